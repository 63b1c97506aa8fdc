"""Event windows and coverage against brute force; unknown stays apart from zero."""

import datetime as dt
import math

import numpy as np
from pyspark.sql import functions as F

from panelsmith.operators import events as E
from panelsmith.operators import places as PL

T0 = dt.datetime(2023, 3, 1)


def frames(spark, seed=11, n_events=25, hours=24 * 31):
    rng = np.random.default_rng(seed)
    ev = [(T0 + dt.timedelta(minutes=int(m)), bool(rng.random() < 0.4)) for m in rng.integers(0, hours * 60, n_events)]
    ev = [(a, a + dt.timedelta(hours=int(rng.integers(1, 5))), b) for a, b in ev]
    grid = [("s", T0 + dt.timedelta(hours=i)) for i in range(hours)]
    return ev, grid, spark.createDataFrame(ev, "timestamp_start timestamp_ntz, timestamp_end timestamp_ntz, is_sharks_game boolean"), spark.createDataFrame(grid, "series string, ts timestamp_ntz")


def test_event_features_match_row_by_row_search(spark):
    ev, grid, events, panel = frames(spark)
    got = {r.ts: r for r in E.add_event_features(panel, events).collect()}
    assert len(got) == len(grid)
    for _, t in grid:
        ds = [((a - t).total_seconds() / 3600, (b - t).total_seconds() / 3600, s) for a, b, s in ev]
        pre = [x for x in ds if 0 <= x[0] <= 3]
        post = [x for x in ds if -1.5 <= x[1] < 0]
        active = [x for x in ds if (0 <= x[0] <= 3) or (x[0] <= 0 <= x[1]) or (-1.5 <= x[1] < 0)]
        r = got[t]
        assert r.is_pre_event_window == bool(pre) and r.is_post_event_window == bool(post) and r.is_any_event_day == bool(active)
        assert r.is_sharks_game_window == any(x[2] for x in active)
        assert abs(r.event_proximity_score - max([math.exp(-0.5 * (x[0] / 3) ** 2) for x in active], default=0.0)) < 1e-9
        nxt = min([x[0] for x in ds if x[0] > 0], default=None)
        last = max([x[1] for x in ds if x[1] < 0], default=None)
        assert (r.hours_to_next_event is None) == (nxt is None) and (nxt is None or abs(r.hours_to_next_event - nxt) < 1e-6)
        assert (r.hours_since_last_event is None) == (last is None) and (last is None or abs(r.hours_since_last_event + last) < 1e-6)


def test_covered_empty_month_is_zero_and_uncovered_is_unknown(spark):
    d = dt.date
    ev = spark.createDataFrame([(dt.datetime(2019, 9, 17, 19), True, False, 19), (dt.datetime(2019, 9, 20, 20), False, False, 20)], "timestamp_start timestamp_ntz, is_sharks_game boolean, is_playoff boolean, game_start_hour int")
    spans = spark.createDataFrame([(d(2019, 9, 1), d(2019, 11, 30))], "span_start date, span_end date")
    panel = spark.createDataFrame([("A", dt.datetime(2019, m, 1)) for m in (8, 9, 10, 12)], "series string, ts timestamp_ntz")
    r = {x.ts.month: x for x in E.add_monthly_events(panel, ev, spans).collect()}
    assert r[8].is_game_day is None and r[8].hours_to_event is None and r[12].is_sharks_game is None
    assert r[9].is_game_day is True and r[9].hours_to_event == 2.0 and r[9].game_start_hour == 19.0
    assert r[10].is_game_day is False and r[10].hours_to_event == 0.0 and r[10].game_start_hour is None
    f = {x.ts.month: x for x in E.add_monthly_event_features(panel, ev, spans).collect()}
    assert f[9].event_proximity_score == 1.0 and f[10].event_proximity_score == 0.0 and f[8].event_proximity_score is None
    assert (f[9].nearest_event_attendance_tier, f[10].nearest_event_attendance_tier) == (2.0, 0.0)


def test_near_events_finds_every_pair(spark):
    rng = np.random.default_rng(2)
    pts = [(i, T0 + dt.timedelta(hours=float(rng.uniform(0, 50))), 37.3 + float(rng.uniform(0, 0.06)), -121.9 + float(rng.uniform(0, 0.06))) for i in range(60)]
    ev = [(f"e{i}", T0 + dt.timedelta(hours=float(rng.uniform(0, 50))), 37.3 + float(rng.uniform(0, 0.06)), -121.9 + float(rng.uniform(0, 0.06))) for i in range(200)]

    def km(a, b):
        la, lo, lb, lc = map(math.radians, (a[2], a[3], b[2], b[3]))
        h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lc - lo) / 2) ** 2
        return 2 * 6371.0088 * math.asin(math.sqrt(h))

    want = {(p[0], e[0]) for p in pts for e in ev if km(p, e) <= 1.5 and abs((p[1] - e[1]).total_seconds()) <= 3 * 3600}
    got = E.near_events(spark.createDataFrame(pts, "id int, at timestamp_ntz, lat double, lng double"), spark.createDataFrame(ev, "event_name string, timestamp_start timestamp_ntz, lat double, lng double"), "id", "at")
    assert {(r.id, r.event_name) for r in got.collect()} == want and want


def test_alert_periods(spark):
    rows = [(["a", "b"], "always", []), (["a"], "open start", [(0, 50)]), (["a"], "over", [(1, 49)]), (["c"], "unknown agency", []), (["a"], "open end", [(40, 0)])]
    df = spark.createDataFrame(rows, "agency_ids array<string>, header string, periods array<struct<start: bigint, end: bigint>>")
    got = {(r.agency, r.header) for r in E.active_alerts(df, 50, {"a": "BART", "b": "VTA", "c": "Other"}, ["BART", "VTA"]).collect()}
    assert got == {("BART", "always"), ("VTA", "always"), ("BART", "open start"), ("BART", "open end")}


def test_place_tiers(spark):
    dim = spark.createDataFrame([("EM", "Embarcadero"), ("12", "12th St. Oakland City Center"), ("19", "19th St. Oakland"), ("DB", "Downtown Berkeley"), ("NB", "North Berkeley"), ("BE", "Berryessa/North San José"), ("SO", "International Airport")], "code string, label string")
    names = ["embarcadero station", "12th Street / Oakland", "Berkeley", "Oakland", "Embarcadro", "SFO", "north berkley", "xyzzy", "the", "berryessa north san jose"]
    q = spark.createDataFrame([(n,) for n in names], "q string")
    got = {r.q: (r.station, r.tier) for r in PL.match_places(q, dim, "q", "code", "label", {"sfo": "SO"}).collect()}
    assert got["embarcadero station"] == ("EM", "exact")
    assert got["12th Street / Oakland"] == ("12", "subset")
    assert got["Berkeley"] == (None, "subset") and got["Oakland"] == (None, "subset")
    assert got["Embarcadro"] == ("EM", "fuzzy") and got["north berkley"] == ("NB", "fuzzy")
    assert got["SFO"] == ("SO", "alias") and got["xyzzy"] == (None, "none") and got["the"] == (None, "none")
    assert got["berryessa north san jose"] == ("BE", "exact")


def test_fuzzy_candidates_lose_no_pair(spark):
    from difflib import SequenceMatcher

    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcde "), rng.integers(6, 14))).strip() or "a" for _ in range(60)]
    near = [w[:2] + w[3:] for w in words] + [w + "e" for w in words]
    q, d = spark.createDataFrame([(w,) for w in near], "q string"), spark.createDataFrame([(w,) for w in words], "d string")
    got = {(r._q, r._d) for r in PL.fuzzy_candidates(q, d, "q", "d").collect()}
    want = {(a, b) for a in set(near) for b in set(words) if a and b and SequenceMatcher(None, a, b).ratio() >= 0.88}
    assert want <= got and want


def test_region_and_same_place(spark):
    df = spark.createDataFrame([(37.5, -122.0), (37.0, -122.5), (38.6, -122.5), (None, 1.0), (float("nan"), -122.0)], "lat double, lng double")
    assert [r.x for r in df.select(PL.in_region("lat", "lng").alias("x")).collect()] == [True, False, True, False, False]
    t = spark.createDataFrame([("Palo Alto, San Francisco Bay Area, CA", "palo  alto"), ("a", "b")], "a string, b string")
    assert [r.x for r in t.select(PL.same_place_text("a", "b").alias("x")).collect()] == [True, False]
    assert df.select(F.lit(1)).count() == 5
