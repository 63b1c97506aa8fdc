"""Names that meet, and operators that must not grow with the square of a crowd."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelsmith.operators import aggregates as A
from panelsmith.operators import events as E
from panelsmith.operators import order_stats as OS

T0 = dt.datetime(2024, 1, 1)


def test_groups_may_have_any_name(spark):
    rows = [(k, float(v)) for k in (1, 2) for v in range(k, 9)]
    for name in ("_m", "_h", "_d"):
        got = {r[0]: r.q for r in OS.exact_quantiles(spark.createDataFrame(rows, f"{name} int, v double"), [name], "v", {"q": 0.5}).collect()}
        assert got == {1: 4.5, 2: 5.0}


@pytest.mark.parametrize("sub_daily", [False, True])
def test_typical_lift_is_against_the_same_season(spark, sub_daily):
    step = dt.timedelta(hours=1) if sub_daily else dt.timedelta(days=31)
    times = [T0 + i * step for i in range(24 * 7 * 4 if sub_daily else 36)]
    if not sub_daily:
        times = [dt.datetime(t.year, t.month, 1) for t in times]
    rng = np.random.default_rng(1)
    rows = [("s", t, float(v), bool(e)) for t, v, e in zip(times, rng.integers(1, 1000, len(times)), rng.random(len(times)) < 0.2, strict=True)]
    history = spark.createDataFrame(rows, "series string, ts timestamp_ntz, y double, is_game_day boolean")
    at = times[-1] + (dt.timedelta(hours=5) if sub_daily else dt.timedelta(days=40))
    at = at if sub_daily else dt.datetime(at.year, at.month, 1)
    forecast = spark.createDataFrame([("s", at + step, 1.0), ("s", at, 500.0)], "series string, ts timestamp_ntz, p50 double")
    season = (lambda t: (t.hour, t.weekday())) if sub_daily else (lambda t: t.month)
    want = float(np.median([v for _, t, v, e in rows if not e and season(t) == season(at)]))
    got = A.typical_lift(forecast, history, sub_daily).collect()
    assert [(r.ts, r.typical_median, r.reason) for r in got] == [(at, round(want, 1), "")]
    assert got[0].lift_pct == pytest.approx((500.0 - want) / max(want, 1.0) * 100, abs=0.051)


def test_events_of_any_length_and_with_nulls(spark):
    rng = np.random.default_rng(9)
    at = lambda m: T0 + dt.timedelta(minutes=int(m))
    ev = [(at(a), at(a + d), bool(b)) for a, d, b in zip(rng.integers(0, 6000, 60), rng.choice([-30, 0, 5, 60, 900, 3000], 60), rng.random(60) < 0.3, strict=True)]
    ev += ev[:5] + [(at(300), None, True), (None, at(400), True), (at(500), at(560), None), (None, None, True)]
    times = [at(m) for m in range(-600, 7000, 20)] + [at(m) for m in range(-600, 7000, 90)]
    panel = spark.createDataFrame([(t,) for t in [*times, None]], "ts timestamp_ntz")
    events = spark.createDataFrame(ev, "timestamp_start timestamp_ntz, timestamp_end timestamp_ntz, is_sharks_game boolean")
    got = {r.ts: r for r in E.event_profile(panel, events).collect()}
    assert set(got) == set(times)
    hours = lambda a, b: (a - b).total_seconds() / 3600
    begun = [(a, max(a, b or a), bool(c)) for a, b, c in ev if a]
    ends = [b for _, b, _ in begun] + [b for a, b, _ in ev if not a and b]
    for t in times:
        active = [(hours(a, t), c) for a, b, c in begun if hours(a, t) <= 3 and hours(t, b) <= 1.5]
        nearest = max([math.exp(-0.5 * (d / 3) ** 2) for d, _ in active], default=0.0)
        r, nxt, last = got[t], min([hours(a, t) for a, _, _ in begun if a > t], default=None), min([hours(t, b) for b in ends if b < t], default=None)
        assert (r.n_active, r.is_sharks_game_window, r.is_pre_event_window) == (len(active), any(c for _, c in active), any(0 <= hours(a, t) <= 3 for a, _, _ in begun))
        assert r.is_post_event_window == (last is not None and last <= 1.5) and r.event_proximity_score == pytest.approx(nearest, abs=1e-12)
        assert (r.hours_to_next_event, r.hours_since_last_event) == (pytest.approx(nxt) if nxt else None, pytest.approx(last) if last else None)


def test_no_frame_ends_unbounded(spark, capsys):
    """Such a frame is computed anew for each row: the square of the rows of a crowded hour."""
    events = spark.createDataFrame([(T0, T0 + dt.timedelta(hours=2), True)], "timestamp_start timestamp_ntz, timestamp_end timestamp_ntz, is_sharks_game boolean")
    E.event_windows(events.select(F.col("timestamp_start").alias("ts")), events).explain("extended")
    plan = capsys.readouterr().out
    assert "unboundedpreceding$" in plan and "unboundedfollowing$" not in plan


@pytest.mark.parametrize("crowded", [None, 3])
@pytest.mark.parametrize("lat, lng", [(37.3, -121.9), (-60.0, 179.99), (-0.01, 0.0), (89.99, 10.0)])
def test_near_events_of_keys_and_starts_met_again(spark, monkeypatch, lat, lng, crowded):
    if crowded:
        monkeypatch.setattr(E, "CROWDED", crowded)
    rng = np.random.default_rng(6)
    wrap = lambda x: (x + 180) % 360 - 180
    spot = lambda: (min(lat + float(rng.uniform(0, 0.05)), 90.0), wrap(lng + float(rng.uniform(0, 0.05 / max(math.cos(math.radians(lat)), 0.01)))))
    points = [(k, T0 + dt.timedelta(hours=float(rng.uniform(0, 9))), *spot()) for k in [*range(30), *range(5), None, None]]
    events = [(f"e{i % 40}", T0 + dt.timedelta(hours=i % 20 / 2), *spot()) for i in range(160)]

    def km(a, b):
        la, lo, lb, lc = map(math.radians, (a[2], a[3], b[2], b[3]))
        h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lc - lo) / 2) ** 2
        return 2 * 6371.0088 * math.asin(math.sqrt(h))

    want = {}
    for p in points:
        for e in events:
            if (d := km(p, e)) <= 1.5 and abs((p[1] - e[1]).total_seconds()) <= 3 * 3600:
                want[p[0], e[0], e[1]] = min(d, want.get((p[0], e[0], e[1]), 9))
    kinds = "timestamp_ntz, lat double, lng double"
    rows = E.near_events(spark.createDataFrame(points, f"id int, at {kinds}"), spark.createDataFrame(events, f"event_name string, timestamp_start {kinds}"), "id", "at").collect()
    assert len(rows) == len(want) > 20 and {(r.id, r.event_name, r.timestamp_start): pytest.approx(r.km, abs=1e-6) for r in rows} == want


def test_near_events_in_the_middle_of_a_cell(spark):
    spots = [(37.3 + i * 0.01, -121.9 + j * 0.01) for i in range(31) for j in range(31)]
    points = spark.createDataFrame([(i, T0, *p) for i, p in enumerate(spots)], "id int, at timestamp_ntz, lat double, lng double")
    events = spark.createDataFrame([(str(i), T0, *p) for i, p in enumerate(spots)], "event_name string, timestamp_start timestamp_ntz, lat double, lng double")
    # Steps are 1.11 km in latitude and 0.88 in longitude, 1.42 across.
    near = sum(1 for a in range(31) for b in range(31) for c in (-1, 0, 1) for d in (-1, 0, 1) if 0 <= a + c < 31 and 0 <= b + d < 31)
    assert E.near_events(points, events, "id", "at").count() == near


def test_pairs_of_near_events_are_not_dealt_anew(spark):
    points = spark.createDataFrame([(i, T0, 37.3, -121.9) for i in range(300)], "id int, at timestamp_ntz, lat double, lng double")
    events = spark.createDataFrame([(f"e{i}", T0, 37.3, -121.9) for i in range(300)], "event_name string, timestamp_start timestamp_ntz, lat double, lng double")
    near = E.near_events(points, events, "id", "at")
    assert near.count() == 90000
    lines = near._jdf.queryExecution().executedPlan().toString().splitlines()
    join = next(i for i, line in enumerate(lines) if "Join [_r" in line)
    assert not [line for line in lines[:join] if "Exchange" in line]


def test_near_events_of_places_shared_by_many_keys(spark, monkeypatch):
    monkeypatch.setattr(E, "CARRIED", 3)
    spots = [(37.3 + i * 0.01, -121.9 + j * 0.01) for i in range(3) for j in range(3)]
    points = [(k, T0 + dt.timedelta(hours=k % 2 * 4), *spots[k % 3]) for k in range(40)] + [(None, T0, *spots[0]), (3, T0, *spots[8]), (7, T0, 37.3, 238.1), (8, None, *spots[0]), (9, T0, None, -121.9)]
    events = [(n, T0 + dt.timedelta(hours=h), *spots[p]) for n, h, p in [("a", 1, 0), ("a", 1, 0), ("b", 1, 1), ("b", 1, 4), ("b", 1, 8), ("c", 1, 1), ("c", 2, 4), (None, 3, 0), (None, 3, 1), ("d", 9, 0)]] + [("e", T0, None, 1.0), ("f", None, *spots[0])]

    def km(a, b):
        la, lo, lb, lc = map(math.radians, (a[2], a[3], b[2], b[3]))
        return 2 * 6371.0088 * math.asin(math.sqrt(math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lc - lo) / 2) ** 2))

    want = {}
    for p in points:
        for e in events:
            if None not in (*p[1:], *e[1:]) and (d := km(p, e)) <= 1.5 and abs((p[1] - e[1]).total_seconds()) <= 3 * 3600:
                want[p[0], e[0], e[1]] = min(d, want.get((p[0], e[0], e[1]), 9))
    kinds = "timestamp_ntz, lat double, lng double"
    sides = spark.createDataFrame(points * 2, f"id int, at {kinds}"), spark.createDataFrame(events, f"event_name string, timestamp_start {kinds}")
    for digits in (None, 2):
        rows = E.near_events(*sides, "id", "at", digits=digits).collect()
        assert len(rows) == len(want) > 100 and {(r.id, r.event_name, r.timestamp_start): r.km for r in rows} == {k: pytest.approx(d if digits is None else round(d, digits), abs=1e-6) for k, d in want.items()}


@pytest.mark.parametrize("lat", [89.99, 0.0])
def test_near_events_across_the_180th_meridian_are_put_out_once(spark, lat):
    points = [(i, T0, lat, lng) for i, lng in enumerate((179.999, -180.0, 180.0, -179.999, 180.001))]
    events = [(str(i), T0, lat, lng) for i, lng in enumerate((179.998, -179.998, 180.0, -180.0, 539.999))]
    kinds = "timestamp_ntz, lat double, lng double"
    got = E.near_events(spark.createDataFrame(points, f"id int, at {kinds}"), spark.createDataFrame(events, f"event_name string, timestamp_start {kinds}"), "id", "at").collect()
    assert sorted((r.id, r.event_name) for r in got) == [(i, str(j)) for i in range(5) for j in range(5)]


def test_pairs_of_near_events_are_put_out_as_they_arise(spark):
    """Where an event is met at one place no pair is grouped, and keys at one place and time are told apart after the search."""
    points = spark.createDataFrame([(i, T0, 37.3, -121.9) for i in range(300)], "id int, at timestamp_ntz, lat double, lng double")
    events = spark.createDataFrame([(f"e{i}", T0, 37.3, -121.9) for i in range(300)], "event_name string, timestamp_start timestamp_ntz, lat double, lng double")
    lines = E.near_events(points, events, "id", "at")._jdf.queryExecution().executedPlan().toString().splitlines()
    above = lines[: next(i for i, line in enumerate(lines) if "Join [_r" in line)]
    assert [line for line in above if "Generate inline(_keys" in line] and not [line for line in above if "Aggregate" in line]


def test_the_gate_reads_the_orders_once(spark, monkeypatch):
    """Its checks run one by one; each would join the orders with all customers, sent out by the driver, again."""
    from panelsmith.catalog import checks as C
    from panelsmith.catalog import fixtures as X
    from panelsmith.catalog import load
    from panelsmith.catalog.registry import QUERIES, Tables

    load()
    made, p1 = [], X.p1
    monkeypatch.setattr(X, "p1", lambda t: made.append(p1(t)) or made[-1])
    assert C.X is X and QUERIES["gate_run"](Tables(spark, "/root/testdata/sf0.001")).count() == 30
    assert len(made) == 1
