"""Store builds that must be refused, holidays of any year, order checks, and cells that follow the data."""

import bisect
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelsmith.functions.holidays import federal_holidays, holiday_flags
from panelsmith.operators import events as E
from panelsmith.operators import joins as J
from panelsmith.operators import order_stats as OS
from panelsmith.operators import places as PL
from panelsmith.operators import quality as Q
from panelsmith.operators.calibration import series_folds
from panelsmith.operators.ordered import nearest_after, quantile_cuts, with_piece, with_text_range
from panelsmith.plans import feature_store as FS


def test_holidays_of_any_year_equal_the_rule(spark):
    want = {d for d, _ in federal_holidays(1990, 2060)}
    days = [(dt.date(1990, 1, 1) + dt.timedelta(days=i),) for i in range((dt.date(2061, 1, 1) - dt.date(1990, 1, 1)).days)]
    got = spark.createDataFrame(days, "d date").select("d", *[c.alias(n) for n, c in holiday_flags("d").items()]).collect()
    assert {r.d for r in got if r.is_holiday} == want
    assert {r.d + dt.timedelta(days=1) for r in got if r.is_holiday_eve and r.d.year < 2060} == {d for d in want if d > dt.date(1990, 1, 1) and d <= dt.date(2060, 1, 1)}


def od(spark, rows):
    return spark.createDataFrame(rows, "period string, day_type string, origin string, riders double").withColumn("period", F.col("period").cast("timestamp_ntz"))


def test_store_refuses_ambiguous_months(spark):
    rows = [("2019-01-01", "Total Trips", "A", 10.0), ("2019-02-01", "Avg Weekday", "A", 3.0), ("2019-03-01", "Total Trips", "A", 10.0), ("2019-03-01", "Total trips (rev)", "A", 10.0)]
    with pytest.raises(ValueError, match="2 months"):
        FS.build_feature_store(od(spark, rows), None, None)
    kept = FS.build_feature_store(od(spark, rows), None, None, ambiguous="drop").collect()
    assert [(r.ts.month, r.y) for r in kept] == [(1, 10.0)]
    assert {(r.period.month, r.n_total_blocks) for r in FS.refused_months(od(spark, rows)).collect()} == {(2, 0), (3, 2)}


def test_weather_without_mapping_is_the_regions(spark):
    hourly = spark.createDataFrame([("w1", "2019-01-05 01:00:00", 10.0, 1), ("w2", "2019-01-06 01:00:00", 20.0, 1), ("w2", "2019-01-07 01:00:00", 30.0, 2)], "station string, ts string, temp_f double, weather_code long").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    store = FS.build_feature_store(od(spark, [("2019-01-01", "Total", "A", 1.0)]), hourly, None).collect()
    assert [(r.temp_f, r.weather_code) for r in store] == [(20.0, 1)]
    panel = spark.createDataFrame([("A", "2019-01-01"), ("B", "2019-01-01")], "series string, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    mapping = spark.createDataFrame([("A", "w2")], "series string, weather_station string")
    got = {r.series: r.temp_f for r in J.weather_or_region(panel, J.monthly_weather(hourly), mapping).collect()}
    assert got == {"A": 25.0, "B": 20.0}


def test_a_step_back_across_months_is_found(spark):
    rows = [("A", "2024-02-01 00:00:00", 1), ("A", "2024-01-01 00:00:00", 2), ("A", "2024-03-01 00:00:00", 30_000)]
    df = spark.createDataFrame(rows, "series string, ts string, arrived long").select("series", F.col("ts").cast("timestamp_ntz").alias("ts"), "arrived", F.lit(1.0).alias("y"))
    for arrival in ("arrived", "at"):
        seen = df.withColumn("at", F.col("ts").cast("timestamp_ntz") if arrival == "arrived" else F.timestamp_seconds(F.col("arrived") * 3600).cast("timestamp_ntz"))
        found = {r["check"]: r.severity for r in Q.run_checks(seen, cadence="hourly", arrival=arrival).collect()}
        assert found["timestamp_monotonic"] == "WARNING"


def test_neighbours_across_the_180th_meridian(spark):
    points = spark.createDataFrame([(1, "2024-01-01 10:00:00", 10.0, 179.9999), (2, "2024-01-01 10:00:00", 10.0, -179.9999), (3, "2024-01-01 10:00:00", 10.0, 0.0)], "k long, at string, lat double, lng double").withColumn("at", F.col("at").cast("timestamp_ntz"))
    events = spark.createDataFrame([("e", "2024-01-01 11:00:00", 10.0, -179.9999), ("f", "2024-01-01 11:00:00", 10.0, 179.9999)], "event_name string, timestamp_start string, lat double, lng double").withColumn("timestamp_start", F.col("timestamp_start").cast("timestamp_ntz"))
    got = {(r.k, r.event_name) for r in E.near_events(points, events, "k", "at").collect()}
    assert got == {(1, "e"), (1, "f"), (2, "e"), (2, "f")}


def test_aliases_need_their_station_and_accents_fold(spark):
    dim = spark.createDataFrame([("A", "Atown"), ("L", "Lodz Szeged")], "code string, label string")
    names = spark.createDataFrame([("sfo",), ("atwn",), ("Ātown",), ("Łódź SZEGÉD",)], "q string")
    got = {r.q: (r.station, r.tier) for r in PL.match_places(names, dim, "q", "code", "label", {"sfo": "SO", "atwn": "A"}, fuzzy=False).collect()}
    assert got == {"sfo": (None, "none"), "atwn": ("A", "alias"), "Ātown": ("A", "exact"), "Łódź SZEGÉD": ("L", "exact")}


def test_names_with_a_common_beginning_spread(spark):
    names = spark.range(3000).select(F.format_string("Customer#%06d", "id").alias("n"))
    ranged = with_text_range(names, "n", "r")
    assert ranged.select("r").distinct().count() >= 30
    rows = ranged.orderBy("n").collect()
    assert [r.r for r in rows] == sorted(r.r for r in rows)
    assert with_text_range(names.limit(1), "n", "r").count() == 1 and with_text_range(names.limit(0), "n", "r").count() == 0
    folds = {r.n: r.fold for r in series_folds(names, 5, "n").collect()}
    assert all(folds[f"Customer#{i:06d}"] == i % 5 for i in range(3000))


def test_one_outlier_does_not_join_names(spark):
    # The common beginning of all names is empty here: ranges follow the names themselves.
    names = spark.range(4000).select(F.when(F.col("id") == 0, F.lit("Zed")).otherwise(F.format_string("Customer#%06d", "id")).alias("n"))
    sizes = [r["count"] for r in with_text_range(names, "n", "r").groupBy("r").count().collect()]
    assert len(sizes) > 150 and max(sizes) < 4000 / 25


def in_cells(spark, monkeypatch, values, most):
    """Exact quantiles with buckets that count as crowded above ``most`` values, and the largest cell that they order."""
    monkeypatch.setattr(OS, "CROWDED", most)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    merged = OS.merged_values(df, [], "v", F.lit(1))
    totals = OS._bucket_totals(merged, [])
    cut = OS.within_bucket(F.col("_v"), F.col("_low"), F.col("_high"), F.col("_values"))
    cells = merged.join(totals, "_bucket").withColumn("_cut", cut).groupBy("_bucket", "_cut").count().agg(F.max("count")).first()[0]
    return OS.spread(df, [], "v", {"q1": 0.25, "median": 0.5, "q3": 0.75}, "median", 0.1).first(), cells


@pytest.mark.parametrize("low, high", [(1e-9, 9e-4), (1e6, 1.0005e6), (-1.0002, -1.0), (1.7e9, 1.7000001e9)])
def test_cells_follow_the_data(spark, monkeypatch, low, high):
    n, most = 4000, 200
    values = low + (high - low) * np.arange(n) / n
    got, cells = in_cells(spark, monkeypatch, values, most)
    assert cells <= 2 * most
    want = [*np.quantile(values, [0.25, 0.5, 0.75]), np.quantile(np.abs(values - np.median(values)), 0.5), np.sort(values)[400:3600].mean()]
    np.testing.assert_allclose([got.q1, got.median, got.q3, got.mad, got.trimmed_mean], want, rtol=1e-9)


def test_average_ranks_in_crowded_cells(spark, monkeypatch):
    monkeypatch.setattr(OS, "CROWDED", 50)
    values = 1e6 + np.repeat(np.arange(900) / 10, 3)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = {r.v: r.r for r in OS.average_ranks(df, [], "v", "r").collect()}
    assert all(got[v] == 3 * i + 2 for i, v in enumerate(1e6 + np.arange(900) / 10))


def test_a_crowded_hour_is_cut(spark):
    # A third of all distinct times lies in one second of one hour; no piece holds more than twice its share.
    times = [dt.datetime(2024, 1, 1) + dt.timedelta(hours=i) for i in range(4000)] + [dt.datetime(2024, 1, 9, 5, 0, 0, i * 400) for i in range(2000)]
    df = spark.createDataFrame([(t,) for t in times], "ts timestamp_ntz")
    sizes = [r["count"] for r in with_piece(df, F.col("ts"), quantile_cuts(df, F.col("ts"), 64), "p", 64).groupBy("p").count().collect()]
    assert len(sizes) == 64 and max(sizes) <= 2 * len(times) / 64
    marks = spark.createDataFrame([(t,) for t in times[1::3]], "ts timestamp_ntz")
    after = {r.ts: r.m for r in nearest_after(df, marks, "ts", "m").collect()}
    ordered, marked = sorted(times), sorted(times[1::3])
    assert all(after[t] == next((m for m in marked[bisect.bisect_right(marked, t):]), None) for t in ordered)


def test_events_of_a_crowded_second(spark):
    # Intervals of different lengths that open in the same second, and points among their ends.
    t0, rng = dt.datetime(2024, 1, 1, 8), np.random.default_rng(4)
    ev = [(t0 + dt.timedelta(microseconds=int(m)), t0 + dt.timedelta(hours=2, microseconds=int(k)), bool(b)) for m, k, b in zip(rng.integers(0, 900_000, 700), rng.integers(0, 900_000, 700), rng.random(700) < 0.3, strict=True)]
    pts = [t0 + dt.timedelta(hours=int(h), microseconds=int(m)) for h, m in zip(rng.choice([-3, 0, 2, 3], 400), rng.integers(0, 900_000, 400), strict=True)]
    points = spark.createDataFrame([(t,) for t in pts], "ts timestamp_ntz")
    events = spark.createDataFrame(ev, "lo timestamp_ntz, hi timestamp_ntz, big boolean")
    found = {r.ts: (r.n or 0, r.last, r.big) for r in E.stabbing(points, events.withColumn("one", F.lit(1)), "ts", "lo", "hi", {"n": ("sum", "one"), "last": ("max", "lo"), "big": ("max", "big")}).collect()}
    for t in pts:
        over = [(a, c) for a, b, c in ev if a <= t <= b]
        assert found[t] == (len(over), max((a for a, _ in over), default=None), any(c for _, c in over) if over else None)
