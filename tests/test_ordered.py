"""Row blocks, as-of lookups, order statistics and spans against brute force."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelsmith.operators import order_stats as OS
from panelsmith.operators import panel as P
from panelsmith.operators import spans as S
from panelsmith.operators.ordered import keep_latest, nearest_after, nearest_before, windowed_by_rows

T0 = dt.datetime(2024, 1, 1)


def skewed_panel(spark, n=4000, seed=3):
    """Series 'hot' holds most rows; time stamps are irregular."""
    rng = np.random.default_rng(seed)
    series = rng.choice(["hot", "a", "b"], n, p=[0.8, 0.1, 0.1])
    steps = np.sort(rng.choice(np.arange(n * 40), n, replace=False))
    pdf = pd.DataFrame({"series": series, "ts": [T0 + dt.timedelta(minutes=int(s)) for s in steps], "y": rng.integers(0, 1000, n).astype(float)})
    return pdf, spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz")).repartition(7)


@pytest.mark.parametrize("block", [5, 64, 100000])
def test_row_blocks_equal_whole_windows(spark, block):
    pdf, df = skewed_panel(spark)
    out = windowed_by_rows(
        df, ["series"], ["ts"], 4, lambda w: {"lag3": F.lag("y", 3).over(w), "sum5": F.sum("y").over(w.rowsBetween(-4, 0))},
        F.col("ts").cast("date"), block,
    ).toPandas().sort_values(["series", "ts"]).reset_index(drop=True)
    want = pdf.sort_values(["series", "ts"]).reset_index(drop=True)
    g = want.groupby("series")["y"]
    assert len(out) == len(want)
    np.testing.assert_array_equal(out["lag3"].to_numpy(), g.shift(3).to_numpy())
    np.testing.assert_array_equal(out["sum5"].to_numpy(), g.transform(lambda x: x.rolling(5, min_periods=1).sum()).to_numpy())


def test_nearest_is_strict_and_crosses_slots(spark):
    marks = [T0, T0 + dt.timedelta(hours=30), T0 + dt.timedelta(days=9)]
    pts = [T0 - dt.timedelta(hours=1), T0, T0 + dt.timedelta(hours=1), T0 + dt.timedelta(hours=30), T0 + dt.timedelta(days=8), T0 + dt.timedelta(days=20)]
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "ts timestamp_ntz")
    before = {r.ts: r.m for r in nearest_before(frame(pts + pts), frame(marks), "ts", "m").collect()}
    after = {r.ts: r.m for r in nearest_after(frame(pts), frame(marks), "ts", "m").collect()}
    for p in pts:
        assert before[p] == max([m for m in marks if m < p], default=None)
        assert after[p] == min([m for m in marks if m > p], default=None)


def test_exact_quantiles_match_numpy_with_ties_and_groups(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": rng.choice(["x", "y"], 3000, p=[0.9, 0.1]), "v": np.where(rng.random(3000) < 0.4, 0.0, np.round(rng.normal(0, 50, 3000), 2))})
    got = OS.exact_quantiles(spark.createDataFrame(pdf), ["g"], "v", {"a": 0.1, "m": 0.5, "z": 0.95}).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        np.testing.assert_allclose(got.loc[g, ["a", "m", "z"]].astype(float), np.quantile(part["v"], [0.1, 0.5, 0.95]), rtol=1e-12, atol=1e-12)
        assert got.loc[g, "n"] == len(part)
    whole = OS.exact_quantiles(spark.createDataFrame(pdf), [], "v", {"m": 0.5}).first()
    assert whole["m"] == np.quantile(pdf["v"], 0.5) and whole["n"] == 3000


def test_value_bucket_never_decreases(spark):
    xs = sorted([-float("inf"), -1e9, -3.5, -1e-9, 0.0, 1e-9, 0.5, 1.0, 1.0001, 7.0, 1e9, float("inf")])
    b = [r.b for r in spark.createDataFrame([(x,) for x in xs], "x double").select("x", OS.value_bucket("x").alias("b")).orderBy("x").collect()]
    assert b == sorted(b)


def test_average_ranks_match_pandas(spark):
    pdf = pd.DataFrame({"g": ["a"] * 7, "v": [3.0, 1.0, 3.0, 2.0, 2.0, 2.0, 9.0], "i": range(7)})
    got = OS.average_ranks(spark.createDataFrame(pdf), ["g"], "v", "r").toPandas().sort_values("i")
    np.testing.assert_array_equal(got["r"], pdf["v"].rank())


def test_keep_latest_does_not_depend_on_order(spark):
    rows = [("k", i, f"v{i}") for i in range(50)] + [("l", 1, "only")]
    for seed in (1, 2):
        df = spark.createDataFrame(rows, "k string, version int, v string").orderBy(F.rand(seed)).repartition(5)
        assert {(r.k, r.v) for r in keep_latest(df, ["k"], ["version"]).collect()} == {("k", "v49"), ("l", "only")}


def test_spans_touching_days_join_and_gaps_stay(spark):
    d = dt.date
    rows = [(d(2019, 9, 1), d(2019, 12, 31)), (d(2020, 1, 1), d(2020, 2, 10)), (d(2020, 2, 12), d(2020, 3, 31)), (d(2020, 2, 15), d(2020, 2, 20))]
    s = spark.createDataFrame(rows, "span_start date, span_end date")
    assert sorted((r.span_start, r.span_end) for r in S.merge_spans(s).collect()) == [(d(2019, 9, 1), d(2020, 2, 10)), (d(2020, 2, 12), d(2020, 3, 31))]
    # February is split by a one-day gap, so it is not covered; whole months inside a span are.
    months = sorted(r.month_ts.date() for r in S.covered_months(s).collect())
    assert months == [d(2019, 9, 1), d(2019, 10, 1), d(2019, 11, 1), d(2019, 12, 1), d(2020, 1, 1), d(2020, 3, 1)]


def gapped(spark):
    """Series A, B; 2019 and 2022-2023 only; B lacks 2023-05."""
    rows = []
    for s, base in (("A", 1000), ("B", 5000)):
        for y in (2019, 2022, 2023):
            for m in range(1, 13):
                if (s, y, m) != ("B", 2023, 5):
                    rows.append((s, dt.datetime(y, m, 1), float(base + (y - 2019) * 200 + m * m)))
    return rows, spark.createDataFrame(rows, "series string, ts timestamp_ntz, y double")


def test_calendar_lags_skip_gaps(spark):
    rows, df = gapped(spark)
    value = {(s, t.year, t.month): v for s, t, v in rows}
    for r in P.calendar_lags(df).collect():
        for k in P.MONTHLY_LAGS:
            i = r.ts.year * 12 + r.ts.month - 1 - k
            assert r[f"y_lag_{k}"] == value.get((r.series, i // 12, i % 12 + 1))


def test_calendar_rolling_counts_only_months_with_data(spark):
    rows, df = gapped(spark)
    value = {(s, t.year * 12 + t.month - 1): v for s, t, v in rows}
    for r in P.calendar_rolling(df).collect():
        i = r.ts.year * 12 + r.ts.month - 1
        three = [value[(r.series, i - k)] for k in (1, 2, 3) if (r.series, i - k) in value]
        twelve = [value[(r.series, i - k)] for k in range(1, 13) if (r.series, i - k) in value]
        assert r["y_rolling_mean_3mo"] == (pytest.approx(np.mean(three)) if len(three) >= 2 else None)
        assert r["y_rolling_std_3mo"] == (pytest.approx(np.std(three, ddof=1)) if len(three) >= 2 else None)
        assert r["y_rolling_mean_12mo"] == (pytest.approx(np.mean(twelve)) if len(twelve) >= 6 else None)


def test_duplicate_month_raises_and_cadence_is_detected(spark):
    _, df = gapped(spark)
    extra = spark.createDataFrame([("A", dt.datetime(2022, 3, 20), 1.0)], df.schema)
    with pytest.raises(ValueError, match="A 2022-03"):
        P.add_lags(df.unionByName(extra), cadence="monthly")
    assert P.is_monthly(df) and not P.is_sub_daily(df)
    assert "y_lag_12" in P.add_lags(df).columns


def test_rain_onset_is_three_valued(spark):
    flags = [None, True, True, False, None, False, True]
    rows = [("s", T0 + dt.timedelta(hours=i), f) for i, f in enumerate(flags)]
    got = [r.is_rain_onset for r in P.rain_onset(spark.createDataFrame(rows, "series string, ts timestamp_ntz, is_raining boolean")).orderBy("ts").collect()]
    assert got == [None, None, False, False, None, False, True]
