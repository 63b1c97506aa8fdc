"""Window operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import safe_ratio
from ..operators import panel as P
from ..operators.order_stats import running_mass
from . import fixtures as X
from .common import flag, rnd
from .fixtures import with_
from .registry import query

_M = "year(ts) * 12 + month(ts)"


def _range(a, b, fn="first_value(y)"):
    return f"{fn} OVER (PARTITION BY series ORDER BY {_M} RANGE BETWEEN {a} PRECEDING AND {b} PRECEDING)"


@query("win_lag_calendar", with_(["p1"], "SELECT series, ts, y, " + ", ".join(f"{_range(k, k)} AS y_lag_{k}" for k in P.MONTHLY_LAGS) + " FROM p1"))
def _(t):
    return P.calendar_lags(X.p1(t))


@query("win_roll_calendar", with_(["p1"], "SELECT series, ts, " + ", ".join(
    f"round(CASE WHEN {_range(n, 1, 'count(y)')} >= {least} THEN {_range(n, 1, fn)} END, 3) AS {name}"
    for n, least, fn, name in ((3, 2, "avg(y)", "y_rolling_mean_3mo"), (3, 2, "stddev_samp(y)", "y_rolling_std_3mo"), (12, 6, "avg(y)", "y_rolling_mean_12mo"))) + " FROM p1"))
def _(t):
    names = ["y_rolling_mean_3mo", "y_rolling_std_3mo", "y_rolling_mean_12mo"]
    return rnd(P.calendar_rolling(X.p1(t)), 3, *names).select("series", "ts", *names)


@query("win_lag_rows", with_(["p3"], "SELECT station, ts, " + ", ".join(f"lag(temp_f, {k}) OVER (PARTITION BY station ORDER BY ts) AS temp_f_lag_{k}" for k in P.ROW_LAGS) + " FROM p3"))
def _(t):
    out = P.row_lags(X.p3(t), P.ROW_LAGS, "station", "ts", "temp_f", F.col("ts").cast("date"))
    return out.select("station", "ts", *[f"temp_f_lag_{k}" for k in P.ROW_LAGS])


def _rows(n, fn):
    return f"{fn} OVER (PARTITION BY station ORDER BY ts ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


@query("win_roll_rows", with_(["p3"], "SELECT station, ts, " + ", ".join(
    f"round(CASE WHEN {_rows(n, 'count(temp_f)')} >= {least} THEN {_rows(n, fn)} END, 6) AS {name}"
    for n, least, fn, name in ((96, 24, "avg(temp_f)", "temp_f_rolling_mean_24h"), (96, 24, "stddev_samp(temp_f)", "temp_f_rolling_std_24h"), (672, 96, "avg(temp_f)", "temp_f_rolling_mean_7d"))) + " FROM p3"))
def _(t):
    names = ["temp_f_rolling_mean_24h", "temp_f_rolling_std_24h", "temp_f_rolling_mean_7d"]
    return rnd(P.row_rolling(X.p3(t), "station", "ts", "temp_f", F.col("ts").cast("date")), 6, *names).select("station", "ts", *names)


@query("win_precip_sums", with_(["p3"], "SELECT station, ts, " + ", ".join(
    f"round(sum(precip_mm) OVER (PARTITION BY station ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 6) AS precip_{n}hr_sum" for n in (3, 6, 24)) + " FROM p3"))
def _(t):
    names = [f"precip_{n}hr_sum" for n in (3, 6, 24)]
    return rnd(P.precip_sums(X.p3(t), "station", "ts", "precip_mm", F.col("ts").cast("date")), 6, *names).select("station", "ts", *names)


# Hours whose mean value is small count as unknown, so that all three truth values meet.
_RAIN = "CASE WHEN temp_f >= 5 THEN precip_mm > 0.5 END"


@query("win_rain_onset", with_(["p3"], f"SELECT station, ts, {flag('r', 'is_raining')}, {flag('r AND NOT prev', 'is_rain_onset')} FROM (SELECT station, ts, r, lag(r) OVER (PARTITION BY station ORDER BY ts) AS prev FROM (SELECT station, ts, {_RAIN} AS r FROM p3))"))
def _(t):
    df = X.p3(t).withColumn("is_raining", F.when(F.col("temp_f") >= 5, F.col("precip_mm") > 0.5))
    return P.rain_onset(df, "station", "ts", F.col("ts").cast("date")).select("station", "ts", "is_raining", "is_rain_onset")


@query("win_spike_median", with_(["p1"], """SELECT series, ts, y, rolling_median, round(y / rolling_median, 6) AS ratio FROM (
  SELECT *, CASE WHEN count(y) OVER w >= 4 THEN quantile_cont(y, 0.5) OVER w END AS rolling_median FROM p1 WINDOW w AS (PARTITION BY series ORDER BY ts ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
  WHERE rolling_median > 0 AND y / rolling_median > 1.2"""))
def _(t):
    return rnd(P.spikes(X.p1(t), multiple=1.2), 6, "ratio")


@query("win_gap_detect", with_(["p3"], """SELECT station, prev AS gap_start, round(epoch(ts - prev) / 3600.0, 2) AS gap_hours FROM (
  SELECT station, ts, lag(ts) OVER (PARTITION BY station ORDER BY ts) AS prev FROM p3) WHERE epoch(ts - prev) / 3600.0 > 2.0"""))
def _(t):
    return P.gaps(X.p3(t), P.gap_limit_hours(1.0), "station", "ts", F.col("ts").cast("date"))


@query("win_gap_detect_monthly", with_(["p1"], """SELECT series, prev AS gap_start, round(epoch(ts - prev) / 3600.0, 2) AS gap_hours FROM (
  SELECT series, ts, lag(ts) OVER (PARTITION BY series ORDER BY ts) AS prev FROM p1) WHERE epoch(ts - prev) / 3600.0 > 840"""))
def _(t):
    return P.gaps(X.p1(t), P.gap_limit_hours(None))


@query("win_monotonic", """SELECT o_orderpriority AS series, CAST(count(*) AS BIGINT) AS n_steps_back FROM (
  SELECT o_orderpriority, o_orderdate, lag(o_orderdate) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS prev FROM orders) WHERE o_orderdate < prev GROUP BY 1""")
def _(t):
    df = t.orders.select(F.col("o_orderpriority").alias("series"), F.col("o_orderdate").alias("ts"), "o_orderkey")
    return P.out_of_order(df, "o_orderkey", chunk=F.floor(F.col("o_orderkey") / 65536))


@query("win_horizon_dense", with_(["p5"], "SELECT series, ts, dense_rank() OVER (PARTITION BY series ORDER BY ts) AS horizon FROM p5"))
def _(t):
    return P.horizon_dense(X.p5(t)).select("series", "ts", "horizon")


@query("win_first_last_by_order", """SELECT o_custkey AS series, first(o_totalprice ORDER BY o_orderkey) AS first_value, last(o_totalprice ORDER BY o_orderkey) AS last_value FROM orders GROUP BY 1""")
def _(t):
    return P.first_last_by_order(t.orders.withColumnRenamed("o_custkey", "series"), ["series"], "o_totalprice", "o_orderkey")


@query("win_seasonal_naive_index", with_(["actuals", "train"], """SELECT r.series, r.ts, r.i AS idx, v.y AS value FROM (SELECT series, ts, (row_number() OVER (PARTITION BY series ORDER BY ts) - 1) % 12 AS i FROM actuals) r
  JOIN (SELECT series, y, 12 - row_number() OVER (PARTITION BY series ORDER BY ts DESC) AS i, count(*) OVER (PARTITION BY series) AS n FROM train) v ON r.series = v.series AND r.i = v.i WHERE v.n >= 12"""))
def _(t):
    from pyspark.sql import Window

    from ..operators.forecast import season_tail

    p = X.p1(t)
    at = (F.row_number().over(Window.partitionBy("series").orderBy("ts")) - 1) % 12
    rows = X.actuals(t, p).select("series", "ts", at.cast("long").alias("idx"))
    tail = season_tail(p.where(F.col("ts") <= F.lit(X.TRAIN_END).cast("timestamp_ntz")), ["series"], 12)
    return rows.join(tail.select("series", F.col("_idx").cast("long").alias("idx"), F.col("_value").alias("value")), ["series", "idx"])


_SCORED_POOL = "SELECT *, CASE WHEN y IS NULL OR p50 IS NULL THEN NULL WHEN p50 <> 0 THEN abs((y - p50) / p50) WHEN y = p50 THEN 0 ELSE 'inf'::DOUBLE END AS s, power(0.5, ((1999 * 12 + 12) - (year(ts) * 12 + month(ts))) / 6.0) AS w FROM gp6"


@query("win_weighted_cumsum", with_(["gp6"], f"SELECT series, ts, origin, horizon, round(sum(w) OVER (PARTITION BY horizon ORDER BY s NULLS FIRST, w, series, ts, origin ROWS UNBOUNDED PRECEDING), 6) AS cum FROM ({_SCORED_POOL})"))
def _(t):
    from ..operators.calibration import decay, resolved_pool

    pool = resolved_pool(X.gapped(t), X.TRAIN_END).withColumns({"s": F.abs(safe_ratio(F.col("y") - F.col("p50"), "p50")), "w": decay(6.0)})
    return rnd(running_mass(pool, ["horizon"], "s", "w", ["series", "ts", "origin"]), 6, "cum").select("series", "ts", "origin", "horizon", "cum")


@query("win_cadence", with_(["p1", "p3"], """SELECT 'monthly panel' AS panel, h AS median_hours, n AS n_steps, CAST(12 AS BIGINT) AS period FROM (SELECT quantile_cont(d, 0.5) AS h, count(*) AS n FROM (SELECT epoch(ts - lag(ts) OVER (PARTITION BY series ORDER BY ts)) / 3600.0 AS d FROM p1) WHERE d IS NOT NULL)
  UNION ALL SELECT 'hourly panel', h, n, CASE WHEN h >= 600 THEN 12 WHEN h >= 20 THEN 7 WHEN h <= 20 / 60.0 THEN 96 ELSE 24 END FROM (SELECT quantile_cont(d, 0.5) AS h, count(*) AS n FROM (SELECT epoch(ts - lag(ts) OVER (ORDER BY ts)) / 3600.0 AS d FROM (SELECT DISTINCT ts FROM p3)) WHERE d IS NOT NULL)"""))
def _(t):
    a = P.median_step_hours(X.p1(t)).withColumn("panel", F.lit("monthly panel"))
    b = P.median_step_hours(X.p3(t), None).withColumn("panel", F.lit("hourly panel"))
    return a.unionByName(b).withColumn("period", P.seasonal_period("median_hours"))


@query("win_interpolate_time", with_(["p1"], """SELECT series, ts, round(greatest(CASE WHEN y IS NOT NULL THEN y WHEN nv IS NOT NULL THEN pv + (nv - pv) * date_diff('day', pt, ts) / date_diff('day', pt, nt) ELSE pv END, 0), 4) AS y,
  CAST(CAST(y IS NULL AS INTEGER) AS DOUBLE) AS imputed FROM (
  SELECT g.series, g.ts, p.y,
    last_value(CASE WHEN p.y IS NOT NULL THEN g.ts END IGNORE NULLS) OVER b AS pt, last_value(p.y IGNORE NULLS) OVER b AS pv,
    first_value(CASE WHEN p.y IS NOT NULL THEN g.ts END IGNORE NULLS) OVER f AS nt, first_value(p.y IGNORE NULLS) OVER f AS nv
  FROM (SELECT series, unnest(generate_series(min(ts), max(ts), INTERVAL 1 MONTH)) AS ts FROM p1 GROUP BY series) g LEFT JOIN p1 p ON g.series = p.series AND g.ts = p.ts
  WINDOW b AS (PARTITION BY g.series ORDER BY g.ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY g.series ORDER BY g.ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""))
def _(t):
    return rnd(P.interpolate_months(X.p1(t)), 4, "y")


@query("win_mase_scale", with_(["train"], "SELECT round(avg(abs(y - l)), 4) AS mase_scale, count(l) AS n_diffs FROM (SELECT y, lag(y, 12) OVER (PARTITION BY series ORDER BY ts) AS l FROM train)"))
def _(t):
    train = X.p1(t).where(F.col("ts") <= F.lit(X.TRAIN_END).cast("timestamp_ntz"))
    return rnd(P.mase_scale(train, 12), 4, "mase_scale")
