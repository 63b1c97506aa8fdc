"""Operators on a panel: rows keyed by (series, ts), measure y.

Monthly operators partition by series: a series holds at most twelve rows per
year, so one task never holds more than a calendar.  Sub-daily operators take
``chunk`` and go through ``windowed_by_rows``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import col, epoch_seconds, month_index, month_list, month_start
from .ordered import windowed_by_rows

MONTHLY_LAGS = [1, 2, 3, 6, 12]
ROW_LAGS = [4, 8, 12, 96, 192, 672]


def by_month(series: str = "series", ts: str = "ts") -> Window:
    return Window.partitionBy(series).orderBy(month_index(ts))


def calendar_lags(df: DataFrame, lags: list[int] = MONTHLY_LAGS, series: str = "series", ts: str = "ts", y: str = "y") -> DataFrame:
    """Value k calendar months earlier; a missing month gives NULL, never an older row."""
    w = by_month(series, ts)
    return df.withColumns({f"{y}_lag_{k}": F.first(y).over(w.rangeBetween(-k, -k)) for k in lags})


def _guarded(agg: Column, y: str, frame, least: int) -> Column:
    return F.when(F.count(y).over(frame) >= least, agg.over(frame))


def calendar_rolling(df: DataFrame, series: str = "series", ts: str = "ts", y: str = "y") -> DataFrame:
    """Previous 3 months mean/std (2 needed) and previous 12 months mean (6 needed)."""
    w = by_month(series, ts)
    three, twelve = w.rangeBetween(-3, -1), w.rangeBetween(-12, -1)
    return df.withColumns({
        f"{y}_rolling_mean_3mo": _guarded(F.avg(y), y, three, 2),
        f"{y}_rolling_std_3mo": _guarded(F.stddev_samp(y), y, three, 2),
        f"{y}_rolling_mean_12mo": _guarded(F.avg(y), y, twelve, 6),
    })


def duplicate_months(df: DataFrame, series: str = "series", ts: str = "ts") -> DataFrame:
    """(series, month) pairs with more than one row: calendar lags would be ambiguous."""
    keyed = df.where(F.col(series).isNotNull() & F.col(ts).isNotNull())
    return keyed.groupBy(series, month_start(ts).alias("month")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def _lag_columns(y: str, lags: list[int]):
    return lambda w: {f"{y}_lag_{k}": F.lag(y, k).over(w) for k in lags}


def _rolling_columns(y: str):
    def columns(w):
        day, week = w.rowsBetween(-96, -1), w.rowsBetween(-672, -1)
        return {
            f"{y}_rolling_mean_24h": _guarded(F.avg(y), y, day, 24),
            f"{y}_rolling_std_24h": _guarded(F.stddev_samp(y), y, day, 24),
            f"{y}_rolling_mean_7d": _guarded(F.avg(y), y, week, 96),
        }

    return columns


def _precip_columns(precip: str):
    return lambda w: {f"precip_{n}hr_sum": F.sum(precip).over(w.rowsBetween(1 - n, 0)) for n in (3, 6, 24)}


def _onset_columns(w):
    return {"is_rain_onset": F.col("is_raining") & ~F.lag("is_raining").over(w)}


def row_lags(df: DataFrame, lags: list[int] = ROW_LAGS, series: str = "series", ts: str = "ts", y: str = "y", chunk: Column | None = None) -> DataFrame:
    return windowed_by_rows(df, [series], [ts], max(lags), _lag_columns(y, lags), chunk)


def row_rolling(df: DataFrame, series: str = "series", ts: str = "ts", y: str = "y", chunk: Column | None = None) -> DataFrame:
    """Previous 96 rows mean/std (24 needed) and previous 672 rows mean (96 needed)."""
    return windowed_by_rows(df, [series], [ts], 672, _rolling_columns(y), chunk)


def precip_sums(df: DataFrame, series: str = "series", ts: str = "ts", precip: str = "precip_mm", chunk: Column | None = None) -> DataFrame:
    """Trailing 3, 6 and 24 row sums, current row included."""
    return windowed_by_rows(df, [series], [ts], 23, _precip_columns(precip), chunk)


def rain_onset(df: DataFrame, series: str = "series", ts: str = "ts", chunk: Column | None = None) -> DataFrame:
    """Raining now and not on the previous row; unknown stays unknown unless it is dry now."""
    return windowed_by_rows(df, [series], [ts], 1, _onset_columns, chunk)


def row_features(df: DataFrame, series: str = "series", ts: str = "ts", y: str | None = "y", precip: str | None = "precip_mm", chunk: Column | None = None) -> DataFrame:
    """``precip_sums``, ``rain_onset``, ``row_lags`` and ``row_rolling`` in one pass: rows are numbered and cut into blocks once."""
    makers = ([_precip_columns(precip), _onset_columns] if precip else []) + ([_lag_columns(y, ROW_LAGS), _rolling_columns(y)] if y else [])
    if not makers:
        return df
    return windowed_by_rows(df, [series], [ts], 672 if y else 23, lambda w: {n: c for make in makers for n, c in make(w).items()}, chunk)


def spikes(
    df: DataFrame, series: str = "series", ts: str = "ts", y: str = "y", window: int = 12,
    multiple: float = 10.0, chunk: Column | None = None,
) -> DataFrame:
    """Rows above ``multiple`` times the trailing median (current row included, 4 values needed)."""

    def columns(w):
        return {"rolling_median": _guarded(F.percentile(y, F.lit(0.5)), y, w.rowsBetween(1 - window, 0), 4)}

    out = windowed_by_rows(df, [series], [ts], window - 1, columns, chunk)
    return out.where(F.col("rolling_median") > 0).withColumn("ratio", F.col(y) / F.col("rolling_median")).where(F.col("ratio") > multiple)


def gaps(df: DataFrame, max_gap_hours: float, series: str = "series", ts: str = "ts", chunk: Column | None = None) -> DataFrame:
    """(series, gap_start, gap_hours) where the step to the next row is too long."""
    out = windowed_by_rows(df.select(series, ts), [series], [ts], 1, lambda w: {"gap_start": F.lag(ts).over(w)}, chunk)
    hours = (epoch_seconds(ts) - epoch_seconds("gap_start")) / 3600.0
    return out.withColumn("gap_hours", F.round(hours, 2)).where(hours > max_gap_hours).select(series, "gap_start", "gap_hours")


def gap_limit_hours(step_hours: float | None, max_gap_hours: float = 2.0) -> float:
    """Monthly and other calendar steps: 35 days; a fixed step: at least twice the step."""
    return 35 * 24.0 if step_hours is None else max(max_gap_hours, 2 * step_hours)


def out_of_order(df: DataFrame, arrival: str, series: str = "series", ts: str = "ts", chunk: Column | None = None) -> DataFrame:
    """Series whose time stamps decrease in arrival order.

    Spark tables have no row order, so arrival order is a column.
    """
    out = windowed_by_rows(df.select(series, ts, arrival), [series], [arrival], 1, lambda w: {"_prev": F.lag(ts).over(w)}, chunk)
    return out.where(F.col(ts) < F.col("_prev")).groupBy(series).agg(F.count(F.lit(1)).alias("n_steps_back"))


def first_last_by_order(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """(keys, first_value, last_value): the values at the least and largest ``order``, by map-side combined aggregates."""
    return df.groupBy(*keys).agg(F.min_by(value, order).alias("first_value"), F.max_by(value, order).alias("last_value"))


def horizon_dense(df: DataFrame, series: str = "series", ts: str = "ts", out: str = "horizon") -> DataFrame:
    """Forecast step of each row in its series (earliest time stamp = 1)."""
    return df.withColumn(out, F.dense_rank().over(Window.partitionBy(series).orderBy(ts)))


def month_grid(df: DataFrame, series: str = "series", ts: str = "ts") -> DataFrame:
    """Every month between each series' first and last row; built by sequence, not by a cross join."""
    return df.groupBy(series).agg(F.min(ts).alias("_a"), F.max(ts).alias("_b")).select(
        series,
        F.explode(month_list(F.col("_a").cast("date"), F.col("_b").cast("date"))).alias(ts),
    )


def shared_grid(df: DataFrame, series: str = "series", ts: str = "ts") -> DataFrame:
    """Every series on the panel's whole month range: each series carries the two bounds."""
    ends = df.agg(F.min(ts).alias("_a"), F.max(ts).alias("_b"))
    months = month_list(F.col("_a").cast("date"), F.col("_b").cast("date"))
    names = df.select(series).distinct()
    return names.join(F.broadcast(ends), F.lit(True), "left").select(series, F.explode(months).alias(ts))


def interpolate_months(df: DataFrame, series: str = "series", ts: str = "ts", y: str = "y") -> DataFrame:
    """Month means on the full grid, linear in time across gaps, last value carried, floored at 0."""
    monthly = df.groupBy(series, month_start(ts).alias(ts)).agg(F.avg(y).alias(y))
    w = Window.partitionBy(series).orderBy(ts)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(y).isNotNull(), F.struct(F.col(ts).alias("t"), F.col(y).alias("v")))
    g = month_grid(df, series, ts).join(monthly, [series, ts], "left").withColumns({
        "_p": F.last(known, ignorenulls=True).over(back),
        "_n": F.first(known, ignorenulls=True).over(ahead),
    })
    days = lambda a, b: F.datediff(F.col(b).cast("date"), F.col(a).cast("date"))
    between = F.col("_p.v") + (F.col("_n.v") - F.col("_p.v")) * days("_p.t", ts) / F.nullif(days("_p.t", "_n.t"), F.lit(0))
    filled = F.coalesce(F.col(y), between, F.col("_p.v"))
    return g.select(series, ts, F.when(filled.isNotNull(), F.greatest(filled, F.lit(0.0))).alias(y), F.col(y).isNull().alias("imputed"))


def median_step_hours(df: DataFrame, series: str | None = "series", ts: str = "ts") -> DataFrame:
    """One row with the median gap: within series, or over distinct time stamps (series=None)."""
    from .order_stats import exact_quantiles

    if series:
        # The cadence is not known yet, so a series is taken to be long and split by month.
        chunk = F.trunc(F.col(ts).cast("date"), "month")
        stepped = windowed_by_rows(df.select(series, ts), [series], [ts], 1, lambda w: {"_prev": F.lag(ts).over(w)}, chunk)
    else:
        # Distinct time stamps of one panel: ordered within days, the last one carried over days.
        d = df.select(ts).distinct().withColumn("_y", F.col(ts).cast("date"))
        edge = d.groupBy("_y").agg(F.max(ts).alias("_m")).withColumn("_carry", F.max("_m").over(Window.orderBy("_y").rowsBetween(Window.unboundedPreceding, -1)))
        stepped = d.withColumn("_in", F.lag(ts).over(Window.partitionBy("_y").orderBy(ts))).join(edge, "_y").withColumn("_prev", F.coalesce("_in", "_carry"))
    steps = stepped.where("_prev is not null").select(((epoch_seconds(ts) - epoch_seconds("_prev")) / 3600.0).alias("_h"))
    return exact_quantiles(steps, [], "_h", {"median_hours": 0.5}).select("median_hours", F.col("n").alias("n_steps"))


def seasonal_period(median_hours) -> Column:
    """Monthly 12, daily 7, quarter-hourly 96, otherwise hourly 24; no steps at all: 96."""
    h = col(median_hours)
    return F.when(h >= 25 * 24, 12).when(h >= 20, 7).when(h <= 20 / 60, 96).when(h.isNull(), 96).otherwise(24)


def is_monthly(df: DataFrame, series: str = "series", ts: str = "ts") -> bool:
    """Plan-time probe (one small job); pass ``cadence`` to the callers to avoid it."""
    row = median_step_hours(df, series, ts).first()
    return row is not None and row["median_hours"] is not None and row["median_hours"] >= 25 * 24


def is_sub_daily(df: DataFrame, ts: str = "ts") -> bool:
    """Plan-time probe: more than one distinct hour of day."""
    return len(df.select(F.hour(ts)).distinct().limit(2).collect()) > 1


def add_lags(df: DataFrame, series: str = "series", ts: str = "ts", y: str = "y", cadence: str | None = None, strict: bool = True) -> DataFrame:
    """Autoregressive columns; calendar months for monthly panels, rows otherwise."""
    if cadence is None:
        cadence = "monthly" if is_monthly(df, series, ts) else "rows"
    if cadence == "monthly":
        if strict:
            double = duplicate_months(df, series, ts)
            bad = double.limit(10).collect()
            if bad:
                listed = ", ".join(f"{r[series]} {r['month']:%Y-%m}" for r in bad)
                raise ValueError(f"monthly lags are ambiguous, more than one row for {double.count()} months; duplicate_months lists them, first: {listed}")
        return calendar_rolling(calendar_lags(df, MONTHLY_LAGS, series, ts, y), series, ts, y)
    return row_features(df, series, ts, y, None, F.trunc(F.col(ts).cast("date"), "month"))


def mase_scale(train: DataFrame, season: int, series: str = "series", ts: str = "ts", y: str = "y", by: list[str] | None = None, chunk: Column | None = None) -> DataFrame:
    """Mean |y(t) - y(t-season)| by row position within each series, over rows with an actual."""
    seen = train.where(F.col(y).isNotNull())
    lagged = windowed_by_rows(seen, [series], [ts], season, lambda w: {"_d": F.abs(F.col(y) - F.lag(y, season).over(w))}, chunk)
    scale = F.avg("_d")
    keys = by or []
    return lagged.groupBy(*keys).agg(F.when(scale >= 1e-8, scale).alias("mase_scale"), F.count("_d").alias("n_diffs"))
