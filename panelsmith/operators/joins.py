"""Panel joins: dimensions, two-level weather, forecasts, tracked rows.

No join carries an unconditional broadcast hint: Spark compares a side's size
with ``spark.sql.autoBroadcastJoinThreshold`` (again at run time under AQE) and
falls back to a shuffle join, with skewed keys split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import NTZ, month_end, month_start

WEATHER_MEANS = ["temp_f", "precip_mm", "precip_in", "windspeed_mph", "is_raining", "cloud_cover_pct", "humidity_pct"]


def monthly_weather(hourly: DataFrame, station: str = "station", ts: str = "ts", means: list[str] | None = None, code: str | None = "weather_code") -> DataFrame:
    """Month means and modal weather code, per station and for the whole region in one pass.

    Region rows have ``station_level`` FALSE and a NULL station.
    """
    means = means or [c for c in WEATHER_MEANS if c in hourly.columns]
    src = hourly.select(F.col(station).alias("station"), month_start(ts).alias("month"), *[F.col(c).cast("double").alias(c) for c in means], *([code] if code else []))
    aggs = [F.avg(c).alias(c) for c in means]
    if code:
        aggs.append(F.mode(F.col(code), deterministic=True).alias(code))
    sets = src.groupingSets([["station", "month"], ["month"]], "station", "month")
    return sets.agg(*aggs, (F.grouping("station") == 0).alias("station_level"))


def weather_or_region(panel: DataFrame, weather: DataFrame, mapping: DataFrame | None, series: str = "series", ts: str = "ts") -> DataFrame:
    """Mapped station's month, falling back per value to the regional month.

    ``mapping``: (series, weather_station); without it every series takes the region's.
    """
    values = [c for c in weather.columns if c not in ("station", "month", "station_level")]
    own = weather.where("station_level").select(F.col("station").alias("_ws"), F.col("month").alias("_m"), *[F.col(c).alias(f"_s_{c}") for c in values])
    region = weather.where("not station_level").select(F.col("month").alias("_m"), *[F.col(c).alias(f"_r_{c}") for c in values])
    if mapping is None:
        j = panel.withColumn("_m", month_start(ts)).join(region, "_m", "left")
        return j.select(*panel.columns, *[F.col(f"_r_{c}").alias(c) for c in values])
    keyed = panel.join(mapping.select(series, F.col("weather_station").alias("_ws")), series, "left").withColumn("_m", month_start(ts))
    j = keyed.join(own, ["_ws", "_m"], "left").join(region, "_m", "left")
    return j.select(*panel.columns, *[F.coalesce(f"_s_{c}", f"_r_{c}").alias(c) for c in values])


def with_station_name(df: DataFrame, dim: DataFrame, code: str, name: str, fallback: str | None = None, out: str = "station_name") -> DataFrame:
    """Code -> name; the source's own name is kept where the code is unknown."""
    d = dim.select(F.col(code).alias("_code"), F.col(name).alias("_name"))
    j = df.join(d, F.col(code) == F.col("_code"), "left")
    return j.withColumn(out, F.coalesce("_name", F.col(fallback)) if fallback else F.col("_name")).drop("_code", "_name")


def unknown_codes(df: DataFrame, dim: DataFrame, code: str) -> DataFrame:
    return df.select(code).distinct().join(dim.select(code).distinct(), code, "left_anti")


def only_in_left(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of a that b lacks."""
    return a.select(*keys).distinct().join(b.select(*keys), keys, "left_anti")


def in_both(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).distinct().join(b.select(*keys), keys, "left_semi")


def actual_forecast_inner(actual: DataFrame, forecast: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return actual.join(forecast, keys or ["series", "ts"])


def three_way(a: DataFrame, b: DataFrame, actual: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or ["series", "ts"]
    return a.select(*keys, F.col("p50").alias("p50_a")).join(b.select(*keys, F.col("p50").alias("p50_b")), keys).join(actual, keys)


def backfill_diagnostics(actual: DataFrame, enriched: DataFrame, columns: list[str], always: tuple[str, ...] = ("is_raining",), keys: list[str] | None = None) -> DataFrame:
    """Diagnostic columns the actuals lack; those in ``always`` are replaced even when present."""
    keys = keys or ["series", "ts"]
    take = [c for c in columns if c in enriched.columns and (c not in actual.columns or c in always)]
    return actual.drop(*take).join(enriched.select(*keys, *take), keys, "left")


def evaluation_matrix(frame: DataFrame, candidates: list[dict], name: str = "candidate") -> DataFrame:
    """Every row once per configured candidate: a literal list is exploded, no cartesian join."""
    items = [F.struct(*[F.lit(v).alias(k) for k, v in c.items()]) for c in candidates]
    return frame.withColumn("_c", F.explode(F.array(*items))).select(*frame.columns, "_c.*")


# ---- filters and windows in time -------------------------------------------------------------


def between_dates(df: DataFrame, start: str | None = None, end: str | None = None, ts: str = "ts") -> DataFrame:
    """Bare comparisons on the column, so they reach the parquet filter."""
    if start is not None:
        df = df.where(F.col(ts) >= F.lit(start).cast(NTZ))
    if end is not None:
        df = df.where(F.col(ts) <= F.lit(end).cast(NTZ))
    return df


def chronological_split(df: DataFrame, train_end: str, val_end: str, test_end: str | None, train_start: str | None = None, ts: str = "ts") -> DataFrame:
    """Rows tagged train / val / test; rows outside every part are dropped."""
    if test_end is None:
        raise ValueError("test_end must be given")
    t = F.col(ts)
    at = lambda d: F.lit(d).cast(NTZ)
    part = F.when((t > at(val_end)) & (t <= at(test_end)), "test").when((t > at(train_end)) & (t <= at(val_end)), "val")
    train = t <= at(train_end)
    if train_start is not None:
        train = train & (t >= at(train_start))
    return between_dates(df, train_start, test_end, ts).withColumn("split", part.when(train, "train")).where("split is not null")


def window_frames(df: DataFrame, as_of_month: str, horizon: int, train_start: str | None = None, ts: str = "ts") -> DataFrame:
    """Backtest window: train up to the month end, test the ``horizon`` months after it."""
    cut = month_end(F.lit(as_of_month).cast(NTZ))
    last = F.last_day(F.add_months(cut.cast("date"), horizon)).cast(NTZ)
    lower = F.lit(True) if train_start is None else F.col(ts) >= F.lit(train_start).cast(NTZ)
    part = F.when((F.col(ts) <= cut) & lower, "train").when((F.col(ts) > cut) & (F.col(ts) <= last), "test")
    return df.withColumn("split", part).where("split is not null")


def check_windows(windows: list[dict], horizon: int, last_month: str) -> None:
    """Configuration check: months of every window follow its as-of month and end by ``last_month``."""
    import pandas as pd

    for w in windows:
        as_of, end = pd.Period(w["as_of"], "M"), pd.Period(w["end"], "M")
        if end - as_of != pd.offsets.MonthEnd(horizon):
            raise ValueError(f"window {w['name']} does not span {horizon} months")
        if end > pd.Period(last_month, "M"):
            raise ValueError(f"window {w['name']} ends after {last_month}")


def exact_window_violations(df: DataFrame, horizon: int, series: str = "series", ts: str = "ts") -> DataFrame:
    """Series that do not have exactly ``horizon`` distinct months, one row each."""
    g = df.groupBy(series).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(month_start(ts)).alias("n_months"))
    return g.where((F.col("n_rows") != horizon) | (F.col("n_months") != horizon))


def closed_history(df: DataFrame, as_of: str, ts: str = "ts") -> DataFrame:
    """Months whose last day is on or before ``as_of``."""
    return df.where(F.last_day(F.col(ts).cast("date")) <= F.lit(as_of).cast("date"))


def context_and_future(df: DataFrame, as_of: str, steps: int | None = None, hours: float | None = None, series: str = "series", ts: str = "ts") -> DataFrame:
    """Rows tagged context (last ``steps`` rows, or rows since as_of - hours) and future."""
    at = F.lit(as_of).cast(NTZ)
    future = df.where(F.col(ts) > at).withColumn("part", F.lit("future"))
    past = df.where(F.col(ts) <= at)
    if hours is not None:
        past = past.where(F.col(ts) >= at - F.expr(f"make_dt_interval(0, {int(hours)}, 0, 0)"))
    if steps is not None:
        w = Window.partitionBy(series).orderBy(F.col(ts).desc())
        past = past.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= steps).drop("_rn")
    return past.withColumn("part", F.lit("context")).unionByName(future)


def training_slice(df: DataFrame, start: str, cutoff: str, excluded: list[str], ts: str = "ts") -> DataFrame:
    """Rows between start and cutoff without the excluded months (a short configured list)."""
    out = between_dates(df, start, cutoff, ts)
    return out.where(~month_start(ts).cast("date").isin([*excluded])) if excluded else out


def finite_bands(df: DataFrame) -> tuple[Column, Column]:
    """(all three quantiles finite, and in order)."""
    from ..functions.scalars import finite

    ok = finite("p10") & finite("p50") & finite("p90")
    return ok, ok & (F.col("p10") <= F.col("p50")) & (F.col("p50") <= F.col("p90"))


def latest_forecast(forecasts: DataFrame, averages: DataFrame, names: DataFrame, series: str = "series", ts: str = "ts") -> DataFrame:
    """Per series: name, rounded typical level and the latest forecast month; all three needed."""
    last = forecasts.groupBy(series).agg(F.max_by(F.struct(F.col(ts).alias("forecast_ts"), F.col("p50")), ts).alias("_f"))
    j = names.join(averages, series).join(last, series)
    return j.select(
        series, "name", F.round("avg_recent", 0).cast("long").alias("typical_monthly"),
        F.col("_f.forecast_ts").alias("forecast_month"), F.round("_f.p50", 0).cast("long").alias("forecast_p50"),
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out

