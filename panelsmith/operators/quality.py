"""Data-quality checks: each returns (check, severity, message, details)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.calendar import col, month_start
from ..functions.scalars import known
from . import panel as P
from .ordered import first_k

# Thresholds of the checks.
MAX_PLAUSIBLE = 5_000_000
SPIKE_MULTIPLE = 10.0
MIN_SERIES_SHARE = 0.80

#: Width of the ranges that arrival numbers are checked in.
ARRIVAL_RANGE = 8192
RESULT = ["check", "severity", "message", "details"]


def result(df: DataFrame, check, severity, message, **details) -> DataFrame:
    """Shape a one-row (or few-row) aggregate as check results."""
    lit = lambda v: F.lit(v) if isinstance(v, str) else v
    pairs = [x for k, v in details.items() for x in (F.lit(k), v.cast("string"))]
    d = F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,string>")
    return df.select(lit(check).alias("check"), lit(severity).alias("severity"), lit(message).alias("message"), d.alias("details"))


def required_columns(df: DataFrame, required: list[str]) -> DataFrame:
    """Whether all columns are there; details tell the rows and, for each column that is there, how many rows have a value."""
    missing = [c for c in required if c not in df.columns]
    filled = F.concat_ws(",", *[F.count(c).cast("string") for c in required if c in df.columns])
    one = df.agg(F.count(F.lit(1)).alias("n"), filled.alias("filled"))
    message = f"missing required columns: {', '.join(missing)}" if missing else "all required columns present"
    return result(one, "required_columns", "ERROR" if missing else "INFO", message, rows=F.col("n"), filled=F.col("filled"))


def monotonic(df: DataFrame, arrival: str, series: str = "series", ts: str = "ts", chunk: Column | None = None) -> DataFrame:
    bad = P.out_of_order(df, arrival, series, ts, chunk)
    one = bad.agg(F.count(F.lit(1)).alias("n")).join(first_k(bad, series, 10), F.lit(True))
    return result(one, "timestamp_monotonic", F.when(F.col("n") > 0, "WARNING").otherwise("INFO"),
                  F.concat(F.col("n").cast("string"), F.lit(" series with decreasing time stamps")), count=F.col("n"), examples=F.col("examples"))


def missing_windows(df: DataFrame, max_gap_hours: float = 35 * 24.0, series: str = "series", ts: str = "ts", chunk: Column | None = None) -> DataFrame:
    bad = P.gaps(df, max_gap_hours, series, ts, chunk)
    label = F.concat_ws("@", F.col(series).cast("string"), F.col("gap_start").cast("string"))
    one = bad.agg(F.count(F.lit(1)).alias("n")).join(first_k(bad, label, 20), F.lit(True))
    return result(one, "missing_windows", F.when(F.col("n") > 0, "WARNING").otherwise("INFO"),
                  F.concat(F.col("n").cast("string"), F.lit(" time gaps")), count=F.col("n"), examples=F.col("examples"))


def spikes(df: DataFrame, window: int = 12, series: str = "series", ts: str = "ts", y: str = "y", chunk: Column | None = None) -> DataFrame:
    bad = P.spikes(df, series, ts, y, window, SPIKE_MULTIPLE, chunk)
    label = F.concat_ws("@", F.col(series).cast("string"), F.col(ts).cast("string"))
    one = bad.agg(F.count(F.lit(1)).alias("n")).join(first_k(bad, label, 10), F.lit(True))
    return result(one, "target_spikes", F.when(F.col("n") > 0, "WARNING").otherwise("INFO"),
                  F.concat(F.col("n").cast("string"), F.lit(" spikes above the trailing median")), count=F.col("n"), examples=F.col("examples"))


def value_range(df: DataFrame, y: str = "y", series: str = "series", most: float = MAX_PLAUSIBLE) -> DataFrame:
    """Negative and implausibly large values; an INFO row only when there are neither."""
    a = df.agg(
        F.count_if(F.col(y) < 0).alias("neg"), F.min(F.when(F.col(y) < 0, F.col(y))).alias("neg_min"),
        F.count_if(F.col(y) > most).alias("huge"), F.max(F.when(F.col(y) > most, F.col(y))).alias("huge_max"),
        F.min(y).alias("lo"), F.max(y).alias("hi"),
    )
    a = a.join(first_k(df.where(F.col(y) < 0), series, 5), F.lit(True))
    neg = result(a.where("neg > 0"), "target_negative", "ERROR", F.concat(F.col("neg").cast("string"), F.lit(" negative values")),
                 count=F.col("neg"), min_value=F.col("neg_min"), sample_series=F.col("examples"))
    huge = result(a.where("huge > 0"), "target_implausible_max", "ERROR", F.concat(F.col("huge").cast("string"), F.lit(" values above the plausible maximum")),
                  count=F.col("huge"), max_value=F.col("huge_max"))
    ok = result(a.where("neg = 0 and huge = 0"), "target_range", "INFO", F.concat(F.lit("range "), F.round("lo", 0).cast("long").cast("string"), F.lit(" to "), F.round("hi", 0).cast("long").cast("string")))
    return neg.unionByName(huge).unionByName(ok)


def null_shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, null_pct, null_count, n) in one pass over the table."""
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(f"_{i}") for i, c in enumerate(columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("null_count")) for i, c in enumerate(columns)])
    return one.select(F.inline(rows), F.col("_n").alias("n")).withColumn("null_pct", F.try_divide(F.col("null_count") * 100.0, F.col("n")))


def weather_nulls(df: DataFrame, columns: tuple[str, ...] = ("temp_f", "precip_mm", "is_raining", "windspeed_mph")) -> DataFrame:
    present = [c for c in columns if c in df.columns]
    if not present:
        return result(df.sparkSession.range(1), "weather_coverage", "WARNING", "no weather columns")
    s = null_shares(df, present)
    sev = F.when(F.col("null_pct") > 20, "ERROR").when(F.col("null_pct") > 5, "WARNING").otherwise("INFO")
    return result(s, F.concat(F.lit("weather_nulls_"), "column"), sev, F.format_string("%s: %.1f%% null", "column", F.coalesce("null_pct", F.lit(0.0))), null_pct=F.round("null_pct", 2))


def target_nulls(df: DataFrame, y: str = "y") -> DataFrame:
    s = null_shares(df, [y])
    sev = F.when(F.col("null_pct") > 10, "ERROR").when(F.col("null_pct") > 2, "WARNING").otherwise("INFO")
    return result(s, "target_null_rate", sev, F.format_string("%.2f%% null", F.coalesce("null_pct", F.lit(0.0))), null_pct=F.round("null_pct", 2), null_count=F.col("null_count"))


def event_scores(df: DataFrame, flag: str = "is_game_day", score: str = "event_proximity_score") -> DataFrame:
    """Share of event rows whose score is zero or missing; no event rows, no result."""
    a = df.where(known(flag)).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.coalesce(F.col(score) == 0, F.lit(False)).cast("double") * 100).alias("zero"),
        F.avg(F.col(score).isNull().cast("double") * 100).alias("missing"),
    ).where("n > 0")
    return result(a, "event_proximity_score", F.when(F.col("zero") + F.col("missing") > 50, "WARNING").otherwise("INFO"),
                  F.format_string("%.1f%% zero, %.1f%% missing", "zero", "missing"), zero_pct=F.round("zero", 2), missing_pct=F.round("missing", 2))


def window_coverage(df: DataFrame, step: str = "hour", series: str = "series", ts: str = "ts") -> DataFrame:
    """(window, n_series, share): distinct series per window; empty windows inside the range count 0.

    The grid has one row per window between first and last time stamp.
    """
    from ..functions.calendar import day_start, hour_start

    at = {"hour": hour_start, "day": day_start, "month": month_start}[step](ts)
    have = df.groupBy(at.alias("window")).agg(F.count_distinct(series).alias("n_series"))
    ends = df.agg(F.min(at).alias("_a"), F.max(at).alias("_b"), F.count_distinct(series).alias("_total"))
    grid = ends.where("_total > 0").select(F.explode(F.sequence("_a", "_b", F.expr(f"interval 1 {step}"))).alias("window"), "_total")
    return grid.join(have, "window", "left").select(
        "window", F.coalesce("n_series", F.lit(0)).alias("n_series"), F.col("_total").alias("total"),
        (F.coalesce("n_series", F.lit(0)) / F.col("_total")).alias("share"),
    )


def series_coverage(df: DataFrame, step: str = "hour", least: float = MIN_SERIES_SHARE, series: str = "series", ts: str = "ts") -> DataFrame:
    low = window_coverage(df, step, series, ts).where(F.col("share") < least)
    one = low.agg(F.count(F.lit(1)).alias("n"), F.min("n_series").alias("fewest")).join(first_k(low, F.col("window").cast("string"), 10), F.lit(True))
    return result(one, "series_coverage", F.when(F.col("n") > 0, "WARNING").otherwise("INFO"),
                  F.concat(F.col("n").cast("string"), F.lit(" windows with too few series")), count=F.col("n"), fewest=F.col("fewest"), examples=F.col("examples"))


def duplicates(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or ["series", "ts"]
    dup = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    one = dup.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"))
    return result(one, "duplicate_rows", F.when(F.col("n") > 0, "ERROR").otherwise("INFO"), F.concat(F.col("n").cast("string"), F.lit(" duplicate rows")), count=F.col("n"))


def _arrival_chunk(df: DataFrame, arrival: str) -> Column | None:
    """Ranges of the arrival column itself, which never decrease along it; None for types without ranges."""
    kind = df.schema[arrival].dataType
    if isinstance(kind, NumericType):
        return F.floor(F.col(arrival) / ARRIVAL_RANGE)
    return F.date_trunc("day", arrival) if kind.typeName() in ("date", "timestamp", "timestamp_ntz") else None


def run_checks(df: DataFrame, cadence: str = "monthly", arrival: str | None = None, series: str = "series", ts: str = "ts", y: str = "y", step: str = "hour") -> DataFrame:
    """Every check in one result table."""
    sub_daily = cadence != "monthly"
    chunk = F.trunc(F.col(ts).cast("date"), "month") if sub_daily else None
    parts = [
        required_columns(df, [ts, series, y]),
        missing_windows(df, P.gap_limit_hours(1.0 if sub_daily else None), series, ts, chunk),
        value_range(df, y, series), spikes(df, 96 if sub_daily else 12, series, ts, y, chunk),
        weather_nulls(df), series_coverage(df, step, MIN_SERIES_SHARE, series, ts), duplicates(df, [series, ts]), target_nulls(df, y),
    ]
    if arrival:
        parts.insert(1, monotonic(df, arrival, series, ts, _arrival_chunk(df, arrival) if sub_daily else None))
    if {"is_game_day", "event_proximity_score"} <= set(df.columns):
        parts.append(event_scores(df))
    return reduce(DataFrame.unionByName, parts)


def raise_on_error(results: DataFrame) -> DataFrame:
    """Strict mode (one job): raise if any check is an ERROR."""
    bad = results.where("severity = 'ERROR'").orderBy("check").collect()  # a few rows a check
    if bad:
        raise ValueError("; ".join(f"{r['check']}: {r['message']}" for r in bad))
    return results


def dimension_checks(dim: DataFrame, store: DataFrame, key: str, api: str, name: str, series: str = "series") -> DataFrame:
    """Station table: unique codes, code pattern and length, same set as the store."""
    def dup(c):
        return dim.groupBy(c).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit(f"unique_{c}").alias("check"), "n")

    def missing(a, ac, b, bc, tag):
        return a.select(F.col(ac).cast("string").alias("k")).distinct().join(b.select(F.col(bc).cast("string").alias("k")), "k", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit(tag).alias("check"), "n")

    pattern = dim.agg(F.count_if(~F.coalesce(F.col(key).cast("string").rlike("^([A-Z]{2}|[0-9]{1,2})$"), F.lit(False))).alias("n")).select(F.lit("code_pattern").alias("check"), "n")
    length = dim.agg(F.count_if(F.coalesce(F.length(api), F.lit(0)) < 4).alias("n")).select(F.lit("api_code_length").alias("check"), "n")
    parts = [dup(key), dup(api), dup(name), pattern, length, missing(store, series, dim, key, "store_not_in_table"), missing(dim, key, store, series, "table_not_in_store")]
    return reduce(DataFrame.unionByName, parts).withColumn("passed", F.col("n") == 0)


def publishable_series(df: DataFrame, flags: list[str], series: str = "series", ts: str = "ts", y: str = "y", regime: str = "method_period") -> DataFrame:
    """Per series: one row per month, positive whole values, regime present, 0/1 flags."""
    m = df.groupBy(series, month_start(ts).alias("_m")).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(~F.coalesce((F.col(y) > 0) & (F.col(y) == F.floor(y)), F.lit(False))).alias("_v"),
        F.count_if(F.col(regime).isNull()).alias("_r"), F.count_if(~reduce(lambda a, b: a & b, [F.coalesce(col(f).isin(0, 1), F.lit(False)) for f in flags])).alias("_f"),
    )
    return m.groupBy(series).agg(
        F.count_if(F.col("_n") > 1).alias("duplicate_months"), F.sum("_v").alias("bad_values"), F.sum("_r").alias("missing_regime"), F.sum("_f").alias("bad_flags")
    ).withColumn("publishable", (F.col("duplicate_months") + F.col("bad_values") + F.col("missing_regime") + F.col("bad_flags")) == 0)
