"""Archive coverage: spans of days a source vouches for, and month coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import month_list, month_start

# Fixed pattern: the end date in an event archive's file name.
EVENT_FILE_END = r"events_\d{4}-\d{2}-\d{2}_(\d{4}-\d{2}-\d{2})\.parquet$"


def merge_spans(spans: DataFrame, start: str = "span_start", end: str = "span_end", keys: list[str] | None = None) -> DataFrame:
    """Join overlapping or day-adjacent spans; a gap stays a gap.

    Spans are per file, so the ordered pass runs over a file list, not data rows.
    Identical spans are merged first.
    """
    keys = keys or []
    order = Window.partitionBy(*keys).orderBy(start, end)
    s = spans.select(*keys, start, end).distinct()
    reach = F.max(F.col(end)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    flagged = s.withColumn("_new", F.when(reach.isNull() | (F.col(start) > F.date_add(reach, 1)), 1).otherwise(0))
    return (
        flagged.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end))
        .drop("_island")
    )


def file_spans(events: DataFrame, file_col: str, ts: str = "timestamp_start") -> DataFrame:
    """Span each file vouches for: month of its first event to the end date in its name.

    A name without a date falls back to the end of the last event's month.
    """
    named = F.regexp_extract(F.col(file_col), EVENT_FILE_END, 1)
    return (
        events.groupBy(file_col).agg(F.min(ts).alias("_first"), F.max(ts).alias("_last"))
        .where(F.col("_first").isNotNull())
        .select(
            file_col,
            month_start("_first").cast("date").alias("span_start"),
            F.coalesce(F.try_to_date(F.when(named != "", named)), F.last_day(F.col("_last").cast("date"))).alias("span_end"),
        )
    )


def archive_span(events: DataFrame, ts: str = "timestamp_start") -> DataFrame:
    """Fallback for an archive without recorded spans: first to last event month."""
    return (
        events.agg(F.min(ts).alias("_first"), F.max(ts).alias("_last")).where("_first is not null")
        .select(month_start("_first").cast("date").alias("span_start"), F.last_day(F.col("_last").cast("date")).alias("span_end"))
    )


def covered_months(spans: DataFrame) -> DataFrame:
    """Distinct months that lie wholly inside one merged span: (month_ts)."""
    merged = merge_spans(spans)
    first = F.when(F.trunc("span_start", "month") == F.col("span_start"), F.col("span_start")).otherwise(
        F.add_months(F.trunc("span_start", "month"), 1)
    )
    last = F.when(F.last_day("span_end") == F.col("span_end"), F.trunc("span_end", "month")).otherwise(
        F.add_months(F.trunc("span_end", "month"), -1)
    )
    months = merged.select(first.alias("a"), last.alias("b")).where("a <= b")
    return months.select(F.explode(month_list(F.col("a"), F.col("b"))).alias("month_ts")).distinct()


def with_coverage(df: DataFrame, spans: DataFrame, ts: str = "ts", out: str = "covered") -> DataFrame:
    """Flag rows whose whole month lies inside one span; never multiplies rows.

    Spans become a list of months, so the range test is an equi-join on month.
    """
    months = covered_months(spans).withColumnRenamed("month_ts", "_month").withColumn("_hit", F.lit(True))
    return (
        df.withColumn("_month", month_start(ts)).join(months, "_month", "left")
        .withColumn(out, F.coalesce("_hit", F.lit(False))).drop("_month", "_hit")
    )
