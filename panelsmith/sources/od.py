"""Origin-destination counts: CSV, wide matrices, workbook cell tables, sensors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import NTZ, month_start
from ..functions.scalars import clean_code, congestion_level, contains_ci, is_station_code

OD_CSV_SCHEMA = "year string, month string, day_type string, origin string, destination string, riders string"


def clean_od_rows(raw: DataFrame, first_year: int, last_year: int, pattern: str = "^[A-Z0-9]{2,4}$") -> DataFrame:
    """Text rows -> typed rows: codes kept as text, bad codes, numbers and years dropped."""
    t = raw.withColumns({
        "origin": clean_code("origin"), "destination": clean_code("destination"),
        "riders": F.expr("try_cast(riders as double)"), "year": F.expr("try_cast(year as int)"), "month": F.expr("try_cast(month as int)"),
    })
    keep = is_station_code("origin", pattern) & is_station_code("destination", pattern) & F.col("riders").isNotNull() & F.col("year").between(first_year, last_year) & F.col("month").between(1, 12)
    return t.where(keep).withColumn("period", F.make_date("year", "month", F.lit(1)).cast(NTZ))


def read_od_csv(spark: SparkSession, path: str, first_year: int, last_year: int) -> DataFrame:
    return clean_od_rows(spark.read.schema(OD_CSV_SCHEMA).option("header", "true").csv(path), first_year, last_year)


def od_from_cells(cells: DataFrame, scan_rows: int = 12, min_codes: int = 10, sheet: list[str] | None = None) -> DataFrame:
    """Wide sheets as cells (file, sheet, row, col, value) -> (origin, destination, riders).

    The header is the row among the first ones with the most station codes (at
    least ten, first on ties); rows are exits, columns are entries; cells that
    are not numbers are dropped.  Header cells and row labels join back on
    (sheet, col) and (sheet, row), so a sheet is never gathered in one task.
    """
    sheet = sheet or ["file", "sheet"]
    c = cells.withColumn("code", clean_code("value"))
    coded = c.where(is_station_code("code"))
    counts = coded.where((F.col("row") < scan_rows) & (F.col("col") >= 1)).groupBy(*sheet, "row").agg(F.count(F.lit(1)).alias("n"))
    header = counts.groupBy(*sheet).agg(F.max(F.struct("n", (-F.col("row")).alias("neg"))).alias("best")).where(F.col("best.n") >= min_codes).select(*sheet, (-F.col("best.neg")).alias("header_row"))
    entries = coded.join(header, sheet).where((F.col("row") == F.col("header_row")) & (F.col("col") >= 1)).select(*sheet, "col", F.col("code").alias("origin"))
    exits = coded.join(header, sheet).where((F.col("row") > F.col("header_row")) & (F.col("col") == 0)).select(*sheet, "row", F.col("code").alias("destination"))
    body = cells.where(F.col("col") >= 1).withColumn("riders", F.expr("try_cast(value as double)")).where("riders is not null and not isnan(riders)")
    return body.join(exits, [*sheet, "row"]).join(entries, [*sheet, "col"]).select(*sheet, "origin", "destination", "riders")


def od_melt(wide: DataFrame, ids: list[str], codes: list[str], name: str = "destination", value: str = "riders") -> DataFrame:
    """Wide named matrix -> long; columns outside ``codes`` are dropped, non-numbers count 0."""
    cols = [c for c in wide.columns if c in codes]
    text = wide.select(*ids, *[F.col(c).cast("string").alias(c) for c in cols])
    long = text.unpivot(ids, cols, name, value)
    return long.withColumn(value, F.coalesce(F.expr(f"try_cast({value} as double)"), F.lit(0.0)))


def union_sheets(sheets: dict[str, DataFrame], period: Column, names: DataFrame | None = None) -> DataFrame:
    """Sheets of any number of workbooks tagged with their day type, period columns added, names joined if given.

    ``period`` is any time in the workbook's month: a literal for one workbook, a column of the sheets for many.
    """
    parts = [df.withColumn("day_type", F.lit(k)) for k, df in sheets.items()]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    out = out.withColumns({"year": F.year(period), "month": F.month(period), "period": month_start(period)})
    if names is not None:
        for side in ("origin", "destination"):
            out = out.join(names.select(F.col("code").alias(side), F.col("name").alias(f"{side}_name")), side, "left")
    return out


def day_type_of_sheet(sheet) -> Column:
    """Sheet name -> day type for both header vintages."""
    return (
        F.when(contains_ci(sheet, "total"), "Total Trips").when(contains_ci(sheet, "sat"), "Avg Saturday")
        .when(contains_ci(sheet, "sun"), "Avg Sunday").when(contains_ci(sheet, "w") & (contains_ci(sheet, "wkdy") | contains_ci(sheet, "weekday")), "Avg Weekday")
    )


def sensor_melt(wide: DataFrame, ts: str = "ts", name: str = "sensor_id", value: str = "speed_mph") -> DataFrame:
    """Time x sensor matrix -> long rows with congestion flags; missing speeds dropped."""
    sensors = [c for c in wide.columns if c != ts]
    long = wide.unpivot([ts], sensors, name, value).where(F.col(value).isNotNull())
    return long.withColumns({"is_congested": F.col(value) < 35, "is_stop_n_go": F.col(value) < 15, "congestion_level": congestion_level(value)})


def sensor_columns(columns: list[str]) -> dict[str, str]:
    """Vendor column -> standard name by the words in it; per-lane columns stay as they are."""
    rules = [(("flow", "volume"), "flow_veh_5min"), (("speed",), "speed_mph"), (("occ",), "occupancy_pct"), (("time",), "timestamp")]
    out = {}
    for c in columns:
        low = c.lower()
        if "lane" in low:
            continue
        new = next((n for words, n in rules if any(w in low for w in words)), None)
        if new or low == "station":
            out[c] = new or "sensor_id"
    return out


def sensor_standardise(raw: DataFrame) -> DataFrame:
    """Rename, parse the time stamp, drop rows without one, add congestion flags."""
    names = sensor_columns(raw.columns)
    df = raw.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in raw.columns])
    if "timestamp" in df.columns:
        df = df.withColumn("timestamp", F.try_to_timestamp(F.col("timestamp").cast("string")).cast(NTZ)).where("timestamp is not null")
    if "speed_mph" in df.columns:
        df = df.withColumns({"is_congested": F.col("speed_mph") < 35, "is_stop_n_go": F.col("speed_mph") < 15})
    return df


def total_blocks(od: DataFrame, period: str = "period", day_type: str = "day_type") -> DataFrame:
    """Periods that do not carry exactly one Total block: (period, n_total_blocks)."""
    return od.groupBy(period).agg(F.count_distinct(F.when(contains_ci(day_type, "total"), F.col(day_type))).alias("n_total_blocks")).where("n_total_blocks <> 1")


def require_one_total_block(refused: DataFrame) -> None:
    """Raise if ``refused`` (``total_blocks``) has rows; the message counts them and names the first by period."""
    found = refused.agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("period", "n_total_blocks")).alias("first")).first()
    if found.n:
        raise ValueError(f"{found.n} months without exactly one Total block, first {found.first.period} with {found.first.n_total_blocks}")


def total_rows(od: DataFrame, day_type: str = "day_type") -> DataFrame:
    return od.where(contains_ci(day_type, "total"))


def drop_aggregate_codes(df: DataFrame, *codes: str, longest: int = 4) -> DataFrame:
    """Rows whose ``codes`` are station codes; sheet totals and labels have longer ones."""
    kept = df
    for c in codes:
        kept = kept.where(F.length(F.col(c).cast("string")) <= longest)
    return kept


def without_self_loops(od: DataFrame, origin: str = "origin", destination: str = "destination") -> DataFrame:
    """Rows between two different places."""
    return od.where(F.col(origin) != F.col(destination))


def drop_out_of_service(df: DataFrame, status: str, values: list[str]) -> DataFrame:
    """Rows whose ``status`` is known and none of ``values``."""
    return df.where(~F.col(status).isin(values))


def boardings(od: DataFrame, period: str = "period", origin: str = "origin", riders: str = "riders", extra: list[str] | None = None) -> DataFrame:
    """Monthly target per origin with a daily estimate (22 working days)."""
    g = od.groupBy(period, origin, *(extra or [])).agg(F.sum(riders).alias("ridership"))
    return g.withColumn("ridership_daily", F.col("ridership") / 22)


def latest_per_order(df: DataFrame, keys: list[str], seq: str, value: str, revised: str = "revised_from") -> DataFrame:
    """Per key: the last value by ``seq``; the first one is kept where it differs."""
    g = df.groupBy(*keys).agg(F.min_by(value, seq).alias("_first"), F.max_by(value, seq).alias(value), F.max(seq).alias(seq))
    return g.withColumn(revised, F.when(~F.col("_first").eqNullSafe(F.col(value)), F.col("_first"))).drop("_first")

