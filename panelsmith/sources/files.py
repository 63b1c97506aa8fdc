"""File sources and sinks on Spark's own readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import INF, no_nan
from ..operators.ordered import keep_latest

# Fixed pattern: one parquet file per month of OD rows.
OD_MONTH_GLOB = "bart_od_[0-9][0-9][0-9][0-9]_[0-9][0-9].parquet"


def read_matching(spark: SparkSession, folder: str, glob: str = OD_MONTH_GLOB) -> DataFrame:
    """Only files whose name matches exactly; an unreadable file fails the read.

    A looser glob would also pick up consolidated files and double the target.
    """
    return spark.read.option("pathGlobFilter", glob).option("ignoreCorruptFiles", "false").parquet(folder)


def read_skipping_corrupt(spark: SparkSession, folder: str, schema, glob: str = "*.parquet") -> DataFrame:
    """Covariate files: an unreadable file is skipped and left in place; each row names its file."""
    df = spark.read.schema(schema).option("pathGlobFilter", glob).option("ignoreCorruptFiles", "true").parquet(folder)
    return df.withColumn("source_file", F.col("_metadata.file_path"))


def file_manifest(spark: SparkSession, folder: str, glob: str = "*.parquet") -> DataFrame:
    """(file_name, path, bytes, modified) of every file that matches; a listing, no file is opened."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    return listed.select(_name_of("path").alias("file_name"), "path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def unread_files(spark: SparkSession, folder: str, rows: DataFrame, glob: str = "*.parquet") -> DataFrame:
    """The manifest's files that gave none of ``rows`` (of ``read_skipping_corrupt``): damaged ones, and ones without rows."""
    gave = rows.select(_name_of("source_file").alias("file_name")).distinct()
    return file_manifest(spark, folder, glob).join(gave, "file_name", "left_anti")


def _name_of(path: str) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def with_file_version(df: DataFrame) -> DataFrame:
    """Tag rows with their own file's modification time and path."""
    return df.withColumns({"file_mtime": F.col("_metadata.file_modification_time"), "file_path": F.col("_metadata.file_path")})


def latest_wins(df: DataFrame, keys: list[str], version: list[str] | None = None) -> DataFrame:
    """Newest row per key; file path breaks ties so the result does not depend on read order."""
    return keep_latest(df, keys, version or ["file_mtime", "file_path"])


def read_newest(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the last parquet file (or folder of part files) under ``folder`` by name.

    The name comes from a listing that opens no file; only the last is read.
    """
    names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
    last = names.agg(F.max("path")).first()[0]
    if last is None:
        raise ValueError(f"no parquet file under {folder}")
    parent, _, leaf = last.rpartition("/")
    return spark.read.parquet(parent if leaf.startswith("part-") else last)


def batch_completeness(df: DataFrame, series: str, ts: str, days: int, columns: list[str]) -> DataFrame:
    """(series, rows, expected, nulls, complete): days x 24 rows and no NULL in the named columns."""
    nulls = [F.count_if(F.col(c).isNull()) for c in columns]
    total = nulls[0]
    for n in nulls[1:]:
        total = total + n
    out = df.groupBy(series).agg(F.count(ts).alias("rows"), total.alias("nulls"))
    return out.withColumn("expected", F.lit(days * 24).cast("long")).withColumn("complete", (F.col("rows") == F.col("expected")) & (F.col("nulls") == 0))


def never_shrink(old: DataFrame, new: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Action per (source, year): written only if the new file has at least as many rows.

    ``unchanged`` where the stored file already reaches the fetched span.
    """
    size = lambda d, p: d.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{p}_rows"), F.max(ts).alias(f"{p}_last"))
    j = size(new, "new").join(size(old, "old"), keys, "left")
    action = (
        F.when(F.col("old_rows").isNull(), "written")
        .when((F.col("old_last") >= F.col("new_last")) & (F.col("old_rows") >= F.col("new_rows")), "unchanged")
        .when(F.col("new_rows") < F.col("old_rows"), "refused").otherwise("written")
    )
    return j.select(*keys, "old_rows", "new_rows", action.alias("action"))


# ---- sinks -----------------------------------------------------------------------------------


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Rows of one partition value go to a few tasks, so no folder gets one file per task.

    AQE splits a skewed partition value again (``rebalance``).
    """
    if partition_by:
        df.hint("rebalance", *partition_by).write.mode("errorifexists").partitionBy(*partition_by).parquet(path)
    else:
        df.write.mode("errorifexists").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", "true").csv(path)


def json_records(df: DataFrame, order: list[str], decimals: int | None = None) -> DataFrame:
    """(sort keys, record): strict JSON lines; NaN and infinity become null, floats are rounded."""
    cols = []
    for f in df.schema.fields:
        if f.dataType.typeName() in ("double", "float"):
            c = no_nan(f.name)
            c = F.when(F.abs(c) != INF, c)
            cols.append((F.round(c, decimals) if decimals is not None else c).alias(f.name))
        else:
            cols.append(F.col(f.name))
    clean = df.select(*cols)
    record = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    return clean.select(*order, record.alias("record")).orderBy(*order)


def write_json(df: DataFrame, path: str, order: list[str], decimals: int | None = None) -> None:
    json_records(df, order, decimals).select("record").write.mode("errorifexists").text(path)


def same_content(a: DataFrame, b: DataFrame) -> bool:
    """Equal as bags of rows; stops at the first difference."""
    if a.columns != b.columns:
        return False
    return not a.exceptAll(b).limit(1).count() and not b.exceptAll(a).limit(1).count()


def publish_if_passed(candidate: DataFrame, served: DataFrame | None, passed: bool, root: str, run_id: str) -> str:
    """Write a versioned folder and move the pointer only if the gate passed and content changed.

    Returns the action: refused, unchanged or published.
    """
    spark = candidate.sparkSession
    if not passed:
        return "refused"
    if served is not None and same_content(candidate, served.select(*candidate.columns)):
        return "unchanged"
    path = f"{root}/runs/{run_id}"
    candidate.write.mode("errorifexists").parquet(f"{path}/store")
    n = spark.read.parquet(f"{path}/store").count()
    spark.createDataFrame([(run_id, n)], "run_id string, n_rows long").coalesce(1).write.mode("errorifexists").json(f"{path}/manifest")
    spark.createDataFrame([(run_id, f"{path}/store")], "run_id string, path string").coalesce(1).write.mode("append").parquet(f"{root}/pointer")
    return "published"


def read_published(spark: SparkSession, root: str) -> DataFrame:
    """The store the newest pointer row names."""
    p = spark.read.parquet(f"{root}/pointer").withColumn("_at", F.col("_metadata.file_modification_time"))
    path = p.orderBy(F.col("_at").desc(), F.col("run_id").desc()).first()["path"]
    return spark.read.parquet(path)
