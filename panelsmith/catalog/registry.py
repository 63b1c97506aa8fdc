"""Named queries over the shared tables, each with its SQL counterpart where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[["Tables"], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


class Tables:
    """Lazy readers for one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(self.path(name))


def tidy(df: DataFrame) -> DataFrame:
    """Result columns in the types both engines print alike: LONG, DOUBLE, STRING, TIMESTAMP_NTZ."""
    cols = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        c = F.col(f"`{f.name}`")
        if kind == "boolean":
            c = c.cast("double")
        elif kind in ("byte", "short", "integer"):
            c = c.cast("long")
        elif kind in ("float", "decimal"):
            c = c.cast("double")
        elif kind in ("date", "timestamp"):
            c = c.cast("timestamp_ntz")
        elif kind in ("map", "array", "struct"):
            c = F.to_json(c)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def runner(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: tidy(QUERIES[name](Tables(spark, folder)))
