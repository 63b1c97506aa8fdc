"""Session settings the operators are tuned for, and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}

_taken: list[str] = []


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, app: str = "panelsmith") -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for k, v in SETTINGS.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for written tables and checkpoints that every executor can read.

    It lies under the cluster's ``spark.checkpoint.dir``.  Where that is unset
    (tests), it lies under ``spark.sql.warehouse.dir``, which is shared as well;
    no machine-local temporary folder is ever taken.  The folder stays until
    ``release_scratch``, as lazy results may read from it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"
    _taken.append(f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}")
    return _taken[-1]


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back.

    Cuts the lineage so that an expensive stage runs once; the files outlive any
    executor.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release_scratch(spark: SparkSession) -> None:
    """Delete the scratch folders this process has taken; call it once results that read from them are written."""
    while _taken:
        path = spark._jvm.org.apache.hadoop.fs.Path(_taken.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
