"""The polled stop-monitoring feed as a file stream.

The flattening is stateless, so the batch function runs unchanged on a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.feeds import flatten_stop_visits

SNAPSHOT_SCHEMA = "agency_id string, json string"


def read_snapshots(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """Snapshot documents as they land; the cap per trigger bounds a micro-batch, not the data."""
    return spark.readStream.schema(SNAPSHOT_SCHEMA).option("maxFilesPerTrigger", max_files).parquet(folder)


def write_visits(snapshots: DataFrame, out: str, checkpoint: str):
    """Append flattened visits; the checkpoint in shared storage makes a restart exact."""
    return (
        flatten_stop_visits(snapshots).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
