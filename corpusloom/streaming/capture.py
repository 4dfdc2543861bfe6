"""Incremental front ends on Structured Streaming: what is new since the checkpoint, in one drained run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def drain_text(spark: SparkSession, folder: str, checkpoint: str, handle: Callable[[DataFrame, int], None], glob: str = "*.jsonl") -> None:
    """Hand the lines of files that are new since ``checkpoint`` to ``handle(rows, batch)``, then stop.

    The checkpoint takes the place of a lock and of a queue: a batch that failed is handed over again.
    """
    stream = spark.readStream.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(folder)
    rows = stream.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("mtime"), "value")
    rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def drain_table(spark: SparkSession, folder: str, checkpoint: str, schema: str, handle: Callable[[DataFrame, int], None]) -> None:
    """The same over Parquet rows, such as chunks that wait for vectors."""
    rows = spark.readStream.schema(schema).parquet(folder)
    rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
