"""Scratch tables in the folder that the driver and all executors share.

The folder is the one the session names in ``spark.checkpoint.dir``.  Only where that is unset and everything runs
in one process (tests, a laptop) a folder of our own is made and set on the context; on a cluster that is an error.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The shared folder of this session, as a URI that Spark's readers and writers take."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not current.isDefined() and not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir names no folder that the driver and all executors share")
        named = current.get() if current.isDefined() else "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        if not current.isDefined():
            spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder; it is removed when the driver's Python ends."""
    path = f"{shared_root(spark)}/corpusloom-{label}-{uuid.uuid4().hex[:12]}"
    if not _made:
        atexit.register(_sweep)
    _made.append((spark, path))
    return path


def materialize(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and return the table read back.

    This cuts the lineage in a way that outlives lost executors.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.options(compression="zstd", **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a path through the file system that owns it."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _sweep() -> None:
    for spark, path in _made:
        try:
            discard(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone; the folder is the cluster's to clean
            return
