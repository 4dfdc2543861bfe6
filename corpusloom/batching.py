"""Bounds of the Arrow batches that Python functions get."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows and bytes of a batch at most; texts can be long, and a worker holds a batch and its arrays at a time.
BATCH_ROWS, BATCH_BYTES = 512, 8 * 1024 * 1024


def small_batches(spark: SparkSession) -> None:
    """Have Spark hand Python batches of few rows and bytes, so that long texts fit a worker.

    The settings are read when a plan runs, so they stay in the session; smaller ones are left as they are.
    """
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = int(spark.conf.get(key).removesuffix("b"))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


@cache
def _libc() -> ctypes.CDLL | None:
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def give_back() -> None:
    """Hand freed memory to the system, where the C library can: an idle worker else keeps what its last task used."""
    if libc := _libc():
        libc.malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut to ``rows`` rows, and to ``most`` bytes on average; one row is never cut.  After the last the memory that
    the task has freed is given back."""
    for batch in batches:
        step = max(1, min(rows, rows if batch.nbytes <= most else batch.num_rows * most // batch.nbytes))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
    give_back()
