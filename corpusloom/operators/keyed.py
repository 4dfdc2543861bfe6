"""Tables that are read by key: files sorted by the key, and beside them a list of each file's least and greatest key.

A reader with a few keys opens the files that could hold one and no other; within a file the sorted column prunes pages.  The
list is a small table of its own (``_keys``, which Spark's readers pass over), a row for each file.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a file at most: some tens of megabytes of chunks.
FILE_ROWS = 20_000
#: Files whose keys the driver keeps, of some 200 bytes each; the names in longer lists are looked up by a job.
LISTED = 100_000


def write(rows: DataFrame, path: str, key: str, file_rows: int = FILE_ROWS) -> None:
    """Write ``rows`` sorted by ``key`` over all files, and the list."""
    spark = rows.sparkSession
    rows.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").option("maxRecordsPerFile", file_rows).parquet(path)
    name = F.substring_index(F.input_file_name(), "/", -1).alias("file")
    held = spark.read.schema(rows.schema).parquet(path).groupBy(name).agg(F.min(key).alias("least"), F.max(key).alias("greatest"), F.count("*").alias("n"))
    held.coalesce(1).write.mode("overwrite").parquet(f"{path}/_keys")


class Keyed:
    """The rows of several such tables of one schema; ``alias`` is the name that readers know the key by."""

    def __init__(self, spark: SparkSession, paths: list[str], schema: str, key: str, alias: str | None = None) -> None:
        self.spark, self.paths, self.schema, self.key, self.alias = spark, paths, schema, key, alias or key
        self.listed: list[tuple] | None = None

    def _lists(self) -> DataFrame:
        out = None
        for path in self.paths:
            held = self.spark.read.parquet(f"{path}/_keys").select(F.concat(F.lit(f"{path}/"), "file").alias("file"), "least", "greatest")
            out = held if out is None else out.unionByName(held)
        return out

    def files(self, keys: list) -> list[str]:
        """Files that could hold one of the keys."""
        keys = sorted({k for k in keys if k is not None})
        if not keys or not self.paths:
            return []
        if self.listed is None:
            few = self._lists().limit(LISTED + 1).collect()
            self.listed = [tuple(r) for r in few] if len(few) <= LISTED else []
        if self.listed:
            return [f for f, least, greatest in self.listed if least is not None and (i := bisect_left(keys, least)) < len(keys) and keys[i] <= greatest]
        asked = self.spark.createDataFrame([(k,) for k in keys], "k string" if isinstance(keys[0], str) else "k long")
        return [r["file"] for r in self._lists().join(F.broadcast(asked), F.col("k").between(F.col("least"), F.col("greatest"))).select("file").distinct().collect()]

    def rows(self, keys: list) -> DataFrame:
        """The rows of the keys, from their files alone."""
        read = self.spark.read.schema(self.schema)
        files = self.files(keys)
        held = read.parquet(*files) if files else self.spark.createDataFrame([], self.schema)
        return held.where(F.col(self.key).isin(list({k for k in keys if k is not None}))).withColumnRenamed(self.key, self.alias)

    def all(self) -> DataFrame:
        held = self.spark.read.schema(self.schema).parquet(*self.paths) if self.paths else self.spark.createDataFrame([], self.schema)
        return held.withColumnRenamed(self.key, self.alias)
