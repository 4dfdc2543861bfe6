"""What a listing of files holds: export batches, rollouts, side files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.sources import exports


def export_batches(files: DataFrame) -> DataFrame:
    """(batch, batch_date, files) of folders that hold conversations, at any depth, oldest first; a batch is known by
    what it holds, not by its name."""
    held = files.where(F.substring_index("path", "/", -1).rlike(f"^{exports.CONVERSATIONS}$"))
    by = held.groupBy(F.regexp_replace("path", r"/[^/]*$", "").alias("batch")).agg(F.max("mtime").alias("mtime"),
        F.array_sort(F.collect_set("path")).alias("files"))
    return by.select("batch", exports.batch_date(F.col("batch"), F.col("mtime")).alias("batch_date"), "files").orderBy("batch_date", "batch")


def second_batches(files: DataFrame, prefix: str = "data-") -> DataFrame:
    """(batch, batch_date) of folders of the second export: named with the prefix, or holding a file only it has."""
    folder = F.regexp_replace("path", r"/[^/]*$", "")
    marks = F.substring_index("path", "/", -1).isin("memories.json", "projects.json") | F.col("path").rlike(r"/projects/[^/]+\.json$")
    home = F.regexp_replace(folder, r"/projects$", "")
    held = files.select(home.alias("batch"), "mtime", (marks | F.substring_index(home, "/", -1).startswith(prefix)).alias("is"))
    by = held.groupBy("batch").agg(F.max("mtime").alias("mtime"), F.bool_or("is").alias("is")).where("is")
    return by.select("batch", exports.batch_date(F.col("batch"), F.col("mtime")).alias("batch_date")).orderBy("batch_date", "batch")


def rollouts(files: DataFrame, folders: tuple[str, ...] = ("sessions", "archived_sessions")) -> DataFrame:
    """Rollout files below the named folders, with whether they are archived ones."""
    parts = F.split("path", "/")
    found = files.where(F.substring_index("path", "/", -1).rlike(r"^rollout-.*\.jsonl$") & F.arrays_overlap(parts, F.array(*map(F.lit, folders))))
    return found.withColumn("archived", F.array_contains(parts, "archived_sessions"))


def side_files(files: DataFrame) -> DataFrame:
    """Notes and texts that lie beside transcripts."""
    return files.where(F.lower("path").rlike(r"\.(md|markdown|txt)$"))
