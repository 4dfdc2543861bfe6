"""Incremental maintenance as joins between the stored snapshot and what a run has seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NEW, CHANGED, TOUCHED, SAME, GONE = "new", "changed", "touched", "same", "gone"


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, state) by content hash, metadata hash and the file's time and size; one full outer join."""
    a, b = old.alias("a"), new.alias("b")
    unchanged_file = (F.abs(F.col("a.mtime") - F.col("b.mtime")) < 1e-6) & (F.col("a.size") == F.col("b.size"))
    state = (
        F.when(F.col("a.path").isNull(), NEW)
        .when(F.col("b.path").isNull(), GONE)
        .when(F.col("a.content_hash") != F.col("b.content_hash"), CHANGED)
        .when(F.coalesce(unchanged_file, F.lit(False)), SAME)
        .otherwise(TOUCHED)
    )
    return a.join(b, F.col("a.path") == F.col("b.path"), "full").select(F.coalesce("a.path", "b.path").alias("path"), state.alias("state"))


def unchanged(listing: DataFrame, documents: DataFrame, force: bool = False) -> DataFrame:
    """Files of the listing that need no parse: same size, same time to a microsecond; none under ``force``."""
    if force:
        return listing.where("false")
    held = documents.select("path", F.col("mtime").alias("_m"), F.col("size").alias("_s"))
    return listing.join(held, "path").where((F.abs(F.col("mtime") - F.col("_m")) < 1e-6) & (F.col("size") == F.col("_s"))).select(*listing.columns)


def upsert(old: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """``old`` with the rows of ``new`` put in by key; new rows win whole."""
    o, n = old.alias("o"), new.alias("n")
    taken = F.col(f"n.{key}").isNotNull()
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"),
        "full").select(*(F.when(taken, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in old.columns))


def prune(documents: DataFrame, seen: DataFrame, scanned: DataFrame) -> DataFrame:
    """Documents that stay: seen ones, and all of sources that were not scanned successfully."""
    stale = documents.join(scanned.select("source_type").distinct(), "source_type", "left_semi").join(seen.select("path").distinct(), "path",
        "left_anti")
    return documents.join(stale.select("path"), "path", "left_anti")


def owners(occurrences: DataFrame) -> DataFrame:
    """(content_hash, path, ord): the first occurrence of each chunk, by path and place."""
    w = Window.partitionBy("content_hash").orderBy("path", "ord")
    return occurrences.withColumn("n", F.row_number().over(w)).where("n = 1").select("content_hash", "path", "ord")


def rehome(chunks: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Chunks that some document still holds, each owned by its least surviving occurrence."""
    home = occurrences.groupBy("content_hash").agg(F.min(F.struct("path", "ord")).alias("home"))
    return chunks.drop("path", "ord").join(home, "content_hash").select("content_hash", F.col("home.path").alias("path"),
        F.col("home.ord").alias("ord"), *(c for c in chunks.columns if c not in ("content_hash", "path", "ord")))


def add_chunks(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks with those of ``new`` whose hash is not there yet, one row a hash."""
    w = Window.partitionBy("content_hash").orderBy("path", "ord")
    fresh = new.join(chunks.select("content_hash"), "content_hash", "left_anti").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return chunks.unionByName(fresh.select(*chunks.columns))


def pending(chunks: DataFrame, vectors: DataFrame, model_name: str | None = None) -> DataFrame:
    """Prose chunks without a vector (of the model)."""
    held = vectors if model_name is None else vectors.where(F.col("model") == model_name)
    return chunks.where("kind = 'prose'").join(held.select("content_hash"), "content_hash", "left_anti")


def replace_vectors(vectors: DataFrame, new: DataFrame) -> DataFrame:
    keys = ["content_hash", "model"] if "model" in vectors.columns else ["content_hash"]
    return vectors.join(new.select(*keys), keys, "left_anti").unionByName(new)


def integrity(occurrences: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """(dangling_occurrences, damaged_documents, orphan_vectors) in one row."""
    lost = occurrences.join(chunks.select("content_hash"), "content_hash", "left_anti").agg(F.count("*").alias("dangling_occurrences"),
        F.count_distinct("path").alias("damaged_documents"))
    orphans = vectors.join(chunks.select("content_hash"), "content_hash", "left_anti").agg(F.count("*").alias("orphan_vectors"))
    return lost.join(F.broadcast(orphans))  # one row each


def latest(rows: DataFrame, key: str | list[str], *order: Column) -> DataFrame:
    """The last row of each key in ``order`` (which ends with a tie-breaker)."""
    keys = [key] if isinstance(key, str) else key
    w = Window.partitionBy(*keys).orderBy(*(o.desc() for o in order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def reattributed(documents: DataFrame, found: DataFrame) -> DataFrame:
    """Documents with the project that ``found`` (path, project) says, where it says one that differs."""
    other = found.select("path", F.col("project").alias("_p")).where("_p is not null and _p <> ''")
    return documents.join(other, "path", "left").withColumn("project", F.coalesce("_p", "project")).drop("_p")
