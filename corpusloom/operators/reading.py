"""Reading documents: resolve a path, the whole text, a window of chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom import model

NONE, ONE, MANY = "not found", "found", "ambiguous"


def resolve(documents: DataFrame, asked: str) -> DataFrame:
    """(status, path): the exact path, or the only one that holds ``asked``; several are listed, ten at most.

    No row means that nothing matches.
    """
    exact = documents.where(F.col("path") == asked).select("path").limit(1).withColumn("exact", F.lit(True))
    part = documents.where(F.col("path").contains(asked)).select("path").distinct().orderBy("path").limit(model.CANDIDATES + 1).withColumn("exact",
        F.lit(False))
    both = exact.union(part)  # 12 rows at most
    facts = both.agg(F.bool_or("exact").alias("has"), F.count_if(~F.col("exact")).alias("n"))
    rows = both.join(F.broadcast(facts)).where(F.col("exact") | ~F.col("has"))
    status = F.when(F.col("has") | (F.col("n") == 1), ONE).otherwise(MANY)
    return rows.select(status.alias("status"), "path").orderBy("path").limit(model.CANDIDATES)


def chunks_of(occurrences: DataFrame, chunks: DataFrame, path: str) -> DataFrame:
    """(ord, text) of one document in order."""
    own = occurrences.where(F.col("path") == path).select("path", "ord", "content_hash")
    return own.join(chunks.select("content_hash", "text"), "content_hash").select("path", "ord", "text")


def read_documents(occurrences: DataFrame, chunks: DataFrame, limit: int = model.READ_CHARS) -> DataFrame:
    """(path, text): chunks in order with blank lines between, cut at ``limit`` characters with a mark."""
    rows = occurrences.select("path", "ord", "content_hash").join(chunks.select("content_hash", "text"), "content_hash")
    ordered = F.array_sort(F.collect_list(F.struct("ord", "text")))
    whole = F.array_join(F.transform(ordered, lambda c: c["text"]), "\n\n")
    return rows.groupBy("path").agg(whole.alias("text")).select("path", capped(F.col("text"), limit).alias("text"))


def capped(text: Column, limit: int = model.READ_CHARS) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("\n\n[truncated]"))).otherwise(text)


def window(chunks: DataFrame, ord_: int, context: int) -> DataFrame:
    """Chunks whose number is within ``context`` of ``ord_``: a range of values, whatever rows there are."""
    return chunks.where(F.col("ord").between(ord_ - context, ord_ + context)).orderBy("ord")
