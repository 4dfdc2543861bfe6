"""Hybrid search: BM25 and exact nearest neighbours, fused by reciprocal ranks, boosted, with a confidence.

One plan from chunks to the result: both legs rank below their own limits after the filter, at most a few
thousand candidates are fused, joined back by key, scored and reduced to the best chunk of a document.

``chunks`` has chunk_id, path, project, source_type, kind, doc_date, title, ord, text, branch;
``vectors`` has chunk_id, embedding.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom import model
from corpusloom.functions import querytext, scoring, text
from corpusloom.operators import lexical
from corpusloom.operators.filters import Filters

ATTRIBUTES = ("chunk_id", "path", "project", "source_type", "kind", "doc_date", "title", "ord", "branch")


@dataclass(frozen=True)
class Policy:
    """How many candidates each leg gives, and whether its scan is scoped."""

    lexical: int
    vector: int
    scoped: bool
    use_vectors: bool = True


def exact_policy(filters: Filters) -> Policy:
    """Both legs always scoped, however many chunks pass; pools by what is filtered."""
    pool = model.POOL_BROAD if filters.active() and filters.projects is None else model.POOL_PROJECT
    return Policy(pool, model.POOL_GLOBAL, True, not filters.skips_vectors())


def eligible_count(chunks: DataFrame, filters: Filters) -> DataFrame:
    return chunks.where(filters.predicate()).agg(F.count("*").alias("eligible"))


def lexical_leg(chunks: DataFrame, query: str, limit: int, filters: Filters) -> DataFrame:
    narrow = chunks.select("chunk_id", "text", "project", "source_type", "kind", "doc_date")
    scores = lexical.scan_scores(narrow, querytext.phrases(query), where=filters.predicate())
    return lexical.ranked(scores, limit)


def nearest(vectors: DataFrame, query: list[float], limit: int) -> DataFrame:
    """(chunk_id, distance, rank0) of the nearest vectors, by exact scan."""
    measured = vectors.select("chunk_id", scoring.l2(F.col("embedding"), query).alias("distance"))
    return lexical.ranked(measured, limit, order="distance", descending=False)


def vector_leg(chunks: DataFrame, vectors: DataFrame, query: list[float], limit: int, filters: Filters, scoped: bool) -> DataFrame:
    if scoped and filters.active():
        vectors = vectors.join(chunks.where(filters.predicate()).select("chunk_id"), "chunk_id", "left_semi")
    return nearest(vectors, query, limit)


def fuse(lexical_hits: DataFrame, vector_hits: DataFrame | None, key: str = "chunk_id") -> DataFrame:
    """(key, rrf, is_fts, distance, matched_by): the legs by union and one sum, no outer join."""
    legs = lexical_hits.select(key, scoring.rrf(F.col("rank0")).alias("part"), F.lit(None).cast("double").alias("distance"),
        F.lit("fts").alias("leg"))
    if vector_hits is not None:
        legs = legs.unionByName(vector_hits.select(key, scoring.rrf(F.col("rank0")).alias("part"), "distance", F.lit("vector").alias("leg")))
    return legs.groupBy(key).agg(F.sum("part").alias("rrf"), F.max("distance").alias("distance"), F.bool_or(F.col("leg") == "fts").alias("is_fts"),
        F.sort_array(F.collect_set("leg")).alias("matched_by"))


def scored(rows: DataFrame, query: str, sure: float, hopeless: float) -> DataFrame:
    """Candidates with their attributes and text, with boost, confidence and score."""
    sure_of = scoring.confidence(scoring.vector_confidence(F.col("distance"), sure, hopeless), text.coverage(querytext.terms(query), F.col("text")))
    rows = rows.withColumn("confidence", sure_of).withColumn("boost", scoring.boost(*map(F.col, ("source_type", "kind", "path", "branch"))))
    return rows.withColumn("score", F.col("rrf") * F.col("boost") * F.col("confidence"))


def best_by_document(rows: DataFrame, digits: int = 9) -> DataFrame:
    w = Window.partitionBy("path").orderBy(F.col("is_fts").desc(), F.round("score", digits).desc(), F.col("chunk_id").asc())
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def search(
    chunks: DataFrame,
    vectors: DataFrame | None,
    query: str,
    vector: list[float] | None = None,
    filters: Filters = Filters(),  # noqa: B008  immutable
    limit: int = model.WEB_DEFAULT,
    policy: Policy | None = None,
    sure: float = model.L2_SURE,
    hopeless: float = model.L2_HOPELESS,
    digits: int = 9,
) -> DataFrame:
    """The result rows, in order.  Without vectors or a query vector the lexical leg stands alone."""
    policy = policy or exact_policy(filters)
    hits = lexical_leg(chunks, query, policy.lexical, filters)
    near = None
    if vectors is not None and vector is not None and policy.use_vectors:
        near = vector_leg(chunks, vectors, vector, policy.vector, filters, policy.scoped)
    rows = F.broadcast(fuse(hits, near)).join(chunks.select(*ATTRIBUTES, "text"), "chunk_id")  # the legs' limits bound it
    if near is not None and not policy.scoped and filters.active():
        rows = rows.where(filters.predicate())  # a global pool holds rows the filter excludes
    return finished(rows, query, sure, hopeless, limit, digits)


def finished(rows: DataFrame, query: str, sure: float, hopeless: float, limit: int, digits: int = 9) -> DataFrame:
    """The result rows in order, from candidates with attributes and text: the best of each document."""
    rows = best_by_document(scored(rows, query, sure, hopeless), digits)
    rows = rows.withColumn("excerpt", text.excerpt(F.col("text"))).drop("text")
    first = [F.col("is_fts").desc()] if querytext.is_exact(query) else []
    return rows.orderBy(*first, F.round("score", digits).desc(), F.col("chunk_id").asc()).limit(limit)


def median_confidence(results: DataFrame) -> DataFrame:
    """(median_confidence, absent): exact median, 0 without rows."""
    return results.agg(F.coalesce(F.median("confidence"), F.lit(0.0)).alias("median_confidence")).withColumn("absent",
        F.col("median_confidence") < model.ABSENT_MEDIAN)
