"""BM25 over chunks from the texts themselves, and ranking; see ``indexed`` for search from a written inverted index.

A query is a list of phrases, each a list of tokens; a phrase counts as one term, and one that is given
twice counts twice.  Statistics are of the whole corpus even where a filter narrows the hits, and the
filter is below the ranking and its limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import scoring, text


def occurrences(tokens: Column, phrase: list[str]) -> Column:
    """How often the phrase stands in the token array."""
    if len(phrase) == 1:
        return F.size(F.filter(tokens, lambda t: t == phrase[0]))
    rest = lambda i: [F.get(tokens, i + k) == p for k, p in enumerate(phrase) if k]

    def here(t: Column, i: Column) -> Column:
        out = t == phrase[0]
        for r in rest(i):
            out = out & r
        return out

    return F.size(F.filter(tokens, here))


def scan_scores(chunks: DataFrame, phrases: list[list[str]], key: str = "chunk_id", where: Column | None = None) -> DataFrame:
    """(key, score) of the hits, in two passes over the text and no shuffle but of one row of statistics."""
    counted = chunks.withColumn("tokens", text.tokens(F.col("text")))
    counted = counted.select(*(c for c in chunks.columns if c != "text"), F.size("tokens").alias("dl"),
        *(occurrences(F.col("tokens"), p).alias(f"tf{i}") for i, p in enumerate(phrases)))
    stats = counted.agg(F.count("*").alias("total"), F.avg("dl").alias("mean_dl"),
        *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(phrases))))
    hits = counted if where is None else counted.where(where)
    any_hit = F.greatest(F.lit(0), F.lit(0), *(F.col(f"tf{i}") for i in range(len(phrases)))) > 0
    scored = hits.where(any_hit).join(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(phrases)):
        score = score + scoring.bm25_term(F.col(f"tf{i}"), F.col("dl"), F.col("mean_dl"), scoring.idf(F.col(f"df{i}"), F.col("total")))
    return scored.select(key, score.alias("score"))


def shifted(positions: str, by: int) -> Column:
    return F.transform(positions, lambda p: p - by)


def ranked(scores: DataFrame, limit: int, key: str = "chunk_id", order: str = "score", descending: bool = True, digits: int = 6) -> DataFrame:
    """The first ``limit`` rows with their rank from 0; ties by key, values compared at ``digits``, nulls last."""
    value = F.round(order, digits)
    first = value.desc_nulls_last() if descending else value.asc_nulls_last()
    best = scores.orderBy(first, F.col(key).asc()).limit(limit)
    # at most ``limit`` rows are numbered
    w = Window.orderBy(first, F.col(key).asc())
    return best.withColumn("rank0", F.row_number().over(w) - 1)
