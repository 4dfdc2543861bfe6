"""Column functions of ranking and scoring."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom import model


def l2(vector: Column, query: list[float]) -> Column:
    """Euclidean distance in double precision."""
    held = F.array(*(F.lit(float(x)) for x in query))
    return F.sqrt(F.aggregate(F.zip_with(vector, held, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x))


def idf(n: Column, total: Column) -> Column:
    return F.greatest(F.lit(model.LEAST_IDF), F.log((total - n + 0.5) / (n + 0.5)))


def bm25_term(tf: Column, length: Column, mean_length: Column, idf_: Column) -> Column:
    k1, b = model.BM25_K1, model.BM25_B
    return idf_ * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean_length))


def rrf(rank0: Column, k: int = model.RRF_K) -> Column:
    return F.lit(1.0) / (k + 1 + rank0)


def vector_confidence(distance: Column, sure: float = model.L2_SURE, hopeless: float = model.L2_HOPELESS) -> Column:
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(hopeless) - distance) / (hopeless - sure))), F.lit(0.0))


def confidence(vector: Column, coverage: Column) -> Column:
    return model.LEAST_CONFIDENCE + (1 - model.LEAST_CONFIDENCE) * F.greatest(vector, coverage)


def boost(source_type: Column, kind: Column, path: Column, branch: Column) -> Column:
    """Static boost.  Repo documents count as top ones under docs or specs, or near their root."""
    parts = F.split(path, "/")
    top = F.array_contains(parts, "docs") | F.array_contains(parts, "specs") | (F.size(parts) <= 6)
    fixed = F.when(source_type == model.REPO_DOC, F.when(top, model.BOOST_REPO_TOP).otherwise(model.BOOST_REPO_DEEP))
    for name, value in model.BOOSTS.items():
        fixed = fixed.when(source_type == name, value)
    said = F.when(branch == model.ABANDONED, model.BOOST_ABANDONED).when(kind == model.TOOL_EVENT,
        model.BOOST_TOOL_EVENT).otherwise(model.BOOST_PROSE)
    return fixed.when(source_type == model.TRANSCRIPT, said).otherwise(F.lit(1.0))


def backlog_score(documents: Column, last: Column, as_of: Column) -> Column:
    """Documents, halved for each 90 days since the last; a missing date counts as ten years."""
    days = F.coalesce(F.datediff(as_of, F.try_to_date(last, "yyyy-MM-dd")), F.lit(model.NO_DATE_DAYS))
    return documents * F.pow(F.lit(0.5), F.greatest(F.lit(0), days) / model.HALF_LIFE_DAYS)
