"""Hybrid search from written tables: an inverted index, vectors, attributes and texts.

Postings, vectors and texts are of units, which are distinct texts; ``rows`` holds the attributes of every place where a
unit stands.  A query reads the postings of its own terms, the attributes its filter needs, the vectors of its
leg, and the texts of the few candidates that are left; no text is cut into tokens.

Postings lie in ranges of units, sorted by term within a range, with bounds of what a term can add to a score there (see
``ranges``).  Texts and attributes are sorted by unit, with a list of
each file's keys (see ``keyed``); the candidates, which the legs' limits bound, are known before these are read and
name the files to open.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom import model
from corpusloom.batching import slices, small_batches
from corpusloom.functions import querytext, scoring, text
from corpusloom.operators import clusters, keyed, lexical, ranges, search
from corpusloom.operators.filters import Filters
from corpusloom.workdir import materialize


@dataclass(frozen=True)
class Index:
    """``rows``: unit and search.ATTRIBUTES, ``texts``: unit and text, both by unit; ``postings``: term, unit, dl, tf, positions;
    ``vectors``: unit, model, embedding."""

    rows: keyed.Keyed | None
    postings: DataFrame
    texts: keyed.Keyed | None
    total: int
    mean_dl: float
    vectors: DataFrame | None = None
    models: tuple[str, ...] = field(default=())
    #: unit and kind of every place, from which a filter on the kind alone is answered
    kinds: DataFrame | None = None
    #: the same vectors by clusters, from which the nearest are found without reading all; (unit) of those that don't count any more
    clusters: clusters.Clustered | None = None
    dead: DataFrame | None = None
    #: the same postings in ranges of units with bounds, from which the best are found without reading or moving all
    ranges: ranges.Ranged | None = None

    def checked(self, name: str | None) -> DataFrame | None:
        """Vectors of one model; a query of another model is refused."""
        if self.vectors is None or name is None:
            return self.vectors
        if others := sorted(m for m in self.models if m != name):
            raise ValueError(f"the index holds vectors of {others}; the query's are of {name}")
        return self.vectors


def postings(units: DataFrame, unit: str = "unit") -> DataFrame:
    """(term, unit, dl, tf, positions) of (unit, text), written once: dealing them to ranges looks for its bounds in a
    pass of its own, which would cut all texts into tokens again."""
    return materialize(grouped(units, unit), "grouped")


def grouped(units: DataFrame, unit: str = "unit") -> DataFrame:
    """(term, unit, dl, tf, positions) of (unit, text), in no order.

    A unit's tokens are in one row, so its postings need no shuffle: they are grouped within Arrow batches, by array
    operations.  (Collecting positions by term and unit would sort all tokens and shuffle them first.)
    """
    held = units.select(F.col(unit).alias("unit"), text.tokens(F.col("text")).alias("t"))
    small_batches(units.sparkSession)
    names = ["term", "unit", "dl", "tf", "positions"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            size = pc.fill_null(pc.list_value_length(b.column("t")), 0).to_numpy()
            words = b.column("t").flatten().dictionary_encode()
            if not len(words):
                continue
            doc = np.repeat(np.arange(len(size)), size)
            at = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
            key = doc * len(words.dictionary) + words.indices.to_numpy()
            order = np.argsort(key, kind="stable")  # places stay in order
            head = np.flatnonzero(np.append(True, np.diff(key[order]) > 0))
            first, ends = order[head], np.append(head, len(order)).astype(np.int32)
            term = words.dictionary.take(words.indices.take(pa.array(first)))
            places = pa.ListArray.from_arrays(pa.array(ends), pa.array(at[order], pa.int32()))
            columns = [term, b.column("unit").take(pa.array(doc[first])), pa.array(size[doc[first]], pa.int32()), pa.array(np.diff(ends), pa.int32()), places]
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = held.schema["unit"].dataType.simpleString()
    return held.mapInArrow(run, f"term string, unit {kind}, dl int, tf int, positions array<int>")


def scores(index: Index, phrases: list[list[str]], allowed: DataFrame | None = None) -> DataFrame:
    """(unit, score) of the hits; statistics are of all units, ``allowed`` (unit) narrows the hits."""
    wanted = sorted({t for p in phrases for t in p})
    if not wanted:
        return index.postings.select("unit", F.lit(0.0).alias("score")).where("false")
    few = index.postings.where(F.col("term").isin(wanted))
    # positions are read of terms that stand in a phrase of several words only
    placed = {t for p in phrases if len(p) > 1 for t in p}
    at = {t: f"{'p' if t in placed else 'n'}{k}" for k, t in enumerate(wanted)}
    held = few.groupBy("unit").agg(
        F.first("dl").alias("dl"), *(F.max(F.when(F.col("term") == t, F.col("positions" if t in placed else "tf"))).alias(c) for t, c in at.items())
    )

    def times(phrase: list[str]) -> Column:
        met = F.col(at[phrase[0]])
        if phrase[0] not in placed:
            return F.coalesce(met, F.lit(0))
        for k, t in enumerate(phrase[1:], 1):
            met = F.array_intersect(met, lexical.shifted(at[t], k))
        return F.coalesce(F.greatest(F.size(met), F.lit(0)), F.lit(0))

    counted = held.select("unit", "dl", *(times(p).alias(f"tf{i}") for i, p in enumerate(phrases)))
    stats = counted.agg(*(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(phrases))))
    hits = counted.where(F.greatest(F.lit(0), F.lit(0), *(F.col(f"tf{i}") for i in range(len(phrases)))) > 0)
    if allowed is not None:
        hits = hits.join(allowed, "unit", "left_semi")
    score = F.lit(0.0)
    for i in range(len(phrases)):
        score = score + scoring.bm25_term(F.col(f"tf{i}"), F.col("dl"), F.lit(index.mean_dl), scoring.idf(F.col(f"df{i}"), F.lit(index.total)))
    return hits.join(F.broadcast(stats)).select("unit", score.alias("score"))  # one row


def allowed(index: Index, filters: Filters) -> DataFrame | None:
    """(unit) of the places that pass; a filter on the kind alone doesn't touch documents."""
    rows = index.rows.all() if filters.needs_documents() or index.kinds is None else index.kinds
    return rows.where(filters.predicate()).select("unit") if filters.active() else None


def lexical_leg(index: Index, query: str, limit: int, filters: Filters = Filters()) -> DataFrame:  # noqa: B008  immutable
    phrases, among = querytext.phrases(query), allowed(index, filters)
    if index.ranges is not None:
        narrowed = None if among is None else lambda hits: hits.join(among, "unit", "left_semi")
        return index.ranges.best(phrases, limit, index.total, index.mean_dl, narrowed, index.dead)
    return lexical.ranked(scores(index, phrases, among), limit, "unit")


def vector_leg(index: Index, vector: list[float], limit: int, filters: Filters, scoped: bool, name: str | None = None) -> DataFrame:
    held = index.checked(name)

    def among(rows: DataFrame) -> DataFrame:
        rows = rows if index.dead is None else rows.join(index.dead, "unit", "left_anti")
        return rows.join(allowed(index, filters), "unit", "left_semi") if scoped and filters.active() else rows

    if index.clusters is not None:
        key = index.clusters.key
        hits = index.clusters.nearest(vector, limit, lambda rows: among(rows.withColumnRenamed(key, "unit")).withColumnRenamed("unit", key))
        return hits.withColumnRenamed(key, "unit")
    if scoped and filters.active():
        held = held.join(allowed(index, filters), "unit", "left_semi")
    measured = held.select("unit", scoring.l2(F.col("embedding"), vector).alias("distance"))
    return lexical.ranked(measured, limit, "unit", order="distance", descending=False)


def candidates(index: Index, query: str, vector: list[float] | None, filters: Filters, policy: search.Policy, name: str | None = None) -> DataFrame:
    """(unit, rrf, distance, is_fts, matched_by) of both legs."""
    hits = lexical_leg(index, query, policy.lexical, filters)
    near = None
    if index.vectors is not None and vector is not None and policy.use_vectors:
        near = vector_leg(index, vector, policy.vector, filters, policy.scoped, name)
    return search.fuse(hits, near, "unit")


def find(
    index: Index,
    query: str,
    vector: list[float] | None = None,
    filters: Filters = Filters(),  # noqa: B008  immutable
    limit: int = model.WEB_DEFAULT,
    policy: search.Policy | None = None,
    sure: float = model.L2_SURE,
    hopeless: float = model.L2_HOPELESS,
    digits: int = 9,
    name: str | None = None,
) -> DataFrame:
    """The result rows of ``search.search``, from the index.  The candidates are brought to the driver, as many as the
    legs' limits allow, so that only the files of their attributes and texts are opened."""
    policy = policy or search.exact_policy(filters)
    held = candidates(index, query, vector, filters, policy, name)
    few = held.collect()
    units = [r["unit"] for r in few]
    small = F.broadcast(index.postings.sparkSession.createDataFrame(few, held.schema))  # the legs' limits bound it
    # a global pool holds rows the filter excludes, and a unit stands in places it excludes
    rows = small.join(index.rows.rows(units).where(filters.predicate()), "unit")
    rows = rows.join(index.texts.rows(units).select("unit", "text"), "unit")
    return search.finished(rows, query, sure, hopeless, limit, digits)
