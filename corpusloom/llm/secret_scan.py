"""Secrets in texts: fixed patterns, and bare strings told apart by who owns them across the corpus.

Fixed kinds (assign, access, hex) are found in every text.  Besides, every bare string that could be a
credential is a candidate, known by a hash of its value.  Over the whole corpus the hashes of candidates,
and of the values of fixed kinds, are counted by distinct repositories and owners.  Values that ``COPIED_OWNERS`` owners hold
in ``COPIED_REPOSITORIES`` repositories are contested: a snippet that many people paste, or one document that was copied.
The texts that hold contested values are joined by similarity (see ``ngram_join``), and each group of near copies
counts once, for its least owner and repository.  A value that still has as many owners and repositories is a widely
copied example; any other that looks like a live credential becomes a span of kind ``owned``.  Spans of fixed kinds stay
whatever their owners; how many of them hold examples is told.

Only values' hashes leave a task; they are combined by (value, owner, repository) before each shuffle, so a value in a
third of all rows is a small group.  Texts are read again only where contested values stand.

Null texts count as empty and give no spans.  Rows that repeat are scanned each, and count once.  A null repository or
owner counts as one name of its own.  Offsets are in code points, ends exclusive.  An empty table gives
no rows.  Other columns stay out of the way.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import ngram_join
from corpusloom.llm.arrow_rows import batch, slices, small_batches
from corpusloom.workdir import materialize

# The base patterns and the least lengths of what they capture.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
HEX_LOWER, HEX_UPPER = frozenset("0123456789abcdef"), frozenset("0123456789ABCDEF")
KINDS = ("assign", "access", "hex", "owned")

#: A bare string that could be a credential, and how many bits by character it may lack of a random string's.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
LEAST_CHARS, LACKING_BITS = 20, 0.5
#: Distinct owners and repositories from which a value is an example that people copy.
COPIED_OWNERS, COPIED_REPOSITORIES = 4, 4
#: Values or texts' hashes that may be broadcast, of some 40 bytes each; beyond it rows are joined to them.
BROADCAST_VALUES = 500_000
#: Spans of all documents that may be broadcast, of some 20 bytes each; beyond it texts are joined to them.
BROADCAST_SPANS = 1_000_000
PIECE = re.compile(r"[^/]{20,}")


def base_values(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, where the value starts) of the fixed kinds; kinds by their place in KINDS."""
    found = [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found)


@cache
def random_bits(alphabet: int, n: int) -> float:
    """Expected entropy by character of n characters drawn from an alphabet."""
    p, held = 1 / alphabet, 0.0
    for k in range(2, min(n, 400) + 1):
        held += math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)) * k * math.log2(k)
    return math.log2(n) - alphabet * held / n


def looks_live(value: str) -> bool:
    """Digits with letters, or letters of both cases; entropy near that of a random string of this alphabet and length."""
    value = value[:-2] + value[-2:].rstrip("=")
    times = Counter(value)
    lower, upper, digit = (any(a <= c <= z for c in times) for a, z in ("az", "AZ", "09"))
    if lower + upper + digit < 2:
        return False
    alphabet = 16 if times.keys() <= HEX_LOWER or times.keys() <= HEX_UPPER else 26 * lower + 26 * upper + 10 * digit + 2 * any(c in times for c in "+/_-")
    n = len(value)
    # of long strings the expectation changes little
    return n >= LEAST_CHARS - 2 and -sum(k / n * math.log2(k / n) for k in times.values()) >= random_bits(alphabet, min(n, 400)) - LACKING_BITS


def candidates(text: str, taken: list[tuple]) -> list[tuple[int, int]]:
    """(start, end) of live-looking bare strings, or of their parts between slashes, that no fixed span touches; ``taken`` is sorted."""
    starts, reach = [t[0] for t in taken], list(accumulate((t[2] for t in taken), max))
    found = []
    for m in CANDIDATE.finditer(text):
        spans = [m.span()] if looks_live(m[0]) else [p.span() for p in PIECE.finditer(text, *m.span()) if looks_live(p[0])]
        for a, z in spans:
            before = bisect_left(starts, z)
            if not before or reach[before - 1] <= a:
                found.append((a, z))
    return found


def hashed(value: str) -> str:
    return hashlib.blake2b(value.encode(), digest_size=16).hexdigest()


SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
VALUES = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("value", pa.string())])
SCANNED = {"row": pa.string(), "doc_id": pa.int64(), "mark": pa.string(), "repository": pa.string(), "owner": pa.string(), "base": pa.list_(SPAN),
    "held": pa.list_(VALUES)}
SCANNED_DDL = "row string, doc_id long, mark string, repository string, owner string, base array<struct<start:long,kind:int,end:long>>, held array<struct<start:long,kind:int,end:long,value:string>>"
OWNED = KINDS.index("owned")


def find(docs: DataFrame, repository: Column, owner: Column) -> DataFrame:
    """One row for each document: what its text holds by itself, before the corpus is asked.

    ``base`` has the spans of fixed kinds, ``held`` the hashes of their values and of candidates.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for b in slices(batches):
            out: dict[str, list] = {k: [] for k in SCANNED}
            for text in b.column("text").to_pylist():
                said = text or ""
                base = base_values(said)
                values = [(s, k, e, v) for s, k, e, v in base] + [(s, OWNED, e, s) for s, e in candidates(said, base)]
                out["row"].append(f"{part}:{number}")
                out["mark"].append(None if text is None else hashlib.sha256(text.encode()).hexdigest())
                out["base"].append([{"start": s, "kind": k, "end": e} for s, k, e, _ in base])
                out["held"].append([{"start": s, "kind": k, "end": e, "value": hashed(said[v:e])} for s, k, e, v in values])
                number += 1
            yield batch(out | {k: b.column(k) for k in ("doc_id", "repository", "owner")}, SCANNED)

    return docs.select("doc_id", "text", repository.cast("string").alias("repository"), owner.cast("string").alias("owner")).mapInArrow(run,
        SCANNED_DDL)


def few(rows: DataFrame) -> DataFrame:
    """Written rows, broadcast where a count allows it."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_VALUES else rows


def frequent(held: DataFrame, copied_owners: int, copied_repositories: int) -> DataFrame:
    """(value) of those with as many owners and repositories; ``held`` has (value, owner, repository)."""
    by = held.groupBy("value", "owner", "repository").agg(F.count("*").alias("n"))
    # a null name is one name
    named = {c: F.countDistinct(c) + F.max(F.col(c).isNull().cast("long")) for c in ("repository", "owner")}
    counts = by.groupBy("value").agg(named["repository"].alias("n_repositories"), named["owner"].alias("n_owners"))
    return counts.where((F.col("n_owners") >= copied_owners) & (F.col("n_repositories") >= copied_repositories)).select("value")


def examples(docs: DataFrame, found: DataFrame, copied_owners: int = COPIED_OWNERS, copied_repositories: int = COPIED_REPOSITORIES) -> DataFrame:
    """(value) of the widely copied ones, where near copies of a text count once."""
    held = found.select("owner", "repository", "mark", F.explode("held.value").alias("value"))
    contested = materialize(frequent(held, copied_owners, copied_repositories), "contested")
    if contested.isEmpty():
        return contested
    held = held.join(few(contested), "value", "left_semi").distinct()
    marks = materialize(held.select("mark").distinct(), "contested")
    texts = docs.select(F.sha2("text", 256).alias("mark"), "text").join(few(marks), "mark", "left_semi").dropDuplicates(["mark"])
    texts = materialize(texts.select("mark", F.xxhash64("text").alias("doc_id"), "text"), "contested")
    groups = ngram_join.link(texts.select("doc_id", "text")).select("doc_id", "group")
    # a text without words is a group of its own
    named = texts.select("mark", "doc_id").join(groups, "doc_id").select("mark", F.coalesce("group", "doc_id").alias("group"))
    # a null name sorts first
    once = held.join(named, "mark").groupBy("value", "group").agg(F.min(F.struct("owner", "repository")).alias("who")).select("value", "who.*")
    return materialize(frequent(once, copied_owners, copied_repositories), "contested")


def scan(docs: DataFrame, repository: Column | None = None, owner: Column | None = None, copied_owners: int = COPIED_OWNERS,
    copied_repositories: int = COPIED_REPOSITORIES) -> DataFrame:
    """(doc_id, mark, base, added, n_examples, n_base_examples) of every row; ``mark`` is the SHA-256 of the text.

    ``repository`` defaults to the column source, ``owner`` to what comes before the first slash of it.
    ``base`` and ``added`` are arrays of (start, kind, end), sorted.  ``n_examples`` counts candidates that are no
    spans since they are examples, ``n_base_examples`` spans of fixed kinds whose value is one.
    """
    repository = F.col("source") if repository is None else repository
    owner = F.substring_index(F.col("source").cast("string"), "/", 1) if owner is None else owner
    found = materialize(find(docs, repository, owner), "secret-scan")
    copied = few(examples(docs, found, copied_owners, copied_repositories))
    known = found.select("row", F.explode(F.array_distinct("held.value")).alias("value")).join(copied, "value", "left_semi")
    known = known.groupBy("row").agg(F.collect_list("value").alias("copied"))  # of one text
    rows = found.join(known, "row", "left").withColumn("copied", F.coalesce("copied", F.expr("cast(array() as array<string>)")))
    bare, example = lambda s: s["kind"] == OWNED, lambda s: F.array_contains("copied", s["value"])
    added = F.transform(F.filter("held", lambda s: bare(s) & ~example(s)), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return rows.select("doc_id", "mark", "base", F.array_sort(added).alias("added"),
        F.size(F.filter("held", lambda s: bare(s) & example(s))).cast("long").alias("n_examples"),
        F.size(F.filter("held", lambda s: ~bare(s) & example(s))).cast("long").alias("n_base_examples"))


def spans_of(spans: str, kind: str) -> Column:
    """How many spans are of a kind."""
    number = KINDS.index(kind)
    return F.size(F.filter(spans, lambda s: s["kind"] == number)).cast("long")


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"),
        s["end"].cast("string"))), ",")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mark``, spans that touch as one; rows without a span unchanged.

    Spans meet rows by identifier, null or not, and by the hash of the text, so rows without an identifier and
    rows that share one are each masked by their own text.  ``n_chars`` follows where the text changes.
    """
    spans = scan(docs).select(F.col("doc_id").alias("id"), "mark", F.array_sort(F.concat("base", "added")).alias("spans")).where(F.size("spans") > 0)
    # a value is judged alike wherever it stands, so equal texts have equal spans
    spans = spans.groupBy("id", "mark").agg(F.first("spans").alias("spans"))
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            row = b.column("row")
            out = dict(zip((f.name for f in row.type), row.flatten(), strict=True))
            texts = out["text"].to_pylist()
            for i, spans in enumerate(b.column("spans").to_pylist()):
                if spans:
                    texts[i] = masked(texts[i], [(s["start"], s["end"]) for s in spans], mark)
                    if "n_chars" in out:
                        lengths = out["n_chars"].to_pylist()
                        lengths[i] = len(texts[i])
                        out["n_chars"] = pa.array(lengths, out["n_chars"].type)
            out["text"] = pa.array(texts, out["text"].type)
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    # few spans go to the texts, many meet them by identifier and text
    spans = materialize(spans, "spans")
    if (spans.agg(F.sum(F.size("spans"))).first()[0] or 0) <= BROADCAST_SPANS:
        spans = F.broadcast(spans)
    # the input's columns travel as one, so that none can clash with ours
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("row_id"), F.sha2("text", 256).alias("row_mark"))
    return rows.join(spans, F.col("row_id").eqNullSafe(F.col("id")) & (F.col("row_mark") == F.col("mark")), "left").select("row",
        "spans").mapInArrow(run, docs.schema)


def masked(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    out, at = [], 0
    for a, z in spans:
        if a > at or not out:
            out += [text[at:a], mark]
        at = max(at, z)
    return "".join(out) + text[at:]
