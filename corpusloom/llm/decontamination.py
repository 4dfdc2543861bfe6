"""Benchmark decontamination by a generalised suffix automaton of the test items.

The automaton of a block of items (at most ``BLOCK_WORDS`` words) knows every run of words that stands in one of them.  Each
document's words are streamed through it, which gives at each word the longest run that ends there and stands in an item.
Where that run has ``window`` words or more, its last ``window`` words are a window of an item; an item of fewer words counts
whole.  Words in windows are hit, and the items of a window are those of its state.  Stretches of words that no item has
can match nothing, so only longer stretches of items' words are streamed.

Automata are broadcast one at a time, and their size is bounded by the block; benchmarks of several blocks take several
passes, each of which adds its hits to those before.  No document is shuffled.

``scan`` tells hits, items and spans; ``clean`` cuts spans whose longest run exceeds a length, and drops documents of which
more than a share is hit.  Null texts have no words, and null or empty items no windows.  Rows that repeat are scanned
each.  Items that share an identifier count as one; an item without identifier hits words, counts once, and is not
in ``items``.  Empty tables give no hits or no rows.  Other columns are ignored by ``scan`` and kept by ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.arrow_rows import slices, small_batches
from corpusloom.llm.words import Words, words_of
from corpusloom.workdir import materialize

WINDOW = 10
#: Words of the items of one automaton at most (an item is never cut): some 100 MB in a worker.
BLOCK_WORDS = 200_000
#: What ``clean`` bears: words of a run that stands in an item, and the share of a document's words that are hit.
MOST_RUN, MOST_SHARE = 12, 0.5

SPAN = pa.struct([("first", pa.int64()), ("end", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("longest", pa.int64())])
TYPES = {"n_words": pa.int64(), "spans": pa.list_(SPAN), "items": pa.list_(pa.string()), "nameless": pa.bool_()}
SCHEMA = ("n_words long, spans array<struct<first: long, end: long, start: long, stop: long, longest: long>>, items array<string>, "
    "nameless boolean")


class Automaton:
    """States of the runs of words in items; ``step`` takes state * words + word to the next state."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW) -> None:
        vocabulary = sorted({w for _, words in items for w in words})
        number = {w: i for i, w in enumerate(vocabulary)}
        self.window, self.words, self.n = window, pa.array(vocabulary, pa.binary()), len(vocabulary)
        self.step: dict[int, int] = {}
        self.link, self.length = [-1], [0]
        leaving: list[list[int]] = [[]]  # words that leave a state
        ends: list[tuple[int, str | None]] = []
        whole: dict[int, set] = {}
        for item, words in items:
            at = 0
            for w in words:
                at = self._extend(at, number[w], leaving)
                if len(words) >= window:
                    ends.append((at, item))
            if 0 < len(words) < window:
                whole.setdefault(at, set()).add((len(words), item))
        self.least = min([window, *(n for held in whole.values() for n, _ in held)])
        self._name(ends, whole)

    def _extend(self, last: int, word: int, leaving: list[list[int]]) -> int:
        """The state of the run at ``last`` and one more word."""
        n, step, link, length = self.n, self.step, self.link, self.length
        known = step.get(last * n + word)
        if known is not None and length[known] == length[last] + 1:
            return known
        made = None
        if known is None:
            made = self._state(length[last] + 1, leaving)
            at = last
            while at != -1 and at * n + word not in step:
                step[at * n + word] = made
                leaving[at].append(word)
                at = link[at]
            if at == -1:
                link[made] = 0
                return made
            last, known = at, step[at * n + word]
            if length[known] == length[last] + 1:
                link[made] = known
                return made
        # the state holds longer runs too, which end elsewhere: the shorter ones get a state of their own
        split = self._state(length[last] + 1, leaving)
        link[split] = link[known]
        for w in leaving[known]:
            step[split * n + w] = step[known * n + w]
        leaving[split] = list(leaving[known])
        while last != -1 and step.get(last * n + word) == known:
            step[last * n + word] = split
            last = link[last]
        link[known] = split
        if made is None:
            return split
        link[made] = split
        return made

    def _state(self, length: int, leaving: list[list[int]]) -> int:
        self.link.append(0)
        self.length.append(length)
        leaving.append([])
        return len(self.link) - 1

    def _name(self, ends: list[tuple[int, str | None]], whole: dict[int, set]) -> None:
        """Which items hold the window that ends in a state (``holders``, under ``top``), and which short items a state ends with."""
        window, link, length = self.window, self.link, self.length
        order = np.argsort(length, kind="stable").tolist()
        top = [-1] * len(link)
        self.short: dict[int, list[tuple[int, str | None]]] = {}
        for v in order[1:]:
            if length[v] >= window:
                top[v] = v if length[link[v]] < window else top[link[v]]
            if held := [*self.short.get(link[v], ()), *whole.get(v, ())]:
                self.short[v] = held
        self.top = np.array(top)
        holders: dict[int, set] = {}
        for v, item in ends:
            if top[v] != -1:
                holders.setdefault(top[v], set()).add(item)
        self.holders = {v: frozenset(held) for v, held in holders.items()}

    def stream(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each word of a run of known words: the length of the longest match that ends there, and its state."""
        step, link, length, n = self.step.get, self.link, self.length, self.n
        state, depth = [0] * len(ids), [0] * len(ids)
        at = size = 0
        for i, word in enumerate(ids.tolist()):
            to = step(at * n + word)
            while to is None:
                at = link[at]
                size = length[at]
                to = step(at * n + word)  # every known word leaves the root
            at, size = to, size + 1
            state[i], depth[i] = at, size
        return np.array(depth), np.array(state)


@dataclass
class Hit:
    """Of one document: words first to end (exclusive) by longest run, and the items."""

    spans: list[tuple[int, int, int]]
    items: set


def hits(auto: Automaton, found: Words) -> dict[int, Hit]:
    """Documents of a batch that have windows."""
    if not auto.n or not len(found.values):
        return {}
    coded = found.values.dictionary_encode()
    which = pc.fill_null(pc.index_in(coded.dictionary, auto.words), -1).to_numpy()
    ids, text = which[coded.indices.to_numpy()], found.text
    known = ids >= 0
    begins = known & np.append(True, ~known[:-1] | (text[1:] != text[:-1]))
    ends = known & np.append(~known[1:] | (text[1:] != text[:-1]), True)
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    out: dict[int, Hit] = {}
    before = np.cumsum(found.per_text) - found.per_text
    for a, z in zip(first.tolist(), last.tolist(), strict=True):
        if z - a < auto.least:
            continue
        depth, state = auto.stream(ids[a:z])
        marks = np.flatnonzero(depth >= auto.window)
        spans = [(int(i) - auto.window + 1, int(i) + 1, int(depth[i])) for i in marks]
        items = {x for v in np.unique(auto.top[state[marks]]).tolist() for x in auto.holders[v]}
        if auto.short:
            for i, (v, d) in enumerate(zip(state.tolist(), depth.tolist(), strict=True)):
                for n, item in auto.short.get(v, ()):
                    if n <= d:
                        spans.append((i - n + 1, i + 1, n))
                        items.add(item)
        if spans:
            t = int(text[a])
            hit = out.setdefault(t, Hit([], set()))
            hit.spans += [(a - int(before[t]) + s, a - int(before[t]) + e, d) for s, e, d in spans]
            hit.items |= items
    for hit in out.values():
        hit.spans = merged(hit.spans)
    return out


def merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that overlap or touch become one, with the longest of their runs."""
    out: list[tuple[int, int, int]] = []
    for a, z, longest in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], z), max(out[-1][2], longest))
        else:
            out.append((a, z, longest))
    return out


def placed(found: Words, text: int, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Spans with their places in the text, in code points: (first, end, start, stop, longest)."""
    if not spans:
        return []
    base = int(found.per_text[:text].sum())
    raw = found.raw[found.origin[text] : found.origin[text + 1]]
    points = np.append(0, np.cumsum((raw & 0xC0) != 0x80))  # code points that begin before a byte
    where = lambda k: int(found.begins[base + k] - found.origin[text])
    return [(a, z, int(points[where(a)]), int(points[where(z - 1) + int(found.sizes[base + z - 1])]), n) for a, z, n in spans]


def blocks(items: DataFrame, window: int, block_words: int) -> Iterator[Automaton]:
    """Automata of all items, block by block; a block's items are brought to the driver, as many words as it may have."""
    held = items.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null")
    # a text has at least a byte of something else between two words
    total = held.agg(F.sum((F.octet_length("text") + 1) / 2)).first()[0] or 0
    n = 1 + int(total // block_words)
    for i in range(n):
        part = held.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).distinct().collect()
        found = words_of(pa.array([r["text"] for r in part], pa.string()))
        words, ends = found.values.to_pylist(), np.cumsum(found.per_text).tolist()
        yield Automaton([(r["item_id"], words[e - k : e]) for r, e, k in zip(part, ends, found.per_text.tolist(), strict=True)], window)


def scan(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, text, n_words, n_hit, n_items, items, spans): of every row the hit words, the identifiers of items by string, and
    spans with words from ``first`` to ``end``, code points from ``start`` to ``stop`` (both exclusive) and their longest run."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text", *(F.lit(None).cast(t).alias(c) for c, t in (("n_words", "long"), ("spans", SCHEMA.split("spans ")[1].split(", items")[0]), ("items",
        "array<string>"), ("nameless", "boolean"))))
    kind = docs.schema["doc_id"].dataType.simpleString()
    for number, auto in enumerate(blocks(items, window, block_words)):
        if number:
            rows = materialize(rows, "hits")  # the pass before is done once, and its automaton is not held with the next
        rows = rows.mapInArrow(_adds(docs.sparkSession.sparkContext.broadcast(auto)), f"doc_id {kind}, text string, {SCHEMA}")
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    named = F.array_sort("items")
    return rows.select("doc_id", "text", "n_words", hit.alias("n_hit"), (F.size("items") + F.col("nameless").cast("int")).cast("long").alias("n_items"),
        named.alias("items"), "spans")


def _adds(shared):
    """A function over batches that adds the hits of one automaton."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = shared.value
        for b in slices(batches):
            found = words_of(b.column("text"))
            new = hits(auto, found)
            spans, names, nameless = ([x or [] for x in b.column("spans").to_pylist()], [x or [] for x in b.column("items").to_pylist()],
                [bool(x) for x in b.column("nameless").to_pylist()])
            for t, hit in new.items():
                every = merged([(s["first"], s["end"], s["longest"]) for s in spans[t]] + hit.spans)
                spans[t] = [dict(zip(("first", "end", "start", "stop", "longest"), s, strict=True)) for s in placed(found, t, every)]
                names[t] = list({*names[t], *(x for x in hit.items if x is not None)})
                nameless[t] = nameless[t] or None in hit.items
            columns = [pa.array(c, t) for c, t in zip((found.per_text, spans, names, nameless), TYPES.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), *columns], ["doc_id", "text", *TYPES])

    return run


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, most_run: int = MOST_RUN, most_share: float = MOST_SHARE,
          block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without what exceeds the limits: spans with a run of more than ``most_run`` words are cut from their text, and rows of
    which more than ``most_share`` of the words are hit are left out."""
    held = docs.select(F.struct(*docs.columns).alias("doc_id"), "text")
    found = scan(held, items, window, block_words).where(F.col("n_hit") <= most_share * F.col("n_words"))
    # from the last span on, so that places before stay right
    cut = F.filter("spans", lambda s: s["longest"] > most_run)
    text = F.aggregate(F.reverse(cut), F.col("text"), lambda t, s: F.concat(F.substring(t, F.lit(1), s["start"].cast("int")), F.substr(t, (s["stop"] + 1).cast("int"))))
    return found.select(*(text.alias("text") if c == "text" else F.col(f"doc_id.{c}").alias(c) for c in docs.columns))
