"""Toxicity by gradient-boosted trees over dense features of a text, calibrated by isotonic regression.

The features are densities of a lexicon (words and word beginnings that labelled toxic texts hold far
more often than others, found here), how many hits stand near a second person, rates of capitals,
punctuation and repeated letters, and of obfuscated words and the lexicon hits among them.  The trees
are grown here in numpy over histograms of a bounded sample of labelled rows (``SAMPLE``: so many toxic
ones, twice as many others, in expectation; texts over ``SAMPLE_CHARS`` stay out of it).  Features of the
sample come from a lexicon of the other half, and the calibration from trees of the other half, so
neither sees its own rows.

Applied, every whole text is scored.  Null and empty texts have features of zero and get the score of
these; so has a text without words.  Without labels of both kinds every score is the share of toxic ones
(0 if there are no labels).  Repeated rows get equal scores; contradicting labels of an identifier count
as toxic.  Labels, lang, source and doc_id never enter a score; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.arrow_rows import batch, slices, small_batches

SAMPLE, SAMPLE_CHARS = 1500, 20_000
THRESHOLD = 0.7
#: A lexicon term is in so many toxic sample texts at least and in this share of them, with this log odds
#: ratio against others; copies of one text would else make its rare words terms.
LEAST_TEXTS, LEAST_SHARE, LEAST_ODDS = 3, 0.006, 2.5
#: Word beginnings of these lengths are terms too, so that inflected forms count.
STEMS = (4, 5, 6)
NEAR = 5
TREES, DEPTH, RATE, BINS, L2 = 60, 3, 0.15, 32, 1.0

WORD = re.compile(r"[^\W\d_]+")
#: A letter, then digits or signs that may stand for letters, then a letter.
MASKED = re.compile(r"[^\W\d_][0-9@$!*+.|_-]+[^\W\d_]")
#: Words whose weights a worker keeps; beyond it the store starts anew.  It bounds memory, not results.
KEPT_WORDS = 400_000
# What signs stand for, and pronouns of the second person.
STANDS_FOR = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"})
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre tú ti tus usted ustedes vosotros".split())
FEATURES = ("density", "hits", "strongest", "weight", "weight_density", "near_you", "near_you_share", "you", "capitals", "exclamations", "marks",
    "repeated", "masked", "masked_hits", "length")


def terms(words: Iterable[str]) -> set[str]:
    """Words and their beginnings; a beginning ends with a hyphen, so it isn't taken for a word."""
    distinct = set(words)
    return distinct.union(*({f"{w[:n]}-" for w in distinct if len(w) >= n} for n in STEMS))


def learn_lexicon(texts: list[str], toxic: np.ndarray) -> dict[str, float]:
    """Terms with their log odds ratio; terms of few toxic texts stay out."""
    held = Counter(t for text, y in zip(texts, toxic, strict=True) if y for t in terms(WORD.findall(text.lower())))
    least = max(LEAST_TEXTS, LEAST_SHARE * toxic.sum())
    held = {t: n for t, n in held.items() if n >= least}
    other = Counter(t for text, y in zip(texts, toxic, strict=True) if not y for t in terms(WORD.findall(text.lower())) if t in held)
    n_toxic, n_other = int(toxic.sum()), int(len(toxic) - toxic.sum())
    odds = {t: math.log((n + 0.5) / (n_toxic + 1)) - math.log((other[t] + 0.5) / (n_other + 1)) for t, n in held.items()}
    return {t: w for t, w in odds.items() if w >= LEAST_ODDS}


def kinds_of_characters() -> np.ndarray:
    """For each UTF-16 unit: 1 for a capital, 2 for a mark, 4 for a letter; astral characters count as one mark."""
    out = np.zeros(65536, np.uint8)
    for c in range(65536):
        ch = chr(c)
        if ch.isalpha():
            out[c] = 4 + ch.isupper()
        elif 0xD800 <= c < 0xDC00 or not (ch.isalnum() or ch.isspace() or ch == "_" or 0xDC00 <= c < 0xE000):
            out[c] = 2
    return out


def rates(text: str, low: str, kinds: np.ndarray) -> tuple[int, int, int]:
    """How many capitals, marks and letters that follow two of their kind."""
    kind = kinds[np.frombuffer(text.encode("utf-16-le"), np.uint16)]
    small = np.frombuffer(low.encode("utf-16-le"), np.uint16)
    same = small[1:] == small[:-1]
    tripled = np.flatnonzero(same[1:] & same[:-1]) if len(small) > 2 else np.empty(0, np.int64)
    return int((kind & 1).sum()), int((kind == 2).sum()), int((kinds[small[tripled]] >= 4).sum())


class Lexicon:
    def __init__(self, weights: dict[str, float]) -> None:
        self.words = {t: w for t, w in weights.items() if not t.endswith("-")}
        self.stems = {n: {t[:-1]: w for t, w in weights.items() if t.endswith("-") and len(t) == n + 1} for n in STEMS}
        self.kinds = kinds_of_characters()
        self.kept: dict[str, float] = {}

    def weight(self, word: str) -> float:
        found = self.kept.get(word)
        if found is None:
            found = max(self.words.get(word, 0.0), *(self.stems[n].get(word[:n], 0.0) if len(word) >= n else 0.0 for n in STEMS))
            self.kept[word] = found
        return found

    def features(self, text: str | None) -> list[float]:
        if not text:
            return [0.0] * len(FEATURES)
        if len(self.kept) > KEPT_WORDS:
            self.kept.clear()
        low = text.lower()
        words = WORD.findall(low)
        n = len(words)
        if not n:
            return [0.0] * len(FEATURES)
        weights = [x for x in map(self.weight, words) if x]
        near = you = 0
        distinct = SECOND_PERSON.intersection(words)
        if distinct:
            you = sum(words.count(w) for w in distinct)
            if weights:
                at = [i for i, w in enumerate(words) if self.kept[w]]
                near = sum(not distinct.isdisjoint(words[max(0, i - NEAR) : i + NEAR + 1]) for i in at)
        masked = [t for t in low.split() if not t.isalpha() and MASKED.search(t)]
        undone = ["".join(WORD.findall(t.translate(STANDS_FOR))) for t in masked]
        capitals, marks, repeated = rates(text, low, self.kinds)
        chars, hits = len(text), len(weights)
        return [
            100 * hits / n, math.log1p(hits), max(weights, default=0.0), math.log1p(sum(weights)), 100 * sum(weights) / n,
            math.log1p(near), near / hits if hits else 0.0, 100 * you / n,
            capitals / chars, 100 * text.count("!") / chars, 100 * marks / chars,
            100 * repeated / n, 100 * len(masked) / n, float(sum(self.weight(w) > 0 for w in undone)), math.log1p(n),
        ]


@dataclass
class Boosted:
    """Trees as arrays: per level-order node a feature and a threshold, per leaf a value."""

    base: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - (2**DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray) -> Boosted:
    """Second-order boosting of the logistic loss over quantile histograms."""
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    model = Boosted(math.log(share / (1 - share)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    score = np.full(len(x), model.base)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        feature, threshold = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf)
        node = np.zeros(len(x), np.int64)
        for depth in range(DEPTH):
            first, width = 2**depth - 1, 2**depth
            best = np.full(width, 1e-9)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                place = (node - first) * (BINS + 1) + binned[:, j]
                gs, hs = (np.bincount(place, weights=v, minlength=width * (BINS + 1)).reshape(width, -1) for v in (g, h))
                gl, hl = gs.cumsum(1)[:, : len(e)], hs.cumsum(1)[:, : len(e)]
                gt, ht = gs.sum(1, keepdims=True), hs.sum(1, keepdims=True)
                gain = gl**2 / (hl + L2) + (gt - gl) ** 2 / (ht - hl + L2) - gt**2 / (ht + L2)
                top = gain.argmax(1)
                for k in np.flatnonzero(gain[np.arange(width), top] > best):
                    best[k], feature[first + k], threshold[first + k] = gain[k, top[k]], j, e[top[k]]
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > threshold[node])
        leaf = node - (2**DEPTH - 1)
        value = -RATE * np.bincount(leaf, weights=g, minlength=2**DEPTH) / (np.bincount(leaf, weights=h, minlength=2**DEPTH) + L2)
        model.trees.append((feature, threshold, value))
        score += value[leaf]
    return model


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of y over raw, by pooling adjacent violators; two rows of each kind are
    added at the ends of their side, so that no score is certain."""
    order = np.argsort(raw, kind="stable")
    pools: list[list[float]] = []
    for x, t in zip(raw[order], y[order].astype(float), strict=True):
        pools.append([t, 1.0, x, x])
        while len(pools) > 1 and (pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1] or pools[-2][3] == pools[-1][2]):
            last = pools.pop()
            pools[-1] = [pools[-1][0] + last[0], pools[-1][1] + last[1], pools[-1][2], last[3]]
    xs = np.array([v for p in pools for v in (p[2], p[3])])
    ys = np.array([v for p in pools for v in [(p[0] + 0.02) / (p[1] + 0.04)] * 2])
    return xs, np.maximum.accumulate(ys)


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: Boosted | None
    knots: tuple[np.ndarray, np.ndarray]
    share: float

    def scores(self, lexicon: Lexicon, texts: list[str | None]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.share)
        x = np.array([lexicon.features(t) for t in texts]).reshape(-1, len(FEATURES))
        return np.interp(self.trees.raw(x), *self.knots)


def fit(texts: list[str], toxic: np.ndarray) -> Model:
    share = float(toxic.mean()) if len(toxic) else 0.0
    if not 0 < toxic.sum() < len(toxic) or min(toxic.sum(), len(toxic) - toxic.sum()) < 4:
        return Model({}, None, (np.zeros(1), np.zeros(1)), share)
    # halves with as many toxic texts each
    half = np.empty(len(toxic), np.int64)
    for y in (0, 1):
        half[toxic == y] = np.arange(int((toxic == y).sum())) % 2
    x = np.empty((len(texts), len(FEATURES)))
    for k in (0, 1):
        rest = np.flatnonzero(half != k)
        lexicon = Lexicon(learn_lexicon([texts[i] for i in rest], toxic[rest]))
        for i in np.flatnonzero(half == k):
            x[i] = lexicon.features(texts[i])
    raw = np.empty(len(texts))
    for k in (0, 1):
        raw[half == k] = boost(x[half != k], toxic[half != k]).raw(x[half == k])
    return Model(learn_lexicon(texts, toxic), boost(x, toxic), isotonic(raw, toxic), share)


def held_out(fold: int = 3, rest: int = 1) -> Column:
    """Rows whose labels training never sees."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold == rest, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 7) -> Model:
    """Fit on a sample that a hash draws from all labelled rows; class counts cover all labels."""
    usable = labels.where(F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r[0]: r[1] for r in usable.groupBy("toxic").count().collect()}
    chance = F.when(F.col("toxic") == 1, min(1.0, sample / max(1, counts.get(1, 0)))).otherwise(min(1.0, 2 * sample / max(1, counts.get(0, 0))))
    drawn = usable.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) < chance * (1 << 30)).limit(4 * sample)
    # at most 4 * sample rows of two numbers
    rows = docs.where(F.length("text") <= SAMPLE_CHARS).select("doc_id", "text").join(F.broadcast(drawn), "doc_id").limit(4 * sample).collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["text"]))
    return fit([r["text"] for r in rows], np.array([int(r["toxic"] == 1) for r in rows], np.int64))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) of every row."""
    small_batches(docs.sparkSession)
    types = {"doc_id": pa.int64(), "score": pa.float64(), "predicted": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(model.lexicon)
        for b in slices(batches):
            s = np.clip(model.scores(lexicon, b.column("text").to_pylist()), 0, 1)
            yield batch({"doc_id": b.column("doc_id"), "score": s, "predicted": (s >= threshold).astype(np.int32)}, types)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")
