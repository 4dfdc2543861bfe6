"""Language of texts by a convolutional network over bytes.

Filters of several widths slide over the lower-cased text's bytes, each filter's largest answer in a
window is kept, and a softmax over these gives the languages' odds.  The network is trained here in
numpy on windows of labelled texts: a bounded sample, ``PER_LANGUAGE`` of each language in expectation,
drawn by a hash.  Applied, the filters are tables: a filter's answer at a place is a sum of rows looked
up by single bytes and pairs of bytes.  A text is cut into windows of fixed length that cover all of it;
its odds are the mean over the windows.

A text that is null or has no letter gets ``und`` with score 0, an empty one too.  Very long texts are
predicted from all their windows, some hundred at a time.  Ties go to the language first in code-point
order.  Repeated rows get equal answers.  With no labelled row every text is ``und``.  Columns lang, source
and doc_id never enter a prediction; other columns stay out of the way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.arrow_rows import batch, slices, small_batches

UNDETERMINED = "und"
#: Letters, and numerals such as halves and Roman ones, which are none.
WORDLIKE = re.compile(r"[^\W\d_]")
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS, EMBEDDED = 16, 8
#: Labelled windows of each language that training takes, in expectation; no more than twice that in all.
PER_LANGUAGE = 800
EPOCHS, LEAST_STEPS, BATCH, RATE = 14, 600, 64, 4e-3
#: Windows whose filter answers are held at a time.
WINDOWS_AT_A_TIME = 512


@dataclass
class Network:
    languages: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    pairs: list[tuple] = field(default_factory=list)

    def tables(self) -> None:
        """Filters as look-up tables: (pair table, or second pair or single table)."""
        self.pairs = []
        for w, f in zip(WIDTHS, self.filters, strict=True):
            single = [self.embed @ f[j * EMBEDDED : (j + 1) * EMBEDDED] for j in range(w)]
            pair = [(single[j][:, None] + single[j + 1][None]).reshape(65536, -1).astype(np.float32) for j in range(0, w - 1, 2)]
            self.pairs.append((pair, single[-1].astype(np.float32) if w % 2 else None))

    def odds(self, windows: np.ndarray) -> np.ndarray:
        """Softmax odds of (n, WINDOW) bytes."""
        out = np.empty((len(windows), len(self.languages)), np.float64)
        for at in range(0, len(windows), WINDOWS_AT_A_TIME):
            b = windows[at : at + WINDOWS_AT_A_TIME].astype(np.int32)
            two = (b[:, :-1] << 8) | b[:, 1:]
            pooled = []
            for w, (pair, last) in zip(WIDTHS, self.pairs, strict=True):
                n = WINDOW - w + 1
                answer = pair[0].take(two[:, :n], axis=0)
                for k, table in enumerate(pair[1:], 1):
                    answer += table.take(two[:, 2 * k : 2 * k + n], axis=0)
                if last is not None:
                    answer += last.take(b[:, w - 1 : w - 1 + n], axis=0)
                pooled.append(answer.max(axis=1))
            hidden = np.maximum(np.concatenate(pooled, axis=1) + self.bias, 0)
            out[at : at + len(b)] = softmax(hidden @ self.out + self.out_bias)
        return out


def has_letter(text: str) -> bool:
    """Whether a character of the text is a letter of any script."""
    return any(m[0].isalpha() for m in WORDLIKE.finditer(text))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def windows_of(text: str) -> np.ndarray:
    """(n, WINDOW) bytes that cover a text: the last window ends with it; a short text is padded with 0."""
    raw = np.frombuffer(text.lower().encode(), np.uint8)
    if len(raw) <= WINDOW:
        out = np.zeros((1, WINDOW), np.uint8)
        out[0, : len(raw)] = raw
        return out
    whole = raw[: len(raw) // WINDOW * WINDOW].reshape(-1, WINDOW)
    return whole if len(raw) % WINDOW == 0 else np.concatenate([whole, raw[None, -WINDOW:]])


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], seed: int = 1) -> Network:
    """Adam on cross-entropy; the gradient of a pooled filter goes to the place of its largest answer."""
    rng = np.random.Generator(np.random.PCG64(seed))
    n_hidden = FILTERS * len(WIDTHS)
    params = [rng.normal(0, 0.3, (256, EMBEDDED)), *(rng.normal(0, 1 / np.sqrt(w * EMBEDDED), (w * EMBEDDED, FILTERS)) for w in WIDTHS),
        np.zeros(n_hidden), rng.normal(0, 0.2, (n_hidden, len(languages))), np.zeros(len(languages))]
    params = [p.astype(np.float32) for p in params]
    params[0][0] = 0  # padding
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(max(EPOCHS, -(-LEAST_STEPS * BATCH // len(windows)))):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), BATCH):
            take = order[at : at + BATCH]
            grads = gradients(params, windows[take], labels[take])
            step += 1
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            params[0][0] = 0
    net = Network(languages, params[0], params[1 : 1 + len(WIDTHS)], *params[1 + len(WIDTHS) :])
    net.tables()
    return net


def gradients(params: list[np.ndarray], b: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
    embed, filters, (bias, out, out_bias) = params[0], params[1 : 1 + len(WIDTHS)], params[1 + len(WIDTHS) :]
    held = embed[b]
    rows = np.arange(len(b))[:, None]
    pooled, places = [], []
    for w, f in zip(WIDTHS, filters, strict=True):
        n = b.shape[1] - w + 1
        answer = sum(held[:, j : j + n] @ f[j * EMBEDDED : (j + 1) * EMBEDDED] for j in range(w))
        place = answer.argmax(axis=1)
        pooled.append(np.take_along_axis(answer, place[:, None], 1)[:, 0])
        places.append(place)
    raw = np.concatenate(pooled, axis=1) + bias
    hidden = np.maximum(raw, 0)
    odds = softmax(hidden @ out + out_bias)
    odds[np.arange(len(b)), labels] -= 1
    odds /= len(b)
    back = (odds @ out.T) * (raw > 0)
    d_embed, d_filters = np.zeros_like(embed), []
    for k, (w, f) in enumerate(zip(WIDTHS, filters, strict=True)):
        g = back[:, k * FILTERS : (k + 1) * FILTERS]
        df = np.zeros_like(f)
        for j in range(w):
            at = b[rows, places[k] + j]
            part = slice(j * EMBEDDED, (j + 1) * EMBEDDED)
            df[part] = np.einsum("nfe,nf->ef", embed[at], g)
            np.add.at(d_embed, at, g[:, :, None] * f[part].T[None])
        d_filters.append(df)
    return [d_embed, *d_filters, back.sum(0), hidden.T @ odds, odds.sum(0)]


def held_out(fold: int = 4, rest: int = 2) -> Column:
    """Rows that training never sees."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold == rest, F.lit(False))


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE, seed: int = 1) -> Network | None:
    """Train on one window of each labelled row that a hash draws; None if there is none.

    Counts by language cover all rows; what reaches the driver is bounded by the sample.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("doc_id", "lang", "text")
    counts = {r[0]: r[1] for r in usable.groupBy("lang").count().collect()}
    if not counts:
        return None
    chance = F.create_map(*(x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, per_language / n)))))
    drawn = usable.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) < F.element_at(chance, F.col("lang")) * (1 << 30))
    start = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.greatest(F.lit(1), F.length("text") - WINDOW + 1)).cast("int") + 1
    sample = drawn.select("doc_id", "lang", F.substring("text", start, F.lit(WINDOW)).alias("text")).limit(2 * per_language * len(counts)).collect()
    sample = sorted((r for r in sample if has_letter(r["text"])), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"]))
    if not sample:
        return None
    languages = sorted({r["lang"] for r in sample}, key=lambda s: s.encode())
    number = {lang: k for k, lang in enumerate(languages)}
    return train(np.concatenate([windows_of(r["text"])[:1] for r in sample]), np.array([number[r["lang"]] for r in sample]), languages, seed)


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """``docs`` with lang_pred and score after its columns; existing columns of these names are replaced."""
    small_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    kept = docs.columns
    if net:
        net.pairs = []  # the tables are rebuilt where they are used; they would outweigh the network

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if net:
            net.tables()
        for b in slices(batches):
            texts = b.column("text").to_pylist()
            langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            for i, mean in means(net, texts):
                best = int(mean.argmax())
                langs[i], scores[i] = net.languages[best], float(mean[best])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(langs), pa.array(scores)], [*kept, "lang_pred", "score"])

    schema = docs.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema
    return docs.mapInArrow(run, schema)


def means(net: Network | None, texts: list[str | None], most: int = 4096) -> Iterator[tuple[int, np.ndarray]]:
    """(index, mean odds) of each text that has a letter; windows of several texts go together."""
    held: list[tuple[int, np.ndarray]] = []
    size = 0
    for i, text in [*enumerate(texts), (-1, None)]:
        if net and text and has_letter(text):
            held.append((i, windows_of(text)))
            size += len(held[-1][1])
        if held and (i < 0 or size >= most):
            odds = net.odds(np.concatenate([w for _, w in held]))
            at = 0
            for k, w in held:
                yield k, odds[at : at + len(w)].mean(axis=0)
                at += len(w)
            held, size = [], 0
