"""op11, op12 and op13 against plain Python, on odd rows too."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import sys
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import compare
import odd_rows

from corpusloom.llm import alignment, block_search, decontamination, queries
from corpusloom.llm.pretokens import load_tokenizer, tokenizer_file
from corpusloom.llm.words import words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, lang string"


def terms(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def test_words_of_odd_texts():
    texts = [r[1] for r in odd_rows.rows()] + ["ab", "cd", "É!ß", "\U0001f600x"]
    for column in (pa.array(texts), pa.array(["zz", *texts], pa.large_string()).slice(1)):
        found = words_of(column)
        assert [w.decode() for w in found.values.to_pylist()] == [t for x in texts for t in terms(x)]
        assert found.per_text.tolist() == [len(terms(x)) for x in texts]
    assert not len(words_of(pa.array([], pa.string())).values)


def ranked(docs, items, k=20):
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    total, df = sum(sum(c.values()) for _, c in held), Counter(t for _, c in held for t in c)
    out = []
    for item, text in dict.fromkeys((i, t) for i, t in items if t is not None):
        found = []
        for doc, c in held:
            m = 75 + 25 * sum(c.values()) * len(held) // total
            score = sum(math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if score:
                found.append((-score, doc is None, doc or 0))
        out += [(item, n, None if none else doc, -score) for n, (score, none, doc) in enumerate(sorted(found)[:k], 1)]
    return sorted(map(str, out))


def words(rng, n):
    return " ".join(f"w{min(int(rng.paretovariate(0.5)), 400)}" for _ in range(n))


def test_ranked_search(spark):
    docs = [(r[0], r[1]) for r in odd_rows.rows()]
    items = [(0, "The QUICK brown the fox!", "x"), (1, None, "x"), (2, "", None), (3, "nowhere", "x"), (4, "e ß é angry BEARS woods", "x"), (0, "lazy dog bear", "x"), (0, "lazy dog bear", "x"),
        (None, "two words", "x")]
    got = block_search.search(block_search.build(odd_rows.docs(spark)), spark.createDataFrame(items, ITEMS))
    assert sorted(str(tuple(r)) for r in got.collect()) == ranked(docs, [i[:2] for i in items])
    assert got.columns == ["item_id", "rank", "doc_id", "score"]


@pytest.mark.parametrize(("block", "shard"), [(64, 2_000_000), (4, 3000)])
def test_ranked_search_over_many_blocks_and_shards(spark, monkeypatch, block, shard):
    monkeypatch.setattr(block_search, "BLOCK", block)
    rng = random.Random(5)
    docs = [(i // 2, words(rng, rng.randrange(40))) for i in range(2500)]
    items = [(i, words(rng, rng.randrange(1, 25)), None) for i in range(30)]
    index = block_search.build(spark.createDataFrame(docs, "doc_id long, text string").repartition(2), shard)
    got = block_search.search(index, spark.createDataFrame(items, ITEMS), 7, pass_bytes=500)
    assert sorted(str(tuple(r)) for r in got.collect()) == ranked(docs, [i[:2] for i in items], 7)


def test_blocks_below_the_threshold_stay_closed():
    docs = [f"common word{i % 50}" + (" rare" if i == 7777 else "") + " common" * (i % 3000 == 5) * 9 for i in range(9000)]
    filled = block_search.Gathered(9000, sum(len(d.split()) for d in docs))
    filled.add(pa.array(range(9000)), pa.array(docs))
    shard = block_search.Shard(pa.Table.from_batches(list(filled.rows(0))))
    best = block_search.Best(3)
    shard.search([(b"common", 10)], best)
    assert best.doc.tolist() == [5, 3005, 6005] and len(shard.opened) < 100
    shard.opened.clear()
    best = block_search.Best(1)
    shard.search([(b"common", 10)], best)
    assert best.doc.tolist() == [5]
    a, z = shard.spans[b"common"]
    assert z - a == 141 and len(shard.opened) < 60
    shard.opened.clear()
    best = block_search.Best(1)
    shard.search([(b"common", 10), (b"rare", 5000)], best)
    assert best.doc.tolist() == [7777] and len(shard.opened) < 60


def test_blocks_round_trip():
    rng = np.random.default_rng(3)
    gaps, tf = rng.integers(0, [5, 300, 70_000] * 100), rng.integers(1, [9, 90_000, 600] * 100)
    head = np.sort(rng.choice(np.arange(1, 300), 20, replace=False))
    head[0] = 0
    body, ends = block_search.pack(head, np.where(np.isin(np.arange(300), head), 0, gaps), tf)
    for k, (a, z) in enumerate(zip(head, [*head[1:], 300], strict=True)):
        docs, n = block_search.unpack(3, z - a, body[ends[k] : ends[k + 1]].tobytes())
        assert docs.tolist() == (3 + np.append(0, np.cumsum(gaps[a + 1 : z]))).tolist() and n.tolist() == tf[a:z].tolist()


def leaks(docs, items, window=10):
    held = defaultdict(set)
    for item, text in items:
        t = terms(text)
        for i in range(len(t) - min(window, len(t)) + 1 if t else 0):
            held[tuple(t[i : i + window])].add(item)
    out = []
    for doc, text in docs:
        t, hit, found = terms(text), set(), set()
        for n in {len(g) for g in held}:
            for i in range(len(t) - n + 1):
                if g := held.get(tuple(t[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= g
        out.append((doc, len(t), len(hit), len(found), sorted(str(x) for x in found if x is not None)))
    return sorted(map(str, out))


@pytest.mark.parametrize("block_words", [200_000, 40])
def test_decontamination(spark, block_words):
    rng = random.Random(block_words)
    some = lambda n: " ".join(rng.choice("abc") for _ in range(n))  # noqa: E731  few words, so that runs overlap
    items = [(i, some(rng.choice([3, 9, 10, 11, 12, 30])), None) for i in range(25)] + [(7, some(14), "x"), (None, some(12), "x"), (2, "", "x"), (3, None, "x"), (4, "é ß", "x"), (4, "é ß", "x")]
    docs = [(i, some(rng.randrange(90)) + rng.choice([" É", " q ", ""]) + some(20) + " é, ß.") for i in range(60)] + [(i[0], i[1]) for i in odd_rows.rows()]
    table = spark.createDataFrame([(*d, "x", "y") for d in docs], "doc_id long, text string, items string, spans string").repartition(3)
    got = decontamination.scan(table, spark.createDataFrame(items, ITEMS), block_words=block_words).collect()
    assert sorted(str((r.doc_id, r.n_words, r.n_hit, r.n_items, r["items"] or [])) for r in got) == leaks(docs, [i[:2] for i in items])
    for r in got:
        for s in r.spans or []:
            assert terms(r.text[s.start : s.stop]) == terms(r.text)[s.first : s.end]
            assert s.longest <= s.end - s.first


def test_no_items_hit_nothing(spark):
    got = decontamination.scan(odd_rows.docs(spark), spark.createDataFrame([], ITEMS)).collect()
    assert len(got) == len(odd_rows.rows()) and not any(r.n_hit or r.n_items for r in got)


def test_longest_matches_by_brute_force():
    rng = random.Random(11)
    items = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(1, 30))] for _ in range(12)]
    auto = decontamination.Automaton([(str(i), w) for i, w in enumerate(items)], 5)
    runs = {tuple(w[i:j]) for w in items for i in range(len(w)) for j in range(i + 1, len(w) + 1)}
    text = [rng.choice([b"a", b"b", b"c"]) for _ in range(400)]
    depth, _ = auto.stream(np.array([auto.words.to_pylist().index(w) for w in text]))
    for i, d in enumerate(depth.tolist()):
        assert tuple(text[i - d + 1 : i + 1]) in runs and (d == i + 1 or tuple(text[i - d : i + 1]) not in runs)
    assert len(auto.link) <= 2 * sum(map(len, items))


def test_cleaning_cuts_long_spans_and_drops_covered_rows(spark):
    item = " ".join(f"t{i}" for i in range(20))
    docs = [(1, "é before " + item + " after", "k"), (2, item + " x", "k"), (3, "before t1 t2 t3 t4 t5 t6 t7 t8 t9 t10 t11 " + "z " * 30, "k"), (4, None, "k"), (5, "clean", None), (5, "clean", None)]
    rows = spark.createDataFrame([(i, (t or "") + " y" * 40 if i == 1 else t, k) for i, t, k in docs], "doc_id long, text string, spans string")
    got = decontamination.clean(rows, spark.createDataFrame([(1, item, "x")], ITEMS))
    assert got.columns == rows.columns
    assert sorted((r.doc_id, r.text, r.spans) for r in got.collect() if r.text and r.spans) == [(1, "é before  after" + " y" * 40, "k"), (3, docs[2][1], "k")]
    assert sorted(str((r.doc_id, r.text)) for r in got.collect()) == sorted(str(x) for x in [(1, "é before  after" + " y" * 40), (3, docs[2][1]), (4, None), (5, "clean"), (5, "clean")])


def aligned(rows):
    a, b = load_tokenizer(alignment.A), alignment.Pieces(alignment.B).model
    a.encode_special_tokens = True
    alphabet = {c: x for x, c in alignment.TokenIds.byte_alphabet().items()}
    docs, counts, best = [], Counter(), defaultdict(int)
    for doc, text in rows:
        x = [(i, bytes(alphabet[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids] if text else []
        y = [(i, bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)] if text else []
        want = b" " + (text or "").encode()
        if b"".join(t for _, t in x) != want or b"".join(t for _, t in y) != want:
            x, y = [], []
        of_byte = [[i for i, t in side for _ in t] for side in (x, y)]
        starts = [[k for k, (_, t) in enumerate(side) for _ in t] for side in (x, y)]
        links = [pair for _, pair in sorted({(s, e): p for s, e, p in zip(*starts, zip(*of_byte, strict=True), strict=True)}.items())]
        both = sorted(set(np.cumsum([len(t) for _, t in x])) & set(np.cumsum([len(t) for _, t in y])))
        groups, last = [], 0
        for end in map(int, both):
            groups.append("|".join(",".join(str(side[k][0]) for k in dict.fromkeys(at[last:end])) for side, at in zip((x, y), starts, strict=True)))
            last = end
        counts.update(set(links))
        docs.append((doc, len(x), len(y), len(both), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if x else ""))
    for (i, _), n in counts.items():
        best[i] = max(best[i], n)
    return sorted(str((doc, n, m, g, len(links), digest, sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links))) for doc, n, m, g, links, digest in docs), counts


@pytest.mark.parametrize("shard_pairs", [1 << 20, 50])
def test_alignment(spark, monkeypatch, shard_pairs):
    monkeypatch.setattr(alignment, "HELD_KEYS", 300)
    rows = [(r[0], r[1]) for r in odd_rows.rows() if len(r[1] or "") < 50_000] + [(90, "<|endoftext|><s></s><unk> x"), (91, "▁ a"), (92, "a  b   c\n\n\n"), (93, "naïve ﬁ 　 ퟿")]
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, keys string, n_best string").repartition(3)
    want, counts = aligned(rows)
    assert sorted(str(tuple(r)) for r in alignment.align(table, shard_pairs=shard_pairs).collect()) == want
    assert {(r.a_id, r.b_id): r.n_documents for r in alignment.pairs(table).collect()} == counts


def test_fast_encoder_is_the_library():
    side = alignment.ByteLevel(alignment.A)
    assert side.fast is not None
    texts = [" " + (r[1] or "") for r in odd_rows.rows()] + [" " * 50_000 + "x", " " + "!" * 30_000, "x" * 30_000 + "\n" * 30_000, "'s 'LL\t\t x\r\n 12345é中"]
    assert side.encode(texts) == [side.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert os.path.exists(tokenizer_file(alignment.B))


def test_empty_tables(spark):
    empty = odd_rows.empty(spark)
    items = spark.createDataFrame([(1, "a b", None)], ITEMS)
    assert block_search.search(block_search.build(empty), items).count() == 0
    assert block_search.search(block_search.build(odd_rows.docs(spark)), items.where("false")).count() == 0
    assert decontamination.scan(empty, items).count() == 0
    assert decontamination.clean(empty, items).count() == 0
    assert alignment.align(empty).count() == 0


@pytest.mark.parametrize("name", ["op11_ranked_search", "op12_decontamination"])
def test_queries(spark, sf, name):
    assert compare.differences(queries.queries()[name](spark, sf), compare.connect(sf), queries.oracle_sql()[name]) == ""


def test_alignment_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(str(tuple(r)) for r in queries.op13_alignment(spark, sf).collect()) == aligned(rows)[0]
