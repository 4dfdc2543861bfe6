"""op1, op2 and op8 against the tokenizers library itself."""

from __future__ import annotations

import os
import sys
import zlib

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import odd_rows

from corpusloom.llm import packing, queries, token_counts, token_store
from corpusloom.llm.pretokens import load_tokenizer
from corpusloom.workdir import scratch_path

TOKENIZER = load_tokenizer("word_bpe_49k.json")


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def check_pieces(rows, texts, window=4096):
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    seen = {}
    for doc, pieces in by_doc.items():
        want = [ids_of(t) + [2] for i, t in texts if i == doc]
        starts = sorted((p.start, p.length, p.ids_crc32, p.doc_tokens) for p in pieces)
        every = sorted((s, n, crc(ids[s : s + n]), len(ids)) for ids in want for s,
            n in [(p.start, p.length) for p in pieces][: len(pieces) // len(want)] if s < len(ids))
        if len(want) == 1:
            assert starts == every
            assert sum(p.length for p in pieces) == len(want[0])
        else:
            assert sum(p.length for p in pieces) == sum(map(len, want))
        for p in pieces:
            seen.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert sorted(seen) == list(range(len(seen)))
    for k, spans in seen.items():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at == window or k == len(seen) - 1


def test_packing_of_odd_rows(spark):
    texts = [(r[0], r[1]) for r in odd_rows.rows()]
    pieces = packing.pack(odd_rows.docs(spark))
    rows = pieces.collect()
    assert {r.doc_id for r in rows} == {i for i, _ in texts}
    check_pieces(rows, texts)
    seqs = packing.sequences(pieces).collect()
    assert all(len(s.ids) == 4 * s.n_tokens <= 4 * 4096 for s in seqs)
    assert sum(s.n_tokens for s in seqs) == sum(len(ids_of(t)) + 1 for _, t in texts)


def test_packing_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check_pieces(queries.op1_packing(spark, sf).collect(), docs)


def test_counts(spark, sf):
    got = {r.doc_id: r for r in token_counts.count(odd_rows.docs(spark)).collect()}
    for i, t, *_ in odd_rows.rows():
        assert (got[i].n_tokens, got[i].n_bytes) == (len(ids_of(t)), len((t or "").encode())), i
        assert got[i].over_limit == (got[i].n_tokens > 2048)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op2_token_counts(spark, sf).collect():
        assert r.n_tokens == len(ids_of(texts[r.doc_id]))


def test_merging_equals_library_on_repeats():
    counts = token_counts.TokenCounts("word_bpe_49k.json")
    texts = ["a" * n + "!" * (n % 7) for n in range(1, 60)] + ["=" * n for n in range(1, 40)] + ["abab" * n for n in range(1, 20)]
    assert counts.of(texts).tolist() == [len(ids_of(t)) for t in texts]


def test_store_round_trip(spark):
    path = scratch_path(spark, "test-store")
    token_store.write(odd_rows.docs(spark), path)
    got = token_store.read(spark, path).collect()
    rows = sorted(odd_rows.rows(), key=lambda r: (r[0] is not None, r[0] or 0))
    order = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in order] == [r[0] for r in rows]
    start = 0
    for r in order:
        assert r.start == start and r.n_tokens * 4 == len(r.ids)
        start += r.n_tokens
    want = sorted((str(i), crc(ids_of(t) + [1])) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), zlib.crc32(r.ids)) for r in got) == want
    found = token_store.lookup(spark, path, [9, 6, -5, 777]).collect()
    assert sorted(r.doc_id for r in found) == [-5, 6, 6, 9]
    assert np.frombuffer(next(r.ids for r in found if r.doc_id == 9), "<u4").tolist() == ids_of(odd_rows.rows()[9][1]) + [1]


def test_store_query(spark, sf):
    texts = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    start = 0
    for (doc_id, text), r in zip(texts, queries.op8_token_store(spark, sf).orderBy("start").collect(), strict=True):
        want = ids_of(text) + [1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(want), crc(want))
        start += len(want)


def test_lookup_reads_only_shards_that_could_hold_a_key(spark):
    path = scratch_path(spark, "test-store")
    rows = [(k // 3 if k % 7 else None, f"text number {k}") for k in range(3000)]
    token_store.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), path, shard_bytes=2000, block_bytes=500)
    manifest = token_store.Manifest(spark, path)
    assert len(manifest.names) >= 4 and manifest.first == sorted(manifest.first)
    wanted = [5, 700, None, 10_000]
    names = manifest.holding([token_store.key_of(d) for d in wanted[:2]])
    assert 1 <= len(names) < len(manifest.names)
    found = sorted((str(r.doc_id), r.ids) for r in token_store.lookup(spark, path, wanted).collect())
    assert found == sorted((str(d), np.array(ids_of(t) + [1], "<u4").tobytes()) for d, t in rows if d in wanted)
    assert token_store.lookup(spark, path, [10_000]).count() == 0
    assert token_store.read(spark, path).count() == len(rows)


def test_shard_blocks_and_damage():
    w = token_store.ShardWriter(2, 0, 0)
    ids = {k: np.arange(k % 900, dtype="<u2") for k in range(0, 5000, 3)}
    for k, v in ids.items():
        w.add(token_store.key_of(k), v.tobytes())
    data = w.finish()
    shard = token_store.Shard(data)
    assert len(shard.index) > 5 and [token_store.id_of(k) for k, _, _ in shard] == list(ids)
    assert all(np.array_equal(shard.get(k)[0], ids[k]) for k in list(ids)[::97])
    assert not any(shard.get(k) for k in range(1, 5000, 3))
    with pytest.raises(ValueError):
        token_store.Shard(data[:-80] + b"\x00" * 16 + data[-64:])


def test_empty_tables(spark):
    e = odd_rows.empty(spark)
    assert packing.pack(e).count() == 0
    assert token_counts.count(e).count() == 0
    path = scratch_path(spark, "test-store")
    token_store.write(e, path)
    assert token_store.read(spark, path).count() == 0
