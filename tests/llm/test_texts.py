"""op4, op5, op7, op9, op10 and the pipeline on odd rows, against plain Python, and on held-out labels."""

from __future__ import annotations

import hashlib
import os
import re
import sys
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import odd_rows
import test_pairs

import corpus_pipeline
from corpusloom.llm import language_id, mixing, ngram_join, quality_rules, queries, secret_scan, toxicity
from corpusloom.llm.pretokens import load_tokenizer

MID = "/root/testdata/sf0.01"


def base_of(text):
    """The fixed kinds, written anew: keyword, separators and value by hand."""
    text = text or ""
    out = []
    for m in re.finditer(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[1]) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def digest(spans):
    return hashlib.sha256(",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()


def test_secret_query(spark, sf, tmp_path):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{MID}/documents.parquet").collect()]
    rows += [(10_000, "TOKEN: 'abcdefgh' secret: pw passwd=apikey:longvalue1 api-key=12345678 ſecret=abcdefghij AKIA1 AKIA2345678901234 é password= 'x.y/z+1=2-3_4'", "s"), (10_001, None, None), (10_002, "a" * 20 + "0123456789abcdef" * 3, "s")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op4_secret_scan(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        want = base_of(t)
        assert got[i].base_sha256 == digest(want), i
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == n for _, k, _ in want) for n in range(3))
        spans = got[i].spans.split(",") if got[i].spans else []
        assert all(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" in spans for s, k, e in want)


def test_ownership_tells_examples_from_owned(spark):
    copied, owned = "Zx9Qw8Er7Ty6Ui5Op4As3D", "Mn1Bv2Cx3Zl4Kj5Hg6Fd7S"
    rows = [(i, f"see{i} {copied} here", "en", f"org{i}/repo", 1) for i in range(4)] + [(10 + i, f"my {owned} value", "en", f"me/repo{i}",
        1) for i in range(3)]
    got = {r.doc_id: r for r in secret_scan.scan(spark.createDataFrame(rows, odd_rows.SCHEMA)).collect()}
    assert all(not got[i].added and got[i].n_examples == 1 for i in range(4))
    assert all([(s.start, s.end) for s in got[10 + i].added] == [(3, 3 + len(owned))] and got[10 + i].n_examples == 0 for i in range(3))
    clean = {r.doc_id: r.text for r in secret_scan.redact(spark.createDataFrame(rows, odd_rows.SCHEMA)).collect()}
    assert clean[10] == "my [SECRET] value" and clean[0] == rows[0][1]


@pytest.mark.parametrize("places", [2, 9])
def test_copies_of_a_document_keep_its_credential(spark, places):
    rows = [(i, "here is my Mn1Bv2Cx3Zl4Kj5Hg6Fd7S value of a service that is live" + " again" * i, "en", f"src{i}", 1) for i in range(places)]
    got = secret_scan.scan(spark.createDataFrame(rows, odd_rows.SCHEMA)).collect()
    assert all(len(r.added) == 1 and r.n_examples == 0 for r in got)


def test_random_keys_are_candidates():
    rng = np.random.default_rng(3)
    for signs, n in [("0123456789abcdef", 20), ("0123456789abcdef", 31), ("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 20),
        ("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 40)]:
        keys = ["".join(rng.choice(list(signs), n)) for _ in range(1000)]
        assert np.mean([len(secret_scan.candidates(f"a {k} b", [])) == 1 for k in keys]) >= 0.98, (signs, n)
    path = "/".join(["example", "documents", "archive"] * 4)
    key = "Mn1Bv2Cx3Zl4Kj5Hg6Fd7S"
    assert secret_scan.candidates(f"{path}/{key}", []) == [(len(path) + 1, len(path) + 1 + len(key))]
    late = "abcdefghijKLMNOPQRSTuvwxyzabcdefghijKLMNOPQRSTuvwxyzABCDEFGHIJklmnop7Qr8St9"
    assert len(secret_scan.candidates(f"see {late} there", [])) == 1  # its first digit is far in
    assert not secret_scan.candidates("internationalization " + path + " InternationalizationSupportModule " + "=" * 40 + "a1" + "-" * 40, [])


@pytest.mark.parametrize("pasted", [False, True])
def test_pasted_snippets_are_examples_and_copied_documents_are_not(spark, pasted):
    """One key under 50 owners: in a snippet with its surroundings that stands in 50 documents, or in one document that was copied."""
    snippet = "client = Client(region='eu-west', key='Mn1Bv2Cx3Zl4Kj5Hg6Fd7S', retries=3, timeout=30, verify=True)"
    rows = [(i, f"{odd_rows.prose(60, 1000 + (i if pasted else 0))} {snippet} {odd_rows.prose(40, 5000 + (i if pasted else 0))} end{i}", "en", f"org{i}/repo", 1) for i in range(50)]
    got = secret_scan.scan(spark.createDataFrame(rows, odd_rows.SCHEMA)).collect()
    assert {(len(r.added), r.n_examples) for r in got} == {(0, 1) if pasted else (1, 0)}


def test_candidates_beside_many_spans():
    text = " ".join(f"token=abcdefgh{i} Mn1Bv2Cx3Zl4Kj5Hg6Fd{i:03d} AKIA{'A1' * 8}b" for i in range(300))
    base = secret_scan.base_values(text)
    every = [m.span() for m in secret_scan.CANDIDATE.finditer(text) if secret_scan.looks_live(m[0])]
    want = [(a, z) for a, z in every if all(z <= t[0] or a >= t[2] for t in base)]
    assert secret_scan.candidates(text, base) == want and len(want) == 300 < len(every) + 1
    long = text * 100
    began = time.perf_counter()
    assert len(secret_scan.candidates(long, secret_scan.base_values(long))) > 29_000
    assert time.perf_counter() - began < 20


def test_added_spans_equal_brute_force(spark):
    """Ownership counted in plain Python, over values that few or many hold, in documents of their own or in near copies of one."""
    rng = np.random.default_rng(8)
    signs = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    keys = ["".join(rng.choice(signs, 24)) for _ in range(30)]
    keys = [k for k in keys if secret_scan.looks_live(k)]
    rows = []
    for k, key in enumerate(keys):
        for j in range(1 + k % 9):
            said = odd_rows.prose(60, 7 * k) if k % 3 == 0 else odd_rows.prose(9, 100 * k + j)
            text = f"{said} {key} after{j} " + ("token=" + keys[(k + 1) % len(keys)] if j % 4 == 3 else "")
            rows.append((len(rows), text, "en", None if j == 5 else f"o{j % 7}/r{j}", 1))
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (r[1].split() for r in rows)]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    places, least = [], {}
    for i, text, _, source, _ in rows:
        fixed = [(m.start(1), m.end()) for m in re.finditer(r"token=([A-Za-z0-9]+)", text)]
        for key in keys:
            for m in re.finditer(key, text):
                places.append((key, i, *m.span(), m.span() in fixed))
                name = (source is not None, source.split("/")[0] if source else "", source or "")
                least[key, group[i]] = min(least.get((key, group[i]), name), name)
    found = {key for key in keys if all(len({n[at] for (k, _), n in least.items() if k == key}) >= 4 for at in (slice(0, 2), slice(0, 3)))}
    assert 3 < len(found) < len(keys) - 3
    got = {r.doc_id: r for r in secret_scan.scan(spark.createDataFrame(rows, odd_rows.SCHEMA)).collect()}
    for i, *_ in rows:
        bare = [p for p in places if p[1] == i and not p[4]]
        assert [(s.start, s.end) for s in got[i].added] == sorted(p[2:4] for p in bare if p[0] not in found), i
        assert got[i].n_examples == sum(p[0] in found for p in bare)
        assert got[i].n_base_examples == sum(p[0] in found for p in places if p[1] == i and p[4])


def test_redaction_of_odd_rows(spark):
    docs = odd_rows.docs(spark)
    out = secret_scan.redact(docs)
    assert out.columns == docs.columns
    got = Counter((r.doc_id, r.text, r.n_chars) for r in out.collect())
    want = Counter()
    for i, t, _, _, n in odd_rows.rows():
        spans = base_of(t)
        new = secret_scan.masked(t, [(s, e) for s, _, e in spans], "[SECRET]") if spans else t
        want[i, new, len(new) if spans else n] += 1
    assert got == want
    assert secret_scan.scan(odd_rows.empty(spark)).count() == 0


def test_redaction_without_identifiers(spark):
    texts = ["password=hunter2hunter2 a", "password=hunter2hunter2 a", "no secret", "token: abcdefgh12345 b", None]
    rows = [(i, t, "en", "s", 1) for i in (None, 7) for t in texts]
    got = Counter((r.doc_id, r.text) for r in secret_scan.redact(spark.createDataFrame(rows, odd_rows.SCHEMA)).collect())
    assert got == Counter((i, t) for i in (None, 7) for t in ["[SECRET] a", "[SECRET] a", "no secret", "[SECRET] b", None])


def plain_targets(sizes):
    names = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    fixed = {}
    while True:
        free = [s for s in names if s not in fixed]
        if not free:
            return fixed
        unit = (sum(sizes.values()) - sum(fixed.values())) / sum(weight[s] for s in free)
        over = [s for s in free if unit * weight[s] > 3 * sizes[s]]
        if not over:
            return fixed | {s: unit * weight[s] for s in free}
        fixed |= {s: 3.0 * sizes[s] for s in over}


def check_mix(rows, texts_by_key):
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    want = plain_targets(dict(sizes))
    for s in sizes:
        assert abs(want[s] - target[s]) < 1e-6
        assert abs(taken[s] - want[s]) <= 1
    assert all(r.source_size == sizes[r.source] for r in rows)
    assert Counter(r.size for r in rows) == Counter(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts_by_key)


def test_mixing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mixing.mix(docs).collect()
    check_mix(rows, [r.text for r in docs.collect()])
    again = queries.op5_mixing(spark, sf).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)
    odd = odd_rows.docs(spark)
    mixed = mixing.mix(odd).collect()
    check_mix(mixed, [r[1] for r in odd_rows.rows()])
    drawn = mixing.draw(odd)
    assert drawn.columns == odd.columns
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in drawn.collect())
    assert words == sum(r.taken for r in mixed)
    assert mixing.mix(odd_rows.empty(spark)).count() == 0 and mixing.draw(odd_rows.empty(spark)).count() == 0


def test_repeats_are_drawn_apart(spark):
    docs = spark.read.parquet(f"{MID}/documents.parquet")
    for shards in (1, 5):
        rows = [r.doc_id for r in mixing.draw(docs, shards=shards).collect()]
        taken = {r.doc_id: len(r.draws) for r in mixing.mix(docs, shards=shards).collect()}
        assert Counter(rows) == Counter({k: v for k, v in taken.items() if v})
        repeated = sum(v > 1 for v in taken.values())
        assert repeated > 50 and sum(a == b for a, b in zip(rows, rows[1:], strict=False)) <= 3
    draws = [d for r in mixing.mix(docs, shards=5).collect() for d in r.draws]
    assert {d.shard for d in draws} == set(range(5))


def test_copies_without_identifiers_are_mixed(spark):
    rows = [(None, odd_rows.prose(40, 1), "en", "a", 1)] * 50 + [(k, odd_rows.prose(10, k), "en", "b", 1) for k in range(5)]
    df = spark.createDataFrame(rows, odd_rows.SCHEMA)
    check_mix(mixed := mixing.mix(df).collect(), [r[1] for r in rows])
    drawn = mixing.draw(df).collect()
    assert sum(len(r.text.split()) for r in drawn) == sum(r.taken for r in mixed)
    assert sum(r.doc_id is None for r in drawn) == sum(len(r.draws) for r in mixed if r.doc_id is None)


def test_capped_targets():
    assert mixing.targets({"a": 10, "b": 100, None: 1000}) == pytest.approx(plain_targets({"a": 10, "b": 100, None: 1000}))
    assert mixing.targets({"a": 10, "b": 100, None: 1000})["a"] == 30
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0.0}


def test_split_tree_is_exact():
    quotas = np.array([1000, 3, 0, 77])
    cuts = mixing.split_tree(quotas, 16, 5)
    assert (cuts.sum(axis=0) == quotas).all() and cuts.min() >= 0
    assert np.ptp(cuts.sum(axis=1)) <= 1
    assert (mixing.split_tree(quotas, 16, 5) == cuts).all() and (mixing.split_tree(quotas, 16, 6) != cuts).any()


def counted(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    times, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if times[g] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, sf):
    rows = odd_rows.rows() + [(500 + k, odd_rows.prose(80 + k, k) + ("\nsame line here" * (k % 4)), "en", "big", 1) for k in range(120)] + [(900,
        "#$% " * 60 + odd_rows.prose(90, 5), "en", "big", 1)]
    got = quality_rules.judge(spark.createDataFrame(rows, odd_rows.SCHEMA)).collect()
    texts = defaultdict(list)
    for r in rows:
        texts[r[0]].append(r[1])
    assert len(got) == len(rows)
    for r in got:
        n, chars, symbols, dup, repeat = counted(texts[r.doc_id][0])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n)
        assert not (r.kept and r.base_failed)
    by = {r.doc_id: r for r in got}
    assert not by[900].kept and not by[900].base_failed
    assert np.mean([by[500 + k].kept for k in range(120)]) > 0.97
    for r in queries.op7_quality_rules(spark, sf).collect():
        assert r.n_words >= 0 and r.kept in (True, False)
    assert quality_rules.judge(odd_rows.empty(spark)).count() == 0


def test_quality_of_small_groups(spark):
    junk = "#$% " * 60 + odd_rows.prose(90, 5)
    rows = [(k, odd_rows.prose(80 + k, k), "en", f"s{k % 20}", 1) for k in range(120)] + [(900, junk, "en", "s3", 1), (901, junk, "xx", None, 1),
        (902, odd_rows.prose(90, 7), "xx", "", 1)]
    by = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, odd_rows.SCHEMA)).collect()}
    assert len(by) == len(rows) and all(r.distance is not None for r in by.values() if not r.base_failed)
    assert not by[900].base_failed and not by[900].kept and not by[901].base_failed and not by[901].kept and by[902].kept
    assert np.mean([by[k].kept for k in range(120)]) > 0.97
    few = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows[:1], odd_rows.SCHEMA)).collect()}
    assert few[0].kept and few[0].distance is not None


def plain_estimate(x):
    """Minimum covariance determinant in numpy, on whole rows: the same starts, steps until the determinant settles."""
    floor = np.diag(np.array(quality_rules.FLOORS) ** 2)
    squared = lambda at, cov, y: np.einsum("ij,jk,ik->i", y - at, np.linalg.inv(cov + floor), y - at)
    middle = np.median(x, axis=0)
    best = None
    for wide in (1.4826 * np.median(abs(x - middle), axis=0), np.subtract(*np.percentile(x, [75, 25], axis=0)) / 1.349):
        at, cov, size = middle, np.diag(wide**2), np.inf
        while True:
            d = squared(at, cov, x)
            core = x[d <= np.quantile(d, 0.5)]
            at, cov = core.mean(axis=0), np.cov(core.T, bias=True)
            before, size = size, np.linalg.slogdet(cov + floor)[1]
            if best is None or size < best[0]:
                best = size, at, cov
            if not before - size > quality_rules.SETTLED:
                break
    _, at, cov = best
    d = squared(at, cov, x)
    inner = x[d / max(1, np.median(d) / quality_rules.MEDIAN) <= quality_rules.INNER]
    at, cov = inner.mean(axis=0), np.cov(inner.T, bias=True)
    scale = max(1, np.median(squared(at, cov, inner)) / quality_rules.MEDIAN)
    return squared(at, cov, x) / scale


def test_quality_equals_plain_estimate(spark):
    docs = spark.read.parquet(f"{MID}/documents.parquet").withColumn("source", F.lit("all"))
    lang = {r.doc_id: r.lang for r in docs.collect()}
    rows = [r for r in quality_rules.statistics(quality_rules.counts(docs)).collect() if not r.base_failed]
    got = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    for name in set(lang.values()):
        mine = [r for r in rows if lang[r.doc_id] == name]
        assert len(mine) >= quality_rules.LEAST_ROWS
        want = plain_estimate(np.array([[r[s] for s in quality_rules.STATISTICS] for r in mine]))
        ours = np.array([got[r.doc_id].distance for r in mine])
        assert np.allclose(ours, want, rtol=0.1, atol=0.3)
        clear = abs(want / quality_rules.CUTOFF - 1) > 0.1
        assert all(got[r.doc_id].kept == (d <= quality_rules.CUTOFF) for r, d, c in zip(mine, want, clear, strict=True) if c)


@pytest.mark.parametrize("junk", [35, 40])
def test_quality_with_many_copies_of_junk(spark, junk):
    text = "#$% " * 60 + odd_rows.prose(90, 5)
    rows = [(k, text if k < junk else odd_rows.prose(80 + k, k), "en", "big", 1) for k in range(100)]
    by = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, odd_rows.SCHEMA)).collect()}
    assert not any(by[k].base_failed or by[k].kept for k in range(junk))
    assert np.mean([by[k].kept for k in range(junk, 100)]) > 0.97


def test_language(spark):
    got = queries.op9_language_id(spark, MID).join(spark.read.parquet(f"{MID}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang == r.lang_pred for r in got if r.held_out]) >= 0.95
    docs = odd_rows.docs(spark)
    out = {r.doc_id: r for r in language_id.predict(docs, language_id.learn(docs)).collect()}
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (0, 1, 2, 17))
    assert out[9].lang_pred in ("de", "en") and len(out) == len({r[0] for r in odd_rows.rows()})
    assert language_id.learn(odd_rows.empty(spark)) is None
    assert language_id.predict(odd_rows.empty(spark), None).count() == 0
    assert {r.lang_pred for r in language_id.predict(docs, None).collect()} == {"und"}


def test_numerals_are_no_letters(spark):
    docs = spark.read.parquet(f"{MID}/documents.parquet")
    texts = ["½ ² 123", "Ⅷ ①", "٣ _ -", "½ a"]
    asked = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in language_id.predict(asked, language_id.learn(docs)).collect()}
    assert [got[i].lang_pred == "und" for i in range(4)] == [True, True, True, False] and got[0].score == 0


def test_tables_equal_a_direct_convolution():
    rng = np.random.default_rng(2)
    widths, e, f = language_id.WIDTHS, language_id.EMBEDDED, language_id.FILTERS
    net = language_id.Network(["a", "b", "c"], rng.normal(size=(256, e)), [rng.normal(size=(w * e, f)) for w in widths],
        rng.normal(size=f * len(widths)), rng.normal(size=(f * len(widths), 3)), rng.normal(size=3))
    net.tables()
    b = rng.integers(0, 256, (5, language_id.WINDOW)).astype(np.uint8)
    pooled = [np.stack([net.embed[b[:, at : at + w]].reshape(5, -1) @ filters for at in range(language_id.WINDOW - w + 1)]).max(axis=0) for w,
        filters in zip(widths, net.filters, strict=True)]
    want = np.maximum(np.concatenate(pooled, axis=1) + net.bias, 0) @ net.out + net.out_bias
    assert np.allclose(net.odds(b), language_id.softmax(want), atol=1e-4)


def test_gradients_equal_differences():
    rng = np.random.default_rng(4)
    widths, e, f = language_id.WIDTHS, language_id.EMBEDDED, language_id.FILTERS
    params = [rng.normal(size=(256, e)), *(rng.normal(size=(w * e, f)) for w in widths), rng.normal(size=f * len(widths)),
        rng.normal(size=(f * len(widths), 3)), rng.normal(size=3)]
    b, labels = rng.integers(0, 256, (4, 20)).astype(np.uint8), np.array([0, 1, 2, 1])

    def loss():
        pooled = [np.stack([params[0][b[:, at : at + w]].reshape(4, -1) @ filters for at in range(20 - w + 1)]).max(axis=0) for w,
            filters in zip(widths, params[1 : 1 + len(widths)], strict=True)]
        odds = language_id.softmax(np.maximum(np.concatenate(pooled, axis=1) + params[-3], 0) @ params[-2] + params[-1])
        return -np.log(odds[np.arange(4), labels]).mean()

    grads = language_id.gradients(params, b, labels)
    for p, g in zip(params, grads, strict=True):
        for at in [tuple(rng.integers(0, n) for n in p.shape) for _ in range(6)] + [np.unravel_index(abs(g).argmax(), p.shape)]:
            held, step = p[at], 1e-6
            p[at] = held + step
            up = loss()
            p[at] = held - step
            down = loss()
            p[at] = held
            assert abs((up - down) / (2 * step) - g[at]) < 1e-4


def test_windows_cover_the_text():
    raw = ("ä" * 700).encode()
    w = language_id.windows_of("ä" * 700)
    assert w.shape == (6, language_id.WINDOW) and w[-1].tobytes() == raw[-256:] and b"".join(x.tobytes() for x in w[:5]) == raw[:1280]


def test_toxicity(spark):
    got = queries.op10_toxicity(spark, MID).join(spark.read.parquet(f"{MID}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    out = [r for r in got if r.held_out]
    pos, neg = [r.score for r in out if r.toxic], [r.score for r in out if not r.toxic]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert auc > 0.9
    docs = odd_rows.docs(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.score(docs, toxicity.learn(docs, none)).collect()} == {0.0}
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(20)] + [(3, 1, None), (6, 0, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.score(docs, toxicity.learn(docs, labels)).collect()
    assert len(rows) == len(odd_rows.rows()) and len({r.score for r in rows if r.doc_id in (0, 1, 2)}) == 1
    assert toxicity.score(odd_rows.empty(spark), toxicity.fit([], np.zeros(0, np.int64))).count() == 0


def plain_boosting(x, y, trees):
    """Each node by trying every threshold of every feature on its own rows."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, toxicity.BINS + 1)[1:-1])) for j in range(x.shape[1])]
    share = y.mean()
    score = np.full(len(x), np.log(share / (1 - share)))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        worth = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + toxicity.L2)  # noqa: B023, E731
        leaves = [np.arange(len(x))]
        for _ in range(toxicity.DEPTH):
            split = []
            for rows in leaves:
                best = (1e-9, None, None)
                for j, held in enumerate(edges):
                    for e in held:
                        left, right = rows[x[rows, j] <= e], rows[x[rows, j] > e]
                        gain = worth(left) + worth(right) - worth(rows)
                        if gain > best[0] + 1e-12:
                            best = (gain, left, right)
                split += [rows, rows[:0]] if best[1] is None else [best[1], best[2]]
            leaves = split
        for rows in leaves:
            score[rows] -= toxicity.RATE * g[rows].sum() / (h[rows].sum() + toxicity.L2)
    return score


def test_boosting_equals_plain_trees(monkeypatch):
    monkeypatch.setattr(toxicity, "TREES", 4)
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(80, 3)), 2)
    y = (x[:, 0] + x[:, 1] ** 2 + rng.normal(size=80) > 1).astype(int)
    model = toxicity.boost(x, y)
    assert len(model.trees) == 4 and np.allclose(model.raw(x), plain_boosting(x, y, 4), atol=1e-9)


def test_isotonic_is_monotone():
    rng = np.random.default_rng(1)
    x = rng.normal(size=400)
    y = (rng.random(400) < 1 / (1 + np.exp(-2 * x))).astype(int)
    xs, ys = toxicity.isotonic(x, y)
    assert (np.diff(ys) >= 0).all() and (np.diff(xs) >= 0).all() and 0 <= ys[0] <= ys[-1] <= 1


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "secrets", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        after = out.collect()
        if name == "language":
            assert len(after) >= 0.97 * len(before)
        if name == "near_duplicates":
            ids = sorted(before)
            label = test_pairs.groups_of(len(ids), test_pairs.brute_links([before[i].text for i in ids]))
            assert sorted(r.doc_id for r in after) == [i for k, i in enumerate(ids) if label[k] == k]
        if name == "secrets":
            assert len(after) == len(before) and all(not base_of(r.text) for r in after)
        if name == "mixing":
            taken = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
            words = Counter()
            for r in after:
                words[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
            assert words == Counter({k: v for k, v in taken.items() if v})
        docs = spark.createDataFrame(after, out.schema)
    pieces = corpus_pipeline.packed(spark, docs, sf).collect()
    assert sum(p.length for p in pieces) == sum(q.doc_tokens for q in pieces if q.start == 0)


def test_pipeline_run(spark, sf, tmp_path):
    """The registered run, with what each stage writes, against plain versions of its decisions."""
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    columns = spark.read.parquet(f"{sf}/documents.parquet").schema
    n = len(rows)
    secret = "password = hunter2hunter2 " + odd_rows.prose(80, 41)
    rows += [(n + 1, secret, "en", "src1", len(secret)), (None, "api_key: abcdef0123456789 " + odd_rows.prose(90, 42), "en", "src2", 1),
        (n + 1, odd_rows.prose(70, 43), "en", "src1", 1), (n + 2, secret + " end", "en", "src3", 1), (n + 3, "½ 12", "en", "src3", 4),
        (n + 4, None, None, None, None)]
    spark.createDataFrame(rows, columns).write.parquet(str(tmp_path / "documents.parquet"))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    net = language_id.learn(docs)
    good = [r for r in language_id.predict(docs, net).collect() if r.lang_pred != "und" and r.score >= corpus_pipeline.LEAST_SCORE]
    held = sorted((r for r in good if r.doc_id is not None), key=lambda r: r.doc_id)
    label = test_pairs.groups_of(len(held), test_pairs.brute_links([r.text for r in held]))
    stay = [r for k, r in enumerate(held) if label[k] == k] + [r for r in good if r.doc_id is None]
    clean = [secret_scan.masked(r.text, [(s, e) for s, _, e in base_of(r.text)], "[SECRET]") for r in stay]
    rows = [(r.doc_id, t, r.lang, r.source, r.n_chars) for r, t in zip(stay, clean, strict=True)]
    taken = Counter()
    for r in mixing.mix(spark.createDataFrame(rows, odd_rows.SCHEMA)).collect():
        taken[r.doc_id] += len(r.draws)
    assert {p.doc_id for p in pieces} == {k for k, v in taken.items() if v}
    starts = Counter(p.doc_id for p in pieces if p.start == 0)
    assert starts == Counter({k: v for k, v in taken.items() if v})
    spans = defaultdict(list)
    for p in pieces:
        spans[p.sequence_id].append((p.offset, p.length))
        assert p.length * 4 == len(p.ids)
    for k, found in spans.items():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at == 4096 or k == max(spans)
    text = b"".join(p.ids for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)))
    said = load_tokenizer("word_bpe_49k.json").decode(np.frombuffer(text, "<u4").tolist())
    assert "hunter2hunter2" not in said.replace(" ", "") and "abcdef0123456789" not in said.replace(" ", "")


def test_texts_of_one_identifier_are_told_apart(spark):
    a, b = odd_rows.prose(60, 1), odd_rows.prose(60, 2)
    rows = [(1, a, "en", "s", 1), (1, b, "en", "s", 1), (1, a, "en", "s", 1), (2, b + " end", "en", "s", 1), (3, a, "en", "s", 1),
        (4, odd_rows.prose(60, 9), "en", "s", 1)]
    out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, odd_rows.SCHEMA), "").collect()
    assert sorted((r.doc_id, r.text) for r in out) == sorted([(1, a), (1, b), (4, rows[-1][1])])
    links = {(r.doc_id, r.n_links) for r in ngram_join.link(spark.createDataFrame(rows, odd_rows.SCHEMA)).collect()}
    assert links == {(1, 2), (1, 1), (2, 1), (3, 2), (4, 0)}


def test_pipeline_on_odd_rows(spark):
    docs = odd_rows.docs(spark)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        rows = docs.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        if name == "near_duplicates":
            ids = [r.doc_id for r in rows if r.doc_id is not None]
            assert len(ids) == len(set(ids)) and 6 in ids and 7 not in ids
    e = odd_rows.empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        e2 = stage(spark, e, "")
        assert e2.count() == 0
    assert ngram_join.link(e).count() == 0
