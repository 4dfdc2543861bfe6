"""The queries opN_<name>: thin digests over the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import (
    alignment,
    block_search,
    decontamination,
    language_id,
    mixing,
    ngram_join,
    packing,
    quality_rules,
    secret_scan,
    token_counts,
    token_store,
    toxicity,
    vector_dedup,
)
from corpusloom.workdir import scratch_path


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return packing.pack(docs).drop("ids")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op3_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [secret_scan.spans_of("base", name).alias(f"n_{name}") for name in secret_scan.KINDS[:3]]
    every = F.array_sort(F.concat("base", "added"))
    return found.select("doc_id", *counts, F.sha2(secret_scan.spans_text(F.col("base")), 256).alias("base_sha256"),
        secret_scan.spans_text(every).alias("spans"), F.size("added").alias("n_owned"), "n_examples", "n_base_examples")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken",
        F.size("draws").cast("long").alias("n_draws"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_mark", "group")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-store")
    token_store.write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return token_store.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = language_id.learn(docs)
    found = language_id.predict(docs.select("doc_id", "text"), net)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = block_search.build(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return block_search.search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


#: All pairs at or above the cosine, and what can be reached by them.
OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v),
pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2])) / a.n / b.n >= 0.9),
reach(vec_id, got) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, p.b FROM reach r JOIN pairs p ON p.a = r.got)
SELECT e.vec_id, (SELECT count(*) FROM pairs WHERE a = e.vec_id) AS n_links, (SELECT min(got) FROM reach r WHERE r.vec_id = e.vec_id) AS component_id,
  e.vec_id = (SELECT min(got) FROM reach r WHERE r.vec_id = e.vec_id) AS kept FROM embeddings e
"""

#: Texts that share shingles, their Jaccard coefficients, and what can be reached by links.
OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * k >= 4 * (x.n + y.n - k)),
reach(doc_id, got) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.got),
c AS (SELECT doc_id, min(got) AS class_id FROM reach GROUP BY 1), k AS (SELECT a, count(*) AS n_links FROM links GROUP BY 1)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links, doc_id = class_id AS kept FROM c LEFT JOIN k ON k.a = c.doc_id
"""


#: Lower-case terms of a column, for A-Z alone.
TERMS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

#: Every document scored against every item.
OP11_SQL = f"""
WITH d AS (SELECT doc_id, {TERMS_SQL} AS t FROM documents),
s AS (SELECT count(*) AS docs, sum(len(t)) AS l FROM d WHERE len(t) > 0),
p AS (SELECT doc_id, len(t) AS n, u.term, count(*) AS tf FROM d, unnest(d.t) AS u(term) GROUP BY doc_id, len(t), u.term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term),
b AS (SELECT item_id, {TERMS_SQL} AS t FROM benchmark),
q AS (SELECT item_id, u.term, count(*) AS times FROM b, unnest(b.t) AS u(term) GROUP BY item_id, u.term),
g AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // l)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term), s GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM g WHERE score > 0)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM r WHERE place <= 20
"""

#: Windows of items, joined with the windows of documents.
OP12_SQL = f"""
WITH d AS (SELECT doc_id, {TERMS_SQL} AS t FROM documents), b AS (SELECT item_id, {TERMS_SQL} AS t, least(len(t), 10) AS n FROM benchmark),
w AS (
  SELECT DISTINCT item_id, n, unnest(list_transform(range(1, len(t) - n + 2), lambda i: array_to_string(t[i:i + n - 1], ' '))) AS g
  FROM b WHERE n > 0),
k AS (SELECT DISTINCT n FROM w),
o AS (
  SELECT doc_id, n, unnest(range(1, len(t) - n + 2)) AS i,
    unnest(list_transform(range(1, len(t) - n + 2), lambda i: array_to_string(t[i:i + n - 1], ' '))) AS g
  FROM d, k WHERE len(t) >= n),
m AS (SELECT doc_id, i, o.n AS n, item_id FROM o JOIN w ON o.g = w.g AND o.n = w.n),
h AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS x FROM m) GROUP BY 1),
c AS (
  SELECT doc_id, count(*) AS n_items, string_agg(v, ',' ORDER BY v) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS v FROM m) GROUP BY 1)
SELECT d.doc_id, len(t) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    """For those whose results SQL can say; the others train, draw or merge byte pairs, and are held against
    brute force in the tests."""
    return {"op3_vector_dedup": OP3_SQL, "op6_ngram_join": OP6_SQL, "op11_ranked_search": OP11_SQL, "op12_decontamination": OP12_SQL}
