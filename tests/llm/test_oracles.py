"""The SQL oracles of the training-data queries, and SQL over those columns of other queries that it can say."""

from __future__ import annotations

import compare
import pytest

from corpusloom.llm import queries


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_equals_oracle(spark, sf, name):
    assert compare.differences(queries.queries()[name](spark, sf), compare.connect(sf), queries.oracle_sql()[name]) == ""


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
#: Shares by weight, and what is above three times a source's words shared again, five times over.
ROUND = """
r{k} AS (SELECT source, w, s, CASE WHEN done THEN target WHEN share * w > 3 * s THEN 3.0 * s ELSE share * w END AS target, done OR share * w > 3 * s AS done
  FROM (SELECT *, (SELECT sum(s) - sum(CASE WHEN done THEN target ELSE 0 END) FROM r{j}) / (SELECT greatest(1, sum(CASE WHEN done THEN 0 ELSE w END)) FROM r{j}) AS share FROM r{j}))"""
TARGETS = (
    "WITH d AS (SELECT doc_id, source, len(" + WORDS + ") AS size FROM documents), "
    "s AS (SELECT source, sum(size) AS s, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM d GROUP BY 1), "
    "r0 AS (SELECT source, w, s, 0.0::DOUBLE AS target, false AS done FROM s)," + ",".join(ROUND.format(k=k, j=k - 1) for k in range(1, 7)) + " "
    "SELECT d.doc_id, d.size, r.s AS source_size, round(r.target, 3) AS target FROM d JOIN r6 r ON d.source IS NOT DISTINCT FROM r.source"
)
DIGESTS = {
    "op4_secret_scan": (
        ["doc_id", "n_access", "n_hex"],
        "SELECT doc_id, len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: len(x) >= 16)) AS n_access, "
        "len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: len(x) >= 32)) AS n_hex FROM documents",
    ),
    "op5_mixing": (["doc_id", "size", "source_size", "round(target, 3) as target"], TARGETS),
    "op7_quality_rules": (
        ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"],
        "WITH d AS (SELECT doc_id, coalesce(text, '') AS text, " + WORDS + " AS w FROM documents), "
        "g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d), t AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS t FROM g), "
        "again AS (SELECT doc_id, i FROM t QUALIFY count(*) OVER (PARTITION BY doc_id, t) > 1), "
        "hit AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY 1), "
        "l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d) "
        "SELECT d.doc_id, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, "
        "len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(n, 0) > 50 * len(w) AS base_failed "
        "FROM d JOIN l USING (doc_id) LEFT JOIN hit USING (doc_id)",
    ),
}


@pytest.mark.parametrize("name", list(DIGESTS))
def test_columns_equal_sql(spark, sf, name):
    columns, sql = DIGESTS[name]
    assert compare.differences(queries.queries()[name](spark, sf).selectExpr(*columns), compare.connect(sf), sql) == ""
