"""An independent SQL statement for each query of the catalog, for DuckDB on the same tables."""

from __future__ import annotations

from corpusloom.plans import catalog as c

BASE = """base AS (
  SELECT doc_id AS chunk_id, text, 'doc/' || doc_id AS path, source AS project,
    CASE doc_id % 8 WHEN 0 THEN 'curated' WHEN 1 THEN 'repo-doc' WHEN 2 THEN 'transcript' WHEN 3 THEN 'archive-doc' WHEN 4 THEN 'tool-memory'
      WHEN 5 THEN 'user-memory' WHEN 6 THEN 'project-brief' ELSE 'transcript' END AS source_type,
    CASE WHEN doc_id % 8 = 7 THEN 'tool_event' ELSE 'prose' END AS kind,
    CASE WHEN doc_id % 17 <> 0 THEN strftime(DATE '2026-01-01' + CAST(doc_id % 200 AS INTEGER), '%Y-%m-%d') END AS doc_date,
    CASE WHEN doc_id % 8 = 2 AND doc_id % 5 = 0 THEN 'abandoned' ELSE 'canonical' END AS branch
  FROM documents)"""

SPACE = r"[ \t\n\x0B\f\r]"
CHUNKS = rf"""steps AS (
  SELECT doc_id, text AS rest, 0 AS step FROM documents WHERE regexp_matches(text, '[^ \t\n\x0B\f\r]')
  UNION ALL
  SELECT doc_id, substr(rest, cut - 480 + 1), step + 1 FROM (
    SELECT doc_id, rest, step, CASE WHEN back > 0 AND 3200 - back >= 1600 THEN 3200 - back ELSE 3200 END AS cut
    FROM (SELECT *, strpos(reverse(substr(rest, 1, 3200)), chr(10)) AS back FROM steps WHERE length(rest) > 3200))
  WHERE regexp_matches(substr(rest, cut - 480 + 1), '[^ \t\n\x0B\f\r]')),
pieces AS (
  SELECT doc_id, step, CASE WHEN length(rest) <= 3200 THEN rest WHEN back > 0 AND 3200 - back >= 1600 THEN substr(rest, 1, 3200 - back) ELSE substr(rest, 1, 3200) END AS raw
  FROM (SELECT *, strpos(reverse(substr(rest, 1, 3200)), chr(10)) AS back FROM steps)),
chunks AS (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY step) - 1 AS INTEGER) AS ord, body AS text, sha256(body) AS content_hash
  FROM (SELECT doc_id, step, regexp_replace(raw, '^{SPACE}+|{SPACE}+$', '', 'g') AS body FROM pieces) WHERE body <> '')"""

TOKENS = r"regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+')"
TERMS = ("moron", "worthless", "with", "nicht", "erst")
COVERAGE = "(" + " + ".join(f"CAST(contains(lower(text), '{t}') AS INTEGER)" for t in TERMS) + ") / 5.0"


def frequency(phrase: list[str]) -> str:
    if len(phrase) == 1:
        return f"len(list_filter(tok, lambda t: t = '{phrase[0]}'))"
    same = " AND ".join(f"tok[i + {k}] = '{p}'" for k, p in enumerate(phrase))
    return f"len(list_filter(range(1, len(tok) + 1), lambda i: {same}))"


def bm25(phrases: list[list[str]], limit: int, where: str = "TRUE", source: str = "base") -> str:
    """CTEs tf, stats, ranked(chunk_id, score, rank0)."""
    n = range(len(phrases))
    tf = ", ".join(f"{frequency(p)} AS tf{i}" for i, p in enumerate(phrases))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in n)
    score = " + ".join(f"greatest(1e-6, ln((total - df{i} + 0.5) / (df{i} + 0.5))) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / mean_dl))" for i in n)
    hit = " OR ".join(f"tf{i} > 0" for i in n)
    return f"""tok AS (SELECT *, {TOKENS} AS tok FROM {source}), tf AS (SELECT * EXCLUDE (tok), len(tok) AS dl, {tf} FROM tok),
stats AS (SELECT count(*)::DOUBLE AS total, avg(dl) AS mean_dl, {df} FROM tf),
scored AS (SELECT chunk_id, {score} AS score FROM tf, stats WHERE ({hit}) AND ({where})),
ranked AS (SELECT chunk_id, score, row_number() OVER (ORDER BY round(score, 6) DESC, chunk_id) - 1 AS rank0 FROM scored QUALIFY rank0 < {limit})"""


ASKED = [[t] for t in TERMS]
PHRASED = [["of", "the"], ["thanble"]]
TOP = "SELECT chunk_id, round(score, 6) AS score, rank0 FROM ranked"
PROJECTS = f"lower(project) IN ('{c.PROJECT}', 'src5')"
DATES = f"doc_date >= '{c.AFTER}' AND doc_date <= '{c.BEFORE}'"

DISTANCE = "sqrt(list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))))"


def nearest(limit: int, where: str = "TRUE") -> str:
    return f"""dist AS (SELECT v.vec_id AS chunk_id, {DISTANCE} AS distance FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 7) q WHERE {where}),
near AS (SELECT chunk_id, distance, row_number() OVER (ORDER BY round(distance, 6), chunk_id) - 1 AS rank0 FROM dist QUALIFY rank0 < {limit})"""


SCOPED = "v.vec_id IN (SELECT chunk_id FROM base WHERE {})"
FUSED = """legs AS (SELECT chunk_id, 1.0::DOUBLE / (61 + rank0) AS part, NULL::DOUBLE AS distance, 'fts' AS leg FROM ranked
  UNION ALL SELECT chunk_id, 1.0::DOUBLE / (61 + rank0), distance, 'vector' FROM near),
fused AS (SELECT chunk_id, sum(part) AS rrf, max(distance) AS distance, bool_or(leg = 'fts') AS is_fts, string_agg(leg, ',' ORDER BY leg) AS matched_by FROM legs GROUP BY chunk_id)"""
BOOST = """CASE WHEN source_type = 'repo-doc' THEN CASE WHEN list_contains(string_split(path, '/'), 'docs') OR list_contains(string_split(path, '/'), 'specs') OR len(string_split(path, '/')) <= 6 THEN 2.0 ELSE 0.7 END
  WHEN source_type = 'curated' THEN 3.0 WHEN source_type IN ('tool-memory', 'user-memory') THEN 2.4 WHEN source_type = 'project-brief' THEN 2.0 WHEN source_type = 'archive-doc' THEN 1.1
  WHEN source_type = 'transcript' THEN CASE WHEN branch = 'abandoned' THEN 0.3 WHEN kind = 'tool_event' THEN 0.5 ELSE 1.0 END ELSE 1.0 END"""
VECTOR_SURE = "coalesce(greatest(0.0, least(1.0, (1.3::DOUBLE - distance) / (1.3::DOUBLE - 1.1::DOUBLE))), 0.0)"


def covered(terms: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"CAST(contains(lower(text), '{t}') AS INTEGER)" for t in terms) + f") / {len(terms)}.0"


def hybrid(phrases: list[list[str]], terms: tuple[str, ...], where: str = "TRUE", pool: int = 50, vector_where: str = "TRUE", exact: bool = False, then: str = "") -> str:
    order = ("is_fts DESC, " if exact else "") + "round(score, 9) DESC, chunk_id"
    return f"""WITH {BASE}, {bm25(phrases, pool, where)}, {nearest(50, vector_where)}, {FUSED},
sure AS (SELECT f.*, b.path, b.source_type, b.text, 0.15 + 0.85 * greatest({VECTOR_SURE}, {covered(terms)}) AS confidence, ({BOOST})::DOUBLE AS boost FROM fused f JOIN base b USING (chunk_id)),
final AS (SELECT *, rrf * boost * confidence AS score FROM sure ORDER BY {order.replace("score, 9", "rrf * boost * confidence, 9")} LIMIT 20)
""" + (then or "SELECT chunk_id, path, source_type, round(score, 9) AS score, round(confidence, 6) AS confidence, matched_by, sha256(CASE WHEN length(text) > 600 THEN substr(text, 1, 600) || '...' ELSE text END) AS excerpt_hash FROM final")


OCC = "occ AS (SELECT 'doc/' || doc_id AS path, ord, content_hash, text FROM chunks)"
EDGES = """turns AS (SELECT conv_id AS conv, turn AS node FROM conversations),
edges AS (SELECT conv, node, CASE WHEN node > 0 THEN node - 1 END AS parent FROM turns UNION ALL SELECT conv, node + 100000, node - 1 FROM turns WHERE conv % 2 = 0 AND node % 3 = 1),
way(conv, node) AS (SELECT conv, max(node) FROM turns GROUP BY conv UNION SELECT e.conv, e.parent FROM way w JOIN edges e ON e.conv = w.conv AND e.node = w.node WHERE e.parent IS NOT NULL),
points AS (SELECT conv, parent AS node, count(*) AS children FROM edges WHERE parent IS NOT NULL GROUP BY ALL HAVING count(*) > 1),
split AS (SELECT DISTINCT conv FROM points WHERE conv IN (SELECT conv FROM way GROUP BY conv HAVING count(*) >= 2)),
branches AS (SELECT conv, node, CASE WHEN conv IN (SELECT conv FROM split) AND NOT EXISTS (SELECT 1 FROM way w WHERE w.conv = e.conv AND w.node = e.node) THEN 'abandoned' ELSE 'canonical' END AS branch FROM edges e)"""
VERSIONS = """cur AS (SELECT path, chunk_id, source_type, sha256(text) AS content_hash, chunk_id::DOUBLE AS mtime, length(text) AS size FROM base),
old AS (SELECT * FROM cur WHERE chunk_id % 10 <> 1),
new AS (SELECT path, chunk_id, source_type, CASE WHEN chunk_id % 10 = 3 THEN content_hash || 'x' ELSE content_hash END AS content_hash, CASE WHEN chunk_id % 10 = 4 THEN mtime + 1 ELSE mtime END AS mtime, size FROM cur WHERE chunk_id % 10 <> 2)"""
SECRETS = "secret AS (SELECT doc_id, text || ['', ' sk-ant-' || repeat('a1', 10), ' sk-' || repeat('b2', 10), ' ghp_' || repeat('c3', 10), ' AKIA' || repeat('D4', 8), ' AIza' || repeat('e5f', 11) || 'gh', ' xoxb-' || repeat('1a', 6), ' Bearer ' || repeat('h6', 12), ' https://me:pw@host/x', ' api_key = ''' || repeat('i7', 12) || ''''][doc_id % 10 + 1] || ' end' AS text FROM documents)"
# The injected credentials stand where these marks come; the tables' own AKIA strings are of 20 characters too.
MARKED = [
    (r"\bsk-ant-[A-Za-z0-9_-]{16,}\b", "anthropic-key"), (r"\bsk-[A-Za-z0-9_-]{16,}\b", "openai-key"), (r"\b(?:ghp|gho|ghu|ghs|ghr|github_pat)_[A-Za-z0-9_]{16,}\b", "github-token"), (r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", "aws-access-key"),
    (r"\bAIza[0-9A-Za-z_-]{35}\b", "google-api-key"), (r"\bxox[abprs]-[0-9A-Za-z-]{10,}\b", "slack-token"), (r"\bBearer\s+[A-Za-z0-9._~+/=-]{20,}", "bearer"), (r"\b[a-z][a-z0-9+.-]*://[^/\s:@]+:[^/\s@]+@", "basic-auth-url"),
    (r"\b(?i:private_key|secret_key|api_key|access_token|client_secret)\s*[:=]\s*[''\"]?[A-Za-z0-9/_+=-]{20,}[''\"]?", "private-key-assign"),
]


def redactions() -> str:
    """CTEs r0, r1, …: the text after each rule, and the kinds so far."""
    out, last = [SECRETS, "r0 AS (SELECT doc_id, text, []::VARCHAR[] AS kinds FROM secret)"], "r0"
    for k, (pattern, kind) in enumerate(MARKED, 1):
        out.append(f"r{k} AS (SELECT doc_id, regexp_replace(text, '{pattern}', '[REDACTED:{kind}]', 'g') AS text, CASE WHEN regexp_matches(text, '{pattern}') THEN list_append(kinds, '{kind}') ELSE kinds END AS kinds FROM {last})")
        last = f"r{k}"
    return ", ".join(out)


def scrub() -> str:
    """Page by page over the pieces between opening brackets: ``held`` names the acting element that is open.  (Pages have no event attributes
    and no addresses of scripts; these are held against cases in the tests.)"""
    names = "('script', 'style', 'iframe', 'object', 'embed', 'applet', 'form', 'link', 'meta', 'base')"
    rest = "substr(piece, strpos(piece, '>') + 1)"
    return f"""WITH RECURSIVE parts AS (SELECT page_id, string_split(html, '<') AS s FROM pages),
    go AS (
      SELECT page_id, 1 AS i, s[1] AS said, '' AS held, s FROM parts
      UNION ALL
      SELECT page_id, i + 1,
        said || CASE WHEN held = '' AND name NOT IN {names} THEN '<' || piece WHEN held = '' AND shut AND strpos(piece, '>') > 0 THEN {rest} WHEN held <> '' AND ends THEN {rest} ELSE '' END,
        CASE WHEN held = '' AND name IN {names} AND NOT shut THEN name WHEN ends THEN '' ELSE held END, s
      FROM (SELECT *, shut AND held <> '' AND name = held AND trim(substr(piece, strpos(lower(piece), name) + length(name), greatest(strpos(piece, '>') - strpos(lower(piece), name) - length(name), 0))) = '' AND strpos(piece, '>') > 0 AS ends
        FROM (SELECT *, s[i + 1] AS piece, starts_with(ltrim(s[i + 1]), '/') AS shut, regexp_extract(lower(s[i + 1]), '[a-z][a-z0-9_:]*') AS word,
          CASE WHEN starts_with(ltrim(ltrim(lower(s[i + 1]), ' /')), word) THEN word ELSE '' END AS name FROM go WHERE i < len(s))))
    SELECT page_id, sha256(said) AS html_hash FROM go WHERE i = len(s)"""


# Sections of one line each; long ones give their heading and slices.  Groups are numbered by a walk over lengths, then joined.
STRIPPED = r"regexp_replace({}, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')"
MARKDOWN = f"""src AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i, len(string_split(text, chr(10))) AS n FROM documents),
sec AS (SELECT doc_id, i, line, CASE WHEN i = 1 THEN '# Top' ELSE '## Part' END AS head, CASE WHEN i = 1 THEN 'Top' ELSE 'Top > Part' END AS place, CASE WHEN i = n AND line = '' THEN '' ELSE chr(10) || line END AS tail FROM src),
parts AS (SELECT doc_id, i, 0 AS k, place, head || tail AS body, false AS large FROM sec WHERE length(head || tail) <= 3200
  UNION ALL SELECT doc_id, i, 0, place, head, true FROM sec WHERE length(head || tail) > 3200
  UNION ALL SELECT doc_id, i, k, place, substr(line, 3200 * (k - 1) + 1, 3200), true FROM (SELECT *, unnest(range(1, CAST(ceil(length(line) / 3200.0) AS BIGINT) + 1)) AS k FROM sec WHERE length(head || tail) > 3200)),
u AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i, k) AS u FROM parts),
pack AS (SELECT doc_id, u, 1 AS g, CASE WHEN large THEN -1 ELSE length(body) END AS held FROM u WHERE u = 1
  UNION ALL SELECT u.doc_id, u.u, CASE WHEN NOT large AND held >= 0 AND held + 1 + length(body) <= 3200 THEN g ELSE g + 1 END, CASE WHEN large THEN -1 WHEN held >= 0 AND held + 1 + length(body) <= 3200 THEN held + 1 + length(body) ELSE length(body) END
    FROM pack JOIN u ON u.doc_id = pack.doc_id AND u.u = pack.u + 1),
packed AS (SELECT doc_id, g, string_agg(body, chr(10) ORDER BY u) AS body, arg_min(place, u) AS place FROM pack JOIN u USING (doc_id, u) GROUP BY ALL),
merge_ AS (SELECT doc_id, g, 1 AS m, length(body) AS size FROM packed WHERE g = 1
  UNION ALL SELECT p.doc_id, p.g, CASE WHEN least(length(body), size) < 400 AND length(body) + size + 1 <= 4000 THEN m ELSE m + 1 END, CASE WHEN least(length(body), size) < 400 AND length(body) + size + 1 <= 4000 THEN size + 1 + length(body) ELSE length(body) END
    FROM merge_ JOIN packed p ON p.doc_id = merge_.doc_id AND p.g = merge_.g + 1),
whole AS (SELECT doc_id, m, {STRIPPED.format("string_agg(body, chr(10) ORDER BY g)")} AS body, arg_min(place, g) AS place FROM merge_ JOIN packed USING (doc_id, g) GROUP BY doc_id, m),
ranked_ AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY m) - 1 AS ord, lag(body) OVER (PARTITION BY doc_id ORDER BY m) AS before FROM whole WHERE body <> ''),
out_ AS (SELECT doc_id, ord, CASE WHEN body LIKE '#%' THEN '' ELSE '[' || place || ']' || chr(10) END || CASE WHEN before IS NULL THEN body ELSE regexp_replace(right(before, 480), '^[ \\t\\n\\x0B\\f\\r]+', '') || chr(10) || chr(10) || body END AS text FROM ranked_)"""
BODY = "CASE WHEN doc_id % 3 = 0 THEN '# Heading ' || doc_id || chr(10) ELSE '' END || CASE WHEN doc_id % 4 = 0 THEN 'Date: 2025-03-04' || chr(10) ELSE '' END || text"
RECORDS = """rec AS (SELECT conv_id AS session, turn AS seq, role, text, CASE WHEN turn % 3 = 1 THEN '/work/p' || (conv_id % 4) || '/' || turn END AS cwd, CASE WHEN turn = 2 THEN substr(text, 1, 20) END AS title,
  strftime(make_timestamp((1700000000 + conv_id * 1000 + turn) * 1000000), '%Y-%m-%dT%H:%M:%S') AS stamp, turn % 7 = 6 AS is_meta, conv_id % 10 = 3 AS side, turn % 11 = 10 AS tool FROM conversations)"""
PLAIN = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"

ORACLES = {
    "content_hash": "SELECT doc_id, sha256(text) AS content_hash FROM documents",
    "chunk_plain": f"WITH RECURSIVE {CHUNKS} SELECT doc_id, ord, length(text) AS n_chars, content_hash FROM chunks",
    "chunk_dedup": f"WITH RECURSIVE {CHUNKS}, {OCC} SELECT content_hash, n, path, ord FROM (SELECT content_hash, path, ord, count(*) OVER (PARTITION BY content_hash) AS n, row_number() OVER (PARTITION BY content_hash ORDER BY path, ord) AS k FROM occ) WHERE n > 1 AND k = 1",
    "dedupe_savings": f"WITH RECURSIVE {CHUNKS}, g AS (SELECT content_hash, count(*) AS n, max(length(text)) AS chars FROM chunks GROUP BY 1) SELECT sum(n)::BIGINT AS occurrences, count(*) AS chunks, sum(n * chars)::BIGINT AS chars, sum(chars)::BIGINT AS kept_chars FROM g",
    "overlap_prefix": f"WITH RECURSIVE {CHUNKS}, p AS (SELECT doc_id, ord, lag(text) OVER (PARTITION BY doc_id ORDER BY ord) AS p FROM chunks) SELECT doc_id, ord, sha256(right(p, 480)) AS prefix_hash FROM p WHERE p IS NOT NULL",
    "term_postings": f"WITH t AS (SELECT doc_id, unnest({TOKENS}) AS term, generate_subscripts({TOKENS}, 1) - 1 AS place FROM documents), p AS (SELECT term, doc_id, count(*) AS tf, min(place) AS place FROM t GROUP BY 1, 2) SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf, min(place) AS earliest FROM p GROUP BY term",
    "bm25_topk": f"WITH {BASE}, {bm25(ASKED, 20)} {TOP}",
    "bm25_phrase": f"WITH {BASE}, {bm25(PHRASED, 20)} {TOP}",
    "bm25_bounded": f"WITH {BASE}, {bm25(ASKED, 20)} {TOP}",
    "bm25_index": f"WITH {BASE}, {bm25(PHRASED, 20)} {TOP}",
    "bm25_scan": f"WITH {BASE}, {bm25(PHRASED, 20)} {TOP}",
    "search_index": f"WITH t AS (SELECT unnest({TOKENS}) AS term, doc_id FROM documents) SELECT (SELECT count(*) FROM documents) AS units, (SELECT count(DISTINCT term) FROM t) AS terms, (SELECT count(*) FROM (SELECT DISTINCT term, doc_id FROM t)) AS postings, (SELECT count(*) FROM t) AS tokens",
    "hybrid_scan": hybrid(ASKED, TERMS),
    "bm25_project_scoped": f"WITH {BASE}, {bm25(ASKED, 20, PROJECTS)} {TOP}",
    "bm25_date_scoped": f"WITH {BASE}, {bm25(ASKED, 20, DATES)} {TOP}",
    "filter_post_vs_pre": f"WITH {BASE}, {bm25(ASKED, 1000000000)} SELECT least(10, (SELECT count(*) FROM ranked JOIN base USING (chunk_id) WHERE project = '{c.PROJECT}')) AS pre, (SELECT count(*) FROM ranked JOIN base USING (chunk_id) WHERE rank0 < 10 AND project = '{c.PROJECT}') AS post",
    "bm25_folded": r"WITH t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+')) AS term FROM documents) SELECT term, count(*) AS df FROM t GROUP BY term",
    "lexical_coverage": f"SELECT doc_id, round({COVERAGE}, 6)::DOUBLE AS coverage FROM documents",
    "knn_l2": f"WITH {nearest(20)} SELECT chunk_id, round(distance, 6) AS distance, rank0 FROM near",
    "knn_scoped": f"WITH {BASE}, {nearest(20, SCOPED.format(f'''project = '{c.PROJECT}' '''))} SELECT chunk_id, round(distance, 6) AS distance, rank0 FROM near",
    "eligible_count": f"WITH {BASE} SELECT count(*) AS eligible FROM base WHERE lower(project) = '{c.PROJECT}' AND doc_date >= '{c.AFTER}'",
    "vector_confidence": f"WITH {nearest(1)}, s AS (SELECT chunk_id, {VECTOR_SURE} AS s FROM dist) SELECT chunk_id, round(s, 6) AS vector_confidence, round(0.15 + 0.85 * greatest(s, 0.2), 6) AS confidence FROM s",
    "rrf_fusion": f"WITH {BASE}, {bm25(ASKED, 50)}, {nearest(50)}, {FUSED} SELECT chunk_id, round(rrf, 9) AS rrf, matched_by FROM fused",
    "static_boosts": f"WITH {BASE}, p AS (SELECT * REPLACE (repeat('d/', (chunk_id % 9)::INTEGER) || CASE WHEN chunk_id % 5 = 0 THEN 'docs/' ELSE '' END || 'x.md' AS path) FROM base) SELECT chunk_id, ({BOOST})::DOUBLE AS boost FROM p",
    "hybrid_search": hybrid(ASKED, TERMS),
    "hybrid_filtered": hybrid(ASKED, TERMS, f"source_type = 'transcript' AND doc_date <= '{c.BEFORE}'", 1600, SCOPED.format(f"source_type = 'transcript' AND doc_date <= '{c.BEFORE}'")),
    "hybrid_exact_first": hybrid(PHRASED, ("the", "thanble"), exact=True),
    "hybrid_parity": hybrid(ASKED, TERMS, PROJECTS, 50, SCOPED.format(PROJECTS)),
    "best_chunk_per_document": f"WITH RECURSIVE {CHUNKS}, s AS (SELECT doc_id, ord, round({COVERAGE}, 6)::DOUBLE AS score, contains(lower(text), 'with') AS is_fts FROM chunks) SELECT doc_id, ord, score, is_fts FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY is_fts DESC, score DESC, ord) = 1",
    "median_confidence_banner": hybrid(ASKED, TERMS, then="SELECT round(coalesce(median(confidence), 0.0), 6) AS median_confidence, coalesce(median(confidence), 0.0) < 0.6 AS absent FROM final"),
    "read_document": f"WITH RECURSIVE {CHUNKS}, {OCC}, w AS (SELECT path, string_agg(text, chr(10) || chr(10) ORDER BY ord) AS t FROM occ GROUP BY path), r AS (SELECT path, CASE WHEN length(t) > 20000 THEN substr(t, 1, 20000) || chr(10) || chr(10) || '[truncated]' ELSE t END AS t FROM w) SELECT path, length(t) AS n_chars, sha256(t) AS text_hash FROM r",
    "read_window": f"WITH RECURSIVE {CHUNKS} SELECT doc_id, ord, content_hash FROM chunks WHERE ord BETWEEN 0 AND 2",
    "path_resolution": f"WITH {BASE}, asked AS (SELECT unnest(['doc/7', 'oc/19', 'doc/10', 'nowhere', 'c/100%']) AS asked), hit AS (SELECT asked, path, path = asked AS exact, bool_or(path = asked) OVER (PARTITION BY asked) AS has, count(*) OVER (PARTITION BY asked) AS n, row_number() OVER (PARTITION BY asked ORDER BY path) AS k FROM asked, base WHERE contains(path, asked)) SELECT asked, CASE WHEN has OR n = 1 THEN 'found' ELSE 'ambiguous' END AS status, path FROM hit WHERE exact OR (NOT has AND k <= 10)",
    "excerpt_trim": r"WITH t AS (SELECT doc_id, text, CASE WHEN length(text) > 603 THEN substr(text, 4, 600) || '...' ELSE substr(text, 4) END AS tail FROM documents), c AS (SELECT *, regexp_extract(tail, '^(\p{Ll}[^\s]{0,23})\s', 1) AS cut FROM t) SELECT doc_id, sha256(CASE WHEN length(text) > 600 THEN substr(text, 1, 600) || '...' ELSE text END) AS excerpt_hash, sha256(CASE WHEN doc_id % 3 > 0 AND length(cut) > 0 THEN '…' || ltrim(substr(tail, length(cut) + 2)) ELSE tail END) AS trimmed_hash FROM c",
    "health_counts": f"WITH {BASE} SELECT count(*) AS documents, count(*) AS chunks, count(*) FILTER (kind = 'prose') AS prose, count(*) FILTER (kind = 'tool_event') AS tool_events, count(*) FILTER (kind = 'prose' AND chunk_id NOT IN (SELECT vec_id FROM embeddings)) AS pending, (SELECT count(*) FROM embeddings) AS vectors FROM base",
    "docs_by_type": f"WITH {BASE} SELECT source_type, count(*) AS documents FROM base GROUP BY 1",
    "health_verdict": f"WITH {BASE}, p AS (SELECT count(*) FILTER (kind = 'prose' AND chunk_id NOT IN (SELECT vec_id FROM embeddings)) AS pending FROM base), r AS (SELECT event_type = 'error' AS bad, CAST(json_extract_string(props, '$.k') AS INTEGER) AS written FROM events ORDER BY event_id DESC LIMIT 1) SELECT CASE WHEN bad THEN 'red' WHEN pending > 0 THEN 'amber' ELSE 'green' END AS state, CASE WHEN bad THEN 'IMPORTER ERRORS' WHEN pending > 0 THEN 'DEGRADED' WHEN written = 0 THEN 'NOTHING NEW' ELSE 'HEALTHY' END AS verdict FROM p, r",
    "pending_embeddings": f"WITH {BASE} SELECT chunk_id, path FROM base WHERE kind = 'prose' AND chunk_id NOT IN (SELECT vec_id FROM embeddings)",
    "dangling_occurrences": "SELECT (SELECT count(*) FROM documents WHERE doc_id % 11 = 0) AS dangling_occurrences, (SELECT count(DISTINCT doc_id) FROM documents WHERE doc_id % 11 = 0) AS damaged_documents, (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 11 <> 0)) AS orphan_vectors",
    "orphan_vectors": "SELECT vec_id AS chunk_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 13 <> 0)",
    "capture_lag": "WITH e AS (SELECT 'u' || (user_id % 7) AS source, ts, event_type FROM events), a AS (SELECT source, max(ts) AS live FROM e WHERE event_type <> 'error' AND source <> 'u6' GROUP BY 1), b AS (SELECT source, max(ts) AS kept FROM e WHERE event_type = 'error' AND source <> 'u5' GROUP BY 1), j AS (SELECT coalesce(a.source, b.source) AS source, live, kept, CASE WHEN live IS NULL OR kept IS NULL THEN 0.0 ELSE greatest(0.0, (epoch_us(live) - epoch_us(kept)) / 3.6e9) END AS lag FROM a FULL JOIN b ON a.source = b.source) SELECT source, round(lag, 6) AS lag_hours, CASE WHEN live IS NULL THEN 'no live source' WHEN kept IS NULL THEN 'NEVER ARCHIVED' WHEN lag > 0.5 THEN 'stalled' ELSE 'ok' END AS state FROM j",
    "export_elements": "SELECT conv_id, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS n_chars, CAST(sum(turn) AS BIGINT) AS turn_sum FROM conversations GROUP BY 1",
    "export_freshness": "WITH n AS (SELECT o_orderpriority AS source, max(o_orderdate)::DATE AS d FROM orders GROUP BY 1) SELECT source, strftime(d, '%Y-%m-%d') AS newest, date_diff('day', d, DATE '1998-08-15') AS age_days, date_diff('day', d, DATE '1998-08-15') > 35 AS stale FROM n",
    "latest_run_per_source": "SELECT user_id, event_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "source_status": "SELECT user_id % 9 AS source, count(*) AS seen, count(*) FILTER (event_type = 'error') AS errors, sum(CAST(json_extract_string(props, '$.k') AS INTEGER))::BIGINT AS written FROM events GROUP BY 1",
    "run_totals": "SELECT count(*) AS seen, count(*) FILTER (event_type = 'error') AS errors, sum(CAST(json_extract_string(props, '$.k') AS INTEGER))::BIGINT AS written FROM events",
    "backlog": f"WITH RECURSIVE {CHUNKS}, {BASE}, n AS (SELECT 'doc/' || doc_id AS path, count(*) AS n_chunks FROM chunks GROUP BY 1), g AS (SELECT project, count(*) AS documents, coalesce(sum(n_chunks), 0)::BIGINT AS chunks, max(doc_date) AS last_date, count(*) FILTER (source_type = 'transcript') AS transcripts, count(*) FILTER (source_type = 'repo-doc') AS repo_docs, count(*) FILTER (source_type IN ('curated', 'tool-memory', 'user-memory', 'project-brief')) AS distilled FROM base LEFT JOIN n USING (path) WHERE project <> '' GROUP BY 1) SELECT *, round(documents * pow(0.5, greatest(0, coalesce(date_diff('day', CAST(last_date AS DATE), DATE '{c.AS_OF}'), 3650)) / 90.0), 6) AS score FROM g WHERE CAST(substr(project, 4) AS INTEGER) % 5 <> 0",
    "alias_resolution": "WITH a AS (SELECT n_name AS alias, r_name AS canonical FROM nation JOIN region ON n_regionkey = r_regionkey), asked AS (SELECT lower(n_name) AS name FROM nation UNION ALL SELECT DISTINCT lower(s_name) FROM supplier), r AS (SELECT name, coalesce(canonical, name) AS canonical FROM asked LEFT JOIN a ON lower(alias) = name) SELECT name, canonical, (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT r.canonical AS x UNION SELECT alias FROM a WHERE a.canonical = r.canonical)) AS names FROM r",
    "alias_suppressions": f"WITH {BASE} SELECT project, 'src' || ((CAST(substr(project, 4) AS INTEGER) + 1) % 20) AS now, count(*) AS documents FROM base WHERE ((CAST(substr(project, 4) AS INTEGER) + 1) % 20) % 5 = 0 AND 'src' || ((CAST(substr(project, 4) AS INTEGER) + 1) % 20) IN (SELECT DISTINCT source FROM documents) GROUP BY 1, 2",
    "session_transcripts": f"WITH {RECORDS}, f AS (SELECT session, arg_min(cwd, seq) FILTER (cwd IS NOT NULL) AS cwd, arg_min(title, seq) FILTER (title IS NOT NULL) AS title, min(stamp) AS started, max(stamp) AS ended, bool_or(side) AS sidechain, count(*) FILTER (is_meta) AS meta_records FROM rec GROUP BY 1), t AS (SELECT session, string_agg(role || ': ' || text, chr(10) || chr(10) ORDER BY seq) AS t FROM rec WHERE role IN ('user', 'assistant') AND NOT is_meta AND NOT tool AND trim(text) <> '' GROUP BY 1) SELECT f.*, sha256(t) AS text_hash FROM f LEFT JOIN t USING (session)",
    "canonical_thread": f"WITH RECURSIVE {EDGES} SELECT * FROM branches",
    "branch_points": f"WITH RECURSIVE {EDGES} SELECT * FROM points",
    "branch_share": f"WITH RECURSIVE {EDGES} SELECT branch, count(*) AS n, count(DISTINCT conv) AS conversations FROM branches GROUP BY 1",
    "latest_batch_wins": "WITH t AS (SELECT conv_id, count(*) AS turns FROM conversations GROUP BY 1) SELECT conv_id, turns + CASE WHEN conv_id % 3 = 0 THEN 2 WHEN conv_id % 2 = 0 THEN 1 ELSE 0 END AS turns, CASE WHEN conv_id % 3 = 0 THEN 3 WHEN conv_id % 2 = 0 THEN 2 ELSE 1 END AS batch FROM t",
    "snapshot_diff": f"WITH {BASE}, {VERSIONS} SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'gone' WHEN o.content_hash <> n.content_hash THEN 'changed' WHEN abs(o.mtime - n.mtime) < 1e-6 AND o.size = n.size THEN 'same' ELSE 'touched' END AS state FROM old o FULL JOIN new n ON o.path = n.path",
    "upsert_merge": f"WITH {BASE}, {VERSIONS} SELECT path, content_hash, mtime FROM new UNION ALL SELECT path, content_hash, mtime FROM old WHERE path NOT IN (SELECT path FROM new)",
    "prune_missing": f"WITH {BASE}, {VERSIONS} SELECT path FROM old WHERE path IN (SELECT path FROM new) OR source_type NOT IN (SELECT DISTINCT source_type FROM new WHERE source_type IN ('curated', 'repo-doc', 'archive-doc'))",
    "unchanged_fast_path": f"WITH {BASE}, {VERSIONS} SELECT n.path FROM new n JOIN old o ON n.path = o.path WHERE abs(n.mtime - o.mtime) < 1e-6 AND n.size = o.size",
    "rehome_chunks": f"WITH RECURSIVE {CHUNKS}, {OCC} SELECT content_hash, path, ord FROM occ WHERE CAST(substr(path, 5) AS BIGINT) % 4 <> 0 QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY path, ord) = 1",
    "redact_text": f"WITH {redactions()} SELECT doc_id, sha256(text) AS text_hash, array_to_string(kinds, ',') AS kinds FROM r{len(MARKED)}",
    "redaction_totals": f"WITH {redactions()}, k AS (SELECT unnest(kinds) AS kind FROM r{len(MARKED)}) SELECT kind, count(*) AS documents FROM k GROUP BY 1",
    "html_scrub": scrub(),
    "html_escape": "SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) AS html_hash FROM pages",
    "doc_title_date": f"WITH b AS (SELECT doc_id, {BODY} AS text FROM documents) SELECT doc_id, CASE WHEN regexp_matches(text, '(?m)^#[ \\t]+(.+)$') THEN trim(regexp_extract(text, '(?m)^#[ \\t]+(.+)$', 1)) ELSE CASE WHEN doc_id % 5 = 0 THEN '2024-12-31-' ELSE '' END || 'note' || doc_id END AS title, CASE WHEN doc_id % 5 = 0 THEN '2024-12-31' WHEN doc_id % 4 = 0 THEN '2025-03-04' ELSE strftime(make_timestamp(doc_id * 86400000000), '%Y-%m-%d') END AS doc_date FROM b",
    "project_from_path": r"WITH p AS (SELECT page_id, regexp_extract(url, '^https?:/(/[^?#]*)', 1) AS path FROM pages), r AS (SELECT '/' || h AS root FROM (SELECT DISTINCT regexp_extract(path, '^/([^/]+)', 1) AS h FROM p ORDER BY h LIMIT 3)), q AS (SELECT p.*, root, root IS NOT NULL AS inside, substr(path, length(root) + 2) AS rest FROM p LEFT JOIN r ON path = root OR starts_with(path, root || '/')) SELECT page_id, path, CASE WHEN NOT inside THEN coalesce(nullif(regexp_extract(path, '/\.codex/worktrees/[^/]+/([^/]+)', 1), ''), nullif(regexp_extract(path, '/codex_projects/([^/]+)', 1), '')) WHEN rest = '' OR NOT contains(rest, '/') THEN '_loose' ELSE string_split(rest, '/')[1] END AS project FROM q",
    "recent_feed_topn": "WITH o AS (SELECT o_orderpriority AS project, strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderkey AS id FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) <= 12) SELECT * FROM o ORDER BY date DESC, id DESC LIMIT 36",
    "name_scan": f"WITH n AS (SELECT DISTINCT lower(array_to_string(regexp_extract_all(text, '[A-Za-z]+')[1:2], '_')) AS name FROM benchmark), l AS (SELECT doc_id AS path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents) SELECT DISTINCT name, path, CAST(l.n AS INTEGER) AS n FROM n, l WHERE {PLAIN.format('name')} <> '' AND contains(' ' || {PLAIN.format('line')} || ' ', ' ' || {PLAIN.format('name')} || ' ')",
    "embed_sign": "WITH t AS (SELECT doc_id, list_transform(string_split(lower(text), ''), lambda ch: ord(ch) % 16) AS c FROM documents), v AS (SELECT doc_id, list_transform(range(0, 16), lambda k: len(list_filter(c, lambda x: x = k))) AS v FROM t), n AS (SELECT doc_id, v, sqrt(list_sum(list_transform(v, lambda x: x::DOUBLE * x))) AS norm FROM v) SELECT doc_id, round(v[1] / norm, 6) AS v0, round(v[2] / norm, 6) AS v1, round(v[6] / norm, 6) AS v5, round(v[16] / norm, 6) AS v15 FROM n",
    "protected_names": f"WITH n AS (SELECT item_id, lower(array_to_string(regexp_extract_all(text, '[A-Za-z]+')[1:2], '_')) AS name FROM benchmark) SELECT DISTINCT name FROM n WHERE length(name) >= 7 AND name NOT IN ('the_first', 'in_the') AND name NOT IN (SELECT name FROM n WHERE item_id % 3 = 0)",
    "session_files": "SELECT conv_id % 50 AS session, max(conv_id + turn / 8.0) AS mtime, sum(length(text))::BIGINT AS size, sha256(string_agg(DISTINCT 'f/' || conv_id || '/' || turn, ',' ORDER BY 'f/' || conv_id || '/' || turn)) AS files FROM conversations GROUP BY 1",
    "distilled_names": "WITH d AS (SELECT DISTINCT source AS project FROM documents WHERE CAST(substr(source, 4) AS INTEGER) % 5 = 0) SELECT project FROM d UNION SELECT DISTINCT source FROM documents WHERE 'src' || ((CAST(substr(source, 4) AS INTEGER) + 1) % 20) IN (SELECT project FROM d)",
    "project_documents": f"SELECT count(*) AS documents FROM documents WHERE lower(source) IN ('{c.PROJECT}', 'src5')",
    "transcript_branches": f"WITH {BASE}, n AS (SELECT project, branch, count(*) AS documents FROM base WHERE source_type = 'transcript' GROUP BY 1, 2) SELECT project, branch, documents, round(documents / sum(documents) OVER (PARTITION BY project), 6)::DOUBLE AS share FROM n",
    "reattributed": f"WITH {BASE} SELECT path, CASE WHEN chunk_id % 8 = 4 THEN 'new' || (chunk_id % 3) ELSE project END AS project FROM base",
    "embed_sign_python": "WITH t AS (SELECT doc_id, list_transform(string_split(lower(substr(text, 1, 8000)), ''), lambda ch: ord(ch) % 16) AS c FROM documents), v AS (SELECT doc_id, list_transform(range(0, 16), lambda k: len(list_filter(c, lambda x: x = k))) AS v FROM t) SELECT CAST(doc_id AS VARCHAR) AS content_hash, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x::DOUBLE * x))), 4) AS v0 FROM v",
    "markdown_chunks": f"WITH RECURSIVE {MARKDOWN} SELECT doc_id, ord, length(text) AS n_chars, sha256(text) AS content_hash FROM out_",
}
# the same results by another way
ORACLES |= {"knn_clustered": ORACLES["knn_l2"], "knn_clustered_scoped": ORACLES["knn_scoped"]}
