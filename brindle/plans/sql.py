"""DuckDB SQL for the registered queries, written from the base tables. Where a query reads structure out of rendered Markdown,
its SQL takes the structure from the tables that were rendered, so the two sides share no steps."""

from __future__ import annotations

from brindle.config import SYNONYMS

# building blocks: common table expressions, each a name and its body

CHUNKS = r"""
body AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS b FROM documents WHERE text IS NOT NULL),
cut AS (SELECT doc_id, b, unnest(generate_series(0, CAST(ceil(greatest(length(b), 1) / 1200.0) AS BIGINT) - 1)) AS i FROM body WHERE b <> ''),
chunks AS (
  SELECT substr(sha1(CAST(doc_id AS VARCHAR) || '||' || CAST(i AS VARCHAR)), 1, 16) AS chunk_id, CAST(doc_id AS VARCHAR) AS doc_id,
         CAST(i AS INTEGER) AS part, substr(b, i * 1200 + 1, 1200) AS text FROM cut
)"""

QUERY_SET = r"""
bq AS (SELECT 'b' || CAST(item_id AS VARCHAR) AS query_id, text AS query FROM benchmark),
names AS (SELECT source, unnest(regexp_extract_all(text, '\b[A-Z][A-Z0-9_]{3,}\b')) AS name FROM documents),
nq AS (SELECT source AS query_id, 'where is ' || min(name) AS query FROM names WHERE name LIKE '%\_%' ESCAPE '\' OR length(name) >= 5 GROUP BY source),
queries AS (SELECT * FROM bq UNION ALL SELECT * FROM nq)"""

TERMS = r"""
words AS (SELECT chunk_id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') AS t FROM chunks),
size AS (SELECT count(*) AS n_chunks, avg(len(t)) AS mean_terms FROM words),
tf AS (SELECT chunk_id, term, any_value(d) AS d, count(*) AS f FROM (SELECT chunk_id, len(t) AS d, unnest(t) AS term FROM words) GROUP BY chunk_id, term),
asked AS (
  SELECT query_id, i AS phrase, regexp_extract_all(strip_accents(lower(tokens[i])), '[\p{L}\p{N}]+')[1] AS term
  FROM (SELECT query_id, tokens, unnest(generate_series(1, len(tokens))) AS i FROM (SELECT query_id, regexp_split_to_array(query, '\s+') AS tokens FROM queries))
)"""

BM25 = (
    TERMS
    + r""",
found AS (SELECT query_id, phrase, chunk_id, d, f FROM asked JOIN tf USING (term)),
np AS (SELECT query_id, phrase, count(*) AS n_p FROM found GROUP BY query_id, phrase),
part AS (
  SELECT query_id, phrase, chunk_id,
         CASE WHEN ln((n_chunks - n_p + 0.5) / (n_p + 0.5)) > 0 THEN ln((n_chunks - n_p + 0.5) / (n_p + 0.5)) ELSE 1e-6 END
         * f * 2.2 / (f + 1.2 * (1 - 0.75 + 0.75 * d / mean_terms)) AS s
  FROM found JOIN np USING (query_id, phrase), size
),
ft AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, chunk_id) AS INTEGER) AS rank
  FROM (SELECT query_id, chunk_id, round(-sum(s ORDER BY phrase), 12) AS score FROM part GROUP BY query_id, chunk_id)
  QUALIFY rank <= 10
)"""
)

VECTOR = r"""
chars AS (SELECT chunk_id AS k, ('0x' || md5(c)[31:32])::INTEGER % 128 AS dim FROM (SELECT chunk_id, unnest(string_split(text, '')) AS c FROM chunks)),
cv AS (SELECT k, dim, CAST(count(*) AS DOUBLE) AS n FROM chars GROUP BY k, dim),
cn AS (SELECT k, sqrt(sum(n * n)) AS norm FROM cv GROUP BY k),
qchars AS (SELECT query_id AS q, ('0x' || md5(c)[31:32])::INTEGER % 128 AS dim FROM (SELECT query_id, unnest(string_split(query, '')) AS c FROM queries)),
qv AS (SELECT q, dim, CAST(count(*) AS DOUBLE) AS n FROM qchars GROUP BY q, dim),
qn AS (SELECT q, sqrt(sum(n * n)) AS norm FROM qv GROUP BY q),
dots AS (SELECT q, k, sum(qv.n * cv.n) AS dot FROM qv JOIN cv USING (dim) GROUP BY q, k),
sims AS (SELECT q AS query_id, k AS chunk_id, round(dot / (qn.norm * cn.norm), 9) AS score FROM dots JOIN qn USING (q) JOIN cn USING (k)),
vec AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM sims QUALIFY rank <= 10
)"""

IDENTIFIERS = r"""
raw AS (
  SELECT {key}, t FROM (SELECT {key}, unnest(regexp_extract_all(text, '\b[A-Z][A-Z0-9_]{{3,}}\b')) AS t FROM {table}) WHERE contains(t, '_') OR length(t) >= 5
  UNION SELECT {key}, t FROM (SELECT {key}, unnest(regexp_extract_all(text, '[A-Za-z0-9_-]+(?:[./][A-Za-z0-9_-]+)*\.[A-Za-z0-9]+')) AS t FROM {table})
  WHERE lower(regexp_extract(t, '[^.]*$')) IN ('json','yml','yaml','toml','ini','conf','env','md','txt','sh','ps1','py','js','ts','tsx','jsx','go','java','rs','sql','log')
  UNION SELECT {key}, trim(t) FROM (SELECT {key}, unnest(regexp_extract_all(text, '`([^`\n]+)`', 1)) AS t FROM {table}) WHERE trim(t) <> ''
)"""

_NORMAL = r"trim(regexp_replace(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_.\-]+', ' ', 'g'), '\s+', ' ', 'g'))"

GRAPH = (
    IDENTIFIERS.format(key="chunk_id", table="chunks")
    + rf""",
aliases AS (SELECT alias, min(t) AS canonical FROM (SELECT t, t AS alias FROM raw UNION SELECT t, lower(t) FROM raw) GROUP BY alias),
matched AS (
  SELECT DISTINCT query_id, canonical FROM (SELECT query_id, {_NORMAL.format(x="query")} AS q FROM queries), (SELECT {_NORMAL.format(x="alias")} AS a, canonical FROM aliases)
  WHERE a <> '' AND contains(' ' || q || ' ', ' ' || a || ' ')
),
gr AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank
  FROM (SELECT query_id, chunk_id, CAST(count(*) AS DOUBLE) AS score FROM matched JOIN (SELECT DISTINCT chunk_id, t FROM raw) r ON r.t = canonical GROUP BY query_id, chunk_id)
  QUALIFY rank <= 10
)"""
)

ROUTE = r"""
lex AS (
  SELECT query_id, regexp_matches(query, '`[^`]+`') OR regexp_matches(query, '[A-Za-z0-9]+_[A-Za-z0-9]+') OR regexp_matches(query, '[a-z][A-Z]')
         OR regexp_matches(query, '(^|[^\p{L}\p{N}_])[A-Z]{2,}($|[^\p{L}\p{N}_])') AS lexical FROM queries
),
dom AS (SELECT query_id, count(*) >= 3 AND median(score) - arg_min(score, rank) > 3.0 AS dominant FROM ft GROUP BY query_id),
routed AS (
  SELECT query_id, path, CASE path WHEN 'fulltext' THEN 0.05e0 * CASE WHEN lexical OR coalesce(dominant, false) THEN 1.8e0 ELSE 1e0 END
                                   WHEN 'vector' THEN 0.85e0 * CASE WHEN lexical OR coalesce(dominant, false) THEN 0.6e0 ELSE 1e0 END ELSE 0.10e0 END AS weight
  FROM lex LEFT JOIN dom USING (query_id), (SELECT unnest(['fulltext', 'graph', 'vector']) AS path)
)"""


def fuse(hits: str, name: str) -> str:
    """Fusion of ``hits`` (query_id, path, chunk_id, rank, weight)."""
    return f"""
{name} AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, chunk_id) AS INTEGER) AS rank
  FROM (SELECT query_id, chunk_id, sum(weight / (60 + rank) ORDER BY path) AS rrf_score, string_agg(path, ',' ORDER BY path) AS sources FROM {hits} WHERE weight > 0 GROUP BY query_id, chunk_id)
)"""


ALL_HITS = """
hits AS (
  SELECT query_id, 'fulltext' AS path, chunk_id, rank FROM ft UNION ALL SELECT query_id, 'graph', chunk_id, rank FROM gr UNION ALL SELECT query_id, 'vector', chunk_id, rank FROM vec
)"""

# the labelled questions: answers are the chunks with all words of the item in a row
QUESTIONS = r"""
queries AS (SELECT 'b' || CAST(item_id AS VARCHAR) AS query_id, text AS query FROM benchmark)"""

ANSWERS = r"""
flat AS (SELECT chunk_id, ' ' || array_to_string(t, ' ') || ' ' AS line FROM words),
sought AS (SELECT query_id, ' ' || array_to_string(regexp_extract_all(strip_accents(lower(query)), '[\p{L}\p{N}]+'), ' ') || ' ' AS p FROM queries),
answers AS (SELECT query_id, chunk_id FROM sought, flat WHERE contains(line, p)),
questions AS (
  SELECT query_id, ['A', 'B', 'C', 'D'][CAST(substr(query_id, 2) AS INTEGER) % 4 + 1] AS category, count(chunk_id) AS n_answers
  FROM queries LEFT JOIN answers USING (query_id) GROUP BY query_id
)"""

TWO_HITS = """
hits AS (SELECT query_id, 'fulltext' AS path, chunk_id, rank FROM ft UNION ALL SELECT query_id, 'vector', chunk_id, rank FROM vec),
plain AS (SELECT *, 1e0 AS weight FROM hits)"""


def measured(lists: str, rows: str) -> str:
    """Measures of ``lists`` (query_id, row, chunk_id, rank) for every question and every row of ``rows`` (row)."""
    return f"""
good AS (SELECT l.query_id, l.row, l.rank FROM {lists} l JOIN answers a ON a.query_id = l.query_id AND a.chunk_id = l.chunk_id),
each AS (
  SELECT q.query_id, category, r.row,
         CASE WHEN n_answers = 0 THEN 0e0 ELSE count(*) FILTER (g.rank <= 1) / n_answers END AS r1,
         CASE WHEN n_answers = 0 THEN 0e0 ELSE count(*) FILTER (g.rank <= 5) / n_answers END AS r5,
         CASE WHEN n_answers = 0 THEN 0e0 ELSE count(*) FILTER (g.rank <= 10) / n_answers END AS r10,
         coalesce(1e0 / min(g.rank), 0e0) AS mrr
  FROM questions q CROSS JOIN {rows} r LEFT JOIN good g ON g.query_id = q.query_id AND g.row = r.row
  GROUP BY q.query_id, category, r.row, n_answers
)"""


BASE = f"WITH {CHUNKS}, {QUERY_SET}, {BM25}"
EVAL = f"WITH {CHUNKS}, {QUESTIONS}, {BM25}, {VECTOR}, {ANSWERS}, {TWO_HITS}, {fuse('plain', 'fused')}"
FOUR = "(SELECT unnest(['vector', 'fulltext', 'graph', 'fused']) AS row)"
EVAL_LISTS = f"""{EVAL}, lists AS (SELECT query_id, path AS row, chunk_id, rank FROM hits UNION ALL SELECT query_id, 'fused', chunk_id, rank FROM fused), {measured("lists", FOUR)}"""
MATRIX = f"""{EVAL_LISTS},
means AS (SELECT category, row, avg(r1) AS a, avg(r5) AS b, avg(r10) AS c, avg(mrr) AS m FROM each GROUP BY category, row),
matrix AS (
  SELECT category, row, 'recall@1' AS metric, round(a, 9) AS value FROM means UNION ALL SELECT category, row, 'recall@5', round(b, 9) FROM means
  UNION ALL SELECT category, row, 'recall@10', round(c, 9) FROM means UNION ALL SELECT category, row, 'mrr', round(m, 9) FROM means
),
gains AS (
  SELECT category, max(value) FILTER (row = 'fused') AS fused, max(value) FILTER (row <> 'fused') AS best FROM matrix WHERE metric = 'recall@5' GROUP BY category
)"""

STATIC_HITS = "s AS (SELECT *, CASE path WHEN 'fulltext' THEN 0.05e0 WHEN 'vector' THEN 0.85e0 ELSE 0.1e0 END AS weight FROM hits)"
SIX = "(SELECT unnest(['vector', 'fulltext', 'graph', 'fused_equal', 'fused_static', 'fused_routed']) AS row)"

# the handbook, from the tables it is rendered from
HANDBOOK = r"""
rows AS (
  SELECT lower(r_name) || '/' || n_nationkey || '-' || (c_custkey // 1000) || '.md' AS doc_id, r_name AS r, n_name AS n, n_nationkey AS k, c_custkey, c_name, c_mktsegment
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
),
pages AS (
  SELECT doc_id, r, n, k, string_agg('| ' || c_custkey || ' | ' || c_name || ' | ' || c_mktsegment || ' |', chr(10) ORDER BY c_custkey) AS lines,
         'Home of customers, see `' || lower(n) || '` and CODE_' || k || '.' AS home, 'Lists customers of ' || n || ' by market.' AS told FROM rows GROUP BY ALL
),
places AS (SELECT DISTINCT r, n, k FROM pages),
funcs AS (SELECT *, 'list_' || k AS short, n || '.list_' || k AS canonical, 'list_' || k || '(limit=10, *market)' AS title FROM places),
upper_names AS (SELECT DISTINCT r, unnest(regexp_extract_all(r, '\b[A-Z][A-Z0-9_]{3,}\b')) AS t FROM places),
r_tokens AS (SELECT r, t FROM upper_names WHERE contains(t, '_') OR length(t) >= 5),
segments AS (SELECT n_name AS n, c_mktsegment AS t FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE length(c_mktsegment) >= 5 GROUP BY ALL),
tokens AS (
  SELECT r_tokens.t, n AS leaf FROM r_tokens JOIN places USING (r) UNION SELECT n, n FROM places UNION SELECT 'CODE_' || k, n FROM places UNION SELECT lower(n), n FROM places
  UNION SELECT t, n FROM segments UNION SELECT r_tokens.t, title FROM r_tokens JOIN funcs USING (r) UNION SELECT n, title FROM funcs
),
edges AS (
  SELECT n AS src, r AS dst, 'belongs_to' AS kind FROM places UNION SELECT canonical, n, 'belongs_to' FROM funcs UNION SELECT canonical, 'limit', 'has_parameter' FROM funcs
  UNION SELECT canonical, 'market', 'has_parameter' FROM funcs UNION SELECT t, leaf, 'mentioned_in' FROM tokens
),
named AS (
  SELECT t AS canonical, 4 AS o, 'identifier' AS kind, t AS alias FROM tokens UNION SELECT t, 4, 'identifier', lower(t) FROM tokens UNION SELECT r, 1, 'section', NULL FROM places
  UNION SELECT n, 1, 'section', NULL FROM places UNION SELECT canonical, 2, 'function', short FROM funcs UNION SELECT unnest(['limit', 'market']), 3, 'parameter', NULL
),
nodes AS (SELECT canonical, arg_min(kind, o) AS kind, coalesce(string_agg(DISTINCT alias, ',' ORDER BY alias), '') AS aliases FROM named GROUP BY canonical),
alias_map AS (SELECT alias, min(canonical) AS canonical FROM (SELECT canonical AS alias, canonical FROM nodes UNION SELECT alias, canonical FROM named WHERE alias IS NOT NULL) GROUP BY alias),
near AS (SELECT src AS entity, dst AS neighbour FROM edges UNION SELECT dst, src FROM edges)"""

ORACLES: dict[str, str] = {
    "chunk_documents": f"WITH {CHUNKS} SELECT chunk_id, doc_id, part, part AS idx, 'text' AS kind, text FROM chunks",
    "over_cap": r"""SELECT round(coalesce(avg(CASE WHEN length(b) > 1200 THEN 1.0 ELSE 0.0 END), 0), 9)::DOUBLE AS over_cap_ratio, count(*) AS n_sections
FROM (SELECT regexp_replace(text, '^\s+|\s+$', '', 'g') AS b FROM documents) WHERE b <> ''""",
    "markdown_sections": f"""WITH {HANDBOOK}, titled AS (SELECT *, 'list_' || k || '(limit=10, *market)' AS f FROM pages)
SELECT doc_id, 0 AS section, 1 AS level, r AS title, r AS path, '' AS text FROM titled
UNION ALL SELECT doc_id, 1, 2, n, r || ' > ' || n, home || chr(10) || chr(10) || '| c_custkey | c_name | segment |' || chr(10) || '|---|:-:|---|' || chr(10) || lines FROM titled
UNION ALL SELECT doc_id, 2, 3, f, r || ' > ' || n || ' > ' || f, told FROM titled""",
    "markdown_elements": f"""WITH {HANDBOOK}
SELECT doc_id, 0 AS "order", 'text' AS kind, r || ' > ' || n AS path, home AS text FROM pages
UNION ALL SELECT doc_id, 1, 'table', r || ' > ' || n, '| c_custkey | c_name | segment |' || chr(10) || '| --- | --- | --- |' || chr(10) || lines FROM pages
UNION ALL SELECT doc_id, 2, 'text', r || ' > ' || n || ' > ' || 'list_' || k || '(limit=10, *market)', told FROM pages""",
    "markdown_table_rows": f"WITH {HANDBOOK} SELECT doc_id, n AS nation, c_custkey, c_name, c_mktsegment AS segment FROM rows",
    "table_part_sizes": f"WITH {HANDBOOK} SELECT doc_id, true AS fits, true AS headed, count(*) AS tables FROM pages GROUP BY doc_id",
    "document_terms": r"SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+')) AS term FROM documents) GROUP BY term",
    "document_identifiers": f"WITH {IDENTIFIERS.format(key='doc_id', table='documents')} SELECT doc_id, t AS token FROM raw",
    "lexical_queries": f"WITH {CHUNKS}, {QUERY_SET}, {BM25}, {ROUTE} SELECT query_id, lexical FROM lex",
    "query_normal": f"SELECT conv_id, turn, {_NORMAL.format(x='text')} AS normal FROM conversations",
    "bm25_search": f"{BASE} SELECT query_id, chunk_id, rank, round(score, 9) AS score FROM ft",
    "bm25_phrases": f"""WITH {CHUNKS}, {QUESTIONS}, {TERMS}, {ANSWERS}
SELECT query_id, chunk_id, CAST((length(line) - length(replace(line, p, ''))) / length(p) AS BIGINT) AS f FROM answers JOIN sought USING (query_id) JOIN flat USING (chunk_id)""",
    "vector_search": f"WITH {CHUNKS}, {QUERY_SET}, {VECTOR} SELECT query_id, chunk_id, rank, score FROM vec",
    "embedding_neighbours": """
WITH e AS (SELECT CAST(vec_id AS VARCHAR) AS id, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT q.id AS query_id, e.id AS vec_id, round(list_cosine_similarity(q.v, e.v), 6) AS score FROM e q, e WHERE q.vec_id % 100 = 0)
SELECT query_id, vec_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, score FROM s QUALIFY rank <= 10""",
    "graph_search": f"WITH {CHUNKS}, {QUERY_SET}, {GRAPH} SELECT query_id, chunk_id, rank, score FROM gr",
    "graph_nodes": f"WITH {HANDBOOK} SELECT * FROM nodes",
    "graph_edges": f"WITH {HANDBOOK} SELECT * FROM edges",
    "graph_aliases": f"WITH {HANDBOOK} SELECT * FROM alias_map",
    "graph_neighbours": f"WITH {HANDBOOK} SELECT * FROM near",
    "graph_parameters": f"WITH {HANDBOOK} SELECT src AS entity, dst AS parameter FROM edges WHERE kind = 'has_parameter'",
    "graph_expansion": rf"""WITH {HANDBOOK},
m AS (
  SELECT DISTINCT n_name AS query_id, canonical AS entity FROM nation, (SELECT {_NORMAL.format(x="alias")} AS a, canonical FROM alias_map)
  WHERE contains(' ' || {_NORMAL.format(x="'Who lives in ' || n_name || '?'")} || ' ', ' ' || a || ' ')
)
SELECT * FROM m UNION SELECT query_id, neighbour FROM m JOIN near USING (entity)""",
    "fused_search": f"""{BASE}, {VECTOR}, {GRAPH}, {ROUTE}, {ALL_HITS}, w AS (SELECT * FROM hits JOIN routed USING (query_id, path)), {fuse("w", "fused")}
SELECT query_id, chunk_id, doc_id, rank, round(rrf_score, 9) AS rrf_score, sources FROM fused JOIN chunks USING (chunk_id)""",
    "found_lines": rf"""{BASE}, flat AS (SELECT chunk_id, doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM chunks)
SELECT query_id, rank, chunk_id || ' · ' || doc_id || ' · p? · ' || CASE WHEN length(t) > 80 THEN substr(t, 1, 80) || '…' ELSE t END AS line FROM ft JOIN flat USING (chunk_id) WHERE rank <= 5""",
    "fused_equal": f"""{BASE}, {GRAPH},
w AS (SELECT query_id, 'fulltext' AS path, chunk_id, rank, 1e0 AS weight FROM ft UNION ALL SELECT query_id, 'graph', chunk_id, rank, 1e0 FROM gr), {fuse("w", "fused")}
SELECT query_id, chunk_id, rank, round(rrf_score, 9) AS rrf_score FROM fused""",
    "routed_weights": f"{BASE}, {ROUTE} SELECT query_id, path, round(weight, 9) AS weight FROM routed",
    "reranked_search": rf"""{BASE},
tok AS (SELECT query_id, chunk_id, rank AS before, list_distinct(regexp_split_to_array(lower(query), '\s+')) AS a, list_filter(list_distinct(regexp_split_to_array(lower(text), '\s+')), lambda x: x <> '') AS b
  FROM ft JOIN queries USING (query_id) JOIN chunks USING (chunk_id)),
sc AS (SELECT query_id, chunk_id, before, len(list_intersect(a, b)) / len(a) AS s FROM tok)
SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, before) AS INTEGER) AS rank, round(s, 9) AS score FROM sc""",
    "evaluation_matrix": f"{MATRIX} SELECT * FROM matrix",
    "evaluation_gains": f"""{MATRIX}
SELECT category, fused, best, round(fused - best, 9) AS gain, CASE WHEN fused < best THEN '回退' WHEN fused > best THEN '提升' ELSE '持平' END AS verdict FROM gains""",
    "evaluation_discrimination": f"""{MATRIX}
SELECT category, round(max(value) - min(value), 9) AS spread, max(value) - min(value) < 0.05 AS warns FROM matrix WHERE metric = 'recall@5' AND row <> 'fused' GROUP BY category""",
    "evaluation_accepted": f"""{MATRIX}
SELECT coalesce(bool_and(fused >= best), false) AND coalesce(bool_and(fused > best) FILTER (category = 'C'), false) AND coalesce(bool_and(fused > best) FILTER (category = 'D'), false) AS accepted,
       count(*) AS n_categories FROM gains""",
    "evaluation_rows": f"""{EVAL}, {ROUTE}, {STATIC_HITS}, {fuse("s", "fixed")}, rt AS (SELECT * FROM hits JOIN routed USING (query_id, path)), {fuse("rt", "adaptive")},
lists AS (
  SELECT query_id, path AS row, chunk_id, rank FROM hits UNION ALL SELECT query_id, 'fused_equal', chunk_id, rank FROM fused WHERE rank <= 10
  UNION ALL SELECT query_id, 'fused_static', chunk_id, rank FROM fixed WHERE rank <= 10 UNION ALL SELECT query_id, 'fused_routed', chunk_id, rank FROM adaptive WHERE rank <= 10
), {measured("lists", SIX)}
SELECT row, round(avg(r1), 9) AS recall_1, round(avg(r5), 9) AS recall_5, round(avg(r10), 9) AS recall_10, round(avg(mrr), 9) AS mrr, count(*) AS n FROM each GROUP BY row""",
    "weight_search": f"""{EVAL}, grid AS (SELECT v, f, 20 - v - f AS g FROM generate_series(0, 20) a(v), generate_series(0, 20) b(f) WHERE v + f <= 20),
wh AS (SELECT v, f, g, query_id, path, chunk_id, rank, CASE path WHEN 'fulltext' THEN f WHEN 'vector' THEN v ELSE g END * 0.05e0 AS weight FROM hits, grid),
fu AS (SELECT v, f, g, query_id, chunk_id, sum(round(weight, 10) / (60 + rank) ORDER BY path) AS s FROM wh WHERE weight > 0 GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY v, f, g, query_id ORDER BY s DESC, chunk_id) AS rank FROM fu QUALIFY rank <= 5),
sc AS (
  SELECT v, f, g, q.query_id, CASE WHEN n_answers = 0 THEN 0e0 ELSE count(a.chunk_id) / n_answers END AS r, coalesce(1e0 / min(CASE WHEN a.chunk_id IS NOT NULL THEN rk.rank END), 0e0) AS m
  FROM grid CROSS JOIN questions q LEFT JOIN rk USING (v, f, g, query_id) LEFT JOIN answers a ON a.query_id = rk.query_id AND a.chunk_id = rk.chunk_id GROUP BY v, f, g, q.query_id, n_answers
)
SELECT round(v * 0.05, 10)::DOUBLE AS vector, round(f * 0.05, 10)::DOUBLE AS fulltext, round(g * 0.05, 10)::DOUBLE AS graph, round(avg(r), 9) AS recall, round(avg(m), 9) AS mrr FROM sc GROUP BY v, f, g""",
    "best_weights": "",
    "fusion_criterion": f"""{EVAL}, {ROUTE}, rt AS (SELECT * FROM hits JOIN routed USING (query_id, path)), {fuse("rt", "adaptive")},
lists AS (SELECT query_id, path AS row, chunk_id, rank FROM hits UNION ALL SELECT query_id, 'fused_routed', chunk_id, rank FROM adaptive WHERE rank <= 10),
{measured("lists", "(SELECT unnest(['vector', 'fulltext', 'graph', 'fused_routed']) AS row)")},
m AS (SELECT row, round(avg(r5), 9) AS v FROM each GROUP BY row),
b AS (SELECT row, v FROM m WHERE row <> 'fused_routed' ORDER BY v DESC, CASE row WHEN 'vector' THEN 0 WHEN 'fulltext' THEN 1 ELSE 2 END LIMIT 1)
SELECT b.row AS best_row, b.v AS best, m.v AS fused, m.v >= b.v AS met FROM b, m WHERE m.row = 'fused_routed'""",
    "weight_grid": """SELECT round(v * 0.05, 10)::DOUBLE AS vector, round(f * 0.05, 10)::DOUBLE AS fulltext, round((20 - v - f) * 0.05, 10)::DOUBLE AS graph
FROM generate_series(0, 20) a(v), generate_series(0, 20) b(f) WHERE v + f <= 20""",
    "rerank_comparison": f"""{EVAL}, lists AS (SELECT query_id, path AS row, chunk_id, rank FROM hits), {measured("lists", "(SELECT unnest(['vector', 'fulltext']) AS row)")},
p AS (SELECT query_id, category, max(r5) FILTER (row = 'vector') AS br, max(r5) FILTER (row = 'fulltext') AS rr, max(mrr) FILTER (row = 'vector') AS bm, max(mrr) FILTER (row = 'fulltext') AS rm FROM each GROUP BY ALL)
SELECT category, grouping(category) = 1 AS pooled, round(avg(br), 9) AS base_recall_5, round(avg(bm), 9) AS base_mrr, round(avg(rr), 9) AS rerank_recall_5, round(avg(rm), 9) AS rerank_mrr, count(*) AS n
FROM p GROUP BY GROUPING SETS ((category), ())""",
    "event_percentiles": """
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS pos, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, max(value) FILTER (pos = CAST(round_even(0.5 * (n - 1), 0) AS BIGINT)) AS p50, max(value) FILTER (pos = CAST(round_even(0.95 * (n - 1), 0) AS BIGINT)) AS p95,
       max(value) FILTER (pos = CAST(round_even(0.99 * (n - 1), 0) AS BIGINT)) AS p99, count(*) AS n FROM r GROUP BY event_type""",
    "event_load": "",
    "synonym_rewrites": f"""
WITH c AS (SELECT conv_id, turn, {[*SYNONYMS, "x"]}[(conv_id * 7 + turn) % {len(SYNONYMS) + 1} + 1] || ' ' || text AS said FROM conversations)
SELECT conv_id, turn, CASE {" ".join(f"WHEN contains(said, '{k}') THEN replace(said, '{k}', '{v[0]}')" for k, v in SYNONYMS.items())} ELSE said END AS said,
       {" OR ".join(f"contains(said, '{k}')" for k in SYNONYMS)} AS changed FROM c""",
    "paragraph_chunks": r"""
WITH RECURSIVE t AS (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS p FROM conversations WHERE text IS NOT NULL),
cut AS (SELECT conv_id, turn, p, unnest(generate_series(0, CAST(ceil(length(p) / 1200.0) AS BIGINT) - 1)) AS j FROM t WHERE p <> ''),
pieces AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, p, j) AS i, substr(p, j * 1200 + 1, 1200) AS p FROM cut),
fold AS (
  SELECT conv_id, i, p AS now, 0 AS part FROM pieces WHERE i = 1
  UNION ALL
  SELECT f.conv_id, q.i, CASE WHEN length(f.now) + 2 + length(q.p) <= 1200 THEN f.now || chr(10) || chr(10) || q.p ELSE q.p END,
         CASE WHEN length(f.now) + 2 + length(q.p) <= 1200 THEN part ELSE part + 1 END
  FROM fold f JOIN pieces q ON q.conv_id = f.conv_id AND q.i = f.i + 1
)
SELECT CAST(conv_id AS VARCHAR) AS doc_id, part, arg_max(now, i) AS text FROM fold GROUP BY conv_id, part""",
    "table_rows_whole": r"SELECT conv_id, turn, turn % 2 = 0 OR trim(regexp_replace(text, '[|\s]+', ' ', 'g')) = '' AS whole FROM conversations WHERE text IS NOT NULL",
    "event_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "label_sets": """
WITH r AS (SELECT conv_id % 2 AS s, text AS question, CASE WHEN role = 'user' THEN 'fact' ELSE 'unanswerable' END AS category FROM conversations),
sh AS (SELECT count(*) AS n_shared FROM (SELECT question FROM r WHERE s = 0 INTERSECT SELECT question FROM r WHERE s = 1))
SELECT CASE s WHEN 0 THEN 'dev' ELSE 'test' END AS dataset, count(*) AS n, count(*) FILTER (category = 'unanswerable') AS n_unanswerable, n_shared,
       count(*) >= 15 AND count(*) FILTER (category = 'unanswerable') >= 3 AND n_shared = 0 AS ok FROM r, sh GROUP BY s, n_shared""",
    "image_routing": """
WITH e AS (
  SELECT event_id, event_type, event_id % 7 AS n, ['ran', 'failed', 'unavailable'][event_id % 3 + 1] AS os, ['ran', 'failed', 'unavailable', 'ran'][event_id % 4 + 1] AS vs,
         ['图表', '照片', '截图', '其他'][event_id % 5 % 4 + 1] AS kind FROM events
), s AS (
  SELECT *, CASE WHEN os <> 'ran' THEN os WHEN n = 3 THEN 'empty' WHEN n = 4 THEN 'low_conf' ELSE 'ok' END AS o, CASE WHEN vs <> 'ran' THEN vs WHEN n = 2 THEN 'bad_json' ELSE 'ok' END AS v FROM e
), k AS (SELECT *, v IN ('ok', 'bad_json') AND (o <> 'ok' OR kind IN ('图表', '流程图', '照片')) AS kv FROM s)
SELECT event_id,
  '[图片] alt ' || event_type || CASE WHEN kv THEN chr(10) || '类型: ' || kind || chr(10) || '内容: ' || CASE WHEN n = 2 THEN 'raw answer' ELSE event_type END ELSE '' END
    || CASE WHEN o = 'ok' THEN chr(10) || '文字: a text that is long enough' ELSE '' END AS text,
  array_to_string(list_sort(list_filter([
    CASE WHEN o = 'failed' THEN 'ocr_failed' END, CASE v WHEN 'unavailable' THEN 'vlm_unavailable' WHEN 'failed' THEN 'vlm_failed' WHEN 'bad_json' THEN 'vlm_bad_json' END,
    CASE WHEN NOT kv AND o = 'low_conf' THEN 'ocr_low_conf' END, CASE WHEN NOT kv AND o NOT IN ('ok', 'low_conf', 'failed') THEN 'ocr_empty' END
  ], lambda x: x IS NOT NULL)), ',') AS degrade
FROM k""",
}
ORACLES["best_weights"] = f"""WITH w AS ({ORACLES["weight_search"]})
SELECT vector, fulltext, graph, recall, mrr FROM w ORDER BY CASE WHEN least(vector, fulltext, graph) >= 0.05 THEN 0 ELSE 1 END, recall DESC, fulltext, graph, vector LIMIT 1"""
ORACLES["event_load"] = f"""
WITH ok AS ({ORACLES["event_percentiles"].replace("FROM events WHERE value IS NOT NULL", "FROM events WHERE value IS NOT NULL AND user_id % 2 = 0")})
SELECT e.event_type, count(*) AS n, count(*) FILTER (user_id % 2 <> 0) AS errors, round(count(*) / 60e0, 9) AS qps, any_value(p50) AS p50, any_value(p95) AS p95, any_value(p99) AS p99
FROM events e LEFT JOIN ok USING (event_type) WHERE value IS NOT NULL GROUP BY e.event_type"""
