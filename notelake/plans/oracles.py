"""Independent DuckDB SQL for the catalogue's queries."""

from __future__ import annotations

from notelake.functions.analyzer import IE_NOUNS, IRREGULAR, S_FINAL, STOPWORDS

_MARKED, _PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def _list(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _tokens(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '[\n\r\p{{Z}}\p{{P}}\p{{Sm}}]+'), lambda t: t <> '')"


def _fold(x: str) -> str:
    return f"translate(lower({x}), '{_MARKED}', '{_PLAIN}')"


def _singular(w: str) -> str:
    irregular = " ".join(f"WHEN {w} = '{a}' THEN '{b}'" for a, b in IRREGULAR.items())
    cut = lambda k: f"substr({w}, 1, length({w}) - {k})"
    return (
        f"CASE WHEN length({w}) <= 3 THEN {w} {irregular} WHEN {w} IN {_list(S_FINAL)} THEN {w} "
        f"WHEN ends_with({w}, 'ies') AND length({w}) > 4 THEN (CASE WHEN {cut(1)} IN {_list(IE_NOUNS)} THEN {cut(1)} ELSE {cut(3)} || 'y' END) "
        f"WHEN ends_with({w}, 'sses') THEN {cut(2)} "
        f"WHEN regexp_matches({w}, '(ches|shes|xes|zes|ses)$') AND length({w}) > 4 THEN {cut(2)} "
        f"WHEN ends_with({w}, 's') AND NOT regexp_matches({w}, '(ss|us|is|os)$') THEN {cut(1)} ELSE {w} END"
    )


def _terms(x: str, keep: bool = False) -> str:
    low = f"list_transform({_tokens(x)}, lambda t: {_fold('t')})"
    kept = low if keep else f"list_filter({low}, lambda t: t NOT IN {_list(STOPWORDS)})"
    return f"list_transform({kept}, lambda w: {_singular('w')})"


_CHUNKS = """chunks AS (
  SELECT doc_id AS chunk_id, source || '/' || CAST(doc_id AS VARCHAR) || '.md' AS note_path, source AS title, lang, text AS content, n_chars,
    CASE WHEN doc_id % 10 <> 9 THEN TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL 1 HOUR END AS modified
  FROM documents
)"""

_FIELDS = f"""{_CHUNKS},
ft AS (
  SELECT chunk_id, 'title' AS field, {_terms('title', True)} AS terms FROM chunks
  UNION ALL SELECT chunk_id, 'tags', {_terms('lang')} FROM chunks
  UNION ALL SELECT chunk_id, 'content', {_terms('content')} FROM chunks
),
stats AS (SELECT field, count(*) AS n_docs, avg(len(terms)) AS avg_len FROM ft GROUP BY field),
post AS (SELECT term, field, chunk_id, count(*) AS tf FROM (SELECT chunk_id, field, unnest(terms) AS term FROM ft) x GROUP BY 1, 2, 3)"""

_QUERIES = "qt(query_id, pos, term) AS (VALUES (1, 0, 'tion'), (1, 1, 'reat'), (2, 0, 'ernde'), (2, 1, 'thing'), (2, 2, 'ention'), (3, 0, 'anon'), (3, 1, 'heat'))"

_SCORES = f"""{_FIELDS},
{_QUERIES},
df AS (SELECT term, field, count(*) AS df FROM post GROUP BY 1, 2),
ts AS (
  SELECT p.term AS term, p.chunk_id AS chunk_id,
    sum(CASE p.field WHEN 'title' THEN 10e0 ELSE 3e0 END * ln(1e0 + (n_docs - df + 0.5e0) / (df + 0.5e0))
      * (0.5e0 + tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * len(terms) / avg_len)))) AS score
  FROM post p JOIN ft USING (chunk_id, field) JOIN df USING (term, field) JOIN stats USING (field)
  WHERE p.term IN (SELECT term FROM qt) GROUP BY 1, 2
),
idx AS (SELECT query_id, count(DISTINCT term) AS n FROM qt WHERE term IN (SELECT term FROM ts) GROUP BY 1),
hits AS (
  SELECT qt.query_id AS query_id, chunk_id, sum(score) AS score, CASE WHEN max(n) <= 1 THEN 1e0 ELSE least(1e0, count(DISTINCT qt.term) / max(n)) END AS coverage
  FROM ts JOIN (SELECT DISTINCT query_id, term FROM qt) qt USING (term) JOIN idx USING (query_id) GROUP BY 1, 2
),
bound AS (
  SELECT query_id, sum(coalesce(top, 0)) AS bound FROM qt LEFT JOIN (SELECT term, max(score) AS top FROM ts GROUP BY 1) b USING (term) GROUP BY 1
)"""

# The index of all fields: derived forms, and accents stripped by DuckDB itself.
_WORD = r"[^\n\r\p{Z}\p{P}\p{Sm}]+"


def _all_terms(x: str, keep: bool = False) -> str:
    bare = rf"regexp_replace({x}, '(\p{{L}})[''’]s([^\p{{L}}\p{{N}}]|$)', '\1\2', 'g')"
    glued = rf"list_transform(regexp_extract_all({bare}, '{_WORD}(?:[-/.''’]{_WORD})+'), lambda g: regexp_replace(g, '[-/.''’]', '', 'g'))"
    split = r"string_split(regexp_replace(regexp_replace(c, '(\p{Ll})(\p{Lu})', '\1 \2', 'g'), '(\p{Lu})(\p{Lu}\p{Ll})', '\1 \2', 'g'), ' ')"
    parts = f"flatten(list_filter(list_transform({_tokens(bare)}, lambda c: {split}), lambda p: len(p) > 1))"
    low = f"list_transform(list_concat({_tokens(bare)}, {glued}, {parts}), lambda t: strip_accents(lower(t)))"
    kept = low if keep else f"list_filter({low}, lambda t: t NOT IN {_list(STOPWORDS)})"
    return f"list_transform({kept}, lambda w: {_singular('w')})"


_INDEX = f"""{_CHUNKS},
ft AS (
  SELECT chunk_id, 'title' AS field, {_all_terms('title', True)} AS terms FROM chunks
  UNION ALL SELECT chunk_id, 'aliases', {_all_terms("lang || ' ' || title", True)} FROM chunks
  UNION ALL SELECT chunk_id, 'tags', {_all_terms('lang')} FROM chunks
  UNION ALL SELECT chunk_id, 'properties', {_all_terms('lang')} FROM chunks
  UNION ALL SELECT chunk_id, 'content', {_all_terms('content')} FROM chunks
),
stats AS (SELECT field, count(*) AS n_docs, avg(len(terms)) AS avg_len FROM ft GROUP BY field),
post AS (SELECT term, field, chunk_id, count(*) AS tf FROM (SELECT chunk_id, field, unnest(terms) AS term FROM ft) x GROUP BY 1, 2, 3)"""

_EXPANDED = f"""{_INDEX},
{_QUERIES},
vocab AS (SELECT DISTINCT term FROM post),
own AS (SELECT DISTINCT query_id, term AS source FROM qt),
ends AS (SELECT query_id, max_by(term, pos) AS source FROM qt GROUP BY 1),
begun AS (SELECT query_id, source, term, 0.375e0 * length(source) / length(term) AS weight FROM ends, vocab WHERE length(source) >= 3 AND starts_with(term, source) AND term <> source),
typos AS (SELECT query_id, source, term, 0.45e0 * length(term) / (length(term) + levenshtein(source, term)) AS weight FROM own, vocab
  WHERE NOT regexp_matches(source, '[0-9]') AND levenshtein(source, term) BETWEEN 1 AND CASE WHEN length(source) <= 2 THEN 0 WHEN length(source) <= 5 THEN 1 ELSE 2 END),
syn(token, mate) AS (VALUES ('tion', 'ention'), ('tion', 'reat'), ('heat', 'thing')),
forms AS (
  SELECT query_id, source, source AS term, 1e0 AS weight FROM own UNION ALL SELECT * FROM begun
  UNION ALL SELECT * FROM typos t WHERE NOT EXISTS (SELECT 1 FROM begun b WHERE b.query_id = t.query_id AND b.source = t.source AND b.term = t.term)
  UNION ALL SELECT query_id, min(source), mate, 0.8e0 FROM own JOIN syn ON source = token WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.query_id = own.query_id AND o.source = mate) GROUP BY query_id, mate
),
df AS (SELECT term, field, count(*) AS df FROM post GROUP BY 1, 2),
ts AS (
  SELECT p.term AS term, p.chunk_id AS chunk_id,
    sum(CASE p.field WHEN 'title' THEN 10e0 WHEN 'aliases' THEN 6e0 WHEN 'properties' THEN 2e0 ELSE 3e0 END * ln(1e0 + (n_docs - df + 0.5e0) / (df + 0.5e0))
      * (0.5e0 + tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * len(terms) / avg_len)))) AS score
  FROM post p JOIN ft USING (chunk_id, field) JOIN df USING (term, field) JOIN stats USING (field)
  WHERE p.term IN (SELECT term FROM forms) GROUP BY 1, 2
),
idx AS (SELECT query_id, count(DISTINCT source) AS n FROM own WHERE source IN (SELECT term FROM vocab) GROUP BY 1),
hits AS (
  SELECT f.query_id AS query_id, chunk_id, sum(score * weight) AS score, CASE WHEN coalesce(max(n), 0) <= 1 THEN 1e0 ELSE least(1e0, count(DISTINCT source) / max(n)) END AS coverage
  FROM ts JOIN forms f USING (term) LEFT JOIN idx ON idx.query_id = f.query_id GROUP BY 1, 2
),
bound AS (
  SELECT query_id, sum(coalesce(top, 0)) AS bound FROM qt LEFT JOIN (SELECT term, max(score) AS top FROM ts GROUP BY 1) b USING (term) GROUP BY 1
)"""

_VECTORS = "v AS (SELECT vec_id AS chunk_id, embedding AS vec FROM embeddings), q AS (SELECT vec_id + 1 AS query_id, embedding AS qv FROM embeddings WHERE vec_id < 3)"
_SEARCHED = "v AS (SELECT vec_id AS chunk_id, embedding AS vec FROM embeddings), q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 50 = 0)"
_DOT = "list_sum(list_transform(range(1, len({b}) + 1), lambda i: CAST({a}[i] AS DOUBLE) * CAST({b}[i] AS DOUBLE)))"
_SIGNED = "list_sum(list_transform(range(1, len(vec) + 1), lambda i: CASE WHEN vec[i] >= 0 THEN CAST(qv[i] AS DOUBLE) ELSE -CAST(qv[i] AS DOUBLE) END))"
_SCALE = "(list_max(list_transform(vec, lambda x: abs(CAST(x AS DOUBLE)))) / 127e0)"
_INT8 = f"list_sum(list_transform(range(1, len(vec) + 1), lambda i: CAST(qv[i] AS DOUBLE) * (floor(CAST(vec[i] AS DOUBLE) / s + 0.5e0) * s)))"


def _scan(score: str, k: int) -> str:
    return f"""scored AS (SELECT query_id, chunk_id, {score} AS score FROM (SELECT *, {_SCALE} AS s FROM v) v, q),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored) x WHERE rank <= {k})"""


_PROPS = """props AS (
  SELECT p_partkey AS note_path, 'p_brand' AS key, p_brand AS value FROM part UNION ALL SELECT p_partkey, 'p_type', p_type FROM part
  UNION ALL SELECT p_partkey, 'p_size', CAST(p_size AS VARCHAR) FROM part UNION ALL SELECT p_partkey, 'p_name', p_name FROM part
),
vals AS (SELECT key, value, count(DISTINCT note_path) AS n FROM props WHERE length(value) <= 40 AND value <> '' AND NOT regexp_matches(value, '^[0-9]{4}-[0-9]{2}-[0-9]{2}|[\\[\\]]') GROUP BY 1, 2)"""

_STALLS = """st AS (
  SELECT event_id, ts, CASE WHEN event_type = 'view' THEN 'idle' ELSE event_type END AS context,
    CASE WHEN event_id % 3 > 0 THEN CAST(user_id AS VARCHAR) END AS frame, value AS ms, value > 40 AS applied, event_id % 4 AS reason, event_type AS type
  FROM events
)"""

_SYNC = """sync AS (
  SELECT l_orderkey AS id, l_suppkey % 3 AS device, CAST(epoch(CAST(l_shipdate AS TIMESTAMP)) AS BIGINT) AS mtime, l_linestatus = 'F' AS tombstone, CAST(l_linenumber AS BIGINT) AS seq, l_partkey AS off
  FROM lineitem
),
own AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, device ORDER BY mtime DESC, tombstone DESC, seq DESC, off DESC) AS k FROM sync) x WHERE k = 1),
res AS (SELECT id, mtime, device, seq, off FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY mtime DESC, device DESC, seq DESC, off DESC) AS j FROM own WHERE NOT tombstone) x WHERE j = 1)"""


def _hybrid(scores: str) -> str:
    return f"""WITH {scores}, {_VECTORS}, {_scan(_SIGNED, 200)},
lex AS (SELECT query_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS k FROM hits) x WHERE k <= (SELECT greatest(100, least(400, CAST(round(100 * sqrt(count(*) / 5000e0)) AS BIGINT))) FROM documents)),
rec AS (SELECT chunk_id FROM chunks WHERE modified IS NOT NULL ORDER BY modified DESC, chunk_id LIMIT 50),
pool AS (SELECT query_id, t.chunk_id AS chunk_id FROM (SELECT query_id, scored.chunk_id AS chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, scored.chunk_id) AS k FROM scored JOIN chunks ON scored.chunk_id = chunks.chunk_id) t WHERE k <= 200
  UNION SELECT query_id, chunk_id FROM lex UNION SELECT query_id, chunk_id FROM rec, (SELECT DISTINCT query_id FROM qt) z),
cos AS (SELECT pool.query_id AS query_id, pool.chunk_id AS chunk_id, CASE WHEN vec IS NOT NULL THEN {_INT8} END AS cos
  FROM pool JOIN q USING (query_id) LEFT JOIN (SELECT *, {_SCALE} AS s FROM v) v ON pool.chunk_id = v.chunk_id),
n AS (SELECT c.query_id AS query_id, c.chunk_id AS chunk_id, least(greatest((coalesce(cos, coalesce(min(cos) OVER (PARTITION BY c.query_id), 0)) + 1) / 2, 0e0), 1e0) AS dense,
    coalesce(score, 0) * coalesce(coverage, 0) * coalesce(coverage, 0) AS w, bound
  FROM cos c LEFT JOIN hits USING (query_id, chunk_id) JOIN bound USING (query_id)),
m AS (SELECT n.query_id AS query_id, n.chunk_id AS chunk_id, note_path, dense, CASE WHEN bound > 1e-10 THEN least(1e0, w / bound) ELSE 0e0 END AS bm25,
    CASE WHEN modified IS NULL THEN 0e0 ELSE pow(0.5e0, greatest(epoch(TIMESTAMP '2024-02-01') - epoch(modified), 0) / 86400e0 / 180e0) END AS recency
  FROM n JOIN chunks USING (chunk_id))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS rank, note_path, chunk_id, round(s, 6) AS score, round(dense, 6) AS dense, round(bm25, 6) AS bm25, round(recency, 6) AS recency, 0e0 AS boost
FROM (SELECT *, 0.85e0 * dense + 0.15e0 * bm25 AS s FROM m) x QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) <= 10"""


ORACLES: dict[str, str] = {
    "hybrid": _hybrid(_SCORES),
    "hybrid_expanded": _hybrid(_EXPANDED),
    "index_terms": f"WITH {_INDEX} SELECT term, field, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM post GROUP BY 1, 2",
    "filtered_search": f"""WITH {_SCORES.replace(_QUERIES, "qt(query_id, pos, term) AS (VALUES (1, 0, 'tion'))")}
SELECT chunk_id, round(score, 6) AS score FROM hits JOIN chunks USING (chunk_id) WHERE lang = 'en' AND n_chars >= 1000 ORDER BY round(score, 6) DESC, chunk_id LIMIT 10""",
    "browse_filters": f"WITH {_CHUNKS} SELECT chunk_id, note_path FROM chunks WHERE lang = 'en' AND title = 'src1' ORDER BY modified DESC NULLS LAST, note_path, chunk_id LIMIT 50",
    "tokenize_counts": f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_filter(t, lambda x: lower(x) NOT IN {_list(STOPWORDS)})) AS BIGINT) AS n_content FROM (SELECT doc_id, {_tokens('text')} AS t FROM documents) x",
    "plural_fold": f"SELECT word, {_singular('word')} AS stem, count(*) AS n FROM (SELECT lower(unnest({_tokens('text')})) AS word FROM documents) x WHERE ends_with(word, 's') GROUP BY word",
    "folded_words": f"SELECT word, {_fold('word')} AS folded, count(*) AS n FROM (SELECT lower(unnest({_tokens('text')})) AS word FROM documents) x WHERE regexp_matches(word, '[^\\x00-\\x7F]') GROUP BY word",
    "date_forms": "SELECT event_id, strftime(ts, '%Y-%m-%d') AS parsed, strftime(date_trunc('month', ts) + INTERVAL 1 MONTH, '%Y-%m-%d') AS month_end, strftime(ts, '%Y-%m-%d') AS named FROM events",
    "field_stats": f"WITH {_FIELDS} SELECT field, n_docs, round(avg_len, 6) AS avg_len FROM stats",
    "postings_topdf": f"WITH {_FIELDS} SELECT term, field, count(*) AS df FROM post GROUP BY 1, 2 ORDER BY df DESC, term, field LIMIT 100",
    "bm25_top10": f"WITH {_SCORES} SELECT * FROM (SELECT query_id, chunk_id, round(score, 6) AS score, round(coverage, 6) AS coverage, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) AS rank FROM hits) x WHERE rank <= 10",
    "bm25_bound": f"WITH {_SCORES} SELECT query_id, round(bound, 6) AS bound FROM bound",
    "doc_fraction": f"WITH {_SCORES} SELECT term, round(max(df) / (SELECT count(*) FROM documents), 6) AS fraction FROM df WHERE term IN (SELECT term FROM qt) GROUP BY term",
    "fuzzy_expand": f"""WITH vocab AS (SELECT DISTINCT unnest({_terms('text')}) AS term FROM documents), w(source, k) AS (VALUES ('tions', 1), ('heta', 1), ('reat', 1), ('thing', 1))
SELECT source, term, round(0.45e0 * length(term) / (length(term) + levenshtein(source, term)), 6) AS weight FROM w, vocab WHERE levenshtein(source, term) BETWEEN 1 AND k""",
    "prefix_expand": f"""WITH vocab AS (SELECT DISTINCT unnest({_terms('text')}) AS term FROM documents), w(source) AS (VALUES ('tions'), ('heta'), ('reat'), ('thing'))
SELECT source, term, round(0.375e0 * length(source) / length(term), 6) AS weight FROM w, vocab WHERE starts_with(term, source) AND term <> source""",
    "synonym_map": f"""WITH names AS (SELECT n_nationkey AS k, unnest([n_name, substr(n_name, 1, 3), n_name || 'n']) AS name FROM nation),
t AS (SELECT DISTINCT k, x[1] AS token FROM (SELECT k, {_terms('name', True)} AS x FROM names) y WHERE len(x) = 1 AND length(x[1]) >= 2),
c AS (SELECT t.k AS k, token FROM t JOIN (SELECT k FROM t GROUP BY k HAVING count(*) >= 2) m ON t.k = m.k),
u AS (SELECT token FROM c GROUP BY token HAVING count(DISTINCT k) = 1),
o AS (SELECT * FROM c WHERE token IN (SELECT token FROM u) AND token <> 'kenyan')
SELECT DISTINCT a.token AS token, b.token AS mate FROM o a JOIN o b ON a.k = b.k AND a.token <> b.token""",
    "synonym_expand": f"""WITH {_QUERIES}, syn(token, mate) AS (VALUES ('tion', 'ention'), ('tion', 'reat'), ('heat', 'thing')), e AS (SELECT DISTINCT query_id, term FROM qt)
SELECT query_id, term AS source, term, 1e0 AS weight FROM e
UNION ALL SELECT query_id, min(term) AS source, mate AS term, 0.8e0 AS weight FROM e JOIN syn ON term = token WHERE NOT EXISTS (SELECT 1 FROM e f WHERE f.query_id = e.query_id AND f.term = mate) GROUP BY query_id, mate""",
    "index_delta": f"""WITH {_FIELDS}, changed AS (
  SELECT term, field, chunk_id FROM post WHERE chunk_id % 7 <> 0 UNION ALL SELECT 'moved', field, chunk_id FROM ft WHERE chunk_id % 7 = 0)
SELECT term, field, count(*) AS df FROM changed GROUP BY 1, 2""",
    "sign_pack": "SELECT vec_id AS chunk_id, array_to_string(list_transform(range(0, 8), lambda b: CAST(list_sum(list_transform(range(0, 8), lambda i: CASE WHEN embedding[b * 8 + i + 1] >= 0 THEN 1 << i ELSE 0 END)) AS BIGINT)), ',') AS bytes FROM embeddings",
    "sign_scan_top": f"WITH {_SEARCHED}, {_scan(_SIGNED, 20)} SELECT query_id, chunk_id, round(score, 6) AS score FROM top",
    "packed_scan_top": f"WITH {_SEARCHED}, {_scan(_SIGNED, 20)} SELECT query_id, chunk_id, round(score, 6) AS score FROM top",
    "int8_codes": f"WITH {_VECTORS} SELECT chunk_id, round(s, 9) AS scale, CAST(list_sum(list_transform(vec, lambda x: floor(CAST(x AS DOUBLE) / s + 0.5e0))) AS BIGINT) AS code_sum FROM (SELECT *, {_SCALE} AS s FROM v) v",
    "int8_rerank": f"WITH {_SEARCHED}, {_scan(_INT8, 20)} SELECT query_id, chunk_id, round(score, 6) AS score FROM top",
    "background_mean": f"SELECT count(*) AS n, round((SELECT avg({_DOT.format(a='a.embedding', b='b.embedding')}) FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id), 6) AS mean FROM embeddings",
    "confidences": f"""WITH {_SEARCHED}, {_scan(_DOT.format(a='qv', b='vec'), 50)}, c AS (SELECT *, 1e0 / (1e0 + exp(-((score - 0.01e0) / 0.125e0 - 2e0) / 0.9e0)) AS p FROM top)
SELECT query_id, chunk_id, round(p, 6) AS confidence, round(CASE WHEN chunk_id % 2 = 0 THEN 0.4e0 ELSE least(greatest(0.85e0 * p + 0.15e0 * 0.4e0, 0e0), 1e0) END, 6) AS strength FROM c""",
    "missing_vectors": "SELECT vec_id IS NULL AS lexical_only, count(*) AS n FROM documents LEFT JOIN embeddings ON doc_id = vec_id GROUP BY 1",
    "vector_guard": "SELECT CASE vec_id % 5 WHEN 0 THEN 'dimension' WHEN 1 THEN 'not finite' ELSE 'ok' END AS status, count(*) AS n FROM embeddings GROUP BY 1",
    "reservoir_sample": "SELECT least(64, count(*)) AS n, least(64, count(*)) AS n_distinct FROM embeddings",
    "length_rungs": f"SELECT CAST(CASE WHEN n <= 32 THEN 32 WHEN n <= 48 THEN 48 WHEN n <= 64 THEN 64 WHEN n <= 96 THEN 96 WHEN n <= 128 THEN 128 WHEN n <= 192 THEN 192 WHEN n <= 256 THEN 256 WHEN n <= 384 THEN 384 ELSE 512 END AS BIGINT) AS rung, count(*) AS n FROM (SELECT len({_tokens('text')}) AS n FROM documents) x GROUP BY 1",
    "filter_tag": "SELECT doc_id AS chunk_id FROM documents WHERE lang IN ('en', 'fr')",
    "filter_path": f"WITH {_CHUNKS} SELECT chunk_id FROM chunks WHERE regexp_matches(note_path, '^src1/.*5[.]md$') OR regexp_matches(note_path, '^src2/..[.]md$')",
    "filter_property": "SELECT doc_id AS chunk_id FROM documents WHERE lang LIKE '%e%' AND lang <> 'de'",
    "filter_number": "SELECT doc_id AS chunk_id FROM documents WHERE n_chars BETWEEN 1000 AND 3000",
    "filter_mismatch": "SELECT doc_id AS chunk_id FROM documents WHERE false",
    "filter_date": f"WITH {_CHUNKS} SELECT chunk_id FROM chunks WHERE modified >= TIMESTAMP '2024-01-05' AND modified < TIMESTAMP '2024-01-21'",
    "negate_note": f"WITH {_CHUNKS} SELECT chunk_id FROM chunks WHERE note_path NOT IN (SELECT note_path FROM (SELECT note_path, unnest({_terms('content')}) AS t FROM chunks) x WHERE t IN ('reat', 'heat'))",
    "caps_by_size": "SELECT arm, CAST(CASE arm WHEN 'recency' THEN 50 ELSE greatest(f, least(c, round(f * sqrt((SELECT count(*) FROM documents) / 5000e0)))) END AS BIGINT) AS cap FROM (VALUES ('dense', 200, 800), ('lexical', 100, 400), ('recency', 50, 50)) t(arm, f, c)",
    "candidate_union": f"""WITH {_SCORES}, {_VECTORS}, {_scan(_SIGNED, 30)},
lex AS (SELECT query_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) AS k FROM hits) x WHERE k <= 30),
rec AS (SELECT chunk_id FROM chunks WHERE modified IS NOT NULL ORDER BY modified DESC, chunk_id LIMIT 10),
a AS (SELECT query_id, chunk_id, 0 AS arm FROM top UNION ALL SELECT query_id, chunk_id, 1 FROM lex UNION ALL SELECT query_id, chunk_id, 2 FROM rec, q)
SELECT query_id, first_arm, n_arms, count(*) AS n FROM (SELECT query_id, chunk_id, min(arm) AS first_arm, count(DISTINCT arm) AS n_arms FROM a GROUP BY 1, 2) x GROUP BY 1, 2, 3""",
    "best_per_note": """WITH b AS (SELECT conv_id, conv_id * 100 + turn AS chunk_id, length(text) AS score, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS k FROM conversations)
SELECT conv_id AS note_path, chunk_id, score, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM b WHERE k = 1 QUALIFY rank <= 25""",
    "browse_order": f"WITH {_CHUNKS} SELECT chunk_id, note_path FROM chunks ORDER BY modified DESC NULLS LAST, note_path, chunk_id LIMIT 60",
    "second_page": f"WITH {_CHUNKS} SELECT chunk_id FROM chunks ORDER BY modified DESC NULLS LAST, chunk_id LIMIT 10 OFFSET 10",
    "orphan_sweep": "SELECT doc_id AS chunk_id FROM documents WHERE doc_id % 3 = 0",
    "delta_ids": """WITH o AS (SELECT DISTINCT l_orderkey, l_partkey AS id FROM lineitem), n AS (SELECT DISTINCT l_orderkey, l_suppkey AS id FROM lineitem)
SELECT coalesce(o.l_orderkey, n.l_orderkey) AS l_orderkey, count(*) FILTER (WHERE n.id IS NULL) AS stale, count(*) FILTER (WHERE o.id IS NULL) AS fresh, count(*) FILTER (WHERE o.id IS NOT NULL AND n.id IS NOT NULL) AS stable
FROM o FULL JOIN n ON o.l_orderkey = n.l_orderkey AND o.id = n.id GROUP BY 1""",
    "recent_queries": """WITH l AS (SELECT user_id, event_type, max(ts) AS ts FROM events GROUP BY 1, 2),
s AS (SELECT l.user_id AS user_id, l.ts AS ts, max(CASE WHEN event_id % 2 = 0 THEN upper(l.event_type) ELSE l.event_type END) AS query FROM l JOIN events e ON e.user_id = l.user_id AND e.event_type = l.event_type AND e.ts = l.ts GROUP BY l.user_id, l.event_type, l.ts)
SELECT user_id, query, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, query) AS rank FROM s QUALIFY rank <= 3""",
    "title_boosts": f"""WITH t AS (SELECT p_partkey, list_distinct({_terms('p_name', True)}) AS w, list_distinct({_terms("string_split(p_name, ' ')[1]", True)}) AS f FROM part)
SELECT p_partkey, round(CASE WHEN list_contains(w, 'green') AND list_contains(w, 'forest') THEN 0.5e0 * 2 / len(w) ELSE 0e0 END, 6) AS boost, round(1e0 / len(w), 6) AS own FROM t""",
    "recency_scores": "SELECT o_orderkey, round(CASE WHEN o_orderkey % 11 = 0 THEN 0e0 ELSE pow(0.5e0, greatest((epoch(TIMESTAMP '1998-01-01') - epoch(CAST(o_orderdate AS TIMESTAMP))) / 86400e0, 0e0) / 180e0) END, 6) AS recency FROM orders",
    "lexical_floor": f"""WITH {_SEARCHED}, {_scan(_DOT.format(a='qv', b='vec'), 40)}
SELECT query_id, chunk_id, round(least(greatest((CASE WHEN chunk_id % 4 = 0 THEN min(CASE WHEN chunk_id % 4 <> 0 THEN score END) OVER (PARTITION BY query_id) ELSE score END + 1e0) / 2e0, 0e0), 1e0), 6) AS dense FROM top""",
    "tag_counts": "SELECT lang AS tag, count(*) AS n FROM documents GROUP BY 1",
    "folder_counts": "SELECT source AS folder, count(*) AS n FROM documents GROUP BY 1",
    "suggest_values": f"WITH {_PROPS} SELECT key, value, n FROM vals WHERE key <> 'p_name'",
    "suggest_keys": f"WITH {_PROPS} SELECT key, count(*) AS n_values, CAST(sum(n) AS BIGINT) AS total FROM vals GROUP BY key HAVING count(*) <= 40 OR sum(n) >= 2 * count(*)",
    "completions": f"WITH {_PROPS} SELECT value AS word, CAST(sum(n) AS BIGINT) AS n FROM vals WHERE starts_with(lower(value), 'b') AND length(value) > 1 GROUP BY value ORDER BY n DESC, word LIMIT 8",
    "dist_stats": """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, max(n) AS n, round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS mean, round(max(CASE WHEN i = floor(0.5e0 * (n - 1)) THEN value END), 6) AS p50, round(max(CASE WHEN i = floor(0.95e0 * (n - 1)) THEN value END), 6) AS p95 FROM r GROUP BY event_type""",
    "log_rollup": f"WITH {_STALLS} SELECT context, count(*) AS n, round(sum(ms), 3) AS total_ms, round(max(ms), 3) AS max_ms FROM st GROUP BY 1",
    "frame_rollup": f"WITH {_STALLS} SELECT coalesce(frame, 'unknown') AS frame, count(*) AS n, round(sum(ms), 3) AS total_ms FROM st WHERE context = 'idle' GROUP BY 1",
    "patch_rollup": f"""WITH {_STALLS}, r AS (SELECT *, row_number() OVER (PARTITION BY context ORDER BY ms) - 1 AS i, count(*) OVER (PARTITION BY context) AS n FROM st)
SELECT context, round(avg(CASE WHEN applied THEN 1e0 ELSE 0e0 END), 6) AS applied, round(max(CASE WHEN i = least(floor(n * 0.95e0), n - 1) THEN ms END), 6) AS p95_ms, round(max(ms), 6) AS max_ms, count(DISTINCT reason) AS n_reasons FROM r GROUP BY 1""",
    "log_cap": f"WITH {_STALLS} SELECT type, event_id FROM (SELECT type, event_id, row_number() OVER (PARTITION BY type ORDER BY ts DESC, event_id DESC) AS k FROM st) x WHERE k <= CASE type WHEN 'click' THEN 5 WHEN 'purchase' THEN 3 ELSE 10 END",
    "device_counts": "SELECT user_id % 7 AS device, count(*) AS n FROM events GROUP BY 1",
    "error_milestones": "SELECT message, event_id, k FROM (SELECT event_type AS message, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events) x WHERE k IN (SELECT CAST(pow(2, i) AS BIGINT) FROM range(0, 40) t(i))",
    "stall_gaps": """WITH g AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) - lag(CAST(floor(epoch(ts)) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)
SELECT user_id, count(gap) AS n, max(gap) AS longest FROM g GROUP BY 1""",
    "span_attribution": """WITH e AS (SELECT event_id, coalesce(event_type IN ('view', 'click'), false) AS opens, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS ms, value FROM events),
t AS (SELECT event_id AS task_id, ms AS a, ms + CAST(floor(value * 100) AS BIGINT) AS z FROM e WHERE NOT opens),
s AS (SELECT 'c' || CAST(event_id AS VARCHAR) AS context, ms AS a, ms + 20000 AS z FROM e WHERE opens),
o AS (SELECT task_id, context, row_number() OVER (PARTITION BY task_id ORDER BY least(t.z, s.z) - greatest(t.a, s.a) DESC, s.a DESC, context DESC) AS k FROM t JOIN s ON least(t.z, s.z) > greatest(t.a, s.a))
SELECT t.task_id AS task_id, coalesce(context, 'idle') AS context FROM t LEFT JOIN o ON t.task_id = o.task_id AND k = 1""",
    "crash_verdicts": """SELECT a.user_id AS user_id, t AS last_type, v AS visibility FROM (SELECT DISTINCT user_id FROM events) a
LEFT JOIN (SELECT user_id, event_type AS t FROM events WHERE event_type <> 'view' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) b ON a.user_id = b.user_id
LEFT JOIN (SELECT user_id, CAST(event_id AS VARCHAR) AS v FROM events WHERE event_type = 'view' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) c ON a.user_id = c.user_id""",
    "redacted": "SELECT page_id, 'path-' || substr(sha256('salt' || url), 1, 10) AS token, CAST(length(url) AS VARCHAR) || '/1' AS shape FROM pages",
    "click_trace": "SELECT s.event_id AS search_id, count(c.event_id) AS n_clicks, min(c.event_id % 10) AS best_rank FROM events s LEFT JOIN events c ON c.event_type = 'click' AND c.event_id - 1 = s.event_id WHERE s.event_type = 'view' GROUP BY 1",
    "progress": "SELECT CAST(floor(100e0 * count(*) FILTER (WHERE o_orderkey % 3 = 0) / count(*) / 5) * 5 AS BIGINT) AS percent FROM orders",
    "index_rates": "SELECT lang, round(sum(n_chars / 1000e0) / (2e0 * count(*)), 6) AS chunks_per_s, round(count(*) / (2e0 * count(*)), 6) AS files_per_s FROM documents GROUP BY 1",
    "delta_classify": """SELECT CASE WHEN d = 2 THEN 'deleted' WHEN d IN (0, 4, 7, 8, 9) THEN 'clean' ELSE 'dirty' END AS state, count(*) AS n FROM (SELECT doc_id % 10 AS d FROM documents) x GROUP BY 1""",
    "chunk_diff": """WITH l AS (SELECT CASE doc_id % 7 WHEN 1 THEN 'embed' WHEN 2 THEN 'remove' WHEN 3 THEN 'patch' WHEN 4 THEN 'reindex' ELSE 'keep' END AS lane FROM documents) SELECT lane, count(*) AS n FROM l GROUP BY 1""",
    "apply_delta": """WITH c AS (SELECT doc_id AS id, source AS title FROM documents)
SELECT title, count(*) AS n FROM (SELECT title FROM c WHERE id % 8 <> 0 UNION ALL SELECT 'new' FROM c WHERE id % 8 = 0 UNION ALL SELECT 'more' FROM c WHERE id % 4 = 1) x GROUP BY 1""",
    "compaction_check": "SELECT count(*) AS n, count(*) FILTER (WHERE l_linestatus = 'F') AS dead, count(*) FILTER (WHERE l_linestatus = 'F') >= 0.25 * count(*) AS rebuild FROM lineitem",
    "coherence": "SELECT m AS missing_in, count(*) AS n FROM (SELECT CASE WHEN vec_id IS NULL THEN 'b' ELSE 'a' END AS m FROM documents FULL JOIN embeddings ON doc_id = vec_id WHERE vec_id IS NULL OR doc_id IS NULL) x GROUP BY 1",
    "carry_over": "SELECT a.doc_id AS chunk_id, max(b.doc_id) AS vector FROM documents a JOIN documents b ON a.text = b.text AND b.doc_id % 2 = 0 WHERE a.doc_id % 2 = 1 GROUP BY 1",
    "log_resolve": f"WITH {_SYNC} SELECT id, mtime, device, seq, off FROM res",
    "hydrate_cover": f"WITH {_SYNC} SELECT o_custkey AS note_path, count(*) AS n_chunks FROM orders LEFT JOIN res ON o_orderkey = id GROUP BY 1 HAVING bool_and(id IS NOT NULL)",
    "compact_log": f"WITH {_SYNC} SELECT device, count(*) AS n, true AS compacted FROM sync WHERE id IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 4 = 0) GROUP BY 1",
    "small_shards": f"WITH {_SYNC}, s AS (SELECT device, id % 40 AS shard, 444 * count(*) AS bytes FROM sync GROUP BY 1, 2) SELECT device, count(*) AS n_small, CAST(sum(bytes) AS BIGINT) AS bytes FROM s GROUP BY 1 HAVING count(*) >= 16",
    "producers": "SELECT s_suppkey AS device, CASE WHEN s_suppkey % 5 > 0 THEN s_nationkey END AS last_full, (SELECT bool_or(s_suppkey % 3 = 2) FROM supplier) AS peer_ahead FROM supplier WHERE s_suppkey % 3 = 1",
    "store_sizes": """SELECT 'region' AS store, count(*) AS n, CAST(sum(length('{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}')) AS BIGINT) AS bytes FROM region
UNION ALL SELECT 'nation', count(*), CAST(sum(length('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}')) AS BIGINT) FROM nation""",
    "log_tail": """WITH e AS (SELECT event_id, user_id % 3 AS device, row_number() OVER (PARTITION BY user_id % 3 ORDER BY ts DESC, event_id DESC) AS k, count(*) OVER (PARTITION BY user_id % 3) AS n FROM events)
SELECT device, count(*) AS n, min(event_id) AS first_id FROM e WHERE n * 100 <= 50000 OR k * 100 <= 20000 GROUP BY 1""",
    "device_retention": "SELECT user_id AS device, count(*) AS n FROM events GROUP BY 1 HAVING max(ts) >= TIMESTAMP '2024-01-29'",
    "record_crc": "SELECT vec_id AS chunk_id FROM embeddings WHERE vec_id % 9 <> 0",
    "membership": f"WITH {_CHUNKS} SELECT chunk_id FROM chunks WHERE NOT starts_with(note_path, 'src1') AND NOT starts_with(note_path, 'src2/') AND NOT regexp_matches(note_path, '[37][.]md$')",
    "sentence_counts": r"""WITH s AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(text, '([.!?…][.!?…"''”’)\]}»]*)[ \t\r\f\v]+([\p{Lu}\p{N}"''“‘(\[{«])', chr(1) || '\1' || chr(2) || '\2', 'g'), '[\x02\n]'), lambda x: regexp_matches(x, '[^\x01\s]')) AS s FROM documents)
SELECT doc_id, CAST(coalesce(len(s), 0) AS BIGINT) AS n_sentences FROM s""",
    "sessions": """WITH g AS (SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 1 HOUR THEN 1 ELSE 0 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM g)
SELECT user_id, count(*) AS n_sessions, max(n) AS longest FROM (SELECT user_id, s, count(*) AS n FROM s GROUP BY 1, 2) x GROUP BY 1""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
