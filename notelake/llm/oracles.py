"""SQL for the queries that SQL can express."""

from __future__ import annotations

from notelake.llm.url_rules import RULES

OP1 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(CAST(sum(CASE WHEN role = 'assistant' THEN length(text) END) AS BIGINT), 0) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(4 + length(role) + length(regexp_replace(role, '[^\\#:]', '', 'g')) + 2 + length(text)
    + length(regexp_replace(text, '[^\\#]', '', 'g')) + (length(text) - length(replace(text, '</turn>', ''))) // 7 + 9) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

OP4 = """
WITH rules(rh, rp, action) AS (VALUES {rules}),
u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^[^:]*(?::[^:]*?)*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
),
f AS (
  SELECT u.host AS host, u.path AS path, rh || rp AS rule, action,
    row_number() OVER (PARTITION BY u.host, u.path ORDER BY length(rh) + length(rp) DESC, length(rh) DESC, action DESC) AS k
  FROM (SELECT DISTINCT host, path FROM u) u JOIN rules ON (u.host = rh OR ends_with(u.host, '.' || rh)) AND starts_with(u.path, rp)
)
SELECT page_id, u.host AS host, u.path AS path, f.rule AS rule, coalesce(f.action, 'allow') AS verdict
FROM u LEFT JOIN f ON u.host = f.host AND u.path = f.path AND f.k = 1
""".format(rules=", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in RULES))

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP9 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS w FROM documents
),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w
),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
p AS (SELECT doc_id, unnest(s) AS t FROM s),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM p a JOIN p b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
r(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT n.doc_id AS doc_id, n.n AS n_shingles, least(n.doc_id, coalesce(min(r.y), n.doc_id)) AS component_id
FROM n LEFT JOIN r ON r.x = n.doc_id GROUP BY n.doc_id, n.n
"""

_WORDS = "list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

OP10 = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT item_id, coalesce({_WORDS}, []) AS w FROM benchmark),
i AS (
  SELECT item_id, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(len(w) - 8, 2)), lambda k: array_to_string(w[k:k + 9], ' '))) AS t
  FROM b WHERE len(w) > 0
),
sizes AS (SELECT DISTINCT n FROM i),
dw AS (
  SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS t
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n) q
),
h AS (SELECT DISTINCT doc_id, k, dw.n AS n, item_id FROM dw JOIN i ON dw.t = i.t AND dw.n = i.n),
hit AS (SELECT doc_id, count(DISTINCT k + j) AS n_hit FROM (SELECT doc_id, k, unnest(range(0, n)) AS j FROM h) q GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) q GROUP BY doc_id)
SELECT d.doc_id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_tree": OP1, "op4_url_rules": OP4, "op9_jaccard_join": OP9, "op10_decontaminate": OP10}
