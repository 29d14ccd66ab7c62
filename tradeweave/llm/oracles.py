"""SQL for the text queries that SQL can express, over the raw tables."""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BLANK_WORDS = rf"regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+')"
LETTER_WORDS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {LETTER_WORDS} AS w FROM documents),
b AS (SELECT item_id, {LETTER_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
  FROM (SELECT item_id, w, least(len(w), 13) AS size, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
),
spelled AS (
  SELECT r, i, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d JOIN (SELECT DISTINCT size FROM windows) ON len(w) >= size)
),
hits AS (SELECT * FROM spelled WHERE phrase IN (SELECT phrase FROM windows)),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM hits) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits JOIN windows USING (phrase)) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""

#: Pairs that are alike enough share one of the rarest n - ceil(0.85 n) + 1 shingles of each; full sets confirm them.
NEAR_COPIES = f"""
WITH RECURSIVE words AS (SELECT doc_id, {BLANK_WORDS} AS w FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')))) END AS s
  FROM words
),
classes AS MATERIALIZED (SELECT min(doc_id) AS c, s FROM sets WHERE len(s) > 0 GROUP BY s),
spread AS MATERIALIZED (SELECT c, len(s) AS n, unnest(s) AS x FROM classes),
common AS (SELECT x, count(*) AS df FROM spread GROUP BY x),
ranked AS (SELECT c, n, x, row_number() OVER (PARTITION BY c ORDER BY df, x) AS place FROM spread JOIN common USING (x)),
prefix AS MATERIALIZED (SELECT c, n, x FROM ranked WHERE place <= n - CAST(ceil(n * 85 / 100.0) AS BIGINT) + 1),
pairs AS (
  SELECT DISTINCT a.c AS a, b.c AS b FROM prefix a JOIN prefix b ON a.x = b.x AND a.c < b.c
  WHERE 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
),
links AS MATERIALIZED (
  SELECT a, b FROM (
    SELECT a, b, len(list_intersect(p.s, q.s)) AS common, len(p.s) + len(q.s) AS total
    FROM pairs JOIN classes p ON p.c = a JOIN classes q ON q.c = b)
  WHERE 100 * common >= 85 * (total - common)
),
ties AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT c AS a, c AS b FROM classes UNION SELECT reached.a, ties.b FROM reached JOIN ties ON reached.b = ties.a),
component AS (SELECT a AS c, min(b) AS least FROM reached GROUP BY a)
SELECT doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(least, doc_id) AS component_id, doc_id = coalesce(least, doc_id) AS kept
FROM sets LEFT JOIN classes ON classes.s = sets.s LEFT JOIN component USING (c)
"""

#: The first h turns of the block's first conversation, then a conversation's own; crc32 bit by bit.
PREFIX_TRIE = rf"""
WITH k AS (
  SELECT conv_id, turn, sha256(length(role) || ':' || role || text) AS g, CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT) AS w
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
),
o AS (SELECT conv_id, g, w, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, g) AS p FROM k),
c AS (
  SELECT conv_id, xor(list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))
  ), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM k)
),
taken AS (
  SELECT c.conv_id, p, g, w FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 20 AND p <= h
  UNION ALL SELECT c.conv_id, p, g, w FROM c JOIN o ON o.conv_id = c.conv_id AND p > h
),
whole AS (
  SELECT c.conv_id, coalesce(list(g ORDER BY p) FILTER (g IS NOT NULL), []) AS gs, list(w ORDER BY p) FILTER (g IS NOT NULL) AS ws
  FROM c LEFT JOIN taken ON taken.conv_id = c.conv_id GROUP BY c.conv_id
),
pre AS (
  SELECT conv_id, d, array_to_string(gs[1:d], '') AS path, CASE WHEN d > 0 THEN ws[d] ELSE 0 END AS w, d = len(gs) AS ends
  FROM (SELECT *, unnest(range(0, len(gs) + 1)) AS d FROM whole)
),
node AS MATERIALIZED (
  SELECT path, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(w) AS saved,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM pre GROUP BY path
),
kids AS MATERIALIZED (SELECT path[1:64 * (depth - 1)] AS path, count(*) AS n FROM node WHERE depth > 0 GROUP BY 1),
sums AS (
  SELECT above, CAST(sum(leaf) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens
  FROM (SELECT path[1:64 * unnest(range(0, depth + 1))] AS above, (kids.n IS NULL)::INT AS leaf, saved FROM node LEFT JOIN kids USING (path))
  GROUP BY above
)
SELECT node.conv_id, node.depth, up.conv_id AS parent_conv_id, node.n_convs, coalesce(kids.n, 0) AS n_children, n_leaves, saved_tokens, node.ends_sha256
FROM node LEFT JOIN kids USING (path) JOIN sums ON sums.above = node.path LEFT JOIN node up ON node.depth > 0 AND up.path = node.path[1:64 * (node.depth - 1)]
"""

#: Turns as the template spells them: 12 and 11 characters of control strings, a line end, and one backslash for each control string in a text.
FORMAT_CHATS = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS x FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
),
t AS (SELECT *, sha256(length(role) || ':' || role || x) AS g FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || x || chr(10), '' ORDER BY turn NULLS FIRST, g)) AS turns_sha256,
       CAST(coalesce(sum(length(x)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(x, '' ORDER BY turn NULLS FIRST, g) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(24 + length(url_encode(role)) + length(x) + len(regexp_extract_all(x, '[<\[]\\*(?:\|im_start\|>|\|im_end\|>|/?s>|/?INST\])'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

ORACLES: dict[str, str] = {"op2_minhash": NEAR_COPIES, "op7_decontaminate": DECONTAMINATE, "op12_prefix_trie": PREFIX_TRIE, "op13_reply_trees": FORMAT_CHATS}
