"""DuckDB SQL for the rows of the queries that SQL can express."""

from __future__ import annotations

_ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"'[^\x20\x09-\x0D]+'"

OP1 = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS h FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(h, '</?(p|h1|br)>', ' ', 'g'), '<[^>]*>', '', 'g') AS t FROM a),
c AS (SELECT page_id, url, trim(regexp_replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM b)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM c
"""

OP2 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_ASCII_LOWER}, {_SPACED}) AS a FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(a, i, i + 4), ' ') AS g
  FROM (SELECT doc_id, a, unnest(generate_series(1, greatest(len(a) - 4, least(len(a), 1)))) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS u, y.doc_id AS v, count(*) AS same FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT u, v FROM p JOIN n nu ON nu.doc_id = u JOIN n nv ON nv.doc_id = v WHERE 100 * same >= 85 * (nu.n + nv.n - same)),
b AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
r AS (SELECT doc_id AS a, doc_id AS z FROM documents UNION SELECT r.a, b.v FROM r JOIN b ON r.z = b.u),
c AS (SELECT a, min(z) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

OP4 = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS a FROM documents),
g AS (SELECT doc_id, i, array_to_string(list_slice(a, i, i + 2), ' ') AS g FROM (SELECT doc_id, a, unnest(generate_series(1, len(a) - 2)) AS i FROM d WHERE len(a) > 2)),
g2 AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM g2, (SELECT unnest([0, 1, 2]) AS j) WHERE n > 1 GROUP BY 1),
l AS (SELECT doc_id, source, t, unnest(string_split(t, chr(10))) AS line FROM d),
l2 AS (SELECT doc_id, source, t, line, len(regexp_extract_all(line, {_SPACED})) AS w,
  trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')) AS k FROM l),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM l2 WHERE w > 0 GROUP BY 1),
tot AS (SELECT source, count(DISTINCT t) AS total FROM d WHERE len(a) > 0 GROUP BY 1),
freq AS (SELECT l2.source, k FROM l2 JOIN tot ON l2.source IS NOT DISTINCT FROM tot.source WHERE w > 0 GROUP BY 1, 2 HAVING count(DISTINCT t) >= 20 AND count(DISTINCT t) >= 0.02 * any_value(total)),
gone AS (SELECT l2.doc_id, sum(w) AS gone FROM l2 JOIN freq ON l2.source IS NOT DISTINCT FROM freq.source AND l2.k = freq.k WHERE w > 0 GROUP BY 1),
x AS (
  SELECT d.doc_id, len(a)::BIGINT AS n_words, coalesce(list_sum(list_transform(a, lambda z: length(z))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(gone, 0)::BIGINT AS n_removed_words
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_removed_words <= 0.7 * n_words AS kept
FROM x
"""

_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

OP10 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_ASCII_LOWER}, {_ALNUM}) AS a FROM documents),
b AS (SELECT item_id, regexp_extract_all({_ASCII_LOWER}, {_ALNUM}) AS a FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(a), 10) AS m, array_to_string(list_slice(a, i, i + least(len(a), 10) - 1), ' ') AS g
  FROM (SELECT item_id, a, unnest(generate_series(1, len(a) - least(len(a), 10) + 1)) AS i FROM b WHERE len(a) > 0)),
dw AS (SELECT doc_id, i, m, array_to_string(list_slice(a, i, i + m - 1), ' ') AS g
  FROM (SELECT doc_id, a, m, unnest(generate_series(1, len(a) - m + 1)) AS i FROM d, (SELECT DISTINCT m FROM win) WHERE len(a) >= m)),
met AS (SELECT doc_id, i, dw.m, item_id FROM dw JOIN win ON dw.g = win.g AND dw.m = win.m),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + m - 1)) AS p FROM met) GROUP BY 1),
names AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS k FROM met) GROUP BY 1)
SELECT d.doc_id, len(a)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN names USING (doc_id)
"""

OP9 = r"""
WITH c AS (
  SELECT conv_id, turn, text, 'call_' || conv_id || '_' || turn AS call_id,
    CASE turn % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'ask' ELSE 'note' END AS name,
    CASE WHEN turn >= 2 THEN 'call_' || conv_id || '_' || (turn - 2) END AS needs
  FROM conversations WHERE role = 'user'),
r AS (SELECT conv_id, turn AS result_turn, 'call_' || conv_id || '_' || (turn - 1) AS call_id, text AS content FROM conversations WHERE role = 'assistant'),
b AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, turn, name, text, needs, content,
    CASE WHEN c.call_id IS NULL THEN 'orphan' WHEN r.call_id IS NULL THEN 'unanswered' ELSE 'linked' END AS status, coalesce(c.turn, r.result_turn) AS at_turn
  FROM c FULL JOIN r ON c.conv_id = r.conv_id AND c.call_id = r.call_id),
x AS (
  SELECT b.*, row_number() OVER (PARTITION BY conv_id ORDER BY at_turn, call_id, status) - 1 AS "position",
    needs IS NULL OR EXISTS (SELECT 1 FROM c WHERE c.conv_id = b.conv_id AND c.call_id = b.needs AND c.turn < b.turn) AS ordered,
    CASE WHEN status = 'orphan' THEN 'call' WHEN name = 'note' THEN 'tool'
      WHEN turn % 5 = 4 THEN CASE name WHEN 'ask' THEN 'missing limit;missing text;unexpected turn' ELSE 'missing text;unexpected turn' END ELSE '' END AS errors,
    CASE WHEN status = 'orphan' THEN NULL WHEN turn % 5 = 4 THEN '{"turn":' || turn || '}' ELSE '{"limit":' || turn || ',"text":' || to_json(text)::VARCHAR || '}' END AS arguments
  FROM b)
SELECT conv_id, call_id, status, "position", ordered, errors, errors = '' AND ordered AS valid,
  '{' || concat_ws(',', '"arguments":' || arguments, '"id":' || to_json(call_id)::VARCHAR, '"name":' || to_json(name)::VARCHAR, '"result":' || to_json(content)::VARCHAR) || '}' AS json
FROM x
"""


def _crc32(text: str) -> str:
    """SQL of the unsigned crc32 of a text of ASCII characters, bit by bit."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    turn = "lambda r, e: xor(xor(r, e) >> 1, 3988292384 * (xor(r, e) & 1))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), {turn}), 4294967295)"


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(({value})::VARCHAR) || ':' || ({value})::VARCHAR END"


def _tree(first: str, rows: str, out: str, levels: int) -> str:
    """CTEs that climb from ``first(g, i, h)`` by eights, and carry ``rows(.., g, i, proof, x)`` up along it into ``out``."""
    sql, node, row = [], first, rows
    for k in range(levels):
        at = f"{first}_{k}"
        sql.append(f"""{at}s AS (SELECT *, count(*) OVER (PARTITION BY g) AS c,
  coalesce(string_agg(h, '') OVER (PARTITION BY g, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
  coalesce(string_agg(h, '') OVER (PARTITION BY g, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b FROM {node}),
{at}n AS (SELECT g, i // 8 AS i, CASE WHEN any_value(c) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {at}s GROUP BY g, i // 8),
{at}r AS (SELECT r.* REPLACE (r.i // 8 AS i, CASE WHEN c > 1 THEN proof || a || b ELSE proof END AS proof, CASE WHEN c > 1 THEN sha256(a || x || b) ELSE x END AS x)
  FROM {row} r JOIN {at}s s ON r.g = s.g AND r.i = s.i)""")
        node, row = f"{at}n", f"{at}r"
    return ",\n".join(sql) + f",\n{first}_root AS (SELECT g, h FROM {node}),\n{out} AS (SELECT * FROM {row})"


_LEAF = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))
_TEXT_LOWER = _ASCII_LOWER.replace("coalesce(text, '')", "text")

#: Seven levels a lang and four above: enough for two million rows a lang and 4,096 langs.
OP11 = f"""
WITH d AS (SELECT doc_id, coalesce('+' || lang, '') AS g, sha256({_LEAF} || {_field("text")}) AS h,
  sha256({_LEAF} || {_field(_TEXT_LOWER)}) AS low, {_crc32("doc_id::VARCHAR")} % 3 = 0 AS tampered FROM documents),
leaf AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM d),
r0 AS (SELECT doc_id, h AS leaf, g, i, '' AS proof, CASE WHEN tampered THEN low ELSE h END AS x FROM leaf),
n0 AS (SELECT g, i, h FROM leaf),
{_tree("n0", "r0", "r1", 7)},
m0 AS (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, h, g AS name FROM n0_root),
r2 AS (SELECT r1.doc_id, leaf, m0.h AS subroot, '' AS g, m0.i AS i, proof, x FROM r1 JOIN m0 ON r1.g = m0.name),
m1 AS (SELECT g, i, h FROM m0),
{_tree("m1", "r2", "r3", 4)}
SELECT doc_id, leaf, subroot, m.h AS root, sha256(proof) AS proof_sha256, x AS folded_root, x = m.h AS verified FROM r3, m1_root m
"""

OP12 = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_crc32("conv_id::VARCHAR")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
k AS (SELECT c.conv_id, count(t.p) AS k FROM c LEFT JOIN t ON t.conv_id = c.base AND t.p <= c.h GROUP BY 1),
b AS (
  SELECT c.conv_id, t.p AS depth, role, text FROM c JOIN t ON t.conv_id = c.base AND t.p <= h
  UNION ALL SELECT c.conv_id, t.p - h + k.k, role, text FROM c JOIN k USING (conv_id) JOIN t ON t.conv_id = c.conv_id AND t.p > h),
s AS (
  SELECT conv_id, depth, text, string_agg(to_json([role, text])::VARCHAR, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM b
  UNION ALL SELECT conv_id, 0, '', '' FROM c),
e AS (SELECT conv_id, max(depth) AS length FROM s GROUP BY 1),
u AS (SELECT s.*, coalesce(lag(path) OVER (PARTITION BY s.conv_id ORDER BY depth), '') AS up, depth = length AS last FROM s JOIN e USING (conv_id)),
n AS (SELECT depth, path, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, max(strlen(text)) AS bytes,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256 FROM u GROUP BY depth, path),
m AS (SELECT n.*, o.conv_id AS parent_conv_id, (SELECT count(*) FROM n x WHERE x.depth = n.depth + 1 AND x.up = n.path) AS n_children
  FROM n LEFT JOIN n o ON o.depth = n.depth - 1 AND o.path = n.up),
w AS (SELECT a.depth, a.path, sum(CASE WHEN m.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((m.n_convs - 1) * m.bytes) AS saved_tokens
  FROM m JOIN u a ON a.conv_id = m.conv_id AND a.depth <= m.depth GROUP BY 1, 2)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM m JOIN w USING (depth, path)
"""

_LEVEL = "CASE WHEN {0} < 8 THEN {0} ELSE 5 + floor(log2({0})) END"
#: Begin marks and the end are texts of white space, which no word is.
OP13 = rf"""
WITH d AS (SELECT doc_id, {_crc32("doc_id::VARCHAR")} % 7 AS rest, list_concat(['   ', '  '], regexp_extract_all({_ASCII_LOWER}, {_SPACED}), [' ']) AS a, row_number() OVER () AS r FROM documents),
t AS (SELECT r, coalesce(rest <> 2, false) AS learn, a[j - 2] AS u, a[j - 1] AS v, a[j] AS w FROM (SELECT *, unnest(generate_series(3, len(a))) AS j FROM d)),
l AS (SELECT * FROM t WHERE learn),
tot AS (SELECT count(*) AS big_n, count(DISTINCT w) AS big_v FROM l),
c1 AS (SELECT w, count(*) AS c FROM l GROUP BY 1), h2 AS (SELECT v, count(*) AS h FROM l GROUP BY 1),
c2 AS (SELECT v, w, count(*) AS c FROM l GROUP BY 1, 2), h3 AS (SELECT u, v, count(*) AS h FROM l GROUP BY 1, 2),
c3 AS (SELECT u, v, w, count(*) AS c FROM l GROUP BY 1, 2, 3),
x AS (SELECT t.r, t.learn, big_n AS n1, coalesce(c1.c, 0) AS k1, coalesce(h2.h, 0) AS n2, coalesce(c2.c, 0) AS k2, coalesce(h3.h, 0) AS n3, coalesce(c3.c, 0) AS k3, big_v
  FROM t CROSS JOIN tot LEFT JOIN c1 ON c1.w = t.w LEFT JOIN h2 ON h2.v = t.v LEFT JOIN c2 ON c2.v = t.v AND c2.w = t.w
  LEFT JOIN h3 ON h3.u = t.u AND h3.v = t.v LEFT JOIN c3 ON c3.u = t.u AND c3.v = t.v AND c3.w = t.w),
y AS (SELECT *, {_LEVEL.format("n1")} AS l1, {_LEVEL.format("n2")} AS l2, {_LEVEL.format("n3")} AS l3 FROM x),
m1 AS (SELECT l1, (count_if(k1 = 1) + 1) / (count(*) + 2) AS m1 FROM y WHERE learn GROUP BY 1),
m2 AS (SELECT l2, (count_if(k2 = 1) + 1) / (count(*) + 2) AS m2 FROM y WHERE learn GROUP BY 1),
m3 AS (SELECT l3, (count_if(k3 = 1) + 1) / (count(*) + 2) AS m3 FROM y WHERE learn GROUP BY 1),
z AS (SELECT *, coalesce((1 - m1) * k1 / n1 + m1 / (big_v + 1), 1 / (big_v + 1)) AS p1 FROM y LEFT JOIN m1 USING (l1) LEFT JOIN m2 USING (l2) LEFT JOIN m3 USING (l3)),
z2 AS (SELECT *, CASE WHEN n2 = 0 THEN p1 ELSE (1 - m2) * k2 / n2 + m2 * p1 END AS p2 FROM z),
z3 AS (SELECT *, CASE WHEN n3 = 0 THEN p2 ELSE (1 - m3) * k3 / n3 + m3 * p2 END AS p3 FROM z2),
s AS (SELECT r, count(*) AS n_tokens, count_if(k1 > 0) AS n_known, any_value(n1) AS train_tokens, sum(log10((k1 + 1) / (n1 + big_v + 1))) AS base_score, sum(log10(p3)) AS score FROM z3 GROUP BY 1)
SELECT doc_id, rest = 2 AS held_out, n_tokens, n_known::BIGINT AS n_known, train_tokens, base_score, score FROM s JOIN d USING (r)
"""


ORACLES: dict[str, str] = {
    "op1_html_extraction": OP1,
    "op2_minhash_near_dedup": OP2,
    "op4_line_quality": OP4,
    "op9_tool_call_linking": OP9,
    "op10_decontamination": OP10,
    "op11_merkle_manifest": OP11,
    "op12_conversation_trie": OP12,
    "op13_language_model": OP13,
}
