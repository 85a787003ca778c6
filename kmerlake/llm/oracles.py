"""DuckDB SQL for the operators' queries that SQL can express."""

from __future__ import annotations

from kmerlake.llm.secrets import RULES

_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOW + ", '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS.format('text')}, []) AS w, text FROM documents),
it AS (SELECT DISTINCT item_id, {_WORDS.format('text')} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
win AS (SELECT DISTINCT item_id, array_to_string(w[CAST(k AS INT):CAST(k + 9 AS INT)], ' ') AS g, least(10, len(w)) AS n FROM it, range(1, greatest(len(w) - 9, 1) + 1) t(k) WHERE len(w) > 0),
dg AS (SELECT doc_id, CAST(k AS INT) AS k, s.n, array_to_string(w[CAST(k AS INT):CAST(k + s.n - 1 AS INT)], ' ') AS g FROM d, (SELECT DISTINCT n FROM win) s, range(1, len(w) - s.n + 2) t(k)),
hit AS (SELECT DISTINCT doc_id, item_id, k, dg.n AS n FROM dg JOIN win ON dg.g = win.g AND dg.n = win.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, range(k, k + n) t(p) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN ids USING (doc_id)"""


def _spans(order: int) -> str:
    rule = RULES[order]
    pattern = rule.pattern.replace("'", "''")
    value = f"regexp_extract(m, '{pattern}', {rule.group})" if rule.group else "m"
    check = f" WHERE length({value}) >= {rule.least}" if rule.least else ""
    return (
        f"SELECT doc_id, {order} AS o, '{rule.kind}' AS kind, a AS start, a + length(m) AS stop FROM (SELECT doc_id, ms[CAST(i AS INT)] AS m, "
        "CAST(list_sum(list_transform(gs[1:CAST(i AS INT)], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:CAST(i - 1 AS INT)], lambda x: length(x))), 0) AS BIGINT) AS a "
        f"FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS ms, regexp_split_to_array(text, '{pattern}') AS gs FROM documents WHERE text IS NOT NULL), range(1, len(ms) + 1) t(i)){check}"
    )


_LINE = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, o)"
SECRETS = (
    "WITH s AS (" + " UNION ALL ".join(_spans(i) for i in range(len(RULES))) + f"), g AS (SELECT doc_id, count(*) FILTER (WHERE o = 0) AS n_assign, count(*) FILTER (WHERE o = 1) AS n_access, count(*) FILTER (WHERE o = 2) AS n_hex, {_LINE} FILTER (WHERE o < 3) AS base, {_LINE} AS spans FROM s GROUP BY doc_id) "
    "SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id"
)

_SPACED = "regexp_extract_all(" + _LOW.format("text") + ", '[^\\x20\\x09-\\x0D]+')"
JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce({_SPACED}, []) AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[CAST(k AS INT):CAST(k + 2 AS INT)], ' ') AS g FROM d, range(1, greatest(len(w) - 2, 1) + 1) t(k) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
sig AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY s) AS rep FROM (SELECT doc_id, count(*) AS n, string_agg(g, chr(10) ORDER BY g) AS s FROM sh GROUP BY doc_id)),
r AS (SELECT sh.* FROM sh JOIN sig USING (doc_id) WHERE doc_id = rep),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM r a JOIN r b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM pair JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * i >= 90 * (p.n + q.n - i)),
both_ways AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach(x, y) AS (SELECT DISTINCT rep, rep FROM sig UNION SELECT reach.x, both_ways.y FROM reach JOIN both_ways ON reach.y = both_ways.x),
comp AS (SELECT x, min(y) AS component_id, count(*) AS component_sets FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(sig.n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, coalesce(component_sets, 0) AS component_sets FROM d LEFT JOIN sig USING (doc_id) LEFT JOIN comp ON comp.x = rep"""


#: The table of the reflected CRC-32, built by its rule; ``crc32`` is 4294967295 exclusive-or the fold over the bytes.
_CRC_TABLE = "(SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], list_transform(range(8), lambda z: 0)), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))) AS tab)"
_HEX = "list_transform(range(CAST(length({0}) / 2 AS BIGINT)), lambda i: CAST('0x' || {0}[CAST(2 * i + 1 AS INT):CAST(2 * i + 2 AS INT)] AS BIGINT))"


def _crc(bytes_as_hex: str) -> str:
    return f"xor(4294967295, list_reduce(list_concat([4294967295], {_HEX.format(bytes_as_hex)}), lambda c, b: xor(c >> 8, tab[CAST((xor(c, b) & 255) + 1 AS INT)])))"


TRIE = f"""
WITH RECURSIVE t AS (SELECT conv_id AS c, turn, sha256(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, CAST(strlen(coalesce(text, '')) AS BIGINT) AS b FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, k, b, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, k) - 1 AS i FROM t),
hx AS (SELECT c, count(*) AS n, hex(encode(CAST(c AS VARCHAR))) AS x FROM o GROUP BY c),
v0 AS (SELECT c, n, {_crc('x')} % 9 AS h, c - c % 5 AS base FROM hx, {_CRC_TABLE}),
v AS (SELECT v0.c, v0.h, v0.base, least(v0.h, coalesce(w.n, 0)) AS p, least(v0.h, coalesce(w.n, 0)) + greatest(v0.n - v0.h, 0) AS total FROM v0 LEFT JOIN v0 w ON w.c = v0.base),
r AS (SELECT v.c, p + i - h + 1 AS d, k, b FROM o JOIN v ON o.c = v.c WHERE i >= h UNION ALL SELECT v.c, i + 1, k, b FROM o JOIN v ON o.c = v.base WHERE i < h),
pre AS (SELECT c, d, b, string_agg(k, '') OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING) AS s FROM r UNION ALL SELECT c, 0, 0, '' FROM v),
nodes AS (SELECT s, d, min(c) AS c, count(*) AS n, min(b) AS b FROM pre GROUP BY s, d),
up AS (SELECT n.s, n.d, n.c, n.n, n.b, q.c AS parent, q.s AS ps FROM nodes n LEFT JOIN nodes q ON q.d = n.d - 1 AND q.s = n.s[:CAST(64 * (n.d - 1) AS INT)]),
kids AS (SELECT ps, count(*) AS k FROM up WHERE d > 0 GROUP BY ps),
below(a, s) AS (SELECT s, s FROM up UNION ALL SELECT up.ps, below.s FROM below JOIN up ON up.s = below.a WHERE up.d > 0),
tot AS (SELECT a, count(*) FILTER (WHERE kids.k IS NULL) AS leaves, sum((up.n - 1) * up.b) AS saved FROM below JOIN up ON up.s = below.s LEFT JOIN kids ON kids.ps = below.s GROUP BY a),
ends AS (SELECT s, string_agg(CAST(pre.c AS VARCHAR), ',' ORDER BY pre.c) AS m FROM pre JOIN v ON v.c = pre.c AND v.total = pre.d GROUP BY s)
SELECT up.c AS conv_id, CAST(up.d AS BIGINT) AS depth, up.parent AS parent_conv_id, up.n AS n_convs, coalesce(kids.k, 0) AS n_children, tot.leaves AS n_leaves, CAST(tot.saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends.m, '')) AS ends_sha256
FROM up LEFT JOIN kids ON kids.ps = up.s JOIN tot ON tot.a = up.s LEFT JOIN ends ON ends.s = up.s"""

SPELLING = f"""
WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all({_LOW.format('text')}, '[a-zÀ-ÿ]+')) AS w FROM documents),
o AS (SELECT w, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)) AS x, count(*) AS k FROM r WHERE length(w) >= 7 GROUP BY ALL),
hs AS (SELECT w, k, {_crc('x')} AS h, length(w) AS l FROM o, {_CRC_TABLE}),
words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN substring(w, 1, CAST(h % l AS INT)) || substring(w, CAST(h % l AS INT) + 2) ELSE w END AS word, k FROM hs) WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
del AS (SELECT word, n, i, substring(word, 1, CAST(i AS INT)) || substring(word, CAST(i AS INT) + 2) AS rest FROM words, range(length(word)) t(i)),
near AS (SELECT a.word AS x, b.word AS y, b.n AS m FROM del a JOIN del b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word UNION SELECT a.word, b.word, b.n FROM del a JOIN words b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM del a JOIN words b ON a.rest = b.word),
best AS (SELECT x, y, m, count(*) OVER (PARTITION BY x) AS n_near, row_number() OVER (PARTITION BY x ORDER BY m DESC, y) AS place FROM near),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN y END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n FROM words LEFT JOIN best ON x = word AND place = 1),
walk(word, root, d) AS (SELECT word, word, 0 FROM f UNION ALL SELECT walk.word, f.form, d + 1 FROM walk JOIN f ON f.word = walk.root WHERE f.form IS NOT NULL),
roots AS (SELECT word, arg_max(root, d) AS root FROM walk GROUP BY word)
SELECT f.word, n, n_near, form, form_n, root FROM f JOIN roots ON roots.word = f.word"""

NEAREST = """
WITH d AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
v AS (SELECT vec_id, list_transform(e, lambda x: floor(256 * x)) AS v FROM d WHERE len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = len(e)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 5"""
