"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

_STRIP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, len(string_split(text, chr(10))) AS n_lines FROM d),
g AS (SELECT r, p, count(*) OVER (PARTITION BY r, gram) AS n
      FROM (SELECT r, p, words[p] || ' ' || words[p + 1] || ' ' || words[p + 2] AS gram FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS p FROM w))),
c AS (SELECT r, count(DISTINCT q) AS n_repeat_words FROM (SELECT r, unnest([p, p + 1, p + 2]) AS q FROM g WHERE n > 1) GROUP BY r),
b AS (SELECT doc_id, text, words, n_lines, len(words) AS n_words, len(array_to_string(words, '')) AS word_chars, len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN c USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 14 * n_words OR 2 * n_dup_lines > n_lines
            OR 5 * len(list_filter(words, lambda x: NOT regexp_matches(x, '\p{L}'))) > n_words
            OR 2 * len(regexp_replace(text, '\P{Lu}+', '', 'g')) > word_chars
            OR 5 * len(list_filter(words, lambda x: x LIKE '%!!')) > n_words
            OR 10 * len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^[\x20\x09]*[-*•]'))) > 9 * n_lines
            OR 10 * len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09\x0D]*$'))) > 3 * n_lines) AS kept
FROM f
"""

OP5 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM h WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM h LEFT JOIN f USING (payload_digest)
"""

OP8 = rf"""
WITH rules(action, host, path) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
u AS (SELECT page_id, {_LOWER.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1)")} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
s AS (SELECT DISTINCT host, path FROM u),
m AS (SELECT s.host, s.path, r.host || r.path AS rule, r.action, row_number() OVER (PARTITION BY s.host, s.path ORDER BY len(r.host || r.path) DESC, len(r.host) DESC, r.action DESC) AS k
      FROM s JOIN rules r ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM u LEFT JOIN (SELECT * FROM m WHERE k = 1) USING (host, path)
"""

OP9 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, i, lines[i] AS line, {_LOWER.format(f"trim(lines[i], {_STRIP})")} AS key FROM (SELECT r, doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM d)),
f AS (SELECT key, min(doc_id) AS holder FROM l WHERE len(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
k AS (SELECT r, l.doc_id, i, line, coalesce(l.doc_id <> holder, false) AS gone FROM l LEFT JOIN f USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM k GROUP BY r
"""

OP12 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS anchor_id, a.label AS own, r.vec_id, r.label, list_dot_product(a.v::DOUBLE[], r.v::DOUBLE[])::BIGINT AS score FROM v a JOIN v r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
pos AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM p WHERE label = own) WHERE k <= 5),
neg AS (SELECT pos.anchor_id, pos.vec_id AS positive_id, pos.score AS positive_score, n.vec_id AS negative_id, n.score AS negative_score,
               row_number() OVER (PARTITION BY pos.anchor_id, pos.vec_id ORDER BY n.score DESC, n.vec_id) AS rank
        FROM pos JOIN p n ON n.anchor_id = pos.anchor_id AND n.label <> n.own AND 100 * n.score BETWEEN 30 * pos.score AND 90 * pos.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 10
"""

#: CRC-32 of a short ASCII text by its rule: each byte is met by XOR, then eight shifts by one bit with the fixed polynomial.
_CRC32 = "xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split({}, ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"

OP13 = f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS i, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, n, conv_id - conv_id % 100 AS base, {_CRC32.format("conv_id::VARCHAR")} % 6 AS h FROM (SELECT conv_id, count(*) AS n FROM t GROUP BY 1)),
k AS (SELECT c.*, least(h, coalesce(b.n, 0)) AS head FROM c LEFT JOIN (SELECT conv_id AS base, n FROM c) b USING (base)),
r AS (SELECT k.conv_id, i, role, text FROM k JOIN t ON t.conv_id = base AND i < h UNION ALL SELECT k.conv_id, i - h + head, role, text FROM k JOIN t ON t.conv_id = k.conv_id AND i >= h),
x AS (SELECT conv_id, i + 1 AS depth, len(text) AS n_chars, sha256(string_agg(sha256(len(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY i)) AS node FROM r UNION ALL SELECT conv_id, 0, 0, 'root' FROM k),
e AS (SELECT conv_id, arg_max(node, depth) AS node FROM x GROUP BY 1),
n AS (SELECT node, any_value(depth) AS depth, any_value(n_chars) AS n_chars, min(conv_id) AS conv_id, count(*) AS n_convs FROM x GROUP BY 1),
u AS (SELECT n.node, p.node AS parent FROM n JOIN x p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1),
w AS (SELECT n.*, u.parent, m.conv_id AS parent_conv_id, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN u USING (node) LEFT JOIN n m ON m.node = u.parent LEFT JOIN (SELECT parent AS node, count(*) AS n_children FROM u GROUP BY 1) ch ON ch.node = n.node),
s AS (SELECT a.node, count(*) FILTER (w.n_children = 0) AS n_leaves, sum((w.n_convs - 1) * w.n_chars) AS saved_tokens FROM w JOIN x a ON a.conv_id = w.conv_id AND a.depth <= w.depth GROUP BY 1),
d AS (SELECT node, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256 FROM e GROUP BY 1)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256 FROM w JOIN s USING (node) LEFT JOIN d USING (node)
"""

ORACLES: dict[str, str] = {"op2_quality_rules": OP2, "op5_warc": OP5, "op8_url_filters": OP8, "op9_line_dedup": OP9, "op12_hard_negatives": OP12, "op13_prefix_trie": OP13}
