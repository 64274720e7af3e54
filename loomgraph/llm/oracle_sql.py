"""DuckDB SQL for the rows of those queries that SQL can express, written apart from the operators."""

from __future__ import annotations

REPEATS = """
WITH t AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
o AS (SELECT r, 500 * c AS o, substr(h, 1000 * c + 1, 1798) AS h FROM (SELECT r, h, unnest(range(0, (length(h) // 2 - 400) // 500 + 1)) AS c FROM t WHERE length(h) >= 800)),
w AS (SELECT r, o + p AS p, md5(substr(h, 2 * p + 1, 800)) AS m FROM (SELECT r, o, h, unnest(range(0, length(h) // 2 - 399)) AS p FROM o)),
d AS (SELECT r, p FROM w WHERE m IN (SELECT m FROM w GROUP BY 1 HAVING count(*) > 1)),
n AS (SELECT r, p, (p > coalesce(lag(p) OVER (PARTITION BY r ORDER BY p), -1000) + 400)::INT AS new FROM d),
s AS (SELECT r, min(p) AS a, max(p) + 400 AS b FROM (SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p) AS k FROM n) GROUP BY r, k),
g AS (SELECT s.r, a, b, coalesce(lag(b) OVER (PARTITION BY s.r ORDER BY a), 0) AS before FROM s),
k AS (SELECT g.r, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM g JOIN t ON t.r = g.r GROUP BY 1)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(from_hex(coalesce(kept || substr(h, 2 * last + 1), h))) AS kept_sha256 FROM t LEFT JOIN k USING (r)
"""

JACCARD = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS both_ FROM u a JOIN u b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
p AS (SELECT *, na = nb AND both_ = na AS same FROM c WHERE both_ >= 0.8 * (na + nb - both_) - 1e-9),
reach AS (SELECT doc_id AS a, doc_id AS r FROM documents UNION SELECT reach.a, p.b FROM reach JOIN p ON p.a = reach.r),
m AS (SELECT a, min(r) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(least(d.doc_id, (SELECT min(b) FROM p WHERE p.a = d.doc_id AND same)), d.doc_id) AS class_id, (SELECT count(*) FROM p WHERE p.a = d.doc_id) AS n_links, component_id, component_id = d.doc_id AS kept FROM documents d JOIN m ON m.a = d.doc_id
"""

VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, label, [x::DOUBLE FOR x IN embedding] AS e FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS r FROM v UNION SELECT reach.a, p.b FROM reach JOIN p ON p.a = reach.r)
SELECT a AS vec_id, (SELECT count(*) FROM p WHERE p.a = reach.a) AS n_links, min(r) AS component_id, min(r) = a AS kept FROM reach GROUP BY a
"""

_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
_ALLOWED = r"^(?:[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}|(?i:.*(?:example|placeholder|sample|dummy|xxxx).*)|[0-9_/=+-]+|(?:[A-Za-z]+[-_/])+[A-Za-z]*[0-9]{0,4})$"


def _hits(name: str, kind: int, form: str) -> str:
    return f"""{name} AS (SELECT r, {kind} AS kind, hit, list_sum([length(x) FOR x IN gaps[1:k]]) + coalesce(list_sum([length(x) FOR x IN hits[1:k - 1]]), 0) AS a FROM
  (SELECT r, gaps, hits, k, hits[k] AS hit FROM (SELECT r, gaps, hits, unnest(range(1, len(hits) + 1)) AS k FROM (SELECT r, string_split_regex(text, '{form}') AS gaps, regexp_extract_all(text, '{form}') AS hits FROM t WHERE regexp_matches(text, '{form}')))))"""


SECRETS = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
{_hits("h0", 0, _ASSIGN)},
{_hits("h1", 1, "AKIA[A-Z0-9]+")},
{_hits("h2", 2, "[0-9a-f]{32,}")},
{_hits("h3", 3, _CANDIDATE)},
base AS (SELECT r, kind, a, a + length(hit) AS b FROM (SELECT * FROM h0 WHERE length(regexp_extract(hit, '{_ASSIGN}', 2)) >= 8 UNION ALL SELECT * FROM h1 WHERE length(hit) >= 16 UNION ALL SELECT * FROM h2)),
cand AS (SELECT row_number() OVER () AS c, r, kind, hit, a, a + length(hit) AS b, CASE WHEN regexp_matches(hit, '^[0-9a-f-]+$') OR regexp_matches(hit, '^[0-9A-F-]+$') THEN 3.0 WHEN regexp_matches(hit, '^[A-Za-z0-9]+$') THEN 3.7 ELSE 3.8 END AS bits
  FROM h3 WHERE regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Za-z]') AND NOT regexp_matches(hit, '{_ALLOWED}')),
win AS (SELECT c, p, unnest(string_split(substr(hit, p, 20), '')) AS ch FROM (SELECT c, hit, unnest(range(1, length(hit) - 18)) AS p FROM cand)),
ent AS (SELECT c, max(h) AS h FROM (SELECT c, p, log2(20) - sum(n * log2(n)) / 20 AS h FROM (SELECT c, p, ch, count(*) AS n FROM win GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1),
extra AS (SELECT r, kind, a, b FROM cand JOIN ent USING (c) WHERE round(h, 9) >= bits AND NOT EXISTS (SELECT 1 FROM base x WHERE x.r = cand.r AND x.a < cand.b AND cand.a < x.b)),
spans AS (SELECT r, kind, a, (['assign', 'access', 'hex', 'entropy'])[kind + 1] || ':' || a || ':' || b AS s, kind < 3 AS base FROM (SELECT * FROM base UNION ALL SELECT * FROM extra)),
per AS (SELECT r, count(*) FILTER (WHERE kind = 0) AS n0, count(*) FILTER (WHERE kind = 1) AS n1, count(*) FILTER (WHERE kind = 2) AS n2, string_agg(s, ',' ORDER BY a, kind) FILTER (WHERE base) AS b, string_agg(s, ',' ORDER BY a, kind) AS s FROM spans GROUP BY 1)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(s, '') AS spans FROM t LEFT JOIN per USING (r)
"""

#: SHA-1 as 32 groups of five bits in the alphabet of base32.
WARC = """
WITH t AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages)
SELECT page_id, payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + (i * 5) // 4, 2) || CASE WHEN (i * 5) // 4 >= 39 THEN '0' ELSE '' END)::BIGINT >> (3 - (i * 5) % 4)) & 31)::INT, 1) FOR i IN range(0, 32)], '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM t
"""

#: CRC-32 of a decimal number, bit by bit.
_CRC = """xor(list_reduce([4294967295::BIGINT] || [ascii(x)::BIGINT FOR x IN string_split(conv_id::VARCHAR, '')],
  lambda c, b: list_reduce([xor(c, b)] || range(0, 8), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295)"""

PREFIXES = rf"""
WITH r AS (SELECT conv_id, turn, length(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || coalesce(text, '') AS e, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(e)) AS i FROM r),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {_CRC} % 4 AS h FROM (SELECT DISTINCT conv_id FROM r)),
q AS (SELECT c.conv_id, 0 AS own, i, e, w FROM c JOIN t ON t.conv_id = base AND i <= h UNION ALL SELECT c.conv_id, 1, i, e, w FROM c JOIN t ON t.conv_id = c.conv_id AND i > h),
s AS (SELECT c.conv_id, coalesce(list(e ORDER BY own, i) FILTER (e IS NOT NULL), []) AS p, coalesce(list(w ORDER BY own, i) FILTER (e IS NOT NULL), []) AS w FROM c LEFT JOIN q ON q.conv_id = c.conv_id GROUP BY 1),
n AS (SELECT conv_id, d, p[1:d] AS k, d = len(p) AS ending, CASE WHEN d > 0 THEN w[d] ELSE 0 END AS w FROM (SELECT *, unnest(range(0, len(p) + 1)) AS d FROM s)),
g AS (SELECT d, k, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ending), '')) AS ends_sha256, min(w) AS w FROM n GROUP BY 1, 2),
f AS (SELECT d, k, count(*) AS n FROM (SELECT d - 1 AS d, k[1:d - 1] AS k FROM g WHERE d > 0) GROUP BY 1, 2),
v AS (SELECT g.*, coalesce(f.n, 0) AS n_children FROM g LEFT JOIN f ON f.d = g.d AND f.k = g.k),
a AS (SELECT e AS d, k[1:e] AS k, sum((n_convs - 1) * w)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM v) GROUP BY 1, 2)
SELECT v.conv_id, v.d AS depth, o.conv_id AS parent_conv_id, v.n_convs, v.n_children, a.n_leaves, a.saved_tokens, v.ends_sha256 FROM v JOIN a ON a.d = v.d AND a.k = v.k LEFT JOIN g o ON o.d = v.d - 1 AND o.k = v.k[1:v.d - 1]
"""

FILTER_AUDIT = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x FROM documents),
w AS (SELECT doc_id, part, x, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n, len(list_distinct(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))) AS u, min(doc_id) OVER (PARTITION BY x) AS first FROM d),
b AS (SELECT doc_id, part, (n < 100)::INT + 2 * (100 * u < 80 * n)::INT + 4 * (100 * (length(x) - length(regexp_replace(x, '[A-Z]', '', 'g'))) > 10 * length(x))::INT + 8 * regexp_matches(x, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, false)::INT AS f FROM w),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, f, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS t FROM b LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
s AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
p AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM s a, s b, s c, s d, s e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
o AS (SELECT o, k::INT AS k, 1 << (ascii(o[k:k]) - 65) AS own, list_sum([0] || [1 << (ascii(y) - 65) FOR y IN string_split(o[1:k - 1], '') IF y <> '']) AS before FROM (SELECT o, unnest(range(1, 6)) AS k FROM p)),
z AS (SELECT part, o AS filter_order, k AS step, own, sum(n * ((f & (own | before)) = 0)::INT) AS kept, sum(n * (f & before = 0 AND f & own > 0)::INT) AS removed, sum(n * (f & before > 0 AND f & own > 0)::INT) AS redundant,
  sum(n * (f = own)::INT) AS unique_fails, sum(g * (f & before = 0 AND f & own > 0)::INT) AS good_lost, sum(t * (f & before = 0 AND f & own > 0)::INT) AS toxic_lost FROM m, o GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM z
"""

ORACLE_SQL = {"op2_repeats": REPEATS, "op4_jaccard_join": JACCARD, "op6_near_vectors": VECTORS, "op7_warc": WARC, "op9_secret_scans": SECRETS, "op12_prefix_trie": PREFIXES, "op13_filter_audit": FILTER_AUDIT}
