"""The same queries in DuckDB SQL. Nothing here is made by the code it checks."""

from twinfold.plans.queries import LINK_SHAPES, RADIUS, RULES

# fixed values: cells of the closed curve through 8 x 8 cells, as x + 8 y
_CURVE = [
    59, 51, 50, 58, 57, 56, 48, 49, 41, 40, 32, 33, 34, 42, 43, 35, 27, 19, 18, 26, 25, 24, 16, 17, 9, 8, 0, 1, 2, 10, 11, 3,
    4, 12, 13, 5, 6, 7, 15, 14, 22, 23, 31, 30, 29, 21, 20, 28, 36, 44, 45, 37, 38, 39, 47, 46, 54, 55, 63, 62, 61, 53, 52, 60,
]


def _rises(of: str) -> str:
    return " || ".join(f"({of}[{_CURVE[k - 1] + 1}] < {of}[{_CURVE[k] + 1}])::INT" for k in range(64))


def _haar_sign(row: int, col: int, y: int, x: int) -> int:
    """The sign of cell (y, x) in a Haar coefficient, by the block it is about: right or lower half less the other."""
    if max(row, col) == 0:
        return 1
    blocks = 1 << max(row, col).bit_length() - 1
    side = 8 // blocks
    if (y // side, x // side) != (row % blocks, col % blocks):
        return 0
    return (-1 if row >= blocks and y % side < side // 2 else 1) * (-1 if col >= blocks and x % side < side // 2 else 1)


def _haar_scale(row: int, col: int) -> str:
    """Eight times the factor of a sum of 8 x 8 block means in an orthonormal coefficient of 32 x 32."""
    return str(8 * 4 / {0: 8, 1: 8, 2: 4, 3: 4}.get(max(row, col), 2))


_DIFF = _rises("embedding")
_WAVE = " || ".join("((" + " ".join(f"{'+' if w > 0 else '-'} g[{k + 1}]" for k in range(64) if (w := _haar_sign(c // 8, c % 8, k // 8, k % 8))) + ") >= 0)::INT" for c in range(64))


def _hex(of: str) -> str:
    return " || ".join(f"substr('0123456789abcdef', 1 + ({' + '.join(f'{8 >> j} * substr({of}, {4 * k + j + 1}, 1)::INT' for j in range(4))}), 1)" for k in range(16))


_H = f"h AS (SELECT vec_id AS idx, label::VARCHAR AS domain, {_DIFF} AS bits FROM embeddings)"
_DIST = "list_sum(list_transform(range(1, 65), lambda i: (x.bits[i] <> y.bits[i])::INT))::BIGINT"
_HOST = r"lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1))"
_GROUPED = """first AS (SELECT text, min(doc_id) AS primary_idx, count(*) - 1 AS dup_count FROM documents WHERE text IS NOT NULL AND text <> '' GROUP BY text),
g AS (SELECT d.doc_id AS idx, coalesce(f.primary_idx, d.doc_id) AS primary_idx, coalesce(f.dup_count, 0) AS dup_count FROM documents d LEFT JOIN first f USING (text))"""


def _closure(edges: str) -> str:
    return f"""v AS (SELECT a, b FROM ({edges}) UNION SELECT b, a FROM ({edges})),
r AS (SELECT a AS id, b AS reach FROM v UNION SELECT r.id, v.b FROM r JOIN v ON r.reach = v.a),
m AS (SELECT id, least(id, min(reach)) AS low FROM r GROUP BY id)"""


_NEAR = f"""WITH RECURSIVE {_H},
e AS (SELECT x.idx AS a, y.idx AS b FROM h x JOIN h y ON x.idx < y.idx WHERE {_DIST} <= {RADIUS}
  AND x.bits NOT IN (repeat('0', 64), repeat('1', 64), '1' || repeat('0', 63), '0' || repeat('1', 63)) AND y.bits NOT IN (repeat('0', 64), repeat('1', 64), '1' || repeat('0', 63), '0' || repeat('1', 63))),
{_closure("SELECT * FROM e")},
g AS (SELECT h.idx, coalesce(low, h.idx) AS primary_idx FROM h LEFT JOIN m ON m.id = h.idx)"""
_PIXEL = "CASE WHEN p = q THEN CASE WHEN p = '1' THEN '0.0.0' ELSE '255.255.255' END WHEN p = '1' THEN '127.0.0' ELSE '255.0.0' END"
_RULES = "(VALUES " + ", ".join(f"({p}, '{d}', {'NULL' if v is None else v})" for p, d, v in RULES) + ") AS t(pos, domain, value)"



def _picture(of: str, key: str, text: str) -> str:
    """px (key, k, v): whole means of the bytes of a text in 1024 equal stretches; gb (key, g): sums of 4 x 4 of them."""
    return f"""pt AS (SELECT {key}, hex(encode(coalesce({text}, ''))) AS h, strlen(coalesce({text}, '')) AS n FROM {of}),
pl AS (SELECT {key}, n, list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::INT) AS l FROM pt),
px AS (SELECT {key}, (i * 1024 - 1) // n AS k, (sum(b) // count(*))::BIGINT AS v FROM (SELECT {key}, n, unnest(l) AS b, generate_subscripts(l, 1) AS i FROM pl WHERE n >= 1024) GROUP BY ALL
  UNION ALL SELECT {key}, k, l[k * n // 1024 + 1]::BIGINT FROM (SELECT {key}, n, l, unnest(range(1024)) AS k FROM pl WHERE n BETWEEN 1 AND 1023)
  UNION ALL SELECT {key}, unnest(range(1024)), 0 FROM pl WHERE n = 0),
gb AS (SELECT {key}, list(s ORDER BY c) AS g FROM (SELECT {key}, k // 128 * 8 + k % 32 // 4 AS c, sum(v)::BIGINT AS s FROM px GROUP BY ALL) GROUP BY {key})"""


def _cosines(px: str, key: str) -> str:
    """db (key, bits): signs of the cosine coefficients, by diagonals; what is zero but for rounding counts as positive."""
    return f"""cs AS (SELECT f, x, cos((2 * x + 1) * f * pi() / 64) AS c FROM range(11) t(f), range(32) u(x)),
d1 AS (SELECT {key}, k // 32 AS y, f AS u, sum((v - 128) * c) AS a FROM {px} JOIN cs ON cs.x = k % 32 GROUP BY ALL),
d2 AS (SELECT {key}, u, f AS w, sum(a * c) AS a FROM d1 JOIN cs ON cs.x = y GROUP BY ALL),
db AS (SELECT {key}, string_agg((a >= -0.000001)::INT::VARCHAR, '' ORDER BY u + w, w) AS bits FROM d2 WHERE u + w BETWEEN 1 AND 10 AND NOT (u = 5 AND w = 5) GROUP BY {key})"""


def _number(of: str) -> str:
    """64 bits as a number, for bit_count(xor())."""
    return f"list_sum(list_transform(range(1, 65), lambda i: substr({of}, i, 1)::HUGEINT << (64 - i)))::HUGEINT"


_BLANK = "('0', '9223372036854775808', '9223372036854775807', '18446744073709551615')"
_GRID = "eg AS (SELECT vec_id AS idx, k, floor(embedding[k // 128 * 8 + k % 32 // 4 + 1]::DOUBLE * 1000 + 0.5) AS v FROM (SELECT *, unnest(range(1024)) AS k FROM embeddings))"

# the whole grouping of documents as items: hashed where a rule lets, linked by url and radius 8 within a domain, closed
_FINDER = f"""WITH RECURSIVE {_picture("documents", "doc_id", "text")},
i AS (SELECT doc_id AS idx, CASE WHEN n_chars % 4 = 0 THEN 'https://h/' || n_chars ELSE '' END AS url, source || '.' || lang AS domain, CASE WHEN doc_id % 13 <> 0 AND (lang <> 'de' OR source = 'src1') THEN {_rises("g")} END AS bits
  FROM documents JOIN gb USING (doc_id) WHERE doc_id % 11 <> 3),
hn AS (SELECT idx, domain, {_number("bits")} AS h FROM i WHERE bits IS NOT NULL),
e AS (SELECT min(idx) OVER (PARTITION BY url) AS a, idx AS b FROM i WHERE url <> ''
  UNION ALL SELECT x.idx, y.idx FROM hn x JOIN hn y ON x.domain = y.domain AND x.idx < y.idx AND bit_count(xor(x.h, y.h)) <= 8 WHERE x.h::VARCHAR NOT IN {_BLANK} AND y.h::VARCHAR NOT IN {_BLANK}),
{_closure("SELECT * FROM e WHERE a <> b")},
g2 AS (SELECT i.idx, bits, coalesce(low, i.idx) AS primary_idx FROM i LEFT JOIN m ON m.id = i.idx),
g3 AS (SELECT *, row_number() OVER (PARTITION BY primary_idx ORDER BY idx) - 1 AS pos, count(*) OVER (PARTITION BY primary_idx) - 1 AS dup_count FROM g2)"""

_EVENTS = """e AS (SELECT event_id AS idx, user_id::VARCHAR || '/' || event_type AS url, event_id % 10 <> 0 AS seen, (SELECT count(*) FROM events) AS n FROM events),
q AS (SELECT *, CASE WHEN idx < n // 4 THEN 0 WHEN idx < 2 * n // 4 THEN 1 WHEN idx < 3 * n // 4 THEN 2 ELSE 3 END AS b FROM e),
u AS (SELECT t.b, url, count(*) AS c, count_if(q.b = t.b) AS fresh, min(q.b) AS first FROM range(4) t(b) JOIN q ON q.b <= t.b WHERE seen GROUP BY ALL),
s AS (SELECT b, (SELECT count(*) FROM q WHERE q.b = u.b) AS num_links, count_if(first = b AND c > 1)::BIGINT AS batch_num_with_dups, (sum(fresh) - count_if(first = b))::BIGINT AS batch_total_dups, count_if(c > 1)::BIGINT AS num_with_dups, (sum(c) - count(*))::BIGINT AS total_dups FROM u GROUP BY b)"""


def _counted(n: str, noun: str) -> str:
    return f"{n} || ' {noun}' || CASE WHEN {n} = 1 THEN '' ELSE 's' END"


_KNOWN = _counted("num_with_dups", "item") + " || ' with ' || " + _counted("total_dups", "duplicate")

# pictures of fingerprints: each bit's coefficient of falling size, transformed back
_VISUALS = f"""WITH {_H},
hb AS (SELECT idx, unnest(range(64)) AS k, bits FROM h),
sg AS (SELECT idx, k, CASE WHEN bits[k + 1] = '1' THEN 1.0 ELSE -1.0 END::DOUBLE AS s FROM hb),
od AS (SELECT row_number() OVER (ORDER BY i, j) - 1 AS k, i - j AS u, j AS w FROM range(1, 11) t(i), range(11) r(j) WHERE j <= i AND NOT (i = 10 AND j = 5)),
cs AS (SELECT f, x, CASE WHEN f = 0 THEN sqrt(1 / 32) ELSE cos((2 * x + 1) * f * pi() / 64) * sqrt(2 / 32) END AS c FROM range(11) t(f), range(32) r(x)),
dw AS (SELECT k, cy.x * 32 + cx.x AS p, exp(-(u + w) / 3) * cx.c * cy.c AS v FROM od JOIN cs cx ON cx.f = u JOIN cs cy ON cy.f = w),
dp AS (SELECT idx, p, sum(s * v) AS v FROM sg JOIN dw USING (k) GROUP BY ALL),
wb AS (SELECT k, k // 8 AS r, k % 8 AS c, greatest(k // 8, k % 8) AS x FROM range(64) t(k)),
wl AS (SELECT *, CASE WHEN x = 0 THEN 1 WHEN x < 2 THEN 1 WHEN x < 4 THEN 2 ELSE 4 END AS blocks FROM wb),
ww AS (SELECT k, p, (CASE WHEN x = 0 THEN 1 WHEN x = 1 THEN 0.5 WHEN x < 4 THEN 0.25 ELSE 0.125 END) * blocks / 8.0 * (CASE WHEN x > 0 AND r >= blocks AND p // 8 % (8 // blocks) < 4 // blocks THEN -1 ELSE 1 END) * (CASE WHEN x > 0 AND c >= blocks AND p % 8 % (8 // blocks) < 4 // blocks THEN -1 ELSE 1 END) AS v
  FROM wl, range(64) t(p) WHERE x = 0 OR (p // 8 // (8 // blocks) = r % blocks AND p % 8 // (8 // blocks) = c % blocks)),
wp AS (SELECT idx, p, sum(s * v::DOUBLE) AS v FROM sg JOIN ww USING (k) GROUP BY ALL)"""


def _shown(of: str) -> str:
    return f"SELECT idx, string_agg((CASE WHEN hi = lo THEN 0 ELSE floor((v - lo) * 255 / (hi - lo) + 0.5) END)::INT::VARCHAR, ',' ORDER BY p) AS a FROM (SELECT *, min(v) OVER (PARTITION BY idx) AS lo, max(v) OVER (PARTITION BY idx) AS hi FROM {of}) GROUP BY idx"


# the base is the url without its last segment; a path's parts are folded from the left
_LINKS = f"""WITH s AS (SELECT page_id, url, [{", ".join(f"'{x}'" for x in LINK_SHAPES)}][page_id % {len(LINK_SHAPES)} + 1] AS link FROM pages),
b AS (SELECT *, regexp_extract(url, '^[a-z]+://[^/?#]*') AS origin, regexp_extract(url, '^[a-z]+://[^?#]*') AS page, regexp_extract(url, '^[^#]*') AS whole FROM s),
a AS (SELECT page_id, CASE WHEN link LIKE 'https:%' THEN link WHEN link LIKE '//%' THEN regexp_extract(url, '^[a-z]+:') || link WHEN link LIKE '/%' THEN origin || link WHEN link = '' THEN whole
  WHEN link LIKE '?%' THEN page || link WHEN link LIKE '#%' THEN whole || link ELSE CASE WHEN page = origin THEN origin || '/' ELSE regexp_replace(page, '[^/]*$', '') END || link END AS u FROM b),
p AS (SELECT page_id, regexp_extract(u, '^[a-z]+://[^/?#]*') AS origin, string_split(substr(regexp_extract(u, '^[a-z]+://[^/?#]*([^?#]*)', 1), 2), '/') AS parts, regexp_extract(u, '^[^?#]*(.*)$', 1) AS rest FROM a),
f AS (SELECT *, list_transform(parts, lambda x: replace(lower(x), '%2e', '.')) AS plain FROM p),
k AS (SELECT *, list_reduce(list_transform(range(len(parts)), lambda i: [i]), lambda done, x: CASE plain[x[1] + 1] WHEN '.' THEN done WHEN '..' THEN done[1:len(done) - 1] ELSE done || x END, []::BIGINT[]) AS kept FROM f)
SELECT page_id, origin || '/' || array_to_string(list_transform(kept, lambda i: parts[i + 1]) || CASE WHEN plain[len(plain)] IN ('.', '..') THEN [''] ELSE [] END, '/') || rest AS link FROM k"""

ORACLE = {
    "exact_key_star_edges": "SELECT a, doc_id AS b FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS a FROM documents WHERE text IS NOT NULL AND text <> '') WHERE a < doc_id",
    "exact_key_groups": f"WITH {_GROUPED} SELECT idx, primary_idx, idx = primary_idx AS is_primary, row_number() OVER (PARTITION BY primary_idx ORDER BY idx) - 1 AS pos, dup_count, idx <> primary_idx AS hidden FROM g",
    "exact_key_stats": f"WITH {_GROUPED} SELECT count_if(dup_count > 0)::BIGINT AS num_with_dups, sum(dup_count)::BIGINT AS total_dups FROM g WHERE idx = primary_idx",
    "dup_labels": f"WITH {_GROUPED} SELECT idx, '(' || dup_count || ' duplicate' || CASE WHEN dup_count = 1 THEN '' ELSE 's' END || ' — show)' AS label FROM g WHERE idx = primary_idx AND dup_count > 0",
    "group_members": f"WITH {_GROUPED} SELECT primary_idx, string_agg(idx::VARCHAR, ',' ORDER BY idx) AS members FROM (SELECT *, (row_number() OVER (PARTITION BY primary_idx ORDER BY idx) - 1) // 1000 AS part FROM g WHERE dup_count > 0) GROUP BY primary_idx, part",
    "null_key_semantics": "SELECT a, doc_id AS b FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY CASE WHEN lang <> 'en' THEN lang ELSE '' END, quality * 7 + toxic) AS a FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL) WHERE a < doc_id",
    "host_extract": f"SELECT page_id, {_HOST} AS host FROM pages",
    "domain_normalize": f"SELECT page_id, regexp_replace({_HOST}, '^www\\.', '') AS domain FROM pages",
    "domain_sort_key": f"SELECT page_id, array_to_string(list_reverse(string_split({_HOST}, '.')), '.') AS sort_key FROM pages",
    "suffix_rule_lookup": f"""WITH rule AS (SELECT domain, arg_max(value, pos) AS value FROM {_RULES} WHERE value IS NOT NULL GROUP BY domain),
p AS (SELECT page_id, {_HOST} AS domain FROM pages),
f AS (SELECT page_id, arg_max(value, length(rule.domain)) AS value FROM p JOIN rule ON p.domain = rule.domain OR ends_with(p.domain, '.' || rule.domain) GROUP BY page_id)
SELECT page_id, domain, coalesce(value, true) AS process FROM p LEFT JOIN f USING (page_id)""",
    "allowlist_https": f"""WITH p AS (SELECT page_id, replace(url, '.example.com', '.thumbs.redditmedia.com') AS url FROM pages)
SELECT page_id, CASE WHEN ends_with({_HOST}, '.thumbs.redditmedia.com') THEN regexp_replace(url, '^http:', 'https:') END AS fetch_url, CASE WHEN NOT ends_with({_HOST}, '.thumbs.redditmedia.com') THEN 'host is not allowed' END AS error FROM p""",
    "domain_typed": f"SELECT page_id, regexp_replace({_HOST}, '^www\\.', '') AS domain, array_to_string(list_reverse(string_split({_HOST}, '.')), '.') AS sort_key, false AS typed_valid FROM pages",
    "page_routing": """SELECT page_id, CASE WHEN page_id % 7 IN (2, 4, 6) THEN 'listing page' WHEN page_id % 7 = 3 THEN 'search page' END AS page_type,
CASE WHEN page_id % 7 IN (2, 4, 6) THEN '#siteTable' WHEN page_id % 7 = 3 THEN '.search-result-group:last' END AS container,
CASE page_id % 7 WHEN 0 THEN 'no body class' WHEN 1 THEN 'single page' WHEN 5 THEN 'other' END AS reason FROM pages""",
    "item_ordinals": "SELECT o_orderkey, idx FROM (SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx FROM orders) WHERE o_orderstatus <> 'F'",
    "diff_hash_hex": f"WITH {_H} SELECT idx, {_hex('bits')} AS hash_hex FROM h",
    "wavelet_hash_hex": f"WITH g AS (SELECT vec_id AS idx, list_transform(embedding, lambda v: floor(v::DOUBLE * 1000 + 0.5)) AS g FROM embeddings), w AS (SELECT idx, {_WAVE} AS bits FROM g) SELECT idx, {_hex('bits')} AS hash_hex FROM w",
    "hash_bits": f"WITH {_H} SELECT idx, bits FROM h",
    "hash_codec": f"WITH {_H}, n AS (SELECT idx, {_hex('bits')} AS x, (list_sum(list_transform(range(2, 65), lambda i: bits[i]::HUGEINT << (64 - i))) - bits[1]::HUGEINT * 9223372036854775808)::BIGINT AS v FROM h) SELECT idx, base64(unhex(x)) AS base64, v AS from_base64, v AS from_hex FROM n",
    "hash_bitmap": f"WITH {_H} SELECT idx, array_to_string(list_transform(range(1, 65), lambda i: {_PIXEL.replace('p =', 'bits[i] =').replace('= q', '= (bits[1] || bits[:63])[i]')}), ' ') AS bitmap FROM h",
    "blank_filter": f"WITH {_H} SELECT idx, domain AS part, {_hex('bits')} AS hash_hex FROM h WHERE idx % 5 > 1 AND bits NOT IN (repeat('0', 64), repeat('1', 64), '1' || repeat('0', 63), '0' || repeat('1', 63))",
    "hamming_pairs": f"WITH {_H} SELECT * FROM (SELECT x.idx AS a, y.idx AS b, {_DIST}::INT AS distance FROM h x JOIN h y ON x.idx < y.idx) WHERE distance <= {RADIUS}",
    "hamming_pairs_partitioned": f"WITH {_H} SELECT * FROM (SELECT x.idx AS a, y.idx AS b, {_DIST}::INT AS distance FROM h x JOIN h y ON x.idx < y.idx AND x.domain = y.domain) WHERE distance <= {RADIUS + 4}",
    "near_dup_groups": _NEAR + " SELECT idx, primary_idx, row_number() OVER (PARTITION BY primary_idx ORDER BY idx) - 1 AS pos, count(*) OVER (PARTITION BY primary_idx) - 1 AS dup_count FROM g",
    "near_dup_stats": _NEAR + " SELECT count_if(n > 1)::BIGINT AS num_with_dups, sum(n - 1)::BIGINT AS total_dups FROM (SELECT count(*) AS n FROM g GROUP BY primary_idx)",
    "combined_edges_groups": f"""WITH RECURSIVE i AS (SELECT doc_id AS idx, text AS url, coalesce(lang, '') AS part, CASE WHEN toxic = 1 THEN n_chars END AS hash FROM documents LEFT JOIN labels USING (doc_id)),
e AS (SELECT min(idx) OVER (PARTITION BY url) AS a, idx AS b FROM i WHERE url <> '' UNION ALL SELECT min(idx) OVER (PARTITION BY part, hash), idx FROM i WHERE hash IS NOT NULL AND hash NOT IN (0, -1)),
{_closure("SELECT * FROM e WHERE a <> b")}
SELECT idx, coalesce(low, idx) AS primary_idx, count(*) OVER (PARTITION BY coalesce(low, idx)) - 1 AS dup_count FROM i LEFT JOIN m ON m.id = i.idx""",
    "compare_to_one": f"WITH {_H}, o AS (SELECT * FROM h ORDER BY idx LIMIT 1) SELECT x.idx, CASE WHEN x.idx <> y.idx THEN {_DIST} END AS distance FROM h x, o y",
    "hash_hex_diff": f"WITH {_H}, n AS (SELECT idx, {_hex('bits')} AS a FROM h), s AS (SELECT idx, a, a[2:] || '0' AS b FROM n) SELECT idx, array_to_string(list_filter(range(1, 17), lambda i: a[i] <> b[i]), ',') AS differ FROM s",
    "grid_block_mean": "SELECT vec_id AS idx, array_to_string(list_transform(range(0, 4), lambda b: floor(list_sum(list_transform(range(0, 16), lambda k: embedding[((b // 2) * 4 + k // 4) * 8 + (b % 2) * 4 + k % 4 + 1]::DOUBLE)) / 16 * 1000 + 0.5)::BIGINT), ',') AS means FROM embeddings",
    "gray_normalize": "WITH g AS (SELECT vec_id AS idx, list_transform(embedding, lambda v: floor(v::DOUBLE * 1000)) AS g FROM embeddings) SELECT idx, array_to_string(list_transform(g, lambda v: CASE WHEN list_max(g) = list_min(g) THEN 0 ELSE floor((v - list_min(g)) * 255 / (list_max(g) - list_min(g)) + 0.5)::INT END), ',') AS levels FROM g",
    "batch_stats": """WITH e AS (SELECT event_id AS idx, user_id::VARCHAR || '/' || event_type AS url FROM events),
c AS (SELECT floor(avg(idx))::BIGINT AS cut, count(*) AS n FROM e),
w AS (SELECT idx, url, min(CASE WHEN idx < cut THEN idx END) OVER (PARTITION BY url) AS p0, min(idx) OVER (PARTITION BY url) AS p1, count_if(idx < cut) OVER (PARTITION BY url) AS n0, count(*) OVER (PARTITION BY url) AS n1, cut, n FROM e, c),
k AS (SELECT *, idx BETWEEN cut AND cut + (n - cut) AS inside FROM w WHERE idx >= cut OR idx = p0)
SELECT count_if(inside AND idx = p1 AND (idx >= cut OR n0 = 1) AND n1 > 1)::BIGINT AS batch_num_with_dups, count_if(inside AND idx <> p1)::BIGINT AS batch_total_dups FROM k""",
    "text_block_mean": f"WITH {_picture('documents', 'doc_id', 'text')} SELECT doc_id, array_to_string(list_transform(g, lambda v: floor(v / 16 * 1000 + 0.5)::BIGINT), ',') AS means FROM gb",
    "text_diff_hash_hex": f"WITH {_picture('documents', 'doc_id', 'text')}, h AS (SELECT doc_id, {_rises('g')} AS bits FROM gb) SELECT doc_id, {_hex('bits')} AS hash_hex FROM h",
    "dct_hash_hex": f"WITH {_picture('documents', 'doc_id', 'text')}, {_cosines('px', 'doc_id')} SELECT doc_id, {_hex('bits')} AS hash_hex FROM db",
    "hash_visuals": f"{_VISUALS} SELECT d.idx, d.a AS dct, w.a AS wavelet FROM ({_shown('dp')}) d JOIN ({_shown('wp')}) w USING (idx)",
    "finder_groups": f"""{_FINDER} SELECT idx, primary_idx, idx = primary_idx AS is_primary, pos, dup_count, idx <> primary_idx AND primary_idx % 2 = 1 AS hidden,
  CASE WHEN idx = primary_idx AND dup_count > 0 THEN '(' || {_counted('dup_count', 'duplicate')} || CASE WHEN primary_idx % 2 = 0 THEN ' — hide)' ELSE ' — show)' END END AS label, CASE WHEN bits IS NOT NULL THEN {_hex('bits')} END AS hash_hex FROM g3""",
    "shown_hashes": f"""WITH RECURSIVE {_picture("documents", "doc_id", "text")},
i AS (SELECT doc_id AS idx, CASE WHEN n_chars % 4 = 0 THEN n_chars END AS url, CASE WHEN doc_id % 13 <> 0 THEN {_rises("g")} END AS bits FROM documents JOIN gb USING (doc_id) WHERE doc_id % 11 <> 3),
e AS (SELECT min(idx) OVER (PARTITION BY url) AS a, idx AS b FROM i WHERE url IS NOT NULL UNION ALL SELECT min(idx) OVER (PARTITION BY bits), idx FROM i WHERE bits IS NOT NULL AND bits NOT IN (repeat('0', 64), repeat('1', 64), '1' || repeat('0', 63), '0' || repeat('1', 63))),
{_closure("SELECT * FROM e WHERE a <> b")} SELECT i.idx, coalesce(low, i.idx) AS primary_idx, ' [' || {_hex('bits')} || ']' AS hash_hex FROM i LEFT JOIN m ON m.id = i.idx""",
    "incremental_groups": f"{_FINDER} SELECT idx, primary_idx FROM g3",
    "incremental_stats": f"""WITH {_EVENTS} SELECT b AS batch_id, num_links, batch_num_with_dups, batch_total_dups, num_with_dups, total_dups,
  CASE WHEN batch_total_dups = 0 THEN 'No duplicates found' WHEN batch_total_dups = total_dups THEN 'Found ' || {_KNOWN} ELSE 'Found ' || {_counted('batch_total_dups', 'duplicate')} || ', total ' || {_KNOWN} END AS message FROM s""",
    "monitor_status": f"WITH {_EVENTS} SELECT 'listing page' AS page_type, false AS ignored, true AS initialized, 0::BIGINT AS pending, 2 * (SELECT count(*) FROM events) AS num_links, num_with_dups, total_dups, true AS last_batch_error, 1::BIGINT AS failed_batches FROM s WHERE b = 3",
    "item_projection": r"""WITH p AS (SELECT page_id, url, CASE WHEN page_id % 3 <> 0 THEN regexp_extract(url, '^[a-z]+://[^/?#]*') || '/r/' || page_id WHEN page_id % 9 <> 0 THEN 'https://Other.example/' || page_id END AS link FROM pages)
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'listing page' ELSE 'search page' END AS page_type, CASE WHEN page_id % 2 = 0 THEN url ELSE link END AS url,
  CASE WHEN page_id % 2 = 0 THEN 'Data' || page_id % 9 WHEN link IS NOT NULL THEN lower(regexp_extract(link, '^[a-z]+://([^/:?#]+)', 1)) END AS domain FROM p""",
    "rule_list": f"""WITH l AS (SELECT pos, domain, value FROM {_RULES} UNION ALL SELECT 1000 + min(page_id), {_HOST} AS host, count(*) % 2 = 0 FROM pages GROUP BY host),
k AS (SELECT *, array_to_string(list_reverse(string_split(domain, '.')), '.') AS sort_key FROM l), f AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY sort_key ORDER BY pos DESC) = 1)
SELECT domain, value, sort_key, count(*) OVER () AS n_rules FROM f""",
    "settings_round_trip": "SELECT * FROM (VALUES ('absent', '8'), ('hashFunction', 'diffHash'), ('maxHammingDistance', '5'), ('domainSettings', 'de=False,src1.de=True,fr=None'), ('partitionByDomain', 'True'), ('reset', 'dctHash')) AS t(name, value)",
    "image_replies": f"""WITH {_picture('pages', 'page_id', 'html')}, r AS (SELECT page_id, replace(url, '.example.com', '.thumbs.redditmedia.com') AS url FROM pages),
o AS (SELECT page_id, CASE WHEN ends_with({_HOST}, '.thumbs.redditmedia.com') THEN regexp_replace(url, '^http:', 'https:') END AS wanted FROM r), f AS (SELECT wanted, min(page_id) FILTER (WHERE page_id % 5 <> 0) AS id FROM o WHERE wanted IS NOT NULL GROUP BY wanted),
h AS (SELECT page_id AS id, {_rises('g')} AS bits FROM gb), x AS (SELECT wanted, base64(unhex({_hex('bits')})) AS reply FROM f JOIN h USING (id))
SELECT page_id, reply, CASE WHEN reply IS NULL THEN 'Failed to get image hash' END AS error FROM o LEFT JOIN x USING (wanted)""",
    "image_files_hashed": f"""WITH g AS (SELECT vec_id AS idx, list_transform(embedding, lambda v: floor(v::DOUBLE * 1000)) AS g FROM embeddings),
l AS (SELECT idx, list_transform(g, lambda v: CASE WHEN list_max(g) = list_min(g) THEN 0 ELSE floor((v - list_min(g)) * 255 / (list_max(g) - list_min(g)) + 0.5)::INT END) AS l FROM g),
s AS (SELECT idx, list_transform(l, lambda v: v + v * 3 % 256 + 255 - v) AS s FROM l), b AS (SELECT idx, s, {_rises('s')} AS bits FROM s)
SELECT idx, CASE WHEN idx % 7 <> 0 THEN {_hex('bits')} END AS hash_hex, CASE WHEN idx % 7 <> 0 THEN array_to_string(list_transform(s, lambda v: floor(v / 3 + 0.5)::INT), ',') END AS gray FROM b""",
    "transforms_restored": "WITH g AS (SELECT vec_id AS idx, array_to_string(list_transform(embedding, lambda v: floor(v::DOUBLE * 1000 + 0.5)::INT), ',') AS g FROM embeddings) SELECT idx, g AS haar, g AS cosine FROM g",
    "sql_functions": f"""WITH {_GRID}, {_cosines('eg', 'idx')}, {_H}, w AS (SELECT list_transform(embedding, lambda v: floor(v::DOUBLE * 1000 + 0.5)) AS g, vec_id AS idx FROM embeddings), t AS (SELECT idx, {_rises('g')} AS bits FROM w),
b AS (SELECT idx, CASE WHEN idx % 5 > 1 THEN t.bits END AS d, CASE WHEN idx % 5 > 1 THEN db.bits END AS c FROM t JOIN db USING (idx)) SELECT idx, {_hex('d')} AS diff_hex, {_hex('c')} AS dct_hex, bit_count(xor({_number('c')}, {_number('d')}))::INT AS apart FROM b""",
    "compare_all_to_one": f"""WITH {_GRID}, {_cosines('eg', 'idx')}, w AS (SELECT vec_id AS idx, list_transform(embedding, lambda v: floor(v::DOUBLE * 1000 + 0.5)) AS g FROM embeddings),
t AS (SELECT idx, {_number(f'({_rises("g")})')} AS d, {_number(f'({_WAVE})')} AS w, {_number('db.bits')} AS c FROM w JOIN db USING (idx)), o AS (SELECT * FROM t ORDER BY idx LIMIT 1)
SELECT t.idx, CASE WHEN t.idx <> o.idx THEN bit_count(xor(t.d, o.d)) END::INT AS diff_distance, CASE WHEN t.idx <> o.idx THEN bit_count(xor(t.w, o.w)) END::INT AS wavelet_distance, CASE WHEN t.idx <> o.idx THEN bit_count(xor(t.c, o.c)) END::INT AS dct_distance FROM t, o""",
    "haar_coefficients": f"""WITH g AS (SELECT vec_id AS idx, list_transform(embedding, lambda v: floor(v::DOUBLE * 1000 + 0.5)) AS g FROM embeddings)
SELECT idx, array_to_string([{", ".join("floor((" + " ".join(f"{'+' if w > 0 else '-'} g[{k + 1}]" for k in range(64) if (w := _haar_sign(c // 8, c % 8, k // 8, k % 8))) + f") * {_haar_scale(c // 8, c % 8)} + 0.5)::INT" for c in range(64))}], ',') AS corner,
  array_to_string(list_transform(range(16), lambda b: list_sum(list_transform(range(4), lambda k: g[(b // 4 * 2 + k // 2) * 8 + b % 4 * 2 + k % 2 + 1]))::INT), ',') AS smooth FROM g""",
    "image_samples": """WITH p AS (SELECT vec_id AS idx, unnest(range(1024)) AS s FROM embeddings WHERE vec_id % 4 <> 0), q AS (SELECT idx, s // 32 AS r, s % 32 AS c, (2 * (s // 32) + 1) * 43 // 64 AS y, (2 * (s % 32) + 1) * 51 // 64 AS x FROM p)
SELECT idx, 51 AS width, 43 AS height, sum(((x * 5 + idx) % 256 + (y * 7 + idx * 3) % 256 + (x * y + idx) % 256) * (c + 1) * (2 * r + 1))::BIGINT AS samples FROM q GROUP BY idx""",
    "link_resolution": _LINKS,
    "listing_order": f"WITH {_GROUPED} SELECT idx, primary_idx, idx <> primary_idx AS hidden, row_number() OVER (ORDER BY primary_idx, idx) - 1 AS place FROM g",
    "settings_applied": f"WITH p AS (SELECT page_id, {_HOST} AS domain FROM pages), r AS (SELECT domain, count(*) % 2 = 0 AS value FROM p GROUP BY domain) SELECT page_id, (SELECT arg_max(value, length(r.domain)) FROM r WHERE p.domain = r.domain OR ends_with(p.domain, '.' || r.domain)) AS process, 5 AS radius FROM p",
    "streamed_groups": "SELECT event_id AS idx, min(event_id) OVER (PARTITION BY user_id, event_type) AS primary_idx FROM events WHERE event_id % 10 <> 0",
    "shown_sizes": "WITH d AS (SELECT doc_id, n_chars AS w, doc_id % 300 + 1 AS h FROM documents) SELECT doc_id, (CASE WHEN greatest(w, h) <= 128 THEN w ELSE floor(w * (128.0::DOUBLE / greatest(w, h))) END)::INT AS width, (CASE WHEN greatest(w, h) <= 128 THEN h ELSE floor(h * (128.0::DOUBLE / greatest(w, h))) END)::INT AS height FROM documents JOIN d USING (doc_id)",
}
