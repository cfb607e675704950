"""DuckDB SQL for the corpus queries that SQL can express."""

_B32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((w{k} >> {35 - 5 * j}) & 31)::INT, 1)" for k in range(4) for j in range(8))

_WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, html,
  {", ".join(f"('0x' || substr(h, {10 * k + 1}, 10))::BIGINT AS w{k}" for k in range(4))} FROM p),
f AS (SELECT html, min(page_id) AS first FROM p GROUP BY html)
SELECT page_id, payload_bytes, {_B32} AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM d JOIN f USING (html)
"""

_EXACT = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""

_PREFERENCE = """
WITH s AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
u AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS turn, {'role': role, 'text': text} AS said FROM s),
z AS (SELECT conv_id, arg_max(turn, turn) AS fin, arg_max(stale, turn) AS stale FROM
  (SELECT conv_id, turn, coalesce(lag(said.text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS stale FROM u WHERE said.role = 'assistant') GROUP BY conv_id),
v AS (SELECT -1 - conv_id AS conv_id, turn, {'role': said.role, 'text': CASE WHEN turn = fin AND said.role = 'assistant' THEN stale ELSE said.text END} AS said FROM u JOIN z USING (conv_id) WHERE turn <= fin),
c AS (SELECT 0 AS kind, conv_id, list(said ORDER BY turn) AS turns FROM u GROUP BY conv_id
  UNION ALL SELECT 1, conv_id, list(said ORDER BY turn) FROM v GROUP BY conv_id
  UNION ALL SELECT 1, conv_id, list(said ORDER BY turn) FROM u JOIN z USING (conv_id) WHERE turn <= fin GROUP BY conv_id),
o1 AS (SELECT conv_id, sha256(role || chr(0) || text) AS sha FROM s QUALIFY turn = min(turn) OVER (PARTITION BY conv_id)),
k AS (SELECT conv_id, score, head FROM (SELECT conv_id, sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS score FROM s GROUP BY conv_id) JOIN (SELECT conv_id, min(sha) AS head FROM o1 GROUP BY conv_id) USING (conv_id)),
b AS (SELECT head, arg_max(conv_id, score * 1000000000 - conv_id) AS chosen FROM k GROUP BY head),
p AS (SELECT 0 AS kind, k.conv_id AS pair_id, b.chosen, k.conv_id AS rejected FROM k JOIN b USING (head) WHERE k.conv_id <> b.chosen
  UNION ALL SELECT 1, -1 - conv_id, conv_id, -1 - conv_id FROM z),
w AS (SELECT pair_id, chosen, rejected, x.turns AS a, y.turns AS b,
  coalesce(list_min(list_filter(range(1, 1 + least(len(x.turns), len(y.turns))), lambda i: x.turns[i] <> y.turns[i])) - 1, least(len(x.turns), len(y.turns))) AS k
  FROM p JOIN c x ON x.conv_id = chosen AND x.kind = p.kind JOIN c y ON y.conv_id = rejected AND y.kind = p.kind),
r AS (SELECT pair_id, chosen, rejected, k, a[1:k] AS q, a[k + 1:] AS ra, b[k + 1:] AS rb FROM w),
l AS (SELECT pair_id, 'a' AS side, unnest(ra) AS t, generate_subscripts(ra, 1) AS i FROM r UNION ALL SELECT pair_id, 'b', unnest(rb), generate_subscripts(rb, 1) FROM r),
o AS (SELECT pair_id, side, i, t, coalesce(sum(length(t.role) + length(t.text) + 14) OVER (PARTITION BY pair_id, side ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM l),
m AS (SELECT pair_id, side, string_agg((pos + 5 + length(t.role))::BIGINT || '-' || (pos + 5 + length(t.role) + length(t.text) + 9)::BIGINT, ',' ORDER BY i) AS mask FROM o WHERE t.role = 'assistant' GROUP BY ALL)
SELECT pair_id, chosen, rejected, k AS n_prompt_turns,
  coalesce(list_aggregate(list_transform(q, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || chr(10) || '<|end|>' || chr(10)), 'string_agg', ''), '') AS prompt,
  coalesce(list_aggregate(list_transform(ra, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || chr(10) || '<|end|>' || chr(10)), 'string_agg', ''), '') AS chosen_text,
  coalesce(list_aggregate(list_transform(rb, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || chr(10) || '<|end|>' || chr(10)), 'string_agg', ''), '') AS rejected_text,
  coalesce((SELECT mask FROM m WHERE m.pair_id = r.pair_id AND side = 'a'), '') AS chosen_mask,
  coalesce((SELECT mask FROM m WHERE m.pair_id = r.pair_id AND side = 'b'), '') AS rejected_mask
FROM r
"""

_LINES = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.doc_id, i, line, c.key IS NOT NULL AND k.doc_id <> c.keeper AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count_if(gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""

_WORDS = "list_filter(string_split_regex({}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"

_NEAR = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS sh FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
v AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT a AS id, b AS reach FROM v UNION SELECT r.id, v.b FROM r JOIN v ON r.reach = v.a),
m AS (SELECT id, min(reach) AS low FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id,
  d.doc_id <= coalesce(low, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.id = d.doc_id
"""

_SUFFIX = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, p, md5_number(substr(h, 2 * p + 1, 800)) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 399)) AS p FROM d WHERE n >= 400)),
g AS (SELECT doc_id, p FROM w QUALIFY count(*) OVER (PARTITION BY k) > 1),
r AS (SELECT doc_id, p, coalesce(p > lag(p) OVER q + 400, true) AS new FROM g WINDOW q AS (PARTITION BY doc_id ORDER BY p)),
t AS (SELECT doc_id, p, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM r),
s AS (SELECT doc_id, run, min(p) AS a, max(p) + 400 AS b FROM t GROUP BY ALL),
x AS (SELECT doc_id, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b FROM s GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(list_sum(b) - list_sum(a), 0)::BIGINT AS n_removed, coalesce(len(a), 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN a IS NULL THEN h ELSE array_to_string(list_transform(range(0, len(a) + 1), lambda i:
    substr(h, 2 * (CASE WHEN i = 0 THEN 0 ELSE b[i] END) + 1, 2 * ((CASE WHEN i = len(a) THEN n ELSE a[i + 1] END) - (CASE WHEN i = 0 THEN 0 ELSE b[i] END)))), '') END)) AS kept_sha256
FROM d LEFT JOIN x USING (doc_id)
"""

_SUBSTRING = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
k AS (SELECT doc_id, p, md5_number(array_to_string(w[p:p + 34], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35)),
g AS (SELECT doc_id, p FROM k QUALIFY count(*) OVER (PARTITION BY k) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS i FROM g),
u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
j AS (SELECT u.doc_id, u.i, word, c.i IS NOT NULL AS gone FROM u LEFT JOIN c ON c.doc_id = u.doc_id AND c.i = u.i),
a AS (SELECT doc_id, count(*) AS n_words, count_if(gone)::BIGINT AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM j GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN a USING (doc_id)
"""

# fixed values: the ladders of cutoffs, safest first, and what each is about
_LADDERS = {
    "n_symbols / n_words": [1.5, 1.2, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1],
    "n_dup_lines / nullif(n_lines, 0)": [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3],
    "n_repeat_words / n_words": [0.5, 0.48, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2],
    "n_capitals / nullif(word_chars, 0)": [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3],
}
_STEPS = ", ".join(f"({f}, {k}, {c}::DOUBLE)" for f, ladder in enumerate(_LADDERS.values()) for k, c in enumerate(ladder))
_VALUES = " UNION ALL ".join(f"SELECT doc_id, stratum, {f} AS f, ({value})::DOUBLE AS v FROM b WHERE NOT base_failed" for f, value in enumerate(_LADDERS))

# good documents may be rejected at 0.04 in all, 0.01 by each of four features, with an error of 0.05 shared among features and strata
_QUALITY = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
r AS (SELECT doc_id, count(DISTINCT i + s)::BIGINT AS n_repeat_words FROM (SELECT doc_id, i FROM (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) > 2)
  QUALIFY count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) > 1), range(3) z(s) GROUP BY doc_id),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
c AS (SELECT doc_id, stratum, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(ls) AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_capitals FROM l LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
q AS (SELECT doc_id, min(quality) >= 1 AS good FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
h AS (SELECT stratum, good, doc_id FROM b JOIN q USING (doc_id) WHERE NOT base_failed),
n AS (SELECT stratum, count_if(good)::BIGINT AS n_good, count(*) OVER () AS n_strata FROM h GROUP BY stratum),
v AS ({_VALUES}),
s AS (SELECT * FROM (VALUES {_STEPS}) AS t(f, place, cut)),
k AS (SELECT stratum, f, place, cut, count_if(good AND v > cut)::BIGINT AS rejected, count_if(NOT good AND v > cut)::BIGINT AS caught FROM v JOIN h USING (doc_id, stratum) JOIN s USING (f) GROUP BY ALL),
p AS (SELECT k.*, n_good, n_strata, CASE WHEN n_good <= 0 OR rejected >= n_good THEN 1.0 ELSE
  list_sum(list_transform(range(0, rejected + 1), lambda i: exp(lgamma(n_good + 1) - lgamma(i + 1) - lgamma(n_good - i + 1) + i * ln(0.01::DOUBLE) + (n_good - i) * ln(0.99::DOUBLE)))) END AS p FROM k JOIN n USING (stratum)),
f AS (SELECT *, bool_and(rejected <= 0.01 * n_good AND p <= 0.05::DOUBLE / (4 * n_strata)) OVER (PARTITION BY stratum, f ORDER BY place) AS certified FROM p),
x AS (SELECT stratum, f, arg_max(cut, caught * 100 - place) AS cut FROM f WHERE certified AND caught > 0 GROUP BY stratum, f),
y AS (SELECT DISTINCT doc_id FROM v JOIN x USING (stratum, f) WHERE v > cut)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND y.doc_id IS NULL AS kept FROM b LEFT JOIN y USING (doc_id)
"""

# fixed values: the primes of XXH64
_P1, _P2, _P3, _P4, _P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
_SEED, _M = 42, (1 << 64) - 1


def _u(x) -> str:
    return f"{x}::UHUGEINT"


def _low(x: str) -> str:
    """64 bits of a sum or product."""
    return f"(({x}) & {_u(_M)})"


def _turned(x: str, n: int) -> str:
    return f"(((({x}) << {n}) & {_u(_M)}) | (({x}) >> {64 - n}))"


def _number(h: str, at: str, size: int) -> str:
    """Little-endian bytes of a hex text, from byte `at`, as a number."""
    return "('0x' || " + " || ".join(f"substr({h}, 2 * ({at}) + {2 * k + 1}, 2)" for k in reversed(range(size))) + ")::UBIGINT::UHUGEINT"


def _lane(k: int) -> str:
    start = _SEED + (_P1 + _P2, _P2, 0, -_P1)[k]
    return f"list_reduce(list_transform(range(n // 32), lambda i: {_low(_number('h', f'32 * i + {8 * k}', 8) + f' * {_u(_P2)}')}), lambda v, x: {_low(_turned(_low('v + x'), 31) + f' * {_u(_P1)}')}, {_u(start & _M)})"


def _merged(acc: str, v: str) -> str:
    return _low(f"xor({acc}, {_low(_turned(_low(f'{v} * {_u(_P2)}'), 31) + f' * {_u(_P1)}')}) * {_u(_P1)} + {_u(_P4)}")


def _mixed(acc: str, shift: int, prime: int) -> str:
    return _low(f"xor({acc}, ({acc}) >> {shift}) * {_u(prime)}")


_STEP8 = _low(_turned("xor(a, x)", 27) + f" * {_u(_P1)} + {_u(_P4)}")
_STEP1 = _low(_turned("xor(a, x)", 11) + f" * {_u(_P1)}")

# XXH64 of distinct shingles, step by step, then the majority of each bit, links of all pairs of different fingerprints and their closure
_SIMHASH = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT doc_id, sh, count(*) AS c FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS sh FROM d) GROUP BY ALL),
x0 AS (SELECT DISTINCT sh, hex(encode(sh)) AS h, strlen(sh) AS n FROM s),
x1 AS (SELECT *, {", ".join(f"CASE WHEN n >= 32 THEN {_lane(k)} END AS v{k}" for k in range(4))} FROM x0),
x2 AS (SELECT *, {_low(" + ".join(_turned(f"v{k}", r) for k, r in enumerate((1, 7, 12, 18))))} AS m FROM x1),
x3 AS (SELECT *, {_merged("m", "v0")} AS m1 FROM x2), x4 AS (SELECT *, {_merged("m1", "v1")} AS m2 FROM x3), x5 AS (SELECT *, {_merged("m2", "v2")} AS m3 FROM x4),
x6 AS (SELECT sh, h, n, {_low(f"CASE WHEN n >= 32 THEN {_merged('m3', 'v3')} ELSE {_u(_SEED + _P5)} END + n::UHUGEINT")} AS a0 FROM x5),
x7 AS (SELECT sh, h, n, list_reduce(list_transform(range(n % 32 // 8), lambda i: {_low(_turned(_low(_number('h', 'n // 32 * 32 + 8 * i', 8) + f' * {_u(_P2)}'), 31) + f' * {_u(_P1)}')}), lambda a, x: {_STEP8}, a0) AS a FROM x6),
x8 AS (SELECT sh, h, n, CASE WHEN n % 8 >= 4 THEN {_low(_turned(f"xor(a, {_low(_number('h', 'n // 8 * 8', 4) + f' * {_u(_P1)}')})", 23) + f" * {_u(_P2)} + {_u(_P3)}")} ELSE a END AS a0 FROM x7),
x9 AS (SELECT sh, list_reduce(list_transform(range(n // 4 * 4, n), lambda i: {_low(_number('h', 'i', 1) + f' * {_u(_P5)}')}), lambda a, x: {_STEP1}, a0) AS a FROM x8),
y1 AS (SELECT sh, {_mixed("a", 33, _P2)} AS a FROM x9), y2 AS (SELECT sh, {_mixed("a", 29, _P3)} AS a FROM y1), y3 AS (SELECT sh, xor(a, a >> 32)::UBIGINT AS x FROM y2),
b AS (SELECT doc_id, {" + ".join(f"((2 * sum(c * ((x >> {k}) & 1)::BIGINT) > sum(c))::UHUGEINT << {k})" for k in range(64))} AS fp FROM s JOIN y3 USING (sh) GROUP BY doc_id),
f AS (SELECT doc_id, coalesce(fp, 0)::UBIGINT AS fp FROM d LEFT JOIN b USING (doc_id)),
n AS (SELECT fp, min(doc_id) AS node FROM f GROUP BY fp),
v AS (SELECT p.node AS a, q.node AS b FROM n p JOIN n q ON p.fp <> q.fp AND bit_count(xor(p.fp, q.fp)::HUGEINT) <= 2),
r AS (SELECT a AS id, b AS reach FROM v UNION SELECT r.id, v.b FROM r JOIN v ON r.reach = v.a),
m AS (SELECT id, min(reach) AS low FROM r GROUP BY id)
SELECT doc_id, lower(lpad(hex(fp), 16, '0')) AS fingerprint, least(node, coalesce(low, node)) AS component_id FROM f JOIN n USING (fp) LEFT JOIN m ON m.id = node
"""

# fixed value: the reversed polynomial of CRC-32
_CRC_TABLE = "t AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END, i::UBIGINT) AS v FROM range(256) z(i)))"


def _crc(text: str) -> str:
    return f"xor(4294967295::UBIGINT, list_reduce(list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda z: ('0x' || z)::UBIGINT), lambda c, x: xor(c >> 8, t[((xor(c, x) & 255) + 1)::BIGINT]), 4294967295::UBIGINT))"


_SPELLING = f"""
WITH RECURSIVE {_CRC_TABLE},
a AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]{{7,}}')) AS run FROM documents),
c AS (SELECT doc_id, run, count(*) AS c FROM a GROUP BY ALL),
h AS (SELECT run, c, ({_crc("doc_id::VARCHAR || ':' || run")})::BIGINT AS h FROM c, t),
w AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM h),
v AS (SELECT word, sum(c)::BIGINT AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
k AS (SELECT word, n, i, word[1:i - 1] AS p, word[i + 1:] AS s FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM v)),
e AS (SELECT x.word, y.word AS near, y.n AS near_n FROM k x JOIN k y ON x.i = y.i AND x.p = y.p AND x.s = y.s AND x.word <> y.word
  UNION SELECT x.word, v.word, v.n FROM k x JOIN v ON v.word = x.p || x.s UNION SELECT v.word, x.word, x.n FROM k x JOIN v ON v.word = x.p || x.s),
b AS (SELECT word, count(*) AS n_near, max(near_n) AS near_n FROM e GROUP BY word),
f AS (SELECT word, min(near) AS near FROM e JOIN b USING (word, near_n) GROUP BY word),
g AS (SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * n THEN near END AS form, CASE WHEN near_n >= 10 * n THEN near_n END AS form_n FROM v LEFT JOIN b USING (word) LEFT JOIN f USING (word)),
r AS (SELECT word, form AS root, 1 AS steps FROM g WHERE form IS NOT NULL UNION ALL SELECT r.word, g.form, steps + 1 FROM r JOIN g ON g.word = r.root WHERE g.form IS NOT NULL),
z AS (SELECT word, arg_max(root, steps) AS root FROM r GROUP BY word)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM g LEFT JOIN z USING (word)
"""

_TRIE = f"""
WITH {_CRC_TABLE},
o AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT c, count(*) AS n FROM o GROUP BY c),
h AS (SELECT c, n, c - c % 100 AS base, ({_crc("c::VARCHAR")})::BIGINT % 6 AS h FROM n, t),
l AS (SELECT h.*, least(h, coalesce(b.n, 0)) AS lead FROM h LEFT JOIN n b ON b.c = base),
s AS (SELECT l.c, lead + pos - h + 1 AS d, role, text FROM l JOIN o USING (c) WHERE pos >= h UNION ALL SELECT l.c, pos + 1, role, text FROM l JOIN o ON o.c = base WHERE pos < h),
p AS (SELECT *, sha256(string_agg(length(role) || ':' || length(text) || ':' || role || text, '' ) OVER (PARTITION BY c ORDER BY d)) AS id, length(text) AS chars FROM s),
m AS (SELECT c, d, id, chars, coalesce(lag(id) OVER (PARTITION BY c ORDER BY d), '') AS up FROM p UNION ALL SELECT c, 0, '', 0, NULL FROM n),
q AS (SELECT d, id, min(up) AS up, min(chars) AS chars, min(c) AS conv_id, count(*) AS n_convs FROM m GROUP BY d, id),
k AS (SELECT up AS id, count(*) AS n_children FROM q GROUP BY up),
u AS (SELECT q.*, coalesce(n_children, 0) AS n_children FROM q LEFT JOIN k USING (id)),
g AS (SELECT a.id, count_if(u.n_children = 0)::BIGINT AS n_leaves, sum((u.n_convs - 1) * u.chars)::BIGINT AS saved_tokens FROM u JOIN m a ON a.c = u.conv_id AND a.d <= u.d GROUP BY a.id),
e AS (SELECT id, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS ends FROM (SELECT c, arg_max(id, d) AS id FROM m GROUP BY c) GROUP BY id)
SELECT u.conv_id, u.d AS depth, a.conv_id AS parent_conv_id, u.n_convs, u.n_children, n_leaves, saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM u JOIN g USING (id) LEFT JOIN q a ON a.id = u.up LEFT JOIN e ON e.id = u.id
"""

ORACLE = {
    "op2_warc_round_trip": _WARC, "op3_quality_rules": _QUALITY, "op4_exact_dedup": _EXACT, "op5_preference_formatting": _PREFERENCE, "op6_line_dedup": _LINES,
    "op7_minhash_near_dedup": _NEAR, "op8_suffix_array_dedup": _SUFFIX, "op9_substring_dedup": _SUBSTRING, "op11_simhash_near_dedup": _SIMHASH, "op12_spelling_variants": _SPELLING, "op13_conversation_trie": _TRIE,
}
