"""SimHash, spelling variants and the conversation trie against brute force."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from twinfold.llm import simhash, spelling, trie
from twinfold.llm.wavelet import WaveletTree

CLASH = "id string, row_key string, key string, word string, n int, c int, pos int"
CLASHING = ("clash", "clash", "k", "w", 1, 2, 3)


def components(nodes, linked):
    label = {x: x for x in nodes}
    for a, b in itertools.combinations(nodes, 2):
        if linked(a, b) and label[a] != label[b]:
            low, high = sorted((label[a], label[b]))
            label = {x: low if v == high else v for x, v in label.items()}
    return label


# SimHash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    found = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in found]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def test_fingerprints(spark):
    texts = ["", " \n\t ", "One", "one TWO", "Ärger über Öl", "a b c d " * 50, "x " * 3, "  nbsp \x1c sep", "w" * 100 + " y z", " ".join(str(k) for k in range(70000))]
    for t in texts:
        assert simhash.fingerprint(t.encode()) == plain_fingerprint(t)
    hashed = spark.createDataFrame([("one two three",)], "s string").select(F.xxhash64("s")).first()[0]
    assert hashed & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"one two three", 42) == simhash.fingerprint(b"One two THREE")


def test_a_chain_starts_somewhere():
    """Every difference of up to r bits keeps the budgets of the chain of some segment, whose first segments are equal."""
    rnd = random.Random(2)
    for m, radius in itertools.product(range(3, 17), (1, 2)):
        cuts, equal = simhash.segments(m), simhash.equal_segments(m, radius)
        assert equal >= 1 and sum(w for _, w in cuts) == 64
        for _ in range(200):
            bits = rnd.sample(range(64), rnd.randint(0, radius))
            per = [sum(low <= b < low + width for b in bits) for low, width in cuts]
            chains = [all(sum(per[(k + j) % m] for j in range(size)) <= size * radius // m for size in range(1, m + 1)) for k in range(m)]
            assert any(chains)
            assert all(not any(per[(k + j) % m] for j in range(equal)) for k in range(m) if chains[k])
    assert simhash.choose_segments(100, 2) <= simhash.choose_segments(10**6, 2) <= simhash.choose_segments(10**10, 2)


@pytest.mark.parametrize(("m", "radius", "paired"), [(3, 2, 64), (5, 2, 3), (7, 2, 2), (4, 1, 2), (None, 2, 64)])
def test_links_of_fingerprints(spark, scratch, m, radius, paired):
    """Random ones, chains of near ones, and a dense ball that shares all keys; with few compared pairs, the ball is linked by the values between."""
    rnd = random.Random(m or 9)
    prints = {rnd.getrandbits(64) for _ in range(30)} | {0, (1 << 64) - 1, 1 << 63}
    for start in list(prints)[:8]:
        for _ in range(4):
            start ^= sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 3)))
            prints.add(start)
    middle = rnd.getrandbits(64)
    prints |= {middle ^ 1 << b for b in rnd.sample(range(64), 20)} | {middle ^ 1 << b ^ 1 << c for b, c in (rnd.sample(range(64), 2) for _ in range(20))}
    nodes = dict(enumerate(sorted(prints)))
    frame = spark.createDataFrame([(k, v - (1 << 64) if v >> 63 else v) for k, v in nodes.items()], "node bigint, fp bigint")
    links = {(r.a, r.b) for r in simhash.near_links(frame, scratch, radius, m, paired).collect()}
    assert all(a < b and (nodes[a] ^ nodes[b]).bit_count() <= 2 for a, b in links)  # at radius 1, two neighbours of one may stand for a link through it
    near = components(nodes, lambda a, b: (nodes[a] ^ nodes[b]).bit_count() <= radius)
    assert components(nodes, lambda a, b: (min(a, b), max(a, b)) in links) == near and 1 < len(set(near.values())) < len(nodes)


def test_radius_is_checked(spark, scratch):
    with pytest.raises(ValueError):
        simhash.near_links(spark.createDataFrame([], "node bigint, fp bigint"), scratch, radius=3)


def test_simhash_documents(spark, scratch):
    rnd = random.Random(4)
    words = [f"word{k}é" for k in range(300)]
    near = list(words)
    near[7] = "other"
    rows = [(5, None), (3, ""), (4, " \n"), (8, "a"), (9, "A"), (None, "a"), (None, " ".join(words)), (20, " ".join(words)), (21, " ".join(near)), (22, "q r s t"), (22, "q r s t"), (30, " ".join(rnd.choices(words, k=9000)))]
    docs = spark.createDataFrame([(i, t, *CLASHING) for i, t in rows], "doc_id bigint, text string, " + CLASH).repartition(3)
    got = simhash.near_duplicates(docs, scratch).collect()
    want = collections.Counter((i, f"{plain_fingerprint(t):016x}") for i, t in rows)
    assert collections.Counter((r.doc_id, r.fingerprint) for r in got) == want
    keys = {r.row_key: (r.doc_id, int(r.fingerprint, 16)) for r in got}
    label = components(sorted(keys), lambda a, b: (keys[a][1] ^ keys[b][1]).bit_count() <= 2)
    assert {r.row_key: r.component_id for r in got} == {k: keys[v][0] for k, v in label.items()}
    assert sum(r.kept for r in got) == len(set(label.values()))
    assert simhash.near_duplicates(docs.where("false"), scratch).collect() == []
    whole = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs.where("doc_id < 20 and doc_id is not null"), scratch).collect()}
    assert whole == {3: 3, 4: 3, 5: 3, 8: 8, 9: 8}


# spelling variants


def test_wavelet_tree():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 17, 64, 300):
        values = rng.permutation(n)
        low, high, least, end = (rng.integers(0, n + 1, 60) for _ in range(4))
        query, found = WaveletTree(values).report(low, high, least, end)
        want = {(q, int(v)) for q in range(60) for v in values[low[q] : high[q]] if least[q] <= v < end[q]}
        assert len(query) == len(want) and set(zip(query.tolist(), found.tolist(), strict=True)) == want
    assert WaveletTree(np.array([], np.int64)).report(*(np.array([0]) for _ in range(4)))[0].size == 0


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


@pytest.mark.parametrize("group", [2, 10, 1 << 14])
def test_near_words(spark, scratch, group):
    """Small groups are divided until they have one position."""
    rnd = random.Random(6)
    words = {"".join(rnd.choice("abÀ") for _ in range(rnd.randint(1, 7))) for _ in range(150)} | {"", "漢字", "漢", "😀字", "aaaaaaa", "aaaaaa"}
    frame = spark.createDataFrame([(w,) for w in words] + [(None,)], "word string")
    got = [(r.word, r.near) for r in spelling.near_words(frame, scratch, group).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in words for b in words if one_edit(a, b)}


def test_spelling_forms(spark, scratch):
    counts = {"although": 1000, "althogh": 90, "altough": 100, "altogh": 5, "athogh": 4, "althought": 100, "zzzzzzz": 3, "zzzzzzy": 29, "zzzzzyy": 290, "single": 1}
    got = {r.word: r for r in spelling.grouped(spark.createDataFrame([(w, n, "x") for w, n in counts.items()], "word string, n int, near string"), scratch).collect()}
    for w, n in counts.items():
        near = sorted((-counts[v], v) for v in counts if one_edit(w, v))
        form = near[0][1] if near and -near[0][0] >= 10 * n else None
        assert (got[w].form, got[w].n, got[w].n_near, got[w].form_n) == (form, n, len(near), counts[form] if form else None)
        root = w
        while got[root].form:
            root = got[root].form
        assert got[w].root == root
    assert got["altogh"].root == "although" != got["altogh"].form
    assert spelling.grouped(spark.createDataFrame([], "word string, n bigint"), scratch).collect() == []


def test_counted_words(spark):
    rnd = random.Random(8)
    rows = [(k % 40 if k % 9 else None, " ".join(rnd.choice(["Straße", "STRASSEN", "über-morgen", "ÄrgerÄrger", "abcdefg", "naïveté×÷", "日本", "Tomorrow", "tomorrow9x", "short"]) for _ in range(30))) for k in range(60)] + [(1, None), (2, ""), (3, "Wanderer" * 20000)]
    docs = spark.createDataFrame([(i, t, *CLASHING) for i, t in rows], "doc_id bigint, text string, " + CLASH)
    want = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            want[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    got = {r.word: r.n for r in spelling.counted_words(docs).collect()}
    assert got == {w: n for w, n in want.items() if len(w) >= 7 and n >= 2} and len(got) > 5
    assert spelling.counted_words(docs.where("false")).collect() == []


# the conversation trie


def plain_trie(rows):
    said = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            said[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    said = {c: [x[-1] for x in sorted(v)] for c, v in said.items()}
    members, ends = collections.defaultdict(set), collections.defaultdict(list)
    for c in sorted(said):
        h, base = zlib.crc32(str(c).encode()) % 6, c - int(np.fmod(c, 100))
        turns = tuple(said.get(base, [])[:h] + said[c][h:])
        for d in range(len(turns) + 1):
            members[turns[:d]].add(c)
        ends[turns].append(c)
    out = []
    for node, of in members.items():
        under = [x for x in members if x[: len(node)] == node]
        leaves = sum(not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in members) for x in under)
        children = sum(len(y) == len(node) + 1 for y in under)
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in under if x)
        text = ",".join(map(str, ends.get(node, [])))
        out.append((min(of), len(node), min(members[node[:-1]]) if node else None, len(of), children, leaves, saved, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations():
    rnd = random.Random(12)
    rows = []
    for c in [0, 100, 200, -100, *rnd.sample(range(-150, 420), 60)]:
        for turn in range(rnd.randint(1, 9)):
            rows.append((c, turn, rnd.choice(["user", "assistant"]), rnd.choice(["hi", "hi", "yes", "naïve 漢字", "😀"])))
    long = [(k, rnd.choice("ab")) for k in range(150)]
    rows += [(300 + j, t, "user", x) for j in (0, 1, 2) for t, x in long[: 150 - 20 * j]]
    rows += [(c, t, "user", x) for c in range(500, 640) for t, x in enumerate(["same", "turns", "again", "and", "again", "."])]  # one very common conversation
    return rows + [(7, None, None, None), (7, 3, "a", "b"), (7, 3, "a", "b"), (7, 3, "a", "c"), (None, 1, "x", "y"), (1, 0, None, "z"), (1 << 40, 5, "user", "far")]


@pytest.mark.parametrize("block", [2, 64])
def test_trie(spark, scratch, monkeypatch, block):
    monkeypatch.setattr(trie, "BLOCK", block)
    monkeypatch.setattr(trie, "_PIECE", 20)
    rows = list(dict.fromkeys(conversations())) + [(7, 3, "a", "b")]
    frame = spark.createDataFrame([(*r, *CLASHING) for r in rows], "conv_id bigint, turn int, role string, text string, " + CLASH).repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = trie.prefix_trie(*trie.rebuilt(trie.turn_rows(frame, scratch), scratch), scratch).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(map(tuple, got), key=repr) == plain_trie(rows)


def test_trie_without_turns(spark, scratch):
    none = spark.createDataFrame([], "conv_id bigint, turn int, role string, text string")
    assert trie.prefix_trie(*trie.rebuilt(trie.turn_rows(none, scratch), scratch), scratch).collect() == []
    lone = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 == 3)  # its base is absent and its turns are no more than the shared ones
    rows = [(lone, 0, "a", "b"), (lone, 1, "a", "c")]
    got = trie.prefix_trie(*trie.rebuilt(trie.turn_rows(spark.createDataFrame(rows, none.schema), scratch), scratch), scratch).collect()
    assert [tuple(r) for r in got] == plain_trie(rows) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]
