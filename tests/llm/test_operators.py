import base64
import collections
import gzip
import hashlib
import io
import math
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from twinfold.llm import anchors, bloom, bpe, counts, exact, lines, minhash, packing, preference, quality, substring, suffix, warc
from twinfold.llm.common import byte_tokenizer
from twinfold.llm.oracle import ORACLE
from twinfold.llm.queries import QUERIES
from twinfold.plans.storage import row_keyed

PATH = public_tokenizers.path("byte_bpe_50k.json")
#: Nulls, empty and white-space texts, ties, repeated rows, and columns whose names the operators use themselves.
SCHEMA = "doc_id bigint, text string, lang string, id string, row_key string, h int, n int, key string"


def words(rnd, n):
    return [rnd.choice("alpha beta gamma delta über naïve 漢字 zeta eta theta".split()) + str(rnd.randint(0, 30)) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    shared = " ".join(words(rnd, 90))
    out = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (5, "a b c"), (6, "a b c"), (7, "A b c"), (None, "a b c"), (None, None), (9, "same row"), (9, "same row"), (10, "x" * 3000), (11, "ab " * 900), (12, "  <|endoftext|> x\x1c y  \n\n z<|endoftext|>")]
    for k in range(20, 44):
        body = words(rnd, rnd.randint(5, 300))
        out.append((k, " ".join(body[:40]) + "\n" + shared + "\n" + " ".join(body[40:]) if k % 2 else " ".join(body)))
    base = words(rnd, 400)
    for k in range(60, 70):
        near = list(base)
        for _ in range(6):
            near[rnd.randrange(400)] = f"changed{k}"
        out.append((k, " ".join(near)))
    out.append((99, " ".join(words(rnd, 30000))))
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "clash", "clash", 1, 2, "k") for i, t in rows], SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_tables_without_rows(spark, scratch):
    none = empty(spark)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    for frame in (exact.exact_groups(none, scratch), exact.exact_dedup(none, scratch), packing.pack(packing.token_pieces(none, PATH), 0), quality.verdicts(none, labels, scratch), lines.dedup_lines(none, scratch), minhash.near_duplicates(none, scratch), suffix.remove_repeats(none, scratch), substring.remove_repeats(none, scratch), bpe.encode_documents(none, PATH, scratch)):
        assert frame.collect() == []
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.read_archives(warc.write_archives(warc.with_revisits(pages, scratch), scratch.folder("a"), scratch)).collect() == []


def test_one_id_for_all_rows_is_dealt_to_many_tasks(spark, scratch):
    rows = spark.range(4000).select(F.lit(None).cast("bigint").alias("id"), F.when(F.col("id") < 3000, F.col("id").cast("string")).otherwise("same").alias("text")).repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    keyed = row_keyed(rows, "id", scratch)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert keyed.select("row_key").distinct().count() == 4000
    per = [r["count"] for r in keyed.groupBy(F.shiftright("row_key", 33)).count().collect()]
    assert len(per) == 4 and max(per) < 2000


def test_exact_keeps_a_column_of_any_name(spark, scratch):
    got = exact.exact_dedup(spark.createDataFrame([(1, "a", "x", "h"), (2, "a", "y", "h")], "doc_id bigint, text string, exact_dedup_key string, h string"), scratch).collect()
    assert [tuple(r) for r in got] == [(1, "a", "x", "h")]


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("weak", [False, True])
def test_exact(docs, rows, scratch, keep, weak):
    hash_of = (lambda t: F.unhex(F.lpad(F.hex(F.length(t) % 3), 32, "0"))) if weak else exact.content_hash
    got = exact.exact_groups(docs, scratch, keep=keep, hash_of=hash_of).collect()
    assert len(got) == len(rows)
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[hashlib.sha256((t or "").encode()).hexdigest()].append(i)
    for r in got:
        ids = [i for i in groups[r.text_sha256] if i is not None]
        assert r.group_size == len(groups[r.text_sha256]) and r.keep_id == (None if not ids else (min if keep == "smallest" else max)(ids))
    assert sum(r.kept for r in got) == len(groups)
    assert exact.exact_dedup(docs, scratch, keep=keep).count() == len(groups)


def whole_pieces(texts, got):
    """Pieces, as counted, are those of the texts' ids; sequences have no gaps and keep their length."""
    t = Tokenizer.from_file(PATH)
    at, want = collections.defaultdict(list), collections.Counter()
    for r in got:
        at[r.sequence_id].append((r.offset, r.length))
    for spans in at.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 1024
    for i, x in texts:
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4")
        start, end, piece = 0, len(ids) % 1024 or 1024, 0
        while start < len(ids):
            want[i, piece, start, end - start, zlib.crc32(ids[start:end].tobytes())] += 1
            start, end, piece = end, end + 1024, piece + 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want


def test_packing(docs, rows):
    whole_pieces(rows, packing.pack(packing.token_pieces(docs, PATH), 100).collect())


def test_packing_keeps_large_ids_beside_null(spark):
    big = 1 << 60
    rows = [(None, "a b c"), (None, None), (big + 1, "d e"), (big + 2, "d e"), (big + 2, "d e"), (-big - 3, "x " * 3000), (7, "")]
    pieces = packing.token_pieces(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1), PATH)
    whole_pieces(rows, packing.pack(pieces, 3, group_docs=1).collect())
    whole_pieces(rows, packing.pack(pieces, len(rows)).collect())
    clash = pieces.withColumns({"offset": F.lit("x"), "sequence_id": F.lit("y"), "row_key": F.lit(1.5)})
    got = packing.pack(clash, len(rows))
    assert dict(got.dtypes)["offset"] == "bigint" and {r.row_key for r in got.collect()} == {1.5}
    named = packing.token_pieces(spark.createDataFrame([("z", "a"), (None, "b")], "doc_id string, text string"), PATH)
    assert {r.doc_id for r in packing.pack(named, 2).collect()} == {"z", None}


def test_packing_deals_rows_of_one_id_to_all_groups(spark):
    one = spark.range(0, 8000, 1, 4).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("start"), (F.col("id") % 3 + 1).alias("length"))
    per = collections.Counter(r.sequence_id >> 40 for r in packing.pack(one, 8000, group_docs=400).collect())
    assert len(per) == 20 and max(per.values()) == 400
    assert sum(per.values()) == 8000


LONG = {"spaces": "x" + " " * 2_000_000 + "y", "lines": "\n" * 2_000_000, "letters": "a" * 2_000_000, "mixed": " \t" * 600_000 + "z"}


@pytest.mark.parametrize("kind", LONG)
def test_very_long_runs_of_one_character(spark, scratch, kind):
    rows = [(1, LONG[kind]), (2, "plain text"), (3, "p " * 300 + LONG[kind])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    whole_pieces(rows, packing.pack(packing.token_pieces(docs, PATH), 3).collect())
    t = Tokenizer.from_file(PATH)
    for r in bpe.encode_documents(docs, PATH, scratch).collect():
        ids = t.encode(dict(rows)[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_settings_stay_as_they_were(spark, scratch):
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = [spark.conf.get(n) for n in names]
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b c")], "doc_id bigint, text string")
    for frame in (bpe.encode_documents(docs, PATH, scratch), lines.dedup_lines(docs, scratch), packing.token_pieces(docs, PATH)):
        frame.collect()
    assert [spark.conf.get(n) for n in names] == before


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_best_fit_capacities(score):
    rnd = random.Random(3)
    lengths = np.array([rnd.randint(1, 1024) for _ in range(2000)])
    cap = packing.Capacities(documents=3, attention=1024 * 1024, score=score)
    seq, offset = packing.best_fit(lengths, cap)
    assert np.bincount(seq).max() <= 3 and np.bincount(seq, lengths).max() <= 1024
    assert np.bincount(seq, lengths.astype(float) ** 2).max() <= cap.attention
    loose, _ = packing.best_fit(lengths, packing.Capacities(score=score))
    assert loose.max() + 1 <= 1.02 * max(math.ceil(lengths.sum() / 1024), (lengths > 512).sum())
    with pytest.raises(ValueError):
        packing.best_fit(np.array([2000]), cap)


def test_full_pieces_have_a_sequence_each(spark):
    lengths = [1024] * 50 + [1000, 24, 600, 424]
    pieces = spark.createDataFrame([(k, 0, 0, n) for k, n in enumerate(lengths)], "doc_id bigint, piece int, start bigint, length bigint")
    per = collections.defaultdict(list)
    for r in packing.pack(pieces, len(lengths)).collect():
        per[r.sequence_id].append((r.length, r.offset))
    assert len(per) == 52 and sum(x == [(1024, 0)] for x in per.values()) == 50
    with pytest.raises(Exception, match="exceeds a sequence's capacities"):
        packing.pack(pieces, len(lengths), packing.Capacities(attention=1024)).collect()


def test_warc(spark, scratch):
    rnd = random.Random(2)
    pages = [(k, f"http://h/{k}" if k % 5 else None, rnd.choice([None, "", "é" * 50, "\x1f<p>", "x" * 70000, f"own {k} " * rnd.randint(1, 4000)])) for k in range(200)]
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(3)
    files = warc.write_archives(warc.with_revisits(frame, scratch), scratch.folder("w"), scratch)
    first = {}
    for k, _, h in pages:
        first.setdefault(h or "", k)
    for split in (700, 50_000, 1 << 30):
        got = {int(r.record_id.rsplit(":", 1)[1]): r for r in warc.read_archives(files, split).collect()}
        assert len(got) == len(pages)
        for k, _, h in pages:
            data = (h or "").encode()
            r = got[k]
            assert r.payload_bytes == len(data) and r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
            assert r.record_type == ("response" if first[h or ""] == k else "revisit")
            assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == data
    paths = [r.path.removeprefix("file://") for r in files.collect()]
    path = max(paths, key=lambda x: len(open(x, "rb").read()))
    assert len(set(paths)) == len(paths)
    assert gzip.open(path).read().startswith(b"WARC/1.1")
    data = bytearray(open(path, "rb").read())
    whole = len(list(warc.records_in(open(path, "rb"), len(data), 0, len(data))))
    data[:0] = b"noise\x1f\x8b\x08" + gzip.compress(b"no record")  # false magic, and a member that is no record
    broken = f"{path}.broken"
    open(broken, "wb").write(data)
    assert len(list(warc.records_in(open(broken, "rb"), len(data), 0, len(data)))) == whole


def test_warc_passes_over_what_its_digest_denies():
    good = warc.record("urn:x-page:1", "response", "u", b"payload", warc.sha1_base32(b"payload"))
    bad = warc.record("urn:x-page:2", "response", "u", b"payloaD", warc.sha1_base32(b"payload"))
    data = warc.member(bad) + warc.member(good) + warc.member(bad)
    assert [f["record_id"] for _, f in warc.records_in(io.BytesIO(data), len(data), 0, len(data))] == ["urn:x-page:1"]
    assert warc.parsed(good)["payload_bytes"] == 7 and warc.parsed(good[:-20]) is None


def test_warc_clashing_columns_and_equal_digests_of_other_lengths(spark, scratch):
    names = "page_id bigint, url string, html string, id string, first string, n string, same string, row_key string, revisit string, payload string"
    pages = spark.createDataFrame([(k, None, h, *["c"] * 7) for k, h in ((3, "x"), (1, "x"), (2, None), (4, ""), (5, "y" * 200_000))], names)
    records = warc.with_revisits(pages, scratch, min_bytes=1).withColumn("extra", F.lit("e"))
    got = {r.record_id: r for r in warc.read_archives(warc.write_archives(records, scratch.folder("c"), scratch), 100).collect()}
    assert {k: (r.record_type, r.refers_to_id) for k, r in got.items()} == {"urn:x-page:1": ("response", None), "urn:x-page:2": ("response", None), "urn:x-page:3": ("revisit", "urn:x-page:1"), "urn:x-page:4": ("response", None), "urn:x-page:5": ("response", None)}
    assert got["urn:x-page:5"].payload_bytes == 200_000


def test_warc_gives_back_null_and_repeated_ids(spark, scratch, tmp_path):
    pages = [(50, "same"), (7, "a"), (7, "same"), (None, "same"), (9, None), (None, "own"), (None, "own"), (-3, ""), (100, "b"), (7, "a")]
    spark.createDataFrame([(k, f"http://h/{k}", h) for k, h in pages], "page_id bigint, url string, html string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    want = collections.Counter()
    first = {}
    for k, h in sorted(pages, key=lambda x: (x[0] is None, x[0] or 0)):
        text = h or ""
        want[k, len(text), base64.b32encode(hashlib.sha1(text.encode()).digest()).decode(), "revisit" if text in first else "response", first.get(text)] += 1
        first.setdefault(text, k)
    got = QUERIES["op2_warc_round_trip"](spark, str(tmp_path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert collections.Counter(map(tuple, got)) == want
    records = warc.with_revisits(spark.read.parquet(f"{tmp_path}/pages.parquet"), scratch).collect()
    ids = {r.record_id for r in records}
    assert len(ids) == len(pages) and {r.refers_to_id for r in records if r.refers_to_id} <= {r.record_id for r in records if r.record_type == "response"}
    named = spark.createDataFrame([("a:row b", "", "x"), ("é", "", "x"), ("", "", "y"), (None, "", "y")], "page_id string, url string, html string")
    found = {r.record_id.split(":row:")[0] for r in warc.read_archives(warc.write_archives(warc.with_revisits(named, scratch), scratch.folder("s"), scratch)).collect()}
    assert {"urn:x-page:a%3Arow+b", "urn:x-page:%C3%A9", "urn:x-page:"} < found and len(found) == 4


def brute_counts(text):
    w = text.encode().split()
    seen = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cover = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    ls = [x for x in text.split("\n") if x.encode().split()]
    return len(w), sum(len(x.decode()) for x in w), sum(text.count(c) for c in "#*$%&|<>"), len(ls) - len(set(ls)), len(cover)


def test_quality(spark, docs, rows, scratch):
    for _, t in rows:
        assert quality.counts((t or "").encode())[:5] == brute_counts(t or "")
    got = quality.verdicts(docs, spark.createDataFrame([(None, 1, 0), (20, None, 0)], "doc_id bigint, quality int, toxic int"), scratch).collect()
    assert len(got) == len(rows) and all(r.kept == (not r.base_failed) for r in got)
    good = [(k, " ".join(f"w{k}x{j}" for j in range(60)), "en") for k in range(3000)]
    bad = [(k, " ".join(f"w{k}x{j}##" for j in range(60)), "en") for k in range(3000, 3300)]
    table = spark.createDataFrame(good + bad, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(k, int(k < 3000), 0) for k in range(3300)], "doc_id bigint, quality int, toxic int")
    assert sorted(r.id for r in quality.verdicts(table, labels, scratch).where("kept").collect()) == list(range(3000))


def test_quality_cutoffs_of_several_strata(spark, tmp_path):
    """Against the SQL: strata with many labels, few, and none; features that tell the good from the bad, and one that doesn't."""
    rnd = random.Random(13)
    docs, labels = [], []
    for k in range(9000):
        lang = ("aa", "bb", "cc", None)[min(3, rnd.randint(0, 9) // 2)]
        bad = rnd.random() < 0.3
        words = [f"w{rnd.randint(0, 10**6)}" for _ in range(rnd.randint(55, 70))]
        if lang == "aa" and rnd.random() < (0.9 if bad else 0.004):
            words = [w + "#" for w in words]
        if lang == "bb" and bad:
            words = ["WXYZ" + w for w in words]
        if lang is None and rnd.random() < (0.9 if bad else 0.1):
            words = [w + "$" for w in words]
        docs.append((k, " ".join(words), lang))
        if lang != "cc" or k % 40 == 0:
            labels.append((k, int(not bad), 0))
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    db = duckdb.connect()
    for t in ("documents", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    found = db.execute(ORACLE["op3_quality_rules"])
    names = [d[0] for d in found.description]
    got = QUERIES["op3_quality_rules"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r[n] for n in names) for r in got) == sorted(found.fetchall())
    lost = collections.Counter(docs[r.doc_id][2] for r in got if not r.kept)
    assert set(lost) == {"aa", "bb"} and lost["aa"] > 300 and lost["bb"] > 300


def test_binomial_tail():
    assert quality.tail_p(10, 0, 0.5) == pytest.approx(2**-10)
    assert quality.tail_p(10, 4, 0.3) == pytest.approx(sum(math.comb(10, i) * 0.3**i * 0.7 ** (10 - i) for i in range(5)))
    assert quality.tail_p(5, 5, 0.1) == 1.0
    assert quality.certified(50, [0, 0], [3, 9], 0.01, 0.01) is None
    assert quality.certified(2000, [0, 5, 90], [3, 9, 50], 0.01, 0.05) == 1


def test_lines(spark, scratch):
    common, rare = "X" + "y" * 45, "z" * 60
    table = [(k, f"{'  ' if k % 2 else ''}{common.upper() if k == 2 else common} \nown {k}\n{common}\n{rare if k < 4 else ''}") for k in range(7)] + [(50, None), (51, "")]
    got = {r.doc_id: r for r in lines.dedup_lines(spark.createDataFrame(table, "doc_id bigint, text string"), scratch, with_text=True).collect()}
    assert [got[k].n_dropped for k in range(7)] == [2] * 6 + [0] and got[50].n_lines == got[51].n_lines == 1
    assert got[0].kept_text == f"own 0\n{rare}" and got[6].kept_text == table[6][1]


def brute_lines(rows, min_docs, min_chars):
    keys = [[x.decode() for x in ((y.strip(b" \t\n\x0b\x0c\r").lower()) for y in (t or "").encode().split(b"\n"))] for _, t in rows]
    holders = collections.defaultdict(set)
    for k, ks in enumerate(keys):
        for x in ks:
            if len(x) >= min_chars:
                holders[x].add(k)
    rank = lambda k: (rows[k][0] is not None, rows[k][0] or 0)
    keeper = {x: max(h, key=rank) for x, h in holders.items() if len(h) >= min_docs}
    out = collections.Counter()
    for k, (i, t) in enumerate(rows):
        kept = [y for y, x in zip((t or "").split("\n"), keys[k], strict=True) if x not in keeper or rank(keeper[x]) == rank(k)]
        out[i, len(keys[k]), len(keys[k]) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("bits", [None, 8])
def test_lines_of_odd_rows(docs, rows, scratch, bits):
    """Nulls, empty, repeated and very long texts, clashing names; also with filters so full that all is suspected."""
    got = lines.dedup_lines(docs, scratch, bloom_bits=bits).collect()
    assert collections.Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in got) == brute_lines(rows, 5, 40)
    assert sum(r.n_dropped for r in got) > 5


def test_filter_sizes(spark):
    small = spark.createDataFrame([("x",)], "text string")
    assert bloom.bits_for(small, 64) == bloom.bits_for(small, 32) // 2 == 1 << 28
    assert bloom.bits_for(spark.range(10), 64) == bloom.MIN_BITS
    assert bloom.bits_for(spark.range(1 << 40), 64) == bloom.MAX_BITS
    with pytest.raises(ValueError, match="bits"):
        bloom.repeated_filter(small, lambda t: {1}, 3 << 20)


def test_filter_misses_nothing(spark):
    sets = [[(k * 7919 + j * j) % 5000 for j in range(40)] for k in range(60)]
    frame = spark.createDataFrame([(s,) for s in sets], "s array<bigint>").repartition(5)
    seen = bloom.repeated_filter(frame, lambda s: {x * 0x9E3779B97F4A7C15 % 2**64 for x in s}, 1 << 18)
    many = collections.Counter(x for s in sets for x in set(s))
    twice = bloom.Filter(seen.twice)
    assert all(x * 0x9E3779B97F4A7C15 % 2**64 in twice for x, n in many.items() if n > 1)
    assert sum(x * 0x9E3779B97F4A7C15 % 2**64 in twice for x in range(5000) if many[x] < 2) < 100


def brute_sets(rows, width):
    out = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set()))
    return out


def test_near(docs, rows, scratch):
    got = minhash.near_duplicates(docs, scratch, width=4).collect()
    sets = brute_sets(rows, 4)
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and label[a] != label[b]:
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    groups = collections.defaultdict(list)
    for k, x in enumerate(label):
        groups[x].append(rows[k][0])
    want = collections.Counter((i, len(s), min((x for x in groups[g] if x is not None), default=None)) for (i, _), s, g in zip(rows, sets, label, strict=True))
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)


@pytest.mark.parametrize("n", [60, 120])
def test_near_with_a_boilerplate(spark, scratch, monkeypatch, n):
    """Documents that share half of their words with all others: what is compared grows with their number, and copies among them are found."""
    rnd = random.Random(n)
    shared = [f"all{k}" for k in range(110)]
    own = [[f"d{i}w{k}" for k in range(100)] for i in range(n)]
    texts = {i: " ".join(shared + own[i]) for i in range(n)}
    for i in range(0, n, 10):  # near copies, in which five words of their own are others
        near = list(own[i])
        for k in rnd.sample(range(100), 5):
            near[k] = f"x{i}{k}"
        texts[n + i] = " ".join(shared + near)
    compared, across, refined, rarest = [], minhash._across, [], minhash._rarest
    monkeypatch.setattr(minhash, "LARGE", 1)
    monkeypatch.setattr(minhash, "_rarest", lambda *a: refined.append(1) or rarest(*a))
    monkeypatch.setattr(minhash, "_across", lambda left, *rest: compared.append(left.groupBy("key", "class").count().agg(F.sum(F.col("count") * F.col("count"))).first()[0] or 0) or across(left, *rest))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"), scratch, width=3).collect()}
    sets = {i: set(zip(*(t.split()[k:] for k in range(3)), strict=False)) for i, t in texts.items()}
    alike = {(a, b) for a in texts for b in texts if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert alike == {(i, n + i) for i in range(0, n, 10)}
    assert got == {i: i - n if i >= n else i for i in texts}
    assert refined and compared[0] < 60 * n


def test_near_makes_rows_of_rare_shingles_only(spark, scratch, monkeypatch):
    """Where documents share a boilerplate, joins make rows of the first shingles of each set that others have too, not of all."""
    monkeypatch.setattr(minhash, "LARGE", 1)
    n, shared, made, rarest, join = 60, " ".join(f"all{k}" for k in range(110)), [], minhash._rarest, minhash.join_facts

    def counted(rows, facts, keys, how="inner"):
        made[-1].append((out := join(rows, facts, keys, how)).count())
        return out

    def watched(*args):
        made.append([])
        with monkeypatch.context() as m:
            m.setattr(minhash, "join_facts", counted)
            return rarest(*args)

    monkeypatch.setattr(minhash, "_rarest", watched)
    rows = [(i, f"{shared} " + " ".join(f"d{i}w{k}" for k in range(100))) for i in range(n)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), scratch, width=3).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i for i in range(n)}
    assert made and all(sum(x) < 20 * n for x in made)  # a set has 208 shingles


def test_ranks_of_hashes(spark):
    rnd = np.random.default_rng(5)
    hashes = rnd.integers(0, 1 << 63, 2000, dtype=np.uint64)
    drawn = [rnd.choice(hashes[: k + 1], 300) for k in range(40)]
    slots = counts.slots_for(2000)
    got = counts.ranks(spark.createDataFrame([(h.tobytes(),) for h in [*drawn, drawn[0][:0]]], "h binary").repartition(7), slots)
    times = np.zeros(slots, np.int64)
    np.add.at(times, counts.slot(np.concatenate(drawn), slots), 1)
    assert (got == np.minimum(255, np.floor(8 * np.log2(1 + times)))).all()
    assert not counts.ranks(spark.createDataFrame([], "h binary"), 1 << 10).any()


@pytest.mark.parametrize(("percent", "large"), [(80, 1024), (90, 1024), (100, 1024), (80, 1), (90, 1)])
def test_near_of_small_sets(spark, scratch, percent, large, monkeypatch):
    """Few words from a small stock, so that very many bands are shared, and blocks of few members; compared in their bands, or by their rarest shingles."""
    monkeypatch.setattr(minhash, "_BLOCK", 8)
    monkeypatch.setattr(minhash, "LARGE", large)
    rnd = random.Random(percent)
    stock = [[f"w{rnd.randint(0, 40)}" for _ in range(40)] for _ in range(6)]
    rows = [(k, " ".join(rnd.choice(stock)[(a := rnd.randint(0, 12)) : a + rnd.randint(1, 28)])) for k in range(300)]
    sets = brute_sets(rows, 3)
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if label[a] != label[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), scratch, width=3, percent=percent).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(label))


def test_near_refuses_what_its_bands_would_lose(docs, scratch):
    miss = lambda percent: (1 - (percent / 100) ** minhash.BAND) ** (minhash.BUCKETS // 2 // minhash.BAND)
    assert miss(minhash.LEAST_PERCENT) <= 5e-8 < miss(minhash.LEAST_PERCENT - 1)
    for percent in (79, 50):
        with pytest.raises(ValueError, match="percent"):
            minhash.near_duplicates(docs, scratch, percent=percent)


def test_suffix(docs, rows, scratch):
    size = 200
    texts = [(t or "").encode() for _, t in rows]
    many = collections.Counter(t[p : p + size] for t in texts for p in range(len(t) - size + 1))
    want = collections.Counter()
    for (i, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - size + 1):
            if many[t[p : p + size]] > 1:
                gone[p : p + size] = True
        left = bytes(np.frombuffer(t, np.uint8)[~gone[:-1]]) if t else b""
        want[i, len(t), int(gone.sum()), int((gone[:-1] & ~np.r_[False, gone[:-2]]).sum()) if t else 0, hashlib.sha256(left).hexdigest()] += 1
    got = suffix.remove_repeats(docs, scratch, min_bytes=size).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


def test_hashes_of_strings(monkeypatch):
    rnd = random.Random(8)
    for plan, make in ((suffix.plan_for(400), lambda n: bytes(rnd.choice(b"abc ") for _ in range(n))), (suffix.plan_for(50, "words"), lambda n: " ".join(rnd.choice("ab cd é".split()) for _ in range(n)).encode())):
        seq = anchors.Sequence(make(3000), plan)
        a = np.array(sorted(rnd.randint(0, seq.n - 60) for _ in range(400)))
        b = a + rnd.randint(5, 50)
        whole = seq.hashes(a, b)
        told = collections.defaultdict(set)
        for x, y, h in zip(a.tolist(), b.tolist(), whole.tolist(), strict=True):
            told[bytes(seq.part(x, y))].add(h)
        assert all(len(h) == 1 for h in told.values()) and len({next(iter(h)) for h in told.values()}) == len(told)
        monkeypatch.setattr(anchors, "_HASHED", 64)
        assert seq.hashes(a, b).tolist() == whole.tolist()
        monkeypatch.undo()
        assert len(seq.hashes(a[:0], b[:0])) == 0


@pytest.mark.parametrize("size", [20, 50])
def test_suffix_on_words(docs, rows, scratch, size):
    texts = [(t or "").encode() for _, t in rows]
    places = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0d]+", t)] for t in texts]
    window = lambda t, at, p: tuple(t[a:b] for a, b in at[p : p + size])
    many = collections.Counter(window(t, at, p) for t, at in zip(texts, places, strict=True) for p in range(len(at) - size + 1))
    want = collections.Counter()
    for (i, _), t, at in zip(rows, texts, places, strict=True):
        gone = {k for p in range(len(at) - size + 1) if many[window(t, at, p)] > 1 for k in range(p, p + size)}
        starts = [a for a, _ in at] + [len(t)]
        left = t[: starts[0]] + b"".join(t[starts[k] : starts[k + 1]] for k in range(len(at)) if k not in gone)
        want[i, len(t), len(t) - len(left), sum(k - 1 not in gone for k in gone), hashlib.sha256(left).hexdigest()] += 1
    got = suffix.remove_repeats(docs, scratch, min_words=size, with_text=True).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got) and sum(r.n_removed for r in got) > 1000
    with pytest.raises(ValueError, match="min_words"):
        suffix.remove_repeats(docs, scratch, min_words=19)


def test_substring(docs, rows, scratch):
    texts = [(t or "").encode().split() for _, t in rows]
    many = collections.Counter(tuple(t[p : p + 35]) for t in texts for p in range(len(t) - 34))
    want = collections.Counter()
    for (i, _), t in zip(rows, texts, strict=True):
        gone = {j for p in range(len(t) - 34) if many[tuple(t[p : p + 35])] > 1 for j in range(p, p + 35)}
        want[i, len(t), len(gone), hashlib.sha256(b" ".join(w for j, w in enumerate(t) if j not in gone)).hexdigest()] += 1
    got = substring.remove_repeats(docs, scratch).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want


def test_bpe(docs, rows, scratch):
    t = Tokenizer.from_file(PATH)
    want = collections.Counter()
    for i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert collections.Counter(tuple(r) for r in bpe.encode_documents(docs, PATH, scratch).collect()) == want


def test_chunks_join_to_the_same_ids():
    rnd = random.Random(9)
    encode, decode = byte_tokenizer(PATH)
    for _ in range(60):
        text = "".join(rnd.choice(["a", " ", "\n", "\x1c", "\x85", "é", "漢", "'s", "<|endoftext|>", "12", "  ", "!"]) for _ in range(rnd.randint(0, 3000)))
        data = text.encode()
        ends = bpe.chunk_ends(data)
        parts = [data[a:b].decode() for a, b in zip([0, *ends], ends, strict=False)]
        assert "".join(parts) == text
        ids = bpe.joined([bpe.encoded_chunk(p, encode) for p in parts], encode)
        assert ids.tolist() == encode(text).tolist() and decode(ids) == text


def test_preference(spark):
    turns = [(1, 0, "user", "q"), (1, 1, "assistant", "good"), (2, 0, "user", "q"), (2, 1, "assistant", "bad"), (2, 2, "user", None), (3, 0, "user", "other"), (None, 0, "user", "q"), (4, None, "user", "q")]
    table = spark.createDataFrame([(*t, "clash") for t in turns], "conv_id bigint, turn bigint, role string, text string, a string")
    pairs = preference.star_pairs(table)
    assert [tuple(r) for r in pairs.collect()] == [(2, 1, 2)]
    r = preference.preference_rows(pairs, table).first()
    assert r.prompt == "<|user|>\nq\n<|end|>\n" and r.n_prompt_turns == 1
    assert r.chosen_text == "<|assistant|>\ngood\n<|end|>\n" and r.rejected_text == "<|assistant|>\nbad\n<|end|>\n<|user|>\n\n<|end|>\n"
    (a, b), = r.chosen_mask
    assert r.chosen_text[a:b] == "good\n<|end|>\n" and len(r.rejected_mask) == 1
    pairs, both = preference.stale_replies(table)
    assert {(x.chosen, x.rejected_text) for x in preference.preference_rows(pairs, both).collect()} == {(1, "<|assistant|>\n\n<|end|>\n"), (2, "<|assistant|>\n\n<|end|>\n")}


def test_a_very_common_chosen_conversation_is_dealt(spark, monkeypatch):
    """One chosen conversation against 60 others: with 7 pairs in a place, the same rows, with and without known counts."""
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", "hi" if t == 0 else "long answer " * 9 if c == 5 else f"a{c}") for c in range(61) for t in range(2)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    plain = sorted(map(tuple, preference.preference_rows(preference.star_pairs(table), table).collect()))
    monkeypatch.setattr(preference, "PAIRS", 7)
    for counts in (False, True):
        assert sorted(map(tuple, preference.preference_rows(preference.star_pairs(table, with_counts=counts), table).collect())) == plain
    assert len(plain) == 60 and {r[1] for r in plain} == {5}


def test_preference_against_sql(spark, tmp_path):
    """Turns with one number, repeated rows, nulls, hot first turns and equal conversations."""
    rnd = random.Random(17)
    turns = [(c, k // 2 if c % 4 == 0 else k, rnd.choice(["user", "assistant", None]), rnd.choice(["a", "bb", "", None, "ccc"])) for c in range(60) for k in range(rnd.randint(1, 7))]
    turns += rnd.sample(turns, 30) + [(None, 0, "user", "a"), (3, None, "user", "a")]
    spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    found = db.execute(ORACLE["op5_preference_formatting"])
    names = [d[0] for d in found.description]
    got = QUERIES["op5_preference_formatting"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r[n] for n in names) for r in got) == sorted(found.fetchall()) and len(got) > 90


def test_preference_of_odd_tables(spark):
    names = "conv_id bigint, turn bigint, role string, text string, head string, chosen string, pair_id string, score string"
    none = spark.createDataFrame([], names)
    assert preference.star_pairs(none).collect() == [] and preference.preference_rows(preference.star_pairs(none), none).collect() == []
    assert preference.preference_rows(*preference.stale_replies(none)).collect() == []
    long = "語" * 300_000
    turns = [(1, 0, "user", long), (1, 1, "assistant", long), (2, 0, "user", long), (2, 1, "assistant", "x")]
    table = spark.createDataFrame([(*t, *["c"] * 4) for t in turns * 3], names)
    pairs = preference.star_pairs(table)
    assert [tuple(r) for r in pairs.collect()] == [(2, 1, 2)]
    r, = preference.preference_rows(pairs, table).collect()
    assert r.n_prompt_turns == 1 and r.chosen_text == f"<|assistant|>\n{long}\n<|end|>\n" and r.chosen_mask == [[14, 14 + 300_000 + 9]]
    same = spark.createDataFrame([(c, 0, "user", "q", *["c"] * 4) for c in (5, 4, 6)], names)
    assert sorted(tuple(r) for r in preference.star_pairs(same).collect()) == [(5, 4, 5), (6, 4, 6)]
    assert all((r.chosen_text, r.rejected_text, r.chosen_mask) == ("", "", []) for r in preference.preference_rows(preference.star_pairs(same), same).collect())


def test_preference_keeps_turns_of_one_number(spark):
    turns = [(1, 0, "user", "q"), (1, 1, "assistant", "two"), (1, 1, "assistant", "one"), (1, 1, "assistant", "two"), (2, 0, "user", "q"), (2, 1, "assistant", "8 of 8 .")]
    table = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    shown = lambda *said: "".join(f"<|assistant|>\n{x}\n<|end|>\n" for x in said)
    r, = preference.preference_rows(preference.star_pairs(table), table).collect()
    assert (r.chosen, r.rejected, r.n_prompt_turns) == (2, 1, 1)
    assert r.chosen_text == shown("8 of 8 .") and r.rejected_text == shown("one", "two") and len(r.rejected_mask) == 2
    stale = {x.chosen: x for x in preference.preference_rows(*preference.stale_replies(table)).collect()}
    assert stale[1].prompt == "<|user|>\nq\n<|end|>\n" + shown("one") and (stale[1].chosen_text, stale[1].rejected_text) == (shown("two"), shown("one"))
    assert (stale[2].chosen_text, stale[2].rejected_text) == (shown("8 of 8 ."), shown(""))
