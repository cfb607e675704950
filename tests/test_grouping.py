import base64
import os

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from twinfold.functions import domains, hashes
from twinfold.operators import collapse, components, edges, order, rules
from twinfold.operators.components import connected_components
from twinfold.operators.dedup import DuplicateFinder
from twinfold.operators.order import position, running_sums, with_ordinals
from twinfold.plans import config
from twinfold.plans.config import DedupConfig, load_settings, reset_settings, save_settings, update_settings
from twinfold.sources.items import background_replies, page_route, project
from twinfold.streaming import state
from twinfold.streaming.incremental import IncrementalFinder

ITEM = "idx bigint, url string, domain string, hash bigint, visible boolean"
H, BLANKS = 0x0F0F0F0F0F0F0F0F, (0, -(2**63), 2**63 - 1, -1)
CASES = [
    ([("u1", "d", H), ("u2", "d", H - 1), ("u3", "d", 0x123456789ABCDEF0), ("u4", "d", H)], {}, [[0, 1, 3], [2]]),
    ([("u1", "d", None), ("u2", "d", None), ("u1", "d", None)], {}, [[0, 2], [1]]),
    ([("u1", "d1", None), ("u1", "d2", None)], {}, [[0, 1]]),
    ([("u9", "d", None), ("u1", "d", H), ("u2", "d", None), ("u3", "d", H), ("u8", "d", None), ("u2", "d", None), ("u4", "d", H), ("u2", "d", None)], {}, [[0], [1, 3, 6], [2, 5, 7], [4]]),
    ([("u1", "d", H), ("u2", "d", H)], {"deduplicateThumbs": False}, [[0], [1]]),
    ([("u1", "independent.co.uk", H), ("u2", "independent.co.uk", H), ("u1", "independent.co.uk", None)], {"domainSettings": (("independent.co.uk", False),)}, [[0, 2], [1]]),
    ([("u1", "d", 0xFF), ("u2", "d", 0xFF), ("u3", "d", 0xFFF)], {}, [[0, 1, 2]]),
    ([("u1", "d", 0xFF), ("u2", "d", 0xFF), ("u3", "d", 0xFFF)], {"maxHammingDistance": 0}, [[0, 1], [2]]),
    ([("u1", "d1", H), ("u2", "d2", H)], {}, [[0], [1]]),
    ([("u1", "d1", H), ("u2", "d2", H)], {"partitionByDomain": False}, [[0, 1]]),
    ([("u1", None, H), ("u2", None, H)], {}, [[0, 1]]),
    ([("", "d", None), ("", "d", None), (None, "d", None), (None, "d", None)], {}, [[0], [1], [2], [3]]),
    ([("u1", "d", 0xFF), ("u2", "d", 0xFFFF), ("u3", "d", 0xFFFFFF)], {}, [[0, 1, 2]]),
    ([("u1", "d", 0xFF), ("u2", "d", 0x1FFFF)], {}, [[0], [1]]),
    ([("u1", "d", -1), ("u1", "d", -1)], {}, [[0, 1]]),
    *(([("u1", "d", b), ("u2", "d", b)], {}, [[0], [1]]) for b in BLANKS),
]


def told(frame):
    out = {}
    for r in frame.select("idx", "primary_idx").collect():
        out.setdefault(r.primary_idx, []).append(r.idx)
    return [sorted(out[k]) for k in sorted(out)]


@pytest.mark.parametrize("rows, config, want", CASES)
def test_golden_groups(spark, scratch, rows, config, want):
    items = spark.createDataFrame([(k, *r, True) for k, r in enumerate(rows)], ITEM)
    assert told(DuplicateFinder(DedupConfig(**config), scratch).grouped(items)) == want


def test_invisible_keep_their_number_and_hash_is_shown(spark, scratch):
    items = spark.createDataFrame([(0, "u", "d", None, True), (1, "u", "d", None, False), (2, "u", "d", H, True)], ITEM)
    rows = {r.idx: r for r in DuplicateFinder(DedupConfig(showHashValues=True), scratch).grouped(items).collect()}
    assert sorted(rows) == [0, 2] and rows[0].label == "(1 duplicate — show)" and rows[2].hidden and rows[2].pos == 1
    assert rows[0].hash_hex is None and rows[2].hash_hex == " [0f0f0f0f0f0f0f0f]"


RULES = [(0, "co.uk", True), (1, "independent.co.uk", False), (2, "a.com", True), (3, "a.com", False), (4, "skip.org", None)]


def test_rules(spark):
    table = spark.createDataFrame(RULES, "pos int, domain string, value boolean")
    want = {"x.independent.co.uk": False, "y.co.uk": True, "z.org": True, "a.com.": False, "A.com": True, "skip.org": True, "dependent.co.uk": True, None: True}
    items = spark.createDataFrame([(d,) for d in want], "domain string")
    assert {r.domain: r.process for r in rules.lookup(items, table, True).collect()} == want
    assert [(r.domain, r.value) for r in rules.ordered_rules(table).collect()] == [("a.com", False), ("skip.org", None), ("co.uk", True), ("independent.co.uk", False)]
    later = rules.with_rules(table, spark.createDataFrame([(0, "co.uk.", False), (1, "b.com", True)], "pos int, domain string, value boolean"))
    assert [(r.domain, r.value) for r in rules.ordered_rules(later).collect()] == [("a.com", False), ("b.com", True), ("skip.org", None), ("co.uk.", False), ("independent.co.uk", False)]
    assert rules.rule_count(later).first().n_rules == 5


@pytest.mark.parametrize("radius", [1, 4, 8, 16])
def test_radius_join_is_exact(spark, radius):
    import random

    rnd = random.Random(radius)
    seeds = [rnd.getrandbits(64) for _ in range(12)]
    values = sorted({s ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, radius + 4))) for s in seeds for _ in range(8)})
    signed = [v - 2**64 if v >> 63 else v for v in values]
    frame = spark.createDataFrame(list(enumerate(signed)), "idx bigint, hash bigint").withColumn("part", F.when(F.col("idx") % 2 == 0, "x").otherwise("y"))
    for parts, rows in ((1, frame.withColumn("part", F.lit(""))), (2, frame)):
        want = {(a, b, d) for a in range(len(values)) for b in range(a + 1, len(values)) if (d := (values[a] ^ values[b]).bit_count()) <= radius and (b - a) % parts == 0}
        for blocks in {0, 3 if radius <= 8 else 5, radius + 1, edges.choose_blocks(radius, 10**6)}:
            got = [(r.a, r.b, r.distance) for r in edges.hamming_pairs(rows, radius, blocks).collect()]
            assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize(("radius", "blocks"), [(8, None), (8, 3), (8, 9), (3, 4), (16, 5)])
def test_forest_of_near_fingerprints(spark, scratch, radius, blocks):
    """Groups are those of all pairs; a dense ball gives links in proportion to its members."""
    import random

    rnd = random.Random(radius)
    middle = rnd.getrandbits(64)
    flipped = lambda v, n: v ^ sum(1 << b for b in rnd.sample(range(64), n))
    ball = {flipped(middle, rnd.randint(0, radius // 2)) for _ in range(600)} | {middle}
    chain, value = [], rnd.getrandbits(64)
    for _ in range(40):
        chain.append(value := flipped(value, radius))
    values = sorted(ball | set(chain) | {flipped(rnd.choice(chain), radius + 2) for _ in range(40)} | {rnd.getrandbits(64) for _ in range(60)})
    signed = [v - 2**64 if v >> 63 else v for v in values]
    frame = spark.createDataFrame(list(enumerate(signed)), "idx bigint, hash bigint").withColumn("part", F.lit(""))
    links = {(r.a, r.b) for r in edges.near_forest(frame, radius, scratch, blocks).collect()}
    assert all(a < b and (values[a] ^ values[b]).bit_count() <= radius for a, b in links)
    pairs = [(a, b) for a in range(len(values)) for b in range(a + 1, len(values)) if (values[a] ^ values[b]).bit_count() <= radius]

    def groups(found):
        led = list(range(len(values)))

        def root(x):
            while led[x] != x:
                led[x] = led[led[x]]
                x = led[x]
            return x

        for a, b in found:
            a, b = root(a), root(b)
            led[max(a, b)] = min(a, b)
        return [root(x) for x in range(len(values))]

    assert groups(links) == groups(pairs)
    assert len(pairs) < 2000 or len(links) < 6 * len(values) < len(pairs)


@pytest.mark.parametrize("size", [16, 1 << 18])
def test_chains_are_contracted_where_they_lie(spark, scratch, monkeypatch, size):
    """The links of a chain of 3000 nodes that one task reads: rounds and links by how many it contracts at once."""
    monkeypatch.setattr(components, "CONTRACTED", size)
    written, save = [], scratch.save
    monkeypatch.setattr(scratch, "save", lambda frame, name: written.append((out := save(frame, name)).count()) or out)
    chain = spark.range(3000).coalesce(1).select((F.col("id") * 7 + 8).alias("a"), (F.col("id") * 7 + 1).alias("b"))
    got = connected_components(chain, scratch)
    assert got.where("component <> 1").isEmpty() and got.count() == 3001
    assert written == [3000] if size > 3000 else 3000 >= written[0] and len(written) <= 7
    a, b = components.local_roots(np.array([5, 9, 2, 7]), np.array([9, 2, 7, 11]))
    assert a.tolist() == [5, 7, 9, 11] and set(b.tolist()) == {2}
    assert [x.tolist() for x in components.local_roots(np.array([3]), np.array([3]))] == [[], []]


def test_few_candidates_meet(spark):
    import random

    rnd = random.Random(7)
    n = 3000
    frame = spark.createDataFrame([(k, rnd.getrandbits(64) - 2**63) for k in range(n)], "idx bigint, hash bigint").withColumn("part", F.lit(""))
    blocks = edges.choose_blocks(8, 10**6)
    found = edges.hamming_pairs(frame, 8, blocks)
    assert found.count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and edges.candidate_share(edges.probe_cuts(8, blocks)) < 0.01


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=30))
def test_components(spark, links):
    from twinfold.plans.storage import Scratch

    parent = {x: x for pair in links for x in pair}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {x: find(x) for x in parent if any(find(x) == find(y) for y in parent if y != x)}
    got = connected_components(spark.createDataFrame(links, "a bigint, b bigint"), Scratch(spark))
    assert {r.id: r.component for r in got.collect()} == want


def test_positions_and_ordinals(spark, scratch):
    frame = spark.createDataFrame([(g, i) for g in (1, 2) for i in range(g, 40, g)], "g int, i bigint")
    for r in position(frame, "g", "i", scratch).collect():
        assert r.pos == (r.i - r.g) // r.g
    assert [r.idx for r in with_ordinals(frame.where("g = 2"), "i", scratch, 5).orderBy("i").collect()] == list(range(5, 24))
    assert with_ordinals(frame.where("g = 9"), "i", scratch).collect() == [] == position(frame.where("g = 9"), "g", "i", scratch).collect()


@pytest.mark.parametrize("kind", ["sparse", "one value", "null"])
def test_orders_without_large_windows(spark, scratch, kind):
    """Sparse keys and equal keys lie in many partitions, and no more than a row of each partition is summed up in one place."""
    key = {"sparse": F.col("id") * 1_000_003 * 1_000_003, "one value": F.lit(7).cast("bigint"), "null": F.lit(None).cast("bigint")}[kind]
    frame = spark.range(0, 5000, 1, 4).select(key.alias("k"), (F.col("id") % 10 < 9).cast("int").alias("g"), F.lit(2).cast("bigint").alias("v"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = [r["count"] for r in order.ordered(frame, ["k"], scratch, ties=True).groupBy("_part").count().collect()]
        assert len(parts) == 4 and max(parts) < 2500
        got = with_ordinals(frame, "k", scratch).collect()
        assert sorted(r.idx for r in got) == list(range(5000)) and (kind != "sparse" or all(r.idx == r.id for r in got))
        ranked = position(frame, "g", "k", scratch).collect()
        assert sorted((r.g, r.pos) for r in ranked) == [(0, k) for k in range(500)] + [(1, k) for k in range(4500)]
        sums = running_sums(frame, ["k", "id"], ["v"], scratch, "g").collect()
        assert sorted((r.g, r.v) for r in sums) == [(0, 2 * k + 2) for k in range(500)] + [(1, 2 * k + 2) for k in range(4500)]
        assert sorted(r.v for r in running_sums(frame, ["k", "id"], ["v"], scratch).collect()) == list(range(2, 10001, 2))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


BATCHES = (
    [(0, "u1", "d", None, True), (1, "u2", "d", H, True), (2, "u1", "d", None, True)],
    [(3, "u3", "d", None, True), (4, "u2", "d", None, True)],
    [(5, "u1", "d", H, True), (6, "u9", "d", None, True)],
)
WANT = [(3, 1, 1, 1, 1), (2, 0, 1, 2, 2), (2, 0, 1, 1, 4)]


def fed(finder, spark, k, rows):
    finder.on_batch(spark.createDataFrame(rows, ITEM), k)
    s = finder.stats[k]
    return tuple(s[x] for x in ("num_links", "batch_num_with_dups", "batch_total_dups", "num_with_dups", "total_dups"))


def test_batches(spark):
    finder = IncrementalFinder(spark, DedupConfig())
    assert [fed(finder, spark, k, rows) for k, rows in enumerate(BATCHES)] == WANT and not finder.errors
    assert told(finder.items) == [[0, 1, 2, 4, 5], [3], [6]]
    assert fed(finder, spark, 9, []) == (0, 0, 0, 1, 4) and told(finder.items) == [[0, 1, 2, 4, 5], [3], [6]]


def test_batches_after_a_restart_and_compaction(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "FAN", 2)
    monkeypatch.setattr(state, "BUCKET_ROWS", 1)
    got = []
    for k, rows in enumerate(BATCHES):
        finder = IncrementalFinder(spark, DedupConfig(), f"file://{tmp_path}/state")
        assert sorted(finder.stats) == list(range(k))
        for done in range(k):
            finder.on_batch(spark.createDataFrame(BATCHES[done], ITEM), done)  # done before: nothing happens
        got.append(fed(finder, spark, k, rows))
    assert got == WANT
    again = IncrementalFinder(spark, DedupConfig(), f"file://{tmp_path}/state")
    assert told(again.items) == [[0, 1, 2, 4, 5], [3], [6]]
    assert again.status() == {"page_type": "listing page", "ignored": False, "initialized": True, "pending": 0, "num_links": 7, "num_with_dups": 1, "total_dups": 4, "last_batch_error": None}


@pytest.mark.parametrize("order", [(2, 1, 0), (1, 2, 0), (2, 0, 1)])
def test_batches_in_any_order(spark, order):
    finder = IncrementalFinder(spark, DedupConfig())
    for k in order:
        fed(finder, spark, k, BATCHES[k])
    assert told(finder.items) == [[0, 1, 2, 4, 5], [3], [6]] and finder.status()["total_dups"] == 4 and finder.status()["num_with_dups"] == 1


def test_radius_and_groups_over_batches(spark, scratch):
    import random

    rnd = random.Random(11)
    rows = [(k, rnd.choice([None, "", f"u{rnd.randint(0, 15)}"]), rnd.choice(["d", "e", None]), rnd.choice([None, -1, rnd.choice([0xFF, 0xFFFF0000, 0x123456789]) ^ sum(1 << rnd.randint(0, 62) for _ in range(rnd.randint(0, 6)))]), rnd.random() < 0.9) for k in range(60)]
    for config in (DedupConfig(), DedupConfig(partitionByDomain=False, maxHammingDistance=3), DedupConfig(maxHammingDistance=0)):
        whole = DuplicateFinder(config, scratch).grouped(spark.createDataFrame(rows, ITEM))
        finder = IncrementalFinder(spark, config)
        for k, part in enumerate((rows[40:], rows[:10], rows[10:40])):
            finder.on_batch(spark.createDataFrame(part, ITEM), k)
        assert not finder.errors and told(finder.items) == told(whole)
        stats = collapse.stats(whole).first().asDict()
        assert {k: finder.status()[k] for k in stats} == stats


def test_a_failed_batch(spark):
    bad = spark.createDataFrame([(7, "u1")], "idx bigint, url string")
    finder = IncrementalFinder(spark, DedupConfig())
    finder.on_batch(bad, 5)
    assert 5 in finder.errors and finder.status()["last_batch_error"] == finder.errors[5] and not finder.stats
    assert finder.status()["num_links"] == 1  # it has arrived
    assert fed(finder, spark, 0, BATCHES[0]) == WANT[0]
    finder.on_batch(spark.createDataFrame([(7, "u1", "d", None, True)], ITEM), 5)
    assert not finder.errors and told(finder.items) == [[0, 2, 7], [1]] and finder.status()["num_links"] == 4
    with pytest.raises(Exception, match="visible"):
        IncrementalFinder(spark, DedupConfig(), on_error="raise").on_batch(bad, 0)
    with pytest.raises(ValueError):
        IncrementalFinder(spark, DedupConfig(), on_error="ignore")
    idle = IncrementalFinder(spark, DedupConfig(), page_type=None)
    idle.on_batch(bad, 0)
    assert idle.status()["ignored"] and not idle.errors
    for page, lacks in (("single page", False), ("no body class", False), ("search page", True)):  # the reason stands as the page type
        told_ = IncrementalFinder(spark, DedupConfig(), page_type=page, ignored=lacks).status()
        assert told_["ignored"] and told_["page_type"] == page and told_["num_links"] == 0


def test_a_batch_reads_its_own_buckets(spark, tmp_path, monkeypatch):
    """Files read grow with the batch, not with the state; a failed batch leaves nothing behind; records are pruned."""
    monkeypatch.setattr(state, "BUCKET_ROWS", 8)
    path = tmp_path / "state"
    finder = IncrementalFinder(spark, DedupConfig(), f"file://{path}")
    many = spark.range(256).select(F.col("id").alias("idx"), F.concat(F.lit("u"), F.col("id") % 200).alias("url"), F.concat(F.lit("d"), F.col("id") % 64).alias("domain"), (F.col("id") * 0x0123456789ABCD % (1 << 62)).alias("hash"), F.lit(True).alias("visible"))
    finder.on_batch(many, 0)
    total = {k: len(b) for k, b in finder.state.parts[0]["buckets"].items()}
    assert total["url"] > 20 and total["print"] > 10 and total["size"] > 10
    few = [(300, "u7", "d5", None, True), (301, "new", "d7", 12345, True)]
    finder.on_batch(spark.createDataFrame(few, ITEM), 1)
    assert not finder.errors and finder.state.files == {"url": 2, "print": 1, "former": 0, "size": 1}
    assert {r.idx: r.primary_idx for r in finder.items.where("idx in (7, 207, 300, 301)").collect()} == {7: 7, 207: 7, 300: 7, 301: 301}
    finder.on_batch(spark.createDataFrame([(9, "u1")], "idx bigint, url string"), 2)
    assert finder.errors and sorted(p.name for p in (path / "parts").iterdir()) == ["1", "2"]
    for k in range(3, 6):
        finder.on_batch(spark.createDataFrame([], ITEM), k)
    assert len([p for p in (path / "done").iterdir() if p.suffix == ".json"]) == 2 and finder.done == [[0, 1], [3, 5]]


def test_a_primary_that_falls_again_and_again(spark, scratch):
    """Each batch takes the place of the primary before it; ways of several steps are followed, and stored as one."""
    finder, seen = IncrementalFinder(spark, DedupConfig(maxHammingDistance=0)), []
    batches = [[(20, "a", "d", None, True), (21, "b", "d", None, True)], [(15, "a", "d", None, True)], [(12, "b", "d", None, True)], [(9, "a", "d", None, True)], [(5, "a", "d", None, True), (6, "b", "d", None, True)], [(3, "a", "d", None, True)], [(30, "b", "d", None, True)], [(1, "c", "d", 77, True), (2, "a", "d", 77, True)]]
    for k, rows in enumerate(batches):
        seen += rows
        finder.on_batch(spark.createDataFrame(rows, ITEM), k)
    whole = DuplicateFinder(DedupConfig(maxHammingDistance=0), scratch).grouped(spark.createDataFrame(seen, ITEM))
    assert not finder.errors and told(finder.items) == told(whole) == [[1, 2, 3, 5, 9, 15, 20], [6, 12, 21, 30]]
    assert finder.status()["total_dups"] == 9 and finder.status()["num_with_dups"] == 2


def test_stream(spark, tmp_path):
    finder = IncrementalFinder(spark, DedupConfig())
    spark.createDataFrame([(3, "a", "d", None, True), (1, "a", "d", None, True)], ITEM).coalesce(1).write.parquet(str(tmp_path / "in"))
    query = spark.readStream.schema(ITEM).parquet(str(tmp_path / "in")).writeStream.foreachBatch(finder.on_batch).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert not finder.errors and told(finder.items) == [[1, 3]]


MESSAGES = {
    (0, 0, 0): "No duplicates found", (3, 9, 0): "No duplicates found", (1, 1, 1): "Found 1 item with 1 duplicate", (2, 3, 3): "Found 2 items with 3 duplicates",
    (2, 5, 1): "Found 1 duplicate, total 2 items with 5 duplicates", (1, 5, 2): "Found 2 duplicates, total 1 item with 5 duplicates",
}


def test_messages(spark):
    rows = spark.createDataFrame(list(MESSAGES), "num_with_dups int, total_dups int, batch_total_dups int")
    assert [r.m for r in rows.select(collapse.stats_message().alias("m")).collect()] == list(MESSAGES.values())


def test_clashing_columns_and_toggles(spark, scratch):
    names = f"{ITEM}, component bigint, process string, label string, pos string, _id int"
    items = spark.createDataFrame([(k, f"u{k % 2}", "d", None, True, 5, "mine", "x", "y", 3) for k in range(6)], names)
    finder = DuplicateFinder(DedupConfig(), scratch)
    rows = {r.idx: r for r in finder.grouped(items).collect()}
    assert rows[0].label == "(2 duplicates — show)" and rows[0].process == "mine" and rows[2].component == 5 and rows[2].pos == 1 and rows[2].hidden
    toggled = spark.createDataFrame([(1,), (1,), (None,), (4,)], "primary_idx bigint")
    rows = {r.idx: r for r in finder.grouped(items, toggled=toggled).collect()}
    assert [rows[k].hidden for k in range(6)] == [False, False, True, False, True, False]
    assert rows[0].label == "(2 duplicates — show)" and rows[1].label == "(2 duplicates — hide)"
    rows = {r.idx: r for r in finder.grouped(items, show=True, toggled=toggled).collect()}
    assert [rows[k].hidden for k in range(6)] == [False, False, False, True, False, True]


def test_display(spark, scratch, tmp_path):
    items = spark.createDataFrame([(k, f"u{k % 3}", "d", None, True) for k in range(9)], ITEM)
    grouped = DuplicateFinder(DedupConfig(), scratch).grouped(items)
    want = [0, 3, 6, 1, 4, 7, 2, 5, 8]
    assert [r.idx for r in collapse.display_order(grouped).collect()] == want
    collapse.write_display(grouped, str(tmp_path / "shown"))
    parts = sorted((tmp_path / "shown").glob("part-*"))
    assert [r for p in parts for r in pq.read_table(p).column("idx").to_pylist()] == want


def test_projection(spark):
    names = "page_type string, data_url string, data_domain string, search_link string, search_title string, page_url string"
    rows = [("listing page", "raw", "Raw.D", "x", "y", None), ("search page", "raw", "d", "/a?b", "z", "https://H.i/s"), ("search page", "r", "d", None, "https://T.u/v", "https://h.i/"), ("search page", "r", "d", None, None, "https://h.i/")]
    got = [(r.url, r.domain) for r in project(spark.createDataFrame(rows, names)).collect()]
    assert got == [("raw", "Raw.D"), ("https://H.i/a?b", "h.i"), ("https://T.u/v", "t.u"), (None, None)]
    with pytest.raises(Exception, match="unknown page type: other"):
        project(spark.createDataFrame([("other", *rows[0][1:])], names)).collect()


def test_replies(spark):
    suffix = domains.IMAGE_HOST_SUFFIX
    asked = spark.createDataFrame([(0, f"http://a{suffix}/x", "https://p/q"), (1, f"//a{suffix}/bad", "https://p/q"), (2, "http://evil/x", "https://p/q"), (3, f"/x#{suffix}", f"http://a{suffix}/"), (4, None, None)], "k int, url string, page_url string")
    grid = [float(k % 32) * 8 for k in range(1024)]
    images = spark.createDataFrame([(f"https://a{suffix}/x", grid), (f"https://a{suffix}/bad", None), (f"https://a{suffix}/x#{suffix}", grid), ("http://evil/x", grid)], "fetch_url string, grid array<double>")
    got = {r.k: (r.reply, r.error) for r in background_replies(asked, images, "diffHash").collect()}
    good, bad = (base64.b64encode(bytes.fromhex("011a011aac402c40")).decode(), None), (None, "Failed to get image hash")
    assert got == {0: good, 1: bad, 2: bad, 3: good, 4: bad}


def test_settings(spark, tmp_path):
    config = DedupConfig(domainSettings=(("a.com", False),), hashFunction="diffHash")
    save_settings(spark, str(tmp_path / "s"), config)
    assert load_settings(spark, str(tmp_path / "s")) == config
    assert load_settings(spark, str(tmp_path / "none")) == DedupConfig()
    assert update_settings(spark, str(tmp_path / "s"), maxHammingDistance=3) == load_settings(spark, str(tmp_path / "s")) == DedupConfig(domainSettings=(("a.com", False),), hashFunction="diffHash", maxHammingDistance=3)
    reset_settings(spark, str(tmp_path / "s"))
    assert load_settings(spark, str(tmp_path / "s")) == DedupConfig()
    with pytest.raises(ValueError):
        DedupConfig(hashFunction="md5")


def test_a_save_that_breaks_off_changes_nothing(spark, tmp_path, monkeypatch):
    path, first = f"file://{tmp_path}/s", DedupConfig(maxHammingDistance=4)
    save_settings(spark, path, first)
    with monkeypatch.context() as broken:
        broken.setattr(config, "write_text", lambda *_: (_ for _ in ()).throw(OSError("no space")))
        with pytest.raises(OSError, match="no space"):
            save_settings(spark, path, DedupConfig(maxHammingDistance=9))
    assert load_settings(spark, path) == first
    for k in range(5, 8):
        update_settings(spark, path, maxHammingDistance=k)
    assert load_settings(spark, path).maxHammingDistance == 7 and len([x for x in os.listdir(tmp_path / "s") if x.endswith(".json")]) == 2
    newest = max(x for x in os.listdir(tmp_path / "s") if x.endswith(".json"))
    (tmp_path / "s" / f".{newest}.crc").unlink(missing_ok=True)
    (tmp_path / "s" / newest).write_text('{"maxHamm')
    with pytest.warns(UserWarning, match="damaged"):
        assert load_settings(spark, path).maxHammingDistance == 6


ROUTES = [
    ([], None, "no body class", None), (None, None, "no body class", None), (["single-page", "listing-page"], None, "single page", None), (["listing-page"], "listing page", None, "#siteTable"),
    (["listing-page", "search-page", "combined-search-page"], "listing page", None, "#siteTable"), (["search-page", "combined-search-page"], "search page", None, ".search-result-group:last"), (["search-page"], "listing page", None, "#siteTable"), (["x"], None, "other", None),
]


def test_routing(spark):
    rows = spark.createDataFrame([(k, r[0]) for k, r in enumerate(ROUTES)], "k int, c array<string>")
    got = [r.r for r in rows.select("k", page_route(F.col("c")).alias("r")).orderBy("k").collect()]
    assert [(r.page_type, r.reason, r.container) for r in got] == [r[1:] for r in ROUTES]
    got = [r.r for r in rows.select("k", page_route(F.col("c"), F.array(F.lit("#siteTable"))).alias("r")).orderBy("k").collect()]
    assert [r.container for r in got] == [None if r[3] is None or r[1] == "search page" else r[3] for r in ROUTES] and got[5].reason == "no container"


def test_batches_work_on_sets_of_items(spark, monkeypatch):
    """Items of one url and fingerprint are one node: the links of a batch grow with its urls, not with its items."""
    from twinfold.streaming import incremental

    links, plain = [], incremental.connected_components
    monkeypatch.setattr(incremental, "connected_components", lambda found, scratch: (links.append(found.count()), plain(found, scratch))[1])
    finder = IncrementalFinder(spark, DedupConfig(maxHammingDistance=0), on_error="raise")
    item = lambda a, b: spark.range(a, b).select(F.col("id").alias("idx"), F.concat(F.lit("u"), F.col("id") % 3).alias("url"), F.lit(None).cast("string").alias("domain"), F.lit(None).cast("bigint").alias("hash"), (F.col("id") % 10 != 0).alias("visible"))
    finder.on_batch(item(300, 600), 0)
    finder.on_batch(item(0, 300), 1)
    assert max(links) <= 3
    assert told(finder.items) == sorted([k for k in range(600) if k % 3 == m and k % 10] for m in range(3))
    got = [tuple(finder.stats[k][x] for x in ("n_items", "batch_num_with_dups", "batch_total_dups", "num_with_dups", "total_dups")) for k in (0, 1)]
    assert got == [(270, 3, 267, 3, 267), (270, 3, 267, 3, 537)]


def test_difference_hashes_agree(spark):
    """The form on whole batches gives the bits of the column form, with values that are rounded, and nothing for grids that aren't whole."""
    import random

    rnd = random.Random(3)
    rows = [(k, [rnd.choice([1 / 3, 200 / 3, 0.1, 0.2, 0.3]) for _ in range(1024)]) for k in range(40)] + [(40, None), (41, [1.0] * 1023), (42, [1.0] * 1023 + [None]), (43, [float("nan")] + [1.0] * 1023), (44, [1.0] * 1024)]
    grid = spark.createDataFrame(rows, "k int, grid array<double>")
    got = grid.select("k", hashes.image_hash(F.col("grid"), "diffHash").alias("a"), hashes.diff_hash32("grid").alias("b")).collect()
    assert all(r.a == r.b for r in got) and [r.k for r in got if r.b is None] == [40, 41, 42, 43]


def test_items_are_not_shuffled_for_few_domains(spark):
    """Values of few domains are broadcast, and without rules nothing is looked up; the values are those of a join."""
    items = spark.createDataFrame([(0, "a.de", "x"), (1, "b.fr", "y"), (2, None, "z")], "idx int, domain string, grid string")
    table = spark.createDataFrame([(0, "de", False)], "pos int, domain string, value boolean")
    plan = lambda found: found._jdf.queryExecution().executedPlan().toString()
    found = rules.lookup(items, table, True)
    assert {r.idx: r.process for r in found.collect()} == {0: False, 1: True, 2: True}
    assert "SortMergeJoin" not in plan(found)
    none = rules.lookup(items, table.limit(0), False)
    assert [r.process for r in none.collect()] == [False] * 3 and "Join" not in plan(none)


def test_parts_make_fewer_pairs():
    """Fingerprints of many parts meet in fewer pairs, so fewer values are looked up."""
    one, many = (edges.probes(edges.probe_cuts(8, edges.choose_blocks(8, 2_500_000, pairs=p))) for p in (None, 2_500_000**2 / 40))
    assert many < one
