"""Links between items: equal keys, equal fingerprints, fingerprints within a Hamming radius.

Equal keys give a star to the smallest id, by an aggregation and an equi-join: no group is gathered and
no pairs of a group are made. The radius join works on distinct fingerprints and cuts them into a few blocks. Two
within radius r agree in one of m blocks up to r / m bits (the first r mod m + 1 blocks), or one bit less (the others);
so each fingerprint looks up, for each block, all values that near its own. Fewer blocks make longer keys, hence fewer false
candidates, and more values to look up; the number of fingerprints decides.

Where only components are wanted, no pairs of a ball of near fingerprints are made: each is first linked to the smallest one with the same
value of a block, if that is near, then to one of the largest component found by that; only values at which different components meet are then looked up, and of two components that
meet in a task one link is kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinfold.functions.bits import hamming, is_blank
from twinfold.operators.components import connected_components
from twinfold.plans.storage import Scratch, join_facts

#: Lookups a fingerprint may make at most; a row looked up costs about as much as so many comparisons.
MAX_PROBES, ROW_COST = 5000, 30

#: Fingerprints up to this number may be compared each with each, if that is cheaper; members of a block when they are.
SMALL_JOIN, BLOCK = 20_000, 1024

#: Fingerprints up to this number are linked by all their pairs, which are few then and take one job.
FEW = 1000


def star_edges(items: DataFrame, keys: list[str], idx: str = "idx") -> DataFrame:
    """Rows (a, b), a < b: each item and the first one with the same keys. Null keys match nothing."""
    rows = items.select(F.col(idx).alias("b"), *keys).dropna(subset=keys)
    first = rows.groupBy(*keys).agg(F.min("b").alias("a"))
    return join_facts(rows, first, keys).where("a < b").select("a", "b")


def url_edges(items: DataFrame) -> DataFrame:
    """Null and empty urls match nothing; domains don't matter."""
    return star_edges(items.select("idx", F.nullif("url", F.lit("")).alias("url")), ["url"])


def hash_keys(items: DataFrame, partition_by_domain: bool) -> DataFrame:
    """Rows (idx, part, hash) that can match: no null and no blank fingerprints; null domains are one part."""
    part = F.coalesce("domain", F.lit("")) if partition_by_domain else F.lit("")
    return items.where(F.col("hash").isNotNull() & ~is_blank(F.col("hash"))).select("idx", part.alias("part"), "hash")


def probe_cuts(radius: int, blocks: int) -> list[tuple[int, int, int]]:
    """(lowest bit, width, reach) of the blocks that are looked up; in one of them at least, two fingerprints within the radius differ by no more than its reach."""
    ends = [64 * k // blocks for k in range(blocks + 1)]
    reach = [radius // blocks - (k > radius % blocks) for k in range(blocks)]
    return [(ends[k], ends[k + 1] - ends[k], reach[k]) for k in range(blocks) if reach[k] >= 0]


def probes(cuts: list[tuple[int, int, int]]) -> int:
    return sum(math.comb(w, d) for _, w, reach in cuts for d in range(reach + 1))


def candidate_share(cuts: list[tuple[int, int, int]]) -> float:
    """The share of all pairs of random fingerprints that meet in a block."""
    return sum(sum(math.comb(w, d) for d in range(reach + 1)) / 2**w for _, w, reach in cuts)


def choose_blocks(radius: int, n: int, other: int | None = None, pairs: int | None = None) -> int:
    """The number of blocks that makes the join of n distinct fingerprints with each other, or with so many others, cheapest; 0 says to compare each with each, which is only for few pairs.

    pairs: how many pairs there are in all, if fingerprints of different parts make none.

    No key is selective at a large radius: at 16 about 7 of 100 random pairs meet with 5000 lookups a row, at 8 about 3 of 10,000 with 700.
    """
    every, looked = (n * n / 2, n) if other is None else (n * other, other)
    pairs = every if pairs is None else pairs

    def cost(m: int) -> float:
        cuts = probe_cuts(radius, m)
        return ROW_COST * (n * probes(cuts) + looked * len(cuts)) + candidate_share(cuts) * pairs

    best = min((m for m in range(1, 65) if probes(probe_cuts(radius, m)) <= MAX_PROBES), key=cost)
    plain = pairs + ROW_COST * (n * math.ceil(looked / BLOCK) + looked)
    return 0 if pairs <= SMALL_JOIN**2 / 2 and plain < cost(best) else best


def _near_values(cuts: list[tuple[int, int, int]]) -> list[int]:
    """Each lookup as a number: the block's, and the bits to flip in its value."""
    out = []
    for k, (_, width, reach) in enumerate(cuts):
        masks = {0}
        for _ in range(reach):
            masks |= {m | 1 << b for m in masks for b in range(width)}
        out += [k << 56 | m for m in sorted(masks)]
    return out


def _value(h: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(h, low).bitwiseAND(F.lit((1 << width) - 1))


def _values(h: str, cuts: list[tuple[int, int, int]]) -> Column:
    return F.array(*(_value(F.col(h), low, width) for low, width, _ in cuts))


def looking(rows: DataFrame, h: str, cuts: list[tuple[int, int, int]]) -> DataFrame:
    """A row for each value that a fingerprint looks up: all those that near its own in a block."""
    rows = rows.withColumn("_values", _values(h, cuts)).withColumn("_probe", F.explode(F.lit(_near_values(cuts))))
    rows = rows.withColumn("_block", F.shiftright("_probe", 56).cast("int"))
    return rows.withColumn("_value", F.get("_values", "_block").bitwiseXOR(F.col("_probe").bitwiseAND(F.lit((1 << 56) - 1)))).drop("_values", "_probe")


def looked_up(rows: DataFrame, h: str, cuts: list[tuple[int, int, int]]) -> DataFrame:
    """A row for each block, with the fingerprint's own value."""
    return rows.select("*", F.posexplode(_values(h, cuts)).alias("_block", "_value"))


def near_join(one: DataFrame, two: DataFrame, radius: int, blocks: int, ordered: bool = False) -> DataFrame:
    """Rows (a, b, distance) of (a, part, ha) and (b, part, hb) with equal parts within the radius, each pair once; ordered: only a < b.

    Exact for any radius below 64. blocks as chosen by choose_blocks(); with 0, pairs are made block by block of BLOCK rows.
    """
    distance = hamming(F.col("ha"), F.col("hb"))
    keep = (distance <= radius) & (F.col("a") < F.col("b") if ordered else F.lit(True))
    if not blocks:
        n = max(1, math.ceil(two.count() / BLOCK))
        one = one.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        two = two.withColumn("_block", F.pmod(F.xxhash64("b"), F.lit(n)).cast("int"))
        return one.join(two, ["part", "_block"]).where(keep).select("a", "b", distance.alias("distance"))
    cuts = probe_cuts(radius, blocks)
    one, two = looking(one.select("a", "part", "ha"), "ha", cuts), looked_up(two.select("b", "part", "hb"), "hb", cuts)
    differ, met = F.col("ha").bitwiseXOR(F.col("hb")), F.lit(False)  # met: in an earlier block
    for k, (low, width, reach) in enumerate(cuts):
        met = met | ((F.lit(k) < F.col("_block")) & (F.bit_count(_value(differ, low, width)) <= reach))
    return one.join(two, ["part", "_block", "_value"]).where(keep & ~met).select("a", "b", distance.alias("distance"))


def hamming_pairs(hashes: DataFrame, radius: int, blocks: int | None = None) -> DataFrame:
    """Rows (a, b, distance) of distinct (idx, part, hash) within the radius, a < b."""
    if blocks is None:
        blocks = choose_blocks(radius, hashes.count())
    one = hashes.select(F.col("idx").alias("a"), "part", F.col("hash").alias("ha"))
    two = hashes.select(F.col("idx").alias("b"), "part", F.col("hash").alias("hb"))
    return near_join(one, two, radius, blocks, ordered=True)


def near_forest(hashes: DataFrame, radius: int, scratch: Scratch, blocks: int | None = None) -> DataFrame:
    """Links (a, b) between distinct (idx, part, hash), whose components are those of all pairs within the radius. Their number grows with the fingerprints, not with the pairs."""
    hashes = scratch.save(hashes.select("idx", "part", "hash"), "hashes")
    if blocks is None:
        n, pairs = hashes.groupBy("part").agg(F.count("*").cast("double").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0.0)), F.coalesce(F.sum(F.col("n") * F.col("n") / 2), F.lit(0.0))).first()
        blocks = choose_blocks(radius, int(n), pairs=pairs)
    cuts, key = probe_cuts(radius, blocks or radius + 1), ["part", "_block", "_value"]
    # those with one value of a block are linked to the smallest one, then to one of the largest component so far
    stars, placed = None, hashes.withColumns({"component": F.col("idx"), "members": F.lit(1).cast("bigint")})
    for _ in range(2):
        own = looked_up(placed, "hash", cuts)
        lead = own.groupBy(*key).agg(F.max(F.struct("members", (-F.col("idx")).alias("low"), "hash", "component")).alias("_lead"))
        near = join_facts(own, lead, key).where((F.col("_lead.component") != F.col("component")) & (hamming(F.col("hash"), F.col("_lead.hash")) <= radius))
        new = near.select(F.least("idx", -F.col("_lead.low")).alias("a"), F.greatest("idx", -F.col("_lead.low")).alias("b")).distinct()
        stars = scratch.save(new if stars is None else stars.unionByName(new), "stars")
        parts = connected_components(stars, scratch).withColumnRenamed("id", "idx")
        sizes = parts.groupBy("component").agg(F.count("*").alias("members"))
        parts = join_facts(parts, sizes, ["component"])
        placed = scratch.save(hashes.join(parts, "idx", "left").select("idx", "part", "hash", F.coalesce("component", "idx").alias("component"), F.coalesce("members", F.lit(1)).cast("bigint").alias("members")), "placed")

    # values at which different components meet
    if blocks:
        one, two = looking(placed, "hash", cuts), looked_up(placed, "hash", cuts)
    else:
        n = max(1, math.ceil(placed.count() / BLOCK))
        key = ["part", "_block"]
        one = placed.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        two = placed.withColumn("_block", F.pmod(F.xxhash64("idx"), F.lit(n)).cast("int"))
    ends = one.select(*key, "component").unionByName(two.select(*key, "component"))
    mixed = scratch.save(ends.groupBy(*key).agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select(*key), "mixed")
    sides = [join_facts(rows, mixed, key).select(*key, F.col("idx").alias(f"_{x}"), F.col("hash").alias(f"_h{x}"), F.col("component").alias(f"_c{x}")) for rows, x in ((one, "a"), (two, "b"))]
    met = sides[0].join(sides[1], key).where((F.col("_ca") != F.col("_cb")) & (hamming(F.col("_ha"), F.col("_hb")) <= radius))
    across = met.groupBy(F.least("_ca", "_cb").alias("_low"), F.greatest("_ca", "_cb").alias("_high")).agg(F.min(F.struct("_a", "_b")).alias("m"))
    return stars.unionByName(across.select(F.least("m._a", "m._b").alias("a"), F.greatest("m._a", "m._b").alias("b")))


def hash_edges(items: DataFrame, radius: int, partition_by_domain: bool, scratch: Scratch, blocks: int | None = None) -> DataFrame:
    """Links by fingerprint: stars of equal ones, and a forest over the first items of those within the radius."""
    keys = hash_keys(items, partition_by_domain)
    same = star_edges(keys, ["part", "hash"])
    if not radius:
        return same
    distinct = keys.groupBy("part", "hash").agg(F.min("idx").alias("idx"))
    distinct = scratch.save(distinct, "distinct")
    if distinct.count() <= FEW:
        return same.unionByName(hamming_pairs(distinct, radius, blocks).select("a", "b"))
    return same.unionByName(near_forest(distinct, radius, scratch, blocks))
