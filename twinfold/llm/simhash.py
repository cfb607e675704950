"""Near-duplicate documents by SimHash fingerprints, found by pigeonring filtering.

The 64 bits of a fingerprint are cut into m segments that form a ring. If two fingerprints differ in at most r bits, then
some segment starts a chain in which every first l segments differ in at most l * r / m bits together (the strong form of the
pigeonhole principle on a ring). So the first ceil(m / r) - 1 segments of that chain are equal: they are the key on which
candidates meet; and the budgets of the longer chains prune candidates before the full distance is taken. More segments
make longer keys and more of them; the number of fingerprints decides.

Equal fingerprints are one from the start. Keys that very many different fingerprints share are not compared
pair by pair: two fingerprints within r = 2 bits have a value between them that is within one bit of both, so each
member names itself and its neighbours in the bits outside of the key, and those that name one value form a star. That is
exact, and its rows grow with the members only.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinfold.llm.common import map_rows, signed
from twinfold.operators.components import connected_components
from twinfold.plans.storage import Scratch, join_facts, row_keyed

#: Members of a key that are still compared with each other; those of larger keys meet at the values between them.
PAIRED = 64
#: What a row looked up costs, in comparisons.
_ROW_COST = 30
#: Shingles hashed at once.
_STEP = 1 << 16


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """A bit is set if it is in over half of the XXH64 of all word shingles, repeats included; zero without words. A-Z count as a-z; fewer words than the width are one shingle."""
    words = text.lower().split()
    if not words:
        return 0
    size = min(width, len(words))
    plain = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - size + 1].tolist()
    stops = ends[size - 1 :].tolist()
    n, ones, digest = len(starts), np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, _STEP):
        h = np.fromiter((digest(plain[a:b], seed) for a, b in zip(starts[at : at + _STEP], stops[at : at + _STEP], strict=True)), np.uint64)
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def segments(m: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of m segments of 64 bits."""
    ends = [64 * k // m for k in range(m + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]


def equal_segments(m: int, radius: int) -> int:
    """How many segments at a chain's start are equal: those l with l * radius / m below 1."""
    return math.ceil(m / radius) - 1


def choose_segments(n: int, radius: int) -> int:
    """The number of segments that makes the search among n different fingerprints cheapest, by rows looked up and by pairs of random ones that meet."""

    def cost(m: int) -> float:
        share = sum(2.0 ** -sum(segments(m)[(k + j) % m][1] for j in range(equal_segments(m, radius))) for k in range(m))
        return _ROW_COST * n * m + share * n * n / 2

    return min(range(radius + 1, 17), key=cost)


def _key_mask(m: int, start: int, radius: int) -> int:
    mask = 0
    for j in range(equal_segments(m, radius)):
        low, width = segments(m)[(start + j) % m]
        mask |= ((1 << width) - 1) << low
    return mask


def _keys(m: int, radius: int) -> Column:
    """An array of each start's key: the bits of its equal segments, at their places."""
    return F.array(*(F.col("fp").bitwiseAND(F.lit(signed(_key_mask(m, k, radius)))) for k in range(m)))


def viable(differ: Column, start: int, m: int, radius: int) -> Column:
    """Whether the chain from a segment keeps its budgets: the first l segments differ in at most l * radius / m bits, for every l."""
    cuts, ok, mask = segments(m), F.lit(True), 0
    for size in range(1, m + 1):
        low, width = cuts[(start + size - 1) % m]
        mask |= ((1 << width) - 1) << low
        if size > equal_segments(m, radius):  # the first ones are equal
            ok = ok & (F.bit_count(differ.bitwiseAND(F.lit(signed(mask)))) <= size * radius // m)
    return ok


def near_links(distinct: DataFrame, scratch: Scratch, radius: int = 2, m: int | None = None, paired: int = PAIRED) -> DataFrame:
    """Links (a, b) between rows (node, fp) of different fingerprints, whose components are those of all pairs within the radius, 1 or 2.

    Pairs that share a key of up to `paired` members are links themselves; members of a larger one are linked by stars.
    """
    if radius not in (1, 2):
        raise ValueError(f"radius is {radius}; values between two fingerprints are within one bit for 1 and 2 only")
    m = m or choose_segments(distinct.count(), radius)
    keyed = scratch.save(distinct.select("node", "fp", F.posexplode(_keys(m, radius)).alias("start", "key")), "keys")
    sizes = keyed.groupBy("start", "key").agg(F.count("*").alias("size")).where("size > 1")
    met = scratch.save(join_facts(keyed, sizes, ["start", "key"]), "met")
    scratch.drop(keyed)

    few = met.where(F.col("size") <= paired).select("start", "key", "node", "fp")
    both = few.alias("x").join(few.alias("y"), ["start", "key"]).where("x.node < y.node").select("start", F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.fp").bitwiseXOR(F.col("y.fp")).alias("differ"))
    chained = F.lit(False)
    for k in range(m):
        chained = chained | ((F.col("start") == k) & viable(F.col("differ"), k, m, radius))
    pairs = both.where(chained).where(F.bit_count("differ") <= radius).select("a", "b").distinct()

    # members of a large key name the values within one bit of theirs; those that name one are within two bits of each other
    many = met.where(F.col("size") > paired)
    flips = F.array(*(F.array(F.lit(0).cast("bigint"), *(F.lit(signed(1 << b)) for b in range(64) if not _key_mask(m, k, radius) >> b & 1)) for k in range(m)))
    named = many.select("node", "start", "fp", F.explode(F.get(flips, F.col("start"))).alias("flip"))
    named = named.select("node", "start", F.col("fp").bitwiseXOR(F.col("flip")).alias("value"), (F.col("flip") == 0).alias("own"))
    first = named.groupBy("start", "value").agg(F.min("node").alias("a"), F.count("*").alias("n"), F.bool_or("own").alias("own"))
    first = first.where(F.col("n") > 1).where(F.col("own") | F.lit(radius == 2)).select("start", "value", "a")  # at radius 1 the value must be a member's own
    stars = join_facts(named, first, ["start", "value"]).where("a < node").select("a", F.col("node").alias("b")).distinct()
    return pairs.unionByName(stars)


def near_duplicates(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2, paired: int = PAIRED) -> DataFrame:
    """Rows (id, row_key, fingerprint, component_id, kept), one per input row; fingerprint as 16 lower-case hex digits.

    Rows are linked if their fingerprints differ in at most `radius` bits; component_id is the smallest id reachable, and that row is kept. Texts without words
    (null, empty, white space) have the fingerprint zero and are linked like any other. Rows with null or repeated ids are rows of their own, null ones last.
    Other columns are ignored, whatever their names; an empty table gives no rows. A very long text is one row of one task, hashed whole.
    """
    own = row_keyed(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")), "id", scratch, nulls_last=True)
    kind = dict(own.dtypes)["id"]
    prints = map_rows(own.select("row_key", "id", "text"), lambda key, doc, text: [(key, doc, signed(fingerprint(text, width)))], f"row_key bigint, id {kind}, fp bigint")
    prints = scratch.save(prints, "prints")
    distinct = scratch.save(prints.groupBy("fp").agg(F.min("row_key").alias("node")), "distinct")
    parts = connected_components(near_links(distinct, scratch, radius, paired=paired), scratch).withColumnRenamed("id", "node")
    led = distinct.join(parts, "node", "left").select("fp", F.coalesce("component", "node").alias("component_key"))
    out = join_facts(prints, led, ["fp"])
    if dict(docs.dtypes)[id_col] in ("bigint", "int", "smallint", "tinyint") and prints.where(~F.col("row_key").eqNullSafe(F.col("id"))).isEmpty():
        out = out.withColumn("component_id", F.col("component_key").cast(kind))
    else:
        names = prints.select(F.col("row_key").alias("component_key"), F.col("id").alias("component_id"))
        out = join_facts(out, names, ["component_key"])
    return out.select(F.col("id").alias(id_col), "row_key", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", (F.col("row_key") == F.col("component_key")).alias("kept"))
