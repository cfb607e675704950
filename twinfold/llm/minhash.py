"""Near-duplicate documents by HyperMinHash.

A document is the set of its word shingles. Each shingle hash falls into one of 256 buckets; a bucket
keeps its smallest hash in compressed form, as the number of leading zeros and ten mantissa bits.
Bands of four registers, of the sketch folded to 128 buckets, make candidates: at a similarity of
0.8 a pair misses all 32 bands with probability 5e-8. Candidates must reach an estimated Jaccard
similarity, corrected for chance collisions of compressed registers, 4.5 standard errors below the
threshold, where the error is that of the registers the pair fills. What is left is verified on the full sets.

Groups grow without all their pairs: equal sets are one node from the start; each band's members are first tried
against one other, among those that lead a band the one sharing most bands; only members of one band that are still
in different components, and whose sizes are near enough, are then compared, by registers, in blocks.

Where very many documents share a boilerplate, so many of them meet in a band by that alone. Bands of more than LARGE such members make
no pairs; their members meet by their rarest shingles instead: counted among them all (counts.py), and each set in the order from rare to common, two sets of
the similarity have one of their first n - ceil(percent * n / 100) + 1 shingles in common. What all share comes last there and brings none together. Any one order gives
the same links, so counters that shingles share do; only the first shingles of a set become rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.llm import counts
from twinfold.llm.common import map_columns, map_rows, signed
from twinfold.operators.components import connected_components
from twinfold.plans.storage import Scratch, join_facts, row_keyed

BUCKETS, MANTISSA, BAND = 256, 10, 4
#: The smallest percent at which a pair misses all bands with probability 5e-8; at 70 it would be 1.5e-4, at 50 13 %.
LEAST_PERCENT = 80
_EMPTY = 0xFFFF
_BANDS = BUCKETS // 2 // BAND
#: Members of a block; two blocks meet in a task.
_BLOCK = 512
#: Members of a band, of one size class and of different components, that are still compared with each other.
LARGE = 1024
#: Rarest shingles of a document by which it is told whether two have met before.
_FIRSTS = 64
_MUL = 0x9E3779B97F4A7C15


def shingles(text: bytes, width: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles; the whole sequence is one if it is shorter."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    size = min(width, n)
    out = h[: n - size + 1] * np.uint64(2 * size + 1)
    for k in range(1, size):
        out = (out ^ (out >> np.uint64(31))) * np.uint64(_MUL) + h[k : n - size + 1 + k]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(out ^ (out >> np.uint64(29)))


def registers(hashes: np.ndarray) -> np.ndarray:
    """The compressed sketch: leading zeros of the bucket's smallest hash and the bits after them."""
    bucket, rest = (hashes & np.uint64(BUCKETS - 1)).astype(np.int64), hashes >> np.uint64(8)
    low = np.full(BUCKETS, 1 << 56, np.uint64)
    np.minimum.at(low, bucket, rest)
    full = low < np.uint64(1 << 56)
    top = np.frexp(np.maximum(low, np.uint64(1)).astype(np.float64))[1] - 1  # place of the highest bit, or one more by rounding
    top = np.where((np.uint64(1) << top.astype(np.uint64)) > np.maximum(low, np.uint64(1)), top - 1, top)
    zeros = (55 - top).astype(np.uint64)
    after = (low << (zeros + np.uint64(1))) & np.uint64((1 << 56) - 1)
    out = (zeros << np.uint64(MANTISSA)) | (after >> np.uint64(56 - MANTISSA))
    return np.where(full, out, np.uint64(_EMPTY)).astype(np.uint16)


def _folded(regs: np.ndarray) -> np.ndarray:
    """Registers of half as many buckets; the smaller hash has more zeros, then smaller bits after."""
    a, b = regs[..., : BUCKETS // 2].astype(np.int32), regs[..., BUCKETS // 2 :].astype(np.int32)
    rank = lambda r: np.where(r == _EMPTY, 1 << 20, (63 - (r >> MANTISSA) << MANTISSA) + (r & (1 << MANTISSA) - 1))
    return np.where(rank(a) <= rank(b), a, b).astype(np.uint16)


def band_keys(regs: np.ndarray) -> list[tuple[int, int]]:
    """(band, key) of each band that isn't empty."""
    bands = _folded(regs).reshape(_BANDS, BAND)
    return [(k, signed(xxhash.xxh3_64_intdigest(bands[k].tobytes(), k))) for k in range(_BANDS) if (bands[k] != _EMPTY).any()]


def likely(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the Jaccard similarity estimated from registers (..., BUCKETS), less the matches expected by chance, allows the threshold."""
    filled_a, filled_b = a != _EMPTY, b != _EMPTY
    either = np.maximum(1, (filled_a | filled_b).sum(axis=-1))
    ratio = np.minimum(n, m) / np.maximum(1, np.maximum(n, m))
    chance = 0.1699 * 2.0 ** (BUCKETS.bit_length() - MANTISSA) * 4 * ratio / (1 + ratio) ** 2
    found = (((a == b) & filled_a).sum(axis=-1) - chance).clip(0) / either
    union = np.maximum(either, (n + m) / (1 + threshold))  # at the threshold; each filled register draws another of its members
    error = np.sqrt(threshold * (1 - threshold) / either * np.maximum(1 - either / union, 0.02))
    return (found >= threshold - 4.5 * error - 0.5 / either) & (ratio >= threshold)


def jaccard(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """(size of the intersection, size of the union)."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both, len(a) + len(b) - both


def near_duplicates(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Rows (id, row_key, n_shingles, component_id, kept, class_key), one per input row.

    Two documents are linked if 100 * |intersection| >= percent * |union| of their shingle sets. component_id is the
    smallest id reachable, and that document is kept. Texts without words (null, empty, white space) are linked with nothing.
    Rows with null or repeated ids are documents of their own, equal rows copies of each other. Other columns are ignored, whatever their names; an empty table
    gives no rows. A very long text is one row of one task, whose set of shingle hashes it holds. class_key: the first row with the same set.
    The bands are made for similarities from LEAST_PERCENT; a lower percent would lose pairs unseen and raises ValueError.
    """
    if percent < LEAST_PERCENT:
        raise ValueError(f"percent is {percent}; the bands find pairs from {LEAST_PERCENT} percent only")
    own = row_keyed(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")), "id", scratch, nulls_last=True)
    kind = dict(own.dtypes)["id"]

    def sketch(key, doc, text: bytes):
        s = shingles(text, width)
        yield (key, doc, len(s), xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None, registers(s).tobytes() if len(s) else None)

    sketches = scratch.save(map_rows(own.select("row_key", "id", "text"), sketch, f"row_key bigint, id {kind}, n bigint, same binary, regs binary", flush=4000), "sketches")
    same = scratch.save(sketches.where("n > 0").groupBy("same").agg(F.min("row_key").alias("class_key")), "same")
    classes = scratch.save(sketches.where("n > 0").select("row_key", "same").join(same, "same").select("row_key", "class_key"), "classes")
    nodes = scratch.save(sketches.join(classes.where("row_key = class_key").select("row_key"), "row_key", "left_semi").select(F.col("row_key").alias("node"), "n", "regs"), "nodes")

    # a smaller set is similar enough to none but itself
    able = nodes.where(f"100 * n >= {percent} * (n + 1)").select("node", "n", "regs")
    bands = map_rows(able, lambda node, n, regs: ((node, n, b, k) for b, k in band_keys(np.frombuffer(regs, np.uint16))), "node bigint, n bigint, band int, key bigint")
    bands = scratch.save(bands, "bands")
    several = bands.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    buckets = scratch.save(join_facts(bands, several, ["key"]).select("key", "band", "node", "n", "size"), "buckets")
    scratch.drop(bands)

    # the member with most company leads its band
    company = buckets.groupBy("node").agg(F.sum("size").alias("company"))
    leads = buckets.join(company, "node").groupBy("key").agg(F.max(F.struct("company", -F.col("node"))).alias("m")).select("key", (-F.col("m.col2")).alias("lead"))
    led = join_facts(buckets, leads, ["key"]).where("node <> lead").groupBy("node", "lead").agg(F.count("*").alias("shared"))
    nearest = led.groupBy("node").agg(F.max(F.struct("shared", -F.col("lead"))).alias("m")).select("node", (-F.col("m.col2")).alias("lead"))
    stars = nearest.select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct()
    links = _linked(_likely(stars, nodes, percent / 100), own, scratch, width, percent)
    parts = connected_components(links, scratch)

    # members of one band, of similar size, in different components, block by block: a size class meets itself and the one below
    placed = buckets.join(parts.withColumnRenamed("id", "node"), "node", "left").withColumn("part", F.coalesce("component", "node"))
    placed = placed.withColumn("own_class", F.floor(F.log("n") / math.log(1.0001 * 100 / percent)).cast("int")).withColumn("class", F.explode(F.array("own_class", F.col("own_class") + 1)))
    placed = placed.select("key", "class", "band", "node", "part", (F.col("class") == F.col("own_class")).alias("mine"))
    mixed = placed.groupBy("key", "class").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.count("*").alias("members"), F.bool_or("mine").alias("any")).where("p <> q and any")
    left = scratch.save(join_facts(placed, mixed, ["key", "class"]).select("key", "class", "band", "node", "part", "mine", "members"), "mixed")
    large = scratch.save(left.where(F.col("members") > LARGE).select("node", "part").distinct(), "large")
    left = left.withColumn("firsts", F.lit(None).cast("array<bigint>"))
    small = left if large.isEmpty() else left.where(F.col("members") <= LARGE).unionByName(_rarest(large, own, scratch, width, percent))
    across = _across(small, nodes, percent / 100)
    more = _linked(across, own, scratch, width, percent)
    found = connected_components(links.unionByName(more), scratch)

    out = sketches.select("row_key", "id", "n").join(classes, "row_key", "left").join(found.withColumnRenamed("id", "class_key"), "class_key", "left")
    out = out.withColumn("component_key", F.coalesce("component", "class_key", "row_key"))
    unique = dict(docs.dtypes)[id_col] in ("bigint", "int", "smallint", "tinyint") and sketches.where(~F.col("row_key").eqNullSafe(F.col("id"))).isEmpty()
    if unique:
        out = out.withColumn("component_id", F.col("component_key").cast(kind))
    else:
        out = out.join(sketches.select(F.col("row_key").alias("component_key"), F.col("id").alias("component_id")), "component_key", "left")
    return out.select(F.col("id").alias(id_col), "row_key", F.col("n").alias("n_shingles"), "component_id", (F.col("component_key") == F.col("row_key")).alias("kept"), "class_key")


def _likely(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose estimate allows the threshold."""
    ends = [nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("regs").alias(f"regs_{x}")) for x in "ab"]
    wide = pairs.join(ends[0], "a").join(ends[1], "b").select("a", "b", "n_a", "n_b", "regs_a", "regs_b")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, m = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, BUCKETS) for k in (4, 5))
            good = likely(a, b, n, m, threshold)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return wide.mapInArrow(keep, "a bigint, b bigint")


def _rarest(large: DataFrame, own: DataFrame, scratch: Scratch, width: int, percent: int) -> DataFrame:
    """Rows as those of a band, with a shingle in place of the band's key, for (node, part): the rarest shingles of each document, as many as similar documents need to meet in one. firsts: the node's first ones, from rare to common."""

    texts = own.select(F.col("row_key").alias("node"), "text").join(large, "node").select("node", "part", "text")
    rows = scratch.save(map_rows(texts, lambda node, part, text: [(node, part, shingles(text, width).tobytes())], "node bigint, part bigint, hashes binary", flush=1000), "sets")
    slots = counts.slots_for(rows.agg(F.coalesce(F.sum(F.length("hashes")), F.lit(0))).first()[0] // 8)
    common = own.sparkSession.sparkContext.broadcast(counts.ranks(rows.select("hashes"), slots))

    def prefix(node: int, part: int, hashes: bytes) -> tuple:
        h = np.frombuffer(hashes, np.uint64)
        m = len(h) - -(-len(h) * percent // 100) + 1
        first = h[np.lexsort((h, common.value[counts.slot(h, slots)]))[:m]].view(np.int64)
        return np.full(m, node, np.int64), np.full(m, part, np.int64), np.arange(m), first

    told = scratch.save(map_columns(rows, prefix, "node bigint, part bigint, first bigint, key bigint"), "rarest")
    scratch.drop(rows)
    mixed = told.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.count("*").alias("members")).where("p <> q").select("key", "members")
    met = scratch.save(join_facts(told, mixed, ["key"]), "rarest")
    firsts = met.groupBy("node").agg(F.slice(F.transform(F.sort_array(F.collect_list(F.struct("first", "key"))), lambda x: x["key"]), 1, _FIRSTS).alias("firsts"))
    fixed = [F.lit(0).alias("class"), F.lit(-1).alias("band")]
    return met.join(firsts, "node").select("key", *fixed, "node", "part", F.lit(True).alias("mine"), "members", "firsts")


def _across(left: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Likely pairs of one band and of different parts; a band's members are dealt in blocks, and each pair is taken in the first band, or the rarest of the first shingles, that it shares."""
    block = F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / _BLOCK)).cast("int")
    rows = left.withColumn("blocks", F.ceil(F.col("members") / _BLOCK).cast("int")).withColumn("own", block)
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = rows.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).join(nodes, "node")
    place = ("key", "class", "i", "j")
    rows = rows.select(*place, "band", "node", "part", "own", F.col("mine").cast("int").alias("mine"), "n", "regs", "firsts").repartition(*place).sortWithinPartitions(*place)

    def padded(lists: pa.Array) -> np.ndarray:
        out = np.zeros((len(lists), _FIRSTS), np.int64)
        for k, keys in enumerate(lists.to_pylist()):
            if keys:
                out[k, : len(keys)] = keys
        return out

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups lie one after another; the last one of a batch waits for the next batch."""
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(10)] + [np.frombuffer(b"".join(batch.column(10).to_pylist()), np.uint16).reshape(-1, BUCKETS), padded(batch.column(11))]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            ends = np.flatnonzero(np.any([x[1:] != x[:-1] for x in held[:4]], axis=0)) + 1
            if len(ends):
                yield from _pairs([x[: ends[-1]] for x in held], ends, threshold)
                held = [x[ends[-1] :] for x in held]
        if held is not None:
            yield from _pairs(held, np.array([len(held[0])]), threshold)

    return rows.mapInArrow(meet, "a bigint, b bigint").distinct()


def _pairs(rows: list[np.ndarray], ends: np.ndarray, threshold: float) -> Iterator[pa.RecordBatch]:
    key, _, i, j, band, node, part, own, mine, n, regs, firsts = rows
    folded = _folded(regs).reshape(-1, _BANDS, BAND)
    full = (folded != _EMPTY).any(axis=2)
    out: list[tuple[int, int]] = []
    start = 0
    for end in ends.tolist():
        k, b = int(band[start]), slice(start, end)
        xs = start + np.flatnonzero(own[b] == i[start])
        ys = start + np.flatnonzero(own[b] == j[start])
        for x in xs.tolist():
            others = ys[(part[ys] != part[x]) & ((mine[ys] | mine[x]) == 1) & ((i[start] != j[start]) | (node[ys] > node[x])) & (np.minimum(n[ys], n[x]) >= threshold * np.maximum(n[ys], n[x]))]
            if k > 0 and len(others):
                others = others[~((folded[others, :k] == folded[x, :k]).all(axis=2) & full[x, :k]).any(axis=1)]
            if len(others):
                others = others[likely(regs[x], regs[others], n[x], n[others], threshold)]
            if k < 0 and len(others):
                before = firsts[x][: np.flatnonzero(np.append(firsts[x], key[x]) == key[x])[0]]  # of those, any that another has comes before the key in its order too
                others = others[~np.isin(firsts[others], before[before != 0]).any(axis=1)]
            if len(others):
                out += [(min(y, int(node[x])), max(y, int(node[x]))) for y in node[others].tolist()]
        start = end
    if out:
        a, b = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _linked(pairs: DataFrame, own: DataFrame, scratch: Scratch, width: int, percent: int) -> DataFrame:
    """Pairs whose full sets are similar enough. Only texts that a pair names are moved, once."""
    pairs = scratch.save(pairs, "candidates")
    named = pairs.select(F.col("a").alias("row_key")).unionByName(pairs.select(F.col("b").alias("row_key"))).distinct()
    texts = scratch.save(own.select("row_key", "text").join(named.hint("merge"), "row_key", "left_semi"), "texts")
    both = pairs.join(texts.select(F.col("row_key").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("row_key").alias("b"), F.col("text").alias("text_b")), "b")
    last: list = [None, None]

    def verify(a: int, b: int, text_a: bytes, text_b: bytes):
        if last[0] != a:
            last[:] = a, shingles(text_a, width)
        inter, union = jaccard(last[1], shingles(text_b, width))
        if 100 * inter >= percent * union:
            yield (a, b)

    return scratch.save(map_rows(both.select("a", "b", "text_a", "text_b"), verify, "a bigint, b bigint"), "links")
