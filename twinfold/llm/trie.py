"""A trie of conversation prefixes, by preorder intervals.

Every turn is known by its digest, every prefix of a conversation by a sum over its turns that tells its identity: four running
sums of digest times a power of a base, each modulo a prime below 2^31. Conversations of equal turns are one sequence with a weight. The sequences
are ranked lexicographically: blocks of BLOCK turns get ranks, then pairs of neighbouring blocks' ranks do, until one rank is left
of each, so that a very long conversation is never one row. A node first appears in the smallest rank among its members, hence
(that rank, depth) is the preorder of the trie; its subtree ends with the last node of the largest rank. What is summed over a
subtree is a difference of two prefix sums in that order, made over range partitions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinfold.operators.order import ordered, position, running_sums, with_ordinals
from twinfold.plans.storage import Scratch, join_facts

#: Turns whose digests make one key for ranking.
BLOCK = 64
#: Primes below 2^31, and a base for each.
_PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
_BASES = (1103515245, 1664525000, 1597334677, 1977654935)
_SUMS = ["s0", "s1", "s2", "s3"]
_NODE = ["depth", "x", "y"]
#: Bytes of text hashed at once.
_PIECE = 1 << 16


def turn_rows(turns: DataFrame, scratch: Scratch, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (c, pos, digest, chars): each conversation's turns numbered from 0 by turn, null first.

    Turns of one number follow by digest; equal rows are turns one after another. A null role or text counts as empty; rows without a conversation are
    left out. Other columns are ignored.
    """
    said, who = F.coalesce(F.col(f"`{text}`"), F.lit("")), F.coalesce(F.col(f"`{role}`"), F.lit(""))
    rows = turns.where(F.col(f"`{conv}`").isNotNull()).select(
        F.col(f"`{conv}`").cast("bigint").alias("c"), F.col(f"`{turn}`").alias("turn"),
        F.unhex(F.sha2(F.concat(F.length(who).cast("string"), F.lit(":"), who, said).cast("binary"), 256)).alias("digest"), F.length(said).cast("bigint").alias("chars"),
    )
    return position(rows, "c", [F.col("turn").asc_nulls_first(), F.col("digest")], scratch).drop("turn")


def rebuilt(rows: DataFrame, scratch: Scratch, every: int = 100, shared: int = 6) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns): rows (c, length) and (c, depth, digest, chars) of rows (c, pos, digest, chars).

    With h = CRC-32 of the decimal c, modulo `shared`, a conversation becomes the first h turns of conversation c - c % every (all of them if there are
    fewer, none if it's absent) and its own turns after its first h. depth starts from 1; a conversation may be left without turns.
    """
    own = rows.groupBy("c").agg(F.count("*").alias("n"))
    told = own.withColumns({"h": F.crc32(F.col("c").cast("string").cast("binary")) % shared, "base": F.col("c") - F.col("c") % every})
    heads = own.where(F.col("c") % every == 0).select(F.col("c").alias("base"), F.col("n").alias("base_n"))
    told = join_facts(told, heads, ["base"], "left").withColumn("lead", F.least("h", F.coalesce("base_n", F.lit(0))))
    told = scratch.save(told.select("c", "base", "h", "lead", (F.col("lead") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "conversations")
    kept = join_facts(rows, told.select("c", "h", "lead"), ["c"]).where("pos >= h").select("c", (F.col("lead") + F.col("pos") - F.col("h") + 1).alias("depth"), "digest", "chars")
    firsts = rows.where((F.col("c") % every == 0) & (F.col("pos") < shared - 1)).select(F.col("c").alias("base"), "pos", "digest", "chars")
    led = firsts.join(told.select("c", "base", "lead").where("lead > 0"), "base").where("pos < lead").select("c", (F.col("pos") + 1).alias("depth"), "digest", "chars")
    return told.select("c", "length"), kept.unionByName(led)


def _power(base: int, prime: int, exponent: str) -> Column:
    """base ** exponent modulo a prime, for a column of exponents below 2^32: a table for each of its four bytes."""
    out = None
    for low in range(0, 32, 8):
        table = ", ".join(f"{pow(base, digit << low, prime)}L" for digit in range(256))
        factor = F.expr(f"get(array({table}), cast(shiftright({exponent}, {low}) & 255 AS int))")
        out = factor if out is None else out * factor % prime
    return out


def _prefixes(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """Add x and y, which with the depth tell a prefix, and those of the prefix before, up_x and up_y. The root's are zero."""
    part = lambda k: F.conv(F.hex(F.substring("digest", 4 * k + 1, 4)), 16, 10).cast("bigint")
    terms = {f"t{k}": (part(k) % p + 1) % p * _power(b, p, "depth") % p for k, (p, b) in enumerate(zip(_PRIMES, _BASES, strict=True))}
    told = turns.withColumns(terms).withColumns({s: F.col(f"t{k}") for k, s in enumerate(_SUMS)})
    sums = running_sums(told, ["depth"], _SUMS, scratch, group="c")
    after = [F.col(s) % p for s, p in zip(_SUMS, _PRIMES, strict=True)]
    before = [(F.col(s) - F.col(f"t{k}")) % p for k, (s, p) in enumerate(zip(_SUMS, _PRIMES, strict=True))]
    pack = lambda a, b: F.shiftleft(a, 31).bitwiseOR(b)
    return sums.select("c", "depth", "digest", "chars", pack(*after[:2]).alias("x"), pack(*after[2:]).alias("y"), pack(*before[:2]).alias("up_x"), pack(*before[2:]).alias("up_y"))


def _ranks(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (c, rank) of rows (c, depth, digest): lexicographic ranks of sequences, from 1. Equal sequences have one rank, a prefix comes before what extends it."""
    blocks = turns.groupBy("c", F.floor((F.col("depth") - 1) / BLOCK).alias("j")).agg(F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("depth", F.hex("digest").alias("d")))), lambda t: t["d"])).alias("key"))
    now, keys = scratch.save(blocks, "blocks"), ["key"]
    while True:
        known = with_ordinals(now.select(*keys).distinct(), keys, scratch, 1, "rank")
        now = scratch.save(join_facts(now, known, keys).select("c", "j", "rank"), "ranks")
        if now.where("j > 0").isEmpty():
            return now.select("c", "rank")
        side = lambda k: F.coalesce(F.max(F.when(F.col("j") % 2 == k, F.col("rank"))), F.lit(0))
        now, keys = now.groupBy("c", F.shiftright("j", 1).alias("j")).agg(side(0).alias("left"), side(1).alias("right")), ["left", "right"]


def _end_digests(members: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (depth, x, y, ends_sha256) of (depth, x, y, c): the digest of the numbers c in order. Each node's text is made in pieces where its rows lie, and the pieces of one node are hashed as they come, never held."""
    rows = ordered(members.select(*_NODE, "c"), [*map(F.col, _NODE), F.col("c")], scratch).sortWithinPartitions("_at")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, held, size, last = None, None, [], 0, None
        for batch in batches:
            for *node, c, place in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if node != now or size > _PIECE or place != last + 1:  # the next row may lie in another task
                    if held:
                        yield piece(now, at, ",".join(held))
                    now, at, held, size = node, place, [], 0
                held.append(str(c))
                size, last = size + len(held[-1]), place
        if held:
            yield piece(now, at, ",".join(held))

    def piece(node: list, at: int, text: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip((*_NODE, "at", "text"), (*node, at, text), strict=True))], schema=pa.schema([*((n, pa.int64()) for n in (*_NODE, "at")), ("text", pa.string())]))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, out = None, None, []
        for batch in batches:
            for *node, _, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if node != now:
                    if sha:
                        out.append((*now, sha.hexdigest()))
                    now, sha = node, hashlib.sha256(text.encode())
                else:
                    sha.update(b"," + text.encode())
            if len(out) > 10000:
                yield told(out)
                out = []
        if sha:
            out.append((*now, sha.hexdigest()))
        if out:
            yield told(out)

    def told(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=[*_NODE, "ends_sha256"])

    made = rows.select(*_NODE, "c", "_at").mapInArrow(pieces, "depth bigint, x bigint, y bigint, at bigint, text string")
    return made.repartition(*_NODE).sortWithinPartitions(*_NODE, "at").mapInArrow(digests, "depth bigint, x bigint, y bigint, ends_sha256 string")


def prefix_trie(conversations: DataFrame, turns: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), one for each distinct prefix of rows (c, depth, digest, chars).

    conversations: rows (c, length), those without turns too, which are members of the root only; none give no rows, not even the root. conv_id is a node's smallest member.
    saved_tokens and n_leaves are sums over the subtree: of (members - 1) times the characters of a node's last turn, and of nodes without children.
    """
    whole = scratch.save(_prefixes(turns, scratch), "prefixes")
    none = F.lit(0).cast("bigint")
    ends = join_facts(whole, conversations, ["c"]).where("depth = length").select("c", *_NODE)
    ends = scratch.save(ends.unionByName(conversations.where("length = 0").select("c", none.alias("depth"), none.alias("x"), none.alias("y"))), "ends")
    classes = scratch.save(ends.groupBy(*_NODE).agg(F.min("c").alias("c"), F.count("*").alias("weight")), "classes")

    # a sequence of turns is followed once, for its smallest conversation
    once = scratch.save(join_facts(whole, classes.select("c", "weight"), ["c"]), "once")
    ranks = classes.select("c", "weight").join(_ranks(once.select("c", "depth", "digest"), scratch), "c", "left").select("c", "weight", F.coalesce("rank", F.lit(0)).cast("bigint").alias("rank"))
    ranks = scratch.save(ranks, "sequences")
    steps = join_facts(once, ranks.select("c", "rank"), ["c"])
    roots = ranks.select("c", *(none.alias(n) for n in (*_NODE, "chars", "up_x", "up_y")), F.lit(b"").alias("digest"), "weight", "rank")
    steps = steps.unionByName(roots)
    nodes = steps.groupBy(*_NODE).agg(
        F.min("c").alias("conv_id"), F.sum("weight").alias("n_convs"), F.min("rank").alias("first"), F.max("rank").alias("last"), F.max("chars").alias("chars"), F.max("up_x").alias("up_x"), F.max("up_y").alias("up_y"),
        ((F.min("digest") == F.max("digest")) & (F.min("up_x") == F.max("up_x")) & (F.min("up_y") == F.max("up_y"))).alias("same"),
    )
    nodes = scratch.save(nodes, "nodes")
    if not nodes.where("not same").isEmpty():  # the sums of two different prefixes agree
        raise ValueError("two different prefixes have the same sums; choose other bases")

    up = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up_x").alias("x"), F.col("up_y").alias("y")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(up, _NODE, "left").withColumn("n_children", F.coalesce("n_children", none))
    nodes = nodes.withColumns({"place": F.lit(1).cast("bigint"), "leaves": (F.col("n_children") == 0).cast("bigint"), "saved": (F.col("n_convs") - 1) * F.col("chars")})
    told = nodes.withColumns({"leaf": F.col("leaves"), "saving": F.col("saved")})
    told = scratch.save(running_sums(told, ["first", "depth"], ["place", "leaves", "saved"], scratch), "preorder")

    # a subtree ends with the last node of its largest rank
    stops = told.groupBy(F.col("first").alias("last")).agg(F.max(F.struct("place", "leaves", "saved")).alias("m")).select("last", F.col("m.leaves").alias("leaves_end"), F.col("m.saved").alias("saved_end"))
    told = join_facts(told, stops, ["last"])
    parents = nodes.select(F.col("depth").alias("up_depth"), F.col("x").alias("up_x"), F.col("y").alias("up_y"), F.col("conv_id").alias("parent_conv_id"))
    told = join_facts(told.withColumn("up_depth", F.col("depth") - 1), parents, ["up_depth", "up_x", "up_y"], "left")
    told = told.join(_end_digests(ends, scratch), _NODE, "left")
    return told.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("leaves_end") - F.col("leaves") + F.col("leaf")).alias("n_leaves"),
        (F.col("saved_end") - F.col("saved") + F.col("saving")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
