"""Which windows of a corpus occur more than once: the exact step behind the seed operators.

An anchor found by a seed operator stands for an interval of windows. For the interval two digests are
made: of its *core*, what all windows at these places relative to the anchor have in common, and of its *context*, the whole
stretch that they cover. A context that occurs again settles all its windows at once: they are repeats. A core that
occurs nowhere else settles them too: none is. Only intervals in between, at the ends of repeats, are
cut into smaller ones, down to single windows. Nothing is compared pair by pair: copies, however many,
meet as counts of a digest, which combine on the map side, so no group of copies is ever gathered.
Digests have 128 bits.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.llm.anchors import Plan, Sequence, place_of
from twinfold.llm.common import map_columns
from twinfold.plans.storage import Scratch

#: Digests of core and context as two numbers each.
_CORE, _CONTEXT = ["core1", "core2"], ["ctx1", "ctx2"]
_UNITS = "row_key bigint, place bigint, core1 bigint, core2 bigint, ctx1 bigint, ctx2 bigint"


def units_of(text: Sequence, key: int, places: np.ndarray, size: int) -> tuple | None:
    """Columns of _UNITS: the windows of each place in pieces of `size` places, counted from its anchor."""
    window, view, digest = text.plan.window, text.view, xxhash.xxh3_128_digest
    bounds = text.bounds
    out, digests = [], []
    for s, lo, hi in zip(*(x.tolist() for x in place_of(places)), strict=True):
        for q in range((s - hi) // size, (s - lo) // size + 1):
            a, b = max(lo, s - (q + 1) * size + 1), min(hi, s - q * size)
            x, y = bounds(s - q * size, s - (q + 1) * size + 1 + window)
            digests.append(digest(view[x:y], q))
            x, y = bounds(a, b + window)
            digests.append(digest(view[x:y], (s - a) << 32 | (b - a)))
            out.append(s << 32 | (s - a) << 16 | (b - a))
    if not out:
        return None
    numbers = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 4)
    return np.full(len(out), key), np.array(out, np.int64), *numbers.T


def _settled(units: DataFrame, scratch: Scratch, last: bool) -> tuple[DataFrame, DataFrame | None]:
    """(places of repeats, places to cut)."""
    both = [*_CORE, *_CONTEXT]
    ctx = units.groupBy(*both).agg(F.count("*").alias("n"), F.min("row_key").alias("one"))
    if last:
        again = scratch.save(ctx.where("n > 1").select(*both), "again")
        return scratch.save(units.join(again, both).select("row_key", "place"), "repeats"), None
    ctx = scratch.save(ctx, "contexts")
    core = ctx.groupBy(*_CORE).agg(F.sum("n").alias("m"), F.count_if(F.col("n") == 1).alias("single")).where("m > 1")
    core = scratch.save(core, "cores")
    told = scratch.save(units.join(ctx.join(core, _CORE), both).select("row_key", "place", (F.col("n") > 1).alias("again"), ((F.col("single") > 0) & ((F.col("n") == 1) | (F.col("row_key") == F.col("one")))).alias("cut")), "settled")
    scratch.drop(ctx, core)
    return told.where("again").select("row_key", "place"), told.where("cut").select("row_key", "place")


def repeated_windows(texts: DataFrame, seeds: DataFrame, plan: Plan, scratch: Scratch) -> DataFrame:
    """Rows (row_key, spans array of places): windows that occur more than once.

    texts: (row_key, text binary); seeds: (row_key, place), the anchors that may stand for such windows, and the windows they stand for.
    A text's seeds are gathered with it, never those of several texts.
    """

    def pieces(size: int) -> Callable:
        return lambda key, text, places: units_of(Sequence(text, plan), key, places, size)

    cut, done = seeds, []
    for size in plan.sizes:
        lists = cut.groupBy("row_key").agg(F.collect_list("place").alias("places"))
        units = scratch.save(map_columns(texts.join(lists, "row_key").select("row_key", "text", "places"), pieces(size), _UNITS), "units")
        again, cut = _settled(units, scratch, size == 1)
        scratch.drop(units)
        done.append(again)
    all_spans = done[0]
    for more in done[1:]:
        all_spans = all_spans.unionByName(more)
    return all_spans.groupBy("row_key").agg(F.collect_list("place").alias("spans"))


def merged(places: np.ndarray | None, window: int) -> list[tuple[int, int]]:
    """Maximal runs [a, b) of symbols covered by the windows."""
    if places is None or not len(places):
        return []
    _, lo, hi = place_of(places)
    order = np.argsort(lo, kind="stable")
    start, end = lo[order], np.maximum.accumulate(hi[order] + window)
    new = np.flatnonzero(start[1:] > end[:-1]) + 1
    return list(zip(start[np.concatenate([[0], new])].tolist(), end[np.concatenate([new, [len(end)]]) - 1].tolist(), strict=True))
