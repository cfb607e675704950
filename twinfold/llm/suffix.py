"""Suffix-array dedup by distributed prefix doubling over content-defined positions.

The full suffix array of a corpus has an entry per byte. Here it is sampled: only anchors (see
anchors.py) are positions, about one in `span` / 2 bytes, and the string from one anchor to the next
is the unit of length. A position's first rank is that of two such strings; each round sorts the pairs
(rank here, rank 2^j strings on) and the place of a pair in that order is the rank for twice the
length. A position whose pair occurs once is dropped; one whose next doubling would reach beyond what
every window with this anchor must contain is past the threshold and is a seed. Since every window
holds its anchor and the strings after it, a repeated window has its anchor among the seeds. The exact
step of repeats.py then finds the repeats to the byte.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinfold.llm.anchors import Plan, Sequence
from twinfold.llm.common import map_columns, map_rows
from twinfold.llm.repeats import merged, repeated_windows
from twinfold.plans.storage import Scratch, row_keyed

#: Strings that the first ranks cover, and doublings after them at most.
_BASE, _LEVELS = 2, 3

_WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def plan_for(window: int, unit: str = "bytes") -> Plan:
    """Anchors so dense that every window holds at least two strings after its anchor, of bytes four as often as not."""
    gram, cell = (16, 8) if unit == "bytes" else (8, 4)
    share = window // 4 if unit == "bytes" else (window - gram + 1) // 3
    span = max(cell, share // cell * cell)
    return Plan(unit, window, gram, span, (span, cell, 1) if span > cell else (span, 1))


def first_ranks(key: int, text: bytes, plan: Plan):
    """Columns (row_key, at, h, place). h: the anchors' strings. at: an anchor's number, how often its string's length may double, and whether a whole window has it; others only serve as second halves. place: its windows."""
    if len(text) < plan.window:
        return None
    seq = Sequence(text, plan)
    if seq.n < plan.window:
        return None
    s = seq.anchors()[0]
    places = seq.places()
    whole = len(places)
    reach = plan.window - 2 * plan.span - plan.gram + 2
    top = np.zeros(len(s), np.int8)
    for level in range(1, _LEVELS + 1):
        step = _BASE << level
        if len(s) > step:
            top[:-step] += ((s[step:] - s[:-step] <= reach) & (top[:-step] == level - 1)).astype(np.int8)
    h = seq.hashes(s[:-_BASE], s[_BASE:] + plan.gram)
    n = len(h)
    i = np.arange(n, dtype=np.int64)
    return np.full(n, key), i << 8 | top[:n].astype(np.int64) << 1 | (i < whole), h.view(np.int64), np.concatenate([places[:n], np.zeros(max(0, n - whole), np.int64)])


def _reranked(pairs: DataFrame, names: list[str], scratch: Scratch) -> DataFrame:
    """The pairs that occur more than once, ranked by their order."""
    again = pairs.groupBy(*names).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return scratch.save(again.repartitionByRange(*names).sortWithinPartitions(*names).withColumn("new", F.monotonically_increasing_id()), "ranks")


def seeds(texts: DataFrame, plan: Plan, scratch: Scratch) -> DataFrame:
    """Rows (row_key, place): the anchors of windows that may occur more than once, and these windows."""
    number, top, whole = F.shiftright("at", 8), F.shiftright("at", 1).bitwiseAND(F.lit(127)), F.col("at").bitwiseAND(F.lit(1)) == 1
    rows = map_columns(texts, lambda k, t: first_ranks(k, t, plan), "row_key bigint, at bigint, h bigint, place bigint")
    rows = scratch.save(rows, "strings")
    ranks = _reranked(rows, ["h"], scratch)
    at = scratch.save(rows.join(ranks.hint("shuffle_hash"), "h").select("row_key", "at", F.col("new").alias("rank"), "place"), "ranked")
    scratch.drop(rows, ranks)
    out = []
    for level in range(_LEVELS):
        out.append(at.where((top == level) & whole).select("row_key", "place"))
        if at.where(top > level).isEmpty():
            break
        step = _BASE << level
        ahead = Window.partitionBy("row_key").orderBy("i").rangeBetween(step, step)
        pairs = at.withColumn("i", number).withColumn("next", F.max("rank").over(ahead)).where((top > level) & F.col("next").isNotNull()).drop("i")
        pairs = scratch.save(pairs, "pairs")
        ranks = _reranked(pairs, ["rank", "next"], scratch)
        at = scratch.save(pairs.join(ranks, ["rank", "next"]).select("row_key", "at", F.col("new").alias("rank"), "place"), "ranked")
        scratch.drop(pairs, ranks)
    else:
        out.append(at.where(whole).select("row_key", "place"))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def byte_runs(text: bytes, runs: list[tuple[int, int]], unit: str) -> list[tuple[int, int]]:
    """Runs of symbols as runs of bytes; a run of words goes up to the next word, so that no two spaces meet."""
    if unit == "bytes" or not runs:
        return runs
    at = [m.start() for m in _WORD.finditer(text)]
    return [(at[a], at[b] if b < len(at) else len(text)) for a, b in runs]


def remove_repeats(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = 400, min_words: int | None = None, with_text: bool = False) -> DataFrame:
    """Rows (id, row_key, n_bytes, n_removed, n_spans, kept_sha256[, spans, kept_text]), one per input row.

    Removes each byte covered by a string of min_bytes that starts anywhere else too, first occurrences included. With
    min_words the strings are of so many words instead, whatever white space is between them, and a run goes with the white space behind it.
    A null text counts as empty; shorter texts stay whole, and a very long one is read in blocks. Rows with null or repeated ids are texts
    of their own, so equal rows remove each other's strings. Other columns are ignored, whatever their names; an empty table gives no rows.
    kept_text leaves out characters of which a byte went.
    """
    if min_bytes < 80 or min_words is not None and min_words < 20:
        raise ValueError("min_bytes: 80 or more; min_words: 20 or more")
    plan = plan_for(min_words, "words") if min_words else plan_for(min_bytes)
    own = row_keyed(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")), "id", scratch)
    kind = dict(own.dtypes)["id"]
    texts = own.select("row_key", "text")
    spans = repeated_windows(texts, seeds(texts, plan, scratch), plan, scratch)
    extra = ", spans array<array<bigint>>, kept_text string" if with_text else ""

    def work(key, doc, text: bytes, spans):
        runs = byte_runs(text, merged(spans, plan.window), plan.unit)
        at, kept = 0, []
        for a, b in runs:
            kept.append(text[at:a])
            at = b
        left = b"".join([*kept, text[at:]])
        more = ([list(r) for r in runs], b"".join(x.decode("utf-8", "ignore").encode() for x in [*kept, text[at:]]).decode()) if with_text else ()
        yield (doc, key, len(text), len(text) - len(left), len(runs), hashlib.sha256(left).hexdigest(), *more)

    whole = own.select("row_key", "id", "text").join(spans, "row_key", "left").select("row_key", "id", "text", "spans")
    return map_rows(whole, work, f"{id_col} {kind}, row_key bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string{extra}", flush=1000 if with_text else 20000)
