"""Substring dedup by seed and extend, on words.

Every window of min_words words has a winnowed anchor, a gram of eight words. Documents join on equal
anchors; an anchor that no other place has cannot lie in a repeat. From the anchors that are left, matches
are extended both ways at once: the stretch around an anchor, as far as a window with this anchor can
reach, is compared as a whole, then in finer parts (repeats.py), so a passage with thousands of copies
costs its occurrences, not their pairs. Maximal runs of repeated windows come out.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.llm.anchors import Plan, Sequence, grams
from twinfold.llm.common import map_columns, map_rows
from twinfold.llm.repeats import merged, repeated_windows
from twinfold.plans.storage import Scratch, row_keyed

_GRAM = 8


def plan_for(min_words: int) -> Plan:
    span = min_words - _GRAM + 1
    span -= span % 4
    return Plan("words", min_words, _GRAM, span, (span, 4, 1))


def seeds(texts: DataFrame, plan: Plan, scratch: Scratch) -> DataFrame:
    """Rows (row_key, place): the anchors whose gram occurs at another anchor too, and their windows."""

    def work(key: int, text: bytes):
        seq = Sequence(text, plan)
        if seq.n < plan.window:
            return None
        places = seq.places()
        return np.full(len(places), key), grams(seq.symbols, plan.gram)[places >> 32].view(np.int64), places

    rows = scratch.save(map_columns(texts, work, "row_key bigint, h bigint, place bigint"), "anchors")
    again = scratch.save(rows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "again")
    out = scratch.save(rows.join(again.hint("shuffle_hash"), "h").select("row_key", "place"), "seeds")
    scratch.drop(rows)
    return out


def remove_repeats(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", min_words: int = 35, with_text: bool = False) -> DataFrame:
    """Rows (id, n_words, n_removed, kept_sha256[, spans, kept_text]), one per input row.

    Removes each word covered by a window of min_words words whose words also start anywhere else, first
    occurrences included; kept words are joined by one space. A null text has no words; shorter texts stay whole. Rows with null or
    repeated ids are texts of their own. Other columns are ignored; an empty table gives no rows. A very long text is one row of one task.
    """
    if min_words < 16:
        raise ValueError("min_words: 16 or more")
    plan = plan_for(min_words)
    own = row_keyed(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")), "id", scratch)
    kind = dict(own.dtypes)["id"]
    texts = own.select("row_key", "text")
    spans = repeated_windows(texts, seeds(texts, plan, scratch), plan, scratch)
    extra = ", spans array<array<bigint>>, kept_text string" if with_text else ""

    def work(doc, text: bytes, spans):
        words, runs = text.split(), merged(spans, min_words)
        at, kept = 0, []
        for a, b in runs:
            kept += words[at:a]
            at = b
        kept += words[at:]
        left = b" ".join(kept)
        more = ([list(r) for r in runs], left.decode("utf-8", "replace")) if with_text else ()
        yield (doc, len(words), len(words) - len(kept), hashlib.sha256(left).hexdigest(), *more)

    whole = own.select("row_key", "id", "text").join(spans, "row_key", "left").select("id", "text", "spans")
    return map_rows(whole, work, f"{id_col} {kind}, n_words bigint, n_removed bigint, kept_sha256 string{extra}", flush=1000 if with_text else 20000)
