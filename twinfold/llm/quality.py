"""Quality rules with risk-controlled cutoffs.

Fixed base rules reject first. Beyond them each feature has a ladder of cutoffs, from one that rejects
next to nothing to one that rejects much. On labelled documents that pass the base rules, a cutoff is
certified for a stratum if the exact binomial test of "good documents are rejected more often than
alpha" fails at the level left after correction: alpha is shared among the features, the error
probability by Bonferroni among strata and features, and each ladder is walked from its safe end until
the first failure (fixed-sequence testing), so no further correction is due along it. The strictest
certified cutoff that rejects any bad document is used. A stratum with too few labels gets none and
loses only what the base rules reject.

Counts cover all labelled documents; what meets in one task is a row for each stratum.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinfold.llm.common import map_rows
from twinfold.plans.storage import Scratch, row_keyed

_SYMBOLS = b"#*$%&|<>"
_LETTERS = np.zeros(256, np.uint8)
_LETTERS[65:91] = 1  # capitals
_COUNTS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint, n_capitals bigint, n_distinct_words bigint"

#: Feature: (expression over the counts, larger is worse; ladder of cutoffs, safest first).
LADDERS: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols_per_word": ("try_divide(n_symbols, n_words)", (1.5, 1.2, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1)),
    "dup_line_share": ("try_divide(n_dup_lines, n_lines)", (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3)),
    "repeat_share": ("try_divide(n_repeat_words, n_words)", (0.5, 0.48, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2)),
    "capital_share": ("try_divide(n_capitals, word_chars)", (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3)),
}


def counts(text: bytes) -> tuple[int, ...]:
    """The counts of one text, in the order of the schema."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    raw = np.frombuffer(text, np.uint8)
    chars = int(((raw & 0xC0) != 0x80).sum())
    white = len(text) - len(text.translate(None, b" \t\n\x0b\x0c\r"))
    n, repeated, distinct = len(words), 0, 0
    if n:
        names: dict[bytes, int] = {}
        ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, n)
        distinct = len(names)
        if n > 2:
            pairs = np.unique(ids[:-1] * distinct + ids[1:], return_inverse=True)[1]
            _, inverse, times = np.unique(pairs[:-1] * distinct + ids[2:], return_inverse=True, return_counts=True)
            again = times[inverse] > 1
            cover = np.zeros(n, bool)
            for shift in range(3):
                cover[shift : n - 2 + shift] |= again
            repeated = int(cover.sum())
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    return n, chars - white, symbols, len(lines) - len(set(lines)), repeated, len(lines), int(_LETTERS[raw].sum()), distinct


def features(keyed: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang") -> DataFrame:
    """Rows (row_key, id, stratum, counts), one per input row. A null text has no words; a null stratum is ''."""
    kind = dict(keyed.dtypes)[id_col]
    stratum = F.coalesce(F.col(stratum_col).cast("string"), F.lit("")) if stratum_col else F.lit("all")
    base = keyed.select(F.col(key).alias("k"), F.col(id_col).alias("id"), stratum.alias("s"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return map_rows(base, lambda k, i, s, text: [(k, i, s, *counts(text))], f"row_key bigint, id {kind}, stratum string, {_COUNTS}")


def base_failed() -> Column:
    return F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")


def tail_p(n: int, k: int, p: float) -> float:
    """P(X <= k) of the binomial distribution: the exact p-value of "the rate exceeds p" after k of n."""
    if n <= 0 or k >= n:
        return 1.0
    terms = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(terms)
    return min(1.0, math.exp(top) * math.fsum(math.exp(t - top) for t in terms))


def certified(n_good: int, rejected: list[int], caught: list[int], alpha: float, delta: float) -> int | None:
    """The place on the ladder of the strictest certified cutoff that catches a bad document."""
    best = None
    for place, (k, bad) in enumerate(zip(rejected, caught, strict=True)):
        if k > alpha * n_good or tail_p(n_good, k, alpha) > delta:
            break
        if bad and (best is None or bad > caught[best]):
            best = place
    return best


def cutoffs(found: DataFrame, labels: DataFrame, scratch: Scratch, alpha: float = 0.04, delta: float = 0.05, label_id: str = "doc_id", quality: str = "quality") -> DataFrame:
    """Rows (stratum, n_good, cut_<feature>...), null where no cutoff is certified. Labels with a null id or quality count for nothing; of several for one id the worst holds."""
    told = labels.where(F.col(quality).isNotNull() & F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("id")).agg(F.min(quality).alias("quality"))
    held = found.where(~base_failed()).join(told, "id")
    good, bad = F.col("quality") >= 1, F.col("quality") < 1
    sums = [F.sum(good.cast("bigint")).alias("n_good")]
    for name, (value, ladder) in LADDERS.items():
        over = [F.expr(value) > c for c in ladder]
        sums += [F.array(*(F.sum((o & who).cast("bigint")) for o in over)).alias(f"{what}_{name}") for what, who in (("rejected", good), ("caught", bad))]
    per = scratch.save(held.groupBy("stratum").agg(*sums), "strata")
    n_strata = max(1, per.count())
    schema = "stratum string, n_good bigint, " + ", ".join(f"cut_{n} double" for n in LADDERS)

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for row in frame.to_dict("records"):
                level = delta / (len(LADDERS) * n_strata)
                places = {n: certified(int(row["n_good"]), [int(x) for x in row[f"rejected_{n}"]], [int(x) for x in row[f"caught_{n}"]], alpha / len(LADDERS), level) for n in LADDERS}
                rows.append({"stratum": row["stratum"], "n_good": row["n_good"]} | {f"cut_{n}": math.nan if p is None else LADDERS[n][1][p] for n, p in places.items()})
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])

    return per.mapInPandas(choose, schema)


def verdicts(docs: DataFrame, labels: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang", alpha: float = 0.04, delta: float = 0.05, key_col: str | None = None) -> DataFrame:
    """One row per input row: row_key, the id, stratum, the counts, base_failed and kept.

    A null text has no words and fails the base rules; null strata are one stratum; a null id has no label.
    An empty table of labels leaves the base rules alone; no documents give no rows, an empty text fails the base rules. Rows with a repeated id are documents of their own with the
    label of that id. A very long text is one row of one task. Other columns are ignored, whatever their names. key_col: a bigint column without nulls or repeats that is to be row_key.
    """
    key = key_col or "quality_key"
    keyed = docs if key_col else row_keyed(docs, id_col, scratch, key)
    found = scratch.save(features(keyed, key, id_col, text_col, stratum_col), "features")
    cuts = scratch.save(cutoffs(found, labels, scratch, alpha, delta), "cutoffs")
    small = cuts.count() <= 10_000
    joined = found.join(F.broadcast(cuts) if small else cuts, "stratum", "left")
    rejected = F.lit(False)
    for name, (value, _) in LADDERS.items():
        cut = F.col(f"cut_{name}")
        rejected = rejected | F.coalesce(cut.isNotNull() & ~F.isnan(cut) & (F.expr(value) > cut), F.lit(False))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rejected)
