"""A training corpus from raw documents: quality rules, exact dedup, near-dedup, repeated strings, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All stages but the
last return the columns of documents, whatever others come in. Rows with null or repeated ids are documents
of their own in every stage; a null text counts as empty. A very long text is one row of one task in each stage, whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.llm import exact, minhash, packing, quality, suffix
from twinfold.llm.common import table
from twinfold.llm.queries import TOKENIZER
from twinfold.plans.storage import Scratch, released, row_keyed

_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
_KEY = "stage_key"

#: Words of a repeated string in the fourth stage. A word and its space have about six bytes, so a passage of 50 words is well below 400 bytes.
REPEAT_WORDS = 50


def _keyed(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The columns of documents and a key that no two rows share, in the order of the ids, null ones last."""
    return row_keyed(docs.select(*_COLUMNS), "doc_id", scratch, _KEY, nulls_last=True)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or a certified cutoff reject go."""
    scratch = Scratch(spark)
    keyed = _keyed(docs, scratch)
    kept = quality.verdicts(keyed, table(spark, sf_dir, "labels"), scratch, key_col=_KEY).where("kept").select(F.col("row_key").alias(_KEY))
    return keyed.join(kept, _KEY, "left_semi").select(*_COLUMNS)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the smallest id stays; a null one only if there is no other."""
    return exact.exact_dedup(docs.select(*_COLUMNS), Scratch(spark)).select(*_COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the smallest id stays: five-word shingles, similarity 0.8."""
    scratch = Scratch(spark)
    keyed = _keyed(docs, scratch)
    kept = minhash.near_duplicates(keyed, scratch, id_col=_KEY, width=5, percent=80).where("kept").select(_KEY)
    return keyed.join(kept, _KEY, "left_semi").select(*_COLUMNS)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each word covered by a string of REPEAT_WORDS words that also starts elsewhere goes; a text of which no word is left goes with it."""
    scratch = Scratch(spark)
    keyed = _keyed(docs, scratch)
    left = suffix.remove_repeats(keyed, scratch, id_col=_KEY, min_words=REPEAT_WORDS, with_text=True).select(_KEY, "kept_text", "n_removed")
    joined = keyed.drop("text", "n_chars").join(left, _KEY)
    gone = (F.col("n_removed") > 0) & ~F.col("kept_text").rlike(r"[^\x20\x09-\x0D]")
    return joined.where(~gone).select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("bigint").alias("n_chars"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    return packing.pack(packing.token_pieces(docs, TOKENIZER, eos=2, max_len=1024), docs.count())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("minhash near-dedup", near_dedup),
    ("suffix-array dedup", repeated_strings),
    ("best-fit packing", best_fit_packing),
]

#: The certified cutoffs and the tokenizer are beyond SQL; tests/llm compares the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's tables go when its result is written."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for name, stage in STAGES[:-1]:
        with released():
            docs = scratch.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
