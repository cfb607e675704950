"""The corpus operators as registered queries, over whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.llm import bpe, exact, lines, minhash, packing, preference, quality, simhash, spelling, substring, suffix, trie, warc
from twinfold.llm.common import table
from twinfold.plans.storage import Scratch

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(packing.token_pieces(docs, TOKENIZER, eos=2, max_len=1024), docs.count())


def op2_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    records = warc.with_revisits(table(spark, sf_dir, "pages"), scratch)
    files = warc.write_archives(records, scratch.folder("archives"), scratch)
    number = lambda c: F.regexp_extract(c, r"^urn:x-page:(-?\d+)(:row:\d+)?$", 1).try_cast("bigint")
    back = warc.read_archives(files)
    return back.select(number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", number(F.col("refers_to_id")).alias("refers_to"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Scratch(spark))
    return found.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"), Scratch(spark), keep="largest").drop("row_key")


def op5_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    rows = preference.preference_rows(preference.star_pairs(turns, with_counts=True), turns).unionByName(preference.preference_rows(*preference.stale_replies(turns)))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s[0], s[1])), ",")
    return rows.withColumns({"chosen_mask": spans(F.col("chosen_mask")), "rejected_mask": spans(F.col("rejected_mask"))})


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents"), Scratch(spark), min_docs=5, min_chars=40, keep="largest")


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark), width=4, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents"), Scratch(spark), min_bytes=400).drop("row_key")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"), Scratch(spark), min_words=35)


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), TOKENIZER, Scratch(spark))


def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark), width=3, radius=2)
    return found.select("doc_id", "fingerprint", "component_id")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.counted_words(table(spark, sf_dir, "documents"), min_chars=7, min_n=2, slip=31)
    return spelling.grouped(words, Scratch(spark), factor=10)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    rows = trie.turn_rows(table(spark, sf_dir, "conversations"), scratch)
    return trie.prefix_trie(*trie.rebuilt(rows, scratch, every=100, shared=6), scratch)


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_warc_round_trip, op3_quality_rules, op4_exact_dedup, op5_preference_formatting, op6_line_dedup, op7_minhash_near_dedup, op8_suffix_array_dedup, op9_substring_dedup, op10_bpe_round_trip, op11_simhash_near_dedup, op12_spelling_variants, op13_conversation_trie)}
