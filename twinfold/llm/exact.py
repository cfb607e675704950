"""Exact dedup with DataFrame functions only.

Rows are grouped by a 128-bit content hash *and* the text itself, so grouping compares bytes inside
each hash group and a collision only makes two groups. The aggregation combines on the map side:
a text that a third of all rows share crosses the network once per task. Ids then find their group
by the hash alone, an equi-join whose hot partitions adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinfold.plans.storage import Scratch, row_keyed


def content_hash(text: Column) -> Column:
    """The first 128 bits of SHA-256."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def exact_groups(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", hash_of=content_hash) -> DataFrame:
    """One row per input row: the id column, row_key, keep_id, group_size, kept, text_sha256.

    keep: the "smallest" or "largest" id of equal texts stays. A null text counts as empty. A null id
    stays only if the group has no other; of rows with the same id and text, one stays. Other columns
    are ignored, whatever their names. An empty table gives no rows. A very long text is a key like any other, held whole in one row.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep: {keep}")
    best = F.max if keep == "largest" else F.min
    own = row_keyed(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), "id", scratch, nulls_last=keep == "smallest")
    rows = own.select("id", "row_key", "text", hash_of(F.col("text")).alias("h"), F.sha2("text", 256).alias("text_sha256"))

    def grouped(texts: DataFrame) -> DataFrame:
        return texts.groupBy("h", "text").agg(best("row_key").alias("best"), best("id").alias("keep_id"), F.count("*").alias("group_size"))

    groups = scratch.save(grouped(rows).drop("text"), "groups")
    clash = groups.groupBy("h").count().where("count > 1").select("h")
    ids = rows.select("id", "row_key", "h", "text_sha256")
    if clash.isEmpty():
        out = ids.join(groups, "h")
    else:  # different texts under one hash: for these the text is the key
        clash = scratch.save(clash, "clash")
        texts = rows.join(clash, "h", "left_semi")
        cols = ["id", "row_key", "text_sha256", "best", "keep_id", "group_size"]
        out = ids.join(groups.join(clash, "h", "left_anti"), "h").select(cols).unionByName(texts.join(grouped(texts), ["h", "text"]).select(cols))
    return out.select(F.col("id").alias(id_col), "row_key", "keep_id", "group_size", (F.col("row_key") == F.col("best")).alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of docs that stay, with all their columns, whatever their names. Ties, nulls and empty tables as in exact_groups()."""
    key = "exact_dedup_key"
    while key in docs.columns:
        key += "_"
    keyed = row_keyed(docs, id_col, scratch, key, nulls_last=keep == "smallest")
    groups = exact_groups(keyed.select(F.col(key).alias("k"), F.col(text_col).alias("t")), scratch, "k", "t", keep)
    return keyed.join(groups.where("kept").select(F.col("k").alias(key)), key, "left_semi").drop(key)
