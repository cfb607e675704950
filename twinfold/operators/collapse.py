"""From components to groups in display order, counts, labels and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinfold.operators.order import position
from twinfold.plans.storage import Scratch, join_facts

#: Columns that groups() adds; columns of the items with these names make way for them.
ADDED = ("primary_idx", "is_primary", "pos", "dup_count", "hidden", "label")


def label(n: Column, shown: bool = False) -> Column:
    """What stands at a group's first item; null without duplicates."""
    plural = F.when(n == 1, F.lit("")).otherwise(F.lit("s"))
    return F.when(n > 0, F.concat(F.lit("("), n.cast("string"), F.lit(" duplicate"), plural, F.lit(" — hide)" if shown else " — show)")))


def groups(items: DataFrame, components: DataFrame, scratch: Scratch, show: bool = False, toggled: DataFrame | None = None) -> DataFrame:
    """Add primary_idx, is_primary, pos, dup_count, hidden and label; items without a link are groups of one.

    show: whether duplicates are shown at first. toggled: rows (primary_idx) of groups that the user has switched to the other state;
    a row for a group that is none, or a null one, does nothing. Columns of items with the names of the results are replaced.
    """
    own = items.drop(*ADDED)
    placed = own.join(components.select(F.col("id").alias("idx"), F.col("component").alias("primary_idx")), "idx", "left")
    placed = placed.withColumn("primary_idx", F.coalesce("primary_idx", "idx"))
    sizes = placed.groupBy("primary_idx").agg((F.count("*") - 1).alias("dup_count"))
    if toggled is None:
        sizes = sizes.withColumn("_shown", F.lit(show))
    else:
        switched = toggled.where("primary_idx is not null").select("primary_idx", F.lit(not show).alias("_shown")).distinct()
        sizes = sizes.join(switched, "primary_idx", "left").withColumn("_shown", F.coalesce("_shown", F.lit(show)))
    out = join_facts(position(placed, "primary_idx", "idx", scratch), sizes, ["primary_idx"])
    first, shown = F.col("primary_idx") == F.col("idx"), F.col("_shown")
    named = F.when(shown, label(F.col("dup_count"), True)).otherwise(label(F.col("dup_count")))
    out = out.withColumns({"is_primary": first, "hidden": ~first & ~shown, "label": F.when(first, named)})
    return out.select(*own.columns, *ADDED)


def display_order(grouped: DataFrame) -> DataFrame:
    """Items as listed: each group's primary, its duplicates right behind it."""
    return grouped.orderBy("primary_idx", "idx")


def write_display(grouped: DataFrame, path: str) -> None:
    """The listing as Parquet: files in the order of the list, rows within them too."""
    grouped.repartitionByRange("primary_idx", "idx").sortWithinPartitions("primary_idx", "idx").write.mode("overwrite").parquet(path)


def stats(grouped: DataFrame) -> DataFrame:
    """One row: groups with duplicates, and all duplicates."""
    first = F.col("is_primary")
    return grouped.agg(F.count_if(first & (F.col("dup_count") > 0)).alias("num_with_dups"), F.coalesce(F.sum(F.when(first, F.col("dup_count"))), F.lit(0)).alias("total_dups"))


def batch_stats(before: DataFrame, after: DataFrame, start: int | None, length: int) -> DataFrame:
    """One row: batch_num_with_dups, batch_total_dups.

    before and after: (idx, primary_idx) of the items known before the batch, and of all. A batch's range is start .. start + length with both ends.
    Heads are all items new in the batch and all former primaries. A head that is still primary counts if it got its first duplicates;
    one that is no longer counts as a duplicate.
    """
    old = before.groupBy(F.col("primary_idx").alias("idx")).agg(F.count("*").alias("old_size"))
    now = after.groupBy("primary_idx").agg(F.count("*").alias("size"))
    heads = after.join(before.select("idx", F.col("primary_idx").alias("old_primary")), "idx", "left").where(F.col("old_primary").isNull() | (F.col("old_primary") == F.col("idx")))
    heads = heads.join(old, "idx", "left").join(now, "primary_idx").withColumn("old_size", F.coalesce("old_size", F.lit(1)))
    inside = F.lit(False) if start is None else F.col("idx").between(start, start + length)
    still = F.col("idx") == F.col("primary_idx")
    return heads.agg(
        F.count_if(inside & still & (F.col("old_size") == 1) & (F.col("size") > 1)).alias("batch_num_with_dups"),
        F.count_if(inside & ~still).alias("batch_total_dups"),
    )


def _counted(n: Column, noun: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, F.lit("")).otherwise(F.lit("s")))


def stats_message() -> Column:
    """The log line of a batch's statistics, in one of three shapes: no new duplicates; the first ones; more than before."""
    items, dups, new = (F.col(c) for c in ("num_with_dups", "total_dups", "batch_total_dups"))
    known = F.concat(_counted(items, "item"), F.lit(" with "), _counted(dups, "duplicate"))
    return (
        F.when(new == 0, F.lit("No duplicates found"))
        .when(new == dups, F.concat(F.lit("Found "), known))
        .otherwise(F.concat(F.lit("Found "), _counted(new, "duplicate"), F.lit(", total "), known))
    )
