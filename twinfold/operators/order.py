"""Places and running sums in an order, by prefix sums over range partitions.

Rows are dealt by ranges of the order, sorted, and written once with a number that tells their partition and their place in it.
What is summed up in one task is a row for each partition, or for each partition that a group reaches into, and never the
rows themselves; so neither sparse nor hot keys make a large window. Rows of one order value are dealt by a hash of
the row and their place in the input, so that equal values don't meet in one partition either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinfold.plans.storage import Scratch, join_facts

#: monotonically_increasing_id() keeps the place within a partition in so many bits.
_PLACE_BITS = 33


def ordered(frame: DataFrame, order: list[str | Column], scratch: Scratch, ties: bool = False) -> DataFrame:
    """The rows in range partitions of the order, written once, with _at (grows with the order) and _part. ties: values of the order may repeat."""
    keys = list(order)
    if ties:
        frame = frame.withColumns({"_row_hash": F.xxhash64(*(F.col(f"`{c}`") for c in frame.columns)), "_row_place": F.monotonically_increasing_id()})
        keys += [F.col("_row_hash"), F.col("_row_place")]
    dealt = frame.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_row_hash", "_row_place")
    return scratch.save(dealt.withColumn("_at", F.monotonically_increasing_id()), "ordered").withColumn("_part", F.shiftright("_at", _PLACE_BITS))


def _before(sums: DataFrame, values: list[str], group: list[str]) -> DataFrame:
    """For each partition (of a group) the sums over the partitions before it."""
    window = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*group, "_part", *(F.coalesce(F.sum(v).over(window), F.lit(0)).cast("bigint").alias(f"_before_{v}") for v in values))


def with_ordinals(things: DataFrame, order: str | list[str | Column], scratch: Scratch, offset: int = 0, out: str = "idx") -> DataFrame:
    """Add a dense number in the order, from offset. Rows of equal order come in any fixed order, null first."""
    rows = ordered(things.drop(out), [order] if isinstance(order, str) else order, scratch, ties=True)
    starts = _before(rows.groupBy("_part").agg(F.count("*").alias("_n")), ["_n"], [])
    place = F.col("_at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)) + F.col("_before__n") + offset
    return rows.join(F.broadcast(starts), "_part").withColumn(out, place.cast("bigint")).drop("_at", "_part", "_before__n")  # a row for each partition


def position(frame: DataFrame, group: str, order: str | list[str | Column], scratch: Scratch, out: str = "pos") -> DataFrame:
    """Add the rank of each row in its group from 0. The group is not null; a hot one lies in many partitions and is ranked in all of them at once."""
    rows = ordered(frame.drop(out), [F.col(group), *([order] if isinstance(order, str) else order)], scratch, ties=True)
    runs = rows.groupBy(group, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    starts = _before(runs, ["_n"], [group]).join(runs.select(group, "_part", "_first"), [group, "_part"])
    starts = starts.select(group, "_part", (F.col("_before__n") - F.col("_first")).alias("_shift"))
    return join_facts(rows, starts, [group, "_part"]).withColumn(out, (F.col("_at") + F.col("_shift")).cast("bigint")).drop("_at", "_part", "_shift")


def running_sums(frame: DataFrame, order: list[str | Column], values: list[str], scratch: Scratch, group: str | None = None) -> DataFrame:
    """Replace each of the bigint columns `values` by its sum over the rows up to and with this one in the order, within the group if there is one.

    The order must be unique (within a group); sums must fit a bigint. The windows that run over rows are those of one partition.
    """
    by = [group] if group else []
    rows = ordered(frame, [*map(F.col, by), *order], scratch)
    sums = rows.groupBy(*by, "_part").agg(*(F.sum(v).alias(v) for v in values))
    starts = _before(sums, values, by)
    own = Window.partitionBy(*by, "_part").orderBy("_at")
    rows = rows.withColumns({v: F.sum(v).over(own) for v in values})
    rows = join_facts(rows, starts, [*by, "_part"]) if group else rows.join(F.broadcast(starts), "_part")  # a row for each partition
    return rows.withColumns({v: (F.col(v) + F.col(f"_before_{v}")).cast("bigint") for v in values}).drop("_at", "_part", *(f"_before_{v}" for v in values))
