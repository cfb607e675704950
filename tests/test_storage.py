import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from twinfold.plans.storage import Scratch, join_facts, released, row_keyed, written


def place(scratch):
    return Path(scratch.root.removeprefix("file://"))


def test_tables_go_with_their_scratch(spark):
    with Scratch(spark) as scratch:
        saved = scratch.save(spark.range(10), "t")
        assert saved.count() == 10 and place(scratch).exists()
    assert not place(scratch).exists()
    outer = Scratch(spark)
    kept = outer.save(spark.range(3), "kept")
    with released():
        inner = Scratch(spark)
        inner.save(spark.range(4), "gone")
        kept_too = outer.save(spark.range(5), "kept")
    assert not place(inner).exists() and (kept.count(), kept_too.count()) == (3, 5)
    outer.drop(kept)
    assert kept_too.count() == 5
    outer.clear()


def test_tables_of_other_threads_stay(spark):
    """A stream writes its tables while a pipeline's stage ends, and the other way round."""
    opened, ended, left = threading.Event(), threading.Event(), []

    def stream():
        with released():
            mine = Scratch(spark)
            table = mine.save(spark.range(6), "mine")
            opened.set()
            ended.wait(60)
            left.append(table.count())
        left.append(place(mine).exists())

    other = threading.Thread(target=stream)
    with released():
        inner = Scratch(spark)
        kept = inner.save(spark.range(4), "t")
        other.start()
        assert opened.wait(60)
    ended.set()
    other.join()
    assert left == [6, False] and not place(inner).exists() and kept is not None


def test_settings_are_as_before_after_a_save(spark, scratch):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    for before in ("false", "true"):
        spark.conf.set(key, before)
        scratch.save(spark.range(5).groupBy("id").count(), "t")
        assert spark.conf.get(key) == before
    spark.conf.unset(key)


@pytest.mark.parametrize("kind", ["bigint", "string", "binary", "int"])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_rows_meet_the_facts_of_their_keys(spark, kind, how):
    rows = spark.range(60).select((F.col("id") % 7).cast("string").alias("k"), F.col("id").alias("v"), F.lit(1).alias("one")).withColumn("k", F.col("k").cast(kind))
    facts = rows.where("v % 7 <> 3").groupBy("k").agg(F.sum("v").alias("s"))
    plain = rows.join(facts, "k", how).select("k", "v", "one", "s")
    assert sorted(map(str, join_facts(rows, facts, ["k"], how).select("k", "v", "one", "s").collect())) == sorted(map(str, plain.collect()))
    two = rows.groupBy("k", "one").agg(F.max("v").alias("m"))
    assert sorted(map(str, join_facts(rows, two, ["k", "one"], how).collect())) == sorted(map(str, rows.join(two, ["k", "one"], how).select("k", "v", "one", "m").collect()))


def test_hot_rows_can_be_split(spark):
    """Both sides of the join come straight from exchanges of their own, as the skew rule wants."""
    rows = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    joined = join_facts(rows, rows.groupBy("k").agg(F.min("id").alias("m")), ["k"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.enabled")
    lines = [x.lstrip(" :+-*0123456789()") for x in plan.splitlines()]
    at = next(k for k, x in enumerate(lines) if x.startswith("SortMergeJoin"))
    assert lines[at + 1].startswith("Sort ") and lines[at + 2].startswith("Exchange") and sum(x.startswith("Exchange") for x in lines) == 3


def test_keys_of_odd_ids(spark, scratch):
    ids = [5, None, 3, 5, None, -1]
    rows = spark.createDataFrame([(i, "t") for i in ids], "id bigint, text string").repartition(3)
    for last in (True, False):
        keyed = sorted((r.row_key, r.id) for r in row_keyed(rows, "id", scratch, nulls_last=last).collect())
        assert len({k for k, _ in keyed}) == 6
        assert [i for _, i in keyed] == ([-1, 3, 5, 5, None, None] if last else [None, None, -1, 3, 5, 5])
    assert [(r.id, r.row_key) for r in row_keyed(rows.where("id in (3, -1)"), "id", scratch).orderBy("id").collect()] == [(-1, -1), (3, 3)]
    assert row_keyed(rows.where("false"), "id", scratch).collect() == []


def test_written_tables_broadcast_little(spark):
    """The driver holds no large table for a join that is written, and the session's own limit is back after it."""
    big, small = (spark.range(n).select("id", F.sha2(F.col("id").cast("string"), 256).alias(c)) for n, c in ((60_000, "a"), (30_000, "b")))
    held = Scratch(spark)
    big, small = held.save(big, "big"), held.save(small, "small")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    plan = lambda: big.join(small, "id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan()
    with written(spark):
        assert "BroadcastHashJoin" not in plan()
        for own in ("-1", "64k"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", own)
            with written(spark):
                assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == {"-1": "-1", "64k": "65536"}[own]
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before
    held.clear()
