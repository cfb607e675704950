"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014).

Before the first shuffle each task contracts the links it reads, some at a time: every node in them leads to the smallest one that it reaches by these
links, so chains that lie together cost one link a node and no rounds. Each round is an aggregation with map-side combine and an equi-join, so a node with very many
links is pre-aggregated and its join partition can be split. Every round is written out, which
keeps the plan short. Rounds end when every link leads to the smallest node of its component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.plans.storage import Scratch, join_facts


#: Links that a task contracts at once.
CONTRACTED = 1 << 18


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node reachable) for the nodes of some links that aren't the smallest themselves."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, two = place[: len(a)], place[len(a) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[one], root[two]
        apart = x != y
        if not apart.any():
            break
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (root[root] != root).any():
            root = root[root]
    led = root != np.arange(len(nodes))
    return nodes[led], nodes[root[led]]


def contracted(edges: DataFrame) -> DataFrame:
    """Links (a, b), a > b, with the same components, made of CONTRACTED links at a time where these lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            held.append(tuple(c.to_numpy() for c in batch.columns))
            if sum(len(x) for x, _ in held) >= CONTRACTED:
                yield roots(held)
                held = []
        if held:
            yield roots(held)

    def roots(held: list) -> pa.RecordBatch:
        node, root = local_roots(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(root, pa.int64())], names=["a", "b"])

    return edges.select("a", "b").mapInArrow(run, "a bigint, b bigint")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    return join_facts(both, low, ["a"]).where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("low"))
    moved = join_facts(down, low, ["a"]).where("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.unionByName(low.select("a", F.col("low").alias("b")))


def _unsettled(edges: DataFrame) -> DataFrame:
    """Nodes that lead to two others, or lead and are led to: none if all links go from a node to its component's smallest one."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up")))
    return ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least")).where("ups > 1 or ups = 1 and least = 0")


def connected_components(edges: DataFrame, scratch: Scratch, src: str = "a", dst: str = "b") -> DataFrame:
    """Rows (id, component) for every node that has a link; component is the smallest id reachable.

    Loops and repeated links are harmless; links with a null end are ignored; no links give no rows.
    """
    now = edges.select(F.col(src).cast("bigint").alias("a"), F.col(dst).cast("bigint").alias("b"))
    now = scratch.save(contracted(now.where("a <> b")).distinct(), "links")
    while not _unsettled(now).isEmpty():
        new = scratch.save(_small_star(_large_star(now).where("a <> b")).where("a <> b").distinct(), "links")
        scratch.drop(now)
        now = new
    roots = now.select(F.col("b").alias("id")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))
