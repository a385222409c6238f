"""Connected components of a graph of longs, by alternating stars.

Each round links every node's larger neighbours to the smallest node it knows (large
star), then does the same among the smaller ones (small star), until no edge changes. The
smallest neighbour is an aggregate, combined before the shuffle, and comes back by a join. A
node with over 1 / PARTS of all edges, and over FLOOR, is not joined by a shuffle, which
would put its edges into one task: there are fewer than PARTS such nodes, so they are
broadcast to the edges. Rounds grow with the logarithm of the
number of nodes; each is checkpointed, so lineage doesn't grow.

FLOOR edges or fewer, whether from the start or after some rounds, are joined by one task
without a shuffle: every round is some seven shuffles, which for so few edges are little
but files.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import checkpointed

#: So many edges are one task's work. Of more, a node with more than FLOOR and than 1 / PARTS of them is broadcast.
FLOOR, PARTS = 100_000, 4096


def components(edges: DataFrame) -> DataFrame:
    """edges: longs a, b. Returns node, component (the smallest node reachable), for nodes that have an edge."""
    now = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    seen = state(now)
    while seen[0] > FLOOR:
        now = checkpointed(large_star(now, seen[0]))
        now = checkpointed(small_star(now, seen[0]))
        then, seen = seen, state(now)
        if then == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b")).groupBy("node").agg(F.min("component").alias("component"))
    return checkpointed(now.coalesce(1).mapInArrow(joined, "node long, component long"))


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, component of all edges a, b."""
    top: dict[int, int] = {}

    def root(x: int) -> int:
        while top.setdefault(x, x) != x:
            top[x] = x = top[top[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            top[max(a, b)] = min(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(list(top), pa.int64()), pa.array([root(x) for x in top], pa.int64())], names=["node", "component"])


def state(edges: DataFrame) -> tuple:
    """What stays the same only if the edges do."""
    mixed = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(mixed), F.coalesce(F.sum(mixed.bitwiseAND(0xFFFFFFFF)), F.lit(0))).first())


def met(edges: DataFrame, by: str, least: DataFrame, many: int) -> DataFrame:
    """edges (many of them, or fewer) with m of least (node, m), null if it isn't there, for the node in column by."""
    least = least.withColumnRenamed("node", by)
    heavy = edges.groupBy(by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(FLOOR, many // PARTS)).select(by)  # fewer than PARTS rows
    hot = edges.join(F.broadcast(heavy.join(least, by, "left")), by)
    return edges.join(F.broadcast(heavy), by, "left_anti").join(least, by, "left").unionByName(hot)


def large_star(edges: DataFrame, many: int) -> DataFrame:
    """edges: a > b. Every neighbour of u larger than u is linked to the smallest of u and its neighbours."""
    least = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))  # of those with a smaller neighbour; for others it's the node itself
    return met(edges, "b", least, many).select("a", F.coalesce("m", "b").alias("b")).distinct()


def small_star(edges: DataFrame, many: int) -> DataFrame:
    """edges: a > b. The smaller neighbours of u, and u, are linked to the smallest of them."""
    least = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
    linked = met(edges, "a", least, many)
    return linked.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select(F.col("node").alias("a"), F.col("m").alias("b"))).distinct()
