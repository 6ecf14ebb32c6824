"""Connected components of links, in DataFrame rounds of star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import discard, written

MOST_ROUNDS = 60


class Forest:
    """Union-find over ids; the least id of a set is its root."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent[x]
        return top

    def join(self, a: int, b: int) -> bool:
        """Whether they were apart."""
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b


def contracted(links: DataFrame) -> DataFrame:
    """Each partition's links as (node, root) of the partition's own components: never more rows than nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                forest.join(a, b)
        nodes = [x for x in forest.parent if forest.parent[x] != x]
        if nodes:
            yield pa.record_batch({"a": pa.array(nodes, pa.int64()), "b": pa.array([forest.root(x) for x in nodes], pa.int64())})

    return links.select("a", "b").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, root (the least node reachable) for every node of a link (long a, b) that isn't its own root.

    Rounds of large-star (a node's larger neighbours move to its least neighbour) and small-star (the others do). What a round makes
    is written, each node's least neighbour too: a hot node is one key of a partial aggregate, and of a join of two tables, which Spark splits.
    """
    edges = written(contracted(links.filter("a <> b")), "links")
    before = None
    for _ in range(MOST_ROUNDS):
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m")), "least")
        large = written(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct(), "large")
        lower = written(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(lower, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lower.select("a", F.col("m").alias("b")))
        after = written(small.distinct(), "links")
        for table in (edges, least, large, lower):
            discard(table)
        edges = after
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
    raise RuntimeError("components did not settle")
