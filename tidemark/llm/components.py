"""Connected components by alternating large-star and small-star, behind a contraction of what lies in one task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

#: Edges that a task contracts at once; bounds its memory.
LOCAL = 500_000


class Parts:
    """Union-find over any numbers; the least one of a part stands for it."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        top = x
        while (to := self.up.setdefault(top, top)) != top:
            top = to
        while x != top:
            self.up[x], x = top, self.up[x]
        return top

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _contracted(edges: DataFrame, local: int) -> DataFrame:
    """Edges (a, b) as stars: of each lot of up to local edges, every node with the least one that it hangs together with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = Parts(), 0

        def stars() -> Iterator[pa.RecordBatch]:
            pairs = [(x, top) for x in list(parts.up) if (top := parts.find(x)) != x]
            for i in range(0, len(pairs), 50_000):
                yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*pairs[i : i + 50_000], strict=True)], ["a", "b"])

        for batch in batches:
            for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                parts.join(x, y)
            held += batch.num_rows
            if held >= local:
                yield from stars()
                parts, held = Parts(), 0
        yield from stars()

    return edges.mapInArrow(run, "a long, b long")


def _least(edges: DataFrame) -> DataFrame:
    """Of each node a, the least neighbour. Written, so that the join with a hub's edges can be split."""
    return common.save(edges.groupBy("a").agg(F.min("b").alias("m")), "least")


def _stars(edges: DataFrame) -> bool:
    """Whether each node has one least node, which has none."""
    if edges.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high")).where("low < high").limit(1).count():
        return False
    return edges.select(F.col("b").alias("a")).distinct().join(edges.select("a"), "a", "left_semi").isEmpty()


def components(edges: DataFrame, a: str, b: str, local: int | None = None) -> DataFrame:
    """(node, component): the least node that each node of an edge can reach. edges: two long columns of a written table, or what costs little to read twice.

    Loops, repeated edges and edges without an end are allowed; nodes without an edge to another node don't appear. An empty table gives no rows.
    Tasks first contract the edges that they read, in lots of a bounded size, to stars; rounds of large-star and small-star
    join the stars of all lots. Each round is a table in the shared folder, deleted when the next one is there; neither a component nor a
    hub's neighbours are ever gathered in one place.
    """
    spark = edges.sparkSession
    local = LOCAL if local is None else local
    edges = edges.where(f"{a} <> {b}").select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    lots = -(-edges.count() // local)
    now = common.save(_contracted(edges.coalesce(max(1, lots)), local).distinct(), "edges")
    while lots > 1 and not _stars(now):
        # Large-star: each node's larger neighbours move to its least neighbour, or to itself.
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = _least(both)
        large_star = common.save(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct(), "edges")
        common.discard(spark, now, least)
        # Small-star: each node and its smaller neighbours move to the least of these.
        least = _least(large_star)
        moved = large_star.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        now = common.save(moved.distinct(), "edges")
        common.discard(spark, large_star, least)
    found = common.save(now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct()), "components")
    common.discard(spark, now)
    return found
