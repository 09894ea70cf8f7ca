"""Connected components of a graph given as a table of edges; nodes and edges stay on the executors."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import afresh, lean

#: Edges that one task may contract: tens of MB of its memory. A graph of at most so many is done in one pass.
LOCAL = 100_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges, LOCAL at a time, as stars around the smallest node of each of their components."""
    up: dict[int, int] = {}
    held = 0

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = y
        return x

    def stars() -> pa.RecordBatch:
        pairs = [(x, r) for x in list(up) if (r := root(x)) != x]
        up.clear()
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                up[max(x, y)] = min(x, y)
        held += batch.num_rows
        if held >= LOCAL:
            yield stars()
            held = 0
    yield stars()


def components(edges: DataFrame) -> DataFrame:
    """node, root for each node of edges (a, b): root is the smallest node of its component.

    Edges are contracted locally, which leaves fewer than there are nodes for each task. If all fit one task, that is the
    answer; else rounds of large star and small star follow, in which hubs are pre-aggregated and never gathered.
    """
    kind = "a long, b long"
    now = afresh(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").mapInArrow(lean(_contract), kind))
    if now.count() < LOCAL:
        now = afresh(now.coalesce(1).mapInArrow(lean(_contract), kind))
    else:
        now = rounds(afresh(now.distinct()))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def rounds(now: DataFrame) -> DataFrame:
    """Edges (a > b) as stars around the smallest nodes of their components."""
    before = None
    while (mark := tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())) != before:
        before = mark
        # Large star: each node's larger neighbours go to its smallest one.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # Small star: each node's smaller neighbours, and itself, go to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        now = afresh(small.filter("a <> b").distinct())
    return now
