"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import stage

#: Edges up to which one task ties them all together, without rounds: less than a megabyte, which Spark itself would not split.
FEW_EDGES = 50_000


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(node, component)`` of the edges ``(a, b)`` of all batches."""
    parent: dict[int, int] = {}

    def find(n: int) -> int:
        while parent.setdefault(n, n) != n:
            parent[n] = n = parent[parent[n]]
        return n

    for batch in batches:
        for a, b in zip(*[c.to_pylist() for c in batch.columns]):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(n) for n in nodes], pa.int64())], names=["node", "component"])


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for the nodes of edges ``(a, b)``; the component is its smallest node.

    In each round every node ties all its neighbours, and itself, to the smallest of them, until all
    are stars. A round is one aggregate, a join with one row per node on one side and one distinct,
    staged; no neighbourhood is ever collected. Up to ``FEW_EDGES`` edges, counted first, need no rounds.
    Null ends and loops are ignored, repeated edges count once. Edges are read twice: let them be staged.
    """
    ends = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))
    if ends.count() <= FEW_EDGES:
        return ends.coalesce(1).mapInArrow(_stars, "node long, component long")
    current = stage(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        mark = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        seen = mark
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        tied = both.join(least, "u").select("v", "m").unionByName(least.select(F.col("u").alias("v"), "m"))
        current = stage(
            tied.where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).distinct()
        )
