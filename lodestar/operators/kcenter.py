"""k-center by farthest-first traversal: coreset of each part, centers of the coreset, radius."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import check_at_least, squared_distance
from ..plans.skew import BROADCAST_ROWS
from ..plans.stage import stage
from .grid import outlier_summary

CENTER_SCHEMA = "part bigint, ord int, id bigint, x double, y double"
# Parts of at most this many points (some tens of bytes each) go to one task as a whole.
PART_ROWS = 2_000_000
# Rounds after which the distances of all points are written anew.
STAGE_ROUNDS = 4
# Up to this many centers are written into the query as constants.
INLINE_CENTERS = 64


def _farthest_first(k: int):
    """Traversal of one part in a task: start at the lowest id, add the farthest point, ties by id."""

    def traverse(table: pa.Table) -> pa.Table:
        table = table.sort_by("id").combine_chunks()
        x, y = table["x"].to_numpy(), table["y"].to_numpy()
        chosen = [0]
        nearest = np.full(len(x), np.inf)
        while len(chosen) < k:
            dx, dy = x - x[chosen[-1]], y - y[chosen[-1]]
            np.minimum(nearest, dx * dx + dy * dy, out=nearest)
            farthest = int(np.argmax(nearest))
            if nearest[farthest] == 0:
                break
            chosen.append(farthest)
        picked = table.select(["part", "id", "x", "y"]).take(chosen)
        return picked.add_column(1, "ord", pa.array(range(len(chosen)), pa.int32()))

    return traverse


def _traverse_in_rounds(parted: DataFrame, k: int, n_parts: int) -> DataFrame:
    """The same centers as the in-task traversal, for parts too large for a task.

    Each point keeps the least distance to the centers so far, so a new center is measured once
    (and again in the few rounds before the distances are staged). A round finds the largest distance
    of each part, then the lowest id among the points that have it.
    """
    state = stage(parted.select("part", "id", "x", "y", F.lit(math.inf).alias("d2")))
    small = F.broadcast if n_parts <= BROADCAST_ROWS else (lambda df: df)
    found, pending = [], []
    for ord_ in range(k):
        measured = state
        for new in pending:
            at = new.select("part", F.col("x").alias("cx"), F.col("y").alias("cy"))
            distance = squared_distance(F.col("x"), F.col("y"), F.col("cx"), F.col("cy"))
            measured = measured.join(small(at), "part", "left").select(
                "part", "id", "x", "y", F.least("d2", F.coalesce(distance, F.col("d2"))).alias("d2")
            )
        if len(pending) == STAGE_ROUNDS:
            state, pending = stage(measured), []
            measured = state
        left = measured.where(F.col("d2") > 0)
        farthest = left.groupBy("part").agg(F.max("d2").alias("d2"))
        first = left.join(small(farthest), ["part", "d2"]).groupBy("part").agg(F.min(F.struct("id", "x", "y")).alias("p"))
        new = stage(first.select("part", F.lit(ord_).cast("int").alias("ord"), "p.id", "p.x", "p.y"))
        found.append(new)
        pending.append(new)
    return stage(reduce(DataFrame.unionByName, found))


def _traverse(parted: DataFrame, k: int, largest: int, n_parts: int, part_rows: int) -> DataFrame:
    if largest <= part_rows:
        return parted.groupBy("part").applyInArrow(_farthest_first(k), CENTER_SCHEMA)
    return _traverse_in_rounds(parted, k, n_parts)


def kcenter_coreset(points: DataFrame, k: int, parts: int, part_rows: int = PART_ROWS) -> DataFrame:
    """``(part, ord, id, x, y)``: up to ``k`` centers of each of the ``parts`` parts of the points."""
    check_at_least(1, k=k, parts=parts)
    parted = points.select(F.pmod("id", F.lit(parts)).alias("part"), "id", "x", "y")
    largest, total = (
        parted.groupBy("part")
        .count()
        .agg(F.coalesce(F.max("count"), F.lit(0)), F.coalesce(F.sum("count"), F.lit(0)))
        .first()
    )
    if k > total:
        raise ValueError(f"k must be <= the number of points, got {k} > {total}")
    return _traverse(parted, k, largest, parts, part_rows)


def kcenter_centers(points: DataFrame, k: int, parts: int, part_rows: int = PART_ROWS) -> DataFrame:
    """``(ord, id, x, y)``: the ``k`` centers in the order they were chosen from the coreset."""
    coreset = stage(kcenter_coreset(points, k, parts, part_rows))
    one_part = coreset.select(F.lit(0).cast("bigint").alias("part"), "id", "x", "y")
    return _traverse(one_part, k, k * parts, 1, part_rows).drop("part")


def _distance_to(x: Column, y: Column, ord_: Column) -> Column:
    return squared_distance(F.col("x"), F.col("y"), x, y)


def _distance_and_order(x: Column, y: Column, ord_: Column) -> Column:
    return F.struct(_distance_to(x, y, ord_).alias("d2"), ord_.alias("ord"))


def _with_least(
    points: DataFrame, centers: DataFrame, k: int, measure: Callable[..., Column]
) -> DataFrame:
    """``points`` with ``near``, the least ``measure`` over the centers.

    The centers reach the tasks as constants, so no point moves: written into
    the expression while they are few, else as the array of a scalar subquery.
    """
    check_at_least(1, k=k)
    if k <= INLINE_CENTERS:
        chosen = centers.orderBy("ord").collect()
        each = F.array(*[measure(F.lit(c["x"]), F.lit(c["y"]), F.lit(c["ord"])) for c in chosen])
        return points.withColumn("near", F.array_min(each))
    every = stage(centers).agg(F.collect_list(F.struct("x", "y", "ord"))).scalar()
    each = F.transform("centers", lambda c: measure(c["x"], c["y"], c["ord"]))
    return points.withColumn("centers", every).withColumn("near", F.array_min(each)).drop("centers")


def kcenter_assignment(points: DataFrame, centers: DataFrame, k: int) -> DataFrame:
    """``(id, center, d2)``: the nearest of the ``k`` centers, ties by order, and its squared distance."""
    return _with_least(points, centers, k, _distance_and_order).select(
        "id", F.col("near.ord").alias("center"), F.col("near.d2").alias("d2")
    )


def cluster_radius(points: DataFrame, centers: DataFrame, k: int) -> DataFrame:
    """``(radius)``: the largest distance of a point to its nearest center."""
    nearest = _with_least(points, centers, k, _distance_to)
    return nearest.agg(F.sqrt(F.max("near")).alias("radius"))


def kcenter_radius(points: DataFrame, k: int, parts: int, part_rows: int = PART_ROWS) -> DataFrame:
    return cluster_radius(points, kcenter_centers(points, k, parts, part_rows), k)


def kcenter_outliers(
    points: DataFrame, k: int, parts: int, m: int, part_rows: int = PART_ROWS
) -> DataFrame:
    """``(radius, sure_outliers, uncertain_points)`` with the cluster radius as outlier distance."""
    (radius,) = kcenter_radius(points, k, parts, part_rows).first()
    if not radius > 0:
        raise ValueError("the radius is 0: every point is a center or a copy of one")
    summary = outlier_summary(points, radius, m)
    return summary.select(F.lit(radius).alias("radius"), "sure_outliers", "uncertain_points")
