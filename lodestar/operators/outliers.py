"""Exact distance outliers: points with at most M points, themselves included, within distance D."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cell_index, cell_side, check_at_least, check_positive, squared_distance
from ..plans.skew import BROADCAST_ROWS, HOT_FLOOR, drop_hot, in_keys, join_sized
from ..plans.stage import stage
from .grid import COPIES, adjacent, cell_sizes, neighbourhood, with_cell

# Two cells are compared point by point up to this many pairs, else both are split.
PAIR_BUDGET = 4096
# Cell indices stay below 2^52, where doubles are whole numbers: splitting ends where a cell's side
# is that much smaller than the largest coordinate, far below the distance of two float32 numbers there.
INDEX_BITS = 52


def point_count(points: DataFrame) -> DataFrame:
    return points.agg(F.count("*").alias("n_points"))


def _within(distance: float) -> Column:
    return squared_distance(F.col("x"), F.col("y"), F.col("ox"), F.col("oy")) <= F.lit(
        distance * distance
    )


def _compare_points(points: DataFrame, pairs: DataFrame, distance: float) -> DataFrame:
    """``(x, y, part)``: weight of the points of the paired cells that lie within the distance.

    ``points`` are ``(ci, cj, x, y, w)`` with distinct coordinates, ``pairs`` are
    ``(i, j, ci, cj)``.
    """
    # Both sides keep the weight, so that they can read the same exchange.
    mine = points.select(
        F.col("ci").alias("i"), F.col("cj").alias("j"), "x", "y", F.col("w").alias("own_w")
    )
    theirs = points.select("ci", "cj", F.col("x").alias("ox"), F.col("y").alias("oy"), "w")
    return (
        pairs.select("i", "j", "ci", "cj")
        .join(mine, ["i", "j"])
        .join(theirs, ["ci", "cj"])
        .where(_within(distance))
        .groupBy("x", "y", "own_w")
        .agg(F.sum("w").alias("part"))
        .select("x", "y", "part")
    )


def _apart() -> Column:
    """Of cells at most three rows and columns away: not in the 3x3 block."""
    return (F.abs(F.col("ci") - F.col("i")) > 1) | (F.abs(F.col("cj") - F.col("j")) > 1)


def _compare_near(own: DataFrame, others: DataFrame, distance: float, few: bool) -> DataFrame:
    """``(x, y, part)`` of the points ``own``: weight of those of ``others`` that lie within the distance,
    but not in the 3x3 block.

    Both are ``(i, j, x, y, w)`` with distinct coordinates. Points meet in tiles of
    cells, to which each of one side is copied once (``adjacent``): no row is
    made for a pair of cells, and the weights are summed where the points meet.
    """
    mine = own.select("i", "j", "x", "y")
    theirs = others.select(
        F.col("i").alias("ci"), F.col("j").alias("cj"), F.col("x").alias("ox"), F.col("y").alias("oy"), "w"
    )
    return (
        adjacent(mine, theirs, few)
        .where(_apart() & _within(distance))
        .groupBy(*([] if few else ["_ti", "_tj"]), "x", "y")
        .agg(F.sum("w").alias("part"))
        .select("x", "y", "part")
    )


def _located(points: DataFrame, distance: float, level: int) -> DataFrame:
    """``points`` with their cell ``(ci, cj)`` after ``level`` halvings of the side."""
    side = cell_side(distance) / 2**level
    return points.select(
        cell_index(F.col("x"), side).alias("ci"), cell_index(F.col("y"), side).alias("cj"), "x", "y", "w"
    )


def _contents(located: DataFrame) -> DataFrame:
    return located.groupBy("ci", "cj").agg(F.count("*").alias("n"), F.sum("w").alias("w"))


def _as_own(cells: DataFrame) -> DataFrame:
    return cells.select(
        F.col("ci").alias("i"), F.col("cj").alias("j"), F.col("n").alias("own_n")
    )


def _split(crowded: DataFrame, cells: DataFrame, level: int, halvings: int) -> DataFrame:
    """The pairs of smaller cells (``cells``, of ``level``) of the ``crowded`` pairs, but for those
    wholly beyond the distance; ``inside`` tells the pairs wholly within it.
    """
    parent = lambda name: F.shiftright(F.col(name), halvings)
    own = _as_own(cells).withColumns({"pi": parent("i"), "pj": parent("j")})
    other = cells.withColumns({"pci": parent("ci"), "pcj": parent("cj")})
    pairs = (
        crowded.select("i", "j", "ci", "cj")
        .toDF("pi", "pj", "pci", "pcj")
        .join(own, ["pi", "pj"])
        .join(other, ["pci", "pcj"])
        .select("i", "j", "own_n", "ci", "cj", "n", "w")
    )
    di, dj = (F.abs(F.col(c) - F.col(o)).cast("double") for c, o in (("ci", "i"), ("cj", "j")))
    gap_i, gap_j = F.greatest(di - 1, F.lit(0.0)), F.greatest(dj - 1, F.lit(0.0))
    # Squared distance in units of the side; pairs that rounding could put on either side are kept.
    reach = 8.0 * 4.0**level
    return pairs.where(gap_i * gap_i + gap_j * gap_j <= F.lit(reach * (1 + 1e-12))).withColumn(
        "inside", (di + 1) * (di + 1) + (dj + 1) * (dj + 1) < F.lit(reach * (1 - 1e-12))
    )


def _halvings(located: DataFrame, distance: float, level: int) -> int:
    """How often to halve the side until the fullest spread of a cell is no longer within one cell.

    Points that lie close together in their cell would stay together for many levels. 0: no further split.
    """
    spread = F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"))
    spreads = located.groupBy("ci", "cj").agg(spread.alias("s"), F.max(F.greatest(F.abs("x"), F.abs("y"))).alias("m"))
    widest, largest = spreads.agg(F.max("s"), F.max("m")).first()
    if not widest:
        return 0
    side = cell_side(distance) / 2**level
    deepest = math.floor(INDEX_BITS + math.log2(side / largest))
    return min(max(1, math.floor(math.log2(side / widest))), max(0, deepest))


def _refined_parts(
    points: DataFrame,
    asked: DataFrame,
    pairs: DataFrame,
    distance: float,
    budget: int,
    total: int,
    floor: int,
    few_asked: bool,
) -> list[DataFrame]:
    """Neighbour weights when some cells are too full to compare point by point.

    Cells of which any two may be compared point by point meet in tiles. Of the
    others, pairs of cells over the budget are replaced by the pairs of their quarter
    cells, or smaller ones where all points of the cells lie close together. A pair of quarters wholly within the distance adds the other cell's
    weight, a pair wholly beyond it is dropped, and the rest go to the next
    level with the points of their cells. A cell meets only the cells on the rim
    of its ball, and identical points never split, being one weighted point. No
    step lists the pairs of a full cell.
    """
    level, ended = 0, False
    located = _located(points, distance, level)
    cells = stage(_contents(located))
    most = math.isqrt(budget)
    n_thin, n_thick = cells.agg(F.count_if(F.col("n") <= most), F.count_if(F.col("n") > most)).first()
    if n_thick == 0:
        return [_compare_near(asked, points, distance, few_asked)]
    sizes = cells.withColumnsRenamed({"ci": "i", "cj": "j"})
    thin = sizes.where(F.col("n") <= most)
    own, others = (in_keys(rows, thin, ["i", "j"], "n", n_thin, sizes, total, floor) for rows in (asked, points))
    parts = [_compare_near(own, others, distance, few_asked)]
    open_pairs = stage(
        pairs.select("i", "j", "ci", "cj")
        .join(_as_own(cells), ["i", "j"])
        .join(cells, ["ci", "cj"])
        .where((F.col("own_n") > most) | (F.col("n") > most))
    )
    while True:
        full = F.col("own_n") * F.col("n") > budget
        n_full = open_pairs.where(full).count() if not ended else 0
        if n_full == 0:
            parts.append(_compare_points(located, open_pairs, distance))
            return parts
        few = drop_hot(located, cells, ["ci", "cj"], "n", total, max(floor, budget))
        parts.append(_compare_points(few, open_pairs.where(~full), distance))

        crowded = open_pairs.where(full)
        active = (
            crowded.select("ci", "cj", "n")
            .union(crowded.select("i", "j", "own_n"))
            .distinct()
        )
        points = in_keys(located, active, ["ci", "cj"], "n", 2 * n_full, cells, total, floor)
        points = stage(points)
        halvings = _halvings(points, distance, level)
        if halvings == 0:
            # Cannot be: distinct float32 points differ in cells that are large enough to be numbered.
            open_pairs, located, ended = crowded, points, True
            continue
        level += halvings
        located = _located(points, distance, level)
        cells = stage(_contents(located))
        met = stage(_split(crowded, cells, level, halvings))
        covered = (
            met.where("inside")
            .groupBy("i", "j")
            .agg(F.sum("w").alias("part"), F.max("own_n").alias("own_n"))
        )
        own_points = located.withColumnsRenamed({"ci": "i", "cj": "j"})
        parts.append(
            join_sized(own_points, covered, ["i", "j"], "own_n", total, floor).select(
                "x", "y", "part"
            )
        )
        open_pairs = met.where(~F.col("inside"))


def _in_cells(
    rows: DataFrame, wanted: DataFrame, n: int, cells: DataFrame, total: int, floor: int
) -> DataFrame:
    return in_keys(rows, wanted, ["i", "j"], "size", n, cells, total, floor)


def _balls(
    points: DataFrame,
    distance: float,
    m: int | None,
    budget: int,
    floor: int,
) -> tuple[DataFrame, DataFrame, int]:
    """Ball counts ``(x, y, w, ball)`` of the distinct coordinates, with the points they came
    from (restricted where ``m`` allows) and the total number of points.

    With ``m``, only cells with N3 <= m are looked at: all others hold no outlier.
    """
    check_positive(distance=distance)
    cells = stage(neighbourhood(cell_sizes(points, distance)))
    wanted = cells if m is None else cells.where(F.col("n3") <= m)
    is_wanted = F.lit(True) if m is None else F.col("n3") <= m
    total, fullest, n_wanted = cells.agg(
        F.coalesce(F.sum("size"), F.lit(0)),
        F.coalesce(F.max("size"), F.lit(0)),
        F.count_if(is_wanted),
    ).first()

    others = cells.select(
        F.col("i").alias("ci"), F.col("j").alias("cj"), F.col("size").alias("other_size")
    )
    pairs = (
        adjacent(wanted.select("i", "j"), others, few=n_wanted * COPIES <= BROADCAST_ROWS)
        .where(_apart())
        .select("i", "j", "ci", "cj", "other_size")
    )
    celled = with_cell(points, distance)
    candidates = celled
    if m is not None:
        pairs = stage(pairs)
        involved = (
            pairs.select(F.col("ci").alias("i"), F.col("cj").alias("j"), F.col("other_size").alias("size"))
            .union(wanted.select("i", "j", "size"))
            .distinct()
        )
        n_involved = 49 * n_wanted
        if n_involved > BROADCAST_ROWS:
            n_involved = pairs.count() + n_wanted
        involved = stage(involved)
        if n_involved > BROADCAST_ROWS:
            n_involved = involved.count()
        celled = _in_cells(celled, involved, n_involved, cells, total, floor)
        candidates = _in_cells(celled, wanted, n_wanted, cells, total, floor)
    # Copies of a point become one weighted point; the partial aggregate merges them before the shuffle.
    weighted = stage(celled.groupBy("i", "j", "x", "y").agg(F.count("*").alias("w")))

    asked, few_asked = weighted, False
    if m is not None:
        asked = _in_cells(weighted, wanted, n_wanted, cells, total, floor)
        # A wanted cell holds at most m points.
        few_asked = m * n_wanted * COPIES <= BROADCAST_ROWS
    if fullest * fullest <= budget:
        parts = [_compare_near(asked, weighted, distance, few_asked)]
    else:
        parts = _refined_parts(weighted, asked, pairs, distance, budget, total, floor, few_asked)
    further = reduce(DataFrame.unionByName, parts)
    if len(parts) > 1:
        further = further.groupBy("x", "y").agg(F.sum("part").alias("part"))
    certain = wanted.select("i", "j", "n3", "size")
    balls = (
        join_sized(asked, certain, ["i", "j"], "size", total, floor)
        .join(further, ["x", "y"], "left")
        .select("x", "y", "w", (F.col("n3") + F.coalesce("part", F.lit(0))).alias("ball"))
    )
    return balls, candidates, total


def ball_counts(
    points: DataFrame, distance: float, budget: int = PAIR_BUDGET, floor: int = HOT_FLOOR
) -> DataFrame:
    """``(id, ball)``: points within the distance of each point, itself included."""
    balls, celled, total = _balls(points, distance, None, budget, floor)
    keyed = balls.select("x", "y", "w", "ball")
    return join_sized(celled, keyed, ["x", "y"], "w", total, floor).select("id", "ball")


def outlier_coordinates(
    points: DataFrame, distance: float, m: int, budget: int = PAIR_BUDGET, floor: int = HOT_FLOOR
) -> DataFrame:
    """``(x, y, w, ball)`` of the outliers; ``w`` points share the coordinates."""
    check_at_least(0, m=m)
    balls, _, _ = _balls(points, distance, m, budget, floor)
    return balls.where(F.col("ball") <= m).select("x", "y", "w", "ball")


def exact_outliers(
    points: DataFrame, distance: float, m: int, budget: int = PAIR_BUDGET, floor: int = HOT_FLOOR
) -> DataFrame:
    """``(id, x, y, ball)`` of every outlier."""
    check_at_least(0, m=m)
    balls, candidates, _ = _balls(points, distance, m, budget, floor)
    found = balls.where(F.col("ball") <= m).select("x", "y", "ball")
    return candidates.join(found, ["x", "y"]).select("id", "x", "y", "ball")


def exact_outlier_count(points: DataFrame, distance: float, m: int, **limits: int) -> DataFrame:
    """Number of outlier points, copies counted."""
    found = outlier_coordinates(points, distance, m, **limits)
    return found.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("n_outliers"))


def top_outliers(points: DataFrame, distance: float, m: int, k: int, **limits: int) -> DataFrame:
    """The ``k`` outlier coordinates with the fewest points around, ties by coordinates."""
    check_at_least(1, k=k)
    found = outlier_coordinates(points, distance, m, **limits)
    return found.select("x", "y", "ball").orderBy("ball", "x", "y").limit(k)
