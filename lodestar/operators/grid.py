"""Grid cells over 2-D points and the approximate distance outliers they give.

With cells of side D/(2*sqrt(2)), the 3x3 block around a point's cell lies
within distance D of the point and the 7x7 block covers all that does. So a
cell with few points in its 7x7 block (N7) holds outliers only, and one with
many in its 3x3 block (N3) holds none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cell_index, cell_side, check_at_least, check_positive

# Cells are matched inside square tiles of 2^TILE_BITS cells a side.
TILE_BITS = 2
REACH = 3
# Tiles a cell can reach.
COPIES = 9


def with_cell(points: DataFrame, distance: float) -> DataFrame:
    side = cell_side(distance)
    return points.withColumns({"i": cell_index(F.col("x"), side), "j": cell_index(F.col("y"), side)})


def cell_sizes(points: DataFrame, distance: float) -> DataFrame:
    """``(i, j, size)`` of the non-empty cells."""
    check_positive(distance=distance)
    return with_cell(points, distance).groupBy("i", "j").agg(F.count("*").alias("size"))


def adjacent(cells: DataFrame, others: DataFrame, few: bool = False) -> DataFrame:
    """Each of ``cells`` beside each of ``others`` at most three rows and columns away.

    One side is copied to every tile it reaches (``COPIES`` at most), so that
    both meet in an equi-join on the tile, which holds at most 10x10 of the
    copied cells whatever the points are. In general ``others`` ``(ci, cj, ...)``
    are copied and a merge join reads both sides tile by tile; broadcasting so
    many copies is slower even when they are small. With ``few`` cells, these are
    copied and broadcast, and ``others`` stay where they are. The join keys
    ``_ti, _tj`` are kept: an aggregation on them and the cell needs no further
    shuffle.
    """
    tile = lambda c: F.shiftright(c, TILE_BITS)
    reached = lambda c: F.explode(F.sequence(tile(c - REACH), tile(c + REACH)))
    i, j, ci, cj = F.col("i"), F.col("j"), F.col("ci"), F.col("cj")
    if few:
        own = F.broadcast(cells.withColumn("_ti", reached(i)).withColumn("_tj", reached(j)))
        other = others.withColumns({"_ti": tile(ci), "_tj": tile(cj)})
    else:
        own = cells.withColumns({"_ti": tile(i), "_tj": tile(j)})
        other = others.withColumn("_ti", reached(ci)).withColumn("_tj", reached(cj)).hint("merge")
    near = (F.abs(ci - i) <= REACH) & (F.abs(cj - j) <= REACH)
    return own.join(other, ["_ti", "_tj"]).where(near)


def neighbourhood(cells: DataFrame) -> DataFrame:
    """``(i, j, size, n3, n7)``: points in the 3x3 and the 7x7 block around each non-empty cell."""
    others = cells.select(
        F.col("i").alias("ci"), F.col("j").alias("cj"), F.col("size").alias("other_size")
    )
    touching = (F.abs(F.col("ci") - F.col("i")) <= 1) & (F.abs(F.col("cj") - F.col("j")) <= 1)
    return (
        adjacent(cells.select("i", "j", "size"), others)
        .groupBy("_ti", "_tj", "i", "j", "size")
        .agg(
            F.sum(F.when(touching, F.col("other_size")).otherwise(F.lit(0))).alias("n3"),
            F.sum("other_size").alias("n7"),
        )
        .drop("_ti", "_tj")
    )


def cell_neighbourhood(points: DataFrame, distance: float) -> DataFrame:
    return neighbourhood(cell_sizes(points, distance))


def cell_classes(points: DataFrame, distance: float, m: int) -> DataFrame:
    """Cells with class ``sure`` (all outliers), ``uncertain`` or ``non_outlier``."""
    check_at_least(0, m=m)
    label = (
        F.when(F.col("n7") <= m, F.lit("sure"))
        .when(F.col("n3") <= m, F.lit("uncertain"))
        .otherwise(F.lit("non_outlier"))
    )
    return cell_neighbourhood(points, distance).withColumn("class", label)


def outlier_summary(points: DataFrame, distance: float, m: int) -> DataFrame:
    """Points in sure and in uncertain cells: sure <= exact outliers <= sure + uncertain."""
    total = lambda name: F.coalesce(
        F.sum(F.when(F.col("class") == name, F.col("size"))), F.lit(0)
    )
    return cell_classes(points, distance, m).agg(
        total("sure").alias("sure_outliers"), total("uncertain").alias("uncertain_points")
    )


def smallest_cells(points: DataFrame, distance: float, k: int) -> DataFrame:
    """The ``k`` cells with the fewest points, ties by cell."""
    check_at_least(1, k=k)
    return cell_sizes(points, distance).orderBy("size", "i", "j").limit(k)
