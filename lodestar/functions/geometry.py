"""Plane geometry: grid cells and distances."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def cell_side(distance: float) -> float:
    """Side of the grid whose 3x3 blocks have ``distance`` as their diagonal bound."""
    return distance / (2 * math.sqrt(2))


def cell_index(coordinate: Column, side: float) -> Column:
    """Row or column of the grid; the default is not reached and declares the result non-null."""
    return F.coalesce(F.floor(coordinate / F.lit(side)).cast("bigint"), F.lit(0).cast("bigint"))


def squared_distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = ax - bx, ay - by
    return dx * dx + dy * dy
