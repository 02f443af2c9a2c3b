"""2-D points ``(id, x, y)``.

Coordinates are rounded to float32 once, as in a file of floats, and widened
to double; all arithmetic afterwards is in double.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .parse import strict
from .text import numbered_lines


def points_from(df: DataFrame, x: str, y: str, id: str | None = None) -> DataFrame:
    """Points from two numeric columns; a row without a finite coordinate fails the job.

    Without an id column, ids are unique but depend on the partitions; ``read_points`` numbers files in order.
    """
    key = F.col(id).cast("bigint") if id else F.monotonically_increasing_id()
    return df.select(key.alias("id"), _coordinate(x, "x"), _coordinate(y, "y"))


def _coordinate(column: str, name: str) -> Column:
    value = strict(F.col(column), "float", name).cast("double")
    bad = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    message = F.concat(F.lit(f"{name} is not finite: "), F.col(column).cast("string"))
    return F.coalesce(F.when(bad, F.raise_error(message).cast("double")).otherwise(value), F.lit(0.0)).alias(name)


def points_from_lines(lines: DataFrame, line: str = "value", id: str | None = None) -> DataFrame:
    """Points from ``x,y`` lines; fields after the second are ignored."""
    fields = F.split(F.col(line), ",")
    columns = [F.get(fields, 0).alias("x"), F.get(fields, 1).alias("y")]
    return points_from(lines.select(*columns, *([id] if id else [])), "x", "y", id)


def read_points(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Points of text files; ids are line numbers from 0, going on from file to file in the order of paths."""
    return points_from_lines(numbered_lines(spark, path, "id"), id="id")
