"""Item streams ``(t, item)``: ``t`` is the 0-based arrival position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

from ..plans.position import with_position
from .parse import strict
from .text import numbered_lines


def items_from(
    df: DataFrame,
    item: str | Column,
    t: str | None = None,
    order_by: Sequence[str] | None = None,
) -> DataFrame:
    """Items of a table.

    Give ``t`` where the table already carries dense 0-based positions: that
    costs no shuffle and also works on a streaming DataFrame. Otherwise
    ``order_by`` names unique ordering columns and positions are computed.
    """
    column = F.col(item) if isinstance(item, str) else item
    value = strict(column, "bigint", "item").alias("item")
    if t is not None:
        return df.select(F.col(t).cast("bigint").alias("t"), value)
    if not order_by:
        raise ValueError("give t or order_by")
    return with_position(df.select(*order_by, value), order_by, "t").select("t", "item")


def items_from_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """``(item)`` from lines with one integer each, static or streaming."""
    return lines.select(strict(F.trim(F.col(line)), "bigint", "item").alias("item"))


def read_items(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Items of text files: in the order of paths, and of the lines in a file."""
    lines = numbered_lines(spark, path, "t")
    return lines.select("t", strict(F.trim("value"), "bigint", "item").alias("item"))


def read_item_stream(reader: DataStreamReader, path: str, schema: str = "value string") -> DataFrame:
    """Streaming ``(item)`` replayed from text files; any other source goes through ``items_from_lines``."""
    return items_from_lines(reader.schema(schema).text(path))
