"""Documents: one text line is one document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.skew import BROADCAST_ROWS
from ..plans.splits import fixed_splits
from ..plans.stage import stage


def numbered_lines(spark: SparkSession, path: str | list[str], name: str) -> DataFrame:
    """``(value, name)``: lines with their numbers from 0, in the order of paths and of the lines in a file.

    A first scan counts the lines of each file block; sums over the blocks, a row
    for each, tell the number of a block's first line, and in a block, which one
    task reads in order, row ids grow with the lines. So no line is moved. The
    splits are the same for both scans (``fixed_splits``).
    """
    block = {"_path": F.col("_metadata.file_path"), "_start": F.col("_metadata.file_block_start")}
    lines = fixed_splits(
        spark,
        lambda own: own.read.text(path).select(
            "value", *[c.alias(n) for n, c in block.items()], F.monotonically_increasing_id().alias("_row")
        ),
    )
    blocks = stage(lines.groupBy(*block).agg(F.count("*").alias("_n"), F.min("_row").alias("_first")))
    before = Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    places = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    if blocks.count() <= BROADCAST_ROWS:
        places = F.broadcast(places)
    placed = lines.join(places, list(block), "left")
    row = F.col("_row") - F.col("_first")
    known = (row >= 0) & (row < F.col("_n"))
    changed = F.raise_error(F.concat(F.lit("a file changed while it was read: "), F.col("_path"))).cast("bigint")
    number = F.when(known, (F.col("_before") + row).cast("bigint")).otherwise(changed)
    return placed.select("value", F.coalesce(number, F.lit(0)).alias(name))


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(line)`` for each line of the text files."""
    return spark.read.text(path).select(F.col("value").alias("line"))


def lines_from(df: DataFrame, text: str, keep: Sequence[str] = ()) -> DataFrame:
    """``(line)`` for each line of a text column; with ``keep`` also these columns and the number ``line_no`` of the line.

    Lines end with LF, CRLF or CR as in a text file; a final line break opens no
    further line. Regular expressions run only on texts with a CR.
    """
    body = F.col(text)
    body = F.when(F.contains(body, F.lit("\r")), F.regexp_replace(body, "\\r\\n?", "\n")).otherwise(body)
    lines = df.where(F.col(text) != "").select(body.alias("body"), *keep)
    whole = F.when(
        F.endswith("body", F.lit("\n")), F.substring("body", F.lit(1), F.length("body") - 1)
    ).otherwise(F.col("body"))
    if keep:
        return lines.select(*keep, F.posexplode(F.split(whole, "\n")).alias("line_no", "line"))
    return lines.select(F.explode(F.split(whole, "\n")).alias("line"))
