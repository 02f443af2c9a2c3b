"""Global 0-based positions without a single-task sort."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .stage import stage


def with_position(
    df: DataFrame,
    order_by: Sequence[str],
    name: str,
    start: int = 0,
    stage: Callable[[DataFrame], DataFrame] = stage,
) -> DataFrame:
    """Add column ``name``: ``start`` plus the rank of the row under the unique ``order_by`` columns.

    Rows are range partitioned and numbered inside each partition; the sizes of
    the partitions, one row each, give the offsets. The numbered rows are staged
    because the range bounds are sampled and must be the same for both uses;
    ``stage`` tells where.
    """
    local = F.monotonically_increasing_id()
    numbered = stage(
        df.repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", local.bitwiseAND(F.lit((1 << 33) - 1)))
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        numbered.groupBy("_part")
        .agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    position = F.col("_offset") + F.col("_row") + F.lit(start)
    return (
        numbered.join(F.broadcast(offsets), "_part")
        .withColumn(name, position.cast("bigint"))
        .drop("_part", "_row", "_offset")
    )
