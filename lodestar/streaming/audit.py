"""Sticky tables of any prefix of a stream, recomputed from parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import check_frequent_params, sticky_rate
from ..operators.sticky import followed_by, part_table, sticky_part
from ..plans.stage import BatchStage, empty
from .runner import start
from .store import Progress

PART = "item bigint, bin int, n bigint, a bigint"


class StickyAudit:
    """Parts of a stream ``(t, item)`` with dense positions in arrival order, in a binary tree over its batches.

    A batch writes its own part, and each node of the tree whose last batch it is: the part of the first half
    followed by that of the second. So the table after any batch takes one part for each binary digit of the
    number of batches, and writing it costs a stream of k batches log k times its parts in all. All folders are
    named by the batch: one that runs again writes the same ones. They are kept, as any of them may be asked for.
    """

    def __init__(self, path: str, phi: float, epsilon: float, delta: float, seed: int = 42):
        check_frequent_params(phi, epsilon, delta)
        self.path, self.seed = path, seed
        self.rate = sticky_rate(phi, epsilon, delta)
        self.progress = Progress(f"{path}/progress", {"total": 0})

    def start(self, stream: DataFrame, every: str | None = None) -> StreamingQuery:
        return start(stream, self.on_batch, f"{self.path}/checkpoint", every=every)

    def _node(self, level: int, number: int) -> str:
        """The folder of the part of the batches from ``number << level`` on, ``1 << level`` of them."""
        return f"{self.path}/parts/{level}/{number}"

    def _read(self, spark: SparkSession, level: int, number: int) -> DataFrame:
        return spark.read.schema(PART).parquet(self._node(level, number))

    def on_batch(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        total = self.progress.after(spark, batch_id - 1)["total"]
        items = batch.select("t", "item").persist()
        try:
            n, first, last = items.agg(F.count("*"), F.min("t"), F.max("t")).first()
            if n and (first != total or last != total + n - 1):
                raise ValueError(f"batch {batch_id} holds positions from {first} to {last}, expected {n} from {total} on")
            stage = BatchStage(f"{self.path}/stage", batch_id)
            part = sticky_part(items, self.rate, self.seed, n, stage) if n else empty(spark, PART)
            part.select("item", F.col("bin").cast("int").alias("bin"), "n", "a").write.mode("overwrite").parquet(self._node(0, batch_id))
        finally:
            items.unpersist()
        level = 1
        while (batch_id + 1) % (1 << level) == 0:
            number = batch_id >> level
            halves = [self._read(spark, level - 1, 2 * number + k) for k in (0, 1)]
            followed_by(*halves).write.mode("overwrite").parquet(self._node(level, number))
            level += 1
        self.progress.save(spark, batch_id, total=total + n)

    def part(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """The part of all batches up to ``batch_id``."""
        done, parts = 0, []
        for level in range((batch_id + 1).bit_length() - 1, -1, -1):
            if (batch_id + 1) >> level & 1:
                parts.append(self._read(spark, level, done >> level))
                done += 1 << level
        return reduce(followed_by, parts) if parts else empty(spark, PART)

    def table(self, spark: SparkSession, batch_id: int | None = None) -> DataFrame:
        """``(item, est)`` after ``batch_id``, or after the last finished batch."""
        if batch_id is None:
            batch_id = self.progress.latest(spark)["batch_id"]
        part = self.part(spark, batch_id)
        n_items = part.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        return part_table(part, n_items, self.rate, self.seed)
