"""Distinct items, largest item and batch sizes of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.report import metrics, stream_report
from .runner import run_until, start
from .store import BatchTable, Progress, SlotTable


def _new_items(path: str) -> BatchTable:
    return BatchTable(f"{path}/distinct", "item bigint", lambda rows: rows.select("item").distinct())


def run_distinct(stream: DataFrame, path: str, every: str | None = None) -> StreamingQuery:
    """Write each item once, in the batch it first appears in. Spark's state store holds the seen items."""
    table = _new_items(path)
    return start(
        stream.select("item").dropDuplicates(["item"]),
        table.save,
        f"{path}/checkpoint-distinct",
        every=every,
    )


def distinct_rows(spark: SparkSession, path: str) -> DataFrame:
    return _new_items(path).load(spark).select("item").distinct()


class SizedStream:
    """Batch sizes and items of a stream that ends after the first batch at or past ``threshold``.

    The batch that crosses the threshold counts as a whole; later ones are ignored.
    """

    def __init__(self, path: str, threshold: int | None = None):
        self.path = path
        self.threshold = threshold
        self.sizes = BatchTable(f"{path}/sizes", "n bigint, at timestamp")
        self.items = BatchTable(f"{path}/items", "item bigint", lambda rows: rows.select("item").distinct())
        self.progress = Progress(f"{path}/progress", {"total": 0})
        self.total: int | None = None

    def start(self, stream: DataFrame, every: str | None = None) -> StreamingQuery:
        self.total = None
        # In a stream this is the time in the query's own log: a batch that runs again has the same.
        timed = stream.select("item", F.current_timestamp().alias("at"))
        return start(timed, self.on_batch, f"{self.path}/checkpoint-sizes", every=every)

    def run(self, stream: DataFrame, every: str) -> None:
        """Run a live query to the threshold."""
        if self.threshold is None:
            raise ValueError("a live query without a threshold has no end: start it and stop it")
        run_until(self.start(stream, every), lambda: self.total is not None and self.done(stream.sparkSession))

    def on_batch(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        total = self.progress.after(spark, batch_id - 1)["total"]
        if self.threshold is None or total < self.threshold:
            batch = batch.select("item", "at").persist()
            try:
                n, at = batch.agg(F.count("*"), F.max("at")).first()
                if n > 0:
                    size = spark.range(0, 1, 1, 1).select(
                        F.lit(n).cast("bigint").alias("n"), F.lit(at).alias("at")
                    )
                    self.items.save(batch.select("item").distinct(), batch_id)
                    self.sizes.save(size, batch_id)
            finally:
                batch.unpersist()
            total += n
        self.progress.save(spark, batch_id, total=total)
        self.total = total

    def done(self, spark: SparkSession) -> bool:
        """Whether the threshold is reached, for a caller that stops a live query."""
        if self.total is None:
            self.total = self.progress.latest(spark)["total"]
        return self.threshold is not None and self.total >= self.threshold


def batch_sizes(spark: SparkSession, path: str) -> DataFrame:
    """``(batch_id, n, at)`` of the non-empty batches; ``at`` is when the query took the batch up."""
    return SizedStream(path).sizes.load(spark).select("batch_id", "n", "at")


def distinct_report(spark: SparkSession, path: str) -> DataFrame:
    """Items processed, distinct items and largest item as ``(metric, value)``."""
    sized = SizedStream(path)
    return stream_report(
        sized.sizes.load(spark), sized.items.load(spark).select("item").distinct()
    )


def run_distinct_summary(stream: DataFrame, path: str, every: str | None = None) -> StreamingQuery:
    """Number of distinct items and the largest, kept by Spark's state stores alone.

    One store holds the seen items, one the two numbers; a batch writes one row, and none of the items.
    """
    table = _summary(path)
    numbers = stream.select("item").dropDuplicates(["item"]).agg(F.count("*").alias("n_distinct"), F.max("item").alias("largest"))

    def save(batch: DataFrame, batch_id: int) -> None:
        table.save(batch.withColumn("batch_id", F.lit(batch_id).cast("bigint")), batch_id)

    return start(numbers, save, f"{path}/checkpoint-summary", output_mode="complete", every=every)


def _summary(path: str) -> SlotTable:
    return SlotTable(f"{path}/summary", "n_distinct bigint, largest bigint, batch_id bigint")


def distinct_summary(spark: SparkSession, path: str) -> DataFrame:
    """``(metric, value)`` after the last finished batch; the largest item is at least 0."""
    last = _summary(path).latest(spark, "batch_id")
    largest = F.greatest(F.coalesce(F.max("largest"), F.lit(0)), F.lit(0))
    return metrics(last, n_distinct=F.coalesce(F.max("n_distinct"), F.lit(0)), largest=largest)
