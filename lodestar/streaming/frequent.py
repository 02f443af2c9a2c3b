"""Frequent items of a stream: exact counts, reservoir and sticky sampling."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import (
    check_at_least,
    check_frequent_params,
    reservoir_key,
    sample_size,
    sticky_rate,
)
from ..operators.frequent import first_n, frequent, item_freq, mark
from ..operators.report import frequent_report
from ..operators.reservoir import smallest_ranks
from ..operators.sticky import EMPTY_STATE, advance, sticky_frequent
from ..plans.position import with_position
from ..plans.stage import BatchStage, empty
from .runner import run_until, start
from .store import BatchTable, Progress, SlotTable

SUMMARIES = ("exact", "reservoir", "sticky")


def item_freq_rows(path: str) -> BatchTable:
    latest = lambda rows: rows.groupBy("item").agg(F.max("freq").alias("freq"))
    return BatchTable(f"{path}/freq", "item bigint, freq bigint", latest)


def run_item_freq(
    stream: DataFrame, path: str, n: int | None = None, every: str | None = None
) -> StreamingQuery:
    """Exact counts in Spark's state store; each batch writes the counts it changed.

    ``stream`` is ``(t, item)`` with positions from the source, so that the first
    ``n`` items can be told before the aggregation.
    """
    return start(
        item_freq(stream, n),
        item_freq_rows(path).save,
        f"{path}/checkpoint-freq",
        output_mode="update",
        every=every,
    )


def stream_item_freq(spark: SparkSession, path: str) -> DataFrame:
    """``(item, freq)``: counts only grow, so the latest is the largest."""
    return item_freq_rows(path).load(spark).groupBy("item").agg(F.max("freq").alias("freq"))


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streaming queries started inside keep their state in RocksDB and write its changes only, batch by batch.

    Spark's default store holds all keys in the executors' memory; this one holds them on their disks.
    """
    prefix = "spark.sql.streaming.stateStore."
    wanted = {
        f"{prefix}providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        f"{prefix}rocksdb.changelogCheckpointing.enabled": "true",
    }
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def run_item_counts(stream: DataFrame, path: str, n: int | None = None, every: str | None = None) -> StreamingQuery:
    """Exact counts that live in Spark's state store only: a batch writes nothing else.

    ``stream`` is as for ``run_item_freq``; ``item_counts`` reads the store. For many items start it inside
    ``rocksdb_state``.
    """
    trigger = {"processingTime": every} if every else {"availableNow": True}
    counts = item_freq(stream, n).writeStream.outputMode("update").format("noop")
    return counts.option("checkpointLocation", f"{path}/checkpoint-counts").trigger(**trigger).start()


def item_counts(spark: SparkSession, path: str, batch_id: int | None = None) -> DataFrame:
    """``(item, freq)`` in the state store of ``run_item_counts`` after the last finished batch, or after ``batch_id``."""
    reader = spark.read.format("statestore")
    if batch_id is not None:
        reader = reader.option("batchId", batch_id)
    return reader.load(f"{path}/checkpoint-counts").select("key.item", F.col("value.count").alias("freq"))


class FrequentStream:
    """The three summaries of the first ``n`` items of a stream.

    ``path`` is a folder all executors share. The stream holds ``(t, item)``
    with dense positions (in arrival order, if sticky sampling is kept) or, with
    ``order_by``, the item and unique columns that order the rows inside a
    batch; positions then go on from batch to batch.
    """

    def __init__(
        self,
        path: str,
        phi: float,
        epsilon: float,
        delta: float,
        n: int | None = None,
        seed: int = 42,
        order_by: Sequence[str] | None = None,
        keep: Sequence[str] = SUMMARIES,
    ):
        check_frequent_params(phi, epsilon, delta)
        if n is not None:
            check_at_least(1, n=n)
        unknown = set(keep) - set(SUMMARIES)
        if unknown:
            raise ValueError(f"unknown summaries {sorted(unknown)}")
        self.path, self.phi, self.epsilon = path, phi, epsilon
        self.n, self.seed, self.order_by, self.keep = n, seed, order_by, tuple(keep)
        self.rate = sticky_rate(phi, epsilon, delta)
        summed = lambda rows: rows.groupBy("item").agg(F.sum("freq").alias("freq"))
        self.exact = BatchTable(f"{path}/exact", "item bigint, freq bigint", summed)
        self.sample = SlotTable(f"{path}/reservoir", "key bigint, t bigint, item bigint")
        self.table = SlotTable(f"{path}/sticky", EMPTY_STATE)
        self.progress = Progress(f"{path}/progress", {"total": 0, "last_bin": 0})
        self.total: int | None = None

    def start(self, stream: DataFrame, every: str | None = None) -> StreamingQuery:
        self.total = None
        return start(stream, self.on_batch, f"{self.path}/checkpoint", every=every)

    def run(self, stream: DataFrame, every: str) -> None:
        """Run a live query until ``n`` items are processed, also where they end inside a batch."""
        if self.n is None:
            raise ValueError("a live query without n has no end: start it and stop it")
        run_until(self.start(stream, every), lambda: self.total is not None and self.total >= self.n)

    def _positioned(self, batch: DataFrame, total: int, stage: BatchStage) -> DataFrame:
        if self.order_by is None:
            return batch.select("t", "item")
        return with_position(batch, self.order_by, "t", start=total, stage=stage).select("t", "item")

    def on_batch(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = self.progress.after(spark, batch_id - 1)
        total, last_bin = before["total"], before["last_bin"]
        ended = self.n is not None and total >= self.n
        stage = BatchStage(f"{self.path}/stage", batch_id)
        if ended:
            items = empty(spark, "t bigint, item bigint")
        else:
            items = first_n(self._positioned(batch, total, stage), self.n)
        items = items.persist()
        try:
            n_items, first, last = items.agg(F.count("*"), F.min("t"), F.max("t")).first()
            in_order = first == total and last == total + n_items - 1
            if "sticky" in self.keep and n_items and not in_order:
                raise ValueError(
                    f"batch {batch_id} holds {n_items} positions from {first} to {last}, "
                    f"expected {total} to {total + n_items - 1}"
                )
            if "exact" in self.keep and n_items:
                self.exact.save(item_freq(items), batch_id)
            if "reservoir" in self.keep:
                ranked = items.withColumn("key", reservoir_key(self.seed, F.col("t")))
                both = self.sample.after(spark, batch_id - 1).unionByName(
                    ranked.select("key", "t", "item")
                )
                self.sample.save(smallest_ranks(both, sample_size(self.phi), self.seed), batch_id)
            if "sticky" in self.keep:
                state = self.table.after(spark, batch_id - 1)
                table, last_bin = advance(
                    items, state, last_bin, total, n_items, self.rate, self.seed, stage=stage
                )
                self.table.save(table, batch_id)
        finally:
            items.unpersist()
        self.progress.save(spark, batch_id, total=total + n_items, last_bin=last_bin)
        self.total = total + n_items

    def n_processed(self, spark: SparkSession) -> int:
        """Items of the finished batches; may be asked while the query runs in this process."""
        if self.total is None:
            self.total = self.progress.latest(spark)["total"]
        return self.total

    def done(self, spark: SparkSession) -> bool:
        """Whether ``n`` items are processed, for a caller that stops a live query."""
        return self.n is not None and self.n_processed(spark) >= self.n

    def item_freq(self, spark: SparkSession) -> DataFrame:
        counts = self.exact.load(spark)
        return counts.groupBy("item").agg(F.sum("freq").alias("freq"))

    def true_frequent(self, spark: SparkSession) -> DataFrame:
        return frequent(self.item_freq(spark), self.phi, self.n_processed(spark))

    def reservoir(self, spark: SparkSession) -> DataFrame:
        return self.sample.after(spark, self.progress.latest(spark)["batch_id"])

    def sticky_table(self, spark: SparkSession) -> DataFrame:
        return self.table.after(spark, self.progress.latest(spark)["batch_id"])

    def reservoir_marked(self, spark: SparkSession) -> DataFrame:
        estimates = self.reservoir(spark).select("item").distinct()
        return mark(estimates, self.true_frequent(spark), self.phi)

    def sticky_marked(self, spark: SparkSession) -> DataFrame:
        reported = sticky_frequent(
            self.sticky_table(spark), self.phi, self.epsilon, self.n_processed(spark)
        )
        return mark(reported, self.true_frequent(spark), self.phi)

    def summary(self, spark: SparkSession) -> DataFrame:
        return frequent_report(
            self.item_freq(spark),
            self.reservoir(spark),
            self.sticky_table(spark),
            self.phi,
            self.epsilon,
            self.n_processed(spark),
        )
