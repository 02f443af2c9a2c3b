"""Tables written by stream batches.

A batch may run again after a failure. Both stores overwrite by batch, so a
second run of a batch replaces the first and every item counts exactly once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.stage import empty


class BatchTable:
    """Rows added by the batches, merged every few batches.

    The rows of the last batches lie in a ring of folders, used in turn. Each
    ``every`` batches, ``merge`` reduces all rows so far to one table, which is
    written into one of two folders in turn. So the number of folders is fixed,
    nothing has to be deleted, and rows grow with what ``merge`` leaves only. A
    batch that runs again finds the merged table and the batches before it:
    the ring is twice as long as the way between two merges.
    """

    def __init__(
        self,
        path: str,
        schema: str,
        merge: Callable[[DataFrame], DataFrame] = lambda rows: rows,
        every: int = 16,
    ):
        self.path = path
        self.schema = schema
        self.names = [field.name for field in StructType.fromDDL(schema)]
        self.merge = merge
        self.every = every

    def save(self, df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        marked = df.select(*self.names, F.lit(batch_id).cast("bigint").alias("batch_id"))
        marked.write.mode("overwrite").parquet(f"{self.path}/ring/{batch_id % (2 * self.every)}")
        if (batch_id + 1) % self.every == 0:
            merged = self.merge(self.load(spark, batch_id))
            columns = [F.col(c) if c in merged.columns else F.lit(batch_id).cast("bigint").alias(c) for c in [*self.names, "batch_id"]]
            merged = merged.select(*columns, F.lit(batch_id).cast("bigint").alias("upto"))
            slot = (batch_id // self.every) % 2
            merged.write.mode("overwrite").parquet(f"{self.path}/merged/{slot}")

    def load(self, spark: SparkSession, last: int | None = None) -> DataFrame:
        """All rows (up to batch ``last``); empty before the first batch.

        Rows that are merged carry the id of a batch of theirs only if ``merge`` keeps it.
        """
        schema = f"{self.schema}, batch_id bigint"
        merged = _read(spark, f"{self.path}/merged/*", f"{schema}, upto bigint")
        recent = _read(spark, f"{self.path}/ring/*", schema)
        if last is not None:
            # A merge of this batch or a later one belongs to a run that is now repeated.
            merged, recent = merged.where(F.col("upto") < last), recent.where(F.col("batch_id") <= last)
        upto = merged.agg(F.max("upto")).first()[0]
        if upto is None:
            return recent
        return merged.where(F.col("upto") == upto).drop("upto").unionByName(recent.where(F.col("batch_id") > upto))


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty(spark, schema)


class SlotTable:
    """State replaced by each batch, in two folders used in turn.

    Batch k reads the folder of batch k-1 and overwrites the other one, so the
    state before a batch is still there when the batch has to run again, and
    old states need no deletion.
    """

    def __init__(self, path: str, schema: str):
        self.path = path
        self.schema = schema

    def _folder(self, batch_id: int) -> str:
        return f"{self.path}/slot{batch_id % 2}"

    def save(self, df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(self._folder(batch_id))

    def after(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """State after ``batch_id``; empty before the first batch."""
        if batch_id < 0:
            return empty(spark, self.schema)
        return spark.read.schema(self.schema).parquet(self._folder(batch_id))


    def latest(self, spark: SparkSession, order: str) -> DataFrame:
        """Of the rows of both folders, the one that is greatest by ``order``."""
        rows = _read(spark, f"{self.path}/slot*", self.schema)
        return rows.orderBy(F.desc(order)).limit(1)


class Progress:
    """One row for each batch: its id and the counters ``fields``.

    It is written last in a batch: a state is used only if its progress row exists.
    """

    def __init__(self, path: str, fields: dict[str, int]):
        self.start = fields
        self.columns = ["batch_id", *fields]
        self.table = SlotTable(path, ", ".join(f"{name} bigint" for name in self.columns))

    def save(self, spark: SparkSession, batch_id: int, **values: int) -> None:
        values = {"batch_id": batch_id, **values}
        row = spark.range(0, 1, 1, 1).select(
            *[F.lit(values[name]).cast("bigint").alias(name) for name in self.columns]
        )
        self.table.save(row, batch_id)

    def after(self, spark: SparkSession, batch_id: int) -> Row:
        if batch_id < 0:
            return Row(batch_id=-1, **self.start)
        row = self.table.after(spark, batch_id).first()
        if row is None or row["batch_id"] != batch_id:
            raise RuntimeError(f"{self.table.path} has no state of batch {batch_id}")
        return row

    def latest(self, spark: SparkSession) -> Row:
        """The row of the last finished batch."""
        return self.table.latest(spark, "batch_id").first() or self.after(spark, -1)
