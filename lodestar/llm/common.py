"""Helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..plans import stage

#: Words everywhere in this subpackage: runs without ASCII white space.
WHITE = " \t\n\x0b\x0c\r"
#: Characters of text that one task should get from an exchange.
TASK_CHARS = 24_000_000
#: Texts that a task holds as Python objects at once.
ROWS = 256
#: Bytes of a batch of rows on its way to Python.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column, folds: int) -> Column:
    """``crc32`` of the key as text, modulo ``folds``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % folds


def bound_batches(spark: SparkSession) -> None:
    """From now on batches for Python hold about ``BATCH_BYTES`` at most, or one row; what the session has set stays.

    Both sides hold a batch or more of each running task beside the heap, and Spark's own limit is 64 MB.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in spark.conf.getAll:
        spark.conf.set(name, str(BATCH_BYTES))


def give_back() -> None:
    """Return freed memory to the system: a Python worker that waits for its next task would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run`` for ``mapInArrow``, whose worker keeps none of its memory after a task."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return tidied


def map_rows(
    df: DataFrame,
    schema: str | StructType,
    start: Callable[[], Callable[[dict[str, list]], dict[str, list] | pa.RecordBatch]],
    rows: int | None = None,
) -> DataFrame:
    """``mapInArrow`` over columns: ``start()`` runs once per task and gives the function for each batch.

    The function takes and returns a dict of column lists (or numpy arrays). With ``rows``, it gets a batch
    in parts of at most so many rows, so that only these become Python objects at once.
    """
    out = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = start()
        for whole in batches:
            step = rows or max(1, whole.num_rows)
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                result = function({n: c.to_pylist() for n, c in zip(batch.schema.names, batch.columns)})
                yield pa.RecordBatch.from_arrays(
                    [pa.array(result[f.name], type=f.type) for f in arrow], schema=arrow
                )

    return df.mapInArrow(tidy(run), out)


def keep_rows(df: DataFrame, column: str, start: Callable[[], Callable[[list], list[bool]]]) -> DataFrame:
    """The rows, with all their columns, for whose values of ``column`` the function of ``start()`` says so.

    The function gets at most ``ROWS`` values at a time.
    """
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = start()
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                batch = whole.slice(first, ROWS)
                yield batch.filter(pa.array(function(batch.column(at).to_pylist()), pa.bool_()))

    return df.mapInArrow(tidy(run), df.schema)


def ranked(df: DataFrame, key: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Add ``name``: the 0-based rank of each row among those with its ``key``, by ``order``.

    Meant for narrow rows. A key may hold any share of the rows: they are range
    partitioned over key and order together and numbered inside each partition;
    only one row per key and partition is summed up for the offsets.
    """
    key, order = list(key), list(order)
    sorted_rows = (
        df.repartitionByRange(*key, *order)
        .sortWithinPartitions(*key, *order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    numbered = stage(sorted_rows)
    counts = numbered.groupBy(*key, "_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    # One row per key and partition: the join never meets a hot pair, AQE splits what is large.
    same = [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in [*key, "_part"]]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    rank = (F.col("n._row") - F.col("o._first") + F.col("o._before")).cast("bigint").alias(name)
    kept = [F.col(f"n.{c}") for c in df.columns]
    return numbered.alias("n").join(offsets.alias("o"), condition).select(*kept, rank)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it differ from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        found.append(name)
    return found


def buckets(total: int, each: int, at_least: int = 1) -> int:
    return max(at_least, math.ceil(total / max(1, each)))
