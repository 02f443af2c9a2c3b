"""Exact item frequencies, distinct items, true frequent items and marks of estimates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import check_at_least, check_fraction


def first_n(items: DataFrame, n: int | None) -> DataFrame:
    """The first ``n`` items of the stream; all without ``n``."""
    if n is None:
        return items
    check_at_least(1, n=n)
    return items.where(F.col("t") < n)


def item_freq(items: DataFrame, n: int | None = None) -> DataFrame:
    """``(item, freq)``."""
    return first_n(items, n).groupBy("item").agg(F.count("*").alias("freq"))


def distinct_items(items: DataFrame, n: int | None = None) -> DataFrame:
    return first_n(items, n).select("item").distinct()


def distinct_item_count(items: DataFrame, n: int | None = None) -> DataFrame:
    return distinct_items(items, n).agg(F.count("*").alias("n_distinct"))


def largest_item(items: DataFrame, n: int | None = None) -> DataFrame:
    """The largest item, at least 0: a stream of negative items has largest item 0."""
    largest = F.greatest(F.coalesce(F.max("item"), F.lit(0)), F.lit(0)).cast("bigint")
    return first_n(items, n).agg(largest.alias("largest"))


def processed(items: DataFrame, n: int | None = None) -> int:
    """Number of items really processed: ``n``, or fewer where the stream ends before."""
    return first_n(items, n).count()


def frequent(freqs: DataFrame, phi: float, n_processed: int) -> DataFrame:
    """Items with freq >= phi*n; there are at most 1/phi of them."""
    check_fraction(phi=phi)
    return freqs.where(F.col("freq") >= F.lit(phi * n_processed)).orderBy("item")


def true_frequent(items: DataFrame, phi: float, n: int | None = None) -> DataFrame:
    """``(item, freq)`` of the true frequent items, ascending."""
    return frequent(item_freq(items, n), phi, processed(items, n))


def mark(estimates: DataFrame, true_items: DataFrame, phi: float) -> DataFrame:
    """Add ``mark``: ``+`` for a true frequent item, ``-`` for any other; ascending by item."""
    known = true_items.select("item", F.lit("+").alias("hit"))
    if phi >= 1e-5:  # at most 100,000 rows
        known = F.broadcast(known)
    return (
        estimates.join(known, "item", "left")
        .withColumn("mark", F.coalesce("hit", F.lit("-")))
        .drop("hit")
        .orderBy("item")
    )
