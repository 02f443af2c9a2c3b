"""Uniform samples of fixed size, as the items with the smallest random ranks.

The m smallest of repeatable random ranks are a uniform m-sample. Samples of
parts merge into the sample of the whole, so each task keeps m rows only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import reservoir_key, reservoir_tie, sample_size
from ..functions.coins import BITS
from .frequent import first_n, mark, true_frequent


# Up to this many rows, of all tasks together, are merged in one task.
TASK_ROWS = 1_000_000
# The last key of a larger sample is found by so many bits at a time.
STEP_BITS = 15


def _bucket_of_rank(buckets: DataFrame, m: int) -> tuple[int, int]:
    """The bucket in which the running count reaches ``m``, and the count before it.

    ``buckets`` has a ``bucket`` of ``STEP_BITS`` bits for each row; rows beyond the end count as reached.
    """
    before = 0
    counts = sorted(buckets.groupBy("bucket").count().collect())
    for bucket, count in counts:
        if before + count >= m:
            return bucket, before
        before += count
    return 1 << STEP_BITS, before


def smallest_ranks(
    ranked: DataFrame, m: int, seed: int = 42, task_rows: int = TASK_ROWS, bits: int = BITS
) -> DataFrame:
    """The ``m`` rows with the smallest ``key``; equal keys follow in a random order too.

    Every task would keep m rows and one task merge them: where these are more
    than ``task_rows``, counts of the key's bits, from the high ones on, give the
    last key of the sample, and only the rows that share it are sorted.
    """
    ranked = ranked.select("key", "t", "item")
    tie = reservoir_tie(seed, F.col("t"))
    if m * ranked.rdd.getNumPartitions() <= task_rows:
        return ranked.orderBy("key", tie, "t").limit(m)
    last_key, taken, edge = 0, 0, ranked
    for left in range(bits - STEP_BITS, -1, -STEP_BITS):
        prefix = F.shiftright("key", left)
        bucket, more = _bucket_of_rank(edge.select(prefix.bitwiseAND((1 << STEP_BITS) - 1).alias("bucket")), m - taken)
        last_key, taken = (last_key << STEP_BITS) + bucket, taken + more
        edge = ranked.where(prefix == last_key)
    ties = ranked.where(F.col("key") == last_key).orderBy(tie, "t").limit(m - taken)
    return ranked.where(F.col("key") < last_key).unionByName(ties)


def reservoir_sample(items: DataFrame, phi: float, n: int | None = None, seed: int = 42) -> DataFrame:
    """``(key, t, item)``: a uniform sample of ceil(1/phi) positions."""
    ranked = first_n(items, n).withColumn("key", reservoir_key(seed, F.col("t")))
    return smallest_ranks(ranked, sample_size(phi), seed)


def reservoir_marked(items: DataFrame, phi: float, n: int | None = None, seed: int = 42) -> DataFrame:
    """``(item, mark)``: the distinct items of the sample against the true frequent items."""
    estimates = reservoir_sample(items, phi, n, seed).select("item").distinct()
    return mark(estimates, true_frequent(items, phi, n), phi)
