"""One-table reports ``(metric, value)`` of the item operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sample_size
from ..plans.stage import stage
from .frequent import frequent, item_freq, mark
from .reservoir import reservoir_sample
from .sticky import sticky_frequent, sticky_table


def metrics(df: DataFrame, **values: Column) -> DataFrame:
    """Aggregate ``df`` to one ``(metric, value)`` row for each of ``values``."""
    names = list(values)
    row = df.agg(*[values[name].cast("bigint").alias(name) for name in names])
    return row.unpivot([], names, "metric", "value")


def frequent_report(
    freqs: DataFrame,
    sample: DataFrame,
    table: DataFrame,
    phi: float,
    epsilon: float,
    n_processed: int,
) -> DataFrame:
    """Sizes of the three summaries and how many of their reports are right."""
    true_items = stage(frequent(freqs, phi, n_processed))
    table = stage(table)
    from_sample = mark(sample.select("item").distinct(), true_items, phi)
    from_table = mark(sticky_frequent(table, phi, epsilon, n_processed), true_items, phi)
    right, wrong = F.count_if(F.col("mark") == "+"), F.count_if(F.col("mark") == "-")
    rows = [
        metrics(
            freqs,
            n_processed=F.coalesce(F.sum("freq"), F.lit(0)),
            table_size=F.count("*"),
        ),
        metrics(true_items, n_true=F.count("*")),
        metrics(
            from_sample, reservoir_reported=F.count("*"), reservoir_right=right, reservoir_wrong=wrong
        ),
        metrics(table, sticky_size=F.count("*"), reservoir_m=F.lit(sample_size(phi))),
        metrics(from_table, sticky_reported=F.count("*"), sticky_right=right, sticky_wrong=wrong),
    ]
    return reduce(DataFrame.unionByName, rows)


def frequent_summary(
    items: DataFrame,
    phi: float,
    epsilon: float,
    delta: float,
    n: int | None = None,
    seed: int = 42,
) -> DataFrame:
    # Three kinds of scans: for the frequencies, the sample and the sticky table (two of these).
    freqs = stage(item_freq(items, n))
    n_processed = freqs.agg(F.coalesce(F.sum("freq"), F.lit(0))).first()[0]
    return frequent_report(
        freqs,
        reservoir_sample(items, phi, n, seed),
        sticky_table(items, phi, epsilon, delta, n, seed, n_processed=n_processed),
        phi,
        epsilon,
        n_processed,
    )


def stream_report(sizes: DataFrame, items: DataFrame) -> DataFrame:
    """Items processed, distinct items and largest item (at least 0)."""
    largest = F.greatest(F.coalesce(F.max("item"), F.lit(0)), F.lit(0))
    return metrics(sizes, n_processed=F.coalesce(F.sum("n"), F.lit(0))).unionByName(
        metrics(items, n_distinct=F.count("*"), largest=largest)
    )
