"""Sticky sampling: an epsilon-approximate frequent-item table of expected size 2/epsilon*ln(1/(delta*phi)).

An item enters the table at the first of its occurrences that wins a coin of
probability 2^-bin and is counted from there on. When a new bin starts, every
entry loses a geometric number of counts and leaves at 0. Given the positions,
an item's entry depends on its own occurrences and coins only, so the table is
a fold over the bins of each item.

Only items that win a coin, or are already in the table, can be in the result.
Winners number about 2r in bin 0 and r in each later bin, however long the
stream. So one pass over the items finds the winners, and a second one counts
the occurrences of these few items.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import (
    bin_of,
    check_frequent_params,
    sticky_coin,
    sticky_rate,
    sticky_tau,
    stream_bin,
)
from ..plans.skew import BROADCAST_ROWS, HOT_FLOOR, join_sized
from ..plans.stage import empty, stage
from .frequent import first_n, mark, processed, true_frequent

EMPTY_STATE = "item bigint, est bigint"


def _by_bin(table: DataFrame, value: Column, name: str) -> DataFrame:
    """One row per item with a map from bin to ``value``; there are at most 64 bins."""
    entries = F.collect_list(F.struct("bin", value.alias("value")))
    return table.groupBy("item").agg(F.map_from_entries(entries).alias(name))


def advance(
    items: DataFrame,
    state: DataFrame,
    last_bin: int,
    n_before: int,
    n_items: int,
    rate: float,
    seed: int,
    broadcast_rows: int = BROADCAST_ROWS,
    floor: int = HOT_FLOOR,
    stage: Callable[[DataFrame], DataFrame] = stage,
) -> tuple[DataFrame, int]:
    """Table ``(item, est)`` after ``n_items`` further items at positions ``n_before`` and up.

    ``state`` is the table before them and ``last_bin`` the bin it stands at;
    ``stage`` tells where the items to follow are kept. Returns the new table and its bin.
    """
    if n_items == 0:
        return state, last_bin
    new_bin = bin_of(n_before + n_items - 1, rate)
    binned = items.select("t", "item", stream_bin(F.col("t"), rate).alias("bin"))
    wins = (
        binned.where(sticky_coin(seed, F.col("item"), F.col("t"), F.col("bin")))
        .groupBy("item", "bin")
        .agg(F.min("t").alias("first_win"))
    )
    tracked = stage(
        _by_bin(wins, F.col("first_win"), "first_wins").join(state, "item", "full_outer")
    )
    firsts = tracked.select("item", "first_wins")
    # No more items are tracked than have been seen.
    if n_before + n_items <= broadcast_rows or tracked.count() <= broadcast_rows:
        followed = binned.join(F.broadcast(firsts), "item")
    else:
        sizes = binned.groupBy("item").agg(F.count("*").alias("size"))
        followed = join_sized(binned, firsts.join(sizes, "item"), ["item"], "size", n_items, floor)
    counts = followed.groupBy("item", "bin").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("t") >= F.col("first_wins")[F.col("bin")]).alias("a"),
    )
    return _folded(tracked.select("item", "est"), counts, last_bin, new_bin, seed), new_bin


def _folded(
    entries: DataFrame, counts: DataFrame, last_bin: int, new_bin: int, seed: int
) -> DataFrame:
    """Table ``(item, est)`` at ``new_bin`` from ``entries`` at ``last_bin`` and ``counts`` (item, bin, n, a) since."""
    per_item = _by_bin(counts, F.struct("n", "a"), "counts")

    def step(est: Column, b: Column) -> Column:
        lost = F.when(b > last_bin, sticky_tau(seed, F.col("item"), b)).otherwise(F.lit(0))
        kept = F.greatest(est - lost.cast("bigint"), F.lit(0).cast("bigint"))
        seen = F.col("counts")[b]
        return F.when(kept > 0, kept + F.coalesce(seen["n"], F.lit(0))).otherwise(
            F.coalesce(seen["a"], F.lit(0))
        )

    start = F.coalesce("est", F.lit(0)).cast("bigint")
    bins = F.sequence(F.lit(last_bin), F.lit(new_bin))
    folded = entries.join(per_item, "item", "left").select(
        "item", F.aggregate(bins, start, step).alias("est")
    )
    return folded.where(F.col("est") > 0)


# What a part of a stream tells of the table, whatever came before it. For each item and bin: its occurrences
# ``n`` in the part, and ``a`` from the first one on that wins its coin there (0 without one). Parts that follow
# each other compose associatively: once an item has won, all later occurrences in the bin count.


def sticky_part(
    items: DataFrame,
    rate: float,
    seed: int,
    n_items: int,
    stage: Callable[[DataFrame], DataFrame] = stage,
    broadcast_rows: int = BROADCAST_ROWS,
    floor: int = HOT_FLOOR,
) -> DataFrame:
    """``(item, bin, n, a)`` of a part of a stream with ``n_items`` rows."""
    binned = items.select("t", "item", stream_bin(F.col("t"), rate).alias("bin"))
    wins = (
        binned.where(sticky_coin(seed, F.col("item"), F.col("t"), F.col("bin")))
        .groupBy("item", "bin")
        .agg(F.min("t").alias("first_win"))
    )
    wins = stage(wins)
    sizes = binned.groupBy("item", "bin").agg(F.count("*").alias("n"))
    if n_items <= broadcast_rows or wins.count() <= broadcast_rows:
        followed = binned.join(F.broadcast(wins), ["item", "bin"])
    else:
        followed = join_sized(
            binned, wins.join(sizes, ["item", "bin"]), ["item", "bin"], "n", n_items, floor
        )
    won = followed.groupBy("item", "bin").agg(
        F.count_if(F.col("t") >= F.col("first_win")).alias("a")
    )
    a = F.coalesce("a", F.lit(0)).cast("bigint").alias("a")
    return sizes.join(won, ["item", "bin"], "left").select("item", "bin", "n", a)


def followed_by(first: DataFrame, second: DataFrame) -> DataFrame:
    """The part that ``first`` and ``second``, which comes next, make together."""
    one = first.select("item", "bin", F.col("n").alias("n1"), F.col("a").alias("a1"))
    two = second.select("item", "bin", F.col("n").alias("n2"), F.col("a").alias("a2"))
    n1, a1, n2, a2 = (F.coalesce(c, F.lit(0).cast("bigint")) for c in ("n1", "a1", "n2", "a2"))
    a = F.when(a1 > 0, a1 + n2).otherwise(a2)
    return one.join(two, ["item", "bin"], "full_outer").select(
        "item", "bin", (n1 + n2).alias("n"), a.alias("a")
    )


def part_table(part: DataFrame, n_items: int, rate: float, seed: int) -> DataFrame:
    """Table ``(item, est)`` of a stream of ``n_items`` items from its ``part``, which begins at position 0."""
    if not n_items:
        return empty(part.sparkSession, EMPTY_STATE)
    # Only items that have won somewhere can be in the table.
    winners = part.where(F.col("a") > 0).select("item").distinct()
    entries = winners.withColumn("est", F.lit(0).cast("bigint"))
    counts = part.join(winners, "item", "left_semi")
    return _folded(entries, counts, 0, bin_of(n_items - 1, rate), seed)


def bin_sizes(
    items: DataFrame, phi: float, epsilon: float, delta: float, n: int | None = None
) -> DataFrame:
    """``(bin, n)``: stream positions in each bin."""
    check_frequent_params(phi, epsilon, delta)
    bins = stream_bin(F.col("t"), sticky_rate(phi, epsilon, delta)).alias("bin")
    return first_n(items, n).groupBy(bins).agg(F.count("*").alias("n"))


def sticky_table(
    items: DataFrame,
    phi: float,
    epsilon: float,
    delta: float,
    n: int | None = None,
    seed: int = 42,
    n_processed: int | None = None,
    **limits: int,
) -> DataFrame:
    """``(item, est)`` after the first ``n`` items; ``n_processed`` is their number, where it is known."""
    check_frequent_params(phi, epsilon, delta)
    rate = sticky_rate(phi, epsilon, delta)
    start = empty(items.sparkSession, EMPTY_STATE)
    used = first_n(items, n)
    if n_processed is None:
        n_processed = processed(items, n)
    return advance(used, start, 0, 0, n_processed, rate, seed, **limits)[0]


def sticky_frequent(table: DataFrame, phi: float, epsilon: float, n_processed: int) -> DataFrame:
    """Entries with est >= (phi-epsilon)*n: all true frequent items, with probability 1-delta."""
    return table.where(F.col("est") >= F.lit((phi - epsilon) * n_processed))


def sticky_marked(
    items: DataFrame,
    phi: float,
    epsilon: float,
    delta: float,
    n: int | None = None,
    seed: int = 42,
    **limits: int,
) -> DataFrame:
    """``(item, est, mark)``: the reported items against the true frequent items, ascending."""
    n_processed = processed(items, n)
    table = sticky_table(items, phi, epsilon, delta, n, seed, n_processed, **limits)
    reported = sticky_frequent(table, phi, epsilon, n_processed)
    return mark(reported, true_frequent(items, phi, n), phi)
