import math
import random

import pytest
import sequential
from conftest import rows
from pyspark.sql import functions as F
from sequential import word

from lodestar.functions import bin_of, reservoir_key, sample_size, sticky_coin, sticky_rate, stream_bin
from lodestar.operators import frequent, report, reservoir, sticky
from lodestar.operators import sticky as sticky_module

PARAMS = (0.05, 0.02, 0.1)
RATE = sticky_rate(*PARAMS)


def make_items(n=6000, seed=4):
    """One item holds a third of the stream; one appears late only, one in two distant bursts."""
    rng = random.Random(seed)
    items = [77 if rng.random() < 1 / 3 else int(rng.paretovariate(0.6)) % 10**6 for _ in range(n)]
    for t in range(n - 400, n, 2):
        items[t] = -5
    for t in [*range(0, 60, 3), *range(n // 2, n // 2 + 90, 3)]:
        items[t] = -9
    return items


def items_frame(spark, items):
    data = list(enumerate(items))
    random.Random(0).shuffle(data)
    return spark.createDataFrame(data, "t bigint, item bigint").repartition(5)


@pytest.fixture(scope="module")
def stream():
    return make_items()


@pytest.fixture(scope="module")
def df(spark, stream):
    return items_frame(spark, stream)


def test_bins(spark):
    edges = [0, 1] + [int(RATE * 2**k) + d for k in range(1, 40) for d in (-1, 0, 1, 2)]
    frame = spark.createDataFrame([(t,) for t in edges], "t bigint")
    got = frame.select("t", stream_bin(F.col("t"), RATE).alias("b")).collect()
    assert all(r["b"] == bin_of(r["t"], RATE) for r in got)
    whole = 64.0  # boundaries that are integers
    frame = spark.createDataFrame([(64 * 2**k + d,) for k in range(45) for d in (-1, 0, 1)], "t bigint")
    got = frame.select("t", stream_bin(F.col("t"), whole).alias("b")).collect()
    assert all(r["b"] == bin_of(r["t"], whole) for r in got)
    assert [bin_of(t, 64.0) for t in (0, 127, 128, 255, 256)] == [0, 0, 1, 1, 2]


def test_sizes():
    assert sample_size(0.07) == 15
    assert sample_size(0.02) == 50
    assert sticky_rate(0.02, 0.01, 0.1) == pytest.approx(621.46, abs=0.01)
    assert 2 * sticky_rate(0.07, 0.03, 0.1) == pytest.approx(330.8, abs=0.1)


@pytest.mark.parametrize("n", [None, 4321, 10, 1])
def test_exact(df, stream, n):
    used = stream[:n]
    freqs = sorted((i, used.count(i)) for i in set(used))
    assert rows(frequent.item_freq(df, n)) == freqs
    assert rows(frequent.distinct_items(df, n)) == [(i,) for i, _ in freqs]
    assert frequent.distinct_item_count(df, n).first()[0] == len(freqs)
    assert frequent.largest_item(df, n).first()[0] == max(0, *used, 0)
    assert frequent.processed(df, n) == len(used)
    got = [tuple(r) for r in frequent.true_frequent(df, 0.05, n).collect()]
    assert got == sequential.true_items(used, 0.05)


def test_cap_beyond_the_stream(df, stream):
    assert frequent.processed(df, 10**9) == len(stream)
    assert rows(frequent.true_frequent(df, 0.05, 10**9)) == sequential.true_items(stream, 0.05)


def test_largest_of_negative_items(spark):
    assert frequent.largest_item(items_frame(spark, [-4, -2, -9])).first()[0] == 0


@pytest.mark.parametrize("n", [None, 4321, 7])
def test_reservoir(df, stream, n):
    phi = 0.05
    expected = sequential.reservoir(stream[:n], phi)
    assert rows(reservoir.reservoir_sample(df, phi, n)) == expected
    assert len(expected) == min(sample_size(phi), len(stream[:n]))
    true = {i for i, _ in sequential.true_items(stream[:n], phi)}
    marked = sorted((i, "+" if i in true else "-") for i in {e[2] for e in expected})
    got = [tuple(r) for r in reservoir.reservoir_marked(df, phi, n).collect()]
    assert got == marked


@pytest.mark.parametrize("m", [1, 50, 2500, 5999, 6000, 7000])
def test_large_samples(spark, stream, df, m):
    """The last key of the sample is found from counts of its bits; some keys are shared."""
    for key in (reservoir_key(42, F.col("t")), F.pmod("t", F.lit(40)) * 70000):
        ranked = df.withColumn("key", key.cast("bigint"))
        expected = rows(reservoir.smallest_ranks(ranked, m))
        assert rows(reservoir.smallest_ranks(ranked, m, task_rows=0)) == expected
        assert len(expected) == min(m, len(stream))


def test_equal_keys_do_not_prefer_early_items(spark):
    """With keys of 8 bits, many positions share the last key of the sample."""
    items = spark.range(100_000).select(F.col("id").alias("t"), F.col("id").alias("item"))
    ranked = items.withColumn("key", F.shiftright(reservoir_key(42, F.col("t")), 52))
    for task_rows in (0, 10**9):
        sample = reservoir.smallest_ranks(ranked, 50, task_rows=task_rows, bits=60)
        positions = sorted(r["t"] for r in sample.collect())
        assert positions[-1] > 80_000 and 30_000 < positions[25] < 70_000


def test_coins_of_late_bins(spark):
    """A coin of bin b wins exactly where the draw is below 2^(60 - b)."""
    draws = [word(42, "coin", 7, t) for t in range(4000)]
    df = spark.range(4000).select(F.col("id").alias("t"), F.lit(7).cast("bigint").alias("item"))
    for b in (5, 9, 30, 40, 60):
        won = {r["t"] for r in df.where(sticky_coin(42, F.col("item"), F.col("t"), F.lit(b))).collect()}
        assert won == {t for t, d in enumerate(draws) if d < 2 ** (60 - b)}
    fixed = spark.range(1).select(F.lit(7).cast("bigint").alias("item"), F.lit(3).cast("bigint").alias("t"))
    assert fixed.where(sticky_coin(42, F.col("item"), F.col("t"), F.lit(0))).count() == 1


def test_large_samples_are_not_merged_in_one_task(df):
    ranked = df.withColumn("key", reservoir_key(42, F.col("t")))
    large = reservoir.smallest_ranks(ranked, 2500, task_rows=2500)
    plan = large._jdf.queryExecution().executedPlan().toString()
    assert "limit=2500" not in plan.replace(" ", "")


@pytest.mark.parametrize("n", [None, 4321, int(2 * RATE), int(2 * RATE) + 1, int(2 * RATE) + 2, 3])
def test_sticky(df, stream, n):
    expected = sequential.sticky(stream[:n], *PARAMS)
    assert rows(sticky.sticky_table(df, *PARAMS, n)) == expected


@pytest.mark.parametrize("floor", [10, 1_000_000])
def test_sticky_with_many_tracked_items(df, stream, floor):
    """The tracked items are not broadcast; the hot item is treated apart."""
    got = rows(sticky.sticky_table(df, *PARAMS, broadcast_rows=0, floor=floor))
    assert got == sequential.sticky(stream, *PARAMS)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_sticky_guarantees(df, stream, seed):
    phi, epsilon, _ = PARAMS
    freq = {i: stream.count(i) for i in set(stream)}
    for item, est in rows(sticky.sticky_table(df, *PARAMS, seed=seed)):
        assert 0 < est <= freq[item]
    marked = rows(sticky.sticky_marked(df, *PARAMS, seed=seed))
    assert all(freq[item] >= (phi - epsilon) * len(stream) for item, _, _ in marked)
    true = {i for i, _ in sequential.true_items(stream, phi)}
    assert {item for item, _, mark in marked if mark == "+"} <= true
    assert 77 in {item for item, _, _ in marked}


def test_summary(df, stream):
    phi, epsilon, delta = PARAMS
    got = dict(rows(report.frequent_summary(df, *PARAMS)))
    table = dict(sequential.sticky(stream, *PARAMS))
    true = {i for i, _ in sequential.true_items(stream, phi)}
    sample = {e[2] for e in sequential.reservoir(stream, phi)}
    reported = {i for i, e in table.items() if e >= (phi - epsilon) * len(stream)}
    assert got == {
        "n_processed": len(stream),
        "table_size": len(set(stream)),
        "n_true": len(true),
        "reservoir_m": math.ceil(1 / phi),
        "reservoir_reported": len(sample),
        "reservoir_right": len(sample & true),
        "reservoir_wrong": len(sample - true),
        "sticky_size": len(table),
        "sticky_reported": len(reported),
        "sticky_right": len(reported & true),
        "sticky_wrong": len(reported - true),
    }


def test_published_size_of_the_sketch(spark):
    """n, phi, epsilon and delta of a known run; 8 frequent items, all of them reported."""
    phi, epsilon, delta, n = 0.07, 0.03, 0.1, 1_000_000
    hot = F.when(F.col("id") % 5 < 4, F.col("id") % 10 + 10**9).otherwise(F.xxhash64("id"))
    items = spark.range(n).select(F.col("id").alias("t"), hot.alias("item"))
    table = sticky.sticky_table(items, phi, epsilon, delta)
    assert table.count() <= 1.5 * 2 * sticky_rate(phi, epsilon, delta)
    marks = [r["mark"] for r in sticky.sticky_marked(items, phi, epsilon, delta).collect()]
    assert marks == ["+"] * 8


def test_mark(spark):
    estimates = spark.createDataFrame([(3,), (1,), (2,)], "item bigint")
    true = spark.createDataFrame([(2, 9)], "item bigint, freq bigint")
    for phi in (0.5, 1e-7):
        got = [tuple(r) for r in frequent.mark(estimates, true, phi).collect()]
        assert got == [(1, "-"), (2, "+"), (3, "-")]


def test_arguments(df):
    for params in ((0, 0.1, 0.1), (1, 0.1, 0.1), (0.5, 0, 0.1), (0.5, 0.1, 1), (0.1, 0.1, 0.1)):
        with pytest.raises(ValueError):
            sticky.sticky_table(df, *params)
    with pytest.raises(ValueError, match="r >= 1"):
        sticky_rate(0.99, 0.98, 0.99)
    with pytest.raises(ValueError):
        frequent.item_freq(df, 0)
    with pytest.raises(ValueError):
        frequent.true_frequent(df, 1.0)
    assert sticky_module.EMPTY_STATE == "item bigint, est bigint"


def test_bin_sizes(df, stream):
    bins = [bin_of(t, RATE) for t in range(4321)]
    got = rows(sticky.bin_sizes(df, *PARAMS, n=4321))
    assert got == sorted((b, bins.count(b)) for b in set(bins))
