import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from lodestar.llm import topk

SCHEMA = "vec_id bigint, embedding array<double>, label int, score string, `rank` string"


def frame(spark, vectors, parts=3):
    return spark.createDataFrame([(i, v, k, "s", "r") for k, (i, v) in enumerate(vectors)], SCHEMA).repartition(parts)


def brute(vectors, every=5, k=10):
    usable = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    found = []
    for a, (query, q) in enumerate(usable):
        if query % every == 0:
            scores = [(-sum(x * y for x, y in zip(q, v)), i) for b, (i, v) in enumerate(usable) if a != b and len(v) == len(q)]
            clipped = sorted((-min(max(-s, -(1 << 63)), (1 << 63) - 1), i) for s, i in scores)
            found += [(query, rank + 1, i, -s) for rank, (s, i) in enumerate(clipped[:k])]
    return sorted(found)


def search(df, every=5, k=10):
    return topk.top_k(df, F.col("vec_id") % every == 0, k)


@pytest.mark.parametrize("seed", range(3))
def test_brute_force(spark, monkeypatch, seed):
    """Random vectors, many exact and near copies, small blocks and several shards."""
    monkeypatch.setattr(topk, "LEAST_ROWS", 60)
    monkeypatch.setattr(topk, "BLOCK_ROWS", [16, 50, 1000][seed])
    monkeypatch.setattr(topk, "BATCH_QUERIES", 7)
    monkeypatch.setattr(topk, "PAIRS", 100)
    rng = np.random.default_rng(seed)
    found = rng.normal(size=(300, 12)) / 3
    hot = rng.normal(size=12)
    vectors = [(int(i), v.tolist()) for i, v in zip(rng.permutation(300), found)]
    vectors += [(1000 + k, hot.tolist()) for k in range(150)]
    vectors += [(2000 + k, (hot + rng.normal(size=12) / 500).tolist()) for k in range(100)]
    assert rows(search(frame(spark, vectors))) == brute(vectors)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(0, [1.0, 2.0]), (5, None), (10, [1.0, None]), (15, [nan, 1.0]), (20, [inf, 0.0]), (25, []), (30, []), (35, [0.5])]
    vectors += [(None, [9.0, 9.0]), (40, [1.0, 2.0]), (40, [1.0, 2.0]), (41, [-1.0, 3.0]), (-5, [0.0, -0.1]), (45, [0.0, 0.0]), (50, [-0.0001, 0.0])]
    assert rows(search(frame(spark, vectors))) == brute(vectors)
    assert rows(search(frame(spark, vectors), k=1)) == brute(vectors, k=1)
    assert search(frame(spark, vectors).where("false")).count() == 0
    assert search(frame(spark, [(0, [1.0])])).count() == 0


def test_ties_go_to_the_smaller_id(spark):
    vectors = [(k, [1.0, -1.0, 0.5]) for k in random.Random(3).sample(range(400), 200)]
    got = search(frame(spark, vectors))
    assert rows(got) == brute(vectors)


def test_large_values(spark):
    """Sums beyond 2^53, and scores beyond 64 bits."""
    rng = np.random.default_rng(4)
    vectors = [(k, (v * 10.0 ** rng.integers(0, 7)).tolist()) for k, v in enumerate(rng.normal(size=(120, 5)))]
    assert rows(search(frame(spark, vectors))) == brute(vectors)
    vectors = [(k, (v * 1e12).tolist()) for k, v in enumerate(rng.normal(size=(60, 4)))]
    assert rows(search(frame(spark, vectors))) == brute(vectors)


def test_bounds_hold_at_every_depth():
    """No reading puts a row out that belongs to the best; most rows are out before they are resolved."""
    rng = np.random.default_rng(5)
    found = np.floor(1024 * rng.normal(size=(4000, 16)) / 4).astype(np.int64)
    lists = topk.Lists(np.arange(4000), np.arange(4000), found)
    resolved = []
    scores = lists.scores
    lists.scores = lambda q, r, e: resolved.append(len(q)) or scores(q, r, e)
    q, ids, score = lists.best(found[:100], np.arange(100), 10)
    exact = found[:100] @ found.T
    exact[np.arange(100), np.arange(100)] = -(1 << 60)
    for k in range(100):
        order = np.lexsort((np.arange(4000), -exact[k]))[:10]
        assert ids[q == k].tolist() == order.tolist() and score[q == k].tolist() == exact[k][order].tolist()
    assert sum(resolved) < 100 * 4000 / 4
