import random
import struct

import numpy as np
import pytest
from conftest import rows
from fixtures import LINE5, N15, SIMPLE9, brute_balls, points_frame, skewed_points
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.operators import grid, outliers

GOLDEN_BALLS = {
    ("simple9", 1.0): (SIMPLE9, [3, 4, 4, 3, 4, 3, 4, 3, 1]),
    ("n15", 1.0): (N15, [3, 1, 7, 7, 2, 2, 6, 6, 6, 6, 2, 2, 1, 2, 2]),
}


@pytest.mark.parametrize("key", GOLDEN_BALLS)
def test_golden_balls(spark, key):
    points, expected = GOLDEN_BALLS[key]
    got = rows(outliers.ball_counts(points_frame(spark, points), key[1]))
    assert got == list(enumerate(expected))
    assert brute_balls(points, key[1]) == expected


@pytest.mark.parametrize(
    ("points", "d", "m", "exact", "n_cells", "sure", "uncertain"),
    [(SIMPLE9, 1.0, 3, 5, 9, 1, 8), (SIMPLE9, 1.0, 2, 1, 9, 1, 8), (N15, 1.0, 3, 9, 11, 7, 4)],
)
def test_golden_outliers(spark, points, d, m, exact, n_cells, sure, uncertain):
    df = points_frame(spark, points)
    assert outliers.exact_outlier_count(df, d, m).first()[0] == exact
    assert outliers.exact_outliers(df, d, m).count() == exact
    assert grid.cell_sizes(df, d).count() == n_cells
    assert tuple(grid.outlier_summary(df, d, m).first()) == (sure, uncertain)
    assert outliers.point_count(df).first()[0] == len(points)


def test_smallest_cells(spark):
    got = grid.smallest_cells(points_frame(spark, N15), 1.0, 9).collect()
    assert [(r["size"], r["i"], r["j"]) for r in got] == [
        (1, 1, 2), (1, 1, 11), (1, 2, 2), (1, 2, 3), (1, 4, 9), (1, 4, 10),
        (1, 9, 13), (1, 11, 11), (1, 12, 12),
    ]


def test_neighbourhood_by_brute_force(spark):
    rng = np.random.default_rng(3)
    points = [tuple(p) for p in rng.normal(0, 6, (400, 2)).astype(np.float32).tolist()]
    cells = {(r["i"], r["j"]): r["size"] for r in grid.cell_sizes(points_frame(spark, points), 2.0).collect()}
    block = lambda i, j, k: sum(
        n for (a, b), n in cells.items() if abs(a - i) <= k and abs(b - j) <= k
    )
    expected = sorted((i, j, n, block(i, j, 1), block(i, j, 3)) for (i, j), n in cells.items())
    assert rows(grid.cell_neighbourhood(points_frame(spark, points), 2.0)) == expected


@pytest.mark.parametrize(("budget", "floor"), [(4096, 1_000_000), (16, 10)])
def test_skewed_points(spark, budget, floor):
    """Hot spots and hot copies, with cells split down and with hot keys treated apart."""
    points, d, m = skewed_points(), 4.0, 3
    df = points_frame(spark, points)
    expected = brute_balls(points, d)
    limits = {"budget": budget, "floor": floor}
    assert rows(outliers.ball_counts(df, d, **limits)) == list(enumerate(expected))
    found = rows(outliers.exact_outliers(df, d, m, **limits).select("id", "ball"))
    assert found == [(i, b) for i, b in enumerate(expected) if b <= m]
    assert len(found) > 50


def test_points_meet_in_tiles(spark):
    """No row is shuffled for a pair of cells; only the copies of points for their tiles are."""
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        rng = np.random.default_rng(9)
        points = [tuple(p) for p in rng.uniform(0, 60, (800, 2)).astype(np.float32).tolist()]
        found = outliers.ball_counts(points_frame(spark, points), 4.0)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(_ti" in plan and "hashpartitioning(ci" not in plan
        assert rows(found) == list(enumerate(brute_balls(points, 4.0)))
    finally:
        spark.conf.set(limit, before)


@pytest.mark.parametrize("few", [False, True])
def test_near_points_by_brute_force(spark, few):
    rng = np.random.default_rng(10)
    points = [tuple(p) for p in rng.uniform(-9, 9, (300, 2)).astype(np.float32).tolist()]
    weighted = grid.with_cell(points_frame(spark, points), 4.0).withColumn("w", F.col("id") + 1)
    own = weighted.where("id % 3 = 0")
    cells = {r["id"]: (r["i"], r["j"]) for r in weighted.collect()}
    expected = {}
    for a, (ax, ay) in enumerate(points):
        for b, (bx, by) in enumerate(points):
            apart = max(abs(cells[a][k] - cells[b][k]) for k in (0, 1)) > 1
            if a % 3 == 0 and apart and (ax - bx) ** 2 + (ay - by) ** 2 <= 16:
                expected[ax, ay] = expected.get((ax, ay), 0) + b + 1
    got = rows(outliers._compare_near(own, weighted, 4.0, few))
    assert got == sorted((x, y, part) for (x, y), part in expected.items())


def test_inside_pairs_of_full_cells(spark):
    """Dense uniform points: whole quarter cells lie within the distance."""
    rng = np.random.default_rng(5)
    points = [tuple(p) for p in rng.uniform(0, 3, (500, 2)).astype(np.float32).tolist()]
    df = points_frame(spark, points)
    assert rows(outliers.ball_counts(df, 1.0, budget=4)) == list(enumerate(brute_balls(points, 1.0)))


def test_many_wanted_cells_are_not_broadcast(spark, monkeypatch):
    from lodestar.plans import skew

    monkeypatch.setattr(skew, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(outliers, "BROADCAST_ROWS", 0)
    points, d, m = skewed_points(), 4.0, 3
    expected = [(i, b) for i, b in enumerate(brute_balls(points, d)) if b <= m]
    got = outliers.exact_outliers(points_frame(spark, points), d, m, budget=16, floor=10)
    assert rows(got.select("id", "ball")) == expected


def test_top_outliers_merge_copies(spark):
    points = [(0, 0), (0, 0), (10, 0), (20, 0), (20, 0.5), (30, 30), (30, 30), (30, 30)]
    df = points_frame(spark, points)
    got = [tuple(r) for r in outliers.top_outliers(df, 1.0, 2, 3).collect()]
    assert got == [(10.0, 0.0, 1), (0.0, 0.0, 2), (20.0, 0.0, 2)]
    assert outliers.exact_outlier_count(df, 1.0, 2).first()[0] == 5


def test_invariants(spark):
    points, d, m = skewed_points(11), 4.0, 5
    df = points_frame(spark, points)
    sure, uncertain = grid.outlier_summary(df, d, m).first()
    exact = outliers.exact_outliers(df, d, m)
    assert sure <= exact.count() <= sure + uncertain
    classes = grid.cell_classes(df, d, m)
    located = grid.with_cell(exact, d).join(classes, ["i", "j"])
    by_class = {r["class"]: r["count"] for r in located.groupBy("class").count().collect()}
    assert by_class.get("sure", 0) == sure
    assert "non_outlier" not in by_class


def test_no_points(spark):
    df = points_frame(spark, SIMPLE9).limit(0)
    assert tuple(grid.outlier_summary(df, 1.0, 3).first()) == (0, 0)
    assert outliers.exact_outlier_count(df, 1.0, 3).first()[0] == 0
    assert outliers.ball_counts(df, 1.0).count() == 0


def test_arguments(spark):
    df = points_frame(spark, LINE5)
    for bad in (0.0, -1.0, float("inf"), float("nan")):
        with pytest.raises(ValueError):
            grid.cell_sizes(df, bad)
        with pytest.raises(ValueError):
            outliers.exact_outliers(df, bad, 3)
    with pytest.raises(ValueError):
        outliers.exact_outliers(df, 1.0, -1)
    with pytest.raises(ValueError):
        grid.cell_classes(df, 1.0, -1)
    with pytest.raises(ValueError):
        outliers.top_outliers(df, 1.0, 3, 0)
    with pytest.raises(ValueError):
        grid.smallest_cells(df, 1.0, 0)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.tuples(st.integers(-8, 8), st.integers(-8, 8)).map(lambda p: (p[0] / 2, p[1] / 2)),
        min_size=1,
        max_size=40,
    ),
    st.sampled_from([0.5, 1.0, 2.5]),
    st.integers(0, 4),
    st.sampled_from([1, 8, 4096]),
)
def test_lattice_points(spark, points, d, m, budget):
    """Many pairs at exactly the distance."""
    df = points_frame(spark, points)
    expected = [(i, b) for i, b in enumerate(brute_balls(points, d)) if b <= m]
    assert rows(outliers.exact_outliers(df, d, m, budget=budget).select("id", "ball")) == expected


def test_tight_clusters_at_the_distance(spark, monkeypatch):
    """Two clusters whose distance is within a cell of D: pairs are settled by small cells, not one by one."""
    rng = random.Random(5)
    points = [(rng.random() * 0.3, rng.random() * 0.3) for _ in range(300)]
    points += [(10**4 + rng.random() * 0.3, rng.random() * 0.3) for _ in range(300)]
    compared = []
    compare = outliers._compare_points

    def counting(cells, pairs, distance):
        if "own_n" in pairs.columns:
            compared.append(pairs.agg(F.coalesce(F.max(F.col("own_n") * F.col("n")), F.lit(0))).first()[0])
        return compare(cells, pairs, distance)

    monkeypatch.setattr(outliers, "_compare_points", counting)
    df = points_frame(spark, points)
    got = rows(outliers.ball_counts(df, 10**4 + 0.15, budget=256))
    rounded = [(struct.unpack("f", struct.pack("f", x))[0], struct.unpack("f", struct.pack("f", y))[0]) for x, y in points]
    assert got == list(enumerate(brute_balls(rounded, 10**4 + 0.15)))
    assert compared and max(compared) <= 256
    assert len(compared) <= 12
