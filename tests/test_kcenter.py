import math

import numpy as np
import pytest
from conftest import rows
from fixtures import LINE5, N15, points_frame, skewed_points

from lodestar.operators import grid, kcenter, outliers


@pytest.mark.parametrize(
    ("points", "k", "centers", "radius"),
    [
        (LINE5, 1, [(0, 0)], 7),
        (LINE5, 2, [(0, 0), (7, 0)], 3),
        (LINE5, 3, [(0, 0), (7, 0), (3, 0)], 1),
        (N15, 2, [(0.4, 0.9), (4.32, 4.3)], 3.308187),
        (N15, 3, [(0.4, 0.9), (4.32, 4.3), (1.11, 5.1)], 1.941649),
        (N15, 4, [(0.4, 0.9), (4.32, 4.3), (1.11, 5.1), (1.51, 3.2)], 1.171367),
    ],
)
def test_golden(spark, points, k, centers, radius):
    df = points_frame(spark, points)
    chosen = kcenter.kcenter_centers(df, k, 1)
    got = chosen.orderBy("ord").collect()
    assert [(r["x"], r["y"]) for r in got] == [pytest.approx(c, abs=1e-6) for c in centers]
    assert kcenter.cluster_radius(df, chosen, k).first()[0] == pytest.approx(radius, abs=1e-5)


def sequential(points, k):
    """Farthest-first traversal of ``(id, x, y)`` in id order."""
    points = sorted(points)
    chosen = [points[0]]
    dist = lambda p, c: (p[1] - c[1]) ** 2 + (p[2] - c[2]) ** 2
    while len(chosen) < k:
        best = max(points, key=lambda p: (min(dist(p, c) for c in chosen), -p[0]))
        if min(dist(best, c) for c in chosen) == 0:
            break
        chosen.append(best)
    return chosen


@pytest.mark.parametrize("part_rows", [2_000_000, 1])
def test_coreset_and_centers(spark, part_rows):
    df = points_frame(spark, skewed_points()).repartition(5)
    data = rows(df)
    k, parts = 5, 3
    expected = [
        (part, ord_, *p)
        for part in range(parts)
        for ord_, p in enumerate(sequential([p for p in data if p[0] % parts == part], k))
    ]
    assert rows(kcenter.kcenter_coreset(df, k, parts, part_rows)) == expected
    centers = sequential([row[2:] for row in expected], k)
    got = rows(kcenter.kcenter_centers(df, k, parts, part_rows))
    assert got == [(ord_, *p) for ord_, p in enumerate(centers)]


def test_few_distinct_points(spark):
    """Parts with fewer distinct points than k and empty parts give fewer centers."""
    df = points_frame(spark, [(0, 0), (0, 0), (5, 0), (0, 0), (5, 0), (5, 0)])
    for part_rows in (2_000_000, 1):
        assert kcenter.kcenter_coreset(df, 6, 1, part_rows).count() == 2
    assert kcenter.kcenter_coreset(df, 6, 8).count() == 6
    assert kcenter.kcenter_radius(df, 2, 1).first()[0] == 0


@pytest.mark.parametrize("inline", [64, 0])
def test_assignment(spark, monkeypatch, inline):
    monkeypatch.setattr(kcenter, "INLINE_CENTERS", inline)
    df = points_frame(spark, N15)
    centers = kcenter.kcenter_centers(df, 4, 2)
    c = rows(centers)
    got = rows(kcenter.kcenter_assignment(df, centers, 4))
    radius = kcenter.cluster_radius(df, centers, 4).first()[0]
    expected = [
        (i, *reversed(min(((x - cx) ** 2 + (y - cy) ** 2, ord_) for ord_, _, cx, cy in c)))
        for i, x, y in rows(df)
    ]
    assert [g[:2] for g in got] == [e[:2] for e in expected]
    assert [g[2] for g in got] == pytest.approx([e[2] for e in expected])
    assert radius == pytest.approx(math.sqrt(max(e[2] for e in expected)))


def test_radius_shrinks_with_k(spark):
    rng = np.random.default_rng(2)
    df = points_frame(spark, rng.normal(0, 5, (120, 2)).tolist())
    radii = [kcenter.kcenter_radius(df, k, 1).first()[0] for k in (1, 2, 4, 8)]
    assert radii == sorted(radii, reverse=True)
    assert kcenter.kcenter_radius(df, 120, 1).first()[0] == 0


@pytest.mark.parametrize(
    ("points", "k", "m", "exact", "sure", "uncertain"),
    [(LINE5, 3, 1, 1, 1, 4), (N15, 4, 3, 8, 7, 4), (N15, 3, 3, 3, 1, 8)],
)
def test_outliers_at_the_radius(spark, points, k, m, exact, sure, uncertain):
    df = points_frame(spark, points)
    radius, *got = kcenter.kcenter_outliers(df, k, 1, m).first()
    assert got == [sure, uncertain]
    assert tuple(grid.outlier_summary(df, radius, m).first()) == (sure, uncertain)
    assert sure <= outliers.exact_outlier_count(df, radius, m).first()[0] <= sure + uncertain


def test_arguments(spark):
    df = points_frame(spark, LINE5)
    for k, parts in ((0, 1), (1, 0), (6, 1)):
        with pytest.raises(ValueError):
            kcenter.kcenter_coreset(df, k, parts)
    with pytest.raises(ValueError, match="radius is 0"):
        kcenter.kcenter_outliers(df, 5, 1, 3)
