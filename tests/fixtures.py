"""Small point sets and helpers shared by the tests."""

import numpy as np

SIMPLE9 = [(0, 0), (1, 0), (1, 1), (0, 1), (2, 0), (3, 0), (2, 1), (3, 1), (4, 4)]
N15 = [
    (0.4, 0.9),
    (0.5, 4.1),
    (0.8, 0.91),
    (0.81, 1.1),
    (1.1, 5.0),
    (1.11, 5.1),
    (1.5, 1.1),
    (1.52, 1.11),
    (1.53, 1.12),
    (1.54, 1.13),
    (1.51, 3.2),
    (1.52, 3.6),
    (3.21, 4.6),
    (4.11, 4.11),
    (4.32, 4.3),
]
LINE5 = [(0, 0), (3, 0), (7, 0), (6, 0), (2, 0)]


def points_frame(spark, points):
    data = [(i, float(np.float32(x)), float(np.float32(y))) for i, (x, y) in enumerate(points)]
    return spark.createDataFrame(data, "id bigint, x double, y double")


def brute_balls(points, distance):
    """Ball count of each point by comparing all pairs."""
    xy = np.array(points, dtype=np.float32).astype(np.float64)
    dx = xy[:, None, 0] - xy[None, :, 0]
    dy = xy[:, None, 1] - xy[None, :, 1]
    return [int(n) for n in (dx * dx + dy * dy <= distance * distance).sum(axis=1)]


def skewed_points(seed=7, n=900):
    """A third of the points in one small spot, a third copies of one point, a third spread out."""
    rng = np.random.default_rng(seed)
    spot = rng.normal((5, 5), 0.02, (n // 3, 2))
    copies = np.tile([[6.0, 5.0]], (n // 3, 1))
    wide = rng.uniform(-30, 40, (n // 3, 2))
    return [tuple(p) for p in np.vstack([spot, copies, wide]).astype(np.float32).tolist()]
