"""Euclidean silhouette in tiles against a plain version over all pairs."""

import numpy as np
import pytest

from msgscope.operators.silhouette import sample_points, silhouette_euclidean

SCHEMA = "id int, x array<double>, c int"


def plain(points):
    x, c = np.array([p[1] for p in points]), np.array([p[2] for p in points])
    out = []
    for i in range(len(x)):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        same = c == c[i]
        others = [d[c == o].mean() for o in set(c) - {c[i]}]
        if same.sum() < 2 or not others:
            out.append(0.0)
            continue
        a, b = d[same].sum() / (same.sum() - 1), min(others)
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(out))


@pytest.mark.parametrize("block", [7, 512])
def test_equals_all_pairs(spark, block):
    rng = np.random.default_rng(1)
    points = [(i, rng.normal(i % 3, 1.0, 5).tolist(), i % 3) for i in range(60)]
    points += [(60, [9.0] * 5, 7)] + [(61, [0.5] * 5, 1)] * 3  # a cluster of one, repeated rows
    got = silhouette_euclidean(spark.createDataFrame(points, SCHEMA), "id", "x", "c", block=block).first()
    assert got["n_points"] == 64 and got["silhouette"] == pytest.approx(plain(points), abs=1e-12)


def test_sample_is_bounded_and_the_same_at_any_partitioning(spark):
    df = spark.createDataFrame([(i, [float(i), 0.0], i % 2) for i in range(100)], SCHEMA)
    a = sample_points(df.repartition(7), "id", "x", "c", 30).collect()
    assert len(a) == 30 and sorted(map(str, a)) == sorted(map(str, sample_points(df.coalesce(1), "id", "x", "c", 30).collect()))
    assert silhouette_euclidean(df, "id", "x", "c", 30, 8).first()["n_points"] == 30


def test_nulls_empty_one_cluster_and_equal_points(spark):
    rows = [(1, [0.0], 0), (None, [0.0], 1), (3, None, 0), (4, [None], 0), (5, [1.0], None), (6, [0.0], 0), (7, [0.0], 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert tuple(silhouette_euclidean(df, "id", "x", "c").first()) == (0.0, 4)
    assert tuple(silhouette_euclidean(df.where("c = 0 AND id IN (1, 6)"), "id", "x", "c").first()) == (0.0, 2)
    assert tuple(silhouette_euclidean(df.limit(0), "id", "x", "c").first()) == (None, 0)
