"""Fits whose passes and tasks don't grow with the input."""

import numpy as np

from msgscope.operators import models as ML
from msgscope.operators import sweep as SW


def test_sets_start_at_rest_on_the_sample(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (90, 5)) + rng.integers(0, 3, (90, 1)) * 4
    rows = spark.createDataFrame([("p", i, list(range(5)), r.tolist()) for i, r in enumerate(x)], "config string, msg_id long, indices array<int>, values array<double>").repartition(40)
    scale = SW.scales(rows, {"p": 5}, unbiased=True)
    assert np.allclose(1 / scale["p"].inverse, x.std(axis=0, ddof=1))
    got = SW.fit_all(rows, scale, SW.starts(rows, scale, range(2, 4), 3))["p"]
    assert len(got) == 6 and all(f.rounds == 1 and f.counts.sum() == 90 for f in got)  # the sample is the whole table here
    z = scale["p"](x)
    for f in got:
        near = np.argmin([[((r - c) ** 2).sum() for c in f.centroids] for r in z], axis=1)
        cost, n, s = SW.moments(z, np.concatenate([f.centroids, f.centroids[::-1]]), [f.k, f.k])
        assert np.allclose(cost, f.cost) and n.tolist() == [*f.counts, *f.counts[::-1]]
        assert np.allclose(s[: f.k], [z[near == j].sum(axis=0) for j in range(f.k)])


def test_tasks_of_a_tree_fit_grow_with_the_root_of_its_rows():
    for n in (1, 10_000, 1_000_000, 100_000_000):
        assert 8 <= ML.tree_tasks(n) <= ML.tree_tasks(100 * n) <= 10 * ML.tree_tasks(n) + 10
    assert ML.tree_tasks(1_000_000) == 125


def test_trees_are_fitted_on_so_many_partitions(spark, monkeypatch):
    from pyspark.ml.classification import GBTClassifier

    from msgscope.plans import q_assembled as Q

    seen, fit = [], GBTClassifier._fit
    monkeypatch.setattr(GBTClassifier, "_fit", lambda self, x: (seen.append(x.rdd.getNumPartitions()), fit(self, x))[1])
    monkeypatch.setattr(ML, "tree_tasks", lambda rows: 1)
    Q._trees(spark, "/root/testdata/sf0.001")
    assert seen == [1]


def test_rows_of_a_tree_fit_are_dealt_out_whatever_their_files(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.linalg import Vectors

    n = 64 * 12**2
    sizes = ML.for_trees(spark.range(n).coalesce(1)).rdd.glom().map(len).collect()
    assert len(sizes) == ML.tree_tasks(n) == 12 and sum(sizes) == n and max(sizes) <= 2 * n / 12
    assert ML.for_trees(spark.range(0, 4000, 1, 1)).rdd.getNumPartitions() == 1
    rows = spark.createDataFrame([(float(i % 2), Vectors.sparse(3, [0, 2], [i % 2 + 0.5, i % 7 + 0.0])) for i in range(60)] * 70, ["label", "features"]).coalesce(1)
    fit = GBTClassifier(maxIter=2, maxDepth=2, seed=42).fit
    chance = lambda m: [r[0][1] for r in m.transform(rows).select("probability").collect()]
    assert np.allclose(chance(fit(ML.for_trees(rows))), chance(fit(rows)))
