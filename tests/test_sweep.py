"""The shared pass of the k sweep against one fit at a time."""

import numpy as np
from pyspark.sql import functions as F

from msgscope.operators import sweep as SW


def plain(x, f):
    """Lloyd's steps by a loop over the rows."""
    c, rounds = f.centroids.copy(), 0
    while True:
        near = [int(np.argmin([((r - m) ** 2).sum() for m in c])) for r in x]
        cost = sum(((r - c[i]) ** 2).sum() for r, i in zip(x, near))
        new = np.array([x[np.array(near) == j].mean(axis=0) if j in near else c[j] for j in range(f.k)])
        rounds += 1
        if ((new - c) ** 2).sum() <= SW.TOL or rounds >= SW.ROUNDS:
            return c, cost, np.bincount(near, minlength=f.k)
        c = new


def slow_silhouette(x, near):
    out = []
    for i, r in enumerate(x):
        d = ((x - r) ** 2).sum(axis=1)
        own = (near == near[i]) & (np.arange(len(x)) != i)
        if not own.any():
            out.append(0.0)
            continue
        b = min(d[near == j].mean() for j in set(near) - {near[i]})
        a = d[own].mean()
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


def test_shared_passes_equal_single_fits(spark):
    rng = np.random.default_rng(3)
    widths, data, raw = {"p": 6, "q": 11}, [], {}
    for name, w in widths.items():
        x = np.where(rng.random((150, w)) < 0.5, rng.normal(0, 1, (150, w)) + rng.integers(0, 4, (150, 1)), 0.0)
        x[:, 2] = 7.0  # no variance
        raw[name] = x
        data += [(name, np.flatnonzero(r).tolist(), r[r != 0].tolist(), "train" if i % 3 else "test", i % 2, i) for i, r in enumerate(x)]
    rows = spark.createDataFrame(data, "config string, indices array<int>, values array<double>, split string, label int, msg_id long").repartition(7)
    train = rows.where("split = 'train'")
    scale = SW.scales(train, widths)
    kept = np.arange(150) % 3 > 0
    for name, x in raw.items():
        sd = x[kept].std(axis=0)
        assert np.allclose(scale[name](x), np.where(sd > 1e-6, (x - x[kept].mean(axis=0)) / np.where(sd > 1e-6, sd, 1), 0), atol=1e-8)
    sets = SW.starts(train, scale, range(2, 5), 3)
    want = {name: [plain(scale[name](raw[name][kept]), f) for f in fits] for name, fits in sets.items()}
    got = SW.fit_all(train, scale, sets)
    for name in widths:
        assert len(got[name]) == 9 and all(f.rests for f in got[name])
        for f, (c, cost, counts) in zip(got[name], want[name]):
            assert np.allclose(f.centroids, c, atol=1e-8) and abs(f.cost - cost) < 1e-6 and f.counts.tolist() == counts.tolist()
    chosen = SW.best(got)
    assert all(chosen[n][k].cost == min(f.cost for f in got[n] if f.k == k) for n in widths for k in range(2, 5))
    table = SW.assigned(rows, scale, chosen)
    assert table.groupBy("config", "k").agg(F.sum("n").alias("n")).where("n <> 150").count() == 0
    sil = SW.silhouettes(rows, scale, chosen)
    for name in widths:
        for k, f in chosen[name].items():
            z = scale[name](raw[name][~kept])
            near = SW.squared(z, f.centroids).argmin(axis=1)
            assert abs(sil[name, k, "test"] - slow_silhouette(z, near)) < 1e-8


def test_passes_read_packed_blocks_of_configurations_that_move(spark):
    rng = np.random.default_rng(9)
    x = {name: np.where(rng.random((2500, w)) < 0.3, rng.normal(0, 1, (2500, w)), 0.0) for name, w in {"p": 5, "q": 9}.items()}
    data = [(name, np.flatnonzero(r).tolist(), r[r != 0].tolist()) for name, rows in x.items() for r in rows]
    rows = spark.createDataFrame(data, "config string, indices array<int>, values array<double>").coalesce(1)
    scale = SW.scales(rows, {"p": 5, "q": 9})
    blocks = spark.read.schema(f"{SW.PACKED}, config string").parquet(SW.packed(rows, scale))
    found = blocks.collect()
    assert len(found) < 20 and sum(r["n"] for r in found) == 5000  # not a row a document
    for name in x:
        z = np.concatenate([SW._unpacked(np.frombuffer(r["sizes"], "<i4"), np.frombuffer(r["cols"], "<u2"), np.frombuffer(r["x"]), scale[name]) for r in found if r["config"] == name])
        assert np.allclose(z[np.lexsort(z.T)], (w := scale[name](x[name]))[np.lexsort(w.T)])
        assert np.allclose(np.sort(np.concatenate([np.frombuffer(r["squares"]) for r in found if r["config"] == name])), np.sort((w * w).sum(axis=1)))
    files = blocks.where(F.col("config").isin("p")).select(F.input_file_name()).distinct().collect()
    assert all("config=p" in r[0] for r in files)
    sets = {n: [SW.Fit(2, 0, scale[n](x[n][:2])), SW.Fit(3, 0, scale[n](x[n][:3]), rests=n == "q")] for n in x}
    got = SW.one_pass(blocks, scale, sets)
    assert set(got) == {("p", 0), ("p", 1), ("q", 0)}
    cost, n, s = SW.moments(scale["q"](x["q"]), sets["q"][0].centroids, [2])
    assert np.allclose(got["q", 0], np.concatenate([cost, n, s.ravel()]))
    short = SW.one_pass(blocks, scale, sets, short=True)
    assert all(np.allclose(short[key][1:], got[key][1:], rtol=1e-4, atol=1e-3) for key in got)


def test_sets_rest_by_passes_in_double_precision(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (400, 6)) + rng.integers(0, 4, (400, 1)) * 2
    rows = spark.createDataFrame([("p", list(range(6)), r.tolist()) for r in x], "config string, indices array<int>, values array<double>").repartition(3)
    scale, seen, one = SW.scales(rows, {"p": 6}), [], SW.one_pass
    z = scale["p"](x)
    monkeypatch.setattr(SW, "one_pass", lambda *a: (seen.append(a[3]), one(*a))[1])
    fits = [SW.Fit(k, seed, SW.plus_plus(z, k, seed)) for k in (2, 4) for seed in range(3)]
    want = [plain(z, f) for f in fits]
    SW.fit_all(rows, scale, {"p": fits})
    assert seen == sorted(seen, reverse=True) and 1 <= seen.count(False) < seen.count(True)
    for f, (c, cost, counts) in zip(fits, want):
        assert f.rests and np.allclose(f.centroids, c, atol=1e-8) and abs(f.cost - cost) < 1e-6 and f.counts.tolist() == counts.tolist()
    capped = SW.fit_all(rows, scale, {"p": [SW.Fit(4, 0, SW.plus_plus(z, 4, 0))]}, rounds=2)["p"][0]
    assert capped.rests and capped.rounds == 2 and capped.counts.sum() == 400
