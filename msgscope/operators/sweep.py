"""k-means for many numbers of clusters, seeds and feature sets at once (ML-07).

The rows are scaled and packed into blocks once, by configuration.  A pass over the
blocks of all configurations moves every set of centroids that has not come to
rest: a task makes a block dense, takes one matrix product with all centroids of
its configuration, and adds up, for each set, its rows' sums by nearest centroid.
Partial sums are added by (configuration, set) on the cluster; what reaches the
driver is one row a set, whatever the number of rows.

Columns are scaled by mean and standard deviation of the training rows (a column
without variance is 0).  Sets begin with k-means++ and Lloyd's steps on the ``SAMPLE``
training rows of least hash; every pass is over all rows.  A set rests once its centroids move
by ``TOL`` at most (sum of squares), or after ``ROUNDS`` passes; a centroid without
rows stays where it is.  Sets move in single precision until they would rest; from
there they move on, are found to rest, and get their cost, in double precision.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgscope.session import checkpoint_dir

ROUNDS, TOL, SEEDS, SAMPLE = 300, 1e-4, 10, 2_000
#: Rows of a dense block, and tasks a core of a pass over all rows.
BLOCK, TASKS = 1024, 3


@dataclass
class Scale:
    mean: np.ndarray
    inverse: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) * self.inverse


@dataclass
class Fit:
    """One set of centroids."""

    k: int
    seed: int
    centroids: np.ndarray
    cost: float = np.inf
    rounds: int = 0
    rests: bool = False
    waits: bool = False  # for passes in double precision
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0))


def dense(indices: pa.Array, values: pa.Array, width: int) -> np.ndarray:
    sizes = np.diff(np.asarray(indices.offsets))
    x = np.zeros((len(indices), width))
    x[np.repeat(np.arange(len(indices)), sizes), np.asarray(indices.flatten())] = np.asarray(values.flatten())
    return x


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.RecordBatch]]:
    """(configuration, rows of it), at most ``BLOCK``."""
    for big in batches:
        configs = np.asarray(big.column(0).to_pylist(), object)
        for name in dict.fromkeys(configs.tolist()):
            own = big.take(pa.array(np.flatnonzero(configs == name)))
            for a in range(0, own.num_rows, BLOCK):
                b = own.slice(a, BLOCK)
                yield name, b.take(pa.array(np.arange(b.num_rows)))  # lists with offsets of their own


def _dense_blocks(batches: Iterator[pa.RecordBatch], widths: dict[str, int]) -> Iterator[tuple[str, np.ndarray, pa.RecordBatch]]:
    """(configuration, dense rows, their batch)."""
    for name, b in _blocks(batches):
        yield name, dense(b.column(1), b.column(2), widths[name]), b


SUMS = pa.schema([("config", pa.string()), ("place", pa.int32()), ("sums", pa.binary())])
SUMS_SQL = "config string, place int, sums binary"


def _rows(totals: dict[tuple[str, int], np.ndarray], kind: str = "<f8") -> Iterator[pa.RecordBatch]:
    for (config, place), x in totals.items():
        yield pa.RecordBatch.from_arrays([pa.array([config]), pa.array([place], pa.int32()), pa.array([x.astype(kind).tobytes()])], schema=SUMS)


def _tasks(rows: DataFrame) -> int:
    """Tasks of a pass: each sends a total a key, or writes a file a configuration, whatever its rows."""
    return rows.sparkSession.sparkContext.defaultParallelism * TASKS


def _added(rows: DataFrame, run, kind: str = "<f8") -> dict[tuple[str, int], np.ndarray]:
    """The totals that ``run`` (batches -> dictionary) makes of all rows, by key:
    a partial total a task, sent as ``kind``, added by key on the cluster, then one row a key."""

    def partial(batches):
        yield from _rows(run(batches), kind)

    def whole(batches):
        totals: dict[tuple[str, int], np.ndarray] = {}
        for b in batches:
            for config, place, x in zip(*(c.to_pylist() for c in b.columns)):
                own = np.frombuffer(x, kind).astype("<f8")
                totals[config, place] = totals[config, place] + own if (config, place) in totals else own
        yield from _rows(totals)

    summed = rows.coalesce(_tasks(rows)).mapInArrow(partial, SUMS_SQL).repartition("config", "place").mapInArrow(whole, SUMS_SQL)
    return {(r["config"], r["place"]): np.frombuffer(r["sums"], "<f8") for r in summed.collect()}


def scales(rows: DataFrame, widths: dict[str, int], unbiased: bool = False) -> dict[str, Scale]:
    """Means and deviations of every column of (config, indices, values); variances
    by n, or by n - 1 if ``unbiased``."""

    def run(batches):
        totals: dict = {}
        for name, x, _ in _dense_blocks(batches, widths):
            own = np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])
            totals[name, 0] = totals.get((name, 0), 0) + own
        return totals

    out = {}
    for (name, _), t in _added(rows.select("config", "indices", "values"), run).items():
        n, w = t[0], widths[name]
        mean = t[1 : w + 1] / n
        var = np.maximum(t[w + 1 :] / n - mean**2, 0) * (n / max(n - 1, 1) if unbiased else 1)
        out[name] = Scale(mean, np.where(var > 1e-12, 1 / np.sqrt(np.maximum(var, 1e-12)), 0.0))
    return out


def plus_plus(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++: each next centroid is a row, by its squared distance to the nearest."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(x)))]
    near = ((x - x[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < k:
        total = near.sum()
        nxt = int(rng.choice(len(x), p=near / total)) if total > 0 else int(rng.integers(len(x)))
        chosen.append(nxt)
        near = np.minimum(near, ((x - x[nxt]) ** 2).sum(axis=1))
    return x[chosen].copy()


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)[None], 0)


def nearest(z: np.ndarray, centroids: np.ndarray, ks: list[int]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of sets of one k: (place of their first centroid, k, and by set and row
    the nearest centroid and the squared distance to it without the row's own square)."""
    d, at = (-2 * centroids) @ z.T, 0
    d += (centroids * centroids).sum(axis=1)[:, None]
    for k, run in groupby(ks):
        own = d[at : at + k * len(list(run))].reshape(-1, k, len(z))
        least, near = own[:, 0].copy(), np.zeros((len(own), len(z)), np.int32)
        for j in range(1, k):
            near[own[:, j] < least] = j
            np.minimum(least, own[:, j], out=least)
        yield at, k, near, least
        at += len(own) * k


def moments(z: np.ndarray, centroids: np.ndarray, ks: list[int], squares: np.ndarray | None = None) -> list[np.ndarray]:
    """Cost by set, and number and sum of rows by centroid, of sets of ``ks`` centroids
    each, one after another: two matrix products for all of them."""
    squares = (z * z).sum(axis=1) if squares is None else squares
    hit, cost = np.empty((len(centroids), len(z)), z.dtype), []
    for at, k, near, least in nearest(z, centroids, ks):
        for j in range(k):
            hit[at + j : at + k * len(near) : k] = near == j
        cost.append(np.maximum(least + squares, 0).sum(axis=1))
    return [np.concatenate(cost), hit.sum(axis=1), hit @ z]


PACKED = "n int, sizes binary, cols binary, x binary, short binary, squares binary"


def packed(rows: DataFrame, scale: dict[str, Scale]) -> str:
    """Path of the blocks of ``rows`` (config, indices, values), scaled: a Parquet row a
    block, a folder a configuration, so that a pass neither decodes nor scales the
    entries of a row again, and doesn't read configurations that rest.  Of each block
    the rows' numbers of stored entries (others are the scaled zero), their columns and
    values in double and single precision, and the rows' squares."""
    shared = rows.sparkSession.sparkContext.broadcast(scale)
    names = ["config", "n", "sizes", "cols", "x", "short", "squares"]

    def run(batches):
        for name, b in _blocks(batches):
            own, col = shared.value[name], np.asarray(b.column(1).flatten())
            x = (np.asarray(b.column(2).flatten()) - own.mean[col]) * own.inverse[col]
            sizes, cols = np.diff(np.asarray(b.column(1).offsets)).astype("<i4"), col.astype(_column_kind(own))
            z = _unpacked(sizes, cols, x, own)
            packs = (sizes, cols, x, x.astype("<f4"), (z * z).sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b.num_rows], pa.int32()), *(pa.array([a.tobytes()]) for a in packs)], names=names)

    path = os.path.join(checkpoint_dir(rows.sparkSession), "blocks", uuid.uuid4().hex)
    rows.coalesce(_tasks(rows)).select("config", "indices", "values").mapInArrow(run, f"config string, {PACKED}").write.partitionBy("config").parquet(path)
    return path


def _column_kind(scale: Scale) -> str:
    return "<u2" if len(scale.mean) <= 1 << 16 else "<i4"


def _unpacked(sizes: np.ndarray, cols: np.ndarray, x: np.ndarray, scale: Scale) -> np.ndarray:
    """The dense rows, in the precision of ``x``."""
    n, width = len(sizes), len(scale.mean)
    z = np.empty((n, width), x.dtype)
    z[:] = -scale.mean * scale.inverse
    z.reshape(-1)[np.repeat(np.arange(n) * width, sizes) + cols] = x
    return z


def one_pass(blocks: DataFrame, scale: dict[str, Scale], sets: dict[str, list[Fit]], short: bool = False) -> dict[tuple[str, int], np.ndarray]:
    """For each set that neither rests nor waits: its cost (not if ``short``: in single
    precision), then for each centroid the number and sum of its rows; one flat array
    by (configuration, place in ``sets``).  The rows are those of ``packed``."""
    live = {name: [(i, f.k) for i, f in enumerate(fits) if not (f.rests or f.waits)] for name, fits in sets.items()}
    live = {name: places for name, places in live.items() if places}
    kind = "<f4" if short else "<f8"
    every = {name: np.concatenate([sets[name][i].centroids for i, _ in places]).astype(kind) for name, places in live.items()}
    shared = blocks.sparkSession.sparkContext.broadcast((scale, live, every))  # bounded by k, seeds and width
    values = ["short"] if short else ["x", "squares"]

    def run(batches):
        scale, live, every = shared.value
        sums: dict = {}
        for b in batches:
            for name, sizes, cols, x, *squares in zip(*(c.to_pylist() for c in b.columns)):
                own = scale[name]
                z = _unpacked(np.frombuffer(sizes, "<i4"), np.frombuffer(cols, _column_kind(own)), np.frombuffer(x, kind), own)
                found = moments(z, every[name], [k for _, k in live[name]], np.frombuffer(squares[0]) if squares else np.zeros(1))
                if name not in sums:
                    sums[name] = [a.astype("<f8") for a in found]
                    continue
                for total, more in zip(sums[name], found):
                    total += more  # in place: as large as all centroids
        totals, ks = {}, {name: [k for _, k in places] for name, places in live.items()}
        for name, (cost, n, s) in sums.items():
            for (place, k), c, to in zip(live[name], cost, np.cumsum(ks[name])):
                totals[name, place] = np.concatenate([[c], n[to - k : to], s[to - k : to].ravel()])
        return totals

    return _added(blocks.where(F.col("config").isin(list(live))).select("config", "sizes", "cols", *values), run, kind)


def fit_all(rows: DataFrame, scale: dict[str, Scale], sets: dict[str, list[Fit]], rounds: int = ROUNDS, tol: float = TOL) -> dict[str, list[Fit]]:
    """Move all sets over ``rows`` (config, indices, values) until they rest."""
    blocks, every = rows.sparkSession.read.schema(f"{PACKED}, config string").parquet(packed(rows, scale)), [f for fits in sets.values() for f in fits]
    for short in (True, False):
        while any(not (f.rests or f.waits) for f in every):
            for (name, place), t in one_pass(blocks, scale, sets, short).items():
                f = sets[name][place]
                n, s = t[1 : f.k + 1], t[f.k + 1 :].reshape(f.k, -1)
                moved = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], f.centroids)
                last = bool(((moved - f.centroids) ** 2).sum() <= tol) or f.rounds + 1 >= rounds
                if last and short:
                    f.waits = True
                    continue
                f.cost, f.counts, f.rounds, f.rests = float(t[0]), n, f.rounds + 1, last
                if not f.rests:  # else cost and counts are those of the centroids kept
                    f.centroids = moved
        for f in every:
            f.waits = False
    return sets


def settled(x: np.ndarray, centroids: np.ndarray, rounds: int = ROUNDS, tol: float = TOL) -> np.ndarray:
    """The centroids after Lloyd's steps over the rows ``x``."""
    for _ in range(rounds):
        _, n, s = moments(x, centroids, [len(centroids)])
        moved = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], centroids)
        shift, centroids = ((moved - centroids) ** 2).sum(), moved
        if shift <= tol:
            break
    return centroids


def starts(rows: DataFrame, scale: dict[str, Scale], ks: range, seeds: int = SEEDS, sample: int = SAMPLE) -> dict[str, list[Fit]]:
    """Sets for every k and seed: k-means++ on the ``sample`` rows of least hash of
    (config, msg_id, indices, values) in each configuration, moved over that sample
    until they rest, each in a task, so that fewer passes over all rows remain."""
    spark, out = rows.sparkSession, {}
    tasks = spark.createDataFrame([(k, seed) for k in ks for seed in range(seeds)], "k int, seed int")
    tasks = tasks.repartition(max(1, min(tasks.count(), spark.sparkContext.defaultParallelism * 2)))
    for name, own in scale.items():
        some = rows.where(F.col("config") == name).orderBy(F.md5(F.col("msg_id").cast("string")), "msg_id").limit(sample)
        table = some.select("indices", "values").toArrow().combine_chunks()
        shared = spark.sparkContext.broadcast((own, table["indices"].combine_chunks(), table["values"].combine_chunks()))

        def run(batches, shared=shared):
            own, indices, values = shared.value
            x = own(dense(indices, values, len(own.mean)))
            for b in batches:
                for k, seed in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    c = settled(x, plus_plus(x, k, 42 + seed))
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([seed], pa.int32()), pa.array([c.tobytes()])], names=["k", "seed", "c"])

        found = {(r["k"], r["seed"]): np.frombuffer(r["c"]).reshape(r["k"], -1) for r in tasks.mapInArrow(run, "k int, seed int, c binary").collect()}
        out[name] = [Fit(k, seed, found[k, seed]) for k in ks for seed in range(seeds)]
    return out


def best(sets: dict[str, list[Fit]]) -> dict[str, dict[int, Fit]]:
    """Of each configuration and k the set of least cost (ties: the first seed)."""
    out: dict = {}
    for name, fits in sets.items():
        for f in fits:
            old = out.setdefault(name, {}).get(f.k)
            if old is None or f.cost < old.cost:
                out[name][f.k] = f
    return out


def assigned(rows: DataFrame, scale: dict[str, Scale], chosen: dict[str, dict[int, Fit]]) -> DataFrame:
    """(config, k, split, label, cluster, n): the contingency tables of all fits on
    rows (config, indices, values, split, label), counted in each task first."""
    schema = pa.schema([("config", pa.string()), ("k", pa.int32()), ("split", pa.string()), ("label", pa.int32()), ("cluster", pa.int32()), ("n", pa.int64())])
    shared = rows.sparkSession.sparkContext.broadcast((scale, chosen))

    def run(batches):
        scale, chosen = shared.value
        counts: dict = {}
        for name, x, b in _dense_blocks(batches, {n: len(s.mean) for n, s in scale.items()}):
            coded = [b.column(i).dictionary_encode(null_encoding="encode") for i in (3, 4)]
            splits, labels = (c.dictionary.to_pylist() for c in coded)
            pair = np.asarray(coded[0].indices, np.int64) * len(labels) + np.asarray(coded[1].indices, np.int64)
            fits = list(chosen[name].values())
            for _, k, near, _ in nearest(scale[name](x), np.concatenate([f.centroids for f in fits]), [f.k for f in fits]):
                for clusters in near:
                    found = np.bincount(pair * k + clusters)
                    for i in np.flatnonzero(found).tolist():
                        key = (name, k, splits[i // k // len(labels)], labels[i // k % len(labels)], i % k)
                        counts[key] = counts.get(key, 0) + int(found[i])
        rows = [(*key, n) for key, n in counts.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    sql = "config string, k int, split string, label int, cluster int, n long"
    keys = ["config", "k", "split", "label", "cluster"]
    return rows.select("config", "indices", "values", "split", "label").mapInArrow(run, sql).groupBy(*keys).agg(F.sum("n").alias("n"))


def silhouettes(rows: DataFrame, scale: dict[str, Scale], chosen: dict[str, dict[int, Fit]]) -> dict[tuple[str, int, str], float]:
    """Mean squared-distance silhouette by (config, k, split), exactly: one pass for
    the clusters' sizes, sums and squares, one for the rows."""
    parts = ("train", "test")
    flat = {name: list(fits.values()) for name, fits in chosen.items()}

    def of(batches, scale, flat):
        """(configuration, rows, their squares, and by fit and part: place, k, places of
        its clusters among those of all fits and parts, its rows and their clusters)."""
        for name, x, b in _dense_blocks(batches, {n: len(s.mean) for n, s in scale.items()}):
            z, split, own, at = scale[name](x), np.asarray(b.column(3).to_pylist(), object), [], 0
            row = [np.flatnonzero(split == part) for part in parts]
            ks = [f.k for f in flat[name]]
            near = [c for *_, c, _ in nearest(z, np.concatenate([f.centroids for f in flat[name]]), ks) for c in c]
            for i, k in enumerate(ks):
                for p, r in enumerate(row):
                    own.append((i * 2 + p, k, slice(at, at + k), r, near[i][r]))
                    at += k
            yield name, z, (z * z).sum(axis=1), own

    shared = rows.sparkSession.sparkContext.broadcast((scale, flat))

    def stats(batches):
        totals: dict = {}
        for name, z, squares, own in of(batches, *shared.value):
            hit = np.zeros((own[-1][2].stop, len(z)))
            for _, _, at, r, near in own:
                hit[at.start + near, r] = 1
            n, q, s = hit.sum(axis=1), hit @ squares, hit @ z
            for place, _, at, _, _ in own:
                totals[name, place] = totals.get((name, place), 0) + np.concatenate([n[at], q[at], s[at].ravel()])
        return totals

    own = rows.select("config", "indices", "values", "split")
    known = own.sparkSession.sparkContext.broadcast(_added(own, stats))

    def sums(batches):
        totals: dict = {}
        for name, z, squares, own in of(batches, *shared.value):
            t = [known.value[name, place] for place, *_ in own]
            cross = np.concatenate([x[2 * k :].reshape(k, -1) for x, (_, k, *_) in zip(t, own)]) @ z.T
            for x, (place, k, at, r, near) in zip(t, own):
                n, q = x[:k, None], x[k : 2 * k, None]
                far = np.maximum(n * squares[r] - 2 * cross[at][:, r] + q, 0)  # summed squared distances
                row, size = np.arange(len(r)), n[near, 0]
                a = far[near, row] / np.maximum(size - 1, 1)
                other = np.where(n > 0, far / np.maximum(n, 1), np.inf)
                other[near, row] = np.inf
                b = other.min(axis=0, initial=np.inf)
                top = np.maximum(a, b)
                value = np.where((size > 1) & np.isfinite(b) & (top > 0), (b - a) / np.where(top > 0, top, 1), 0.0)
                totals[name, place] = totals.get((name, place), 0) + np.array([value.sum(), len(r)])
        return totals

    out = {}
    for (name, place), (total, n) in _added(own, sums).items():
        if n:
            out[name, flat[name][place // 2].k, parts[place % 2]] = float(total / n)
    return out
