"""Euclidean silhouette over a bounded sample (AGG-30).

Mean distances to a cluster have no closed form without squares, so every point
of the sample is held against every other one.  The sample is cut into blocks, a
tile holds one block against another, and only sums by (point, cluster) leave it.
The work is quadratic in ``max_points`` and so never grows with the table; the
exact squared-distance form over all points is ``silhouette_sq_euclidean``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from msgscope.operators.clustering import attach_one_row
from msgscope.session import materialize

#: Points of the sample, and of a block (a tile holds two blocks).
MAX_POINTS = 20_000
BLOCK = 512

SUMS = "point long, cluster long, total double"


def sample_points(points: DataFrame, key: str, x: str, c: str, max_points: int = MAX_POINTS) -> DataFrame:
    """(point, cluster, x): the first ``max_points`` rows in the order of their key's
    md5, ties by key, cluster and vector; all of them if there are no more.  Rows
    without a cluster or a vector, or with a null in it, are left out."""
    v = F.col(x).cast("array<double>")
    whole = points.where(v.isNotNull() & F.col(c).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(c).cast("long").alias("cluster"), v.alias("x"))
    whole = whole.where(~F.exists("x", lambda e: e.isNull()))
    order = [F.md5("k"), F.col("k"), F.col("cluster"), F.col("x")]
    first = whole.orderBy(*order).limit(max_points)
    return first.select((F.row_number().over(Window.orderBy(*order)) - 1).cast("long").alias("point"), "cluster", "x")  # the sample alone


def _tile(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Sums of the distances of each left point to the right points of each cluster."""
    if left.empty or right.empty:
        return pd.DataFrame({"point": [], "cluster": [], "total": []})
    others, cluster = np.stack(right["x"].to_numpy()), right["cluster"].to_numpy()
    names, at = np.unique(cluster, return_inverse=True)
    parts = []
    for p, v in zip(left["point"], left["x"]):
        diff = others - np.asarray(v)
        total = np.bincount(at, weights=np.sqrt(np.einsum("ij,ij->i", diff, diff)), minlength=len(names))
        parts.append(pd.DataFrame({"point": p, "cluster": names, "total": total}))
    return pd.concat(parts)


def silhouette_euclidean(points: DataFrame, key: str, x: str, c: str, max_points: int = MAX_POINTS, block: int = BLOCK) -> DataFrame:
    """One row (silhouette, n_points).  A point alone in its cluster, or without
    another cluster, or with only zero distances has 0; without points the mean is null."""
    s = materialize(sample_points(points, key, x, c, max_points))
    n_blocks = -(-s.count() // block)
    if n_blocks == 0:
        return s.agg(F.avg(F.lit(0.0)).alias("silhouette"), F.count("*").alias("n_points"))
    own = s.withColumn("b", F.floor(F.col("point") / block).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    left = own.select(F.col("b").alias("i"), every.alias("j"), "point", "x")
    right = own.select(every.alias("i"), F.col("b").alias("j"), "cluster", "x")
    sums = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(_tile, SUMS)
    sizes = s.groupBy("cluster").agg(F.count("*").alias("n"))
    mine = s.select("point", F.col("cluster").alias("mine"))
    total = sums.groupBy("point", "cluster").agg(F.sum("total").alias("total")).join(sizes, "cluster").join(mine, "point")
    inside = F.col("cluster") == F.col("mine")
    per = total.groupBy("point").agg(
        F.max(F.when(inside & (F.col("n") > 1), F.col("total") / F.greatest(F.col("n") - 1, F.lit(1)))).alias("a"),
        F.min(F.when(~inside, F.col("total") / F.col("n"))).alias("b"),
    )
    most = F.greatest("a", "b")
    value = F.when(F.col("a").isNull() | F.col("b").isNull() | (most == 0), 0.0).otherwise((F.col("b") - F.col("a")) / F.when(most > 0, most))
    return per.agg(F.avg(value).alias("silhouette"), F.count("*").alias("n_points"))


def compared(points: DataFrame, key: str, x: str, c: str, squared: DataFrame, max_points: int = MAX_POINTS) -> DataFrame:
    """The Euclidean figure of the sample beside the squared one of all points
    (columns silhouette, n_points)."""
    own = silhouette_euclidean(points, key, x, c, max_points)
    return attach_one_row(own, squared.select(F.col("silhouette").alias("squared_all"), F.col("n_points").alias("n_all")))
