"""Cluster analytics: composition, mapping, ARI/NMI, silhouette, centroid
distances and 2-D scaling.

Cluster parameters (k centroids, per-cluster sums) are tiny and bounded by
``k * dims`` - exactly like a fitted ``KMeansModel`` - so they are collected
once and applied as literal arrays inside native higher-order functions; no
points x centroids join is materialised.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_CLUSTERS = 4096  # rows of cluster parameters that a driver takes at most


def attach_one_row(left: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row frame to every row (broadcast)."""
    k = "__one"
    return left.withColumn(k, F.lit(1)).join(F.broadcast(one_row.withColumn(k, F.lit(1))), k).drop(k)


def composition(df: DataFrame, cluster: str = "cluster_id", label: str = "label", source: str = "source", k: int | None = None) -> DataFrame:
    """AGG-19/20/31, WIN-05: size, spam rate, majority class, dominant source
    (most rows, ties to the smaller name) and number of sources per cluster.
    With ``k``, clusters 0..k-1 without rows are there, too: size and class 0."""
    by = df.groupBy(cluster, source).agg(F.count(F.lit(1)).cast("long").alias("n"), F.sum(label).alias("spam"))
    first = F.min_by(source, F.struct(-F.col("n"), F.col(source)))  # over clusters x sources rows
    per = by.groupBy(cluster).agg(
        F.sum("n").cast("long").alias("size"), (F.sum("spam") / F.sum("n")).alias("spam_rate"),
        F.count(source).cast("long").alias("n_sources"), first.alias("dominant_source"),
    )
    if k is not None:
        ids = df.sparkSession.range(k).select(F.col("id").cast(df.schema[cluster].dataType).alias(cluster))
        per = ids.join(per, cluster, "left").fillna(0, ["size", "n_sources"])
    return per.withColumn("mapped_class", F.coalesce((F.col("spam_rate") > 0.5).cast("int"), F.lit(0)))


def source_shares(df: DataFrame, cluster: str = "cluster_id", label: str = "label", source: str = "source") -> DataFrame:
    """AGG-19 source map (long form) and AGG-21 share of each source within
    the cluster's spam (0 when the cluster has none)."""
    cs = df.groupBy(cluster, source).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("spam_n"))
    w = Window.partitionBy(cluster)
    tot_spam = F.sum("spam_n").over(w)
    return cs.select(
        cluster, source, F.col("n").cast("long"),
        (F.col("n") / F.sum("n").over(w)).alias("share"),
        F.col("spam_n").cast("long"),
        F.when(tot_spam > 0, F.col("spam_n") / tot_spam).otherwise(F.lit(0.0)).alias("spam_share"),
    )


def map_clusters(df: DataFrame, cluster: str = "cluster_id", label: str = "label") -> DataFrame:
    """JN-02/07: majority class per cluster (default 0) as ``prediction``
    and the cluster spam rate as ``cluster_rate`` (a score)."""
    cm = df.groupBy(cluster).agg(F.avg(label).alias("cluster_rate")).withColumn(
        "__cls", F.when(F.col("cluster_rate") > 0.5, 1).otherwise(0)
    )
    return df.join(cm, cluster, "left").withColumn("prediction", F.coalesce(F.col("__cls"), F.lit(0))).drop("__cls")


def ari_nmi(df: DataFrame, u: str, v: str) -> DataFrame:
    """AGG-28/29 from the contingency table (classes x clusters rows):
    adjusted Rand index and NMI with the arithmetic-mean normaliser."""
    ct = df.groupBy(F.col(u).alias("u"), F.col(v).alias("v")).agg(F.count(F.lit(1)).cast("double").alias("nij"))
    a = ct.groupBy("u").agg(F.sum("nij").alias("ai"))
    b = ct.groupBy("v").agg(F.sum("nij").alias("bj"))
    n = ct.agg(F.sum("nij").alias("n"))
    full = attach_one_row(ct.join(a, "u").join(b, "v"), n)
    pair = lambda x: x * (x - 1) / 2.0
    sums = full.agg(
        F.sum(pair(F.col("nij"))).alias("sij"),
        F.sum(F.col("nij") / F.col("n") * F.log(F.col("n") * F.col("nij") / (F.col("ai") * F.col("bj")))).alias("mi"),
        F.first("n").alias("n"),
    )
    sa = attach_one_row(a, n).agg(
        F.sum(pair(F.col("ai"))).alias("sa"), (-F.sum(F.col("ai") / F.col("n") * F.log(F.col("ai") / F.col("n")))).alias("hu")
    )
    sb = attach_one_row(b, n).agg(
        F.sum(pair(F.col("bj"))).alias("sb"), (-F.sum(F.col("bj") / F.col("n") * F.log(F.col("bj") / F.col("n")))).alias("hv")
    )
    s = attach_one_row(attach_one_row(sums, sa), sb)
    expected = F.col("sa") * F.col("sb") / pair(F.col("n"))
    den = (F.col("sa") + F.col("sb")) / 2 - expected
    return s.select(
        F.when(den == 0, F.lit(1.0)).otherwise((F.col("sij") - expected) / den).alias("ari"),
        F.when(F.col("hu") + F.col("hv") == 0, F.lit(1.0))
        .otherwise(F.col("mi") / ((F.col("hu") + F.col("hv")) / 2))
        .alias("nmi"),
    )


def _collect_clusters(params: DataFrame, what: str) -> list:
    """The parameters, a row for each cluster; never more than the bound plus one
    reach the driver."""
    rows = params.limit(MAX_CLUSTERS + 1).collect()
    if len(rows) > MAX_CLUSTERS:
        raise ValueError(f"{what}: more than {MAX_CLUSTERS} clusters")
    return rows


def centroids(df: DataFrame, x: str, c: str) -> list[tuple[int, list[float]]]:
    """Per-cluster mean vectors (Summarizer, JVM side), collected: k x dims."""
    m = df.groupBy(c).agg(Summarizer.mean(array_to_vector(F.col(x))).alias("m"))
    rows = _collect_clusters(m.select(c, vector_to_array("m").alias("m")).orderBy(c), "centroids")
    return [(int(r[c]), [float(v) for v in r["m"]]) for r in rows]


def _sq_dist(x: F.Column, center: list[float]) -> F.Column:
    cen = F.array(*[F.lit(v) for v in center])
    return F.aggregate(F.zip_with(x, cen, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, t: acc + t)


def distances_to_centroids(df: DataFrame, x: str, cents: list[tuple[int, list[float]]]) -> DataFrame:
    """ML-04/JN-10: Euclidean distance to every centroid (columns d<c>) and
    the nearest cluster (ties to the smaller id)."""
    out = df
    for cid, center in cents:
        out = out.withColumn(f"d{cid}", F.sqrt(_sq_dist(F.col(x), center)))
    pairs = F.array(*[F.struct(F.col(f"d{cid}").alias("d"), F.lit(cid).alias("c")) for cid, _ in cents])
    return out.withColumn("cluster_id", F.array_min(pairs)["c"].cast("int"))


def majority_clusters(df: DataFrame, c: str, y: str) -> list[int]:
    rows = _collect_clusters(df.groupBy(c).agg(F.avg(y).alias("r")).where("r > 0.5").select(c), "majority")
    return sorted(int(r[c]) for r in rows)


def distance_probability(dist: DataFrame, spam_clusters: list[int], k: int) -> DataFrame:
    """ML-05: spam probability 1 - sum(d spam clusters)/sum(d), prediction
    from the nearest cluster, confidence |d0 - d1| / max(d)."""
    ds = [F.col(f"d{i}") for i in range(k)]
    total = sum(ds[1:], ds[0])
    spam_d = sum((F.col(f"d{i}") for i in spam_clusters), F.lit(0.0))
    mx = F.greatest(*ds)
    return dist.select(
        "*",
        F.col("cluster_id").isin(spam_clusters).cast("int").alias("prediction") if spam_clusters else F.lit(0).alias("prediction"),
        F.when(total > 0, 1 - spam_d / total).otherwise(F.lit(0.5)).alias("spam_probability"),
        F.when(mx > 0, F.abs(ds[0] - ds[1]) / mx).otherwise(F.lit(0.5)).alias("confidence"),
    )


def silhouette_sq_euclidean(df: DataFrame, x: str, c: str) -> DataFrame:
    """Exact mean silhouette under squared Euclidean distance in O(n * k):
    sum_j |x_i - x_j|^2 over a cluster = n|x_i|^2 - 2 x_i.S + Q."""
    stats = df.groupBy(c).agg(
        F.count(F.lit(1)).alias("n"),
        Summarizer.sum(array_to_vector(F.col(x))).alias("s"),
        F.sum(F.aggregate(F.col(x), F.lit(0.0), lambda acc, v: acc + v * v)).alias("q"),
    )
    rows = _collect_clusters(stats.select(c, "n", vector_to_array("s").alias("s"), "q"), "silhouette")
    norm2 = F.aggregate(F.col(x), F.lit(0.0), lambda acc, v: acc + v * v)
    per = []
    for r in rows:
        sv = F.array(*[F.lit(float(v)) for v in r["s"]])
        dot = F.aggregate(F.zip_with(F.col(x), sv, lambda a, b: a * b), F.lit(0.0), lambda acc, t: acc + t)
        tot = F.lit(int(r["n"])) * norm2 - 2 * dot + F.lit(float(r["q"]))
        per.append(F.struct(F.lit(int(r[c])).alias("c"), F.lit(int(r["n"])).alias("n"), tot.alias("tot")))
    arr = F.array(*per)
    own = F.filter(arr, lambda e: e["c"] == F.col(c))[0]
    others = F.transform(F.filter(arr, lambda e: e["c"] != F.col(c)), lambda e: e["tot"] / e["n"])
    a = F.when(own["n"] > 1, own["tot"] / (own["n"] - 1))
    b = F.array_min(others)
    s = F.when((own["n"] <= 1) | b.isNull(), F.lit(0.0)).otherwise((b - a) / F.greatest(a, b))
    return df.select(s.alias("s")).agg(F.avg("s").alias("silhouette"), F.count(F.lit(1)).cast("long").alias("n_points"))


def scale_2d(df: DataFrame, px: str, py: str) -> DataFrame:
    """VEC-09 / SNK-11: scale a 2-D point into 0..100 by the min/max ranges
    (one-row aggregate, broadcast), clamped; 50 when a range is empty."""
    r = df.agg(F.min(px).alias("x0"), F.max(px).alias("x1"), F.min(py).alias("y0"), F.max(py).alias("y1"))

    def sc(v, lo, hi):
        return F.when(F.col(hi) > F.col(lo), F.least(F.lit(100.0), F.greatest(F.lit(0.0), (F.col(v) - F.col(lo)) / (F.col(hi) - F.col(lo)) * 100))).otherwise(F.lit(50.0))

    return attach_one_row(df, r).select("*", sc(px, "x0", "x1").alias("x_scaled"), sc(py, "y0", "y1").alias("y_scaled"))
