"""Registered query: Euclidean silhouette (AGG-30)."""

from __future__ import annotations

from pyspark.sql import functions as F

from msgscope.operators import clustering as CL
from msgscope.operators import silhouette as SI
from msgscope.plans.q_eval import SQL_SILHOUETTE
from msgscope.plans.registry import query
from msgscope.plans.rules import vector_cluster
from msgscope.sources.tables import read_table

SQL_EUCLIDEAN = f"""
WITH s AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, CAST((embedding[1] > 0) AS INTEGER) * 2 + CAST((embedding[2] > 0) AS INTEGER) AS c
           FROM embeddings ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id LIMIT {SI.MAX_POINTS}),
pair AS (SELECT a.vec_id, a.c AS own, b.c AS other, count(*) AS n, sum(list_distance(a.x, b.x)) AS tot FROM s a, s b GROUP BY 1, 2, 3),
per AS (SELECT vec_id, max(CASE WHEN own = other AND n > 1 THEN tot / (n - 1) END) AS a, min(CASE WHEN own <> other THEN tot / n END) AS b FROM pair GROUP BY vec_id)
SELECT round(avg(CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) = 0 THEN 0.0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette,
       CAST(count(*) AS BIGINT) AS n_points, (SELECT silhouette FROM ({SQL_SILHOUETTE})) AS squared_all, (SELECT count(*) FROM embeddings) AS n_all
FROM per"""


@query("silhouette_euclid", SQL_EUCLIDEAN)
def silhouette_euclid(spark, d):
    """AGG-30: over the sample, beside the squared form over all points."""
    e = read_table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), vector_cluster("embedding").alias("c"))
    r = SI.compared(e, "vec_id", "x", "c", CL.silhouette_sq_euclidean(e, "x", "c"))
    return r.select(F.round("silhouette", 6).alias("silhouette"), "n_points", F.round("squared_all", 6).alias("squared_all"), "n_all")
