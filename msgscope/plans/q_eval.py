"""Registered queries: classifier metrics, curves, thresholds, clustering
metrics and centroid distances, driven by deterministic rule columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from msgscope.operators import clustering as CL
from msgscope.operators import metrics as MT
from msgscope.operators.ranking import join_null_safe
from msgscope.plans import sqlparts as S
from msgscope.plans.frames import SQL_MESSAGES, messages, with_ctes
from msgscope.plans.registry import query
from msgscope.plans.rules import LANG_CLUSTERS, lang_cluster, rule_score, vector_cluster
from msgscope.sources.tables import read_table


def _r6(c):
    return F.round(c, 6)


def sql_rule_score(t: str, wu: int = 40, wb: int = 200) -> str:
    u = S.count_class(t, r"\p{Lu}")
    e = S.count_literal(t, "!")
    L = f"greatest(1, length({t}))"
    return f"(floor(10000 * (1 - 1 / (1 + ({wu} * {u}) / {L} + ({wb} * {e}) / {L}))) / 10000.0)"


def sql_lang_cluster(col: str) -> str:
    whens = " ".join(f"WHEN {col} = '{lang}' THEN {i}" for i, lang in enumerate(LANG_CLUSTERS))
    return f"CAST(CASE {whens} ELSE {len(LANG_CLUSTERS)} END AS INTEGER)"


SQL_SCORED = f"""scored AS (
  SELECT msg_id, label, source, lang, score, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS prediction,
         {sql_lang_cluster('lang')} AS cluster_id
  FROM (SELECT *, {sql_rule_score('t')} AS score FROM (SELECT *, coalesce(text, '') AS t FROM messages)))"""
BASE = with_ctes(SQL_MESSAGES, SQL_SCORED)


def scored(spark, d):
    m = messages(spark, d, with_lang=True)
    s = m.withColumn("score", rule_score("text"))
    return s.select(
        "msg_id", "label", "source", "lang", "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("prediction"),
        lang_cluster("lang").alias("cluster_id"),
    )


# --------------------------------------------------------------------------- AGG-22
SQL_CONFUSION = BASE + """
SELECT CAST(l.label AS INTEGER) AS label, CAST(p.prediction AS INTEGER) AS prediction,
       CAST(count(s.msg_id) AS BIGINT) AS n
FROM (VALUES (0), (1)) l(label) CROSS JOIN (VALUES (0), (1)) p(prediction)
LEFT JOIN scored s ON s.label = l.label AND s.prediction = p.prediction
GROUP BY 1, 2
"""


@query("confusion", SQL_CONFUSION)
def confusion(spark, d):
    return MT.confusion(scored(spark, d))


# --------------------------------------------------------------------------- AGG-23
def _sql_prf(group: str = "") -> str:
    sel = f"{group}, " if group else ""
    return f"""SELECT {sel}
  round(CASE WHEN count(*) > 0 THEN sum(CASE WHEN label = prediction THEN 1 ELSE 0 END) / count(*) ELSE 0.0 END, 6) AS accuracy,
  round(CASE WHEN sum(prediction) > 0 THEN sum(label * prediction) / sum(prediction) ELSE 0.0 END, 6) AS precision,
  round(CASE WHEN sum(label) > 0 THEN sum(label * prediction) / sum(label) ELSE 0.0 END, 6) AS recall,
  round(CASE WHEN 2 * sum(label * prediction) + sum((1 - label) * prediction) + sum(label * (1 - prediction)) > 0
        THEN 2 * sum(label * prediction) / (2 * sum(label * prediction) + sum((1 - label) * prediction)
                                            + sum(label * (1 - prediction))) ELSE 0.0 END, 6) AS f1
FROM scored {'GROUP BY ' + group if group else ''}"""


@query("classification_metrics", BASE + _sql_prf())
def classification_metrics(spark, d):
    r = MT.prf(MT.counts(scored(spark, d)))
    return r.select(*[_r6(F.col(c)).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


# --------------------------------------------------------------------------- AGG-24/25/26
SQL_AUC_PARTS = """
ranks AS (
  SELECT source, label, score,
         rank() OVER (PARTITION BY source ORDER BY score) + (count(*) OVER (PARTITION BY source, score) - 1) / 2.0 AS r
  FROM scored),
auc AS (
  SELECT source, CASE WHEN sum(label) > 0 AND sum(1 - label) > 0 THEN
           (sum(CASE WHEN label = 1 THEN r ELSE 0 END) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * sum(1 - label))
         END AS roc_auc
  FROM ranks GROUP BY source)"""

SQL_METRICS_BY_SOURCE = BASE + "," + SQL_AUC_PARTS + f""",
prf AS ({_sql_prf('source')}),
base AS (SELECT source, CAST(count(*) AS BIGINT) AS sample_count, round(avg(label), 6) AS spam_rate FROM scored GROUP BY source)
SELECT b.source, b.sample_count, b.spam_rate, p.accuracy, p.precision, p.recall, p.f1, round(a.roc_auc, 6) AS roc_auc
FROM base b JOIN prf p ON b.source IS NOT DISTINCT FROM p.source JOIN auc a ON a.source IS NOT DISTINCT FROM b.source
"""


@query("metrics_by_source", SQL_METRICS_BY_SOURCE)
def metrics_by_source(spark, d):
    d1 = MT.distinct_scores(scored(spark, d), group_cols=["source"])
    c = MT.counts_at(d1, 0.5, ["source"])
    n = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    base = c.select("source", n.alias("sample_count"), _r6((F.col("tp") + F.col("fn")) / n).alias("spam_rate"))
    auc = MT.auc_ap(MT.with_running_totals(d1, ["source"]), group_cols=["source"])
    every = join_null_safe(join_null_safe(base, MT.prf(c, keep=["source"]), ["source"]), auc, ["source"])
    return every.select(
        "source", "sample_count", "spam_rate",
        *[_r6(F.col(x)).alias(x) for x in ("accuracy", "precision", "recall", "f1", "roc_auc")],
    )


# --------------------------------------------------------------------------- AGG-41
SQL_ACCURACY = BASE + """
SELECT CASE WHEN grouping(source) = 1 THEN 'overall' ELSE 'source' END AS level, source, CAST(count(*) AS BIGINT) AS n,
       CAST(sum(CASE WHEN label = prediction THEN 1 ELSE 0 END) AS BIGINT) AS n_right,
       round(sum(CASE WHEN label = prediction THEN 1 ELSE 0 END) / count(*), 6) AS accuracy
FROM scored GROUP BY ROLLUP (source)
"""


@query("accuracy_by_source", SQL_ACCURACY)
def accuracy_by_source(spark, d):
    """AGG-41: messages whose prediction is the expected label, overall and by source."""
    right = F.sum((F.col("label") == F.col("prediction")).cast("int"))
    level = F.when(F.grouping("source") == 1, "overall").otherwise("source")
    r = scored(spark, d).rollup("source").agg(level.alias("level"), F.count("*").cast("long").alias("n"), right.cast("long").alias("n_right"))
    return r.select("level", "source", "n", "n_right", _r6(F.col("n_right") / F.col("n")).alias("accuracy"))


SQL_CURVE = """
d AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM scored GROUP BY score),
c AS (SELECT score, pos, neg, sum(pos) OVER (ORDER BY score DESC) AS cum_pos, sum(neg) OVER (ORDER BY score DESC) AS cum_neg,
             sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM d)"""

SQL_ROC_AUC = BASE + "," + SQL_CURVE + """
SELECT round(CASE WHEN max(P) > 0 AND max(N) > 0 THEN sum(pos * (N - cum_neg + 0.5 * neg)) / (max(P) * max(N)) END, 6) AS roc_auc,
       round(CASE WHEN max(P) > 0 THEN sum(pos / P * (cum_pos / (cum_pos + cum_neg))) END, 6) AS average_precision
FROM c
"""


@query("roc_auc", SQL_ROC_AUC)
def roc_auc(spark, d):
    r = MT.auc_ap(MT.score_table(scored(spark, d)))
    return r.select(_r6(F.col("roc_auc")).alias("roc_auc"), _r6(F.col("average_precision")).alias("average_precision"))


# --------------------------------------------------------------------------- WIN-02, AGG-36
SQL_PR_CURVE = BASE + "," + SQL_CURVE + """
SELECT score, CAST(cum_pos AS BIGINT) AS tp, CAST(cum_neg AS BIGINT) AS fp,
       round(CASE WHEN cum_pos + cum_neg > 0 THEN cum_pos / (cum_pos + cum_neg) ELSE 0.0 END, 6) AS precision,
       round(CASE WHEN P > 0 THEN cum_pos / P ELSE 0.0 END, 6) AS recall,
       round(CASE WHEN N > 0 THEN cum_neg / N ELSE 0.0 END, 6) AS fpr
FROM c
"""


@query("pr_curve", SQL_PR_CURVE)
def pr_curve(spark, d):
    r = MT.pr_roc_curve(MT.score_table(scored(spark, d)))
    return r.select(
        "score", F.col("tp").cast("long"), F.col("fp").cast("long"),
        *[_r6(F.col(c)).alias(c) for c in ("precision", "recall", "fpr")],
    )


# --------------------------------------------------------------------------- WIN-04, ML-12
SQL_BEST_THRESHOLD = BASE + "," + SQL_CURVE + """,
f AS (SELECT score, CASE WHEN cum_pos + cum_neg > 0 THEN cum_pos / (cum_pos + cum_neg) ELSE 0.0 END AS p,
             CASE WHEN P > 0 THEN cum_pos / P ELSE 0.0 END AS r FROM c),
g AS (SELECT score, p, r, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1 FROM f)
SELECT score AS threshold, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1
FROM g ORDER BY f1 DESC, score ASC LIMIT 1
"""


@query("best_threshold", SQL_BEST_THRESHOLD)
def best_threshold(spark, d):
    r = MT.best_threshold(MT.score_table(scored(spark, d)))
    return r.select("threshold", *[_r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


# --------------------------------------------------------------------------- AGG-27
SQL_CLASS_REPORT = BASE + """,
k AS (SELECT sum(label * prediction) AS tp, sum((1 - label) * prediction) AS fp,
             sum((1 - label) * (1 - prediction)) AS tn, sum(label * (1 - prediction)) AS fn FROM scored),
per AS (
  SELECT '0' AS class, CASE WHEN tn + fn > 0 THEN tn / (tn + fn) ELSE 0.0 END AS precision,
         CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0.0 END AS recall,
         CASE WHEN 2 * tn + fn + fp > 0 THEN 2 * tn / (2 * tn + fn + fp) ELSE 0.0 END AS f1, tn + fp AS support FROM k
  UNION ALL
  SELECT '1', CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END,
         CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END, tp + fn FROM k),
allr AS (
  SELECT class, precision, recall, f1, support FROM per
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM per
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                   sum(f1 * support) / sum(support), sum(support) FROM per)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       CAST(support AS BIGINT) AS support FROM allr
"""


@query("class_report", SQL_CLASS_REPORT)
def class_report(spark, d):
    r = MT.class_report(scored(spark, d))
    return r.select("class", *[_r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")], "support")


# --------------------------------------------------------------------------- AGG-35
SQL_HISTOGRAM = BASE + """
SELECT label, CAST(least(floor(score * 30), 29) + 1 AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS n,
       round(count(*) / (sum(count(*)) OVER (PARTITION BY label) * (1.0 / 30)), 6) AS density
FROM scored GROUP BY 1, 2
"""


@query("score_histogram", SQL_HISTOGRAM)
def score_histogram(spark, d):
    h = MT.histogram(scored(spark, d), "score", 30, ["label"])
    return h.select("label", "bin", "n", _r6(F.col("density")).alias("density"))


# --------------------------------------------------------------------------- AGG-19/20/31, WIN-05
SQL_CLUSTER_COMPOSITION = BASE + f""",
cs AS (SELECT cluster_id, source, count(*) AS n FROM scored GROUP BY 1, 2),
dom AS (SELECT cluster_id, source, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, source) AS rk FROM cs)
SELECT CAST(k.k AS INTEGER) AS cluster_id, CAST(count(s.msg_id) AS BIGINT) AS size, round(avg(label), 6) AS spam_rate,
       CAST(CASE WHEN avg(label) > 0.5 THEN 1 ELSE 0 END AS INTEGER) AS mapped_class,
       any_value(d.source) AS dominant_source, CAST(count(DISTINCT s.source) AS BIGINT) AS n_sources
FROM range(0, {len(LANG_CLUSTERS) + 1}) k(k) LEFT JOIN scored s ON s.cluster_id = k.k LEFT JOIN dom d ON s.cluster_id = d.cluster_id AND d.rk = 1
GROUP BY k.k
"""


@query("cluster_composition", SQL_CLUSTER_COMPOSITION)
def cluster_composition(spark, d):
    return CL.composition(scored(spark, d), k=len(LANG_CLUSTERS) + 1).select(
        "cluster_id", "size", _r6(F.col("spam_rate")).alias("spam_rate"), "mapped_class", "dominant_source", "n_sources"
    )


SQL_CLUSTER_SOURCES = BASE + """
SELECT cluster_id, source, CAST(count(*) AS BIGINT) AS n,
       round(count(*) / sum(count(*)) OVER (PARTITION BY cluster_id), 6) AS share,
       CAST(sum(label) AS BIGINT) AS spam_n,
       round(CASE WHEN sum(sum(label)) OVER (PARTITION BY cluster_id) > 0
             THEN sum(label) / sum(sum(label)) OVER (PARTITION BY cluster_id) ELSE 0.0 END, 6) AS spam_share
FROM scored GROUP BY 1, 2
"""


@query("cluster_sources", SQL_CLUSTER_SOURCES)
def cluster_sources(spark, d):
    r = CL.source_shares(scored(spark, d))
    return r.select("cluster_id", "source", "n", _r6(F.col("share")).alias("share"), "spam_n", _r6(F.col("spam_share")).alias("spam_share"))


# --------------------------------------------------------------------------- AGG-22..25 via cluster mapping (JN-02/07)
SQL_CLUSTER_CLASSIFICATION = BASE + """,
cm AS (SELECT cluster_id, avg(label) AS rate, CASE WHEN avg(label) > 0.5 THEN 1 ELSE 0 END AS cls FROM scored GROUP BY 1),
sc2 AS (SELECT s.msg_id, s.label, s.source, c.rate AS score, coalesce(c.cls, 0) AS prediction
        FROM scored s LEFT JOIN cm c ON s.cluster_id = c.cluster_id),
d AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM sc2 GROUP BY score),
c AS (SELECT score, pos, neg, sum(pos) OVER (ORDER BY score DESC) AS cum_pos, sum(neg) OVER (ORDER BY score DESC) AS cum_neg,
             sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM d),
a AS (SELECT CASE WHEN max(P) > 0 AND max(N) > 0 THEN sum(pos * (N - cum_neg + 0.5 * neg)) / (max(P) * max(N)) END AS roc_auc,
             CASE WHEN max(P) > 0 THEN sum(pos / P * (cum_pos / (cum_pos + cum_neg))) END AS average_precision FROM c),
m AS (SELECT sum(CASE WHEN label = prediction THEN 1 ELSE 0 END) / count(*) AS accuracy,
             CASE WHEN sum(prediction) > 0 THEN sum(label * prediction) / sum(prediction) ELSE 0.0 END AS precision,
             CASE WHEN sum(label) > 0 THEN sum(label * prediction) / sum(label) ELSE 0.0 END AS recall,
             CASE WHEN 2 * sum(label * prediction) + sum((1 - label) * prediction) + sum(label * (1 - prediction)) > 0
                  THEN 2 * sum(label * prediction) / (2 * sum(label * prediction) + sum((1 - label) * prediction)
                       + sum(label * (1 - prediction))) ELSE 0.0 END AS f1 FROM sc2)
SELECT round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       round(roc_auc, 6) AS roc_auc, round(average_precision, 6) AS average_precision FROM m, a
"""


@query("cluster_classification", SQL_CLUSTER_CLASSIFICATION)
def cluster_classification(spark, d):
    s = CL.map_clusters(scored(spark, d))
    prf = MT.prf(MT.counts(s))
    auc = MT.auc_ap(MT.score_table(s, score="cluster_rate"))
    out = CL.attach_one_row(prf, auc)
    return out.select(*[_r6(F.col(c)).alias(c) for c in ("accuracy", "precision", "recall", "f1", "roc_auc", "average_precision")])


# --------------------------------------------------------------------------- AGG-28/29
def _sql_contingency(src: str, u: str, v: str, name: str) -> str:
    return f"""SELECT '{name}' AS dataset, * FROM (
  WITH ct AS (SELECT {u} AS u, {v} AS v, count(*) AS nij FROM {src} GROUP BY 1, 2),
  a AS (SELECT u, sum(nij) AS ai FROM ct GROUP BY u),
  b AS (SELECT v, sum(nij) AS bj FROM ct GROUP BY v),
  tot AS (SELECT sum(nij) AS n FROM ct),
  s AS (SELECT (SELECT sum(nij * (nij - 1) / 2.0) FROM ct) AS sij,
               (SELECT sum(ai * (ai - 1) / 2.0) FROM a) AS sa,
               (SELECT sum(bj * (bj - 1) / 2.0) FROM b) AS sb,
               (SELECT n * (n - 1) / 2.0 FROM tot) AS cn,
               (SELECT sum(nij / n * ln(n * nij / (ai * bj))) FROM ct JOIN a USING (u) JOIN b USING (v), tot) AS mi,
               (SELECT -sum(ai / n * ln(ai / n)) FROM a, tot) AS hu,
               (SELECT -sum(bj / n * ln(bj / n)) FROM b, tot) AS hv)
  SELECT round(CASE WHEN (sa + sb) / 2 - sa * sb / cn = 0 THEN 1.0
                    ELSE (sij - sa * sb / cn) / ((sa + sb) / 2 - sa * sb / cn) END, 6) AS ari,
         round(CASE WHEN hu + hv = 0 THEN 1.0 ELSE mi / ((hu + hv) / 2) END, 6) AS nmi
  FROM s)"""


SQL_ARI_NMI = (
    BASE
    + ", emb AS (SELECT vec_id, label, "
    + "CAST((embedding[1] > 0) AS INTEGER) * 2 + CAST((embedding[2] > 0) AS INTEGER) AS cluster_id FROM embeddings)\n"
    + _sql_contingency("scored", "label", "cluster_id", "messages")
    + "\nUNION ALL\n"
    + _sql_contingency("emb", "label", "cluster_id", "embeddings")
)


@query("ari_nmi", SQL_ARI_NMI)
def ari_nmi(spark, d):
    m = CL.ari_nmi(scored(spark, d), "label", "cluster_id").withColumn("dataset", F.lit("messages"))
    e = read_table(spark, d, "embeddings").select("label", vector_cluster("embedding").alias("cluster_id"))
    e = CL.ari_nmi(e, "label", "cluster_id").withColumn("dataset", F.lit("embeddings"))
    return m.unionByName(e).select("dataset", _r6(F.col("ari")).alias("ari"), _r6(F.col("nmi")).alias("nmi"))


# --------------------------------------------------------------------------- AGG-30 (squared Euclidean)
SQL_SILHOUETTE = """
WITH pts AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x,
               CAST((embedding[1] > 0) AS INTEGER) * 2 + CAST((embedding[2] > 0) AS INTEGER) AS c FROM embeddings),
dims AS (SELECT c, i, sum(x[i]) AS s FROM pts, range(1, 65) r(i) GROUP BY c, i),
cl AS (SELECT p.c, count(*) AS n, sum(list_sum(list_transform(x, lambda v: v * v))) AS q FROM pts p GROUP BY p.c),
cs AS (SELECT c, list(s ORDER BY i) AS sv FROM dims GROUP BY c),
dist AS (SELECT p.vec_id, p.c AS own, k.c AS other, k.n,
                (k.n * list_sum(list_transform(p.x, lambda v: v * v)) - 2 * list_dot_product(p.x, s.sv) + k.q) AS tot
         FROM pts p, cl k JOIN cs s ON s.c = k.c),
per AS (SELECT vec_id,
          max(CASE WHEN other = own THEN (CASE WHEN n > 1 THEN tot / (n - 1) END) END) AS a,
          min(CASE WHEN other <> own THEN tot / n END) AS b,
          max(CASE WHEN other = own THEN n END) AS own_n FROM dist GROUP BY vec_id)
SELECT round(avg(CASE WHEN own_n <= 1 OR b IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette,
       CAST(count(*) AS BIGINT) AS n_points
FROM per
"""


@query("silhouette_sqeuclid", SQL_SILHOUETTE)
def silhouette_sqeuclid(spark, d):
    e = read_table(spark, d, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("x"), vector_cluster("embedding").alias("c")
    )
    r = CL.silhouette_sq_euclidean(e, "x", "c")
    return r.select(_r6(F.col("silhouette")).alias("silhouette"), "n_points")


# --------------------------------------------------------------------------- ML-04/05, JN-10, VEC-09
SQL_EMB = """emb AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, CAST(label >= 5 AS INTEGER) AS y,
               CAST((embedding[1] > 0) AS INTEGER) * 2 + CAST((embedding[2] > 0) AS INTEGER) AS c FROM embeddings),
dims AS (SELECT c, i, avg(x[i]) AS m FROM emb, range(1, 65) r(i) GROUP BY c, i),
cent AS (SELECT c, list(m ORDER BY i) AS mv FROM dims GROUP BY c),
dist AS (SELECT e.vec_id, e.y, k.c, list_distance(e.x, k.mv) AS dd FROM emb e, cent k),
spamc AS (SELECT c FROM emb GROUP BY c HAVING avg(y) > 0.5)"""

SQL_CENTROID_DISTANCE = "WITH " + SQL_EMB + """
SELECT vec_id, CAST(arg_min(c, struct_pack(dd := dd, c := c)) AS INTEGER) AS cluster_id,
       round(max(CASE WHEN c = 0 THEN dd END), 6) AS d0, round(max(CASE WHEN c = 1 THEN dd END), 6) AS d1,
       round(max(CASE WHEN c = 2 THEN dd END), 6) AS d2, round(max(CASE WHEN c = 3 THEN dd END), 6) AS d3
FROM dist GROUP BY vec_id
"""


def _centroids(spark, d):
    e = read_table(spark, d, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("x"),
        (F.col("label") >= 5).cast("int").alias("y"), vector_cluster("embedding").alias("c"),
    )
    cents = CL.centroids(e, "x", "c")
    return e, cents


@query("centroid_distance", SQL_CENTROID_DISTANCE)
def centroid_distance(spark, d):
    e, cents = _centroids(spark, d)
    r = CL.distances_to_centroids(e, "x", cents)
    return r.select(
        "vec_id", "cluster_id", *[_r6(F.col(f"d{k}")).alias(f"d{k}") for k in range(4)]
    )


SQL_DISTANCE_PROBABILITY = "WITH " + SQL_EMB + """,
agg AS (SELECT vec_id, sum(dd) AS total, sum(CASE WHEN c IN (SELECT c FROM spamc) THEN dd ELSE 0 END) AS spam_d,
               max(dd) AS mx, max(CASE WHEN c = 0 THEN dd END) AS d0, max(CASE WHEN c = 1 THEN dd END) AS d1,
               arg_min(c, struct_pack(dd := dd, c := c)) AS nearest FROM dist GROUP BY vec_id)
SELECT vec_id, CAST(CASE WHEN nearest IN (SELECT c FROM spamc) THEN 1 ELSE 0 END AS INTEGER) AS prediction,
       round(CASE WHEN total > 0 THEN 1 - spam_d / total ELSE 0.5 END, 6) AS spam_probability,
       round(CASE WHEN mx > 0 THEN abs(d0 - d1) / mx ELSE 0.5 END, 6) AS confidence
FROM agg
"""


@query("distance_probability", SQL_DISTANCE_PROBABILITY)
def distance_probability(spark, d):
    e, cents = _centroids(spark, d)
    spam_clusters = CL.majority_clusters(e, "c", "y")
    r = CL.distance_probability(CL.distances_to_centroids(e, "x", cents), spam_clusters, k=4)
    return r.select(
        "vec_id", "prediction", _r6(F.col("spam_probability")).alias("spam_probability"),
        _r6(F.col("confidence")).alias("confidence"),
    )


SQL_POINT_2D = """
WITH p AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS px, CAST(embedding[2] AS DOUBLE) AS py FROM embeddings),
r AS (SELECT min(px) AS x0, max(px) AS x1, min(py) AS y0, max(py) AS y1 FROM p)
SELECT vec_id,
  round(CASE WHEN x1 > x0 THEN least(100.0, greatest(0.0, (px - x0) / (x1 - x0) * 100)) ELSE 50.0 END, 6) AS x_scaled,
  round(CASE WHEN y1 > y0 THEN least(100.0, greatest(0.0, (py - y0) / (y1 - y0) * 100)) ELSE 50.0 END, 6) AS y_scaled
FROM p, r
"""


@query("point_2d_scale", SQL_POINT_2D)
def point_2d_scale(spark, d):
    p = read_table(spark, d, "embeddings").select(
        "vec_id", F.element_at("embedding", 1).cast("double").alias("px"), F.element_at("embedding", 2).cast("double").alias("py")
    )
    r = CL.scale_2d(p, "px", "py")
    return r.select("vec_id", _r6(F.col("x_scaled")).alias("x_scaled"), _r6(F.col("y_scaled")).alias("y_scaled"))
