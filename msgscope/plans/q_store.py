"""Registered queries: the versioned model store (ML-19, SNK-06, BAT-03)."""

from __future__ import annotations

from pyspark.sql import functions as F

from msgscope.operators import metrics as MT
from msgscope.operators import models as ML
from msgscope.operators import store as ST
from msgscope.operators.sampling import stratified_split
from msgscope.plans.frames import SQL_CLEANED, SQL_MESSAGES, cleaned, with_ctes
from msgscope.plans.q_eval import SQL_SCORED, _sql_prf, scored
from msgscope.plans.q_sampling import SQL_SPLIT
from msgscope.plans.registry import query
from msgscope.session import materialize

FIGURES = ("accuracy", "precision", "recall", "f1")

SQL_STORE = with_ctes(SQL_MESSAGES, SQL_CLEANED, SQL_SCORED, SQL_SPLIT).rstrip() + f""",
parts AS (SELECT s.label, s.score, p.split FROM scored s JOIN split p ON s.msg_id = p.msg_id),
d AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM parts WHERE split = 'train' GROUP BY score),
c AS (SELECT score, sum(pos) OVER (ORDER BY score DESC) AS cum_pos, sum(neg) OVER (ORDER BY score DESC) AS cum_neg, sum(pos) OVER () AS P FROM d),
f AS (SELECT score, CASE WHEN cum_pos + cum_neg > 0 THEN cum_pos / (cum_pos + cum_neg) ELSE 0.0 END AS p, CASE WHEN P > 0 THEN cum_pos / P ELSE 0.0 END AS r FROM c),
best AS (SELECT score AS threshold FROM f ORDER BY CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END DESC, score ASC LIMIT 1),
told AS (SELECT label, CASE WHEN score >= threshold THEN 1 ELSE 0 END AS prediction FROM parts, best WHERE split = 'test'),
figures AS ({_sql_prf().replace('FROM scored', 'FROM told')}),
long AS (UNPIVOT figures ON {', '.join(FIGURES)} INTO NAME metric VALUE value)
SELECT 'rule' AS model_id, CAST(2 AS BIGINT) AS version, threshold, metric, value FROM long, best
UNION ALL SELECT 'rule', CAST(2 AS BIGINT), threshold, 'predicted_spam', CAST((SELECT sum(prediction) FROM told) AS DOUBLE) FROM best"""


def _long(figures):
    return figures.select(F.explode(F.create_map(*[x for m in FIGURES for x in (F.lit(m), F.col(m))])).alias("metric", "value"))


@query("model_store", SQL_STORE)
def model_store(spark, d):
    """Train writes: a version at 0.5, then one at the best threshold of the training
    part, each with its figures on the test part.  Scoring reads the latest one: its
    figures (BAT-03), and how many test rows its threshold calls spam."""
    split = stratified_split(cleaned(spark, d).select("msg_id", "label", "source")).select("msg_id", "split")
    rows = materialize(scored(spark, d).select("msg_id", "label", "score").join(split, "msg_id"))
    test = rows.where("split = 'test'").select("label", "score")
    best = MT.best_threshold(MT.score_table(rows.where("split = 'train'"))).first()
    root = ML.model_path(spark, "store")
    for threshold in (0.5, best["threshold"] if best else 0.5):
        told = test.withColumn("prediction", (F.col("score") >= F.lit(threshold)).cast("int"))
        ST.publish(root, "rule", _long(MT.prf(MT.counts(told))), threshold)
    reader = ST.latest(spark, root, "rule")
    info = ST.model_info(spark, root).select("model_id", "version", "threshold", "metric", F.round("value", 6).alias("value"))
    spam = reader.predict(test).agg(F.sum("prediction").cast("double").alias("value"))
    told = spam.select(*[F.lit(x).alias(c) for c, x in (("model_id", reader.model_id), ("version", reader.version), ("threshold", reader.threshold), ("metric", "predicted_spam"))], "value")
    return info.unionByName(told.withColumn("version", F.col("version").cast("long")))
