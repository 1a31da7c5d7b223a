"""Batch scoring with several models (BAT-01) and the per-model summary
(AGG-34)."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgscope.functions.service import confidence
from msgscope.plans.rules import rule_score

log = logging.getLogger(__name__)


def score_with_models(df: DataFrame, models: dict, text_col: str = "text", id_col: str = "msg_id") -> DataFrame:
    """One row per (message, model): ``model_id, msg_id, p, prediction``, from one
    scan of the messages.  A model whose expression can't be built is skipped
    (logged), the others run; if none can be, there are no rows."""
    scores = []
    for name, weights in models.items():
        try:
            scores.append(F.struct(F.lit(name).alias("model_id"), rule_score(text_col, *weights).cast("double").alias("p")))
        except Exception as exc:  # noqa: BLE001 - a failing model must not stop the batch
            log.warning("model %s skipped: %s", name, exc)
    each = F.array(*scores).cast("array<struct<model_id:string,p:double>>")
    rows = df.select(F.col(id_col).alias("msg_id"), F.explode(each).alias("s")).select("s.model_id", "msg_id", "s.p")
    return rows.withColumn("prediction", F.when(F.col("p") >= 0.5, 1).otherwise(0))


def summarize_batch(preds: DataFrame, requested: list[str]) -> DataFrame:
    """Per requested model: predictions, spam, ham, mean confidence, mean
    spam probability; models without predictions report zeros."""
    spark = preds.sparkSession
    req = spark.createDataFrame([(m,) for m in requested], "model_id string")  # the request list
    agg = preds.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("prediction").alias("spam"),
        F.avg(confidence(F.col("p"))).alias("c"),
        F.avg("p").alias("pp"),
    )
    j = req.join(agg, "model_id", "left")
    return j.select(
        "model_id",
        F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("predictions"),
        F.coalesce(F.col("spam"), F.lit(0)).cast("long").alias("spam"),
        (F.coalesce(F.col("n"), F.lit(0)) - F.coalesce(F.col("spam"), F.lit(0))).cast("long").alias("ham"),
        F.coalesce(F.col("c"), F.lit(0.0)).alias("avg_confidence"),
        F.coalesce(F.col("pp"), F.lit(0.0)).alias("avg_spam_probability"),
    )
