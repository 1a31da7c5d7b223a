"""Versioned model store (ML-19, SNK-06, BAT-03).

A version is a folder of its own: the fitted pipeline (if there is one), the table
of its quality figures, and the mapping from clusters to classes (if there is
one).  The manifest is written last, one row in one file, which the committer
puts in place by one rename: a reader takes the greatest version in the
manifests, so it sees a whole version or none of it.  A folder whose writer was
lost has no manifest and is never read.  Two writers at a time may give the same
number; the later one by its time of writing is taken.
"""

from __future__ import annotations

import os
import time
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MANIFEST = "model_id string, version long, written_us long, folder string, threshold double, has_model boolean, has_mapping boolean"


def _manifests(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(MANIFEST).parquet(os.path.join(root, "manifests"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def current(spark: SparkSession, root: str) -> DataFrame:
    """The manifest row of the latest version of each model."""
    latest = Window.partitionBy("model_id").orderBy(F.col("version").desc(), F.col("written_us").desc(), "folder")
    return _manifests(spark, root).withColumn("__n", F.row_number().over(latest)).where("__n = 1").drop("__n")


@dataclass
class Version:
    spark: SparkSession
    model_id: str
    version: int
    folder: str
    threshold: float
    has_model: bool
    has_mapping: bool

    def model(self) -> PipelineModel:
        if not self.has_model:
            raise LookupError(f"{self.model_id}: version {self.version} holds no fitted model")
        return PipelineModel.load(os.path.join(self.folder, "model"))

    def metrics(self) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.folder, "metrics"))

    def mapping(self) -> DataFrame:
        if not self.has_mapping:
            raise LookupError(f"{self.model_id}: version {self.version} holds no mapping")
        return self.spark.read.parquet(os.path.join(self.folder, "mapping"))

    def predict(self, scored: DataFrame) -> DataFrame:
        """``prediction`` by the stored threshold; a null score gives a null."""
        return scored.withColumn("prediction", (F.col("score") >= F.lit(self.threshold)).cast("int"))


def publish(root: str, model_id: str, metrics: DataFrame, threshold: float, model: PipelineModel | None = None, mapping: DataFrame | None = None) -> int:
    """Write a version and then its manifest; the number of the version.
    ``metrics``: (metric string, value double); ``mapping``: (cluster_id, label)."""
    spark = metrics.sparkSession
    folder = os.path.join(root, "versions", f"{model_id}-{uuid.uuid4().hex}")
    metrics.select("metric", "value").write.parquet(os.path.join(folder, "metrics"))
    if model is not None:
        model.write().save(os.path.join(folder, "model"))
    if mapping is not None:
        mapping.write.parquet(os.path.join(folder, "mapping"))
    last = _manifests(spark, root).where(F.col("model_id") == model_id).agg(F.max("version")).first()[0]
    version = (last or 0) + 1
    row = (model_id, version, time.time_ns() // 1000, folder, float(threshold), model is not None, mapping is not None)
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").parquet(os.path.join(root, "manifests"))
    return version


def latest(spark: SparkSession, root: str, model_id: str) -> Version:
    """The latest whole version; there is no default for a model never published."""
    row = current(spark, root).where(F.col("model_id") == model_id).first()
    if row is None:
        raise LookupError(f"no version of {model_id} in {root}")
    return Version(spark, row["model_id"], row["version"], row["folder"], row["threshold"], row["has_model"], row["has_mapping"])


def model_info(spark: SparkSession, root: str) -> DataFrame:
    """BAT-03: (model_id, version, threshold, metric, value) of the latest version of
    every model; a row with nulls for one without figures.  The store holds a few
    models, whose manifests are read on the driver to name their folders."""
    out = None
    for r in current(spark, root).orderBy("model_id").collect():
        told = spark.createDataFrame([(r["model_id"], r["version"], r["threshold"], 0)], "model_id string, version long, threshold double, __n int")
        own = spark.read.parquet(os.path.join(r["folder"], "metrics")).withColumn("__n", F.lit(0))
        one = told.join(own, "__n", "left").drop("__n")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "model_id string, version long, threshold double, metric string, value double")
