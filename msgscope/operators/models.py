"""Model fit and scoring as Spark ML jobs (ML-01..19, VEC-05..08).

One ``Pipeline`` holds feature assembly, scaling and the estimator; it is
fitted on the training split, saved under the cluster's shared checkpoint
folder and loaded again for scoring, so training and serving use the same
artefact (no train/serve skew).
"""

from __future__ import annotations

import math
import os
import uuid

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgscope.session import checkpoint_dir


def model_path(spark, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), "models", f"{name}-{uuid.uuid4().hex[:8]}")


def save_and_reload(model: PipelineModel, path: str) -> PipelineModel:
    model.write().overwrite().save(path)
    return PipelineModel.load(path)


ROWS_A_TASK = 64  # of a tree fit, as its root: see ``tree_tasks``
FEW_ROWS = 1 << 12  # of a tree fit, that one task may hold


def tree_tasks(rows: int) -> int:
    """Tasks of a fit of trees on wide rows.  Each sends a histogram of every column
    for a node to the node's one task, and holds its share of the rows, so both grow
    with the root of the rows."""
    return max(8, math.isqrt(rows // ROWS_A_TASK))


def for_trees(train: DataFrame) -> DataFrame:
    """The rows in even shares on ``tree_tasks``: a file of the stored matrix may hold
    any number of rows, and each becomes as wide as the matrix in the fit.  Where one
    task could hold them all, they stay in their files."""
    rows = train.count()
    n = tree_tasks(rows)
    return train.repartition(n) if rows > FEW_ROWS else train.coalesce(n)


def fit_kmeans(train: DataFrame, features: list[str], k: int = 3, n_init: int = 10, seed: int = 42, max_iter: int = 300):
    """k-means on standardised features; ``n_init`` seeds, lowest cost kept
    (each fit is a distributed job)."""
    best, best_cost = None, None
    for i in range(n_init):
        pipe = Pipeline(
            stages=[
                VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="keep"),
                StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
                KMeans(k=k, seed=seed + i, maxIter=max_iter, featuresCol="features", predictionCol="cluster_id"),
            ]
        )
        m = pipe.fit(train)
        cost = m.stages[-1].summary.trainingCost
        if best_cost is None or cost < best_cost:
            best, best_cost = m, cost
    return best, best_cost


def fit_gbt(train: DataFrame, features: list[str], seed: int = 42, max_iter: int = 50, max_depth: int = 5):
    pipe = Pipeline(
        stages=[
            VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"),
            GBTClassifier(labelCol="label", featuresCol="features", maxIter=max_iter, maxDepth=max_depth, seed=seed),
        ]
    )
    return pipe.fit(train)


def spam_probability(scored: DataFrame) -> DataFrame:
    """ML-14: probability of class 1 from the ML probability vector."""
    return scored.withColumn("score", vector_to_array("probability").getItem(1))


def importances(spark, model: PipelineModel, features: list[str]) -> DataFrame:
    """ML-13/JN-06: feature importances joined to names by index."""
    imp = model.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame([(i, f, float(v)) for i, (f, v) in enumerate(zip(features, imp))], "idx int, feature string, importance double")


def fit_pca_2d(train: DataFrame, features: list[str]):
    """VEC-08: standardised features -> 2 principal components, with each
    component's sign fixed so its largest-magnitude loading is positive."""
    pipe = Pipeline(
        stages=[
            VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="keep"),
            StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True),
            PCA(k=2, inputCol="scaled", outputCol="pc"),
        ]
    )
    m = pipe.fit(train)
    loadings = m.stages[-1].pc.toArray()  # dims x 2, bounded by the feature count
    signs = [1.0 if loadings[abs(loadings[:, j]).argmax(), j] >= 0 else -1.0 for j in range(2)]
    return m, signs, m.stages[-1].explainedVariance.toArray().tolist()


def pc_columns(df: DataFrame, signs: list[float]) -> DataFrame:
    arr = vector_to_array("pc")
    return df.withColumn("px", arr.getItem(0) * F.lit(signs[0])).withColumn("py", arr.getItem(1) * F.lit(signs[1]))
