"""Random search over boosted-tree parameters and the analysis of its trials
(ML-09/10, AGG-37, TOP-05)."""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What a trial draws (fixed ranges, in the terms of Spark's trees): kind, least,
#: most.  ``share`` is the share of features that a node may use.
SPACE = {
    "maxIter": ("int", 100, 1000),
    "stepSize": ("log", 1e-3, 0.3),
    "maxDepth": ("int", 3, 11),
    "minInstancesPerNode": ("int", 1, 9),
    "subsamplingRate": ("uniform", 0.5, 1.0),
    "featureSubsetStrategy": ("share", 0.5, 1.0),
    "minInfoGain": ("uniform", 0.0, 1.0),
}


def draw(n: int, seed: int, **bounds) -> list[dict]:
    """``n`` parameter sets; ``bounds`` narrow a parameter's range."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        one = {}
        for name, (kind, low, high) in SPACE.items():
            low, high = bounds.get(name, (low, high))
            if kind == "int":
                one[name] = rng.randint(low, high)
            elif kind == "log":
                one[name] = math.exp(rng.uniform(math.log(low), math.log(high)))
            else:
                value = rng.uniform(low, high)
                one[name] = str(round(value, 3)) if kind == "share" else value
        out.append(one)
    return out


def run_trials(train: DataFrame, trials: list[dict], folds: int, parallelism: int = 4, seed: int = 42) -> DataFrame:
    """(trial, mean_test_score, std_test_score, params as JSON): every set fitted
    on the exact folds (column ``fold``, 0-based) and scored by average precision."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator

    gbt = GBTClassifier(labelCol="label", featuresCol="features", seed=seed)
    grid = [{gbt.getParam(k): v for k, v in t.items()} for t in trials]
    cv = CrossValidator(
        estimator=gbt, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(metricName="areaUnderPR"),
        foldCol="fold", numFolds=folds, parallelism=parallelism, seed=seed,
    )
    m = cv.fit(train)
    rows = [(i, float(a), float(s), json.dumps(t)) for i, (t, a, s) in enumerate(zip(trials, m.avgMetrics, m.stdMetrics))]
    return train.sparkSession.createDataFrame(rows, "trial int, mean_test_score double, std_test_score double, params string")


def ranked(trials: DataFrame, top: int) -> DataFrame:
    """TOP-05: the best trials, ties by number."""
    w = Window.orderBy(F.col("mean_test_score").desc(), "trial")  # a row for each trial
    return trials.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def parameter_summary(trials: DataFrame, top: int = 20) -> DataFrame:
    """AGG-37: of the best trials, a numeric parameter's mean and population
    standard deviation; another's three most common values."""
    best = ranked(trials, top).select(F.explode(F.from_json("params", "map<string,string>")).alias("param", "value"))
    typed = best.withColumn("x", F.expr("try_cast(value AS double)"))
    numeric = typed.groupBy("param").agg(F.count("*").cast("long").alias("n"), F.count("x").cast("long").alias("n_numeric"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    counts = best.groupBy("param", "value").agg(F.count("*").cast("long").alias("c"))
    w = Window.partitionBy("param").orderBy(F.col("c").desc(), "value")  # at most ``top`` values a parameter
    common = counts.withColumn("k", F.row_number().over(w)).where("k <= 3").groupBy("param").agg(F.array_sort(F.collect_list(F.struct("k", "value"))).alias("v"))
    names = common.select("param", F.array_join(F.transform("v", lambda e: e["value"]), ",").alias("values"))
    is_number = F.col("n_numeric") == F.col("n")
    return numeric.join(names, "param").select(
        "param", "n", F.when(is_number, F.col("mean")).alias("mean"), F.when(is_number, F.col("std")).alias("std"), F.when(~is_number, F.col("values")).alias("most_common")
    )
