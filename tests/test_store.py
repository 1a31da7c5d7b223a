"""The model store: whole versions only, the latest one, nothing by default."""

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from msgscope.operators import store as ST


def test_versions(spark, tmp_path):
    root = f"{tmp_path}/store"
    with pytest.raises(LookupError):
        ST.latest(spark, root, "linear")
    assert ST.model_info(spark, root).count() == 0
    figures = lambda v: spark.createDataFrame([("f1", v), ("accuracy", None)], "metric string, value double")
    train = spark.createDataFrame([(Vectors.dense([float(i)]), i % 2 if i < 4 else 1) for i in range(10)], ["features", "label"])
    model = Pipeline(stages=[LogisticRegression(maxIter=5)]).fit(train)
    mapping = spark.createDataFrame([(0, 1), (1, 0)], "cluster_id int, label int")
    assert ST.publish(root, "linear", figures(0.5), 0.5) == 1
    assert ST.publish(root, "linear", figures(0.75), 0.3, model, mapping) == 2
    assert ST.publish(root, "rule", figures(None), 0.9) == 1
    # a writer that was lost before its manifest
    spark.createDataFrame([("f1", 1.0)], "metric string, value double").write.parquet(f"{root}/versions/linear-lost/metrics")
    v = ST.latest(spark, root, "linear")
    assert (v.version, v.threshold) == (2, 0.3)
    assert {r["metric"]: r["value"] for r in v.metrics().collect()} == {"f1": 0.75, "accuracy": None}
    assert sorted(map(tuple, v.mapping().collect())) == [(0, 1), (1, 0)]
    again = v.model().transform(train).select("probability").collect()
    assert again == model.transform(train).select("probability").collect()
    got = v.predict(spark.createDataFrame([(0.29,), (0.3,), (None,)], "score double")).select(F.collect_list("prediction"), F.count("*")).first()
    assert tuple(got) == ([0, 1], 3)
    info = {(r["model_id"], r["version"], r["metric"]): (r["threshold"], r["value"]) for r in ST.model_info(spark, root).collect()}
    assert info == {("linear", 2, "f1"): (0.3, 0.75), ("linear", 2, "accuracy"): (0.3, None), ("rule", 1, "f1"): (0.9, None), ("rule", 1, "accuracy"): (0.9, None)}
    with pytest.raises(LookupError):
        ST.latest(spark, root, "rule").model()
