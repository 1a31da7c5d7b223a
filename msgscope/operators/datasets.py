"""Saved datasets: the split with its metadata document, and its readers
(SNK-02, SRC-09, AGG-07, SEQ-06..08, FLT-03, SMP-08)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from msgscope.session import checkpoint_dir


def new_folder(spark: SparkSession, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), "datasets", f"{name}-{uuid.uuid4().hex[:8]}")


def split_metadata(rows: DataFrame) -> DataFrame:
    """AGG-07: one row on a split table (label, source, split), in one pass."""
    part = lambda p: F.sum(F.when(F.col("split") == p, 1).otherwise(0)).cast("long")
    rate = lambda p: F.round(F.avg(F.when(F.col("split") == p, F.col("label"))), 6)
    return rows.agg(
        F.count("*").cast("long").alias("n_rows"),
        part("train").alias("n_train"), part("test").alias("n_test"),
        rate("train").alias("train_spam_rate"), rate("test").alias("test_spam_rate"),
        F.countDistinct("source").cast("long").alias("n_sources"),
    )


def save_split(rows: DataFrame, path: str) -> None:
    """SNK-02: rows by split, and the metadata document beside them."""
    rows.write.partitionBy("split").parquet(os.path.join(path, "rows"))
    saved = rows.sparkSession.read.parquet(os.path.join(path, "rows"))
    doc = split_metadata(saved)
    doc.select(F.to_json(F.struct(*doc.columns)).alias("value")).coalesce(1).write.text(os.path.join(path, "metadata"))


def load_split(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """SRC-09: one part (only its files are read) or all."""
    rows = spark.read.parquet(os.path.join(path, "rows"))
    return rows.where(F.col("split") == split) if split else rows


def load_metadata(spark: SparkSession, path: str) -> DataFrame:
    schema = "n_rows long, n_train long, n_test long, train_spam_rate double, test_spam_rate double, n_sources long"
    doc = spark.read.text(os.path.join(path, "metadata"))
    return doc.select(F.from_json("value", schema).alias("m")).select("m.*")


def compare_balance(before: DataFrame, after: DataFrame) -> DataFrame:
    """AGG-10: rows and spam rate by source before and after, from one grouped
    pass over both; a source that is gone has 0 rows after."""
    both = before.select("source", "label", F.lit(0).alias("part")).unionByName(after.select("source", "label", F.lit(1).alias("part")))
    n = lambda p: F.sum(F.when(F.col("part") == p, 1).otherwise(0)).cast("long")
    rate = lambda p: F.round(F.avg(F.when(F.col("part") == p, F.col("label"))), 6)
    return both.groupBy("source").agg(n(0).alias("n_before"), n(1).alias("n_after"), rate(0).alias("spam_rate_before"), rate(1).alias("spam_rate_after"))


def numeric_names(names: DataFrame) -> DataFrame:
    """FLT-03: feature names that are no TF-IDF terms."""
    return names.where(~F.col("feature").startswith("tfidf_"))


def sample_names(names: DataFrame, n: int, seed: int) -> DataFrame:
    """SMP-08: ``n`` columns without replacement, the first in md5(seed:name) order."""
    return names.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "feature")), "feature").limit(n)
