"""Readers for the parquet tables and the rule for usable text."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from msgscope.functions import patterns as P
from msgscope.session import ship

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def valid_text(c) -> F.Column:
    """FLT-01: text present and not blank."""
    return c.isNotNull() & c.rlike(f"[^{P.SPACE}]")

