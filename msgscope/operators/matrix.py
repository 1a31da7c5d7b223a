"""Stored feature matrices (SNK-04, SRC-10, SRC-11): one Parquet row a document,
its features in the layout of Spark ML's sparse vectors, and the table of column
names beside them.

The layout is written natively (a struct of type, size, indices and values) and
read back as vectors by schema, so no function runs a row.  Identifiers, label
and other columns stand beside the vector, so a reader that needs only them, or
only the vectors, reads only those.
"""

from __future__ import annotations

import os

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from msgscope.operators.datasets import sample_names

SPARSE = 0  # the vector type's mark of a sparse vector


def write(rows: DataFrame, width: int, names: DataFrame, path: str) -> None:
    """``rows`` with ``indices`` (ascending) and ``values``, and names (idx, feature)."""
    vector = F.struct(
        F.lit(SPARSE).cast("tinyint").alias("type"), F.lit(width).cast("int").alias("size"),
        F.col("indices").cast("array<int>").alias("indices"), F.col("values").cast("array<double>").alias("values"),
    )
    rows.select(*[c for c in rows.columns if c not in ("indices", "values")], vector.alias("features")).write.parquet(os.path.join(path, "rows"))
    names.select("idx", "feature").coalesce(1).write.parquet(os.path.join(path, "names"))


def _schema(spark: SparkSession, path: str) -> StructType:
    return spark.read.parquet(os.path.join(path, "rows")).schema


def load(spark: SparkSession, path: str) -> DataFrame:
    """SRC-11: the rows with ``features`` as vectors, ready to train on."""
    fields = [StructField("features", VectorUDT()) if f.name == "features" else f for f in _schema(spark, path).fields]
    return spark.read.schema(StructType(fields)).parquet(os.path.join(path, "rows"))


def load_names(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(os.path.join(path, "names"))


def entries(spark: SparkSession, path: str, names: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, feature, value): the entries in the columns ``names`` (idx, feature);
    zeros are not stored.  The table of names is at most as long as the matrix is
    wide, and Spark picks the join by its size."""
    rows = spark.read.parquet(os.path.join(path, "rows")).select(*keep, F.arrays_zip("features.indices", "features.values").alias("e"))
    each = rows.select(*keep, F.explode_outer("e").alias("e")).where("e IS NOT NULL").select(*keep, F.col("e.indices").alias("idx"), F.col("e.values").alias("value"))
    return each.join(names, "idx").select(*keep, "feature", "value")


def sampled(spark: SparkSession, path: str, n: int, seed: int, keep: list[str]) -> DataFrame:
    """SRC-10: the entries of ``n`` columns drawn by seed; all of them, if fewer."""
    return entries(spark, path, sample_names(load_names(spark, path), n, seed), keep)
