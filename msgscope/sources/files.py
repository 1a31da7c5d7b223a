"""Loaders for differently shaped labelled-message files (SRC-01..07) and
their union (SET-01).

Each loader returns ``(text, label, source)`` with the label normalised
(PRJ-01) and invalid rows dropped (FLT-01).  A file without the expected
columns yields an empty frame with the target schema; a missing file is
skipped; when no source exists at all the union raises.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from msgscope.functions.text import normalize_label
from msgscope.sources.tables import valid_text

log = logging.getLogger(__name__)

OUT_SCHEMA = "text string, label int, source string"
JSON_SCHEMA = StructType([StructField("text", StringType()), StructField("label", StringType())])


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], OUT_SCHEMA)


def _csv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    return (
        spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
        .option("encoding", encoding).option("mode", "PERMISSIVE").csv(path)
    )


def _finish(df: DataFrame, text_col: str, label_col: str, source: str) -> DataFrame:
    out = df.select(
        F.col(text_col).cast("string").alias("text"), normalize_label(F.col(label_col)).alias("label"), F.lit(source).alias("source")
    )
    return out.where(valid_text(F.col("text")))


def _pick(df: DataFrame, text_candidates: list[str], label_candidates: list[str]):
    cols = set(df.columns)
    t = next((c for c in text_candidates if c in cols), None)
    lab = next((c for c in label_candidates if c in cols), None)
    return t, lab


def load_csv_source(spark: SparkSession, path: str, source: str, text_cols: list[str], label_cols: list[str], encoding: str = "UTF-8"):
    if not _exists(spark, path):
        log.warning("source %s: %s not found, skipped", source, path)
        return None
    df = _csv(spark, path, encoding)
    t, lab = _pick(df, text_cols, label_cols)
    if t is None or lab is None:
        log.warning("source %s: expected columns missing in %s", source, path)
        return _empty(spark)
    return _finish(df, t, lab, source)


def load_sms(spark, path):
    """SRC-01: latin-1 CSV, ``v2`` text, ``v1`` label."""
    return load_csv_source(spark, path, "sms", ["v2"], ["v1"], encoding="ISO-8859-1")


def load_email(spark, path):
    """SRC-02: label column ``spam`` or ``label``."""
    return load_csv_source(spark, path, "email", ["text"], ["spam", "label"])


def load_mix(spark, path):
    """SRC-03."""
    return load_csv_source(spark, path, "mix_email_sms", ["text"], ["label"])


def load_youtube(spark, path):
    """SRC-04: ``CONTENT`` text, ``CLASS`` label."""
    return load_csv_source(spark, path, "youtube", ["CONTENT"], ["CLASS"])


def load_review(spark, path):
    """SRC-05: JSON lines; malformed lines and lines without both keys are
    skipped; ``"label": null`` is kept (normalised to 0)."""
    if not _exists(spark, path):
        log.warning("source review: %s not found, skipped", path)
        return None
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    keys = F.json_object_keys("value")  # null for malformed JSON / non-objects
    ok = lines.where(keys.isNotNull() & F.array_contains(keys, "text") & F.array_contains(keys, "label"))
    parsed = ok.select(F.from_json("value", JSON_SCHEMA).alias("j")).select("j.text", "j.label")
    return _finish(parsed, "text", "label", "review")


LOADERS = {"sms": load_sms, "email": load_email, "mix_email_sms": load_mix, "youtube": load_youtube, "review": load_review}


def union_sources(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """SET-01 / SRC-06: union every present source; stop when none exists."""
    parts = []
    for source, path in paths.items():
        df = LOADERS[source](spark, path)
        if df is not None:
            parts.append(df)
    if not parts:
        raise FileNotFoundError("no source file found")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
