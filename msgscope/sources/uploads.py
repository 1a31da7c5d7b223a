"""Whole files as input texts (BAT-04): size, encoding, blank and length checks,
with a table of what was turned away.

A folder is listed by metadata alone, and contents are read only of files within
the size bound (``length`` is pushed down to the file source), so one huge file
costs no memory.  Spark's file sources pass over empty files; these come from the
source's own list of paths, which the driver holds for any file source.  The checks are native and made on the bytes.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from msgscope.functions.text import strip_ws

#: Bytes of a file, characters of its text.
MAX_FILE_BYTES = 100 * 1024
MAX_TEXT_CHARS = 10_000

#: Reasons in the order of the checks.
TOO_LARGE, NOT_UTF8, EMPTY, TOO_LONG = "too_large", "not_utf8", "empty", "too_long"


def read_files(spark: SparkSession, path: str, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """(path, n_bytes, content) of every file below a folder; the content of a file
    above the bound is null and never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    fits = F.col("length") <= max_bytes
    read = files.where(fits).select("path", F.col("length").alias("n_bytes"), "content")
    nothing = F.lit(None).cast("binary").alias("content")
    left = files.where(~fits).select("path", F.col("length").alias("n_bytes"), nothing)
    empty = _listed(files).join(files.select("path"), "path", "left_anti").select("path", F.lit(0).cast("long").alias("n_bytes"), nothing)
    return read.unionByName(left).unionByName(empty)


def _listed(files: DataFrame) -> DataFrame:
    """(path) of every file of a file source, empty ones too.  Listed paths are URL
    encoded but for a plus sign, and have an empty host where the source has none."""
    listed = files.sparkSession.createDataFrame([(p,) for p in files.inputFiles()], "value string")
    plain = F.url_decode(F.replace("value", F.lit("+"), F.lit("%2B")))
    return listed.select(F.regexp_replace(plain, r"^([\w+.-]+):///", "$1:/").alias("path"))


def _reason(max_bytes: int, max_chars: int) -> Column:
    told = F.coalesce(F.col("n_bytes"), F.octet_length("content"), F.lit(0))
    return (
        F.when(told > max_bytes, TOO_LARGE)
        .when(~F.is_valid_utf8(F.col("content").cast("string")), NOT_UTF8)
        .when(F.coalesce(strip_ws(F.col("content").cast("string")), F.lit("")) == "", EMPTY)
        .when(F.char_length(F.col("content").cast("string")) > max_chars, TOO_LONG)
    )


def judged(files: DataFrame, max_bytes: int = MAX_FILE_BYTES, max_chars: int = MAX_TEXT_CHARS) -> DataFrame:
    """(path, n_bytes, text, reason) of files (path, n_bytes, content): a text where
    the reason is null, else the first reason that holds.  A null content within
    the bound is an empty file.  Rows are judged one by one: repeated paths stay,
    and further columns are dropped."""
    seen = files.select("path", "n_bytes", "content").withColumn("reason", _reason(max_bytes, max_chars))
    return seen.select("path", "n_bytes", F.when(F.col("reason").isNull(), F.col("content").cast("string")).alias("text"), "reason")


def ingest(files: DataFrame, out: str, max_bytes: int = MAX_FILE_BYTES, max_chars: int = MAX_TEXT_CHARS) -> None:
    """Judge once and write both tables in one pass."""
    told = judged(files, max_bytes, max_chars).withColumn("accepted", F.col("reason").isNull())
    told.write.partitionBy("accepted").parquet(os.path.join(out, "uploads"))


def _stored(spark: SparkSession, out: str) -> DataFrame:
    schema = "path string, n_bytes long, text string, reason string, accepted boolean"
    return spark.read.schema(schema).parquet(os.path.join(out, "uploads"))


def accepted(spark: SparkSession, out: str) -> DataFrame:
    """(path, n_bytes, text); only that partition is read."""
    return _stored(spark, out).where("accepted").select("path", "n_bytes", "text")


def rejected(spark: SparkSession, out: str) -> DataFrame:
    """(path, n_bytes, reason)."""
    return _stored(spark, out).where("NOT accepted").select("path", "n_bytes", "reason")
