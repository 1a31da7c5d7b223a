"""Common input frames for the registered queries, Spark side and SQL side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from msgscope.functions import patterns as P
from msgscope.functions.features import FAMILY_A_NAMES, family_a, features_of
from msgscope.functions.text import normalize_label
from msgscope.operators.cleaning import clean_messages, spread
from msgscope.plans import sqlparts as S
from msgscope.sources.tables import read_table, valid_text


# ----------------------------------------------------------------- Spark side
def documents(spark: SparkSession, d: str) -> DataFrame:
    """Every document as ``(msg_id, text, lang, source)``, spread for CPU work."""
    return spread(read_table(spark, d, "documents")).select(
        F.col("doc_id").alias("msg_id"), F.col("text").cast("string").alias("text"), "lang", "source"
    )


def messages(spark: SparkSession, d: str, with_lang: bool = False) -> DataFrame:
    """Labelled messages: documents joined with labels, label = toxic."""
    labels = read_table(spark, d, "labels").select(
        F.col("doc_id").alias("msg_id"), normalize_label(F.col("toxic")).alias("label")
    )
    cols = ["msg_id", "text", "label", "source"] + (["lang"] if with_lang else [])
    return documents(spark, d).join(labels, "msg_id").where(valid_text(F.col("text"))).select(*cols)


def cleaned(spark: SparkSession, d: str, with_lang: bool = False) -> DataFrame:
    return clean_messages(messages(spark, d, with_lang))


def features_a(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d)
    return features_of(m, family_a, FAMILY_A_NAMES, keep=["msg_id", "label", "source"])


# ------------------------------------------------------------------- SQL side
def sql_normalize_label(expr: str) -> str:
    s = f"lower({S.strip(f'CAST({expr} AS VARCHAR)')})"
    spam = ", ".join(S.lit(x) for x in P.SPAM_LABELS)
    ham = ", ".join(S.lit(x) for x in P.HAM_LABELS)
    num = f"TRY_CAST({s} AS DOUBLE)"
    return (
        f"CAST(CASE WHEN {s} IN ({spam}) THEN 1 WHEN {s} IN ({ham}) THEN 0 "
        f"WHEN {num} IS NOT NULL AND NOT isnan({num}) AND {num} > 0.5 THEN 1 ELSE 0 END AS INTEGER)"
    )


def sql_valid_text(expr: str) -> str:
    return f"({expr} IS NOT NULL AND {S.strip(expr)} <> '')"


SQL_MESSAGES = f"""messages AS (
  SELECT d.doc_id AS msg_id, CAST(d.text AS VARCHAR) AS text, {sql_normalize_label('l.toxic')} AS label,
         d.source, d.lang
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
  WHERE {sql_valid_text('d.text')}
)"""

SQL_CLEANED = f"""cleaned AS (
  SELECT msg_id, label, source, lang, cleaned_text, CAST(length(cleaned_text) AS INTEGER) AS text_length,
         CAST(len({S.words('cleaned_text')}) AS INTEGER) AS word_count
  FROM (SELECT *, {S.clean_text('text')} AS cleaned_text FROM messages)
  WHERE length(cleaned_text) >= {P.MIN_CLEAN_LENGTH}
)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
