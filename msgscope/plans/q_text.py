"""Registered queries: loading, validation, cleaning, tokenising, features."""

from __future__ import annotations

from pyspark.sql import functions as F

from msgscope.functions import patterns as P
from msgscope.functions import text as T
from msgscope.functions.features import FAMILY_A_NAMES, FAMILY_C_ORDER, family_a, family_b, family_c, features_of
from msgscope.operators.cleaning import clean_messages
from msgscope.operators.stats import spam_rate_by_source
from msgscope.plans import sqlfeatures as SF
from msgscope.plans import sqlparts as S
from msgscope.plans.frames import (
    SQL_CLEANED,
    SQL_MESSAGES,
    cleaned,
    documents,
    sql_normalize_label,
    sql_valid_text,
    with_ctes,
)
from msgscope.plans.registry import query
from msgscope.sources.tables import read_table, valid_text

# --------------------------------------------------------------------------- flagship
SQL_SPAM_RATE = with_ctes(SQL_MESSAGES, SQL_CLEANED) + """
SELECT source, CAST(count(*) AS BIGINT) AS total, CAST(sum(label) AS BIGINT) AS spam,
       CAST(sum(1 - label) AS BIGINT) AS ham, round(avg(label), 6) AS spam_rate
FROM cleaned GROUP BY ROLLUP (source)
"""


@query("spam_rate_by_source", SQL_SPAM_RATE)
def spam_rate(spark, d):
    """messages -> label -> valid -> clean -> spam rate per source + overall."""
    return spam_rate_by_source(cleaned(spark, d))


# --------------------------------------------------------------------------- PRJ-01
SQL_LABEL_NORMALIZE = f"""
SELECT event_id,
  {sql_normalize_label('event_type')} AS from_type,
  {sql_normalize_label('value')} AS from_value,
  {sql_normalize_label("CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100")} AS from_props,
  {sql_normalize_label('value > 50')} AS from_flag
FROM events
"""


@query("label_normalize", SQL_LABEL_NORMALIZE)
def label_normalize(spark, d):
    ev = read_table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("double") / 100
    return ev.select(
        "event_id",
        T.normalize_label(F.col("event_type")).alias("from_type"),
        T.normalize_label(F.col("value")).alias("from_value"),
        T.normalize_label(k).alias("from_props"),
        T.normalize_label(F.col("value") > 50).alias("from_flag"),
    )


# --------------------------------------------------------------------------- SET-01/02, FLT-01
SQL_UNION_SOURCES = f"""
WITH u AS (
  SELECT d.doc_id AS msg_id, d.text, {sql_normalize_label('l.toxic')} AS label, d.source
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
  UNION ALL
  SELECT conv_id * 1000 + turn, text, {sql_normalize_label('NULL')}, 'conversations:' || role FROM conversations
  UNION ALL
  SELECT item_id, text, {sql_normalize_label('NULL')}, 'benchmark' FROM benchmark
)
SELECT source, label, CAST(count(*) AS BIGINT) AS n FROM u WHERE {sql_valid_text('text')} GROUP BY source, label
"""


@query("union_sources", SQL_UNION_SOURCES)
def union_sources(spark, d):
    labelled = (
        read_table(spark, d, "documents")
        .join(read_table(spark, d, "labels"), "doc_id")
        .select(F.col("doc_id").alias("msg_id"), "text", T.normalize_label(F.col("toxic")).alias("label"), "source")
    )
    convs = read_table(spark, d, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("msg_id"),
        "text",
        T.normalize_label(F.lit(None).cast("string")).alias("label"),
        F.concat(F.lit("conversations:"), F.col("role")).alias("source"),
    )
    bench = read_table(spark, d, "benchmark").select(
        F.col("item_id").alias("msg_id"),
        "text",
        T.normalize_label(F.lit(None).cast("string")).alias("label"),
        F.lit("benchmark").alias("source"),
    )
    u = labelled.unionByName(convs).unionByName(bench)
    return u.where(valid_text(F.col("text"))).groupBy("source", "label").agg(F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------------------------- FLT-01/04
SQL_VALIDATE = f"""
SELECT doc_id AS msg_id, CAST(coalesce(length(text), 0) AS INTEGER) AS char_count,
  CASE WHEN NOT {sql_valid_text('text')} THEN 'empty'
       WHEN length(text) > {P.MAX_TEXT_CHARS} THEN 'too_long' ELSE 'ok' END AS status
FROM documents
"""


@query("messages_validate", SQL_VALIDATE)
def messages_validate(spark, d):
    docs = read_table(spark, d, "documents")
    return docs.select(
        F.col("doc_id").alias("msg_id"),
        F.coalesce(F.length("text"), F.lit(0)).cast("int").alias("char_count"),
        F.when(~valid_text(F.col("text")), "empty")
        .when(F.length("text") > P.MAX_TEXT_CHARS, "too_long")
        .otherwise("ok")
        .alias("status"),
    )


# --------------------------------------------------------------------------- TXT-01..12
SQL_CLEAN_TEXT = f"""
SELECT msg_id, cleaned_text, CAST(length(cleaned_text) AS INTEGER) AS text_length,
       CAST(len({S.words('cleaned_text')}) AS INTEGER) AS word_count
FROM (SELECT doc_id AS msg_id, {S.clean_text('text')} AS cleaned_text FROM documents)
WHERE length(cleaned_text) >= {P.MIN_CLEAN_LENGTH}
"""


@query("clean_text", SQL_CLEAN_TEXT)
def clean_text_q(spark, d):
    return clean_messages(documents(spark, d)).select("msg_id", "cleaned_text", "text_length", "word_count")


SQL_EMAIL_ARTIFACTS = f"SELECT doc_id AS msg_id, {S.clean_email_artifacts('text')} AS email_clean FROM documents"


@query("clean_email_artifacts", SQL_EMAIL_ARTIFACTS)
def clean_email_artifacts_q(spark, d):
    return documents(spark, d).select("msg_id", T.clean_email_artifacts(F.col("text")).alias("email_clean"))


SQL_FILTER_ARTIFACTS = f"""
SELECT msg_id, {S.filter_source_artifacts('e')} AS filtered
FROM (SELECT doc_id AS msg_id, {S.clean_email_artifacts('text')} AS e FROM documents)
"""


@query("filter_artifacts", SQL_FILTER_ARTIFACTS)
def filter_artifacts_q(spark, d):
    e = documents(spark, d).select("msg_id", T.clean_email_artifacts(F.col("text")).alias("e"))
    return e.select("msg_id", T.filter_source_artifacts(F.col("e")).alias("filtered"))


# --------------------------------------------------------------------------- TXT-15/16
SQL_SEQ_TOKENS = f"""
SELECT msg_id, q AS seq_text, CAST(len(toks) AS INTEGER) AS n_tokens, md5(array_to_string(toks, '|')) AS tokens_md5
FROM (SELECT msg_id, q, {S.tokens('q', P.SEQ_TOKEN)} AS toks
      FROM (SELECT doc_id AS msg_id, {S.clean_for_sequence('text')} AS q FROM documents))
"""


@query("sequence_tokens", SQL_SEQ_TOKENS)
def sequence_tokens_q(spark, d):
    q = documents(spark, d).select("msg_id", T.clean_for_sequence(F.col("text")).alias("q"))
    q = q.select("msg_id", "q", T.sequence_tokens(F.col("q")).alias("toks"))
    return q.select(
        "msg_id",
        F.col("q").alias("seq_text"),
        F.size("toks").cast("int").alias("n_tokens"),
        F.md5(F.array_join("toks", "|")).alias("tokens_md5"),
    )


# --------------------------------------------------------------------------- TXT-17..21
SQL_TFIDF_TOKENS = f"""
SELECT msg_id, CAST(len(toks) AS INTEGER) AS n_tokens, CAST(len(terms) AS INTEGER) AS n_terms,
       md5(array_to_string(terms, '|')) AS terms_md5
FROM (SELECT msg_id, toks, {S.with_bigrams('toks')} AS terms
      FROM (SELECT msg_id, {S.tokens(S.strip_accents('lower(cleaned_text)'), P.TFIDF_TOKEN)} AS toks
            FROM (SELECT doc_id AS msg_id, {S.clean_text('text')} AS cleaned_text FROM documents)
            WHERE length(cleaned_text) >= {P.MIN_CLEAN_LENGTH}))
"""


@query("tfidf_tokens", SQL_TFIDF_TOKENS)
def tfidf_tokens_q(spark, d):
    c = clean_messages(documents(spark, d)).select("msg_id", T.tfidf_tokens(F.col("cleaned_text"), True).alias("toks"))
    c = c.select("msg_id", "toks", T.with_bigrams(F.col("toks")).alias("terms"))
    return c.select(
        "msg_id",
        F.size("toks").cast("int").alias("n_tokens"),
        F.size("terms").cast("int").alias("n_terms"),
        F.md5(F.array_join("terms", "|")).alias("terms_md5"),
    )


# --------------------------------------------------------------------------- F-01..15
FAMILY_A_GROUPS = {
    "features_basic": ["char_count", "word_count", "sentence_count", "avg_word_length", "avg_sentence_length"],
    "features_spam": [
        "urgency_count", "money_count", "action_count", "suspicious_count", "has_url", "has_email", "has_phone",
        "currency_count", "has_price", "number_sequences",
    ],
    "features_char": [
        "exclamation_count", "question_count", "dot_count", "comma_count", "exclamation_ratio", "question_ratio",
        "punctuation_ratio", "upper_ratio", "consecutive_caps", "digit_count", "digit_ratio", "special_char_count",
        "special_char_ratio", "space_ratio",
    ],
    "features_lexical": ["unique_words", "unique_ratio", "max_word_repetition"],
}
assert sum(len(v) for v in FAMILY_A_GROUPS.values()) == len(FAMILY_A_NAMES) == 32

def _family_a_query(group: str):
    names = FAMILY_A_GROUPS[group]
    sql_cols = dict(SF.family_a("t"))
    sql = (
        "SELECT msg_id, "
        + ", ".join(f"{sql_cols[n]} AS {n}" for n in names)
        + " FROM (SELECT doc_id AS msg_id, coalesce(CAST(text AS VARCHAR), '') AS t FROM documents)"
    )

    def build(spark, d):
        return features_of(documents(spark, d), family_a, names)

    build.__name__ = group
    query(group, sql)(build)


for _g in FAMILY_A_GROUPS:
    _family_a_query(_g)


# --------------------------------------------------------------------------- F-20..22
SQL_FEATURES_TOKENS = (
    "SELECT msg_id, "
    + ", ".join(f"{e} AS {n}" for n, e in SF.family_b("cleaned_text"))
    + f" FROM (SELECT doc_id AS msg_id, {S.clean_text('text')} AS cleaned_text FROM documents)"
    + f" WHERE length(cleaned_text) >= {P.MIN_CLEAN_LENGTH}"
)


@query("features_tokens", SQL_FEATURES_TOKENS)
def features_tokens(spark, d):
    c = clean_messages(documents(spark, d))
    return c.select("msg_id", *[col.alias(n) for n, col in family_b(F.col("cleaned_text"))])


# --------------------------------------------------------------------------- F-30..50
SQL_FEATURES_CLUSTER = (
    "SELECT msg_id, "
    + ", ".join(f"{e} AS {n}" for n, e in SF.family_c("t", "low", "mlow", "c"))
    + f" FROM (SELECT msg_id, t, lower(t) AS low, {S.marked('lower(t)')} AS mlow, string_split(t, '') AS c"
    + f" FROM (SELECT doc_id AS msg_id, {S.clean_email_artifacts('text')} AS t FROM documents))"
)


@query("features_cluster", SQL_FEATURES_CLUSTER)
def features_cluster(spark, d):
    e = documents(spark, d).select("msg_id", T.clean_email_artifacts(F.col("text")).alias("t"))
    return features_of(e, family_c, FAMILY_C_ORDER, "t")


SQL_REPEATED_CHARS = f"""
SELECT msg_id, {SF.repeated_chars('c')} AS repeated_chars
FROM (SELECT msg_id, string_split(t, '') AS c FROM (SELECT doc_id AS msg_id, {S.clean_email_artifacts('text')} AS t FROM documents))
"""


@query("repeated_chars", SQL_REPEATED_CHARS)
def repeated_chars(spark, d):
    e = documents(spark, d).select("msg_id", T.clean_email_artifacts(F.col("text")).alias("t"))
    return e.select("msg_id", F.regexp_count(F.col("t"), F.lit(P.REPEATED_CHARS)).cast("int").alias("repeated_chars"))
