"""Registered queries: saved splits, metadata, balance, sequences for a model,
feature-name selection, and the saved-analysis table (SNK-02/05/10, SRC-09/10,
AGG-07/10, SEQ-06..08, SMP-07/08, FLT-03, TOP-07/10)."""

from __future__ import annotations


from pyspark.sql import functions as F

from msgscope.functions import patterns as P
from msgscope.functions import text as T
from msgscope.operators import datasets as D
from msgscope.operators import history as H
from msgscope.operators import sampling as SM
from msgscope.operators import vectorize as V
from msgscope.operators.ranking import exact_quantiles
from msgscope.plans import sqlparts as S
from msgscope.plans.frames import SQL_CLEANED, SQL_MESSAGES, cleaned, with_ctes
from msgscope.plans.q_assembled import SQL_NAMES, split_rows
from msgscope.plans.q_assembled import assembled_names as _names
from msgscope.plans.q_sampling import SQL_FOLDS, SQL_SPLIT, TARGETS, _sql_rebalance
from msgscope.plans.q_service import HISTORY_OWNER, HISTORY_QUERY, SQL_ANALYSES, analyses
from msgscope.plans.q_vectors import MIN_FREQ, VOCAB_SIZE
from msgscope.plans.registry import query
from msgscope.session import materialize

BASE = with_ctes(SQL_MESSAGES, SQL_CLEANED, SQL_SPLIT).rstrip()


def _split(spark, d):
    return SM.stratified_split(cleaned(spark, d).select("msg_id", "label", "source"))


def _saved(spark, d) -> str:
    path = D.new_folder(spark, "split")
    D.save_split(_split(spark, d), path)
    return path


@query("saved_split", BASE + "\nSELECT split, source, CAST(count(*) AS BIGINT) AS n, round(avg(label), 6) AS spam_rate FROM split GROUP BY split, source")
def saved_split(spark, d):
    rows = D.load_split(spark, _saved(spark, d))
    return rows.groupBy("split", "source").agg(F.count("*").cast("long").alias("n"), F.round(F.avg("label"), 6).alias("spam_rate")).select(F.col("split").cast("string").alias("split"), "source", "n", "spam_rate")


SQL_METADATA = BASE + """
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) FILTER (split = 'train') AS BIGINT) AS n_train, CAST(count(*) FILTER (split = 'test') AS BIGINT) AS n_test,
       round(avg(label) FILTER (split = 'train'), 6) AS train_spam_rate, round(avg(label) FILTER (split = 'test'), 6) AS test_spam_rate,
       CAST(count(DISTINCT source) AS BIGINT) AS n_sources FROM split"""


@query("split_metadata", SQL_METADATA)
def split_metadata(spark, d):
    return D.load_metadata(spark, _saved(spark, d))


SQL_BALANCE = BASE + "," + _sql_rebalance(P.DEFAULT_SOFT_CAP).replace("\nSELECT r.msg_id, r.label, r.source FROM", ",\nbalanced AS (SELECT r.msg_id, r.label, r.source FROM") + """)
SELECT t.source, CAST(t.n AS BIGINT) AS n_before, CAST(coalesce(b.n, 0) AS BIGINT) AS n_after, round(t.r, 6) AS spam_rate_before, round(b.r, 6) AS spam_rate_after
FROM (SELECT source, count(*) AS n, avg(label) AS r FROM train GROUP BY source) t
LEFT JOIN (SELECT source, count(*) AS n, avg(label) AS r FROM balanced GROUP BY source) b ON t.source IS NOT DISTINCT FROM b.source"""


@query("balance_comparison", SQL_BALANCE)
def balance_comparison(spark, d):
    train = materialize(_split(spark, d).where("split = 'train'").select("msg_id", "label", "source"))
    return D.compare_balance(train, SM.rebalance(train, TARGETS, P.DEFAULT_SOFT_CAP))


SQL_BASE_PIPELINE = BASE + "," + _sql_rebalance(P.DEFAULT_SOFT_CAP).replace("\nSELECT r.msg_id, r.label, r.source FROM", ",\nbalanced AS (SELECT r.msg_id, r.label, r.source FROM") + """),
""" + SQL_FOLDS.replace("\ntrain AS (SELECT msg_id, label, source FROM split WHERE split = 'train'),\ntranked AS", "branked AS").replace("FROM train", "FROM balanced").replace("tranked", "branked").lstrip() + """
SELECT 'train' AS part, CAST(fold AS INTEGER) AS fold, CAST(count(*) AS BIGINT) AS n, CAST(sum(label) AS BIGINT) AS spam FROM folds GROUP BY fold
UNION ALL SELECT 'test', 0, CAST(count(*) AS BIGINT), CAST(sum(label) AS BIGINT) FROM split WHERE split = 'test'"""


@query("base_pipeline", SQL_BASE_PIPELINE)
def base_pipeline(spark, d):
    """SMP-07: clean, split, rebalance the training part only, fold it, save, read back."""
    rows = materialize(_split(spark, d))
    train = SM.rebalance(rows.where("split = 'train'").select("msg_id", "label", "source"), TARGETS, P.DEFAULT_SOFT_CAP)
    folds = SM.kfold_assign(train)
    test = rows.where("split = 'test'").select("msg_id", "label", "source", F.lit(0).alias("fold"))
    path = D.new_folder(spark, "base")
    every = folds.select("msg_id", "label", "source", "fold", F.lit("train").alias("part")).unionByName(test.withColumn("part", F.lit("test")))
    every.write.partitionBy("part").parquet(path)
    saved = spark.read.parquet(path)
    return saved.groupBy("part", "fold").agg(F.count("*").cast("long").alias("n"), F.sum("label").cast("long").alias("spam")).select(F.col("part").cast("string").alias("part"), F.col("fold").cast("int").alias("fold"), "n", "spam")


# --------------------------------------------------------------------------- SEQ-06..08
MOST_LEN = 128  # fixed value
SQL_SEQ_TRAIN = BASE + f""",
sq AS (SELECT c.msg_id, c.label, s.split, {S.tokens(S.clean_for_sequence('c.cleaned_text'), P.SEQ_TOKEN)} AS toks FROM cleaned c JOIN split s ON c.msg_id = s.msg_id),
cnt AS (SELECT token, count(*) AS count FROM (SELECT unnest(toks) AS token FROM sq WHERE split = 'train') GROUP BY token),
top AS (SELECT token, count FROM cnt ORDER BY count DESC, token ASC LIMIT {VOCAB_SIZE - len(P.SEQ_RESERVED)}),
vocab AS (SELECT token, row_number() OVER (ORDER BY count DESC, token ASC) - 1 + {len(P.SEQ_RESERVED)} AS idx FROM top WHERE count >= {MIN_FREQ}
          UNION ALL SELECT * FROM (VALUES {', '.join(f"('{t}', {i})" for t, i in P.SEQ_RESERVED)}) r(token, idx))"""
SQL_SEQ_ARRAYS = SQL_SEQ_TRAIN + f""",
cut AS (SELECT CAST(least(floor(quantile_cont(len(toks), 0.95)), {MOST_LEN}) AS INTEGER) AS n FROM sq),
pos AS (SELECT msg_id, unnest(toks[1:n]) AS token, unnest(range(1, len(toks[1:n]) + 1)) AS p FROM sq, cut WHERE split = 'test'),
ids AS (SELECT s.msg_id, list(coalesce(v.idx, 1) ORDER BY s.p) AS ids FROM pos s LEFT JOIN vocab v ON s.token = v.token GROUP BY s.msg_id)
SELECT q.msg_id, array_to_string(list_resize(coalesce(i.ids, []), n, 0), ' ') AS ids, CAST(q.label AS DOUBLE) AS label
FROM cut, sq q LEFT JOIN ids i ON q.msg_id = i.msg_id WHERE q.split = 'test'"""


def _sequences(spark, d):
    rows = split_rows(spark, d)
    return materialize(rows.select("msg_id", "label", "split", T.sequence_tokens(T.clean_for_sequence(F.col("cleaned_text"))).alias("toks")))


def _saved_vocabulary(spark, toks):
    path = D.new_folder(spark, "vocabulary")
    V.build_token_vocabulary(toks.where("split = 'train'"), "toks", VOCAB_SIZE, MIN_FREQ).write.parquet(path)
    return spark.read.parquet(path)


@query("sequence_arrays", SQL_SEQ_ARRAYS)
def sequence_arrays(spark, d):
    """SEQ-06/08: held-out rows as padded id arrays by the saved vocabulary of the
    training rows, cut at their suggested length, with the label as a number."""
    toks = _sequences(spark, d)
    test = toks.where("split = 'test'")
    lengths = exact_quantiles(toks.select(F.size("toks").alias("n")), "n", [0.95])
    cut = lengths.select(F.least(F.floor("q_0"), F.lit(MOST_LEN)).cast("int")).first()  # SEQ-05: a parameter of the model
    ids = V.encode_and_pad(test, "msg_id", "toks", _saved_vocabulary(spark, toks), cut[0] if cut and cut[0] is not None else MOST_LEN)
    return test.select("msg_id", F.col("label").cast("double").alias("label")).join(ids, "msg_id").select("msg_id", F.array_join("ids", " ").alias("ids"), "label")


SQL_SEQ_METADATA = SQL_SEQ_TRAIN + """
SELECT CAST((SELECT count(*) FROM vocab) AS BIGINT) AS vocab_size, CAST(count(*) FILTER (split = 'train') AS BIGINT) AS n_train,
       CAST(count(*) FILTER (split = 'test') AS BIGINT) AS n_test, round(avg(label) FILTER (split = 'train'), 6) AS train_spam_rate,
       round(avg(label) FILTER (split = 'test'), 6) AS test_spam_rate, round(avg(len(toks)), 6) AS mean_length, CAST(max(len(toks)) AS BIGINT) AS max_length FROM sq"""


@query("sequence_metadata", SQL_SEQ_METADATA)
def sequence_metadata(spark, d):
    """SEQ-07: sizes, lengths and spam rates of the sequence data."""
    toks = _sequences(spark, d)
    n = _saved_vocabulary(spark, toks).count()  # bounded by its size limit
    part = lambda p: F.sum(F.when(F.col("split") == p, 1).otherwise(0)).cast("long")
    rate = lambda p: F.round(F.avg(F.when(F.col("split") == p, F.col("label"))), 6)
    return toks.agg(
        F.lit(n).cast("long").alias("vocab_size"), part("train").alias("n_train"), part("test").alias("n_test"), rate("train").alias("train_spam_rate"),
        rate("test").alias("test_spam_rate"), F.round(F.avg(F.size("toks")), 6).alias("mean_length"), F.max(F.size("toks")).cast("long").alias("max_length"),
    )


# --------------------------------------------------------------------------- FLT-03, SMP-08
@query("feature_names_numeric", f"SELECT * FROM ({SQL_NAMES}) WHERE NOT starts_with(feature, 'tfidf_')")
def feature_names_numeric(spark, d):
    return D.numeric_names(_names(spark, d))


@query("feature_names_sampled", f"SELECT * FROM ({SQL_NAMES}) ORDER BY md5('42:' || feature), feature LIMIT 500")
def feature_names_sampled(spark, d):
    return D.sample_names(_names(spark, d), 500, P.DEFAULT_SEED)


# --------------------------------------------------------------------------- SNK-10, TOP-07/10
GOT_ID = 13003
SQL_GET = f"WITH {SQL_ANALYSES}\nSELECT id, user_id, message_text, array_to_string(selected_models, ',') AS models FROM analyses WHERE id = {GOT_ID} AND user_id = '{HISTORY_OWNER}'"


@query("history_get", SQL_GET)
def history_get(spark, d):
    return H.get_analysis(analyses(spark, d), HISTORY_OWNER, GOT_ID).select("id", "user_id", "message_text", F.array_join("selected_models", ",").alias("models"))


SQL_SORTED = f"""WITH {SQL_ANALYSES},
f AS (SELECT *, substr(message_text, 1, {P.SNIPPET_CHARS}) AS snip FROM analyses
      WHERE user_id = '{HISTORY_OWNER}' AND (contains(lower(substr(message_text, 1, {P.SNIPPET_CHARS})), lower('{HISTORY_QUERY}'))
            OR contains(lower(CAST(created_at AS VARCHAR)), lower('{HISTORY_QUERY}'))))
SELECT id, CAST(row_number() OVER (ORDER BY message_text, id DESC) AS BIGINT) AS position, CAST(count(*) OVER () AS BIGINT) AS total FROM f QUALIFY position <= 10"""


@query("history_sorted", SQL_SORTED)
def history_sorted(spark, d):
    """TOP-07 with another sort key and direction."""
    return H.search_page(analyses(spark, d), HISTORY_OWNER, HISTORY_QUERY, 1, 10, "snippet", False).select("id", "position", "total")


SQL_APPEND = f"""WITH {SQL_ANALYSES},
m AS (SELECT max(id) AS m FROM analyses),
n AS (SELECT m + row_number() OVER (ORDER BY created_at, message_text, id) AS id, user_id, created_at, message_text FROM analyses, m WHERE user_id = '{HISTORY_OWNER}')
SELECT id, user_id, message_text FROM analyses UNION ALL SELECT id, user_id, message_text FROM n"""


@query("history_append", SQL_APPEND)
def history_append(spark, d):
    """SNK-10: one owner's analyses saved a second time; new ids follow the rest.
    The table is written and read back."""
    a = analyses(spark, d)
    path = D.new_folder(spark, "analyses")
    H.append_analyses(a, a.where(F.col("user_id") == HISTORY_OWNER).drop("id")).write.parquet(path)
    return spark.read.parquet(path).select("id", "user_id", "message_text")


