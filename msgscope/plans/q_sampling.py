"""Registered queries: exact stratified split, folds, rebalancing (SMP-01..07)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from msgscope.functions import patterns as P
from msgscope.operators import sampling as SM
from msgscope.plans.frames import SQL_CLEANED, SQL_MESSAGES, cleaned, with_ctes
from msgscope.plans.registry import query

SEED = P.DEFAULT_SEED
TARGETS = {"src0": 0.375, "src1": 0.375, "src2": None, "src3": None}  # like sms/email targets, others kept
TIGHT_CAP = 0.05  # with 20 sources the 0.42 default never binds; this one does


def _sql_rank(table: str, keys: str = "source, label") -> str:
    return (
        f"SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY md5('{SEED}:' || CAST(msg_id AS VARCHAR)), msg_id)"
        f" AS rnk FROM {table}"
    )


SQL_SPLIT = f"""
ranked AS ({_sql_rank('cleaned')}),
sizes AS (SELECT source, label, count(*) AS n FROM cleaned GROUP BY source, label),
q1 AS (SELECT *, sum(n) OVER () AS tot, CAST(ceil(sum(n) OVER () * {P.DEFAULT_TEST_SIZE}) AS BIGINT) AS ntest FROM sizes),
q2 AS (SELECT *, n * ntest AS num, CAST(floor(n * ntest / tot) AS BIGINT) AS fl FROM q1),
q3 AS (SELECT *, num - fl * tot AS frac, ntest - sum(fl) OVER () AS lft FROM q2),
q4 AS (SELECT source, label, fl + CASE WHEN row_number() OVER (ORDER BY frac DESC, coalesce(source, '') || '|||' || CAST(label AS VARCHAR))
              <= lft THEN 1 ELSE 0 END AS quota FROM q3),
split AS (SELECT r.msg_id, r.label, r.source, r.text_length, CASE WHEN r.rnk <= q.quota THEN 'test' ELSE 'train' END AS split
          FROM ranked r JOIN q4 q ON r.source IS NOT DISTINCT FROM q.source AND r.label = q.label)"""


def _split(spark, d):
    return SM.stratified_split(cleaned(spark, d).select("msg_id", "label", "source"))


SQL_STRATIFIED_SPLIT = with_ctes(SQL_MESSAGES, SQL_CLEANED, SQL_SPLIT) + "SELECT msg_id, split FROM split"


@query("stratified_split", SQL_STRATIFIED_SPLIT)
def stratified_split(spark, d):
    return _split(spark, d).select("msg_id", "split")


# --------------------------------------------------------------------------- SMP-02
SQL_SPLIT_BY_LABEL = with_ctes(SQL_MESSAGES, SQL_CLEANED) + f"""
, ranked AS ({_sql_rank('cleaned', 'label')}),
q1 AS (SELECT label, count(*) AS n, sum(count(*)) OVER () AS tot,
       CAST(ceil(sum(count(*)) OVER () * {P.DEFAULT_TEST_SIZE}) AS BIGINT) AS ntest FROM cleaned GROUP BY label),
q2 AS (SELECT *, n * ntest - CAST(floor(n * ntest / tot) AS BIGINT) * tot AS frac, CAST(floor(n * ntest / tot) AS BIGINT) AS fl FROM q1),
q3 AS (SELECT label, fl + CASE WHEN row_number() OVER (ORDER BY frac DESC, CAST(label AS VARCHAR)) <= ntest - sum(fl) OVER () THEN 1 ELSE 0 END AS quota FROM q2)
SELECT r.msg_id, CASE WHEN r.rnk <= q.quota THEN 'test' ELSE 'train' END AS split FROM ranked r JOIN q3 q ON r.label = q.label"""


@query("split_by_label", SQL_SPLIT_BY_LABEL)
def split_by_label(spark, d):
    """The split stratified by the label alone."""
    return SM.stratified_split(cleaned(spark, d).select("msg_id", "label"), strata=["label"]).select("msg_id", "split")


# --------------------------------------------------------------------------- AGG-05
SQL_SPLIT_DISTRIBUTION = with_ctes(SQL_MESSAGES, SQL_CLEANED, SQL_SPLIT) + """,
tagged AS (SELECT 'original' AS part, source, label FROM cleaned
           UNION ALL SELECT split, source, label FROM split)
SELECT part, source, CAST(count(*) AS BIGINT) AS n,
       round(count(*) / sum(count(*)) OVER (PARTITION BY part), 6) AS share, round(avg(label), 6) AS spam_rate
FROM tagged GROUP BY part, source
"""


@query("split_distribution", SQL_SPLIT_DISTRIBUTION.replace("\n,\ntagged", ",\ntagged"))
def split_distribution(spark, d):
    parts = F.explode(F.array(F.lit("original"), F.col("split")))
    tagged = _split(spark, d).select(parts.alias("part"), "source", "label")
    g = tagged.groupBy("part", "source").agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("r"))
    w = Window.partitionBy("part")  # parts x sources rows
    return g.select(
        "part", "source", F.col("n").cast("long"),
        F.round(F.col("n") / F.sum("n").over(w), 6).alias("share"), F.round("r", 6).alias("spam_rate"),
    )


# --------------------------------------------------------------------------- SMP-04, AGG-40
SQL_FOLDS = f"""
train AS (SELECT msg_id, label, source FROM split WHERE split = 'train'),
tranked AS ({_sql_rank('train')}),
tsizes AS (SELECT source, label, count(*) AS n FROM train GROUP BY source, label),
toff AS (SELECT source, label, coalesce(sum(n) OVER (ORDER BY coalesce(source, '') || '|||' || CAST(label AS VARCHAR)
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM tsizes),
folds AS (SELECT r.msg_id, r.label, r.source, CAST((o.start + r.rnk - 1) % {P.DEFAULT_FOLDS} + 1 AS INTEGER) AS fold
          FROM tranked r JOIN toff o ON r.source IS NOT DISTINCT FROM o.source AND r.label = o.label)"""


def _folds(spark, d):
    return SM.kfold_assign(_split(spark, d).where(F.col("split") == "train").select("msg_id", "label", "source"))


SQL_KFOLD = with_ctes(SQL_MESSAGES, SQL_CLEANED, SQL_SPLIT, SQL_FOLDS) + "SELECT msg_id, fold FROM folds"


@query("kfold_assign", SQL_KFOLD)
def kfold_assign(spark, d):
    return _folds(spark, d).select("msg_id", "fold")


SQL_FOLD_REPORT = with_ctes(SQL_MESSAGES, SQL_CLEANED, SQL_SPLIT, SQL_FOLDS) + """,
per AS (SELECT fold, count(*) AS val_size, sum(label) AS val_spam FROM folds GROUP BY fold)
SELECT fold, CAST(sum(val_size) OVER () - val_size AS BIGINT) AS train_size, CAST(val_size AS BIGINT) AS val_size,
       round((sum(val_spam) OVER () - val_spam) * 100.0 / (sum(val_size) OVER () - val_size), 6) AS train_spam_rate,
       round(val_spam * 100.0 / val_size, 6) AS val_spam_rate
FROM per
"""


@query("fold_report", SQL_FOLD_REPORT.replace("\n,\nper", ",\nper"))
def fold_report(spark, d):
    return SM.fold_report(_folds(spark, d))


# --------------------------------------------------------------------------- SMP-05/06
def _sql_rebalance(cap: float) -> str:
    tv = [(k, v) for k, v in TARGETS.items() if isinstance(v, (int, float)) and 0 < v < 1]
    values = ", ".join(f"('{k}', {float(v)})" for k, v in tv)
    return f"""
train AS (SELECT msg_id, label, source FROM split WHERE split = 'train'),
tranked AS ({_sql_rank('train')}),
tgt AS (SELECT * FROM (VALUES {values}) AS t(source, target)),
cnt AS (SELECT source, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS spam,
               sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS ham FROM train GROUP BY source),
c2 AS (SELECT c.*, t.target, CAST(floor(c.spam * (1 - t.target) / t.target) AS BIGINT) AS req
       FROM cnt c LEFT JOIN tgt t ON c.source = t.source),
c3 AS (SELECT *, CASE WHEN target IS NOT NULL AND spam > 0 AND req <= ham THEN req ELSE ham END AS ham_q FROM c2),
c4 AS (SELECT *, spam + ham_q AS n_src FROM c3),
c5 AS (SELECT *, CAST(floor(sum(n_src) OVER () * {float(cap)}) AS BIGINT) AS cap FROM c4),
quota AS (SELECT source,
  CASE WHEN n_src > cap THEN CAST(floor(cap * spam / n_src) AS BIGINT) ELSE spam END AS q1,
  CASE WHEN n_src > cap THEN CAST(floor(cap * ham_q / n_src) AS BIGINT) ELSE ham_q END AS q0 FROM c5)
SELECT r.msg_id, r.label, r.source FROM tranked r JOIN quota q ON r.source IS NOT DISTINCT FROM q.source
WHERE r.rnk <= CASE WHEN r.label = 1 THEN q.q1 ELSE q.q0 END"""


def _rebalanced(spark, d, cap):
    train = _split(spark, d).where(F.col("split") == "train").select("msg_id", "label", "source")
    return SM.rebalance(train, TARGETS, cap).select("msg_id", "label", "source")


@query("rebalance_train", with_ctes(SQL_MESSAGES, SQL_CLEANED, SQL_SPLIT) + "," + _sql_rebalance(P.DEFAULT_SOFT_CAP))
def rebalance_train(spark, d):
    return _rebalanced(spark, d, P.DEFAULT_SOFT_CAP)


@query("rebalance_capped", with_ctes(SQL_MESSAGES, SQL_CLEANED, SQL_SPLIT) + "," + _sql_rebalance(TIGHT_CAP))
def rebalance_capped(spark, d):
    return _rebalanced(spark, d, TIGHT_CAP)
