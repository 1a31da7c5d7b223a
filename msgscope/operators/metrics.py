"""Classifier and curve metrics on any (label, score/prediction) table.

Everything is one pass of conditional aggregation or the two-level prefix
sums over the *distinct score* table; no global sort of raw rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from msgscope.operators.ranking import join_null_safe, ordered_prefix_sums
from msgscope.session import materialize


def _div0(num, den):
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def counts(df: DataFrame, label: str = "label", pred: str = "prediction", group_cols=None) -> DataFrame:
    g = list(group_cols or [])
    y, p = F.col(label), F.col(pred)
    return df.groupBy(*g).agg(
        F.sum(F.when((y == 1) & (p == 1), 1).otherwise(0)).cast("long").alias("tp"),
        F.sum(F.when((y == 0) & (p == 1), 1).otherwise(0)).cast("long").alias("fp"),
        F.sum(F.when((y == 0) & (p == 0), 1).otherwise(0)).cast("long").alias("tn"),
        F.sum(F.when((y == 1) & (p == 0), 1).otherwise(0)).cast("long").alias("fn"),
    )


def prf(c: DataFrame, keep=()) -> DataFrame:
    """accuracy / precision / recall / f1 (zero_division = 0) from counts."""
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    precision = _div0(tp, tp + fp)
    recall = _div0(tp, tp + fn)
    f1 = _div0(2 * tp, 2 * tp + fp + fn)
    return c.select(
        *keep,
        _div0(tp + tn, tp + fp + tn + fn).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        f1.alias("f1"),
    )


def confusion(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """2x2 grid (label, prediction, n) including empty cells, one pass."""
    c = counts(df, label, pred)
    return c.select(
        F.expr("stack(4, 0, 0, tn, 0, 1, fp, 1, 0, fn, 1, 1, tp) AS (label, prediction, n)")
    ).select(F.col("label").cast("int"), F.col("prediction").cast("int"), F.col("n").cast("long"))


def score_table(df: DataFrame, label: str = "label", score: str = "score", group_cols=None) -> DataFrame:
    """Distinct scores with positive/negative counts and running totals in
    descending score order (``cum_pos``, ``cum_neg``) plus group totals."""
    g = list(group_cols or [])
    d = distinct_scores(df, label, score, g)
    return with_running_totals(d, g)


def distinct_scores(df: DataFrame, label: str = "label", score: str = "score", group_cols=None) -> DataFrame:
    """(group, score, pos, neg), written once: all metrics at all thresholds
    follow from it."""
    return materialize(
        df.groupBy(*(group_cols or []), F.col(score).cast("double").alias("score")).agg(
            F.sum(F.col(label)).cast("long").alias("pos"), F.sum(1 - F.col(label)).cast("long").alias("neg")
        )
    )


def counts_at(d: DataFrame, threshold: float = 0.5, group_cols=None) -> DataFrame:
    """tp / fp / tn / fn from the distinct scores."""
    up = F.col("score") >= threshold
    n = lambda c, hit: F.sum(F.when(up == F.lit(hit), F.col(c)).otherwise(0)).cast("long")
    return d.groupBy(*(group_cols or [])).agg(
        n("pos", True).alias("tp"), n("neg", True).alias("fp"), n("neg", False).alias("tn"), n("pos", False).alias("fn")
    )


def with_running_totals(d: DataFrame, group_cols=None) -> DataFrame:
    g = list(group_cols or [])
    cum = ordered_prefix_sums(d, "score", ["pos", "neg"], descending=True, group_cols=g)
    if g:
        return join_null_safe(cum, d.groupBy(*g).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")), g)
    return _attach_totals(cum, d.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")))


def _attach_totals(cum: DataFrame, totals: DataFrame) -> DataFrame:
    # one-row totals: attach through a constant key (a broadcast hash join)
    k = "__one"
    return cum.withColumn(k, F.lit(1)).join(F.broadcast(totals.withColumn(k, F.lit(1))), k).drop(k)


def pr_roc_curve(st: DataFrame, group_cols=None) -> DataFrame:
    g = list(group_cols or [])
    tp, fp = F.col("cum_pos"), F.col("cum_neg")
    return st.select(
        *g,
        "score",
        tp.alias("tp"),
        fp.alias("fp"),
        _div0(tp, tp + fp).alias("precision"),
        _div0(tp, F.col("P")).alias("recall"),
        _div0(fp, F.col("N")).alias("fpr"),
    )


def auc_ap(st: DataFrame, group_cols=None) -> DataFrame:
    """ROC-AUC with mid-ranks for ties, and average precision
    sum((R_n - R_{n-1}) * P_n).  AUC is null for a single-class group."""
    g = list(group_cols or [])
    below = F.col("N") - F.col("cum_neg")
    return st.groupBy(*g).agg(
        F.when(
            (F.first("P") > 0) & (F.first("N") > 0),
            F.sum(F.col("pos") * (below + 0.5 * F.col("neg"))) / (F.first("P") * F.first("N")),
        ).alias("roc_auc"),
        F.when(
            F.first("P") > 0,
            F.sum(F.col("pos") / F.col("P") * (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg")))),
        ).alias("average_precision"),
    )


def best_threshold(st: DataFrame, metric: str = "f1") -> DataFrame:
    """First maximum over thresholds in ascending order (so ties pick the
    lowest threshold); NaN F1 counts as 0."""
    cur = pr_roc_curve(st)
    p, r = F.col("precision"), F.col("recall")
    cur = cur.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)))
    return cur.orderBy(F.col(metric).desc(), F.col("score").asc()).limit(1).select(
        F.col("score").alias("threshold"), "precision", "recall", "f1"
    )


def class_report(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """Per-class precision/recall/f1/support plus macro and weighted averages."""
    c = counts(df, label, pred)
    rows = c.select(
        F.expr(
            "stack(2, '0', tn, fn, fp, '1', tp, fp, fn) AS (class, hit, false_pos, false_neg)"
        )
    )
    per = rows.select(
        "class",
        _div0(F.col("hit"), F.col("hit") + F.col("false_pos")).alias("precision"),
        _div0(F.col("hit"), F.col("hit") + F.col("false_neg")).alias("recall"),
        _div0(2 * F.col("hit"), 2 * F.col("hit") + F.col("false_pos") + F.col("false_neg")).alias("f1"),
        (F.col("hit") + F.col("false_neg")).cast("long").alias("support"),
    )
    tot = per.agg(
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("wp"),
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("wr"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("wf"),
        F.sum("support").cast("long").alias("s"),
    )
    avgs = tot.select(
        F.expr("stack(2, 'macro avg', mp, mr, mf, s, 'weighted avg', wp, wr, wf, s) AS (class, precision, recall, f1, support)")
    )
    return per.unionByName(avgs)


def histogram(df: DataFrame, value: str, bins: int = 30, group_cols=None) -> DataFrame:
    """Density histogram on [0, 1]: count / (n * width) per bin (1..bins)."""
    g = list(group_cols or [])
    b = (F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)) + 1).cast("int")
    h = df.groupBy(*g, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*g)  # bins x groups rows
    return h.withColumn("density", F.col("n") / (F.sum("n").over(w) * (1.0 / bins))).withColumn(
        "n", F.col("n").cast("long")
    )
