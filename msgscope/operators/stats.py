"""Aggregations and statistics (AGG-01..18, PRJ-11/12).

Wide one-pass aggregates are computed first and only their one-row result
is turned long with ``stack`` (no row explosion of the data).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from msgscope.functions import patterns as P
from msgscope.operators.ranking import exact_quantiles
from msgscope.session import materialize


def _stack_sql(items: list[tuple[str, ...]], names: list[str]) -> str:
    body = ", ".join(", ".join(it) for it in items)
    return f"stack({len(items)}, {body}) AS ({', '.join(names)})"


def _q(name: str) -> str:
    return "'" + name.replace("'", "\\'") + "'"


def counts_by_source(df: DataFrame) -> DataFrame:
    """AGG-01: rows per source and share of all rows (percent, 2 decimals)."""
    per = df.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    tot = Window.partitionBy()  # one row per source
    return per.select(
        "source", F.col("n").cast("long"), F.round(F.col("n") * 100.0 / F.sum("n").over(tot), 2).alias("pct")
    )


def spam_rate_by_source(df: DataFrame) -> DataFrame:
    """AGG-03: total / spam / ham / spam rate per source plus the overall row
    (``source`` null) in one pass with ``rollup``."""
    return df.rollup("source").agg(
        F.count(F.lit(1)).cast("long").alias("total"),
        F.sum("label").cast("long").alias("spam"),
        F.sum(1 - F.col("label")).cast("long").alias("ham"),
        F.round(F.avg("label"), 6).alias("spam_rate"),
    )


def describe(df: DataFrame, col: str, group_cols=None) -> DataFrame:
    """AGG-06: count, mean, std (n-1), min, 25/50/75 %, max (exact)."""
    g = list(group_cols or [])
    df = materialize(df.select(*g, col))  # read twice: the aggregate and the quantiles
    base = df.groupBy(*g).agg(
        F.count(F.col(col)).cast("long").alias("count"),
        F.avg(col).alias("mean"),
        F.stddev_samp(col).alias("std"),
        F.min(col).cast("double").alias("min"),
        F.max(col).cast("double").alias("max"),
    )
    qs = exact_quantiles(df, col, [0.25, 0.5, 0.75], g)
    qs = qs.select(*g, F.col("q_0").alias("p25"), F.col("q_1").alias("p50"), F.col("q_2").alias("p75"))
    if g:
        return base.join(qs, g)
    k = "__one"
    return base.withColumn(k, F.lit(1)).join(qs.withColumn(k, F.lit(1)), k).drop(k)


def class_means(df: DataFrame, groups: list[tuple[str, list[str]]], label: str = "label") -> DataFrame:
    """AGG-11: per feature spam mean, ham mean, difference, ratio (0 when
    the ham mean is not positive)."""
    aggs, items = [], []
    for grp, feats in groups:
        for f in feats:
            aggs += [
                F.avg(F.when(F.col(label) == 1, F.col(f).cast("double"))).alias(f"s__{f}"),
                F.avg(F.when(F.col(label) == 0, F.col(f).cast("double"))).alias(f"h__{f}"),
            ]
            items.append((_q(f), _q(grp), f"`s__{f}`", f"`h__{f}`"))
    wide = df.agg(*aggs)
    long = wide.select(F.expr(_stack_sql(items, ["feature", "group", "spam_mean", "ham_mean"])))
    return long.select(
        "feature",
        "group",
        "spam_mean",
        "ham_mean",
        (F.col("spam_mean") - F.col("ham_mean")).alias("difference"),
        F.when(F.col("ham_mean") > 0, F.col("spam_mean") / F.col("ham_mean")).otherwise(F.lit(0.0)).alias("ratio"),
    )


def class_distributions(df: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """AGG-12: per (feature, class) min, max, mean, exact median, std (n-1)."""
    items = [(_q(f), f"CAST(`{f}` AS DOUBLE)") for f in features]
    long = materialize(df.select(label, *features)).select(
        F.when(F.col(label) == 1, "spam").otherwise("ham").alias("class"),
        F.expr(_stack_sql(items, ["feature", "value"])),
    )
    stats = long.groupBy("feature", "class").agg(
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
    )
    med = exact_quantiles(long, "value", [0.5], ["feature", "class"]).withColumnRenamed("q_0", "median")
    return stats.join(med, ["feature", "class"])


def label_correlations(df: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """AGG-13/14: Pearson r of each feature with the label (0 for a constant
    feature), |r|, n and the t statistic t = r*sqrt((n-2)/(1-r^2))."""
    y = F.col(label).cast("double")
    aggs, items = [F.count(F.lit(1)).alias("__n"), F.stddev_pop(y).alias("__sy")], []
    for f in features:
        x = F.col(f).cast("double")
        aggs += [F.covar_pop(x, y).alias(f"c__{f}"), F.stddev_pop(x).alias(f"s__{f}")]
        items.append((_q(f), f"`c__{f}`", f"`s__{f}`"))
    wide = df.agg(*aggs)
    long = wide.select("__n", "__sy", F.expr(_stack_sql(items, ["feature", "cov", "sx"])))
    # r = cov / (sx * sy); a constant feature (or label) has r = 0 (no ANSI divide-by-zero)
    r = F.when((F.col("sx") > 0) & (F.col("__sy") > 0), F.col("cov") / (F.col("sx") * F.col("__sy"))).otherwise(
        F.lit(0.0)
    )
    long = long.select("feature", r.alias("correlation"), F.col("__n").cast("long").alias("n"))
    t = F.when(
        F.abs(F.col("correlation")) < 1,
        F.col("correlation") * F.sqrt((F.col("n") - 2) / (1 - F.col("correlation") * F.col("correlation"))),
    )
    return long.withColumn("abs_correlation", F.abs("correlation")).withColumn("t_stat", t)


def feature_type(name_col: Column) -> Column:
    """PRJ-11: category of a feature name, first keyword hit wins."""
    low = F.lower(name_col)
    expr = F.lit("Other")
    for category, keys in reversed(P.FEATURE_CATEGORIES):
        hit = F.lit(False)
        for k in keys:
            hit = hit | low.contains(k)
        expr = F.when(hit, F.lit(category)).otherwise(expr)
    return expr


def significance(p_col: Column) -> Column:
    """PRJ-12: star marker for a p-value."""
    return F.when(p_col < 0.001, "***").when(p_col < 0.01, "**").when(p_col < 0.05, "*").otherwise("")


# ---------------------------------------------------------------------------
# Two-sided Student-t p-value (regularised incomplete beta, log space), used
# as an Arrow-batched pandas UDF on the small correlation table.
# ---------------------------------------------------------------------------
def _betacf(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = tiny if abs(d) < tiny else d
    d = 1.0 / d
    h = d
    for m in range(1, 500):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = tiny if abs(d) < tiny else d
        c = 1.0 + aa / c
        c = tiny if abs(c) < tiny else c
        d = 1.0 / d
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = tiny if abs(d) < tiny else d
        c = 1.0 + aa / c
        c = tiny if abs(c) < tiny else c
        d = 1.0 / d
        de = d * c
        h *= de
        if abs(de - 1.0) < 1e-15:
            break
    return h


def _betainc_reg(a: float, b: float, x: float) -> float:
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    lbt = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1) / (a + b + 2):
        return math.exp(lbt) * _betacf(a, b, x) / a
    return 1.0 - math.exp(lbt) * _betacf(b, a, 1 - x) / b


def t_two_sided_p(t: float, dof: float) -> float:
    if t is None or dof is None or dof <= 0 or (isinstance(t, float) and math.isnan(t)):
        return float("nan")
    if math.isinf(t):
        return 0.0
    x = dof / (dof + t * t)
    return _betainc_reg(dof / 2.0, 0.5, x)


@F.pandas_udf(DoubleType())
def p_value_udf(r: pd.Series, n: pd.Series) -> pd.Series:
    out = []
    for rv, nv in zip(r.to_numpy(dtype=float), n.to_numpy(dtype=float)):
        if nv <= 2 or np.isnan(rv):
            out.append(float("nan"))
        elif rv == 0:
            out.append(1.0)
        elif abs(rv) >= 1:
            out.append(0.0)
        else:
            t = rv * math.sqrt((nv - 2) / (1 - rv * rv))
            out.append(t_two_sided_p(t, nv - 2))
    return pd.Series(out)


def with_p_values(corr: DataFrame) -> DataFrame:
    """AGG-14 p-values + PRJ-11 type + PRJ-12 marker on the correlation table."""
    return (
        corr.withColumn("p_value", p_value_udf(F.col("correlation"), F.col("n")))
        .withColumn("feature_type", feature_type(F.col("feature")))
        .withColumn("significance", significance(F.col("p_value")))
    )


def importance_by_fragment(imp: DataFrame, fragments: list[str], feature: str = "feature", value: str = "importance") -> DataFrame:
    """AGG-32/33: total, mean and count of importance over the features whose
    name contains each fragment (case-insensitive); fragments with no match
    are omitted.  One conditional-aggregation pass, no join."""
    low = F.lower(F.col(feature))
    aggs, items = [], []
    for i, frag in enumerate(fragments):
        hit = low.contains(frag.lower())
        aggs += [F.sum(F.when(hit, F.col(value))).alias(f"t{i}"), F.count(F.when(hit, 1)).alias(f"n{i}")]
        items.append((_q(frag), f"t{i}", f"n{i}"))
    wide = imp.agg(*aggs)
    long = wide.select(F.expr(_stack_sql(items, ["fragment", "total_importance", "count"])))
    return long.where(F.col("count") > 0).select(
        "fragment", "total_importance", (F.col("total_importance") / F.col("count")).alias("avg_importance"),
        F.col("count").cast("long"),
    )
