"""Registered queries: counts, distributions, class comparisons, correlations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from msgscope.functions import patterns as P
from msgscope.operators import stats as ST
from msgscope.operators.ranking import exact_quantiles
from msgscope.plans import sqlfeatures as SF
from msgscope.plans.frames import SQL_CLEANED, SQL_MESSAGES, cleaned, features_a, with_ctes
from msgscope.plans.registry import query
from msgscope.plans.q_text import FAMILY_A_GROUPS
from msgscope.session import materialize

# The 27 compared features (character group without dot/comma/digit/special counts)
COMPARED = [
    ("Basic", FAMILY_A_GROUPS["features_basic"]),
    ("Spam Indicators", FAMILY_A_GROUPS["features_spam"]),
    (
        "Character",
        [
            "exclamation_count", "question_count", "exclamation_ratio", "question_ratio", "punctuation_ratio",
            "upper_ratio", "consecutive_caps", "digit_ratio", "special_char_ratio",
        ],
    ),
    ("Lexical", FAMILY_A_GROUPS["features_lexical"]),
]
KEY_FEATURES = [
    "word_count", "money_count", "urgency_count", "has_url", "exclamation_count", "upper_ratio", "consecutive_caps",
    "number_sequences",
]
ALL_A = [f for fs in FAMILY_A_GROUPS.values() for f in fs]

SQL_FA = (
    "fa AS (SELECT msg_id, label, source, "
    + ", ".join(f"{e} AS {n}" for n, e in SF.family_a("t"))
    + " FROM (SELECT msg_id, label, source, coalesce(text, '') AS t FROM messages))"
)


def _r6(c):
    return F.round(c, 6)


# --------------------------------------------------------------------------- AGG-01
SQL_SOURCE_COUNTS = with_ctes(SQL_MESSAGES, SQL_CLEANED) + """
SELECT source, CAST(count(*) AS BIGINT) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS pct
FROM cleaned GROUP BY source
"""


@query("source_counts", SQL_SOURCE_COUNTS)
def source_counts(spark, d):
    return ST.counts_by_source(cleaned(spark, d))


# --------------------------------------------------------------------------- AGG-02
SQL_LABEL_BY_SOURCE = with_ctes(SQL_MESSAGES, SQL_CLEANED) + """
SELECT source, CAST(sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS ham,
       CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS spam
FROM cleaned GROUP BY source
"""


@query("label_by_source", SQL_LABEL_BY_SOURCE)
def label_by_source(spark, d):
    p = cleaned(spark, d).groupBy("source").pivot("label", [0, 1]).count().na.fill(0)
    return p.select("source", F.col("0").cast("long").alias("ham"), F.col("1").cast("long").alias("spam"))


# --------------------------------------------------------------------------- AGG-09
SQL_CROSSTAB = with_ctes(SQL_MESSAGES, SQL_CLEANED) + """
SELECT source, round(100.0 * sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) / count(*), 4) AS ham_pct,
       round(100.0 * sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) / count(*), 4) AS spam_pct
FROM cleaned GROUP BY source
"""


@query("crosstab_norm", SQL_CROSSTAB)
def crosstab_norm(spark, d):
    c = cleaned(spark, d).groupBy("source").agg(
        F.sum(F.when(F.col("label") == 0, 1).otherwise(0)).alias("h"),
        F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("s"),
        F.count(F.lit(1)).alias("n"),
    )
    return c.select(
        "source",
        F.round(F.lit(100.0) * F.col("h") / F.col("n"), 4).alias("ham_pct"),
        F.round(F.lit(100.0) * F.col("s") / F.col("n"), 4).alias("spam_pct"),
    )


# --------------------------------------------------------------------------- AGG-06
SQL_DESCRIBE = with_ctes(SQL_MESSAGES, SQL_CLEANED) + """
SELECT CAST(count(text_length) AS BIGINT) AS count, round(avg(text_length), 6) AS mean,
       round(stddev_samp(text_length), 6) AS std, CAST(min(text_length) AS DOUBLE) AS min,
       round(quantile_cont(text_length, 0.25), 6) AS p25, round(quantile_cont(text_length, 0.5), 6) AS p50,
       round(quantile_cont(text_length, 0.75), 6) AS p75, CAST(max(text_length) AS DOUBLE) AS max
FROM cleaned
"""


@query("length_describe", SQL_DESCRIBE)
def length_describe(spark, d):
    r = ST.describe(cleaned(spark, d), "text_length")
    return r.select(
        "count", _r6(F.col("mean")).alias("mean"), _r6(F.col("std")).alias("std"), "min",
        _r6(F.col("p25")).alias("p25"), _r6(F.col("p50")).alias("p50"), _r6(F.col("p75")).alias("p75"), "max",
    )


# --------------------------------------------------------------------------- AGG-08
SQL_WC_QUARTILES = with_ctes(SQL_MESSAGES, SQL_CLEANED) + """
SELECT label,
  round(quantile_cont(word_count, 0.25), 6) AS wc_p25, round(quantile_cont(word_count, 0.5), 6) AS wc_p50,
  round(quantile_cont(word_count, 0.75), 6) AS wc_p75,
  round(quantile_cont(log10(word_count + 1), 0.25), 6) AS log_p25,
  round(quantile_cont(log10(word_count + 1), 0.5), 6) AS log_p50,
  round(quantile_cont(log10(word_count + 1), 0.75), 6) AS log_p75
FROM cleaned GROUP BY label
"""


@query("word_count_quartiles", SQL_WC_QUARTILES)
def word_count_quartiles(spark, d):
    c = materialize(cleaned(spark, d).select("label", "word_count", F.log10(F.col("word_count") + 1).alias("lg")))
    a = exact_quantiles(c, "word_count", [0.25, 0.5, 0.75], ["label"])
    b = exact_quantiles(c, "lg", [0.25, 0.5, 0.75], ["label"])
    a = a.select("label", *[_r6(F.col(f"q_{i}")).alias(f"wc_p{p}") for i, p in enumerate([25, 50, 75])])
    b = b.select("label", *[_r6(F.col(f"q_{i}")).alias(f"log_p{p}") for i, p in enumerate([25, 50, 75])])
    return a.join(b, "label")


# --------------------------------------------------------------------------- AGG-11 / TOP-01
def _sql_class_means() -> str:
    parts = []
    for grp, feats in COMPARED:
        for f in feats:
            parts.append(
                f"SELECT '{f}' AS feature, '{grp}' AS feature_group, "
                f"avg(CASE WHEN label = 1 THEN CAST({f} AS DOUBLE) END) AS spam_mean, "
                f"avg(CASE WHEN label = 0 THEN CAST({f} AS DOUBLE) END) AS ham_mean FROM fa"
            )
    return "cm AS (" + "\nUNION ALL\n".join(parts) + ")"


SQL_CM = _sql_class_means()
SQL_CM_OUT = """cmo AS (
  SELECT feature, feature_group, spam_mean, ham_mean, spam_mean - ham_mean AS difference,
         CASE WHEN ham_mean > 0 THEN spam_mean / ham_mean ELSE 0.0 END AS ratio FROM cm)"""

SQL_FEATURE_COMPARISON = with_ctes(SQL_MESSAGES, SQL_FA, SQL_CM, SQL_CM_OUT) + """
SELECT feature, feature_group, round(spam_mean, 6) AS spam_mean, round(ham_mean, 6) AS ham_mean,
       round(difference, 6) AS difference, round(ratio, 6) AS ratio FROM cmo
"""


def _class_means(spark, d):
    r = ST.class_means(features_a(spark, d), COMPARED)
    return r.withColumnRenamed("group", "feature_group")


@query("feature_comparison", SQL_FEATURE_COMPARISON)
def feature_comparison(spark, d):
    r = _class_means(spark, d)
    return r.select("feature", "feature_group", *[_r6(F.col(c)).alias(c) for c in ("spam_mean", "ham_mean", "difference", "ratio")])


SQL_TOP_DISCRIMINATIVE = with_ctes(SQL_MESSAGES, SQL_FA, SQL_CM, SQL_CM_OUT) + """
SELECT feature, round(ratio, 6) AS ratio, round(difference, 6) AS difference
FROM cmo ORDER BY ratio DESC, feature ASC LIMIT 15
"""


@query("top_discriminative", SQL_TOP_DISCRIMINATIVE)
def top_discriminative(spark, d):
    r = _class_means(spark, d).orderBy(F.col("ratio").desc(), F.col("feature").asc()).limit(15)
    return r.select("feature", _r6(F.col("ratio")).alias("ratio"), _r6(F.col("difference")).alias("difference"))


# --------------------------------------------------------------------------- AGG-12
SQL_FEATURE_DISTRIBUTION = with_ctes(SQL_MESSAGES, SQL_FA) + "\nUNION ALL\n".join(
    f"""SELECT '{f}' AS feature, CASE WHEN label = 1 THEN 'spam' ELSE 'ham' END AS class,
  round(min(CAST({f} AS DOUBLE)), 6) AS min, round(max(CAST({f} AS DOUBLE)), 6) AS max,
  round(avg(CAST({f} AS DOUBLE)), 6) AS mean, round(quantile_cont(CAST({f} AS DOUBLE), 0.5), 6) AS median,
  round(stddev_samp(CAST({f} AS DOUBLE)), 6) AS std
FROM fa GROUP BY 2"""
    for f in KEY_FEATURES
)


@query("feature_distribution", SQL_FEATURE_DISTRIBUTION)
def feature_distribution(spark, d):
    r = ST.class_distributions(features_a(spark, d), KEY_FEATURES)
    return r.select("feature", "class", *[_r6(F.col(c)).alias(c) for c in ("min", "max", "mean", "median", "std")])


# --------------------------------------------------------------------------- AGG-13/14, PRJ-11
def _sql_feature_type(col: str) -> str:
    branches = []
    for cat, keys in P.FEATURE_CATEGORIES:
        cond = " OR ".join(f"contains(lower({col}), '{k}')" for k in keys)
        branches.append(f"WHEN {cond} THEN '{cat}'")
    return "CASE " + " ".join(branches) + " ELSE 'Other' END"


SQL_CORR = "corr_raw AS (" + "\nUNION ALL\n".join(
    f"""SELECT '{f}' AS feature, CAST(count(*) AS BIGINT) AS n,
  CASE WHEN stddev_pop(CAST({f} AS DOUBLE)) > 0 AND stddev_pop(CAST(label AS DOUBLE)) > 0
       THEN covar_pop(CAST({f} AS DOUBLE), CAST(label AS DOUBLE))
            / (stddev_pop(CAST({f} AS DOUBLE)) * stddev_pop(CAST(label AS DOUBLE)))
       ELSE 0.0 END AS correlation FROM fa"""
    for f in ALL_A
) + ")"
SQL_CORR_OUT = f"""corr_t AS (
  SELECT feature, n, correlation, abs(correlation) AS abs_correlation,
         CASE WHEN abs(correlation) < 1 THEN correlation * sqrt((n - 2) / (1 - correlation * correlation)) END AS t_stat,
         {_sql_feature_type('feature')} AS feature_type
  FROM corr_raw)"""

SQL_FEATURE_CORRELATION = with_ctes(SQL_MESSAGES, SQL_FA, SQL_CORR, SQL_CORR_OUT) + """
SELECT feature, n, round(correlation, 6) AS correlation, round(abs_correlation, 6) AS abs_correlation,
       round(t_stat, 6) AS t_stat, feature_type FROM corr_t
"""


def _correlations(spark, d):
    r = ST.label_correlations(features_a(spark, d), ALL_A)
    return r.withColumn("feature_type", ST.feature_type(F.col("feature")))


@query("feature_correlation", SQL_FEATURE_CORRELATION)
def feature_correlation(spark, d):
    r = _correlations(spark, d)
    return r.select(
        "feature", "n", *[_r6(F.col(c)).alias(c) for c in ("correlation", "abs_correlation", "t_stat")], "feature_type"
    )


# two-sided p of Student's t: one less twice the density's integral up to |t|, by
# Simpson's rule
SIMPSON = 4000
SQL_P = f"""corr_p AS (
  SELECT c.*, CASE WHEN c.correlation = 0 THEN 1.0 WHEN c.abs_correlation >= 1 THEN 0.0 ELSE greatest(0.0, 1 - 2 * i.area) END AS p_value
  FROM corr_t c LEFT JOIN (
    SELECT feature, sum((CASE WHEN k IN (0, {SIMPSON}) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END)
             * pow(1 + pow(abs(t_stat) * k / {SIMPSON}, 2) / (n - 2), -(n - 1) / 2.0))
           * any_value(exp(lgamma((n - 1) / 2.0) - lgamma((n - 2) / 2.0)) / sqrt((n - 2) * pi()) * abs(t_stat) / {SIMPSON} / 3) AS area
    FROM corr_t, range(0, {SIMPSON} + 1) r(k) WHERE t_stat IS NOT NULL GROUP BY feature) i ON i.feature = c.feature)"""
CORR_CTES = (SQL_MESSAGES, SQL_FA, SQL_CORR, SQL_CORR_OUT, SQL_P)

SQL_SIGNIFICANCE = with_ctes(*CORR_CTES) + """
SELECT feature, round(correlation, 6) AS correlation, round(abs_correlation, 6) AS abs_correlation, round(p_value, 6) AS p_value,
       feature_type, CASE WHEN p_value < 0.001 THEN '***' WHEN p_value < 0.01 THEN '**' WHEN p_value < 0.05 THEN '*' ELSE '' END AS significance
FROM corr_p
"""


def _with_p(spark, d):
    return ST.with_p_values(ST.label_correlations(features_a(spark, d), ALL_A))


@query("correlation_significance", SQL_SIGNIFICANCE)
def correlation_significance(spark, d):
    return _with_p(spark, d).select(
        "feature", *[_r6(F.col(c)).alias(c) for c in ("correlation", "abs_correlation", "p_value")], "feature_type", "significance"
    )


# --------------------------------------------------------------------------- TOP-01/02/03
SQL_TOP_DIFFERENCE = with_ctes(SQL_MESSAGES, SQL_FA, SQL_CM, SQL_CM_OUT) + """
SELECT feature, round(difference, 6) AS difference, round(ratio, 6) AS ratio FROM cmo ORDER BY abs(difference) DESC, feature LIMIT 15
"""


@query("top_by_difference", SQL_TOP_DIFFERENCE)
def top_by_difference(spark, d):
    r = _class_means(spark, d).orderBy(F.abs("difference").desc(), "feature").limit(15)
    return r.select("feature", _r6(F.col("difference")).alias("difference"), _r6(F.col("ratio")).alias("ratio"))


TOP_LISTS = {"overall": ("abs_correlation", 10), "positive": ("correlation", 10), "negative": ("-correlation", 10), "report": ("abs_correlation", 5), "chart": ("abs_correlation", 20)}


def _sql_top_list(name: str) -> str:
    by, n = TOP_LISTS[name]
    only = {"positive": "WHERE correlation > 0", "negative": "WHERE correlation < 0"}.get(name, "")
    return f"SELECT '{name}' AS list, feature, correlation, row_number() OVER (ORDER BY {by} DESC, feature) AS rank FROM corr_t {only} QUALIFY rank <= {n}"


SQL_TOP_CORRELATIONS = (
    with_ctes(SQL_MESSAGES, SQL_FA, SQL_CORR, SQL_CORR_OUT)
    + "SELECT list, CAST(rank AS INTEGER) AS rank, feature, round(correlation, 6) AS correlation FROM ("
    + " UNION ALL ".join(_sql_top_list(n) for n in TOP_LISTS)
    + ")"
)


@query("top_correlations", SQL_TOP_CORRELATIONS)
def top_correlations(spark, d):
    """The leading features of each list; the table has a row for each feature."""
    c = _correlations(spark, d)
    order = {n: F.expr(by) for n, (by, _) in TOP_LISTS.items()}
    keep = {"positive": F.col("correlation") > 0, "negative": F.col("correlation") < 0}
    entry = [F.when(keep.get(n, F.lit(True)), F.struct(F.lit(n).alias("list"), order[n].alias("by"), F.lit(k).alias("top"))) for n, (_, k) in TOP_LISTS.items()]
    each = c.select("feature", "correlation", F.explode(F.array_compact(F.array(*entry))).alias("e"))
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("e.list").orderBy(F.col("e.by").desc(), "feature")))
    return ranked.where(F.col("rank") <= F.col("e.top")).select("e.list", F.col("rank").cast("int"), "feature", _r6(F.col("correlation")).alias("correlation"))


# --------------------------------------------------------------------------- AGG-15/16
SQL_FEATURE_TYPE_STATS = with_ctes(*CORR_CTES) + """
SELECT feature_type, CAST(count(*) AS BIGINT) AS n_features, round(avg(abs_correlation), 4) AS mean_abs_correlation,
       round(max(abs_correlation), 4) AS max_abs_correlation, CAST(count(*) FILTER (p_value < 0.05) AS BIGINT) AS n_significant,
       round(count(*) FILTER (p_value < 0.05) / count(*), 6) AS significant_share
FROM corr_p GROUP BY feature_type
"""


@query("feature_type_stats", SQL_FEATURE_TYPE_STATS)
def feature_type_stats(spark, d):
    n, hit = F.count(F.lit(1)), F.sum(F.when(F.col("p_value") < 0.05, 1).otherwise(0))
    return _with_p(spark, d).groupBy("feature_type").agg(
        n.cast("long").alias("n_features"),
        F.round(F.avg("abs_correlation"), 4).alias("mean_abs_correlation"),
        F.round(F.max("abs_correlation"), 4).alias("max_abs_correlation"),
        hit.cast("long").alias("n_significant"), _r6(hit / n).alias("significant_share"),
    )


SQL_PATTERN_SUMMARY = with_ctes(*CORR_CTES) + """
SELECT CAST(count(*) AS BIGINT) AS total_features,
       CAST(count(*) FILTER (p_value < 0.05) AS BIGINT) AS significant_features,
       round(count(*) FILTER (p_value < 0.05) / count(*), 6) AS significant_rate,
       CAST(count(*) FILTER (abs_correlation > 0.1) AS BIGINT) AS strong_predictors,
       round(count(*) FILTER (abs_correlation > 0.1) / count(*), 6) AS strong_predictor_rate,
       (SELECT feature FROM corr_p ORDER BY abs_correlation DESC, feature LIMIT 1) AS top_feature,
       round(max(abs_correlation), 6) AS top_abs_correlation,
       round(avg(correlation), 6) AS mean_correlation, round(stddev_samp(correlation), 6) AS std_correlation
FROM corr_p
"""


@query("pattern_summary", SQL_PATTERN_SUMMARY)
def pattern_summary(spark, d):
    c = _with_p(spark, d)
    n = F.count(F.lit(1))
    sig = F.sum(F.when(F.col("p_value") < 0.05, 1).otherwise(0))
    strong = F.sum(F.when(F.col("abs_correlation") > 0.1, 1).otherwise(0))
    return c.agg(
        n.cast("long").alias("total_features"),
        sig.cast("long").alias("significant_features"), _r6(sig / n).alias("significant_rate"),
        strong.cast("long").alias("strong_predictors"), _r6(strong / n).alias("strong_predictor_rate"),
        F.min_by("feature", F.struct(-F.col("abs_correlation"), F.col("feature"))).alias("top_feature"),
        _r6(F.max("abs_correlation")).alias("top_abs_correlation"),
        _r6(F.avg("correlation")).alias("mean_correlation"),
        _r6(F.stddev_samp("correlation")).alias("std_correlation"),
    )
