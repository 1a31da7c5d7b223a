"""Registered queries: uploaded files, report documents, flat files, stored ranges
and the result folder.  Each writes what its operator writes and reads it back."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from msgscope.functions.features import FAMILY_A_NAMES, family_a, features_of
from msgscope.operators import documents as DOC
from msgscope.operators import stats as ST
from msgscope.operators.datasets import new_folder
from msgscope.plans import sqlfeatures as SF
from msgscope.plans import sqlparts as S
from msgscope.plans.frames import SQL_MESSAGES, messages, with_ctes
from msgscope.plans.q_eval import BASE, scored
from msgscope.plans.q_stats import ALL_A, COMPARED, CORR_CTES, KEY_FEATURES, SQL_CM, SQL_CM_OUT, SQL_CORR, SQL_CORR_OUT, SQL_FA
from msgscope.plans.registry import query
from msgscope.session import materialize
from msgscope.sources import uploads as UP
from msgscope.sources.tables import read_table


def _r6(c):
    return F.round(c, 6)


# --------------------------------------------------------------------------- BAT-04
# Every document as a file; four of each ten are spoilt: a byte that UTF-8 hasn't,
# white space alone, a text repeated beyond the characters, one beyond the bytes.
SQL_UPLOADS = f"""WITH f AS (
  SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END AS bad,
         CASE WHEN text IS NULL THEN NULL WHEN doc_id % 10 = 1 THEN ' ' || chr(10) || chr(9)
              WHEN doc_id % 10 = 2 THEN repeat(text, CAST({UP.MAX_TEXT_CHARS} // greatest(1, length(text)) + 1 AS BIGINT))
              WHEN doc_id % 10 = 3 THEN repeat(text, CAST({UP.MAX_FILE_BYTES} // greatest(1, length(text)) + 1 AS BIGINT)) ELSE text END AS t
  FROM documents), g AS (SELECT *, CAST(strlen(t) + bad AS BIGINT) AS n_bytes FROM f)
SELECT 'documents/' || doc_id AS path, n_bytes, CASE WHEN reason IS NULL THEN CAST(length(t) AS BIGINT) END AS n_chars, reason FROM (
  SELECT *, CASE WHEN coalesce(n_bytes, 0) > {UP.MAX_FILE_BYTES} THEN 'too_large' WHEN bad = 1 AND t IS NOT NULL THEN 'not_utf8'
                 WHEN coalesce({S.strip('t')}, '') = '' THEN 'empty' WHEN length(t) > {UP.MAX_TEXT_CHARS} THEN 'too_long' END AS reason FROM g)"""


@query("upload_check", SQL_UPLOADS)
def upload_check(spark, d):
    """BAT-04: judged once, both tables stored, read back."""
    docs = read_table(spark, d, "documents").select("doc_id", F.col("text").cast("string").alias("text"))
    kind = F.col("doc_id") % 10
    times = lambda most: (F.floor(F.lit(most) / F.greatest(F.lit(1), F.length("text"))) + 1).cast("int")
    text = (
        F.when(F.col("text").isNull(), F.lit(None))
        .when(kind == 1, " \n\t")
        .when(kind == 2, F.repeat("text", times(UP.MAX_TEXT_CHARS)))
        .when(kind == 3, F.repeat("text", times(UP.MAX_FILE_BYTES)))
        .otherwise(F.col("text"))
    )
    content = F.encode(text, "UTF-8")
    spoilt = F.when(kind == 0, F.concat(content, F.lit(bytearray(b"\xff")))).otherwise(content)
    files = docs.select(F.concat(F.lit("documents/"), F.col("doc_id")).alias("path"), spoilt.alias("content"))
    out = new_folder(spark, "uploads")
    UP.ingest(files.withColumn("n_bytes", F.octet_length("content").cast("long")), out)
    kept = UP.accepted(spark, out).select("path", "n_bytes", F.char_length("text").cast("long").alias("n_chars"), F.lit(None).cast("string").alias("reason"))
    gone = UP.rejected(spark, out).select("path", "n_bytes", F.lit(None).cast("long").alias("n_chars"), "reason")
    return kept.unionByName(gone)


# --------------------------------------------------------------------------- SNK-08, FLT-08
SQL_DOC = with_ctes(SQL_MESSAGES, SQL_FA, SQL_CM, SQL_CM_OUT, SQL_CORR, SQL_CORR_OUT).rstrip() + """,
compared AS (SELECT feature, feature_group, round(difference, 6) AS difference, round(ratio, 6) AS ratio FROM cmo),
fc AS (SELECT *, CAST(row_number() OVER (ORDER BY abs(difference) DESC, feature) AS INTEGER) AS position FROM compared),
td AS (SELECT *, CAST(row_number() OVER (ORDER BY ratio DESC, feature) AS INTEGER) AS position FROM compared QUALIFY position <= 15),
co AS (SELECT feature, c AS correlation, CAST(row_number() OVER (ORDER BY abs(c) DESC, feature) AS INTEGER) AS position
       FROM (SELECT feature, round(correlation, 6) AS c FROM corr_t) QUALIFY position <= 20),
ds AS (""" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, CASE WHEN label = 1 THEN 'spam' ELSE 'ham' END AS class, round(quantile_cont(CAST({f} AS DOUBLE), 0.5), 6) AS median FROM fa GROUP BY 2"
    for f in KEY_FEATURES
) + """),
sd AS (SELECT CASE WHEN label = 1 THEN 'spam' ELSE 'ham' END || '/' || coalesce(source, 'null') AS name, CAST(count(*) AS DOUBLE) AS value FROM fa GROUP BY 1)
"""
SQL_FEATURE_DOCUMENT = SQL_DOC + """SELECT 'feature_comparison' AS section, position, feature AS name, difference AS value FROM fc
UNION ALL SELECT 'top_discriminative', position, feature, ratio FROM td
UNION ALL SELECT 'correlations', position, feature, correlation FROM co
UNION ALL SELECT 'distributions', CAST(row_number() OVER (ORDER BY feature, class) AS INTEGER), feature || '/' || class, median FROM ds
UNION ALL SELECT 'source_distribution', CAST(row_number() OVER (ORDER BY name) AS INTEGER), name, value FROM sd
UNION ALL SELECT 'overall_stats', 1, 'total_messages', CAST(count(*) AS DOUBLE) FROM fa
UNION ALL SELECT 'overall_stats', 2, 'spam_count', CAST(coalesce(sum(label), 0) AS DOUBLE) FROM fa
UNION ALL SELECT 'overall_stats', 3, 'ham_count', CAST(coalesce(sum(1 - label), 0) AS DOUBLE) FROM fa
UNION ALL SELECT 'overall_stats', 4, 'spam_rate', round(avg(label), 6) FROM fa"""
SQL_FEATURE_CHART = SQL_DOC + """SELECT 'all' AS chosen, position AS rank, feature, difference, ratio FROM td
UNION ALL SELECT feature_group, CAST(row_number() OVER (PARTITION BY feature_group ORDER BY position) AS INTEGER) AS n, feature, difference, ratio FROM fc QUALIFY n <= 15"""


def _analysis_document(spark, d) -> str:
    """SNK-08: the feature-analysis document, written; its path."""
    fa = materialize(features_of(messages(spark, d), family_a, FAMILY_A_NAMES, keep=["msg_id", "label", "source"]))
    means = ST.class_means(fa, COMPARED).withColumnRenamed("group", "feature_group")
    means = materialize(means.select("feature", "feature_group", *[_r6(F.col(c)).alias(c) for c in ("spam_mean", "ham_mean", "difference", "ratio")]))
    corr = ST.label_correlations(fa, ALL_A).select("feature", _r6(F.col("correlation")).alias("correlation"))
    dist = ST.class_distributions(fa, KEY_FEATURES).select("feature", "class", *[_r6(F.col(c)).alias(c) for c in ("min", "max", "mean", "median", "std")])
    by_source = fa.groupBy(F.when(F.col("label") == 1, "spam").otherwise("ham").alias("class"), F.coalesce("source", F.lit("null")).alias("source")).agg(F.count("*").alias("n"))
    stats = fa.agg(
        F.count("*").alias("total_messages"), F.coalesce(F.sum("label"), F.lit(0)).alias("spam_count"),
        F.coalesce(F.sum(1 - F.col("label")), F.lit(0)).alias("ham_count"), _r6(F.avg("label")).alias("spam_rate"),
    )
    doc = DOC.document(
        stats.select(F.struct(*stats.columns).alias("overall_stats")),
        DOC.as_list(means, "feature_comparison", [F.abs("difference").desc(), F.col("feature")]),
        DOC.as_list(means, "top_discriminative", [F.col("ratio").desc(), F.col("feature")], top=15),
        DOC.as_list(dist, "distributions", [F.col("feature"), F.col("class")]),
        DOC.as_list(corr, "correlations", [F.abs("correlation").desc(), F.col("feature")], top=20),
        DOC.as_list(by_source, "source_distribution", [F.concat("class", F.lit("/"), "source")]),
    )
    path = os.path.join(new_folder(spark, "analysis"), "feature_analysis.json")
    DOC.write_json(doc, path)
    return path


_MEANS = "array<struct<feature:string,feature_group:string,spam_mean:double,ham_mean:double,difference:double,ratio:double>>"
ANALYSIS = (
    "overall_stats struct<total_messages:double,spam_count:double,ham_count:double,spam_rate:double>, "
    f"feature_comparison {_MEANS}, top_discriminative {_MEANS}, "
    "distributions array<struct<feature:string,class:string,min:double,max:double,mean:double,median:double,std:double>>, "
    "correlations array<struct<feature:string,correlation:double>>, source_distribution array<struct<class:string,source:string,n:double>>"
)


@query("feature_document", SQL_FEATURE_DOCUMENT)
def feature_document(spark, d):
    """SNK-08: the document, read back as (section, position, name, value)."""
    doc = DOC.read_json(spark, _analysis_document(spark, d), ANALYSIS)
    both = lambda a, b: lambda e: F.concat(e[a], F.lit("/"), e[b])
    own = lambda e: e["feature"]
    sections = {
        "feature_comparison": (own, "difference"), "top_discriminative": (own, "ratio"), "correlations": (own, "correlation"),
        "distributions": (both("feature", "class"), "median"), "source_distribution": (both("class", "source"), "n"),
    }

    def entries(section, name, value):
        return F.transform(
            section, lambda e, i: F.struct(F.lit(section).alias("section"), (i + 1).alias("position"), name(e).alias("name"), e[value].alias("value"))
        )

    lists = [entries(s, name, value) for s, (name, value) in sections.items()]
    figures = [
        F.struct(F.lit("overall_stats").alias("section"), F.lit(i).alias("position"), F.lit(n).alias("name"), F.col(f"overall_stats.{n}").alias("value"))
        for i, n in enumerate(("total_messages", "spam_count", "ham_count", "spam_rate"), 1)
    ]
    return doc.select(F.explode(F.concat(*lists, F.array(*figures))).alias("e")).select("e.*")


@query("feature_chart", SQL_FEATURE_CHART)
def feature_chart(spark, d):
    """FLT-08: the bars of every choice of the chart, from the stored document."""
    path = _analysis_document(spark, d)
    out = None
    for group in (None, *[g for g, _ in COMPARED]):
        one = DOC.chart(DOC.read_json(spark, path, ANALYSIS), group)
        out = one if out is None else out.unionByName(one)
    return out.select("chosen", "rank", "feature", "difference", "ratio")


# --------------------------------------------------------------------------- SNK-07
SQL_REPORT = with_ctes(*CORR_CTES).rstrip() + """,
r AS (SELECT feature, correlation, abs_correlation, p_value, row_number() OVER (ORDER BY round(abs_correlation, 9) DESC, feature) AS n FROM corr_p),
s AS (SELECT count(*) AS total, count(*) FILTER (p_value < 0.05) AS sig, count(*) FILTER (abs_correlation > 0.1) AS strong FROM r)
SELECT 'report' AS part, CAST(1 AS INTEGER) AS n, 'Features: ' || total AS line FROM s
UNION ALL SELECT 'report', 2, 'Significant (p < 0.05): ' || sig || printf(' (%.1f%%)', 100.0 * sig / greatest(total, 1)) FROM s
UNION ALL SELECT 'report', 3, 'Strong (|r| > 0.1): ' || strong || printf(' (%.1f%%)', 100.0 * strong / greatest(total, 1)) FROM s
UNION ALL SELECT 'report', CAST(3 + n AS INTEGER), n || printf('. %s r=%.3f p=%.4f ', feature, correlation, p_value) || CASE WHEN correlation > 0 THEN 'SPAM' ELSE 'HAM' END FROM r WHERE n <= 5
UNION ALL SELECT 'summary', 1, total || '/' || sig || '/' || strong || '/' || (SELECT feature FROM r WHERE n = 1) FROM s
UNION ALL SELECT 'table', CAST(n AS INTEGER), feature FROM r"""


@query("correlation_report", SQL_REPORT)
def correlation_report(spark, d):
    """SNK-07: the correlation table as CSV, the summary as JSON, the report as lines
    of text; each read back from what was written."""
    fa = features_of(messages(spark, d), family_a, FAMILY_A_NAMES, keep=["label"])
    cols = ["feature", "correlation", "abs_correlation", "p_value"]
    corr = materialize(ST.with_p_values(ST.label_correlations(fa, ALL_A)).select(*cols, "feature_type", "significance"))
    order = [F.round("abs_correlation", 9).desc(), F.col("feature")]
    hit = lambda c: F.count(F.when(c, 1))
    found = corr.agg(F.count("*").alias("total_features"), hit(F.col("p_value") < 0.05).alias("significant_features"), hit(F.col("abs_correlation") > 0.1).alias("strong_predictors"))
    summary = DOC.document(found, DOC.as_list(corr, "top_predictors", order, cols, top=5))
    base = new_folder(spark, "correlations")
    DOC.write_json(summary, os.path.join(base, "summary.json"))
    ranked = DOC.as_list(corr, "rows", order).select(F.posexplode("rows").alias("n", "e")).select((F.col("n") + 1).alias("rank"), "e.*")
    DOC.write_csv(ranked, os.path.join(base, "correlations.csv"))

    read = DOC.read_json(spark, os.path.join(base, "summary.json"), "total_features long, significant_features long, strong_predictors long, top_predictors array<struct<feature:string,correlation:double,abs_correlation:double,p_value:double>>")
    share = lambda c: F.format_string(" (%.1f%%)", 100.0 * F.col(c) / F.greatest(F.col("total_features"), F.lit(1)))
    head = F.array(
        F.concat(F.lit("Features: "), "total_features"),
        F.concat(F.lit("Significant (p < 0.05): "), "significant_features", share("significant_features")),
        F.concat(F.lit("Strong (|r| > 0.1): "), "strong_predictors", share("strong_predictors")),
    )
    told = F.transform(
        "top_predictors",
        lambda e, i: F.concat(
            F.format_string("%d. %s r=%.3f p=%.4f ", i + 1, e["feature"], e["correlation"], e["p_value"]), F.when(e["correlation"] > 0, "SPAM").otherwise("HAM")
        ),
    )
    DOC.write_lines(read.select(F.concat(head, told).alias("lines")), os.path.join(base, "report.txt"))
    lines = DOC.read_lines(spark, os.path.join(base, "report.txt")).select(F.lit("report").alias("part"), F.col("line_no").alias("n"), "line")
    figures = read.select(F.lit("summary").alias("part"), F.lit(1).alias("n"), F.concat_ws("/", "total_features", "significant_features", "strong_predictors", F.col("top_predictors")[0]["feature"]).alias("line"))
    schema = "rank int, feature string, correlation double, abs_correlation double, p_value double, feature_type string, significance string"
    table = DOC.read_csv(spark, os.path.join(base, "correlations.csv"), schema).select(F.lit("table").alias("part"), F.col("rank").alias("n"), F.col("feature").alias("line"))
    return lines.unionByName(figures).unionByName(table)


# --------------------------------------------------------------------------- AGG-35
SQL_CORR_HIST = with_ctes(SQL_MESSAGES, SQL_FA, SQL_CORR) + """
, v AS (SELECT round(correlation, 6) AS x FROM corr_raw), e0 AS (SELECT min(x) AS a, max(x) AS b FROM v),
e AS (SELECT CASE WHEN a = b THEN a - 0.5 ELSE a END AS a, CASE WHEN a = b THEN b + 0.5 ELSE b END AS b FROM e0 WHERE a IS NOT NULL),
h AS (SELECT least(floor((x - a) / (b - a) * 30), 29) + 1 AS bin, count(*) AS n FROM v, e GROUP BY 1)
SELECT CAST(k AS INTEGER) AS bin, round(a + (k - 1) * ((b - a) / 30), 6) AS low, round(a + k * ((b - a) / 30), 6) AS high, CAST(coalesce(h.n, 0) AS BIGINT) AS n
FROM e, range(1, 31) r(k) LEFT JOIN h ON h.bin = k"""


@query("correlation_histogram", SQL_CORR_HIST)
def correlation_histogram(spark, d):
    fa = features_of(messages(spark, d), family_a, FAMILY_A_NAMES, keep=["label"])
    corr = materialize(ST.label_correlations(fa, ALL_A).select(_r6(F.col("correlation")).alias("correlation")))
    h = DOC.value_histogram(corr, "correlation", 30)
    return h.select("bin", _r6(F.col("low")).alias("low"), _r6(F.col("high")).alias("high"), "n")


# --------------------------------------------------------------------------- SNK-09
SQL_CLUSTER_SUMMARY = BASE + """
SELECT cluster_id, CAST(sum(count(*)) OVER (PARTITION BY cluster_id) AS BIGINT) AS size,
       round(sum(sum(label)) OVER (PARTITION BY cluster_id) / sum(count(*)) OVER (PARTITION BY cluster_id), 6) AS spam_rate,
       coalesce(source, 'null') AS source, CAST(count(*) AS BIGINT) AS n FROM scored GROUP BY cluster_id, source"""


@query("cluster_summary", SQL_CLUSTER_SUMMARY)
def cluster_summary(spark, d):
    """SNK-09: a row for each cluster with its sources as a map, as CSV; read back."""
    by = scored(spark, d).groupBy("cluster_id", "source").agg(F.count("*").alias("n"), F.sum("label").alias("spam"))
    entry = F.struct(F.coalesce("source", F.lit("null")).alias("key"), F.col("n").alias("value"))
    per = by.groupBy("cluster_id").agg(  # clusters x sources rows
        F.sum("n").alias("size"), (F.sum("spam") / F.sum("n")).alias("spam_rate"), F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("sources")
    )
    path = os.path.join(new_folder(spark, "clusters"), "cluster_summary.csv")
    DOC.write_csv(per, path)
    read = DOC.read_csv(spark, path, "cluster_id int, size long, spam_rate double, sources string")
    return read.select("cluster_id", "size", _r6(F.col("spam_rate")).alias("spam_rate"), F.explode(F.from_json("sources", "map<string,long>")).alias("source", "n"))


# --------------------------------------------------------------------------- SNK-01, SNK-03
@query("combined_table", with_ctes(SQL_MESSAGES) + "SELECT text, label, source FROM messages")
def combined_table(spark, d):
    """SNK-01: the combined table as CSV, read back."""
    path = os.path.join(new_folder(spark, "combined"), "combined.csv")
    DOC.write_csv(DOC.combined(messages(spark, d)), path)
    return DOC.read_csv(spark, path, "text string, label int, source string")


SQL_ENRICHED = with_ctes(SQL_MESSAGES) + (
    "SELECT text, label, source, " + ", ".join(f"round(CAST({e} AS DOUBLE), 6) AS {n}" for n, e in SF.family_a("t")) + " FROM (SELECT *, coalesce(text, '') AS t FROM messages)"
)


@query("enriched_table", SQL_ENRICHED)
def enriched_table(spark, d):
    """SNK-03: the combined table with its features as CSV, read back."""
    rows = features_of(messages(spark, d), family_a, FAMILY_A_NAMES, keep=["text", "label", "source"])
    path = os.path.join(new_folder(spark, "enriched"), "combined_with_features.csv")
    DOC.write_csv(rows, path)
    read = DOC.read_csv(spark, path, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema))
    return read.select("text", "label", "source", *[_r6(F.col(n).cast("double")).alias(n) for n in FAMILY_A_NAMES])


# --------------------------------------------------------------------------- SNK-11
SQL_RANGES = """
WITH p AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS px, CAST(embedding[2] AS DOUBLE) AS py FROM embeddings),
r AS (SELECT min(px) AS x0, max(px) AS x1, min(py) AS y0, max(py) AS y1 FROM p WHERE vec_id % 2 = 0)
SELECT vec_id,
  CASE WHEN px IS NOT NULL THEN round(CASE WHEN x1 > x0 THEN least(100.0, greatest(0.0, (px - x0) / (x1 - x0) * 100)) ELSE 50.0 END, 6) END AS x_scaled,
  CASE WHEN py IS NOT NULL THEN round(CASE WHEN y1 > y0 THEN least(100.0, greatest(0.0, (py - y0) / (y1 - y0) * 100)) ELSE 50.0 END, 6) END AS y_scaled
FROM p, r"""


@query("stored_ranges", SQL_RANGES)
def stored_ranges(spark, d):
    """SNK-11: ranges of the training half (even ids) stored beside a model; every
    point scaled by what is read back."""
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    p = read_table(spark, d, "embeddings").select("vec_id", at(0).alias("px"), at(1).alias("py"))
    path = os.path.join(new_folder(spark, "ranges"), "feature_metadata.json")
    DOC.write_ranges(p.where("vec_id % 2 = 0"), "px", "py", path)
    out = DOC.scale_by(p, DOC.read_ranges(spark, path), "px", "py")
    return out.select("vec_id", _r6(F.col("x_scaled")).alias("x_scaled"), _r6(F.col("y_scaled")).alias("y_scaled"))


# --------------------------------------------------------------------------- PRJ-13
def _sql_share(part: str, whole: str, of: str = "{}") -> str:
    return f"CAST(coalesce(floor({of.format(f'CASE WHEN ({whole}) > 0 THEN CAST(100 AS DOUBLE) * ({part}) / ({whole}) END')} + 0.5), 0) AS INTEGER)"


SQL_DISPLAY = BASE + f"""
SELECT source, {_sql_share('tp + tn', 'tp + fp + fn + tn')} AS accuracy, {_sql_share('tp', 'tp + fn')} AS spam_catch_rate,
       {_sql_share('fp', 'fp + tn', '(CAST(100 AS DOUBLE) - {})')} AS safe_message_rate
FROM (SELECT source, sum(label * prediction) AS tp, sum((1 - label) * prediction) AS fp, sum(label * (1 - prediction)) AS fn,
             sum((1 - label) * (1 - prediction)) AS tn FROM scored GROUP BY source)"""


@query("display_rates", SQL_DISPLAY)
def display_rates(spark, d):
    """PRJ-13: the rule's rates as the front end shows them, by source."""
    y, p = F.col("label"), F.col("prediction")
    cells = {"tp": y * p, "fp": (1 - y) * p, "fn": y * (1 - p), "tn": (1 - y) * (1 - p)}
    counts = scored(spark, d).groupBy("source").agg(*[F.sum(v).alias(k) for k, v in cells.items()])
    return DOC.display_rates(counts, ["source"])


# --------------------------------------------------------------------------- SRC-12, JN-08
# Clusters are k equal slices of the rule's score, a configuration is one source's
# rows, a cluster is spam if most of it is.  Results are written for even k only.
SQL_RESULTS = BASE.rstrip() + """,
c AS (SELECT CAST(k AS INTEGER) AS k, coalesce(source, 'none') AS config, least(CAST(floor(score * k) AS INTEGER), k - 1) AS cl, sum(label) AS pos, sum(1 - label) AS neg
      FROM scored, range(2, 9) r(k) GROUP BY 1, 2, 3),
m AS (SELECT k, config, sum(CASE WHEN pos > neg THEN pos ELSE 0 END) AS tp, sum(CASE WHEN pos > neg THEN neg ELSE 0 END) AS fp, sum(pos) AS p, sum(pos + neg) AS n FROM c GROUP BY 1, 2)
SELECT k, config, CASE WHEN k % 2 = 0 THEN 'loaded' ELSE 'missing' END AS status,
  CASE WHEN k % 2 = 0 THEN round((tp + n - p - fp) / n, 6) END AS accuracy,
  CASE WHEN k % 2 = 0 AND tp + fp > 0 THEN round(tp / (tp + fp), 6) END AS precision,
  CASE WHEN k % 2 = 0 AND p > 0 THEN round(tp / p, 6) END AS recall,
  CASE WHEN k % 2 = 0 AND tp + fp + p > 0 THEN round(2 * tp / (tp + fp + p), 6) END AS f1_score,
  CAST(NULL AS DOUBLE) AS silhouette_score_test
FROM m"""


@query("result_folder", SQL_RESULTS)
def result_folder(spark, d):
    """SRC-12 / JN-08: results written to a folder by k and configuration, read by
    partition discovery, and laid beside every pair asked for."""
    config = F.coalesce("source", F.lit("none"))
    scores = materialize(scored(spark, d).groupBy(config.alias("config"), "score").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg")))
    each = scores.withColumn("k", F.explode(F.sequence(F.lit(2), F.lit(8), F.lit(2))))
    cl = F.least(F.floor(F.col("score") * F.col("k")), F.col("k") - 1).cast("int")
    c = each.groupBy("k", "config", cl.alias("cl")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    spam = F.col("pos") > F.col("neg")
    m = c.groupBy("k", "config").agg(
        F.sum(F.when(spam, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(spam, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum("pos").alias("p"), F.sum(F.col("pos") + F.col("neg")).alias("n"),
    )
    tp, fp, p, n = (F.col(x) for x in ("tp", "fp", "p", "n"))
    figures = {
        "accuracy": (tp + n - p - fp) / n, "precision": F.when(tp + fp > 0, tp / (tp + fp)), "recall": F.when(p > 0, tp / p),
        "f1_score": F.when(tp + fp + p > 0, 2 * tp / (tp + fp + p)),
    }
    base = new_folder(spark, "results")
    DOC.write_results(m.select("k", "config", F.struct(*[v.alias(x) for x, v in figures.items()]).alias("classification_performance")), base)
    asked = scores.select("config").distinct().withColumn("k", F.explode(F.sequence(F.lit(2), F.lit(8))))
    out = DOC.aligned(DOC.read_results(spark, base), asked)
    return out.select("k", "config", "status", *[_r6(F.col(x)).alias(x) for x in figures], "silhouette_score_test")
