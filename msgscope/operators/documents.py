"""Report documents and flat files (SNK-01, SNK-03, SNK-07..09, SNK-11), their
readers, and what the front end takes from them (FLT-08, PRJ-13, AGG-35).

A document is one row of text.  It is put together from tables whose size follows
from the list of features, sources or clusters and not from the messages; each
becomes a list in a fixed order, and one writer puts the row into one file.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from msgscope.operators.clustering import attach_one_row

#: Lists of a document hold at most so many entries; more is an error, not a cut.
MAX_ENTRIES = 100_000


def as_list(table: DataFrame, name: str, order: list[Column], columns: list[str] | None = None, top: int | None = None) -> DataFrame:
    """One row with one column ``name``: the rows of a small table as a list of
    structs in the given order; the ``top`` first of them."""
    columns = columns or table.columns
    ranked = table.select(*columns, F.row_number().over(Window.orderBy(*order)).alias("__n"))  # a small table
    if top is not None:
        ranked = ranked.where(F.col("__n") <= top)
    out = ranked.agg(F.array_sort(F.collect_list(F.struct("__n", F.struct(*columns).alias("v")))).alias("l"))
    n = F.size("l")
    whole = F.when(n > MAX_ENTRIES, F.raise_error(F.lit(f"{name}: more than {MAX_ENTRIES} entries"))).otherwise(F.col("l"))
    return out.select(whole.alias("l")).select(F.transform("l", lambda e: e["v"]).alias(name))


def as_map(table: DataFrame, name: str, key: str, value: str) -> DataFrame:
    """One row with one column ``name``: a map in the order of its keys; a null key
    is the key ``null``, as text has it."""
    entry = F.struct(F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("key"), F.col(value).alias("value"))
    return table.agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias(name))


def document(*parts: DataFrame) -> DataFrame:
    """One row from one-row frames: their columns are the document's fields."""
    out = parts[0]
    for p in parts[1:]:
        out = attach_one_row(out, p)
    return out


def write_json(doc: DataFrame, path: str) -> None:
    """The document as JSON in one file; null fields are written as null."""
    text = F.to_json(F.struct(*doc.columns), {"pretty": "true", "ignoreNullFields": "false"})
    doc.select(text.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The document's fields, one row; a text that is no such document is an error."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("d")).select("d.*")


def write_lines(lines: DataFrame, path: str) -> None:
    """A text report: one row with an array of lines, written in the array's order."""
    text = F.array_join(F.col(lines.columns[0]), "\n", "")
    lines.select(text.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no from 1, line) of a report."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"\n\z", "").alias("value"))
    return text.select(F.posexplode(F.split("value", "\n", -1)).alias("n", "line")).select((F.col("n") + 1).alias("line_no"), "line")


CSV = {
    "header": "true", "quote": '"', "escape": '"', "quoteAll": "true", "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false", "emptyValue": "", "nullValue": "\\N", "encoding": "UTF-8",
}


def write_csv(rows: DataFrame, path: str) -> None:
    """SNK-01/03: a table as CSV files with a header each.  Line breaks, quotes and
    outer white space of a text come back as they were; maps, arrays and structs
    are written as JSON (SNK-09).  A value ``\\N`` reads back as null."""
    flat = [F.to_json(F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("map", "array", "struct") else F.col(f.name) for f in rows.schema]
    rows.select(*flat).write.options(**CSV).mode("overwrite").csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A written table; a file with line breaks in its texts is one task."""
    return spark.read.options(**CSV).option("multiLine", "true").option("mode", "FAILFAST").option("enforceSchema", "false").schema(schema).csv(path)


def combined(rows: DataFrame) -> DataFrame:
    """SNK-01: the columns of the combined table."""
    return rows.select("text", "label", "source")


# ------------------------------------------------------------- ranges (SNK-11)
RANGES = "x_min double, x_max double, y_min double, y_max double"


def write_ranges(points: DataFrame, px: str, py: str, path: str) -> None:
    """SNK-11: the ranges of 2-D points beside a model."""
    r = points.agg(F.min(px).alias("x_min"), F.max(px).alias("x_max"), F.min(py).alias("y_min"), F.max(py).alias("y_max"))
    write_json(r, path)


def read_ranges(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, RANGES)


def scale_by(points: DataFrame, ranges: DataFrame, px: str, py: str) -> DataFrame:
    """Points within 0..100 of stored ranges (one row), clamped; 50 where a range is
    empty or missing, null where the coordinate is."""
    def scaled(v: str, low: str, high: str) -> Column:
        share = (F.col(v) - F.col(low)) / (F.col(high) - F.col(low)) * 100
        inside = F.when(F.col(high) > F.col(low), F.least(F.lit(100.0), F.greatest(F.lit(0.0), share))).otherwise(F.lit(50.0))
        return F.when(F.col(v).isNotNull(), inside)

    both = attach_one_row(points, ranges)
    out = both.select("*", scaled(px, "x_min", "x_max").alias("x_scaled"), scaled(py, "y_min", "y_max").alias("y_scaled"))
    return out.drop("x_min", "x_max", "y_min", "y_max")


# ------------------------------------------------- what the front end takes
def chart(doc: DataFrame, group: str | None = None, top: int = 15) -> DataFrame:
    """FLT-08: the bars of the feature chart, from the analysis document: the first
    of ``top_discriminative``, or, with a group, the first of ``feature_comparison``
    that are of that group, both in the document's order."""
    entries = F.col("top_discriminative") if group is None else F.filter("feature_comparison", lambda e: e["feature_group"] == group)
    shown = doc.select(F.posexplode(F.slice(entries, 1, top)).alias("n", "e"))
    return shown.select(F.lit(group or "all").alias("chosen"), (F.col("n") + 1).alias("rank"), "e.*")


def display_rates(counts: DataFrame, keep: list[str]) -> DataFrame:
    """PRJ-13: whole per cents from confusion counts (tp, fp, fn, tn): accuracy, share
    of spam caught, and the safe-message rate, 100 less the false-alarm rate; halves
    go up, and a rate without rows is 0 (the safe-message rate, too)."""
    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, 100.0 * part / whole)

    def shown(rate: Column) -> Column:
        return F.coalesce(F.floor(rate + 0.5), F.lit(0)).cast("int")

    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        *keep, shown(share(tp + tn, tp + fp + fn + tn)).alias("accuracy"), shown(share(tp, tp + fn)).alias("spam_catch_rate"),
        shown(100.0 - share(fp, fp + tn)).alias("safe_message_rate"),
    )


def value_histogram(table: DataFrame, value: str, bins: int = 30) -> DataFrame:
    """AGG-35: (bin from 1, low, high, n) of every bin between the least and the
    greatest value; the last one is closed.  A single value has the middle of a
    range of 1; nulls and NaN are left out, and without values there are no bins."""
    v = F.col(value).cast("double")
    x = table.select(v.alias("x")).where(v.isNotNull() & ~F.isnan(v))
    ends = x.agg(F.min("x").alias("a"), F.max("x").alias("b")).where("a IS NOT NULL")
    one = F.col("a") == F.col("b")
    ends = ends.select(F.when(one, F.col("a") - 0.5).otherwise(F.col("a")).alias("a"), F.when(one, F.col("b") + 0.5).otherwise(F.col("b")).alias("b"))
    place = F.least(F.floor((F.col("x") - F.col("a")) / (F.col("b") - F.col("a")) * bins), F.lit(bins - 1)) + 1
    n = attach_one_row(x, ends).groupBy(place.cast("int").alias("bin")).agg(F.count(F.lit(1)).cast("long").alias("n"))
    all_bins = ends.select("a", ((F.col("b") - F.col("a")) / bins).alias("w"), F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    return all_bins.join(n, "bin", "left").select(
        "bin", (F.col("a") + (F.col("bin") - 1) * F.col("w")).alias("low"), (F.col("a") + F.col("bin") * F.col("w")).alias("high"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
    )


# --------------------------------------------------- result folder (SRC-12, JN-08)
PART = "struct<train:double,test:double>"
RESULT = (
    f"clustering_performance struct<silhouette_score:{PART},adjusted_rand_index:{PART},normalized_mutual_info:{PART}>, "
    "classification_performance struct<accuracy:double,precision:double,recall:double,f1_score:double,roc_auc:double,average_precision:double>"
)
CLUSTERING = ("silhouette_score", "adjusted_rand_index", "normalized_mutual_info")
CLASSIFICATION = ("accuracy", "precision", "recall", "f1_score", "roc_auc", "average_precision")


def write_results(results: DataFrame, base: str) -> None:
    """One JSON document below ``k=<k>/config=<config>`` for each row (k, config and
    fields of RESULT).  A pair that comes twice is an error."""
    fields = [c for c in results.columns if c not in ("k", "config")]
    text = F.to_json(F.struct(*fields), {"pretty": "true"})
    per = results.select("k", "config", text.alias("value")).groupBy("k", "config").agg(F.count("*").alias("n"), F.min("value").alias("value"))
    once = F.when(F.col("n") > 1, F.raise_error(F.lit("two results of one k and config"))).otherwise(F.col("value"))
    per.select("k", "config", once.alias("value")).write.partitionBy("k", "config").text(base)


def read_results(spark: SparkSession, base: str) -> DataFrame:
    """SRC-12: (k, config, readable, fields of RESULT) of every document there is, by
    partition discovery over k and config.  A document that can't be read has null
    fields; a folder that isn't there holds none."""
    schema = f"{RESULT}, __bad string, k int, config string"
    try:
        found = spark.read.schema(schema).option("multiLine", True).option("columnNameOfCorruptRecord", "__bad").json(base)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], schema)
    return found.withColumn("readable", F.col("__bad").isNull()).drop("__bad")


def aligned(found: DataFrame, asked: DataFrame) -> DataFrame:
    """JN-08: a row for each asked (k, config), ``status`` loaded, unreadable or
    missing, with every metric or null.  Pairs asked twice are one."""
    cols = [F.col(f"clustering_performance.{m}.{p}").alias(f"{m}_{p}") for m in CLUSTERING for p in ("train", "test")]
    cols += [F.col(f"classification_performance.{m}").alias(m) for m in CLASSIFICATION]
    flat = found.select("k", "config", F.when(F.col("readable"), "loaded").otherwise("unreadable").alias("status"), *cols)
    out = asked.select(F.col("k").cast("int").alias("k"), "config").distinct().join(flat, ["k", "config"], "left")
    return out.withColumn("status", F.coalesce("status", F.lit("missing")))
