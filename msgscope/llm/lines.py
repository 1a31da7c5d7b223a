"""Cross-site boilerplate lines by distinct-site spread (operator 1).

Every line hash gets a HyperLogLog sketch of the sites (sources) that hold it;
sketches merge by aggregation, so a line held by a third of all rows costs one
sketch a task.  Lines whose estimate is within BAND of the threshold get an
exact distinct count.  Lines on ``min_sites`` sites or more are boilerplate and
are removed wherever they stand.  Only a document without a line of its own (all
its lines are boilerplate) keeps them: it is a copy of others as a whole, which
document-level dedup handles, and stripping it would leave no text behind.

Lines are split at \\n and compared without spaces, tabs and \\r around them, by
two 64-bit hashes.  Blank lines are neither counted nor removed; lines that stay
are unchanged.  Null or empty text has no lines and stays as it is; null sources
count as one site.  Rows are told apart by two hashes of doc_id and text, so
repeated rows give repeated results, null doc_ids are kept, and an empty table gives an empty
result.  Columns other than doc_id, text and source only pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from msgscope.llm.spill import stored

MIN_SITES = 10
LG_K = 12
#: Four standard errors of a sketch with 2**12 registers, and a little more.
BAND = 0.07
NO_SITE = "\x00null"


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def _row_key() -> list[Column]:
    return [F.xxhash64("doc_id", "text").alias("k"), F.xxhash64(F.lit(1), "doc_id", "text").alias("k2")]


def line_table(docs: DataFrame) -> DataFrame:
    """(k, k2: row key, pos, a, b: line hash, site) of the lines that are not blank."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("pos"), _trimmed(x).alias("t")))
    own = docs.select(
        *_row_key(),
        F.xxhash64(F.coalesce(F.col("source").cast("string"), F.lit(NO_SITE))).alias("site"),
        F.filter(lines, lambda x: x["t"] != "").alias("every"),
    )
    # the keys stand in a projection of their own: beside the generator, Spark
    # would hash the whole text again for each line
    each = own.select("k", "k2", "site", F.explode_outer("every").alias("l"))
    return each.where("l IS NOT NULL").select("k", "k2", F.col("l.pos").alias("pos"), F.xxhash64("l.t").alias("a"), F.xxhash64(F.lit(1), "l.t").alias("b"), "site")


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(a, b) of the lines on ``min_sites`` sites or more."""
    sketches = lines.groupBy("a", "b").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("n"))
    spread = stored(sketches.where(F.col("n") >= min_sites * (1 - BAND)), "spread")
    sure = F.col("n") >= min_sites * (1 + BAND)
    near = spread.where(~sure).select("a", "b")
    pairs = lines.select("a", "b", "site").join(near, ["a", "b"], "left_semi").groupBy("a", "b", "site").agg(F.lit(1).alias("one"))
    exact = pairs.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites)
    return spread.where(sure).select("a", "b").unionByName(exact.select("a", "b"))


def _cleaned(docs: DataFrame, min_sites: int) -> DataFrame:
    """(row: the input row, n_lines, n_removed, kept: the text that stays)."""
    own = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("source"))
    lines = stored(line_table(own), "lines")
    gone = lines.join(boilerplate(lines, min_sites), ["a", "b"]).groupBy("k", "k2").agg(F.collect_set("pos").alias("gone"))
    every = own.select("row", "text", *_row_key()).join(gone, ["k", "k2"], "left")
    split = every.withColumn("l", F.split(F.coalesce("text", F.lit("")), "\n"))
    counted = split.select("row", "text", "gone", "l", F.size(F.filter("l", lambda x: _trimmed(x) != "")).cast("long").alias("n_lines"))
    cut = F.coalesce(F.size("gone") < F.col("n_lines"), F.lit(False))
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size("l") - 1), "gone"), lambda i: F.get(F.col("l"), i))
    return counted.select(
        "row", "n_lines",
        F.when(cut & F.col("gone").isNotNull(), F.size("gone")).otherwise(0).cast("long").alias("n_removed"),
        F.when(cut & F.col("gone").isNotNull(), F.array_join(left, "\n")).otherwise(F.col("text")).alias("kept"),
    )


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """The rows of ``docs`` with boilerplate lines taken out of ``text``; where
    there is a column n_chars, it follows the text."""
    out = _cleaned(docs, min_sites)
    value = {"text": F.col("kept").cast(docs.schema["text"].dataType)}
    if "n_chars" in docs.columns:
        value["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length("kept")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[value.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def line_digest(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    return _cleaned(docs.select("doc_id", "text", "source"), min_sites).select(
        F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256")
    )


def digest_sql(min_sites: int = MIN_SITES) -> str:
    """The same over table ``documents`` for DuckDB."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, chr(1)) AS site, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
e AS (SELECT r, site, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS pos FROM d),
t AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS t FROM e),
b AS (SELECT t FROM t WHERE t <> '' GROUP BY t HAVING count(DISTINCT site) >= {min_sites}),
m AS (SELECT t.*, b.t IS NOT NULL AS hit FROM t LEFT JOIN b ON t.t = b.t),
s AS (SELECT r, count(*) FILTER (t <> '' AND NOT hit) > 0 AS cut FROM m GROUP BY r),
f AS (
  SELECT r, count(*) FILTER (t <> '') AS n_lines, count(*) FILTER (hit AND cut) AS n_removed,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT (hit AND cut)), '') AS kept FROM m JOIN s USING (r) GROUP BY r)
SELECT doc_id, n_lines, n_removed, sha256(kept) AS kept_sha256 FROM f JOIN d USING (r)"""
