"""Saved-analysis history (HIS-01): append, owner filter, search, paging."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from msgscope.functions import patterns as P
from msgscope.functions.text import snippet
from msgscope.session import materialize


def append_analyses(existing: DataFrame, new: DataFrame) -> DataFrame:
    """SNK-10: new rows get ids after the current maximum (in arrival order
    ``created_at, message_text``) and a creation time when missing.  They are
    dealt by ranges of that order, so no task holds all new rows."""
    start = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m"))
    staged = new.withColumn("created_at", F.coalesce(F.col("created_at"), F.current_timestamp()))
    ordered = materialize(staged.repartitionByRange("created_at", "message_text").sortWithinPartitions("created_at", "message_text"))
    part = ordered.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id())
    sizes = part.groupBy("__p").agg(F.count("*").alias("__n"))
    before = sizes.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    # the id within a partition is the low part of the generated one
    inside = F.col("__i").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    k = "__one"
    numbered = (
        part.join(before, "__p").withColumn(k, F.lit(1)).join(F.broadcast(start.withColumn(k, F.lit(1))), k)
        .withColumn("id", F.col("m") + F.col("__b") + inside)
    )
    return existing.unionByName(numbered.select(*existing.columns))


SORT_KEYS = {"created_at": "created_at", "snippet": "message_text", "id": "id"}


def get_analysis(analyses: DataFrame, owner: str, analysis_id: int) -> DataFrame:
    """TOP-10: the owner's analysis of this id; no rows if there is none."""
    return analyses.where((F.col("id") == analysis_id) & (F.col("user_id") == owner))


def search_page(
    analyses: DataFrame, owner: str, q: str, page: int, size: int, sort: str = "created_at", descending: bool = True
) -> DataFrame:
    """FLT-06/07, TOP-06/07: the owner's analyses whose snippet or timestamp
    contains ``q`` (case-insensitive), by the sort key (ties: larger id first),
    page ``page`` of ``size`` rows with position, total and has-prev/next."""
    snip = snippet(F.col("message_text"), P.SNIPPET_CHARS)
    f = analyses.where(F.col("user_id") == owner).where(
        F.lower(snip).contains(q.lower()) | F.lower(F.col("created_at").cast("string")).contains(q.lower())
    )
    total = f.agg(F.count(F.lit(1)).alias("total"))
    off = (page - 1) * size
    by = F.col(SORT_KEYS[sort])
    order = [by.desc() if descending else by.asc(), F.col("id").desc()]
    top = f.orderBy(*order).offset(off).limit(size)  # bounded top-k
    w = Window.orderBy(*order)  # <= size rows
    ranked = top.withColumn("position", (F.lit(off) + F.row_number().over(w)).cast("long"))
    k = "__one"
    out = ranked.withColumn(k, F.lit(1)).join(F.broadcast(total.withColumn(k, F.lit(1))), k).drop(k)
    return out.select(
        "id", snip.alias("snippet"), F.size("selected_models").cast("int").alias("n_models"), "position",
        F.col("total").cast("long").alias("total"),
        ((F.col("position") > 1) & F.lit(page > 1)).alias("has_prev"),
        (F.col("total") > page * size).alias("has_next"),
    )
