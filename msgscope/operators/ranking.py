"""Skew-safe ordered primitives.

``rank_within`` gives every row its exact 1-based position inside its
stratum under a deterministic hash order, without ever placing a whole
stratum in one task: every stratum is cut by a prefix of the hash whose
length follows from the number of all rows, so a bucket holds about
``ROWS_PER_BUCKET`` rows of a stratum at most.  The only exchange of the rows
is by (stratum, bucket); what depends on the stratum (size, quota, offset)
arrives with the bucket table, which has a row for each bucket.

``ordered_prefix_sums`` is the same two-level idea for a global running
total over an ordered key (PR/ROC curves): quantile buckets from
``percentile_approx`` whose number follows from the number of keys, exact
per-bucket totals, offsets over the bucket table, and a window only inside a
bucket.

Null strata and groups are strata and groups of their own.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from msgscope.session import materialize

ROWS_PER_BUCKET = 1 << 20  # rows of a stratum sorted together in one task, about
KEYS_PER_BUCKET = 1 << 17  # distinct keys of a running total in one task, about


def hash_order(seed: int, id_col: str) -> F.Column:
    """Deterministic pseudo-random order key (hex md5; equal in DuckDB)."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys of which null equals null; the keys come from ``left``."""
    named = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = None
    for k in keys:
        same = left[k].eqNullSafe(named[f"__r_{k}"])
        on = same if on is None else on & same
    return left.join(named, on, how).drop(*[f"__r_{k}" for k in keys])


def _plain_keys(keys: list[str]) -> dict[str, Column]:
    """The keys as columns that are never null, so that a window and a join can
    share one exchange."""
    out = {}
    for i, k in enumerate(keys):
        out[f"__k{i}"] = F.coalesce(F.col(k).cast("string"), F.lit(""))
        out[f"__n{i}"] = F.col(k).isNull()
    return out


def rank_within(
    df: DataFrame,
    keys: list[str],
    id_col: str,
    seed: int,
    rank_col: str = "rank_in_stratum",
    size_col: str = "stratum_size",
    per_stratum: Callable[[DataFrame], DataFrame] | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """``df`` with the exact rank of each row inside ``keys``, ordered by
    (md5(seed:id), id), and the size of its stratum.

    ``per_stratum`` may add columns (quotas, offsets) to the table of strata
    (keys, size); rows get those, too.  ``df`` is written once to the shared
    checkpoint folder, so pass only the columns that are needed."""
    rows = materialize(df)
    plain = _plain_keys(keys)
    total = rows.count()
    digits = max(0, math.ceil(math.log(max(1, total) / rows_per_bucket, 16)))
    cut = rows.withColumn("__h", hash_order(seed, id_col)).withColumns(plain).withColumn("__bucket", F.substring("__h", 1, digits))
    own = [*plain, "__bucket"]
    counts = cut.groupBy(*own).agg(F.count(F.lit(1)).alias("__c"), *[F.min(k).alias(k) for k in keys])
    before = Window.partitionBy(*plain).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    table = counts.select(*own, F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__offset"))
    sizes = counts.groupBy(*plain).agg(F.sum("__c").alias(size_col), *[F.min(k).alias(k) for k in keys])
    if per_stratum is not None:
        sizes = per_stratum(sizes)
    table = table.join(sizes.drop(*keys), list(plain))
    inner = Window.partitionBy(*own).orderBy("__h", id_col)
    return (
        cut.withColumn("__row", F.row_number().over(inner))
        .join(table, own)
        .withColumn(rank_col, (F.col("__offset") + F.col("__row")).cast("long"))
        .drop(*own, "__h", "__row", "__offset")
    )


def ordered_prefix_sums(
    df: DataFrame,
    order_col: str,
    sum_cols: list[str],
    descending: bool = True,
    inclusive: bool = True,
    keys_per_bucket: int = KEYS_PER_BUCKET,
    group_cols: list[str] | None = None,
) -> DataFrame:
    """Running totals of ``sum_cols`` over ``order_col`` within ``group_cols``
    (one row per distinct key expected, e.g. per distinct score).  Adds
    ``cum_<col>`` columns.  Bucket split points are shared by all groups."""
    g = list(group_cols or [])
    df = materialize(df)
    buckets = max(8, math.ceil(df.count() / keys_per_bucket))
    probs = [i / buckets for i in range(1, buckets)]
    qs = df.agg(F.percentile_approx(order_col, probs, 10 * max(1000, buckets)).alias("q")).first()["q"] or []
    splits = sorted(set(float(x) for x in qs))
    splits = [-math.inf] + splits + [math.inf]
    bucketed = Bucketizer(splits=splits, inputCol=order_col, outputCol="__b", handleInvalid="keep").transform(
        df.withColumn(order_col, F.col(order_col).cast("double"))
    )
    if descending:
        bucketed = bucketed.withColumn("__b", -F.col("__b"))
    totals = bucketed.groupBy(*g, "__b").agg(*[F.sum(c).alias(f"__t_{c}") for c in sum_cols])
    # bucket table: <= buckets rows per group
    wb = Window.partitionBy(*g).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *g, "__b", *[F.coalesce(F.sum(f"__t_{c}").over(wb), F.lit(0)).alias(f"__o_{c}") for c in sum_cols]
    )
    order = F.col(order_col).desc() if descending else F.col(order_col).asc()
    frame_end = 0 if inclusive else -1
    wi = Window.partitionBy(*g, "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, frame_end)
    out = join_null_safe(bucketed, offsets, g + ["__b"])
    for c in sum_cols:
        out = out.withColumn(f"cum_{c}", F.col(f"__o_{c}") + F.coalesce(F.sum(c).over(wi), F.lit(0)))
    return out.drop("__b", *[f"__o_{c}" for c in sum_cols])


def exact_quantiles(df: DataFrame, value_col: str, probs: list[float], group_cols: list[str] | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation (pandas/numpy default).

    Works on the (group, value) -> count table, so memory follows the
    number of distinct values, and ranks come from the two-level prefix
    sums rather than a global sort.  Output: group columns + ``q_<i>``.
    """
    g = list(group_cols or [])
    base = df if g else df.withColumn("__g", F.lit(0))
    gk = g or ["__g"]
    vc = base.where(F.col(value_col).isNotNull()).groupBy(*gk, F.col(value_col).cast("double").alias("__v")).agg(
        F.count(F.lit(1)).alias("__n")
    )
    cum = ordered_prefix_sums(vc, "__v", ["__n"], descending=False, group_cols=gk)
    cum = cum.withColumn("__prev", F.col("cum___n") - F.col("__n"))
    totals = vc.groupBy(*gk).agg(F.sum("__n").alias("__tot"))  # one row per group
    cum = join_null_safe(cum, totals, gk)
    aggs = []
    for i, p in enumerate(probs):
        h = (F.col("__tot") - 1) * F.lit(float(p))
        lo_rank = F.floor(h) + 1
        hi_rank = F.least(lo_rank + 1, F.col("__tot"))
        cum = cum.withColumn(f"__h{i}", h - F.floor(h))
        aggs += [
            F.max(F.when((F.col("__prev") < lo_rank) & (lo_rank <= F.col("cum___n")), F.col("__v"))).alias(f"__lo{i}"),
            F.max(F.when((F.col("__prev") < hi_rank) & (hi_rank <= F.col("cum___n")), F.col("__v"))).alias(f"__hi{i}"),
            F.max(f"__h{i}").alias(f"__f{i}"),
        ]
    res = cum.groupBy(*gk).agg(*aggs)
    return res.select(
        *g,
        *[
            (F.col(f"__lo{i}") + F.col(f"__f{i}") * (F.col(f"__hi{i}") - F.col(f"__lo{i}"))).alias(f"q_{i}")
            for i in range(len(probs))
        ],
    )


def rank_newest(df: DataFrame, keys: list[str], time_col: str, id_col: str, rank_col: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """``df`` with each row's place among the rows of its keys, newest first
    (ties: larger id).  Keys are cut by time ranges, so one key's rows lie in as
    many tasks as there are ranges; places before a range come from its counts."""
    rows = materialize(df)
    buckets = max(1, math.ceil(rows.count() / rows_per_bucket))
    at = F.unix_micros(F.col(time_col).cast("timestamp")).cast("double")
    probs = [i / buckets for i in range(1, buckets)]
    qs = (rows.agg(F.percentile_approx(at, probs, 10 * max(1000, buckets)).alias("q")).first()["q"] or []) if probs else []
    splits = [-math.inf, *sorted({0.0, *(float(x) for x in qs)}), math.inf]
    plain = _plain_keys(keys)
    cut = Bucketizer(splits=splits, inputCol="__at", outputCol="__b", handleInvalid="keep").transform(rows.withColumn("__at", at).withColumns(plain))
    own = [*plain, "__b"]
    counts = cut.groupBy(*own).agg(F.count(F.lit(1)).alias("__c"))
    later = Window.partitionBy(*plain).orderBy(F.col("__b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    table = counts.select(*own, F.coalesce(F.sum("__c").over(later), F.lit(0)).alias("__offset"))
    inner = Window.partitionBy(*own).orderBy(F.col(time_col).desc(), F.col(id_col).desc())
    ranked = cut.withColumn("__row", F.row_number().over(inner)).join(table, own)
    return ranked.withColumn(rank_col, (F.col("__offset") + F.col("__row")).cast("long")).drop(*own, "__at", "__row", "__offset")
