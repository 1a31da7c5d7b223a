"""Exact, repeatable stratified sampling (SMP-01..06).

All selections are "the first q rows of a stratum in md5(seed:id) order",
with q computed exactly from the table of strata while it is merged into the
bucket table of :func:`msgscope.operators.ranking.rank_within`, which never
puts a whole stratum in one task.  Rows with a null in a stratum column form
strata of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from msgscope.functions import patterns as P
from msgscope.operators.ranking import rank_within

STRATA = ["source", "label"]


def strat_key(strata: list[str]) -> F.Column:
    """``source|||label`` key; its string order fixes ties and fold offsets.  A
    null counts as ''."""
    return F.concat_ws("|||", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in strata])


def test_quotas(sizes: DataFrame, test_size: float, strata: list[str] = STRATA) -> DataFrame:
    """Adds ``test_quota``: largest-remainder allocation of ceil(test_size*N)
    test rows over strata.

    ``sizes``: one row per stratum with ``stratum_size``.  Integer arithmetic
    only; remainder ties go to the smaller key.
    """
    tot = Window.partitionBy()  # strata table: a few rows per source
    s = sizes.withColumn("__N", F.sum("stratum_size").over(tot))
    s = s.withColumn("__ntest", F.ceil(F.col("__N") * F.lit(float(test_size))).cast("long"))
    s = s.withColumn("__num", F.col("stratum_size") * F.col("__ntest"))
    s = s.withColumn("__floor", F.floor(F.col("__num") / F.col("__N")).cast("long"))
    s = s.withColumn("__frac", F.col("__num") - F.col("__floor") * F.col("__N"))
    s = s.withColumn("__left", F.col("__ntest") - F.sum("__floor").over(tot))
    order = Window.partitionBy().orderBy(F.col("__frac").desc(), strat_key(strata).asc())
    s = s.withColumn("__pos", F.row_number().over(order))
    quota = (F.col("__floor") + F.when(F.col("__pos") <= F.col("__left"), 1).otherwise(0)).cast("long")
    return s.withColumn("test_quota", quota).drop("__N", "__ntest", "__num", "__floor", "__frac", "__left", "__pos")


def stratified_split(
    df: DataFrame,
    id_col: str = "msg_id",
    test_size: float = P.DEFAULT_TEST_SIZE,
    seed: int = P.DEFAULT_SEED,
    strata: list[str] | None = None,
) -> DataFrame:
    """Adds ``split`` in {train, test}: exact shares of each stratum, by default
    of (source, label)."""
    keys = list(strata or STRATA)
    ranked = rank_within(df, keys, id_col, seed, per_stratum=lambda s: test_quotas(s, test_size, keys))
    return ranked.withColumn("split", F.when(F.col("rank_in_stratum") <= F.col("test_quota"), "test").otherwise("train")).drop(
        "rank_in_stratum", "stratum_size", "test_quota"
    )


def kfold_assign(
    df: DataFrame, id_col: str = "msg_id", k: int = P.DEFAULT_FOLDS, seed: int = P.DEFAULT_SEED, strata: list[str] | None = None
) -> DataFrame:
    """Adds ``fold`` in 1..k.  Strata are laid end to end in key order and
    dealt round-robin, so fold sizes differ by at most one overall and per
    stratum (the stratified k-fold allocation)."""
    keys = list(strata or STRATA)
    w = Window.partitionBy().orderBy(strat_key(keys)).rowsBetween(Window.unboundedPreceding, -1)
    start = lambda s: s.withColumn("__start", F.coalesce(F.sum("stratum_size").over(w), F.lit(0)))
    ranked = rank_within(df, keys, id_col, seed, per_stratum=start)
    return ranked.withColumn("fold", (((F.col("__start") + F.col("rank_in_stratum") - 1) % k) + 1).cast("int")).drop(
        "rank_in_stratum", "stratum_size", "__start"
    )


def fold_report(folded: DataFrame) -> DataFrame:
    """AGG-40: per fold, train/validation sizes and spam rates (percent)."""
    per = folded.groupBy("fold").agg(
        F.count(F.lit(1)).alias("val_size"), F.sum("label").alias("val_spam")
    )
    tot = Window.partitionBy()
    per = per.withColumn("__n", F.sum("val_size").over(tot)).withColumn("__s", F.sum("val_spam").over(tot))
    return per.select(
        "fold",
        (F.col("__n") - F.col("val_size")).cast("long").alias("train_size"),
        F.col("val_size").cast("long").alias("val_size"),
        F.round((F.col("__s") - F.col("val_spam")) * 100.0 / (F.col("__n") - F.col("val_size")), 6).alias("train_spam_rate"),
        F.round(F.col("val_spam") * 100.0 / F.col("val_size"), 6).alias("val_spam_rate"),
    )


def rebalance(
    train: DataFrame,
    target_spam_rates: dict | None,
    soft_cap_ratio: float = P.DEFAULT_SOFT_CAP,
    id_col: str = "msg_id",
    seed: int = P.DEFAULT_SEED,
) -> DataFrame:
    """SMP-05/06: undersample ham per source to a target spam rate, then cap
    each source at int(total*ratio) rows keeping its label proportions.

    A source keeps its rows when its target is missing/invalid, it has no
    spam, or it lacks ham.  Both quotas select a prefix of the same hash
    order, so the final rows are ``rank <= min(q_rebalance, q_cap)``.
    """
    targets = target_spam_rates or {}
    valid = {str(k): float(v) for k, v in targets.items() if isinstance(v, (int, float)) and 0 < v < 1}
    target = F.lit(None).cast("double")
    for k, v in valid.items():
        target = F.when(F.col("source") == k, F.lit(v)).otherwise(target)

    def quotas(sizes: DataFrame) -> DataFrame:
        """Adds ``quota`` to the table of strata."""
        by_source, every = Window.partitionBy("source"), Window.partitionBy()
        n = lambda label: F.coalesce(F.sum(F.when(F.col("label") == label, F.col("stratum_size"))).over(by_source), F.lit(0))
        s = sizes.withColumns({"__spam": n(1), "__ham": n(0), "__target": target})
        req = F.floor(F.col("__spam") * (1 - F.col("__target")) / F.col("__target")).cast("long")
        enough = F.col("__target").isNotNull() & (F.col("__spam") > 0) & (req <= F.col("__ham"))
        s = s.withColumn("__ham_q", F.when(enough, req).otherwise(F.col("__ham")))
        s = s.withColumn("__n_src", F.col("__spam") + F.col("__ham_q"))
        # a source's rows of this table share its n_src: count it once
        once = F.row_number().over(by_source.orderBy("label")) == 1
        s = s.withColumn("__once", F.when(once, F.col("__n_src")).otherwise(0))
        s = s.withColumn("__cap", F.floor(F.sum("__once").over(every) * F.lit(float(soft_cap_ratio))).cast("long"))
        own = F.when(F.col("label") == 1, F.col("__spam")).otherwise(F.col("__ham_q"))
        capped = F.floor(F.col("__cap") * own / F.col("__n_src"))
        quota = F.when(F.col("__n_src") > F.col("__cap"), capped).otherwise(own).cast("long")
        return s.withColumn("quota", quota).drop("__spam", "__ham", "__target", "__ham_q", "__n_src", "__once", "__cap")

    ranked = rank_within(train, STRATA, id_col, seed, per_stratum=quotas)
    return ranked.where(F.col("rank_in_stratum") <= F.col("quota")).drop("rank_in_stratum", "stratum_size", "quota")
