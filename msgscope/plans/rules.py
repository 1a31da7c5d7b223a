"""Deterministic rule columns used to drive the evaluation operators on the
given tables (a score per message, a cluster id per message/vector).

They are defined once here for Spark and once in the oracle SQL, with the
same operation order so both engines produce bit-identical doubles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from msgscope.functions.text import count_class, count_literal

LANG_CLUSTERS = ["de", "en", "es", "fr"]  # cluster id = position; others -> last + 1
RULE_MODELS = {"rule_caps": (40, 200), "rule_bangs": (10, 400), "rule_mixed": (25, 300)}


def rule_score(text_col: str = "text", upper_weight: int = 40, bang_weight: int = 200) -> Column:
    """score = floor(1e4 * (1 - 1/(1 + wu*upper/L + wb*bangs/L))) / 1e4."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    L = F.greatest(F.lit(1), F.length(t))
    u = count_class(t, r"\p{Lu}")
    e = count_literal(t, "!")
    x = F.lit(1) + (F.lit(upper_weight) * u) / L + (F.lit(bang_weight) * e) / L
    return F.floor(F.lit(10000) * (F.lit(1) - F.lit(1) / x)) / F.lit(10000.0)


def lang_cluster(lang_col: str = "lang") -> Column:
    expr = F.lit(len(LANG_CLUSTERS))
    for i, lang in reversed(list(enumerate(LANG_CLUSTERS))):
        expr = F.when(F.col(lang_col) == lang, F.lit(i)).otherwise(expr)
    return expr.cast("int")


def vector_cluster(vec_col: str = "embedding") -> Column:
    """4 clusters from the signs of the first two coordinates."""
    v = F.col(vec_col)
    return ((F.element_at(v, 1) > 0).cast("int") * 2 + (F.element_at(v, 2) > 0).cast("int")).cast("int")
