"""DataFrame-level cleaning operators.

``clean_messages`` runs the token-marking chain once per row:

* each regex step is its own projection, guarded by a cheap byte-level
  ``contains`` test on the step's trigger text (a step whose trigger is absent
  cannot match, so the guard never changes the result);
* the last two steps, other characters and white space, are one class replaced
  by a space and a split at spaces;
* the ``length >= 3`` rule is applied through ``explode(filter(array(x)))``
  so Catalyst cannot push the predicate below the chain and evaluate the
  whole chain twice (it would for a plain ``where``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from msgscope.functions import patterns as P
from msgscope.functions.text import one_space, word_count

# Literal texts of which every match of a step contains one (none: no cheap guard)
STEP_GUARDS = {
    "md_link_http": "](", "md_link_www": "](", "md_bold": "**", "md_italic": "*", "md_bold_us": "__",
    "md_italic_us": "_", "md_code": "`", "md_strike": "~~", "escaped_brackets": "\\[", "url": "://",
    "www": "www.", "email": "@", "money": tuple("$£€¥₹₽"), "excited": "!!", "question": "??", "dots": "...",
}


#: Session setting: tasks that CPU-heavy text work is dealt out to where a table
#: has fewer row groups than the machine has cores.  Unset (the default, and right
#: for large tables), rows stay where the scan puts them.
SPREAD_SETTING = "spark.msgscope.inputPartitions"


def spread(df: DataFrame) -> DataFrame:
    n = df.sparkSession.conf.get(SPREAD_SETTING, "")
    return df.repartition(int(n)) if n else df


def with_clean_text(df: DataFrame, text_col: str = "text", out_col: str = "cleaned_text") -> DataFrame:
    """Add the cleaned text (no row filter)."""
    tmp = f"__{out_col}"
    cur = df.withColumn(tmp, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    for name, pat, rep, _p2, _r2 in P.CLEAN_STEPS[:-2]:
        step = F.regexp_replace(F.col(tmp), pat, rep)
        guard = STEP_GUARDS.get(name)
        if guard:
            has = [F.col(tmp).contains(g) for g in ([guard] if isinstance(guard, str) else guard)]
            step = F.when(reduce(Column.__or__, has), step).otherwise(F.col(tmp))
        cur = cur.withColumn(tmp, step)
    return cur.withColumn(out_col, one_space(tmp, P.CLEAN_OTHER_J)).drop(tmp)  # other characters and white space


def clean_messages(df: DataFrame, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """TXT-12: cleaned_text + text_length + word_count, rows with fewer than
    3 cleaned characters dropped."""
    staged = with_clean_text(df, text_col, "__c")
    others = [c for c in df.columns if keep_text or c != text_col]
    kept = staged.select(
        *others,
        F.explode(F.filter(F.array(F.col("__c")), lambda x: F.length(x) >= P.MIN_CLEAN_LENGTH)).alias("cleaned_text"),
    )
    return kept.withColumn("text_length", F.length("cleaned_text").cast("int")).withColumn(
        "word_count", word_count(F.col("cleaned_text")).cast("int")
    )
