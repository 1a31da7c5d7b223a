"""Quality rules as a bitmask ledger (operator 6), DataFrame functions only.

``ledger`` reads each text once: it takes the measurements, evaluates every rule
on them and keeps the failures as bits of one long.  The stored ledger holds no
text, so policies (named sets of rules, by version) are applied to it without
reading the corpus again, and ``ablations`` answers "what would be kept without
this rule" from counts by failure pattern: at most 2**rules rows, whatever the
input.

Words are runs of characters other than space and \\t \\n \\v \\f \\r.  Null text
counts as empty: no words, so it fails ``few_words``.  Repeated rows give
repeated results; a null doc_id stays null; an empty table gives an empty ledger.
Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from msgscope.llm.spill import stored

WHITE = r"[\x20\x09-\x0D]+"
WINDOW = 8

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_upper"]

#: name -> (failure on the measurements, the same for SQL).  A rule's bit is its
#: place here; add new rules at the end so that stored ledgers stay readable.
RULES: dict[str, tuple[Callable[[], Column], str]] = {
    "few_words": (lambda: F.col("n_words") < 20, "n_words < 20"),
    "repeated_windows": (lambda: F.col("n_repeat_words") * 100 > F.col("n_words") * 30, "100 * n_repeat_words > 30 * n_words"),
    "symbols": (lambda: F.col("n_symbols") * 10 > F.col("n_words"), "10 * n_symbols > n_words"),
    "repeated_lines": (lambda: F.col("n_dup_lines") * 100 > F.col("n_lines") * 30, "100 * n_dup_lines > 30 * n_lines"),
    "upper_case": (lambda: F.col("n_upper") * 100 > F.col("n_letters") * 40, "100 * n_upper > 40 * n_letters"),
    "word_length": (
        lambda: (F.col("word_chars") < F.col("n_words") * 2) | (F.col("word_chars") > F.col("n_words") * 20),
        "word_chars < 2 * n_words OR word_chars > 20 * n_words",
    ),
    "few_letters": (lambda: F.col("n_letters") * 100 < F.col("word_chars") * 50, "100 * n_letters < 50 * word_chars"),
}

#: version -> rules whose failure rejects a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "repeated_lines"),
    "v2": ("few_words", "repeated_windows", "symbols", "repeated_lines", "upper_case", "word_length", "few_letters"),
}


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask(policy: str) -> int:
    return sum(bit(r) for r in POLICIES[policy])


def _with(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once a row, however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _repeated_words(windows: Column) -> Column:
    """Words covered by windows that occur twice or more: sort (hash, start),
    keep starts with an equal neighbour, add up what each start covers."""

    def starts(s: Column) -> Column:
        same = lambda x, i: F.coalesce((F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]), F.lit(False))
        return F.sort_array(F.transform(F.filter(s, same), lambda x: x["at"]))

    def cover(p: Column) -> Column:
        step = F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1), x + WINDOW) - x).cast("long"))
        return F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)

    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    return _with(pairs, lambda s: _with(starts(s), cover))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and MEASURES; each step's arrays are columns of its own, used by the next."""
    words = (
        docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
        .withColumn("w", F.filter(F.split("t", WHITE), lambda w: w != ""))
        .withColumn("l", F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    )
    counted = words.select(
        "doc_id",
        F.size("w").alias("n"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.char_length(F.regexp_replace("t", r"\P{L}+", "")).cast("long").alias("n_letters"),
        F.char_length(F.regexp_replace("t", r"\P{Lu}+", "")).cast("long").alias("n_upper"),
        F.transform("w", lambda w: F.xxhash64(w)).alias("h"),
    )
    window = F.transform(
        F.sequence(F.lit(0), F.col("n") - WINDOW), lambda i: F.xxhash64(*[F.get(F.col("h"), i + k) for k in range(WINDOW)])
    )
    windows = counted.withColumn("v", F.when(F.col("n") >= WINDOW, window).otherwise(F.array().cast("array<bigint>"))).drop("h")
    repeated = F.when(F.size(F.array_distinct("v")) == F.size("v"), F.lit(0).cast("long")).otherwise(_repeated_words(F.col("v")))
    return windows.select("doc_id", F.col("n").cast("long").alias("n_words"), *MEASURES[1:5], repeated.alias("n_repeat_words"), *MEASURES[6:])


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, MEASURES and ``fail_bits``: every rule, evaluated once."""
    bits = None
    for name, (fails, _) in RULES.items():
        b = F.when(fails(), F.lit(bit(name))).otherwise(F.lit(0)).cast("long")
        bits = b if bits is None else bits.bitwiseOR(b)
    return measure(docs).withColumn("fail_bits", bits)


def apply_policy(entries: DataFrame, policy: str) -> DataFrame:
    """The stored entries with ``policy``, ``base_failed`` and ``kept``; what the
    base policy rejects is never kept."""
    base = F.col("fail_bits").bitwiseAND(F.lit(mask("base"))) != 0
    return entries.withColumns({
        "policy": F.lit(policy),
        "base_failed": base,
        "kept": F.col("fail_bits").bitwiseAND(F.lit(mask("base") | mask(policy))) == 0,
    })


def ablations(entries: DataFrame, policy: str) -> DataFrame:
    """A row for each rule of the policy: documents that fail it, fail it alone,
    and are kept in all and without it."""
    used = entries.select(F.col("fail_bits").bitwiseAND(F.lit(mask(policy))).alias("p")).groupBy("p").agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(bit(r)).cast("long").alias("b")) for r in POLICIES[policy]])
    each = used.select("p", "n", F.explode(rules).alias("r")).select("p", "n", "r.rule", "r.b")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    p, b = F.col("p"), F.col("b")
    return each.groupBy("rule").agg(
        total(p.bitwiseAND(b) != 0).alias("n_failed"),
        total(p == b).alias("n_failed_alone"),
        total(p == 0).alias("n_kept"),
        total(p.bitwiseAND(F.bitwise_not(b)) == 0).alias("n_kept_without"),
    )


def rule_digest(docs: DataFrame, policy: str = "v2") -> DataFrame:
    return apply_policy(stored(ledger(docs), "ledger"), policy).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits"
    )


def digest_sql(policy: str = "v2") -> str:
    """The same over table ``documents`` for DuckDB."""
    bits = " | ".join(f"(CASE WHEN {sql} THEN {bit(r)} ELSE 0 END)" for r, (_, sql) in RULES.items())
    return rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
s AS (
  SELECT r, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
v AS (SELECT r, unnest(range(1, len(w) - 6)) AS i, w FROM s WHERE len(w) >= 8),
k AS (SELECT r, i, array_to_string(list_slice(w, i, i + 7), ' ') AS k FROM v),
d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM k) WHERE c > 1),
g AS (SELECT r, sum(least(8, coalesce(next - i, 8))) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS next FROM d) GROUP BY r),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(g.n, 0)::BIGINT AS n_repeat_words,
    length(regexp_replace(t, '\P{{L}}+', '', 'g'))::BIGINT AS n_letters, length(regexp_replace(t, '\P{{Lu}}+', '', 'g'))::BIGINT AS n_upper
  FROM s LEFT JOIN g USING (r)),
b AS (SELECT *, ({bits})::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & {mask("base")}) <> 0 AS base_failed,
  (fail_bits & {mask("base") | mask(policy)}) = 0 AS kept, fail_bits FROM b"""
