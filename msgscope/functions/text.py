"""Text scalar functions as native Spark Column expressions (no UDFs).

Every function takes and returns a ``Column``; they stay inside whole-stage
codegen.  Patterns come from :mod:`msgscope.functions.patterns`.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from msgscope.functions import patterns as P


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Python ``str.strip()``: remove Unicode white space at both ends."""
    return F.regexp_replace(_c(c), P.STRIP, "")


def one_space(c, other: str = P.ODD_SPACE_J) -> Column:
    """Words one space apart, none at the ends; characters of the class ``other``
    are spaces too.  A split at a literal space takes no pattern's steps."""
    spaced = F.regexp_replace(_c(c), other, " ")
    return F.array_join(F.array_remove(F.split(spaced, " "), ""), " ")


def normalize_label(c) -> Column:
    """Map any raw label to 0/1.

    Known spam/ham words first; otherwise a number > 0.5 is spam (NaN is not);
    anything else is ham.
    """
    s = F.lower(strip_ws(_c(c).cast("string")))
    num = s.try_cast("double")
    return (
        F.when(s.isin(*P.SPAM_LABELS), F.lit(1))
        .when(s.isin(*P.HAM_LABELS), F.lit(0))
        .when(num.isNotNull() & ~F.isnan(num) & (num > 0.5), F.lit(1))
        .otherwise(F.lit(0))
        .cast("int")
    )


def clean_text(c) -> Column:
    """Token-marking cleaner: markdown, URL, e-mail, phone, money, number,
    emphasis tokens, other characters, white space; then strip."""
    out = F.coalesce(_c(c).cast("string"), F.lit(""))
    for _name, pat, rep, _p2, _r2 in P.CLEAN_STEPS:
        out = F.regexp_replace(out, pat, rep)
    return F.btrim(out)  # all white space is a space by now


def clean_email_artifacts(c) -> Column:
    """Remove subject/header lines, signatures, 'sent from my X'; collapse."""
    out = F.coalesce(_c(c).cast("string"), F.lit(""))
    for pat, rep in P.EMAIL_ARTIFACT_STEPS_J[:-1]:
        out = F.regexp_replace(out, pat, rep)
    return one_space(out)


def words(c) -> Column:
    """Python ``str.split()``: white-space separated words, no empties."""
    return F.filter(F.split(_c(c), f"[{P.SPACE}]+", -1), lambda w: w != F.lit(""))


def word_count(c) -> Column:
    return F.size(words(c))


def count_literal(c, literal: str) -> Column:
    """Non-overlapping occurrences of a literal (Python ``str.count``)."""
    c = _c(c)
    return ((F.length(c) - F.length(F.replace(c, F.lit(literal), F.lit("")))) / F.lit(len(literal))).cast("int")


def count_class(c, char_class: str) -> Column:
    """Number of characters matching a regex character class."""
    c = _c(c)
    return (F.length(c) - F.length(F.regexp_replace(c, f"{char_class}+", ""))).cast("int")


def filter_source_artifacts(c) -> Column:
    """Lower-case, split, drop words whose punctuation-free form is an
    artefact token, has length <= 2, or is all digits; re-join with spaces."""
    ws = words(F.lower(_c(c)))

    def keep(e):
        return (F.length(e["core"]) > 2) & ~e["core"].isin(P.SOURCE_ARTIFACTS) & ~e["core"].rlike(f"^{P.IS_DIGIT_J}+$")

    pairs = F.transform(ws, lambda w: F.struct(w.alias("w"), F.regexp_replace(w, f"[^{P.WORD}]+", "").alias("core")))
    return F.array_join(F.transform(F.filter(pairs, keep), lambda e: e["w"]), " ")


def clean_for_sequence(c) -> Column:
    """Light cleaner for the sequence model: lower, collapse, keep basic
    punctuation and token brackets, collapse, strip."""
    return one_space(F.lower(F.coalesce(_c(c).cast("string"), F.lit(""))), P.SEQ_OTHER_J)


def sequence_tokens(c) -> Column:
    """Word runs, ``<token>`` markers and single punctuation marks."""
    return F.regexp_extract_all(_c(c), F.lit(P.SEQ_TOKEN_J), 0)


def tfidf_tokens(c, fold_accents: bool = False) -> Column:
    """Lower-cased word runs and ``<token>`` markers (TF-IDF analyser)."""
    s = F.lower(_c(c))
    if fold_accents:
        s = strip_accents(s)
    return F.regexp_extract_all(s, F.lit(P.TFIDF_TOKEN_J), 0)


@lru_cache(maxsize=1)
def accent_map() -> tuple[str, str]:
    """Single-character accent folding table built by rule: every character
    whose NFKD form is one base character followed by combining marks maps to
    that base; combining marks of their own map to nothing."""
    src, dst, drop = [], [], []
    for cp in range(0x00A0, sys.maxunicode + 1):
        ch = chr(cp)
        if unicodedata.combining(ch):
            drop.append(ch)
            continue
        base = [x for x in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(x)]
        if len(base) == 1 and base[0] != ch:
            src.append(ch)
            dst.append(base[0])
    return "".join(src + drop), "".join(dst)


def strip_accents(c) -> Column:
    src, dst = accent_map()
    c = _c(c)
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.translate(c, src, dst)).otherwise(c)


def with_bigrams(tokens: Column) -> Column:
    """Unigrams followed by space-joined bigrams of an array column.

    ``tokens`` must be a plain column reference: it is read inside the
    per-element lambda, so passing the tokenising expression itself would
    re-tokenise the whole text for every bigram (quadratic).
    """
    if "(" in str(tokens).split("'", 1)[-1]:
        raise ValueError("with_bigrams expects a column reference; project the tokens first")
    bigrams = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0))),
        lambda i: F.concat_ws(" ", F.element_at(tokens, i), F.element_at(tokens, i + 1)),
    )
    bigrams = F.when(F.size(tokens) > 1, bigrams).otherwise(F.array().cast("array<string>"))
    return F.concat(tokens, bigrams)


def snippet(c, n: int = P.SNIPPET_CHARS) -> Column:
    return F.substring(_c(c), 1, n)
