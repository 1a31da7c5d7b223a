"""Feature columns (row -> numbers) as native Column expressions.

Three families:

* ``family_a``: 32 interpretable columns on the raw text.
* ``family_b``: 19 columns for the tree model, on cleaned (token-marked) text.
* ``family_c``: 53 columns for clustering, on e-mail-artefact-cleaned text.

Each returns ``list[(name, Column)]``; callers ``select`` them in one
projection so the whole family stays in one codegen stage.  Counting uses
``length - length(replace)`` for literals/classes (no array allocation) and
``regexp_count`` for multi-character patterns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from msgscope.functions import patterns as P
from msgscope.functions.text import _c, count_class, count_literal, one_space, words


def _ratio(num: Column, den: Column) -> Column:
    return (num.cast("double") / den.cast("double")).cast("double")


def _safe_ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def _contains_count(lower: Column, keywords: list[str]) -> Column:
    """Number of distinct keywords present as substrings."""
    total = F.lit(0)
    for kw in keywords:
        total = total + F.when(lower.contains(kw), 1).otherwise(0)
    return total.cast("int")


def _max_repetition(ws: Column) -> Column:
    """Largest multiplicity of any element: one pass over the sorted array
    (in-row, no shuffle, O(n log n) even for 20 000-word documents)."""
    init = F.struct(F.lit(None).cast("string").alias("prev"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc, w):
        run = F.when(acc["prev"] == w, acc["run"] + 1).otherwise(F.lit(1))
        return F.struct(w.alias("prev"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(F.sort_array(ws), init, step, lambda acc: acc["best"])


#: Patterns over words one space apart (``flat``), with a space at both ends where
#: they begin with one: the slow class of all white space is matched once a text.
LONG_WORD = "[^ ]{7,}"
NOT_SHORT_WORD = "[^ ]{4,}"
CAPS_WORD = r" (?=[^ ]*\p{Lu})[^ \p{Ll}\p{Lt}]{3,}(?= )"
NO_VOWEL_WORD = f" [^ {P.VOWELS}]+(?= )"


def _count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("int")


def _flat(t: Column) -> Column:
    """Words one space apart, no white space at the ends."""
    return one_space(t)


def _n_words(flat: Column) -> Column:
    return F.when(flat == "", 0).otherwise(F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit(""))) + 1).cast("int")


def _sentences(flat: Column) -> Column:
    return F.filter(F.split(flat, P.SENTENCE_SPLIT, -1), lambda s: F.btrim(s) != "")


def _sentence_words(parts: Column) -> Column:
    return F.transform(parts, lambda s: _n_words(F.btrim(s)))


def staged(df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """``keep`` and the steps that several features share, each in a projection
    of its own, so that it is evaluated once a row: ``t`` (never null), ``low``,
    ``flat``, ``n_words``, ``lw`` (lower-case words), ``parts`` (sentences that
    aren't blank), ``part_words`` (words of each)."""
    t = df.select(*keep, F.coalesce(_c(text_col).cast("string"), F.lit("")).alias("t"))
    flat = t.select("*", F.lower("t").alias("low"), _flat(F.col("t")).alias("flat"))
    parts = flat.select("*", _n_words(F.col("flat")).alias("n_words"), _sentences(F.col("flat")).alias("parts"), F.split(F.lower("flat"), " ", -1).alias("lw"))
    return parts.select("*", _sentence_words(F.col("parts")).alias("part_words"))


def features_of(df: DataFrame, family, names: list[str], text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` and the named features of a family, over shared steps."""
    cols = dict(family(F.col("t"), shared=True))
    own = list(keep or ["msg_id"])
    return staged(df, text_col, own).select(*own, *[cols[n].alias(n) for n in names])


def family_a(text_col, shared: bool = False) -> list[tuple[str, Column]]:
    """32 features of a text; ``shared`` reads the columns of ``staged``."""
    t = F.coalesce(_c(text_col).cast("string"), F.lit(""))
    low = F.col("low") if shared else F.lower(t)
    flat = F.col("flat") if shared else _flat(t)
    wc = F.col("n_words") if shared else _n_words(flat)
    n = F.length(t)
    L = F.greatest(F.lit(1), n)
    sent = F.greatest(F.lit(1), F.size(F.split(flat, P.SENTENCE_SPLIT, -1)))
    letters = F.length(F.replace(flat, F.lit(" "), F.lit("")))  # total length of words
    lw = F.col("lw") if shared else F.split(F.lower(flat), " ", -1)
    uniq = F.when(wc > 0, F.size(F.array_distinct(lw))).otherwise(0)
    punct = count_class(t, "[" + "".join("\\" + ch for ch in P.PUNCT_CHARS) + "]")
    return [
        ("char_count", n.cast("int")),
        ("word_count", wc.cast("int")),
        ("sentence_count", sent.cast("int")),
        ("avg_word_length", F.when(wc > 0, letters / wc).otherwise(F.lit(0.0)).cast("double")),
        ("avg_sentence_length", (wc / sent).cast("double")),
        ("urgency_count", _contains_count(low, P.URGENCY_WORDS)),
        ("money_count", _contains_count(low, P.MONEY_WORDS)),
        ("action_count", _contains_count(low, P.ACTION_WORDS)),
        ("suspicious_count", _contains_count(low, P.SUSPICIOUS_WORDS)),
        ("has_url", low.rlike(P.HAS_URL_J).cast("int")),
        ("has_email", (t.contains("@") & t.rlike(P.HAS_EMAIL)).cast("int")),
        ("has_phone", t.rlike(P.HAS_PHONE_J).cast("int")),
        ("currency_count", (count_literal(t, "£") + count_literal(t, "$")).cast("int")),
        ("has_price", low.rlike(P.HAS_PRICE_J).cast("int")),
        ("number_sequences", F.regexp_count(t, F.lit(P.NUMBER_SEQ_J)).cast("int")),
        ("exclamation_count", count_literal(t, "!")),
        ("question_count", count_literal(t, "?")),
        ("dot_count", count_literal(t, ".")),
        ("comma_count", count_literal(t, ",")),
        ("exclamation_ratio", _ratio(count_literal(t, "!"), L)),
        ("question_ratio", _ratio(count_literal(t, "?"), L)),
        ("punctuation_ratio", _ratio(punct, L)),
        ("upper_ratio", _ratio(count_class(t, r"\p{Lu}"), L)),
        ("consecutive_caps", F.regexp_count(t, F.lit(P.CAPS_RUN)).cast("int")),
        ("digit_count", count_class(t, P.IS_DIGIT_J)),
        ("digit_ratio", _ratio(count_class(t, P.IS_DIGIT_J), L)),
        ("special_char_count", count_class(t, f"[^\\p{{L}}\\p{{N}}{P.SPACE}]")),
        ("special_char_ratio", _ratio(count_class(t, f"[^\\p{{L}}\\p{{N}}{P.SPACE}]"), L)),
        ("space_ratio", _ratio(count_literal(t, " "), L)),
        ("unique_words", uniq.cast("int")),
        ("unique_ratio", F.when(wc > 0, uniq / wc).otherwise(F.lit(0.0)).cast("double")),
        ("max_word_repetition", F.when(wc > 0, _max_repetition(lw)).otherwise(F.lit(0)).cast("int")),
    ]


FAMILY_A_NAMES = [
    "char_count", "word_count", "sentence_count", "avg_word_length", "avg_sentence_length",
    "urgency_count", "money_count", "action_count", "suspicious_count", "has_url", "has_email", "has_phone",
    "currency_count", "has_price", "number_sequences", "exclamation_count", "question_count", "dot_count",
    "comma_count", "exclamation_ratio", "question_ratio", "punctuation_ratio", "upper_ratio", "consecutive_caps",
    "digit_count", "digit_ratio", "special_char_count", "special_char_ratio", "space_ratio", "unique_words",
    "unique_ratio", "max_word_repetition",
]


def family_b(cleaned_col) -> list[tuple[str, Column]]:
    t = F.coalesce(_c(cleaned_col).cast("string"), F.lit(""))
    ws = words(t)
    wc = F.size(ws)
    L = F.greatest(F.lit(1), F.length(t))
    letters = F.length(F.regexp_replace(t, f"[{P.SPACE}]+", ""))
    cols = [
        ("char_count", F.length(t).cast("int")),
        ("word_count", wc.cast("int")),
        ("sentence_count", F.size(F.split(t, P.SENTENCE_SPLIT, -1)).cast("int")),
        ("avg_word_length", F.when(wc > 0, letters / wc).otherwise(F.lit(0.0)).cast("double")),
        ("exclamation_count", count_literal(t, "!")),
        ("question_count", count_literal(t, "?")),
        ("dot_count", count_literal(t, ".")),
        ("comma_count", count_literal(t, ",")),
        ("exclamation_ratio", _ratio(count_literal(t, "!"), L)),
        ("question_ratio", _ratio(count_literal(t, "?"), L)),
        ("upper_ratio", _ratio(count_class(t, r"\p{Lu}"), L)),
    ]
    cols += [(name, count_literal(t, tok)) for name, tok in P.SPECIAL_TOKENS]
    return cols


FAMILY_B_NAMES = [
    "char_count", "word_count", "sentence_count", "avg_word_length", "exclamation_count", "question_count",
    "dot_count", "comma_count", "exclamation_ratio", "question_ratio", "upper_ratio",
] + [name for name, _ in P.SPECIAL_TOKENS]


def _words_pattern(alts: list[str], rest: str = "") -> str:
    """The alternatives as whole words.  Their first letters (and second, where all
    have a plain one) are looked at before the word boundary, which costs more."""
    second = "".join(sorted({a[1:2] for a in alts}))
    look = "[" + "".join(sorted({a[0] for a in alts})) + "]" + (f"[{second}]" if all(a[1:2].isalpha() for a in alts) else "")
    return rf"(?={look})\b(?:" + "|".join(alts) + ")" + rest + r"\b"


def family_c_word_patterns_java() -> list[tuple[str, str]]:
    out = [(name, _words_pattern(alts)) for name, alts in P.FAMILY_C_WORDS]
    g1, g2 = P.GENERIC_GREETINGS
    out.append(("generic_greetings", _words_pattern(g1, f"[{P.SPACE}]+(?:" + "|".join(g2) + ")")))
    f1, f2 = P.FIRST_PERSON
    out.append(("first_person_claims", _words_pattern(f1, f"[{P.SPACE}]+(?:" + "|".join(f2) + ")")))
    out.append(("suspicious_attachments", r"\.(" + "|".join(P.SUSPICIOUS_ATTACHMENTS) + r")\b"))
    return out


def family_c(text_col, with_repeated_chars: bool = True, shared: bool = False) -> list[tuple[str, Column]]:
    """53 clustering features.  Expects the *already artefact-cleaned* text
    (see :func:`msgscope.functions.text.clean_email_artifacts`); ``shared``
    reads the columns of ``staged``."""
    t = F.coalesce(_c(text_col).cast("string"), F.lit(""))
    low = F.col("low") if shared else F.lower(t)
    flat = F.col("flat") if shared else _flat(t)
    wc = F.col("n_words") if shared else _n_words(flat)
    n = F.length(t)
    parts = F.col("parts") if shared else _sentences(flat)
    sc = F.size(parts)
    part_words = F.col("part_words") if shared else _sentence_words(parts)
    letters = F.length(F.replace(flat, F.lit(" "), F.lit("")))
    padded = F.concat(F.lit(" "), flat, F.lit(" "))
    caps_words = _count(padded, CAPS_WORD)
    # each word has one syllable at least: all vowels, and one for words without any
    no_vowel = F.when(wc > 0, _count(padded, NO_VOWEL_WORD)).otherwise(0)
    syllables = sum((count_literal(t, v) for v in P.VOWELS), F.lit(0)) + no_vowel
    complex_words = _count(flat, LONG_WORD)
    awps = F.when(sc > 0, wc / sc).otherwise(F.lit(0.0))
    word_pats = dict(family_c_word_patterns_java())
    rc = lambda s, p: F.regexp_count(s, F.lit(p)).cast("int")
    special = count_class(t, "[" + "".join("\\" + ch for ch in P.SPECIAL_DENSITY_CHARS) + "]")
    phrase_score = F.lit(0)
    for phrase, weight in P.SPAM_PHRASES:
        phrase_score = phrase_score + count_literal(low, phrase) * weight
    cols = {
        "char_count": n.cast("int"),
        "word_count": wc.cast("int"),
        "avg_word_length": F.when(wc > 0, letters / wc).otherwise(F.lit(0.0)).cast("double"),
        "sentence_count": sc.cast("int"),
        "avg_sentence_length": F.when(
            sc > 0, F.aggregate(part_words, F.lit(0), lambda a, x: a + x) / sc
        ).otherwise(F.lit(0.0)).cast("double"),
        "url_count": count_literal(t, "<URL>"),
        "email_count": count_literal(t, "<EMAIL>"),
        "phone_count": count_literal(t, "<PHONE>"),
        "money_count": count_literal(t, "<MONEY>"),
        "excited_count": count_literal(t, "<EXCITED>"),
        "exclamation_ratio": _safe_ratio(count_literal(t, "!"), n),
        "question_ratio": _safe_ratio(count_literal(t, "?"), n),
        "upper_ratio": _safe_ratio(count_class(t, r"\p{Lu}"), n),
        "caps_words": caps_words.cast("int"),
        "caps_ratio": _safe_ratio(caps_words, wc),
        "non_alphabetic_ratio": _safe_ratio(count_class(t, f"[^\\p{{L}}{P.SPACE}]"), n),
        "special_char_density": _safe_ratio(special, n),
        "repeated_chars": rc(t, P.REPEATED_CHARS),
        "line_breaks": count_literal(t, "\n"),
        "excessive_spaces": rc(t, P.EXCESSIVE_SPACES),
        "grammar_errors": rc(low, word_pats["grammar_errors"]),
        # sentences are split on their terminators, so none ends with one
        "incomplete_sentences": sc.cast("int"),
        "avg_words_per_sentence": awps.cast("double"),
        "personal_pronouns": rc(low, word_pats["personal_pronouns"]),
        "first_person_claims": rc(low, word_pats["first_person_claims"]),
        "time_pressure": rc(low, word_pats["time_pressure"]),
        "scarcity_words": rc(low, word_pats["scarcity_words"]),
        "superlatives": rc(low, word_pats["superlatives"]),
        "call_to_action": rc(low, word_pats["call_to_action"]),
        "imperative_verbs": rc(low, word_pats["imperative_verbs"]),
        "free_count": rc(low, word_pats["free_count"]),
        "offer_count": rc(low, word_pats["offer_count"]),
        "promotional_words": rc(low, word_pats["promotional_words"]),
        "percentage_mentions": rc(t, P.PERCENTAGE),
        "price_patterns": rc(low, P.PRICE_PATTERNS),
        "positive_emotions": rc(low, word_pats["positive_emotions"]),
        "fear_words": rc(low, word_pats["fear_words"]),
        "excitement_words": rc(low, word_pats["excitement_words"]),
        "generic_greetings": rc(low, word_pats["generic_greetings"]),
        "spam_phrase_score": phrase_score.cast("int"),
        "consecutive_capitals": rc(t, P.CAPS_RUN),
        "digit_ratio": _safe_ratio(count_class(t, P.IS_DIGIT_J), n),
        "number_sequences": rc(t, P.NUMBER_RUN),
        "short_sentences": F.size(F.filter(part_words, lambda x: x < 5)).cast("int"),
        "long_sentences": F.size(F.filter(part_words, lambda x: x > 20)).cast("int"),
        "suspicious_domains": rc(low, P.SUSPICIOUS_DOMAINS),
        "url_shorteners": rc(low, word_pats["url_shorteners"]),
        "suspicious_attachments": rc(low, word_pats["suspicious_attachments"]),
        "complex_words": complex_words,
        "simple_words": (wc - _count(flat, NOT_SHORT_WORD)).cast("int"),
        "complexity_ratio": _safe_ratio(complex_words, wc),
        "flesch_approx": F.when(
            wc > 0,
            F.lit(P.FLESCH[0]) - F.lit(P.FLESCH[1]) * awps - F.lit(P.FLESCH[2]) * (syllables / wc),
        ).otherwise(F.lit(P.FLESCH[3])).cast("double"),
        "syllable_count": syllables.cast("int"),
    }
    if not with_repeated_chars:
        cols.pop("repeated_chars")
    return [(k, cols[k]) for k in FAMILY_C_ORDER if k in cols]


FAMILY_C_ORDER = [
    "char_count", "word_count", "avg_word_length", "sentence_count", "avg_sentence_length",
    "url_count", "email_count", "phone_count", "money_count", "excited_count",
    "exclamation_ratio", "question_ratio", "upper_ratio", "caps_words", "caps_ratio",
    "non_alphabetic_ratio", "special_char_density", "repeated_chars", "line_breaks", "excessive_spaces",
    "grammar_errors", "incomplete_sentences", "avg_words_per_sentence", "personal_pronouns", "first_person_claims",
    "time_pressure", "scarcity_words", "superlatives", "call_to_action", "imperative_verbs",
    "free_count", "offer_count", "promotional_words", "percentage_mentions", "price_patterns",
    "positive_emotions", "fear_words", "excitement_words", "generic_greetings", "spam_phrase_score",
    "consecutive_capitals", "digit_ratio", "number_sequences", "short_sentences", "long_sentences",
    "suspicious_domains", "url_shorteners", "suspicious_attachments", "complex_words", "simple_words",
    "complexity_ratio", "flesch_approx", "syllable_count",
]
