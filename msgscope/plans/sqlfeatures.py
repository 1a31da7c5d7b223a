"""DuckDB SQL forms of the three feature families (oracle only)."""

from __future__ import annotations

from msgscope.functions import patterns as P
from msgscope.plans import sqlparts as S


def _esc_class(chars: str) -> str:
    return "[" + "".join("\\" + ch for ch in chars) + "]"


def _ratio(num: str, den: str) -> str:
    return f"(CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE))"


def _safe_ratio(num: str, den: str) -> str:
    return f"(CASE WHEN {den} > 0 THEN CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) ELSE 0.0 END)"


def _contains_count(low: str, kws: list[str]) -> str:
    return "CAST((" + " + ".join(f"(CASE WHEN instr({low}, {S.lit(k)}) > 0 THEN 1 ELSE 0 END)" for k in kws) + ") AS INTEGER)"


def family_a(t: str) -> list[tuple[str, str]]:
    """``t`` must be a plain column reference (it is repeated many times)."""
    low = f"lower({t})"
    ws = S.words(t)
    wc = f"len({ws})"
    L = f"greatest(1, length({t}))"
    sent = f"greatest(1, len(string_split_regex({S.strip(t)}, {S.rx(P.SENTENCE_SPLIT)})))"
    letters = f"length(regexp_replace({t}, {S.rx('[' + P.SPACE + ']+')}, '', 'g'))"
    lw = f"list_transform({ws}, lambda w: lower(w))"
    uniq = f"len(list_distinct({lw}))"
    special = f"[^\\p{{L}}\\p{{N}}{P.SPACE}]"
    mark = S.marked(t)
    return [
        ("char_count", f"CAST(length({t}) AS INTEGER)"),
        ("word_count", f"CAST({wc} AS INTEGER)"),
        ("sentence_count", f"CAST({sent} AS INTEGER)"),
        ("avg_word_length", f"(CASE WHEN {wc} > 0 THEN {letters} / {wc} ELSE 0.0 END)"),
        ("avg_sentence_length", f"({wc} / {sent})"),
        ("urgency_count", _contains_count(low, P.URGENCY_WORDS)),
        ("money_count", _contains_count(low, P.MONEY_WORDS)),
        ("action_count", _contains_count(low, P.ACTION_WORDS)),
        ("suspicious_count", _contains_count(low, P.SUSPICIOUS_WORDS)),
        ("has_url", f"CAST(regexp_matches({low}, {S.rx(P.HAS_URL)}) AS INTEGER)"),
        ("has_email", f"CAST(regexp_matches({t}, {S.rx(P.HAS_EMAIL)}) AS INTEGER)"),
        (
            "has_phone",
            f"CAST(regexp_matches({mark}, {S.rx(P.HAS_PHONE_R_MARKED)}) OR regexp_matches({t}, {S.rx(P.HAS_PHONE_R_PLAIN)}) AS INTEGER)",
        ),
        ("currency_count", f"CAST({S.count_literal(t, '£')} + {S.count_literal(t, '$')} AS INTEGER)"),
        ("has_price", f"CAST(regexp_matches({low}, {S.rx(P.HAS_PRICE)}) AS INTEGER)"),
        ("number_sequences", S.regexp_count(mark, P.NUMBER_SEQ_R_MARKED)),
        ("exclamation_count", S.count_literal(t, "!")),
        ("question_count", S.count_literal(t, "?")),
        ("dot_count", S.count_literal(t, ".")),
        ("comma_count", S.count_literal(t, ",")),
        ("exclamation_ratio", _ratio(S.count_literal(t, "!"), L)),
        ("question_ratio", _ratio(S.count_literal(t, "?"), L)),
        ("punctuation_ratio", _ratio(S.count_class(t, _esc_class(P.PUNCT_CHARS)), L)),
        ("upper_ratio", _ratio(S.count_class(t, r"\p{Lu}"), L)),
        ("consecutive_caps", S.regexp_count(t, P.CAPS_RUN)),
        ("digit_count", S.count_class(t, S.DIGITS)),
        ("digit_ratio", _ratio(S.count_class(t, S.DIGITS), L)),
        ("special_char_count", S.count_class(t, special)),
        ("special_char_ratio", _ratio(S.count_class(t, special), L)),
        ("space_ratio", _ratio(S.count_literal(t, " "), L)),
        ("unique_words", f"CAST({uniq} AS INTEGER)"),
        ("unique_ratio", f"(CASE WHEN {wc} > 0 THEN {uniq} / {wc} ELSE 0.0 END)"),
        (
            "max_word_repetition",
            f"CAST(CASE WHEN {wc} > 0 THEN list_max(map_values(list_aggregate({lw}, 'histogram'))) ELSE 0 END AS INTEGER)",
        ),
    ]


def family_b(t: str) -> list[tuple[str, str]]:
    ws = S.words(t)
    wc = f"len({ws})"
    L = f"greatest(1, length({t}))"
    letters = f"length(regexp_replace({t}, {S.rx('[' + P.SPACE + ']+')}, '', 'g'))"
    cols = [
        ("char_count", f"CAST(length({t}) AS INTEGER)"),
        ("word_count", f"CAST({wc} AS INTEGER)"),
        ("sentence_count", f"CAST(len(string_split_regex({t}, {S.rx(P.SENTENCE_SPLIT)})) AS INTEGER)"),
        ("avg_word_length", f"(CASE WHEN {wc} > 0 THEN {letters} / {wc} ELSE 0.0 END)"),
        ("exclamation_count", S.count_literal(t, "!")),
        ("question_count", S.count_literal(t, "?")),
        ("dot_count", S.count_literal(t, ".")),
        ("comma_count", S.count_literal(t, ",")),
        ("exclamation_ratio", _ratio(S.count_literal(t, "!"), L)),
        ("question_ratio", _ratio(S.count_literal(t, "?"), L)),
        ("upper_ratio", _ratio(S.count_class(t, r"\p{Lu}"), L)),
    ]
    cols += [(name, S.count_literal(t, tok)) for name, tok in P.SPECIAL_TOKENS]
    return cols


def family_c_word_patterns_marked() -> dict[str, str]:
    out = {name: S.word_alternation_marked(alts) for name, alts in P.FAMILY_C_WORDS}
    g1, g2 = P.GENERIC_GREETINGS
    out["generic_greetings"] = (
        S.word_alternation_marked(g1) + f"[{P.SPACE}]+" + S.word_alternation_marked(g2)
    )
    f1, f2 = P.FIRST_PERSON
    out["first_person_claims"] = S.word_alternation_marked(f1) + f"[{P.SPACE}]+" + S.word_alternation_marked(f2)
    out["suspicious_attachments"] = r"\." + S.word_alternation_marked(P.SUSPICIOUS_ATTACHMENTS)
    return out


def repeated_chars(c: str) -> str:
    """Runs of three or more of one character (no line break) in the list of
    characters ``c``: the places where such a run begins."""
    return (
        f"CAST(coalesce(len(list_filter(range(1, len({c}) - 1), lambda i: {c}[i] = {c}[i + 1] AND {c}[i] = {c}[i + 2] "
        f"AND {c}[i] <> chr(10) AND (i = 1 OR {c}[i - 1] <> {c}[i]))), 0) AS INTEGER)"
    )


def family_c(t: str, low: str, marked_low: str, chars: str) -> list[tuple[str, str]]:
    """``t`` artefact-cleaned text, ``low`` = lower(t), ``marked_low`` = the
    word-marked lower text, ``chars`` its characters; all plain column references."""
    ws = S.words(t)
    wc = f"len({ws})"
    n = f"length({t})"
    parts = f"list_filter(string_split_regex({t}, {S.rx(P.SENTENCE_SPLIT)}), lambda s: {S.strip('s')} <> '')"
    sc = f"len({parts})"
    part_words = f"list_transform({parts}, lambda s: len({S.words('s')}))"
    letters = f"length(regexp_replace({t}, {S.rx('[' + P.SPACE + ']+')}, '', 'g'))"
    caps = (
        f"len(list_filter({ws}, lambda w: regexp_matches(w, '\\p{{Lu}}') AND NOT regexp_matches(w, '[\\p{{Ll}}\\p{{Lt}}]') "
        f"AND length(w) > 2))"
    )
    syl = f"coalesce(list_sum(list_transform({ws}, lambda w: greatest(1, {S.count_class('w', '[' + P.VOWELS + ']')}))), 0)"
    awps = f"(CASE WHEN {sc} > 0 THEN {wc} / {sc} ELSE 0.0 END)"
    wp = family_c_word_patterns_marked()
    mc = lambda name: S.regexp_count(marked_low, wp[name])
    phrase = " + ".join(f"{S.count_literal(low, ph)} * {w}" for ph, w in P.SPAM_PHRASES)
    complex_w = f"len(list_filter({ws}, lambda w: length(w) > 6))"
    cols = {
        "char_count": f"CAST({n} AS INTEGER)",
        "word_count": f"CAST({wc} AS INTEGER)",
        "avg_word_length": f"(CASE WHEN {wc} > 0 THEN {letters} / {wc} ELSE 0.0 END)",
        "sentence_count": f"CAST({sc} AS INTEGER)",
        "avg_sentence_length": f"(CASE WHEN {sc} > 0 THEN coalesce(list_sum({part_words}), 0) / {sc} ELSE 0.0 END)",
        "url_count": S.count_literal(t, "<URL>"),
        "email_count": S.count_literal(t, "<EMAIL>"),
        "phone_count": S.count_literal(t, "<PHONE>"),
        "money_count": S.count_literal(t, "<MONEY>"),
        "excited_count": S.count_literal(t, "<EXCITED>"),
        "exclamation_ratio": _safe_ratio(S.count_literal(t, "!"), n),
        "question_ratio": _safe_ratio(S.count_literal(t, "?"), n),
        "upper_ratio": _safe_ratio(S.count_class(t, r"\p{Lu}"), n),
        "caps_words": f"CAST({caps} AS INTEGER)",
        "caps_ratio": _safe_ratio(caps, wc),
        "non_alphabetic_ratio": _safe_ratio(S.count_class(t, f"[^\\p{{L}}{P.SPACE}]"), n),
        "special_char_density": _safe_ratio(S.count_class(t, _esc_class(P.SPECIAL_DENSITY_CHARS)), n),
        "repeated_chars": repeated_chars(chars),
        "line_breaks": S.count_literal(t, "\n"),
        "excessive_spaces": S.regexp_count(t, P.EXCESSIVE_SPACES),
        "grammar_errors": mc("grammar_errors"),
        "incomplete_sentences": f"CAST({sc} AS INTEGER)",
        "avg_words_per_sentence": awps,
        "personal_pronouns": mc("personal_pronouns"),
        "first_person_claims": mc("first_person_claims"),
        "time_pressure": mc("time_pressure"),
        "scarcity_words": mc("scarcity_words"),
        "superlatives": mc("superlatives"),
        "call_to_action": mc("call_to_action"),
        "imperative_verbs": mc("imperative_verbs"),
        "free_count": mc("free_count"),
        "offer_count": mc("offer_count"),
        "promotional_words": mc("promotional_words"),
        "percentage_mentions": S.regexp_count(t, P.PERCENTAGE),
        "price_patterns": S.regexp_count(low, P.PRICE_PATTERNS),
        "positive_emotions": mc("positive_emotions"),
        "fear_words": mc("fear_words"),
        "excitement_words": mc("excitement_words"),
        "generic_greetings": mc("generic_greetings"),
        "spam_phrase_score": f"CAST({phrase} AS INTEGER)",
        "consecutive_capitals": S.regexp_count(t, P.CAPS_RUN),
        "digit_ratio": _safe_ratio(S.count_class(t, S.DIGITS), n),
        "number_sequences": S.regexp_count(t, P.NUMBER_RUN),
        "short_sentences": f"CAST(len(list_filter({part_words}, lambda x: x < 5)) AS INTEGER)",
        "long_sentences": f"CAST(len(list_filter({part_words}, lambda x: x > 20)) AS INTEGER)",
        "suspicious_domains": S.regexp_count(low, P.SUSPICIOUS_DOMAINS),
        "url_shorteners": mc("url_shorteners"),
        "suspicious_attachments": mc("suspicious_attachments"),
        "complex_words": f"CAST({complex_w} AS INTEGER)",
        "simple_words": f"CAST(len(list_filter({ws}, lambda w: length(w) <= 3)) AS INTEGER)",
        "complexity_ratio": _safe_ratio(complex_w, wc),
        "flesch_approx": (
            f"(CASE WHEN {wc} > 0 THEN {P.FLESCH[0]} - {P.FLESCH[1]} * {awps} - {P.FLESCH[2]} * ({syl} / {wc}) "
            f"ELSE {P.FLESCH[3]} END)"
        ),
        "syllable_count": f"CAST({syl} AS INTEGER)",
    }
    return list(cols.items())
