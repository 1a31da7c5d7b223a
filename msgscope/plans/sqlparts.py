"""DuckDB (RE2) SQL fragments for the oracle, built from the fixed values in
:mod:`msgscope.functions.patterns`.  Only used to write ``oracle_sql()``."""

from __future__ import annotations

from msgscope.functions import patterns as P


def lit(s: str) -> str:
    """SQL string literal; control characters go through ``chr``."""
    parts, buf = [], []
    for ch in s:
        if ord(ch) < 32 and ch not in "\t\n\r":
            if buf:
                parts.append("'" + "".join(buf).replace("'", "''") + "'")
                buf = []
            parts.append(f"chr({ord(ch)})")
        else:
            buf.append(ch)
    if buf or not parts:
        parts.append("'" + "".join(buf).replace("'", "''") + "'")
    return "(" + " || ".join(parts) + ")" if len(parts) > 1 else parts[0]


def rx(pattern: str) -> str:
    return lit(pattern)


def replace_all(expr: str, pattern: str, repl: str) -> str:
    return f"regexp_replace({expr}, {rx(pattern)}, {lit(repl)}, 'g')"


def strip(expr: str) -> str:
    return replace_all(expr, P.STRIP, "")


def clean_text(expr: str) -> str:
    out = f"coalesce(CAST({expr} AS VARCHAR), '')"
    for _n, _jp, _jr, pat, rep in P.CLEAN_STEPS:
        out = replace_all(out, pat, rep)
    return strip(out)


def clean_email_artifacts(expr: str) -> str:
    out = f"coalesce(CAST({expr} AS VARCHAR), '')"
    for pat, rep in P.EMAIL_ARTIFACT_STEPS:
        if pat.startswith("(?imd)"):
            # RE2 has no (?d); its '.', '^' and '$' already treat only \n as a line end
            pat = "(?im)" + pat[6:]
        out = replace_all(out, pat, rep)
    return strip(out)


def words(expr: str) -> str:
    return f"list_filter(string_split_regex({expr}, {rx('[' + P.SPACE + ']+')}), lambda x: x <> '')"


def count_literal(expr: str, s: str) -> str:
    return f"CAST((length({expr}) - length(replace({expr}, {lit(s)}, ''))) // {len(s)} AS INTEGER)"


def count_class(expr: str, cls: str) -> str:
    return f"CAST(length({expr}) - length(regexp_replace({expr}, {rx(cls)}, '', 'g')) AS INTEGER)"


def regexp_count(expr: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({expr}, {rx(pattern)})) AS INTEGER)"


def marked(expr: str) -> str:
    """Wrap every maximal run of word characters in the marker character, so
    a Unicode word boundary becomes a literal marker for RE2."""
    return f"regexp_replace({expr}, {rx('([' + P.WORD + ']+)')}, chr(1) || '\\1' || chr(1), 'g')"


def mark_alt(alt: str) -> str:
    """Insert the marker at every word/non-word transition inside a literal
    alternative (e.g. ``you're`` -> ``you\\x01'\\x01re``, ``bit\\.ly`` ->
    ``bit\\x01\\.\\x01ly``, ``sign up`` -> ``sign\\x01 \\x01up``)."""
    out, prev_word = [], None
    i = 0
    while i < len(alt):
        ch = alt[i]
        tok = ch
        if ch == "\\" and i + 1 < len(alt):
            tok = alt[i : i + 2]
            i += 1
        is_word = tok.isalnum() or tok == "_" or tok in ("s?",)
        if tok == "?":  # optional suffix of a word ("expires?") stays attached
            out.append(tok)
            i += 1
            continue
        if prev_word is not None and is_word != prev_word:
            out.append(P.MARK)
        out.append(tok)
        prev_word = is_word
        i += 1
    return "".join(out)


def word_alternation_marked(alts: list[str]) -> str:
    return P.MARK + "(" + "|".join(mark_alt(a) for a in alts) + ")" + P.MARK


def clean_for_sequence(expr: str) -> str:
    out = f"lower(coalesce(CAST({expr} AS VARCHAR), ''))"
    out = replace_all(out, f"[{P.SPACE}]+", " ")
    out = replace_all(out, P.SEQ_KEEP, " ")
    out = replace_all(out, f"[{P.SPACE}]+", " ")
    return strip(out)


def filter_source_artifacts(expr: str) -> str:
    arts = "[" + ", ".join(lit(a) for a in P.SOURCE_ARTIFACTS) + "]"
    core = f"regexp_replace(w, {rx('[^' + P.WORD + ']')}, '', 'g')"
    keep = (
        f"NOT list_contains({arts}, {core}) AND length({core}) > 2 "
        f"AND NOT regexp_matches({core}, {rx('^' + DIGITS + '+$')})"
    )
    return f"array_to_string(list_filter({words(f'lower({expr})')}, lambda w: {keep}), ' ')"


def tokens(expr: str, pattern: str) -> str:
    return f"regexp_extract_all({expr}, {rx(pattern)})"


def with_bigrams(toks: str) -> str:
    """Unigrams followed by space-joined bigrams (``toks`` a column name)."""
    return (
        f"list_concat({toks}, CASE WHEN len({toks}) > 1 THEN "
        f"list_transform(range(1, len({toks})), lambda i: {toks}[i] || ' ' || {toks}[i + 1]) ELSE [] END)"
    )


def strip_accents(expr: str) -> str:
    return f"strip_accents({expr})"


#: Characters that count as digits: decimal ones, and the superscripts, circled
#: and other digits of Unicode (written out apart from the Spark side).
DIGITS = (
    r"[\p{Nd}²³¹\x{1369}-\x{1371}\x{19da}⁰⁴-⁹₀-₉①-⑨⑴-⑼⒈-⒐⓪⓵-⓽⓿❶-❾➀-➈➊-➒"
    r"\x{10a40}-\x{10a43}\x{10e60}-\x{10e68}\x{11052}-\x{1105a}\x{1f100}-\x{1f10a}]"
)
