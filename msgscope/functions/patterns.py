"""Patterns, word lists and constants that define the behaviour.

These must equal the values of the system being re-expressed, so they are
stated plainly and in their natural order.  Two regex dialects are kept:

* ``*_J``  - Java regex as used by Spark's ``regexp_replace`` / ``rlike``.
* ``*_R``  - RE2 as used by DuckDB (the SQL oracle).  RE2 has no
  look-around, no back-references and an ASCII-only ``\\b``; where a rule
  needs a Unicode word boundary the oracle runs it on *word-marked* text
  (every maximal run of word characters wrapped in ``\\x01``), where
  ``\\b`` becomes the marker itself.

Character classes are spelled out (``\\p{L}\\p{N}_`` for a word character,
an explicit white-space set) so that both engines agree with Python's
Unicode ``\\w`` / ``\\s`` on the multilingual test texts.
"""

from __future__ import annotations

import sys
import unicodedata

# --------------------------------------------------------------------------
# Character classes (fixed values)
# --------------------------------------------------------------------------
WORD = r"\p{L}\p{N}_"
SPACE = (
    r"\t\n\x{0B}\f\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
DIGIT = r"\p{Nd}"
#: White space that "one space" replaces, without the single spaces it leaves alike.
SPACES_J = rf" [{SPACE}]+|[{SPACE}&&[^ ]][{SPACE}]*"
#: White space other than the space itself.
ODD_SPACE_J = "[" + SPACE.replace(r"\x{1C}-\x{20}", r"\x{1C}-\x{1F}") + "]"


def _digit_class() -> str:
    """Characters for which Python's ``str.isdigit`` holds, by rule: decimal
    digits, and others such as superscripts and circled digits."""
    more = [c for c in range(0x80, sys.maxunicode + 1) if chr(c).isdigit() and unicodedata.category(chr(c)) != "Nd"]
    runs: list[list[int]] = []
    for c in more:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "[" + DIGIT + "".join(f"\\x{{{x:x}}}-\\x{{{y:x}}}" for x, y in runs) + "]"


IS_DIGIT = _digit_class()
#: The same for Java, which looks at the cheap half first: ASCII has no other digits.
IS_DIGIT_J = rf"[[^\x00-/:-\x7F]&&{IS_DIGIT}]"
MARK = "\x01"  # word-run marker used only by the RE2 oracle

# --------------------------------------------------------------------------
# Label normalisation (fixed values)
# --------------------------------------------------------------------------
SPAM_LABELS = ["spam", "1", "1.0", "true", "yes"]
HAM_LABELS = ["not_spam", "ham", "0", "0.0", "false", "no"]

# --------------------------------------------------------------------------
# Text cleaning chain, in order (fixed values).  Each step:
# (name, java_pattern, java_replacement, re2_pattern, re2_replacement)
# --------------------------------------------------------------------------
_URL_BODY = r"(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\\(\\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+"
_EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
_PHONE = (
    rf"(\+{DIGIT}{{1,3}}[-.{SPACE}]?)?\(?{DIGIT}{{1,4}}\)?[-.{SPACE}]?"
    rf"{DIGIT}{{1,4}}[-.{SPACE}]?{DIGIT}{{1,9}}"
)
_MONEY = rf"[$£€¥₹₽][{SPACE}]*{DIGIT}+(?:[.,]{DIGIT}+)*"

CLEAN_STEPS = [
    ("md_link_http", r"\[([^\]]+)\]\(https?://[^\)]+\)", "$1 <URL> ", r"\[([^\]]+)\]\(https?://[^\)]+\)", r"\1 <URL> "),
    ("md_link_www", r"\[([^\]]+)\]\(www\.[^\)]+\)", "$1 <URL> ", r"\[([^\]]+)\]\(www\.[^\)]+\)", r"\1 <URL> "),
    ("md_bold", r"\*\*([^\*]+)\*\*", "$1", r"\*\*([^\*]+)\*\*", r"\1"),
    ("md_italic", r"\*([^\*]+)\*", "$1", r"\*([^\*]+)\*", r"\1"),
    ("md_bold_us", r"__([^_]+)__", "$1", r"__([^_]+)__", r"\1"),
    ("md_italic_us", r"_([^_]+)_", "$1", r"_([^_]+)_", r"\1"),
    ("md_code", r"`([^`]+)`", "$1", r"`([^`]+)`", r"\1"),
    ("md_strike", r"~~([^~]+)~~", "$1", r"~~([^~]+)~~", r"\1"),
    ("escaped_brackets", r"\\\[([^\]]+)\\\]", "[$1]", r"\\\[([^\]]+)\\\]", r"[\1]"),
    ("url", r"http[s]?://" + _URL_BODY, " <URL> ", r"http[s]?://" + _URL_BODY, " <URL> "),
    ("www", r"www\." + _URL_BODY, " <URL> ", r"www\." + _URL_BODY, " <URL> "),
    ("email", _EMAIL, " <EMAIL> ", _EMAIL, " <EMAIL> "),
    ("phone", rf"(?=[+({DIGIT}])" + _PHONE, " <PHONE> ", _PHONE, " <PHONE> "),
    ("money", _MONEY, " <MONEY> ", _MONEY, " <MONEY> "),
    ("number", rf"(?={DIGIT})\b{DIGIT}{{4,}}\b", " <NUMBER> ", rf"\b{DIGIT}{{4,}}\b", " <NUMBER> "),
    ("excited", r"!{2,}", " <EXCITED> ", r"!{2,}", " <EXCITED> "),
    ("question", r"\?{2,}", " <QUESTION> ", r"\?{2,}", " <QUESTION> "),
    ("dots", r"\.{3,}", " <DOTS> ", r"\.{3,}", " <DOTS> "),
    ("other_chars", rf"[^{WORD}{SPACE}!?.,<>-]", " ", rf"[^{WORD}{SPACE}!?.,<>-]", " "),
    ("spaces", SPACES_J, " ", rf"[{SPACE}]+", " "),
]
#: What the last two steps make a space of, for Java: one class, a character at a time.
CLEAN_OTHER_J = rf"[^{WORD} !?.,<>-]"
STRIP = rf"^[{SPACE}]+|[{SPACE}]+$"
MIN_CLEAN_LENGTH = 3

# --------------------------------------------------------------------------
# E-mail artefact removal, in order (fixed values)
# --------------------------------------------------------------------------
EMAIL_ARTIFACT_STEPS = [
    (rf"(?i)^subject:[{SPACE}]*", ""),
    (rf"(?i)\bsubject:[{SPACE}]*", " "),
    (rf"(?i)^subject[{SPACE}]*", ""),
    (rf"(?i)\bsubject[{SPACE}]*", " "),
    (r"(?imd)^(from|to|cc|bcc|date|reply-to):[" + SPACE + r"]*.*$", ""),  # (?d): only \n ends a line
    (rf"(?s)--[{SPACE}]*\n.*", ""),
    (rf"(?i)sent from my [{WORD}]+", ""),
    (rf"[{SPACE}]+", " "),
]
#: The same for Java: a word's first letter is looked at before its boundary.
EMAIL_ARTIFACT_STEPS_J = [(p.replace(r"\bsubject", r"(?=s)\bsubject"), r) for p, r in EMAIL_ARTIFACT_STEPS[:-1]] + [(SPACES_J, " ")]

# Source-artefact tokens (fixed values)
SOURCE_ARTIFACTS = [
    "enron", "vince", "kaminski", "ect", "hou", "cc",
    "0", "00", "01", "02", "03", "04", "05", "06", "07", "08", "09",
    "1", "10", "11", "12", "13", "14", "15", "16", "17", "18", "19",
    "2", "20", "21", "22", "23", "24", "25", "26", "27", "28", "29",
    "3", "30", "31", "4", "5", "6", "7", "8", "9",
    "j", "s", "t", "m", "n", "r", "l", "k", "p", "b", "c", "d", "f", "g", "h",
    "fwd", "fw", "re", "msg", "orig", "mailto",
]

# Sequence cleaning / tokenising (fixed values)
SEQ_KEEP = rf"[^{WORD}{SPACE}.,!?<>-]"
#: The same for Java, with all white space but the space itself.
SEQ_OTHER_J = rf"[^{WORD} .,!?<>-]"
SEQ_TOKEN = rf"[{WORD}]+|<[{WORD}]+>|[.,!?]"
TFIDF_TOKEN = rf"[{WORD}]+|<[{WORD}]+>"
DEFAULT_TFIDF_TOKEN = rf"[{WORD}]{{2,}}"
#: The same for Java, which need not give back a part of a word.
SEQ_TOKEN_J = SEQ_TOKEN.replace("]+", "]++")
TFIDF_TOKEN_J = TFIDF_TOKEN.replace("]+", "]++")
SEQ_RESERVED = [("<PAD>", 0), ("<UNK>", 1), ("<SOS>", 2), ("<EOS>", 3)]

# --------------------------------------------------------------------------
# Family A (32 columns) keyword lists and patterns (fixed values)
# --------------------------------------------------------------------------
URGENCY_WORDS = ["urgent", "act now", "limited time", "expires", "hurry", "fast", "don't wait", "now", "immediately"]
MONEY_WORDS = ["free", "prize", "win", "winner", "cash", "money", "claim", "reward", "£", "$", "pounds", "bonus"]
ACTION_WORDS = ["call", "click", "text", "txt", "reply", "send", "subscribe", "unsubscribe", "download"]
SUSPICIOUS_WORDS = ["congratulations", "selected", "guaranteed", "offer", "promotion", "discount"]

HAS_URL = rf"http[s]?://|www\.|[{WORD}]+\.(com|org|net|co\.uk)"
#: As HAS_URL, for a search: what comes before a word's last character doesn't matter.
HAS_URL_J = rf"http[s]?://|www\.|\.(?<=[{WORD}]\.)(?:com|org|net|co\.uk)"
HAS_EMAIL = _EMAIL
HAS_PHONE_J = rf"(?=[+(]|{DIGIT})(?:\b{DIGIT}{{5,}}\b|(\+?{DIGIT}{{1,3}}[{SPACE}-]?)?\(?{DIGIT}{{3}}\)?[{SPACE}.-]?{DIGIT}{{3,4}}[{SPACE}.-]?{DIGIT}{{4}})"
HAS_PHONE_R_MARKED = rf"{MARK}{DIGIT}{{5,}}{MARK}"
HAS_PHONE_R_PLAIN = rf"(\+?{DIGIT}{{1,3}}[{SPACE}-]?)?\(?{DIGIT}{{3}}\)?[{SPACE}.-]?{DIGIT}{{3,4}}[{SPACE}.-]?{DIGIT}{{4}}"
HAS_PRICE = rf"£{DIGIT}+|\${DIGIT}+|{DIGIT}+[{SPACE}]*(pound|dollar|gbp|usd)"
HAS_PRICE_J = rf"(?=[£$]|{DIGIT})(?:{HAS_PRICE})"
NUMBER_SEQ_J = rf"(?={DIGIT})\b{DIGIT}{{4,}}\b"
NUMBER_SEQ_R_MARKED = rf"{MARK}{DIGIT}{{4,}}{MARK}"
CAPS_RUN = r"[A-Z]{3,}"
SENTENCE_SPLIT = r"[.!?]+"
PUNCT_CHARS = "!?.,:;"

# --------------------------------------------------------------------------
# Family B special tokens (fixed values)
# --------------------------------------------------------------------------
SPECIAL_TOKENS = [
    ("url_count", "<URL>"), ("email_count", "<EMAIL>"), ("phone_count", "<PHONE>"), ("money_count", "<MONEY>"),
    ("number_count", "<NUMBER>"), ("excited_count", "<EXCITED>"), ("question_token_count", "<QUESTION>"),
    ("dots_count", "<DOTS>"),
]

# --------------------------------------------------------------------------
# Family C word patterns on lower-case text (fixed values).
# name -> alternatives; "\s" inside an alternative means white space.
# Java form: \b(alt|...)\b ; RE2 form on marked text: MARK(alt|...)MARK
# --------------------------------------------------------------------------
FAMILY_C_WORDS = [
    ("grammar_errors", ["you're", "your", "there", "their", "its", "it's", "to", "too", "two"]),
    ("time_pressure", ["limited", "expires?", "deadline", "hurry", "quick", "immediate", "now", "today", "tonight", "asap"]),
    ("scarcity_words", ["last", "final", "only", "exclusive", "rare", "unique", "secret", "special"]),
    ("superlatives", ["best", "greatest", "amazing", "incredible", "unbelievable", "guaranteed", "perfect"]),
    ("call_to_action", ["click", "call", "visit", "download", "install", "register", "sign up", "buy now", "order", "purchase"]),
    ("imperative_verbs", ["get", "take", "grab", "claim", "receive", "earn", "make", "win", "start", "try"]),
    ("promotional_words", ["sale", "discount", "coupon", "voucher", "rebate", "cashback", "bonus", "reward"]),
    ("free_count", ["free"]),
    ("offer_count", ["offer", "deal", "save", "win", "prize", "gift"]),
    ("positive_emotions", ["amazing", "awesome", "fantastic", "incredible", "wonderful", "congratulations"]),
    ("fear_words", ["warning", "alert", "danger", "risk", "lose", "miss", "mistake", "problem", "urgent"]),
    ("excitement_words", ["winner", "lucky", "selected", "chosen", "opportunity", "chance"]),
    ("personal_pronouns", ["you", "your", "yours"]),
    ("url_shorteners", [r"bit\.ly", "tinyurl", r"t\.co", r"goo\.gl", r"ow\.ly"]),
]
GENERIC_GREETINGS = (["dear", "hello", "hi", "greetings"], ["sir", "madam", "friend", "customer"])
FIRST_PERSON = (["i"], ["am", "have", "will", "can", "guarantee"])
SUSPICIOUS_DOMAINS = r"\.(tk|ml|ga|cf|click|download)"
SUSPICIOUS_ATTACHMENTS = ["exe", "zip", "rar", "bat", "scr", "com"]
PERCENTAGE = rf"{DIGIT}+%"
PRICE_PATTERNS = rf"\${DIGIT}+|{DIGIT}+[{SPACE}]*dollars?|{DIGIT}+[{SPACE}]*bucks|cost|price"
EXCESSIVE_SPACES = rf"[{SPACE}]{{4,}}"
NUMBER_RUN = rf"{DIGIT}{{4,}}"
REPEATED_CHARS = r"(.)\1{2,}"
SPECIAL_DENSITY_CHARS = "!@#$%^&*()+={}[]|\\:\";'<>?,./"
VOWELS = "aeiouAEIOU"
SPAM_PHRASES = [
    ("free money", 3), ("make money", 2), ("work from home", 2), ("click here", 2), ("act now", 3),
    ("limited time", 2), ("you have won", 3), ("claim now", 3), ("no obligation", 2), ("risk free", 2),
    ("satisfaction guaranteed", 2),
]
FLESCH = (206.835, 1.015, 84.6, 50.0)

# --------------------------------------------------------------------------
# Feature-name categories, first hit wins (fixed values)
# --------------------------------------------------------------------------
FEATURE_CATEGORIES = [
    ("Source", ["source"]),
    ("Text_Stats", ["count", "length", "ratio", "char", "word", "sentence"]),
    ("Spam_Tokens", ["url", "email", "phone", "money", "excited", "number"]),
    ("Formatting", ["caps", "upper", "exclamation", "question", "punctuation"]),
    ("Urgency_Language", ["time_pressure", "scarcity", "superlatives", "call_to_action", "imperative"]),
    ("Emotional_Indicators", ["positive_emotions", "fear_words", "excitement", "emotional"]),
    ("Commercial_Indicators", ["free", "offer", "promotional", "money", "price"]),
    ("Linguistic_Quality", ["grammar", "complexity", "readability"]),
]

# Risk tiers on a spam probability, highest first (fixed values)
# (threshold, type, confidence level)
RISK_TIERS = [
    (0.8, "spam", "Very High Risk"),
    (0.65, "spam", "High Risk"),
    (0.5, "spam", "Medium Risk"),
    (0.35, "mixed", "Low Risk"),
]
RISK_DEFAULT = ("ham", "Safe")

# Service limits (fixed values)
MAX_TEXT_CHARS = 10000
LOCKOUT_ATTEMPTS = 3
LOCKOUT_SECONDS = 30
SNIPPET_CHARS = 50
BLOCKED_HOSTS = ["localhost", "127.0.0.1", "0.0.0.0", "::1", "localhost.localdomain"]

# Sampling defaults (fixed values)
DEFAULT_TEST_SIZE = 0.2
DEFAULT_FOLDS = 5
DEFAULT_SOFT_CAP = 0.42
DEFAULT_SEED = 42

# Feature-importance name fragments (fixed values); a feature may hit several
IMPORTANCE_FRAGMENTS = [
    "tfidf", "char_count", "word_count", "exclamation", "question", "upper", "url", "email", "phone", "money", "source",
]
IMPORTANCE_TYPES = ["tfidf", "exclamation", "question", "upper", "url", "source"]

# --------------------------------------------------------------------------
# English stop words (fixed values, the library's list)
# --------------------------------------------------------------------------
ENGLISH_STOP_WORDS = """
    i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers
    herself it its itself they them their theirs themselves what which who whom this that these those am is are
    was were be been being have has had having do does did doing a an the and but if or because as until while of
    at by for with about against between into through during before after above below to from up down in out on
    off over under again further then once here there when where why how all any both each few more most other
    some such no nor not only own same so than too very s t can will just don should now i'll you'll he'll she'll
    we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've you've
    they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't
    mustn't can't couldn't cannot could here's how's let's ought that's there's what's when's where's who's why's
    would
""".split()
