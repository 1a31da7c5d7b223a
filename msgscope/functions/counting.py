"""Family C and the clustering tokens inside a task, many texts at a time.

``features.family_c`` and the clustering tokeniser state what is counted, as
columns: a pattern a feature, each over the whole text.  Here the texts of an
Arrow batch are one array of code points, classified once; words, sentences and
runs are its maximal runs, and the word lists are looked up once a word.  Slices
of ``SLICE`` code points, and of ``BATCH`` for tokens and output, bound the arrays.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from msgscope.functions import patterns as P
from msgscope.functions.features import FAMILY_C_ORDER

#: Code points that are looked at together; a longer text is looked at alone.
SLICE, BATCH = 1 << 18, 1 << 22
#: What stands before and after each text: no code point.
EDGE = 0x110000
INK, LETTER, DECIMAL, MARK, UPPER, LOWER, DIGIT, SPECIAL, VOWEL, STOP, WORD, BREAK = (1 << i for i in range(12))
_CATEGORIES = {"Lu": LETTER | UPPER | WORD, "Ll": LETTER | LOWER | WORD, "Lt": LETTER | LOWER | WORD, "Lm": LETTER | WORD, "Lo": LETTER | WORD, "Nd": DECIMAL | WORD, "Mn": MARK}


@lru_cache(maxsize=1)
def _python(pattern: str) -> re.Pattern:
    """A pattern with Java's code points in braces."""
    return re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: f"\\U{int(m[1], 16):08x}", pattern))


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The classes of every code point; ``EDGE`` has none.  WORD is what Java's word
    boundary looks at, without marks."""
    kinds = [unicodedata.category(chr(c)) for c in range(EDGE)]
    out = np.array([_CATEGORIES.get(k, 0) | INK for k in kinds] + [0], np.uint16)
    out[[c for c, k in enumerate(kinds) if k[0] == "N" and chr(c).isdigit()]] |= DIGIT
    space = _python(f"[{P.SPACE}]")
    out[[c for c in range(0x3001) if space.match(chr(c))]] &= ~np.uint16(INK)
    for chars, flag in ((P.SPECIAL_DENSITY_CHARS, SPECIAL), (P.VOWELS, VOWEL), ("!?.", STOP), ("_", WORD), ("\n\r\x85\u2028\u2029", BREAK)):
        out[[ord(c) for c in chars]] |= flag
    return out


class _Texts:
    """Texts as one array of code points, an ``EDGE`` around each."""

    def __init__(self, texts: pa.Array):
        size = np.asarray(pc.utf8_length(texts), np.int64)
        self.n, self.size = len(texts), size
        joined = "".join(texts.to_pylist()).encode("utf-32-le")
        ends = np.concatenate([[0], np.cumsum(size)])
        self.at = ends + np.arange(self.n + 1)  # the edges
        self.points = np.insert(np.frombuffer(joined, "<u4"), ends, EDGE)
        self.flags = _classes()[self.points]

    def has(self, flag: int) -> np.ndarray:
        return (self.flags & flag) != 0

    def count(self, places: np.ndarray) -> np.ndarray:
        """By text, how many of the ascending places are in it."""
        return np.diff(np.searchsorted(places, self.at))

    def of(self, mask: np.ndarray) -> np.ndarray:
        return self.count(np.flatnonzero(mask))


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of maximal runs; the first and the last place are false."""
    change = np.flatnonzero(mask[1:] != mask[:-1]) + 1
    return change[::2], change[1::2]


@lru_cache(maxsize=1)
def _lists() -> tuple[dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], dict[str, int]]:
    """By length the words that any list or phrase looks for (keys ascending, their
    code points, ids), and the id of each word."""
    alts = [a.replace("\\", "").replace("expires?", "expires") for _, words in P.FAMILY_C_WORDS for a in words]
    alts += [w for pair in (P.GENERIC_GREETINGS, P.FIRST_PERSON) for words in pair for w in words] + P.SUSPICIOUS_ATTACHMENTS + ["expire"]
    words = sorted({w for a in alts for w in re.findall(r"\w+", a)})
    ids, out = {w: i for i, w in enumerate(words)}, {}
    for size in sorted({len(w) for w in words}):
        own = [w for w in words if len(w) == size]
        chars = np.array([[ord(c) for c in w] for w in own], np.uint64)
        key = _key(chars)
        order = np.argsort(key)
        out[size] = (key[order], chars[order], np.array([ids[w] for w in own])[order])
    return out, ids


def _key(chars: np.ndarray) -> np.ndarray:
    key = np.zeros(len(chars), np.uint64)
    for j in range(chars.shape[1]):
        key = key * np.uint64(1_000_003) + chars[:, j]
    return key


def _word_ids(points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The id of each run of word characters, -1 for words of no list."""
    out = np.full(len(starts), -1)
    for size, (keys, chars, ids) in _lists()[0].items():
        own = np.flatnonzero(sizes == size)
        mine = points[starts[own][:, None] + np.arange(size)].astype(np.uint64)
        key = _key(mine)
        place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit = np.flatnonzero(keys[place] == key)
        hit = hit[(mine[hit] == chars[place[hit]]).all(axis=1)]
        out[own[hit]] = ids[place[hit]]
    return out


def _word_counts(low: _Texts) -> dict[str, np.ndarray]:
    """The word lists and phrases of lower-case texts, as whole words."""
    ids, word, points = _lists()[1], low.has(WORD), low.points
    marks, ends = _runs(low.has(MARK))
    for a, b in zip(marks, ends):  # marks belong to the letter or digit before them
        word[a:b] = low.flags[a - 1] & (LETTER | DECIMAL) != 0
    starts, ends = _runs(word)
    found = _word_ids(points, starts, ends - starts)
    ink = np.cumsum(low.has(INK))
    gap = np.where(low.has(INK), 0, points == EDGE).astype(np.int64)  # an edge is no space
    gap = np.cumsum(gap) + ink  # grows at whatever is no white space
    first = np.flatnonzero((found[:-1] >= 0) & (found[1:] >= 0))  # with a word of a list after it
    a, b = found[first], found[first + 1]
    apart, sep = starts[first + 1] - ends[first], points[ends[first]]
    spaced = gap[starts[first + 1] - 1] == gap[ends[first] - 1]
    member = lambda x, words: np.isin(x, [ids[w] for w in words])
    dotted = points[starts - 1] == ord(".")
    out = {}
    for name, alts in P.FAMILY_C_WORDS:
        alts = [x.replace("\\", "") for alt in alts for x in ([alt[:-2], alt[:-2] + "s"] if alt.endswith("s?") else [alt])]
        places = [starts[member(found, [x for x in alts if x in ids and re.fullmatch(r"\w+", x)])]]
        for left, mid, right in (re.fullmatch(r"(\w+)(\W)(\w+)", x).groups() for x in alts if not re.fullmatch(r"\w+", x)):
            places.append(starts[first[(a == ids[left]) & (b == ids[right]) & (apart == 1) & (sep == ord(mid))]])
        out[name] = low.count(np.sort(np.concatenate(places)))
    for name, (left, right) in (("generic_greetings", P.GENERIC_GREETINGS), ("first_person_claims", P.FIRST_PERSON)):
        out[name] = low.count(starts[first[member(a, left) & member(b, right) & spaced]])
    out["suspicious_attachments"] = low.count(starts[member(found, P.SUSPICIOUS_ATTACHMENTS) & dotted])
    after = np.flatnonzero(points[:-1] == ord(".")) + 1
    padded = np.append(points, np.full(16, EDGE, points.dtype))
    domain = np.zeros(len(after), bool)
    for d in re.fullmatch(r"\\\.\((.*)\)", P.SUSPICIOUS_DOMAINS)[1].split("|"):
        domain |= (padded[after[:, None] + np.arange(len(d))] == [ord(c) for c in d]).all(axis=1)
    out["suspicious_domains"] = low.count(after[domain])
    return out


def _price_counts(low: _Texts, texts: pa.Array) -> np.ndarray:
    """As ``P.PRICE_PATTERNS``: amounts after a dollar sign, or before dollars or bucks."""
    points, decimal = low.points, low.has(DECIMAL)
    sign = np.flatnonzero((points[:-1] == ord("$")) & decimal[1:])
    total = low.count(sign) + np.asarray(pc.count_substring(texts, "cost")) + np.asarray(pc.count_substring(texts, "price"))
    starts, ends = _runs(decimal)
    if len(starts):
        solid, place = low.has(INK) | (points == EDGE), np.arange(len(points))
        then = np.minimum.accumulate(np.where(solid, place, len(points))[::-1])[::-1]  # the next that is no white space
        after = then[ends[points[starts - 1] != ord("$")]]
        padded = np.append(points, np.full(16, EDGE, points.dtype))
        money = np.zeros(len(after), bool)
        for w in ("dollar", "bucks"):
            money |= (padded[after[:, None] + np.arange(len(w))] == [ord(c) for c in w]).all(axis=1)
        total = total + low.count(after[money])
    return total


def _counts(texts: pa.Array, lower: pa.Array) -> np.ndarray:
    t, low = _Texts(texts), _Texts(lower)
    points, size = t.points, t.size.astype(np.float64)
    literal = lambda x, s: np.asarray(pc.count_substring(x, s))
    ink, upper, lower_case, vowel, stop = (t.has(f) for f in (INK, UPPER, LOWER, VOWEL, STOP))
    starts, ends = _runs(ink)
    inside = lambda mask: (lambda c: c[ends - 1] - c[starts - 1])(np.cumsum(mask))
    long = ends - starts
    wc, letters = t.count(starts), t.of(ink)
    caps = t.count(starts[(long >= 3) & (inside(lower_case) == 0) & (inside(upper) > 0)])
    syllables = t.of(vowel) + t.count(starts[inside(vowel) == 0])
    complex_words = t.count(starts[long >= 7])
    piece, _ = _runs(ink & ~stop)  # words of sentences
    group = np.cumsum(stop | (points == EDGE))[piece]
    head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    part, words = piece[head], np.diff(np.append(head, len(group)))
    sc = t.count(part)
    again = np.zeros(len(points), bool)
    again[1:] = (points[1:] == points[:-1]) & ((t.flags[1:] & BREAK) == 0) & (points[1:] != EDGE)
    run = lambda mask, least: (lambda a, b: t.count(a[b - a >= least]))(*_runs(mask))
    share = lambda x, of: np.divide(x, of, out=np.zeros(t.n), where=of > 0)
    awps, decimal = share(wc.astype(float), sc), t.has(DECIMAL)
    score = sum(literal(lower, phrase) * weight for phrase, weight in P.SPAM_PHRASES)
    flesch = P.FLESCH[0] - P.FLESCH[1] * awps - P.FLESCH[2] * share(syllables.astype(float), wc)
    cols = {
        "char_count": size, "word_count": wc, "avg_word_length": share(letters.astype(float), wc), "sentence_count": sc,
        "avg_sentence_length": share(t.count(piece).astype(float), sc),
        **{f"{n}_count": literal(texts, f"<{n.upper()}>") for n in ("url", "email", "phone", "money", "excited")},
        "exclamation_ratio": share(literal(texts, "!"), size), "question_ratio": share(literal(texts, "?"), size), "upper_ratio": share(t.of(upper), size),
        "caps_words": caps, "caps_ratio": share(caps, wc), "non_alphabetic_ratio": share(t.of(ink & ~t.has(LETTER)), size),
        "special_char_density": share(t.of(t.has(SPECIAL)), size), "repeated_chars": run(again, 2), "line_breaks": literal(texts, "\n"),
        "excessive_spaces": run(~ink & (points != EDGE), 4), "incomplete_sentences": sc, "avg_words_per_sentence": awps,
        "percentage_mentions": t.count(np.flatnonzero((points[1:] == ord("%")) & decimal[:-1]) + 1), "price_patterns": _price_counts(low, lower),
        "spam_phrase_score": score, "consecutive_capitals": run((points >= ord("A")) & (points <= ord("Z")), 3),
        "digit_ratio": share(t.of(t.has(DIGIT)), size), "number_sequences": run(decimal, 4),
        "short_sentences": t.count(part[words < 5]), "long_sentences": t.count(part[words > 20]),
        "complex_words": complex_words, "simple_words": wc - t.count(starts[long >= 4]), "complexity_ratio": share(complex_words, wc),
        "flesch_approx": np.where(wc > 0, flesch, P.FLESCH[3]), "syllable_count": syllables, **_word_counts(low),
    }
    return np.stack([np.asarray(cols[n], np.float64) for n in FAMILY_C_ORDER], axis=1)


def slices(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """(first, number) of runs of texts of ``most`` code points together, or one text."""
    ends, a = np.cumsum(np.asarray(pc.fill_null(pc.utf8_length(texts), 0), np.int64)), 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")))
        yield a, b - a
        a = b


def family_c_rows(texts: pa.Array, lower: pa.Array) -> np.ndarray:
    """A row a text, in ``FAMILY_C_ORDER``, of texts and the same in lower case."""
    texts, lower = (pc.fill_null(a, "") for a in (texts, lower))
    return np.concatenate([np.zeros((0, len(FAMILY_C_ORDER))), *(_counts(texts.slice(*s), lower.slice(*s)) for s in slices(texts, SLICE))])


class Tokens:
    """The clustering tokens of words one space apart: source artefacts, stop words and
    what ``text.filter_source_artifacts`` drops left out.  A word is looked at once."""

    MOST = 1 << 18  # words that are kept

    def __init__(self):
        self.known: dict[str, list[str]] = {}
        self.other = re.compile(r"[^\w]+")
        self.token = re.compile(r"\w+|<\w+>")
        self.left_out, self.stop = set(P.SOURCE_ARTIFACTS), set(P.ENGLISH_STOP_WORDS)

    def _of(self, word: str) -> list[str]:
        core = self.other.sub("", word)
        if len(core) <= 2 or core in self.left_out or core.isdigit():
            return []
        return [w for w in self.token.findall(word) if w not in self.stop]

    def __call__(self, lower: pa.Array) -> pa.ListArray:
        lists = pc.split_pattern(pc.fill_null(lower, ""), " ")
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.known) > self.MOST:
            self.known = {}
        each = []
        for w in words:
            own = self.known.get(w)
            if own is None:
                own = self.known[w] = self._of(w)
            each.append(own)
        size = np.array([len(x) for x in each], np.int64)
        flat, first = pa.array([w for x in each for w in x], pa.string()), np.cumsum(size) - size
        code = np.asarray(coded.indices, np.int64)
        n = size[code]
        ends = np.concatenate([[0], np.cumsum(n)])
        place = np.repeat(first[code] - ends[:-1], n) + np.arange(ends[-1])
        off = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists), np.int64))])
        return pa.ListArray.from_arrays(pa.array(ends[off].astype(np.int32)), flat.take(pa.array(place)))
