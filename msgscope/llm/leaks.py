"""Benchmark decontamination by CGK embedding and bit sampling (operator 3).

Texts are rows of words: lower case, without ASCII punctuation.  A document
holds an item if some span of its words is within ``EDITS`` of the item's length
in edit distance (words inserted, deleted or replaced).

The CGK embedding walks along a row of words and writes the word it stands on at
each step; a random bit for each word and step says whether it moves on.  Two
rows a few edits apart soon walk in step again, so edit distance becomes Hamming
distance, and sampled places of the output agree for near rows.  Short
items are classed by length, all of ``WINDOW`` words or more are one class.  A
window has as many steps as its class has words at least, so about half as many
words; windows begin at every ``stride``-th word of a document and at every word
of an item up to its last whole window, so a passage holds an aligned window for
each ``stride`` of its words, wherever its edits lie.  ``REPEATS`` independent
walks, each sampled at ``SAMPLES`` places, reach the target recall (measured in
the tests by length and kind of edits).  A window's sampled words are looked up one place at a
time, and windows that no item can match any more stop walking.

Candidates of one item that begin within its allowed edits of each other are
looked at together.  They are verified: first by the number of the item's words nearby (a bound
that loses nothing), then by exact edit distance to the best span.

Items are the stated query set: they go through in blocks of bounded bytes, each
against all documents.  Null or empty items match nothing, and neither do null or
empty documents.  Items of fewer than five words must occur exactly (20 % of them
is less than a word).  Repeated rows and equal items give repeated results; null
ids stay null; empty tables give an empty result.  Columns other than doc_id,
text, item_id are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgscope.llm import textbuf as tb

EDITS = 0.2
REPEATS = 8
SAMPLES = 4
WINDOW = 16
ITEM_BLOCK_BYTES = 4 << 20
SLICE = 1 << 19
TABLE_BITS = 16

#: ASCII punctuation is dropped; letters are lower case already.
DROPPED = np.zeros(256, dtype=bool)
DROPPED[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def plain_words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words, offsets by row) of lower-case texts."""
    keep = ~DROPPED[raw]
    at = np.concatenate([[0], np.cumsum(keep)])
    raw, off = raw[keep], at[off]
    start, end, by_row = tb.words(raw, off)
    return tb.word_hashes(raw, start, end), by_row


def allowed(n: np.ndarray) -> np.ndarray:
    return np.floor(np.asarray(n) * EDITS + 1e-9).astype(np.int64)


@dataclass
class Plan:
    """What one class looks for in one repeat."""

    least: int  # items of least .. 2 * least - 1 words, the last class of all from WINDOW on
    repeat: int
    places: np.ndarray  # sampled steps, ascending
    seen: list  # for each place, a table of the words that items show there
    keys: np.ndarray  # sorted
    item: np.ndarray
    shift: np.ndarray  # where in the item the window begins

    @property
    def stride(self) -> int:
        return max(1, self.least // 4)


def _step_bits(h: np.ndarray, repeat: int, block: int) -> np.ndarray:
    return tb.salted(h, 1000 + 64 * repeat + block)


def _low(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)


def walk(h: np.ndarray, bits: list, at: np.ndarray, places: np.ndarray, seen: list | None = None):
    """(starts that are left, their keys): the words under the walkers at the
    sampled places, folded into one key.  ``seen`` drops walkers on the way."""
    left = np.arange(len(at))
    key = np.zeros(len(at), np.uint64)
    last = len(h) - 1
    now, step = at, 0
    for k, place in enumerate(places):
        while step < place:
            now = now + ((bits[step >> 6][now] >> np.uint64(step & 63)) & np.uint64(1)).astype(np.int64)
            np.minimum(now, last, out=now)
            step += 1
        word = h[now]
        if seen is not None:
            ok = seen[k][_low(word)]
            left, now, key, word = left[ok], now[ok], key[ok], word[ok]
        key = tb.salted(key ^ word, 400 + k)
    return left, key


def classes_of(n: np.ndarray) -> np.ndarray:
    """Least length of each length's class: the power of two below it, up to WINDOW."""
    return np.minimum(1 << (np.floor(np.log2(np.maximum(n, 1))).astype(np.int64)), WINDOW)


class Items:
    """The items of one block, with the keys of their windows."""

    def __init__(self, texts: list[str], repeats: int = REPEATS, samples: int = SAMPLES, seed: int = 5):
        parts = [t.encode() for t in texts]
        off = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        self.h, self.off = plain_words(np.frombuffer(b"".join(parts), np.uint8), off)
        self.n = np.diff(self.off)
        self.bag = np.sort(self._pair(np.repeat(np.arange(len(self.n)), self.n), self.h))
        self.bag = self.bag[np.concatenate([[True], self.bag[1:] != self.bag[:-1]])] if len(self.bag) else self.bag
        self.distinct = np.array([len(np.unique(self.words(i))) for i in range(len(self.n))], np.int64)
        self.plans = []
        rng = np.random.default_rng(seed)
        kind = np.where(self.n > 0, classes_of(self.n), 0)
        # behind an item stand words that nothing equals
        gap = WINDOW + 2
        tail = tb.salted(np.arange(gap, dtype=np.uint64), 55)
        for least in np.unique(kind[kind > 0]):
            members = np.flatnonzero(kind == least)
            steps = int(least)
            # items of fewer than four words must occur exactly, from their first word on
            shifts = self.n[members] - steps // 2 + 1 if least >= 4 else np.ones(len(members), np.int64)
            padded = np.concatenate([np.concatenate([self.h[self.off[i] : self.off[i + 1]], tail]) for i in members])
            first = np.concatenate([[0], np.cumsum(self.n[members] + gap)[:-1]])
            shift = tb.ragged(shifts)
            at = np.repeat(first, shifts) + shift
            item, shift = np.repeat(members, shifts).astype(np.int32), shift.astype(np.int32)
            for r in range(repeats):
                places = np.sort(rng.choice(steps, min(samples, steps), replace=False))
                if least < 4 and r:
                    break  # one or two places: all repeats are alike
                bits = [_step_bits(padded, r, b) for b in range((steps >> 6) + 1)]
                seen = []
                now, step = at, 0
                for place in places:
                    while step < place:
                        now = now + ((bits[step >> 6][now] >> np.uint64(step & 63)) & np.uint64(1)).astype(np.int64)
                        step += 1
                    table = np.zeros(1 << TABLE_BITS, dtype=bool)
                    table[_low(padded[now])] = True
                    seen.append(table)
                _, key = walk(padded, bits, at, places)
                order = np.argsort(key, kind="stable")
                self.plans.append(Plan(int(least), r, places, seen, key[order], item[order], shift[order]))

    @staticmethod
    def _pair(item: np.ndarray, h: np.ndarray) -> np.ndarray:
        return tb.salted(h ^ tb.salted(item.astype(np.uint64), 8), 9)

    def words(self, i: int) -> np.ndarray:
        return self.h[self.off[i] : self.off[i + 1]]

    def candidates(self, h: np.ndarray, by_row: np.ndarray):
        """(row, item, first and last place where the item would begin) by the
        sampled walks; places at most the item's allowed edits apart are one."""
        out = []
        bits: dict = {}
        starts: dict = {}
        for p in sorted(self.plans, key=lambda p: (p.repeat, p.least)):
            if p.stride not in starts:
                count = -(-np.diff(by_row) // p.stride)
                starts[p.stride] = np.repeat(by_row[:-1], count) + p.stride * tb.ragged(count)
            at = starts[p.stride]
            if not len(at):
                continue
            for b in range((int(p.places[-1]) >> 6) + 1):
                if (p.repeat, b) not in bits:
                    bits = {k: v for k, v in bits.items() if k[0] == p.repeat} | {(p.repeat, b): _step_bits(h, p.repeat, b)}
            left, key = walk(h, [bits[p.repeat, b] for b in range((int(p.places[-1]) >> 6) + 1)], at, p.places, p.seen)
            low, high = np.searchsorted(p.keys, key, "left"), np.searchsorted(p.keys, key, "right")
            n = high - low
            entry = np.repeat(low, n) + tb.ragged(n)
            pos = np.repeat(at[left], n)
            row = np.searchsorted(by_row, pos, side="right") - 1
            out.append(np.stack([row, p.item[entry], pos - p.shift[entry]], axis=1))
        if not out:
            return np.zeros((0, 4), np.int64)
        row, item, begin = np.concatenate(out).T
        width = allowed(self.n[item]) + 1
        order = np.lexsort((begin, item, row))
        row, item, begin, part = row[order], item[order], begin[order], (begin // width)[order]
        new = np.ones(len(row), dtype=bool)
        new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (part[1:] != part[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(row))[: len(first)] - 1
        return np.stack([row[first], item[first], begin[first], begin[last]], axis=1)

    def likely(self, h: np.ndarray, by_row: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Whether enough of the item's words stand near: each edit takes away one
        of its distinct words at most."""
        ok = np.zeros(len(found), dtype=bool)
        for a in range(0, len(found), 4096):
            row, item, begin, end = found[a : a + 4096].T
            n = self.n[item]
            k = allowed(n)
            low = np.maximum(begin - 2 * k, by_row[row])
            high = np.minimum(end + n + 2 * k, by_row[row + 1])
            width = high - low
            at = np.repeat(low, width) + tb.ragged(width)
            pair = self._pair(np.repeat(item, width), h[at])
            place = np.minimum(np.searchsorted(self.bag, pair), len(self.bag) - 1)
            hit = np.flatnonzero(self.bag[place] == pair)
            each = np.unique(np.repeat(np.arange(len(row)), width)[hit] * len(self.bag) + place[hit]) // max(1, len(self.bag))
            ok[a : a + 4096] = np.bincount(each, minlength=len(row)) >= self.distinct[item] - k
        return ok

    def matches(self, h: np.ndarray, by_row: np.ndarray) -> dict:
        """(row, item) -> (edits, first word) of the best span found."""
        found = self.candidates(h, by_row)
        found = found[self.likely(h, by_row, found)]
        best: dict = {}
        for row, item, begin, end in found.tolist():
            if best.get((row, item), (1, 0))[0] == 0:
                continue
            n = int(self.n[item])
            k = int(allowed(n))
            low, high = max(begin - 2 * k, int(by_row[row])), min(end + n + 2 * k, int(by_row[row + 1]))
            edits, first = best_span(self.words(item), h[low:high])
            if edits <= k:
                new = (edits, low + first - int(by_row[row]))
                best[row, item] = min(best.get((row, item), new), new)
        return best


def best_span(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(least edit distance of ``item`` to a span of ``text``, the span's start)."""
    m = len(text)
    cost = np.zeros(m + 1, np.int64)
    origin = np.arange(m + 1)
    index = np.arange(m + 1)
    big = m + len(item) + 2
    for i, word in enumerate(item, 1):
        up, diagonal = cost + 1, cost[:-1] + (text != word)
        base, base_origin = up.copy(), origin.copy()
        take = diagonal <= up[1:]
        base[1:][take], base_origin[1:][take] = diagonal[take], origin[:-1][take]
        # words inserted in the text: least of base[j'] + (j - j') over j' <= j
        code = np.minimum.accumulate((base - index) * big + (m - index))
        source = m - code % big
        cost = base[source] + index - source
        origin = base_origin[source]
    j = int(cost.argmin())
    return int(cost[j]), int(origin[j])


def _blocks(docs: DataFrame, items: DataFrame):
    """The items, block by block, as broadcast (ids, Items); each block is about
    ITEM_BLOCK_BYTES of text."""
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.lower(F.col("text").cast("string")).alias("text")).where(F.length("text") > 0)
    size = asked.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    blocks = max(1, -(-int(size) // ITEM_BLOCK_BYTES))
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        yield docs.sparkSession.sparkContext.broadcast(([r["item_id"] for r in rows], Items([r["text"] for r in rows])))


def _matched(b: pa.RecordBatch, items: Items, lower: str):
    """(first row, end row, {(row, item): (edits, first word)}) by slice."""
    for a, z, raw, off in tb.slices(b, lower, SLICE):
        h, by_row = plain_words(raw, off)
        yield a, z, items.matches(h, by_row) if len(h) else {}


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, item_words, edits, start (word of the document) for each
    item that a document holds."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col("text").cast("string")).alias("text"))
    out = None
    for shared in _blocks(docs, items):
        found = _search(own, shared)
        out = found if out is None else out.unionByName(found)
    return out


def _search(docs: DataFrame, shared) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("item_words", pa.int32()), ("edits", pa.int32()), ("start", pa.int64())])

    def run(batches):
        ids, items = shared.value
        for b in batches:
            for a, z, best in _matched(b, items, "text"):
                if best:
                    got = sorted(best.items())
                    yield pa.RecordBatch.from_arrays(
                        [
                            b.column(0).slice(a, z - a).take(pa.array([r for (r, _), _ in got])), pa.array([ids[i] for (_, i), _ in got], pa.int64()),
                            pa.array([int(items.n[i]) for (_, i), _ in got], pa.int32()), pa.array([e for _, (e, _) in got], pa.int32()), pa.array([s for _, (_, s) in got], pa.int64()),
                        ],
                        schema=schema,
                    )

    return docs.mapInArrow(run, "doc_id long, item_id long, item_words int, edits int, start long")


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs``, unchanged, that hold no item: filtered where they
    lie, one block of items after the other."""
    lower, n = "__lower__", len(docs.columns)
    while lower in docs.columns:
        lower += "_"
    out = docs
    for shared in _blocks(docs, items):
        out = _without(out, shared, lower, n)
    return out


def _without(docs: DataFrame, shared, lower: str, n: int) -> DataFrame:
    def run(batches):
        _, items = shared.value
        for b in batches:
            kept = b.select(list(range(n)))
            for a, z, best in _matched(b, items, lower):
                clean = np.ones(z - a, dtype=bool)
                clean[[row for row, _ in best]] = False
                yield kept.slice(a, z - a).filter(pa.array(clean))

    return docs.withColumn(lower, F.lower(docs["text"].cast("string"))).mapInArrow(run, docs.schema)
