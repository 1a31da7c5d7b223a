"""Byte-level BPE by tree concatenation (operator 11).

A text longer than ``LEAF`` characters is halved until the pieces are short,
wherever the middles fall, without looking for a place to split.  The pieces are
encoded on their own, and neighbours are joined level by level.  Around each join a
window of tokens is encoded again; it grows until both sides agree exactly:

* Left, the window begins at the start of a pre-token of the left half (those
  that end ``MARGIN`` bytes before the join are the whole text's, since the
  pre-splitting pattern and the added tokens look no further ahead), or inside a
  longer one with the token that the left half has there.
* Right, a pre-token starts in the window where one starts in the right half -
  from there on both scans are alike - or the window ends inside a pre-token
  with the token that the right half has there.

Inside one pre-token a row of tokens is its encoding if every two neighbours are
the encoding of their bytes, and every pair of the result stands in one of the
three encodings.  If nothing agrees, the window becomes both halves.

Texts above ``SPREAD`` characters are dealt out as rows of pieces, so that one
long text is encoded by many tasks; joining them takes one task a text (its ids
are one cell of the result anyway).  Other texts are encoded, joined and decoded
where they are read.

Null text counts as empty: no ids.  Repeated rows give repeated results; a null
doc_id stays null; an empty table gives no rows; other columns of the input,
whatever their names, are not read.  The string of an added token inside a text
is that token, as for the library.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgscope.llm.spill import stored

#: Characters of a piece, and of a text that is dealt out to several tasks.
LEAF = 1 << 13
SPREAD = 1 << 16
#: Bytes that the pre-splitting pattern may look ahead; the longest added token
#: is taken in too.
LOOK = 16
#: Tokens on each side of a join in the first window.
WINDOW = 8
#: Words of a generation that a worker remembers, characters of such a word, and
#: new words strung together for the library.
KNOWN, WORD, STRUNG = 200_000, 48, 2000
#: Marks an id that begins a pre-token.
FIRST = np.uint32(1 << 31)
#: Between a character other than white space and a space or line end, every match
#: of the pattern ends, and no match looks beyond: a piece's words encode alone.
CUT = re.compile(r"(?<=[^\s\x1c-\x1f])(?=[ \n])")
#: Rows and bytes of text handed to the library at once.
ROWS, SLICE = 256, 1 << 20


class Piece(NamedTuple):
    """A text's bytes, token ids, where each token ends, and whether a pre-token
    starts with it."""

    raw: bytes
    ids: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def byte_of_character() -> dict[str, int]:
    """What byte a token's character stands for: visible characters of Latin-1 for
    themselves, the other bytes in order for those from 256 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


class TreeEncoder:
    def __init__(self, spec: str, leaf: int = LEAF, window: int = WINDOW):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.leaf, self.window = leaf, window
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.tok = Tokenizer.from_str(spec)
        self.tok.no_truncation()
        self.tok.no_padding()
        d = json.loads(spec)
        pre, added, model = d.get("pre_tokenizer") or {}, d.get("added_tokens") or [], d.get("model") or {}
        #: Whether texts may be cut: byte-level pre-tokens, nothing that changes the text.
        self.cuts = (
            pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
            and not d.get("normalizer") and model.get("type") == "BPE" and not model.get("dropout")
            and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix") and not model.get("ignore_merges")
            and not any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word", "normalized"))
        )
        self.margin = max([LOOK, *(len(t["content"].encode()) for t in added)])
        # a token's characters stand for bytes, one each; an added token is itself
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.size = np.zeros(max(vocab.values(), default=0) + 1, np.int64)
        for token, i in vocab.items():
            self.size[i] = len(token)
        for t in added:
            self.size[t["id"]] = len(t["content"].encode())
        self.bytes: list[bytes] | None = None
        if (d.get("decoder") or {}).get("type") == "ByteLevel":
            of = byte_of_character()
            known = lambda t: bytes(of[c] for c in t) if all(c in of for c in t) else t.encode()
            self.bytes = [b""] * len(self.size)
            for token, i in vocab.items():
                self.bytes[i] = known(token)

    # ---------------------------------------------------------------- pieces

    def halves(self, text: str) -> list[str]:
        """The text's pieces: halved until none is longer than a leaf."""
        if len(text) <= self.leaf or not self.cuts:
            return [text]
        mid = len(text) // 2
        return self.halves(text[:mid]) + self.halves(text[mid:])

    def _learn(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """The codes of words: their ids, with ``FIRST`` where a pre-token starts.
        Words between two cuts are strung together; sizes tell where each ends."""
        strung = [w for w in words if w[:1] in (" ", "\n") and not w[-1].isspace()] if self.cuts else []
        alone = list(set(words).difference(strung))
        blocks = [strung[a : a + STRUNG] for a in range(0, len(strung), STRUNG)] + [[w] for w in alone]
        for some, e in zip(blocks, self.tok.encode_batch(["".join(x) for x in blocks], add_special_tokens=False)):
            code, word = np.array(e.ids, np.uint32), np.array(e.word_ids, np.int64)
            ends = np.cumsum(self.size[code])
            code[:1] |= FIRST
            code[1:] |= np.where(word[1:] != word[:-1], FIRST, np.uint32(0))
            if len(some) == 1:
                yield some[0], code.tobytes()
                continue
            at = [0, *(np.searchsorted(ends, np.cumsum([len(w.encode()) for w in some])) + 1).tolist()]
            data = code.tobytes()
            yield from ((w, data[4 * i : 4 * j]) for w, i, j in zip(some, at, at[1:]))

    def codes(self, texts: list[str]) -> list[np.ndarray]:
        """The codes of each text.  The library is asked once for a word that comes
        again; of two generations of words the older one is forgotten."""
        words = [CUT.split(t) for t in texts] if self.cuts else [[t] for t in texts]
        have, new = {}, []
        for w in set(chain.from_iterable(words)):
            x = self.young.get(w)
            if x is None:
                x = self.old.get(w)
                if x is None:
                    new.append(w)
                    continue
                self.young[w] = x
            have[w] = x
        for w, x in self._learn(new):
            have[w] = x
            if len(w) <= WORD:
                self.young[w] = x
        if len(self.young) > KNOWN:
            self.young, self.old = {}, self.young
        return [np.frombuffer(b"".join([have[w] for w in some]), np.uint32) for some in words]

    def pieces(self, texts: list[str]) -> list[Piece]:
        out = []
        for t, code in zip(texts, self.codes(texts)):
            ids = code & ~FIRST
            out.append(Piece(t.encode(), ids, np.cumsum(self.size[ids]), code >= FIRST))
        return out

    # ----------------------------------------------------------------- joins

    def join(self, a: Piece, b: Piece) -> Piece:
        """The encoding of both halves' text from those of the halves."""
        if not len(a.ids) or not len(b.ids):
            return a if len(a.ids) else b
        raw, k = a.raw + b.raw, self.window
        while True:
            i, j = self._left(a, k), self._right(b, k)
            p, q = int(a.ends[i - 1]) if i else 0, int(b.ends[j - 1])
            w = self.pieces([raw[p : len(a.raw) + q].decode()])[0]
            if i == 0 and j == len(b.ids):
                return Piece(raw, w.ids, w.ends, w.first)
            if i and not a.first[i]:  # inside a pre-token: the token there must be the same
                left = w.ids[0] == a.ids[i]
                w.first[0] = False
            else:
                left = True
            cut = self._agree(w, b, j, len(a.raw) - p) if left else None
            if cut is not None:
                n, m = cut
                ids = np.concatenate([a.ids[:i], w.ids[:n], b.ids[m:]])
                first = np.concatenate([a.first[:i], w.first[:n], b.first[m:]])
                return Piece(raw, ids, np.cumsum(self.size[ids]), first)
            k *= 2

    def _left(self, a: Piece, k: int) -> int:
        """The token of the left half that the window begins with, about ``k``
        tokens from its end; 0 for the whole half."""
        i = len(a.ids) - k
        start = np.flatnonzero(a.first)
        while i > 0:
            at = int(a.ends[i - 1])
            if at <= len(a.raw) - self.margin and a.raw[at] & 0xC0 != 0x80:
                if a.first[i]:
                    return i
                own = int(start[np.searchsorted(start, i, side="right") - 1])
                if at - (int(a.ends[own - 1]) if own else 0) >= 4 and a.raw[at] != 0x27:
                    return i
            i -= 1
        return 0

    def _right(self, b: Piece, k: int) -> int:
        """How many tokens of the right half the window takes."""
        j = k
        while j < len(b.ids):
            at = int(b.ends[j - 1])
            if at > self.margin and b.raw[at] & 0xC0 != 0x80:
                return j
            j += 1
        return len(b.ids)

    def _agree(self, w: Piece, b: Piece, j: int, at: int) -> tuple[int, int] | None:
        """(tokens of the window, tokens of the right half to leave out) where the
        window, in which the right half begins at byte ``at``, goes over into it."""
        if j == len(b.ids):
            return len(w.ids), j
        # starts of pre-tokens by byte of the right half, in the window and in the half
        end = int(b.ends[j - 1])
        inside = np.flatnonzero(w.first[1:]) + 1
        here = w.ends[inside - 1] - at
        sure = (here >= 0) & (here <= end - self.margin)
        inside, here = inside[sure], here[sure]
        there = np.flatnonzero(b.first[: j + 1])
        starts = np.where(there > 0, b.ends[there - 1], 0)
        common, x, y = np.intersect1d(here, starts, assume_unique=True, return_indices=True)
        if len(common):
            return int(inside[x[0]]), int(there[y[0]])
        if b.first[j] or w.ids[-1] != b.ids[j - 1]:
            return None
        own = int(there[-1])
        if end - (int(b.ends[own - 1]) if own else 0) < self.margin:
            return None
        return len(w.ids), j

    def merge(self, parts: list[Piece]) -> Piece:
        """One piece from neighbouring ones, joined level by level."""
        while len(parts) > 1:
            parts = [self.join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0]

    # ----------------------------------------------------------------- texts

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        short = [i for i, t in enumerate(texts) if len(t) <= self.leaf or not self.cuts]
        out: list = [None] * len(texts)
        for i, code in zip(short, self.codes([texts[i] for i in short])):
            out[i] = code & ~FIRST
        for i, t in enumerate(texts):
            if out[i] is None:
                out[i] = self.merge(self.pieces(self.halves(t))).ids
        return out

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """The texts of the ids, special tokens too: for a byte-level decoder the
        tokens' bytes strung together, as the library does."""
        if self.bytes is None:
            return self.tok.decode_batch([x.tolist() for x in ids], skip_special_tokens=False)
        return [b"".join(map(self.bytes.__getitem__, x.tolist())).decode("utf-8", "replace") for x in ids]


_encoders: dict = {}


def encoder(spec: str) -> TreeEncoder:
    """Built once in each worker process."""
    if spec not in _encoders:
        _encoders[spec] = TreeEncoder(spec)
    return _encoders[spec]


# ---------------------------------------------------------------------- tables

OUT = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("text", pa.string())])
OUT_SQL = "id long, n_tokens long, ids binary, text string"
LEAVES = "row long, id long, leaf long, text string"
PIECES = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("leaf", pa.int64()), ("text", pa.string()), ("ids", pa.binary()), ("first", pa.binary())])


def _slices(b: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows of bounded text; a longer text is a run of its own."""
    size = [len(t or "") for t in b.column(column).to_pylist()]
    a = total = 0
    for i, n in enumerate(size):
        if i > a and (total + n > SLICE or i - a >= ROWS):
            yield b.slice(a, i - a)
            a, total = i, 0
        total += n
    if a < len(size):
        yield b.slice(a)


def _results(enc: TreeEncoder, ids: list, tokens: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()),
            pa.array([len(x) for x in tokens], pa.int64()),
            pa.array([x.astype("<u4").tobytes() for x in tokens], pa.binary()),
            pa.array(enc.decode(tokens), pa.string()),
        ],
        schema=OUT,
    )


def round_trip(
    docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", spread: int = SPREAD,
    then: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, then_sql: str = OUT_SQL,
) -> DataFrame:
    """(id, n_tokens, ids binary: little-endian unsigned 32-bit, text decoded
    from them) for each row of ``docs``.  ``then`` takes these rows on in the task that
    made them, to the columns ``then_sql``: ids and texts don't pass through a second
    worker process beside the one that holds the vocabulary."""
    spark = docs.sparkSession
    then = then or (lambda out: out)
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())  # a vocabulary, whatever the corpus
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def whole(batches):
        enc = encoder(spec.value)
        for b in batches:
            for s in _slices(b, 1):
                yield then(_results(enc, s.column(0).to_pylist(), enc.encode(s.column(1).to_pylist())))

    def cut(batches):
        enc = encoder(spec.value)
        for b in batches:
            for row, i, text in zip(*(c.to_pylist() for c in b.columns)):
                parts = enc.halves(text)
                n = len(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row] * n, pa.int64()), pa.array([i] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(parts, pa.string())],
                    names=["row", "id", "leaf", "text"],
                )

    def encode(batches):
        enc = encoder(spec.value)
        for b in batches:
            for s in _slices(b, 3):
                got = enc.pieces(s.column(3).to_pylist())
                more = [pa.array([p.ids.astype("<u4").tobytes() for p in got], pa.binary()), pa.array([p.first.tobytes() for p in got], pa.binary())]
                yield pa.RecordBatch.from_arrays([*s.columns, *more], schema=PIECES)

    def join(table: pa.Table) -> pa.Table:
        enc = encoder(spec.value)
        t = table.sort_by("leaf")
        parts = []
        for text, ids, first in zip(t["text"].to_pylist(), t["ids"].to_pylist(), t["first"].to_pylist()):
            tokens = np.frombuffer(ids, "<u4")
            parts.append(Piece(text.encode(), tokens, np.cumsum(enc.size[tokens]), np.frombuffer(first, bool).copy()))
        return pa.Table.from_batches([then(_results(enc, t["id"].to_pylist()[:1], [enc.merge(parts).ids]))])

    size = F.length("text")
    # the row number tells repeated rows apart; written, so that it holds if a task runs again
    long = stored(rows.where(size > spread).select(F.monotonically_increasing_id().alias("row"), "id", "text"), "long-texts")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = long.mapInArrow(cut, LEAVES).repartition(n, "row", "leaf").mapInArrow(encode, LEAVES + ", ids binary, first binary")
    return rows.where(size <= spread).mapInArrow(whole, then_sql).unionByName(dealt.groupBy("row").applyInArrow(join, then_sql))


def round_trip_digest(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """doc_id, n_tokens, SHA-256 of the decimal ids joined by commas, and of the
    decoded text."""

    decimal: list[str] = []  # of a task

    def digest(out: pa.RecordBatch) -> pa.RecordBatch:
        tokens = [np.frombuffer(x, "<u4") for x in out.column(2).to_pylist()]
        most = max((int(x.max()) + 1 for x in tokens if len(x)), default=0)
        decimal.extend(map(str, range(len(decimal), most)))
        ids = (",".join(map(decimal.__getitem__, x.tolist())).encode() for x in tokens)
        texts = (x.encode() for x in out.column(3).to_pylist())
        sha = [pa.array([hashlib.sha256(x).hexdigest() for x in some], pa.string()) for some in (ids, texts)]
        return pa.RecordBatch.from_arrays([out.column(0), out.column(1), *sha], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return round_trip(docs, tokenizer_file, then=digest, then_sql="doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
