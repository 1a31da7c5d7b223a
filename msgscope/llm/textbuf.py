"""Whole-buffer access to Arrow text columns: words and rolling hashes in numpy.

Inside a task a text column arrives as one byte buffer with offsets.  The
helpers here find words and hash any byte range or any run of words of the
whole buffer at once, so no per-row Python is needed.  A range hash is a
polynomial over a table of random values, taken modulo 2**64 from prefix sums:
``(S[e] - S[s]) * B**-s``; ``mix`` scatters its bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes that separate words: space and \t \n \v \f \r.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of uint64 values (a bijection)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def salted(x: np.ndarray, salt: int) -> np.ndarray:
    """An independent hash for each salt."""
    return mix(x ^ U64((salt * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) & (2**64 - 1)))


#: A random value for each byte.
BYTE_VALUE = salted(np.arange(256, dtype=np.uint64), 77)


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64; the table grows as longer buffers come."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = max(1 << 16, 1 << int(n).bit_length())
        have = np.full(size + 1, base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``span_hash`` takes the hash of any span."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _power(_BASE, len(values))[: len(values)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for arrays of starts and ends."""
    return mix((sums[end] - sums[start]) * _power(_INV, len(sums))[start])


def run_hash(sums: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k values, by start."""
    n = len(sums) - k
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    return mix((sums[k:] - sums[:n]) * _power(_INV, len(sums))[:n])


def buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of whole rows of about
    ``max_bytes`` text, so that working memory follows the slice and not the
    batch.  One longer text makes a slice of its own."""
    raw, off = buffers(batch.column(batch.schema.get_field_index(column)))
    n, a = len(off) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + max_bytes, side="right")) - 1)
        yield a, b, raw[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, word offsets by row) of runs of non-space bytes."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    space = IS_SPACE[raw]
    edge = np.empty(n + 1, dtype=bool)
    edge[0] = edge[n] = True
    edge[1:n] = space[:-1]
    edge[off] = True
    start = np.flatnonzero(~space & edge[:n])
    edge[1:n] = space[1:]
    edge[off] = True
    end = np.flatnonzero(~space & edge[1:]) + 1
    return start, end, np.searchsorted(start, off)


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return span_hash(prefix(BYTE_VALUE[raw]), start, end)


def row_of(offsets: np.ndarray) -> np.ndarray:
    """The row of each element, for offsets by row."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def whole_runs(offsets: np.ndarray, k: int) -> np.ndarray:
    """Starts of the runs of k elements that lie inside one row."""
    n = int(offsets[-1])
    if n < k:
        return np.zeros(0, np.int64)
    ends = np.repeat(offsets[1:], np.diff(offsets))[: n - k + 1]
    return np.flatnonzero(np.arange(k, n + 1) <= ends)


def ragged(lengths: np.ndarray) -> np.ndarray:
    """0..l-1 for each length, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - lengths, lengths)
