"""Repeated windows of a corpus: the steps that both substring operators share.

Text is a row of units (words or bytes).  A window is ``size`` consecutive units
of one document, and its *anchor* is the leftmost of its ``gram``-unit runs with
the least hash.  Equal windows have equal anchors at equal offsets, so windows
can be dealt to tasks by their anchor, and a window can repeat only if its anchor
does.  Neighbouring windows share anchors: there are about
``2 / (size - gram + 2)`` of them a unit.

1. ``repeated_anchors``: a count-min sketch over the anchors of all windows.
   Each task ships its own sketch sparsely (the cells it touched, dealt by cell
   range); the merged sketch of a range is summed in one task of bounded size.
   The estimate is never too low, so no repeated window is lost.
2. ``anchor_windows``: in the documents that have repeated anchors, the runs of
   windows behind them, for the operator to compare exactly.
3. ``with_spans``: what the comparison removes, gathered by document and joined
   to the texts.

What is shipped twice by one task is shipped once with its first start; the rest
is known to repeat.  So a passage held by a third of all rows costs a group one
entry a task, not one a row.  A document is a doc_id and a text (by a 64-bit hash,
``key``), in this order: rows that repeat both are the same document, different
texts are different ones, whatever their ids, and a null doc_id sorts before all
others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from msgscope.llm import textbuf as tb
from msgscope.llm.spill import stored

#: Anchors a task holds before it ships them.
HOLD = 1 << 19
#: Text bytes behind one cell range; at least SEGMENTS ranges are used.
SEGMENT_BYTES = 8 << 20
SEGMENTS = 128
NO_ID = -(1 << 63)

Units = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def word_units(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start, end, by_row = tb.words(raw, off)
    return tb.word_hashes(raw, start, end), by_row


def byte_units(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return tb.BYTE_VALUE[raw], off


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id never null, text)."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("string").alias("text")
    )


def row_keyed(docs: DataFrame) -> DataFrame:
    """(doc_id never null, key: hash of the text, text)."""
    return keyed(docs).select("doc_id", F.xxhash64("text").alias("key"), "text")


def numbered(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of each row in the order of (doc, key), doc and key of each number)."""
    order = np.lexsort((key, doc))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (doc[order[1:]] != doc[order[:-1]]) | (key[order[1:]] != key[order[:-1]])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, doc[order[new]], key[order[new]]


def real_id(c: Column) -> Column:
    return F.when(c != NO_ID, c)


def least_positions(h: np.ndarray, span: int) -> np.ndarray:
    """Position of the leftmost least of h[i : i + span], for each i."""
    value, at, width = h, np.arange(len(h), dtype=np.int32), 1

    def join(shift: int):
        a, b = value[: len(value) - shift], value[shift:]
        right = b < a
        return np.where(right, b, a), np.where(right, at[shift:], at[: len(a)])

    if len(h) < span:
        return np.zeros(0, np.int32)
    while 2 * width <= span:
        value, at = join(width)
        width *= 2
    return join(span - width)[1] if width < span else at


def window_anchors(values: np.ndarray, offsets: np.ndarray, size: int, gram: int):
    """(gram hashes, window starts, their anchors) of a slice's whole windows."""
    grams = tb.run_hash(tb.prefix(values), gram)
    starts = tb.whole_runs(offsets, size)
    if not len(starts):
        return grams, starts, starts
    return grams, starts, least_positions(grams, size - gram + 1)[starts]


def segment_of(h: np.ndarray, segments: int) -> np.ndarray:
    return (tb.salted(h, 5) % np.uint64(segments)).astype(np.int64)


def segment_count(docs: DataFrame) -> int:
    n = docs.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    return max(SEGMENTS, int(n) // SEGMENT_BYTES)


def spread_of(doc: np.ndarray, key: np.ndarray, pos: np.ndarray, width: int, segments: int) -> np.ndarray:
    """A segment for each stretch of ``width`` positions of a document."""
    return segment_of(tb.salted(doc.astype(np.uint64) ^ key.astype(np.uint64), 3) + pos.astype(np.uint64) // np.uint64(width), segments)


def by_segment(segment: np.ndarray, segments: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(segment, kind="stable")
    edge = np.searchsorted(segment[order], np.arange(segments + 1))
    for s in range(segments):
        if edge[s] < edge[s + 1]:
            yield s, order[edge[s] : edge[s + 1]]


def first_of_equal(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by the keys, and in that order whether the *first two less the rest*
    begin a new value: keys are (value keys..., doc, pos); see ``later``."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), dtype=bool)
    if len(order) > 1:
        new[1:] = np.any([k[order[1:]] != k[order[:-1]] for k in keys[:-2]], axis=0)
    return order, new


def later(*keys: np.ndarray) -> np.ndarray:
    """For keys (value keys..., doc, pos): whether an equal value has an earlier
    (doc, pos).  The same (doc, pos) twice (repeated rows) is one start.  ``doc`` is
    a number by ``numbered``."""
    order, new = first_of_equal(*keys)
    doc, pos = keys[-2][order], keys[-1][order]
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    out = np.zeros(len(order), dtype=bool)
    out[order] = (doc != doc[head]) | (pos != pos[head])
    return out


def binary(x: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(x).astype(kind, copy=False).tobytes()


def joined(column, kind: str) -> np.ndarray:
    parts = [np.frombuffer(x, kind) for x in column.to_pylist() if x]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


ANCHORS = pa.schema([("seg", pa.int32()), ("cell", pa.binary()), ("doc", pa.binary()), ("key", pa.binary()), ("pos", pa.binary()), ("known_doc", pa.binary()), ("known_key", pa.binary()), ("known_pos", pa.binary())])
ANCHORS_SQL = "seg int, cell binary, doc binary, key binary, pos binary, known_doc binary, known_key binary, known_pos binary"
FLAGGED = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("pos", pa.int32())])


def repeated_anchors(docs: DataFrame, units: Units, size: int, gram: int, slice_bytes: int) -> DataFrame:
    """(doc_id, key, anchors: positions whose gram is estimated to occur twice or more)."""
    segments = segment_count(docs)

    def sketch(batches):
        held, n = [], 0

        def ship():
            h, doc, key, pos = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(h, kind="stable")
            same = np.zeros(len(h), dtype=bool)
            same[1:] = h[order[1:]] == h[order[:-1]]
            twice = same.copy()
            twice[:-1] |= same[1:]
            first, known = order[~same], order[twice]
            to = segment_of(h[first], segments)
            spread = spread_of(doc[known], key[known], pos[known], 64, segments)
            known_by = dict(by_segment(spread, segments))
            none = np.zeros(0, np.int64)
            rows = dict(by_segment(to, segments))
            for s in rows.keys() | known_by.keys():
                i, j = first[np.sort(rows.get(s, none))], known[known_by.get(s, none)]
                i = np.sort(i)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s], pa.int32()), *(pa.array([binary(x, t)], pa.binary()) for x, t in ((h[i], "<u8"), (doc[i], "<i8"), (key[i], "<i8"), (pos[i], "<i4"), (doc[j], "<i8"), (key[j], "<i8"), (pos[j], "<i4")))],
                    schema=ANCHORS,
                )

        for b in batches:
            ids, keys = (b.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            for a, _, raw, off in tb.slices(b, "text", slice_bytes):
                values, by_row = units(raw, off)
                grams, _, at = window_anchors(values, by_row, size, gram)
                if not len(at):
                    continue
                at = at[np.concatenate([[True], at[1:] != at[:-1]])].astype(np.int64)
                row = np.searchsorted(by_row, at, side="right") - 1
                held.append((grams[at], ids[a + row], keys[a + row], (at - by_row[row]).astype(np.int32)))
                n += len(at)
                if n >= HOLD:
                    yield from ship()
                    held, n = [], 0
        if held:
            yield from ship()

    def merge(table: pa.Table) -> pa.Table:
        h, doc, key, pos = (joined(table[c], t) for c, t in (("cell", "<u8"), ("doc", "<i8"), ("key", "<i8"), ("pos", "<i4")))
        least = None
        width = np.uint64(1 << max(10, int(4 * len(h)).bit_length()))
        for row in range(2):  # the rows of the merged sketch of this range
            cell = (tb.salted(h, 11 + row) % width).astype(np.int64)
            count = np.bincount(cell)[cell] if len(cell) else cell
            least = count if least is None else np.minimum(least, count)
        twice = least >= 2
        return pa.table(
            [
                pa.array(np.concatenate([doc[twice], joined(table["known_doc"], "<i8")]), pa.int64()),
                pa.array(np.concatenate([key[twice], joined(table["known_key"], "<i8")]), pa.int64()),
                pa.array(np.concatenate([pos[twice], joined(table["known_pos"], "<i4")]), pa.int32()),
            ],
            schema=FLAGGED,
        )

    found = docs.mapInArrow(sketch, ANCHORS_SQL).groupBy("seg").applyInArrow(merge, "doc_id long, key long, pos int")
    return found.groupBy("doc_id", "key").agg(F.collect_set("pos").alias("anchors"))


def flagged_windows(raw, off, anchors, units: Units, size: int, gram: int):
    """For one slice: (unit values, offsets by row, grams, window starts, anchors)
    of the windows whose anchor is in the row's list."""
    values, by_row = units(raw, off)
    grams, starts, at = window_anchors(values, by_row, size, gram)
    if len(starts):
        mark = np.zeros(len(grams) + 1, dtype=bool)
        flat, edges = anchors
        place = np.repeat(by_row[:-1], np.diff(edges)) + flat
        mark[place[place < np.repeat(by_row[1:], np.diff(edges))]] = True  # see removed_mask
        keep = mark[at]
        starts, at = starts[keep], at[keep].astype(np.int64)
    return values, by_row, grams, starts, at


def list_slice(column: pa.Array, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of rows a to b of a list column."""
    part = column.slice(a, b - a)
    offsets = part.offsets.to_numpy().astype(np.int64)
    return part.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]


def with_spans(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """docs with ``spans``: array of (start, n) windows removed, null if none.
    ``removed`` is (doc_id, key, start, n) for runs of window starts."""
    spans = removed.groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", "n")).alias("spans"))
    return docs.join(spans, ["doc_id", "key"], "left")


def removed_mask(n: int, by_row: np.ndarray, spans: pa.Array, a: int, b: int, size: int) -> np.ndarray:
    """Units of a slice that the removed windows of its rows cover."""
    part = spans.slice(a, b - a)
    offsets = part.offsets.to_numpy().astype(np.int64)
    own = part.values.slice(offsets[0], offsets[-1] - offsets[0])
    counts = np.diff(offsets)
    if part.null_count:
        counts = np.where(part.is_valid().to_numpy(zero_copy_only=False), counts, 0)
    change = np.zeros(n + 1, np.int64)
    if len(own):
        start = own.field(0).to_numpy(zero_copy_only=False).astype(np.int64)
        length = own.field(1).to_numpy(zero_copy_only=False).astype(np.int64)
        base = np.repeat(by_row[:-1], counts)
        end = np.minimum(base + start + length - 1 + size, np.repeat(by_row[1:], counts))
        ok = base + start < end  # texts of one id whose hashes are equal by chance may differ in length
        np.add.at(change, (base + start)[ok], 1)
        np.add.at(change, end[ok], -1)
    return np.cumsum(change[:-1]) > 0


def stored_anchors(docs: DataFrame, units: Units, size: int, gram: int, slice_bytes: int) -> DataFrame:
    return stored(repeated_anchors(docs, units, size, gram, slice_bytes), "anchors")
