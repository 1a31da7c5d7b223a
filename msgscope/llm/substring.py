"""Substring dedup with a count-min prefilter (operator 9).

A window is ``size`` consecutive words of one document.  Words covered by a
window whose word sequence also starts earlier (smaller doc_id, or same document
and earlier start) are removed; windows are judged on the input.  A first pass
estimates how often each window's anchor occurs by merged count-min sketches
(``repeats``); a second pass compares exactly only the windows estimated to
repeat, by 64-bit hashes of the window within equal 64-bit anchors.

Null or empty texts, and texts of fewer words than a window, lose nothing.  Rows
that share doc_id and text count as one document, different texts of one id (or
of no id) as several, in the order of a hash.  Columns other than doc_id and text
are not read.  An empty table gives an empty result.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgscope.llm import repeats as rp
from msgscope.llm import textbuf as tb

SIZE = 20
GRAM = 8
SLICE = 1 << 20
ANCHORS_A_SEGMENT = 50_000

RUNS = pa.schema([("seg", pa.int32()), ("gram", pa.binary()), ("doc", pa.binary()), ("key", pa.binary()), ("pos", pa.binary()), ("n", pa.binary()), ("hash", pa.binary()), ("known_doc", pa.binary()), ("known_key", pa.binary()), ("known_pos", pa.binary()), ("known_n", pa.binary())])
RUNS_SQL = "seg int, gram binary, doc binary, key binary, pos binary, n binary, hash binary, known_doc binary, known_key binary, known_pos binary, known_n binary"
SPANS = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])


def runs(*same: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first index, length) of runs in which ``same`` arrays are equal and
    ``step`` grows by one."""
    n = len(step)
    new = np.ones(n, dtype=bool)
    if n > 1:
        new[1:] = np.any([x[1:] != x[:-1] for x in same], axis=0) | (step[1:] != step[:-1] + 1)
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, n))


def removed_windows(docs: DataFrame, anchors: DataFrame, size: int = SIZE, gram: int = GRAM, segments: int = rp.SEGMENTS) -> DataFrame:
    """(doc_id, key, start, n): runs of windows that also start earlier."""

    def ship_runs(batches):
        held, n = [], 0

        def ship():
            g, h, doc, key, pos = (np.concatenate(x) for x in zip(*held))
            doc, ids, keys = rp.numbered(doc, key)
            late = rp.later(h, g, doc, pos)
            first, length = runs(g, doc, late, step=pos)
            own, known = first[~late[first]], first[late[first]]
            own_n, known_n = length[~late[first]], length[late[first]]
            to = dict(rp.by_segment(rp.segment_of(g[own], segments), segments))
            spread = rp.spread_of(ids[doc[known]], keys[doc[known]], pos[known], 256, segments)
            known_by = dict(rp.by_segment(spread, segments))
            none = np.zeros(0, np.int64)
            for s in to.keys() | known_by.keys():
                i, j = to.get(s, none), known_by.get(s, none)
                every = np.repeat(own[i], own_n[i]) + tb.ragged(own_n[i])
                cols = ((g[own[i]], "<u8"), (ids[doc[own[i]]], "<i8"), (keys[doc[own[i]]], "<i8"), (pos[own[i]], "<i4"), (own_n[i], "<i4"), (h[every], "<u8"), (ids[doc[known[j]]], "<i8"), (keys[doc[known[j]]], "<i8"), (pos[known[j]], "<i4"), (known_n[j], "<i4"))
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), *(pa.array([rp.binary(x, t)], pa.binary()) for x, t in cols)], schema=RUNS)

        for b in batches:
            ids, keys = (b.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            lists = b.column(3)
            for a, z, raw, off in tb.slices(b, "text", SLICE):
                values, by_row, grams, starts, at = rp.flagged_windows(raw, off, rp.list_slice(lists, a, z), rp.word_units, size, gram)
                if not len(starts):
                    continue
                row = np.searchsorted(by_row, starts, side="right") - 1
                held.append((grams[at], tb.run_hash(tb.prefix(tb.salted(values, 9)), size)[starts], ids[a + row], keys[a + row], starts - by_row[row]))
                n += len(starts)
                if n >= rp.HOLD:
                    yield from ship()
                    held, n = [], 0
        if held:
            yield from ship()

    def compare(table: pa.Table) -> pa.Table:
        n = rp.joined(table["n"], "<i4").astype(np.int64)
        doc, ids, keys = rp.numbered(rp.joined(table["doc"], "<i8"), rp.joined(table["key"], "<i8"))
        g, doc = np.repeat(rp.joined(table["gram"], "<u8"), n), np.repeat(doc, n)
        pos = np.repeat(rp.joined(table["pos"], "<i4").astype(np.int64), n) + tb.ragged(n)
        late = rp.later(rp.joined(table["hash"], "<u8"), g, doc, pos)
        doc, pos = doc[late], pos[late]
        first, length = runs(doc, step=pos)
        return pa.table(
            [
                pa.array(np.concatenate([ids[doc[first]], rp.joined(table["known_doc"], "<i8")]), pa.int64()),
                pa.array(np.concatenate([keys[doc[first]], rp.joined(table["known_key"], "<i8")]), pa.int64()),
                pa.array(np.concatenate([pos[first], rp.joined(table["known_pos"], "<i4")]), pa.int32()),
                pa.array(np.concatenate([length, rp.joined(table["known_n"], "<i4")]), pa.int32()),
            ],
            schema=SPANS,
        )

    return docs.join(anchors, ["doc_id", "key"]).select("doc_id", "key", "text", "anchors").mapInArrow(ship_runs, RUNS_SQL).groupBy("seg").applyInArrow(compare, "doc_id long, key long, start int, n int")


def dedup_windows(docs: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, kept: remaining words joined by one space)."""
    docs = rp.row_keyed(docs)
    anchors = rp.stored_anchors(docs, rp.word_units, size, gram, SLICE)
    flagged = anchors.agg(F.sum(F.size("anchors"))).collect()[0][0] or 0
    segments = max(rp.SEGMENTS, flagged // ANCHORS_A_SEGMENT)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def finish(batches):
        for b in batches:
            spans = b.column(2)
            for a, z, raw, off in tb.slices(b, "text", SLICE):
                start, end, by_row = tb.words(raw, off)
                gone = rp.removed_mask(len(start), by_row, spans, a, z, size)
                total = np.concatenate([[0], np.cumsum(gone)])[by_row]
                # bytes of kept words, each with a space behind it
                keep = np.flatnonzero(~gone)
                length = end[keep] - start[keep] + 1
                flat = np.repeat(start[keep], length) + tb.ragged(length)
                out = np.append(raw, np.uint8(32))[flat] if len(flat) else np.zeros(0, np.uint8)
                ends = np.cumsum(length)
                if len(ends):
                    out[ends - 1] = 32
                edge = np.concatenate([[0], ends])[np.searchsorted(keep, by_row)]
                data = out.tobytes()
                kept = [data[x : max(x, y - 1)].decode("utf-8") for x, y in zip(edge[:-1], edge[1:])]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(a, z - a), pa.array(np.diff(by_row), pa.int64()), pa.array(np.diff(total), pa.int64()), pa.array(kept, pa.string())], schema=schema
                )

    removed = removed_windows(docs, anchors, size, gram, segments)
    return (
        rp.with_spans(docs, removed).select("doc_id", "text", "spans").mapInArrow(finish, "doc_id long, n_words long, n_removed long, kept string")
        .withColumn("doc_id", rp.real_id(F.col("doc_id")))
    )


def window_digest(docs: DataFrame, size: int = SIZE) -> DataFrame:
    return dedup_windows(docs, size).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def digest_sql(size: int = SIZE) -> str:
    """The same over table ``documents`` (distinct doc_ids) for DuckDB."""
    return rf"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
v AS (SELECT doc_id, w, unnest(range(1, len(w) - {size - 2})) AS i FROM t WHERE len(w) >= {size}),
k AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + {size - 1}), ' ') AS k FROM v),
g AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM k) WHERE r > 1),
u AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM t),
c AS (SELECT u.doc_id, u.word, u.p, coalesce(u.p - g.i < {size}, false) AS gone FROM u ASOF LEFT JOIN g ON u.doc_id = g.doc_id AND u.p >= g.i),
a AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT t.doc_id, len(t.w)::BIGINT AS n_words, coalesce(a.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(a.kept, '')) AS kept_sha256
FROM t LEFT JOIN a ON t.doc_id = a.doc_id"""
