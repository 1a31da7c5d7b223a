"""Failed-login lockout per identifier (STR-02).

Rules (fixed values in :mod:`msgscope.functions.patterns`): each failure
increments ``attempts``; reaching 3 locks the identifier for 30 s after that
failure.  While locked an event is rejected and not counted.  The first
event at or after the lock's end resets the state to 0 before it is
processed.  A success clears the state.

One pure transition function drives both forms:

* ``lockout_stream`` - Structured Streaming, ``applyInPandasWithState``
  keyed by identifier; state is two numbers per key, kept in the
  checkpointed state store while there are open failures or a lock, and each
  call only sees the key's rows of one micro-batch (bounded by the source's
  per-trigger limit).  A success and the end of a lock remove it.
* ``lockout_batch`` - the same function over a table, cut into chunks of an
  identifier and a time span, so that no identifier lies in one task.  A chunk
  is first summed up as a function: the state it ends in for each state it may
  begin in (0, 1 or 2 failures, or a lock that ends at some time).  The short
  row of an identifier's summaries is then composed in order, and each chunk is
  folded from the state it really begins in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from msgscope.functions import patterns as P

OUT_SCHEMA = "event_id long, identifier long, decision string, attempts int, lockout_until_us long"
STATE_SCHEMA = "attempts int, lockout_until_us long"


def transitions(ts: np.ndarray, ok: np.ndarray, attempts: int = 0, lock_us: int | None = None):
    """(decisions, counts, lock ends, 0 for none) of one key's events in order,
    and the final state."""
    decisions, counts, locks = [], [], []
    span = P.LOCKOUT_SECONDS * 1_000_000
    for at, success in zip(ts.tolist(), ok.tolist()):
        if lock_us is not None and at < lock_us:
            decisions.append("locked")
        else:
            if lock_us is not None:  # expired: reset before processing
                attempts, lock_us = 0, None
            if success:
                attempts, lock_us = 0, None
                decisions.append("ok")
            else:
                attempts += 1
                if attempts >= P.LOCKOUT_ATTEMPTS:
                    lock_us = at + span
                decisions.append("failed")
        counts.append(attempts)
        locks.append(lock_us or 0)
    return decisions, counts, locks, attempts, lock_us


def fold(pdf: pd.DataFrame, attempts: int = 0, lock_us: int | None = None) -> tuple[pd.DataFrame, int, int | None]:
    """Apply the transition to one key's events (any order); returns the
    decisions and the final state."""
    pdf = pdf.sort_values(["ts_us", "event_id"], kind="mergesort")
    decisions, counts, locks, attempts, lock_us = transitions(pdf["ts_us"].to_numpy(np.int64), pdf["success"].to_numpy(bool), attempts, lock_us)
    out = pd.DataFrame(
        {
            "event_id": pdf["event_id"].astype("int64").to_numpy(),
            "identifier": pdf["identifier"].astype("int64").to_numpy(),
            "decision": decisions,
            "attempts": pd.Series(counts, dtype="int32").to_numpy(),
            "lockout_until_us": pd.Series(locks, dtype="int64").to_numpy(),
        }
    )
    return out, attempts, lock_us


def _prepare(events: DataFrame) -> DataFrame:
    """Expects ``event_id, identifier, ts (timestamp), success (bool)``."""
    if dict(events.dtypes)["ts"] == "timestamp_ntz":
        # wall-clock timestamps: micros since the NTZ epoch, independent of the session time zone
        ts_us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    else:
        ts_us = F.unix_micros("ts")
    return events.select("event_id", "identifier", ts_us.alias("ts_us"), "success")


#: Time span of a chunk.  A lock must not outlast it.
CHUNK_US = 24 * 3_600_000_000
SPAN_US = P.LOCKOUT_SECONDS * 1_000_000
#: Rows that a task gathers before it hands them on.
ROWS_OUT = 8_192
SUMMARY = pa.schema([("identifier", pa.int64()), ("chunk", pa.int64()), ("exits", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("after", pa.list_(pa.int64()))])
SUMMARY_SCHEMA = "identifier long, chunk long, exits array<long>, starts array<long>, after array<long>"
ENTRY_SCHEMA = "identifier long, chunk long, entry_attempts int, entry_lock_us long"
OUT = pa.schema([("event_id", pa.int64()), ("identifier", pa.int64()), ("decision", pa.string()), ("attempts", pa.int32()), ("lockout_until_us", pa.int64())])


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[pa.Array]]:
    """The columns of each run of rows that agree in the first ``keys`` columns,
    from batches sorted by them."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b] if held is None else [*held.to_batches(), b]).combine_chunks()
        if not len(t):
            continue
        new = np.zeros(len(t), dtype=bool)
        for c in t.columns[:keys]:
            v = c.to_numpy()
            new[1:] |= v[1:] != v[:-1]
        edges = [0, *np.flatnonzero(new).tolist()]
        columns = [c.combine_chunks() for c in t.columns]
        for x, y in zip(edges[:-1], edges[1:]):
            yield [c.slice(x, y - x) for c in columns]
        held = t.slice(edges[-1])
    if held is not None:
        yield [c.combine_chunks() for c in held.combine_chunks().columns]


def _summary(ts: np.ndarray, ok: np.ndarray, begin: int) -> tuple[list[int], list[int], list[int]]:
    """What a chunk makes of each state it may begin in.

    A state is a number: 0, 1 or 2 failures, or the end of a lock.  ``exits`` are
    the states after the chunk for 0, 1 and 2; a lock that ends within it leads to
    state 0 at the first event from then on, so ``after`` holds the state after
    the chunk for state 0 at each event (``starts``) at which such a lock can end."""
    n, top = len(ts), P.LOCKOUT_ATTEMPTS
    free = np.searchsorted(ts, ts + SPAN_US).tolist()  # the first event from the end of a lock set here
    ends = [list(range(top))] * (n + 1)
    for i in range(n - 1, -1, -1):
        then = ends[i + 1]
        if ok[i]:
            ends[i] = [then[0]] * top
        else:
            ends[i] = [*then[1:], ends[free[i]][0] if free[i] < n else int(ts[i]) + SPAN_US]
    # a lock from before ends SPAN_US after the chunk's begin at the latest
    reach = min(n, int(np.searchsorted(ts, begin + SPAN_US, side="right")) + 1)
    return ends[0], ts[:reach].tolist(), [e[0] for e in ends[:reach]]


def _entries(pdf: pd.DataFrame) -> pd.DataFrame:
    """The state in which each of an identifier's chunks begins."""
    pdf = pdf.sort_values("chunk")
    state, out = 0, []
    for identifier, chunk, exits, starts, after in pdf[["identifier", "chunk", "exits", "starts", "after"]].itertuples(index=False):
        if state < P.LOCKOUT_ATTEMPTS:
            out.append((identifier, chunk, state, 0))
            state = int(exits[state])
            continue
        out.append((identifier, chunk, P.LOCKOUT_ATTEMPTS, state))
        at = int(np.searchsorted(np.asarray(starts, np.int64), state))
        if at < len(after):  # else the chunk ends before the lock does
            state = int(after[at])
    return pd.DataFrame(out, columns=["identifier", "chunk", "entry_attempts", "entry_lock_us"])


def lockout_batch(events: DataFrame, chunk_us: int = CHUNK_US) -> DataFrame:
    def summed(batches):
        rows = []
        for identifier, chunk, ts, _, ok in _groups(batches, 2):
            at = chunk[0].as_py()
            rows.append((identifier[0].as_py(), at, *_summary(ts.to_numpy(), ok.to_numpy(zero_copy_only=False), at * chunk_us)))
            if len(rows) >= ROWS_OUT:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), SUMMARY)], schema=SUMMARY)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), SUMMARY)], schema=SUMMARY)

    def decided(batches):
        columns: list[list] = [[] for _ in OUT]
        for identifier, _, ts, event, ok, attempts, lock in _groups(batches, 2):
            d, n, until, _, _ = transitions(ts.to_numpy(), ok.to_numpy(zero_copy_only=False), attempts[0].as_py(), lock[0].as_py() or None)
            for held, new in zip(columns, (event.to_pylist(), identifier.to_pylist(), d, n, until)):
                held.extend(new)
            if len(columns[0]) >= ROWS_OUT:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, OUT)], schema=OUT)
                columns = [[] for _ in OUT]
        if columns[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, OUT)], schema=OUT)

    ev = _prepare(events).withColumn("chunk", F.floor(F.col("ts_us") / chunk_us).cast("long"))
    ev = ev.select(F.col("identifier").cast("long").alias("identifier"), "chunk", "ts_us", F.col("event_id").cast("long").alias("event_id"), "success")
    order = ["identifier", "chunk", "ts_us", "event_id"]
    sums = ev.repartition("identifier", "chunk").sortWithinPartitions(*order).mapInArrow(summed, SUMMARY_SCHEMA)
    entries = sums.groupBy("identifier").applyInPandas(lambda pdf: _entries(pdf), ENTRY_SCHEMA)
    begun = ev.join(entries, ["identifier", "chunk"]).select(*ev.columns, "entry_attempts", "entry_lock_us")
    return begun.repartition("identifier", "chunk").sortWithinPartitions(*order).mapInArrow(decided, OUT_SCHEMA)


def _stream_fn(key, pdfs: Iterator[pd.DataFrame], state):
    """A key's rows of one micro-batch, or the end of its lock.  A key without
    failures has no state; one that is locked loses it when the watermark has
    passed the lock's end, since every later event would begin anew."""
    if state.hasTimedOut:
        state.remove()
        return
    attempts, lock_us = state.get if state.exists else (0, None)
    lock_us = None if lock_us is None or pd.isna(lock_us) else int(lock_us)
    frames = [p for p in pdfs]
    if not frames:
        return
    out, attempts, lock_us = fold(pd.concat(frames, ignore_index=True), int(attempts), lock_us)
    ends_ms = None if lock_us is None else lock_us // 1000 + 1
    if attempts == 0 or (ends_ms is not None and ends_ms <= state.getCurrentWatermarkMs()):
        if state.exists:
            state.remove()
    else:
        state.update((int(attempts), lock_us))
        if ends_ms is not None:
            state.setTimeoutTimestamp(ends_ms)
    yield out


#: Events that come so much later than the latest one are dropped, as after any
#: watermark.
LATE = "7 days"


def lockout_stream(events_stream: DataFrame, late: str = LATE) -> DataFrame:
    """Streaming form: output mode append, one output row per input event.  State is
    kept for identifiers with open failures or a lock that hasn't ended only."""
    timed = _prepare(events_stream).withColumn("at", F.timestamp_micros("ts_us")).withWatermark("at", late)
    return timed.groupBy("identifier").applyInPandasWithState(_stream_fn, OUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout)
