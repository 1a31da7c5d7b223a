"""Quality scores learned by Bradley-Terry pairwise ranking (operator 5).

A document's strength is a weighted sum of features of its whole text; a pair of
a preferred (label 1) and another (label 0) document contributes the logistic
loss of the difference of their features.  The threshold is a quantile of the
strengths of the labelled rows, at the share of label 0, and the score is the
logistic function of the strength above it: 0.5 or more means label 1.

The fit sees at most ``MAX_LABELS`` rows of each label, those with the least hash
of their doc_id; features of all other rows are computed where the rows lie.
Features are counts of character classes, of neighbouring classes, of words, and
of repeated words, lines and windows.  labels, lang, source and doc_id are never
inputs of a score.

Null text counts as empty and gets a score too; repeated rows get equal scores;
doc_ids whose labels contradict each other or are null teach nothing; without
labelled rows of both kinds every score is 0.5.  An empty table gives an empty
result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from msgscope.llm import textbuf as tb

MAX_LABELS = 8_000
PAIRS = 100_000
STEPS = 400
RATE = 0.05
RIDGE = 1e-3
WINDOW = 8
#: Bytes of text whose features are worked out at once.
SLICE = 1 << 18

# ------------------------------------------------------------------- features


def _classes() -> np.ndarray:
    """A class for each byte: letters by case, digits, white space, lead and
    further bytes of other characters, and punctuation by kind."""
    c = np.full(256, 15, np.int64)
    for k, chars in enumerate([b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\x0b\x0c", b"\n\r", b".", b",;:", b"!?", b"'\"()-", b"|", b"#*", b"$%&", b"<>"]):
        c[list(chars)] = k
    c[0x80:0xC0], c[0xC0:] = 13, 14
    return c


CLASS = _classes()
N_CLASSES = 16
N_EXTRA = 10
N_FEATURES = N_CLASSES * N_CLASSES + N_CLASSES + N_EXTRA


def _repeated(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """By row, how many values equal an earlier one of that row."""
    order = np.lexsort((values, row))
    v, r = values[order], row[order]
    return np.bincount(r[1:][(v[1:] == v[:-1]) & (r[1:] == r[:-1])], minlength=n).astype(float)


def _lines(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the lines of all rows; empty ones too."""
    breaks = np.flatnonzero(raw == 10)
    ends = np.concatenate([breaks, off[1:]])
    row = np.concatenate([np.searchsorted(off, breaks, side="right") - 1, np.arange(len(off) - 1)])
    order = np.lexsort((ends, row))
    ends, row = ends[order], row[order]
    first = np.ones(len(row), dtype=bool)
    first[1:] = row[1:] != row[:-1]
    starts = np.where(first, off[row], np.append(0, ends[:-1] + 1))
    return tb.span_hash(tb.prefix(tb.BYTE_VALUE[raw]), starts, ends), row


def features(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of N_FEATURES for each text of a slice."""
    n = len(off) - 1
    out = np.zeros((n, N_FEATURES), np.float32)
    length = np.diff(off)
    if not len(raw):
        return out
    c = CLASS[raw]
    row = np.repeat(np.arange(n), length)
    one = np.bincount(row * N_CLASSES + c, minlength=n * N_CLASSES).reshape(n, -1)
    inner = row[1:] == row[:-1]
    two = np.bincount((row[:-1] * N_CLASSES**2 + c[:-1] * N_CLASSES + c[1:])[inner], minlength=n * N_CLASSES**2).reshape(n, -1)
    size = np.maximum(length, 1)[:, None]
    start, end, by_row = tb.words(raw, off)
    words = np.diff(by_row)
    h = tb.word_hashes(raw, start, end)
    word_row = tb.row_of(by_row)
    at = tb.whole_runs(by_row, WINDOW)
    windows = tb.run_hash(tb.prefix(h), WINDOW)[at] if len(at) else np.zeros(0, np.uint64)
    in_row = np.searchsorted(by_row, at, side="right") - 1
    line, line_row = _lines(raw, off)
    lines = np.bincount(line_row, minlength=n)
    share = lambda a, b: a / np.maximum(b, 1)
    again = share(_repeated(windows, in_row, n), np.maximum(words - WINDOW + 1, 0))
    extra = [
        np.log1p(words), np.minimum(words, 20) / 20, np.minimum(words, 50) / 50, share(end_sum(end - start, by_row), words) / 8,
        share(_repeated(h, word_row, n), words), again, np.sqrt(again), share(_repeated(line, line_row, n), lines),
        np.log1p(lines), np.log1p(share(words, lines)),
    ]
    out[:, : N_CLASSES**2] = np.sqrt(two / size)
    out[:, N_CLASSES**2 : N_CLASSES**2 + N_CLASSES] = one / size
    out[:, -N_EXTRA:] = np.stack(extra, axis=1)
    out[length == 0] = 0
    return out


def end_sum(values: np.ndarray, by_row: np.ndarray) -> np.ndarray:
    """Sum of the values of each row."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[by_row])


def _batch_features(batch: pa.RecordBatch):
    for a, z, raw, off in tb.slices(batch, "text", SLICE):
        yield a, z, features(raw, off)


# ------------------------------------------------------------------ the model


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    threshold: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.strength(x) - self.threshold, -30, 30)))


def fit_pairs(good: np.ndarray, bad: np.ndarray, share_bad: float, seed: int = 7) -> Model:
    """Bradley-Terry weights by Adam on fresh random pairs in each step."""
    every = np.concatenate([good, bad]).astype(np.float64)
    mean, scale = every.mean(axis=0), every.std(axis=0) + 1e-2
    model = Model(mean, scale, np.zeros(every.shape[1]), 0.0)
    g, b = (np.clip((x - mean) / scale, -8, 8) for x in (good, bad))
    rng = np.random.default_rng(seed)
    w = model.weight
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, STEPS + 1):
        i, j = rng.integers(len(g), size=PAIRS), rng.integers(len(b), size=PAIRS)
        miss = 1 / (1 + np.exp(np.clip((g @ w)[i] - (b @ w)[j], -30, 30)))
        by_g, by_b = np.bincount(i, miss, len(g)), np.bincount(j, miss, len(b))
        grad = (by_b @ b - by_g @ g) / PAIRS + RIDGE * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    s = np.concatenate([g @ w, b @ w])
    weight = np.concatenate([np.full(len(g), (1 - share_bad) / len(g)), np.full(len(b), share_bad / len(b))])
    order = np.argsort(s)
    below = np.cumsum(weight[order])
    k = int(np.searchsorted(below, share_bad - 1e-12))
    model.threshold = float((s[order[k]] + s[order[min(k + 1, len(s) - 1)]]) / 2)
    return model


def bucket(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null doc_id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def train(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> Model | None:
    """The model, or None without labelled rows of both kinds."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (bucket(F.col("doc_id"), 3) != 1))
        .groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").alias("y"), F.max("quality").alias("z"))
        .where("y = z").select("id", "y")
    )
    some = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(max_labels) for y in (0, 1)]
    share = known.agg(F.avg(1 - F.col("y"))).collect()[0][0]
    sample = some[0].unionByName(some[1])  # at most 2 * max_labels rows
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "id")
    schema = pa.schema([("id", pa.int64()), ("y", pa.int32()), ("x", pa.binary())])

    def run(batches):
        for b in batches:
            for a, z, x in _batch_features(b):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), b.column(1).slice(a, z - a).cast(pa.int32()), pa.array([r.tobytes() for r in x], pa.binary())], schema=schema)

    got = texts.select("id", "y", "text").mapInArrow(run, "id long, y int, x binary")
    # rows that share a doc_id count once, so the number of rows stays bounded
    rows = got.groupBy("id").agg(F.min_by(F.struct("y", "x"), "x").alias("r")).select("id", "r.*").collect()
    rows.sort(key=lambda r: r["id"])
    side = [np.array([np.frombuffer(r["x"], np.float32) for r in rows if r["y"] == y]) for y in (0, 1)]
    if not len(side[0]) or not len(side[1]):
        return None
    return fit_pairs(side[1], side[0], share)


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score) of every row of (doc_id, text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for b in batches:
            for a, z, x in _batch_features(b):
                s = model.score(x) if model else np.full(z - a, 0.5)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), pa.array(s, pa.float64())], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return scored(docs, train(docs, labels)).select(
        "doc_id", (bucket(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, unchanged, whose score is 0.5 or more."""
    model = train(docs, labels)
    if model is None:
        return docs

    def run(batches):
        for b in batches:
            for a, z, x in _batch_features(b):
                yield b.slice(a, z - a).filter(pa.array(model.score(x) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
