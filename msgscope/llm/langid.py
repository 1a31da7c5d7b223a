"""Language by a byte convolutional network (operator 7).

Bytes are embedded; filters of several widths run over windows of ``WINDOW``
bytes; each filter's maximum over the window feeds a softmax.  The network is
trained in numpy on windows of labelled texts and applied to all windows of
every text, in batches: the window log-probabilities, weighted by length, add up
to the prediction of a document.

The fit sees the ``SAMPLE_DOCS`` distinct texts of each language with the least
hashes and ``DOC_WINDOWS`` windows of each; repeated rows count once.  lang,
source and doc_id are never inputs of a prediction.  Rows held out (crc32 of
doc_id mod 5 is 0) and rows with a null lang teach nothing.

Null texts and texts without a letter are ``und`` with score 0, and so is every
text if there is nothing to learn from.  Repeated rows get equal predictions; a
null doc_id counts as '' for the fold; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from msgscope.llm import textbuf as tb
from msgscope.llm.quality import bucket

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
DIM = 8
SAMPLE_DOCS = 1_500
DOC_WINDOWS = 3
EPOCHS = 4
LEAST_STEPS = 200
#: The most frequent language has at most so many times a language's windows.
RARE = 8
BATCH = 64
RATE = 0.01
UNKNOWN = "und"
SPAN = max(WIDTHS)


@dataclass
class Network:
    langs: list[str]
    embed: np.ndarray  # 256 x DIM
    conv: np.ndarray  # SPAN * DIM x filters; zero outside a filter's width
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def hidden(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(inputs of the filters by position, filter outputs by position)."""
        n = len(windows)
        wide = np.zeros((n, WINDOW + SPAN), np.uint8)
        wide[:, :WINDOW] = windows
        at = self.embed[wide]
        x = np.concatenate([at[:, k : k + WINDOW] for k in range(SPAN)], axis=2)
        return x, (x.reshape(-1, SPAN * DIM) @ self.conv).reshape(n, WINDOW, -1)

    def top(self, best: np.ndarray) -> np.ndarray:
        """Log-probabilities from the filters' maxima."""
        z = np.maximum(best + self.bias, 0) @ self.out + self.out_bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def log_probs(self, windows: np.ndarray) -> np.ndarray:
        """Log-probabilities of each window; position inputs come from a table of
        embedded byte pairs."""
        if not hasattr(self, "_pairs"):
            e = self.embed
            self._pairs = np.concatenate([np.repeat(e, 256, axis=0), np.tile(e, (256, 1))], axis=1)
        best = np.empty((len(windows), self.conv.shape[1]), np.float32)
        x = np.empty((BATCH * WINDOW, SPAN * DIM), np.float32).reshape(BATCH, WINDOW, SPAN * DIM)
        wide = np.zeros((BATCH, WINDOW + SPAN), np.int32)
        for a in range(0, len(windows), BATCH):
            part = windows[a : a + BATCH]
            n = len(part)
            wide[:n, :WINDOW] = part
            code = (wide[:n, :-1] << 8) | wide[:n, 1:]
            for k in range(0, SPAN, 2):
                x[:n, :, k * DIM : (k + 2) * DIM] = self._pairs[code[:, k : k + WINDOW]]
            y = x[:n].reshape(-1, SPAN * DIM) @ self.conv
            best[a : a + n] = y.reshape(n, WINDOW, -1).max(axis=1)
        return self.top(best)


def new_network(langs: list[str], rng: np.random.Generator) -> Network:
    n = FILTERS * len(WIDTHS)
    conv = rng.normal(0, 0.3, (SPAN, DIM, n))
    for i, w in enumerate(WIDTHS):
        conv[w:, :, i * FILTERS : (i + 1) * FILTERS] = 0
    f = lambda x: x.astype(np.float32)
    return Network(langs, f(rng.normal(0, 0.5, (256, DIM))), f(conv.reshape(SPAN * DIM, n)), np.zeros(n, np.float32), f(rng.normal(0, 0.1, (n, len(langs)))), np.zeros(len(langs), np.float32))


def fit(windows: np.ndarray, y: np.ndarray, langs: list[str], seed: int = 11) -> Network:
    """Adam on mini-batches.  Only a filter's best position carries gradient."""
    rng = np.random.default_rng(seed)
    net = new_network(langs, rng)
    names = ("embed", "conv", "bias", "out", "out_bias")
    first = {k: np.zeros_like(getattr(net, k)) for k in names}
    second = {k: np.zeros_like(getattr(net, k)) for k in names}
    live = net.conv != 0
    a_round = -(-len(windows) // BATCH)
    epochs = max(EPOCHS, -(-LEAST_STEPS // a_round))  # few windows are seen more often
    steps = epochs * a_round
    t = 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for a in range(0, len(order), BATCH):
            t += 1
            rows = order[a : a + BATCH]
            part, label = windows[rows].copy(), y[rows]
            # shorter texts too
            cut = np.where(rng.random(len(rows)) < 0.35, rng.integers(8, WINDOW + 1, len(rows)), WINDOW)
            part[np.arange(WINDOW)[None, :] >= cut[:, None]] = 0
            x, h = net.hidden(part)
            n = len(part)
            at = h.argmax(axis=1)
            best = np.take_along_axis(h, at[:, None, :], axis=1)[:, 0]
            act = np.maximum(best + net.bias, 0)
            p = np.exp(net.top(best))
            p[np.arange(n), label] -= 1
            p /= n
            g = {"out": act.T @ p, "out_bias": p.sum(axis=0)}
            back = (p @ net.out.T) * (act > 0)
            g["bias"] = back.sum(axis=0)
            seen = x[np.arange(n)[:, None], at]  # n x filters x inputs
            g["conv"] = np.einsum("nf,nfi->if", back, seen) * live
            to_input = (back[:, :, None] * net.conv.T[None]).reshape(n, -1, SPAN, DIM)
            wide = np.zeros((n, WINDOW + SPAN), np.int64)
            wide[:, :WINDOW] = part
            byte = wide[np.arange(n)[:, None, None], at[:, :, None] + np.arange(SPAN)]
            g["embed"] = np.zeros_like(net.embed)
            np.add.at(g["embed"], byte.ravel(), to_input.reshape(-1, DIM))
            rate = RATE * (1 - t / (steps + 1))
            for k in names:
                first[k] = 0.9 * first[k] + 0.1 * g[k]
                second[k] = 0.99 * second[k] + 0.01 * g[k] ** 2
                step = rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-7)
                setattr(net, k, (getattr(net, k) - step).astype(np.float32))
    return net


# ------------------------------------------------------------- texts, windows


def windows_of(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, row of each, its length) that cover every text of a slice."""
    length = np.diff(off)
    count = -(-length // WINDOW)
    row = np.repeat(np.arange(len(length)), count)
    inner = tb.ragged(count) * WINDOW
    size = np.minimum(length[row] - inner, WINDOW)
    out = np.zeros((len(row), WINDOW), np.uint8)
    # a window's bytes follow each other in the buffer; the last ones end early
    flat = np.repeat(np.arange(len(row)) * WINDOW, size) + tb.ragged(size)
    out.ravel()[flat] = raw[: len(flat)]
    return out, row, size


def sample(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(lang, h, h2: hash of the text, bytes: a window): at most DOC_WINDOWS windows
    of ``sample_docs`` distinct texts of each language, from rows that may teach."""
    text = F.col("text").cast("string")
    own = docs.select(F.col("lang").cast("string").alias("lang"), F.xxhash64(F.lit(3), text).alias("h"), F.xxhash64(F.lit(4), text).alias("h2"), text.alias("text"), F.col("doc_id").alias("doc_id"))
    own = own.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (bucket(F.col("doc_id").cast("long"), 5) != 0))
    key = ["lang", "h", "h2"]
    least = Window.partitionBy("lang").orderBy("h", "h2")
    chosen = own.select(*key).distinct().withColumn("n", F.row_number().over(least)).where(F.col("n") <= sample_docs).select(*key)
    schema = pa.schema([("lang", pa.string()), ("h", pa.int64()), ("h2", pa.int64()), ("bytes", pa.binary())])

    def run(batches):
        for b in batches:
            for a, z, raw, off in tb.slices(b, "text"):
                win, row, _ = windows_of(raw, off)
                total = np.bincount(row, minlength=z - a)
                nth = tb.ragged(total)
                # DOC_WINDOWS of a document, evenly over the whole of it
                gap = np.maximum(1, total // DOC_WINDOWS)[row]
                take = np.flatnonzero((nth % gap == 0) & (nth // gap < DOC_WINDOWS))
                which = pa.array(row[take])
                told = [b.column(i).slice(a, z - a).take(which) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*told, pa.array([win[i].tobytes() for i in take], pa.binary())], schema=schema)

    got = own.join(chosen, key).select(*key, "text").mapInArrow(run, "lang string, h long, h2 long, bytes binary")
    return got.distinct()  # of copies, however many, one


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Network | None:
    """The network, or None if no row may teach."""
    got = sample(docs, sample_docs).collect()  # bounded: DOC_WINDOWS * sample_docs for each class of the model
    if not got:
        return None
    got.sort(key=lambda r: (r["lang"], r["h"], r["h2"], r["bytes"]))
    langs = sorted({r["lang"] for r in got})
    y = np.searchsorted(np.array(langs, object), np.array([r["lang"] for r in got], object))
    # a language of few texts shows them more often
    size = np.bincount(y)
    every = np.concatenate([np.resize(np.flatnonzero(y == i), max(n, size.max() // RARE)) for i, n in enumerate(size)])
    return fit(np.array([np.frombuffer(r["bytes"], np.uint8) for r in got])[every], y[every], langs)


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of (doc_id, text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        for b in batches:
            letters = np.asarray(b.column(1).to_numpy(zero_copy_only=False), dtype=bool)
            for a, z, raw, off in tb.slices(b, "text"):
                known = letters[a:z] & (net is not None)
                lang = np.full(z - a, UNKNOWN, object)
                score = np.zeros(z - a)
                if known.any():
                    win, row, size = windows_of(raw, off)
                    logs = net.log_probs(win).astype(np.float64) * size[:, None]
                    ends = np.searchsorted(row, np.arange(z - a + 1))
                    total = np.diff(np.vstack([np.zeros((1, logs.shape[1])), np.cumsum(logs, axis=0)])[ends], axis=0)
                    mean = total / np.maximum(np.diff(off), 1)[:, None]
                    p = np.exp(mean - mean.max(axis=1, keepdims=True))
                    p /= p.sum(axis=1, keepdims=True)
                    best = p.argmax(axis=1)
                    lang = np.where(known, np.array(net.langs, object)[best], UNKNOWN)
                    score = np.where(known, p[np.arange(z - a), best], 0.0)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), pa.array(lang.tolist(), pa.string()), pa.array(score, pa.float64())], schema=schema)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False)).alias("letter"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, lang_pred string, score double")


def language_digest(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    return predict(docs, train(docs)).select("doc_id", (bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")
