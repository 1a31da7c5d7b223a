"""Vectorisation in long form: TF-IDF, token vocabularies, id sequences,
standard scaling and one-hot codes (VEC-*, SEQ-*, F-60..62).

TF-IDF never builds a dense matrix: n-grams are counted from the documents' tokens
in their tasks, in slices of bounded size, and a slice's distinct terms meet in an
aggregation on ``term``.  A fitted vocabulary is small by its size parameter:
where it has ``MOST_TERMS`` rows at most, it goes to the tasks, and ids, weights
and norms are worked out inside each row, without an exchange of tokens or terms.
A larger one is joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from msgscope.functions import patterns as P
from msgscope.functions import text as T
from msgscope.session import materialize


#: A vocabulary of more rows is joined instead of sent to the tasks.
MOST_TERMS = 1 << 18


def small(table: DataFrame, columns: list[str], most: int | None = None) -> pa.Table | None:
    """The table itself, if it has ``most`` rows at most; no more are fetched."""
    most = MOST_TERMS if most is None else most
    rows = table.select(*columns).limit(most + 1).toArrow()
    return rows if rows.num_rows <= most else None


def _offsets(lists: pa.Array) -> np.ndarray:
    sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)


def _places(values: pa.Array, table: pa.Table, column: str) -> np.ndarray:
    """The row of ``table`` that holds each value, -1 for none."""
    return np.asarray(pc.fill_null(pc.index_in(values, value_set=table[column].combine_chunks()), -1))


#: Tokens of rows that a task counts together; a longer document is counted alone.
SLICE = 1 << 21


def _slices(b: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows of bounded numbers of tokens."""
    off, a = _offsets(b.column(column)), 0
    while a < b.num_rows:
        end = max(a + 1, int(np.searchsorted(off, off[a] + SLICE, side="right")) - 1)
        yield b.slice(a, end - a)
        a = end


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each slice with tokens: its rows, its distinct words, the word and the row
    of each token, and the places with another token of the row after them."""
    for b in batches:
        for s in _slices(b, 0):
            flat, off = s.column(0).flatten(), _offsets(s.column(0))
            if len(flat):
                coded = flat.dictionary_encode()
                row = np.repeat(np.arange(s.num_rows), np.diff(off))
                yield s.num_rows, coded.dictionary, np.asarray(coded.indices, np.int64), row, np.flatnonzero(row[1:] == row[:-1])


def _added(n: int, key: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys ascending, rows that hold them, places) of keys in ``n`` rows."""
    at = np.sort(key * n + row)
    key, first = at // n, np.concatenate([[True], at[1:] != at[:-1]])
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[starts], np.add.reduceat(first.astype(np.int64), starts), np.diff(np.append(starts, len(key)))


def _named(words: pa.Array, term: np.ndarray) -> pa.Array:
    """The terms of ascending keys: a word's place, or with m words m + left * m + right."""
    m = len(words)
    one, two = term[term < m], term[term >= m] - m
    pairs = pc.binary_join_element_wise(words.take(pa.array(two // m)), words.take(pa.array(two % m)), " ")
    return pa.concat_arrays([words.take(pa.array(one)), pairs])


def term_totals(docs: DataFrame, tokens_col: str) -> DataFrame:
    """(term, df, cf): documents and places of every token and bigram (a space
    apart), added up over the rows of a slice; a term comes once a slice.  Tokens
    hold no space."""

    def run(batches):
        for n, words, code, row, left in _coded(batches):
            m = len(words)
            key = np.concatenate([code, m + code[left] * m + code[left + 1]])
            term, df, cf = _added(n, key, np.concatenate([row, row[left]]))
            yield pa.RecordBatch.from_arrays([_named(words, term), pa.array(df), pa.array(cf)], names=["term", "df", "cf"])

    return docs.select(tokens_col).mapInArrow(run, "term string, df long, cf long")


#: Buckets of bigrams that are counted before the bigrams themselves, as a power of two.
BUCKET_BITS = 18


def _buckets(words: pa.Array, code: np.ndarray, left: np.ndarray, bits: int) -> np.ndarray:
    """The bucket of each bigram, the same in every task: a hash of its words."""
    h = pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False)[code]
    mixed = (h[left] * np.uint64(0x9E3779B97F4A7C15) + h[left + 1]) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


def likely_totals(
    docs: DataFrame, tokens_col: str, n_docs: int, max_features: int | None, min_df: int = 1, max_df: float = 1.0
) -> DataFrame:
    """As ``term_totals``, without terms that ``fit_tfidf_vocabulary`` can't pick with
    these parameters.  A first pass counts all words, and bigrams by bucket of a hash.
    The last of the ``max_features`` most frequent words that may be picked has the
    least count a picked term can have (without so many: ``min_df``), and a bigram's
    bucket holds its count at least, so the second pass counts the bigrams of the
    buckets that reach it, and no bigram that may be picked is left out."""

    bits = BUCKET_BITS

    def first(batches):
        sums = np.zeros(1 << bits, np.int64)
        for n, words, code, row, left in _coded(batches):
            term, df, cf = _added(n, code, row)
            yield pa.RecordBatch.from_arrays([_named(words, term), pa.nulls(len(df), pa.int32()), pa.array(df), pa.array(cf)], names=names)
            sums += np.bincount(_buckets(words, code, left, bits), minlength=len(sums))
        own = np.flatnonzero(sums)
        if len(own):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(own), pa.string()), pa.array(own.astype(np.int32)), pa.array(np.zeros_like(own)), pa.array(sums[own])], names=names)

    names = ["term", "bucket", "df", "cf"]
    rows = docs.select(tokens_col).mapInArrow(first, "term string, bucket int, df long, cf long")
    counted_once = materialize(rows.groupBy("term", "bucket").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")))
    words = counted_once.where("term IS NOT NULL").select("term", "df", "cf")
    least = max(min_df, 1)
    if max_features:
        found = _within(words, n_docs, min_df, max_df).orderBy(F.col("cf").desc()).limit(max_features).agg(F.count("*"), F.min("cf")).first()
        least = max(least, found[1] if found[0] == max_features else 0)
    hot = counted_once.where((F.col("term").isNull()) & (F.col("cf") >= least)).select("bucket").toArrow()  # a row a bucket at most
    reached = np.zeros(1 << bits, bool)
    reached[np.asarray(hot["bucket"])] = True
    shared = docs.sparkSession.sparkContext.broadcast(reached)

    def second(batches):
        for n, words, code, row, left in _coded(batches):
            left = left[shared.value[_buckets(words, code, left, bits)]]
            if len(left):
                m = len(words)
                term, df, cf = _added(n, m + code[left] * m + code[left + 1], row[left])
                yield pa.RecordBatch.from_arrays([_named(words, term), pa.array(df), pa.array(cf)], names=["term", "df", "cf"])

    pairs = docs.select(tokens_col).mapInArrow(second, "term string, df long, cf long")
    return words.where(F.col("cf") >= least).unionByName(pairs)


class Lookup:
    """Where a vocabulary (a table with term and idf) has each token and bigram."""

    def __init__(self, table: pa.Table):
        terms = [t.split(" ") for t in table["term"].to_pylist()]
        self.idf = np.asarray(table["idf"], np.float64)
        place: dict[str, int] = {}
        for t in terms:
            for w in t:
                place.setdefault(w, len(place))
        self.words = pa.array(list(place), pa.string())
        self.one = np.full(len(place) + 1, -1)
        pairs = []
        for i, t in enumerate(terms):
            if len(t) == 1:
                self.one[place[t[0]]] = i
            elif len(t) == 2:
                pairs.append((place[t[0]] * len(place) + place[t[1]], i))
        self.pairs = np.array(sorted(pairs), np.int64).reshape(-1, 2)

    def weights(self, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(offsets by row, row of the vocabulary, weight) for lists of tokens: sublinear
        tf (1 + ln tf) x idf, L2-normalised by row, in vocabulary order."""
        n, m = len(self.idf), len(self.words)
        off = _offsets(tokens)
        code = np.asarray(pc.fill_null(pc.index_in(tokens.flatten(), value_set=self.words), -1)).astype(np.int64)
        row = np.repeat(np.arange(len(tokens)), np.diff(off))
        at = self.one[code]  # the last place stands for unknown words
        found, rows = [at[at >= 0]], [row[at >= 0]]
        left = np.flatnonzero((row[1:] == row[:-1]) & (code[1:] >= 0) & (code[:-1] >= 0))
        if len(self.pairs) and len(left):
            key = code[left] * m + code[left + 1]
            place = np.minimum(np.searchsorted(self.pairs[:, 0], key), len(self.pairs) - 1)
            hit = self.pairs[place, 0] == key
            found.append(self.pairs[place[hit], 1])
            rows.append(row[left[hit]])
        each, tf = np.unique(np.concatenate(rows) * max(n, 1) + np.concatenate(found), return_counts=True)
        row, at = each // max(n, 1), each % max(n, 1)
        w = (1 + np.log(tf)) * self.idf[at]
        norm = np.sqrt(np.bincount(row, w * w, minlength=len(tokens)))
        return np.searchsorted(row, np.arange(len(tokens) + 1)).astype(np.int32), at, w / norm[row]


def counted(terms: Column) -> Column:
    """array<struct(term, tf)> from an array of terms: run lengths of the sorted
    array.  ``terms`` is bound once, so it may be any expression."""

    def runs(s: Column) -> Column:
        n = F.size(s)
        new = lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1))
        starts = F.when(n > 0, F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(new(i), F.lit(True)))).otherwise(
            F.array().cast("array<int>")
        )
        each = lambda at: F.transform(
            at, lambda i, k: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(at, k + 1), n) - i).cast("long").alias("tf"))
        )
        return F.element_at(F.transform(F.array(starts), each), 1)

    return F.element_at(F.transform(F.array(F.array_sort(terms)), runs), 1)


def explode_values(df: DataFrame, keep: list[str], array_col: str, out: str) -> DataFrame:
    """One row per array element.

    ``explode`` on a projected column makes Catalyst infer ``size(col) > 0``
    and push it below the projection with the column's defining expression
    substituted - re-running the tokeniser (inside the bigram lambda, once
    per element: quadratic).  ``explode_outer`` infers nothing; its null rows
    for empty arrays are dropped above the generator, where the predicate
    cannot be pushed further down.
    """
    return df.select(*keep, F.explode_outer(F.col(array_col)).alias(out)).where(F.col(out).isNotNull())


def term_frequencies(df: DataFrame, id_col: str, counts_col: str) -> DataFrame:
    """(id, term, tf) from a column of ``counted`` terms; no shuffle."""
    return explode_values(df, [id_col], counts_col, "__t").select(id_col, "__t.term", "__t.tf")


def _within(dfs: DataFrame, n_docs: int, min_df: int, max_df: float) -> DataFrame:
    return dfs.where((F.col("df") >= min_df) & (F.col("df") <= F.lit(float(max_df)) * F.lit(n_docs)))


def fit_tfidf_vocabulary(
    totals: DataFrame, n_docs: int, max_features: int | None, min_df: int = 1, max_df: float = 1.0
) -> DataFrame:
    """From ``term_totals`` or ``likely_totals`` the terms with min_df <= df <= max_df * n, the ``max_features`` largest by
    corpus count (ties: term ascending); smooth idf = ln((1+n)/(1+df)) + 1."""
    kept = _within(totals.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")), n_docs, min_df, max_df)
    if max_features is not None:
        kept = kept.orderBy(F.col("cf").desc(), F.col("term").asc()).limit(max_features)
    return kept.withColumn("idf", F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + 1)


def tfidf_weights(by_doc: DataFrame, tokens_col: str, vocab: DataFrame, id_col: str) -> DataFrame:
    """(id, term, weight) of rows of tokens and their bigrams: sublinear tf (1 + ln
    tf) x idf, L2-normalised per document."""
    table = small(vocab, ["term", "idf"])
    if table is None:
        terms = by_doc.select(id_col, T.with_bigrams(F.col(tokens_col)).alias("__terms"))
        return _joined_weights(term_frequencies(terms.select(id_col, counted(F.col("__terms")).alias("__c")), id_col, "__c"), vocab, id_col)
    shared = by_doc.sparkSession.sparkContext.broadcast((Lookup(table), table["term"].combine_chunks()))

    def run(batches):
        lookup, terms = shared.value
        for b in batches:
            off, at, weight = lookup.weights(b.column(1))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.ListArray.from_arrays(off, terms.take(pa.array(at))), pa.ListArray.from_arrays(off, pa.array(weight))],
                names=[id_col, "terms", "weights"],
            )

    own = by_doc.select(id_col, tokens_col)
    rows = own.mapInArrow(run, f"`{id_col}` {own.schema[id_col].dataType.simpleString()}, terms array<string>, weights array<double>")
    each = rows.select(id_col, F.explode_outer(F.arrays_zip("terms", "weights")).alias("__t")).where("__t IS NOT NULL")
    return each.select(id_col, F.col("__t.terms").alias("term"), F.col("__t.weights").alias("weight"))


def _joined_weights(tf: DataFrame, vocab: DataFrame, id_col: str) -> DataFrame:
    w = tf.join(vocab.select("term", "idf"), "term").withColumn("w", (F.lit(1.0) + F.log(F.col("tf").cast("double"))) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))  # a document's vocabulary terms
    return w.select(id_col, "term", (F.col("w") / norm).alias("weight"))


# --------------------------------------------------------------------------- sequences
def token_totals(docs: DataFrame, tokens_col: str) -> DataFrame:
    """(token, count) of every token, added up over the rows of a slice."""

    def run(batches):
        for b in batches:
            for s in _slices(b, 0):
                coded = s.column(0).flatten().drop_null().dictionary_encode()
                n = np.bincount(np.asarray(coded.indices, np.int64), minlength=len(coded.dictionary))
                yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(n.astype(np.int64))], names=["token", "count"])

    return docs.select(tokens_col).mapInArrow(run, "token string, count long")


def build_token_vocabulary(tokens: DataFrame, tokens_col: str, vocab_size: int = 10000, min_freq: int = 2) -> DataFrame:
    """SEQ-01: reserved tokens 0..3, then the most frequent tokens (count
    desc, token asc) with count >= min_freq, up to ``vocab_size`` entries."""
    spark = tokens.sparkSession
    counts = token_totals(tokens, tokens_col).groupBy("token").agg(F.sum("count").alias("count"))
    n_free = vocab_size - len(P.SEQ_RESERVED)
    top = counts.orderBy(F.col("count").desc(), F.col("token").asc()).limit(n_free).where(F.col("count") >= min_freq)
    w = Window.orderBy(F.col("count").desc(), F.col("token").asc())  # <= vocab_size rows after the limit
    top = top.select("token", (F.row_number().over(w) - 1 + len(P.SEQ_RESERVED)).cast("int").alias("idx"), "count")
    reserved = spark.createDataFrame([(t, i, 0) for t, i in P.SEQ_RESERVED], "token string, idx int, count long")
    return reserved.unionByName(top)


def encode(df: DataFrame, id_col: str, tokens_col: str, vocab: DataFrame) -> DataFrame:
    """SEQ-02: (id, ids) with every token's id in order, unknown = 1; documents
    without tokens get an empty array.  ``df`` may be sliced before."""
    unk = dict(P.SEQ_RESERVED)["<UNK>"]
    table = small(vocab, ["token", "idx"])
    if table is None:
        return _joined_ids(df, id_col, tokens_col, vocab, unk)
    shared = df.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        idx = np.asarray(shared.value["idx"], np.int32)
        for b in batches:
            at = _places(b.column(1).flatten(), shared.value, "token")
            ids = np.where(at >= 0, idx[at], unk).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(_offsets(b.column(1)), pa.array(ids))], names=[id_col, "ids"])

    own = df.select(id_col, tokens_col)
    return own.mapInArrow(run, f"`{id_col}` {own.schema[id_col].dataType.simpleString()}, ids array<int>")


def _joined_ids(df: DataFrame, id_col: str, tokens_col: str, vocab: DataFrame, unk: int) -> DataFrame:
    toks = df.select(id_col, F.posexplode_outer(tokens_col).alias("pos", "token"))
    ids = toks.join(vocab.select("token", "idx"), "token", "left")
    pair = F.when(F.col("pos").isNotNull(), F.struct("pos", F.coalesce(F.col("idx"), F.lit(unk)).alias("id")))
    seqs = ids.groupBy(id_col).agg(F.array_sort(F.collect_list(pair)).alias("p"))
    return seqs.select(id_col, F.transform("p", lambda e: e["id"]).alias("ids"))


def encode_and_pad(df: DataFrame, id_col: str, tokens_col: str, vocab: DataFrame, max_length: int) -> DataFrame:
    """SEQ-02/04: token -> id, truncate to ``max_length``, right-pad with 0."""
    pad = dict(P.SEQ_RESERVED)["<PAD>"]
    full = encode(df.select(id_col, F.slice(F.col(tokens_col), 1, max_length).alias("__t")), id_col, "__t", vocab)
    padded = F.slice(F.concat(F.col("ids"), F.array_repeat(F.lit(pad), max_length)), 1, max_length)
    return full.select(id_col, padded.alias("ids"), F.size("ids").alias("n_real"))


# --------------------------------------------------------------------------- scaling / one-hot
def standard_scale_long(train: DataFrame, apply_to: DataFrame, id_col: str, features: list[str]) -> DataFrame:
    """VEC-07: z = (x - mean_train) / std_pop_train (population std, like the
    reference's scaler); zero variance -> 0.  Long output (id, feature, z)."""
    stats = train.agg(
        *[F.avg(F.col(f).cast("double")).alias(f"m__{f}") for f in features],
        *[F.stddev_pop(F.col(f).cast("double")).alias(f"s__{f}") for f in features],
    )
    items = ", ".join(f"'{f}', `m__{f}`, `s__{f}`" for f in features)
    stats_long = stats.select(F.expr(f"stack({len(features)}, {items}) AS (feature, mean, std)"))
    vals = ", ".join(f"'{f}', CAST(`{f}` AS DOUBLE)" for f in features)
    long = apply_to.select(id_col, F.expr(f"stack({len(features)}, {vals}) AS (feature, x)"))
    z = F.when(F.col("std") > 0, (F.col("x") - F.col("mean")) / F.col("std")).otherwise(F.lit(0.0))
    return long.join(F.broadcast(stats_long), "feature").select(id_col, "feature", z.alias("z"))
