"""TF-IDF, numeric and source columns as one sparse feature row (VEC-01..06,
F-60..62, SEQ-06, ML-15/19).

A ``FeatureModel`` is fitted on training rows only: vocabulary with idf,
source categories, and the numeric columns' names.  It is two small tables and
a parameter document, saved together and reloaded for scoring, so training and
serving use the same artefact.  ``transform`` applies it to any rows, in long
form ``(id, idx, value)`` without zeros; ``vectors`` gathers that by id for
Spark ML.  Rows meet tables by joins on term and source, whose strategy Spark
picks by size.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from msgscope.functions import counting
from msgscope.functions import patterns as P
from msgscope.functions import text as T
from msgscope.functions.features import FAMILY_B_NAMES, FAMILY_C_ORDER, family_b, family_c
from msgscope.operators import matrix
from msgscope.operators import vectorize as V
from msgscope.operators.ranking import join_null_safe
from msgscope.session import checkpoint_dir, materialize


def _plain(c: Column) -> Column:
    return T.tfidf_tokens(c, True)


def _default(c: Column) -> Column:
    """TXT-18: words of two or more characters."""
    return F.regexp_extract_all(F.lower(c), F.lit(P.DEFAULT_TFIDF_TOKEN), 0)


def _filtered(c: Column) -> Column:
    tokens = T.tfidf_tokens(T.filter_source_artifacts(T.clean_email_artifacts(c)))
    return F.filter(tokens, lambda w: ~w.isin(P.ENGLISH_STOP_WORDS))


@dataclass(frozen=True)
class Spec:
    """What one kind of model sees (fixed values of the variants below)."""

    tokens: Callable[[Column], Column]
    max_features: int
    min_df: int
    max_df: float
    numeric: Callable[[Column], list] | None
    numeric_names: tuple[str, ...]
    source_weight: float
    ready: Callable[[DataFrame, list[str]], DataFrame] | None = None  # ``prepared`` of this kind, if not by columns


def _counted(df: DataFrame, own: list[str]) -> DataFrame:
    """``prepared`` for clusters: the artefacts are removed once a row, and a task counts
    what ``family_c`` and ``_filtered`` do."""
    text = df.select(*own, F.col("source").alias("__source"), T.clean_email_artifacts(F.col("cleaned_text")).alias("__t"))

    def run(batches):
        tokens, k = counting.Tokens(), len(own) + 1
        for whole in batches:
            for b in (whole.slice(*s) for s in counting.slices(whole.column(k), counting.BATCH)):
                wide = counting.family_c_rows(b.column(k), b.column(k + 1))
                ends = np.arange(len(wide) + 1, dtype=np.int32) * wide.shape[1]
                yield pa.RecordBatch.from_arrays([*b.columns[:k], pa.ListArray.from_arrays(ends, pa.array(wide.ravel())), tokens(b.column(k + 1))], names=[*own, *_READY])

    sql = ", ".join(f"`{c}` {text.schema[c].dataType.simpleString()}" for c in [*own, "__source"])
    return text.select("*", F.lower("__t").alias("__low")).mapInArrow(run, f"{sql}, __x array<double>, __toks array<string>")


_READY = ("__source", "__x", "__toks")
SPECS = {
    "basic": Spec(_default, 3000, 2, 0.95, None, (), 0.0),
    "trees": Spec(_plain, 5000, 2, 0.95, family_b, tuple(FAMILY_B_NAMES), 1.0),
    "clusters": Spec(_filtered, 500, 5, 0.6, lambda c: family_c(T.clean_email_artifacts(c)), tuple(FAMILY_C_ORDER), 1.0, _counted),
}


def term_rows(df: DataFrame, spec: Spec, id_col: str = "msg_id", text_col: str = "cleaned_text") -> DataFrame:
    """(id, counts): one row a document, the tokens whose n-grams are counted."""
    if "__toks" in df.columns:
        return df.select(id_col, F.col("__toks").alias("counts"))
    return df.select(id_col, spec.tokens(F.col(text_col)).alias("counts"))


def prepared(df: DataFrame, spec: Spec, own: list[str]) -> DataFrame:
    """The columns ``own`` of rows (msg_id, cleaned_text, source), their source, numeric
    columns and tokens: what no fitted model is needed for."""
    if spec.ready:
        return spec.ready(df, own)
    numeric = dict(spec.numeric(F.col("cleaned_text"))) if spec.numeric else {}
    x = F.array(*[numeric[n].cast("double") for n in spec.numeric_names]) if numeric else F.array().cast("array<double>")
    return df.select(*own, F.col("source").alias("__source"), x.alias("__x"), spec.tokens(F.col("cleaned_text")).alias("__toks"))


@dataclass
class FeatureModel:
    kind: str
    vocab: DataFrame  # term, df, cf, idf, idx (by term)
    sources: DataFrame  # source, idx (by source; no nulls)
    source_weight: float | None = None  # the kind's own, if None

    @property
    def spec(self) -> Spec:
        spec = SPECS[self.kind]
        return spec if self.source_weight is None else replace(spec, source_weight=self.source_weight)

    def narrowed(self, max_features: int, source_weight: float) -> FeatureModel:
        """The model of fewer terms (the most frequent, as ``fit`` picks them) and
        another weight of the sources."""
        top = self.vocab.orderBy(F.col("cf").desc(), "term").limit(max_features).drop("idx")
        return FeatureModel(self.kind, materialize(_numbered(top, "term")), self.sources, source_weight)

    def names(self) -> DataFrame:
        """(idx, feature): TF-IDF terms, numeric columns, sources, in this order."""
        spark = self.vocab.sparkSession
        n_terms = self.vocab.count()  # bounded by max_features
        numeric = spark.createDataFrame([(n_terms + i, n) for i, n in enumerate(self.spec.numeric_names)], "idx int, feature string")
        parts = [self.vocab.select("idx", F.concat(F.lit("tfidf_"), "term").alias("feature")), numeric]
        if self.spec.source_weight:
            at = n_terms + len(self.spec.numeric_names)
            parts.append(self.sources.select((F.col("idx") + at).alias("idx"), F.concat(F.lit("source_"), "source").alias("feature")))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.select(F.col("idx").cast("int").alias("idx"), "feature")

    def tfidf(self, df: DataFrame) -> DataFrame:
        """(msg_id, term, weight) of any rows by the fitted vocabulary."""
        return V.tfidf_weights(term_rows(df, self.spec), "counts", self.vocab, "msg_id")

    def sparse(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """(msg_id, keep, indices, values) of rows (msg_id, cleaned_text, source), or of
        ``prepared`` ones; no zeros.  The vocabulary is bounded by ``max_features`` and goes to the tasks,
        as the sources do, so that a row is worked out where it lies."""
        spec, keep, spark = self.spec, keep or [], df.sparkSession
        vocab = self.vocab.select("term", "idx", "idf").orderBy("idx").toArrow()
        sources = {r["source"]: r["idx"] for r in self.sources.collect()} if spec.source_weight else {}
        shared = spark.sparkContext.broadcast((V.Lookup(vocab), sources))
        own = ["msg_id", *keep]
        toks = df.select(*own, *_READY) if "__toks" in df.columns else prepared(df, spec, own)
        n_names, weight = len(spec.numeric_names), float(spec.source_weight)

        def run(batches):
            lookup, sources = shared.value
            n_terms = len(lookup.idf)
            for b in batches:
                n, k = b.num_rows, len(own)
                off, at, w = lookup.weights(b.column(k + 2))
                rows, cols, values = [np.repeat(np.arange(n), np.diff(off))], [at], [w]
                wide = np.nan_to_num(np.asarray(b.column(k + 1).flatten(), np.float64)).reshape(n, n_names)
                r, c = np.nonzero(wide)
                rows, cols, values = [*rows, r], [*cols, c + n_terms], [*values, wide[r, c]]
                if weight:
                    place = np.array([sources.get(s, -1) for s in b.column(k).to_pylist()], np.int64)
                    r = np.flatnonzero(place >= 0)
                    rows, cols, values = [*rows, r], [*cols, place[r] + n_terms + n_names], [*values, np.full(len(r), weight)]
                row, col, value = (np.concatenate(a) for a in (rows, cols, values))
                order = np.lexsort((col, row))
                ends = np.searchsorted(row[order], np.arange(n + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(ends, pa.array(a)) for a in (col[order].astype(np.int32), value[order])]
                yield pa.RecordBatch.from_arrays([*b.columns[:k], *lists], names=[*own, "indices", "values"])

        sql = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in own)
        return toks.mapInArrow(run, f"{sql}, indices array<int>, values array<double>")

    def transform(self, df: DataFrame) -> DataFrame:
        """(msg_id, idx, value) of rows (msg_id, cleaned_text, source); no zeros."""
        each = self.sparse(df).select("msg_id", F.explode_outer(F.arrays_zip("indices", "values")).alias("e")).where("e IS NOT NULL")
        return each.select("msg_id", F.col("e.indices").alias("idx"), F.col("e.values").alias("value"))

    def size(self) -> int:
        return self.vocab.count() + len(self.spec.numeric_names) + (self.sources.count() if self.spec.source_weight else 0)

    def write_matrix(self, df: DataFrame, path: str, keep: list[str] | None = None) -> None:
        """SNK-04: the matrix of every row of ``df``, with the columns ``keep``."""
        matrix.write(self.sparse(df, keep), self.size(), self.names(), path)

    def vectors(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """(msg_id, keep, features: sparse vector) of every row, stored and read back."""
        path = os.path.join(checkpoint_dir(df.sparkSession), "matrices", uuid.uuid4().hex)
        self.write_matrix(df, path, keep)
        return matrix.load(df.sparkSession, path)

    def save(self, path: str) -> None:
        self.vocab.write.parquet(os.path.join(path, "vocab"))
        self.sources.write.parquet(os.path.join(path, "sources"))
        spark = self.vocab.sparkSession
        spark.createDataFrame([(json.dumps({"kind": self.kind, "size": self.size(), "source_weight": self.source_weight}),)], "value string").coalesce(1).write.text(os.path.join(path, "metadata"))


def narrowed_rows(rows: DataFrame, widest: FeatureModel, models: dict[str, FeatureModel]) -> DataFrame:
    """(config, the columns of ``rows``) with the indices and values that each of the
    ``narrowed`` models gives, from those of ``widest`` (with its sources' weight):
    a term's weight before the norm is the same, so the texts aren't read again."""
    width, n_terms = widest.size(), widest.vocab.count()
    at = {r["term"]: r["idx"] for r in widest.vocab.select("term", "idx").collect()}  # bounded by max_features
    plans = {}
    for name, model in models.items():
        place, times = np.full(width, -1), np.ones(width)
        own = model.vocab.select("term", "idx").collect()
        for r in own:
            place[at[r["term"]]] = r["idx"]
        end = n_terms + len(widest.spec.numeric_names) if not model.spec.source_weight else width
        place[n_terms:end] = np.arange(end - n_terms) + len(own)
        times[n_terms + len(widest.spec.numeric_names) :] = model.spec.source_weight / (widest.spec.source_weight or 1.0)
        plans[name] = (place, times)
    keep = [c for c in rows.columns if c not in ("indices", "values")]
    shared = rows.sparkSession.sparkContext.broadcast(plans)

    def run(batches):
        for b in batches:
            k, n = len(keep), b.num_rows
            row = np.repeat(np.arange(n), np.asarray(V.pc.list_value_length(b.column(k))))
            old, value = np.asarray(b.column(k).flatten()), np.asarray(b.column(k + 1).flatten())
            for name, (place, times) in shared.value.items():
                own = np.flatnonzero(place[old] >= 0)
                r, w = row[own], value[own] * times[old[own]]
                term = old[own] < n_terms
                norm = np.sqrt(np.bincount(r[term], w[term] ** 2, minlength=n))
                w[term] /= norm[r[term]]
                ends = np.searchsorted(r, np.arange(n + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (place[old[own]].astype(np.int32), w)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * n), *b.columns[:k], *lists], names=["config", *keep, "indices", "values"])

    sql = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select(*keep, "indices", "values").mapInArrow(run, f"config string, {sql}, indices array<int>, values array<double>")


def load(spark: SparkSession, path: str) -> FeatureModel:
    meta = json.loads(spark.read.text(os.path.join(path, "metadata")).collect()[0][0])
    return FeatureModel(meta["kind"], spark.read.parquet(os.path.join(path, "vocab")), spark.read.parquet(os.path.join(path, "sources")), meta.get("source_weight"))


def _numbered(df: DataFrame, col: str) -> DataFrame:
    """Adds ``idx``: 0-based place in the order of ``col``; for bounded tables."""
    return df.withColumn("idx", (F.row_number().over(Window.orderBy(col)) - 1).cast("int"))


def fit(train: DataFrame, kind: str, max_features: int | None = None) -> FeatureModel:
    """Fit on rows (msg_id, cleaned_text, source), or on stored ``prepared`` ones."""
    spec, ready = SPECS[kind], "__toks" in train.columns
    by_doc = term_rows(train, spec) if ready else materialize(term_rows(train, spec))
    limits = (by_doc.count(), max_features or spec.max_features, spec.min_df, spec.max_df)
    vocab = V.fit_tfidf_vocabulary(V.likely_totals(by_doc, "counts", *limits), *limits)
    sources = train.select(F.col("__source" if ready else "source").alias("source")).where("source IS NOT NULL").distinct()
    return FeatureModel(kind, materialize(_numbered(vocab.select("term", "df", "cf", "idf"), "term")), materialize(_numbered(sources, "source")))


def one_hot_sources(df: DataFrame, sources: DataFrame) -> DataFrame:
    """F-60/61: ``source_index`` (-1 if unknown or null) and the 0/1 code."""
    k = sources.agg(F.count("*").cast("int").alias("__k"))
    one = "__one"
    found = join_null_safe(df, sources.withColumnRenamed("idx", "source_index"), ["source"], "left")
    full = found.withColumn(one, F.lit(1)).join(F.broadcast(k.withColumn(one, F.lit(1))), one).drop(one)  # one row
    full = full.withColumn("source_index", F.coalesce("source_index", F.lit(-1)).cast("int"))
    code = F.transform(F.sequence(F.lit(0), F.col("__k") - 1), lambda i: (i == F.col("source_index")).cast("int"))
    return full.withColumn("onehot", F.when(F.col("__k") > 0, F.array_join(code, ",")).otherwise("")).drop("__k")
