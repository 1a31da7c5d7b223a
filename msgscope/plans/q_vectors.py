"""Registered queries: TF-IDF, token vocabulary, id sequences, scaling, one-hot."""

from __future__ import annotations

from pyspark.sql import functions as F

from msgscope.functions import patterns as P
from msgscope.functions import text as T
from msgscope.functions.features import family_a, features_of
from msgscope.operators import vectorize as V
from msgscope.operators.assemble import _numbered, one_hot_sources
from msgscope.operators.cleaning import clean_messages
from msgscope.operators.ranking import exact_quantiles
from msgscope.operators.sampling import stratified_split
from msgscope.plans import sqlparts as S
from msgscope.plans.frames import SQL_CLEANED, SQL_MESSAGES, cleaned, documents, messages, with_ctes
from msgscope.plans.q_sampling import SQL_SPLIT
from msgscope.plans.q_stats import ALL_A, SQL_FA
from msgscope.plans.registry import query
from msgscope.session import materialize

# Trees-model TF-IDF parameters (fixed values)
MAX_FEATURES, MIN_DF, MAX_DF = 5000, 2, 0.95
# Sequence-model parameters (fixed values)
VOCAB_SIZE, MIN_FREQ, MAX_LEN = 10000, 2, 128


def _r6(c):
    return F.round(c, 6)


SQL_DOC_TERMS = f"""
cdocs AS (SELECT msg_id, cleaned_text FROM (SELECT doc_id AS msg_id, {S.clean_text('text')} AS cleaned_text FROM documents)
          WHERE length(cleaned_text) >= {P.MIN_CLEAN_LENGTH}),
toks AS (SELECT msg_id, {S.tokens(S.strip_accents('lower(cleaned_text)'), P.TFIDF_TOKEN)} AS toks FROM cdocs),
terms AS (SELECT msg_id, {S.with_bigrams('toks')} AS terms FROM toks),
tf AS (SELECT msg_id, term, count(*) AS tf FROM (SELECT msg_id, unnest(terms) AS term FROM terms) GROUP BY 1, 2),
nd AS (SELECT count(*) AS n FROM cdocs),
dfs AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY term),
vocab AS (SELECT term, df, cf, ln(CAST(1 + n AS DOUBLE) / CAST(1 + df AS DOUBLE)) + 1 AS idf
          FROM dfs, nd WHERE df >= {MIN_DF} AND df <= {MAX_DF} * n ORDER BY cf DESC, term ASC LIMIT {MAX_FEATURES})"""


def _tfidf_inputs(spark, d):
    by_doc = materialize(clean_messages(documents(spark, d)).select("msg_id", T.tfidf_tokens(F.col("cleaned_text"), True).alias("toks")))
    n_docs = by_doc.count()
    limits = (n_docs, MAX_FEATURES, MIN_DF, MAX_DF)
    vocab = V.fit_tfidf_vocabulary(V.likely_totals(by_doc, "toks", *limits), *limits)
    return by_doc, materialize(vocab), n_docs


@query("tfidf_vocab", "WITH " + SQL_DOC_TERMS + "\nSELECT term, CAST(df AS BIGINT) AS df, CAST(cf AS BIGINT) AS cf, round(idf, 6) AS idf FROM vocab")
def tfidf_vocab(spark, d):
    _rows, vocab, _n = _tfidf_inputs(spark, d)
    return vocab.select("term", "df", "cf", _r6(F.col("idf")).alias("idf"))


SQL_TFIDF_WEIGHTS = "WITH " + SQL_DOC_TERMS + """,
w AS (SELECT t.msg_id, t.term, (1 + ln(t.tf)) * v.idf AS w FROM tf t JOIN vocab v ON t.term = v.term)
SELECT msg_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY msg_id)), 6) AS weight FROM w
"""


@query("tfidf_weights", SQL_TFIDF_WEIGHTS)
def tfidf_weights(spark, d):
    by_doc, vocab, _n = _tfidf_inputs(spark, d)
    return V.tfidf_weights(by_doc, "toks", vocab, "msg_id").select("msg_id", "term", _r6(F.col("weight")).alias("weight"))


SQL_TFIDF_SPARSITY = "WITH " + SQL_DOC_TERMS + """,
nnz AS (SELECT count(*) AS nnz FROM tf t JOIN vocab v ON t.term = v.term),
nt AS (SELECT count(*) AS n_terms FROM vocab)
SELECT CAST(n AS BIGINT) AS n_docs, CAST(n_terms AS BIGINT) AS n_terms, CAST(nnz AS BIGINT) AS nnz,
       round(nnz / (n * n_terms), 6) AS density FROM nd, nnz, nt
"""


@query("tfidf_sparsity", SQL_TFIDF_SPARSITY)
def tfidf_sparsity(spark, d):
    _rows, vocab, n_docs = _tfidf_inputs(spark, d)
    # a term has an entry in each of its ``df`` documents
    r = vocab.agg(F.count(F.lit(1)).alias("n_terms"), F.coalesce(F.sum("df"), F.lit(0)).alias("nnz"))
    return r.select(
        F.lit(n_docs).cast("long").alias("n_docs"), F.col("n_terms").cast("long"), F.col("nnz").cast("long"),
        _r6(F.col("nnz") / (F.lit(n_docs) * F.col("n_terms"))).alias("density"),
    )


# VEC-04: artefact tokens left in the vocabulary (expected: none)
SQL_VOCAB_LEAK = "WITH " + SQL_DOC_TERMS + f"""
SELECT term FROM vocab WHERE list_contains([{', '.join(S.lit(a) for a in P.SOURCE_ARTIFACTS)}], term)
"""


@query("vocab_artifact_leak", SQL_VOCAB_LEAK)
def vocab_artifact_leak(spark, d):
    _rows, vocab, _n = _tfidf_inputs(spark, d)
    arts = spark.createDataFrame([(a,) for a in P.SOURCE_ARTIFACTS], "term string")
    return vocab.join(F.broadcast(arts), "term", "left_semi").select("term")


# --------------------------------------------------------------------------- SEQ-01..05
SQL_SEQ_BASE = f"""
sq AS (SELECT msg_id, {S.tokens(S.clean_for_sequence('cleaned_text'), P.SEQ_TOKEN)} AS toks FROM
        (SELECT msg_id, cleaned_text FROM (SELECT doc_id AS msg_id, {S.clean_text('text')} AS cleaned_text FROM documents)
         WHERE length(cleaned_text) >= {P.MIN_CLEAN_LENGTH})),
cnt AS (SELECT token, count(*) AS count FROM (SELECT unnest(toks) AS token FROM sq) GROUP BY token),
top AS (SELECT token, count FROM cnt ORDER BY count DESC, token ASC LIMIT {VOCAB_SIZE - len(P.SEQ_RESERVED)}),
vocab AS (SELECT token, CAST(row_number() OVER (ORDER BY count DESC, token ASC) - 1 + {len(P.SEQ_RESERVED)} AS INTEGER) AS idx,
                 CAST(count AS BIGINT) AS count FROM top WHERE count >= {MIN_FREQ}
          UNION ALL SELECT * FROM (VALUES {', '.join(f"('{t}', {i}, CAST(0 AS BIGINT))" for t, i in P.SEQ_RESERVED)}) r(token, idx, count))"""


def _seq_tokens(spark, d):
    c = clean_messages(documents(spark, d)).select("msg_id", "cleaned_text")
    return materialize(c.select("msg_id", T.sequence_tokens(T.clean_for_sequence(F.col("cleaned_text"))).alias("toks")))


@query("vocab_build", "WITH " + SQL_SEQ_BASE + "\nSELECT token, idx, count FROM vocab")
def vocab_build(spark, d):
    return V.build_token_vocabulary(_seq_tokens(spark, d), "toks", VOCAB_SIZE, MIN_FREQ)


SQL_ENCODE = "WITH " + SQL_SEQ_BASE + f""",
pos AS (SELECT msg_id, unnest(toks[1:{MAX_LEN}]) AS token, unnest(range(1, len(toks[1:{MAX_LEN}]) + 1)) AS p FROM sq),
ids AS (SELECT s.msg_id, list(coalesce(v.idx, 1) ORDER BY s.p) AS ids FROM pos s LEFT JOIN vocab v ON s.token = v.token GROUP BY s.msg_id)
SELECT q.msg_id, array_to_string(list_resize(coalesce(i.ids, []), {MAX_LEN}, 0), ' ') AS ids,
       CAST(len(coalesce(i.ids, [])) AS INTEGER) AS n_real
FROM sq q LEFT JOIN ids i ON q.msg_id = i.msg_id
"""


@query("encode_pad", SQL_ENCODE)
def encode_pad(spark, d):
    toks = _seq_tokens(spark, d)
    vocab = materialize(V.build_token_vocabulary(toks, "toks", VOCAB_SIZE, MIN_FREQ))
    r = V.encode_and_pad(toks, "msg_id", "toks", vocab, MAX_LEN)
    return r.select("msg_id", F.array_join("ids", " ").alias("ids"), F.col("n_real").cast("int"))


SQL_SEQ_LENGTHS = "WITH " + SQL_SEQ_BASE + """
SELECT round(avg(len(toks)), 6) AS mean, round(quantile_cont(len(toks), 0.25), 6) AS p25,
       round(quantile_cont(len(toks), 0.5), 6) AS median, round(quantile_cont(len(toks), 0.75), 6) AS p75,
       round(quantile_cont(len(toks), 0.95), 6) AS p95, CAST(max(len(toks)) AS BIGINT) AS max,
       CAST(least(floor(quantile_cont(len(toks), 0.95)), 128) AS INTEGER) AS suggested_max_length
FROM sq
"""


@query("sequence_lengths", SQL_SEQ_LENGTHS)
def sequence_lengths(spark, d):
    lens = _seq_tokens(spark, d).select(F.size("toks").alias("n"))
    q = exact_quantiles(lens, "n", [0.25, 0.5, 0.75, 0.95])
    base = lens.agg(_r6(F.avg("n")).alias("mean"), F.max("n").cast("long").alias("max"))
    from msgscope.operators.clustering import attach_one_row

    r = attach_one_row(base, q)
    return r.select(
        "mean", _r6(F.col("q_0")).alias("p25"), _r6(F.col("q_1")).alias("median"), _r6(F.col("q_2")).alias("p75"),
        _r6(F.col("q_3")).alias("p95"), "max",
        F.least(F.floor(F.col("q_3")), F.lit(MAX_LEN)).cast("int").alias("suggested_max_length"),
    )


# --------------------------------------------------------------------------- VEC-07
SQL_SCALE = with_ctes(SQL_MESSAGES, SQL_CLEANED, SQL_SPLIT, SQL_FA) + """,
sp AS (SELECT f.*, s.split FROM fa f JOIN split s ON f.msg_id = s.msg_id),
lg AS (UNPIVOT (SELECT msg_id, split, """ + ", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in ALL_A) + """ FROM sp)
       ON """ + ", ".join(ALL_A) + """ INTO NAME feature VALUE x),
st AS (SELECT feature, avg(x) AS mean, stddev_pop(x) AS std FROM lg WHERE split = 'train' GROUP BY feature)
SELECT l.msg_id, l.feature, round(CASE WHEN s.std > 0 THEN (l.x - s.mean) / s.std ELSE 0.0 END, 6) AS z
FROM lg l JOIN st s ON l.feature = s.feature WHERE l.split = 'test'
"""


@query("scale_standard", SQL_SCALE)
def scale_standard(spark, d):
    sp = stratified_split(cleaned(spark, d).select("msg_id", "label", "source")).select("msg_id", "split")
    fa = features_of(messages(spark, d), family_a, ALL_A)
    both = materialize(fa.join(sp, "msg_id"))
    z = V.standard_scale_long(both.where("split = 'train'"), both.where("split = 'test'"), "msg_id", ALL_A)
    return z.select("msg_id", "feature", _r6(F.col("z")).alias("z"))


# --------------------------------------------------------------------------- F-60/61
SQL_ONEHOT = with_ctes(SQL_MESSAGES, SQL_CLEANED, SQL_SPLIT) + """,
cats AS (SELECT list(DISTINCT source ORDER BY source) AS c FROM split WHERE split = 'train')
SELECT msg_id, CAST(coalesce(list_position(c, source), 0) - 1 AS INTEGER) AS source_index,
       array_to_string(list_transform(range(1, len(c) + 1), lambda i: CASE WHEN i = list_position(c, source) THEN 1 ELSE 0 END), ',') AS onehot
FROM split, cats
"""


@query("source_onehot", SQL_ONEHOT)
def source_onehot(spark, d):
    sp = stratified_split(cleaned(spark, d).select("msg_id", "label", "source")).select("msg_id", "source", "split")
    sources = _numbered(sp.where("split = 'train' AND source IS NOT NULL").select("source").distinct(), "source")
    return one_hot_sources(sp.select("msg_id", "source"), sources).select("msg_id", "source_index", "onehot")
