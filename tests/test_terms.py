"""Terms counted from tokens in slices, and text steps that look before they match."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from msgscope.functions import features as FE
from msgscope.functions import patterns as P
from msgscope.functions import text as T
from msgscope.operators import vectorize as V
from msgscope.operators.cleaning import with_clean_text

DOCS = [["a", "b", "a", "b"], [], None, ["b"], ["a", "b", "c d".split()[0]], ["a"] * 7]


def grams(doc):
    return list(doc or []) + [f"{x} {y}" for x, y in zip(doc or [], (doc or [])[1:])]


def test_term_totals_equal_a_count_of_every_document(spark, monkeypatch):
    """One row a slice and term instead of one a document and term; slices of any size."""
    df = spark.createDataFrame([(i, d) for i, d in enumerate(DOCS)], "id long, toks array<string>").coalesce(1)
    cf, dfs = Counter(), Counter()
    for d in DOCS:
        cf.update(grams(d))
        dfs.update(set(grams(d)))
    plain = V.term_totals(df, "toks").collect()
    assert {r["term"]: (r["df"], r["cf"]) for r in plain} == {t: (dfs[t], cf[t]) for t in cf} and len(plain) == len(cf)
    b = pa.RecordBatch.from_arrays([pa.array(DOCS, pa.list_(pa.string()))], names=["toks"])
    monkeypatch.setattr(V, "SLICE", 5)
    parts = list(V._slices(b, 0))
    assert sum(p.num_rows for p in parts) == len(DOCS) and len(parts) > 1 and [x for p in parts for x in p.column(0).to_pylist()] == DOCS
    tokens = V.token_totals(df, "toks").groupBy("token").agg(F.sum("count").alias("n")).collect()
    assert {r["token"]: r["n"] for r in tokens} == Counter(t for d in DOCS for t in d or [])
    fitted = V.fit_tfidf_vocabulary(V.term_totals(df, "toks"), len(DOCS), 2, 2, 1.0).collect()
    assert [(r["term"], r["df"], r["cf"]) for r in fitted] == [("a", 3, 10), ("b", 3, 4)]


def test_lookup_weights(spark):
    table = pa.table({"term": ["a", "a b", "c", "zz y"], "idf": [1.0, 2.0, 3.0, 4.0]})
    off, at, w = V.Lookup(table).weights(pa.array(DOCS, pa.list_(pa.string())))
    for i, d in enumerate(DOCS):
        n = Counter(grams(d))
        raw = {j: (1 + np.log(n[t])) * idf for j, (t, idf) in enumerate(zip(*table.to_pydict().values())) if n[t]}
        norm = np.sqrt(sum(x * x for x in raw.values()))
        assert at[off[i] : off[i + 1]].tolist() == list(raw) and np.allclose(w[off[i] : off[i + 1]], [x / norm for x in raw.values()])


def test_text_steps_equal_their_plain_forms(spark):
    texts = ["", " a  b\t\tc \n", "x  y z", "٠١ 2² now buy now, you're won't", "www.a.org a.com .com http://x é.net", "call +1 (555) 123 4567 or 12345!",
             "£5 $ 7 dollars 3 pounds", "Subject: re SUBJECT: x resubject y", "a@b.co  my.mail@x.org", "A1234 12345 123", "to TO too two hi sir HI  madam i am"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    c, rc = F.col("t"), lambda p: F.regexp_count(F.lower("t"), F.lit(p))
    pairs = [(F.regexp_replace(c, P.SPACES_J, " "), F.regexp_replace(c, f"[{P.SPACE}]+", " ")), (c.rlike(P.HAS_URL_J), c.rlike(P.HAS_URL)), (c.rlike(P.HAS_PRICE_J), c.rlike(P.HAS_PRICE))]
    pairs += [(F.regexp_extract_all(c, F.lit(a), 0), F.regexp_extract_all(c, F.lit(b), 0)) for a, b in ((P.SEQ_TOKEN_J, P.SEQ_TOKEN), (P.TFIDF_TOKEN_J, P.TFIDF_TOKEN))]
    pairs += [(T.count_class(c, P.IS_DIGIT_J), F.length(c) - F.length(F.regexp_replace(c, P.IS_DIGIT, "")))]
    pairs += [(F.regexp_replace(c, a, "_"), F.regexp_replace(c, b, "_")) for (a, _), (b, _) in zip(P.EMAIL_ARTIFACT_STEPS_J[:-1], P.EMAIL_ARTIFACT_STEPS)]
    pairs += [(F.regexp_replace(c, java, "_"), F.regexp_replace(c, re2, "_")) for name, java, _, re2, _ in P.CLEAN_STEPS if name in ("phone", "number")]
    words = dict(FE.family_c_word_patterns_java())
    pairs += [(rc(words[n]), rc(r"\b(" + "|".join(alts) + r")\b")) for n, alts in P.FAMILY_C_WORDS]
    rows = df.select("t", *[F.to_json(F.struct(a.alias("x"))).alias(f"a{i}") for i, (a, _) in enumerate(pairs)], *[F.to_json(F.struct(b.alias("x"))).alias(f"b{i}") for i, (_, b) in enumerate(pairs)]).collect()
    for r in rows:
        assert [r[f"a{i}"] for i in range(len(pairs))] == [r[f"b{i}"] for i in range(len(pairs))], r["t"]


def test_one_space_and_the_cleaned_tail_equal_the_plain_steps(spark):
    """Spaces by a split at a literal, other characters and white space by one class."""
    odd = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0    　"
    texts = [None, "", " ", odd, f"{odd}a{odd}b ", "a  b", " é–ñ {x}  <URL>;;y\t\tz_ ", "$5 £ 7 a € 9,5 ₹1.2.3 5$", "x퟿\U0001f600y", "A, b! -c <Dots>?"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "msg_id long, t string")
    rc = F.regexp_replace
    c = F.coalesce("t", F.lit(""))
    old_sequence = F.btrim(rc(rc(rc(F.lower(c), P.SPACES_J, " "), P.SEQ_KEEP, " "), "  +", " "))
    pairs = [(T.one_space("t"), F.btrim(rc("t", P.SPACES_J, " "))), (T.clean_for_sequence(F.col("t")), old_sequence)]
    rows = df.select("msg_id", *[a.alias(f"a{i}") for i, (a, _) in enumerate(pairs)], *[b.alias(f"b{i}") for i, (_, b) in enumerate(pairs)]).collect()
    for r in rows:
        assert [r[f"a{i}"] for i in range(len(pairs))] == [r[f"b{i}"] for i in range(len(pairs))], texts[r["msg_id"]]
    staged = with_clean_text(df, "t", "c").select("c", T.clean_text(F.col("t")).alias("plain"))
    assert all(r["c"] == r["plain"] for r in staged.collect())
    plan = staged.select("c")._jdf.queryExecution().optimizedPlan().toString()
    assert P.CLEAN_STEPS[-1][1] not in plan and P.CLEAN_STEPS[-2][1] not in plan  # the two slow patterns


def test_likely_totals_leave_out_no_term_of_the_vocabulary(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = np.array([f"w{i}" for i in range(300)])
    docs = [(i, words[np.minimum(rng.zipf(1.3, rng.integers(0, 60)) - 1, 299)].tolist() if i % 17 else None) for i in range(400)]
    df = spark.createDataFrame(docs, "id long, toks array<string>").repartition(5)
    cf = Counter(t for _, d in docs for t in grams(d))
    for bits in (4, 12):
        monkeypatch.setattr(V, "BUCKET_BITS", bits)
        for limits in ((400, 40, 2, 0.95), (400, 40, 2, 0.2), (400, 5000, 1, 1.0), (400, None, 3, 0.9), (400, 3, 399, 1.0)):
            likely = V.likely_totals(df, "toks", *limits)
            key = lambda t: sorted(map(tuple, V.fit_tfidf_vocabulary(t, *limits).collect()))
            assert key(likely) == key(V.term_totals(df, "toks")), (bits, limits)
    few = {r["term"] for r in V.likely_totals(df, "toks", 400, 40, 2, 0.95).collect()}
    assert len(few) < len(cf) / 4 and {t for t, _ in cf.most_common(20)} <= few


def test_sequence_classifier_evaluates_its_rows_once(spark, tmp_path, monkeypatch):
    """The ids are taken from stored rows, not from another run of the cleaning chain."""
    from msgscope.plans import q_ml

    rows = [(i, f"some words of text number {i % 7} here", "en", f"s{i % 3}", i % 2) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, toxic int")
    docs.drop("toxic").write.parquet(f"{tmp_path}/documents.parquet")
    docs.select("doc_id", "toxic").write.parquet(f"{tmp_path}/labels.parquet")

    class Seen(Exception):
        pass

    def encode(df, *_):
        raise Seen(df._jdf.queryExecution().executedPlan().toString())

    monkeypatch.setattr(V, "encode", encode)
    with pytest.raises(Seen) as e:
        q_ml.sequence_classifier(spark, str(tmp_path))
    assert "FileScan" not in str(e.value) and "regexp" not in str(e.value)
