"""Family C and the clustering tokens counted in tasks, against their columns."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from msgscope.functions import counting as C
from msgscope.functions import patterns as P
from msgscope.functions.features import FAMILY_C_ORDER, family_c, features_of
from msgscope.operators import assemble as A
from msgscope.session import ship

ODD = """<URL> <EMAIL> İI straße Éa ÇÉÀ ABC ²²² ٣٤٥ $5 12_dollars 7 bucks cost price $12dollar 5% ٣% .com .exe .tk .click aaa !!! re: ΣΑΣ á
 ́your youŕ _́your 1́now ǅabc ABCǅ 中文字 vince 00 fwd don't enron's a-b-c <foo> ½ ¾¾¾ 12½ it's you're bit.ly t.co goo.gl I am dear sir""".split()


def texts():
    draw = random.Random(11)
    words = ODD + [a.replace("\\", "").replace("?", "") for _, x in P.FAMILY_C_WORDS for a in x] + [p for p, _ in P.SPAM_PHRASES]
    words += [w for pair in (P.GENERIC_GREETINGS, P.FIRST_PERSON) for x in pair for w in x]
    gaps = [" "] * 10 + ["  ", "    ", "\n", "\t", ". ", "!", "?", ", ", "-", "_", "'", "", "\r\n", "\u0085\u0085"]
    return ["", " ", ".", "\n\n", "!!!", "no obligationo obligation"] + ["".join(draw.choice(words) + draw.choice(gaps) for _ in range(draw.choice([1, 4, 30, 200]))) for _ in range(300)]


def test_counts_equal_the_columns(spark, monkeypatch):
    ship(spark)
    monkeypatch.setattr(C, "SLICE", 5000)
    df = spark.createDataFrame(list(enumerate(texts())), "msg_id long, t string").coalesce(2)
    want = {r["msg_id"]: [float(r[n]) for n in FAMILY_C_ORDER] for r in features_of(df, family_c, FAMILY_C_ORDER, "t").collect()}
    both = df.select("msg_id", "t", F.lower("t").alias("low")).toArrow().combine_chunks()
    got = C.family_c_rows(both["t"].combine_chunks(), both["low"].combine_chunks())
    assert got.shape == (len(want), 53)
    for i, row in zip(both["msg_id"].to_pylist(), got.tolist()):
        assert all(abs(x - y) <= 1e-12 * max(1, abs(y)) for x, y in zip(row, want[i])), (i, [n for n, x, y in zip(FAMILY_C_ORDER, row, want[i]) if x != y])


def test_no_texts():
    none = pa.array([], pa.string())
    assert C.family_c_rows(none, none).shape == (0, 53)
    assert C.Tokens()(none).to_pylist() == []
    assert C.family_c_rows(pa.array([None], pa.string()), pa.array([None], pa.string())).tolist() == C.family_c_rows(pa.array([""]), pa.array([""])).tolist()


def test_slices_hold_every_text_once():
    found = list(C.slices(pa.array(["aaa", "", None, "é" * 9, "bb", "c"]), 4))
    assert found == [(0, 3), (3, 1), (4, 2)]
    assert list(C.slices(pa.array([], pa.string()), 4)) == []


def test_prepared_rows_are_cleaned_once_and_give_the_same_matrix(spark):
    rows = [(i, t, "train" if i % 3 else "test", ["a", "b", None][i % 3]) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "msg_id long, cleaned_text string, split string, source string")
    spec = A.SPECS["clusters"]
    ready = A.prepared(df, spec, ["msg_id", "split"])
    tokens = {r["msg_id"]: r["t"] for r in df.select("msg_id", spec.tokens(F.col("cleaned_text")).alias("t")).collect()}
    assert {r["msg_id"]: r["__toks"] for r in ready.collect()} == tokens
    plan = ready._jdf.queryExecution().executedPlan().toString()
    assert plan.count("sent from my") == 1 and "regexp_count" not in plan
    model, other = A.fit(df.where("split = 'train'"), "clusters"), A.fit(ready.where("split = 'train'"), "clusters")
    assert model.vocab.collect() == other.vocab.collect() and model.sources.collect() == other.sources.collect()
    cells = lambda x: sorted((r["msg_id"], r["indices"], r["values"]) for r in x.collect())
    assert cells(model.sparse(df)) == cells(model.sparse(ready))
