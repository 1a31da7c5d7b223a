"""Cleaning, label normalisation and tokenising on inline golden rows."""

import math

import pytest
from pyspark.sql import functions as F

from msgscope.functions import text as T
from msgscope.operators.cleaning import clean_messages

# (input, expected cleaned text) - edge rows from the fixture list
CLEAN_ROWS = [
    ("URGENT! You've WON a $1000 gift card!!! Click here", "URGENT! You ve WON a <PHONE> gift card <EXCITED> Click here"),
    ("see [my site](https://x.io/a?b=1) **now** or _later_", "see my site <URL> now or later"),
    ("visit www.deal.com/x or http://a.b/c%20d ok", "visit <URL> or <URL> ok"),
    ("mail me: a.b+c@ex-ample.co.uk asap", "mail me <EMAIL> asap"),
    ("pay £5 or $20 today", "pay <MONEY> or <MONEY> today"),
    ("call +44 20-7946 0958 or 555-0123", "call <PHONE> or <PHONE>"),
    ("room 42, year 2024, ref 1234567", "room 42, year <PHONE> , ref <PHONE>"),
    ("really?? yes... 90% off", "really <QUESTION> yes <DOTS> 90 off"),
    ("été à 10€ – ça va ??", "été à 10 ça va <QUESTION>"),
    ("keep \\[this\\] `code` ~~gone~~", "keep this code gone"),
]


def test_clean_golden_rows(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CLEAN_ROWS)], "msg_id long, text string")
    got = {r.msg_id: r.c for r in df.select("msg_id", T.clean_text(F.col("text")).alias("c")).collect()}
    for i, (_, want) in enumerate(CLEAN_ROWS):
        assert got[i] == want, (CLEAN_ROWS[i][0], got[i])


def test_clean_messages_drops_short_and_blank(spark):
    rows = [(1, "ok"), (2, "   "), (3, None), (4, "hello world")]
    df = spark.createDataFrame(rows, "msg_id long, text string")
    out = {r.msg_id: (r.cleaned_text, r.text_length, r.word_count) for r in clean_messages(df).collect()}
    assert out == {4: ("hello world", 11, 2)}


def test_guarded_chain_equals_plain_chain(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CLEAN_ROWS)] + [(99, "a**b** c__d__ `e` f~~g~~")], "msg_id long, text string")
    plain = {r.msg_id: r.c for r in df.select("msg_id", T.clean_text(F.col("text")).alias("c")).collect()}
    staged = {r.msg_id: r.cleaned_text for r in clean_messages(df).collect()}
    assert staged == {k: v for k, v in plain.items() if len(v) >= 3}


LABEL_ROWS = [
    ("spam", 1), (" SPAM ", 1), ("1", 1), ("1.0", 1), ("true", 1), ("yes", 1), ("ham", 0), ("not_spam", 0),
    ("0.0", 0), ("no", 0), ("0.7", 1), ("0.5", 0), ("2", 1), ("abc", 0), ("nan", 0), (None, 0),
]


def test_normalize_label(spark):
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(LABEL_ROWS)], "i int, v string")
    got = {r.i: r.y for r in df.select("i", T.normalize_label(F.col("v")).alias("y")).collect()}
    for i, (v, want) in enumerate(LABEL_ROWS):
        assert got[i] == want, v


def test_nan_double_label_is_ham(spark):
    df = spark.createDataFrame([(float("nan"),), (0.9,), (math.inf,)], "v double")
    assert [r.y for r in df.select(T.normalize_label(F.col("v")).alias("y")).collect()] == [0, 1, 1]


def test_tokenisers(spark):
    df = spark.createDataFrame([("Hello, <URL> wörld!! été-2",)], "t string")
    r = df.select(
        T.sequence_tokens(T.clean_for_sequence(F.col("t"))).alias("s"), T.tfidf_tokens(F.col("t"), True).alias("f")
    ).first()
    assert r.s == ["hello", ",", "<url>", "wörld", "!", "!", "été", "2"]
    assert r.f == ["hello", "<url>", "world", "ete", "2"]


def test_bigrams_need_a_column(spark):
    with pytest.raises(ValueError):
        T.with_bigrams(T.tfidf_tokens(F.col("t")))
    df = spark.createDataFrame([(["a", "b", "c"],), (["x"],), ([],)], "toks array<string>")
    got = [r.g for r in df.select(T.with_bigrams(F.col("toks")).alias("g")).collect()]
    assert got == [["a", "b", "c", "a b", "b c"], ["x"], []]


def test_filter_source_artifacts(spark):
    df = spark.createDataFrame([("Fwd: Vince said 12 ok, Enron meeting at hou 2024 tomorrow!",)], "t string")
    assert df.select(T.filter_source_artifacts(F.col("t")).alias("f")).first().f == "said meeting tomorrow!"
