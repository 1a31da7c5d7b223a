"""Operator 6 against a plain count over words and lines."""

import re
from collections import Counter

from pyspark.sql import functions as F

from msgscope.llm import ledger
from tests.llm import corpus

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expect(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    count = Counter(windows)
    gone = set()
    for i, k in enumerate(windows):
        if count[k] > 1:
            gone.update(range(i, i + 8))
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(gone))


def test_measures(spark):
    data = corpus.rows(4) + [(900, "a b c d e f g h a b c d e f g h i", "", "", 0), (901, "x " * 40, "", "", 0), (902, "#|* l\nq\n\nq\n q\n" * 9, "", "", 0)]
    got = ledger.rule_digest(corpus.frame(spark, data)).collect()
    want = {d: expect(t) for d, t, *_ in data}
    assert len(got) == len(data)
    for r in got:
        assert tuple(r)[1:6] == want[r["doc_id"]], r["doc_id"]
        n, _, symbols, _, repeat = want[r["doc_id"]]
        assert r["base_failed"] == (n < 20 or 100 * repeat > 30 * n)
        assert not (r["base_failed"] and r["kept"])
        assert bool(r["fail_bits"] & ledger.bit("symbols")) == (10 * symbols > n)


def test_ablations_count_what_policies_keep(spark):
    rows = [(i, b) for i, b in enumerate([0, 0, 1, 2, 3, 4, 6, 64])]
    entries = spark.createDataFrame(rows, "doc_id long, fail_bits long")
    got = {r["rule"]: tuple(r)[1:] for r in ledger.ablations(entries, "v1").collect()}
    assert got["few_words"] == (2, 1, 3, 4)
    assert got["symbols"] == (2, 1, 3, 4)
    assert got["repeated_lines"] == (0, 0, 3, 3)
    kept = {p: ledger.apply_policy(entries, p).where("kept").count() for p in ledger.POLICIES}
    assert kept == {"base": 4, "v1": 3, "v2": 2}


def test_edges_and_plan(spark):
    assert ledger.rule_digest(corpus.frame(spark, [], parts=1)).count() == 0
    rows = [(None, None, None, None, None), (1, "a", None, None, None), (1, "a", None, None, None)]
    clash = corpus.frame(spark, rows).withColumn("n_words", F.lit(9)).withColumn("fail_bits", F.lit("x")).withColumn("t", F.lit(1))
    got = sorted(map(tuple, ledger.rule_digest(clash).collect()), key=str)
    assert [r[:2] for r in got] == [(1, 1), (1, 1), (None, 0)] and all(r[6] and not r[7] for r in got)
    plan = ledger.ledger(corpus.frame(spark, corpus.rows(1, 3)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert plan.count("split(t") <= 2
