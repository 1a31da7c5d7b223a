"""Operator 3 against edit distance to every span, and its recall."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from msgscope.llm import leaks
from tests.llm import corpus

DROP = {i: None for i, d in enumerate(leaks.DROPPED) if d}


def plain(text):
    return (text or "").lower().translate(DROP).split()


def least_edits(item, text):
    """Least edit distance of item to any span of text, by the plain recurrence."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (w != t)))
        row = new
    return min(row)


def edited(rng, w, n, pool):
    w = w[:]
    for _ in range(n):
        k, p = rng.random(), rng.randrange(len(w))
        if k < 0.5:
            w[p] = rng.choice(pool)
        elif k < 0.75:
            w.insert(p, rng.choice(pool))
        else:
            del w[p]
    return w


def corpus_with_leaks(seed=1):
    rng = random.Random(seed)
    pool = [f"word{i}" for i in range(3000)] + ["the", "of", "and", "a"] * 300
    items = [(i, " ".join(rng.choice(pool) for _ in range(rng.choice([1, 3, 4, 6, 9, 14, 20, 33, 47, 70, 140]))).capitalize() + ".") for i in range(60)]
    items += [(60, None), (61, ""), (62, "?!"), (63, items[9][1]), (None, items[12][1])]
    docs = []
    for d in range(260):
        w = [rng.choice(pool) for _ in range(rng.randrange(0, 150))]
        if d % 2:
            i, t = items[rng.randrange(60)]
            own = plain(t)
            part = edited(rng, own, rng.randrange(0, int(len(own) * 0.2) + 2), pool)
            at = rng.randrange(len(w) + 1)
            w[at:at] = [x.upper() if d % 4 == 1 else x + "," for x in part]
        docs.append((d, rng.choice([" ", "\n", "  "]).join(w), "en", "s", 1))
    docs += [(900, None, None, None, None), (901, "", "", "", 0), (902, " \n", "", "", 0), (903, items[20][1], "", "", 0), (903, items[20][1], "", "", 0), (None, items[21][1], "", "", 0)]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_every_row_is_right_and_few_are_missing(spark, seed):
    docs, items = corpus_with_leaks(seed)
    got = leaks.leaks(corpus.frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    words = [(d, plain(t)) for d, t, *_ in docs]
    asked = [(i, plain(t)) for i, t in items if plain(t)]
    want = {}
    for d, text in words:
        for i, item in asked:
            e = least_edits(item, text)
            if e <= int(len(item) * 0.2 + 1e-9):
                want[d, i] = e
    found = {(r["doc_id"], r["item_id"]): r["edits"] for r in got}
    assert all(want[k] == e for k, e in found.items())  # none that isn't one
    exact = {k for k, e in want.items() if e == 0}
    assert exact <= found.keys()
    assert len(found) >= 0.97 * len(want)
    assert sum(r["doc_id"] == 903 for r in got) == 2 * sum(d == 903 for d, _ in want)


def test_best_span():
    rng = np.random.default_rng(4)
    for _ in range(200):
        item, text = rng.integers(0, 6, rng.integers(1, 12)), rng.integers(0, 6, rng.integers(0, 20))
        cost, first = leaks.best_span(item, text)
        assert cost == least_edits(item.tolist(), text.tolist())
        assert any(least_edits_whole(item.tolist(), text[first:z].tolist()) == cost for z in range(first, len(text) + 1))


def least_edits_whole(a, b):
    row = list(range(len(b) + 1))
    for i, w in enumerate(a, 1):
        new = [i]
        for j, t in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (w != t)))
        row = new
    return row[-1]


def test_items_in_blocks_and_rows_kept(spark, monkeypatch):
    docs, items = corpus_with_leaks(3)
    d = corpus.frame(spark, docs).withColumn("key", F.lit(1)).withColumn("gone_id", F.lit("x"))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("start", F.lit(9))
    key = lambda x: sorted(map(tuple, x.collect()), key=str)
    whole = key(leaks.leaks(d, b))
    monkeypatch.setattr(leaks, "ITEM_BLOCK_BYTES", 3000)
    parts = key(leaks.leaks(d, b))
    assert {r[:2] for r in whole if r[3] == 0} == {r[:2] for r in parts if r[3] == 0} and abs(len(whole) - len(parts)) <= 3
    kept = leaks.keep_clean(d, b)
    assert kept.schema.simpleString() == d.schema.simpleString()
    ids = [r["doc_id"] for r in kept.collect()]
    assert set(ids) == {r[0] for r in docs} - {r[0] for r in parts} and {900, 901, 902} <= set(ids)
    assert "Join" not in kept._jdf.queryExecution().executedPlan().toString()


def test_empty_tables(spark):
    docs, items = corpus_with_leaks(3)
    d, b = corpus.frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    assert leaks.leaks(corpus.frame(spark, [], parts=1), b).count() == 0
    assert leaks.leaks(d, b.where("false")).count() == 0
    assert leaks.keep_clean(d, b.where("false")).count() == len(docs)
