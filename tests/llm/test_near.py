"""Operator 2 against exact similarity of all pairs."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from msgscope.llm import near
from msgscope.llm.components import components
from tests.llm import corpus

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(text or "")
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def exact(a, b):
    both = a.keys() & b.keys()
    every = a.keys() | b.keys()
    return sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in every) for d in both)


def expect(data):
    """(doc_id, text, class) of each row, by all pairs of texts."""
    first = {}
    for d, t, *_ in data:
        if WORD.search(t or ""):
            first[t] = min(first.get(t, (2, 0)), (d is not None, d or 0))
    texts = sorted(first, key=lambda t: first[t])
    own = [shingles(t) for t in texts]
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(own):
        for j, b in enumerate(own[:i]):
            if root(i) != root(j) and exact(a, b) >= 0.8:
                x, y = sorted((root(i), root(j)))
                up[y] = x
    at = {t: i for i, t in enumerate(texts)}
    of = lambda t: first[texts[root(at[t])]]
    return [(d, t, (of(t)[1] if of(t)[0] else None) if t in at else d) for d, t, *_ in data]


def same(got, data):
    pairs = lambda rows: sorted(((r[0], r[-1]) for r in rows), key=str)
    return pairs(got) == pairs(expect(data))


def family(seed, n, at, size=90):
    """Copies with chains: some like the first, some only like other copies."""
    rng = random.Random(seed)
    base = corpus.words(rng, size)
    out = [base]
    for _ in range(n - 1):
        w = (base if rng.random() < 0.6 else rng.choice(out))[:]
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        out.append(w)
    return [(at + i, " ".join(w), "en", "s", 1) for i, w in enumerate(out)]


def test_similarity_is_the_probability_jaccard():
    rng = random.Random(1)
    for _ in range(60):
        a = Counter(rng.choices(range(30), k=rng.randrange(1, 60)))
        b = Counter(rng.choices(range(30), k=rng.randrange(1, 60)))
        args = []
        for c in (a, b):
            k = sorted(c)
            args += [np.array(k, np.uint64), np.array([c[x] for x in k])]
        assert abs(near.similarity(*args) - exact(a, b)) < 1e-9


def test_signatures_estimate_it():
    rng = np.random.default_rng(3)
    for overlap in (0.3, 0.8):
        n = 300
        h = rng.integers(1, 2**63, 2 * n).astype(np.uint64)
        k = int(n * overlap)
        a, b = np.sort(h[:n]), np.sort(np.concatenate([h[:k], h[n : 2 * n - k]]))
        wa, wb = rng.integers(1, 5, n), rng.integers(1, 5, n)
        m = 4000
        sig = near.signatures(np.repeat([0, 1], n), np.concatenate([a, b]), np.concatenate([wa, wb]), 2, m)
        assert abs((sig[0] == sig[1]).mean() - near.similarity(a, wa, b, wb)) < 0.04
        assert (sig != 0).all()


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_against_all_pairs(spark, seed):
    data = corpus.rows(seed)[:] + family(seed, 40, 1000) + family(seed + 9, 25, 2000, 14) + [(3000, "a b c", "", "", 0), (3001, "a  b c", "", "", 0), (3002, "a b", "", "", 0)]
    data = [r for r in data if not r[1] or len(r[1]) < 20_000]
    assert same(near.near_classes(corpus.frame(spark, data)).collect(), data)


def test_a_group_dealt_in_blocks(spark, monkeypatch):
    data = family(5, 120, 0)
    monkeypatch.setattr(near, "BLOCK_BYTES", 9_000)
    docs = near.keyed(corpus.frame(spark, data))
    links = near.verified(near.led_pairs(near.bands(docs)), docs)
    assert links.where("u = v").count() == 0 and links.count() > 0
    assert same(near.near_classes(corpus.frame(spark, data)).collect(), data)


def kept(spark, data):
    docs = corpus.frame(spark, data).withColumn("a", F.lit(1)).withColumn("class_id", F.lit("c")).withColumn("row", F.lit(2.0)).withColumn("node", F.lit(0))
    assert same(near.near_classes(docs).collect(), data)
    out = near.keep_one(docs)
    assert out.schema.simpleString() == docs.schema.simpleString()
    return sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)


def test_no_text_is_lost_with_its_id(spark):
    say = lambda i: f"text number {i} has words {i * 7} of {i * 11} its {i * 13} own {i * 17}"
    unrelated = [(None, say(i), "", "", 0) for i in range(5)] + [(7, say(8), "", "", 0), (7, say(9), "", "", 0)]
    assert kept(spark, unrelated) == sorted(((d, t) for d, t, *_ in unrelated), key=str)
    shared = [(700, say(1), "", "", 0), (700, say(2), "", "", 0), (701, say(2), "", "", 0)]
    assert kept(spark, shared) == sorted([(700, say(1)), (700, say(2))])


def test_repeated_ids_nulls_and_one_kept(spark):
    f = family(8, 6, 10)
    data = f + [f[0], f[0], (500, f[2][1], "x", "y", 1), (None, f[3][1], "", "", 0), (None, "own words here for the null row", "", "", 0)]
    data += [(600, None, "", "", 0), (601, "", "", "", 0), (602, " \n", "", "", 0), (603, "", "", "", 0), (None, None, "", "", 0)]
    got = kept(spark, data)
    classes = {t: c for _, t, c in expect(data) if WORD.search(t or "")}
    of = [classes[t] for _, t in got if t in classes]
    # one row stays of each class, and the class has that row's id
    assert len(got) == len(set(classes.values())) + 1 + 5 and [d for d, t in got if t in classes] == of
    none = corpus.frame(spark, [], parts=1)
    assert near.near_classes(none).count() == 0 and near.keep_one(none).count() == 0


def test_long_texts(spark):
    """Megabytes of text, one a near copy of the other."""
    rng = random.Random(3)
    w = corpus.words(rng, 250_000, 10**6)
    near_copy = w[:]
    for i in range(0, len(w), 400):
        near_copy[i] = "zz"
    other = corpus.words(rng, 250_000, 10**6)
    data = [(5, " ".join(w), "", "", 0), (2, " ".join(near_copy), "", "", 0), (1, " ".join(other), "", "", 0), (9, "short", "", "", 0)]
    docs = corpus.frame(spark, data)
    assert {tuple(r) for r in near.near_classes(docs).collect()} == {(5, 2), (2, 2), (1, 1), (9, 9)}
    assert sorted(r["doc_id"] for r in near.keep_one(docs).collect()) == [1, 2, 9]


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(25)] + [(7, 7)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    got = {r["u"]: r["v"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: root(x) for x in up if root(x) != x}
