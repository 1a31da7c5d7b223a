"""Operator 1 against exact distinct counts."""

import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from msgscope.llm import lines
from tests.llm import corpus


def expect(data, min_sites):
    sites = defaultdict(set)
    trim = lambda x: x.strip(" \t\r")
    for _, t, _, s, _ in data:
        for x in (t or "").split("\n"):
            sites[trim(x)].add(s)
    out = []
    for d, t, *_ in data:
        every = (t or "").split("\n")
        hit = [bool(trim(x)) and len(sites[trim(x)]) >= min_sites for x in every]
        cut = any(trim(x) and not h for x, h in zip(every, hit))
        kept = "\n".join(x for x, h in zip(every, hit) if not (h and cut))
        out.append((d, sum(bool(trim(x)) for x in every), sum(hit) if cut else 0, hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def data():
    out = []
    for i in range(400):
        body = [f"line {i} {j} with its own words" for j in range(i % 5)]
        # line k stands on k sites: estimates on both sides of the threshold
        body += [f"shared {k}" for k in range(1, 60) if i % 60 < k and i % 7 == k % 7]
        body += ["Menu\r", "  Menu", "", " "] if i % 3 == 0 else []
        body += ["on one site only"] if i % 60 == 5 else []
        out.append((i, "\n".join(body), "en", f"s{i % 60}" if i % 60 != 9 else None, 1))
    return out + [(500, None, None, None, None), (501, "", "", "", 0), (501, "", "", "", 0), (502, "Menu", "", "x", 0), (None, "Menu\nmore text here", "", "y", 0)]


def test_lines_against_exact_counts(spark):
    rows = data()
    for n in (2, 6, 10):
        got = sorted(map(tuple, lines.line_digest(corpus.frame(spark, rows), n).collect()), key=str)
        assert got == expect(rows, n)
        assert any(r[2] for r in got)


def test_rows_keep_their_columns(spark):
    rows = data()
    docs = corpus.frame(spark, rows).withColumn("gone", F.lit(7)).withColumn("k", F.lit("k")).withColumn("row", F.lit("r"))
    out = lines.dedup_lines(docs, 6)
    assert out.columns == docs.columns and out.schema["text"].dataType == docs.schema["text"].dataType
    got = out.collect()
    assert len(got) == len(rows)
    want = {r[0]: r for r in expect(rows, 6)}
    for r in got:
        assert (r["gone"], r["k"], r["row"]) == (7, "k", "r")
        assert hashlib.sha256((r["text"] or "").encode()).hexdigest() == want[r["doc_id"]][3]
        if want[r["doc_id"]][2]:
            assert r["n_chars"] == len(r["text"])
    assert [r["text"] for r in got if r["doc_id"] == 500] == [None]
    assert [r["text"] for r in got if r["doc_id"] == 502] == ["Menu"]


def test_long_texts(spark):
    """A page of 1 MB and a line of 1 MB; short pages that are mostly boilerplate."""
    rows = [(i, f"a menu of many words on every page\nown {i}", "en", f"s{i}", 1) for i in range(12)]
    rows += [(100, "a menu of many words on every page\n" + "own line of words\n" * 60_000, "", "s1", 1), (101, "a menu of many words on every page\n" + "w " * 500_000, "", "s2", 1)]
    rows += [(102, "a menu of many words on every page", "", "s3", 1), (103, "a menu of many words on every page\n" * 30_000, "", "s3", 1)]
    got = sorted(map(tuple, lines.line_digest(corpus.frame(spark, rows)).collect()), key=str)
    assert got == expect(rows, 10)
    assert {r[0]: r[2] for r in got} == dict.fromkeys(range(12), 1) | {100: 1, 101: 1, 102: 0, 103: 0}


def test_an_empty_table(spark):
    assert lines.line_digest(corpus.frame(spark, [], parts=1)).count() == 0
