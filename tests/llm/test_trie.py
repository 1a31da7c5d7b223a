"""Operator 13 against all prefixes in a dictionary, with small shards and chunks."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from msgscope.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"
SMALL = {"shard": 40, "shard_rows": 3, "chunk": 3, "last": 4, "few": 30}


def expect(rows):
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest(), (role or "", text or "")))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    members, ends = {}, {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        seq = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
        ends.setdefault(seq, []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = kids.get(p, [])
        leaves[p] = sum(leaves[k] for k in below) or 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[k] for k in below)
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest())
        for p, m in members.items()
    )


def talk(seed, n, hot=0):
    rng, rows = random.Random(seed), []
    said = [f"text {i} é😀"[: rng.randrange(1, 12)] for i in range(6)] + [None, ""]
    for c in range(n):
        for t in range(rng.randrange(0, 9)):
            rows.append((c * 7 - 300 if c % 5 else c * 100, None if rng.random() < 0.05 else t, rng.choice(["user", "user", "assistant", None]), rng.choice(said)))
    rows += [(10_000 + i, t, "user", "same") for i in range(hot) for t in range(4)]
    return rows


def got(df):
    return sorted(tuple(r) for r in df.collect())


def key(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize(("n", "hot"), [(1, 0), (12, 0), (150, 0), (150, 120)])
def test_against_all_prefixes(spark, n, hot):
    rows = talk(n, n, hot) + [(None, 1, "user", "nobody's"), (7, 1, "user", "twice"), (7, 1, "user", "twice")]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4).withColumn("base", F.lit(1)).withColumn("seq", F.lit("x")).withColumn("id", F.lit(2))
    seqs = trie.sequences(df, "crc32(cast(conv_id as string)) % 6", "conv_id - conv_id % 100")
    want = key(expect(rows))
    assert key(got(trie.prefix_digest(df))) == want
    assert key(got(trie.nodes(seqs, **SMALL))) == want


def test_long_and_short(spark):
    """A conversation of 5 000 turns, one of 1 MB, turnless ones and a hot tail."""
    turnless = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)  # conversation 100 is absent
    rows = [(300, t, "user", f"{t}") for t in range(5000)] + [(301, t, "user", f"{t}") for t in range(4990)]
    rows += [(400, 0, "user", "ab" * 500_000), (turnless, 0, "user", "gone"), (None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    seqs = trie.sequences(df, "crc32(cast(conv_id as string)) % 6", "conv_id - conv_id % 100")
    want = key(expect(rows))
    assert key(got(trie.nodes(seqs, **SMALL | {"shard": 1000}))) == want


def test_empty(spark):
    assert trie.prefix_digest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert trie.prefix_digest(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).count() == 0


def test_medians_balance():
    spines = [trie.Spine.of(i.to_bytes(16, "big"), b"\1" + b"\0" * 7, 1, i, "x") for i in range(1023)]
    t = trie.Tree(spines)

    def deep(i):
        return 1 + max(deep(t.lower[i]), deep(t.higher[i])) if i else 0

    assert deep(t.child[0]) == 10 and sorted(trie._medians(9)) == list(range(9))
