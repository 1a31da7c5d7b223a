"""Operator 11: the library's own ids and decoded text, by a fresh tokenizer."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from msgscope.llm import treebpe
from tests.llm import corpus
from tests.llm.test_rans import odd_texts

FILE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["a", "b", "the", "ing", "'s", "'re", "'", "r", " ", "  ", "\n", "\t", "23", "!", "...", "é", "日本", "😀", "<|endoftext|>", "<|endof", "text|>", "　", "\xa0", "=", "ß"]
RUNS = ["a", "ab", "=", "! ", "'", " ", "\n", "é", "😀", "日", "0", "xyz", "-'"]


@pytest.fixture(scope="module")
def spec():
    with open(FILE, encoding="utf-8") as f:
        return f.read()


def test_joins_change_nothing(spec):
    rng, fresh = random.Random(5), Tokenizer.from_file(FILE)
    enc = treebpe.TreeEncoder(spec)
    for n in range(400):
        some = rng.sample(PIECES, rng.choice([3, len(PIECES)]))
        text = rng.choice(RUNS) * rng.choice([0, 0, rng.randrange(300)]) + "".join(rng.choice(some) for _ in range(rng.randrange(150)))
        enc.leaf, enc.window = rng.choice([2, 5, 16, 50]), rng.choice([1, 2, 4])
        assert enc.encode([text])[0].tolist() == fresh.encode(text, add_special_tokens=False).ids, (text, enc.leaf, enc.window)


def test_long_runs_need_small_windows(spec, monkeypatch):
    """One pre-token of 200 000 letters: joined by windows, not encoded anew."""
    rng, fresh = random.Random(6), Tokenizer.from_file(FILE)
    text = "".join(rng.choice("acgt") for _ in range(200_000))
    enc, seen = treebpe.TreeEncoder(spec), []
    parts = enc.pieces(enc.halves(text))
    plain = enc.pieces
    monkeypatch.setattr(enc, "pieces", lambda texts: seen.extend(map(len, texts)) or plain(texts))
    assert enc.merge(parts).ids.tolist() == fresh.encode(text, add_special_tokens=False).ids
    assert len(parts) > 16 and len(seen) >= len(parts) - 1 and sum(seen) < len(text) // 10


def test_any_ids_decode_as_the_library_does(spec):
    """Ids whose bytes are no valid text, too."""
    rng, fresh = random.Random(8), Tokenizer.from_file(FILE)
    enc = treebpe.TreeEncoder(spec)
    lists = [[rng.choice([rng.randrange(256), rng.randrange(50_257), 50_256]) for _ in range(rng.randrange(40))] for _ in range(500)]
    assert enc.decode([np.array(x, np.uint32) for x in lists]) == [fresh.decode(x, skip_special_tokens=False) for x in lists]


def test_digest(spark):
    fresh = Tokenizer.from_file(FILE)
    data = corpus.rows(2) + [(2000 + i, t, "", "", 0) for i, t in enumerate(odd_texts())]
    data += [(None, "x<|endoftext|> y", "", "", 0), (None, None, "", "", 0), (2999, "<|endoftext|>" * 3, "", "", 0)]
    data += [(3000, "ab, cd! <|endoftext|>" * 20_000, "", "", 0)] * 2 + [(3000, "q" * 100_000 + "é", "", "", 0), (None, "日本" * 40_000, "", "", 0)]
    docs = corpus.frame(spark, data).withColumn("id", F.lit(1)).withColumn("row", F.lit("x")).withColumn("leaf", F.lit(2)).withColumn("n_tokens", F.lit(0))
    got = sorted((tuple(r) for r in treebpe.round_trip_digest(docs, FILE).collect()), key=str)
    want = []
    for d, t, *_ in data:
        ids = fresh.encode(t or "", add_special_tokens=False).ids
        back = fresh.decode(ids, skip_special_tokens=False)
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert treebpe.round_trip_digest(corpus.frame(spark, [], parts=1), FILE).count() == 0


def test_other_tokenizers_are_not_cut():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        enc = treebpe.TreeEncoder(f.read(), leaf=8)
    text = "Some Words, and more of them " * 20
    assert not enc.cuts and enc.encode([text])[0].tolist() == enc.tok.encode(text, add_special_tokens=False).ids


def test_ids_and_texts_pass_through_one_worker(spark):
    """The digest is taken where the row is made, and the operator's own rows hold."""
    fresh = Tokenizer.from_file(FILE)
    data = [(1, "ab, cd!", "", "", 0), (2, "q r " * 20_000, "", "", 0), (None, None, "", "", 0)]
    docs = corpus.frame(spark, data, parts=1)
    plan = treebpe.round_trip_digest(docs, FILE)._jdf.queryExecution().optimizedPlan().toString().strip()
    assert plan.startswith("Union") and plan.count("MapInArrow") == 3  # whole texts; pieces cut, and encoded
    got = {r["id"]: (r["n_tokens"], np.frombuffer(r["ids"], "<u4").tolist(), r["text"]) for r in treebpe.round_trip(docs, FILE).collect()}
    for d, t, *_ in data:
        ids = fresh.encode(t or "", add_special_tokens=False).ids
        assert got[d] == (len(ids), ids, t or "")
