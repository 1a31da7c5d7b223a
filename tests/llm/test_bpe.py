"""Operator 8: the library's ids and the texts' own bytes."""

import hashlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from msgscope.llm import bpe
from tests.llm import corpus
from tests.llm.test_rans import odd_texts

FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_round_trip(spark):
    with open(FILE, "rb") as f:
        enc = bpe.encoding("test", public_tokenizers.PATTERN, f.read())
    data = corpus.rows(2) + [(2000 + i, t, "", "", 0) for i, t in enumerate(odd_texts())] + [(None, "x", "", "", 0)] + [(3000, "ab, cd! " * 30_000, "", "", 0)] * 2
    docs = corpus.frame(spark, data).withColumn("id", F.lit(1)).withColumn("bytes", F.lit("x"))
    got = bpe.round_trip_digest(docs, FILE, public_tokenizers.PATTERN).collect()
    assert len(got) == len(data)
    text = {d: t or "" for d, t, *_ in data}
    for r in got:
        t = text[r["doc_id"]]
        ids = np.array(enc.encode_ordinary(t), "<u4").tobytes()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert bpe.round_trip_digest(corpus.frame(spark, [], parts=1), FILE, public_tokenizers.PATTERN).count() == 0


def test_two_steps_equal_one(spark):
    docs = corpus.frame(spark, corpus.rows(7))
    a = bpe.detokenize(bpe.tokenize(docs, FILE, public_tokenizers.PATTERN), FILE, public_tokenizers.PATTERN)
    b = bpe.round_trip(docs, FILE, public_tokenizers.PATTERN)
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


def test_cuts_change_nothing():
    with open(FILE, "rb") as f:
        enc = bpe.encoding("test", public_tokenizers.PATTERN, f.read())
    for t in [*odd_texts(), *(t or "" for _, t, *_ in corpus.rows(5))]:
        for size in (1, 3, 17):
            assert bpe.encode(enc, t, size).tolist() == enc.encode_ordinary(t)
