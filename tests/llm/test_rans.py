"""Operator 4: exact round trips, the library's ids, file order, checksums."""

import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from msgscope.llm import rans
from tests.llm import corpus

FILE = public_tokenizers.path("byte_bpe_50k.json")


def library():
    return Tokenizer.from_file(FILE)


def odd_texts():
    return [
        "a  b\t\tc \n\n d", "  lead and trail  ", " nbsp  wide　", "x\x0by\x0cz \x1c\x85", "don't we'll I'M", "<|endoftext|> inside", "x.<|endoftext|><|endoftext|>", "half <|endof", "text|> another", "a  <|endoftext|>  b", "é" * 300,
        "a" * 5000, " \n" * 500, "日本語 テキスト 123 456", "“quoted” — dash…", "\r\n\r\n", "1 2  3   4    5", "emoji 👩‍👩‍👧 end", "tab\tonly", "﻿bom",
    ]


def test_parts_encode_as_the_library_does():
    with open(FILE, encoding="utf-8") as f:
        enc = rans.PartEncoder(f.read())
    texts = odd_texts() + [t or "" for _, t, *_ in corpus.rows(3)]
    tok = library()
    for _ in range(2):  # the second time from what is remembered
        parts = [t.encode() for t in texts]
        off = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        flat, n = enc(np.frombuffer(b"".join(parts), np.uint8), off)
        ends = np.cumsum(n)
        for t, a, z in zip(texts, ends - n, ends):
            assert flat[a:z].tolist() == tok.encode(t, add_special_tokens=False).ids, t[:40]


def test_coder_round_trip_and_checksum():
    rng = np.random.default_rng(1)
    for n in (0, 1, 1023, 1025, 600_000):
        ids = np.minimum(rng.geometric(0.01, n), 900).astype(np.uint32)
        coder = rans.Coder(rans.quantise(np.bincount(ids, minlength=2)))
        parts = coder.encode(ids)
        assert np.array_equal(np.concatenate([coder.decode(s) for s in parts]) if parts else np.zeros(0), ids)
        if n == 600_000:
            assert len(parts) > 2 and np.array_equal(coder.decode(parts[1]), ids[rans.LANES * rans.STEPS : 2 * rans.LANES * rans.STEPS])
            assert sum(len(s["words"]) for s in parts) < 2 * n
            with pytest.raises(ValueError):
                coder.decode({**parts[0], "crc": parts[0]["crc"] ^ 1})


def test_frequencies_fill_the_table():
    for counts in ([5], [1, 0, 3], [10**12, 1, 1], [1] * 5000):
        f = rans.quantise(np.array(counts))
        assert f.sum() == 1 << rans.SCALE and all((x > 0) == (c > 0) for x, c in zip(f, counts))


def test_documents_in_order(spark):
    data = corpus.rows(2) + [(2000 + i, t, "", "", 0) for i, t in enumerate(odd_texts())] + [(3000, "twice", "", "", 0)] * 2
    docs = corpus.frame(spark, data).withColumn("part", F.lit(1)).withColumn("ids", F.lit("x"))
    got = {}
    for r in rans.token_digest(docs, FILE).collect():
        got.setdefault(r["doc_id"], []).append(tuple(r)[1:])
    tok, at = library(), 0
    for d, t, *_ in sorted(data, key=lambda r: (r[0], r[1] or "")):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        assert (at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))) in got[d]
        at += len(ids)
    assert sum(map(len, got.values())) == len(data)


def test_rows_without_ids_are_dealt_out(spark):
    """Ids in order, and neither null ids nor one id's rows all in one part."""
    data = [(None, f"text {i}", "", "", 0) for i in range(400)] + [(5, f"more {i}", "", "", 0) for i in range(400)] + [(9, "last", "", "", 0)]
    path = rans.folder(spark, "test-parts")
    rows = sorted(rans.token_digest(corpus.frame(spark, data), FILE, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None] * 400 + [5] * 400 + [9]
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:]))
    parts = rans.read_tokens(spark, path).groupBy("doc_id").agg(F.countDistinct("part").alias("n")).collect()
    assert {r["doc_id"]: r["n"] > 1 for r in parts} == {None: True, 5: True, 9: False}


def test_empty_and_null_ids(spark):
    assert rans.token_digest(corpus.frame(spark, [], parts=1), FILE).count() == 0
    got = rans.token_digest(corpus.frame(spark, [(4, "b", "", "", 0), (None, "a", "", "", 0)]), FILE).collect()
    assert sorted((r["start"], r["doc_id"]) for r in got) == [(0, None), (2, 4)]
