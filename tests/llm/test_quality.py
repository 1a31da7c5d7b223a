"""Operator 5: held-out accuracy, what it must not see, and edge rows."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from msgscope.llm import quality
from msgscope.sources.tables import read_table
from tests.llm import corpus

LABELS = "doc_id long, quality int, toxic int"


def held_out(d):
    return zlib.crc32(str(d).encode()) % 3 == 1


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = read_table(spark, sf, "documents"), read_table(spark, sf, "labels")
    got = quality.quality_digest(docs, labels)
    r = got.join(labels, "doc_id").where("held_out").agg(
        F.avg((F.col("predicted") == F.col("quality")).cast("double")).alias("acc"),
        F.avg(F.when(F.col("quality") == 1, F.col("predicted"))).alias("kept"),
        F.avg(F.when(F.col("quality") == 0, 1 - F.col("predicted"))).alias("caught"),
    ).collect()[0]
    print(r)
    assert r["acc"] > 0.97 and r["kept"] > 0.98 and r["caught"] > 0.9


def small(rng):
    out, labels = [], []
    for i in range(300):
        w = corpus.words(rng, rng.randrange(30, 90))
        y = i % 3 != 0
        out.append((i, " ".join(w if y else [x.upper() + "!!" for x in w]), "en", f"label{int(y)}", 1))
        # held-out rows carry the wrong label: they must not teach
        labels.append((i, int(y != held_out(i)), 0))
    return out, labels


def test_held_out_labels_and_other_columns_are_not_read(spark):
    data, labels = small(random.Random(5))
    data += [(900, None, None, None, None), (901, "", "", "", 0), (902, "x", "", "", 0), (902, "x", "", "", 0), (None, "a b", "", "", 0)]
    labels += [(3, 1, 0), (4, 0, None), (905, 1, 0), (None, 1, 0), (7, None, 0)]
    docs = corpus.frame(spark, data).withColumn("score", F.lit("x")).withColumn("y", F.lit(1))
    lab = spark.createDataFrame(labels, LABELS)
    got = {r["doc_id"]: r for r in quality.quality_digest(docs, lab).collect()}
    for i in range(300):
        assert got[i]["predicted"] == (i % 3 != 0)
        assert got[i]["held_out"] == held_out(i) and 0 <= got[i]["score"] <= 1
    assert {900, 901, 902, None} <= got.keys() and got[900]["score"] == got[901]["score"]
    kept = quality.keep_good(docs, lab)
    assert kept.schema == docs.schema
    assert {r["doc_id"] for r in kept.collect()} == {d for d, r in got.items() if r["predicted"]}


def test_without_labels_or_rows(spark):
    docs = corpus.frame(spark, small(random.Random(5))[0])
    none = spark.createDataFrame([(1, 1, 0)], LABELS)
    assert {r["score"] for r in quality.quality_digest(docs, none).collect()} == {0.5}
    assert quality.keep_good(docs, none).count() == 300
    assert quality.quality_digest(corpus.frame(spark, [], parts=1), none).count() == 0


def test_features_do_not_depend_on_neighbours():
    texts = [t or "" for _, t, *_ in corpus.rows(6)] + ["a\n\na\na", "\n", "\n\n"]
    parts = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    together = quality.features(np.frombuffer(b"".join(parts), np.uint8), off)
    for i, p in enumerate(parts):
        alone = quality.features(np.frombuffer(p, np.uint8), np.array([0, len(p)]))
        assert np.allclose(alone[0], together[i]), texts[i]
    h, row = quality._lines(np.frombuffer(b"a\n\na\nb", np.uint8), np.array([0, 4, 6]))
    assert list(row) == [0, 0, 0, 1, 1] and h[0] == h[2]
