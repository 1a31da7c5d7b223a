"""The pipeline: each stage against a brute-force version on its own input."""

import hashlib
import random

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline as P
from msgscope.llm import bpe
from tests.llm import corpus, test_leaks, test_lines, test_near

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, tmp_path):
    rng = random.Random(12)
    docs, labels = [], []
    items = [(i, " ".join(corpus.words(rng, rng.choice([12, 25, 40]), 5000))) for i in range(8)]
    for i in range(240):
        w = corpus.words(rng, rng.randrange(60, 120), 3000)
        good = i % 4 != 0
        if i % 10 == 3:
            w[7:7] = items[i % 8][1].split()
        body = [" ".join(w[a : a + 15]) for a in range(0, len(w), 15)]
        if good and i % 3 == 0:
            body.insert(2, "Home  About  Contact")
        text = "\n".join(body)
        docs.append((i, text if good else " ".join(x.upper() + "!!" for x in w), "en", f"s{i % 37}", len(text)))
        labels.append((i, int(good), 0))
    family = [(300 + d, t, "en", f"s{d % 3}", len(t)) for d, t, *_ in test_near.family(4, 20, 0)]
    docs += family + [family[0]] * 2 + [(400, docs[1][1], "en", "s1", 5), (500, None, None, None, None), (501, "", "", "", 0), (501, "", "", "", 0)]
    docs += [(None, "a text of a row without an id that has some words of its own here", None, None, 3)]
    spark.createDataFrame(docs, COLUMNS).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return docs, items


def test_stages(spark, tmp_path):
    docs, items = tables(spark, tmp_path)
    stages = dict(P.STAGES)
    assert list(stages) == ["quality_classifier", "line_dedup", "near_dedup", "decontamination", "byte_bpe"]
    sf = str(tmp_path)
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    key = lambda rows: sorted(map(tuple, rows), key=str)

    def step(name, rows):
        out = stages[name](spark, spark.createDataFrame(rows, COLUMNS).repartition(3), sf)
        assert out.columns == frame.columns
        return key(out.collect())

    one = step("quality_classifier", docs)
    bad = {i for i in range(240) if i % 4 == 0}
    assert {r[0] for r in docs if r[0] is not None and r[0] < 400} - bad <= {r[0] for r in one}
    assert not bad & {r[0] for r in one} and set(one) <= set(map(tuple, docs))

    two = step("line_dedup", one)
    want = {(r[0], r[3]) for r in test_lines.expect(one, 10)}
    assert {(r[0], hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in two} == want and len(two) == len(one)
    assert any("Home  About" in (r[1] or "") for r in one) and not any("Home  About" in (r[1] or "") for r in two)

    three = step("near_dedup", two)
    told = test_near.expect(two)
    wordy = lambda t: test_near.WORD.search(t or "")
    want = {(d, t) for d, t, c in told if wordy(t) and d == c}  # of each class the first, once
    assert key(r[:2] for r in three) == key([*want, *((d, t) for d, t, _ in told if not wordy(t))])
    assert set(three) <= set(two) and 300 in {r[0] for r in three} and 400 not in {r[0] for r in three}

    four = step("decontamination", three)
    held = {r[0] for r in three for _, t in items if test_leaks.least_edits(test_leaks.plain(t), test_leaks.plain(r[1])) <= int(len(test_leaks.plain(t)) * 0.2)}
    assert {r[0] for r in four} == {r[0] for r in three} - held and held

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        enc = bpe.encoding("pipeline", public_tokenizers.PATTERN, f.read())
    want = {(d, np.array(enc.encode_ordinary(t or ""), "<u4").tobytes(), hashlib.sha256((t or "").encode()).hexdigest()) for d, t, *_ in four}
    last = P.run(spark, sf).collect()
    assert {(r["doc_id"], bytes(r["ids"]), r["decoded_sha256"]) for r in last} == want and len(last) == len(four)
    assert all(r["n_tokens"] * 4 == len(r["ids"]) for r in last)


def test_empty_tables_and_further_columns(spark, tmp_path):
    tables(spark, tmp_path)
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").where("false")
    empty.write.parquet(f"{tmp_path}/none/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/none/{t}.parquet")
    assert P.run(spark, f"{tmp_path}/none").count() == 0
    more = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumn("k", F.lit(1)).withColumn("row", F.lit("r")).withColumn("gone", F.lit(2.5))
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, more, str(tmp_path))
        assert out.columns == more.columns and out.where("k = 1 AND row = 'r' AND gone = 2.5").count() == out.count() > 0
