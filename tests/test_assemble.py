"""Assembled features: fitted on training rows, saved, reloaded, applied."""

import math

from pyspark.sql import functions as F

from msgscope.operators import assemble as A


def frame(spark, rows):
    return spark.createDataFrame(rows, "msg_id long, cleaned_text string, source string")


def test_fit_save_reload_transform(spark, tmp_path):
    train = frame(spark, [(1, "free money now", "b"), (2, "free lunch", "a"), (3, "money money <URL> now", None), (4, "see you", "a")])
    model = A.fit(train, "trees")
    model.save(f"{tmp_path}/m")
    again = A.load(spark, f"{tmp_path}/m")
    vocab = {r["term"]: (r["idx"], r["idf"]) for r in again.vocab.collect()}
    assert set(vocab) == {"free", "money", "now"}  # df of two or more
    assert [vocab[t][0] for t in ("free", "money", "now")] == [0, 1, 2]
    assert math.isclose(vocab["free"][1], math.log(5 / 3) + 1)
    names = {r["idx"]: r["feature"] for r in again.names().collect()}
    assert names[0] == "tfidf_free" and names[3] == "char_count" and names[max(names)] == "source_b" and len(names) == again.size()
    new = frame(spark, [(10, "free free money unknown!", "a"), (11, "nothing", "unseen"), (12, "", None)])
    got = {}
    for r in again.transform(new).collect():
        got.setdefault(r["msg_id"], {})[names[r["idx"]]] = r["value"]
    a, b = (1 + math.log(2)) * vocab["free"][1], vocab["money"][1]
    assert math.isclose(got[10]["tfidf_free"], a / math.hypot(a, b)) and got[10]["source_a"] == 1.0
    assert got[10]["exclamation_count"] == 1 and not any(n.startswith(("tfidf_", "source_")) for n in got[11])
    vectors = {r["msg_id"]: r["features"] for r in again.vectors(new).collect()}
    assert set(vectors) == {10, 11, 12} and vectors[10].size == again.size()
    assert vectors[10][0] == got[10]["tfidf_free"]


def test_narrowed_rows_equal_a_narrow_model(spark, monkeypatch):
    """Fewer terms and another weight of the sources, from the widest model's rows;
    and the stored matrix, whole and by columns."""
    import random

    from msgscope.operators import matrix as M
    from msgscope.operators import vectorize as V
    from msgscope.session import checkpoint_dir

    rng = random.Random(4)
    words = [f"word{i}" for i in range(30)]
    df = frame(spark, [(i, " ".join(rng.choices(words, weights=range(1, 31), k=rng.randrange(0, 25))) + "!", rng.choice(["a", "b", None])) for i in range(60)])
    widest = A.fit(df, "clusters", 12)
    path = f"{checkpoint_dir(spark)}/matrix-test"
    widest.write_matrix(df, path, ["source"])
    whole = spark.read.parquet(f"{path}/rows").select("msg_id", "source", "features.indices", "features.values")
    models = {"few": widest.narrowed(4, 0.0), "weighted": widest.narrowed(7, 0.5)}
    entry = lambda r: {(i, round(v, 9)) for i, v in zip(r["indices"], r["values"])}
    got = {(r["config"], r["msg_id"]): entry(r) for r in A.narrowed_rows(whole, widest, models).collect()}
    for name, model in models.items():
        assert model.vocab.count() == (4 if name == "few" else 7)
        assert {r["msg_id"]: entry(r) for r in model.sparse(df).collect()} == {m: e for (c, m), e in got.items() if c == name}
    # the matrix: vectors to train on, a column read alone, and only the columns asked for in the plan
    vectors = {r["msg_id"]: r["features"] for r in M.load(spark, path).collect()}
    some = M.load_names(spark, path).where("feature LIKE 'source%'")
    idx = {r["feature"]: r["idx"] for r in some.collect()}
    cells = M.entries(spark, path, some, ["msg_id"]).collect()
    assert len(cells) == df.where("source IS NOT NULL").count() and all(vectors[c["msg_id"]][idx[c["feature"]]] == c["value"] == 1.0 for c in cells)
    assert M.sampled(spark, path, 2, 42, ["msg_id"]).select("feature").distinct().count() <= 2
    plan = M.load(spark, path).select("msg_id")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<msg_id:bigint>" in plan
    # weights and ids by a vocabulary too large to send equal those worked out in the row, which exchanges nothing
    key = lambda rows: sorted((r[0], r[1], round(r[2], 9)) for r in rows)
    by_doc = A.term_rows(df, widest.spec)
    sent = V.tfidf_weights(by_doc, "counts", widest.vocab, "msg_id")
    toks = df.select("msg_id", F.split("cleaned_text", " ").alias("t"))
    vocab = V.build_token_vocabulary(toks, "t", 20, 2)
    ids = V.encode_and_pad(toks, "msg_id", "t", vocab, 9)
    for frame_ in (sent, ids):
        assert "Exchange" not in frame_._jdf.queryExecution().executedPlan().toString()
    a, b = key(sent.collect()), sorted(map(str, ids.collect()))
    monkeypatch.setattr(V, "MOST_TERMS", 3)
    joined = V.tfidf_weights(by_doc, "counts", widest.vocab, "msg_id")
    assert key(joined.collect()) == a and sorted(map(str, V.encode_and_pad(toks, "msg_id", "t", vocab, 9).collect())) == b


def test_default_tokens_and_one_hot(spark):
    df = spark.createDataFrame([("a bc x1 é déjà_vu",)], "t string")
    assert df.select(A._default(F.col("t"))).collect()[0][0] == ["bc", "x1", "déjà_vu"]
    sources = spark.createDataFrame([("p", 0), ("q", 1)], "source string, idx int")
    rows = spark.createDataFrame([(1, "q"), (2, None), (3, "z")], "msg_id long, source string")
    got = {r["msg_id"]: (r["source_index"], r["onehot"]) for r in A.one_hot_sources(rows, sources).collect()}
    assert got == {1: (1, "0,1"), 2: (-1, "0,0"), 3: (-1, "0,0")}


def test_a_stream_scored_by_fitted_models_equals_the_batch(spark, tmp_path):
    from msgscope.plans.q_assembled import FittedModels
    from msgscope.streaming.scoring import stream_scored

    fitted = FittedModels(spark, "/root/testdata/sf0.001")
    conv = spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(["free money!!!", "see you at noon", "x", None, "WIN $100 now www.spam.com", "hello there"])], "conv_id long, turn int, role string, text string")
    conv.repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    key = lambda r: (r["model_id"], r["msg_id"])
    batch = sorted(fitted.score(conv.select((F.col("conv_id") * 1000).alias("msg_id"), "text")).collect(), key=key)
    stream = sorted(stream_scored(spark, f"{tmp_path}/conversations.parquet", conv.schema, fitted.score, 1).collect(), key=key)
    assert [(*key(r), r["p"], r["prediction"]) for r in batch] == [(*key(r), r["p"], r["prediction"]) for r in stream]
    assert {r["msg_id"] for r in batch} == {0, 1000, 4000, 5000} and len(batch) == 8  # shorter than three characters: dropped
    assert all(0 <= r["p"] <= 1 for r in batch)
