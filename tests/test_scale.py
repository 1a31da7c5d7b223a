"""Behaviour that must not depend on size, skew, nulls or file layout."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from msgscope.functions import text as T
from msgscope.functions.features import family_a, family_c
from msgscope.operators import clustering as CL
from msgscope.operators import metrics as MT
from msgscope.operators import sampling as SM
from msgscope.operators import vectorize as V
from msgscope.operators.scoring import score_with_models, summarize_batch
from msgscope.plans.rules import RULE_MODELS
from msgscope.streaming.lockout import lockout_batch
from msgscope.streaming.scoring import stream_lockout, stream_score


@pytest.fixture(scope="module")
def nulls(spark):
    """1 000 rows, 100 of them without a source, most of one stratum."""
    rows = [(i, None if i % 10 == 0 else "hot" if i % 3 else f"s{i % 7}", int(i % 4 == 0)) for i in range(1000)]
    return spark.createDataFrame(rows, "msg_id long, source string, label int")


def test_no_row_is_lost_to_a_null_source(spark, nulls):
    split = SM.stratified_split(nulls)
    assert split.count() == 1000 and split.where("split = 'test'").count() == 200
    folds = SM.kfold_assign(nulls).groupBy("fold").count().collect()
    assert sorted(r["count"] for r in folds) == [200] * 5
    kept = SM.rebalance(nulls, {"hot": 0.5}, 1.0)
    assert kept.where("source IS NULL").count() == 100
    hot = kept.where("source = 'hot'").groupBy("label").count().collect()
    assert len({r["count"] for r in hot}) == 1
    scored = nulls.withColumn("score", (F.col("msg_id") % 11) / 10)
    assert MT.with_running_totals(MT.distinct_scores(scored, group_cols=["source"]), ["source"]).where("source IS NULL").count() == 11


def test_split_by_label_only(nulls):
    got = {r["label"]: r["n"] for r in SM.stratified_split(nulls, strata=["label"]).where("split = 'test'").groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert got == {0: 150, 1: 50}


def test_ranking_in_many_buckets_equals_one(spark, nulls):
    from msgscope.operators.ranking import rank_within

    key = lambda d: sorted((r["msg_id"], r["rank_in_stratum"], r["stratum_size"]) for r in d.collect())
    assert key(rank_within(nulls, ["source", "label"], "msg_id", 1)) == key(rank_within(nulls, ["source", "label"], "msg_id", 1, rows_per_bucket=3))


def test_the_rows_are_never_dealt_by_the_stratum_alone(spark, nulls):
    plan = SM.stratified_split(nulls)._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning(" in x]
    rows = [x for x in dealt if "__bucket" in x.split("ENSURE")[0]]
    assert rows and plan.count("row_number()") >= 1
    # what is dealt by the stratum alone comes from the table of buckets
    assert all("hashpartitioning(source" not in x for x in dealt)


def test_accents_digits_and_clusters(spark):
    df = spark.createDataFrame([("tiếng Việt Ångström naïve",), ("x² ٣ ①a",), ("plain",)], "t string")
    got = [r[0] for r in df.select(T.strip_accents(F.col("t"))).collect()]
    assert got[0] == "tieng Viet Angstrom naive" and got[2] == "plain"
    digits = dict(family_a(F.col("t")))["digit_count"]
    assert [r[0] for r in df.select(digits).collect()] == [sum(c.isdigit() for c in t) for t in ("tiếng Việt Ångström naïve", "x² ٣ ①a", "plain")]
    ratio = dict(family_c(F.col("t")))["digit_ratio"]
    assert abs(df.select(ratio).collect()[1][0] - 3 / 7) < 1e-9
    points = spark.createDataFrame([(i, [float(i % 65), 1.0], i % 65) for i in range(650)], "id long, x array<double>, c int")
    assert len(CL.centroids(points, "x", "c")) == 65


def test_term_counts_in_a_row(spark):
    df = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, ["a"])], "id long, terms array<string>")
    got = V.term_frequencies(df.select("id", V.counted(F.col("terms")).alias("c")), "id", "c").collect()
    assert sorted(map(tuple, got)) == [(1, "a", 1), (1, "b", 2), (3, "a", 1)]


def test_models_are_scored_in_one_scan(spark, tmp_path):
    df = spark.createDataFrame([(1, "HELLO!!"), (2, "hello"), (3, None)], "msg_id long, text string")
    df.write.parquet(f"{tmp_path}/m.parquet")
    src = spark.read.parquet(f"{tmp_path}/m.parquet")
    preds = score_with_models(src, RULE_MODELS | {"broken": ("no", "number", "fits")})
    assert preds.count() == 9
    assert preds._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    none = summarize_batch(score_with_models(src, {"broken": (1, 2, 3)}), ["broken"]).collect()[0]
    assert (none["predictions"], none["spam"], none["avg_confidence"]) == (0, 0, 0.0)


def test_streams_read_tables_of_several_files(spark, tmp_path):
    conv = spark.createDataFrame([(i, i % 5, "user" if i % 2 else "assistant", f"TEXT {i}!" if i % 3 else "text") for i in range(40)], "conv_id long, turn int, role string, text string")
    conv.repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    got = stream_score(spark, f"{tmp_path}/conversations.parquet", conv.schema, RULE_MODELS, 1)
    batch = score_with_models(conv.select((F.col("conv_id") * 1000 + F.col("turn")).alias("msg_id"), "text"), RULE_MODELS)
    cols = ["model_id", "msg_id", "p", "prediction"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, batch.select(cols).collect()))
    assert got.select("batch_id").distinct().count() == 4


START = dt.datetime(2024, 1, 1)
#: seconds, success, what the rules say: three failures lock for 30 s after the
#: third; locked events don't count; the first at or after the end starts anew.
EVENTS = [
    (0, False, "failed", 1), (5, False, "failed", 2), (10, False, "failed", 3), (11, True, "locked", 3), (39, False, "locked", 3),
    (40, False, "failed", 1), (50, True, "ok", 0), (60, False, "failed", 1), (61, False, "failed", 2), (62, True, "ok", 0),
    (63, False, "failed", 1), (64, False, "failed", 2), (65, False, "failed", 3), (94, True, "locked", 3), (95, True, "ok", 0),
]


def lockout_events(spark):
    rows = [(k * 100 + i, k, START + dt.timedelta(seconds=s), ok) for k in (1, 2) for i, (s, ok, _, _) in enumerate(EVENTS)]
    return spark.createDataFrame(rows, "event_id long, identifier long, ts timestamp, success boolean")


def test_lockout_reaches_locked_expiry_and_success(spark):
    got = {r["event_id"]: (r["decision"], r["attempts"]) for r in lockout_batch(lockout_events(spark)).collect()}
    assert got == {k * 100 + i: (d, n) for k in (1, 2) for i, (_, _, d, n) in enumerate(EVENTS)}


def test_lockout_state_lives_across_files(spark, tmp_path):
    ev = lockout_events(spark).select("event_id", F.col("identifier").alias("user_id"), "ts", F.when(F.col("success"), "signup").otherwise("error").alias("event_type"))
    # four files in time order: locks and counts carry over
    for part in range(4):
        own = ev.where((F.col("event_id") % 100 >= part * 4) & (F.col("event_id") % 100 < part * 4 + 4)).coalesce(1)
        own.write.mode("append").parquet(f"{tmp_path}/events.parquet")
    got = stream_lockout(spark, f"{tmp_path}/events.parquet", ev.schema, 1)
    assert {r["event_id"]: (r["decision"], r["attempts"]) for r in got.collect()} == {k * 100 + i: (d, n) for k in (1, 2) for i, (_, _, d, n) in enumerate(EVENTS)}


@pytest.mark.parametrize("chunk_s", [40, 3600])
def test_lockout_in_chunks_equals_one_fold(spark, chunk_s):
    import random

    import pandas as pd

    from msgscope.streaming import lockout as L

    rng = random.Random(3)
    rows, at = [], 0
    for i in range(3000):
        at += rng.choice([0, 0, 1, 2, 5, 9, 31, 200]) if rng.random() < 0.9 else rng.randrange(4000)
        rows.append((i, rng.choice([1, 1, 1, 2]), START + dt.timedelta(seconds=at), rng.random() < 0.15))
    got = {r["event_id"]: (r["decision"], r["attempts"], r["lockout_until_us"]) for r in lockout_batch(spark.createDataFrame(rows, "event_id long, identifier long, ts timestamp, success boolean"), chunk_s * 1_000_000).collect()}
    want = {}
    for k in (1, 2):
        own = [r for r in rows if r[1] == k]
        pdf = pd.DataFrame({"event_id": [r[0] for r in own], "identifier": k, "ts_us": [int(r[2].replace(tzinfo=dt.timezone.utc).timestamp()) * 1_000_000 for r in own], "success": [r[3] for r in own]})
        for r in L.fold(pdf)[0].itertuples():
            want[r.event_id] = (r.decision, r.attempts, r.lockout_until_us)
    assert got == want and any(d == "locked" for d, _, _ in want.values())


def test_newest_first_in_many_ranges(spark):
    from msgscope.operators.ranking import rank_newest

    rows = [(i, "u" if i % 3 else None, START + dt.timedelta(minutes=(i * 37) % 50)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, user_id string, created_at timestamp")
    for size in (7, 1 << 20):
        got = {r["id"]: r["rank"] for r in rank_newest(df, ["user_id"], "created_at", "id", "rank", size).collect()}
        for user in ("u", None):
            order = sorted((r for r in rows if r[1] == user), key=lambda r: (r[2], r[0]), reverse=True)
            assert [got[r[0]] for r in order] == list(range(1, len(order) + 1))
