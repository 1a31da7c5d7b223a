"""Operators against brute force and golden identities."""

import math

import pandas as pd
from pyspark.sql import functions as F

from msgscope.functions.features import family_a, family_c
from msgscope.operators import clustering as CL
from msgscope.operators import metrics as MT
from msgscope.operators import sampling as SM
from msgscope.operators import stats as ST
from msgscope.operators.ranking import exact_quantiles, rank_within


def test_rank_within_sub_buckets_equal_plain_row_number(spark):
    # one hot stratum (a third of the rows) and several small ones
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 7}", i % 2) for i in range(3000)]
    df = spark.createDataFrame(rows, "msg_id long, source string, label int")
    small = rank_within(df, ["source", "label"], "msg_id", 42, rows_per_bucket=16).select("msg_id", "rank_in_stratum")
    big = rank_within(df, ["source", "label"], "msg_id", 42).select("msg_id", F.col("rank_in_stratum").alias("r2"))
    j = small.join(big, "msg_id")
    assert j.where("rank_in_stratum <> r2").count() == 0
    assert j.count() == 3000


def test_split_and_folds_properties(spark):
    rows = [(i, f"s{i % 5}", int(i % 7 == 0)) for i in range(2000)]
    df = spark.createDataFrame(rows, "msg_id long, source string, label int")
    sp = SM.stratified_split(df, test_size=0.2).toPandas()
    assert len(sp) == 2000 and sp.msg_id.is_unique
    assert (sp.split == "test").sum() == math.ceil(0.2 * 2000)
    per = sp.groupby(["source", "label"]).apply(lambda g: (g.split == "test").sum() / len(g), include_groups=False)
    assert (per - 0.2).abs().max() < 0.05
    tr = spark.createDataFrame(sp[sp.split == "train"][["msg_id", "source", "label"]])
    f = SM.kfold_assign(tr, k=5).toPandas()
    sizes = f.fold.value_counts()
    assert sizes.max() - sizes.min() <= 1 and sorted(sizes.index) == [1, 2, 3, 4, 5]
    strat = f.groupby(["source", "label", "fold"]).size().unstack(fill_value=0)
    assert (strat.max(axis=1) - strat.min(axis=1)).max() <= 1


def test_golden_fold_sizes(spark):
    # 12 003 rows in 5 folds -> 2401 x3 + 2400 x2
    rows = [(i, f"s{i % 4}", int(i % 3 == 0)) for i in range(12003)]
    f = SM.kfold_assign(spark.createDataFrame(rows, "msg_id long, source string, label int"), k=5)
    assert sorted(r["count"] for r in f.groupBy("fold").count().collect()) == [2400, 2400, 2401, 2401, 2401]


def test_confusion_identities(spark):
    # stored cluster confusion: tn=2124 fp=1 fn=518 tp=569
    rows = [(0, 0)] * 2124 + [(0, 1)] * 1 + [(1, 0)] * 518 + [(1, 1)] * 569
    df = spark.createDataFrame(rows, "label int, prediction int")
    m = MT.prf(MT.counts(df)).first()
    assert abs(m.accuracy - 0.8384184) < 1e-6
    assert abs(m.precision - 0.9982456) < 1e-6
    assert abs(m.recall - 0.5234591) < 1e-6


def _brute_auc_ap(labels, scores):
    pos = [s for s, y in zip(scores, labels) if y == 1]
    neg = [s for s, y in zip(scores, labels) if y == 0]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    ap, prev_r = 0.0, 0.0
    for t in sorted(set(scores), reverse=True):
        tp = sum(1 for s, y in zip(scores, labels) if s >= t and y == 1)
        fp = sum(1 for s, y in zip(scores, labels) if s >= t and y == 0)
        r = tp / len(pos)
        ap += (r - prev_r) * (tp / (tp + fp))
        prev_r = r
    return auc, ap


def test_auc_ap_against_brute_force(spark):
    import random

    rnd = random.Random(7)
    labels = [rnd.randint(0, 1) for _ in range(400)]
    scores = [round(rnd.random() * 0.5 + 0.3 * y, 2) for y in labels]  # many ties
    df = spark.createDataFrame(list(zip(labels, scores)), "label int, score double")
    r = MT.auc_ap(MT.score_table(df)).first()
    auc, ap = _brute_auc_ap(labels, scores)
    assert abs(r.roc_auc - auc) < 1e-12 and abs(r.average_precision - ap) < 1e-12


def test_exact_quantiles_match_pandas(spark):
    vals = [float(x % 37) * 1.5 for x in range(501)]
    df = spark.createDataFrame([(v, i % 2) for i, v in enumerate(vals)], "v double, g int")
    q = exact_quantiles(df, "v", [0.25, 0.5, 0.95], ["g"]).toPandas().set_index("g").sort_index()
    pdf = pd.DataFrame({"v": vals, "g": [i % 2 for i in range(501)]})
    for g in (0, 1):
        want = pdf[pdf.g == g].v.quantile([0.25, 0.5, 0.95]).tolist()
        got = q.loc[g, ["q_0", "q_1", "q_2"]].tolist()
        assert all(abs(a - b) < 1e-9 for a, b in zip(got, want))


def test_ari_nmi_identities(spark):
    df = spark.createDataFrame([(i % 3, i % 3) for i in range(90)], "u int, v int")
    r = CL.ari_nmi(df, "u", "v").first()
    assert abs(r.ari - 1.0) < 1e-12 and abs(r.nmi - 1.0) < 1e-12


def test_p_value_known(spark):
    # r = 0.129357, n = 399 -> t ~ 2.60, two-sided p ~ 0.0097
    assert abs(ST.t_two_sided_p(0.129357 * math.sqrt(397 / (1 - 0.129357**2)), 397) - 0.0097) < 3e-4
    assert ST.t_two_sided_p(0.0, 10) == 1.0


def test_feature_type_rule(spark):
    names = ["offer_count", "source_sms", "url_count", "all_caps", "free_mentions", "grammar_errors", "flesch_approx"]
    df = spark.createDataFrame([(n,) for n in names], "f string")
    got = [r.t for r in df.select(ST.feature_type(F.col("f")).alias("t")).collect()]
    assert got == ["Text_Stats", "Source", "Text_Stats", "Formatting", "Commercial_Indicators", "Linguistic_Quality", "Other"]


def test_family_a_example(spark):
    df = spark.createDataFrame([("FREE prize!! Call now 555-12345 www.win.com",)], "t string")
    r = df.select(*[c.alias(n) for n, c in family_a(F.col("t"))]).first()
    assert r.char_count == 43 and r.word_count == 6 and r.money_count == 3 and r.has_url == 1 and r.has_phone == 1
    assert r.exclamation_count == 2 and r.consecutive_caps == 1 and r.max_word_repetition == 1


def test_family_c_counts(spark):
    df = spark.createDataFrame([("You have won! Click here to claim your free prize now. Dear friend, act now.",)], "t string")
    r = df.select(*[c.alias(n) for n, c in family_c(F.col("t"))]).first()
    assert r.sentence_count == 3 and r.incomplete_sentences == 3
    assert r.personal_pronouns == 2 and r.time_pressure == 2 and r.generic_greetings == 1 and r.free_count == 1
    assert r.spam_phrase_score == 3 + 2 + 3  # you have won, click here, act now


def test_importance_by_fragment(spark):
    imp = spark.createDataFrame(
        [("url_count", 0.5), ("char_count", 0.2), ("exclamation_ratio", 0.2), ("Upper_ratio", 0.1)],
        "feature string, importance double",
    )
    got = {r.fragment: (round(r.total_importance, 9), r["count"]) for r in ST.importance_by_fragment(imp, ["url", "char_count", "upper", "tfidf"]).collect()}
    assert got == {"url": (0.5, 1), "char_count": (0.2, 1), "upper": (0.1, 1)}
