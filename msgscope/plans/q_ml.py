"""Registered queries: Spark ML fits and scoring (rows-only checks: model
fits are not SQL-expressible).  Each query fits on the training split of the
exact stratified split, saves the pipeline, reloads it, scores the test split."""

from __future__ import annotations

from pyspark.sql import functions as F

from msgscope.functions import patterns as P
from msgscope.functions.features import FAMILY_B_NAMES, FAMILY_C_ORDER, family_b, family_c, features_of
from msgscope.functions.text import clean_email_artifacts
from msgscope.operators import clustering as CL
from msgscope.operators import metrics as MT
from msgscope.operators import models as ML
from msgscope.operators.sampling import stratified_split
from msgscope.plans import sqlparts as S
from msgscope.plans.frames import cleaned
from msgscope.plans.registry import query
from msgscope.session import materialize


W2V_PARTITIONS = 8  # tasks of an embedding fit; raise it with the corpus


def _split_features(spark, d, family: str):
    c = cleaned(spark, d)
    keep = ["msg_id", "label", "source"]
    if family == "c":
        f = features_of(c.select(*keep, clean_email_artifacts(F.col("cleaned_text")).alias("e")), family_c, FAMILY_C_ORDER, "e", keep)
    else:
        f = c.select(*keep, *[x.alias(n) for n, x in family_b(F.col("cleaned_text"))])
    return materialize(stratified_split(f))


def _long(spark, pairs):
    return spark.createDataFrame([(k, float(v) if v is not None else None) for k, v in pairs], "metric string, value double")


@query("kmeans_fit")
def kmeans_fit(spark, d):
    """ML-01/02/03/06/15/19 + AGG-28/29/31: k=3 on scaled family-C features,
    10 seeds; cluster->class mapping learned on train, applied to test."""
    f = _split_features(spark, d, "c")
    feats = [n for n in FAMILY_C_ORDER]
    model, cost = ML.fit_kmeans(f.where("split = 'train'"), feats, k=3, n_init=10)
    model = ML.save_and_reload(model, ML.model_path(spark, "kmeans"))
    train = model.transform(f.where("split = 'train'")).select("label", "cluster_id")
    test = model.transform(f.where("split = 'test'")).select("msg_id", "label", "source", "cluster_id")
    mapping = train.groupBy("cluster_id").agg(F.avg("label").alias("cluster_rate"))
    scored = test.join(mapping, "cluster_id", "left").withColumn(
        "prediction", F.when(F.col("cluster_rate") > 0.5, 1).otherwise(0)
    ).withColumn("cluster_rate", F.coalesce("cluster_rate", F.lit(0.5)))
    m = MT.prf(MT.counts(scored)).first()
    a = MT.auc_ap(MT.score_table(scored, score="cluster_rate")).first()
    ari = CL.ari_nmi(test, "label", "cluster_id").first()
    return _long(
        spark,
        [("training_cost", cost), ("accuracy", m.accuracy), ("precision", m.precision), ("recall", m.recall),
         ("f1", m.f1), ("roc_auc", a.roc_auc), ("average_precision", a.average_precision), ("ari", ari.ari), ("nmi", ari.nmi)],
    )


def _gbt(spark, d):
    f = _split_features(spark, d, "b")
    model = ML.fit_gbt(f.where("split = 'train'"), FAMILY_B_NAMES)
    model = ML.save_and_reload(model, ML.model_path(spark, "gbt"))
    return f, model


@query("gbt_fit")
def gbt_fit(spark, d):
    """ML-08/12/14/16: boosted trees on family-B features; test metrics at
    0.5 and at the F1-optimal threshold."""
    f, model = _gbt(spark, d)
    scored = materialize(ML.spam_probability(model.transform(f.where("split = 'test'"))))
    m = MT.prf(MT.counts(scored)).first()
    st = MT.score_table(scored)
    a = MT.auc_ap(st).first()
    b = MT.best_threshold(st).first()
    return _long(
        spark,
        [("accuracy", m.accuracy), ("precision", m.precision), ("recall", m.recall), ("f1", m.f1),
         ("roc_auc", a.roc_auc), ("average_precision", a.average_precision),
         ("best_threshold", b.threshold if b else None), ("f1_at_best", b.f1 if b else None)],
    )


@query("gbt_importance")
def gbt_importance(spark, d):
    """ML-13, TOP-04: the 15 most important features by name."""
    _f, model = _gbt(spark, d)
    return ML.importances(spark, model, FAMILY_B_NAMES).orderBy(F.col("importance").desc(), "feature").limit(15)


@query("pca_2d")
def pca_2d(spark, d):
    """VEC-08/09: two principal components of scaled family-C features fitted
    on train, test points scaled into 0..100 by the train ranges."""
    f = _split_features(spark, d, "c")
    model, signs, var = ML.fit_pca_2d(f.where("split = 'train'"), FAMILY_C_ORDER)
    model = ML.save_and_reload(model, ML.model_path(spark, "pca"))
    tr = ML.pc_columns(model.transform(f.where("split = 'train'")), signs)
    te = ML.pc_columns(model.transform(f.where("split = 'test'")), signs)
    r = tr.agg(F.min("px").alias("x0"), F.max("px").alias("x1"), F.min("py").alias("y0"), F.max("py").alias("y1"))

    def sc(v, lo, hi):
        return F.when(F.col(hi) > F.col(lo), F.least(F.lit(100.0), F.greatest(F.lit(0.0), (F.col(v) - F.col(lo)) / (F.col(hi) - F.col(lo)) * 100))).otherwise(F.lit(50.0))

    out = CL.attach_one_row(te.select("msg_id", "px", "py"), r)
    return out.select(
        "msg_id", sc("px", "x0", "x1").alias("x_scaled"), sc("py", "y0", "y1").alias("y_scaled"),
        F.lit(var[0]).alias("explained_var_1"), F.lit(var[1]).alias("explained_var_2"),
    )


SQL_CLUSTER_VOCAB = f"""
WITH cdocs AS (SELECT msg_id, cleaned_text FROM (SELECT doc_id AS msg_id, {S.clean_text('text')} AS cleaned_text FROM documents)
               WHERE length(cleaned_text) >= {P.MIN_CLEAN_LENGTH}),
e AS (SELECT msg_id, {S.clean_email_artifacts('cleaned_text')} AS e FROM cdocs),
f AS (SELECT msg_id, {S.filter_source_artifacts('e')} AS f FROM e),
t0 AS (SELECT msg_id, {S.tokens('lower(f)', P.TFIDF_TOKEN)} AS t0 FROM f),
t1 AS (SELECT msg_id, list_filter(t0, lambda w: NOT list_contains([{', '.join(S.lit(w) for w in P.ENGLISH_STOP_WORDS)}], w)) AS toks FROM t0),
terms AS (SELECT msg_id, {S.with_bigrams('toks')} AS terms FROM t1),
tf AS (SELECT msg_id, term, count(*) AS tf FROM (SELECT msg_id, unnest(terms) AS term FROM terms) GROUP BY 1, 2),
nd AS (SELECT count(*) AS n FROM cdocs),
dfs AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY term)
SELECT term, CAST(df AS BIGINT) AS df, CAST(cf AS BIGINT) AS cf, round(ln(CAST(1 + n AS DOUBLE) / CAST(1 + df AS DOUBLE)) + 1, 6) AS idf,
       list_contains([{', '.join(S.lit(a) for a in P.SOURCE_ARTIFACTS)}], term) AS artifact_leak
FROM dfs, nd WHERE df >= 5 AND df <= 0.6 * n ORDER BY cf DESC, term ASC LIMIT 500
"""


@query("tfidf_cluster_vocab", SQL_CLUSTER_VOCAB)
def tfidf_cluster_vocab(spark, d):
    """VEC-03/04, TXT-13/14/20: clustering TF-IDF - e-mail artefacts and source
    artefact words removed, English stop words (pinned list), uni+bigrams,
    min_df 5, max_df 0.6, 500 terms.  ``artifact_leak`` counts artefact
    tokens that reached the vocabulary (expected 0)."""
    from msgscope.functions import text as T
    from msgscope.operators import vectorize as V
    from msgscope.plans.frames import documents
    from msgscope.operators.cleaning import clean_messages

    c = clean_messages(documents(spark, d)).select("msg_id", "cleaned_text")
    f = c.select("msg_id", T.filter_source_artifacts(clean_email_artifacts(F.col("cleaned_text"))).alias("f"))
    toks = f.select("msg_id", T.tfidf_tokens(F.col("f")).alias("toks"))
    by_doc = materialize(toks.select("msg_id", F.filter("toks", lambda w: ~w.isin(P.ENGLISH_STOP_WORDS)).alias("kept")))
    limits = (by_doc.count(), 500, 5, 0.6)
    vocab = V.fit_tfidf_vocabulary(V.likely_totals(by_doc, "kept", *limits), *limits)
    arts = F.array(*[F.lit(a) for a in P.SOURCE_ARTIFACTS])
    return vocab.select(
        "term", "df", "cf", F.round("idf", 6).alias("idf"), F.array_contains(arts, F.col("term")).alias("artifact_leak")
    )


#: A short search: all parameters are drawn, but trees are few and shallow.
TRIALS, SEARCH_FOLDS = 5, 3
SEARCH_BOUNDS = {"maxIter": (4, 12), "stepSize": (0.02, 0.3), "maxDepth": (2, 4), "minInfoGain": (0.0, 0.05)}
_trial_tables: dict[tuple[str, str], str] = {}


def _trials(spark, d):
    """The trial table, fitted once an application and saved."""
    from pyspark.ml.feature import VectorAssembler

    from msgscope.operators import search as SE
    from msgscope.operators.sampling import kfold_assign

    key = (spark.sparkContext.applicationId, d)
    if key not in _trial_tables:
        train = _split_features(spark, d, "b").where("split = 'train'")
        folds = kfold_assign(train.select("msg_id", "label", "source"), k=SEARCH_FOLDS).select("msg_id", (F.col("fold") - 1).alias("fold"))
        x = VectorAssembler(inputCols=FAMILY_B_NAMES, outputCol="features", handleInvalid="keep").transform(train.join(folds, "msg_id"))
        found = SE.run_trials(materialize(x.select("label", "features", "fold")), SE.draw(TRIALS, 42, **SEARCH_BOUNDS), SEARCH_FOLDS)
        path = ML.model_path(spark, "trials")
        found.write.parquet(path)
        _trial_tables[key] = path
    return spark.read.parquet(_trial_tables[key])


@query("gbt_search")
def gbt_search(spark, d):
    """ML-09/10, TOP-05, SMP-04: random search of boosted trees on the exact
    stratified folds, scored by average precision; the ten best trials."""
    from msgscope.operators import search as SE

    return SE.ranked(_trials(spark, d), 10)


@query("search_summary")
def search_summary(spark, d):
    """AGG-37: the parameters of the 20 best trials."""
    from msgscope.operators import search as SE

    return SE.parameter_summary(_trials(spark, d), 20)


@query("gbt_importance_types")
def gbt_importance_types(spark, d):
    """AGG-32/33: importance totals by name fragment, and by the six types, of
    the trees on the assembled features."""
    from msgscope.operators.stats import importance_by_fragment
    from msgscope.plans.q_assembled import named_importances

    imp = materialize(named_importances(spark, d))
    parts = {"fragment": P.IMPORTANCE_FRAGMENTS, "type": P.IMPORTANCE_TYPES}
    out = [importance_by_fragment(imp, names).withColumn("list", F.lit(k)) for k, names in parts.items()]
    return out[0].unionByName(out[1])


@query("gbt_early_stop")
def gbt_early_stop(spark, d):
    """ML-11/12, SMP-03: retrain boosted trees with early stopping on a 10 %
    stratified validation split of the training rows (validationIndicatorCol
    + validationTol), then report the trees kept and test metrics."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    f = _split_features(spark, d, "b")
    train = f.where("split = 'train'").drop("split")
    val = stratified_split(train, test_size=0.1).select("msg_id", (F.col("split") == "test").alias("is_val"))
    data = VectorAssembler(inputCols=FAMILY_B_NAMES, outputCol="features", handleInvalid="keep").transform(
        train.join(val, "msg_id")
    )
    gbt = GBTClassifier(
        labelCol="label", featuresCol="features", maxIter=200, maxDepth=5, stepSize=0.1, seed=42,
        validationIndicatorCol="is_val", validationTol=0.01,
    )
    model = gbt.fit(data)
    test = VectorAssembler(inputCols=FAMILY_B_NAMES, outputCol="features", handleInvalid="keep").transform(
        f.where("split = 'test'")
    )
    scored = materialize(ML.spam_probability(model.transform(test)))
    m = MT.prf(MT.counts(scored)).first()
    st = MT.score_table(scored)
    a = MT.auc_ap(st).first()
    b = MT.best_threshold(st).first()
    return _long(
        spark,
        [("trees_kept", model.getNumTrees), ("accuracy", m.accuracy), ("f1", m.f1), ("roc_auc", a.roc_auc),
         ("average_precision", a.average_precision), ("best_threshold", b.threshold if b else None),
         ("f1_at_best", b.f1 if b else None), ("f1_gain_vs_0_5", (b.f1 - m.f1) if b else None)],
    )


@query("sequence_classifier")
def sequence_classifier(spark, d):
    """ML-17 re-aimed: sequence tokens -> ids of the bounded vocabulary (others
    are the unknown id) -> Word2Vec mean embedding over the whole text, fitted in
    several partitions -> logistic regression; one saved pipeline, test metrics."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import Word2Vec

    from msgscope.functions import text as T
    from msgscope.operators import vectorize as V

    c = cleaned(spark, d).select(
        "msg_id", "label", "source", T.sequence_tokens(T.clean_for_sequence(F.col("cleaned_text"))).alias("words")
    )
    c = materialize(stratified_split(c))  # read by the vocabulary, the ids and their join
    vocab = materialize(V.build_token_vocabulary(c.where("split = 'train'"), "words", 10000, 2))
    ids = V.encode(c, "msg_id", "words", vocab)
    toks = materialize(
        c.select("msg_id", "label", "split").join(ids, "msg_id").select("msg_id", "label", "split", F.col("ids").cast("array<string>").alias("toks"))
    )
    pipe = Pipeline(
        stages=[
            Word2Vec(inputCol="toks", outputCol="features", vectorSize=64, minCount=1, seed=42, maxIter=1, numPartitions=W2V_PARTITIONS),
            LogisticRegression(labelCol="label", featuresCol="features", maxIter=100),
        ]
    )
    model = ML.save_and_reload(pipe.fit(toks.where("split = 'train'")), ML.model_path(spark, "seq"))
    scored = materialize(ML.spam_probability(model.transform(toks.where("split = 'test'"))))
    m = MT.prf(MT.counts(scored)).first()
    a = MT.auc_ap(MT.score_table(scored)).first()
    return _long(
        spark,
        [("accuracy", m.accuracy), ("precision", m.precision), ("recall", m.recall), ("f1", m.f1),
         ("roc_auc", a.roc_auc), ("average_precision", a.average_precision)],
    )
