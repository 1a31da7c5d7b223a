"""Registered queries: features fitted on the training rows and applied to
held-out ones, and models on them (VEC-01..06, F-62, ML-01..08, ML-15/19)."""

from __future__ import annotations

import os

from pyspark.sql import Window
from pyspark.sql import functions as F

from msgscope.functions import patterns as P
from msgscope.functions.features import FAMILY_B_NAMES
from msgscope.operators import assemble as A
from msgscope.operators import matrix as M
from msgscope.operators import metrics as MT
from msgscope.operators import models as ML
from msgscope.operators import sweep as SW
from msgscope.operators.cleaning import clean_messages
from msgscope.operators.sampling import stratified_split
from msgscope.plans import sqlfeatures as SF
from msgscope.plans import sqlparts as S
from msgscope.plans.frames import SQL_CLEANED, SQL_MESSAGES, cleaned, with_ctes
from msgscope.plans.q_sampling import SQL_SPLIT
from msgscope.plans.registry import query
from msgscope.session import materialize
from msgscope.sources.tables import read_table


def split_rows(spark, d):
    """(msg_id, label, source, cleaned_text, split)."""
    rows = materialize(cleaned(spark, d).select("msg_id", "label", "source", "cleaned_text"))
    split = stratified_split(rows.select("msg_id", "label", "source")).select("msg_id", "split")
    return materialize(rows.join(split, "msg_id"))


def _fitted(spark, d, kind: str):
    """The rows and a feature model fitted on the training part, saved and reloaded."""
    rows = split_rows(spark, d)
    path = ML.model_path(spark, f"features-{kind}")
    A.fit(rows.where("split = 'train'"), kind).save(path)
    return rows, A.load(spark, path)


_FILTERED = S.filter_source_artifacts(S.clean_email_artifacts("cleaned_text"))
_STOP = ", ".join(S.lit(w) for w in P.ENGLISH_STOP_WORDS)
SQL_TOKENS = {
    "basic": S.tokens("lower(cleaned_text)", P.DEFAULT_TFIDF_TOKEN),
    "trees": S.tokens(S.strip_accents("lower(cleaned_text)"), P.TFIDF_TOKEN),
    "clusters": f"list_filter({S.tokens(f'lower({_FILTERED})', P.TFIDF_TOKEN)}, lambda w: NOT list_contains([{_STOP}], w))",
}


def _sql_heldout(kind: str) -> str:
    spec = A.SPECS[kind]
    return with_ctes(SQL_MESSAGES, SQL_CLEANED, SQL_SPLIT) + f""",
rows AS (SELECT c.*, s.split FROM cleaned c JOIN split s ON c.msg_id = s.msg_id),
toks AS (SELECT msg_id, split, {SQL_TOKENS[kind]} AS toks FROM rows),
terms AS (SELECT msg_id, split, unnest({S.with_bigrams('toks')}) AS term FROM toks),
tf AS (SELECT msg_id, split, term, count(*) AS tf FROM terms GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf WHERE split = 'train' GROUP BY term),
nd AS (SELECT count(*) AS n FROM rows WHERE split = 'train'),
top AS (SELECT term, ln(CAST(1 + n AS DOUBLE) / CAST(1 + df AS DOUBLE)) + 1 AS idf FROM dfs, nd
        WHERE df >= {spec.min_df} AND df <= {spec.max_df} * n ORDER BY cf DESC, term LIMIT {spec.max_features}),
vocab AS (SELECT *, row_number() OVER (ORDER BY term) - 1 AS idx FROM top),
w AS (SELECT t.msg_id, t.term, v.idx, (1 + ln(t.tf)) * v.idf AS w FROM tf t JOIN vocab v ON t.term = v.term WHERE t.split = 'test'),
tfidf AS (SELECT msg_id, term, idx, w / sqrt(sum(w * w) OVER (PARTITION BY msg_id)) AS weight FROM w)"""


def _sql_clean(sql: str) -> str:
    return sql.replace("\n,\nrows AS", ",\nrows AS")


def _heldout_query(kind: str, name: str):
    @query(name, _sql_clean(_sql_heldout(kind)) + "\nSELECT msg_id, term, round(weight, 6) AS weight FROM tfidf")
    def build(spark, d):
        rows, model = _fitted(spark, d, kind)
        return model.tfidf(rows.where("split = 'test'")).select("msg_id", "term", F.round("weight", 6).alias("weight"))

    return build


tfidf_heldout_basic = _heldout_query("basic", "tfidf_heldout_basic")
tfidf_heldout = _heldout_query("trees", "tfidf_heldout")
tfidf_heldout_clusters = _heldout_query("clusters", "tfidf_heldout_clusters")

_NUMERIC = dict(SF.family_b("cleaned_text"))
SQL_SOURCES = """,
nt AS (SELECT count(*) AS n_terms FROM vocab),
cats AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS idx FROM (SELECT DISTINCT source FROM rows WHERE split = 'train' AND source IS NOT NULL))"""
SQL_TREES = _sql_clean(_sql_heldout("trees")) + SQL_SOURCES + f""",
num AS (SELECT msg_id, [{', '.join(f'CAST({_NUMERIC[n]} AS DOUBLE)' for n in FAMILY_B_NAMES)}] AS x FROM rows WHERE split = 'test'),
numl AS (SELECT msg_id, unnest(range(0, {len(FAMILY_B_NAMES)})) AS pos, unnest(x) AS value FROM num),
entries AS (
  SELECT msg_id, CAST(idx AS INTEGER) AS idx, round(weight, 6) AS value FROM tfidf
  UNION ALL SELECT msg_id, CAST(pos + n_terms AS INTEGER), round(value, 6) FROM numl, nt WHERE value <> 0
  UNION ALL SELECT r.msg_id, CAST(c.idx + n_terms + {len(FAMILY_B_NAMES)} AS INTEGER), 1.0 FROM rows r JOIN cats c ON r.source = c.source, nt WHERE r.split = 'test'),
names AS (
  SELECT CAST(idx AS INTEGER) AS idx, 'tfidf_' || term AS feature FROM vocab
  UNION ALL SELECT CAST(n_terms + i AS INTEGER), name FROM nt, (VALUES {', '.join(f"({i}, '{n}')" for i, n in enumerate(FAMILY_B_NAMES))}) v(i, name)
  UNION ALL SELECT CAST(n_terms + {len(FAMILY_B_NAMES)} + idx AS INTEGER), 'source_' || source FROM cats, nt)
"""
SQL_ASSEMBLED = SQL_TREES + "SELECT * FROM entries"


@query("assembled_features", SQL_ASSEMBLED)
def assembled_features(spark, d):
    """VEC-05, F-60..62: TF-IDF, numeric and source columns of the held-out rows."""
    rows, model = _fitted(spark, d, "trees")
    return model.transform(rows.where("split = 'test'")).select("msg_id", "idx", F.round("value", 6).alias("value"))


SQL_NAMES = SQL_TREES + "SELECT * FROM names"


@query("assembled_names", SQL_NAMES)
def assembled_names(spark, d):
    """VEC-06: the name of every column of the assembled features."""
    _rows, model = _fitted(spark, d, "trees")
    return model.names()


SAMPLED_COLUMNS = 5000
SQL_MATRIX = SQL_TREES + f"""SELECT e.msg_id, d.feature, e.value FROM entries e
JOIN (SELECT * FROM names ORDER BY md5('42:' || feature), feature LIMIT {SAMPLED_COLUMNS}) d ON e.idx = d.idx"""


@query("stored_matrix", SQL_MATRIX)
def stored_matrix(spark, d):
    """SNK-04, SRC-10: the held-out rows' matrix, written and read back in the
    columns drawn by seed."""
    rows, model = _fitted(spark, d, "trees")
    path = ML.model_path(spark, "matrix")
    model.write_matrix(rows.where("split = 'test'"), path)
    return M.sampled(spark, path, SAMPLED_COLUMNS, P.DEFAULT_SEED, ["msg_id"]).select("msg_id", "feature", F.round("value", 6).alias("value"))


# ------------------------------------------------------------------ models on them
def _metrics(spark, scored):
    d1 = MT.distinct_scores(scored)
    m = MT.prf(MT.counts_at(d1)).first()
    a = MT.auc_ap(MT.with_running_totals(d1)).first()
    pairs = [(k, m[k]) for k in ("accuracy", "precision", "recall", "f1")] + [(k, a[k]) for k in ("roc_auc", "average_precision")]
    return spark.createDataFrame([(k, float(v) if v is not None else None) for k, v in pairs], "metric string, value double")


def _trees(spark, d):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier

    rows, features = _fitted(spark, d, "trees")
    x = features.vectors(rows, ["label", "split"])
    train = x.where("split = 'train'")
    fitted = Pipeline(stages=[GBTClassifier(labelCol="label", maxIter=10, maxDepth=3, seed=42)]).fit(ML.for_trees(train))
    return x, features, ML.save_and_reload(fitted, ML.model_path(spark, "gbt-assembled"))


def named_importances(spark, d):
    """ML-13, JN-06: (feature, importance) of every assembled column, 0 if no tree uses it."""
    _x, features, model = _trees(spark, d)
    imp = model.stages[-1].featureImportances
    used = spark.createDataFrame([(int(i), float(v)) for i, v in zip(imp.indices, imp.values)], "idx int, importance double")
    return features.names().join(used, "idx", "left").select("feature", F.coalesce("importance", F.lit(0.0)).alias("importance"))


@query("gbt_assembled")  # a fit: rows only
def gbt_assembled(spark, d):
    """ML-08/14/15/16/19: boosted trees on the assembled sparse features."""
    x, _features, model = _trees(spark, d)
    return _metrics(spark, ML.spam_probability(model.transform(x.where("split = 'test'"))))


class FittedModels:
    """Two models on one feature model, all reloaded from their saved form."""

    def __init__(self, spark, d):
        from pyspark.ml import Pipeline
        from pyspark.ml.classification import LogisticRegression

        x, self.features, trees = _trees(spark, d)
        linear = Pipeline(stages=[LogisticRegression(labelCol="label", maxIter=50, regParam=0.01)]).fit(x.where("split = 'train'"))
        self.models = {"trees": trees, "linear": ML.save_and_reload(linear, ML.model_path(spark, "linear-assembled"))}

    def score(self, turns):
        """(model_id, msg_id, p, prediction) of rows (msg_id, text): cleaned and
        turned into features once, then through every model."""
        rows = materialize(clean_messages(turns.select("msg_id", "text", F.lit(None).cast("string").alias("source"))).select("msg_id", "cleaned_text", "source"))
        out = self.features.vectors(rows)
        for name, model in self.models.items():
            keep = [c for c in out.columns if c != "score"]
            out = ML.spam_probability(model.transform(out)).select(*keep, F.col("score").alias(name))
        pairs = F.array(*[F.struct(F.lit(n).alias("model_id"), F.col(n).alias("p")) for n in self.models])
        long = out.select("msg_id", F.explode(pairs).alias("s")).select("s.model_id", "msg_id", "s.p")
        return long.withColumn("prediction", (F.col("p") >= 0.5).cast("int"))


@query("score_fitted")  # fitted models: rows only
def score_fitted(spark, d):
    """BAT-01: every turn of the conversations scored by two fitted models; per
    model predictions, spam and means."""
    from msgscope.operators.scoring import summarize_batch

    turns = read_table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("msg_id"), "text")
    fitted = FittedModels(spark, d)
    return summarize_batch(fitted.score(turns), list(fitted.models))


@query("stream_fitted")  # fitted models: rows only
def stream_fitted(spark, d):
    """STR-01: the same over a file stream of the conversations."""
    from msgscope.operators.scoring import summarize_batch
    from msgscope.streaming.scoring import stream_scored

    fitted = FittedModels(spark, d)
    schema = read_table(spark, d, "conversations").schema
    preds = stream_scored(spark, os.path.join(d, "conversations.parquet"), schema, fitted.score, FILES_A_BATCH)
    return summarize_batch(preds.drop("batch_id"), list(fitted.models))


FILES_A_BATCH = 32
#: Configurations of the sweep (fixed values): most terms, weight of the sources.
SWEEP = {
    "current": (500, 0.0),
    "tfidf_50": (50, 0.0),
    "tfidf_100": (100, 0.0),
    "tfidf_1000": (1000, 0.0),
    "source_0.1": (500, 0.1),
    "source_0.3": (500, 0.3),
    "source_0.5": (500, 0.5),
}
SWEEP_K = range(2, 9)


@query("kmeans_assembled")  # a fit: rows only
def kmeans_assembled(spark, d):
    """ML-01/02/03/06, AGG-30: k-means on the assembled features, scaled once, ten
    seeds in shared passes; silhouette, agreement with the label and mapped accuracy."""
    rows, features = _fitted(spark, d, "clusters")
    path, name = ML.model_path(spark, "kmeans-assembled"), "assembled"
    features.write_matrix(rows, path, ["label", "split"])
    stored = spark.read.parquet(os.path.join(path, "rows"))
    x = stored.select(F.lit(name).alias("config"), "msg_id", "split", F.col("label").cast("int").alias("label"), "features.indices", "features.values")
    train = x.where("split = 'train'")
    scale = SW.scales(train, {name: features.size()}, unbiased=True)
    chosen = SW.best(SW.fit_all(train, scale, SW.starts(train, scale, range(3, 4))))
    fit = chosen[name][3]
    agree = {(r["split"], r["metric"]): r["value"] for r in _agreement(materialize(SW.assigned(x, scale, chosen))).collect()}  # some figures a split
    silhouette = SW.silhouettes(train, scale, chosen).get((name, 3, "train")) if (fit.counts > 0).sum() > 1 else None
    found = [("training_cost", fit.cost), ("silhouette", silhouette), *((m, agree.get(("test", m))) for m in ("accuracy", "f1", "ari", "nmi"))]
    return spark.createDataFrame([(k, float(v) if v is not None else None) for k, v in found], "metric string, value double")


def _sweep_rows(spark, d):
    """(config, msg_id, indices, values, split, label) of every configuration, and
    their widths.  The widest model is fitted and its matrix written once; the
    others' rows follow from it."""
    rows = materialize(A.prepared(split_rows(spark, d), A.SPECS["clusters"], ["msg_id", "label", "split"]))
    widest = A.fit(rows.where("split = 'train'"), "clusters", max(n for n, _ in SWEEP.values()))
    path = ML.model_path(spark, "sweep")
    widest.write_matrix(rows, os.path.join(path, "widest"), ["label", "split"])
    whole = spark.read.parquet(os.path.join(path, "widest", "rows")).select("msg_id", "split", F.col("label").cast("int").alias("label"), "features.indices", "features.values")
    models = {name: widest.narrowed(n, weight) for name, (n, weight) in SWEEP.items()}
    A.narrowed_rows(whole, widest, models).write.parquet(os.path.join(path, "rows"))
    return spark.read.parquet(os.path.join(path, "rows")), {name: m.size() for name, m in models.items()}


def _agreement(counts):
    """(config, k, split, metric, value) from the contingency tables: ARI, NMI, and
    on the test part the figures of the classifier that calls a cluster spam if
    more than half of its training rows are."""
    by = ["config", "k", "split"]
    pair = lambda x: x * (x - 1) / 2.0
    n, a, b = (F.sum("n").over(Window.partitionBy(*by, *more)).cast("double") for more in ([], ["label"], ["cluster"]))
    t = counts.withColumns({"all": n, "a": a, "b": b})
    p = F.col("n") / F.col("all")
    sums = t.groupBy(*by).agg(
        F.first("all").alias("n"), F.sum(pair(F.col("n"))).alias("both"),
        F.sum(pair(F.col("a")) * F.col("n") / F.col("a")).alias("one"), F.sum(pair(F.col("b")) * F.col("n") / F.col("b")).alias("two"),
        F.sum(p * F.log(F.col("n") * F.col("all") / (F.col("a") * F.col("b")))).alias("mi"),
        (-F.sum(p * F.log(F.col("a") / F.col("all")))).alias("hu"), (-F.sum(p * F.log(F.col("b") / F.col("all")))).alias("hv"),
    )
    chance = F.col("one") * F.col("two") / pair(F.col("n"))
    room, half = (F.col("one") + F.col("two")) / 2 - chance, (F.col("hu") + F.col("hv")) / 2
    ari = F.when(F.coalesce(room, F.lit(0.0)) == 0, 1.0).otherwise((F.col("both") - chance) / room)
    nmi = F.when(half == 0, 1.0).otherwise(F.col("mi") / half)
    agree = sums.select(*by, F.explode(F.create_map(F.lit("ari"), ari, F.lit("nmi"), nmi)).alias("metric", "value"))
    spam = counts.where("split = 'train'").groupBy("config", "k", "cluster").agg((F.sum(F.col("n") * F.col("label")) / F.sum("n") > 0.5).cast("int").alias("guess"))
    told = counts.where("split = 'test'").join(spam, ["config", "k", "cluster"], "left").withColumn("guess", F.coalesce("guess", F.lit(0)))
    cell = lambda label, guess: F.sum(F.when((F.col("label") == label) & (F.col("guess") == guess), F.col("n")).otherwise(0))
    hits = told.groupBy(*by).agg(cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(0, 0).alias("tn"))
    share = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    figures = {"accuracy": share(tp + tn, tp + fp + fn + tn), "precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "f1": share(2 * tp, 2 * tp + fp + fn)}
    told = hits.select(*by, F.explode(F.create_map(*[x for k, v in figures.items() for x in (F.lit(k), v)])).alias("metric", "value"))
    return agree.unionByName(told)


@query("k_sweep")  # fits: rows only
def k_sweep(spark, d):
    """ML-07, AGG-38, JN-08: k = 2..8 with ten seeds on all seven configurations, in
    shared passes; (config, k, split, metric, value) for every fit asked for, null
    where there is none."""
    rows, widths = _sweep_rows(spark, d)
    train = rows.where("split = 'train'")
    scale = SW.scales(train, widths)
    chosen = SW.best(SW.fit_all(train, scale, SW.starts(train, scale, SWEEP_K)))
    found = [(name, k, "train", "training_cost", f.cost) for name, fits in chosen.items() for k, f in fits.items()]
    found += [(name, k, split, "silhouette", v) for (name, k, split), v in SW.silhouettes(rows, scale, chosen).items()]
    schema = "config string, k int, split string, metric string, value double"
    results = spark.createDataFrame(found, schema).unionByName(_agreement(materialize(SW.assigned(rows, scale, chosen))))
    kinds = [("train", m) for m in ("training_cost", "silhouette", "ari", "nmi")] + [("test", m) for m in ("silhouette", "ari", "nmi", "accuracy", "precision", "recall", "f1")]
    asked = spark.createDataFrame([(n, k, *kind) for n in SWEEP for k in SWEEP_K for kind in kinds], "config string, k int, split string, metric string")
    return asked.join(results, ["config", "k", "split", "metric"], "left")
