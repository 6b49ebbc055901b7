"""MLlib training, scoring and evaluation.

Training inputs are per-client tables (one row per client); MLlib fits them
with its own distributed optimisers and tree learners.  Metrics are plain
aggregates over (actual, prediction) rows, so they also run on any prediction
table (``regression_metrics``, ``churn_metrics``, ``classification_report``)."""

from __future__ import annotations

import datetime as dt

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clientlens.operators import forest
from clientlens.operators.churn import temporal_split
from clientlens.schemas import require_columns
from clientlens.session import materialize
from clientlens.sources.commits import AppendTable, Versions

REV_NUM = ["nb_paiements", "actions_total", "sessions_total", "anciennete_jours"]
REV_CAT = ["plan", "ville"]
REV_TARGET = "ca_total"
CHURN_NUM = ["paid_count_before_T", "paid_sum_before_T", "days_since_last_paid"]
CHURN_CAT = ["plan", "ville"]
CHURN_TARGET = "churn_7_30j"


def _encoders(cat: list[str]):
    """StringIndexer(keep) + OneHotEncoder(dropLast): an unseen category is the
    dropped last slot, i.e. an all-zero block (sklearn ``handle_unknown='ignore'``)."""
    idx = StringIndexer(inputCols=cat, outputCols=[f"_{c}_idx" for c in cat],
                        handleInvalid="keep", stringOrderType="alphabetAsc")
    ohe = OneHotEncoder(inputCols=[f"_{c}_idx" for c in cat], outputCols=[f"_{c}_ohe" for c in cat],
                        dropLast=True, handleInvalid="keep")
    return [idx, ohe]


def preprocess_stages(num: list[str], cat: list[str], scale: bool) -> list:
    """M1: numeric block (optionally standardised) + one-hot categoricals -> ``features``."""
    stages = _encoders(cat)
    if scale:
        stages += [VectorAssembler(inputCols=num, outputCol="_num", handleInvalid="error"),
                   StandardScaler(inputCol="_num", outputCol="_num_s", withMean=True, withStd=True)]
        num_in = ["_num_s"]
    else:
        num_in = num
    stages.append(VectorAssembler(inputCols=num_in + [f"_{c}_ohe" for c in cat], outputCol="features"))
    return stages


def hash_split(df: DataFrame, key: str = "client_id", test_pct: int = 20, seed: int = 42) -> DataFrame:
    """Deterministic 80/20 split by key hash (stable under re-execution and retries)."""
    return df.withColumn("split", F.when(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(100)) < test_pct, "test")
                         .otherwise("train"))


class EmptyDatasetError(ValueError):
    pass


def check_training_set(df: DataFrame, label: str, where: str) -> None:
    """An empty training table is an error; a single class only warns."""
    import warnings

    stats = df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(label).alias("k")).first()
    if stats["n"] == 0:
        raise EmptyDatasetError(f"empty dataset: {where}")
    if stats["k"] < 2:
        warnings.warn(f"{where}: a single class/value of {label}; model and metrics are not reliable", stacklevel=2)


def regression_metrics(pred: DataFrame, actual: str = "actual", prediction: str = "prediction") -> DataFrame:
    """MAE and RMSE (one row)."""
    e = F.col(prediction).cast("double") - F.col(actual).cast("double")
    return pred.agg(
        F.round(F.avg(F.abs(e)), 6).alias("MAE"),
        F.round(F.sqrt(F.avg(e * e)), 6).alias("RMSE"),
        F.count(F.lit(1)).alias("n_eval"),
    )


def residuals(pred: DataFrame, key: str = "client_id", actual: str = "actual", prediction: str = "prediction") -> DataFrame:
    """Actual, prediction and residual = actual - prediction, largest first."""
    return pred.select(key, F.col(actual).alias("actual"), F.col(prediction).alias("prediction"),
                       F.round(F.col(actual) - F.col(prediction), 6).alias("residual")).orderBy(F.desc("residual"), key)


def _confusion(pred: DataFrame, actual: str, prediction: str) -> DataFrame:
    a, p = F.col(actual).cast("int"), F.col(prediction).cast("int")
    return pred.agg(
        F.sum(((a == 0) & (p == 0)).cast("long")).alias("tn"),
        F.sum(((a == 0) & (p == 1)).cast("long")).alias("fp"),
        F.sum(((a == 1) & (p == 0)).cast("long")).alias("fn"),
        F.sum(((a == 1) & (p == 1)).cast("long")).alias("tp"),
    ).na.fill(0)


def _ratio(n, d):
    return F.coalesce(F.try_divide(n.cast("double"), d.cast("double")), F.lit(0.0))


def churn_metrics(pred: DataFrame, actual: str = "actual", prediction: str = "prediction") -> DataFrame:
    """Confusion counts (always 2x2), precision and recall with zero_division=0."""
    c = _confusion(pred, actual, prediction)
    return c.select("tn", "fp", "fn", "tp",
                    F.round(_ratio(F.col("tp"), F.col("tp") + F.col("fp")), 6).alias("precision"),
                    F.round(_ratio(F.col("tp"), F.col("tp") + F.col("fn")), 6).alias("recall"))


def classification_report(pred: DataFrame, actual: str = "actual", prediction: str = "prediction") -> DataFrame:
    """Per-class precision / recall / f1 / support, accuracy, macro and weighted averages."""
    c = _confusion(pred, actual, prediction)  # one row
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))

    def cls(label, tp_, fp_, fn_):
        p = _ratio(tp_, tp_ + fp_)
        r = _ratio(tp_, tp_ + fn_)
        f1 = _ratio(2 * p * r, p + r)
        return F.struct(F.lit(label).alias("label"), p.alias("precision"), r.alias("recall"), f1.alias("f1_score"),
                        (tp_ + fn_).alias("support"))

    rows = c.select(F.array(cls("0", tn, fn, fp), cls("1", tp, fp, fn)).alias("k"), (tn + fp + fn + tp).alias("n"),
                    (tn + tp).alias("ok"))
    per = rows.select(F.explode("k").alias("r"), "n", "ok").select("r.*", "n", "ok")
    macro = per.groupBy().agg(F.lit("macro avg").alias("label"), F.avg("precision").alias("precision"),
                              F.avg("recall").alias("recall"), F.avg("f1_score").alias("f1_score"),
                              F.sum("support").alias("support"))
    wsum = lambda m: F.coalesce(F.try_divide(F.sum(F.col(m) * F.col("support")), F.sum("support")), F.lit(0.0))
    weighted = per.groupBy().agg(F.lit("weighted avg").alias("label"), wsum("precision").alias("precision"),
                                 wsum("recall").alias("recall"), wsum("f1_score").alias("f1_score"),
                                 F.sum("support").alias("support"))
    acc = rows.select(F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
                      F.lit(None).cast("double").alias("recall"), _ratio(F.col("ok"), F.col("n")).alias("f1_score"),
                      F.col("n").alias("support"))
    out = per.drop("n", "ok").unionByName(acc).unionByName(macro).unionByName(weighted)
    return out.select("label", *[F.round(c_, 6).alias(c_) for c_ in ("precision", "recall", "f1_score")],
                      F.col("support").cast("long").alias("support"))


def encoded_feature_names(model: PipelineModel, features_col: str = "features", df: DataFrame | None = None) -> list[str]:
    """Names of the assembled vector slots from the ``ml_attr`` metadata (the stages before the model make
    them; a forest would be sent to all executors for it)."""
    schema_df = PipelineModel(stages=model.stages[:-1]).transform(df.limit(0)) if df is not None else None
    meta = schema_df.schema[features_col].metadata["ml_attr"]["attrs"]
    slots = []
    for kind in meta.values():
        for a in kind:
            slots.append((a["idx"], a["name"]))
    names = []
    for _, n in sorted(slots):
        n = n.replace("_num_s_", "").replace("_plan_ohe_", "plan_").replace("_ville_ohe_", "ville_")
        names.append(n)
    return names


def _metrics_row(spark, model_name: str, target: str, m: DataFrame, n_rows: int, n_features: int) -> DataFrame:
    return m.select(F.lit(model_name).alias("model"), F.lit(target).alias("target"), "MAE", "RMSE",
                    F.lit(n_rows).cast("long").alias("n_rows"), F.lit(n_features).cast("long").alias("n_features"),
                    F.lit(dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)).alias("run_ts"))


MAX_DEPTH = 30  # MLlib's own limit: trees grow until their leaves are pure


def train_revenue(ml_ready: DataFrame, kind: str = "linear", seed: int = 42, max_depth: int = MAX_DEPTH):
    """M2 / M3: fit on the hash-split 80 %, score the 20 %; returns (model, predictions, metrics row).
    The input is computed once, into a checkpoint that every step reads."""
    require_columns(ml_ready, REV_NUM + REV_CAT + [REV_TARGET], "ml_ready")
    data = materialize(hash_split(ml_ready.withColumn("label", F.col(REV_TARGET).cast("double")), seed=seed))
    check_training_set(data, REV_TARGET, "ml_ready")
    if kind == "linear":
        est, name = LinearRegression(featuresCol="features", labelCol="label", regParam=0.0, solver="auto"), "LinearRegression"
    else:
        # each row keeps its node of every tree: a pass neither ships the trees grown so far nor walks them again
        est = RandomForestRegressor(featuresCol="features", labelCol="label", numTrees=100, featureSubsetStrategy="all",
                                    maxDepth=max_depth, cacheNodeIds=True, seed=seed)
        name = "RandomForestRegressor"
    train = data.where("split = 'train'")
    model = Pipeline(stages=preprocess_stages(REV_NUM, REV_CAT, scale=True)).fit(train)
    fit = est.fit if kind == "linear" else lambda df: forest.fit(est, df)
    model = PipelineModel(stages=[*model.stages, fit(model.transform(train))])
    pred = forest.transform(model, data.where("split = 'test'")).select(
        "client_id", F.col("label").alias("actual"), F.col("prediction"))
    n = data.count()
    return model, pred, _metrics_row(ml_ready.sparkSession, name, REV_TARGET, regression_metrics(pred), n,
                                     len(REV_NUM + REV_CAT))


def score_revenue(model: PipelineModel, df: DataFrame) -> DataFrame:
    """M5: prediction per row, actual alongside when present."""
    out = forest.transform(model, df)
    cols = ["client_id", F.col("prediction").alias("pred_ca_total")]
    if REV_TARGET in df.columns:
        cols.append(F.col(REV_TARGET).alias("actual"))
    return out.select(*cols)


def train_churn(churn_ready: DataFrame, test_size: float = 0.3):
    """M4: temporal split, L2 logistic regression on raw numerics + one-hot;
    returns (model, test predictions, split frame).  regParam = 1/n_train with
    standardization off is the same objective as C=1 in the reference."""
    require_columns(churn_ready, CHURN_NUM + CHURN_CAT + [CHURN_TARGET], "churn_ready")
    # the split reads its input several times, as do the estimator's stages: each is
    # written once (reliable checkpoint in the shared folder; survives executor loss)
    churn_ready = materialize(churn_ready)
    check_training_set(churn_ready, CHURN_TARGET, "churn_ready")
    split = materialize(temporal_split(churn_ready, test_size).withColumn("label", F.col(CHURN_TARGET).cast("double")))
    train = split.where("split = 'train'")
    n_train = train.count()
    lr = LogisticRegression(featuresCol="features", labelCol="label", regParam=1.0 / max(n_train, 1),
                            elasticNetParam=0.0, standardization=False, maxIter=1000, tol=1e-6)
    model = Pipeline(stages=preprocess_stages(CHURN_NUM, CHURN_CAT, scale=False) + [lr]).fit(train)
    test = split.where("split = 'test'").withColumn("actual", F.col(CHURN_TARGET))
    return model, score_churn(model, test, "actual"), split


def score_churn(model: PipelineModel, df: DataFrame, *keep: str) -> DataFrame:
    """M6: probability of class 1 and hard class (p > 0.5); ``keep`` columns go along."""
    out = model.transform(df)
    p = vector_to_array("probability")[1]
    return out.select("client_id", *keep, p.alias("churn_probability"), (p > 0.5).alias("churn"),
                      F.col("prediction").cast("int").alias("prediction"))


def feature_importance(weights: DataFrame) -> DataFrame:
    """M7: random-forest importances by encoded feature name, from the saved weights."""
    return weights.select("feature", F.col("weight").alias("importance"))


def churn_coefficients(weights: DataFrame) -> DataFrame:
    """M8: signed logistic weights by encoded feature name, from the saved weights."""
    return weights.where("feature <> '(intercept)'")


def feature_weights(weights: DataFrame, col: str = "weight", n: int = 15) -> DataFrame:
    """Top-n and bottom-n weights, tagged."""
    top = weights.orderBy(F.desc(col), "feature").limit(n).withColumn("side", F.lit("top"))
    bottom = weights.orderBy(F.asc(col), "feature").limit(n).withColumn("side", F.lit("bottom"))
    return top.unionByName(bottom)


def write_metrics_json(metrics: DataFrame, path: str) -> None:
    """Overwrite the metrics snapshot as JSON (non-ASCII kept as is)."""
    metrics.coalesce(1).write.mode("overwrite").json(path)  # one row


class ModelStore:
    """Models by name, each save a version of its own, and one current version of a name.
    A job that scores pins a version for its whole run; saving never touches a folder that is read."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def _versions(self, name: str) -> Versions:
        return Versions(self.spark, f"{self.base}/{name}")

    def save(self, name: str, model: PipelineModel, data: DataFrame, current: bool = True) -> int | None:
        """Save the model and its weights as a table; make it current when asked.  ``data`` gives the
        encoded columns their names.  A save that is not made current is kept, unnumbered."""
        store = self._versions(name)
        folder = store.folder()
        forest.save(model, f"{folder}/model")
        model_weights(model, data).write.parquet(f"{folder}/weights")
        return store.switch(folder) if current else None

    def has(self, name: str) -> bool:
        return bool(self._versions(name).log.numbers())

    def load(self, name: str, version: int | None = None) -> tuple[PipelineModel, int]:
        """The current (or a named) version and its number; a missing one is an error."""
        number, entry = self._versions(name).current(version)
        return forest.load(f"{entry['folder']}/model"), number

    def weights(self, name: str, version: int | None = None) -> DataFrame:
        """(feature, weight) of a version, as saved with it."""
        return self.spark.read.schema("feature string, weight double").parquet(f"{self._versions(name).current(version)[1]['folder']}/weights")


def model_weights(model: PipelineModel, df: DataFrame) -> DataFrame:
    """(feature, weight): importances of trees, else signed coefficients (with ``(intercept)``)."""
    names, last = encoded_feature_names(model, df=df), model.stages[-1]
    if hasattr(last, "featureImportances"):
        rows = list(zip(names, map(float, last.featureImportances.toArray().tolist())))
    else:
        rows = [*zip(names, map(float, last.coefficients.toArray().tolist())), ("(intercept)", float(last.intercept))]
    return df.sparkSession.createDataFrame(rows, "feature string, weight double")


def load_model(path: str) -> PipelineModel:
    """S9 for a model folder of another origin: a missing artifact is an error."""
    return PipelineModel.load(path)


def append_runs(spark: SparkSession, runs: DataFrame, path: str) -> DataFrame:
    """Add the runs (keyed by ``run_id``) that the history at ``path`` doesn't have yet; the
    history.  Running again with the same runs, or by two writers at once, leaves it as it is."""
    table = AppendTable(spark, path, runs.schema, F.col("run_id"), F.col("model"))
    table.append(runs)
    return table.read()


def latest_run(history: DataFrame) -> DataFrame:
    """The last metrics run."""
    return history.agg(F.max_by(F.struct(*history.columns), "run_ts").alias("r")).select("r.*")
