"""Model work on ``pyspark.ml``: word vectors, boosted trees, random search,
evaluation, batch scoring and additive (linear Shapley) contributions."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler, Word2Vec
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paysift.functions import constants as K
from paysift.operators.boosting import TableGBT
from paysift.operators.features import request_defaults


def train_word2vec(sentences: DataFrame, col: str, params: dict | None = None):
    """Skip-gram word vectors (``pyspark.ml.feature.Word2Vec``) with the
    reference's dimension, window, minimum count, epochs and seed.

    ``Word2Vec`` trains on one partition unless told otherwise; ``numPartitions``
    is a fixed parameter, because the vectors depend on it.
    """
    return Word2Vec(inputCol=col, outputCol="_w2v", **dict(K.W2V_PARAMS, **(params or {}))).fit(sentences)


def assembler(cols: Sequence[str], out: str = "features") -> VectorAssembler:
    """Fixed-order feature vector; null / NaN kept as NaN (trees route them)."""
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="keep")


def gbt(label: str = "log_salary", features: str = "features", params: dict | None = None) -> GBTRegressor:
    return TableGBT(labelCol=label, featuresCol=features, **dict(K.GBT_PARAMS, **(params or {})))


def regression_metrics(pred: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """RMSE, MAE, R² (1 − SSE/SST) in one aggregate pass."""
    e = F.col(label) - F.col(prediction)
    m = pred.agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"),
                 F.avg(F.abs(e)).alias("mae"), F.sum(e * e).alias("_sse"),
                 F.var_pop(label).alias("_var"))
    return m.select("n", "rmse", "mae", (1 - F.col("_sse") / (F.col("_var") * F.col("n"))).alias("r2"))


def random_param_maps(est: GBTRegressor, n_draws: int, seed: int = 42,
                      ranges: dict | None = None) -> list:
    """``n_draws`` parameter maps drawn on the driver from the search ranges."""
    rng = random.Random(seed)
    r = dict(K.TUNE_RANGES, **(ranges or {}))
    maps = []
    for _ in range(n_draws):
        maps.append({
            est.maxIter: rng.randrange(*r["maxIter"]), est.maxDepth: rng.randrange(*r["maxDepth"]),
            est.stepSize: rng.uniform(*r["stepSize"]), est.subsamplingRate: rng.uniform(*r["subsamplingRate"]),
            est.featureSubsetStrategy: f"{rng.uniform(*r['featureSubsetStrategy']):.3f}",
            est.minInfoGain: rng.uniform(*r["minInfoGain"])})
    return maps


def random_search(train: DataFrame, est: GBTRegressor, n_draws: int = K.TUNE_DRAWS,
                  folds: int = K.TUNE_FOLDS, fold_col: str | None = None, parallelism: int = 4,
                  seed: int = 42):
    """Random search with k-fold cross validation on RMSE.  With ``fold_col``
    the folds are a deterministic column (e.g. an md5 bucket)."""
    ev = RegressionEvaluator(labelCol=est.getLabelCol(), predictionCol=est.getPredictionCol(), metricName="rmse")
    cv = CrossValidator(estimator=est, estimatorParamMaps=random_param_maps(est, n_draws, seed),
                        evaluator=ev, numFolds=folds, parallelism=parallelism, seed=seed)
    if fold_col:
        cv = cv.setFoldCol(fold_col)
    return cv.fit(train)


def contribution_col(feature: str) -> str:
    return f"contrib__{feature}"


def linear_contributions(df: DataFrame, keys: Sequence[str], feature_cols: Sequence[str],
                         label: str, train: DataFrame | None = None):
    """Exact Shapley values of a linear model: ``coef_j * (x_j − mean_j)``,
    base = mean prediction (Lundberg & Lee 2017, linear case).

    Returns ``(model, wide)``: ``keys, prediction, base`` and one
    ``contrib__<feature>`` column per feature — a projection of each row, so
    explaining a table costs one pass and no row is multiplied by the feature
    count (``contributions_long`` explodes a chosen slice when a long form is
    wanted).  Means come from the training rows (one aggregate); the
    coefficients are a fitted parameter with one number per feature.
    """
    keys = list(keys)
    cols = list(feature_cols)
    train = train if train is not None else df
    filled = lambda d: request_defaults(d).fillna(0.0, subset=cols)
    asm = VectorAssembler(inputCols=cols, outputCol="_x", handleInvalid="keep")
    lr = LinearRegression(featuresCol="_x", labelCol=label, regParam=0.0, standardization=False,
                          solver="normal")
    model = Pipeline(stages=[asm, lr]).fit(filled(train))
    coef = [float(c) for c in model.stages[-1].coefficients]
    icpt = float(model.stages[-1].intercept)
    means = filled(train).agg(*[F.avg(c).alias(c) for c in cols]).first()
    mu = {n: float(means[n] or 0.0) for n in cols}
    return model, _contributions(filled(df), keys, cols, coef, icpt, mu)


def _contributions(d: DataFrame, keys: Sequence[str], cols: Sequence[str], coef: Sequence[float], icpt: float, mu: dict[str, float]) -> DataFrame:
    base = icpt + sum(c * mu[n] for c, n in zip(coef, cols))
    pred = F.lit(icpt)
    for n, c in zip(cols, coef):
        pred = pred + F.lit(c) * F.col(n).cast("double")
    contribs = [(F.lit(c) * (F.col(n).cast("double") - F.lit(mu[n]))).alias(contribution_col(n))
                for n, c in zip(cols, coef)]
    return d.select(*keys, pred.alias("prediction"), F.lit(base).alias("base"), *contribs)


def contributions_long(wide: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Long form ``keys, feature, contribution`` for a chosen set of features."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(contribution_col(f)).alias("contribution"))
                      for f in features])
    return wide.select(*keys, F.explode(pairs).alias("_p")).select(*keys, "_p.feature", "_p.contribution")


def mean_abs_importance(wide: DataFrame, features: Sequence[str]) -> DataFrame:
    """Global importance = mean |contribution| per feature, in one aggregate
    pass over the wide table; returns ``feature, importance``."""
    one = wide.agg(*[F.avg(F.abs(F.col(contribution_col(f)))).alias(f"_{i}") for i, f in enumerate(features)])
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"_{i}").alias("importance")) for i, f in enumerate(features)])
    return one.select(F.explode(pairs).alias("_p")).select("_p.feature", "_p.importance")


def score(model, requests: DataFrame, keys: Sequence[str], pred_col: str = "prediction") -> DataFrame:
    """Batch scoring: log prediction -> salary truncated to whole dollars + ±17 % interval."""
    from paysift.operators.rules import interval
    p = model.transform(requests)
    return p.select(*keys, F.col(pred_col).alias("log_pred"), *interval(F.exp(pred_col)))


def gain_importances(spark: SparkSession, model, names: DataFrame) -> DataFrame:
    """``feature, importance`` of a tree model: one number per feature, all of them (a fitted parameter, not data), with
    their ``names`` (idx, feature)."""
    imp = model.featureImportances.toArray().tolist()
    shares = spark.createDataFrame([(i, float(v)) for i, v in enumerate(imp)], "idx int, importance double")
    return names.join(shares, "idx").select("feature", "importance")


def top_contributions(wide: DataFrame, keys: Sequence[str], features: Sequence[str], k: int = K.TOP_CONTRIBUTIONS) -> DataFrame:
    """Each row's ``k`` largest contributions by absolute value (ties by name), with
    rank, base and prediction; local to the row."""
    pairs = F.array(*[F.struct((-F.abs(F.col(contribution_col(f)))).alias("k"), F.lit(f).alias("feature"),
                               F.col(contribution_col(f)).alias("contribution")) for f in features])
    top = wide.select(*keys, "base", "prediction", F.posexplode(F.slice(F.array_sort(pairs), 1, k)).alias("rank", "x"))
    return top.select(*keys, (F.col("rank") + 1).cast("long").alias("rank"), "x.feature", "x.contribution", "base", "prediction")
