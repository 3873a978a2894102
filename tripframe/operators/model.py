"""Fit and score.

* ``fit_group_mean`` / ``score_group_mean``: a hierarchical group-mean
  predictor (e.g. segment x time class, then segment, then global) whose
  fit tables are plain aggregates: the deterministic model behind every
  evaluation query, and the incumbent-style baseline.
* ``fit_per_group_line``: one least-squares line per group in closed form
  (``regr_slope`` / ``regr_intercept``, partially aggregated), the Spark
  re-aim of one small model per (segment, day type).
* ``fit_gbt`` / ``fit_global_regressor`` / ``tune``: Spark ML estimators
  for the boosted-tree model, the global regressor with hashed id
  features and sample weights, and the validation-set parameter search.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripframe.operators.positions import attach_scalars, nullsafe_join


# Group-mean predictor -------------------------------------------------------
def fit_group_mean(train: DataFrame, levels: Sequence[Sequence[str]], target: str = "TIME_GAP"
                   ) -> DataFrame:
    """Means of ``target`` for every level (most specific first; the empty
    level is the global mean) in one ``GROUPING SETS`` pass: one shuffle,
    one fit table with a ``_level`` column."""
    keys = list(dict.fromkeys(k for lvl in levels for k in lvl))
    sets = [list(lvl) for lvl in levels]
    g = train.groupingSets(sets, *keys) if keys else train.groupBy()
    fit = g.agg(F.avg(F.col(target).cast("double")).alias("_mean"),
                F.grouping_id(*keys).alias("_gid") if keys else F.lit(0).alias("_gid"))
    gid_to_level = F.lit(None).cast("int")
    for i, lvl in enumerate(levels):
        gid = sum(2 ** (len(keys) - 1 - j) for j, k in enumerate(keys) if k not in lvl)
        gid_to_level = F.when(F.col("_gid") == gid, F.lit(i)).otherwise(gid_to_level)
    return fit.withColumn("_level", gid_to_level).drop("_gid")


def score_level(df: DataFrame, fit: DataFrame, level: int, keys: Sequence[str],
                out: str) -> DataFrame:
    """The mean of one fitted level only (no fallback), e.g. to compare two
    predictors fitted in the same pass."""
    part = fit.filter(F.col("_level") == level).select(*keys, F.col("_mean").alias(out))
    return nullsafe_join(df, part, list(keys), "left")


def score_group_mean(df: DataFrame, fit: DataFrame, levels: Sequence[Sequence[str]],
                     out: str = "prediction") -> DataFrame:
    """Mean of the most specific level that has the row's group. The fit
    table holds one row per group per level: small, so AQE broadcasts it
    when its measured size allows and shuffles otherwise."""
    x = df
    for i, lvl in enumerate(levels):
        part = fit.filter(F.col("_level") == i).select(*lvl, F.col("_mean").alias(f"_m{i}"))
        if lvl:
            x = nullsafe_join(x, part, list(lvl), "left")
        else:
            x = attach_scalars(x, part)  # global mean: one value
    pred = F.coalesce(*[F.col(f"_m{i}") for i in range(len(levels))])
    return x.withColumn(out, pred).drop(*[f"_m{i}" for i in range(len(levels))])


# Per-group closed-form regression (I3) ---------------------------------------
def fit_per_group_line(train: DataFrame, keys: Sequence[str], x: str, y: str,
                       min_rows: int = 2) -> DataFrame:
    """slope / intercept of y on x per group; groups under ``min_rows`` rows
    (or with constant x) get no model."""
    return (train.groupBy(*keys)
                 .agg(F.regr_slope(F.col(y).cast("double"), F.col(x).cast("double")).alias("slope"),
                      F.regr_intercept(F.col(y).cast("double"), F.col(x).cast("double")).alias("intercept"),
                      F.count(F.lit(1)).alias("n_train"))
                 .filter((F.col("n_train") >= min_rows) & F.col("slope").isNotNull()))


def score_per_group_line(df: DataFrame, fit: DataFrame, keys: Sequence[str], x: str,
                         out: str = "prediction") -> DataFrame:
    j = nullsafe_join(df, fit, list(keys))  # inner: groups without a model are skipped
    return j.withColumn(out, F.col("intercept") + F.col("slope") * F.col(x).cast("double")) \
            .drop("slope", "intercept", "n_train")


def fit_per_group_ols(train: DataFrame, keys: Sequence[str], xs: Sequence[str], y: str,
                      min_rows: int | None = None, tol: float = 1e-9) -> DataFrame:
    """Least squares of ``y`` on several regressors per group: ``keys, intercept,
    coef`` (array in the order of ``xs``), ``n_train``.

    The normal equations need only means and covariances, which Spark merges from
    partial aggregates: one shuffle of one row a group and task, whatever a group's
    size. They are solved in closed form in columns (square-root-free Cholesky on the
    covariances, so large means don't cost digits). Rows with a null in ``y`` or any
    regressor are left out. A group of fewer than ``min_rows`` (default: one more than
    the coefficients) rows, or with a regressor that the ones before it determine (what
    they leave of its variance is below ``tol`` of it), gets no model."""
    xs, p = list(xs), len(xs)
    least = p + 2 if min_rows is None else min_rows
    v = [F.col(c).cast("double") for c in [*xs, y]]
    whole = train
    for c in [*xs, y]:
        whole = whole.filter(F.col(c).isNotNull())
    pairs = [(i, j) for i in range(p + 1) for j in range(i, p + 1)][:-1]
    g = whole.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_train"), *[F.avg(x).alias(f"_m{i}") for i, x in enumerate(v)],
        *[F.covar_pop(v[i], v[j]).alias(f"_s{i}_{j}") for i, j in pairs])
    g = g.filter(F.col("n_train") >= least)
    # S = L D L', column by column; the column of y turns into L^-1 s_y on the way.
    for j in range(p):
        done = F.col(f"_s{j}_{j}")
        for k in range(j):
            done = done - F.col(f"_l{k}_{j}") * F.col(f"_l{k}_{j}") * F.col(f"_d{k}")
        g = g.withColumn(f"_d{j}", done).filter(
            (F.col(f"_s{j}_{j}") > 0) & (F.col(f"_d{j}") > F.lit(tol) * F.col(f"_s{j}_{j}")))
        new = {}
        for i in range(j + 1, p + 1):
            left = F.col(f"_s{j}_{i}")
            for k in range(j):
                left = left - F.col(f"_l{k}_{j}") * F.col(f"_l{k}_{i}") * F.col(f"_d{k}")
            new[f"_l{j}_{i}"] = left / F.col(f"_d{j}")
        g = g.withColumns(new)
    for j in reversed(range(p)):
        b = F.col(f"_l{j}_{p}")
        for i in range(j + 1, p):
            b = b - F.col(f"_l{j}_{i}") * F.col(f"_b{i}")
        g = g.withColumn(f"_b{j}", b)
    start = F.col(f"_m{p}")
    for j in range(p):
        start = start - F.col(f"_b{j}") * F.col(f"_m{j}")
    return g.select(*keys, start.alias("intercept"), F.array(*[F.col(f"_b{j}") for j in range(p)]).alias("coef"),
                    "n_train")


def score_per_group_ols(df: DataFrame, fit: DataFrame, keys: Sequence[str], xs: Sequence[str],
                        out: str = "prediction") -> DataFrame:
    """Rows of groups that have a model, with its prediction."""
    j = nullsafe_join(df, fit, list(keys))
    value = F.col("intercept")
    for i, c in enumerate(xs):
        value = value + F.col("coef")[i] * F.col(c).cast("double")
    return j.withColumn(out, value).drop("intercept", "coef", "n_train")


# Spark ML estimators ---------------------------------------------------------
def fit_gbt(train_val: DataFrame, feature_cols: Sequence[str], label: str = "TIME_GAP",
            val_flag: str = "is_val", max_iter: int = 100, step: float = 0.01,
            max_depth: int = 20, subsample: float = 0.8, col_sample: str = "0.8",
            seed: int = 42, checkpoint_interval: int = 10) -> PipelineModel:
    """Boosted trees with validation-set early stopping.

    Spark stops when validation error improves by less than
    ``validationTol`` (relative), not after a patience of rounds, and
    samples columns per split rather than per tree: the model is the same
    family but not value-equal to the source's."""
    gbt = GBTRegressor(featuresCol="features", labelCol=label, maxIter=max_iter, stepSize=step,
                       maxDepth=max_depth, subsamplingRate=subsample,
                       featureSubsetStrategy=col_sample, seed=seed,
                       validationIndicatorCol=val_flag, validationTol=1e-6,
                       checkpointInterval=checkpoint_interval, cacheNodeIds=True)
    pipe = Pipeline(stages=[VectorAssembler(inputCols=list(feature_cols), outputCol="features",
                                            handleInvalid="keep"), gbt])
    return pipe.fit(train_val)


def global_regressor(dense_cols: Sequence[str], hash_col: str, hash_size: int,
                     label: str = "TIME_GAP", weight: str | None = None,
                     reg: float = 0.01) -> Pipeline:
    """Dense features + one-hot of the hashed segment id (an embedding
    re-aimed as a sparse indicator) -> weighted linear regression."""
    ohe = OneHotEncoder(inputCols=[hash_col], outputCols=["_id_vec"], dropLast=False,
                        handleInvalid="keep")
    asm = VectorAssembler(inputCols=list(dense_cols) + ["_id_vec"], outputCol="features",
                          handleInvalid="keep")
    lr = LinearRegression(featuresCol="features", labelCol=label, regParam=reg,
                          elasticNetParam=0.0, maxIter=50)
    if weight:
        lr.setWeightCol(weight)
    _ = hash_size  # the hashed column's range fixes the vector size
    return Pipeline(stages=[ohe, asm, lr])


def tune(pipeline: Pipeline, param_maps, train: DataFrame, val: DataFrame,
         label: str = "TIME_GAP", metric: str = "rmse", parallelism: int = 2):
    """I4: fit every parameter map on train, score on the fixed validation
    set, keep the best (lowest ``metric``). Candidates are fitted as
    concurrent Spark jobs by ``parallelism`` threads pulling from
    ``fitMultiple`` (whose iterator is thread-safe), as TrainValidationSplit
    does. Returns (best model, [(params, metric)])."""
    from concurrent.futures import ThreadPoolExecutor

    ev = RegressionEvaluator(labelCol=label, predictionCol="prediction", metricName=metric)
    fits = pipeline.fitMultiple(train, param_maps)

    def one(_):
        idx, m = next(fits)
        return idx, m, ev.evaluate(m.transform(val))

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        done = list(pool.map(one, range(len(param_maps))))
    results = {idx: r for idx, _, r in done}
    models = {idx: m for idx, m, _ in done}
    best = min(results, key=results.get)
    return models[best], [(param_maps[i], results[i]) for i in sorted(results)]


def score(model: PipelineModel, df: DataFrame, out: str = "TIME_GAP_ESTIMATE") -> DataFrame:
    """Transform, round half-even to an int estimate (no actuals needed)."""
    return model.transform(df).withColumn(out, F.bround("prediction", 0).cast("int"))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
