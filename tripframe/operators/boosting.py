"""Boosted regression trees with patience.

Squared-error boosting round by round over Spark ML's distributed decision trees: a
round fits one tree to the residuals on a share of the rows and of the columns, drawn
per tree by a seeded hash of the row key and by a seeded draw of column numbers, and moves
every prediction by ``step`` times the tree's. All rounds of a chunk stand side by side as
columns, so one pass over the validation rows gives the chunk's part of the validation
curve; then the predictions are written to the shared folder, which keeps plans short and
costs one chunk if executors are lost. Rounds end when the last ``patience`` rounds brought
no better validation error, and the model is cut back to the best round: what a library
with early stopping on a fixed validation set keeps.

The result is an ordinary ``GBTRegressionModel`` whose first tree is the training mean,
so it is saved, loaded and scored like any other. Cost: a round is about ``depth`` passes
over the drawn training rows (the trees cache their binned input) and a share ``1 / chunk``
of a write of the predictions; figures are in the README.
"""

from __future__ import annotations

import random
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml.feature import ElementwiseProduct, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripframe.sources.files import stage_table

MISSING = -1.0
_DRAWS = 1 << 20


class Boosted(NamedTuple):
    """The model, the validation error (RMSE) before the first and after each round, and
    the best round (0: the mean alone)."""

    model: GBTRegressionModel
    curve: list[float]
    best: int


def vectors(df: DataFrame, feature_cols: Sequence[str], out: str = "features") -> DataFrame:
    """``df`` with its features as one vector; a missing value counts as ``MISSING``."""
    held = {f"_v{i}": F.coalesce(F.col(c).cast("double"), F.lit(MISSING)) for i, c in enumerate(feature_cols)}
    return VectorAssembler(inputCols=list(held), outputCol=out).transform(df.withColumns(held)).drop(*held)


def _model(spark, trees: list, weights: list[float], feature_col: str) -> GBTRegressionModel:
    gateway, jvm = spark.sparkContext._gateway, spark._jvm
    kinds = jvm.org.apache.spark.ml.regression
    tree_array = gateway.new_array(kinds.DecisionTreeRegressionModel, len(trees))
    weight_array = gateway.new_array(jvm.double, len(trees))
    for i, (t, w) in enumerate(zip(trees, weights)):
        tree_array[i], weight_array[i] = t._java_obj, float(w)
    made = GBTRegressionModel(kinds.GBTRegressionModel(f"boosted_{len(trees)}", tree_array, weight_array))
    return made.setFeaturesCol(feature_col)


def stop_round(curve: Sequence[float], patience: int) -> tuple[int, bool]:
    """(best round so far, whether ``patience`` rounds since brought nothing better). The
    first of equal rounds counts."""
    best = 0
    for r, e in enumerate(curve):
        if e < curve[best]:
            best = r
        elif r - best >= patience:
            return best, True
    return best, False


def fit_boosted(rows: DataFrame, feature_cols: Sequence[str], label: str = "TIME_GAP", val_flag: str = "is_val",
                key: str = "obs_id", rounds: int = 1_000_000, step: float = 0.01, depth: int = 20, patience: int = 20,
                row_share: float = 0.8, col_share: float = 0.8, chunk: int = 10, bins: int = 256, seed: int = 42
                ) -> Boosted:
    """Fit on the rows whose ``val_flag`` is false, stop by those where it is true. Rows
    without a label take no part. The defaults are the source's; ``rounds`` is only an upper
    limit. Without training or validation rows it fails."""
    spark = rows.sparkSession
    cols = list(feature_cols)
    data = vectors(rows.filter(F.col(label).isNotNull()), cols).select(
        F.col(key).alias("k"), F.col(label).cast("double").alias("y"), F.col(val_flag).alias("val"), "features")
    data = stage_table(data, "boost_rows")
    sizes = data.agg(F.count_if(~F.col("val")), F.count_if(F.col("val"))).first()
    if not sizes[0] or not sizes[1]:
        raise ValueError("boosting needs training and validation rows")

    def tree(label_col: str, feature_col: str, levels: int) -> DecisionTreeRegressor:
        return DecisionTreeRegressor(labelCol=label_col, featuresCol=feature_col, maxDepth=levels, maxBins=bins, seed=seed)

    def moved(df: DataFrame, fitted, was: str | None, now: str, by: float) -> DataFrame:
        fitted = fitted.setFeaturesCol("features").setPredictionCol("_t")
        value = F.col("_t") * by if was is None else F.col(was) + F.col("_t") * by
        return fitted.transform(df).withColumn(now, value).drop("_t")

    def errors(df: DataFrame, names: list[str]) -> list[float]:
        return list(df.filter("val").agg(*[F.sqrt(F.avg((F.col("y") - F.col(c)) ** 2)) for c in names]).first())

    trees, weights = [tree("y", "features", 0).fit(data.filter("not val"))], [1.0]
    state = moved(data, trees[0], None, "f0", 1.0)
    curve = errors(state, ["f0"])
    best, done = 0, False
    while not done and len(trees) <= rounds:
        first = len(trees)
        names = []
        for r in range(first, min(first + chunk, rounds + 1)):
            drawn = set(random.Random(f"{seed}-{r}").sample(range(len(cols)), max(1, round(col_share * len(cols)))))
            mask = ElementwiseProduct(scalingVec=Vectors.dense([float(i in drawn) for i in range(len(cols))]),
                                      inputCol="features", outputCol="_x")
            luck = F.pmod(F.xxhash64("k", F.lit(seed), F.lit(r)), F.lit(_DRAWS)) < int(row_share * _DRAWS)
            part = state.filter(~F.col("val") & luck).withColumn("_res", F.col("y") - F.col(f"f{r - 1}"))
            fitted = tree("_res", "_x", depth).fit(mask.transform(part.select("features", "_res")))
            state = moved(state, fitted, f"f{r - 1}", f"f{r}", step)
            trees.append(fitted)
            weights.append(step)
            names.append(f"f{r}")
        state = stage_table(state.select("k", "y", "val", "features", *names), "boost_rounds")
        curve += errors(state, names)
        state = state.select("k", "y", "val", "features", names[-1])
        best, done = stop_round(curve, patience)
    return Boosted(_model(spark, trees[:best + 1], weights[:best + 1], "features"), curve, best)
