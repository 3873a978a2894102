"""Evaluation and comparison reports.

Everything is an aggregate over scored rows. Batch-averaged metrics use
exact row positions from ``positions.position``, never
a one-partition window; bin grids come from ``sequence`` on a one-row
aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripframe.functions.hashing import seeded_hash
from tripframe.operators import positions, splits

# Duration bands (seconds) of the travel and holding reports.
TRAVEL_BANDS = (("<2min", 120), ("2-5min", 300), (">=5min", None))
HOLDING_BANDS = (("<15s", 15), ("15s-30s", 30), (">=30s", None))

# Fixed value: minute-bin label format of the incumbent comparison.
BIN_LABEL = "%d-%d분"


def np_round(c: Column, digits: int = 0) -> Column:
    """numpy-style rounding: rint(x * 10^d) / 10^d (half-even on the scaled
    double). Spark's ``bround`` rounds the decimal text of the double and
    differs on values such as 0.575."""
    if digits == 0:
        return F.rint(c)
    scale = float(10 ** digits)
    return F.rint(c * F.lit(scale)) / F.lit(scale)


def _err(pred: str, actual: str) -> Column:
    return F.col(pred).cast("double") - F.col(actual).cast("double")


def metrics(df: DataFrame, pred: str = "prediction", actual: str = "TIME_GAP",
            eps: float = 1e-8) -> DataFrame:
    """I7/I9 global: n (rows with prediction and actual, which the means are
    over), MAE, MSE, RMSE, MAPE (%, +eps in the denominator)."""
    e = _err(pred, actual)
    return df.agg(
        F.count(e).alias("n"), F.avg(F.abs(e)).alias("mae"),
        F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (F.avg(F.abs(e) / (F.abs(F.col(actual).cast("double")) + F.lit(eps))) * 100).alias("mape"))


def metrics_batched(df: DataFrame, pred: str = "prediction", actual: str = "TIME_GAP",
                    order: str = "obs_id", batch: int = 32,
                    eps: float = 1e-8) -> DataFrame:
    """I7 batch mode: rows in ``order`` cut into batches of ``batch``; MAE,
    RMSE and MAPE are the unweighted means of the per-batch values (the
    source's loader averaging). Positions are exact and distributed."""
    pos = positions.position(df, [], [order], name="_pos")
    e = _err(pred, actual)
    per = (pos.withColumn("_batch", F.floor(F.col("_pos") / batch))
              .groupBy("_batch")
              .agg(F.avg(F.abs(e)).alias("_mae"), F.sqrt(F.avg(e * e)).alias("_rmse"),
                   (F.avg(F.abs(e) / (F.abs(F.col(actual).cast("double")) + F.lit(eps))) * 100)
                   .alias("_mape")))
    return per.agg(F.count(F.lit(1)).alias("n_batches"), F.avg("_mae").alias("mae"),
                   F.avg("_rmse").alias("rmse"), F.avg("_mape").alias("mape"))


def weighted_mse(df: DataFrame, pred: str, actual: str, weight: str) -> DataFrame:
    """I8: mean(w * (pred - actual)^2)."""
    e = _err(pred, actual)
    return df.agg(F.avg(F.col(weight) * e * e).alias("weighted_mse"))


def prediction_report(df: DataFrame, pred: str = "prediction", actual: str = "TIME_GAP",
                      rate_digits: int | None = 2, est_digits: int = 1,
                      order_by: str = "ERROR") -> DataFrame:
    """TIME_GAP_ESTIMATE = trunc(round-half-even(pred, est_digits));
    ERROR = |estimate - actual|; ERROR_RATE = round-half-even(ERROR / actual,
    rate_digits) (None = no rate; division by zero -> null); sorted
    descending by ``order_by``, then by the row key if there is one, so rows
    of equal value spread over the ranges of the sort."""
    est = np_round(F.col(pred).cast("double"), est_digits).cast("int")
    x = (df.withColumn("TIME_GAP_ESTIMATE", est)
           .withColumn("ERROR", F.abs(F.col("TIME_GAP_ESTIMATE") - F.col(actual)).cast("int")))
    if rate_digits is not None:
        x = x.withColumn("ERROR_RATE", np_round(F.try_divide(F.col("ERROR").cast("double"),
                                                             F.col(actual).cast("double")), rate_digits))
    return x.orderBy(F.col(order_by).desc(), *[c for c in ("obs_id",) if c in x.columns])


def band_of(actual: Column, bands=TRAVEL_BANDS) -> Column:
    expr = F.lit(bands[-1][0])
    for name, upper in reversed(bands[:-1]):
        expr = F.when(actual < upper, F.lit(name)).otherwise(expr)
    return expr


def banded_comparison(df: DataFrame, pred: str = "prediction", actual: str = "TIME_GAP",
                      bands=TRAVEL_BANDS, per_band: int = 20, key: str = "obs_id",
                      seed: int = 42) -> DataFrame:
    """Up to ``per_band`` seeded rows per duration band with Category,
    Actual, Predicted and Absolute Error."""
    s = splits.banded_sample(df, band_of(F.col(actual), bands), per_band, key, seed)
    return s.select(key, F.col("band").alias("Category"),
                    F.col(actual).cast("double").alias("Actual"),
                    F.col(pred).cast("double").alias("Predicted"),
                    F.abs(F.col(actual).cast("double") - F.col(pred).cast("double"))
                    .alias("Absolute Error"))


def incumbent_bins(comp: DataFrame, event: str, ai: str, bis: str, upper_minutes: float | None = None,
                   lower_minutes: float | None = 0.0) -> DataFrame:
    """Drop rows missing any of the three; optional minute range;
    left-closed 1-minute bins 0..int(max); per bin the mean model and
    incumbent errors (half-even to int, empty bins 0) and the row count."""
    m = F.col(event).cast("double") / F.lit(60.0)
    x = comp.select(m.alias("_min"), F.col(ai).alias("_ai"), F.col(bis).alias("_bis")).na.drop()
    if lower_minutes is not None:
        x = x.filter(F.col("_min") >= lower_minutes)
    if upper_minutes is not None:
        x = x.filter(F.col("_min") <= upper_minutes)
    x = x.withColumn("bin", F.floor("_min").cast("int"))
    agg = x.groupBy("bin").agg(F.avg("_ai").alias("_a"), F.avg("_bis").alias("_b"),
                               F.count(F.lit(1)).alias("_n"))
    # the grid bound comes from the (small) per-bin aggregate, not a rescan
    top = agg.agg(F.max("bin").alias("_top"))
    grid = top.select(F.explode(F.sequence(F.lit(0), F.col("_top"))).alias("bin"))
    out = grid.join(agg, "bin", "left")
    label = F.format_string(BIN_LABEL, F.col("bin"), F.col("bin") + 1)
    return out.select("bin", label.alias("label"),
                      np_round(F.coalesce("_a", F.lit(0.0))).cast("int").alias("ai_mean"),
                      np_round(F.coalesce("_b", F.lit(0.0))).cast("int").alias("bis_mean"),
                      F.coalesce("_n", F.lit(0)).cast("bigint").alias("count"))


def improvement(comp: DataFrame, event: str, ai: str, bis: str, upper_minutes: float | None = None,
                lower_minutes: float | None = 0.0) -> DataFrame:
    """Overall mean errors and (bis - ai) / bis * 100 (0 when bis is 0)."""
    m = F.col(event).cast("double") / F.lit(60.0)
    x = comp.select(m.alias("_min"), F.col(ai).alias("_ai"), F.col(bis).alias("_bis")).na.drop()
    if lower_minutes is not None:
        x = x.filter(F.col("_min") >= lower_minutes)
    if upper_minutes is not None:
        x = x.filter(F.col("_min") <= upper_minutes)
    a = x.agg(F.avg("_ai").alias("ai_mean"), F.avg("_bis").alias("bis_mean"))
    return a.withColumn("improvement_pct",
                        F.when(F.col("bis_mean") == 0, F.lit(0.0))
                         .otherwise((F.col("bis_mean") - F.col("ai_mean")) / F.col("bis_mean") * 100))


def bin_drilldown(comp: DataFrame, event: str, ai: str, bis: str, minute_bin: int,
                  key: str = "obs_id") -> DataFrame:
    """The rows of one minute bin, labelled ``i-(i+1)`` minutes."""
    m = F.col(event).cast("double") / F.lit(60.0)
    x = comp.select(key, m.alias("EVENT_MIN"), ai, bis).na.drop(subset=["EVENT_MIN", ai, bis])
    x = x.filter((F.col("EVENT_MIN") >= 0) & (F.floor("EVENT_MIN") == minute_bin))
    return x.withColumn("label", F.lit(BIN_LABEL % (minute_bin, minute_bin + 1)))


def random_rows(df: DataFrame, n: int = 20, key: str = "obs_id", seed: int = 42,
                pred: str = "prediction", actual: str = "TIME_GAP") -> DataFrame:
    """I16: n seeded rows with Actual, Predicted, Absolute Error (a global
    top-n by seeded hash: per-partition top-n, then a merge)."""
    pick = df.withColumn("_h", seeded_hash(key, seed)).orderBy("_h", key).limit(n)
    return pick.select(key, F.col(actual).cast("double").alias("Actual"),
                       F.col(pred).cast("double").alias("Predicted"),
                       F.abs(F.col(actual).cast("double") - F.col(pred).cast("double"))
                       .alias("Absolute Error"))


def final_order_dedup(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Exact-duplicate removal, then the final sort."""
    return df.dropDuplicates().orderBy(*order)
