"""Outlier operators.

Fences come from one-row fit tables of exact quantiles, selected without a value
map in one task (``quantiles``). One-row fences reach the rows as scalar
subqueries (computed once, no join). Group statistics are hash aggregates joined back on the
group key, never a window: a hot group is partially aggregated map-side
and its single stats row is what the join replicates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripframe.operators.positions import attach_scalars, nullsafe_join
from tripframe.operators.quantiles import exact_quantiles, quantile_name


def iqr_bounds(df: DataFrame, cols: Sequence[str], k: float = 1.5) -> DataFrame:
    """One row: q1_c, q3_c, lo_c, hi_c per column (linear interpolation)."""
    fit = exact_quantiles(df, cols, (0.25, 0.75))
    sel = []
    for c in cols:
        q1, q3 = (F.col(quantile_name(c, p)) for p in (0.25, 0.75))
        iqr = q3 - q1
        sel += [q1.alias(f"q1_{c}"), q3.alias(f"q3_{c}"),
                (q1 - F.lit(k) * iqr).alias(f"lo_{c}"), (q3 + F.lit(k) * iqr).alias(f"hi_{c}")]
    return fit.select(*sel)


def _with_bounds(df: DataFrame, bounds: DataFrame) -> DataFrame:
    return attach_scalars(df, bounds)


def iqr_split(df: DataFrame, cols: Sequence[str], k: float = 1.5,
              name: str = "iqr_set") -> DataFrame:
    """``kept`` = inside every fence (inclusive), ``outlier`` = outside any
    fence; equal outlier rows are kept once (the distinct union of the
    outliers of all columns). Bounds always come from the input table. A null
    value is neither kept nor (by itself) an outlier, so such rows may land in
    no set."""
    x = _with_bounds(df, iqr_bounds(df, cols, k))
    inside, outside = F.lit(True), F.lit(False)
    for c in cols:
        v, lo, hi = F.col(c), F.col(f"lo_{c}"), F.col(f"hi_{c}")
        inside, outside = inside & (v >= lo) & (v <= hi), outside | (v < lo) | (v > hi)
    kept, out = ((x.filter(test).select(*df.columns, F.lit(lab).alias(name)))
                 for test, lab in ((inside, "kept"), (outside, "outlier")))
    return kept.unionByName(out.distinct())


def iqr_stats(df: DataFrame, cols: Sequence[str], k: float = 1.5) -> DataFrame:
    """Total rows, outlier rows and their percentage."""
    s = iqr_split(df, cols, k)
    tot = df.agg(F.count(F.lit(1)).alias("total"))
    n = s.agg(F.count_if(F.col("iqr_set") == "outlier").alias("outliers"))
    return (attach_scalars(n, tot).select("total", "outliers")
               .withColumn("pct", F.try_divide(F.col("outliers") * F.lit(100.0), F.col("total"))))


def save_iqr_split(df: DataFrame, cols: Sequence[str], path: str, fmt: str = "parquet") -> None:
    """Both outputs in one write, one folder per set."""
    iqr_split(df, cols).write.mode("overwrite").partitionBy("iqr_set").format(fmt).save(path)


def fence_summary(df: DataFrame, col: str, k: float = 1.5) -> DataFrame:
    """C4 header: bounds and upper / lower outlier counts."""
    b = iqr_bounds(df, [col], k)
    x = _with_bounds(df, b)
    v = F.col(col)
    return x.groupBy(F.col(f"lo_{col}").alias("lower_bound"),
                     F.col(f"hi_{col}").alias("upper_bound")).agg(
        F.count_if(v > F.col(f"hi_{col}")).alias("n_upper"),
        F.count_if(v < F.col(f"lo_{col}")).alias("n_lower"))


def fence_extremes(df: DataFrame, col: str, key: str = "obs_id", n_high: int = 20,
                   n_low: int = 5, k: float = 1.5) -> DataFrame:
    """C4/C5 lists: the ``n_high`` largest upper outliers and the ``n_low``
    smallest lower outliers (ties broken by key). Each list is a global
    top-k (TakeOrderedAndProject: per-partition top-k, then a merge)."""
    b = iqr_bounds(df, [col], k)
    x = _with_bounds(df, b)
    up = (x.filter(F.col(col) > F.col(f"hi_{col}"))
           .orderBy(F.col(col).desc(), F.col(key)).limit(n_high)
           .select(F.lit("upper").alias("side"), key, col))
    lo = (x.filter(F.col(col) < F.col(f"lo_{col}"))
           .orderBy(F.col(col).asc(), F.col(key)).limit(n_low)
           .select(F.lit("lower").alias("side"), key, col))
    both = up.unionByName(lo)
    w = Window.partitionBy("side").orderBy(
        F.when(F.col("side") == "upper", -F.col(col)).otherwise(F.col(col)), F.col(key))
    return both.withColumn("rank", F.row_number().over(w))  # at most n_high + n_low rows


def outlier_list(df: DataFrame, col: str, key: str = "obs_id", n: int = 20, k: float = 1.5,
                 bounds: DataFrame | None = None) -> DataFrame:
    """The ``n`` largest of all outliers, upper and lower ones together
    (ties by key): with few upper outliers the list goes on with lower ones.
    ``bounds`` (from ``iqr_bounds``) may come from another table."""
    b = iqr_bounds(df, [col], k) if bounds is None else bounds
    v = F.col(col)
    top = (_with_bounds(df, b).filter((v > F.col(f"hi_{col}")) | (v < F.col(f"lo_{col}")))
           .select(*dict.fromkeys([key, col]), F.when(v > F.col(f"hi_{col}"), "upper").otherwise("lower").alias("side"))
           .orderBy(v.desc(), F.col(key)).limit(n))
    w = Window.partitionBy().orderBy(v.desc(), F.col(key))
    return top.withColumn("rank", F.row_number().over(w))  # n rows


def group_sigma_filter(df: DataFrame, keys: Sequence[str], col: str = "TIME_GAP",
                       num_std: float = 2.0) -> DataFrame:
    """Per group drop nulls, keep mean +- k * sample std (inclusive).
    One-row groups have a null std and are dropped, as in the source."""
    clean = df.na.drop(how="any")
    stats = clean.groupBy(*keys).agg(F.avg(col).alias("_mean"),
                                     F.stddev_samp(col).alias("_std"))
    j = nullsafe_join(clean, stats, keys)
    lo = F.col("_mean") - F.lit(num_std) * F.col("_std")
    hi = F.col("_mean") + F.lit(num_std) * F.col("_std")
    return j.filter(F.coalesce((F.col(col) >= lo) & (F.col(col) <= hi), F.lit(False))) \
            .select(*df.columns)


def group_sizes(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Surviving rows per group."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def clamp_outliers(df: DataFrame, cols: Sequence[str], k: float = 1.5) -> DataFrame:
    """Replace values outside the IQR fences by the nearest fence."""
    b = iqr_bounds(df, cols, k)
    x = _with_bounds(df, b)
    for c in cols:
        x = x.withColumn(c, F.least(F.greatest(F.col(c).cast("double"), F.col(f"lo_{c}")),
                                    F.col(f"hi_{c}")))
    return x.select(*df.columns)
