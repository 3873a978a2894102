"""Profiling and aggregation.

Each profile is a single aggregation pass: several key sets share one
``GROUPING SETS`` shuffle, several columns are unpivoted to (column, value)
rows so one partially-aggregated ``groupBy`` serves all of them, and small
grids (histogram bins) come from ``sequence`` on a one-row table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripframe.functions import clock
from tripframe.functions.hashing import md5_mod
from tripframe.operators.positions import attach_scalars
from tripframe.operators.quantiles import exact_quantiles, quantile_name


def sizes_by_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Row count per value of each key, one shuffle for all keys."""
    keys = list(keys)
    g = df.groupingSets([[k] for k in keys], *keys).agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_gid"))
    n = len(keys)
    dim = F.lit(None).cast("string")
    val = F.lit(None).cast("string")
    for i, k in enumerate(keys):
        gid = (2 ** n - 1) - 2 ** (n - 1 - i)  # only key i is grouped
        dim = F.when(F.col("_gid") == gid, F.lit(k)).otherwise(dim)
        val = F.when(F.col("_gid") == gid, F.col(k).cast("string")).otherwise(val)
    return g.select(dim.alias("dim"), val.alias("value"), "n")


def sizes_5min(df: DataFrame, col: str = "DEP_TIME", width: int = 5) -> DataFrame:
    """Rows per ``width``-minute departure bucket, labelled ``HH:mm``."""
    m = clock.minute_of_day(col)
    b = F.floor(m / width) * width
    label = F.format_string("%02d:%02d", (b / 60).cast("int"), (b % 60).cast("int"))
    return df.groupBy(label.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def _unpivot(df: DataFrame, cols: Sequence[str], cast: str) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(c).alias("column"),
                                        F.col(c).cast(cast).alias("value")) for c in cols]))


def describe_num(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, mean, sample std, min, quartiles, max per column. Quartiles
    (pandas' linear interpolation) are selected exactly (``quantiles``); the rest
    is one aggregate over all columns side by side."""
    cols = list(cols)
    probs = (0.25, 0.5, 0.75)
    stats = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    row = df.agg(*[fn(F.col(c).cast("double")).alias(f"{name}_{i}")
                   for i, c in enumerate(cols) for name, fn in stats.items()])
    row = attach_scalars(row, exact_quantiles(df, cols, probs))
    each = [F.struct(F.lit(c).alias("column"), *[F.col(f"{name}_{i}").alias(name) for name in ("count", "mean", "std", "min")],
                     *[F.col(quantile_name(c, p)).alias(f"p{p * 100:g}") for p in probs],
                     F.col(f"max_{i}").alias("max")) for i, c in enumerate(cols)]
    return row.select(F.explode(F.array(*each)).alias("_d")).select("_d.*")


def describe_all(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, unique, top (most frequent; ties -> smallest), freq."""
    long = df.select(_unpivot(df, cols, "string").alias("_kv")).select("_kv.*")
    per_value = (long.filter(F.col("value").isNotNull())
                     .groupBy("column", "value").agg(F.count(F.lit(1)).alias("_c")))
    return per_value.groupBy("column").agg(
        F.sum("_c").alias("count"), F.count(F.lit(1)).alias("unique"),
        F.min_by("value", F.struct(-F.col("_c"), F.col("value"))).alias("top"),
        F.max("_c").alias("freq"))


def describe_mixed(df: DataFrame, numeric: Sequence[str], text: Sequence[str]) -> DataFrame:
    """One row per column of both kinds: ``count``; mean, sample std, min, quartiles
    and max of numeric columns; unique, top and freq of the others (null elsewhere)."""
    num, other = describe_num(df, numeric), describe_all(df, text)
    return num.unionByName(other, allowMissingColumns=True)


def missing_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """E5: nulls per column, only columns with at least one."""
    cols = list(cols or df.columns)
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    long = row.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in cols])).alias("_m"))
    return long.select("_m.*").filter(F.col("missing") > 0)


def class_counts(df: DataFrame, col: str) -> DataFrame:
    """Value counts, descending."""
    return (df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
              .orderBy(F.col("n").desc(), F.col(col)))


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every column pair, long form, one pass. A constant
    column correlates with nothing, itself included (null)."""
    cols = list(cols)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    # Not F.corr: it divides by zero on constant columns in ANSI mode.
    def spread(x, y):
        return F.stddev_pop(F.when(F.col(y).isNotNull(), F.col(x).cast("double")))

    row = df.agg(*[F.try_divide(F.covar_pop(F.col(a).cast("double"), F.col(b).cast("double")),
                                spread(a, b) * spread(b, a)).alias(f"{a}|{b}") for a, b in pairs],
                 *[F.stddev_pop(F.col(a).cast("double")).alias(f"{a}|") for a in cols])
    items = []
    for a, b in pairs:
        v = F.col(f"`{a}|{b}`")
        items.append(F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), v.alias("corr")))
        items.append(F.struct(F.lit(b).alias("col_a"), F.lit(a).alias("col_b"), v.alias("corr")))
    for a in cols:
        items.append(F.struct(F.lit(a).alias("col_a"), F.lit(a).alias("col_b"),
                              F.when(F.col(f"`{a}|`") > 0, F.lit(1.0)).alias("corr")))
    return row.select(F.explode(F.array(*items)).alias("_c")).select("_c.*")


def histogram_equal(df: DataFrame, cols: Sequence[str], bins: int = 30) -> DataFrame:
    """``bins`` equal-width bins between each column's min and max; the
    max falls in the last bin (numpy rule); empty bins are kept with 0."""
    long = df.select(_unpivot(df, cols, "double").alias("_kv")).select("_kv.*") \
             .filter(F.col("value").isNotNull())
    rng = long.groupBy("column").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    b = F.when(F.col("_hi") == F.col("_lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col("value") - F.col("_lo")) / width), F.lit(bins - 1))).cast("int")
    # rng has one row per column: a handful of rows, safe to broadcast.
    counts = (long.join(F.broadcast(rng), "column").withColumn("bin", b)
                  .groupBy("column", "bin").agg(F.count(F.lit(1)).alias("n")))
    grid = rng.select("column", "_lo", "_hi",
                      F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    w = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    return (grid.join(counts, ["column", "bin"], "left")
                .select("column", "bin", (F.col("_lo") + F.col("bin") * w).alias("lo"),
                        (F.col("_lo") + (F.col("bin") + 1) * w).alias("hi"),
                        F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n")))


def histogram_fixed(df: DataFrame, col: str, width: float = 60.0, lo: int = 0,
                    hi: int = 50) -> DataFrame:
    """Fixed bins of ``width`` (1 minute for seconds) from lo to hi bins;
    values outside [lo, hi) bins are not counted; empty bins kept."""
    b = F.floor(F.col(col) / F.lit(width)).cast("int")
    counts = (df.select(b.alias("bin")).filter(F.col("bin").between(lo, hi - 1))
                .groupBy("bin").agg(F.count(F.lit(1)).alias("n")))
    grid = counts.sparkSession.range(lo, hi).select(F.col("id").cast("int").alias("bin"))
    return (grid.join(counts, "bin", "left")
                .select("bin", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


def time_profile(df: DataFrame, keys: Sequence[str] = ("BUSROUTE_ID", "BUSSTOP_ID"),
                 col: str = "TIME_GAP", time_col: str = "DEP_TIME", bin_minutes: int = 10,
                 window: int = 1, hour_range: tuple[int, int] = (5, 24)) -> DataFrame:
    """Per key and ``bin_minutes`` bin, mean of ``col`` and its centred
    moving mean over ``window`` bins (null unless the window is full, like
    pandas rolling(center=True)). The window runs on the aggregated bins
    (at most 1440/bin_minutes rows per key), not on raw rows."""
    if window % 2 != 1:
        raise ValueError("window must be odd")
    h = clock.hour_of(time_col)
    m = clock.minute_of_day(time_col)
    base = df.filter(F.coalesce(h.between(*hour_range), F.lit(False)))
    binned = base.withColumn("bin", (F.floor(m / bin_minutes) * bin_minutes).cast("int"))
    agg = binned.groupBy(*keys, "bin").agg(F.avg(col).alias("mean"))
    half = window // 2
    w = Window.partitionBy(*keys).orderBy("bin").rowsBetween(-half, half)
    return agg.withColumn("moving_mean", F.when(F.count(F.lit(1)).over(w) == window,
                                                F.avg("mean").over(w)))


def combos(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct key combinations."""
    return df.select(*cols).distinct()


def bucket_collisions(df: DataFrame, col: str, n_buckets: int) -> DataFrame:
    """How md5 buckets share ids: ids, occupied buckets, mean and max
    ids per occupied bucket."""
    ids = df.select(col).distinct()
    per = ids.groupBy(md5_mod(col, n_buckets).alias("bucket")).agg(
        F.count(F.lit(1)).alias("ids"))
    return per.agg(F.sum("ids").alias("n_ids"), F.count(F.lit(1)).alias("occupied"),
                   F.avg("ids").alias("mean_ids_per_bucket"), F.max("ids").alias("max_ids"))


def singletons(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values seen exactly once."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
              .filter(F.col("_n") == 1).select(*keys))
