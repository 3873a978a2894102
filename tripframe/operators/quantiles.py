"""Exact quantiles by selection, without a value map in one task.

One pass counts the rows per distinct value of all wanted columns (partially
aggregated before the shuffle). The counts are range-partitioned by (column, value)
and written once; a count per range gives every range its offset, so the
few ranges that hold a wanted position are known. Only those are sorted and summed
up, and the two values beside each position are interpolated. No task holds more
than one range, whatever the number of distinct values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripframe.sources.files import stage_table


def quantile_name(col: str, prob: float) -> str:
    return f"q{prob:g}_{col}".replace(".", "_")


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """One row: ``quantile_name(c, p)`` for every column and probability, with linear
    interpolation between the neighbouring values (position ``p * (n - 1)``). Nulls
    and NaN are left out; a column without values gives null. Computed at once: the row
    is a local table, so what it is attached to reads no file for it."""
    cols = list(cols)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v"))
                            for i, c in enumerate(cols)]))
    counts = (df.select(x.alias("x")).select("x.*").filter("v is not null and not isnan(v)")
              .groupBy("c", "v").agg(F.count(F.lit(1)).alias("n")))
    counts = stage_table(counts.repartitionByRange(parts, "c", "v").withColumn("r", F.spark_partition_id()), "value_counts")
    w = Window.partitionBy("c")
    ranges = counts.groupBy("c", "r").agg(F.sum("n").alias("m")).select(
        "c", "r", "m", F.sum("m").over(w).alias("total"),
        (F.sum("m").over(w.orderBy("r").rowsBetween(Window.unboundedPreceding, 0)) - F.col("m")).alias("off"))

    def places(p: float):
        at = F.lit(float(p)) * (F.col("total") - 1)
        return F.floor(at), F.ceil(at), at - F.floor(at)

    def holds(at, start, size):
        return (at >= start) & (at < start + size)

    wanted = F.lit(False)
    for p in probs:
        for at in places(p)[:2]:
            wanted = wanted | holds(at, F.col("off"), F.col("m"))
    inside = Window.partitionBy("c", "r").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    near = counts.join(ranges.filter(wanted), ["c", "r"]).withColumn(
        "first", F.col("off") + F.sum("n").over(inside) - F.col("n"))
    picks, out = [], []
    for i, c in enumerate(cols):
        for j, p in enumerate(probs):
            low, high, part = places(p)
            for name, at in (("l", low), ("h", high)):
                picks.append(F.max(F.when((F.col("c") == i) & holds(at, F.col("first"), F.col("n")), F.col("v")))
                             .alias(f"{name}{i}_{j}"))
            picks.append(F.max(F.when(F.col("c") == i, part)).alias(f"p{i}_{j}"))
            lo, hi = F.col(f"l{i}_{j}"), F.col(f"h{i}_{j}")
            out.append(F.when(lo == hi, lo).otherwise(lo + (hi - lo) * F.col(f"p{i}_{j}")).alias(quantile_name(c, p)))
    row = near.agg(*picks).select(*out)
    return df.sparkSession.createDataFrame([row.first()], row.schema)
