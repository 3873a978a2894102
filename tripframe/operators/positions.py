"""Exact positions in an order without one-task windows (helper H0).

A global ``row_number() over (order by ...)`` runs in a single task, and a
per-group one puts a hot group (a third of all rows) in one task. One plan
serves groups of every size instead:

1. rows are range-partitioned on (group, order); the order ends in the row
   key, so ties and hot groups are cut wherever the ranges fall;
2. the ranged rows are written once (shared checkpoint folder) with their
   range number, which pins the ranges for the steps below;
3. one partially aggregated ``groupBy(group, range).count()`` gives sizes, and
   a running sum over that table (for a group, at most one row per range)
   the offset of each (group, range);
4. the position is ``offset + row_number()`` inside one (group, range).

The input is read twice: once to find the range borders, once to write.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OFF, GN, RANGE = "_off", "_gn", "_range"


def attach_scalars(df: DataFrame, one_row: DataFrame, cols: Sequence[str] | None = None
                   ) -> DataFrame:
    """Add the columns of a one-row aggregate (fit statistics, fences,
    totals) to every row as scalar subqueries: no join, the value is
    computed once, Catalyst merges subqueries over the same aggregate and
    the value can prune scans like a literal."""
    cols = list(cols) if cols is not None else one_row.columns
    return df.withColumns({c: one_row.select(c).scalar() for c in cols})


def nullsafe_join(left: DataFrame, right: DataFrame, keys: Sequence[str],
                  how: str = "inner") -> DataFrame:
    """Equi-join where null keys match null keys (pandas groupby-like)."""
    keys = list(keys)
    if not keys:
        raise ValueError("nullsafe_join needs at least one key")
    renamed = right
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"__r_{k}")
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(renamed[f"__r_{k}"])
        cond = c if cond is None else cond & c
    out = left.join(renamed, cond, how)
    return out.drop(*[f"__r_{k}" for k in keys])


def position(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str],
             name: str = "_pos", keep_counts: bool = False, parts: int | None = None) -> DataFrame:
    """Exact 0-based position of every row in ``order_cols`` within its group
    (null keys form groups of their own). ``order_cols`` must end in a key
    that tells the group's rows apart. ``keep_counts`` adds the group size."""
    from tripframe.sources.files import stage_table

    group_cols, order_cols = list(group_cols), list(order_cols)
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stage_table(df.repartitionByRange(parts, *group_cols, *order_cols)
                         .withColumn(RANGE, F.spark_partition_id()), "positions")
    counts = ranged.groupBy(*group_cols, RANGE).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*group_cols)
    counts = counts.select(
        *group_cols, RANGE, F.sum("_n").over(w).alias(GN),
        (F.sum("_n").over(w.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias(OFF))
    inside = Window.partitionBy(*group_cols, RANGE).orderBy(*order_cols)
    out = nullsafe_join(ranged, counts, [*group_cols, RANGE]).withColumn(
        name, F.col(OFF) + F.row_number().over(inside) - 1)
    return out.drop(RANGE, OFF, *([] if keep_counts else [GN]))


def label_at(pos: Column, cuts: Sequence[Column], labels: Sequence) -> Column:
    """labels[i] for the first cut with pos < cut, else the last label."""
    expr = F.lit(labels[-1])
    for cut, lab in reversed(list(zip(cuts, labels[:-1]))):
        expr = F.when(pos < cut, F.lit(lab)).otherwise(expr)
    return expr


def assign_by_cuts(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str],
                   cuts_of_n, labels: Sequence, name: str) -> DataFrame:
    """Label rows by position against cut points that depend on group size.
    ``cuts_of_n(gn)`` returns nondecreasing Columns."""
    x = position(df, group_cols, order_cols, "_pos", keep_counts=True)
    return x.withColumn(name, label_at(F.col("_pos"), cuts_of_n(F.col(GN)), labels)).select(*df.columns, name)
