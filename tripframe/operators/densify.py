"""Minute-grid densification (H1-H4).

The grid is tiny and bounded (at most 1440 minute labels) and is generated
per id row with ``explode``; ids x grid is the output size itself. The minutes that an
id has are gathered with its first row in one aggregate (at most a grid's worth per id),
so the missing ones are made in place: no (id, minute) pair is shuffled to find them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripframe.functions import clock


def _mins(t: str) -> int:
    hh, mm = t.split(":")
    return int(hh) * 60 + int(mm)


def grid_minutes(slots=clock.TIME_SLOTS) -> Column:
    """H1 as an expression: array of the minutes of day of the inclusive slots."""
    return F.array_distinct(F.concat(*[F.sequence(F.lit(_mins(a)), F.lit(_mins(b)))
                                       for a, b in slots]))


def grid_labels(slots=clock.TIME_SLOTS) -> list[str]:
    """H1 as values: the ``HH:mm`` labels of the inclusive slots, each once."""
    minutes = dict.fromkeys(m for a, b in slots for m in range(_mins(a), _mins(b) + 1))
    return [f"{m // 60:02d}:{m % 60:02d}" for m in minutes]


def minute_label(m: Column) -> Column:
    return F.format_string("%02d:%02d", (m / 60).cast("int"), (m % 60).cast("int"))


def minute_grid(spark: SparkSession, slots=clock.TIME_SLOTS, name: str = "DEP_TIME") -> DataFrame:
    """H1: every ``HH:mm`` label of the inclusive slots (3 x 121 = 363)."""
    g = spark.range(1).select(F.explode(grid_minutes(slots)).alias("_m"))
    return g.select(minute_label(F.col("_m")).alias(name))


def fill_minutes(full: DataFrame, keys: Sequence[str], first_cols: Sequence[str],
                 fill: dict, time_col: str = "DEP_TIME", order: str = "obs_id",
                 slots=clock.TIME_SLOTS, keep_cols: Sequence[str] | None = None) -> DataFrame:
    """H2/H3 + H4: slot-filtered rows plus one generated row for every id of
    the *full* table and grid minute the filtered rows lack. Generated rows
    copy ``first_cols`` from the id's first row (smallest ``order``) and take
    the ``fill`` literals (e.g. TIME_GAP -1, speed 0)."""
    keys = list(keys)
    keep_cols = list(keep_cols) if keep_cols else keys + list(first_cols) + [time_col] + list(fill)
    in_slot = F.coalesce(clock.in_slots(time_col, slots), F.lit(False))
    observed = full.filter(in_slot)
    labels = grid_labels(slots)
    on_grid = in_slot & F.col(time_col).isin(labels)
    firsts = (full.groupBy(*keys)
                  .agg(F.min_by(F.struct(*[F.col(c) for c in first_cols]), F.col(order)).alias("_f"),
                       F.collect_set(F.when(on_grid, F.col(time_col))).alias("_seen"))
                  .select(*keys, "_f.*", "_seen"))
    # each id row generates the grid minutes (<= 1440) that it lacks in place: no join
    lacking = F.array_except(F.array(*[F.lit(m) for m in labels]), F.col("_seen"))
    missing = firsts.withColumn(time_col, F.explode(lacking)).drop("_seen")
    for c, v in fill.items():
        missing = missing.withColumn(c, F.lit(v))
    gen = missing.select(*[F.col(c).cast(full.schema[c].dataType) if c in full.columns
                           else F.col(c) for c in keep_cols])
    obs = observed.select(*[F.col(c).cast(gen.schema[c].dataType) for c in keep_cols])
    return obs.unionByName(gen)


def ordered(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """H4: final order by time (then ids): a range-partitioned sort."""
    return df.orderBy(*cols)
