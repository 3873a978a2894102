"""Fixed-length sequences over ordered groups.

A row's input is the ``length`` rows before it in its group (by departure
time, then row key); groups with at most ``length`` rows give nothing.
The order of a group of any size is cut into chunks of ``chunk`` positions
(exact positions from ``positions.position``); the last ``length`` rows of each
chunk are copied into the next chunk as context, and the sliding window runs
per (group, chunk). Work per task is bounded by ``chunk + length`` rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripframe.operators import positions


def sliding_sequences(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                      step_cols: Sequence[str], length: int = 5, key: str = "obs_id",
                      chunk: int = 4096) -> DataFrame:
    """One row per target row that has ``length`` predecessors, with
    ``seq`` = array of structs(step_cols), oldest first, and its ``obs_id``."""
    keys, order = list(keys), list(order)
    if chunk <= length:
        raise ValueError("chunk must exceed the sequence length")
    steps = F.struct(*[F.col(c) for c in step_cols])
    pos = positions.position(df, keys, order + [key], name="_pos")
    ch = F.floor(F.col("_pos") / chunk)
    tail = (F.col("_pos") % chunk) >= (chunk - length)
    copies = F.when(tail, F.array(F.struct(ch.alias("_chunk"), F.lit(False).alias("_ctx")),
                                  F.struct((ch + 1).alias("_chunk"), F.lit(True).alias("_ctx"))))\
              .otherwise(F.array(F.struct(ch.alias("_chunk"), F.lit(False).alias("_ctx"))))
    x = pos.withColumn("_c", F.explode(copies)).select("*", "_c._chunk", "_c._ctx").drop("_c")
    wc = (Window.partitionBy(*keys, "_chunk").orderBy("_pos")
                .rowsBetween(-length, -1))
    return (x.withColumn("seq", F.collect_list(steps).over(wc))
             .filter(~F.col("_ctx") & (F.size("seq") == length))
             .drop("_pos", "_chunk", "_ctx"))


def backfill(rows: DataFrame, scored: DataFrame, est_col: str = "TIME_GAP_ESTIMATE",
             key: str = "obs_id", default: int = -1) -> DataFrame:
    """Every row gets the estimate of its sequence, or ``default``
    where it had none (join on the row key, never on position)."""
    s = scored.select(key, F.col(est_col).alias("_est"))
    return (rows.join(s, key, "left")
                .withColumn(est_col, F.coalesce(F.col("_est"), F.lit(default)).cast("int"))
                .drop("_est"))


def padded_short_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                        value: str, length: int = 5, key: str = "obs_id",
                        pad=0) -> DataFrame:
    """Groups shorter than ``length`` as one zero-padded sequence each.

    Group sizes come from a partial aggregate; only groups already known to
    be short (< length rows) are collected, so no collect is unbounded."""
    keys = list(keys)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    short = positions.nullsafe_join(df, sizes.filter(F.col("_n") < length), keys)
    ordered = F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in order], F.col(key),
                                                   F.col(value).alias("_v"))))
    g = short.groupBy(*keys).agg(ordered.alias("_s"), F.first("_n").alias("_n"))
    vals = F.transform(F.col("_s"), lambda s: s["_v"])
    padv = F.array_repeat(F.lit(pad).cast(df.schema[value].dataType), F.lit(length) - F.col("_n").cast("int"))
    return g.select(*keys, F.concat(vals, padv).alias("seq"))


def last_step_weight(seq: Column, field: str, threshold: float = 0.5,
                     high: float = 3.0, low: float = 1.0) -> Column:
    """``high`` if the last step's ``field`` >= threshold, else ``low``."""
    return F.when(F.element_at(seq, -1)[field] >= threshold, F.lit(high)).otherwise(F.lit(low))
