"""Fitted encoders and scalers (F13-F19) as fit tables.

A fit is an aggregate that yields a small table (one row for scalers, one
row per distinct label for vocabularies). One-row fit tables reach the
rows as scalar subqueries (no join); vocabularies are joined and left to AQE,
which broadcasts them only when their measured size is under the
threshold and otherwise keeps a shuffle join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripframe.functions.text import zfill
from tripframe.operators import positions


# F13 standard scaler -------------------------------------------------------
def fit_standard(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """mean_c and scale_c (population std; 0 or undefined -> 1), optionally
    per group ``by`` (F13b refit per set)."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"mean_{c}"), F.stddev_pop(x).alias(f"_sd_{c}")]
    fit = df.groupBy(*by).agg(*aggs)
    for c in cols:
        sd = F.col(f"_sd_{c}")
        fit = fit.withColumn(f"scale_{c}", F.when(sd.isNull() | (sd == 0), F.lit(1.0)).otherwise(sd))
    return fit.drop(*[f"_sd_{c}" for c in cols])


def _attach(df: DataFrame, fit: DataFrame, by: Sequence[str]) -> DataFrame:
    if by:
        return positions.nullsafe_join(df, fit, list(by))
    return positions.attach_scalars(df, fit)  # one-row fit table


def apply_standard(df: DataFrame, fit: DataFrame, cols: Sequence[str],
                   suffix: str = "_scaled", by: Sequence[str] = ()) -> DataFrame:
    x = _attach(df, fit, by)
    for c in cols:
        x = x.withColumn(f"{c}{suffix}", (F.col(c) - F.col(f"mean_{c}")) / F.col(f"scale_{c}"))
    return x.select(*df.columns, *[f"{c}{suffix}" for c in cols])


def invert_standard(df: DataFrame, fit: DataFrame, scaled: str, col: str,
                    out: str) -> DataFrame:
    """Back to the original scale: scaled * scale_col + mean_col."""
    x = _attach(df, fit, ())
    return x.withColumn(out, F.col(scaled) * F.col(f"scale_{col}") + F.col(f"mean_{col}")) \
            .select(*df.columns, out)


# F14 / F15 min-max ---------------------------------------------------------
def fit_minmax(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.agg(*[e for c in cols for e in (F.min(F.col(c).cast("double")).alias(f"min_{c}"),
                                              F.max(F.col(c).cast("double")).alias(f"max_{c}"))])


def apply_minmax(df: DataFrame, fit: DataFrame, cols: Sequence[str],
                 suffix: str = "_mm") -> DataFrame:
    """(x - min) / (max - min); a zero range divides by 1. Values outside
    the fitted range leave [0, 1], as with a scaler fit on train only."""
    x = positions.attach_scalars(df, fit)
    for c in cols:
        rng = F.col(f"max_{c}") - F.col(f"min_{c}")
        x = x.withColumn(f"{c}{suffix}", (F.col(c) - F.col(f"min_{c}")) /
                         F.when(rng == 0, F.lit(1.0)).otherwise(rng))
    return x.select(*df.columns, *[f"{c}{suffix}" for c in cols])


def minmax_by_group(df: DataFrame, cols: Sequence[str], keys: Sequence[str],
                    suffix: str = "_mm") -> DataFrame:
    """min-max within each group (aggregate + join, no window); a
    constant group maps to 0.0."""
    stats = df.groupBy(*keys).agg(*[e for c in cols for e in (
        F.min(F.col(c).cast("double")).alias(f"min_{c}"),
        F.max(F.col(c).cast("double")).alias(f"max_{c}"))])
    x = positions.nullsafe_join(df, stats, list(keys))
    for c in cols:
        rng = F.col(f"max_{c}") - F.col(f"min_{c}")
        x = x.withColumn(f"{c}{suffix}", F.when(rng == 0, F.lit(0.0))
                         .otherwise((F.col(c) - F.col(f"min_{c}")) / rng))
    return x.select(*df.columns, *[f"{c}{suffix}" for c in cols])


# F16-F19 label vocabularies -------------------------------------------------
def label_vocabulary(df: DataFrame, col: str, parts: int | None = None) -> DataFrame:
    """F16: sorted distinct (string) values -> codes 0..n-1.

    Codes are exact positions in value order (``positions``), so no task ever
    holds the whole vocabulary."""
    vals = (df.select(F.col(col).cast("string").alias("value"))
              .filter(F.col("value").isNotNull()).distinct())
    return (positions.position(vals, [], ["value"], name="_code", parts=parts)
            .select("value", F.col("_code").cast("int").alias("code")))


def encode_known(df: DataFrame, vocab: DataFrame, col: str, out: str = "code") -> DataFrame:
    """keep rows whose id is in the vocabulary, with its code (inner
    join = semi join + lookup)."""
    v = vocab.withColumnRenamed("value", "_v").withColumnRenamed("code", out)
    return df.join(v, F.col(col).cast("string") == F.col("_v"), "inner").drop("_v")


def unknown_labels(df: DataFrame, vocab: DataFrame, col: str) -> DataFrame:
    """distinct ids absent from the vocabulary."""
    ids = df.select(F.col(col).cast("string").alias("value")).filter(F.col("value").isNotNull())
    return ids.join(vocab, "value", "left_anti").distinct()


def decode_labels(df: DataFrame, vocab: DataFrame, code_col: str, out: str,
                  width: int = 9) -> DataFrame:
    """code -> id, left-padded with zeros to ``width`` (never truncated)."""
    v = vocab.select(F.col("code").alias("_c"), F.col("value").alias("_v"))
    return (df.join(v, F.col(code_col) == F.col("_c"), "left")
              .withColumn(out, zfill(F.col("_v"), width)).drop("_c", "_v"))


def extend_vocabulary(vocab: DataFrame, df: DataFrame, col: str) -> DataFrame:
    """append unseen ids (in sorted order) after the current max code."""
    new = unknown_labels(df, vocab, col)
    new_codes = label_vocabulary(new, "value")
    top = vocab.agg(F.coalesce(F.max("code"), F.lit(-1)).alias("_max"))
    added = (positions.attach_scalars(new_codes, top)
                      .select("value", (F.col("code") + F.col("_max") + 1).cast("int").alias("code")))
    return vocab.unionByName(added)
