"""Projections, filters and cleaning rules.

Each operator is ``f(df, ...) -> DataFrame``: lazy, no action, no collect.
Row rules are plain filters (pushed to the scan where possible); both
dedups are hash aggregates with map-side partial aggregation, so a hot key
is combined before the shuffle instead of being sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripframe.functions import clock
from tripframe.operators.positions import attach_scalars, nullsafe_join
from tripframe.operators.quantiles import exact_quantiles, quantile_name

KEY = "obs_id"
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
           T.DoubleType, T.DecimalType)


def _payload(df: DataFrame, key: str | None = KEY) -> list[str]:
    return [c for c in df.columns if c != key]


def numeric_columns(df: DataFrame, exclude: Sequence[str] = (KEY,)) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC) and f.name not in exclude]


# B1 ------------------------------------------------------------------------
def zero_filter(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Drop a row when any numeric column equals 0; nulls and strings pass."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.coalesce(F.col(c) != 0, F.lit(True))
    return df.filter(cond)


# B2-B4 ---------------------------------------------------------------------
def drop_all_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Drop rows whose (payload) columns are all null; the row key is ignored."""
    return df.na.drop(how="all", subset=list(cols) if cols else _payload(df))


def drop_blank(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop rows null, or empty after trimming, in any of ``cols``."""
    cond = F.lit(True)
    types = dict(df.dtypes)
    for c in cols:
        ok = F.col(c).isNotNull()
        if types[c] == "string":
            ok = ok & (F.trim(F.col(c)) != "")
        cond = cond & ok
    return df.filter(cond)


def drop_any_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.na.drop(how="any", subset=list(cols))


# B5 ------------------------------------------------------------------------
def tighten_types(df: DataFrame, trunc_cols: Sequence[str] = ("TIME_GAP",),
                  round_cols: Sequence[str] = ("SPEED",)) -> DataFrame:
    """TIME_GAP truncates to int; SPEED rounds half-to-even, then int."""
    out = df
    for c in trunc_cols:
        out = out.withColumn(c, F.col(c).try_cast("int"))
    for c in round_cols:
        out = out.withColumn(c, F.bround(F.col(c), 0).try_cast("int"))
    return out


# B6/B7 rule lists ------------------------------------------------------------
def travel_row_rules() -> list[tuple[str, Column]]:
    """Row-level travel rules in their source order (dedups sit between)."""
    return [
        ("time_gap_5_300", (F.col("TIME_GAP") > 5) & (F.col("TIME_GAP") <= 300)),
        ("speed_5_55", (F.col("SPEED") > 5) & (F.col("SPEED") <= 55)),
        ("gps_nonzero", F.coalesce(F.col("GPS_COORDX") != 0, F.lit(True))
                        & F.coalesce(F.col("GPS_COORDY") != 0, F.lit(True))),
        ("time_slots", clock.in_slots("DEP_TIME")),
    ]


TRAVEL_KEY = ("BUSROUTE_ID", "BUSINFOUNIT_ID", "DEP_TIME")


def _passes(rule: Column) -> Column:
    return F.coalesce(rule, F.lit(False))


# B9 ------------------------------------------------------------------------
def dedup_exact(df: DataFrame, key: str | None = KEY) -> DataFrame:
    """Exact duplicates (all columns but the row key) keep the first row."""
    if key is None or key not in df.columns:
        return df.dropDuplicates()
    payload = _payload(df, key)
    return (df.groupBy(*payload).agg(F.min(key).alias(key))
              .select(*df.columns))


# B10 -----------------------------------------------------------------------
def dedup_first(df: DataFrame, keys: Sequence[str], order: str = KEY) -> DataFrame:
    """Keep the first row (smallest ``order``) of every key; null keys group."""
    rest = [c for c in df.columns if c not in keys]
    agg = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.col(order)).alias("_first"))
    return agg.select(*keys, "_first.*").select(*df.columns)


# B11 -----------------------------------------------------------------------
def duplicates(df: DataFrame, key: str | None = KEY) -> DataFrame:
    """Second and later copies of exact duplicates.

    With a row key the copies are listed; without one (true duplicates) each
    duplicated row is listed once with its number of extra ``copies``.
    """
    if key is None or key not in df.columns:
        payload = list(df.columns)
        return (df.groupBy(*payload).agg(F.count(F.lit(1)).alias("_n"))
                  .filter(F.col("_n") > 1)
                  .select(*payload, (F.col("_n") - 1).alias("copies")))
    payload = _payload(df, key)
    firsts = (df.groupBy(*payload)
                .agg(F.min(key).alias("_first"), F.count(F.lit(1)).alias("_n"))
                .filter(F.col("_n") > 1))
    out = nullsafe_join(df, firsts, payload)
    return out.filter(F.col(key) != F.col("_first")).select(*df.columns)


# B6 ------------------------------------------------------------------------
def travel_quality(df: DataFrame) -> DataFrame:
    """LEN>0; exact dedup; 5<TIME_GAP<=300; 5<SPEED<=55; GPS != 0; slots;
    keep first per (route, segment, DEP_TIME)."""
    out = dedup_exact(df.filter(F.col("LEN") > 0))
    for _, rule in travel_row_rules():
        out = out.filter(_passes(rule))
    return dedup_first(out, list(TRAVEL_KEY))


def travel_quality_audit(df: DataFrame) -> DataFrame:
    """Rows removed per numbered step plus the kept count (in = kept + sum).

    Every figure comes from aggregates: exact duplicates are counted as
    rows minus groups, keyed duplicates as survivors minus keys, so no
    per-row window is needed and hot keys are combined map-side.
    """
    rules = travel_row_rules()
    names = (["len_positive", "exact_duplicates"] + [n for n, _ in rules]
             + ["key_duplicates"])
    n_in = df.agg(F.count(F.lit(1)).alias("n_in"))
    s1 = df.filter(F.col("LEN") > 0)
    groups = s1.groupBy(*_payload(s1)).agg(F.count(F.lit(1)).alias("_n"))
    step_expr = F.lit(None).cast("int")
    for i, (_, rule) in reversed(list(enumerate(rules))):
        step_expr = F.when(~_passes(rule), F.lit(i + 3)).otherwise(step_expr)
    tagged = groups.withColumn("_step", step_expr)
    per_rule = tagged.agg(
        F.sum("_n").alias("rows1"), F.count(F.lit(1)).alias("grps"),
        *[F.count_if(F.col("_step") == i + 3).alias(f"r{i + 3}")
          for i in range(len(rules))])
    keyed = (tagged.filter(F.col("_step").isNull())
                   .groupBy(*TRAVEL_KEY).agg(F.count(F.lit(1)).alias("_k")))
    tail = keyed.agg(F.coalesce(F.sum(F.col("_k") - 1), F.lit(0)).alias("dups"),
                     F.count(F.lit(1)).alias("kept"))
    removed = ([F.col("n_in") - F.coalesce(F.col("rows1"), F.lit(0)),
                F.coalesce(F.col("rows1"), F.lit(0)) - F.col("grps")]
               + [F.col(f"r{i + 3}") for i in range(len(rules))]
               + [F.col("dups"), F.col("kept")])
    labels = names + ["kept"]
    steps = list(range(1, len(names) + 1)) + [0]
    rows = F.array(*[F.struct(F.lit(s).alias("step"), F.lit(n).alias("rule"),
                              r.cast("bigint").alias("removed"))
                     for s, n, r in zip(steps, labels, removed)])
    one = attach_scalars(attach_scalars(per_rule, n_in), tail)
    return one.select(F.inline(rows))


# B7 ------------------------------------------------------------------------
def holding_quality(df: DataFrame) -> DataFrame:
    """Exact dedup, then 0 < TIME_GAP <= 120."""
    out = dedup_exact(df)
    return out.filter((F.col("TIME_GAP") > 0) & (F.col("TIME_GAP") <= 120))


# B8 / B16 / B17 -------------------------------------------------------------
def slot_filter(df: DataFrame, col: str = "DEP_TIME", slots=clock.TIME_SLOTS) -> DataFrame:
    return df.filter(_passes(clock.in_slots(col, slots)))


def clock_range_filter(df: DataFrame, col: str = "DEP_TIME") -> DataFrame:
    hh, mm, ss = clock.split_hms(col)
    return (df.withColumn("hh", hh).withColumn("mm", mm).withColumn("ss", ss)
              .filter(_passes(clock.clock_in_range(F.col("hh"), F.col("mm"), F.col("ss")))))


def hour_window(df: DataFrame, col: str = "DEP_TIME", lo: int = 5, hi: int = 24) -> DataFrame:
    return df.filter(_passes(clock.hour_of(col).between(lo, hi)))


# B12/B13 -------------------------------------------------------------------
def parse_two_formats(df: DataFrame, cols: Sequence[str] = ("ARR_DATE", "DEP_DATE"),
                      time_col: str | None = "DEP_TIME") -> DataFrame:
    """Parse both layouts, drop rows null in any, add ``HH:mm:ss`` of DEP_DATE."""
    out = df
    for c in cols:
        out = out.withColumn(c, clock.two_format_timestamp(c))
    out = out.na.drop(subset=list(cols))
    if time_col:
        out = out.withColumn(time_col, F.date_format(cols[-1], "HH:mm:ss"))
    return out


# B18 -----------------------------------------------------------------------
def derived_speed(length="LEN", gap="TIME_GAP", zero_gap: str = "null") -> Column:
    """km/h from metres and seconds; division by zero gives null, or with
    ``zero_gap="infinity"`` infinity by the sign of the length (0 / 0 stays null)."""
    if zero_gap not in ("null", "infinity"):
        raise ValueError(zero_gap)
    speed = F.try_divide(F.col(length), F.col(gap)) * F.lit(3.6)
    if zero_gap == "null":
        return speed
    far = F.lit(float("inf"))
    return (F.when(F.col(gap) != 0, speed).when((F.col(gap) == 0) & (F.col(length) > 0), far)
            .when((F.col(gap) == 0) & (F.col(length) < 0), -far))


# B19 -----------------------------------------------------------------------
def drop_audit(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows dropped between two tables, count and percent of the original."""
    b = before.agg(F.count(F.lit(1)).alias("rows_before"))
    a = after.agg(F.count(F.lit(1)).alias("rows_after"))
    return (attach_scalars(a, b).select("rows_before", "rows_after")
             .withColumn("rows_dropped", F.col("rows_before") - F.col("rows_after"))
             .withColumn("pct_dropped", F.try_divide(F.col("rows_dropped") * F.lit(100.0),
                                                     F.col("rows_before"))))


# B21 -----------------------------------------------------------------------
def to_minutes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    out = df
    for c in cols:
        out = out.withColumn(f"{c}_MIN", F.col(c) / F.lit(60.0))
    return out


# B22 -----------------------------------------------------------------------
def impute(df: DataFrame, cols: Sequence[str], strategy: str = "mean") -> DataFrame:
    """Fill nulls with the column mean or median (one-row fit table; the median
    is selected exactly, see ``quantiles``)."""
    if strategy not in ("mean", "median"):
        raise ValueError(strategy)
    if strategy == "mean":
        fit = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"_fill_{c}") for c in cols])
    else:
        fit = exact_quantiles(df, cols, (0.5,)).select(
            *[F.col(quantile_name(c, 0.5)).alias(f"_fill_{c}") for c in cols])
    out = attach_scalars(df, fit)
    for c in cols:
        out = out.withColumn(c, F.coalesce(F.col(c).cast("double"), F.col(f"_fill_{c}")))
    return out.drop(*[f"_fill_{c}" for c in cols])
