"""Adapters: present the driver's tables in the trip-observation schemas.

They only rename and retype columns (a projection per row, no shuffle), so
every operator downstream reads real rows whose volume grows with the
tables. The same mappings are written in DuckDB SQL in
``tripframe.plans.sqlviews`` for the correctness gate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripframe.functions import clock
from tripframe.functions.text import zfill


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The driver table ``name``: a plain scan, so filters and column lists of
    a query reach it at every size."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _k(props: Column) -> Column:
    return F.get_json_object(props, "$.k").cast("int")


def travel_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 ``travel_obs`` from ``events`` (one row per event)."""
    return travel_obs_from(table(spark, sf_dir, "events"))


def travel_obs_from(ev: DataFrame) -> DataFrame:
    """The ``travel_obs`` projection of an events frame (batch or stream)."""
    k = _k(F.col("props"))
    length = (k * 20).cast("int")
    gap = F.floor("value").cast("int")
    return ev.select(
        F.col("event_id").alias("obs_id"),
        F.dayofweek("ts").cast("tinyint").alias("DAY_TYPE"),
        F.col("event_type").alias("BUSROUTE_ID"),
        (k % 12).cast("smallint").alias("PEEK_ALLOC"),
        (k % 7 + 3).cast("smallint").alias("NPEEK_ALLOC"),
        (F.col("user_id") % 10 * 1500 + 20000).cast("int").alias("ROUTE_LEN"),
        (F.col("user_id") % 40 + 20).cast("smallint").alias("BUSSTOP_CNT"),
        (k % 40 + 1).cast("smallint").alias("INFOUNIT_SEQ"),
        zfill(F.col("user_id").cast("string"), 9).alias("BUSINFOUNIT_ID"),
        length.alias("LEN"),
        F.when(k % 25 == 0, F.lit(0.0))
         .otherwise(F.lit(126.9) + k / F.lit(1000.0)).cast("float").alias("GPS_COORDX"),
        F.when(F.col("user_id") % 30 == 0, F.lit(0.0))
         .otherwise(F.lit(37.5) + F.col("user_id") / F.lit(10000.0)).cast("float")
         .alias("GPS_COORDY"),
        F.date_format("ts", "yyyy-MM-dd").alias("COLLECT_DATE"),
        F.date_format("ts", "HH:mm").alias("DEP_TIME"),
        gap.alias("TIME_GAP"),
        F.bround(F.try_divide(length, gap) * F.lit(3.6), 0).cast("int").alias("SPEED"),
        F.when(F.col("event_type").isin("click", "purchase", "error"), F.lit("EVENT"))
         .otherwise(F.lit("PATRN")).alias("DATA_TYPE"),
    )


def holding_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2 ``holding_obs`` from ``events``: stop = user, dwell = floor(value)."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("obs_id"),
        F.dayofweek("ts").cast("tinyint").alias("DAY_TYPE"),
        F.col("event_type").alias("BUSROUTE_ID"),
        F.col("user_id").cast("string").alias("BUSSTOP_ID"),
        F.date_format("ts", "yyyy-MM-dd").alias("COLLECT_DATE"),
        F.date_format("ts", "HH:mm").alias("DEP_TIME"),
        F.floor("value").cast("int").alias("TIME_GAP"),
    )


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3 ``raw_events``: date strings in the two source formats plus junk.

    DEP_DATE is date-only for one event in three and unparsable for users
    divisible by 37, so the two-format parser sees all three cases.
    """
    ev = table(spark, sf_dir, "events")
    full = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    dep = (F.when(F.col("user_id") % 37 == 0, F.lit("n/a"))
            .when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd"))
            .otherwise(full))
    return ev.select(
        F.col("event_id").alias("obs_id"),
        full.alias("ARR_DATE"),
        dep.alias("DEP_DATE"),
        F.dayofweek("ts").cast("tinyint").alias("DAY_TYPE"),
        F.col("event_type").alias("BUSROUTE_ID"),
        F.col("user_id").cast("string").alias("LOCATION_ID"),
        F.floor("value").cast("int").alias("TIME_GAP"),
    )


def line_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scale-run observations from ``lineitem`` (no row key).

    route = supplier, segment = part, date = ship date, TIME_GAP = quantity,
    LEN = extended price / 50. Every ship date is at midnight.
    """
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.dayofweek("l_shipdate").cast("tinyint").alias("DAY_TYPE"),
        F.col("l_suppkey").cast("string").alias("BUSROUTE_ID"),
        zfill(F.col("l_partkey").cast("string"), 9).alias("BUSINFOUNIT_ID"),
        (F.col("l_extendedprice") / 50).cast("int").alias("LEN"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("COLLECT_DATE"),
        F.col("l_quantity").cast("int").alias("TIME_GAP"),
        F.col("l_returnflag").alias("FLAG"),
    )


def line_coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as observations of few routes, segments and months, so that
    equal rows and values beyond both fences occur (no row key)."""
    li = table(spark, sf_dir, "lineitem")
    tens = (F.floor(F.col("l_quantity") / 10) * 10).cast("int")
    return li.select(
        (F.month("l_shipdate") % 7 + 1).cast("tinyint").alias("DAY_TYPE"),
        (F.col("l_suppkey") % 5).cast("string").alias("BUSROUTE_ID"),
        zfill((F.col("l_partkey") % 20).cast("string"), 9).alias("BUSINFOUNIT_ID"),
        (F.floor(F.col("l_extendedprice") / 5000) * 100 + 100).cast("int").alias("LEN"),
        F.trunc("l_shipdate", "MM").cast("string").alias("COLLECT_DATE"),
        F.when(F.col("l_partkey") % 50 == 0, 4000 + tens).when(F.col("l_partkey") % 50 == 1, tens / 10)
         .otherwise(200 + tens).cast("int").alias("TIME_GAP"),
        F.col("l_returnflag").alias("FLAG"),
    )


def comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4 ``comparison``: actual event times and absolute errors of a model
    and of an incumbent predictor, derived from ``travel_obs``.

    EVENT rows carry travel times, PATRN rows service (dwell) times. The
    model predicts the mean TIME_GAP of (segment, time-of-day class), the
    incumbent the mean of the segment; both are fitted with
    ``model.fit_group_mean`` on the whole table.
    """
    from tripframe.operators import model

    obs = travel_obs(spark, sf_dir).withColumn(
        "tod_class", clock.tod_class(clock.hour_of("DEP_TIME")))
    levels = [["BUSINFOUNIT_ID", "tod_class"], ["BUSINFOUNIT_ID"]]
    fit = model.fit_group_mean(obs, levels)  # both predictors in one pass
    x = model.score_level(obs, fit, 0, levels[0], "_ai")
    x = model.score_level(x, fit, 1, levels[1], "_bis")
    tg = F.col("TIME_GAP").cast("double")
    is_travel = F.col("DATA_TYPE") == "EVENT"
    d_ai = F.abs(tg - F.col("_ai"))
    d_bis = F.abs(tg - F.col("_bis"))
    return x.select(
        "obs_id",
        F.when(is_travel, tg).alias("TRAVEL_TIME_EVENT"),
        F.when(~is_travel, tg).alias("SERVICE_TIME_EVENT"),
        F.when(is_travel, d_ai).alias("DIFF_EVENT_AI"),
        F.when(is_travel, d_bis).alias("DIFF_EVENT_BIS"),
        F.when(~is_travel, d_ai).alias("DIFF_EVENT_SERVICE_AI"),
        F.when(~is_travel, d_bis).alias("DIFF_EVENT_SERVICE_BIS"),
    )
