"""Queries for scans-free cleaning rules (B1-B22) and the flagship slice."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripframe.functions import clock
from tripframe.operators import clean
from tripframe.plans import sqlparts as P
from tripframe.plans.registry import query
from tripframe.plans.sqlviews import HOLDING_OBS, LINE_COARSE, RAW_EVENTS, TRAVEL_OBS, with_views
from tripframe.sources import adapters as A

# --------------------------------------------------------------------------
FLAGSHIP_SQL = with_views(TRAVEL_OBS, f"""
z AS (SELECT * FROM obs WHERE coalesce(LEN <> 0, true) AND coalesce(TIME_GAP <> 0, true)),
{P.travel_quality('z')}""") + f"""
SELECT tod_class, avg(TIME_GAP) AS mean_time_gap, count(*) AS n
FROM (SELECT *, {P.tod_class(P.hour('DEP_TIME'))} AS tod_class FROM tq)
GROUP BY tod_class"""


@query("flagship_tod_profile", FLAGSHIP_SQL)
def flagship_tod_profile(spark, sf_dir):
    """Flagship (B1, B6, F1, F8): obs -> zero filter (LEN, TIME_GAP) -> travel
    rules -> hour -> time-of-day class -> mean and count of TIME_GAP per class."""
    obs = clean.zero_filter(A.travel_obs(spark, sf_dir), ["LEN", "TIME_GAP"])
    kept = clean.travel_quality(obs)
    return (kept.withColumn("tod_class", clock.tod_class(clock.hour_of("DEP_TIME")))
                .groupBy("tod_class")
                .agg(F.avg("TIME_GAP").alias("mean_time_gap"),
                     F.count(F.lit(1)).alias("n")))


# B1 ------------------------------------------------------------------------
@query("zero_filter", with_views(TRAVEL_OBS) + """
SELECT obs_id, BUSINFOUNIT_ID, LEN, DEP_TIME, TIME_GAP, PEEK_ALLOC, SPEED FROM obs
WHERE coalesce(LEN <> 0, true) AND coalesce(TIME_GAP <> 0, true)
  AND coalesce(PEEK_ALLOC <> 0, true) AND coalesce(SPEED <> 0, true)""")
def q_zero_filter(spark, sf_dir):
    """B1: drop rows where any numeric column is 0 (nulls and strings pass)."""
    obs = A.travel_obs(spark, sf_dir).select(
        "obs_id", "BUSINFOUNIT_ID", "LEN", "DEP_TIME", "TIME_GAP", "PEEK_ALLOC", "SPEED")
    return clean.zero_filter(obs)


# B2 ------------------------------------------------------------------------
SPARSE_SQL = """
sparse AS (SELECT obs_id, nullif(LEN, 0) AS LEN, SPEED, nullif(TIME_GAP, 0) AS TIME_GAP FROM obs)"""


def _sparse(spark, sf_dir):
    obs = A.travel_obs(spark, sf_dir)
    return obs.select("obs_id", F.nullif(F.col("LEN"), F.lit(0)).alias("LEN"), "SPEED",
                      F.nullif(F.col("TIME_GAP"), F.lit(0)).alias("TIME_GAP"))


@query("dropna_all", with_views(TRAVEL_OBS, SPARSE_SQL) + """
SELECT * FROM sparse WHERE LEN IS NOT NULL OR SPEED IS NOT NULL OR TIME_GAP IS NOT NULL""")
def q_dropna_all(spark, sf_dir):
    """B2: drop rows whose payload columns are all null."""
    return clean.drop_all_null(_sparse(spark, sf_dir))


@query("drop_blank", with_views(RAW_EVENTS) + """
SELECT obs_id, BUSROUTE_ID, DEP_TIME FROM (
  SELECT obs_id, BUSROUTE_ID,
         CASE WHEN DEP_DATE = 'n/a' THEN '  ' ELSE substr(DEP_DATE, 12, 5) END AS DEP_TIME
  FROM raw) WHERE DEP_TIME IS NOT NULL AND trim(DEP_TIME) <> ''
    AND BUSROUTE_ID IS NOT NULL AND trim(BUSROUTE_ID) <> ''""")
def q_drop_blank(spark, sf_dir):
    """Rows null or blank after trimming dropped (junk dates become
    spaces, date-only ones an empty time)."""
    raw = A.raw_events(spark, sf_dir)
    dep = F.when(F.col("DEP_DATE") == "n/a", F.lit("  ")).otherwise(
        F.substring("DEP_DATE", 12, 5))
    return clean.drop_blank(raw.select("obs_id", "BUSROUTE_ID", dep.alias("DEP_TIME")),
                            ["BUSROUTE_ID", "DEP_TIME"])


@query("dropna_any", with_views(TRAVEL_OBS, SPARSE_SQL) + """
SELECT * FROM sparse WHERE LEN IS NOT NULL AND SPEED IS NOT NULL""")
def q_dropna_any(spark, sf_dir):
    """Drop rows with a null in LEN or SPEED."""
    return clean.drop_any_null(_sparse(spark, sf_dir), ["LEN", "SPEED"])


# B5 ------------------------------------------------------------------------
@query("tighten_types", """
SELECT event_id AS obs_id, CAST(trunc(value) AS INTEGER) AS TIME_GAP,
       CAST(round_even(value / 7.0::DOUBLE * 3.6::DOUBLE, 0) AS INTEGER) AS SPEED
FROM events""")
def q_tighten_types(spark, sf_dir):
    """TIME_GAP truncated to int, SPEED rounded half-to-even to int."""
    ev = A.table(spark, sf_dir, "events")
    raw = ev.select(F.col("event_id").alias("obs_id"), F.col("value").alias("TIME_GAP"),
                    (F.col("value") / F.lit(7.0) * F.lit(3.6)).alias("SPEED"))
    return clean.tighten_types(raw)


# B6 ------------------------------------------------------------------------
@query("quality_travel", with_views(TRAVEL_OBS, P.travel_quality("obs")) + """
SELECT * FROM tq""")
def q_quality_travel(spark, sf_dir):
    """The travel rule list (LEN, exact dedup, ranges, GPS, slots, keyed dedup)."""
    return clean.travel_quality(A.travel_obs(spark, sf_dir))


@query("quality_travel_audit", with_views(TRAVEL_OBS, f"""
s1 AS (SELECT {P.TRAVEL_PAYLOAD}, count(*) AS _n FROM obs WHERE LEN > 0 GROUP BY ALL),
t AS (SELECT *, CASE WHEN NOT coalesce(TIME_GAP > 5 AND TIME_GAP <= 300, false) THEN 3
                     WHEN NOT coalesce(SPEED > 5 AND SPEED <= 55, false) THEN 4
                     WHEN NOT (coalesce(GPS_COORDX <> 0, true) AND coalesce(GPS_COORDY <> 0, true)) THEN 5
                     WHEN NOT coalesce({P.slots()}, false) THEN 6 END AS _step FROM s1),
k AS (SELECT count(*) AS _k FROM t WHERE _step IS NULL
      GROUP BY BUSROUTE_ID, BUSINFOUNIT_ID, DEP_TIME)""") + """
SELECT 1 AS step, 'len_positive' AS rule, CAST((SELECT count(*) FROM obs) - (SELECT sum(_n) FROM s1) AS BIGINT) AS removed
UNION ALL SELECT 2, 'exact_duplicates', CAST((SELECT sum(_n) FROM s1) - (SELECT count(*) FROM s1) AS BIGINT)
UNION ALL SELECT 3, 'time_gap_5_300', (SELECT count(*) FROM t WHERE _step = 3)
UNION ALL SELECT 4, 'speed_5_55', (SELECT count(*) FROM t WHERE _step = 4)
UNION ALL SELECT 5, 'gps_nonzero', (SELECT count(*) FROM t WHERE _step = 5)
UNION ALL SELECT 6, 'time_slots', (SELECT count(*) FROM t WHERE _step = 6)
UNION ALL SELECT 7, 'key_duplicates', CAST((SELECT coalesce(sum(_k - 1), 0) FROM k) AS BIGINT)
UNION ALL SELECT 0, 'kept', (SELECT count(*) FROM k)""")
def q_quality_travel_audit(spark, sf_dir):
    """B6 audit: rows removed per numbered rule plus the kept count."""
    return clean.travel_quality_audit(A.travel_obs(spark, sf_dir))


# B7 ------------------------------------------------------------------------
@query("quality_holding", with_views(HOLDING_OBS) + """
SELECT min(obs_id) AS obs_id, DAY_TYPE, BUSROUTE_ID, BUSSTOP_ID, COLLECT_DATE, DEP_TIME, TIME_GAP
FROM hobs GROUP BY ALL HAVING TIME_GAP > 0 AND TIME_GAP <= 120""")
def q_quality_holding(spark, sf_dir):
    """Exact dedup, then 0 < TIME_GAP <= 120."""
    return clean.holding_quality(A.holding_obs(spark, sf_dir))


# B8 / B17 / B16 ------------------------------------------------------------
@query("time_slots", with_views(TRAVEL_OBS) + f"""
SELECT obs_id, BUSINFOUNIT_ID, DEP_TIME FROM obs WHERE {P.slots()}""")
def q_time_slots(spark, sf_dir):
    """Departures inside the three inclusive slots."""
    return clean.slot_filter(A.travel_obs(spark, sf_dir).select(
        "obs_id", "BUSINFOUNIT_ID", "DEP_TIME"))


@query("hour_window", with_views(TRAVEL_OBS) + f"""
SELECT obs_id, DEP_TIME, TIME_GAP FROM obs WHERE {P.hour('DEP_TIME')} BETWEEN 5 AND 24""")
def q_hour_window(spark, sf_dir):
    """Departures with 5 <= hour <= 24."""
    return clean.hour_window(A.travel_obs(spark, sf_dir).select("obs_id", "DEP_TIME", "TIME_GAP"))


PARSED_SQL = """
parsed AS (
  SELECT obs_id, BUSROUTE_ID, LOCATION_ID, DAY_TYPE, TIME_GAP,
         coalesce(try_strptime(ARR_DATE, '%Y-%m-%d %H:%M:%S'), try_strptime(ARR_DATE, '%Y-%m-%d')) AS ARR_TS,
         coalesce(try_strptime(DEP_DATE, '%Y-%m-%d %H:%M:%S'), try_strptime(DEP_DATE, '%Y-%m-%d')) AS DEP_TS
  FROM raw),
p2 AS (SELECT *, strftime(DEP_TS, '%H:%M:%S') AS DEP_TIME FROM parsed
       WHERE ARR_TS IS NOT NULL AND DEP_TS IS NOT NULL)"""


def _parsed(spark, sf_dir):
    return clean.parse_two_formats(A.raw_events(spark, sf_dir))


@query("clock_range", with_views(RAW_EVENTS, PARSED_SQL) + """
SELECT obs_id, DEP_TIME, hh, mm, ss FROM (
  SELECT obs_id, DEP_TIME, CAST(split_part(DEP_TIME, ':', 1) AS INTEGER) AS hh,
         CAST(split_part(DEP_TIME, ':', 2) AS INTEGER) AS mm,
         CAST(split_part(DEP_TIME, ':', 3) AS INTEGER) AS ss FROM p2)
WHERE hh >= 0 AND hh < 24 AND mm >= 0 AND mm < 60 AND ss >= 0 AND ss < 60""")
def q_clock_range(spark, sf_dir):
    """B16 + F3: HH:mm:ss split into hh, mm, ss and range-checked."""
    out = clean.clock_range_filter(_parsed(spark, sf_dir))
    return out.select("obs_id", "DEP_TIME", "hh", "mm", "ss")


# B9-B11 --------------------------------------------------------------------
@query("dedup_exact", with_views(LINE_COARSE) + "SELECT DISTINCT * FROM lobs")
def q_dedup_exact(spark, sf_dir):
    """Exact duplicates removed (line observations, no row key)."""
    return clean.dedup_exact(A.line_coarse(spark, sf_dir), key=None)


@query("dedup_first", with_views(TRAVEL_OBS) + f"""
SELECT {P.TRAVEL_COLS} FROM (
  SELECT *, row_number() OVER (PARTITION BY BUSROUTE_ID, BUSINFOUNIT_ID, DEP_TIME
                               ORDER BY obs_id) AS _rn FROM obs) WHERE _rn = 1""")
def q_dedup_first(spark, sf_dir):
    """First row (smallest obs_id) per (route, segment, DEP_TIME)."""
    return clean.dedup_first(A.travel_obs(spark, sf_dir), list(clean.TRAVEL_KEY))


@query("duplicates", with_views(LINE_COARSE) + """
SELECT *, count(*) - 1 AS copies FROM lobs GROUP BY ALL HAVING count(*) > 1""")
def q_duplicates(spark, sf_dir):
    """Duplicated rows with their number of extra copies."""
    return clean.duplicates(A.line_coarse(spark, sf_dir), key=None)


@query("duplicates_keyed", with_views(TRAVEL_OBS) + f"""
SELECT obs_id, BUSROUTE_ID, BUSINFOUNIT_ID, DEP_TIME FROM (
  SELECT obs_id, BUSROUTE_ID, BUSINFOUNIT_ID, DEP_TIME,
         row_number() OVER (PARTITION BY BUSROUTE_ID, BUSINFOUNIT_ID, DEP_TIME ORDER BY obs_id) AS _rn
  FROM obs) WHERE _rn > 1""")
def q_duplicates_keyed(spark, sf_dir):
    """B11 keyed: later copies by obs_id over a projection (route, segment, DEP_TIME)."""
    obs = A.travel_obs(spark, sf_dir).select("obs_id", "BUSROUTE_ID", "BUSINFOUNIT_ID", "DEP_TIME")
    return clean.duplicates(obs)


# B12-B15 -------------------------------------------------------------------
@query("parse_two_formats", with_views(RAW_EVENTS, PARSED_SQL) + """
SELECT obs_id, strftime(ARR_TS, '%Y-%m-%d %H:%M:%S') AS ARR_DATE,
       strftime(DEP_TS, '%Y-%m-%d %H:%M:%S') AS DEP_DATE, DEP_TIME FROM p2""")
def q_parse_two_formats(spark, sf_dir):
    """B12 + B13: both layouts parsed, failures dropped, time of day text."""
    out = _parsed(spark, sf_dir)
    return out.select("obs_id",
                      F.date_format("ARR_DATE", "yyyy-MM-dd HH:mm:ss").alias("ARR_DATE"),
                      F.date_format("DEP_DATE", "yyyy-MM-dd HH:mm:ss").alias("DEP_DATE"),
                      "DEP_TIME")


@query("minute_text", with_views(RAW_EVENTS) + f"""
SELECT obs_id, strftime(coalesce({P.clock('DEP_DATE')}, try_strptime(DEP_DATE, '%Y-%m-%d')), '%H:%M')
       AS DEP_TIME FROM raw""")
def q_minute_text(spark, sf_dir):
    """Any departure layout reformatted to HH:mm; junk -> null."""
    raw = A.raw_events(spark, sf_dir)
    return raw.select("obs_id", clock.minute_text("DEP_DATE").alias("DEP_TIME"))


@query("date_text", with_views(RAW_EVENTS) + """
SELECT obs_id, strftime(try_strptime(substr(DEP_DATE, 1, 10), '%Y-%m-%d'), '%Y-%m-%d') AS COLLECT_DATE
FROM raw""")
def q_date_text(spark, sf_dir):
    """First ten characters parsed as a date, written yyyy-MM-dd."""
    raw = A.raw_events(spark, sf_dir)
    return raw.select("obs_id", clock.date_text("DEP_DATE").alias("COLLECT_DATE"))


# B18-B22 -------------------------------------------------------------------
@query("derived_speed", with_views(TRAVEL_OBS) + """
SELECT obs_id, LEN, TIME_GAP,
       CASE WHEN TIME_GAP = 0 THEN NULL ELSE LEN / TIME_GAP END * 3.6::DOUBLE AS speed_kmh
FROM obs""")
def q_derived_speed(spark, sf_dir):
    """speed = LEN / TIME_GAP * 3.6 (division by zero -> null)."""
    obs = A.travel_obs(spark, sf_dir)
    return obs.select("obs_id", "LEN", "TIME_GAP", clean.derived_speed().alias("speed_kmh"))


@query("drop_audit", with_views(RAW_EVENTS, PARSED_SQL) + """
SELECT rows_before, rows_after, rows_before - rows_after AS rows_dropped,
       (rows_before - rows_after) * 100.0::DOUBLE / rows_before AS pct_dropped
FROM (SELECT (SELECT count(*) FROM raw) AS rows_before, (SELECT count(*) FROM p2) AS rows_after)""")
def q_drop_audit(spark, sf_dir):
    """Rows dropped by the two-format parse, count and percent."""
    return clean.drop_audit(A.raw_events(spark, sf_dir), _parsed(spark, sf_dir))


@query("select_reorder", with_views(TRAVEL_OBS) + """
SELECT obs_id, DAY_TYPE, BUSINFOUNIT_ID, LEN, DEP_TIME, TIME_GAP FROM obs""")
def q_select_reorder(spark, sf_dir):
    """Output column subset and order."""
    return A.travel_obs(spark, sf_dir).select(
        "obs_id", "DAY_TYPE", "BUSINFOUNIT_ID", "LEN", "DEP_TIME", "TIME_GAP")


@query("to_minutes", with_views(TRAVEL_OBS) + """
SELECT obs_id, TIME_GAP, TIME_GAP / 60.0::DOUBLE AS TIME_GAP_MIN FROM obs""")
def q_to_minutes(spark, sf_dir):
    """Seconds to minutes."""
    obs = A.travel_obs(spark, sf_dir).select("obs_id", "TIME_GAP")
    return clean.to_minutes(obs, ["TIME_GAP"])


@query("impute", with_views(TRAVEL_OBS, SPARSE_SQL) + """
SELECT obs_id, coalesce(CAST(LEN AS DOUBLE), (SELECT avg(LEN) FROM sparse)) AS LEN,
       coalesce(CAST(SPEED AS DOUBLE), (SELECT median(SPEED) FROM sparse)) AS SPEED
FROM sparse""")
def q_impute(spark, sf_dir):
    """LEN mean-imputed, SPEED median-imputed (stated in the readme only)."""
    sp = _sparse(spark, sf_dir).select("obs_id", "LEN", "SPEED")
    return clean.impute(clean.impute(sp, ["LEN"], "mean"), ["SPEED"], "median")
