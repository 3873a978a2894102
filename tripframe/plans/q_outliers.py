"""Queries for outlier operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripframe.operators import clean, outliers
from tripframe.plans.registry import query
from tripframe.plans.sqlviews import LINE_COARSE, TRAVEL_OBS, with_views
from tripframe.sources import adapters as A

LINE_BOUNDS = """
q AS (SELECT quantile_cont(TIME_GAP, 0.25) AS q1t, quantile_cont(TIME_GAP, 0.75) AS q3t,
             quantile_cont(LEN, 0.25) AS q1l, quantile_cont(LEN, 0.75) AS q3l FROM lobs),
bb AS (SELECT q1t - 1.5::DOUBLE * (q3t - q1t) AS lot, q3t + 1.5::DOUBLE * (q3t - q1t) AS hit,
              q1l - 1.5::DOUBLE * (q3l - q1l) AS lol, q3l + 1.5::DOUBLE * (q3l - q1l) AS hil FROM q),
lab AS (SELECT lobs.*, CASE
          WHEN coalesce(TIME_GAP >= lot AND TIME_GAP <= hit, false)
               AND coalesce(LEN >= lol AND LEN <= hil, false) THEN 'kept'
          WHEN coalesce(TIME_GAP < lot OR TIME_GAP > hit, false)
               OR coalesce(LEN < lol OR LEN > hil, false) THEN 'outlier' END AS iqr_set
        FROM lobs, bb)"""


@query("iqr_split", with_views(LINE_COARSE, LINE_BOUNDS) + """
SELECT * FROM lab WHERE iqr_set = 'kept'
UNION ALL SELECT DISTINCT * FROM lab WHERE iqr_set = 'outlier'""")
def q_iqr_split(spark, sf_dir):
    """IQR fences per column; kept rows and distinct outliers (null in neither)."""
    return outliers.iqr_split(A.line_coarse(spark, sf_dir), ["TIME_GAP", "LEN"])


@query("iqr_stats", with_views(LINE_COARSE, LINE_BOUNDS) + """
SELECT (SELECT count(*) FROM lobs) AS total, count(*) AS outliers,
       count(*) * 100.0::DOUBLE / (SELECT count(*) FROM lobs) AS pct
FROM (SELECT DISTINCT * FROM lab WHERE iqr_set = 'outlier')""")
def q_iqr_stats(spark, sf_dir):
    """Total rows, outlier rows and percentage."""
    return outliers.iqr_stats(A.line_coarse(spark, sf_dir), ["TIME_GAP", "LEN"])


OBS_TG_BOUNDS = """
tb AS (SELECT quantile_cont(TIME_GAP, 0.25) - 1.5::DOUBLE * (quantile_cont(TIME_GAP, 0.75) - quantile_cont(TIME_GAP, 0.25)) AS lo,
              quantile_cont(TIME_GAP, 0.75) + 1.5::DOUBLE * (quantile_cont(TIME_GAP, 0.75) - quantile_cont(TIME_GAP, 0.25)) AS hi
       FROM obs)"""


@query("fence_summary", with_views(TRAVEL_OBS, OBS_TG_BOUNDS) + """
SELECT lo AS lower_bound, hi AS upper_bound,
       count(*) FILTER (WHERE TIME_GAP > hi) AS n_upper,
       count(*) FILTER (WHERE TIME_GAP < lo) AS n_lower
FROM obs, tb GROUP BY lo, hi""")
def q_fence_summary(spark, sf_dir):
    """C4 header: TIME_GAP fences and outlier counts."""
    return outliers.fence_summary(A.travel_obs(spark, sf_dir), "TIME_GAP")


@query("iqr_topk", with_views(TRAVEL_OBS, OBS_TG_BOUNDS) + """
SELECT * FROM (
  SELECT 'upper' AS side, obs_id, TIME_GAP,
         CAST(row_number() OVER (ORDER BY TIME_GAP DESC, obs_id) AS INTEGER) AS rank
  FROM obs, tb WHERE TIME_GAP > hi) WHERE rank <= 20
UNION ALL
SELECT * FROM (
  SELECT 'lower' AS side, obs_id, TIME_GAP,
         CAST(row_number() OVER (ORDER BY TIME_GAP, obs_id) AS INTEGER) AS rank
  FROM obs, tb WHERE TIME_GAP < lo) WHERE rank <= 5""")
def q_iqr_topk(spark, sf_dir):
    """C4 lists: top 20 upper TIME_GAP outliers, 5 lowest lower ones."""
    obs = A.travel_obs(spark, sf_dir).select("obs_id", "TIME_GAP")
    return outliers.fence_extremes(obs, "TIME_GAP", n_high=20, n_low=5)


@query("speed_outliers", with_views(TRAVEL_OBS, """
sp AS (SELECT obs_id, CASE WHEN TIME_GAP = 0 THEN NULL ELSE LEN / TIME_GAP END * 3.6::DOUBLE AS SPEED FROM obs),
sb AS (SELECT quantile_cont(SPEED, 0.25) - 1.5::DOUBLE * (quantile_cont(SPEED, 0.75) - quantile_cont(SPEED, 0.25)) AS lo,
              quantile_cont(SPEED, 0.75) + 1.5::DOUBLE * (quantile_cont(SPEED, 0.75) - quantile_cont(SPEED, 0.25)) AS hi
       FROM sp)""") + """
SELECT * FROM (
  SELECT 'upper' AS side, obs_id, SPEED, CAST(row_number() OVER (ORDER BY SPEED DESC, obs_id) AS INTEGER) AS rank
  FROM sp, sb WHERE SPEED > hi) WHERE rank <= 100
UNION ALL
SELECT * FROM (
  SELECT 'lower' AS side, obs_id, SPEED, CAST(row_number() OVER (ORDER BY SPEED, obs_id) AS INTEGER) AS rank
  FROM sp, sb WHERE SPEED < lo) WHERE rank <= 5""")
def q_speed_outliers(spark, sf_dir):
    """Recomputed speed, its fences, top 100 high and 5 lowest."""
    obs = A.travel_obs(spark, sf_dir)
    sp = obs.select("obs_id", clean.derived_speed().alias("SPEED"))
    return outliers.fence_extremes(sp, "SPEED", n_high=100, n_low=5)


@query("outlier_list", with_views(LINE_COARSE, """
tb AS (SELECT q1 - 1.5::DOUBLE * (q3 - q1) AS lo, q3 + 1.5::DOUBLE * (q3 - q1) AS hi
       FROM (SELECT quantile_cont(TIME_GAP, 0.25) AS q1, quantile_cont(TIME_GAP, 0.75) AS q3 FROM lobs)),
o AS (SELECT DISTINCT TIME_GAP, CASE WHEN TIME_GAP > hi THEN 'upper' ELSE 'lower' END AS side
      FROM lobs, tb WHERE TIME_GAP > hi OR TIME_GAP < lo)""") + """
SELECT * FROM (SELECT *, CAST(row_number() OVER (ORDER BY TIME_GAP DESC) AS INTEGER) AS rank FROM o) WHERE rank <= 20""")
def q_outlier_list(spark, sf_dir):
    """C4: the 20 largest of all distinct outlying TIME_GAP values; lower ones
    follow where the upper ones are fewer."""
    obs = A.line_coarse(spark, sf_dir)
    bounds = outliers.iqr_bounds(obs, ["TIME_GAP"])
    return outliers.outlier_list(obs.select("TIME_GAP").distinct(), "TIME_GAP", key="TIME_GAP", bounds=bounds)


@query("speed_outlier_list", with_views(TRAVEL_OBS, """
sp AS (SELECT obs_id, CASE WHEN TIME_GAP <> 0 THEN LEN / TIME_GAP * 3.6::DOUBLE WHEN TIME_GAP = 0 AND LEN > 0 THEN 'inf'::DOUBLE
                           WHEN TIME_GAP = 0 AND LEN < 0 THEN '-inf'::DOUBLE END AS SPEED FROM
       (SELECT obs_id, LEN, CASE WHEN obs_id % 97 = 0 THEN 0 ELSE TIME_GAP END AS TIME_GAP FROM obs)),
sb AS (SELECT q1 - 1.5::DOUBLE * (q3 - q1) AS lo, q3 + 1.5::DOUBLE * (q3 - q1) AS hi
       FROM (SELECT quantile_cont(SPEED, 0.25) AS q1, quantile_cont(SPEED, 0.75) AS q3 FROM sp))""") + """
SELECT obs_id, SPEED, side, rank FROM (
  SELECT *, CASE WHEN SPEED > hi THEN 'upper' ELSE 'lower' END AS side,
         CAST(row_number() OVER (ORDER BY SPEED DESC, obs_id) AS INTEGER) AS rank
  FROM sp, sb WHERE SPEED > hi OR SPEED < lo) WHERE rank <= 100""")
def q_speed_outlier_list(spark, sf_dir):
    """The 100 largest of all outlying speeds, a gap of zero (here every 97th
    observation's) counted as infinitely fast."""
    gap = F.when(F.col("obs_id") % 97 == 0, 0).otherwise(F.col("TIME_GAP")).alias("TIME_GAP")
    obs = A.travel_obs(spark, sf_dir).select("obs_id", "LEN", gap)
    sp = obs.select("obs_id", clean.derived_speed(zero_gap="infinity").alias("SPEED"))
    return outliers.outlier_list(sp, "SPEED", n=100)


SIGMA_SQL = """
g0 AS (SELECT obs_id, BUSINFOUNIT_ID, DAY_TYPE, DEP_TIME, TIME_GAP, SPEED FROM obs
       WHERE SPEED IS NOT NULL),
gs AS (SELECT BUSINFOUNIT_ID, DAY_TYPE, avg(TIME_GAP) AS m, stddev_samp(TIME_GAP) AS s
       FROM g0 GROUP BY ALL),
kept AS (SELECT g0.* FROM g0 JOIN gs USING (BUSINFOUNIT_ID, DAY_TYPE)
         WHERE TIME_GAP >= m - 2.0::DOUBLE * s AND TIME_GAP <= m + 2.0::DOUBLE * s)"""


def _sigma(spark, sf_dir):
    obs = A.travel_obs(spark, sf_dir).select(
        "obs_id", "BUSINFOUNIT_ID", "DAY_TYPE", "DEP_TIME", "TIME_GAP", "SPEED")
    return outliers.group_sigma_filter(obs, ["BUSINFOUNIT_ID", "DAY_TYPE"], "TIME_GAP", 2.0)


@query("group_sigma_filter", with_views(TRAVEL_OBS, SIGMA_SQL) + "SELECT * FROM kept")
def q_group_sigma_filter(spark, sf_dir):
    """Per (segment, DAY_TYPE) keep mean +- 2 sample std."""
    return _sigma(spark, sf_dir)


@query("group_sizes", with_views(TRAVEL_OBS, SIGMA_SQL) + """
SELECT BUSINFOUNIT_ID, DAY_TYPE, count(*) AS n FROM kept GROUP BY ALL""")
def q_group_sizes(spark, sf_dir):
    """Surviving rows per group after C6."""
    return outliers.group_sizes(_sigma(spark, sf_dir), ["BUSINFOUNIT_ID", "DAY_TYPE"])


@query("clamp_outliers", with_views(LINE_COARSE, """
q AS (SELECT quantile_cont(TIME_GAP, 0.25) AS q1, quantile_cont(TIME_GAP, 0.75) AS q3 FROM lobs)""") + """
SELECT DAY_TYPE, BUSROUTE_ID, BUSINFOUNIT_ID, LEN, COLLECT_DATE,
       least(greatest(CAST(TIME_GAP AS DOUBLE), q1 - 1.5::DOUBLE * (q3 - q1)), q3 + 1.5::DOUBLE * (q3 - q1)) AS TIME_GAP,
       FLAG
FROM lobs, q""")
def q_clamp_outliers(spark, sf_dir):
    """Values outside the fences replaced by the fence (stated only)."""
    return outliers.clamp_outliers(A.line_coarse(spark, sf_dir), ["TIME_GAP"])
