"""Queries for profiling operators."""

from __future__ import annotations

from tripframe.operators import profile
from tripframe.plans import sqlparts as P
from tripframe.plans.q_clean import SPARSE_SQL, _sparse
from tripframe.plans.registry import query
from tripframe.plans.sqlviews import HOLDING_OBS, LINE_OBS, TRAVEL_OBS, with_views
from tripframe.sources import adapters as A


@query("sizes_by_keys", with_views(TRAVEL_OBS) + """
SELECT CASE WHEN grouping(DAY_TYPE) = 0 THEN 'DAY_TYPE'
            WHEN grouping(BUSROUTE_ID) = 0 THEN 'BUSROUTE_ID'
            WHEN grouping(BUSINFOUNIT_ID) = 0 THEN 'BUSINFOUNIT_ID'
            ELSE 'LEN' END AS dim,
       CASE WHEN grouping(DAY_TYPE) = 0 THEN CAST(DAY_TYPE AS VARCHAR)
            WHEN grouping(BUSROUTE_ID) = 0 THEN BUSROUTE_ID
            WHEN grouping(BUSINFOUNIT_ID) = 0 THEN BUSINFOUNIT_ID
            ELSE CAST(LEN AS VARCHAR) END AS value,
       count(*) AS n
FROM obs GROUP BY GROUPING SETS ((DAY_TYPE), (BUSROUTE_ID), (BUSINFOUNIT_ID), (LEN))""")
def q_sizes_by_keys(spark, sf_dir):
    """Sizes per day type, route, segment and LEN in one shuffle."""
    return profile.sizes_by_keys(A.travel_obs(spark, sf_dir),
                                 ["DAY_TYPE", "BUSROUTE_ID", "BUSINFOUNIT_ID", "LEN"])


@query("sizes_5min", with_views(TRAVEL_OBS) + f"""
SELECT printf('%02d:%02d', CAST(floor(b / 60) AS INTEGER), CAST(b - floor(b / 60) * 60 AS INTEGER)) AS bucket, count(*) AS n
FROM (SELECT floor(({P.hour('DEP_TIME')} * 60 + {P.minute('DEP_TIME')}) / 5) * 5 AS b FROM obs)
GROUP BY ALL""")
def q_sizes_5min(spark, sf_dir):
    """Rows per 5-minute departure bucket."""
    return profile.sizes_5min(A.travel_obs(spark, sf_dir))


DESCRIBE_ONE = """SELECT '{c}' AS "column", count({c}) AS count, avg({c}) AS mean,
  stddev_samp({c}) AS std, CAST(min({c}) AS DOUBLE) AS min, quantile_cont({c}, 0.25) AS p25,
  quantile_cont({c}, 0.5) AS p50, quantile_cont({c}, 0.75) AS p75, CAST(max({c}) AS DOUBLE) AS max
FROM lobs"""


@query("describe_num", with_views(LINE_OBS) + "\nUNION ALL ".join(
    DESCRIBE_ONE.format(c=c) for c in ("TIME_GAP", "LEN", "DAY_TYPE")))
def q_describe_num(spark, sf_dir):
    """Count, mean, sample std, min, exact quartiles, max per column."""
    return profile.describe_num(A.line_obs(spark, sf_dir), ["TIME_GAP", "LEN", "DAY_TYPE"])


DESCRIBE_ALL_ONE = """SELECT '{c}' AS "column", CAST(sum(_c) AS BIGINT) AS count, count(*) AS "unique",
  arg_min(value, (-_c, value)) AS top, max(_c) AS freq
FROM (SELECT {c} AS value, count(*) AS _c FROM obs WHERE {c} IS NOT NULL GROUP BY 1)"""


@query("describe_all", with_views(TRAVEL_OBS) + "\nUNION ALL ".join(
    DESCRIBE_ALL_ONE.format(c=c) for c in ("BUSROUTE_ID", "DATA_TYPE", "DEP_TIME")))
def q_describe_all(spark, sf_dir):
    """Count, unique, top and freq per string column."""
    return profile.describe_all(A.travel_obs(spark, sf_dir), ["BUSROUTE_ID", "DATA_TYPE", "DEP_TIME"])


@query("describe_mixed", with_views(LINE_OBS) + """
, d AS (""" + "\nUNION ALL ".join(DESCRIBE_ONE.format(c=c) for c in ("TIME_GAP", "LEN")) + """),
t AS (""" + "\nUNION ALL ".join(DESCRIBE_ALL_ONE.format(c=c).replace("FROM obs", "FROM lobs")
                                for c in ("BUSROUTE_ID", "FLAG", "COLLECT_DATE")) + """)
SELECT * FROM d UNION ALL BY NAME SELECT * FROM t""")
def q_describe_mixed(spark, sf_dir):
    """Numeric and text columns in one summary (describe of all columns)."""
    return profile.describe_mixed(A.line_obs(spark, sf_dir), ["TIME_GAP", "LEN"], ["BUSROUTE_ID", "FLAG", "COLLECT_DATE"])


@query("missing", with_views(TRAVEL_OBS, SPARSE_SQL) + """
SELECT * FROM (
  SELECT 'obs_id' AS "column", count(*) FILTER (WHERE obs_id IS NULL) AS missing FROM sparse
  UNION ALL SELECT 'LEN', count(*) FILTER (WHERE LEN IS NULL) FROM sparse
  UNION ALL SELECT 'SPEED', count(*) FILTER (WHERE SPEED IS NULL) FROM sparse
  UNION ALL SELECT 'TIME_GAP', count(*) FILTER (WHERE TIME_GAP IS NULL) FROM sparse)
WHERE missing > 0""")
def q_missing(spark, sf_dir):
    """E5: nulls per column, only columns with at least one."""
    return profile.missing_counts(_sparse(spark, sf_dir))


@query("class_counts", with_views(TRAVEL_OBS) + """
SELECT BUSROUTE_ID, count(*) AS n FROM obs GROUP BY 1""")
def q_class_counts(spark, sf_dir):
    """Value counts of the route, descending."""
    return profile.class_counts(A.travel_obs(spark, sf_dir), "BUSROUTE_ID")


_CORR_COLS = ("TIME_GAP", "LEN", "DAY_TYPE")


def _corr_sql():
    parts = []
    for i, a in enumerate(_CORR_COLS):
        for b in _CORR_COLS[i + 1:]:
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, corr({a}, {b}) AS corr FROM lobs")
            parts.append(f"SELECT '{b}', '{a}', corr({a}, {b}) FROM lobs")
        parts.append(f"SELECT '{a}', '{a}', 1.0::DOUBLE")
    return with_views(LINE_OBS) + "\nUNION ALL ".join(parts)


@query("corr_matrix", _corr_sql())
def q_corr_matrix(spark, sf_dir):
    """Pearson correlation of every column pair."""
    return profile.corr_matrix(A.line_obs(spark, sf_dir), list(_CORR_COLS))


@query("histogram", with_views(LINE_OBS, """
lg AS (SELECT 'TIME_GAP' AS "column", CAST(TIME_GAP AS DOUBLE) AS value FROM lobs
       UNION ALL SELECT 'LEN', CAST(LEN AS DOUBLE) FROM lobs),
rng AS (SELECT "column", min(value) AS _lo, max(value) AS _hi FROM lg GROUP BY 1),
cnt AS (SELECT "column", CAST(CASE WHEN _hi = _lo THEN 0
                  ELSE least(floor((value - _lo) / ((_hi - _lo) / 30.0::DOUBLE)), 29) END AS INTEGER) AS bin,
               count(*) AS n
        FROM lg JOIN rng USING ("column") GROUP BY ALL),
grid AS (SELECT "column", _lo, _hi, CAST(unnest(range(0, 30)) AS INTEGER) AS bin FROM rng)""") + """
SELECT grid."column", grid.bin, _lo + bin * ((_hi - _lo) / 30.0::DOUBLE) AS lo,
       _lo + (bin + 1) * ((_hi - _lo) / 30.0::DOUBLE) AS hi, CAST(coalesce(n, 0) AS BIGINT) AS n
FROM grid LEFT JOIN cnt USING ("column", bin)""")
def q_histogram(spark, sf_dir):
    """30 equal-width bins per numeric column, empty bins kept."""
    return profile.histogram_equal(A.line_obs(spark, sf_dir), ["TIME_GAP", "LEN"], 30)


@query("histogram_minutes", with_views(TRAVEL_OBS) + """
SELECT g.bin, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM (SELECT CAST(unnest(range(0, 50)) AS INTEGER) AS bin) g
LEFT JOIN (SELECT CAST(floor(TIME_GAP / 60.0::DOUBLE) AS INTEGER) AS bin, count(*) AS n FROM obs
           WHERE floor(TIME_GAP / 60.0::DOUBLE) BETWEEN 0 AND 49 GROUP BY 1) c USING (bin)""")
def q_histogram_minutes(spark, sf_dir):
    """Fixed 1-minute bins 0-50 of TIME_GAP (seconds)."""
    return profile.histogram_fixed(A.travel_obs(spark, sf_dir), "TIME_GAP", 60.0, 0, 50)


@query("time_profile", with_views(HOLDING_OBS, f"""
b AS (SELECT BUSROUTE_ID, BUSSTOP_ID,
             CAST(floor(({P.hour('DEP_TIME')} * 60 + {P.minute('DEP_TIME')}) / 10) * 10 AS INTEGER) AS bin,
             TIME_GAP FROM hobs WHERE {P.hour('DEP_TIME')} BETWEEN 5 AND 24),
a AS (SELECT BUSROUTE_ID, BUSSTOP_ID, bin, avg(TIME_GAP) AS mean FROM b GROUP BY ALL)""") + """
SELECT *, CASE WHEN count(*) OVER w = 3 THEN avg(mean) OVER w END AS moving_mean
FROM a WINDOW w AS (PARTITION BY BUSROUTE_ID, BUSSTOP_ID ORDER BY bin ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)""")
def q_time_profile(spark, sf_dir):
    """Per (route, stop) 10-minute means and a centred 3-bin moving mean."""
    return profile.time_profile(A.holding_obs(spark, sf_dir), window=3)


@query("combos", with_views(TRAVEL_OBS) + "SELECT DISTINCT BUSROUTE_ID, BUSINFOUNIT_ID FROM obs")
def q_combos(spark, sf_dir):
    """Distinct (route, segment) combinations."""
    return profile.combos(A.travel_obs(spark, sf_dir), ["BUSROUTE_ID", "BUSINFOUNIT_ID"])


@query("bucket_collisions", with_views(TRAVEL_OBS) + f"""
SELECT CAST(sum(ids) AS BIGINT) AS n_ids, count(*) AS occupied, avg(ids) AS mean_ids_per_bucket, max(ids) AS max_ids
FROM (SELECT {P.md5_mod('BUSINFOUNIT_ID', 100)} AS bucket, count(*) AS ids
      FROM (SELECT DISTINCT BUSINFOUNIT_ID FROM obs) GROUP BY 1)""")
def q_bucket_collisions(spark, sf_dir):
    """md5 mod 100 collisions of segment ids."""
    return profile.bucket_collisions(A.travel_obs(spark, sf_dir), "BUSINFOUNIT_ID", 100)


@query("singletons", with_views(LINE_OBS) + """
SELECT BUSROUTE_ID, BUSINFOUNIT_ID FROM lobs GROUP BY ALL HAVING count(*) = 1""")
def q_singletons(spark, sf_dir):
    """(route, segment) keys seen exactly once."""
    return profile.singletons(A.line_obs(spark, sf_dir), ["BUSROUTE_ID", "BUSINFOUNIT_ID"])
