"""DuckDB SQL for the adapters, used as CTE prefixes by oracle queries.

These restate ``tripframe.sources.adapters`` in DuckDB dialect: dayofweek
is 0-based there (+1), ``/`` on integers is true division, constants are
cast to DOUBLE so arithmetic matches Spark's double literals.
"""

ZFILL9 = "CASE WHEN length({c}) >= 9 THEN {c} ELSE lpad({c}, 9, '0') END"

TRAVEL_OBS = f"""
obs AS (
  SELECT event_id AS obs_id,
         CAST(dayofweek(ts) + 1 AS TINYINT) AS DAY_TYPE,
         event_type AS BUSROUTE_ID,
         CAST(k % 12 AS SMALLINT) AS PEEK_ALLOC,
         CAST(k % 7 + 3 AS SMALLINT) AS NPEEK_ALLOC,
         CAST(user_id % 10 * 1500 + 20000 AS INTEGER) AS ROUTE_LEN,
         CAST(user_id % 40 + 20 AS SMALLINT) AS BUSSTOP_CNT,
         CAST(k % 40 + 1 AS SMALLINT) AS INFOUNIT_SEQ,
         {ZFILL9.format(c="CAST(user_id AS VARCHAR)")} AS BUSINFOUNIT_ID,
         CAST(k * 20 AS INTEGER) AS LEN,
         CAST(CASE WHEN k % 25 = 0 THEN 0.0::DOUBLE
                   ELSE 126.9::DOUBLE + k / 1000.0::DOUBLE END AS FLOAT) AS GPS_COORDX,
         CAST(CASE WHEN user_id % 30 = 0 THEN 0.0::DOUBLE
                   ELSE 37.5::DOUBLE + user_id / 10000.0::DOUBLE END AS FLOAT) AS GPS_COORDY,
         strftime(ts, '%Y-%m-%d') AS COLLECT_DATE,
         strftime(ts, '%H:%M') AS DEP_TIME,
         CAST(floor(value) AS INTEGER) AS TIME_GAP,
         CAST(round_even(CASE WHEN floor(value) = 0 THEN NULL
                              ELSE (k * 20) / floor(value) END * 3.6::DOUBLE, 0)
              AS INTEGER) AS SPEED,
         CASE WHEN event_type IN ('click', 'purchase', 'error') THEN 'EVENT'
              ELSE 'PATRN' END AS DATA_TYPE
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) e
)"""

HOLDING_OBS = """
hobs AS (
  SELECT event_id AS obs_id,
         CAST(dayofweek(ts) + 1 AS TINYINT) AS DAY_TYPE,
         event_type AS BUSROUTE_ID,
         CAST(user_id AS VARCHAR) AS BUSSTOP_ID,
         strftime(ts, '%Y-%m-%d') AS COLLECT_DATE,
         strftime(ts, '%H:%M') AS DEP_TIME,
         CAST(floor(value) AS INTEGER) AS TIME_GAP
  FROM events
)"""

RAW_EVENTS = """
raw AS (
  SELECT event_id AS obs_id,
         strftime(ts, '%Y-%m-%d %H:%M:%S') AS ARR_DATE,
         CASE WHEN user_id % 37 = 0 THEN 'n/a'
              WHEN event_id % 3 = 0 THEN strftime(ts, '%Y-%m-%d')
              ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS DEP_DATE,
         CAST(dayofweek(ts) + 1 AS TINYINT) AS DAY_TYPE,
         event_type AS BUSROUTE_ID,
         CAST(user_id AS VARCHAR) AS LOCATION_ID,
         CAST(floor(value) AS INTEGER) AS TIME_GAP
  FROM events
)"""

LINE_OBS = f"""
lobs AS (
  SELECT CAST(dayofweek(l_shipdate) + 1 AS TINYINT) AS DAY_TYPE,
         CAST(l_suppkey AS VARCHAR) AS BUSROUTE_ID,
         {ZFILL9.format(c="CAST(l_partkey AS VARCHAR)")} AS BUSINFOUNIT_ID,
         CAST(trunc(l_extendedprice / 50) AS INTEGER) AS LEN,
         strftime(l_shipdate, '%Y-%m-%d') AS COLLECT_DATE,
         CAST(trunc(l_quantity) AS INTEGER) AS TIME_GAP,
         l_returnflag AS FLAG
  FROM lineitem
)"""


LINE_COARSE = f"""
lobs AS (
  SELECT CAST(month(l_shipdate) % 7 + 1 AS TINYINT) AS DAY_TYPE,
         CAST(l_suppkey % 5 AS VARCHAR) AS BUSROUTE_ID,
         {ZFILL9.format(c="CAST(l_partkey % 20 AS VARCHAR)")} AS BUSINFOUNIT_ID,
         CAST(floor(l_extendedprice / 5000) * 100 + 100 AS INTEGER) AS LEN,
         strftime(l_shipdate, '%Y-%m-01') AS COLLECT_DATE,
         CAST(CASE WHEN l_partkey % 50 = 0 THEN 4000 + floor(l_quantity / 10) * 10
                   WHEN l_partkey % 50 = 1 THEN floor(l_quantity / 10)
                   ELSE 200 + floor(l_quantity / 10) * 10 END AS INTEGER) AS TIME_GAP,
         l_returnflag AS FLAG
  FROM lineitem
)"""


def with_views(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes)
