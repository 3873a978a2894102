"""Queries for sequences (G1-G5) and minute-grid densification (H1-H4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripframe.functions import clock
from tripframe.operators import densify, encode, sequence
from tripframe.plans import sqlparts as P
from tripframe.plans.registry import query
from tripframe.plans.sqlviews import HOLDING_OBS, TRAVEL_OBS, with_views
from tripframe.sources import adapters as A

SEQ_KEYS = ["BUSROUTE_ID", "BUSINFOUNIT_ID"]
WSQL = ("WINDOW w AS (PARTITION BY BUSROUTE_ID, BUSINFOUNIT_ID ORDER BY DEP_TIME, obs_id "
        "ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)")
MOD = f"({P.hour('DEP_TIME')} * 60 + {P.minute('DEP_TIME')})"


def _seq_input(spark, sf_dir):
    obs = A.travel_obs(spark, sf_dir)
    return obs.select("obs_id", *SEQ_KEYS, "DEP_TIME", "TIME_GAP", "LEN",
                      clock.minute_of_day("DEP_TIME").alias("minute_of_day"))


def _sequences(spark, sf_dir, extra=()):
    x = _seq_input(spark, sf_dir)
    return sequence.sliding_sequences(x, SEQ_KEYS, ["DEP_TIME"],
                                      ["TIME_GAP", "minute_of_day", *extra], length=5)


@query("sequences", with_views(TRAVEL_OBS) + f"""
SELECT obs_id, TIME_GAP, {", ".join(f"t[{i}] AS t_{i}" for i in range(1, 6))},
       {", ".join(f"m[{i}] AS m_{i}" for i in range(1, 6))} FROM (
  SELECT obs_id, TIME_GAP, list(TIME_GAP) OVER w AS t, list({MOD}) OVER w AS m FROM obs {WSQL})
WHERE len(t) = 5""")
def q_sequences(spark, sf_dir):
    """Per (route, segment) by departure time, each target row with
    its five predecessors (TIME_GAP and minute of day), keyed by obs_id."""
    s = _sequences(spark, sf_dir)
    return s.select("obs_id", "TIME_GAP",
                    *[F.col("seq")[i - 1]["TIME_GAP"].alias(f"t_{i}") for i in range(1, 6)],
                    *[F.col("seq")[i - 1]["minute_of_day"].alias(f"m_{i}") for i in range(1, 6)])


@query("sequence_backfill", with_views(TRAVEL_OBS) + f"""
SELECT obs_id, CASE WHEN count(*) OVER w = 5 THEN CAST(round_even(avg(TIME_GAP) OVER w, 0) AS INTEGER)
                    ELSE -1 END AS TIME_GAP_ESTIMATE
FROM obs {WSQL}""")
def q_sequence_backfill(spark, sf_dir):
    """A sequence estimate (mean of the five previous TIME_GAPs, rounded)
    joined back to every row on obs_id; rows without a sequence get -1."""
    s = _sequences(spark, sf_dir)
    est = s.select("obs_id", F.bround(F.aggregate(F.col("seq"), F.lit(0.0),
                                                  lambda a, e: a + e["TIME_GAP"]) / 5, 0)
                   .cast("int").alias("TIME_GAP_ESTIMATE"))
    rows = A.travel_obs(spark, sf_dir).select("obs_id")
    return sequence.backfill(rows, est)


@query("sequence_pad", with_views(TRAVEL_OBS) + """
SELECT BUSROUTE_ID, BUSINFOUNIT_ID, """ + ", ".join(f"coalesce(l[{i}], 0) AS s_{i}" for i in range(1, 6)) + """
FROM (SELECT BUSROUTE_ID, BUSINFOUNIT_ID, list(TIME_GAP ORDER BY DEP_TIME, obs_id) AS l
      FROM obs GROUP BY ALL HAVING count(*) < 5)""")
def q_sequence_pad(spark, sf_dir):
    """Groups shorter than 5 as one sequence, zero-padded at the tail."""
    x = _seq_input(spark, sf_dir)
    p = sequence.padded_short_groups(x, SEQ_KEYS, ["DEP_TIME"], "TIME_GAP", 5)
    return p.select(*SEQ_KEYS, *[F.col("seq")[i - 1].alias(f"s_{i}") for i in range(1, 6)])


@query("sequence_weight", with_views(TRAVEL_OBS, """
sc AS (SELECT *, CASE WHEN max(LEN) OVER g = min(LEN) OVER g THEN 0.0
                      ELSE (LEN - min(LEN) OVER g) / CAST(max(LEN) OVER g - min(LEN) OVER g AS DOUBLE) END AS LEN_mm
       FROM obs WINDOW g AS (PARTITION BY BUSROUTE_ID, BUSINFOUNIT_ID))""") + f"""
SELECT obs_id, CASE WHEN _last >= 0.5 THEN 3.0 ELSE 1.0 END::DOUBLE AS weight FROM (
  SELECT *, count(*) OVER w AS _n, lag(LEN_mm) OVER w2 AS _last FROM sc {WSQL},
  w2 AS (PARTITION BY BUSROUTE_ID, BUSINFOUNIT_ID ORDER BY DEP_TIME, obs_id))
WHERE _n = 5""")
def q_sequence_weight(spark, sf_dir):
    """Weight 3 when the last step's per-group min-max LEN is >= 0.5."""
    x = _seq_input(spark, sf_dir)
    x = encode.minmax_by_group(x, ["LEN"], SEQ_KEYS)
    s = sequence.sliding_sequences(x, SEQ_KEYS, ["DEP_TIME"], ["TIME_GAP", "LEN_mm"], length=5)
    return s.select("obs_id", sequence.last_step_weight(F.col("seq"), "LEN_mm").alias("weight"))


GRID_SQL = """grid AS (SELECT printf('%02d:%02d', m // 60, m % 60) AS DEP_TIME FROM (
  SELECT unnest(list_distinct(range(420, 541) || range(780, 901) || range(1080, 1201))) AS m))"""


@query("fill_minutes_travel", with_views(TRAVEL_OBS, f"""
fl AS (SELECT obs_id, DAY_TYPE, BUSINFOUNIT_ID, LEN, DEP_TIME, TIME_GAP, SPEED AS speed_kmh FROM obs),
observed AS (SELECT * FROM fl WHERE {P.slots()}),
firsts AS (SELECT BUSINFOUNIT_ID, arg_min(DAY_TYPE, obs_id) AS DAY_TYPE, arg_min(LEN, obs_id) AS LEN
           FROM fl GROUP BY 1)""", GRID_SQL) + """
SELECT DAY_TYPE, BUSINFOUNIT_ID, LEN, DEP_TIME, TIME_GAP, speed_kmh FROM observed
UNION ALL
SELECT DAY_TYPE, BUSINFOUNIT_ID, LEN, DEP_TIME, -1, 0
FROM firsts CROSS JOIN grid
WHERE NOT EXISTS (SELECT 1 FROM observed o WHERE o.BUSINFOUNIT_ID = firsts.BUSINFOUNIT_ID
                  AND o.DEP_TIME = grid.DEP_TIME)""")
def q_fill_minutes_travel(spark, sf_dir):
    """H1 + H2 + H4: slot rows plus TIME_GAP -1 / speed 0 rows for every
    segment x minute of the 363-minute grid not observed."""
    obs = A.travel_obs(spark, sf_dir).withColumnRenamed("SPEED", "speed_kmh")
    out = densify.fill_minutes(obs, ["BUSINFOUNIT_ID"], ["DAY_TYPE", "LEN"],
                               {"TIME_GAP": -1, "speed_kmh": 0},
                               keep_cols=["DAY_TYPE", "BUSINFOUNIT_ID", "LEN", "DEP_TIME",
                                          "TIME_GAP", "speed_kmh"])
    return densify.ordered(out, ["DEP_TIME", "BUSINFOUNIT_ID"])


@query("fill_minutes_holding", with_views(HOLDING_OBS, f"""
observed AS (SELECT * FROM hobs WHERE {P.slots()}),
firsts AS (SELECT BUSROUTE_ID, BUSSTOP_ID, arg_min(DAY_TYPE, obs_id) AS DAY_TYPE FROM hobs GROUP BY ALL)""",
                                      GRID_SQL) + """
SELECT DAY_TYPE, BUSROUTE_ID, BUSSTOP_ID, DEP_TIME, TIME_GAP FROM observed
UNION ALL
SELECT DAY_TYPE, BUSROUTE_ID, BUSSTOP_ID, DEP_TIME, -1
FROM firsts CROSS JOIN grid
WHERE NOT EXISTS (SELECT 1 FROM observed o WHERE o.BUSROUTE_ID = firsts.BUSROUTE_ID
                  AND o.BUSSTOP_ID = firsts.BUSSTOP_ID AND o.DEP_TIME = grid.DEP_TIME)""")
def q_fill_minutes_holding(spark, sf_dir):
    """H3 + H4: the same grid keyed on (route, stop); ordered by time, route, stop."""
    h = A.holding_obs(spark, sf_dir)
    out = densify.fill_minutes(h, ["BUSROUTE_ID", "BUSSTOP_ID"], ["DAY_TYPE"], {"TIME_GAP": -1},
                               keep_cols=["DAY_TYPE", "BUSROUTE_ID", "BUSSTOP_ID", "DEP_TIME",
                                          "TIME_GAP"])
    return densify.ordered(out, ["DEP_TIME", "BUSROUTE_ID", "BUSSTOP_ID"])
