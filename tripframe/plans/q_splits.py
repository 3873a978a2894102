"""Queries for splits and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripframe.functions.text import composite_key
from tripframe.operators import clean, splits
from tripframe.plans import sqlparts as P
from tripframe.plans.q_clean import PARSED_SQL
from tripframe.plans.registry import query
from tripframe.plans.sqlviews import HOLDING_OBS, LINE_OBS, RAW_EVENTS, TRAVEL_OBS, with_views
from tripframe.sources import adapters as A


def sql_assign(src: str, keys: list[str], seed: int, cuts: list[str], labels: list[str],
               key: str = "obs_id", name: str = "dataset", extra_order: str = "") -> str:
    """SELECT src.*, label by position in seeded md5 order within keys.
    ``cuts`` are SQL expressions in ``n`` (rows in the group)."""
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    order = f"{P.seeded_hash(key, seed)}, {key}"
    case = "CASE " + " ".join(f"WHEN _pos < {c} THEN {lab}" for c, lab in zip(cuts, labels)) \
           + f" ELSE {labels[-1]} END"
    return f"""SELECT * EXCLUDE (_pos, n), {case} AS {name} FROM (
  SELECT *, row_number() OVER ({part} ORDER BY {order}) - 1 AS _pos,
         count(*) OVER ({part}) AS n FROM {src})"""


RATIO_CUTS = ["floor(0.7::DOUBLE * n)", "floor(0.7::DOUBLE * n) + floor(0.15::DOUBLE * n)"]
TVT = ["'train'", "'validation'", "'test'"]


def _obs_small(spark, sf_dir):
    return A.travel_obs(spark, sf_dir).select("obs_id", "BUSROUTE_ID", "BUSINFOUNIT_ID", "TIME_GAP")


OBS_SMALL = "small AS (SELECT obs_id, BUSROUTE_ID, BUSINFOUNIT_ID, TIME_GAP FROM obs)"


@query("split_random", with_views(TRAVEL_OBS, OBS_SMALL) + sql_assign("small", [], 42, RATIO_CUTS, TVT))
def q_split_random(spark, sf_dir):
    """Seeded 70/15/15 on the whole table (no one-task global sort)."""
    return splits.random_split(_obs_small(spark, sf_dir))


@query("split_report", with_views(TRAVEL_OBS, OBS_SMALL, "s AS (" + sql_assign(
        "small", [], 42, RATIO_CUTS, TVT) + ")") + """
SELECT dataset, count(*) AS n, count(*) / sum(count(*)) OVER () AS ratio FROM s GROUP BY 1""")
def q_split_report(spark, sf_dir):
    """Rows and share per set of the D1 split."""
    return splits.split_report(splits.random_split(_obs_small(spark, sf_dir)))


RAW_P = with_views(RAW_EVENTS, PARSED_SQL, """
rp AS (SELECT obs_id, DAY_TYPE, BUSROUTE_ID, LOCATION_ID, DEP_TIME, TIME_GAP FROM p2)""")


def _raw_parsed(spark, sf_dir):
    out = clean.parse_two_formats(A.raw_events(spark, sf_dir))
    return out.select("obs_id", "DAY_TYPE", "BUSROUTE_ID", "LOCATION_ID", "DEP_TIME", "TIME_GAP")


@query("split_stratified", RAW_P + sql_assign("rp", ["DAY_TYPE", "BUSROUTE_ID"], 42, RATIO_CUTS, TVT))
def q_split_stratified(spark, sf_dir):
    """D2 on parsed raw events, strata (DAY_TYPE, BUSROUTE_ID)."""
    return splits.stratified_split(_raw_parsed(spark, sf_dir), ["DAY_TYPE", "BUSROUTE_ID"])


_FB_KEYS = ["DAY_TYPE", "BUSROUTE_ID", "LOCATION_ID"]
FALLBACK_STEPS = """),
f AS (SELECT count(*) FILTER (WHERE dataset = 'validation') = 0 AS ve,
             count(*) FILTER (WHERE dataset = 'test') = 0 AS te FROM s),
s1 AS (SELECT s.* REPLACE (CASE WHEN dataset = '' AND (ve OR te) THEN 'test' ELSE dataset END AS dataset),
              ve, te FROM s, f),
s2 AS (SELECT * EXCLUDE (_p, _nt) REPLACE (
         CASE WHEN dataset = 'train' AND ve AND _p < round_even((0.15::DOUBLE / (1 - 0.15::DOUBLE)) * _nt, 0)
              THEN 'validation' ELSE dataset END AS dataset)
       FROM (SELECT *, row_number() OVER (PARTITION BY dataset = 'train'
                                          ORDER BY md5('43|' || CAST(obs_id AS VARCHAR)), obs_id) - 1 AS _p,
                    count(*) FILTER (WHERE dataset = 'train') OVER () AS _nt FROM s1)),
s3 AS (SELECT * EXCLUDE (_p, _nt) REPLACE (
         CASE WHEN dataset = 'train' AND te
                   AND _p < round_even(((1 - 0.7::DOUBLE - 0.15::DOUBLE) / (1 - 0.7::DOUBLE)) * _nt, 0)
              THEN 'test' ELSE dataset END AS dataset)
       FROM (SELECT *, row_number() OVER (PARTITION BY dataset = 'train'
                                          ORDER BY md5('44|' || CAST(obs_id AS VARCHAR)), obs_id) - 1 AS _p,
                    count(*) FILTER (WHERE dataset = 'train') OVER () AS _nt FROM s2))
SELECT * EXCLUDE (ve, te) FROM s3"""
FALLBACK_SQL = RAW_P + ", s AS (" + sql_assign("rp", _FB_KEYS, 42, RATIO_CUTS, TVT) + FALLBACK_STEPS


@query("split_stratified_fallback", FALLBACK_SQL)
def q_split_stratified_fallback(spark, sf_dir):
    """D2 + D3 with strata (DAY_TYPE, route, location): most strata are tiny, so
    validation ends empty and the fallback moves train rows."""
    return splits.stratified_split_fallback(_raw_parsed(spark, sf_dir), _FB_KEYS)


TG_SQL = f"""CASE WHEN {P.hour('DEP_TIME')} >= 0 AND {P.hour('DEP_TIME')} < 7 THEN '00-07'
  WHEN {P.hour('DEP_TIME')} >= 7 AND {P.hour('DEP_TIME')} < 12 THEN '06-12'
  WHEN {P.hour('DEP_TIME')} >= 12 AND {P.hour('DEP_TIME')} < 18 THEN '12-18'
  WHEN {P.hour('DEP_TIME')} >= 18 AND {P.hour('DEP_TIME')} < 24 THEN '18-24' END"""


@query("split_timegroup", RAW_P + f", rt AS (SELECT *, {TG_SQL} AS time_group FROM rp)\n" + sql_assign(
    "rt", ["DAY_TYPE", "BUSROUTE_ID", "time_group"], 42, RATIO_CUTS, TVT))
def q_split_timegroup(spark, sf_dir):
    """Strata (DAY_TYPE, route, departure time group)."""
    return splits.timegroup_split(_raw_parsed(spark, sf_dir), ["DAY_TYPE", "BUSROUTE_ID"])


@query("split_timegroup_fallback", RAW_P + f", rt AS (SELECT *, {TG_SQL} AS time_group FROM rp), s AS (" + sql_assign(
    "rt", [*_FB_KEYS, "time_group"], 42, RATIO_CUTS, TVT) + FALLBACK_STEPS)
def q_split_timegroup_fallback(spark, sf_dir):
    """D4 with the D3 step: strata (DAY_TYPE, route, location, time group) are so
    small that validation stays empty and train rows move."""
    return splits.timegroup_split(_raw_parsed(spark, sf_dir), _FB_KEYS, fallback=True)


HOLD_KEYED = """hk AS (SELECT obs_id, BUSROUTE_ID || '_' || BUSSTOP_ID AS route_stop, TIME_GAP FROM hobs),
c1 AS (SELECT *, count(*) OVER (PARTITION BY route_stop) AS _n1 FROM hk)"""


def _lr_sql(src: str, test: float, seed: int, name: str) -> str:
    """Largest-remainder train-side count per route_stop (ties: seeded md5)."""
    return f"""{name}_c AS (SELECT route_stop, count(*) AS _c FROM {src} GROUP BY 1),
{name}_b AS (SELECT *, floor(cont) AS _fl, cont - floor(cont) AS _rem FROM (
   SELECT route_stop, _c, _N - ceil({test}::DOUBLE * _N) AS _ntr,
          _c / _N * (_N - ceil({test}::DOUBLE * _N)) AS cont
   FROM {name}_c, (SELECT sum(_c) AS _N FROM {name}_c))),
{name} AS (SELECT route_stop, CAST(_fl + CASE WHEN _rank < (SELECT max(_ntr) - sum(_fl) FROM {name}_b)
                                          THEN 1 ELSE 0 END AS BIGINT) AS _ni FROM (
   SELECT *, row_number() OVER (ORDER BY 1.0::DOUBLE - _rem, md5('{seed}|' || route_stop)) - 1 AS _rank
   FROM {name}_b))"""


def _pick_sql(src: str, ni: str, seed: int, first: str, rest: str) -> str:
    return f"""SELECT obs_id, route_stop, TIME_GAP, CASE WHEN _p < _ni THEN {first} ELSE {rest} END AS dataset
FROM (SELECT {src}.*, _ni, row_number() OVER (PARTITION BY route_stop
        ORDER BY md5('{seed}|' || CAST(obs_id AS VARCHAR)), obs_id) - 1 AS _p
      FROM {src} JOIN {ni} USING (route_stop))"""


SINGLETON_SQL = with_views(
    HOLDING_OBS, HOLD_KEYED,
    "m1 AS (SELECT * EXCLUDE (_n1) FROM c1 WHERE _n1 > 1)",
    _lr_sql("m1", 0.3, 42, "ni1"),
    "a1 AS (" + _pick_sql("m1", "ni1", 42, "'train'", "'_temp'") + ")",
    "t2 AS (SELECT * EXCLUDE (dataset), count(*) OVER (PARTITION BY route_stop) AS _n2 FROM a1 WHERE dataset = '_temp')",
    "m2 AS (SELECT * EXCLUDE (_n2) FROM t2 WHERE _n2 > 1)",
    _lr_sql("m2", 0.5, 43, "ni2"),
    "a2 AS (" + _pick_sql("m2", "ni2", 43, "'validation'", "'test'") + ")") + """
SELECT * FROM a1 WHERE dataset = 'train'
UNION ALL SELECT * FROM a2
UNION ALL SELECT * EXCLUDE (_n2), 'train' FROM t2 WHERE _n2 = 1
UNION ALL SELECT * EXCLUDE (_n1), 'train' FROM c1 WHERE _n1 = 1"""


@query("split_singleton", SINGLETON_SQL)
def q_split_singleton(spark, sf_dir):
    """D5 on the holding composite key route_stop."""
    h = A.holding_obs(spark, sf_dir)
    hk = h.select("obs_id", composite_key("BUSROUTE_ID", "BUSSTOP_ID").alias("route_stop"), "TIME_GAP")
    return splits.singleton_split(hk, ["route_stop"])


@query("split_dates", with_views(LINE_OBS, """
d AS (SELECT _d, row_number() OVER (ORDER BY _d) - 1 AS _pos, count(*) OVER () AS n
      FROM (SELECT DISTINCT COLLECT_DATE AS _d FROM lobs WHERE COLLECT_DATE IS NOT NULL))""") + """
SELECT lobs.*, CASE WHEN _pos < floor(0.7::DOUBLE * n) THEN 'train'
                    WHEN _pos < floor(0.7::DOUBLE * n) + floor(0.15::DOUBLE * n) THEN 'validation'
                    ELSE 'test' END AS dataset
FROM lobs JOIN d ON lobs.COLLECT_DATE = d._d""")
def q_split_dates(spark, sf_dir):
    """Chronological 70/15/15 by distinct ship date."""
    return splits.date_split(A.line_obs(spark, sf_dir))


@query("halve_groups", with_views(TRAVEL_OBS, OBS_SMALL) + sql_assign(
    "small", ["BUSINFOUNIT_ID"], 42, ["floor(0.5::DOUBLE * n)"], ["'validation'", "'test'"]))
def q_halve_groups(spark, sf_dir):
    """Per segment half validation, half test."""
    return splits.halve_groups(_obs_small(spark, sf_dir), ["BUSINFOUNIT_ID"])


BAND_SQL = "CASE WHEN TIME_GAP < 120 THEN '<2min' WHEN TIME_GAP < 300 THEN '2-5min' ELSE '>=5min' END"


def travel_band(col="TIME_GAP"):
    c = F.col(col)
    return F.when(c < 120, "<2min").when(c < 300, "2-5min").otherwise(">=5min")


@query("banded_sample", with_views(TRAVEL_OBS, OBS_SMALL, f"b AS (SELECT *, {BAND_SQL} AS band FROM small)") + """
SELECT * EXCLUDE (_pos) FROM (
  SELECT *, row_number() OVER (PARTITION BY band ORDER BY md5('42|' || CAST(obs_id AS VARCHAR)), obs_id) - 1 AS _pos
  FROM b) WHERE _pos < 20""")
def q_banded_sample(spark, sf_dir):
    """20 rows per travel-time band, seeded, without replacement."""
    return splits.banded_sample(_obs_small(spark, sf_dir), travel_band(), 20)


@query("kfold", with_views(TRAVEL_OBS, OBS_SMALL) + """
SELECT * EXCLUDE (_pos), CAST(_pos % 5 AS INTEGER) AS fold FROM (
  SELECT *, row_number() OVER (PARTITION BY BUSROUTE_ID, BUSINFOUNIT_ID
                               ORDER BY md5('42|' || CAST(obs_id AS VARCHAR)), obs_id) - 1 AS _pos FROM small)""")
def q_kfold(spark, sf_dir):
    """Stratified 5-fold index per (route, segment)."""
    return splits.kfold(_obs_small(spark, sf_dir), ["BUSROUTE_ID", "BUSINFOUNIT_ID"], 5)


@query("split_two_step", with_views(TRAVEL_OBS, OBS_SMALL) + sql_assign(
    "small", [], 42, ["n - ceil(0.3::DOUBLE * n)",
                      "n - ceil(0.3::DOUBLE * n) + ceil(0.3::DOUBLE * n) - ceil(0.5::DOUBLE * ceil(0.3::DOUBLE * n))"],
    TVT))
def q_split_two_step(spark, sf_dir):
    """70/30 then 50/50 of the hold-out, with ceil rounding of the held-out sizes."""
    return splits.two_step_split(_obs_small(spark, sf_dir))
