"""Queries for the models' feature sets (F24), sequences of steps (G1) and serving."""

from __future__ import annotations

import math
import os

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tripframe.functions import features
from tripframe.functions.featuresets import DAY_COLUMNS, FEATURE_SETS, ROUTE_FEAT_SCALED, STEP_FEATURES
from tripframe.operators import assembly, bundle, clean, encode, splits
from tripframe.plans import sqlparts as P
from tripframe.plans.q_splits import RATIO_CUTS, TVT, sql_assign
from tripframe.plans.registry import query
from tripframe.plans.sqlviews import TRAVEL_OBS, with_views
from tripframe.session import ensure_checkpoint_dir
from tripframe.sources import adapters as A
from tripframe.sources import files

TWO_PI = f"{2 * math.pi!r}::DOUBLE"
H, M = P.hour("DEP_TIME"), P.minute("DEP_TIME")
SPLIT = ["""nz AS (SELECT *, ln(1 + CAST(ROUTE_LEN AS DOUBLE)) AS LOG_ROUTE_LEN FROM obs
         WHERE coalesce(LEN <> 0, true) AND coalesce(TIME_GAP <> 0, true))""",
         "s AS (" + sql_assign("nz", [], 42, RATIO_CUTS, TVT) + ")"]
DAYS = ", ".join(f"CAST(DAY_TYPE = {d} AS DOUBLE) AS {c}" for d, c in zip(features.DAY_TYPES, DAY_COLUMNS))
TIMES = f"{H} AS dep_hour, {M} AS dep_minute"
CYCLE = f"""sin({TWO_PI} * {H} / 24.0::DOUBLE) AS dep_time_sin, cos({TWO_PI} * {H} / 24.0::DOUBLE) AS dep_time_cos,
  sin({TWO_PI} * DAY_TYPE / 7.0::DOUBLE) AS day_type_sin, cos({TWO_PI} * DAY_TYPE / 7.0::DOUBLE) AS day_type_cos"""


def _classes(low: int, high: int) -> str:
    return f"""ln(1 + CAST(LEN AS DOUBLE)) AS log_len, CAST(DAY_TYPE IN (1, 7) AS INTEGER) AS is_weekend,
  {P.tod_class(H)} AS time_of_day,
  CAST(({H} >= 7 AND {H} < 10) OR ({H} >= 18 AND {H} < 20) AS INTEGER) AS peak_hours,
  CASE WHEN LEN < {low} THEN 0 WHEN LEN < {high} THEN 1 WHEN LEN >= {high} THEN 2 ELSE 0 END AS distance_type"""


def _hashes(n: int) -> str:
    return f"{P.md5_mod('BUSROUTE_ID', n)} AS route_hash, {P.md5_mod('BUSINFOUNIT_ID', n)} AS unit_hash"


def _filtered_split(spark, sf_dir):
    obs = clean.zero_filter(A.travel_obs(spark, sf_dir), ["LEN", "TIME_GAP"])
    return files.stage_table(splits.random_split(obs), "assembly_split")


def _flat(spark, sf_dir, name):
    fs = FEATURE_SETS[name]
    return assembly.flat(_filtered_split(spark, sf_dir), fs).select(
        "obs_id", "dataset", *fs.columns, *[c for c in ("route_hash", "unit_hash") if c not in fs.columns])


STD = ("(CAST({c} AS DOUBLE) - avg(CAST({c} AS DOUBLE)) {w}) / CASE WHEN coalesce(stddev_pop(CAST({c} AS DOUBLE)) {w}, 0) = 0 "
       "THEN 1.0::DOUBLE ELSE stddev_pop(CAST({c} AS DOUBLE)) {w} END AS {c}_scaled")


def _std(cols, over: str) -> str:
    return ", ".join(STD.format(c=c, w=over) for c in cols)


@query("route_feat_features", with_views(TRAVEL_OBS, *SPLIT) + f"""
SELECT obs_id, dataset, {DAYS}, {TIMES}, {_std(ROUTE_FEAT_SCALED, "FILTER (WHERE dataset = 'train') OVER ()")}, {CYCLE},
  {_classes(100, 500)}, {_hashes(20000)} FROM s""")
def q_route_feat_features(spark, sf_dir):
    """the 26 inputs of the route model with extra columns (eight of them scaled by
    one scaler fitted on train), cuts 100 / 500, and both hashed ids."""
    return _flat(spark, sf_dir, "route_feat")


@query("route_features", with_views(TRAVEL_OBS, *SPLIT) + f"""
SELECT obs_id, dataset, {DAYS}, {TIMES}, {_std(["LEN"], "OVER (PARTITION BY dataset)")}, SPEED, {CYCLE},
  {_classes(500, 1500)}, {_hashes(1000)} FROM s""")
def q_route_features(spark, sf_dir):
    """the 20 inputs of the route model (LEN scaled within each set, plain SPEED)."""
    return _flat(spark, sf_dir, "route")


@query("boost_features", with_views(TRAVEL_OBS, *SPLIT, """
mm AS (SELECT min(LEN) AS lo, max(LEN) AS hi FROM s WHERE dataset = 'train')""") + f"""
SELECT obs_id, dataset, {_hashes(20000)}, {TIMES},
  (LEN - lo) / CASE WHEN hi - lo = 0 THEN 1.0::DOUBLE ELSE CAST(hi - lo AS DOUBLE) END AS LEN_mm,
  sin({TWO_PI} * {H} / 24.0::DOUBLE) AS dep_time_sin, cos({TWO_PI} * {H} / 24.0::DOUBLE) AS dep_time_cos,
  ln(1 + CAST(LEN AS DOUBLE)) AS log_len, {P.tod_class(H)} AS time_of_day,
  CAST(({H} >= 7 AND {H} < 10) OR ({H} >= 18 AND {H} < 20) AS INTEGER) AS peak_hours,
  CASE WHEN LEN < 500 THEN 0 WHEN LEN < 1500 THEN 1 WHEN LEN >= 1500 THEN 2 ELSE 0 END AS distance_type
FROM s, mm""")
def q_boost_features(spark, sf_dir):
    """the 11 inputs of the boosted trees (hashed ids among them, LEN min-max scaled on train)."""
    return _flat(spark, sf_dir, "boost")


# Every step of a group, numbered; a step's values summed up in one number a feature, so
# that each is compared without a column for each of 5 x 13 values.
STEPS_SQL = with_views(TRAVEL_OBS, f"h AS (SELECT obs.*, {_hashes(20000)} FROM obs)", f"""
f AS (SELECT obs_id, route_hash, unit_hash, DEP_TIME, CAST(DAY_TYPE AS DOUBLE) AS DAY_TYPE, {TIMES},
  CASE WHEN max(LEN) OVER g = min(LEN) OVER g THEN 0.0::DOUBLE
       ELSE (LEN - min(LEN) OVER g) / CAST(max(LEN) OVER g - min(LEN) OVER g AS DOUBLE) END AS LEN_mm,
  {CYCLE}, {_classes(500, 1500)} FROM h WINDOW g AS (PARTITION BY route_hash, unit_hash))""")


@query("step_sequences", STEPS_SQL + "\nSELECT obs_id, " + ", ".join(
    f"CAST(lag({c}, {6 - i}) OVER w AS DOUBLE) AS {c}_{i}" for c in STEP_FEATURES for i in range(1, 6)) + """
FROM f WINDOW w AS (PARTITION BY route_hash, unit_hash ORDER BY DEP_TIME, obs_id)
QUALIFY row_number() OVER w > 5""")
def q_step_sequences(spark, sf_dir):
    """G1: five steps of 13 inputs before every target row, by hashed route and segment,
    LEN min-max scaled within the group (all rows, as the source's sequence loader)."""
    got = assembly.step_sequences(A.travel_obs(spark, sf_dir), FEATURE_SETS["steps"])
    return got.select("obs_id", *[F.col("seq")[i - 1][k].alias(f"{c}_{i}")
                                  for k, c in enumerate(STEP_FEATURES) for i in range(1, 6)])


# F23 -------------------------------------------------------------------------
@query("target_weight_train", with_views(TRAVEL_OBS, *SPLIT, """
tf AS (SELECT avg(TIME_GAP) AS m, CASE WHEN coalesce(stddev_pop(TIME_GAP), 0) = 0 THEN 1.0 ELSE stddev_pop(TIME_GAP) END AS sc
       FROM s WHERE dataset = 'train')""") + """
SELECT obs_id, dataset, (TIME_GAP - m) / sc AS TIME_GAP_scaled,
       CASE WHEN (TIME_GAP - m) / sc > 0.3 THEN 10.0 ELSE 1.0 END::DOUBLE AS w_target FROM s, tf""")
def q_target_weight_train(spark, sf_dir):
    """target weights by the scaler fitted on zero-filtered train rows."""
    s = _filtered_split(spark, sf_dir).select("obs_id", "dataset", "TIME_GAP")
    fit = encode.fit_standard(s.filter(F.col("dataset") == "train"), ["TIME_GAP"])
    return encode.apply_standard(s, fit, ["TIME_GAP"]).select(
        "obs_id", "dataset", "TIME_GAP_scaled", features.target_weight("TIME_GAP_scaled").alias("w_target"))


# I5 --------------------------------------------------------------------------
@query("bundle_score", with_views(TRAVEL_OBS, *SPLIT, """
fit AS (SELECT avg(LEN) AS ml, coalesce(nullif(stddev_pop(LEN), 0), 1) AS sl,
               avg(TIME_GAP) AS mt, coalesce(nullif(stddev_pop(TIME_GAP), 0), 1) AS st FROM s WHERE dataset = 'train')""", """
line AS (SELECT regr_slope((TIME_GAP - mt) / st, (LEN - ml) / sl) AS a, regr_intercept((TIME_GAP - mt) / st, (LEN - ml) / sl) AS b
         FROM s, fit WHERE dataset = 'train')""", """
p AS (SELECT obs_id, (a * ((LEN - ml) / sl) + b) * st + mt AS prediction FROM s, fit, line WHERE dataset = 'test'
        AND BUSINFOUNIT_ID IN (SELECT BUSINFOUNIT_ID FROM s WHERE dataset = 'train'))""") + """
SELECT obs_id, prediction, CAST(round_even(prediction, 0) AS INTEGER) AS TIME_GAP_ESTIMATE FROM p""")
def q_bundle_score(spark, sf_dir):
    """Model of the scaled target on the travel set's scaled LEN, written with both
    scalers, the train ids and the schema as one bundle; test rows without their actuals are
    scored from the folder alone and inverted to seconds."""
    s = _filtered_split(spark, sf_dir)
    train, fs = s.filter(F.col("dataset") == "train"), FEATURE_SETS["travel"]
    inputs, target = assembly.fit_scaler(s, fs), encode.fit_standard(train, ["TIME_GAP"])
    x = encode.apply_standard(assembly.flat(train, fs, inputs), target, ["TIME_GAP"])
    pipe = Pipeline(stages=[VectorAssembler(inputCols=["LEN_scaled"], outputCol="features"),
                            LinearRegression(labelCol="TIME_GAP_scaled", solver="normal")])
    rows = s.filter(F.col("dataset") == "test").drop("TIME_GAP", "dataset")
    schema = rows.select("BUSROUTE_ID", "BUSINFOUNIT_ID", "LEN", "DEP_TIME").schema
    path = os.path.join(ensure_checkpoint_dir(spark), "bundles", "travel_line")
    bundle.save(bundle.Bundle("travel", "TIME_GAP", schema, pipe.fit(x.select("LEN_scaled", "TIME_GAP_scaled")), inputs,
                              target, encode.label_vocabulary(train, "BUSINFOUNIT_ID"), "BUSINFOUNIT_ID"), path)
    return bundle.load(spark, path).score(rows)
