"""Queries for sources and sinks (A1-A10) and streaming scoring.

Each writes data derived from the tables into a fresh folder under the
session's shared checkpoint directory and returns the (lazy) read-back.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripframe import schema as S
from tripframe.functions import clock
from tripframe.operators import encode, evaluate, model, outliers, splits
from tripframe.plans import sqlparts as P
from tripframe.plans.q_features import SMALL2, SPLIT_SQL, STD_FIT, _split_small
from tripframe.plans.q_model import LEVELS, SCORED_SQL, _scored
from tripframe.plans.q_splits import OBS_SMALL, RATIO_CUTS, TVT, sql_assign
from tripframe.plans.registry import query
from tripframe.plans.q_outliers import OBS_TG_BOUNDS
from tripframe.plans.sqlviews import TRAVEL_OBS, with_views
from tripframe.session import ensure_checkpoint_dir
from tripframe.sources import adapters as A
from tripframe.sources import concat, files
from tripframe.streaming import live


def scratch(spark, name: str) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), "scratch", f"{name}-{uuid.uuid4().hex[:10]}")


NARROW = T.StructType([S.TRAVEL_OBS[c] for c in ("obs_id", "BUSINFOUNIT_ID", "LEN", "DEP_TIME",
                                                 "TIME_GAP", "SPEED")])
NARROW_DAY = T.StructType(NARROW.fields + [S.TRAVEL_OBS["DAY_TYPE"]])


@query("scan_typed", with_views(TRAVEL_OBS) + """
SELECT obs_id, BUSINFOUNIT_ID, LEN, DEP_TIME, TIME_GAP FROM obs""")
def q_scan_typed(spark, sf_dir):
    """A1/A2: typed CSV scan with a column subset; ids keep leading zeros."""
    path = scratch(spark, "scan_typed")
    files.write_csv(A.travel_obs(spark, sf_dir).select(*NARROW.fieldNames()), path)
    return files.read_typed_csv(spark, path, NARROW,
                                ["obs_id", "BUSINFOUNIT_ID", "LEN", "DEP_TIME", "TIME_GAP"])


@query("folder_concat", with_views(TRAVEL_OBS) + """
SELECT obs_id, BUSINFOUNIT_ID, LEN, DEP_TIME, TIME_GAP, SPEED, DAY_TYPE FROM obs""")
def q_folder_concat(spark, sf_dir):
    """A4: every *.csv / *.CSV file under a folder stacked in one scan."""
    path = scratch(spark, "folder_concat")
    obs = A.travel_obs(spark, sf_dir).select(*NARROW.fieldNames(), "DAY_TYPE")
    obs.write.mode("overwrite").partitionBy("DAY_TYPE").option("header", True).csv(path)
    df = files.read_typed_csv(spark, path, NARROW_DAY, glob="*.{csv,CSV}")
    return df.select(*NARROW.fieldNames(), "DAY_TYPE")


@query("file_audit", with_views(TRAVEL_OBS) + """
SELECT DAY_TYPE, count(*) AS rows_read, count(*) FILTER (WHERE SPEED IS NOT NULL) AS rows_kept
FROM obs GROUP BY 1""")
def q_file_audit(spark, sf_dir):
    """A5: per-file rows read / kept (SPEED present), rolled up per folder."""
    path = scratch(spark, "file_audit")
    obs = A.travel_obs(spark, sf_dir).select(*NARROW.fieldNames(), "DAY_TYPE")
    obs.write.mode("overwrite").partitionBy("DAY_TYPE").option("header", True).csv(path)
    df = files.read_typed_csv(spark, path, NARROW_DAY,
                              glob="*.{csv,CSV}", with_file=True)
    per_file = files.file_audit(df, ["SPEED"], by=("DAY_TYPE", "source_file"))
    return per_file.groupBy("DAY_TYPE").agg(F.sum("rows_read").alias("rows_read"),
                                            F.sum("rows_kept").alias("rows_kept"))


STEP_SOURCE = """
src AS (SELECT DAY_TYPE, BUSROUTE_ID, BUSINFOUNIT_ID, LEN, DEP_TIME, CASE WHEN obs_id % 11 = 0 THEN NULL ELSE TIME_GAP END AS TIME_GAP,
               SPEED FROM obs)"""


def _with_gaps(spark, sf_dir, path):
    """Observations with some missing TIME_GAPs (and the SPEEDs that can't be computed)
    written as CSV, one folder per day type."""
    obs = A.travel_obs(spark, sf_dir).select(
        "DAY_TYPE", "BUSROUTE_ID", "BUSINFOUNIT_ID", "LEN", "DEP_TIME",
        F.when(F.col("obs_id") % 11 != 0, F.col("TIME_GAP")).alias("TIME_GAP"), "SPEED")
    obs.write.mode("overwrite").partitionBy("DAY_TYPE").option("header", True).csv(path)


CONCAT = T.StructType([S.TRAVEL_OBS[c] for c in ("BUSROUTE_ID", "BUSINFOUNIT_ID", "LEN", "DEP_TIME", "TIME_GAP", "SPEED",
                                                 "DAY_TYPE")])


@query("concat_audit", with_views(TRAVEL_OBS, STEP_SOURCE) + """
SELECT DAY_TYPE, count(*) AS rows_read, count(*) FILTER (WHERE SPEED IS NULL) AS "dropped_SPEED",
       count(*) FILTER (WHERE SPEED IS NOT NULL AND TIME_GAP IS NULL) AS "dropped_TIME_GAP",
       count(*) FILTER (WHERE SPEED IS NOT NULL AND TIME_GAP IS NOT NULL) AS rows_kept FROM src GROUP BY 1""")
def q_concat_audit(spark, sf_dir):
    """A5: rows that each step drops, counted over the marked rows (here per folder, as
    file names differ from run to run)."""
    path = scratch(spark, "concat_in")
    _with_gaps(spark, sf_dir, path)
    marked = concat.read_marked(spark, path, CONCAT, ["SPEED", "TIME_GAP"])
    return concat.step_audit(marked, ["SPEED", "TIME_GAP"], by=["DAY_TYPE"])


@query("concat_sorted", with_views(TRAVEL_OBS, STEP_SOURCE) + """
SELECT DISTINCT * FROM src WHERE SPEED IS NOT NULL AND TIME_GAP IS NOT NULL""")
def q_concat_sorted(spark, sf_dir):
    """A4 + A5 + B3 + B5 + B9 + A8: a folder stacked, audited, cleaned, made distinct,
    ordered and written; the written files read back."""
    path, out = scratch(spark, "concat_in"), scratch(spark, "concat_out")
    _with_gaps(spark, sf_dir, path)
    concat.concat(spark, path, out, CONCAT)
    return files.read_typed_csv(spark, out, CONCAT)


@query("csv_roundtrip", with_views(TRAVEL_OBS) + f"SELECT {P.TRAVEL_COLS} FROM obs")
def q_csv_roundtrip(spark, sf_dir):
    """Header CSV sink read back with the declared T1 schema."""
    path = scratch(spark, "csv_roundtrip")
    files.write_csv(A.travel_obs(spark, sf_dir), path)
    return files.read_typed_csv(spark, path, S.TRAVEL_OBS)


@query("partitioned_roundtrip", with_views(TRAVEL_OBS, OBS_SMALL) + "SELECT * FROM (" + sql_assign(
    "small", [], 42, RATIO_CUTS, TVT) + ") WHERE dataset = 'test'")
def q_partitioned_roundtrip(spark, sf_dir):
    """D1 split written once, one folder per set; the test folder is read
    back by partition pruning."""
    path = scratch(spark, "partitioned")
    obs = A.travel_obs(spark, sf_dir).select("obs_id", "BUSROUTE_ID", "BUSINFOUNIT_ID", "TIME_GAP")
    files.write_split(splits.random_split(obs), path)
    return spark.read.parquet(path).filter(F.col("dataset") == "test")


@query("sorted_roundtrip", with_views(TRAVEL_OBS) + """
SELECT obs_id, BUSROUTE_ID, BUSINFOUNIT_ID, DEP_TIME, TIME_GAP FROM obs""")
def q_sorted_roundtrip(spark, sf_dir):
    """Globally sorted (route, segment, time) sink read back."""
    path = scratch(spark, "sorted")
    obs = A.travel_obs(spark, sf_dir).select("obs_id", "BUSROUTE_ID", "BUSINFOUNIT_ID", "DEP_TIME",
                                             "TIME_GAP")
    files.write_sorted(obs, path, ["BUSROUTE_ID", "BUSINFOUNIT_ID", "DEP_TIME"])
    return spark.read.parquet(path)


@query("fit_table_roundtrip", with_views(TRAVEL_OBS, SMALL2, SPLIT_SQL, STD_FIT) + """
SELECT obs_id, dataset, (LEN - mean_LEN) / sc_LEN AS LEN_scaled, (TIME_GAP - mean_TG) / sc_TG AS TIME_GAP_scaled
FROM s, fit2""")
def q_fit_table_roundtrip(spark, sf_dir):
    """A9 + F13: scaler fit table saved, reloaded, applied."""
    s = _split_small(spark, sf_dir)
    path = scratch(spark, "fit_table")
    files.save_fit_table(encode.fit_standard(s.filter(F.col("dataset") == "train"),
                                             ["LEN", "TIME_GAP"]), path)
    fit = files.load_fit_table(spark, path)
    return encode.apply_standard(s, fit, ["LEN", "TIME_GAP"]).select(
        "obs_id", "dataset", "LEN_scaled", "TIME_GAP_scaled")


METRICS_SCHEMA = T.StructType([T.StructField("n", T.LongType()), T.StructField("mae", T.DoubleType()),
                               T.StructField("mse", T.DoubleType()), T.StructField("rmse", T.DoubleType()),
                               T.StructField("mape", T.DoubleType())])


@query("metrics_json_roundtrip", with_views(TRAVEL_OBS, *SCORED_SQL) + """
SELECT count(*) AS n, avg(abs(prediction - TIME_GAP)) AS mae,
       avg((prediction - TIME_GAP) * (prediction - TIME_GAP)) AS mse,
       sqrt(avg((prediction - TIME_GAP) * (prediction - TIME_GAP))) AS rmse,
       avg(abs(prediction - TIME_GAP) / (abs(TIME_GAP) + 1e-8::DOUBLE)) * 100 AS mape FROM scored""")
def q_metrics_json_roundtrip(spark, sf_dir):
    """A10: test metrics written as JSON and read back."""
    path = scratch(spark, "metrics_json")
    files.write_json(evaluate.metrics(_scored(spark, sf_dir)), path)
    return files.read_json(spark, path, METRICS_SCHEMA)


@query("stream_score", with_views(TRAVEL_OBS, f"""
o5 AS (SELECT *, {P.tod_class(P.hour('DEP_TIME'))} AS tod_class FROM obs),
m0 AS (SELECT BUSINFOUNIT_ID, tod_class, avg(TIME_GAP) AS _m0 FROM o5 GROUP BY ALL),
m1 AS (SELECT BUSINFOUNIT_ID, avg(TIME_GAP) AS _m1 FROM o5 GROUP BY ALL),
m2 AS (SELECT avg(TIME_GAP) AS _m2 FROM o5)""") + f"""
SELECT obs_id, BUSINFOUNIT_ID, DEP_TIME, TIME_GAP, coalesce(_m0, _m1, _m2) AS prediction
FROM o5 LEFT JOIN m0 USING (BUSINFOUNIT_ID, tod_class) LEFT JOIN m1 USING (BUSINFOUNIT_ID) CROSS JOIN m2
WHERE LEN > 0 AND {P.TRAVEL_ROW_RULES}""")
def q_stream_score(spark, sf_dir):
    """Streaming (B6 rules, I5 scoring): events read as a stream, the stateless travel rules applied,
    each row scored by a stream-static join with the group-mean fit tables
    (fit on the static table), drained to a parquet sink and read back."""
    static = A.travel_obs(spark, sf_dir).withColumn(
        "tod_class", clock.tod_class(clock.hour_of("DEP_TIME")))
    fits = model.fit_group_mean(static, LEVELS)
    stream = live.clean_stream(A.travel_obs_from(live.events_stream(spark, sf_dir)))
    scored = live.score_stream(stream, fits, LEVELS).select(
        "obs_id", "BUSINFOUNIT_ID", "DEP_TIME", "TIME_GAP", "prediction")
    out = scratch(spark, "stream_score")
    live.run_to_parquet(scored, out, out + "-ckpt")
    return spark.read.parquet(out)


@query("iqr_split_saved", with_views(TRAVEL_OBS, OBS_TG_BOUNDS) + """
SELECT obs_id, BUSINFOUNIT_ID, TIME_GAP FROM obs, tb WHERE TIME_GAP < lo OR TIME_GAP > hi""")
def q_iqr_split_saved(spark, sf_dir):
    """Kept and outlier rows written once, one folder each; the outlier
    folder read back by partition pruning."""
    path = scratch(spark, "iqr_split")
    obs = A.travel_obs(spark, sf_dir).select("obs_id", "BUSINFOUNIT_ID", "TIME_GAP")
    outliers.save_iqr_split(obs, ["TIME_GAP"], path)
    return spark.read.parquet(path).filter(F.col("iqr_set") == "outlier").drop("iqr_set")


@query("stream_window_means", with_views(TRAVEL_OBS, f"""
c AS (SELECT *, strptime(COLLECT_DATE || ' ' || DEP_TIME, '%Y-%m-%d %H:%M') AS event_ts FROM obs
      WHERE LEN > 0 AND {P.TRAVEL_ROW_RULES}),
wm AS (SELECT max(event_ts) - INTERVAL 2 HOUR AS watermark FROM c)""") + """
SELECT window_start, window_end, BUSINFOUNIT_ID, mean_time_gap, n FROM (
  SELECT time_bucket(INTERVAL 1 HOUR, event_ts) AS window_start,
         time_bucket(INTERVAL 1 HOUR, event_ts) + INTERVAL 1 HOUR AS window_end,
         BUSINFOUNIT_ID, avg(TIME_GAP) AS mean_time_gap, count(*) AS n
  FROM c GROUP BY ALL), wm
WHERE window_end <= watermark""")
def q_stream_window_means(spark, sf_dir):
    """Streaming (E9-style profile): hourly mean TIME_GAP per segment over the cleaned event
    stream with a 2-hour watermark, append mode (only windows the watermark
    has closed are emitted, each exactly once), drained to parquet."""
    stream = live.clean_stream(A.travel_obs_from(live.events_stream(spark, sf_dir)))
    agg = live.windowed_segment_means(stream, "1 hour", "2 hours")
    out = scratch(spark, "stream_windows")
    live.run_to_parquet(agg, out, out + "-ckpt")
    return spark.read.parquet(out)
