"""Declared schemas of the logical tables (T1..T6).

Columns keep the upper-case names of the source files so reports line up
with the operators' inputs. ``obs_id`` is our explicit row key: every join
that aligns predictions or sequences with rows uses it, never position.
"""

from pyspark.sql import types as T

TRAVEL_OBS = T.StructType([
    T.StructField("obs_id", T.LongType(), False),
    T.StructField("DAY_TYPE", T.ByteType()),
    T.StructField("BUSROUTE_ID", T.StringType()),
    T.StructField("PEEK_ALLOC", T.ShortType()),
    T.StructField("NPEEK_ALLOC", T.ShortType()),
    T.StructField("ROUTE_LEN", T.IntegerType()),
    T.StructField("BUSSTOP_CNT", T.ShortType()),
    T.StructField("INFOUNIT_SEQ", T.ShortType()),
    T.StructField("BUSINFOUNIT_ID", T.StringType()),
    T.StructField("LEN", T.IntegerType()),
    T.StructField("GPS_COORDX", T.FloatType()),
    T.StructField("GPS_COORDY", T.FloatType()),
    T.StructField("COLLECT_DATE", T.StringType()),
    T.StructField("DEP_TIME", T.StringType()),
    T.StructField("TIME_GAP", T.IntegerType()),
    T.StructField("SPEED", T.IntegerType()),
    T.StructField("DATA_TYPE", T.StringType()),
])

# Narrow travel file as the training scripts read it.
TRAVEL_NARROW_COLS = ["BUSINFOUNIT_ID", "LEN", "DEP_TIME", "TIME_GAP"]

HOLDING_OBS = T.StructType([
    T.StructField("obs_id", T.LongType(), False),
    T.StructField("DAY_TYPE", T.ByteType()),
    T.StructField("BUSROUTE_ID", T.StringType()),
    T.StructField("BUSSTOP_ID", T.StringType()),
    T.StructField("COLLECT_DATE", T.StringType()),
    T.StructField("DEP_TIME", T.StringType()),
    T.StructField("TIME_GAP", T.IntegerType()),
])

RAW_EVENTS = T.StructType([
    T.StructField("obs_id", T.LongType(), False),
    T.StructField("ARR_DATE", T.StringType()),
    T.StructField("DEP_DATE", T.StringType()),
    T.StructField("DAY_TYPE", T.ByteType()),
    T.StructField("BUSROUTE_ID", T.StringType()),
    T.StructField("LOCATION_ID", T.StringType()),
    T.StructField("TIME_GAP", T.IntegerType()),
])

# Grid output of the minute densifier (generated rows: TIME_GAP -1, speed 0).
GRID_OUT_COLS = ["DAY_TYPE", "BUSINFOUNIT_ID", "LEN", "DEP_TIME", "TIME_GAP",
                 "speed_kmh"]

COMPARISON = T.StructType([
    T.StructField("obs_id", T.LongType(), False),
    T.StructField("TRAVEL_TIME_EVENT", T.DoubleType()),
    T.StructField("SERVICE_TIME_EVENT", T.DoubleType()),
    T.StructField("DIFF_EVENT_AI", T.DoubleType()),
    T.StructField("DIFF_EVENT_BIS", T.DoubleType()),
    T.StructField("DIFF_EVENT_SERVICE_AI", T.DoubleType()),
    T.StructField("DIFF_EVENT_SERVICE_BIS", T.DoubleType()),
])

PREDICTION_REPORT_EXTRA = ["TIME_GAP_ESTIMATE", "ERROR", "ERROR_RATE"]

SAMPLE_COMPARISON = T.StructType([
    T.StructField("Category", T.StringType()),
    T.StructField("Actual", T.DoubleType()),
    T.StructField("Predicted", T.DoubleType()),
    T.StructField("Absolute Error", T.DoubleType()),
])
