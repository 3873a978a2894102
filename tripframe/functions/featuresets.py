"""Named, ordered feature sets (F24) and their column expressions.

A feature set is the ordered list of model inputs of one of the source
models. Columns are built as named expressions; ``assemble`` turns them
into the single vector column Spark ML expects, only at the model edge.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripframe.functions import clock, features
from tripframe.functions.hashing import md5_mod

# Ordered inputs of the travel model (9 features).
TRAVEL_FEATURES = ("dep_hour", "dep_minute", "LEN_scaled", "dep_time_sin", "dep_time_cos",
                   "log_len", "time_of_day", "peak_hours", "distance_type")

# Ordered inputs of the holding model (6 features).
HOLDING_FEATURES = ("dep_hour", "dep_minute", "dep_time_sin", "dep_time_cos", "time_of_day",
                    "peak_hours")

# Ordered inputs of the boosted-tree model (11 features).
BOOST_FEATURES = ("route_hash", "unit_hash", "dep_hour", "dep_minute", "LEN_mm", "dep_time_sin", "dep_time_cos", "log_len",
                  "time_of_day", "peak_hours", "distance_type")


# One-hot day columns; scaled inputs of the route models.
DAY_COLUMNS = tuple(f"day_{d}" for d in features.DAY_TYPES)
ROUTE_FEAT_SCALED = ("LEN", "PEEK_ALLOC", "NPEEK_ALLOC", "BUSSTOP_CNT", "INFOUNIT_SEQ", "GPS_COORDX", "GPS_COORDY",
                     "LOG_ROUTE_LEN")

# Ordered cyclic and class inputs that the route models and the sequence steps share.
_CYCLIC = ("dep_time_sin", "dep_time_cos", "day_type_sin", "day_type_cos")
_CLASSES = ("log_len", "is_weekend", "time_of_day", "peak_hours", "distance_type")

# Ordered inputs of the route models (26 and 20 features) and of a sequence step (13).
ROUTE_FEAT_FEATURES = (*DAY_COLUMNS, "dep_hour", "dep_minute", *(f"{c}_scaled" for c in ROUTE_FEAT_SCALED), *_CYCLIC,
                       *_CLASSES)
ROUTE_FEATURES = (*DAY_COLUMNS, "dep_hour", "dep_minute", "LEN_scaled", "SPEED", *_CYCLIC, *_CLASSES)
STEP_FEATURES = ("DAY_TYPE", "dep_hour", "dep_minute", "LEN_mm", *_CYCLIC, *_CLASSES)


@dataclass(frozen=True)
class FeatureSet:
    """Ordered inputs of one model and how its scaled columns are fitted.

    ``scaler``: standard (suffix ``_scaled``), minmax (``_mm``) or None; ``scope``: what
    a fit covers: ``train`` rows, each ``set`` by itself, or each ``group``."""
    name: str
    columns: tuple[str, ...]
    scaled: tuple[str, ...] = ()
    scaler: str | None = None
    scope: str = "train"
    cuts: tuple[int, int] = features.TRAVEL_DISTANCE_CUTS
    route_hash: int | None = None
    unit_hash: int | None = None


# Scaler, fit scope, distance cuts and hash sizes of each model.
FEATURE_SETS = {s.name: s for s in (
    FeatureSet("travel", TRAVEL_FEATURES, ("LEN",), "standard", unit_hash=20000),
    FeatureSet("route_feat", ROUTE_FEAT_FEATURES, ROUTE_FEAT_SCALED, "standard",
               cuts=features.ROUTE_DISTANCE_CUTS, route_hash=20000, unit_hash=20000),
    FeatureSet("route", ROUTE_FEATURES, ("LEN",), "standard", "set", route_hash=1000, unit_hash=1000),
    FeatureSet("boost", BOOST_FEATURES, ("LEN",), "minmax", route_hash=20000, unit_hash=20000),
    FeatureSet("steps", STEP_FEATURES, ("LEN",), "minmax", "group", route_hash=20000, unit_hash=20000),
)}


def row_features(df: DataFrame, fs: FeatureSet) -> DataFrame:
    """Adds every input of ``fs`` that one row gives, the columns that its scaler
    reads and the hashed ids; the scaled ones need a fit (``operators.assembly``)."""
    hour = clock.hour_of("DEP_TIME")
    ts, tc = features.cyclic(hour, 24)
    want = set(fs.columns) | set(fs.scaled)
    made = {"dep_hour": hour, "dep_minute": clock.minute_of("DEP_TIME"), "dep_time_sin": ts, "dep_time_cos": tc,
            "log_len": F.log1p(F.col("LEN").cast("double")), "time_of_day": clock.tod_class(hour),
            "peak_hours": clock.peak_flag(hour), "distance_type": features.distance_class("LEN", fs.cuts)}
    if "day_type_sin" in want:
        ds, dc = features.cyclic("DAY_TYPE", 7)
        made |= {"day_type_sin": ds, "day_type_cos": dc, "is_weekend": clock.weekend_flag(F.col("DAY_TYPE"))}
    if DAY_COLUMNS[0] in want:
        made |= dict(zip(DAY_COLUMNS, features.onehot("DAY_TYPE", features.DAY_TYPES)))
    if "LOG_ROUTE_LEN" in want:
        made["LOG_ROUTE_LEN"] = F.log1p(F.col("ROUTE_LEN").cast("double"))
    if fs.route_hash:
        made["route_hash"] = md5_mod("BUSROUTE_ID", fs.route_hash)
    if fs.unit_hash:
        made["unit_hash"] = md5_mod("BUSINFOUNIT_ID", fs.unit_hash)
    return df.withColumns(made)


def travel_features(df: DataFrame, hash_size: int = 20000, len_col: str = "LEN",
                    time_col: str = "DEP_TIME", id_col: str = "BUSINFOUNIT_ID") -> DataFrame:
    """Adds every travel feature but the scaled LEN (which needs a fit)."""
    h = clock.hour_of(time_col)
    out = (df.withColumn("dep_hour", h)
             .withColumn("dep_minute", clock.minute_of(time_col)))
    s, c = features.cyclic(F.col("dep_hour"), 24)
    return (out.withColumn("dep_time_sin", s).withColumn("dep_time_cos", c)
               .withColumn("log_len", F.log1p(F.col(len_col).cast("double")))
               .withColumn("time_of_day", clock.tod_class(F.col("dep_hour")))
               .withColumn("peak_hours", clock.peak_flag(F.col("dep_hour")))
               .withColumn("distance_type", features.distance_class(len_col))
               .withColumn("unit_hash", md5_mod(id_col, hash_size)))


def boost_features(df: DataFrame, hash_size: int = 20000, route_col: str = "BUSROUTE_ID") -> DataFrame:
    """Adds the boosted-tree features but the min-max scaled LEN (which needs a fit)."""
    return travel_features(df, hash_size).withColumn("route_hash", md5_mod(route_col, hash_size))


def holding_features(df: DataFrame, route_hash: int = 1452, stop_hash: int = 13693,
                     time_col: str = "DEP_TIME") -> DataFrame:
    h = clock.hour_of(time_col)
    out = df.withColumn("dep_hour", h).withColumn("dep_minute", clock.minute_of(time_col))
    s, c = features.cyclic(F.col("dep_hour"), 24)
    return (out.withColumn("dep_time_sin", s).withColumn("dep_time_cos", c)
               .withColumn("time_of_day", clock.tod_class(F.col("dep_hour")))
               .withColumn("peak_hours", clock.peak_flag(F.col("dep_hour"), evening_start=17))
               .withColumn("route_hash", md5_mod("BUSROUTE_ID", route_hash))
               .withColumn("stop_hash", md5_mod("BUSSTOP_ID", stop_hash)))


def assemble(df: DataFrame, cols, out: str = "features") -> DataFrame:
    """Ordered columns -> one ``VectorUDT`` column (model edge only)."""
    return VectorAssembler(inputCols=list(cols), outputCol=out,
                           handleInvalid="keep").transform(df)
