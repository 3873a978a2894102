"""Queries for scalar features, scalers and encoders."""

from __future__ import annotations

import math

from pyspark.ml.feature import HashingTF, Tokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tripframe.functions import clock, features, featuresets
from tripframe.functions.hashing import md5_mod
from tripframe.functions.text import composite_key, hashed_tokens
from tripframe.operators import clean, encode, splits
from tripframe.operators.positions import attach_scalars
from tripframe.plans import sqlparts as P
from tripframe.plans.q_splits import RATIO_CUTS, TVT, sql_assign
from tripframe.plans.registry import query
from tripframe.plans.sqlviews import HOLDING_OBS, LINE_OBS, TRAVEL_OBS, with_views
from tripframe.sources import adapters as A
from tripframe.sources import files

TWO_PI = repr(2 * math.pi)
H = P.hour("DEP_TIME")


def _obs(spark, sf_dir):
    return A.travel_obs(spark, sf_dir)


# F1-F3 ---------------------------------------------------------------------
@query("time_features", with_views(TRAVEL_OBS) + f"""
SELECT obs_id, DEP_TIME, {H} AS dep_hour, {P.minute('DEP_TIME')} AS dep_minute,
       {H} * 60 + {P.minute('DEP_TIME')} AS minute_of_day FROM obs""")
def q_time_features(spark, sf_dir):
    """hour, minute and minute of day of the departure time."""
    return _obs(spark, sf_dir).select(
        "obs_id", "DEP_TIME", clock.hour_of("DEP_TIME").alias("dep_hour"),
        clock.minute_of("DEP_TIME").alias("dep_minute"),
        clock.minute_of_day("DEP_TIME").alias("minute_of_day"))


# F4/F5 ---------------------------------------------------------------------
@query("cyclic", with_views(TRAVEL_OBS) + f"""
SELECT obs_id, sin({TWO_PI}::DOUBLE * {H} / 24.0::DOUBLE) AS dep_time_sin,
       cos({TWO_PI}::DOUBLE * {H} / 24.0::DOUBLE) AS dep_time_cos,
       sin({TWO_PI}::DOUBLE * DAY_TYPE / 7.0::DOUBLE) AS day_type_sin,
       cos({TWO_PI}::DOUBLE * DAY_TYPE / 7.0::DOUBLE) AS day_type_cos FROM obs""")
def q_cyclic(spark, sf_dir):
    """sin/cos of hour/24 and of DAY_TYPE/7."""
    obs = _obs(spark, sf_dir)
    hs, hc = features.cyclic(clock.hour_of("DEP_TIME"), 24)
    ds, dc = features.cyclic("DAY_TYPE", 7)
    return obs.select("obs_id", hs.alias("dep_time_sin"), hc.alias("dep_time_cos"),
                      ds.alias("day_type_sin"), dc.alias("day_type_cos"))


@query("log_len", with_views(TRAVEL_OBS) + """
SELECT obs_id, ln(1 + CAST(LEN AS DOUBLE)) AS log_len, ln(1 + CAST(ROUTE_LEN AS DOUBLE)) AS log_route_len
FROM obs""")
def q_log_len(spark, sf_dir):
    """log1p of segment and route length."""
    return _obs(spark, sf_dir).select(
        "obs_id", F.log1p(F.col("LEN").cast("double")).alias("log_len"),
        F.log1p(F.col("ROUTE_LEN").cast("double")).alias("log_route_len"))


@query("weekend", with_views(TRAVEL_OBS) + """
SELECT obs_id, DAY_TYPE, CAST(DAY_TYPE IN (1, 7) AS INTEGER) AS is_weekend FROM obs""")
def q_weekend(spark, sf_dir):
    """weekend flag for DAY_TYPE 1 (Sunday) and 7 (Saturday)."""
    return _obs(spark, sf_dir).select("obs_id", "DAY_TYPE",
                                      clock.weekend_flag(F.col("DAY_TYPE")).alias("is_weekend"))


@query("tod_class", with_views(TRAVEL_OBS) + f"""
SELECT obs_id, {P.tod_class(H, 2)} AS time_of_day, {P.tod_class(H, 0)} AS time_of_day_v0 FROM obs""")
def q_tod_class(spark, sf_dir):
    """F8: time-of-day class, default 2 (travel) and 0 (variant)."""
    h = clock.hour_of("DEP_TIME")
    return _obs(spark, sf_dir).select("obs_id", clock.tod_class(h, 2).alias("time_of_day"),
                                      clock.tod_class(h, 0).alias("time_of_day_v0"))


@query("peak", with_views(TRAVEL_OBS) + f"""
SELECT obs_id, CAST(({H} >= 7 AND {H} < 10) OR ({H} >= 18 AND {H} < 20) AS INTEGER) AS peak_travel,
       CAST(({H} >= 7 AND {H} < 10) OR ({H} >= 17 AND {H} < 20) AS INTEGER) AS peak_holding FROM obs""")
def q_peak(spark, sf_dir):
    """peak flag with the travel (18h) and holding (17h) evening start."""
    h = clock.hour_of("DEP_TIME")
    return _obs(spark, sf_dir).select("obs_id", clock.peak_flag(h, 18).alias("peak_travel"),
                                      clock.peak_flag(h, 17).alias("peak_holding"))


@query("distance_class", with_views(TRAVEL_OBS) + """
SELECT obs_id, LEN,
  CASE WHEN LEN < 500 THEN 0 WHEN LEN < 1500 THEN 1 WHEN LEN >= 1500 THEN 2 ELSE 0 END AS distance_type,
  CASE WHEN LEN < 100 THEN 0 WHEN LEN < 500 THEN 1 WHEN LEN >= 500 THEN 2 ELSE 0 END AS distance_type_route
FROM obs""")
def q_distance_class(spark, sf_dir):
    """travel cuts 500/1500 and route-model cuts 100/500."""
    return _obs(spark, sf_dir).select(
        "obs_id", "LEN", features.distance_class("LEN").alias("distance_type"),
        features.distance_class("LEN", features.ROUTE_DISTANCE_CUTS).alias("distance_type_route"))


@query("onehot_day", with_views(TRAVEL_OBS) + "SELECT obs_id, " + ", ".join(
    f"CAST(DAY_TYPE = {d} AS DOUBLE) AS day_{d}" for d in features.DAY_TYPES) + " FROM obs")
def q_onehot_day(spark, sf_dir):
    """always seven day columns in order; absent days are 0."""
    cols = features.onehot("DAY_TYPE", features.DAY_TYPES)
    return _obs(spark, sf_dir).select(
        "obs_id", *[c.alias(f"day_{d}") for c, d in zip(cols, features.DAY_TYPES)])


@query("onehot_type", with_views(TRAVEL_OBS) + "SELECT obs_id, " + ", ".join(
    f"CAST(DATA_TYPE = '{t}' AS DOUBLE) AS {t}" for t in features.DATA_TYPES) + " FROM obs")
def q_onehot_type(spark, sf_dir):
    """EVENT / PATRN columns in alphabetical order."""
    cols = features.onehot("DATA_TYPE", features.DATA_TYPES)
    return _obs(spark, sf_dir).select(
        "obs_id", *[c.alias(t) for c, t in zip(cols, features.DATA_TYPES)])


# F12 -----------------------------------------------------------------------
@query("md5_bucket", with_views(TRAVEL_OBS) + f"""
SELECT obs_id, BUSINFOUNIT_ID, {P.md5_mod('BUSINFOUNIT_ID', 20000)} AS unit_hash,
       {P.md5_mod('BUSROUTE_ID', 1000)} AS route_hash FROM obs""")
def q_md5_bucket(spark, sf_dir):
    """int(md5(id), 16) mod N per column (20 000 segments, 1 000 routes)."""
    return _obs(spark, sf_dir).select(
        "obs_id", "BUSINFOUNIT_ID", md5_mod("BUSINFOUNIT_ID", 20000).alias("unit_hash"),
        md5_mod("BUSROUTE_ID", 1000).alias("route_hash"))


# F13-F15 -------------------------------------------------------------------
SPLIT_SQL = "s AS (" + sql_assign("small2", [], 42, RATIO_CUTS, TVT) + ")"
SMALL2 = ("small2 AS (SELECT obs_id, LEN, TIME_GAP, BUSINFOUNIT_ID, BUSROUTE_ID FROM obs "
          "WHERE coalesce(LEN <> 0, true) AND coalesce(TIME_GAP <> 0, true))")
STD_FIT = """fit AS (SELECT avg(LEN) AS mean_LEN, stddev_pop(LEN) AS sd_LEN,
                    avg(TIME_GAP) AS mean_TG, stddev_pop(TIME_GAP) AS sd_TG FROM s WHERE dataset = 'train'),
fit2 AS (SELECT mean_LEN, CASE WHEN sd_LEN IS NULL OR sd_LEN = 0 THEN 1.0 ELSE sd_LEN END AS sc_LEN,
                mean_TG, CASE WHEN sd_TG IS NULL OR sd_TG = 0 THEN 1.0 ELSE sd_TG END AS sc_TG FROM fit)"""


def _split_small(spark, sf_dir):
    obs = clean.zero_filter(_obs(spark, sf_dir), ["LEN", "TIME_GAP"]).select(
        "obs_id", "LEN", "TIME_GAP", "BUSINFOUNIT_ID", "BUSROUTE_ID")
    return files.stage_table(splits.random_split(obs), "small_split")


def _scaled(spark, sf_dir):
    s = _split_small(spark, sf_dir)
    fit = encode.fit_standard(s.filter(F.col("dataset") == "train"), ["LEN", "TIME_GAP"])
    return s, fit, encode.apply_standard(s, fit, ["LEN", "TIME_GAP"])


@query("standard_scale", with_views(TRAVEL_OBS, SMALL2, SPLIT_SQL, STD_FIT) + """
SELECT obs_id, dataset, (LEN - mean_LEN) / sc_LEN AS LEN_scaled, (TIME_GAP - mean_TG) / sc_TG AS TIME_GAP_scaled
FROM s, fit2""")
def q_standard_scale(spark, sf_dir):
    """scaler fit on the train split only, applied to every set."""
    _, _, out = _scaled(spark, sf_dir)
    return out.select("obs_id", "dataset", "LEN_scaled", "TIME_GAP_scaled")


@query("standard_inverse", with_views(TRAVEL_OBS, SMALL2, SPLIT_SQL, STD_FIT) + """
SELECT obs_id, TIME_GAP, round(((TIME_GAP - mean_TG) / sc_TG) * sc_TG + mean_TG, 6) + 0.0 AS TIME_GAP_restored
FROM s, fit2""")
def q_standard_inverse(spark, sf_dir):
    """F13 inverse: scaled target back to seconds (reported to the
    microsecond; + 0.0 folds a negative zero)."""
    _, fit, out = _scaled(spark, sf_dir)
    inv = encode.invert_standard(out, fit, "TIME_GAP_scaled", "TIME_GAP", "TIME_GAP_restored")
    return inv.select("obs_id", "TIME_GAP",
                      (F.round("TIME_GAP_restored", 6) + F.lit(0.0)).alias("TIME_GAP_restored"))


@query("standard_scale_per_set", with_views(TRAVEL_OBS, SMALL2, SPLIT_SQL, """
fs AS (SELECT dataset, avg(LEN) AS m, CASE WHEN stddev_pop(LEN) = 0 THEN 1.0 ELSE stddev_pop(LEN) END AS sc
       FROM s GROUP BY dataset)""") + """
SELECT obs_id, dataset, (LEN - m) / sc AS LEN_scaled FROM s JOIN fs USING (dataset)""")
def q_standard_scale_per_set(spark, sf_dir):
    """The scaler refit on each set separately (source behaviour)."""
    s = _split_small(spark, sf_dir)
    fit = encode.fit_standard(s, ["LEN"], by=["dataset"])
    return encode.apply_standard(s, fit, ["LEN"], by=["dataset"]).select(
        "obs_id", "dataset", "LEN_scaled")


@query("minmax", with_views(TRAVEL_OBS, SMALL2, SPLIT_SQL, """
mm AS (SELECT min(LEN) AS lo, max(LEN) AS hi, min(TIME_GAP) AS lo2, max(TIME_GAP) AS hi2
       FROM s WHERE dataset = 'train')""") + """
SELECT obs_id, dataset, (LEN - lo) / CASE WHEN hi - lo = 0 THEN 1.0 ELSE CAST(hi - lo AS DOUBLE) END AS LEN_mm,
       (TIME_GAP - lo2) / CASE WHEN hi2 - lo2 = 0 THEN 1.0 ELSE CAST(hi2 - lo2 AS DOUBLE) END AS TIME_GAP_mm
FROM s, mm""")
def q_minmax(spark, sf_dir):
    """min-max scaler fit on train, applied to all sets."""
    s = _split_small(spark, sf_dir)
    fit = encode.fit_minmax(s.filter(F.col("dataset") == "train"), ["LEN", "TIME_GAP"])
    return encode.apply_minmax(s, fit, ["LEN", "TIME_GAP"]).select(
        "obs_id", "dataset", "LEN_mm", "TIME_GAP_mm")


@query("minmax_group", with_views(TRAVEL_OBS) + """
SELECT obs_id, BUSROUTE_ID, BUSINFOUNIT_ID,
  CASE WHEN max(LEN) OVER w = min(LEN) OVER w THEN 0.0
       ELSE (LEN - min(LEN) OVER w) / CAST(max(LEN) OVER w - min(LEN) OVER w AS DOUBLE) END AS LEN_mm,
  CASE WHEN max(TIME_GAP) OVER w = min(TIME_GAP) OVER w THEN 0.0
       ELSE (TIME_GAP - min(TIME_GAP) OVER w) / CAST(max(TIME_GAP) OVER w - min(TIME_GAP) OVER w AS DOUBLE) END AS TIME_GAP_mm
FROM obs WINDOW w AS (PARTITION BY BUSROUTE_ID, BUSINFOUNIT_ID)""")
def q_minmax_group(spark, sf_dir):
    """min-max within (route, segment); constant groups -> 0."""
    obs = _obs(spark, sf_dir).select("obs_id", "BUSROUTE_ID", "BUSINFOUNIT_ID", "LEN", "TIME_GAP")
    return encode.minmax_by_group(obs, ["LEN", "TIME_GAP"], ["BUSROUTE_ID", "BUSINFOUNIT_ID"]) \
        .select("obs_id", "BUSROUTE_ID", "BUSINFOUNIT_ID", "LEN_mm", "TIME_GAP_mm")


# F16-F19 -------------------------------------------------------------------
LINE_SPLIT = with_views(LINE_OBS, """
d AS (SELECT _d, row_number() OVER (ORDER BY _d) - 1 AS _pos, count(*) OVER () AS n
      FROM (SELECT DISTINCT COLLECT_DATE AS _d FROM lobs)),
ls AS (SELECT lobs.*, CASE WHEN _pos < floor(0.7::DOUBLE * n) THEN 'train'
                           WHEN _pos < floor(0.7::DOUBLE * n) + floor(0.15::DOUBLE * n) THEN 'validation'
                           ELSE 'test' END AS dataset FROM lobs JOIN d ON lobs.COLLECT_DATE = d._d),
voc AS (SELECT value, CAST(row_number() OVER (ORDER BY value) - 1 AS INTEGER) AS code
        FROM (SELECT DISTINCT BUSINFOUNIT_ID AS value FROM ls WHERE dataset = 'train'))""")


def _line_split(spark, sf_dir):
    return files.stage_table(splits.date_split(A.line_obs(spark, sf_dir)), "line_split")


def _train_vocab(ls):
    return encode.label_vocabulary(ls.filter(F.col("dataset") == "train"), "BUSINFOUNIT_ID")


@query("label_encode", with_views(LINE_OBS) + """
SELECT value, CAST(row_number() OVER (ORDER BY value) - 1 AS INTEGER) AS code
FROM (SELECT DISTINCT BUSINFOUNIT_ID AS value FROM lobs WHERE BUSINFOUNIT_ID IS NOT NULL)""")
def q_label_encode(spark, sf_dir):
    """F16: sorted distinct segment ids -> 0..n-1 over all sets."""
    return encode.label_vocabulary(A.line_obs(spark, sf_dir), "BUSINFOUNIT_ID")


@query("label_apply", LINE_SPLIT + """
SELECT ls.*, voc.code FROM ls JOIN voc ON ls.BUSINFOUNIT_ID = voc.value WHERE dataset = 'test'""")
def q_label_apply(spark, sf_dir):
    """test rows whose segment is known to the train vocabulary, coded."""
    ls = _line_split(spark, sf_dir)
    return encode.encode_known(ls.filter(F.col("dataset") == "test"), _train_vocab(ls), "BUSINFOUNIT_ID")


@query("label_unknown", LINE_SPLIT + """
SELECT DISTINCT BUSINFOUNIT_ID AS value FROM ls WHERE dataset = 'test'
  AND BUSINFOUNIT_ID NOT IN (SELECT value FROM voc)""")
def q_label_unknown(spark, sf_dir):
    """segment ids of the test set unknown to the train vocabulary."""
    ls = _line_split(spark, sf_dir)
    return encode.unknown_labels(ls.filter(F.col("dataset") == "test"), _train_vocab(ls), "BUSINFOUNIT_ID")


@query("label_decode_pad", """
WITH v AS (SELECT value, CAST(row_number() OVER (ORDER BY value) - 1 AS INTEGER) AS code
           FROM (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS value FROM lineitem))
SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS part, v.code,
       CASE WHEN length(v.value) >= 9 THEN v.value ELSE lpad(v.value, 9, '0') END AS BUSINFOUNIT_ID
FROM lineitem JOIN v ON CAST(l_partkey AS VARCHAR) = v.value""")
def q_label_decode_pad(spark, sf_dir):
    """F16 -> F18: raw part keys coded, then decoded and zero-padded to 9."""
    parts = A.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("part"))
    vocab = encode.label_vocabulary(parts, "part")
    coded = encode.encode_known(parts, vocab, "part")
    return encode.decode_labels(coded, vocab, "code", "BUSINFOUNIT_ID").distinct()


@query("label_extend", LINE_SPLIT + """
, new AS (SELECT DISTINCT BUSINFOUNIT_ID AS value FROM ls WHERE dataset = 'test'
          AND BUSINFOUNIT_ID NOT IN (SELECT value FROM voc))
SELECT * FROM voc
UNION ALL SELECT value, CAST((SELECT max(code) FROM voc) + row_number() OVER (ORDER BY value) AS INTEGER) FROM new""")
def q_label_extend(spark, sf_dir):
    """train vocabulary extended with unseen test ids after the max code."""
    ls = _line_split(spark, sf_dir)
    return encode.extend_vocabulary(_train_vocab(ls), ls.filter(F.col("dataset") == "test"), "BUSINFOUNIT_ID")


# F20-F23 -------------------------------------------------------------------
@query("composite_key", with_views(HOLDING_OBS) + """
SELECT obs_id, BUSROUTE_ID || '_' || BUSSTOP_ID AS route_stop FROM hobs""")
def q_composite_key(spark, sf_dir):
    """route_stop composite key (null in -> null out)."""
    h = A.holding_obs(spark, sf_dir)
    return h.select("obs_id", composite_key("BUSROUTE_ID", "BUSSTOP_ID").alias("route_stop"))


@query("weights", with_views(TRAVEL_OBS, """
tf AS (SELECT avg(TIME_GAP) AS m, CASE WHEN stddev_pop(TIME_GAP) = 0 THEN 1.0 ELSE stddev_pop(TIME_GAP) END AS sc FROM obs)""") + """
SELECT obs_id, LEN, DATA_TYPE,
  CASE WHEN LEN >= 500 THEN 3.5 ELSE 1.0 END::DOUBLE AS w_travel,
  CASE WHEN LEN >= 100 THEN 3.0 ELSE 1.0 END::DOUBLE AS w_route_feat,
  CASE WHEN LEN >= 500 THEN 3.0 ELSE 1.0 END::DOUBLE AS w_route,
  CASE WHEN LEN >= 1500 THEN 2.0 ELSE 1.0 END::DOUBLE AS w_legacy,
  CASE WHEN DATA_TYPE = 'EVENT' THEN 0.8::DOUBLE WHEN DATA_TYPE = 'PATRN' THEN 0.2::DOUBLE END
    * CASE WHEN LEN >= 500 THEN 3.0 ELSE 1.0 END::DOUBLE AS w_data_type,
  CASE WHEN (TIME_GAP - m) / sc > 0.3 THEN 10.0 ELSE 1.0 END::DOUBLE AS w_target
FROM obs, tf""")
def q_weights(spark, sf_dir):
    """F21 distance weights (4 variants), F22 data-type weight, F23 target weight."""
    obs = _obs(spark, sf_dir)
    fit = encode.fit_standard(obs, ["TIME_GAP"])
    x = encode.apply_standard(obs, fit, ["TIME_GAP"])
    return x.select(
        "obs_id", "LEN", "DATA_TYPE",
        *[features.distance_weight("LEN", v).alias(f"w_{v}") for v in features.DISTANCE_WEIGHTS],
        features.data_type_weight("DATA_TYPE", "LEN", "route").alias("w_data_type"),
        features.target_weight("TIME_GAP_scaled").alias("w_target"))


# F24-F26 -------------------------------------------------------------------
@query("feature_matrix", with_views(TRAVEL_OBS, "small2 AS (SELECT * FROM obs WHERE coalesce(LEN <> 0, true) AND coalesce(TIME_GAP <> 0, true))", SPLIT_SQL, STD_FIT) + f"""
SELECT obs_id, dataset, {H} AS dep_hour, {P.minute('DEP_TIME')} AS dep_minute,
  (LEN - mean_LEN) / sc_LEN AS LEN_scaled,
  sin({TWO_PI}::DOUBLE * {H} / 24.0::DOUBLE) AS dep_time_sin,
  cos({TWO_PI}::DOUBLE * {H} / 24.0::DOUBLE) AS dep_time_cos,
  ln(1 + CAST(LEN AS DOUBLE)) AS log_len, {P.tod_class(H)} AS time_of_day,
  CAST(({H} >= 7 AND {H} < 10) OR ({H} >= 18 AND {H} < 20) AS INTEGER) AS peak_hours,
  CASE WHEN LEN < 500 THEN 0 WHEN LEN < 1500 THEN 1 WHEN LEN >= 1500 THEN 2 ELSE 0 END AS distance_type,
  {P.md5_mod('BUSINFOUNIT_ID', 20000)} AS unit_hash
FROM s, fit2""")
def q_feature_matrix(spark, sf_dir):
    """the ordered 9-column travel feature set plus the hashed segment id
    (LEN scaler fit on the train split)."""
    obs = clean.zero_filter(_obs(spark, sf_dir), ["LEN", "TIME_GAP"])
    s = files.stage_table(splits.random_split(obs), "feature_split")
    fit = encode.fit_standard(s.filter(F.col("dataset") == "train"), ["LEN"])
    x = featuresets.travel_features(encode.apply_standard(s, fit, ["LEN"]))
    return x.select("obs_id", "dataset", *featuresets.TRAVEL_FEATURES, "unit_hash")


@query("token_hash")
def q_token_hash(spark, sf_dir):
    """part names tokenised and hashed to 4 term-frequency features
    (Spark's HashingTF hash: not value-equal to the source's; rows-only)."""
    part = A.table(spark, sf_dir, "part").select("p_partkey", "p_name")
    tok = Tokenizer(inputCol="p_name", outputCol="_tok").transform(part)
    tf = HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=4).transform(tok)
    return tf.select("p_partkey", vector_to_array("_tf").alias("token_features"))


_MUL = "CAST(({a})::HUGEINT * {c} % 4294967296 AS BIGINT)"
_ROT = "((({a}) << {n}) % 4294967296 | (({a}) >> {m}))"


def _scramble_sql(k: str) -> str:
    t = _MUL.format(a=k, c=0xCC9E2D51)
    return _MUL.format(a=_ROT.format(a=t, n=15, m=17), c=0x1B873593)


# 32-bit MurmurHash3 (public algorithm) of every word, block by block.
TOKEN_SQL = f"""
w AS (SELECT p_partkey, unnest(regexp_extract_all(lower(p_name), '\\b\\w\\w+\\b')) AS t FROM part),
b AS (SELECT DISTINCT t, strlen(t) AS n, list_transform(range(strlen(t)), lambda i: CAST(ascii(t[i + 1]) AS BIGINT)) AS c FROM w),
k AS (SELECT t, n, list_transform(range(n // 4 + 1), lambda j: list_sum(list_transform(range(4),
        lambda i: coalesce(c[4 * j + i + 1], 0) * CAST(256 ** i AS BIGINT)))::BIGINT) AS words FROM b),
s AS (SELECT t, n, list_transform(words, lambda k: {_scramble_sql('k')}) AS mixed FROM k),
r AS (SELECT t, n, mixed[-1] AS last, list_reduce(list_prepend(0::BIGINT, mixed[:-2]),
        lambda h, x: ({_ROT.format(a='xor(h, x)', n=13, m=19)} * 5 + 3864292196) % 4294967296) AS h FROM s),
f1 AS (SELECT t, xor(xor(h, last), n) AS h FROM r),
f2 AS (SELECT t, {_MUL.format(a='xor(h, h >> 16)', c=0x85EBCA6B)} AS h FROM f1),
f3 AS (SELECT t, {_MUL.format(a='xor(h, h >> 13)', c=0xC2B2AE35)} AS h FROM f2),
f4 AS (SELECT t, xor(h, h >> 16) AS h FROM f3),
p AS (SELECT t, abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % 4 AS place FROM f4),
n AS (SELECT p_partkey, count(*) FILTER (WHERE place = 0) AS c0, count(*) FILTER (WHERE place = 1) AS c1,
             count(*) FILTER (WHERE place = 2) AS c2, count(*) FILTER (WHERE place = 3) AS c3
      FROM w JOIN p USING (t) GROUP BY 1)"""


@query("token_features", "WITH " + TOKEN_SQL.strip() + """
SELECT part.p_partkey, coalesce(c0 / sqrt(c0 * c0 + c1 * c1 + c2 * c2 + c3 * c3), 0.0)::DOUBLE AS h0,
       coalesce(c1 / sqrt(c0 * c0 + c1 * c1 + c2 * c2 + c3 * c3), 0.0)::DOUBLE AS h1,
       coalesce(c2 / sqrt(c0 * c0 + c1 * c1 + c2 * c2 + c3 * c3), 0.0)::DOUBLE AS h2,
       coalesce(c3 / sqrt(c0 * c0 + c1 * c1 + c2 * c2 + c3 * c3), 0.0)::DOUBLE AS h3
FROM part LEFT JOIN n USING (p_partkey)""")
def q_token_features(spark, sf_dir):
    """part names hashed to 4 features by the source's token hash, scaled to length 1."""
    x = A.table(spark, sf_dir, "part").select("p_partkey", hashed_tokens(F.col("p_name"), 4).alias("_f"))
    return x.select("p_partkey", *[F.col("_f")[i].alias(f"h{i}") for i in range(4)])


@query("clip_zero", with_views(TRAVEL_OBS, "m AS (SELECT avg(TIME_GAP) AS mu FROM obs)") + """
SELECT obs_id, TIME_GAP - mu AS centred, greatest(TIME_GAP - mu, 0.0) AS clipped FROM obs, m""")
def q_clip_zero(spark, sf_dir):
    """negative values (here centred TIME_GAP) clipped to 0."""
    obs = _obs(spark, sf_dir)
    mu = obs.agg(F.avg("TIME_GAP").alias("mu"))
    x = attach_scalars(obs, mu).withColumn("centred", F.col("TIME_GAP") - F.col("mu"))
    return x.select("obs_id", "centred", features.clip_zero("centred").alias("clipped"))


@query("holding_features", with_views(HOLDING_OBS) + f"""
SELECT obs_id, {H} AS dep_hour, {P.minute('DEP_TIME')} AS dep_minute,
  sin({TWO_PI}::DOUBLE * {H} / 24.0::DOUBLE) AS dep_time_sin,
  cos({TWO_PI}::DOUBLE * {H} / 24.0::DOUBLE) AS dep_time_cos, {P.tod_class(H)} AS time_of_day,
  CAST(({H} >= 7 AND {H} < 10) OR ({H} >= 17 AND {H} < 20) AS INTEGER) AS peak_hours,
  {P.md5_mod('BUSROUTE_ID', 1452)} AS route_hash, {P.md5_mod('BUSSTOP_ID', 13693)} AS stop_hash
FROM hobs""")
def q_holding_features(spark, sf_dir):
    """F24 holding set: 6 time features (evening peak from 17h) and the
    route / stop md5 buckets with the stored best sizes (1452, 13693)."""
    x = featuresets.holding_features(A.holding_obs(spark, sf_dir))
    return x.select("obs_id", *featuresets.HOLDING_FEATURES, "route_hash", "stop_hash")
