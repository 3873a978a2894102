"""Invariants: split sizes and determinism, exact positions, chunked
sequences, audit reconciliation, densify coverage."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_ORACLE, SF_SMALL
from tripframe.functions.hashing import seeded_hash
from tripframe.operators import clean, densify, outliers, positions, sequence, splits
from tripframe.sources import adapters as A


def test_position_equals_global_row_number(spark):
    ev = A.table(spark, SF_ORACLE, "events").select("event_id", "value")
    h = ev.withColumn("_h", seeded_hash("event_id"))
    ours = positions.position(h, [], ["_h", "event_id"])
    ref = h.withColumn("_ref", F.row_number().over(Window.orderBy("_h", "event_id")) - 1)
    j = ours.join(ref.select("event_id", "_ref"), "event_id")
    assert j.filter(F.col("_pos") != F.col("_ref")).count() == 0
    assert j.count() == ev.count()


def test_random_split_sizes_and_determinism(spark):
    obs = A.travel_obs(spark, SF_ORACLE).select("obs_id", "TIME_GAP")
    n = obs.count()
    a = splits.random_split(obs.repartition(3))
    b = splits.random_split(obs.repartition(11))
    c = {r.dataset: r["count"] for r in a.groupBy("dataset").count().collect()}
    assert c["train"] == int(0.7 * n) and c["validation"] == int(0.15 * n)
    assert sum(c.values()) == n
    diff = a.join(b.withColumnRenamed("dataset", "d2"), "obs_id").filter("dataset <> d2").count()
    assert diff == 0


def test_stratified_fallback_fills_validation(spark):
    raw = clean.parse_two_formats(A.raw_events(spark, SF_SMALL))
    out = splits.stratified_split_fallback(raw, ["DAY_TYPE", "BUSROUTE_ID", "LOCATION_ID"])
    c = {r.dataset: r["count"] for r in out.groupBy("dataset").count().collect()}
    assert c.get("validation", 0) > 0 and c.get("test", 0) > 0 and "" not in c
    assert sum(c.values()) == raw.count()


def test_chunked_sequences_match_plain_window(spark):
    obs = A.travel_obs(spark, SF_ORACLE).select("obs_id", "BUSROUTE_ID", "DEP_TIME", "TIME_GAP")
    ours = sequence.sliding_sequences(obs, ["BUSROUTE_ID"], ["DEP_TIME"], ["TIME_GAP"],
                                      length=5, chunk=37)
    w = (Window.partitionBy("BUSROUTE_ID").orderBy("DEP_TIME", "obs_id").rowsBetween(-5, -1))
    ref = (obs.withColumn("ref", F.collect_list("TIME_GAP").over(w))
              .filter(F.size("ref") == 5).select("obs_id", "ref"))
    j = ours.select("obs_id", F.transform("seq", lambda s: s["TIME_GAP"]).alias("got")).join(
        ref, "obs_id", "full")
    assert j.filter(F.col("got").isNull() | F.col("ref").isNull() | (F.col("got") != F.col("ref"))).count() == 0
    assert j.count() == ref.count()


def test_quality_audit_reconciles(spark):
    obs = A.travel_obs(spark, SF_ORACLE)
    audit = {r.rule: r.removed for r in clean.travel_quality_audit(obs).collect()}
    assert sum(audit.values()) == obs.count()
    assert audit["kept"] == clean.travel_quality(obs).count()


def test_iqr_sets_disjoint(spark):
    lo = A.line_obs(spark, SF_SMALL)
    s = outliers.iqr_split(lo, ["TIME_GAP", "LEN"])
    c = {r.iqr_set: r["count"] for r in s.groupBy("iqr_set").count().collect()}
    assert c.get("kept", 0) + c.get("outlier", 0) == lo.count()


def test_densify_covers_grid(spark):
    obs = A.travel_obs(spark, SF_SMALL).withColumnRenamed("SPEED", "speed_kmh")
    out = densify.fill_minutes(obs, ["BUSINFOUNIT_ID"], ["DAY_TYPE", "LEN"],
                               {"TIME_GAP": -1, "speed_kmh": 0})
    ids = obs.select("BUSINFOUNIT_ID").distinct().count()
    pairs = out.select("BUSINFOUNIT_ID", "DEP_TIME").distinct().count()
    assert pairs == ids * 363
    assert densify.minute_grid(spark).count() == 363


def test_banded_sample_bounded(spark):
    obs = A.travel_obs(spark, SF_ORACLE)
    band = F.when(F.col("TIME_GAP") < 120, "a").otherwise("b")
    s = splits.banded_sample(obs, band, 20)
    assert all(r["count"] <= 20 for r in s.groupBy("band").count().collect())


def test_sequences_hot_segment_small_blocks(spark):
    """One segment holds every row; tiny chunks force many chunk borders, and
    the result still equals a plain window."""
    obs = A.travel_obs(spark, SF_SMALL).select("obs_id", "DEP_TIME", "TIME_GAP") \
        .withColumn("seg", F.lit("hot"))
    ours = sequence.sliding_sequences(obs, ["seg"], ["DEP_TIME"], ["TIME_GAP"], length=5,
                                      chunk=11)
    w = Window.partitionBy("seg").orderBy("DEP_TIME", "obs_id").rowsBetween(-5, -1)
    ref = (obs.withColumn("ref", F.collect_list("TIME_GAP").over(w))
              .filter(F.size("ref") == 5).select("obs_id", "ref"))
    got = ours.select("obs_id", F.transform("seq", lambda s: s["TIME_GAP"]).alias("got"))
    j = got.join(ref, "obs_id", "full")
    assert j.filter(F.col("got").isNull() | F.col("ref").isNull() | (F.col("got") != F.col("ref"))).count() == 0
    assert j.count() == obs.count() - 5


def test_group_sigma_hot_group(spark):
    """A group holding a third of the rows gives the same result as a
    per-group window computation."""
    from tripframe.operators import outliers
    obs = A.travel_obs(spark, SF_SMALL).select("obs_id", "BUSINFOUNIT_ID", "TIME_GAP") \
        .withColumn("g", F.when(F.col("obs_id") % 3 == 0, F.lit("hot")).otherwise(F.col("BUSINFOUNIT_ID")))
    ours = outliers.group_sigma_filter(obs, ["g"], "TIME_GAP", 2.0)
    w = Window.partitionBy("g")
    m, s = F.avg("TIME_GAP").over(w), F.stddev_samp("TIME_GAP").over(w)
    ref = obs.filter(F.col("TIME_GAP").isNotNull()).withColumn("_m", m).withColumn("_s", s) \
        .filter((F.col("TIME_GAP") >= F.col("_m") - 2 * F.col("_s"))
                & (F.col("TIME_GAP") <= F.col("_m") + 2 * F.col("_s")))
    assert sorted(r.obs_id for r in ours.collect()) == sorted(r.obs_id for r in ref.collect())


def test_kfold_and_splits_equal_plain_windows(spark):
    """k-fold and stratified labels are those of a plain window per stratum."""
    obs = A.travel_obs(spark, SF_SMALL).select("obs_id", "BUSROUTE_ID", "DAY_TYPE")
    w = Window.partitionBy("BUSROUTE_ID").orderBy("_h", "obs_id")
    ref = obs.withColumn("_h", seeded_hash("obs_id", 42)).withColumn("f", (F.row_number().over(w) - 1) % 5)
    got = {r.obs_id: r.fold for r in splits.kfold(obs, ["BUSROUTE_ID"]).collect()}
    assert got == {r.obs_id: r.f for r in ref.collect()}
    s = splits.stratified_split(obs, ["BUSROUTE_ID", "DAY_TYPE"])
    sizes = {(r[0], r[1]): r[2] for r in obs.groupBy("BUSROUTE_ID", "DAY_TYPE").count().collect()}
    for r in s.filter("dataset = 'train'").groupBy("BUSROUTE_ID", "DAY_TYPE").count().collect():
        assert r[2] == int(0.7 * sizes[r[0], r[1]])


def test_positions_spread_a_group_of_all_rows(spark):
    """One group of all rows, hashed ids and one order value: ranges stay even
    and no window partition holds more than its range."""
    from tripframe.operators import positions
    df = spark.range(8000).selectExpr("xxhash64(id) as id", "1 as g", "7 as o")
    pos = positions.position(df, ["g"], ["o", "id"], parts=16)
    assert sorted(r._pos for r in pos.select("_pos").collect()) == list(range(8000))
    ranged = df.repartitionByRange(16, "g", "o", "id").groupBy(F.spark_partition_id().alias("p")).count()
    assert ranged.agg(F.max("count")).first()[0] < 8000 / 16 * 2


def test_largest_remainder_allocation(spark):
    """D5 allocation: totals hold out exactly ceil(test * N) rows and each
    key gets floor or ceil of its proportional share."""
    import math
    from tripframe.operators.splits import _largest_remainder
    obs = A.travel_obs(spark, SF_SMALL).select("obs_id", "BUSINFOUNIT_ID")
    sizes = {r.BUSINFOUNIT_ID: r["count"] for r in obs.groupBy("BUSINFOUNIT_ID").count().collect()}
    n = sum(sizes.values())
    n_train = n - math.ceil(0.3 * n)
    counts = obs.groupBy("BUSINFOUNIT_ID").agg(F.count(F.lit(1)).alias("_c"))
    alloc = {r.BUSINFOUNIT_ID: r._ni
             for r in _largest_remainder(counts, ["BUSINFOUNIT_ID"], 0.3, 42).collect()}
    assert sum(alloc.values()) == n_train
    for k, c in sizes.items():
        share = c / n * n_train
        assert math.floor(share) <= alloc[k] <= math.floor(share) + 1
