"""Edge fixtures (FIXTURES.md, 'edge fixtures of ours')."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from tripframe.functions import clock, features
from tripframe.operators import clean, densify, encode, evaluate, outliers, splits
from tripframe.plans import load_all
from tripframe.sources import adapters


def test_null_stratum_key_stays_unassigned(spark):
    df = spark.createDataFrame([(i, "a" if i % 2 else None) for i in range(10)], "obs_id long, k string")
    out = {r.obs_id: r.dataset for r in splits.stratified_split(df, ["k"]).collect()}
    assert all(out[i] == "" for i in range(0, 10, 2))
    assert all(out[i] in ("train", "validation", "test") for i in range(1, 10, 2))


def test_one_row_group_dropped_by_sigma_filter(spark):
    df = spark.createDataFrame([(1, "solo", 10), (2, "g", 10), (3, "g", 12), (4, "g", 11)],
                               "obs_id long, g string, TIME_GAP int")
    kept = sorted(r.obs_id for r in outliers.group_sigma_filter(df, ["g"]).collect())
    assert kept == [2, 3, 4]


def test_constant_group_minmax_is_zero(spark):
    df = spark.createDataFrame([(1, "c", 500), (2, "c", 500), (3, "v", 100), (4, "v", 300)],
                               "obs_id long, g string, LEN int")
    got = {r.obs_id: r.LEN_mm for r in encode.minmax_by_group(df, ["LEN"], ["g"]).collect()}
    assert got == {1: 0.0, 2: 0.0, 3: 0.0, 4: 1.0}


def test_empty_middle_bin_kept(spark):
    comp = spark.createDataFrame([(1, 30.0, 2.0, 4.0), (2, 150.0, 6.0, 8.0)],
                                 "obs_id long, E double, A double, B double")
    rows = {r.bin: (r.ai_mean, r.bis_mean, r["count"], r.label)
            for r in evaluate.incumbent_bins(comp, "E", "A", "B").collect()}
    assert rows[1] == (0, 0, 0, "1-2분")
    assert rows[0][2] == 1 and rows[2][2] == 1


def test_incumbent_mean_zero_gives_zero_improvement(spark):
    comp = spark.createDataFrame([(1, 30.0, 2.0, 0.0)], "obs_id long, E double, A double, B double")
    assert evaluate.improvement(comp, "E", "A", "B").first().improvement_pct == 0.0


def test_two_date_formats_and_invalid(spark):
    df = spark.createDataFrame([(1, "2024-09-01 07:05:09", "2024-09-01"),
                                (2, "2024-09-01", "2024-09-01 08:00:00"),
                                (3, "not a date", "2024-09-01")],
                               "obs_id long, ARR_DATE string, DEP_DATE string")
    out = {r.obs_id: r.DEP_TIME for r in clean.parse_two_formats(df).collect()}
    assert out == {1: "00:00:00", 2: "08:00:00"}


def test_slot_boundaries(spark):
    df = spark.createDataFrame([(t,) for t in ["06:59", "07:00", "09:00", "09:01", "13:00", "20:00", "20:01"]],
                               "DEP_TIME string")
    kept = [r.DEP_TIME for r in df.filter(clock.in_slots("DEP_TIME")).collect()]
    assert kept == ["07:00", "09:00", "13:00", "20:00"]


def test_report_rounding_matches_numpy(spark):
    df = spark.createDataFrame([(1, 40, 63.05), (2, 40, 62.95), (3, 0, 5.0)],
                               "obs_id long, TIME_GAP int, prediction double")
    rep = {r.obs_id: (r.TIME_GAP_ESTIMATE, r.ERROR, r.ERROR_RATE)
           for r in evaluate.prediction_report(df).collect()}
    import numpy as np
    for k, tg, p in [(1, 40, 63.05), (2, 40, 62.95)]:
        est = int(np.round(p, 1))
        assert rep[k][0] == est and rep[k][1] == abs(est - tg)
        assert rep[k][2] == float(np.round(abs(est - tg) / tg, 2))
    assert rep[3][2] is None  # division by zero -> null, not an error


def test_null_target_in_metrics(spark):
    df = spark.createDataFrame([(1, 10, 12.0), (2, None, 5.0), (3, 20, 17.0)],
                               "obs_id long, TIME_GAP int, prediction double")
    m = evaluate.metrics(df).first()
    assert m.n == 2 and abs(m.mae - 2.5) < 1e-12


def test_tune_picks_lowest_validation_rmse(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    from pyspark.ml.tuning import ParamGridBuilder

    from tripframe.operators import model
    rows = [(float(x), 2.0 * x + 1.0) for x in range(40)]
    df = spark.createDataFrame(rows, "x double, TIME_GAP double")
    lr = LinearRegression(featuresCol="f", labelCol="TIME_GAP")
    pipe = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="f"), lr])
    grid = ParamGridBuilder().addGrid(lr.regParam, [1000.0, 0.0]).build()
    best, scores = model.tune(pipe, grid, df.filter("x < 30"), df.filter("x >= 30"))
    assert best.stages[-1].getRegParam() == 0.0
    assert len(scores) == 2 and min(r for _, r in scores) < 1e-6


def test_malformed_clock_is_null(spark):
    df = spark.createDataFrame([("07:30:15",), ("ab:cd",), ("7:5",), (None,), ("07:30:x",)], "t string")
    got = [tuple(r) for r in df.select(*clock.split_hms("t")).collect()]
    assert got == [(7, 30, 15), (None, None, 0), (7, 5, 0), (None, None, 0), (7, 30, None)]


def test_date_split_keeps_a_day_together(spark):
    rows = [(i, f"2024-01-{i % 20 + 1:02d} {i % 24:02d}:00:00") for i in range(400)] + [(999, "n/a"), (998, None)]
    got = splits.date_split(spark.createDataFrame(rows, "obs_id long, COLLECT_DATE string")).collect()
    days = {}
    for r in got:
        days.setdefault(r.COLLECT_DATE[:10], set()).add(r.dataset)
    assert len(got) == 400 and len(days) == 20 and all(len(s) == 1 for s in days.values())


def test_outliers_are_distinct(spark):
    rows = [(float(i % 10), "a") for i in range(100)] + [(1e6, "b")] * 3
    df = spark.createDataFrame(rows, "v double, k string")
    assert outliers.iqr_split(df, ["v"]).filter("iqr_set = 'outlier'").count() == 1
    assert outliers.iqr_stats(df, ["v"]).first().outliers == 1


def test_null_flags_are_zero(spark):
    df = spark.createDataFrame([(None,)], "x int")
    r = df.select(clock.weekend_flag(F.col("x")), clock.peak_flag(F.col("x")), *features.onehot("x", [1, 2])).first()
    assert tuple(r) == (0, 0, 0.0, 0.0)


def test_stream_reads_file_and_folder(spark, tmp_path):
    from tripframe.streaming import live
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    ev.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    for i, d in enumerate((SF_SMALL, str(tmp_path))):
        out, ck = str(tmp_path / f"out{i}"), str(tmp_path / f"ck{i}")
        live.run_to_parquet(live.events_stream(spark, d), out, ck)
        assert spark.read.parquet(out).count() == ev.count()


def test_checked_branches_are_not_empty(spark):
    """Inputs of the dedup and outlier queries have duplicates and both tails."""
    x = adapters.line_coarse(spark, SF_SMALL)
    assert x.distinct().count() < x.count()
    q = {n: load_all()[0][n] for n in ("duplicates", "iqr_split", "clamp_outliers")}
    assert q["duplicates"](spark, SF_SMALL).count() > 0
    out = q["iqr_split"](spark, SF_SMALL).filter("iqr_set = 'outlier'")
    assert out.filter("TIME_GAP > 1000").count() and out.filter("TIME_GAP < 100").count()
    got = q["clamp_outliers"](spark, SF_SMALL).agg(F.max("TIME_GAP"), F.min("TIME_GAP")).first()
    assert got[0] < 4000 and got[1] > 10


def test_csv_columns_by_name(spark, tmp_path):
    """Reordered, extra, absent and malformed columns; files that differ."""
    import pytest
    from pyspark.sql import types as T
    from tripframe.sources import files
    want = T.StructType([T.StructField("ID", T.StringType()), T.StructField("LEN", T.IntegerType()),
                         T.StructField("DAY", T.StringType())])
    for name, text in (("a", "LEN,JUNK, ID,DAY\n5,x,000010004,d1\nzz,y,7,\n"), ("b", "ID,LEN\n000000001,9\n")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "f.CSV").write_text(text)
    paths = [str(tmp_path / n) for n in "ab"]
    got = files.read_typed_csv(spark, paths, want, glob="*.{csv,CSV}", optional=["DAY"]).collect()
    assert sorted(map(tuple, got), key=str) == sorted(
        [("000010004", 5, "d1"), ("7", None, None), ("000000001", 9, None)], key=str)
    with pytest.raises(ValueError):
        files.read_typed_csv(spark, paths[1], want)
    (tmp_path / "a" / "g.csv").write_text("ID,LEN,JUNK,DAY\n1,2,3,4\n")
    with pytest.raises(Exception):
        files.read_typed_csv(spark, paths[0], want).collect()


def test_layouts_by_length_equal_trying_them_all(spark):
    texts = ["07:05", "7:05", "07:05:09", "24:00", "07:61:00", "2024-09-01 07:05:09", "2024-09-01", "+12024-09-01 07:05:09",
             "+12024-09-01", "2024-09-01 07:05", " 07:05", "", "n/a", "2024-13-01", "2024-09-01T07:05:09", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    day = "yyyy-MM-dd"

    def tried(*layouts):
        return F.coalesce(*[F.try_to_timestamp("t", F.lit(f)) for f in layouts]).cast("string")

    got = df.select(clock.parse_clock("t").cast("string"), tried(*clock.DEP_TIME_FORMATS),
                    clock.two_format_timestamp("t").cast("string"), tried("yyyy-MM-dd HH:mm:ss", day)).collect()
    assert [r[0] for r in got] == [r[1] for r in got] and [r[2] for r in got] == [r[3] for r in got]
    assert sum(r[0] is not None for r in got) == 4


def test_fallback_split_computes_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def dep(i):
        seen.add(1)
        return f"{i % 24:02d}:00:00"

    df = spark.range(60).select(F.col("id").alias("obs_id"), (F.col("id") % 20).alias("k"),
                                dep(F.col("id") % 20).alias("DEP_TIME"))
    got = splits.timegroup_split(df, ["k"], fallback=True).groupBy("dataset").count().collect()
    assert sum(r["count"] for r in got) == 60 and len(got) == 3
    assert seen.value == 60


def test_fill_minutes_shuffles_no_pairs(spark):
    rows = [(1, "a", "07:00", 5, 2), (2, "a", "07:00:30", 6, 3), (3, "a", "12:00", 7, 4), (4, None, "07:02", 8, 5),
            (5, None, None, 9, 6), (0, "b", "23:00", 1, 7)]
    df = spark.createDataFrame(rows, "obs_id long, k string, DEP_TIME string, TIME_GAP int, D int")
    slots = (("07:00", "07:02"), ("07:02", "07:03"))
    got = densify.fill_minutes(df, ["k"], ["D"], {"TIME_GAP": -1}, slots=slots)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    grid = ["07:00", "07:01", "07:02", "07:03"]
    want = [("a", 2, "07:00", 5), ("a", 3, "07:00:30", 6), (None, 5, "07:02", 8)]
    want += [("a", 2, m, -1) for m in grid[1:]] + [(None, 5, m, -1) for m in grid if m != "07:02"] + [("b", 7, m, -1) for m in grid]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
