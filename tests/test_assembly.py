"""Feature sets, sequences of steps, the serving bundle, folder concatenation."""

import json
import os

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import SF_SMALL
from tripframe import cli
from tripframe.functions.featuresets import FEATURE_SETS
from tripframe.operators import assembly, bundle, clean, encode, profile, splits
from tripframe.sources import adapters as A
from tripframe.sources import concat, files


@pytest.mark.parametrize("name,n", [("travel", 9), ("route_feat", 26), ("route", 20), ("boost", 11), ("steps", 13)])
def test_widths_and_empty_tables(spark, name, n):
    fs = FEATURE_SETS[name]
    assert len(fs.columns) == len(set(fs.columns)) == n
    none = A.travel_obs(spark, SF_SMALL).filter("false").withColumn("dataset", F.lit("train"))
    assert set(fs.columns) <= set(assembly.flat(none, fs).columns)
    assert assembly.flat(none, fs).count() == 0


def test_scaler_scopes(spark):
    rows = [(i, "r", "u", 100 * (i + 1), "08:00", "train" if i < 3 else "test") for i in range(5)]
    df = spark.createDataFrame(rows, "obs_id long, BUSROUTE_ID string, BUSINFOUNIT_ID string, LEN int, DEP_TIME string, "
                               "dataset string").withColumn("DAY_TYPE", F.lit(1)).withColumn("SPEED", F.lit(9))
    got = {n: {r.obs_id: r[c] for r in assembly.flat(df, FEATURE_SETS[n]).collect()}
           for n, c in (("travel", "LEN_scaled"), ("route", "LEN_scaled"), ("boost", "LEN_mm"), ("steps", "LEN_mm"))}
    sd = np.std([100, 200, 300])
    assert got["travel"] == pytest.approx({i: (100 * (i + 1) - 200) / sd for i in range(5)})      # train's fit everywhere
    assert [got["route"][i] for i in (3, 4)] == pytest.approx([-1, 1])                            # each set's own
    assert got["boost"] == pytest.approx({i: i / 2 for i in range(5)})                            # leaves [0, 1]
    assert got["steps"] == pytest.approx({i: i / 4 for i in range(5)})                            # the whole group


def test_step_sequences_are_the_five_rows_before(spark):
    rows = [(i, "r", "u", 100 + 10 * i, f"08:{i:02d}", 2) for i in range(8)] + [(90, "r", "v", 5, "07:00", 3)]
    df = spark.createDataFrame(rows, "obs_id long, BUSROUTE_ID string, BUSINFOUNIT_ID string, LEN int, DEP_TIME string, "
                               "DAY_TYPE int")
    got = {r.obs_id: r.seq for r in assembly.step_sequences(df, FEATURE_SETS["steps"]).collect()}
    assert sorted(got) == [5, 6, 7]
    at = FEATURE_SETS["steps"].columns.index
    for i, seq in got.items():
        assert [len(s) for s in seq] == [13] * 5
        assert [s[at("dep_minute")] for s in seq] == [float(j) for j in range(i - 5, i)]
        assert [s[at("LEN_mm")] for s in seq] == pytest.approx([j / 7 for j in range(i - 5, i)])


@pytest.fixture(scope="module")
def saved(spark, tmp_path_factory):
    """A bundle of all nine travel inputs, its training rows and its path."""
    obs = clean.zero_filter(A.travel_obs(spark, SF_SMALL), ["LEN", "TIME_GAP"])
    s = files.stage_table(splits.random_split(obs), "bundle_test")
    train, fs = s.filter("dataset = 'train'"), FEATURE_SETS["travel"]
    inputs, target = assembly.fit_scaler(s, fs), encode.fit_standard(train, ["TIME_GAP"])
    x = encode.apply_standard(assembly.flat(train, fs, inputs), target, ["TIME_GAP"])
    pipe = Pipeline(stages=[VectorAssembler(inputCols=list(fs.columns), outputCol="features"),
                            LinearRegression(labelCol="TIME_GAP_scaled", regParam=0.1)])
    schema = s.select("BUSINFOUNIT_ID", "LEN", "DEP_TIME").schema
    b = bundle.Bundle("travel", "TIME_GAP", schema, pipe.fit(x), inputs, target,
                      encode.label_vocabulary(train, "BUSINFOUNIT_ID"), "BUSINFOUNIT_ID")
    path = str(tmp_path_factory.mktemp("bundle") / "b")
    bundle.save(b, path)
    return s, b, path


def test_bundle_scores_as_the_parts_in_memory(spark, saved):
    s, b, path = saved
    rows = s.filter("dataset = 'test'").drop("TIME_GAP", "dataset")
    got = {r.obs_id: r for r in bundle.load(spark, path).score(rows).collect()}
    x = assembly.flat(rows, FEATURE_SETS["travel"], b.input_scaler)
    t = b.target_scaler.first()
    want = {r.obs_id: r.prediction * t["scale_TIME_GAP"] + t["mean_TIME_GAP"] for r in b.model.transform(x).collect()}
    known = {r.value for r in b.vocabulary.collect()}
    ids = {r.obs_id for r in rows.collect() if r.BUSINFOUNIT_ID in known}
    assert set(got) == ids
    for i in ids:
        assert got[i].prediction == pytest.approx(want[i], rel=1e-9)
        assert got[i].TIME_GAP_ESTIMATE == int(np.rint(got[i].prediction))


def test_bundle_leaves_unknown_ids_out(spark, saved):
    s, _, path = saved
    row = s.limit(1).withColumn("BUSINFOUNIT_ID", F.lit("never seen"))
    assert bundle.load(spark, path).score(row).count() == 0


def test_bundle_refuses_other_schemas(spark, saved):
    s, _, path = saved
    b = bundle.load(spark, path)
    with pytest.raises(bundle.SchemaMismatch, match="LEN: int wanted, bigint"):
        b.score(s.withColumn("LEN", F.col("LEN").cast("long")))
    with pytest.raises(bundle.SchemaMismatch, match="DEP_TIME: string wanted, absent"):
        b.score(s.drop("DEP_TIME"))
    b.score(s.withColumn("more", F.lit(1)))                       # other columns don't matter


def test_bundle_refuses_other_versions(spark, saved, tmp_path):
    _, _, path = saved
    line = files.read_json(spark, f"{path}/manifest").first().asDict()
    for change, text in (({"version": "99"}, "version 99"), ({"inputs": json.dumps(["a"])}, "inputs of feature set")):
        changed = spark.createDataFrame([line | change])
        files.write_json(changed, str(tmp_path / "m" / "manifest"))
        with pytest.raises(ValueError, match=text):
            bundle.load(spark, str(tmp_path / "m"))


CSV = T.StructType([T.StructField("BUSROUTE_ID", T.StringType()), T.StructField("BUSINFOUNIT_ID", T.StringType()),
                    T.StructField("DEP_TIME", T.StringType()), T.StructField("SPEED", T.DoubleType()),
                    T.StructField("TIME_GAP", T.DoubleType())])


def test_concat_counts_every_step_per_file(spark, tmp_path):
    head = "BUSROUTE_ID,BUSINFOUNIT_ID,DEP_TIME,SPEED,TIME_GAP\n"
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.csv").write_text(head + "2,1,08:00,10.5,30\n2,1,08:00,10.5,30\n1,1,09:00,,30\n1,1,07:00,,\n1,2,07:00,9,\n")
    (src / "b.CSV").write_text(head + "1,1,07:00,11.5,31.9\n2,1,08:00,10.5,30\n")
    (src / "notes.txt").write_text("not a table")
    out = str(tmp_path / "out")
    audit = {r.source_file: r for r in concat.concat(spark, str(src), out, CSV).collect()}
    assert {k: tuple(r)[1:] for k, r in audit.items()} == {"a.csv": (5, 2, 1, 2), "b.CSV": (2, 0, 0, 2)}
    rows = [tuple(r) for r in files.read_typed_csv(spark, out, CSV).collect()]
    assert sorted(rows) == [("1", "1", "07:00", 12.0, 31.0), ("2", "1", "08:00", 10.0, 30.0)]
    marked = concat.read_marked(spark, str(src), CSV, ["SPEED", "TIME_GAP"])
    got = concat.totals(concat.step_audit(marked, ["SPEED", "TIME_GAP"]), ["SPEED", "TIME_GAP"],
                        concat.kept_rows(marked, ["SPEED", "TIME_GAP"])).first()
    assert tuple(got) == (7, 2, 1, 4, 2)


def test_concat_cli(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    A.travel_obs(spark, SF_SMALL).drop("obs_id").write.option("header", True).csv(src)
    assert cli.main(["concat", "--input", src, "--output", os.path.join(out, "c"), "--audit", os.path.join(out, "a")]) == 0
    audit = spark.read.parquet(os.path.join(out, "a")).agg(F.sum("rows_read"), F.sum("rows_kept")).first()
    obs = A.travel_obs(spark, SF_SMALL)
    assert tuple(audit) == (obs.count(), obs.filter("SPEED is not null").count())
    assert spark.read.parquet(os.path.join(out, "c")).count() == obs.drop("obs_id").filter("SPEED is not null").distinct().count()


def test_mixed_description_and_constant_columns(spark):
    df = spark.createDataFrame([(1.0, 7, "b"), (3.0, 7, "a"), (None, 7, "b"), (5.0, 7, None)], "x double, k int, t string")
    got = {r.column: r.asDict() for r in profile.describe_mixed(df, ["x"], ["t"]).collect()}
    assert (got["x"]["count"], got["x"]["mean"], got["x"]["p50"], got["x"]["top"]) == (3, 3.0, 3.0, None)
    assert (got["t"]["count"], got["t"]["unique"], got["t"]["top"], got["t"]["freq"], got["t"]["mean"]) == (3, 2, "b", 2, None)
    corr = {(r.col_a, r.col_b): r.corr for r in profile.corr_matrix(df, ["x", "k"]).collect()}
    assert corr[("x", "x")] == 1.0 and corr[("k", "k")] is None and corr[("x", "k")] is None
