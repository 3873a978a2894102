"""The command line runs the source project's stages on CSV folders."""

import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from tripframe import cli
from tripframe.operators import clean
from tripframe.sources import adapters as A


def _csv_input(spark):
    d = tempfile.mkdtemp(prefix="tf-cli-in-")
    obs = A.travel_obs(spark, SF_SMALL).orderBy("obs_id").drop("obs_id").coalesce(1)
    obs.write.mode("overwrite").option("header", True).csv(d)
    return d


def test_clean_travel_cli_matches_library(spark):
    src = _csv_input(spark)
    out = tempfile.mkdtemp(prefix="tf-cli-out-")
    assert cli.main(["clean-travel", "--input", src, "--output", os.path.join(out, "c"),
                     "--audit", os.path.join(out, "a")]) == 0
    got = spark.read.parquet(os.path.join(out, "c"))
    want = clean.travel_quality(A.travel_obs(spark, SF_SMALL))
    cols = [c for c in want.columns if c != "obs_id"]
    assert got.select(cols).exceptAll(want.select(cols)).count() == 0
    assert want.select(cols).exceptAll(got.select(cols)).count() == 0
    audit = spark.read.parquet(os.path.join(out, "a"))
    assert audit.agg(F.sum("removed")).first()[0] == A.travel_obs(spark, SF_SMALL).count()


def test_split_and_densify_cli(spark):
    src = _csv_input(spark)
    out = tempfile.mkdtemp(prefix="tf-cli-out-")
    assert cli.main(["split", "--input", src, "--output", os.path.join(out, "s")]) == 0
    s = spark.read.parquet(os.path.join(out, "s"))
    assert s.count() == A.travel_obs(spark, SF_SMALL).count()
    assert s.select("obs_id").distinct().count() == s.count()
    assert cli.main(["densify", "--input", src, "--output", os.path.join(out, "d")]) == 0
    d = spark.read.parquet(os.path.join(out, "d"))
    ids = A.travel_obs(spark, SF_SMALL).select("BUSINFOUNIT_ID").distinct().count()
    assert d.select("BUSINFOUNIT_ID", "DEP_TIME").distinct().count() == ids * 363


def test_other_stages_run(spark):
    out = tempfile.mkdtemp(prefix="tf-cli-out-")
    src = _csv_input(spark)
    hold = tempfile.mkdtemp(prefix="tf-cli-hold-")
    A.holding_obs(spark, SF_SMALL).drop("obs_id").coalesce(1).write.mode("overwrite") \
        .option("header", True).csv(hold)
    cmp_dir = tempfile.mkdtemp(prefix="tf-cli-cmp-")
    A.comparison(spark, SF_SMALL).drop("obs_id").coalesce(1).write.mode("overwrite") \
        .option("header", True).csv(cmp_dir)
    runs = [
        (["clean-holding", "--input", hold], "h"),
        (["outliers", "--input", src, "--columns", "TIME_GAP,LEN"], "o"),
        (["profile", "--input", src], "p"),
        (["compare", "--input", cmp_dir], "c"),
        (["split", "--input", src, "--mode", "stratified", "--keys", "DAY_TYPE,BUSROUTE_ID"], "s"),
    ]
    for args, name in runs:
        assert cli.main(args + ["--output", os.path.join(out, name)]) == 0
    n = A.holding_obs(spark, SF_SMALL).filter("TIME_GAP > 0 AND TIME_GAP <= 120").count()
    assert 0 < spark.read.parquet(os.path.join(out, "h")).count() <= n
    assert spark.read.parquet(os.path.join(out, "o")).count() > 0
    assert spark.read.parquet(os.path.join(out, "p", "describe")).count() == 1
    assert spark.read.parquet(os.path.join(out, "c", "travel_bins")).count() > 0
    s = spark.read.parquet(os.path.join(out, "s"))
    assert s.count() == A.travel_obs(spark, SF_SMALL).count()
