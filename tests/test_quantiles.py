"""Exact quantiles against numpy, and plans without a value map in one task."""

import numpy as np
import pytest

from conftest import SF_SMALL
from tripframe.operators import clean, outliers
from tripframe.operators.quantiles import exact_quantiles, quantile_name

PROBS = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)


@pytest.mark.parametrize("n", [1, 2, 5, 1000])
def test_quantiles_match_numpy(spark, n):
    rng = np.random.default_rng(n)
    a, b = rng.standard_normal(n), rng.integers(0, 4, n).astype(float)
    rows = [(float(x), float(y)) for x, y in zip(a, b)] + [(None, float("nan")), (float("nan"), None)]
    got = exact_quantiles(spark.createDataFrame(rows, "a double, b double"), ["a", "b"], PROBS).first()
    for name, v in (("a", a), ("b", b)):
        want = np.quantile(v, PROBS)
        np.testing.assert_allclose([got[quantile_name(name, p)] for p in PROBS], want, rtol=1e-12, atol=1e-15)


def test_quantiles_of_nothing_and_infinity(spark):
    empty = spark.createDataFrame([(None, 1.0)], "a double, b double")
    got = exact_quantiles(empty, ["a", "b"], (0.5,)).first()
    assert got[quantile_name("a", 0.5)] is None and got[quantile_name("b", 0.5)] == 1.0
    far = spark.createDataFrame([(1.0,), (2.0,), (float("inf"),)], "a double")
    assert exact_quantiles(far, ["a"], (0.5, 1.0)).first()[:] == (2.0, float("inf"))


def test_golden_quartiles_and_fences(spark):
    """1..8 and 100: quartiles 3 and 7 (linear), fences -3 and 13."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 100])], "obs_id long, v int")
    b = outliers.iqr_bounds(df, ["v"]).first()
    assert (b.q1_v, b.q3_v, b.lo_v, b.hi_v) == (3.0, 7.0, -3.0, 13.0)
    got = outliers.iqr_split(df, ["v"]).collect()
    assert [r.v for r in got if r.iqr_set == "outlier"] == [100] and len(got) == 9


def test_outlier_list_goes_on_with_lower_ones(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([-900, -50, 3, 4, 5, 5, 6, 7, 100])], "obs_id long, v int")
    got = [(r.rank, r.v, r.side) for r in sorted(outliers.outlier_list(df, "v").collect(), key=lambda r: r.rank)]
    assert got == [(1, 100, "upper"), (2, -50, "lower"), (3, -900, "lower")]
    assert outliers.outlier_list(df, "v", n=2).count() == 2


def test_zero_gap_is_infinitely_fast(spark):
    df = spark.createDataFrame([(10, 5), (10, 0), (0, 0), (-3, 0), (None, 0)], "LEN int, TIME_GAP int")
    got = [r.s for r in df.select(clean.derived_speed(zero_gap="infinity").alias("s")).collect()]
    assert got == [7.2, float("inf"), None, float("-inf"), None]
    assert [r.s for r in df.select(clean.derived_speed().alias("s")).collect()] == [7.2, None, None, None, None]


def test_no_plan_keeps_all_values_in_one_task(spark):
    from tripframe.plans import load_all
    queries, _ = load_all()
    for name in ("iqr_split", "iqr_stats", "fence_summary", "iqr_topk", "speed_outliers", "clamp_outliers", "describe_num",
                 "impute", "outlier_list", "speed_outlier_list"):
        plan = queries[name](spark, SF_SMALL)._jdf.queryExecution().toString()
        assert "percentile" not in plan and "median" not in plan, name
