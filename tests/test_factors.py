"""Id factors: planted factors are found again; odd rows; one pass over the rows."""

import numpy as np
import pytest

from tripframe.operators import factors


def planted(n_ids=60, per=40, noise=0.1, seed=3):
    rng = np.random.default_rng(seed)
    a, v = np.array([5.0, 1.0, -2.0, 0.5]), rng.standard_normal((2, 4))
    u = rng.standard_normal((n_ids, 2)) * 2
    rows = []
    for i in range(n_ids):
        x = rng.standard_normal((per, 3))
        y = np.c_[np.ones(per), x] @ (a + u[i] @ v) + noise * rng.standard_normal(per)
        rows += [(f"id{i}", *map(float, r), float(t), 1.0 + i % 3) for r, t in zip(x, y)]
    return rows


COLS = "id string, x1 double, x2 double, x3 double, y double, w double"
XS = ["x1", "x2", "x3"]


def test_planted_factors_are_found(spark):
    rows = planted()
    df = spark.createDataFrame(rows, COLS).repartition(5)
    fit = factors.fit_id_factors(df, XS, "id", "y", weight="w", rank=2, rounds=15, reg=0.05)
    got = factors.score_id_factors(df, fit).toPandas()
    rmse = float(np.sqrt(((got.y - got.prediction) ** 2).mean()))
    assert rmse < 0.12 < 1.0 < got.y.std()
    # Alternating minimisation: the objective never rises.
    assert all(b <= a * (1 + 1e-9) for a, b in zip(fit.curve, fit.curve[1:]))
    # Few rows of an id suffice, as the directions are shared: 3 rows cannot fit 4 numbers.
    few = [r for k, r in enumerate(rows) if r[0] != "id7" or k % 40 < 3]
    held = [r for k, r in enumerate(rows) if r[0] == "id7" and k % 40 >= 3]
    fit = factors.fit_id_factors(spark.createDataFrame(few, COLS), XS, "id", "y", rank=2, rounds=15, reg=0.05)
    got = factors.score_id_factors(spark.createDataFrame(held, COLS), fit).toPandas()
    assert float(np.sqrt(((got.y - got.prediction) ** 2).mean())) < 0.6


def test_common_part_equals_numpy_and_serves_unseen_ids(spark):
    rows = planted(n_ids=10, noise=1.0)
    df = spark.createDataFrame(rows, COLS)
    fit = factors.fit_id_factors(df, XS, "id", "y", weight="w", rank=1, rounds=1, reg=1e12)
    x = np.array([r[1:4] for r in rows])
    z = np.c_[np.ones(len(x)), (x - x.mean(0)) / x.std(0)]
    y, w = np.array([r[4] for r in rows]), np.sqrt([r[5] for r in rows])
    want = np.linalg.lstsq(z * w[:, None], y * w, rcond=None)[0]
    assert fit.common == pytest.approx(list(want), rel=1e-6, abs=1e-6)
    new = factors.score_id_factors(spark.createDataFrame([("new", *rows[0][1:])], COLS), fit).first()
    assert new.prediction == pytest.approx(float(z[0] @ want), rel=1e-6)


def test_null_ids_bad_rows_and_no_rows(spark):
    bad = [("id0", None, 0.0, 0.0, 1.0, 1.0), ("id0", 1.0, 1.0, 1.0, None, 1.0),
           ("id0", float("nan"), 1.0, 1.0, 1.0, 1.0), ("id0", 1.0, 1.0, 1.0, 1.0, 0.0)]
    rows = [(None if r[0] == "id1" else r[0], *r[1:]) for r in planted(n_ids=4)]
    df = spark.createDataFrame(rows, COLS)
    a = factors.fit_id_factors(df, XS, "id", "y", weight="w", rounds=2)
    b = factors.fit_id_factors(df.union(spark.createDataFrame(bad, COLS)), XS, "id", "y", weight="w", rounds=2)
    assert a.common == pytest.approx(b.common, rel=1e-9)
    assert {r.id for r in a.ids.collect()} == {None, "id0", "id2", "id3"}
    assert factors.score_id_factors(df, a).filter("prediction is null").count() == 0
    assert factors.fit_id_factors(df.limit(0), XS, "id", "y") is None
