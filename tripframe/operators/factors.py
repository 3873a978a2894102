"""Id embeddings (I2): weighted least squares in which every id has a few factors.

The prediction is ``(a + V' u_id) . x`` with ``x`` = 1 and the standardized dense
features: a common line ``a``, and per id ``rank`` numbers ``u_id`` that bend it along
the ``rank`` directions ``V`` that all ids share. Rare ids are drawn to the common line
by the ridge, ids unseen in training have it.

The rows are read once: per id, Spark sums weighted products of the inputs (partial
aggregates, so a hot id travels as one row a task). The alternating rounds then work on
that table of one row an id, each task giving one fixed-size sum of normal equations.
Only those sums, ``((rank + 1) * inputs) ** 2`` numbers whatever the number of ids,
reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripframe.operators.positions import nullsafe_join
from tripframe.sources.files import stage_table


@dataclass
class IdFactors:
    """``ids``: key and ``coef`` (array: constant, then one number a feature) of every
    id of the training rows; ``common``: those of any other id; ``curve``: the weighted
    squared error plus ridge after each round."""

    ids: DataFrame
    common: list[float]
    mean: list[float]
    scale: list[float]
    features: list[str]
    key: str
    curve: list[float]


def _inputs(features: Sequence[str], mean: Sequence[float], scale: Sequence[float]):
    return [F.lit(1.0)] + [(F.col(f"`{c}`").cast("double") - m) / s
                           for c, m, s in zip(features, mean, scale)]


def fit_id_factors(train: DataFrame, features: Sequence[str], key: str, label: str,
                   weight: str | None = None, rank: int = 2, rounds: int = 10,
                   reg: float = 1.0, seed: int = 42) -> IdFactors | None:
    """Fit by alternating ridge regressions: the ids' factors given the common part,
    then the common part given the factors. ``reg`` weighs the squares of factors and
    directions against the weighted squared error. Rows with a null or non-finite
    input, label or weight, or a weight not above 0, are left out; a null id is an id
    like any other; without rows there is no model (None)."""
    features = list(features)
    w = F.col(f"`{weight}`").cast("double") if weight else F.lit(1.0)
    y = F.col(f"`{label}`").cast("double")
    whole = train.filter(w > 0)
    for c in [*[F.col(f"`{c}`").cast("double") for c in features], y, w]:
        whole = whole.filter(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    first = whole.agg(F.count(F.lit(1)), *[f(F.col(f"`{c}`").cast("double"))
                                           for c in features for f in (F.avg, F.stddev_pop)]).first()
    if not first[0]:
        return None
    mean, scale = list(first[1::2]), [s or 1.0 for s in first[2::2]]
    x = _inputs(features, mean, scale)
    q, r = len(x), rank
    pairs = [(i, j) for i in range(q) for j in range(i, q)]
    sums = ([F.sum(w * x[i] * x[j]) for i, j in pairs] + [F.sum(w * v * y) for v in x] + [F.sum(w * y * y)])
    per_id = whole.groupBy(F.col(f"`{key}`").alias(key)).agg(*[s.alias(f"_s{i}") for i, s in enumerate(sums)])
    table = stage_table(per_id.select(key, F.array(*[f"_s{i}" for i in range(len(sums))]).alias("_stats")),
                        "id-factors")
    upper = np.array(pairs)

    def parts(batch):
        import numpy as np
        s = np.asarray(batch.column("_stats").flatten()).reshape(batch.num_rows, -1)
        g = np.empty((len(s), q, q))
        g[:, upper[:, 0], upper[:, 1]] = g[:, upper[:, 1], upper[:, 0]] = s[:, :len(upper)]
        return g, s[:, len(upper):-1], s[:, -1]

    def factors(g, c, common, shared):
        import numpy as np
        left = shared @ g @ shared.T + reg * np.eye(r)
        return np.linalg.solve(left, ((c - g @ common) @ shared.T)[:, :, None])[:, :, 0]

    def round_sums(common, shared):
        """Per task: normal equations of (common, shared) given the ids' best factors,
        and the objective there. ``shared`` None: of the common part alone."""
        n = q * (1 if shared is None else r + 1)

        def run(batches):
            import numpy as np
            import pyarrow as pa
            m, rhs, loss = np.zeros((n, n)), np.zeros(n), 0.0
            for b in batches:
                if not b.num_rows:
                    continue
                g, c, yy = parts(b)
                one = np.ones((len(g), 1))
                u = one if shared is None else np.hstack([one, factors(g, c, common, shared)])
                uu = (u[:, :, None] * u[:, None, :]).reshape(len(u), -1)
                k = u.shape[1]
                m += (uu.T @ g.reshape(len(g), -1)).reshape(k, k, q, q).transpose(0, 2, 1, 3).reshape(n, n)
                rhs += (u.T @ c).ravel()
                if shared is not None:
                    coef = common + u[:, 1:] @ shared
                    loss += float(yy.sum() - 2 * (coef * c).sum()
                                  + np.einsum("ni,nij,nj->", coef, g, coef) + reg * (u[:, 1:] ** 2).sum())
            flat = np.concatenate([m.ravel(), rhs, [loss]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["at", "v"])

        got = table.select("_stats").mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v"))
        flat = np.array([t.v for t in sorted(got.collect(), key=lambda t: t["at"])])
        return flat[:n * n].reshape(n, n), flat[n * n:-1], float(flat[-1])

    m, rhs, _ = round_sums(None, None)
    common = np.linalg.solve(m + 1e-9 * np.trace(m) / q * np.eye(q), rhs)
    shared = np.random.default_rng(seed).standard_normal((r, q)) / np.sqrt(q)
    curve = []
    for _ in range(rounds):
        m, rhs, loss = round_sums(common, shared)
        curve.append(loss + reg * float((shared ** 2).sum()))
        ridge = np.r_[np.full(q, 1e-9 * np.trace(m[:q, :q]) / q), np.full(r * q, reg)]
        both = np.linalg.solve(m + np.diag(ridge), rhs)
        common, shared = both[:q], both[q:].reshape(r, q)

    def coefs(batches):
        import pyarrow as pa
        for b in batches:
            if b.num_rows:
                g, c, _ = parts(b)
                coef = common + factors(g, c, common, shared) @ shared
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(list(coef), pa.list_(pa.float64()))], names=[key, "coef"])

    kind = table.schema[key].dataType.simpleString()
    ids = stage_table(table.mapInArrow(coefs, f"`{key}` {kind}, coef array<double>"), "id-factor-coefs")
    return IdFactors(ids, [float(v) for v in common], mean, scale, features, key, curve)


def score_id_factors(df: DataFrame, fit: IdFactors, out: str = "prediction") -> DataFrame:
    """Every row with its prediction (null where an input is null)."""
    ids = fit.ids.select(fit.key, F.col("coef").alias("_coef"))
    j = nullsafe_join(df, ids, [fit.key], "left")
    coef = F.coalesce("_coef", F.array(*[F.lit(v) for v in fit.common]))
    value = F.lit(0.0)
    for i, x in enumerate(_inputs(fit.features, fit.mean, fit.scale)):
        value = value + coef[i] * x
    return j.withColumn(out, value).drop("_coef")
