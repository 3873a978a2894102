"""Seeded parameter search: model-based sampling with successive halving (I4).

``propose`` draws parameter points that past results make likely to be good: results are
split into the better quarter and the rest, both are smoothed into densities per parameter,
and of many draws around good points the one with the largest ratio of the two densities is
taken (a tree-structured Parzen estimator). ``search`` runs rounds of proposals: all points
of a round are tried on a small share of the data, the best ``1 / eta`` of them go on to a
larger share, and only the last few see all of it. ``fit_search`` does that for a Spark ML
pipeline: a round's candidates are fitted by ``fitMultiple`` in at most ``parallelism`` Spark
jobs at a time, on a seeded share of the training rows, and scored on the whole validation
set. The driver holds points and scores only.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Range(NamedTuple):
    """Bounds of a parameter, on a logarithmic scale or rounded to whole numbers if asked."""

    low: float
    high: float
    log: bool = False
    whole: bool = False

    def at(self, u: float) -> float:
        if self.log:
            v = math.exp(math.log(self.low) + u * (math.log(self.high) - math.log(self.low)))
        else:
            v = self.low + u * (self.high - self.low)
        return int(round(v)) if self.whole else v


class Trial(NamedTuple):
    """A point of the unit cube, the largest share of data it was tried on, its loss there."""

    point: tuple[float, ...]
    share: float
    loss: float


GOOD, DRAWS, START = 0.25, 24, 6


def _density(x: float, centres: Sequence[float], width: float) -> float:
    # A flat part keeps every place possible.
    return 0.1 + sum(math.exp(-0.5 * ((x - c) / width) ** 2) for c in centres) / (len(centres) * width * math.sqrt(2 * math.pi))


def propose(trials: Sequence[Trial], n: int, dims: int, rng: random.Random) -> list[tuple[float, ...]]:
    """``n`` points: spread evenly over every parameter at first, then by the model."""
    if len(trials) < START:
        columns = [[(k + rng.random()) / n for k in rng.sample(range(n), n)] for _ in range(dims)]
        return list(zip(*columns))
    ranked = sorted(trials, key=lambda t: (-t.share, t.loss))      # who came further is better
    k = max(2, math.ceil(GOOD * len(ranked)))
    good, rest = ranked[:k], ranked[k:] or ranked
    wide = [max(0.04, len(g) ** -0.5 * _spread([t.point[d] for t in g])) for g in (good, rest) for d in range(dims)]

    def ratio(p: Sequence[float]) -> float:
        return sum(math.log(_density(p[d], [t.point[d] for t in good], wide[d]))
                   - math.log(_density(p[d], [t.point[d] for t in rest], wide[dims + d])) for d in range(dims))

    def draw() -> tuple[float, ...]:
        near = rng.choice(good).point
        return tuple(_fold(rng.gauss(near[d], wide[d])) for d in range(dims))

    return [max((draw() for _ in range(DRAWS)), key=ratio) for _ in range(n)]


def _spread(v: Sequence[float]) -> float:
    m = sum(v) / len(v)
    return math.sqrt(sum((x - m) ** 2 for x in v) / len(v))


def _fold(x: float) -> float:
    """Reflected into the unit interval."""
    x = abs(x) % 2
    return 2 - x if x > 1 else x


def search(evaluate: Callable[[list[dict], float], list[float]], space: dict[str, Range], rounds: int = 5, width: int = 9,
           eta: int = 3, steps: int = 3, seed: int = 42) -> tuple[dict, float, list[Trial]]:
    """(best parameters, their loss on all data, all trials). ``evaluate`` takes parameter
    dicts and a share of the data (``eta ** -(steps - 1)`` up to 1) and gives their losses;
    NaN counts as the worst. Ties go to the earlier point."""
    names, rng = list(space), random.Random(seed)
    trials: list[Trial] = []
    best: tuple[float, int] | None = None
    points: list[dict] = []
    for _ in range(rounds):
        alive = [(p, {n: space[n].at(u) for n, u in zip(names, p)}) for p in propose(trials, width, len(names), rng)]
        done: dict[int, Trial] = {}
        order = list(range(len(alive)))
        for step in range(steps):
            share = float(eta) ** (step - steps + 1)
            losses = [math.inf if math.isnan(x) else x for x in evaluate([alive[i][1] for i in order], share)]
            for i, loss in zip(order, losses):
                done[i] = Trial(alive[i][0], share, loss)
            if step < steps - 1:
                order = sorted(order, key=lambda i: (done[i].loss, i))[:max(1, len(order) // eta)]
        for i in order:
            points.append(alive[i][1])
            if best is None or done[i].loss < best[0]:
                best = (done[i].loss, len(points) - 1)
        trials += done.values()
    return points[best[1]], best[0], trials


def fit_search(pipeline: Pipeline, params: dict[str, tuple[object, Range]], train: DataFrame, val: DataFrame,
               label: str = "TIME_GAP", key: str = "obs_id", metric: str = "rmse", parallelism: int = 2, seed: int = 42,
               **how) -> tuple[PipelineModel, dict, list[Trial]]:
    """``search`` over a pipeline's parameters (name -> (Spark ML param, range)): the model
    fitted on all of ``train`` with the best parameters, those, and all trials."""
    scorer = RegressionEvaluator(labelCol=label, predictionCol="prediction", metricName=metric)
    sign = -1.0 if scorer.isLargerBetter() else 1.0
    kept: dict[tuple, PipelineModel] = {}

    def evaluate(points: list[dict], share: float) -> list[float]:
        part = train if share >= 1 else train.filter(
            F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20)))
        fits = pipeline.fitMultiple(part, [{params[n][0]: v for n, v in p.items()} for p in points])

        def one(_) -> tuple[int, float]:
            i, fitted = next(fits)
            if share >= 1:
                kept[tuple(points[i].items())] = fitted
            return i, sign * scorer.evaluate(fitted.transform(val))

        with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
            return [x for _, x in sorted(pool.map(one, points))]

    best, _, trials = search(evaluate, {n: r for n, (_, r) in params.items()}, seed=seed, **how)
    return kept[tuple(best.items())], best, trials
