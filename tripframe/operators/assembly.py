"""Feature sets with fitted scalers (F24) and the sequences made of them (G1).

A set declares its ordered inputs, which columns are scaled, how, and what a
fit covers; the same declaration gives flat rows and sequence steps. Fits are
aggregates: one row (``train``), one per set, or one per group, never a window
over a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripframe.functions.featuresets import FeatureSet, row_features
from tripframe.operators import encode, sequence
from tripframe.operators.splits import DATASET, TRAIN

GROUP = ("BUSROUTE_ID", "BUSINFOUNIT_ID")


def fit_scaler(rows: DataFrame, fs: FeatureSet, dataset: str = DATASET) -> DataFrame | None:
    """Fit table of a set's scaler, or None where it has none or scales by group (which
    needs no fit kept). ``train`` sets are fitted on the train rows of ``dataset``."""
    if fs.scaler is None or fs.scope == "group":
        return None
    x = row_features(rows, fs)
    if fs.scope == "train":
        x = x.filter(F.col(dataset) == TRAIN)
    if fs.scaler == "minmax":
        if fs.scope != "train":
            raise ValueError("min-max scalers are fitted on train rows or by group")
        return encode.fit_minmax(x, fs.scaled)
    return encode.fit_standard(x, fs.scaled, by=[dataset] if fs.scope == "set" else ())


def flat(rows: DataFrame, fs: FeatureSet, fit: DataFrame | None = None, dataset: str = DATASET,
         group: Sequence[str] = GROUP) -> DataFrame:
    """``rows`` with every input of ``fs``. ``fit``: a saved fit table (default: fitted
    on the rows themselves). Null inputs stay null; an empty table stays empty."""
    x = row_features(rows, fs)
    if fs.scaler is None:
        return x
    if fs.scope == "group":
        return encode.minmax_by_group(x, fs.scaled, list(group))
    fit = fit_scaler(rows, fs, dataset) if fit is None else fit
    if fs.scaler == "minmax":
        return encode.apply_minmax(x, fit, fs.scaled)
    return encode.apply_standard(x, fit, fs.scaled, by=[dataset] if fs.scope == "set" else ())


def step_sequences(rows: DataFrame, fs: FeatureSet, order: Sequence[str] = ("DEP_TIME",), length: int = 5,
                   key: str = "obs_id", group: Sequence[str] = GROUP, hashed: bool = True) -> DataFrame:
    """G1: one row per target row that has ``length`` rows before it in its group, with
    ``seq``: an array of steps, each the ordered inputs of ``fs`` as an array of doubles.

    Groups are the hashed route and segment, as in the source, so ids that share a
    bucket share a group and its scaler; ``hashed=False`` groups by the ids themselves."""
    x = row_features(rows, fs)
    keys = ["route_hash", "unit_hash"] if hashed else list(group)
    if fs.scope == "group":
        x = encode.minmax_by_group(x, fs.scaled, keys)
    elif fs.scaler is not None:
        x = flat(rows, fs)
    step = F.array(*[F.col(c).cast("double") for c in fs.columns])
    got = sequence.sliding_sequences(x.withColumn("step", step), keys, list(order), ["step"], length, key)
    return got.withColumn("seq", F.transform("seq", lambda s: s["step"])).drop("step")
