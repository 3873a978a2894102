"""Scalar feature expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Day types and data types used by the one-hot encoders.
DAY_TYPES = (1, 2, 3, 4, 5, 6, 7)
DATA_TYPES = ("EVENT", "PATRN")

# Distance-class cut points (travel model, route model).
TRAVEL_DISTANCE_CUTS = (500, 1500)
ROUTE_DISTANCE_CUTS = (100, 500)

# Distance-weight variants as (minimum LEN, weight); else 1.0.
DISTANCE_WEIGHTS = {
    "travel": (500, 3.5),
    "route_feat": (100, 3.0),
    "route": (500, 3.0),
    "legacy": (1500, 2.0),
}

# Data-type weights.
DATA_TYPE_WEIGHTS = {"EVENT": 0.8, "PATRN": 0.2}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cyclic(c, period: float) -> tuple[Column, Column]:
    """sin/cos(2*pi*c/period) (F4 with 24, F5 with 7)."""
    angle = F.lit(2 * math.pi) * _col(c) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def distance_class(length, cuts=TRAVEL_DISTANCE_CUTS) -> Column:
    """0 below the first cut, 1 below the second, else 2."""
    length = _col(length)
    lo, hi = cuts
    return (F.when(length < lo, 0).when(length < hi, 1)
             .when(length >= hi, 2).otherwise(0))


def onehot(c, values) -> list[Column]:
    """One 0/1 double column per value, in the given order (F11, F11b); null
    has no category, so all of them are 0."""
    c = _col(c)
    return [F.coalesce((c == F.lit(v)).cast("double"), F.lit(0.0)) for v in values]


def distance_weight(length, variant: str = "travel") -> Column:
    cut, weight = DISTANCE_WEIGHTS[variant]
    return F.when(_col(length) >= cut, F.lit(weight)).otherwise(F.lit(1.0))


def data_type_weight(data_type, length, variant: str = "travel") -> Column:
    """data-type weight times distance weight."""
    dt = _col(data_type)
    w = F.lit(None).cast("double")
    for name, value in DATA_TYPE_WEIGHTS.items():
        w = F.when(dt == name, F.lit(value)).otherwise(w)
    return w * distance_weight(length, variant)


def target_weight(scaled_target, threshold: float = 0.3,
                  high: float = 10.0, low: float = 1.0) -> Column:
    """high weight when the scaled target exceeds the threshold."""
    return F.when(_col(scaled_target) > threshold, F.lit(high)).otherwise(F.lit(low))


def clip_zero(c) -> Column:
    """negative predictions become 0."""
    return F.greatest(_col(c), F.lit(0).cast("double"))
