"""The driver-facing rounding needs each oracle query's double columns;
this keeps the generated map in tripframe/plans/doubles.py current."""

from pyspark.sql import types as T

from conftest import SF_SMALL
from tripframe.plans import load_all
from tripframe.plans.doubles import DOUBLE_COLUMNS


def spark_double_columns(spark):
    queries, oracle = load_all()
    out = {}
    for name in sorted(oracle):
        sch = queries[name](spark, SF_SMALL).schema
        cols = [f.name for f in sch.fields if isinstance(f.dataType, T.DoubleType)]
        if cols:
            out[name] = cols
    return out


def test_double_column_map_is_current(spark):
    assert spark_double_columns(spark) == DOUBLE_COLUMNS
