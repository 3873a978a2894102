"""Name -> query builder registry shared by the catalog modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query builder; ``sql`` is its DuckDB oracle (None = rows-only)."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# Results handed to the driver: doubles are reported to 1e-6 (rint of the
# scaled value, the same binary rule in Spark and DuckDB) so last-bit
# differences between summation orders do not change a value hash.
DIGITS = 6


def round_doubles(df: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F
    from pyspark.sql import types as T
    scale = float(10 ** DIGITS)
    cols = [(F.rint(F.col(f.name) * F.lit(scale)) / F.lit(scale)).alias(f.name)
            if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
            for f in df.schema.fields]
    return df.select(*cols)


def round_sql(sql: str, double_cols) -> str:
    if not double_cols:
        return sql
    repl = ", ".join(f'round_even("{c}" * 1e{DIGITS}::DOUBLE, 0) / 1e{DIGITS}::DOUBLE AS "{c}"'
                     for c in double_cols)
    return f"SELECT * REPLACE ({repl}) FROM (\n{sql}\n) AS _q"
