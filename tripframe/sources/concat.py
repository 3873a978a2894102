"""Folder concatenation with a per-step audit (A4, A5, B3, B5, B9, A8 as one job).

Every file of a folder is read once; each row is marked with the first step that drops
it and the marked rows are written once (shared folder). The audit counts two narrow
columns of that table; the kept rows are tightened, made distinct, ordered by range
partitions and written. Whatever the number of files, nothing loops over them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripframe.operators import clean
from tripframe.sources import files

FILE, STEP = "source_file", "_step"


def first_failure(required: Sequence[str]) -> Column:
    """Number of the first column of ``required`` that is null or blank, else their count."""
    out = F.lit(len(required))
    for i in reversed(range(len(required))):
        c = F.col(required[i])
        out = F.when(c.isNull() | (F.trim(c.cast("string")) == ""), F.lit(i)).otherwise(out)
    return out


def step_audit(marked: DataFrame, required: Sequence[str], by: Sequence[str] = (FILE,)) -> DataFrame:
    """A5: per file the rows read, the rows each step drops (of those that the steps
    before it left, as ``dropped_<column>``) and the rows kept."""
    return marked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows_read"),
        *[F.count_if(F.col(STEP) == i).alias(f"dropped_{c}") for i, c in enumerate(required)],
        F.count_if(F.col(STEP) == len(required)).alias("rows_kept"))


def read_marked(spark: SparkSession, path, schema: T.StructType, required: Sequence[str],
                glob: str = "*.{csv,CSV}", optional: Sequence[str] = ()) -> DataFrame:
    """The rows of every file with their file and first failing step, written once."""
    df = files.read_typed_csv(spark, path, schema, glob=glob, with_file=True, optional=optional)
    return files.stage_table(df.withColumn(STEP, first_failure(required)), "concat")


def kept_rows(marked: DataFrame, required: Sequence[str], truncate: Sequence[str] = ("TIME_GAP",),
              rounded: Sequence[str] = ("SPEED",)) -> DataFrame:
    """Rows that no step drops, integer columns tightened (B5), equal rows once."""
    x = marked.filter(F.col(STEP) == len(required)).drop(FILE, STEP)
    return clean.tighten_types(x, [c for c in truncate if c in x.columns],
                               [c for c in rounded if c in x.columns]).distinct()


def totals(audit: DataFrame, required: Sequence[str], written: DataFrame) -> DataFrame:
    """One row: the audit summed up over all files and the rows after removal of equal ones."""
    names = ["rows_read", *[f"dropped_{c}" for c in required], "rows_kept"]
    return audit.agg(*[F.sum(c).alias(c) for c in names]).withColumn(
        "rows_distinct", written.agg(F.count(F.lit(1))).scalar())


def concat(spark: SparkSession, path, out: str, schema: T.StructType, required: Sequence[str] = ("SPEED", "TIME_GAP"),
           order: Sequence[str] = ("BUSROUTE_ID", "BUSINFOUNIT_ID", "DEP_TIME"), fmt: str = "csv",
           glob: str = "*.{csv,CSV}", optional: Sequence[str] = ()) -> DataFrame:
    """Reads, audits, cleans, orders and writes a folder to ``out``; returns the per-file audit.
    Rows equal in ``order`` stand in any order, as in the source."""
    marked = read_marked(spark, path, schema, required, glob, optional)
    files.write_sorted(kept_rows(marked, required), out, order, fmt)
    return step_audit(marked, required)
