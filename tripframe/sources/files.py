"""File sources and sinks (A1-A10).

Reads declare their schema (no inference pass), keep identifiers as strings
(leading zeros survive) and let Spark split files into tasks; sinks write
from the executors in parallel. Nothing is collected to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_typed_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType,
                   cols: Sequence[str] | None = None, glob: str | None = None,
                   with_file: bool = False, optional: Sequence[str] = ()) -> DataFrame:
    """A1/A2/A3/A4: header CSV with declared types, columns found by name.

    The header (of the first file; one small read) names the columns, which are
    read as text and selected by name, so files may have other columns or
    another order. Values that don't fit their type become null. A column that
    the header lacks is an error, or null if it is in ``optional``. Spark checks
    the header of every file against the first one and fails on a difference
    rather than shifting columns; folders with different headers are given as
    a list of paths and stacked by name. Spaces after the separator are
    trimmed, blank lines skipped; a folder (optionally filtered by ``glob``,
    e.g. ``*.{csv,CSV}``) reads every matching file. ``with_file`` adds the
    source file name (A5)."""
    if not isinstance(path, str):
        parts = [read_typed_csv(spark, p, schema, cols, glob, with_file, optional) for p in path]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def reader():
        r = (spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True)
             .option("mode", "PERMISSIVE"))
        return r.option("pathGlobFilter", glob) if glob else r

    names = reader().csv(path).columns
    text = T.StructType([T.StructField(n, T.StringType()) for n in names])
    df = reader().schema(text).option("enforceSchema", False).csv(path)
    wanted = [f for f in schema.fields if cols is None or f.name in cols]
    missing = [f.name for f in wanted if f.name not in names and f.name not in optional]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    out = [(F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in names
            else F.lit(None).cast(f.dataType)).alias(f.name) for f in wanted]
    if with_file:
        out.append(F.col("_metadata.file_name").alias("source_file"))
    return df.select(*out).select(*(cols or [f.name for f in wanted]), *(["source_file"] if with_file else []))


def file_audit(df: DataFrame, required: Sequence[str],
               by: str | Sequence[str] = "source_file") -> DataFrame:
    """A5: rows per file before and after dropping rows null or blank in
    ``required`` (one aggregation, no per-file loop)."""
    ok = F.lit(True)
    for c in required:
        ok = ok & F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")
    keys = [by] if isinstance(by, str) else list(by)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_read"),
                                 F.count_if(ok).alias("rows_kept"))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header and no index column."""
    df.write.mode(mode).option("header", True).csv(path)


def write_split(df: DataFrame, path: str, col: str = "dataset", fmt: str = "parquet",
                mode: str = "overwrite") -> None:
    """One folder per value of ``col`` in a single write (readers then
    prune partitions by a filter on ``col``)."""
    df.write.mode(mode).partitionBy(col).format(fmt).option("header", True).save(path)


def write_sorted(df: DataFrame, path: str, keys: Sequence[str], fmt: str = "parquet",
                 parts: int | None = None, mode: str = "overwrite") -> None:
    """Globally sorted output: range partitions, each sorted locally."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
       .write.mode(mode).format(fmt).option("header", True).save(path))


def save_fit_table(fit: DataFrame, path: str) -> None:
    """Persist a fit table (scaler statistics, vocabulary) as parquet."""
    fit.write.mode("overwrite").parquet(path)


def load_fit_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """A10: metrics / parameters (one-row frames) as JSON lines."""
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.json(path)


def stage_table(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once as parquet under the shared checkpoint folder and
    return the read-back: a lineage cut for results that several later
    steps reuse (a split feeding fits and scoring), so the input is not
    rescanned per consumer. Survives executor loss; columnar reads keep
    pruning and pushdown, and AQE sees real sizes. ``partition_by`` (e.g.
    the split column) lets later filters on it skip whole folders."""
    import os
    import uuid

    from tripframe.session import ensure_checkpoint_dir
    spark = df.sparkSession
    path = os.path.join(ensure_checkpoint_dir(spark), "stage", f"{name}-{uuid.uuid4().hex[:10]}")
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)
    return spark.read.parquet(path)
