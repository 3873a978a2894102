"""Command line for the source project's script stages, on your own files.

    python -m tripframe.cli concat        --input raw_csv_dir --output dir [--audit audit_dir]
    python -m tripframe.cli clean-travel  --input raw_csv_dir --output clean_dir [--audit audit_dir]
    python -m tripframe.cli clean-holding --input raw_csv_dir --output clean_dir
    python -m tripframe.cli outliers      --input dir --columns TIME_GAP,SPEED --output dir
    python -m tripframe.cli split         --input dir --output dir --mode random|stratified|date|singleton
                                          [--keys DAY_TYPE,BUSROUTE_ID]
    python -m tripframe.cli densify       --input dir --output dir --kind travel|holding
    python -m tripframe.cli profile       --input dir --output dir [--columns TIME_GAP,LEN]
    python -m tripframe.cli compare       --input dir --output dir

Inputs are CSV folders (``*.csv`` / ``*.CSV``, header, declared schema) or
parquet folders (``--format parquet``); outputs are parquet unless
``--out-format csv``. A row key ``obs_id`` is added from the input order when
the files have none. Every stage is one Spark job graph; nothing is
collected to the driver.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripframe import schema as S
from tripframe.operators import clean, densify, evaluate, outliers, positions, profile, splits
from tripframe.sources import concat, files
from tripframe.session import get_spark


def _raw_schema(schema: T.StructType) -> T.StructType:
    """File schema: no row key; TIME_GAP / SPEED read as doubles so that B5
    (truncate / round half-even) decides their integer values."""
    return T.StructType([T.StructField(f.name, T.DoubleType()) if f.name in ("TIME_GAP", "SPEED")
                         else f for f in schema.fields if f.name != "obs_id"])


def _read(spark: SparkSession, path: str, fmt: str, schema: T.StructType) -> DataFrame:
    """Read a folder and add ``obs_id`` = position in file order (file name,
    then position inside the file) when the files carry no key. Positions
    are exact and distributed: buckets are (file, split), each bounded by
    the split size."""
    if fmt == "parquet":
        df = spark.read.parquet(path)
    else:
        df = files.read_typed_csv(spark, path, _raw_schema(schema), glob="*.{csv,CSV}",
                                  optional=schema.fieldNames())
    if "obs_id" in df.columns:
        return df
    cols = df.columns
    df = (df.withColumn("_f", F.col("_metadata.file_name"))
            .withColumn("_b", F.col("_metadata.file_block_start"))
            .withColumn("_m", F.monotonically_increasing_id()))
    df = positions.position(df, [], ["_f", "_b", "_m"], name="obs_id")
    return clean.tighten_types(df.select(F.col("obs_id").cast("long"), *cols),
                               [c for c in ("TIME_GAP",) if c in cols],
                               [c for c in ("SPEED",) if c in cols])


def _write(df: DataFrame, path: str, fmt: str, partition_by: str | None = None) -> None:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)


def main(argv=None) -> int:
    ap = argparse.ArgumentParser(prog="tripframe")
    ap.add_argument("stage", choices=["concat", "clean-travel", "clean-holding", "outliers", "split",
                                      "densify", "profile", "compare"])
    ap.add_argument("--input", required=True)
    ap.add_argument("--output", required=True)
    ap.add_argument("--format", default="csv", choices=["csv", "parquet"])
    ap.add_argument("--out-format", default="parquet", choices=["csv", "parquet"])
    ap.add_argument("--audit")
    ap.add_argument("--columns", default="TIME_GAP")
    ap.add_argument("--keys", default="")
    ap.add_argument("--mode", default="random", choices=["random", "stratified", "date", "singleton"])
    ap.add_argument("--kind", default="travel", choices=["travel", "holding"])
    ap.add_argument("--master")
    a = ap.parse_args(argv)
    spark = get_spark(a.master, f"tripframe-{a.stage}")
    cols = [c for c in a.columns.split(",") if c]
    keys = [c for c in a.keys.split(",") if c]

    if a.stage == "concat":
        schema = _raw_schema(S.TRAVEL_OBS)
        audit = concat.concat(spark, a.input, a.output, schema, fmt=a.out_format, optional=schema.fieldNames())
        if a.audit:
            _write(audit, a.audit, a.out_format)
    elif a.stage == "clean-travel":
        df = _read(spark, a.input, a.format, S.TRAVEL_OBS)
        df = clean.drop_blank(df, ["BUSINFOUNIT_ID", "DEP_TIME"])
        _write(clean.travel_quality(df), a.output, a.out_format)
        if a.audit:
            _write(clean.travel_quality_audit(df), a.audit, a.out_format)
    elif a.stage == "clean-holding":
        df = _read(spark, a.input, a.format, S.HOLDING_OBS)
        _write(clean.holding_quality(df), a.output, a.out_format)
    elif a.stage == "outliers":
        df = _read(spark, a.input, a.format, S.TRAVEL_OBS)
        _write(outliers.iqr_split(df, cols), a.output, a.out_format, "iqr_set")
    elif a.stage == "split":
        df = _read(spark, a.input, a.format, S.TRAVEL_OBS)
        if a.mode == "random":
            out = splits.random_split(df)
        elif a.mode == "stratified":
            out = splits.stratified_split_fallback(df, keys)
        elif a.mode == "date":
            out = splits.date_split(df)
        else:
            out = splits.singleton_split(df, keys)
        _write(out, a.output, a.out_format, "dataset")
    elif a.stage == "densify":
        if a.kind == "travel":
            df = _read(spark, a.input, a.format, S.TRAVEL_OBS).withColumnRenamed("SPEED", "speed_kmh")
            out = densify.fill_minutes(df, ["BUSINFOUNIT_ID"], ["DAY_TYPE", "LEN"],
                                       {"TIME_GAP": -1, "speed_kmh": 0},
                                       keep_cols=list(S.GRID_OUT_COLS))
            out = densify.ordered(out, ["DEP_TIME", "BUSINFOUNIT_ID"])
        else:
            df = _read(spark, a.input, a.format, S.HOLDING_OBS)
            out = densify.fill_minutes(df, ["BUSROUTE_ID", "BUSSTOP_ID"], ["DAY_TYPE"],
                                       {"TIME_GAP": -1},
                                       keep_cols=["DAY_TYPE", "BUSROUTE_ID", "BUSSTOP_ID",
                                                  "DEP_TIME", "TIME_GAP"])
            out = densify.ordered(out, ["DEP_TIME", "BUSROUTE_ID", "BUSSTOP_ID"])
        _write(out, a.output, a.out_format)
    elif a.stage == "profile":
        df = _read(spark, a.input, a.format, S.TRAVEL_OBS)
        _write(profile.describe_num(df, cols or ["TIME_GAP", "LEN"]), a.output + "/describe",
               a.out_format)
        _write(profile.sizes_by_keys(df, ["DAY_TYPE", "BUSROUTE_ID", "BUSINFOUNIT_ID"]),
               a.output + "/sizes", a.out_format)
        _write(profile.missing_counts(df), a.output + "/missing", a.out_format)
    elif a.stage == "compare":
        df = _read(spark, a.input, a.format, S.COMPARISON)
        _write(evaluate.incumbent_bins(df, "TRAVEL_TIME_EVENT", "DIFF_EVENT_AI", "DIFF_EVENT_BIS"),
               a.output + "/travel_bins", a.out_format)
        _write(evaluate.incumbent_bins(df, "SERVICE_TIME_EVENT", "DIFF_EVENT_SERVICE_AI",
                                       "DIFF_EVENT_SERVICE_BIS", upper_minutes=5),
               a.output + "/service_bins", a.out_format)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
