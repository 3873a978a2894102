"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import tripframe
from tripframe.session import ensure_checkpoint_dir
from tripframe.sources.files import stage_table

#: Bytes of text an Arrow batch may hold on its way to Python. A batch of
#: rows is cut at this size, so a task's memory does not depend on how long
#: the texts are.
BATCH_BYTES = 8 << 20
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name``, read by Spark (any store it can read)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, as any job
    does with its own modules."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    root = Path(tripframe.__file__).parent
    target = Path(tempfile.mkdtemp(prefix="tripframe-pkg-")) / "tripframe-package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(target))


def bound_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Prepare the session for Arrow functions of this package: cut batches by
    bytes where the session leaves that open, and ship the package."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, "2147483647")) > size:
        spark.conf.set(key, str(size))


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read back."""
    return stage_table(df, f"llm-{name}")


def stage_freed(df: DataFrame, name: str) -> DataFrame:
    """``stage``; the shuffles that led to it are deleted then, not when the
    driver next collects garbage."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        return stage(df, name)
    finally:
        conf.set(key, before)


def unstage(df: DataFrame) -> None:
    """Delete the files of a ``stage`` that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shared_dir(spark: SparkSession) -> str:
    return ensure_checkpoint_dir(spark)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def keyed_text(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text) under names that cannot clash with other columns."""
    return docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"),
                       F.col(f"`{text}`").cast("string").alias("text"))


def column(name: str) -> Column:
    return F.col(f"`{name}`")
