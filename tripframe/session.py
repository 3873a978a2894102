"""Spark session defaults for trip-observation jobs.

Only settings that are not already present are applied, so a cluster's own
configuration (shuffle partitions, checkpoint folder, memory) always wins.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Defaults tuned for large inputs: AQE re-plans joins and partition counts at
# run time from real shuffle sizes, skew join splits hot keys, and the
# broadcast threshold is the size check behind every implicit broadcast.
#
# Sizing at 100 TB (set by the cluster, never overridden here): scans split
# at 128 MB (~800k tasks); ``spark.sql.shuffle.partitions`` should be about
# the largest shuffle's bytes / 256 MB (e.g. 20 000-50 000 for a full-table
# shuffle) so every reducer fits executor memory; AQE then coalesces the
# small shuffles (aggregates, fit tables) towards the 128 MB advisory size.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "tripframe",
              extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session.

    An active session is reused as configured (``extra`` runtime settings
    are applied to it). Otherwise ``DEFAULTS`` fill only keys the cluster's
    submit-time configuration (``SparkConf()``: spark-submit arguments,
    spark-defaults.conf) leaves unset, and ``master`` only when none is set;
    ``extra`` is the caller's explicit choice and always applies."""
    from pyspark import SparkConf

    active = SparkSession.getActiveSession()
    if active is not None:
        for key, value in (extra or {}).items():
            try:
                active.conf.set(key, value)
            except Exception:  # noqa: BLE001 - static settings cannot change at run time
                pass
        ensure_checkpoint_dir(active)
        return active
    base = SparkConf()
    builder = SparkSession.builder.appName(app)
    if master and not base.contains("spark.master"):
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        if not base.contains(key):
            builder = builder.config(key, value)
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``.

    A private folder is created only when the setting is absent *and* the
    session is local (tests, benches); a cluster without the setting is an
    error, because a machine-local folder does not survive executor loss.
    """
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None)
    if not path:
        master = conf.get("spark.master", "")
        if not master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        path = tempfile.mkdtemp(prefix="tripframe-ckpt-",
                                dir=os.environ.get("TMPDIR", "/tmp"))
    spark.sparkContext.setCheckpointDir(path)
    return path
