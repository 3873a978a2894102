"""Structured Streaming: score observations as they arrive.

Real-time use is the stated goal of the source project; its data work per
row is stateless (row rules, features), so the same Column expressions run
unchanged on a stream. Scoring is a stream-static join with the fitted
group-mean tables; per-segment windowed means use a watermark so state is
dropped once a window can no longer change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripframe.functions import clock
from tripframe.operators import clean, model
from tripframe.sources import adapters as A


def events_stream(spark: SparkSession, sf_dir: str, max_files: int = 1) -> DataFrame:
    """The ``events`` table as a stream (schema from the table). The path is a
    pattern, which lists a single file as well as a folder of files."""
    schema = A.table(spark, sf_dir, "events").schema
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
            .parquet(f"{sf_dir}/events.parque[t]"))


def clean_stream(obs: DataFrame) -> DataFrame:
    """Stateless travel rules (range, speed, GPS, slots) on streaming rows.

    The two dedups need state over the whole history; they run in the batch
    operators, not here."""
    out = obs.filter(F.col("LEN") > 0)
    for _, rule in clean.travel_row_rules():
        out = out.filter(F.coalesce(rule, F.lit(False)))
    return out


def score_stream(obs: DataFrame, fits, levels) -> DataFrame:
    """Stream-static join with the group-mean fit tables (I5 on a stream)."""
    x = obs.withColumn("tod_class", clock.tod_class(clock.hour_of("DEP_TIME")))
    return model.score_group_mean(x, fits, levels)


def event_time(obs: DataFrame) -> DataFrame:
    ts = F.to_timestamp(F.concat_ws(" ", "COLLECT_DATE", "DEP_TIME"), "yyyy-MM-dd HH:mm")
    return obs.withColumn("event_ts", ts)


def windowed_segment_means(obs: DataFrame, window: str = "1 hour",
                           watermark: str = "2 hours") -> DataFrame:
    """Tumbling-window mean TIME_GAP per segment with a watermark."""
    x = event_time(obs).withWatermark("event_ts", watermark)
    return (x.groupBy(F.window("event_ts", window).alias("w"), "BUSINFOUNIT_ID")
             .agg(F.avg("TIME_GAP").alias("mean_time_gap"), F.count(F.lit(1)).alias("n"))
             .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                     "BUSINFOUNIT_ID", "mean_time_gap", "n"))


def run_to_parquet(sdf: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Drain all available input into a parquet sink (exactly-once via the
    checkpoint), then stop."""
    q = (sdf.writeStream.format("parquet").outputMode(mode)
            .option("path", path).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
    q.awaitTermination()
