"""Live bars from a stream of ticks/events with Structured Streaming.

Event-time tumbling windows with a watermark: rows later than the watermark
are dropped, rows within it update their bar (open/close are taken by event
order with min_by/max_by, so a late-but-allowed row lands in the right
place). Each micro-batch's updated bars are appended to a sink table with
the batch id (``foreachBatch``, idempotent per batch id); the current state
of every bar is its row from the latest batch. Checkpoints live under the
shared folder, so a restarted query resumes where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])

K_PATTERN = r'"k":\s*(-?\d+)'


def bar_aggregate(events: DataFrame, minutes: int, delay: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    ev = events.withColumn("ets", ts).withWatermark("ets", delay)
    k = F.regexp_extract(F.col("props"), K_PATTERN, 1).try_cast("int")
    return ev.groupBy(F.col("event_type").alias("symbol"), F.window("ets", f"{minutes} minutes").alias("w")).agg(
        F.min_by("value", "event_id").alias("o"),
        F.max("value").alias("h"),
        F.min("value").alias("l"),
        F.max_by("value", "event_id").alias("c"),
        F.count(F.lit(1)).alias("v"),
        (F.max_by(k, "event_id") / F.lit(100.0)).alias("base_score"),
    )


def run(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str, minutes: int = 60,
        delay: str = "2 hours", max_files_per_trigger: int | None = None) -> None:
    """Process everything available in ``source_dir`` (Parquet event files) and stop."""
    reader = spark.readStream.schema(EVENT_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    bars = bar_aggregate(reader.parquet(source_dir), minutes, delay)

    def sink(df: DataFrame, batch_id: int) -> None:
        (df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
         .parquet(f"{sink_dir.rstrip('/')}/batch_id={batch_id}"))

    q = (bars.writeStream.outputMode("update").foreachBatch(sink)
         .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())
    q.awaitTermination()


def current_bars(spark: SparkSession, sink_dir: str) -> DataFrame:
    """Latest state of every bar: its row from the most recent batch (canonical bar schema)."""
    rows = spark.read.parquet(sink_dir)
    cols = ["o", "h", "l", "c", "v", "base_score"]
    latest = rows.groupBy("symbol", F.col("w.start").alias("start")).agg(
        F.max_by(F.struct(*cols), "batch_id").alias("b"))
    out = latest.select("symbol", F.col("start").cast("timestamp_ntz").alias("ts"),
                        *[F.col("b")[c].alias(c) for c in cols])
    return out.withColumn("v", F.col("v").cast("long")).withColumn(
        "vwap", (F.col("h") + F.col("l") + F.col("c")) / F.lit(3.0))
