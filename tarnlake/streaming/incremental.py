"""Structured Streaming: raw files compacted as they arrive, and event-time windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def compact_stream(spark: SparkSession, raw: str, schema, curated: str, checkpoint: str, key: list[str], order: str) -> StreamingQuery:
    """Every micro-batch adds its latest row of each key to the curated folder, under its batch number, so a batch that is
    run again replaces itself. `latest` reads the folder."""

    def write(batch: DataFrame, number: int) -> None:
        best = batch.groupBy(*key).agg(F.max(F.struct(order, *[c for c in batch.columns if c not in (*key, order)])).alias("b")).select(*key, "b.*")
        best.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{curated}/batch={number}")

    return spark.readStream.schema(schema).parquet(raw).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, curated: str, key: list[str], order: str) -> DataFrame:
    rows = spark.read.option("basePath", curated).parquet(f"{curated}/batch=*")
    rest = [c for c in rows.columns if c not in (*key, order, "batch")]
    return rows.groupBy(*key).agg(F.max(F.struct(order, "batch", *rest)).alias("b")).select(*key, f"b.{order}", *[f"b.{c}" for c in rest])


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums per event type and tumbling window; rows later than the watermark are dropped when streaming."""
    out = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each user, closed by a gap."""
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
