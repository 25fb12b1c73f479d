"""The lake as a stream: late rows within a watermark, each chunk once, upserted batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestream.operators import lake


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``window_start, event_type, n, total`` of a batch or stream of events; rows later than ``late`` are dropped by a stream."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    counted = timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return counted.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def ingest_stream(spark: SparkSession, path: str, collection: str, checkpoint: str, tenant: str, late: str = "7 days") -> StreamingQuery:
    """Chunks of what lands below ``path`` (parquet) into the collection, once for each harvest_id, until all is read."""
    schema = spark.read.parquet(path).schema
    landed = spark.readStream.schema(schema).parquet(path).withWatermark("harvested_at", late).dropDuplicatesWithinWatermark(["harvest_id"])

    def write(batch: DataFrame, epoch: int) -> None:
        lake.upsert(spark, lake.payloads(lake.flatten(batch), tenant), collection, ["chunk_no", "source_url"])

    return landed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
