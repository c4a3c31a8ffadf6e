"""Extension beyond the batch pipeline: new chunk topics as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.functions.text import normalize_topic


def topic_stream(spark: SparkSession, path: str, schema: str = "raw_id long, chunk_id long, topic string, seen_at timestamp") -> DataFrame:
    """(chunk_id, topic, seen_at): normalised topics of arriving Parquet files, each once within a day."""
    s = spark.readStream.schema(schema).parquet(path).withWatermark("seen_at", "1 day")
    s = s.select("chunk_id", normalize_topic(F.col("topic")).alias("topic"), "seen_at").where("topic is not null")
    return s.dropDuplicatesWithinWatermark(["chunk_id", "topic"])


def upsert_into(stream: DataFrame, target: str, checkpoint: str):
    """A query that adds the rows of each batch whose (chunk_id, topic) the target table doesn't hold yet.

    A batch that runs again after a failure finds its rows there and adds nothing.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("chunk_id", "topic").distinct()
        try:
            rows = rows.join(spark.read.parquet(target).select("chunk_id", "topic"), ["chunk_id", "topic"], "left_anti")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        rows.write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, events, value): activity of a user without a longer gap, for batches and streams alike."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    g = e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "value")
