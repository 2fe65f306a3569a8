"""Incremental curation. The reference has no event-time streams; windows and watermarks here are an
extension and named so."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lodestat.functions.text import squeeze


def file_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 64, kind: str = "parquet") -> DataFrame:
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)


def first_seen(stream: DataFrame, text: str, ts: str, within: str = "7 days") -> DataFrame:
    """Duplicates by normalised text within a time bound, so the state stays bounded."""
    d = stream.withColumn("text_hash", F.sha2(squeeze(F.col(text)), 256)).withWatermark(ts, within)
    return d.dropDuplicatesWithinWatermark(["text_hash"])


def windowed_counts(stream: DataFrame, ts: str, by: str, window: str = "1 hour", late: str = "2 hours", value: str | None = None) -> DataFrame:
    """Tumbling windows (extension)."""
    aggs = [F.count(F.lit(1)).alias("n")] + ([F.sum(value).alias("total")] if value else [])
    return stream.withWatermark(ts, late).groupBy(F.window(ts, window), by).agg(*aggs).select(F.col("window.start").alias("window_start"), by, "n", *(["total"] if value else []))


def append_batches(stream: DataFrame, target: str, checkpoint: str, key: str) -> StreamingQuery:
    """Appends each batch once: the batch number is part of the path, so a repeated batch overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates([key]).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_for(query: StreamingQuery, seconds: float) -> bool:
    """Lets a stream work until it is done or the time is up: true if done. What was written stays; the next start with the
    same checkpoint goes on behind the last whole batch."""
    if query.awaitTermination(seconds):
        return True
    query.stop()
    return False
