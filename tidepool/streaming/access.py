"""Streams over the access log: windowed counts with a watermark, and ingest without repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def access_stream(spark: SparkSession, path: str, schema: str, glob: str = "events.parquet") -> DataFrame:
    """memory_id, accessed_at, query_text, event_id as they arrive."""
    files = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").parquet(path)
    return files.select(F.col("user_id").alias("memory_id"), F.col("ts").cast("timestamp").alias("accessed_at"), F.col("event_type").alias("query_text"), "event_id")


def windowed_counts(stream: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Accesses of each memory in windows of time; later rows than the watermark are left out."""
    w = F.window("accessed_at", width)
    return stream.withWatermark("accessed_at", late).groupBy(w, "memory_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("day"), "memory_id", "n")


def without_repeats(stream: DataFrame, key: str, late: str = "2 days") -> DataFrame:
    return stream.withWatermark("accessed_at", late).dropDuplicatesWithinWatermark([key])


def kept_counts(stream: DataFrame, folder: str, width: str = "1 day", late: str = "2 days") -> StreamingQuery:
    """Writes the windowed counts that each micro-batch changes to folder/batch=n, once: a batch that is run again replaces what it wrote. The state lies in
    folder-state, so a query that is started again goes on where the last one ended."""

    def put(changed: DataFrame, n: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/batch={n}")

    return windowed_counts(stream, width, late).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{folder}-state").trigger(availableNow=True).start()


def read_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The counts as the last batch that changed each has left them."""
    found = spark.read.parquet(folder)
    return found.groupBy("day", "memory_id").agg(F.max_by("n", "batch").alias("n"))
