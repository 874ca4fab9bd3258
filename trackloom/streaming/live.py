"""Event streams: reading, tables as streams of several files, rolling throughput. Batch and stream forms share their expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.sources.shared import shared_path


def read_events(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """The table at ``path`` (a file or a folder) as a stream; the pattern keeps a lone file from being taken for a folder."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path + "*")


def in_files(events: DataFrame, part: Column, parts: int = 3) -> DataFrame:
    """A table as a stream of about ``parts`` micro-batches: the files of ``part`` 0 come first, then those of 1 and so on."""
    spark = events.sparkSession
    path = shared_path(spark, "files")
    for n in range(parts):
        events.where(part == n).write.mode("append").parquet(path)
    files = len(spark.read.parquet(path).inputFiles())
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", max(1, -(-files // parts))).parquet(path)


def _marked(events: DataFrame, late: str) -> DataFrame:
    """A stream with a watermark on ``t`` (which needs a timestamp of the session's zone); a table as it is."""
    return events.withColumn("t", F.col("t").cast("timestamp")).withWatermark("t", late) if events.isStreaming else events


def throughput(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Outputs in sliding windows of 30 minutes, every 10; works on streams (late rows beyond ``late`` are dropped) and tables."""
    rows = _marked(events, late)
    out = rows.where("type = 'mp3_verified'").groupBy(F.window("t", "30 minutes", "10 minutes").alias("w")).agg(F.count("*").alias("done"))
    return out.select(F.col("w.start").alias("start"), "done", F.round(F.col("done") / 30, 6).alias("rate"))


def collect_stream(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a finite stream to its end into a table in memory (for tests and small reports)."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
