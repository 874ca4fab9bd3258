"""Streams whose results are kept by key: a journal of checkpoints and live coverage.

A journal is a folder of batches: each writes its latest row of each key under its own number, over what an earlier attempt
of the same batch left, so a batch that runs twice counts once. Readers take each key's latest row by the order columns,
whichever batch brought it: an older event that comes late doesn't overwrite a newer one. Every ``COMPACT`` batches the rows
so far are written as one. The folder is all there is to a journal: a new driver reads it and goes on.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.sources.shared import shared_path

COMPACT = 16


class Journal:
    """Keyed rows under ``path``: ``key`` columns, ``order`` columns that say which of a key's rows is the latest."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], order: list[str]):
        self.spark, self.path, self.key, self.order = spark, path, key, order

    def _latest(self, rows: DataFrame, *last: str) -> DataFrame:
        best = F.max_by(F.struct("*"), F.struct(*self.order, *last))
        return rows.groupBy(*self.key).agg(best.alias("row")).select("row.*")

    def put(self, batch: DataFrame, number: int) -> None:
        self._latest(batch).write.mode("overwrite").parquet(f"{self.path}/batch={number}")
        if number % COMPACT == COMPACT - 1:
            # the rows so far go under a number of their own, and the batches before it are no longer read
            self.rows().write.mode("overwrite").parquet(f"{self.path}-upto/batch={number}")

    def _batches(self, path: str) -> list[int]:
        """The numbers of the batches that were written to their end."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        at = hadoop(path)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        return [int(x.getPath().getName().split("=")[1]) for x in fs.listStatus(at) if "=" in x.getPath().getName() and fs.exists(hadoop(x.getPath(), "_SUCCESS"))]

    def rows(self) -> DataFrame | None:
        """The latest row of every key; None before the first batch."""
        written = self._batches(self.path)
        if not written:
            return None
        upto = max(self._batches(f"{self.path}-upto"), default=-1)
        read = lambda path, n: self.spark.read.parquet(f"{path}/batch={n}").withColumn("batch", F.lit(n).cast("long"))
        parts = [read(self.path, n) for n in sorted(written) if n > upto] + ([read(f"{self.path}-upto", upto)] if upto >= 0 else [])
        return self._latest(reduce(DataFrame.unionByName, parts), "batch").drop("batch")


def _run(stream: DataFrame, each: Callable[[DataFrame, int], None], base: str, mode: str = "append") -> None:
    stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{base}/log").outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def journal_upsert(stream: DataFrame, key: list[str], order: list[str], base: str | None = None) -> DataFrame:
    """The latest row of each key of a finite stream of checkpoints, merged batch by batch. ``base``: the folder of an earlier run
    that this one goes on from."""
    spark = stream.sparkSession
    base = base or shared_path(spark, "journal")
    journal = Journal(spark, f"{base}/rows", key, order)
    _run(stream, journal.put, base)
    rows = journal.rows()
    return rows if rows is not None else spark.createDataFrame([], stream.schema)


def live_coverage(stream: DataFrame) -> DataFrame:
    """(playlist_id, tracks, on_disk, failed, percent, done) after a finite stream of changes (playlist_id, track, state, t, event_id).

    A batch recounts only the playlists that it names; a track's latest state counts: ``saved``, ``failed`` or any other.
    """
    spark = stream.sparkSession
    base = shared_path(spark, "coverage")
    tracks = Journal(spark, f"{base}/tracks", ["playlist_id", "track"], ["t", "event_id"])
    counts = Journal(spark, f"{base}/counts", ["playlist_id"], ["tracks"])

    def each(batch: DataFrame, number: int) -> None:
        tracks.put(batch, number)
        named = batch.select("playlist_id").distinct()
        counts.put(coverage_of(tracks.rows().join(named, "playlist_id", "left_semi")), number)

    _run(stream, each, base)
    rows = counts.rows()
    return rows if rows is not None else coverage_of(spark.createDataFrame([], stream.schema))


def coverage_of(states: DataFrame) -> DataFrame:
    of = states.groupBy("playlist_id").agg(F.count("*").alias("tracks"), F.count_if(F.col("state") == "saved").alias("on_disk"), F.count_if(F.col("state") == "failed").alias("failed"))
    percent = F.floor(F.col("on_disk") * 100 / F.col("tracks") + 0.5)
    return of.select("playlist_id", "tracks", "on_disk", "failed", percent.cast("long").alias("percent"), (F.col("on_disk") + F.col("failed") >= F.col("tracks")).alias("done"))
