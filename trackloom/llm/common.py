"""Helpers shared by the training-data operators: shared storage, written intermediate tables, bounded worker memory."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids that one broadcast may hold; beyond that a join shuffles.
BROADCAST_ROWS = 1_000_000
_LOCAL: dict[str, str] = {}
_WORKER: dict = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local master (tests) gets a temporary folder; on a cluster this raises, for no local folder is shared.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="trackloom-", dir="/tmp/checkpoints")
    return _LOCAL[app]


def scratch(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark)}/trackloom/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of materialized ``tables`` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if name.startswith(shared_dir(spark)) or name.replace("file:///", "file:/").startswith(shared_dir(spark).replace("file:///", "file:/")):
                _delete(spark, name)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_scratch(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this library; call it once results are saved."""
    _delete(spark, f"{shared_dir(spark)}/trackloom")


#: Bounds of the Arrow batches sent to Python, by rows and by bytes, so that long texts don't add up in a worker.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings that hold while tables are written, and what was there before afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def small_batches(spark: SparkSession) -> None:
    """Sets ``BATCHES`` for good, for results that run after an operator returned: Spark reads them when a plan runs, not when it is made."""
    for k, v in BATCHES.items():
        spark.conf.set(k, v)


def worker_state(key: str, make: Callable):
    """What this Python worker keeps between batches and tasks under ``key``. Another key replaces it: a reused worker holds
    the caches of one operator at a time."""
    if _WORKER.get("key") != key:
        _WORKER.clear()
        _WORKER.update(key=key, value=make())
    return _WORKER["value"]


def map_rows(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` whatever the names of its columns (dots, repeats): ``run`` gets them as c0, c1, ..."""
    return df.toDF(*(f"c{k}" for k in range(len(df.columns)))).mapInArrow(run, schema)


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id is in ``ids`` (doc_id): by broadcast if those are few enough, else by a
    shuffle. Rows go as one struct, so that no name of their columns matters."""
    few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    ids = ids.select(F.col("doc_id").alias("id"))
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("id"))
    return rows.join(F.broadcast(ids) if few else ids, "id", "left_anti").select("doc.*")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *keep: str) -> DataFrame:
    """``doc_id`` (long), ``text`` (null becomes empty) and the columns ``keep``; whatever else the table has is left behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *keep)
