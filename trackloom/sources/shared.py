"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
#: Rows of a shuffled table that one task gets, about.
TASK_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a local master (tests) gets one temporary folder an application; on a cluster
    this raises, for no local folder is shared."""
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


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark)}/trackloom/{label}-{uuid.uuid4().hex}"


def tasks_for(rows: DataFrame) -> int | None:
    """Tasks for a shuffle of ``rows`` by their number, if that takes more than the session's; else None. A plain scan is counted from
    its files' footers."""
    tasks = -(-rows.count() // TASK_ROWS)
    return tasks if tasks > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def dealt(rows: DataFrame, tasks: int | None, *by: str) -> DataFrame:
    """``rows`` dealt to ``tasks`` by the columns ``by``, so that what a task sorts or groups by them doesn't grow with the table;
    without a number they are left to the session."""
    return rows.repartition(tasks, *by) if tasks else rows


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back: cuts lineage and survives lost executors."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
