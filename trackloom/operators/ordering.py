"""Places in a total order, counted without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.sources.shared import materialize


def placed(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """``rows`` with their place, from 1, in a total ``order``: ranges are sorted apart, and the counts of the ranges before are
    added. The table of counts has a row a range."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(rows.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    out = dealt.withColumn(name, own).join(F.broadcast(counts.select("_range", before.alias("_before"))), "_range")
    return out.withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before")
