"""Catalog views over the driver tables, as DataFrames and (``SQL``) as the same projections for an oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.sources.shared import dealt, tasks_for

LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def playlist(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", 4).when(F.col("o_orderstatus") == "O", 0).otherwise(5)
    return table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("playlist_id"), F.col("c_name").alias("name"), F.col("o_custkey").alias("rank"), (F.col("o_orderpriority") == "5-LOW").alias("skipped"), status.alias("status"), F.col("o_orderdate").alias("last_played"))


def occurrence(spark: SparkSession, d: str) -> DataFrame:
    """``seq`` numbers a playlist's rows: whole rows are unique, so their order is total."""
    w = Window.partitionBy("l_orderkey").orderBy(*LINE)
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("playlist_id"), F.col("l_partkey").alias("song_id"), F.col("l_linenumber").alias("n"), F.col("l_suppkey").alias("folder"), F.row_number().over(w).alias("seq"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))


def song(spark: SparkSession, d: str) -> DataFrame:
    ms = F.when(F.col("p_partkey") % 17 != 0, (60 + F.pmod(F.col("p_partkey") * 37, F.lit(600))) * 1000)
    return table(spark, d, "part").select(F.col("p_partkey").alias("song_id"), F.col("p_brand").alias("artist"), F.col("p_name").alias("name"), F.col("p_type").alias("bucket"), ms.alias("expected_ms"))


def candidate(spark: SparkSession, d: str) -> DataFrame:
    """``place`` orders a song's candidates: query, then rank by order and row."""
    lines = table(spark, d, "lineitem").withColumn("query_no", F.col("l_linenumber") % 3)
    w = Window.partitionBy("l_partkey").orderBy("query_no", *LINE)
    lines = lines.select(F.col("l_partkey").alias("song_id"), "query_no", F.col("l_suppkey").alias("video"), "l_quantity", "l_returnflag", F.row_number().over(w).alias("place"))
    seconds = F.when(F.col("l_returnflag") != "R", F.col("expected_ms") / 1000 + (F.col("l_quantity") - 25) * 0.6)
    return lines.join(song(spark, d).select("song_id", "expected_ms"), "song_id").select("song_id", "query_no", "place", "video", "expected_ms", seconds.alias("seconds"))


def ledger(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").where("l_linestatus = 'F' and l_quantity > 40").select(F.col("l_partkey").alias("song_id"), F.col("l_suppkey").alias("video")).distinct()
    return lines.join(song(spark, d).select("song_id", "expected_ms"), "song_id")


def file(spark: SparkSession, d: str) -> DataFrame:
    """One row per (folder, song): physical ids are shared on purpose."""
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_shipdate", "l_quantity", "l_returnflag")
    rows = dealt(rows, tasks_for(rows), "l_suppkey", "l_partkey")
    lines = rows.groupBy(F.col("l_suppkey").alias("folder"), F.col("l_partkey").alias("song_id")).agg(F.min("l_shipdate").alias("mtime"), F.min("l_quantity").alias("q"), F.max(F.when(F.col("l_returnflag") != "R", 1).otherwise(0)).alias("known"))
    seconds = F.when(F.col("known") == 1, F.col("expected_ms") / 1000 + (F.col("q") - 25) * 0.6)
    both = lines.join(song(spark, d).select("song_id", "expected_ms"), "song_id")
    return both.select(F.concat(F.lit("f"), F.col("folder"), F.lit("/"), F.col("song_id")).alias("path"), "folder", "song_id", (F.col("folder") % 3).alias("dev"), (F.col("song_id") % 500).alias("ino"), ((F.col("song_id") % 500 + 1) * 1000).alias("size"), "mtime", "expected_ms", seconds.alias("seconds"))


#: Event types in the log's words.
TYPES = {"purchase": "mp3_verified", "click": "download_start", "view": "search_ok", "error": "block", "signup": "pace_change"}


def event(spark: SparkSession, d: str) -> DataFrame:
    kind = F.create_map(*(F.lit(x) for p in TYPES.items() for x in p))[F.col("event_type")]
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").select("event_id", F.col("ts").alias("t"), F.col("user_id").alias("key"), kind.alias("type"), k.alias("k"), "value")


SQL = {
    "playlist": "SELECT o_orderkey AS playlist_id, c_name AS name, o_custkey AS rank, (o_orderpriority = '5-LOW') AS skipped, CASE o_orderstatus WHEN 'F' THEN 4 WHEN 'O' THEN 0 ELSE 5 END AS status, o_orderdate AS last_played FROM orders JOIN customer ON o_custkey = c_custkey",
    "occurrence": f"SELECT l_orderkey AS playlist_id, l_partkey AS song_id, l_linenumber AS n, l_suppkey AS folder, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE)}) AS seq, l_quantity AS quantity, l_discount AS discount, l_tax AS tax FROM lineitem",
    "song": "SELECT p_partkey AS song_id, p_brand AS artist, p_name AS name, p_type AS bucket, CASE WHEN p_partkey % 17 <> 0 THEN (60 + (p_partkey * 37) % 600) * 1000 END AS expected_ms FROM part",
    "candidate": f"SELECT song_id, query_no, place, video, expected_ms, CASE WHEN l_returnflag <> 'R' THEN expected_ms / 1000.0 + (l_quantity - 25) * 0.6 END AS seconds FROM (SELECT l_partkey AS song_id, l_linenumber % 3 AS query_no, l_suppkey AS video, l_quantity, l_returnflag, row_number() OVER (PARTITION BY l_partkey ORDER BY l_linenumber % 3, {', '.join(LINE)}) AS place FROM lineitem) JOIN song USING (song_id)",
    "ledger": "SELECT DISTINCT l_partkey AS song_id, l_suppkey AS video, expected_ms FROM lineitem JOIN song ON song_id = l_partkey WHERE l_linestatus = 'F' AND l_quantity > 40",
    "file": "SELECT concat('f', folder, '/', song_id) AS path, folder, song_id, folder % 3 AS dev, song_id % 500 AS ino, (song_id % 500 + 1) * 1000 AS size, mtime, expected_ms, CASE WHEN known = 1 THEN expected_ms / 1000.0 + (q - 25) * 0.6 END AS seconds FROM (SELECT l_suppkey AS folder, l_partkey AS song_id, min(l_shipdate) AS mtime, min(l_quantity) AS q, max(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END) AS known FROM lineitem GROUP BY 1, 2) JOIN song USING (song_id)",
    "event": f"SELECT event_id, ts AS t, user_id AS \"key\", CASE event_type {' '.join(f'WHEN {chr(39)}{a}{chr(39)} THEN {chr(39)}{b}{chr(39)}' for a, b in TYPES.items())} END AS type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, value FROM events",
}


def with_views(sql: str) -> str:
    """The query after definitions of the views that it names (and those that they need)."""
    need = [v for v in SQL if f" {v}" in sql.replace("\n", " ")]
    if {"candidate", "ledger", "file"} & set(need) and "song" not in need:
        need.insert(0, "song")
    need.sort(key=lambda v: v != "song")
    recursive = "RECURSIVE " if sql.startswith("WITH RECURSIVE ") else ""
    own = sql.removeprefix(f"WITH {recursive}") if sql.startswith("WITH ") else None
    heads = [f'"{v}" AS ({SQL[v]})' for v in need]
    return f"WITH {recursive}" + ", ".join(heads) + (f", {own}" if own else f" {sql}") if heads else sql
