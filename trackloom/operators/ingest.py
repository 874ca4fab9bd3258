"""Documents to rows: paginated pulls, nested items, search results, status snapshots. Input is JSON text, a document a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = "pull long, offset long, `limit` long, total long, next string, items array<struct<id: string>>"
TRACK = "id: string, name: string, type: string, artists: array<struct<name: string>>, album: struct<name: string, images: array<struct<url: string>>>"
ITEM = f"track struct<{TRACK}>, item struct<{TRACK}>, id string, name string, type string, artists array<struct<name: string>>, album struct<name: string, images: array<struct<url: string>>>, added_at string"
RESULT = "query string, original_url string, entries array<struct<id: string, url: string, title: string, duration: double>>"
PHASES = ["running", "waiting-for-recovery", "draining"]


def parsed(lines: DataFrame, schema: str, *keep: str) -> DataFrame:
    """``lines`` (text, ``keep``) with the fields of ``schema``; a line that is no JSON object has ``bad`` true and null fields."""
    doc = F.from_json("text", f"{schema}, bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"})
    rows = lines.select(*keep, doc.alias("doc"))
    return rows.select(*keep, "doc.*").withColumn("bad", F.col("bad").isNotNull())


def assemble_pages(lines: DataFrame) -> DataFrame:
    """Per pull: pages, items, and whether its pages make up the whole; else the first reason why not.

    Pages must start where the ones before end, agree on the total, repeat no id, and the last one must reach the total
    and name no next page.
    """
    pages = parsed(lines, PAGE).where("not bad and pull is not null")
    before = Window.partitionBy("pull").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    n = F.size("items")
    checked = pages.select("pull", "offset", "total", "next", n.alias("n"), (F.coalesce(F.sum(n).over(before), F.lit(0)) != F.col("offset")).alias("gap"), (~F.col("limit").between(1, 50) | (n > F.col("limit"))).alias("bad"))
    ids = pages.select("pull", F.explode("items.id").alias("id")).groupBy("pull").agg((F.count("*") > F.count_distinct("id")).alias("repeated"))
    of = checked.groupBy("pull").agg(
        F.count("*").alias("pages"),
        F.sum("n").alias("items"),
        F.bool_or(F.col("gap") | F.col("bad")).alias("gap"),
        (F.count_distinct("total") > 1).alias("changed"),
        F.max_by(F.struct("total", "next"), "offset").alias("last"),
    )
    reason = F.when(F.col("gap"), "page gap or repeated page").when(F.col("changed"), "library changed during pagination").when(F.coalesce("repeated", F.lit(False)), "playlist repeated during pagination")
    reason = reason.when(F.col("last.next").isNotNull() | (F.col("items") != F.col("last.total")), "page count does not match the reported total")
    return of.join(ids, "pull", "left").select("pull", "pages", "items", reason.isNull().alias("complete"), reason.alias("reason"))


def normalize_items(lines: DataFrame) -> DataFrame:
    """Flat rows of nested items (playlist_id, n, text): of ``track``, ``item`` or the item itself; episodes and nameless ones go."""
    rows = parsed(lines, ITEM, "playlist_id", "n")
    self_ = F.struct("id", "name", "type", "artists", "album")
    t = F.coalesce("track", "item", self_)
    rows = rows.select("playlist_id", "n", "added_at", F.when(t["type"] != "episode", t).when(t["type"].isNull(), t).otherwise(F.col("track")).alias("t"))
    artists = F.array_join(F.transform(F.coalesce("t.artists", F.array().cast("array<struct<name: string>>")), lambda a: F.coalesce(a["name"], F.lit(""))), ", ")
    kept = rows.where("t is not null and t.name <> ''")
    return kept.select("playlist_id", "n", "t.id", "t.name", artists.alias("artist"), F.col("t.album.name").alias("album"), F.get("t.album.images", F.lit(0))["url"].alias("cover_url"), "added_at")


def search_results(lines: DataFrame, most: int = 5) -> DataFrame:
    """(line, state, place, video, seconds) of result documents (line, text): a row for each new id of a document in its
    order, at most as many as it asked for; one row with state ``empty`` or ``malformed`` for a document without."""
    docs = parsed(lines, RESULT, "line")
    asked = F.regexp_extract("original_url", r"^ytsearch(\d+):", 1).try_cast("int")
    docs = docs.select("line", "entries", (F.col("bad") | (F.coalesce("query", F.lit("")) == "")).alias("malformed"), F.when(asked.between(1, 50), asked).otherwise(most).alias("most"))
    url_id = F.nullif(F.regexp_extract("e.url", r"[?&]v=([A-Za-z0-9_-]{11})(?:&|$)", 1), F.lit(""))
    own_id = F.when(F.col("e.id").rlike(r"^[A-Za-z0-9_-]{11}$"), F.col("e.id"))
    found = docs.where("not malformed").select("line", "most", F.posexplode("entries").alias("at", "e")).select("line", "most", "at", F.coalesce(url_id, own_id).alias("video"), F.when(F.col("e.duration") > 0, F.col("e.duration")).alias("seconds")).where("video is not null")
    one = found.groupBy("line", "video").agg(F.min_by(F.struct("at", "most", "seconds"), "at").alias("b")).select("line", "video", "b.*")
    ranked = one.withColumn("place", F.row_number().over(Window.partitionBy("line").orderBy("at"))).where("place <= most")
    out = ranked.select("line", F.lit("result").alias("state"), "place", "video", F.round("seconds", 6).alias("seconds"))
    none = docs.where("malformed or size(entries) = 0").select("line", F.when(F.col("malformed"), "malformed").otherwise("empty").alias("state"), F.lit(None).cast("int").alias("place"), F.lit(None).cast("string").alias("video"), F.lit(None).cast("double").alias("seconds"))
    return out.union(none)


def snapshot_fresh(status: DataFrame, handoff: DataFrame, now: Column) -> DataFrame:
    """Status rows (id, key, at, run, pid, phase, lease) with the phase to show and whether it is fresh: at most 90 s old (or
    5 s ahead), of the run and process that the key's ``handoff`` (key, run, pid, phase) names as owner, and known."""
    met = status.join(handoff.select("key", F.col("run").alias("own_run"), F.col("pid").alias("own_pid"), F.col("phase").alias("own_phase")), "key", "left")
    age = F.unix_seconds(now) - F.unix_seconds("at")
    same = (F.col("run") == F.col("own_run")) & (F.col("run") != "") & (F.col("pid") == F.col("own_pid")) & (F.col("pid") > 0) & (F.col("own_phase") == "owned")
    fresh = F.coalesce(same & age.between(-5, 90) & F.col("phase").isin(PHASES), F.lit(False))
    owned = F.col("lease") == "owned"
    return met.select("id", F.when(~owned, None).when(fresh, F.col("phase")).otherwise("unknown").alias("phase"), (owned & fresh).alias("fresh"))
