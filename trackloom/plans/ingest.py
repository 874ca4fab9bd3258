"""Queries of the ingest operators over documents that Spark derives from the driver tables, and their SQL.

The derived documents hold every kind of damage by a rule on a row's id, so that each verdict occurs at every scale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import SparkSession as S

from trackloom.functions import messages
from trackloom.operators import ingest
from trackloom.sources import views
from trackloom.sources.views import with_views


def one_of(n: Column, *values: Column | str | None) -> Column:
    """The value at place n of ``values``."""
    return F.element_at(F.array(*(v if isinstance(v, Column) else F.lit(v) for v in values)), (n + 1).cast("int"))


# ---- paginated pulls: the playlists of each customer, five a page, damaged by the customer's id modulo 7


def _pages(s: S, d: str) -> DataFrame:
    own = views.playlist(s, d).select(F.col("rank").alias("pull"), "playlist_id")
    w = Window.partitionBy("pull")
    rows = own.withColumn("at", F.row_number().over(w.orderBy("playlist_id")) - 1).withColumn("total", F.count("*").over(w)).withColumn("first", F.min("playlist_id").over(w))
    page, kind = F.floor(F.col("at") / 5), F.col("pull") % 7
    id_ = F.when((kind == 3) & (F.col("at") == 5), F.col("first")).otherwise(F.col("playlist_id"))
    rows = rows.withColumn("page", page).groupBy("pull", "page").agg(F.first("total").alias("total"), F.transform(F.array_sort(F.collect_list(F.struct("at", id_.alias("id")))), lambda x: F.struct(x["id"].cast("string").alias("id"))).alias("items"))
    last = (F.col("page") + 1) * 5 >= F.col("total")
    rows = rows.where(~((kind == 1) & (F.col("page") == 1)))
    total = F.col("total") + F.when((kind == 2) & (F.col("page") == 1), 1).otherwise(0)
    doc = F.struct("pull", (F.col("page") * 5).alias("offset"), F.lit(5).alias("limit"), total.alias("total"), F.when(~last | (kind == 4), F.lit("more")).alias("next"), "items")
    return rows.select(F.to_json(doc).alias("text"))


PAGES = """base AS (SELECT rank AS pull, playlist_id, row_number() OVER (PARTITION BY rank ORDER BY playlist_id) - 1 AS pos, count(*) OVER (PARTITION BY rank) AS total, min(playlist_id) OVER (PARTITION BY rank) AS first FROM playlist),
 entries AS (SELECT pull, pos // 5 AS page, CASE WHEN pull % 7 = 3 AND pos = 5 THEN first ELSE playlist_id END AS id, total + CASE WHEN pull % 7 = 2 AND pos // 5 = 1 THEN 1 ELSE 0 END AS total, CASE WHEN (pos // 5 + 1) * 5 < total OR pull % 7 = 4 THEN 'more' END AS next FROM base WHERE NOT (pull % 7 = 1 AND pos // 5 = 1)),
 pages AS (SELECT pull, page, count(*) AS n, any_value(total) AS total, any_value(next) AS next FROM entries GROUP BY 1, 2),
 run AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY pull ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pages),
 pulls AS (SELECT pull, count(*) AS pages, CAST(sum(n) AS BIGINT) AS items, bool_or(before <> page * 5) AS gap, count(DISTINCT total) > 1 AS changed, arg_max(total, page) AS last_total, bool_or(page = (SELECT max(page) FROM pages q WHERE q.pull = run.pull) AND next IS NOT NULL) AS more FROM run GROUP BY 1),
 twice AS (SELECT pull, count(*) > count(DISTINCT id) AS repeated FROM entries GROUP BY 1)"""
PAGES_SQL = f"""WITH {PAGES}, judged AS (SELECT pull, pages, items, CASE WHEN gap THEN 'page gap or repeated page' WHEN changed THEN 'library changed during pagination' WHEN repeated THEN 'playlist repeated during pagination'
 WHEN more OR items <> last_total THEN 'page count does not match the reported total' END AS reason FROM pulls JOIN twice USING (pull)) SELECT pull, pages, items, reason IS NULL AS complete, reason FROM judged"""


# ---- nested items: a song stands under track, under item or by itself; some are episodes or nameless


def _nested(s: S, d: str) -> DataFrame:
    rows = views.occurrence(s, d).join(views.song(s, d), "song_id")
    k = F.col("song_id") % 11
    t = F.struct(
        F.col("song_id").cast("string").alias("id"),
        F.when(k == 5, F.lit("")).when(k != 6, F.col("name")).alias("name"),
        F.when(k.isin(2, 3, 4), "episode").when(k != 7, "track").alias("type"),
        F.when(k != 8, F.array(F.struct(F.col("artist").alias("name")), F.struct(F.when(k != 9, F.lit("Second")).alias("name")))).alias("artists"),
        F.struct(F.col("bucket").alias("name"), F.when(k % 2 == 0, F.array(F.struct(F.concat(F.lit("http://c/"), "song_id").alias("url")))).alias("images")).alias("album"),
    )
    where = F.col("song_id") % 3
    added = F.struct(F.concat(F.lit("2024-01-"), F.lpad((F.col("seq") % 28 + 1).cast("string"), 2, "0")).alias("added_at"))
    nested = [F.to_json(F.struct(t.alias(c), added["added_at"].alias("added_at"))) for c in ("track", "item")]
    own = F.to_json(F.struct(*(t[f].alias(f) for f in ("id", "name", "type", "artists", "album")), added["added_at"].alias("added_at")))
    return rows.select("playlist_id", F.col("seq").alias("n"), F.when(where == 0, nested[0]).when(where == 1, nested[1]).otherwise(own).alias("text"))


NESTED_SQL = """SELECT playlist_id, seq AS n, CAST(song_id AS VARCHAR) AS id, name, CASE WHEN song_id % 11 = 8 THEN '' ELSE concat(artist, ', ', CASE WHEN song_id % 11 <> 9 THEN 'Second' ELSE '' END) END AS artist, bucket AS album,
 CASE WHEN song_id % 11 % 2 = 0 THEN concat('http://c/', song_id) END AS cover_url, concat('2024-01-', lpad(CAST(seq % 28 + 1 AS VARCHAR), 2, '0')) AS added_at
 FROM occurrence JOIN song USING (song_id) WHERE song_id % 11 NOT IN (5, 6) AND NOT (song_id % 11 IN (2, 3, 4) AND song_id % 3 <> 0)"""


# ---- search results: a song's candidates as one document; some are cut off, some empty


def _results(s: S, d: str) -> DataFrame:
    c = views.candidate(s, d)
    id_ = F.lpad(F.col("video").cast("string"), 11, "v")
    entry = F.struct("place", F.when(F.col("place") % 3 != 0, id_).otherwise("short").alias("id"), F.when(F.col("place") % 3 == 0, F.concat(F.lit("https://www.youtube.com/watch?v="), id_)).alias("url"), F.col("seconds").alias("duration"))
    docs = c.groupBy("song_id").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    entries = F.transform("e", lambda x: F.struct(x["id"].alias("id"), x["url"].alias("url"), F.lit("t").alias("title"), x["duration"].alias("duration")))
    k = F.col("song_id")
    asked = F.when(k % 5 == 0, "ytsearch3:q").when(k % 5 == 1, "ytsearch90:q").when(k % 5 == 2, "ytsearch10:q")
    text = F.to_json(F.struct(F.when(k % 17 != 0, F.concat(F.lit("q"), k)).alias("query"), asked.alias("original_url"), F.when(k % 13 != 0, entries).otherwise(F.slice(entries, 1, 0)).alias("entries")))
    return docs.select(k.alias("line"), F.when(k % 11 == 0, F.substring(text, F.lit(1), F.length(text) - 3)).otherwise(text).alias("text"))


RESULTS_SQL = """WITH docs AS (SELECT DISTINCT song_id AS line, song_id % 11 = 0 OR song_id % 17 = 0 AS malformed, song_id % 13 = 0 AS empty, CASE song_id % 5 WHEN 0 THEN 3 WHEN 2 THEN 10 ELSE 5 END AS most FROM candidate),
 one AS (SELECT c.song_id AS line, c.video, min(c.place) AS at, arg_min(coalesce(c.seconds, -1), c.place) AS seconds FROM candidate c GROUP BY 1, 2),
 ranked AS (SELECT o.line, o.video, o.seconds, d.most, row_number() OVER (PARTITION BY o.line ORDER BY o.at) AS place FROM one o JOIN docs d ON d.line = o.line WHERE NOT d.malformed AND NOT d.empty)
 SELECT line, 'result' AS state, place, lpad(CAST(video AS VARCHAR), 11, 'v') AS video, CASE WHEN seconds > 0 THEN round(seconds, 6) END AS seconds FROM ranked WHERE place <= most
 UNION ALL SELECT line, CASE WHEN malformed THEN 'malformed' ELSE 'empty' END, NULL, NULL, NULL FROM docs WHERE malformed OR empty"""


# ---- messages: a template by the document's id, before its text

TEMPLATES = [
    "[download] 48.0% of 2.95MiB at 429.51KiB/s", "HTTP Error 429: Too Many Requests", "no route to host (429)", "Read timed out", "Sign in to confirm your age", "ffprobe unavailable", "MP3 tags could not be written", "write: ENOSPC",
    "SQLITE_BUSY", "Requested format is not available", "HTTP Error 403: Forbidden", "Private video", "cookies file missing", "CLI stopping", "Local disk is full", "took 429.5 s", "code 429", "nothing known",
]


def _messages(s: S, d: str) -> DataFrame:
    m = one_of(F.col("doc_id") % len(TEMPLATES), *TEMPLATES)
    return views.table(s, d, "documents").select("doc_id", F.when(F.col("doc_id") % 36 == 14, m).otherwise(F.concat(m, F.lit("\n"), F.coalesce("text", F.lit("")))).alias("message"))


def _like(pattern: str) -> str:
    return f"regexp_matches(m, '{pattern}', 'i')"


# the expression has no look-ahead: a number that another figure follows after a dot is spelled out
LIMIT_SQL = messages.RATE_LIMIT.replace(r"\b429\b(?!\.\d)", r"\b429(?:$|[^\w.]|\.(?:$|[^0-9]))")
CLASS_SQL = " ".join(
    [f"CASE WHEN m IN ('{messages.CANCELLED}', '{messages.LIMITED}', '{messages.OFFLINE}', '{messages.UNKNOWN}', {', '.join(repr(n) for _, n in messages.CLASSES)}) THEN m"]
    + [f"WHEN {_like('CLI stopping|YouTube admission cancelled|CLI admission cancelled')} THEN '{messages.CANCELLED}'"]
    + [f"WHEN NOT {_like(messages.LOCAL_NETWORK)} AND regexp_matches(regexp_replace(m, '^[\\t ]*\\[download\\].*$', '', 'gim'), '{LIMIT_SQL}', 'i') THEN '{messages.LIMITED}'", f"WHEN {_like(messages.LOCAL_NETWORK)} THEN '{messages.OFFLINE}'"]
    + [f"WHEN {_like(p)} THEN '{n}'" for p, n in messages.CLASSES]
    + [f"ELSE '{messages.UNKNOWN}' END"]
)
MESSAGES_SQL = f"WITH t AS (SELECT [{', '.join(repr(t) for t in TEMPLATES)}] AS t), msg AS (SELECT doc_id, t.t[doc_id % {len(TEMPLATES)} + 1] || CASE WHEN doc_id % 36 = 14 THEN '' ELSE chr(10) || coalesce(text, '') END AS m FROM documents, t) SELECT doc_id, {CLASS_SQL} AS class FROM msg"


# ---- attributions and kinds


def _labels(s: S, d: str) -> DataFrame:
    p = views.playlist(s, d)
    n = F.col("playlist_id")
    subtitle = one_of(n % 6, F.concat(F.lit("Playlist • "), "name"), F.concat(F.lit("playlist · Made for "), "name"), F.concat(F.lit("Album • "), "name"), None, "Playlist •  ", "Made for you")
    owner = one_of(n % 4, F.concat(F.lit("owner "), F.col("rank").cast("string")), None, "  ", None)
    uri = one_of(n % 9, "spotify:playlist:1", "spotify:user:x:collection:tracks", "spotify:album:2", "spotify:artist:3", "spotify:station:4", "x:RADIO:5", "spotify:collection:6", None, "other")
    title = one_of(n % 7, "Liked Songs", "Rock Radio", "Daily Mix 3", F.col("name"), None, F.col("name"), F.col("name"))
    return p.select("playlist_id", subtitle.alias("subtitle"), owner.alias("owner"), uri.alias("uri"), title.alias("title"))


LABELS = """labels_of AS (SELECT playlist_id, [concat('Playlist • ', name), concat('playlist · Made for ', name), concat('Album • ', name), NULL, 'Playlist •  ', 'Made for you'][playlist_id % 6 + 1] AS subtitle,
 [concat('owner ', rank), NULL, '', NULL][playlist_id % 4 + 1] AS owner, ['spotify:playlist:1', 'spotify:user:x:collection:tracks', 'spotify:album:2', 'spotify:artist:3', 'spotify:station:4', 'x:RADIO:5', 'spotify:collection:6', NULL, 'other'][playlist_id % 9 + 1] AS uri,
 ['Liked Songs', 'Rock Radio', 'Daily Mix 3', name, NULL, name, name][playlist_id % 7 + 1] AS title, name FROM playlist)"""
ATTRIBUTION_SQL = f"""WITH {LABELS}, named AS (SELECT playlist_id, nullif(owner, '') AS given, CASE playlist_id % 6 WHEN 0 THEN name WHEN 1 THEN 'Made for ' || name END AS label, CASE playlist_id % 6 WHEN 1 THEN name END AS made_for FROM labels_of)
 SELECT playlist_id, coalesce(given, CASE WHEN made_for IS NULL THEN label END) AS owner, CASE WHEN given IS NOT NULL THEN 'structured' WHEN made_for IS NULL AND label IS NOT NULL THEN 'saved-subtitle' END AS source, made_for FROM named"""
KIND_SQL = f"""WITH {LABELS}, u AS (SELECT playlist_id, coalesce(uri, '') AS u, coalesce(title, '') AS n, subtitle FROM labels_of) SELECT playlist_id, CASE WHEN u LIKE 'spotify:playlist:%' THEN 'playlist' WHEN u LIKE '%collection:tracks%' OR n = 'Liked Songs' THEN 'liked_songs'
 WHEN u LIKE 'spotify:album:%' THEN 'album' WHEN u LIKE 'spotify:artist:%' THEN 'artist' WHEN u LIKE '%station%' OR u ILIKE '%radio%' OR n LIKE '% Radio' THEN 'radio' WHEN n ILIKE '%daily mix%' OR subtitle LIKE 'Made for%' THEN 'mix' WHEN u LIKE 'spotify:collection:%' THEN 'collection' ELSE 'other' END AS kind FROM u"""


# ---- chapters: the lines of a supplier in their order


def _chapters(s: S, d: str) -> DataFrame:
    start = F.col("l_quantity") * 4.0
    end = start + F.round(F.col("l_discount") * 100 - 2) * 10
    line = F.struct(*views.LINE, start.alias("start"), F.when(F.col("l_linenumber") != 7, end).alias("end"))
    of = views.table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("folder")).agg(F.array_sort(F.collect_list(line)).alias("c"))
    chapters = F.transform("c", lambda x: F.struct(x["start"].cast("double").alias("start"), x["end"].cast("double").alias("end")))
    total = F.when(F.col("folder") % 9 != 0, 150.0 + F.col("folder") % 100)
    kept = messages.chapters_valid(chapters, total)
    return of.select("folder", F.size(kept).alias("kept"), F.round(F.aggregate(kept, F.lit(0.0), lambda a, c: a + c["end"] - c["start"]), 4).alias("seconds"))


CHAPTERS_SQL = f"""WITH c AS (SELECT l_suppkey AS folder, row_number() OVER (PARTITION BY l_suppkey ORDER BY {', '.join(views.LINE)}) AS pos, l_quantity * 4.0 AS start, CASE WHEN l_linenumber <> 7 THEN l_quantity * 4.0 + round(l_discount * 100 - 2) * 10 END AS "end",
 CASE WHEN l_suppkey % 9 <> 0 THEN 150.0 + l_suppkey % 100 END AS total FROM lineitem), k AS (SELECT *, pos <= 200 AND start >= 0 AND "end" > start AND (total IS NULL OR "end" <= total + 1) AS ok FROM c)
 SELECT folder, CAST(count(*) FILTER (ok) AS INTEGER) AS kept, round(coalesce(sum("end" - start) FILTER (ok), 0.0), 4) AS seconds FROM k GROUP BY 1"""


# ---- snapshots: each event as a status row; a key's owner by its id


def _snapshots(s: S, d: str) -> DataFrame:
    e = views.event(s, d)
    follows = F.col("event_id") % 3 != 0
    run = F.concat(F.lit("r"), F.when(follows, F.col("key") % 5).otherwise(F.coalesce("k", F.lit(0)) % 5))
    pid = F.when(follows, F.col("key") % 20).otherwise(F.coalesce("k", F.lit(0)) - 2)
    phase = one_of(F.col("event_id") % 4, *ingest.PHASES, "starting")
    status = e.select(F.col("event_id").alias("id"), "key", F.col("t").cast("timestamp").alias("at"), run.alias("run"), pid.cast("long").alias("pid"), phase.alias("phase"), F.when(F.col("key") % 4 != 0, "owned").otherwise("available").alias("lease"), (F.col("event_id") % 110 - 9).alias("age"))
    handoff = e.select("key").distinct().select("key", F.concat(F.lit("r"), F.col("key") % 5).alias("run"), (F.col("key") % 20).alias("pid"), F.when(F.col("key") % 7 == 0, "released").otherwise("owned").alias("phase"))
    return ingest.snapshot_fresh(status, handoff, F.timestamp_seconds(F.unix_seconds("at") + F.col("age")))


SNAPSHOT_SQL = """WITH e AS (SELECT event_id AS id, "key" AS k2, event_id % 3 <> 0 AS follows, coalesce(k, 0) AS k, event_id % 110 - 9 AS age, ['running', 'waiting-for-recovery', 'draining', 'starting'][event_id % 4 + 1] AS phase FROM event),
 f AS (SELECT id, k2 % 4 <> 0 AS owned, phase, (follows OR k % 5 = k2 % 5) AND (CASE WHEN follows THEN k2 % 20 ELSE k - 2 END) = k2 % 20 AND k2 % 20 > 0 AND k2 % 7 <> 0 AND age BETWEEN -5 AND 90 AND phase <> 'starting' AS fresh FROM e)
 SELECT id, CASE WHEN owned THEN CASE WHEN fresh THEN phase ELSE 'unknown' END END AS phase, owned AND fresh AS fresh FROM f"""


QUERIES = {
    "src_page_assembly": lambda s, d: ingest.assemble_pages(_pages(s, d)),
    "src_normalize_items": lambda s, d: ingest.normalize_items(_nested(s, d)),
    "src_search_results": lambda s, d: ingest.search_results(_results(s, d)),
    "fn_error_class": lambda s, d: _messages(s, d).select("doc_id", messages.error_class(F.col("message")).alias("class")),
    "fn_attribution": lambda s, d: _labels(s, d).select("playlist_id", messages.attribution(F.col("owner"), F.col("subtitle")).alias("a")).select("playlist_id", "a.*"),
    "fn_item_kind": lambda s, d: _labels(s, d).select("playlist_id", messages.item_kind(F.col("uri"), F.col("title"), F.col("subtitle")).alias("kind")),
    "fn_chapters_valid": _chapters,
    "flt_snapshot_fresh": _snapshots,
}

SQL = {
    name: with_views(sql)
    for name, sql in {
        "src_page_assembly": PAGES_SQL,
        "src_normalize_items": NESTED_SQL,
        "src_search_results": RESULTS_SQL,
        "fn_error_class": MESSAGES_SQL,
        "fn_attribution": ATTRIBUTION_SQL,
        "fn_item_kind": KIND_SQL,
        "fn_chapters_valid": CHAPTERS_SQL,
        "flt_snapshot_fresh": SNAPSHOT_SQL,
    }.items()
}
