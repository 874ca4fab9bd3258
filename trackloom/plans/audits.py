"""Queries of audits, documents and reports on inputs where every verdict occurs, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import SparkSession as S

from trackloom.operators import audits, catalog, events, evidence, matching, planning
from trackloom.plans.ingest import one_of
from trackloom.plans.oracle import FLAGS, KEY, reason
from trackloom.sources import documents, shared, views
from trackloom.sources.views import with_views

# ---- physical files that two folders share, with few uses each: all match, all fail, some unknown, mixed


def _states(s: S, d: str) -> DataFrame:
    files = views.file(s, d).withColumn("dev", F.floor(F.col("folder") / 2)).withColumn("ino", F.col("song_id"))
    return matching.occurrence_states(views.occurrence(s, d), files)


STATES = f"states AS (SELECT o.playlist_id, o.seq, o.song_id, f.folder // 2 AS dev, f.song_id AS ino, f.path, f.size, CASE {reason('f.expected_ms', 'f.seconds')} WHEN 'missing-source' THEN 'missing-source-metadata' WHEN 'match' THEN 'length-match' ELSE 'probable-bad-duration' END AS state FROM occurrence o JOIN file f ON f.folder = o.folder AND f.song_id = o.song_id)"
FILES = "files AS (SELECT dev, ino, count(*) AS uses, count(DISTINCT path) AS paths, max(size) AS size, bool_or(state = 'length-match') AS fits, bool_or(state = 'missing-source-metadata') AS unknown, bool_or(state = 'probable-bad-duration') AS bad FROM states GROUP BY 1, 2), worst AS (SELECT *, CASE WHEN bad THEN 'probable-bad-duration' WHEN unknown THEN 'missing-source-metadata' ELSE 'length-match' END AS state FROM files)"
REPAIR_SQL = f"WITH {STATES}, {FILES} SELECT dev, ino, uses, paths, size, NOT fits AND NOT unknown AS repair, CASE WHEN fits THEN 'some use matches' WHEN unknown THEN 'some length is unknown' END AS reason FROM files"
STATE_SQL = f"WITH {STATES}, {FILES} SELECT dev, ino, uses, size, state FROM worst"
AMBIGUOUS_SQL = f"WITH {STATES}, {FILES} SELECT dev, ino, CASE WHEN bad AND NOT fits AND NOT unknown THEN 'probable-bad-duration' WHEN fits AND NOT bad AND NOT unknown THEN 'length-match' ELSE 'ambiguous-source-editions' END AS state, state AS candidate FROM worst"
AUDIT_SQL = f"""WITH {STATES}, {FILES}, b AS (SELECT w.state, count(DISTINCT s.song_id) AS bad_songs FROM worst w JOIN states s ON s.dev = w.dev AND s.ino = w.ino AND s.state = 'probable-bad-duration' GROUP BY 1), g AS (SELECT state, count(*) AS files, CAST(sum(uses) AS BIGINT) AS uses, CAST(sum(size) AS BIGINT) AS bytes FROM worst GROUP BY 1)
 SELECT g.state, g.files, g.uses, g.bytes, coalesce(b.bad_songs, 0) AS bad_songs, NOT EXISTS (SELECT 1 FROM worst WHERE state = 'missing-source-metadata') AS complete FROM g LEFT JOIN b ON b.state = g.state"""

# ---- songs of which a third have no candidate of a fitting length


def _inspections(s: S, d: str) -> DataFrame:
    found = views.candidate(s, d).withColumn("seconds", F.col("seconds") + F.when(F.col("song_id") % 3 == 0, 100).otherwise(0))
    return matching.inspection_pick(matching.evidence(found, views.ledger(s, d)))


INSPECT_SQL = f"""WITH c AS (SELECT song_id, video, place, expected_ms, seconds + CASE WHEN song_id % 3 = 0 THEN 100 ELSE 0 END AS seconds FROM candidate), one AS (SELECT song_id, video, min(place) AS place, max(expected_ms) AS expected_ms, arg_max(seconds, place) FILTER (seconds IS NOT NULL) AS seconds FROM c GROUP BY 1, 2),
 e AS (SELECT o.song_id, o.video, o.place, CASE WHEN l.expected_ms = o.expected_ms THEN 'rejected' ELSE {reason('o.expected_ms', 'o.seconds')} END AS reason FROM one o LEFT JOIN ledger l ON l.song_id = o.song_id AND l.video = o.video)
 SELECT song_id, video, pick FROM (SELECT *, CAST(row_number() OVER (PARTITION BY song_id ORDER BY place) AS INTEGER) AS pick FROM e WHERE reason = 'missing-candidate' AND song_id NOT IN (SELECT song_id FROM e WHERE reason = 'match')) WHERE pick <= 2"""

# ---- editions of two titles

SUFFIXES = ["", " (Live at Home)", " - Acoustic Version", " [Remix]", " sped up + slowed", " Karaoke", " delivered"]


def _editions(s: S, d: str) -> DataFrame:
    n = F.col("doc_id")
    text = F.coalesce("text", F.lit(""))
    rows = views.table(s, d, "documents").select("doc_id", F.concat(text, one_of(n % 7, *SUFFIXES)).alias("a"), F.concat(text, one_of(n % 5, *SUFFIXES[:5])).alias("b"))
    return rows.select("doc_id", audits.edition_verdict(F.col("a"), F.col("b")).alias("v")).select("doc_id", "v.*")


def _flags(text: str) -> str:
    return FLAGS.replace("lower(text)", f"lower({text})")


EDITION_SQL = f"""WITH t AS (SELECT doc_id, coalesce(text, '') || {SUFFIXES!r}[doc_id % 7 + 1] AS a, coalesce(text, '') || {SUFFIXES[:5]!r}[doc_id % 5 + 1] AS b FROM documents), f AS (SELECT doc_id, {_flags('a')} AS wanted, {_flags('b')} AS found FROM t),
 l AS (SELECT *, list_filter(string_split(wanted, ','), lambda x: x <> '') AS fa, list_filter(string_split(found, ','), lambda x: x <> '') AS fb FROM f),
 m AS (SELECT *, len(list_filter(fb, lambda x: NOT list_contains(fa, x))) > 0 AS more, len(list_filter(fa, lambda x: NOT list_contains(fb, x))) > 0 AS less FROM l) SELECT doc_id, wanted, found, CASE WHEN more AND less THEN 'other' WHEN more THEN 'extra' WHEN less THEN 'lacking' ELSE 'match' END AS verdict FROM m"""

# ---- admissions of three lanes, requests of sets, priorities, sort modes, pieces, spellings, job tables


def _requests(s: S, d: str) -> DataFrame:
    e = views.event(s, d).select("key", (F.col("event_id") % 40).alias("part"), F.concat_ws(":", "type", (F.coalesce("k", F.lit(0)) % 3).cast("string")).alias("uri"))
    return e.groupBy("key", "part").agg(F.sha2(F.array_join(F.array_sort(F.collect_set("uri")), ","), 256).alias("hash"))


def _priorities(s: S, d: str) -> DataFrame:
    ms = F.when(F.col("song_id") % 289 != 0, F.coalesce("expected_ms", F.lit(90_000)))
    return planning.metadata_priority(views.song(s, d).withColumn("expected_ms", ms))


def _sorted(s: S, d: str) -> DataFrame:
    p = views.playlist(s, d)
    plays = views.occurrence(s, d).groupBy("playlist_id").agg(F.count_if(F.col("quantity") > 45).alias("plays"), F.count_if(F.col("quantity") <= 10).alias("remaining"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    bucket = F.when(F.col("status") == 0, 0).when(F.col("status") == 5, 1).otherwise(2)
    return audits.sort_modes(p.join(plays, "playlist_id", "left").select("playlist_id", "name", "rank", "last_played", zero("plays"), zero("remaining"), bucket.alias("bucket")))


SORT_SQL = " UNION ALL ".join(
    f"(SELECT '{mode}' AS mode, row_number() OVER (ORDER BY {order}) AS place, playlist_id, bucket FROM p)"
    for mode, order in {"name": "lower(name), playlist_id", "recents": "last_played DESC NULLS LAST, playlist_id", "played": "plays DESC, last_played DESC NULLS LAST, playlist_id", "activity": "bucket, remaining DESC, rank, playlist_id"}.items()
)
SORT_SQL = f"WITH c AS (SELECT playlist_id, count(*) FILTER (quantity > 45) AS plays, count(*) FILTER (quantity <= 10) AS remaining FROM occurrence GROUP BY 1), p AS (SELECT q.playlist_id, name, rank, last_played, coalesce(plays, 0) AS plays, coalesce(remaining, 0) AS remaining, CASE status WHEN 0 THEN 0 WHEN 5 THEN 1 ELSE 2 END AS bucket FROM playlist q LEFT JOIN c ON c.playlist_id = q.playlist_id) {SORT_SQL}"


def _pieces(s: S, d: str) -> DataFrame:
    o = views.occurrence(s, d)
    start = F.col("seq") * 25.0
    return evidence.coverage_assert(o.select("playlist_id", F.col("seq").alias("bar"), start.alias("start"), (start + F.col("quantity") - 1).alias("end")))


PIECES_SQL = "WITH i AS (SELECT playlist_id, seq * 25.0 AS a, seq * 25.0 + quantity - 1 AS z, seq * 25.0 - lag(seq * 25.0 + quantity - 1) OVER (PARTITION BY playlist_id ORDER BY seq) AS step FROM occurrence) SELECT playlist_id, count(*) FILTER (step > 0) AS gaps, count(*) FILTER (step < 0) AS overlaps, count(*) FILTER (z <= a) AS empty FROM i GROUP BY 1"


def _collisions(s: S, d: str) -> DataFrame:
    return catalog.key_collisions(views.song(s, d).withColumn("name", F.when(F.col("song_id") % 3 == 0, F.upper("name")).otherwise(F.col("name"))))


COLLISION_SQL = f"WITH s AS (SELECT song_id, artist, CASE WHEN song_id % 3 = 0 THEN upper(name) ELSE name END AS name, expected_ms FROM song) SELECT {KEY} AS song_key, count(*) AS songs, count(DISTINCT name) AS spellings, count(expected_ms) AS known, min(expected_ms) AS least_ms, max(expected_ms) AS most_ms FROM s GROUP BY 1 HAVING count(*) > 1"


def _jobs(s: S, d: str) -> DataFrame:
    """An older table without errors and a newer one with them, read as one."""
    p = views.playlist(s, d)
    parents = p.select("playlist_id", "name")
    old = p.where("last_played < '1995-01-01'").select("playlist_id", "status")
    new = p.where("last_played >= '1995-01-01' or last_played is null").select("playlist_id", "status", F.when(F.col("status") == 4, F.concat(F.lit("failed "), F.col("rank").cast("string"))).alias("error"))
    return evidence.job_table(old, parents, "playlist_id", ["status", "error"]).union(evidence.job_table(new, parents, "playlist_id", ["status", "error"]))


JOBS_SQL = "SELECT playlist_id, status, CASE WHEN status = 4 AND (last_played >= '1995-01-01' OR last_played IS NULL) THEN concat('failed ', rank) END AS error, name FROM playlist"

# ---- documents in and out


def _event_lines(s: S, d: str) -> DataFrame:
    """The event log as JSON lines, some cut off, written to the shared folder and read back; malformed lines drop out."""
    e = views.event(s, d)
    text = F.to_json(F.struct("event_id", "key", "type", "k"))
    line = F.when(F.col("event_id") % 31 == 0, F.substring(text, F.lit(1), F.length(text) - 2)).when(F.col("event_id") % 37 == 0, F.concat(F.lit("# "), text)).otherwise(text)
    path = documents.write_lines(e, line, shared.shared_path(s, "log"))
    read = documents.read_lines(s, path, "event_id long, key long, type string, k int")
    return read.where("not bad and k is not null and type is not null").select("event_id", "key", "type", "k")


EVENT_SQL = "SELECT event_id, \"key\", type, k FROM event WHERE k IS NOT NULL AND type IS NOT NULL AND event_id % 31 <> 0 AND event_id % 37 <> 0"


def _playlist_documents(s: S, d: str) -> DataFrame:
    """Playlists as JSON documents with their tracks, written out and read back; excluded names and nameless tracks drop out."""
    n = F.col("song_id")
    track = F.struct("seq", F.col("song_id").alias("id"), F.when(n % 13 != 0, F.col("artist")).otherwise("").alias("artist"), F.when(n % 17 != 0, F.col("name")).alias("name"), F.col("n").alias("number"))
    rows = views.occurrence(s, d).join(views.song(s, d), "song_id").groupBy("playlist_id").agg(F.array_sort(F.collect_list(track)).alias("tracks"))
    p = views.playlist(s, d).select("playlist_id", one_of(F.col("playlist_id") % 9, F.concat(F.lit("Daily Mix "), F.col("rank").cast("string")), F.lit(" dj "), *[F.col("name")] * 7).alias("name"), "skipped")
    docs = p.join(rows, "playlist_id").select(F.to_json(F.struct("playlist_id", "name", "skipped", "tracks")).alias("text"))
    path = documents.write_lines(docs, F.col("text"), shared.shared_path(s, "playlists"))
    read = documents.read_lines(s, path, "playlist_id long, name string, skipped boolean, tracks array<struct<seq: int, id: long, artist: string, name: string, number: long>>")
    kept = read.where(~F.col("bad") & ~F.col("skipped") & ~planning.excluded_name(F.col("name")))
    return kept.select("playlist_id", F.explode("tracks").alias("t")).where("coalesce(t.artist, '') <> '' and coalesce(t.name, '') <> ''").select("playlist_id", F.col("t.id").alias("song_id"), F.col("t.number").alias("n"), "t.seq", "t.artist", "t.name")


PLAYLIST_SQL = "SELECT o.playlist_id, o.song_id, o.n, CAST(o.seq AS INTEGER) AS seq, s.artist, s.name FROM occurrence o JOIN playlist p ON p.playlist_id = o.playlist_id JOIN song s ON s.song_id = o.song_id WHERE NOT p.skipped AND p.playlist_id % 9 > 1 AND s.song_id % 13 <> 0 AND s.song_id % 17 <> 0"


def _csv(s: S, d: str) -> DataFrame:
    """Documents as CSV with safe cells, written and read back: what is read is what was to be written."""
    rows = views.table(s, d, "documents").select("doc_id", documents.safe_cell(F.col("text")).alias("cell"))
    path = documents.write_csv(rows, shared.shared_path(s, "csv"))
    return documents.read_csv(s, path, "doc_id long, cell string").select("doc_id", F.md5("cell").alias("cell_md5"))


PRIVATE = r"token = |/Users/|/home/"


def _manifest(s: S, d: str) -> DataFrame:
    t = views.table(s, d, "documents")
    rows = t.select(F.concat(F.lit("audio/"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"), F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 600).cast("long").alias("seconds"))
    return audits.manifest(rows, PRIVATE)


MANIFEST_SQL = f"""WITH e AS (SELECT concat('audio/', doc_id) AS path, coalesce(regexp_matches(text, '{PRIVATE}'), false) AS private, text, CASE WHEN doc_id % 3 <> 0 THEN doc_id % 600 END AS seconds FROM documents),
 f AS (SELECT path, CASE WHEN NOT private THEN sha256(text) END AS sha256, CAST(octet_length(encode(text)) AS BIGINT) AS bytes, CAST(seconds AS BIGINT) AS seconds, CASE WHEN private THEN 'refused' WHEN text IS NULL THEN 'empty' ELSE 'listed' END AS state FROM e)
 SELECT * FROM f UNION ALL SELECT 'total', NULL, coalesce(CAST(sum(bytes) AS BIGINT), 0), CAST(sum(seconds) AS BIGINT), concat(count(*), ' files, ', count(seconds), ' with a length') FROM f WHERE state = 'listed'"""

# ---- candidates with titles: by song and video the right one, another edition, another song, another artist, none


def _evidence(s: S, d: str) -> DataFrame:
    found = matching.evidence(views.candidate(s, d), views.ledger(s, d))
    kind = (F.col("song_id") + F.col("video")) % 7
    title = F.when(kind == 0, F.concat("artist", F.lit(" - "), "name", F.lit(" (Official Video)"))).when(kind == 1, F.concat("name", F.lit(" live"))).when(kind == 2, "something else").when(kind == 3, "").otherwise(F.col("name"))
    channel = F.when(kind == 4, "nobody known").otherwise(F.col("artist"))
    named = found.select("song_id", "video").join(views.song(s, d), "song_id").select("song_id", "video", "artist", "name", title.alias("title"), channel.alias("channel"))
    return audits.with_identity(found, named)


BASE = f"""one AS (SELECT song_id, video, min(place) AS place, count(*) AS repeats, max(expected_ms) AS expected_ms, arg_max(seconds, place) FILTER (seconds IS NOT NULL) AS seconds FROM candidate GROUP BY 1, 2),
 ev AS (SELECT o.song_id, o.video, o.place, o.repeats > 1 AS duplicate, round(o.seconds, 6) AS seconds, {reason('o.expected_ms', 'o.seconds')} AS length, coalesce(l.expected_ms = o.expected_ms, false) AS rejected FROM one o LEFT JOIN ledger l ON l.song_id = o.song_id AND l.video = o.video)"""
IDENTITY = f"""{BASE}, named AS (SELECT *, CASE (song_id + video) % 7 WHEN 1 THEN 'edition-mismatch' WHEN 2 THEN 'title-mismatch' WHEN 3 THEN 'missing-title' WHEN 4 THEN 'artist-mismatch' ELSE 'match' END AS identity FROM ev),
 final AS (SELECT song_id, video, place, duplicate, seconds, length, identity, CASE WHEN rejected THEN 'rejected' WHEN identity <> 'match' THEN identity ELSE length END AS reason FROM named)"""
REJECTED_SQL = f"""WITH {BASE}, r AS (SELECT song_id, video, place, CASE WHEN rejected THEN 'rejected' ELSE length END AS reason FROM ev), k AS (SELECT song_id, video, place, row_number() OVER (PARTITION BY song_id ORDER BY place DESC, video) AS n FROM r WHERE reason IN ('mismatch', 'rejected'))
 SELECT song_id, video, place, 'rejected' AS kind FROM k WHERE n <= 128 UNION ALL SELECT r.song_id, r.video, r.place, 'open' FROM r WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.song_id = r.song_id AND k.video = r.video AND k.n <= 128)"""


def _texts(s: S, d: str) -> DataFrame:
    path = views.file(s, d).select("folder", "song_id", "path")
    rows = views.occurrence(s, d).join(views.song(s, d), "song_id").join(path, ["folder", "song_id"], "left").select("playlist_id", "seq", F.col("expected_ms").alias("ms"), "name", "path")
    return audits.playlist_text(rows).select("playlist_id", F.md5("body").alias("body_md5"))


TEXT_SQL = """SELECT o.playlist_id, md5(concat('#EXTM3U', chr(10), string_agg(concat('#EXTINF:', CAST(floor(coalesce(s.expected_ms, 0) / 1000.0 + 0.5) AS BIGINT), ',', s.name, chr(10), coalesce(f.path, '')), chr(10) ORDER BY o.seq))) AS body_md5
 FROM occurrence o JOIN song s ON s.song_id = o.song_id LEFT JOIN file f ON f.folder = o.folder AND f.song_id = o.song_id GROUP BY 1"""

QUERIES = {
    "join_candidate_evidence": _evidence,
    "join_candidate_select": lambda s, d: matching.select_candidate(_evidence(s, d)),
    "join_rejected_anti": lambda s, d: audits.rejections(matching.evidence(views.candidate(s, d), views.ledger(s, d))),
    "snk_playlist_text": _texts,
    "agg_repair_manifest": lambda s, d: audits.repair_manifest(_states(s, d), shared.tasks_for(views.table(s, d, "lineitem"))),
    "agg_file_state": lambda s, d: matching.file_state(_states(s, d)),
    "agg_edition_ambiguity": lambda s, d: audits.edition_ambiguity(_states(s, d)),
    "agg_full_audit": lambda s, d: audits.full_audit(_states(s, d)),
    "join_inspection_pick": _inspections,
    "fn_edition_flags": _editions,
    "win_admission_load": lambda s, d: events.admission_load(views.event(s, d).withColumn("key", F.col("key") % 3), 2),
    "fn_request_hash": _requests,
    "top_metadata_priority": _priorities,
    "top_playlist_sort": _sorted,
    "win_coverage_assert": _pieces,
    "agg_key_collisions": _collisions,
    "src_job_table": _jobs,
    "src_event_log": _event_lines,
    "src_playlist_explode": _playlist_documents,
    "snk_export_csv": _csv,
    "snk_export_manifest": _manifest,
}

SQL = {
    name: with_views(sql)
    for name, sql in {
        "join_candidate_evidence": f"WITH {IDENTITY} SELECT * FROM final",
        "join_candidate_select": f"WITH {IDENTITY} SELECT song_id, video, place FROM (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY place) AS r FROM final WHERE reason = 'match') WHERE r = 1",
        "join_rejected_anti": REJECTED_SQL,
        "snk_playlist_text": TEXT_SQL,
        "agg_repair_manifest": REPAIR_SQL,
        "agg_file_state": STATE_SQL,
        "agg_edition_ambiguity": AMBIGUOUS_SQL,
        "agg_full_audit": AUDIT_SQL,
        "join_inspection_pick": INSPECT_SQL,
        "fn_edition_flags": EDITION_SQL,
        "win_admission_load": 'SELECT event_id, "key" % 3 AS "key", count(*) OVER w AS load, count(*) OVER w >= 2 AS would_exceed FROM event WHERE type = \'download_start\' WINDOW w AS (PARTITION BY "key" % 3 ORDER BY epoch_us(t) RANGE BETWEEN 599999999 PRECEDING AND CURRENT ROW)',
        "fn_request_hash": "SELECT \"key\", event_id % 40 AS part, sha256(string_agg(DISTINCT concat(type, ':', coalesce(k, 0) % 3), ',' ORDER BY concat(type, ':', coalesce(k, 0) % 3))) AS hash FROM event GROUP BY 1, 2",
        "top_metadata_priority": "WITH s AS (SELECT song_id, CASE WHEN song_id % 289 <> 0 THEN coalesce(expected_ms, 90000) ELSE 0 END AS ms FROM song) SELECT song_id, CASE WHEN ms < 60000 THEN 0 ELSE 1 END AS tier, ms, row_number() OVER (ORDER BY CASE WHEN ms < 60000 THEN 0 ELSE 1 END, ms DESC, song_id) AS place FROM s",
        "top_playlist_sort": SORT_SQL,
        "win_coverage_assert": PIECES_SQL,
        "agg_key_collisions": COLLISION_SQL,
        "src_job_table": JOBS_SQL,
        "src_event_log": EVENT_SQL,
        "src_playlist_explode": PLAYLIST_SQL,
        "snk_export_csv": "SELECT doc_id, md5(CASE WHEN regexp_matches(text, '\\A[=+\\-@]') THEN concat('''', text) ELSE text END) AS cell_md5 FROM documents",
        "snk_export_manifest": MANIFEST_SQL,
    }.items()
}
