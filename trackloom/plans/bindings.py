"""Queries of the binding operators over the driver tables, and their SQL. Every verdict occurs by a rule on ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import SparkSession as S

from trackloom.operators import bindings, matching
from trackloom.plans.ingest import one_of
from trackloom.plans.oracle import STATES, reason
from trackloom.sources import shared, views
from trackloom.sources.views import with_views

# ---- exact bindings: songs are identities; two songs in four share a file name, a fifth of some paths has two owners

KEY_SQL = "CASE WHEN song_id % 4 < 2 THEN concat('p', song_id // 4) ELSE concat('k', song_id) END"


def _file_key() -> Column:
    n = F.col("song_id")
    return F.when(n % 4 < 2, F.concat(F.lit("p"), F.floor(n / 4))).otherwise(F.concat(F.lit("k"), n))


def _bindings(s: S, d: str) -> DataFrame:
    files, songs = views.file(s, d), views.song(s, d)
    name = lambda n: F.concat(F.lit("i"), n)
    k = F.col("folder") % 5
    tag = F.when(k == 0, name(F.col("song_id"))).when(k == 1, name(F.col("song_id") + 1)).when(k == 2, "elsewhere")
    own = files.select(F.col("path").alias("file_id"), "path", _file_key().alias("file_key"), tag.alias("tag"))
    saved = files.where("folder % 3 = 0")
    by_path = saved.select("path", name(F.col("song_id")).alias("identity")).union(saved.where("song_id % 5 = 0").select("path", name(F.col("song_id") + 1)))
    by_name = songs.where("song_id % 7 <> 0").select(_file_key().alias("file_key"), name(F.col("song_id")).alias("identity"))
    return bindings.exact_binding(own, songs.select(name(F.col("song_id")).alias("identity")), by_path, by_name)


BINDING_SQL = f"""WITH ids AS (SELECT concat('i', song_id) AS identity, {KEY_SQL} AS file_key, song_id FROM song),
 by_name AS (SELECT file_key, count(DISTINCT identity) AS n, min(identity) AS identity FROM ids WHERE song_id % 7 <> 0 GROUP BY 1),
 f AS (SELECT path, {KEY_SQL} AS file_key, CASE WHEN folder % 3 = 0 THEN CASE WHEN song_id % 5 = 0 THEN 2 ELSE 1 END END AS path_n, CASE WHEN folder % 3 = 0 THEN concat('i', song_id) END AS path_id,
 CASE folder % 5 WHEN 0 THEN concat('i', song_id) WHEN 1 THEN concat('i', song_id + 1) WHEN 2 THEN 'elsewhere' END AS tag FROM file),
 m AS (SELECT f.path AS file_id, f.path_n, coalesce(f.path_n, b.n, 0) AS n, coalesce(f.path_id, b.identity) AS own, i.identity AS tag FROM f LEFT JOIN by_name b ON b.file_key = f.file_key LEFT JOIN ids i ON i.identity = f.tag),
 r AS (SELECT *, n = 1 AND tag IS NOT NULL AND tag <> own AS conflict FROM m)
 SELECT file_id, CASE WHEN n = 1 AND NOT conflict OR n = 0 AND tag IS NOT NULL THEN 'bound' ELSE 'unknown-identity' END AS state,
 CASE WHEN n > 1 THEN 'several identities' WHEN conflict THEN 'conflicts with tag' WHEN path_n = 1 THEN 'path' WHEN n = 1 THEN 'filename' WHEN tag IS NOT NULL THEN 'tags' ELSE 'none' END AS method,
 CASE WHEN n = 1 AND NOT conflict THEN own WHEN n = 0 THEN tag END AS identity, CAST(CASE WHEN conflict THEN 2 ELSE n END AS BIGINT) AS candidates FROM r"""

# ---- source lengths: cached metadata of each part, spoilt in one way or another


def _durations(s: S, d: str) -> DataFrame:
    n = F.col("song_id")
    id_ = F.lpad(n.cast("string"), 22, "0")
    ids = F.when(n % 19 == 0, F.array(id_, F.lpad(n.cast("string"), 22, "9"))).when(n % 23 == 0, F.array(F.lit("short"))).otherwise(F.array(id_, id_))
    songs = views.song(s, d).select("song_id", "artist", "name", F.when(n % 3 != 0, F.col("expected_ms")).alias("expected_ms"), ids.alias("ids"), (n % 29 == 0).alias("conflict"))
    k = n % 7
    meta = views.song(s, d).select(
        id_.alias("id"), F.when(k == 0, 2).otherwise(1).alias("version"), F.when(k == 1, F.concat(F.lit("other "), "name")).otherwise(F.concat(F.lit("  "), F.upper("name"))).alias("name"),
        F.when(k == 2, F.lit("nobody")).otherwise(F.col("artist")).alias("artist"), F.when(k != 3, F.coalesce("expected_ms", F.lit(1000)).cast("long")).alias("duration_ms"),
    )
    return bindings.source_duration(songs, meta)


DURATION_SQL = """WITH s AS (SELECT song_id, CASE WHEN song_id % 3 <> 0 AND expected_ms > 0 THEN expected_ms END AS own, song_id % 19 = 0 AS many, song_id % 19 <> 0 AND song_id % 23 = 0 AS none, song_id % 29 = 0 AS conflict, song_id % 7 NOT IN (0, 1, 2, 3) AS valid, coalesce(expected_ms, 1000) AS cached FROM song),
 t AS (SELECT *, CASE WHEN conflict THEN 'conflict' WHEN many THEN 'ambiguous' WHEN own IS NOT NULL THEN 'own' WHEN valid AND NOT none THEN 'cached' ELSE 'unavailable' END AS state FROM s)
 SELECT song_id, state, CAST(CASE state WHEN 'own' THEN own WHEN 'cached' THEN cached END AS BIGINT) AS duration_ms FROM t"""

# ---- old records: each line names a song by name, by key, or only in free text


def _history(s: S, d: str) -> DataFrame:
    songs = views.song(s, d).select("song_id", "artist", "name")
    unknown = views.file(s, d).where("seconds is null").join(songs, "song_id").select(F.col("path").alias("file_id"), F.upper(F.concat_ws(" - ", "artist", "name")).alias("key"))
    lines = views.table(s, d, "lineitem").where("l_quantity < 4").select(F.col("l_partkey").alias("song_id"), "l_linenumber", "l_returnflag").join(songs, "song_id")
    id_ = lambda first: F.concat(F.lit(first), F.lpad(F.col("song_id").cast("string"), 21, "0"))
    how = F.col("l_linenumber") % 4
    key = F.concat_ws(" - ", "artist", "name")
    records = lines.select(
        F.when(how == 0, F.col("artist")).alias("artist"), F.when(how < 2, F.col("name")).alias("name"), F.when(how.isin(1, 2), key).alias("key"),
        one_of(F.col("l_linenumber") % 3, F.array(F.lit("short")), F.array(id_("0"), id_("0")), F.array(id_("0"), id_("1"))).alias("ids"), key.alias("detail"),
    )
    return bindings.history_recovery(unknown, records)


HISTORY_SQL = """WITH u AS (SELECT f.path AS file_id, lower(concat(s.artist, ' - ', s.name)) AS k FROM file f JOIN song s ON s.song_id = f.song_id WHERE f.seconds IS NULL),
 r AS (SELECT lower(concat(s.artist, ' - ', s.name)) AS k, l.l_linenumber % 3 AS n, l_partkey AS id FROM lineitem l JOIN song s ON s.song_id = l.l_partkey WHERE l_quantity < 4 AND l_linenumber % 4 <> 3),
 m AS (SELECT file_id, n, id FROM u JOIN r USING (k)),
 i AS (SELECT file_id, count(DISTINCT x) AS ids FROM (SELECT file_id, concat('0', id) AS x FROM m WHERE n > 0 UNION ALL SELECT file_id, concat('1', id) FROM m WHERE n = 2) GROUP BY 1)
 SELECT m.file_id, count(*) FILTER (n > 0) AS bindings, coalesce(any_value(i.ids), 0) AS ids, count(*) FILTER (n = 0) AS observations FROM m LEFT JOIN i ON i.file_id = m.file_id GROUP BY 1"""

# ---- completion of missing lengths


def _completion(s: S, d: str) -> DataFrame:
    states = matching.occurrence_states(views.occurrence(s, d), views.file(s, d))
    near = F.when(F.col("song_id") % 2 == 0, F.lit(200_000)).otherwise(F.lit(None))
    resolved = views.song(s, d).where("song_id % 17 = 0").select("song_id", near.cast("long").alias("ms"))
    files = views.file(s, d).withColumn("seconds", F.when(F.col("expected_ms").isNull(), 195.0 + F.col("song_id") % 40).otherwise(F.col("seconds")))
    path = shared.shared_path(s, "uses")
    bindings.store_uses(states, path)
    return bindings.source_completion(s, path, files, resolved)


COMPLETION_SQL = f"""WITH {STATES}, again AS (SELECT dev, ino, size, CASE WHEN state = 'missing-source-metadata' AND song_id % 17 = 0 AND song_id % 2 = 0 THEN CASE WHEN abs(200.0 - (195.0 + song_id % 40)) <= 10.000001 THEN 'length-match' ELSE 'probable-bad-duration' END ELSE state END AS state FROM states)
 SELECT dev, ino, count(*) AS uses, max(size) AS size, CASE WHEN bool_or(state = 'probable-bad-duration') THEN 'probable-bad-duration' WHEN bool_or(state = 'missing-source-metadata') THEN 'missing-source-metadata' ELSE 'length-match' END AS state FROM again GROUP BY 1, 2"""

# ---- members with everything known of them


def _export(s: S, d: str) -> DataFrame:
    songs, n = views.song(s, d), F.col("song_id")
    proof = views.file(s, d).groupBy("song_id").agg(F.min("path").alias("path"), F.max("seconds").alias("seconds")).where(n % 6 != 0)
    analysis = songs.where(n % 5 != 0).select("song_id", (100.0 + n % 40).alias("tempo"))
    digits = F.lpad((n % 10_000_000).cast("string"), 7, "0")
    isrc = one_of(n % 3, F.concat(F.lit("gb-abc-"), digits), F.concat(F.lit("GBA1"), digits), None)
    metadata = songs.where(n % 4 != 0).select("song_id", "expected_ms", isrc.alias("isrc"))
    scores = songs.where(n % 3 != 0).select("song_id", (n % 50 / 50.0).alias("energy"))
    return bindings.export_enrich(views.occurrence(s, d).select("playlist_id", "seq", "song_id"), proof, analysis, metadata, scores)


EXPORT_SQL = f"""WITH proof AS (SELECT song_id, min(path) AS path, max(seconds) AS seconds FROM file WHERE song_id % 6 <> 0 GROUP BY 1)
 SELECT o.playlist_id, o.seq, o.song_id, p.path, CASE WHEN o.song_id % 5 <> 0 THEN 100.0 + o.song_id % 40 END AS tempo, CASE WHEN o.song_id % 4 <> 0 AND o.song_id % 3 = 0 THEN concat('GBABC', lpad(CAST(o.song_id AS VARCHAR), 7, '0')) END AS isrc,
 CASE WHEN o.song_id % 3 <> 0 THEN round(o.song_id % 50 / 50.0, 6) END AS energy, p.path IS NOT NULL AND o.song_id % 5 <> 0 AND o.song_id % 4 <> 0 AND s.expected_ms IS NOT NULL AND coalesce({reason('s.expected_ms', 'p.seconds')} = 'match', false) AS complete
 FROM occurrence o JOIN song s ON s.song_id = o.song_id LEFT JOIN proof p ON p.song_id = o.song_id"""

# ---- rows that stored files already serve


def _reuse(s: S, d: str) -> DataFrame:
    base = lambda n: F.concat(F.lit("Base "), n)
    n = F.col("song_id")
    rows = views.occurrence(s, d).select((F.col("playlist_id") * 100 + F.col("seq")).alias("row_id"), "folder", base(n).alias("base"), F.when(n % 4 != 0, F.concat(F.lit("u"), F.floor(n / 3))).alias("url"), ((F.col("playlist_id") + F.col("seq")) % 6).cast("int").alias("status"))
    stored = views.file(s, d).where(((F.col("folder") + n) % 3 == 0) & (n % 5 < 2)).select("folder", F.upper(base(n)).alias("base"), F.when(n % 10 != 1, F.col("size")).otherwise(0).alias("size"))
    return bindings.local_reuse(rows, stored)


REUSE_SQL = """WITH rows_ AS (SELECT playlist_id * 100 + seq AS row_id, folder, concat('base ', song_id) AS base, CASE WHEN song_id % 4 <> 0 THEN concat('u', song_id // 3) END AS url, (playlist_id + seq) % 6 AS status FROM occurrence),
 stored AS (SELECT folder, concat('base ', song_id) AS base, concat(folder, '/BASE ', song_id) AS name FROM file WHERE (folder + song_id) % 3 = 0 AND song_id % 5 < 2 AND song_id % 10 <> 1),
 by_name AS (SELECT base, min(name) AS name FROM stored GROUP BY 1),
 placed AS (SELECT r.*, st.name AS at_place FROM rows_ r LEFT JOIN stored st ON st.folder = r.folder AND st.base = r.base),
 by_url AS (SELECT url, arg_min(at_place, row_id) AS name FROM placed WHERE url IS NOT NULL AND at_place IS NOT NULL GROUP BY 1)
 SELECT p.row_id, CASE WHEN p.at_place IS NOT NULL THEN 'destination' WHEN n.name IS NOT NULL THEN 'name' ELSE 'source' END AS how, coalesce(p.at_place, n.name, u.name) AS source
 FROM placed p LEFT JOIN by_name n ON n.base = p.base LEFT JOIN by_url u ON u.url = p.url WHERE p.status < 4 AND coalesce(p.at_place, n.name, u.name) IS NOT NULL"""

# ---- ledgers


def _replacements(s: S, d: str) -> DataFrame:
    n = F.col("song_id")
    deleted = views.file(s, d).select(n.alias("key"), F.col("path").alias("file_id"), F.when((n % 5 == 0) & (F.col("folder") % 2 == 0), "second").otherwise("first").alias("source_id"), ((n % 4 != 0) | (F.col("folder") % 3 != 0)).alias("deleted"), F.coalesce("expected_ms", F.lit(180_000)).cast("long").alias("expected_ms"))
    replaced = views.song(s, d).where(n % 3 != 0).select(n.alias("key"), ((F.coalesce("expected_ms", F.lit(180_000)) / 1000) + F.when(n % 7 == 0, 90).otherwise(1)).alias("seconds"))
    return bindings.replacement_status(deleted, replaced)


REPLACED_SQL = """WITH e AS (SELECT song_id AS k, CASE WHEN song_id % 5 = 0 AND folder % 2 = 0 THEN 2 ELSE 1 END AS id, song_id % 4 <> 0 OR folder % 3 <> 0 AS deleted FROM file),
 g AS (SELECT k, count(*) AS files, count(DISTINCT id) AS identities, bool_and(deleted) AS covered FROM e GROUP BY 1)
 SELECT k AS "key", files, identities, CASE WHEN k % 3 = 0 THEN 'open' WHEN identities <= 1 AND covered AND k % 7 <> 0 THEN 'resolved' ELSE 'needs-review' END AS state FROM g"""


def _marks(s: S, d: str) -> DataFrame:
    n = F.col("song_id")
    bad = matching.occurrence_states(views.occurrence(s, d), views.file(s, d)).where("state = 'probable-bad-duration'")
    findings = bad.where(n % 6 != 0).select(n.alias("key"), F.concat(F.lit("f"), F.col("ino")).alias("file_id"), F.timestamp_seconds(F.lit(1_700_000_000) + n % 100).alias("checked_at"))
    entries = views.song(s, d).where(n % 5 != 0).select(n.alias("key"), F.explode(F.sequence(F.lit(1), (n % 2 + 1).cast("int"))).alias("entry"))
    status = F.when(F.col("key") % 3 == 0, "resolved").when(F.col("key") % 3 == 1, "open").otherwise("needs-review")
    resolved = F.when((F.col("key") % 3 == 0) & (F.col("key") % 7 != 0), F.timestamp_seconds(F.lit(1_700_000_050)))
    seen = F.when(F.col("key") % 4 == 1, F.concat(F.lit("f"), F.col("key") % 500)).otherwise("none")
    ledger = entries.select("key", "entry", F.when(F.col("entry") == 2, status).otherwise(F.when(F.col("key") % 2 == 0, status).otherwise("open")).alias("status"), resolved.alias("resolved_at"), seen.alias("seen"))
    return bindings.mark_findings(findings, ledger)


MARKS_SQL = f"""WITH {STATES}, found AS (SELECT song_id AS k, string_agg(DISTINCT concat('f', ino), ',' ORDER BY concat('f', ino)) AS found, song_id % 100 AS checked FROM states WHERE state = 'probable-bad-duration' AND song_id % 6 <> 0 GROUP BY 1, 3),
 l AS (SELECT song_id AS k, CASE song_id % 3 WHEN 0 THEN 'resolved' WHEN 1 THEN 'open' ELSE 'needs-review' END AS status, CASE WHEN song_id % 4 = 1 THEN concat('f', song_id % 500) ELSE 'none' END AS seen, song_id % 7 <> 0 AS dated FROM song WHERE song_id % 5 <> 0),
 m AS (SELECT coalesce(l.k, f.k) AS k, l.status, f.found, CASE WHEN f.found IS NULL THEN 'untouched' WHEN l.status IS NULL THEN 'added' WHEN l.status = 'resolved' AND l.dated AND f.checked <= 50 THEN 'stale' WHEN l.status = 'resolved' THEN 'reopened' WHEN l.seen = f.found THEN 'same' ELSE 'updated' END AS action FROM l FULL JOIN found f ON f.k = l.k)
 SELECT k AS "key", action, CASE WHEN action IN ('added', 'reopened') THEN 'needs-review' ELSE status END AS status FROM m"""

QUERIES = {
    "join_exact_binding": _bindings,
    "join_source_duration": _durations,
    "join_history_recovery": _history,
    "join_source_completion": _completion,
    "join_export_enrich": _export,
    "join_local_reuse": _reuse,
    "agg_replacement_status": _replacements,
    "agg_mark_findings": _marks,
}

SQL = {
    name: with_views(sql)
    for name, sql in {
        "join_exact_binding": BINDING_SQL,
        "join_source_duration": DURATION_SQL,
        "join_history_recovery": HISTORY_SQL,
        "join_source_completion": COMPLETION_SQL,
        "join_export_enrich": EXPORT_SQL,
        "join_local_reuse": REUSE_SQL,
        "agg_replacement_status": REPLACED_SQL,
        "agg_mark_findings": MARKS_SQL,
    }.items()
}
