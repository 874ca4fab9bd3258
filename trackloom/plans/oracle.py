"""The queries' rows as plain SQL, written apart from the DataFrame code. Views come from ``sources.views.SQL``."""

from __future__ import annotations

from trackloom.functions import keys
from trackloom.operators import planning
from trackloom.sources.views import with_views

TOL = "greatest(5.0, least(20.0, {ms} / 1000.0 * 0.05))"


def tol(ms: str = "expected_ms") -> str:
    return TOL.format(ms=ms)


def reason(ms: str = "expected_ms", s: str = "seconds") -> str:
    return f"CASE WHEN coalesce({ms}, 0) <= 0 THEN 'missing-source' WHEN coalesce({s}, 0) <= 0 THEN 'missing-candidate' WHEN abs({ms} / 1000.0 - {s}) <= {tol(ms)} + 0.000001 THEN 'match' ELSE 'mismatch' END"


BASE = "translate(concat({a}, ' - ', regexp_replace({n}, '/', '')), '/\\?%*:|\"<>', '----------')"
DOC_BASE = BASE.format(a="CASE WHEN coalesce(source, '') = '' THEN 'unknown_artist' ELSE source END", n="CASE WHEN coalesce(text, '') = '' THEN 'unknown_track' ELSE text END")
KEY = f"lower({BASE.format(a='artist', n='name')})"
FOLD = "CASE WHEN {x} <= 0 THEN 100.0 WHEN {x} < 85 THEN {x} * pow(2, ceil(log2(85 / {x}))) WHEN {x} > 170 THEN {x} / pow(2, ceil(log2({x} / 170))) ELSE {x} END"
SONGS_IN = "SELECT * FROM occurrence JOIN song USING (song_id)"
EVIDENCE = f"""one AS (SELECT song_id, video, min(place) AS place, count(*) AS repeats, max(expected_ms) AS expected_ms, arg_max(seconds, place) FILTER (seconds IS NOT NULL) AS seconds FROM candidate GROUP BY 1, 2),
 evidence AS (SELECT o.song_id, o.video, o.place, o.repeats > 1 AS duplicate, round(o.seconds, 6) AS seconds, {reason('o.expected_ms', 'o.seconds')} AS length, CASE WHEN l.expected_ms = o.expected_ms THEN 'rejected' ELSE {reason('o.expected_ms', 'o.seconds')} END AS reason FROM one o LEFT JOIN ledger l ON l.song_id = o.song_id AND l.video = o.video)"""
STATES = f"states AS (SELECT o.playlist_id, o.seq, o.song_id, f.dev, f.ino, f.path, f.size, CASE {reason('f.expected_ms', 'f.seconds')} WHEN 'missing-source' THEN 'missing-source-metadata' WHEN 'match' THEN 'length-match' ELSE 'probable-bad-duration' END AS state FROM occurrence o JOIN file f ON f.folder = o.folder AND f.song_id = o.song_id)"
FILE_STATE = "file_state AS (SELECT dev, ino, count(*) AS uses, max(size) AS size, CASE WHEN bool_or(state = 'probable-bad-duration') THEN 'probable-bad-duration' WHEN bool_or(state = 'missing-source-metadata') THEN 'missing-source-metadata' ELSE 'length-match' END AS state FROM states GROUP BY 1, 2)"
BARS = "bars AS (SELECT playlist_id, seq AS bar, -100 * discount AS rel_db, quantity AS level FROM occurrence)"
ITEMS = f"items AS (SELECT p_partkey AS song_id, p_brand AS artist, p_name AS name, {FOLD.format(x='(p_retailprice / 10)')} AS tempo, p_size / 50.0 AS energy, p_partkey % 12 + 1 AS wheel, p_partkey % 2 AS letter FROM part)"
FLAGS = "array_to_string(list_filter([{e}], lambda e: contains(concat(' ', regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), concat(' ', e, ' '))), ',')".format(e=", ".join(f"'{e}'" for e in keys.EDITIONS))
UNIT = "SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS v FROM embeddings"
OLD = "SELECT * FROM event WHERE event_id % 2 = 0"
NEW = "SELECT * FROM event WHERE event_id % 2 = 1 OR event_id % 6 = 0"

_SQL = {
    "src_event_union": f"WITH a AS ({OLD}), b AS ({NEW}) SELECT event_id, \"key\", replace(type, 'search_ok', 'download_start') AS type, 'a' AS source FROM a WHERE type IN ('mp3_verified', 'download_start', 'search_ok') UNION ALL SELECT event_id, \"key\", replace(type, 'search_ok', 'download_start'), 'b' FROM b WHERE type IN ('mp3_verified', 'download_start', 'search_ok')",
    "src_file_manifest": "SELECT folder // 2 AS dev, song_id AS ino, string_agg(path, ',' ORDER BY path) AS paths, max(size) AS size, count(*) AS names FROM file GROUP BY 1, 2",
    "snk_upsert_journal": f"WITH a AS ({OLD}), b AS ({NEW}), was AS (SELECT \"key\", arg_max(type, (t, event_id)) AS state, max(event_id) AS event_id FROM a GROUP BY 1), now AS (SELECT \"key\", type AS state, event_id, row_number() OVER (PARTITION BY \"key\" ORDER BY t DESC, event_id DESC) AS r FROM b) SELECT \"key\", state, event_id FROM now WHERE r = 1 UNION ALL SELECT * FROM was WHERE \"key\" NOT IN (SELECT \"key\" FROM now)",
    "snk_reconcile_rows": "SELECT playlist_id, 4 AS status, skipped FROM playlist WHERE rank % 5 = 0 AND status <> 4",
    "fn_file_base": f"WITH b AS (SELECT doc_id, {DOC_BASE} AS b FROM documents) SELECT doc_id, md5(CASE WHEN octet_length(encode(b)) <= 251 THEN b ELSE concat(substr(b, 1, (SELECT max(n) FROM range(0, 239) r(n) WHERE octet_length(encode(substr(b, 1, n))) <= 238)), '-', substr(sha256(lower(b)), 1, 12)) END) AS base_md5 FROM b",
    "fn_source_key": f"SELECT song_id, CASE WHEN song_id % 2 = 0 THEN concat('spotify:', lpad(CAST(song_id AS VARCHAR), 22, '0')) ELSE {KEY} END AS source_key FROM song",
    "fn_base_title": "SELECT song_id, name AS title FROM song",
    "fn_primary_artist": "SELECT song_id, artist FROM song",
    "fn_length_match": f"SELECT song_id, place, {reason()} AS reason, round(CASE WHEN expected_ms > 0 THEN {tol()} END, 6) AS tolerance FROM candidate",
    "fn_fold_tempo": f"SELECT p_partkey AS song_id, round({FOLD.format(x='(p_retailprice / 10)')}, 6) AS tempo FROM part",
    "fn_ordered_hash": "SELECT playlist_id, count(*) AS items, sha256(concat('[', string_agg(CAST(song_id AS VARCHAR), ',' ORDER BY seq), ']')) AS hash FROM occurrence GROUP BY 1",
    "agg_catalog_dedup": f"WITH r AS (SELECT *, {KEY} AS song_key FROM ({SONGS_IN})), f AS (SELECT song_key, arg_min(expected_ms, (playlist_id, seq)) FILTER (expected_ms > 0) AS d FROM r GROUP BY 1) SELECT r.song_key, count(DISTINCT song_id) AS ids, count(*) AS occurrences, count(DISTINCT playlist_id) AS playlists, max(d) AS duration_ms, coalesce(bool_or(abs(expected_ms - d) > 5000), false) AS conflict FROM r JOIN f ON f.song_key = r.song_key GROUP BY 1",
    "agg_playlist_coverage": f"WITH m AS (SELECT o.playlist_id, coalesce({reason('f.expected_ms', 'f.seconds')} = 'match', false) AS ok FROM occurrence o JOIN playlist p ON p.playlist_id = o.playlist_id AND NOT p.skipped JOIN song s ON s.song_id = o.song_id LEFT JOIN file f ON f.folder = o.folder AND f.song_id = o.song_id) SELECT playlist_id, count(*) AS total, count(*) FILTER (ok) AS on_disk, CAST(floor(100.0 * count(*) FILTER (ok) / count(*) + 0.5) AS BIGINT) AS percent, count(*) = count(*) FILTER (ok) AS done FROM m GROUP BY ROLLUP (playlist_id)",
    "agg_catalog_summary": "SELECT count(*) AS total, count(*) FILTER (status = 4) AS saved, count(*) FILTER (status = 5) AS failed, count(*) FILTER (status = 0) AS remaining, count(*) FILTER (status = 0 AND NOT skipped) AS ready, count(*) FILTER (skipped) AS skipped FROM playlist",
    "agg_disjoint_windows": f"SELECT artist, name, count(*) AS known, round(max(expected_ms / 1000.0 - {tol()}), 6) AS max_lower, round(min(expected_ms / 1000.0 + {tol()}), 6) AS min_upper FROM song WHERE expected_ms > 0 GROUP BY 1, 2 HAVING count(*) >= 2 AND max(expected_ms / 1000.0 - {tol()}) > min(expected_ms / 1000.0 + {tol()})",
    "agg_status_counts": "SELECT status, count(*) AS n, count(DISTINCT name) AS names FROM playlist GROUP BY 1",
    "agg_best_status": "SELECT name, status, playlist_id FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY status DESC, playlist_id) AS r FROM playlist) WHERE r = 1",
    "agg_latest_by_key": "SELECT \"key\", event_id, type, k FROM (SELECT *, row_number() OVER (PARTITION BY \"key\" ORDER BY t DESC, event_id DESC) AS r FROM event) WHERE r = 1",
    "agg_source_variants": "SELECT artist, name, count(*) AS variants, count(*) - count(expected_ms) AS unavailable, coalesce(max(expected_ms) - min(expected_ms) > 5000, false) AS ambiguous FROM song GROUP BY 1, 2",
    "agg_resolution_funnel": "WITH p AS (SELECT name, max(CASE status WHEN 4 THEN 2 WHEN 5 THEN 1 ELSE 0 END) AS s FROM playlist GROUP BY 1) SELECT count(*) AS keys, count(*) FILTER (s = 2) AS found, count(*) FILTER (s = 1) AS no_result, count(*) FILTER (s = 0) AS searching, round(count(*) FILTER (s = 2) * 1.0 / nullif(count(*) FILTER (s > 0), 0), 6) AS success FROM p",
    "agg_disk_usage": "SELECT count(*) AS files, CAST(sum(n) AS BIGINT) AS paths, CAST(sum(size) AS BIGINT) AS bytes, round(avg(size), 6) AS mean_bytes FROM (SELECT dev, ino, max(size) AS size, count(*) AS n FROM file GROUP BY 1, 2)",
    "agg_audit_unique": f"WITH {STATES}, v AS (SELECT song_id, CASE WHEN bool_or(state = 'probable-bad-duration') THEN 'any-bad' WHEN bool_and(state = 'length-match') THEN 'all-match' ELSE 'unknown' END AS verdict FROM states GROUP BY 1) SELECT verdict, count(*) AS songs FROM v GROUP BY 1",
    "agg_media_rollup": f"WITH {STATES}, o AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY CASE state WHEN 'length-match' THEN 0 WHEN 'missing-source-metadata' THEN 1 ELSE 2 END, path) AS r, count(*) OVER (PARTITION BY song_id) AS places FROM states) SELECT song_id, state, path, places FROM o WHERE r = 1",
    "agg_energy_score": "WITH z AS (SELECT p_partkey AS song_id, least(3, greatest(-3, (p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER ())) + 0.5 * least(3, greatest(-3, (p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER ())) AS v FROM part) SELECT song_id, round((v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()), 6) AS energy FROM z",
    "agg_output_audit": "WITH p AS (SELECT CAST(t AS DATE) AS day, \"key\", count(*) AS n FROM event WHERE type = 'mp3_verified' GROUP BY 1, 2) SELECT day, CAST(sum(n) AS BIGINT) AS outputs, count(*) FILTER (n > 1) AS repeated_keys, round(sum(n) / 24 / 3.0, 6) AS multiple FROM p GROUP BY 1",
    "join_nearest_variant": f"WITH q AS (SELECT f.path, v.song_id AS variant, round(abs(f.seconds - v.expected_ms / 1000.0), 6) AS gap, {reason('v.expected_ms', 'f.seconds')} = 'match' AS ok FROM file f JOIN song s ON s.song_id = f.song_id JOIN song v ON v.artist = s.artist AND v.name = s.name WHERE f.seconds > 0 AND v.expected_ms IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ok DESC, gap, variant) AS place, count(*) OVER (PARTITION BY path) AS variants FROM q) SELECT path, variants, variant, gap, CASE WHEN ok THEN 'match' ELSE 'mismatch' END AS state FROM r WHERE place = 1",
    "join_occurrence_compare": f"WITH {STATES} SELECT playlist_id, seq, state FROM states",
    "join_reuse_url": "WITH h AS (SELECT artist, name, min(song_id) AS from_id FROM song WHERE song_id % 3 = 0 GROUP BY 1, 2) SELECT s.song_id, h.from_id, concat('http://h/', h.from_id) AS url FROM song s JOIN h ON h.artist = s.artist AND h.name = s.name WHERE s.song_id % 3 <> 0",
    "join_unmatched_coverage": "SELECT 'saved' AS state, count(*) AS n FROM song WHERE song_id IN (SELECT song_id FROM file) UNION ALL SELECT 'missing', count(*) FROM song WHERE song_id NOT IN (SELECT song_id FROM file) UNION ALL SELECT 'unexpected', count(DISTINCT song_id) FROM file WHERE song_id NOT IN (SELECT song_id FROM song)",
    "set_membership_diff": """WITH m AS (SELECT playlist_id, 1 AS obs, song_id, seq FROM occurrence WHERE quantity > CASE WHEN playlist_id % 3 = 1 THEN 10 ELSE 14 END UNION ALL SELECT playlist_id, 2, song_id, seq FROM occurrence WHERE quantity > 14
  UNION ALL SELECT playlist_id, 3, song_id, seq FROM occurrence WHERE playlist_id % 5 = 0 OR playlist_id % 5 = 1 AND quantity > 14 OR playlist_id % 5 = 2 AND quantity > 45 OR playlist_id % 5 > 2 AND quantity > 25),
 h AS (SELECT playlist_id, obs, count(*) AS n, string_agg(CAST(song_id AS VARCHAR), ',' ORDER BY seq) AS hash FROM m GROUP BY 1, 2), e AS (SELECT p.playlist_id, x.obs FROM (SELECT DISTINCT playlist_id FROM occurrence) p, (VALUES (1), (2), (3)) x(obs)),
 o AS (SELECT e.playlist_id, e.obs, coalesce(n, 0) AS n, coalesce(hash, '') AS hash, coalesce(n, 0) = coalesce(n + CASE WHEN (e.playlist_id + e.obs) % 4 = 3 THEN 1 ELSE 0 END, e.playlist_id % 2) AS sure FROM e LEFT JOIN h ON h.playlist_id = e.playlist_id AND h.obs = e.obs),
 s0 AS (SELECT e.playlist_id, count(o.seq) AS n FROM (SELECT DISTINCT playlist_id FROM occurrence) e LEFT JOIN occurrence o ON o.playlist_id = e.playlist_id AND o.quantity < 40 GROUP BY 1),
 t0 AS (SELECT playlist_id, n, 0 AS acc, true AS asure, NULL::BIGINT AS pn, NULL::VARCHAR AS ph, 'none' AS verdict FROM s0),
 v1 AS (SELECT t.*, o.obs, o.n AS m, o.hash, o.sure, CASE WHEN o.n = 0 AND NOT o.sure THEN 'missing' WHEN o.n < t.n AND NOT o.sure THEN 'refused' WHEN o.n >= t.n OR pn = o.n AND ph = o.hash THEN 'accepted' WHEN pn IS NOT NULL THEN 'changed' ELSE 'pending' END AS w FROM t0 t JOIN o ON o.playlist_id = t.playlist_id AND o.obs = 1),
 t1 AS (SELECT playlist_id, CASE WHEN w = 'accepted' THEN m ELSE n END AS n, CASE WHEN w = 'accepted' THEN obs ELSE acc END AS acc, CASE WHEN w = 'accepted' THEN sure ELSE asure END AS asure, CASE WHEN w IN ('pending', 'changed') THEN m WHEN w <> 'accepted' THEN pn END AS pn, CASE WHEN w IN ('pending', 'changed') THEN hash WHEN w <> 'accepted' THEN ph END AS ph, w AS verdict FROM v1),
 v2 AS (SELECT t.*, o.obs, o.n AS m, o.hash, o.sure, CASE WHEN o.n = 0 AND NOT o.sure THEN 'missing' WHEN o.n < t.n AND NOT o.sure THEN 'refused' WHEN o.n >= t.n OR pn = o.n AND ph = o.hash THEN 'accepted' WHEN pn IS NOT NULL THEN 'changed' ELSE 'pending' END AS w FROM t1 t JOIN o ON o.playlist_id = t.playlist_id AND o.obs = 2),
 t2 AS (SELECT playlist_id, CASE WHEN w = 'accepted' THEN m ELSE n END AS n, CASE WHEN w = 'accepted' THEN obs ELSE acc END AS acc, CASE WHEN w = 'accepted' THEN sure ELSE asure END AS asure, CASE WHEN w IN ('pending', 'changed') THEN m WHEN w <> 'accepted' THEN pn END AS pn, CASE WHEN w IN ('pending', 'changed') THEN hash WHEN w <> 'accepted' THEN ph END AS ph, w AS verdict FROM v2),
 v3 AS (SELECT t.*, o.obs, o.n AS m, o.hash, o.sure, CASE WHEN o.n = 0 AND NOT o.sure THEN 'missing' WHEN o.n < t.n AND NOT o.sure THEN 'refused' WHEN o.n >= t.n OR pn = o.n AND ph = o.hash THEN 'accepted' WHEN pn IS NOT NULL THEN 'changed' ELSE 'pending' END AS w FROM t2 t JOIN o ON o.playlist_id = t.playlist_id AND o.obs = 3),
 f AS (SELECT playlist_id, CASE WHEN w = 'accepted' THEN obs ELSE acc END AS acc, CASE WHEN w = 'accepted' THEN sure ELSE asure END AS asure, w AS verdict FROM v3),
 d AS (SELECT playlist_id, song_id, sum(x) AS x, sum(y) AS y FROM (SELECT playlist_id, song_id, 1 AS x, 0 AS y FROM occurrence WHERE quantity < 40 UNION ALL SELECT m.playlist_id, song_id, 0, 1 FROM m JOIN f ON f.playlist_id = m.playlist_id AND f.acc = m.obs) GROUP BY 1, 2),
 c AS (SELECT playlist_id, sum(greatest(y - x, 0)) AS added, sum(greatest(x - y, 0)) AS removed FROM d GROUP BY 1)
 SELECT f.playlist_id, verdict, acc AS accepted, CAST(CASE WHEN acc = 0 THEN 0 ELSE coalesce(added, 0) END AS BIGINT) AS added, CAST(CASE WHEN acc = 0 OR NOT asure THEN 0 ELSE coalesce(removed, 0) END AS BIGINT) AS removed, CAST(s0.n - CASE WHEN acc = 0 OR NOT asure THEN 0 ELSE coalesce(removed, 0) END AS BIGINT) AS kept
 FROM f JOIN s0 ON s0.playlist_id = f.playlist_id LEFT JOIN c ON c.playlist_id = f.playlist_id""",
    "set_multiset_max": "WITH c AS (SELECT \"key\", greatest(count(*) FILTER (event_id % 2 = 0), count(*) FILTER (event_id % 2 = 1 OR event_id % 6 = 0)) AS times FROM event WHERE type = 'block' GROUP BY 1) SELECT \"key\", CAST(unnest(range(1, times + 1)) AS INTEGER) AS copy FROM c",
    "win_trailing_rates": "WITH m AS (SELECT max(t) AS last FROM event), w AS (SELECT unnest([10, 30, 60, 120]) AS minutes) SELECT w.minutes, count(*) FILTER (type = 'download_start') AS starts, count(*) FILTER (type = 'mp3_verified') AS done, count(*) FILTER (type = 'block') AS blocks, round(count(*) FILTER (type = 'mp3_verified') * 1.0 / w.minutes, 6) AS rate FROM w, m, event e WHERE e.t > m.last - to_minutes(w.minutes) GROUP BY w.minutes",
    "win_overall_rate": "SELECT count(*) AS done, round(count(*) / ((epoch_us(max(t)) - epoch_us(min(t))) / 60e6), 6) AS per_minute FROM event WHERE type = 'mp3_verified'",
    "win_trip_episodes": "WITH b AS (SELECT *, coalesce(CAST(epoch_us(t) - lag(epoch_us(t)) OVER w > 43200000000 AS INTEGER), 1) AS new FROM event WHERE type = 'block' WINDOW w AS (PARTITION BY \"key\" ORDER BY t, event_id)), e AS (SELECT *, CAST(sum(new) OVER (PARTITION BY \"key\" ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS episode FROM b) SELECT \"key\", episode, count(*) AS blocks, count(*) > 1 AS repeated FROM e GROUP BY 1, 2",
    "win_phase_benchmark": """WITH c AS (SELECT "key", t, event_id, type, CASE WHEN type = 'block' THEN (1, 1, 8) ELSE (k % 4, k % 2, 8 * (k % 12)) END AS s FROM event WHERE type IN ('pace_change', 'block')),
 d AS (SELECT *, lag(s) OVER (PARTITION BY "key" ORDER BY t, event_id) AS was FROM c), e AS (SELECT "key", max(epoch_us(t)) AS over FROM event GROUP BY 1),
 p AS (SELECT d."key", epoch_us(t) AS start, CASE WHEN type = 'block' THEN epoch_us(t) + 43200000000 END AS cool, row_number() OVER (PARTITION BY d."key" ORDER BY t, event_id) AS phase, coalesce(epoch_us(lead(t) OVER (PARTITION BY d."key" ORDER BY t, event_id)), e.over) AS fin FROM d JOIN e ON e."key" = d."key" WHERE type = 'block' OR was IS NULL OR was <> s),
 n AS (SELECT p."key", phase, round(max(fin - start) / 60e6, 6) AS minutes, count(*) FILTER (e.type = 'mp3_verified' AND e.us >= start AND e.us < fin OR e.type = 'mp3_verified' AND fin = over AND e.us = fin) AS outputs, count(*) FILTER (e.type = 'block' AND e.us > start AND e.us <= fin) AS trips, count(*) FILTER (e.type = 'mp3_verified' AND e.us >= start AND (e.us < fin OR fin = over) AND e.us < cool) AS carry_over,
  CASE WHEN max(fin - start) >= 600000000 THEN count(*) FILTER (e.type = 'mp3_verified' AND e.us >= start AND (e.us < fin OR fin = over) AND e.us < start + 600000000) END AS first_10, CASE WHEN max(fin - start) >= 600000000 THEN count(*) FILTER (e.type = 'mp3_verified' AND e.us >= start AND (e.us < fin OR fin = over) AND e.us >= fin - 600000000) END AS last_10,
  CASE WHEN max(fin - start) >= 1800000000 THEN count(*) FILTER (e.type = 'mp3_verified' AND e.us >= start AND (e.us < fin OR fin = over) AND e.us >= fin - 1800000000) END AS last_30
  FROM (SELECT p.*, e.over FROM p JOIN e ON e."key" = p."key") p LEFT JOIN (SELECT "key", epoch_us(t) AS us, type FROM event WHERE type IN ('mp3_verified', 'block')) e ON e."key" = p."key" GROUP BY 1, 2)
 SELECT *, coalesce(round(outputs / nullif(minutes, 0), 6), 0.0) AS rate, coalesce(round((outputs - carry_over) / nullif(minutes, 0), 6), 0.0) AS recovered_rate FROM n""",
    "win_eta": "WITH c AS (SELECT \"key\", count(*) FILTER (type <> 'mp3_verified') AS remaining, count(*) FILTER (type = 'mp3_verified') / 60.0 AS rate FROM event GROUP BY 1) SELECT \"key\", remaining, round(CASE WHEN rate > 0 THEN remaining / rate / 60 END, 6) AS hours, round(CASE WHEN rate > 0 THEN remaining / rate / 60 * 1.25 END, 6) AS buffered_hours FROM c",
    "win_tempo_from_beats": "WITH g AS (SELECT \"key\", (lead(epoch_us(t)) OVER (PARTITION BY \"key\" ORDER BY t, event_id) - epoch_us(t)) / 1e6 AS gap FROM event), m AS (SELECT \"key\", quantile_cont(gap, 0.5) AS median FROM g WHERE gap > 0 GROUP BY 1) SELECT g.\"key\", count(*) AS gaps, round(max(median), 6) AS median_gap, round(60 / max(median), 6) AS per_minute, round(avg(CASE WHEN abs(gap - median) <= 0.15 * median THEN 1.0 ELSE 0.0 END), 6) AS regularity FROM g JOIN m ON m.\"key\" = g.\"key\" WHERE gap > 0 GROUP BY 1",
    "win_second_levels": "SELECT \"key\", CAST(floor(epoch_us(t) / 3600e6) AS BIGINT) AS bin, round(20 * log10(sqrt(avg(value * value)) + 1e-9), 6) AS level_db FROM event GROUP BY 1, 2",
    "win_active_span": f"WITH {BARS}, p AS (SELECT playlist_id, quantile_cont(rel_db, 0.9) AS p90 FROM bars GROUP BY 1) SELECT playlist_id, min(bar) AS first_bar, max(bar) AS last_bar, count(*) AS bars FROM bars JOIN p USING (playlist_id) WHERE rel_db >= p90 - 3.0 GROUP BY 1",
    "win_rolling_median": f"WITH {BARS} SELECT playlist_id, bar, round(quantile_cont(level, 0.5) OVER (PARTITION BY playlist_id ORDER BY bar ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS median FROM bars",
    "win_join_jumps": f"WITH {BARS}, j AS (SELECT playlist_id, abs(level - lag(level) OVER (PARTITION BY playlist_id ORDER BY bar)) AS jump FROM bars) SELECT playlist_id, max(jump) AS worst_jump, count(jump) AS joins FROM j GROUP BY 1",
    "win_timeline": f"WITH {BARS} SELECT playlist_id, bar, round(coalesce(sum(level) OVER (PARTITION BY playlist_id ORDER BY bar ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 2.0 * (bar - 1), 6) AS start FROM bars",
    "win_energy_tiers": f"WITH {ITEMS}, r AS (SELECT artist, song_id, row_number() OVER (PARTITION BY artist ORDER BY energy DESC, song_id) AS place, count(*) OVER (PARTITION BY artist) AS n FROM items) SELECT artist, song_id, CASE WHEN place <= round_even(n * 0.25, 0) THEN 'peak' WHEN place <= round_even(n * 0.25, 0) + round_even(n * 0.5, 0) THEN 'middle' ELSE 'rest' END AS tier FROM r",
    "vec_pool_normalize": f"WITH u AS ({UNIT}), p AS (SELECT label, CAST(i - 1 AS INTEGER) AS place, avg(v[i]) AS x FROM u, range(1, 65) r(i) GROUP BY 1, 2) SELECT label, place, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS x FROM p",
    "vec_knn_vote": f"WITH u AS ({UNIT}), s AS (SELECT a.vec_id, b.vec_id AS near, b.label, round(list_dot_product(a.v, b.v), 9) AS sim FROM u a JOIN u b ON b.vec_id % 3 = 0 AND a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, near) AS r FROM s), v AS (SELECT vec_id, label, round(sum(sim), 6) AS votes FROM r WHERE r <= 5 GROUP BY 1, 2) SELECT vec_id, label FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY votes DESC, label DESC) AS r FROM v) WHERE r = 1",
    "str_throughput": "WITH w AS (SELECT time_bucket(INTERVAL 10 MINUTE, t) - to_minutes(unnest([0, 10, 20])) AS start FROM event WHERE type = 'mp3_verified') SELECT start, count(*) AS done, round(count(*) / 30.0, 6) AS rate FROM w GROUP BY 1",
    "ingest_skip_done": "SELECT doc_id, sha256(concat(doc_id, '|', sha256(coalesce(text, '')), '|v1')) AS mark FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) OR doc_id % 7 = 0 AND coalesce(text, '') <> coalesce(reverse(text), '')",
    "fn_excluded_name": "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN true WHEN 1 THEN true ELSE regexp_matches(trim(coalesce(text, '')), '(?i)^(daily mix(es)?(\\s.*)?|dj|discover weekly|release radar|on repeat|repeat rewind|(your )?daily drive)$') END AS excluded FROM documents",
    "fn_genre_bucket": "SELECT doc_id, CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + f" THEN '{name}'" for name, words in planning.GENRES.items()) + " END AS bucket FROM documents",
    "fn_retry_class": "WITH e AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE ['HTTP Error 429: Too Many Requests', 'SIGN IN to confirm you are over 18', 'read TIMED OUT', 'youtube search failed (1)', 'got 5 Bytes Read', 'Media URL rejected (403)', 'network down', 'bot check', '" + planning.NO_CANDIDATE[0] + "', '" + planning.NO_CANDIDATE[1] + "', '" + planning.NO_MATCH + " for x', 'disk full'][doc_id % 12 + 1] END AS e FROM documents) SELECT doc_id, coalesce(" + " OR ".join(f"contains(lower(e), '{w.lower()}')" for w in planning.TRANSIENT) + ", false) AS transient, coalesce(regexp_matches(e, '(?i)network|timed out|timeout|rate limit|bot check|Media URL rejected \\(403\\)'), false) AS network, coalesce(e IN ('" + "', '".join(planning.NO_CANDIDATE) + "') OR starts_with(e, '" + planning.NO_MATCH + "'), false) AS candidate FROM e",
    "fn_tempo_match": "WITH o AS (SELECT p_partkey AS song_id, abs(p_size * 40.0 / p_retailprice - 1) * 100 AS one, abs(p_size * 40.0 / (0.5 * p_retailprice) - 1) * 100 AS half, abs(p_size * 40.0 / (2 * p_retailprice) - 1) * 100 AS two FROM part) SELECT song_id, CASE WHEN one <= least(half, two) + 0.5 THEN 1.0 WHEN half <= two THEN 0.5 ELSE 2.0 END AS ratio, round(CASE WHEN one <= least(half, two) + 0.5 THEN one ELSE least(half, two) END, 6) AS stretch FROM o",
    "fn_e_star": "WITH p AS (SELECT * FROM (VALUES (0.0, 0.25, 0.35, 0.55), (0.25, 0.6, 0.55, 0.9), (0.6, 0.85, 0.9, 1.0), (0.85, 1.0, 1.0, 0.7)) v(x0, x1, y0, y1)), n AS (SELECT DISTINCT l_linenumber AS n FROM lineitem) SELECT n, round(CAST(y0 AS DOUBLE) + (n / 7.0 - x0) * (y1 - y0) / (x1 - x0), 6) AS target FROM n JOIN p ON n / 7.0 > x0 AND n / 7.0 <= x1",
    "fn_query_variants": "WITH q AS (SELECT song_id, artist, name, concat(artist, CASE song_id % 3 WHEN 0 THEN ' feat. Other' WHEN 1 THEN '   Second' ELSE '' END, ' ', name, CASE song_id % 4 WHEN 0 THEN ' - 2011 Remastered' WHEN 1 THEN ' live' ELSE '' END) AS plain, concat(artist, CASE WHEN song_id % 3 = 1 THEN '   Second' ELSE '' END, ' ', name, CASE WHEN song_id % 4 = 1 THEN ' live' ELSE '' END) AS short, CASE WHEN song_id % 2 = 0 THEN bucket ELSE 'audio' END AS more FROM song) SELECT song_id, array_to_string([trim(regexp_replace(x, '\\s+', ' ', 'g')) FOR x IN [plain, concat(short, ' ', more), concat(short, ' official audio')]], '|') AS variants FROM q",
    "fn_camelot_distance": "SELECT p_partkey AS song_id, CASE WHEN p_partkey % 5 = 0 THEN 6 ELSE least(abs(p_partkey % 12 - 7), 12 - abs(p_partkey % 12 - 7)) + CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE 1 END END AS distance FROM part",
    "flt_playlist_view": "SELECT playlist_id, name FROM playlist WHERE name ILIKE '%#00000001%' AND status <> 4",
    "flt_eligibility": "SELECT doc_id, CASE WHEN n_chars IS NULL THEN 'needs_prep' WHEN n_chars < 200 THEN 'too_short' WHEN n_chars > 20000 THEN 'too_long' WHEN strpos(text, chr(10)) = 0 THEN 'no_excerpt' END AS reason FROM documents",
    "flt_block_assign": f"WITH {ITEMS}, b AS (SELECT song_id, concat(artist, '/', CASE WHEN tempo < 105 THEN 'slow' WHEN tempo < 130 THEN 'mid' ELSE 'fast' END) AS block FROM items) SELECT song_id, CASE WHEN count(*) OVER (PARTITION BY block) < 3 THEN 'close' ELSE block END AS block FROM b",
    "flt_fast_skip": "SELECT playlist_id FROM playlist WHERE status = 5 AND rank % 7 <> 0 AND NOT skipped",
    "join_review_status": "WITH w AS (SELECT doc_id, max(CASE WHEN toxic = 1 THEN 2 WHEN quality = 1 THEN 0 ELSE 1 END) AS r FROM labels GROUP BY 1) SELECT d.doc_id, CASE r WHEN 2 THEN 'needs-repair' WHEN 1 THEN 'needs-review' WHEN 0 THEN 'resolved' ELSE 'none' END AS status FROM documents d LEFT JOIN w ON w.doc_id = d.doc_id",
    "join_nearest_grid": "WITH p AS (SELECT e.event_id, e.\"key\", epoch_us(g.t) - epoch_us(e.t) AS gap FROM event e JOIN event g ON g.\"key\" = e.\"key\" AND g.type = 'download_start' WHERE e.type <> 'download_start'), r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY abs(gap), gap) AS r FROM p) SELECT \"key\", event_id, round(gap / 1e6, 6) AS shift_s FROM r WHERE r = 1 AND abs(gap) <= 36000000000",
    "agg_review_metrics": "WITH w AS (SELECT d.doc_id, max(CASE WHEN toxic = 1 THEN 2 WHEN quality = 1 THEN 0 WHEN quality IS NOT NULL THEN 1 END) AS r FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1) SELECT count(*) FILTER (r >= 1) AS open, count(*) FILTER (r = 2) AS repair, count(*) FILTER (r = 0) AS resolved, count(*) FILTER (r IS NULL) AS unreviewed FROM w",
    "agg_resume_plan": "SELECT CASE WHEN status = 4 THEN 'saved' WHEN skipped THEN 'missing' WHEN status = 5 AND rank % 3 <> 0 THEN 'error' WHEN rank % 11 < 5 THEN 'ready' ELSE 'pending' END AS state, count(*) AS n FROM playlist GROUP BY 1",
    "set_snapshot_drift": "WITH a AS (SELECT playlist_id, string_agg(CAST(song_id AS VARCHAR), ',' ORDER BY seq) AS h, count(*) AS n FROM occurrence WHERE playlist_id % 9 <> 0 GROUP BY 1), b AS (SELECT playlist_id, string_agg(CAST(song_id AS VARCHAR), ',' ORDER BY seq) AS h, count(*) AS n FROM occurrence WHERE quantity > 3 GROUP BY 1) SELECT b.playlist_id, concat_ws(',', CASE WHEN a.h IS NULL THEN 'no-baseline' END, CASE WHEN a.h <> b.h THEN 'snapshot-changed' END, CASE WHEN a.n <> b.n THEN 'count-changed' END) AS reasons FROM b LEFT JOIN a ON a.playlist_id = b.playlist_id WHERE a.h IS NULL OR a.h <> b.h OR a.n <> b.n",
    "set_removed_work": "SELECT playlist_id, song_id, seq FROM occurrence WHERE song_id IN (SELECT song_id FROM occurrence WHERE quantity < 10) AND song_id NOT IN (SELECT song_id FROM occurrence WHERE quantity > 45)",
    "set_affected_rows": "SELECT playlist_id, song_id, seq FROM occurrence WHERE song_id IN (SELECT song_id FROM occurrence WHERE quantity = 50 AND song_id % 7 = 0)",
    "win_curve_bins": "WITH f AS (SELECT \"key\", CAST(floor(epoch_us(t) / 43200e6) AS BIGINT) AS bin, avg(value) AS mean FROM event GROUP BY 1, 2), s AS (SELECT \"key\", unnest(range(min(bin), max(bin) + 1)) AS bin FROM f GROUP BY 1) SELECT s.\"key\", s.bin, round(mean, 6) AS mean FROM s LEFT JOIN f ON f.\"key\" = s.\"key\" AND f.bin = s.bin",
    "top_ready_order": "SELECT playlist_id, rank, row_number() OVER (ORDER BY last_played DESC, rank, playlist_id) AS place FROM playlist WHERE status = 0 AND NOT skipped",
    "vec_cosine_distance": f"WITH u AS ({UNIT}) SELECT a.vec_id AS a, b.vec_id AS b, round(1 - list_dot_product(a.v, b.v), 5) AS distance FROM u a JOIN u b ON a.label = b.label WHERE a.vec_id % 100 = 0",
    "vec_kernel_regression": f"WITH u AS ({UNIT}) SELECT a.vec_id, round(sum(exp(-(1 - list_dot_product(a.v, b.v)) / 0.2) * b.label) / sum(exp(-(1 - list_dot_product(a.v, b.v)) / 0.2)), 6) AS value FROM u a, u b WHERE b.vec_id % 100 = 0 GROUP BY 1",
    "fn_public_text": "SELECT doc_id, md5(nullif(substr(trim(regexp_replace(text, '[\\x00-\\x1f\\x7f]', ' ', 'g')), 1, 500), '')) AS text_md5 FROM documents",
    "fn_camelot": "SELECT p_partkey AS song_id, CASE p_partkey % 10 WHEN 0 THEN '8B' WHEN 1 THEN '12A' WHEN 2 THEN '10B' WHEN 3 THEN '3A' WHEN 5 THEN '5A' WHEN 6 THEN '3B' WHEN 7 THEN '7A' WHEN 8 THEN '6B' ELSE '?' END AS code FROM part",
    "fn_artist_set": "SELECT song_id, concat(lower(artist), '|zed') AS artists FROM song",
    "fn_credits_match": "SELECT song_id, CASE WHEN song_id % 7 = 0 THEN song_id % 5 = 2 ELSE song_id % 5 < 2 END AS ok FROM song",
    "flt_identity": "SELECT song_id, CASE song_id % 5 WHEN 0 THEN 'missing-title' WHEN 1 THEN 'match' WHEN 2 THEN 'edition-mismatch' WHEN 3 THEN 'title-mismatch' ELSE 'artist-mismatch' END AS verdict FROM song",
    "flt_beatable": "WITH g AS (SELECT \"key\", (lead(epoch_us(t)) OVER (PARTITION BY \"key\" ORDER BY t, event_id) - epoch_us(t)) / 1e6 AS gap FROM event), m AS (SELECT \"key\", quantile_cont(gap, 0.5) AS median FROM g WHERE gap > 0 GROUP BY 1) SELECT g.\"key\", count(*) AS gaps FROM g JOIN m ON m.\"key\" = g.\"key\" WHERE gap > 0 GROUP BY 1 HAVING count(*) >= 8 AND round(avg(CASE WHEN abs(gap - median) <= 0.15 * median THEN 1.0 ELSE 0.0 END), 6) >= 0.1",
    "join_media_resolve": f"WITH f AS (SELECT song_id, folder, path, {reason()} AS reason FROM file WHERE path NOT LIKE '%7/%'), c AS (SELECT o.playlist_id, o.seq, f.path, f.reason, row_number() OVER (PARTITION BY o.playlist_id, o.seq ORDER BY CASE WHEN f.reason = 'match' THEN 0 ELSE 1 END, CASE WHEN f.folder = o.folder THEN 0 ELSE 1 END, f.path) AS r FROM occurrence o LEFT JOIN f ON f.song_id = o.song_id) SELECT playlist_id, seq, path, CASE WHEN reason IS NULL THEN 'missing' WHEN reason = 'match' THEN 'duration-match' WHEN reason = 'mismatch' THEN 'mismatch' ELSE 'unverified' END AS verdict FROM c WHERE r = 1",
    "join_presence": "WITH l AS (SELECT playlist_id, arg_max(quantity > 20, seq) AS returned FROM occurrence WHERE n % 2 = 0 GROUP BY 1) SELECT p.playlist_id, CASE WHEN returned THEN 'present' WHEN NOT returned THEN 'not-returned' ELSE 'unknown' END AS state FROM playlist p LEFT JOIN l ON l.playlist_id = p.playlist_id",
    "join_ratings_last": "SELECT a, b, vote FROM (SELECT \"key\" % 10 AS a, k % 10 AS b, CASE WHEN type <> 'block' THEN k END AS vote, row_number() OVER (PARTITION BY \"key\" % 10, k % 10 ORDER BY t DESC, event_id DESC) AS r FROM event) WHERE r = 1 AND vote IS NOT NULL",
    "join_event_interval": "SELECT f.\"key\", f.event_id AS file_id, count(*) AS events, min(e.event_id) AS first_event FROM event f JOIN event e ON e.\"key\" = f.\"key\" AND e.type = 'mp3_verified' AND CAST(e.t AS DATE) >= CAST(f.t AS DATE) AND epoch_us(e.t) - epoch_us(f.t) BETWEEN -1000000 AND 172800000000 WHERE f.type = 'download_start' GROUP BY 1, 2",
    "join_exclusion_overlap": "SELECT p.\"key\", p.event_id AS phase, count(*) AS overlaps FROM event p JOIN event b ON b.\"key\" = p.\"key\" AND b.type = 'block' AND p.t < b.t + INTERVAL 2 HOUR AND b.t < p.t + INTERVAL 6 HOUR WHERE p.type = 'download_start' GROUP BY 1, 2",
    "agg_grid_report": "SELECT l_returnflag AS class, count(*) AS n, round(quantile_cont(l_quantity, 0.1), 6) AS p10, round(quantile_cont(l_quantity, 0.5), 6) AS p50, round(quantile_cont(l_quantity, 0.9), 6) AS p90, " + ", ".join(f"count(*) FILTER (l_quantity >= {a} AND l_quantity < {b}) AS bin_{k}" for k, (a, b) in enumerate([(0, 10), (10, 20), (20, 30), (30, 40), (40, 51)])) + " FROM lineitem GROUP BY 1",
    "win_tempo_refine": "WITH s AS (SELECT \"key\", (lead(epoch_us(t), 8) OVER (PARTITION BY \"key\" ORDER BY t, event_id) - epoch_us(t)) / 1e6 AS s FROM event), m AS (SELECT \"key\", quantile_cont(s, 0.5) AS m FROM s WHERE s > 0 GROUP BY 1) SELECT s.\"key\", count(*) AS spans, round(480.0 / avg(s), 6) AS per_minute FROM s JOIN m ON m.\"key\" = s.\"key\" WHERE s > 0 AND abs(s - m) <= 0.5 * m GROUP BY 1",
    "win_join_profile": f"WITH {BARS}, l AS (SELECT *, max(bar) OVER (PARTITION BY playlist_id) AS last FROM bars) SELECT playlist_id, round(avg(level) FILTER (bar <= 3) - avg(level), 6) AS entry, round(avg(level) FILTER (bar > last - 3) - avg(level), 6) AS \"exit\" FROM l GROUP BY 1",
    "set_changed_keys": "SELECT DISTINCT f.song_id FROM file f WHERE (f.dev, f.ino) IN (SELECT (dev, ino) FROM file WHERE folder % 50 = 3)",
    "join_legacy_fallback": "SELECT concat('spotify:', song_id) AS song_key, CASE WHEN song_id % 4 = 0 THEN 'saved' ELSE 'missing' END AS state, CASE WHEN song_id % 4 = 0 THEN 'u' END AS url, song_id % 4 <> 0 AS legacy FROM song WHERE song_id % 4 = 0 OR song_id % 6 = 0",
    "top_labels": "WITH m AS (SELECT label AS series, i - 1 AS class, round(avg(CAST(embedding[i] AS DOUBLE)), 6) AS mean FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2) SELECT series, CAST(class AS INTEGER) AS class, mean, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY mean DESC, class) AS place FROM m) WHERE place <= 5",
    "fn_source_id": "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN lpad(CAST(page_id AS VARCHAR), 22, 'a') END AS source_id FROM pages",
    "fn_display_name": "SELECT song_id, CASE WHEN song_id % 2 = 0 THEN artist ELSE '' END AS artist, name AS title FROM song",
    "join_queue_prune": "SELECT o.playlist_id, count(f.song_id) AS satisfied, count(*) - count(f.song_id) AS open FROM occurrence o LEFT JOIN (SELECT DISTINCT song_id FROM file WHERE seconds > 300) f ON f.song_id = o.song_id GROUP BY 1",
    "agg_conflict_files": f"WITH m AS (SELECT artist, name FROM song GROUP BY 1, 2 HAVING count(DISTINCT expected_ms) > 1) SELECT CASE WHEN f.path IS NULL THEN 'no-file' ELSE {reason('f.expected_ms', 'f.seconds')} END AS verdict, count(*) AS n, count(DISTINCT s.song_id) AS songs FROM song s JOIN m ON m.artist = s.artist AND m.name = s.name LEFT JOIN file f ON f.song_id = s.song_id AND f.song_id % 13 <> 0 GROUP BY 1",
    "vec_zero_shot": f"WITH u AS ({UNIT}), e AS (SELECT a.vec_id, b.vec_id AS prompt, exp(10 * list_dot_product(a.v, b.v)) AS e FROM u a JOIN u b ON b.vec_id < 4) SELECT vec_id, arg_max(prompt, e) AS prompt, round(max(e) / sum(e), 6) AS share FROM e GROUP BY 1",
    "win_nearest_section": f"WITH u AS ({UNIT}), n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos FROM u), p AS (SELECT concat(label, '-', pos // 40) AS series, pos % 40 // 8 AS section, i AS place, avg(v[i]) AS x FROM n, range(1, 65) r(i) GROUP BY 1, 2, 3), q AS (SELECT series, section, place, round(x / sqrt(sum(x * x) OVER (PARTITION BY series, section)), 6) AS x FROM p), s AS (SELECT a.series, a.section, b.section AS other, sum(a.x * b.x) AS sim FROM q a JOIN q b ON a.series = b.series AND a.place = b.place AND a.section <> b.section GROUP BY 1, 2, 3) SELECT series, section, round(1 - max(sim), 4) AS distance FROM s GROUP BY 1, 2",
}

SQL = {name: with_views(sql) for name, sql in _SQL.items()}
