"""Queries that run the events table as a finite stream, and the SQL of their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import SparkSession as S

from trackloom.functions import keys
from trackloom.sources import views
from trackloom.sources.views import with_views
from trackloom.streaming import journal, live, timed


def _events(s: S, d: str) -> DataFrame:
    """The events as a stream of three micro-batches, dealt out so that older events come after newer ones."""
    rows = views.event(s, d).select("event_id", F.timestamp_micros(keys.micros("t")).alias("t"), F.col("key").cast("long").alias("key"), "type", F.col("k").cast("int").alias("k"))
    return live.in_files(rows, F.pmod(F.col("event_id"), F.lit(3)))


def _requests(s: S, d: str) -> DataFrame:
    e = views.event(s, d)
    request = F.concat_ws("-", F.col("key").cast("string"), (F.coalesce("k", F.lit(0)) % 3).cast("string"))
    rows = e.select(request.alias("key"), "event_id", keys.micros("t").alias("t_us"), F.when(F.col("event_id") % 7 == 0, "other").otherwise("same").alias("type"), (F.col("type") == "mp3_verified").cast("long").alias("value"))
    return timed.replayed(s, rows, timed.idempotent_requests)


REQUEST_SQL = """WITH r AS (SELECT concat("key", '-', coalesce(k, 0) % 3) AS request, CASE WHEN event_id % 7 = 0 THEN 'other' ELSE 'same' END AS fp, type = 'mp3_verified' AS completes, t, event_id FROM event),
 f AS (SELECT *, first_value(fp) OVER w AS first, row_number() OVER w AS n FROM r WINDOW w AS (PARTITION BY request ORDER BY t, event_id)),
 c AS (SELECT *, coalesce(bool_or(completes AND fp = first) OVER (PARTITION BY request ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS completed FROM f)
 SELECT request, event_id, CASE WHEN n = 1 THEN 'admitted' WHEN fp <> first THEN 'conflict' WHEN completed THEN 'completed' ELSE 'unfinished' END AS verdict FROM c"""


def _checkpoints(s: S, d: str) -> DataFrame:
    e = _events(s, d).where("type is not null")
    rows = e.select("key", F.col("type").alias("state"), F.coalesce("k", F.lit(0)).alias("attempts"), F.when(F.col("type") == "block", "blocked").alias("error"), "t", "event_id")
    return journal.journal_upsert(rows, ["key"], ["t", "event_id"]).select("key", "state", "attempts", "error", "event_id")


CHECKPOINT_SQL = """SELECT "key", arg_max(type, (t, event_id)) AS state, arg_max(coalesce(k, 0), (t, event_id)) AS attempts, CASE WHEN arg_max(type, (t, event_id)) = 'block' THEN 'blocked' END AS error, arg_max(event_id, (t, event_id)) AS event_id FROM event WHERE type IS NOT NULL GROUP BY 1"""


def _coverage(s: S, d: str) -> DataFrame:
    state = F.when(F.col("type") == "mp3_verified", "saved").when(F.col("type") == "block", "failed").otherwise("open")
    rows = _events(s, d).select(F.col("key").alias("playlist_id"), (F.coalesce("k", F.lit(0)) % 12).alias("track"), state.alias("state"), "t", "event_id")
    return journal.live_coverage(rows)


COVERAGE_SQL = """WITH s AS (SELECT "key" AS playlist_id, coalesce(k, 0) % 12 AS track, arg_max(type, (t, event_id)) AS type FROM event GROUP BY 1, 2), c AS (SELECT playlist_id, count(*) AS tracks, count(*) FILTER (type = 'mp3_verified') AS on_disk, count(*) FILTER (type = 'block') AS failed FROM s GROUP BY 1)
 SELECT playlist_id, tracks, on_disk, failed, CAST(floor(on_disk * 100 / tracks + 0.5) AS BIGINT) AS percent, on_disk + failed >= tracks AS done FROM c"""

QUIET_S = 6 * 3600


def _alerts(s: S, d: str) -> DataFrame:
    kind = F.when((F.col("type") == "block") & (F.coalesce("k", F.lit(0)) % 10 != 3), "block").otherwise("other")
    rows = views.event(s, d).select(F.col("key").cast("long").alias("key"), "event_id", keys.micros("t").alias("t_us"), kind.alias("kind"), F.when(F.col("type") == "search_ok", F.col("k").cast("long")).alias("value"))
    return timed.replayed(s, rows.withColumnRenamed("kind", "type"), lambda e: timed.error_alerts(e, QUIET_S))


ALERT_SQL = f"""WITH r AS (SELECT "key" AS k2, t, event_id, type = 'block' AND coalesce(k, 0) % 10 <> 3 AS block, CASE WHEN type = 'search_ok' THEN k END AS errors FROM event),
 b AS (SELECT *, last_value(errors IGNORE NULLS) OVER (PARTITION BY k2 ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r),
 c AS (SELECT *, CASE WHEN block THEN 'block' WHEN errors > before THEN 'errors' END AS cause FROM b), g AS (SELECT *, floor(epoch_us(t) / 1000000) - lag(floor(epoch_us(t) / 1000000)) OVER (PARTITION BY k2 ORDER BY t, event_id) AS gap FROM c WHERE cause IS NOT NULL)
 SELECT k2 AS "key", event_id, cause FROM g WHERE gap IS NULL OR gap > {QUIET_S}"""


# ---- fixed batches and the search for a pace, as streams over several files

HOLD_MS = 6 * 3_600_000
PACE = timed.Pace(clean_us=20 * 3_600_000_000, again_us=48 * 3_600_000_000, cool_us=3_600_000_000, long_us=3 * 3_600_000_000)


def _batches(s: S, d: str) -> DataFrame:
    rows = timed.event_rows(views.event(s, d)).where("key is not null")
    return timed.replayed(s, rows, lambda e: timed.change_batches(e, HOLD_MS))


BATCH_SQL = f"""WITH RECURSIVE e AS (SELECT "key" AS id, epoch_us(t) AS t, type FROM event), b(id, start) AS (SELECT id, min(t) FROM e GROUP BY 1
 UNION ALL SELECT b.id, (SELECT min(e.t) FROM e WHERE e.id = b.id AND e.t >= b.start + {HOLD_MS * 1000}) AS start FROM b WHERE start IS NOT NULL)
 SELECT b.id AS "key", b.start AS start_us, count(*) AS notices, string_agg(DISTINCT e.type, ',' ORDER BY e.type) AS kinds FROM b JOIN e ON e.id = b.id AND e.t >= b.start AND e.t < b.start + {HOLD_MS * 1000} GROUP BY 1, 2"""


def _trips(s: S, d: str) -> DataFrame:
    rows = timed.event_rows(views.event(s, d)).where("key is not null")
    return timed.replayed(s, rows, lambda e: timed.trip_state(e, PACE))


_MID = "CASE WHEN fail > good + 1 THEN greatest((good + fail) // 2, good + 1) END"
_DUE = f"CASE WHEN {_MID} <> cur AND {_MID} <= {timed.CAP} THEN greatest(coalesce(bot, 0), coalesce(step, 0)) + {PACE.clean_us} END"
TRIP_SQL = f"""WITH RECURSIVE e AS (SELECT "key" AS id, event_id, epoch_us(t) AS t, type, 8 * (k % 12) AS value, row_number() OVER (PARTITION BY "key" ORDER BY t, event_id) AS n FROM event WHERE type IN ('pace_change', 'mp3_verified', 'block') AND (type <> 'pace_change' OR k IS NOT NULL)),
 ends AS (SELECT * FROM e UNION ALL SELECT id, NULL, {timed.END_US}, 'end', NULL, max(n) + 1 FROM e GROUP BY 1),
 s(id, n, t, event_id, type, probe_at, probe, was, cur, good, fail, cool, bot, step) AS (
  SELECT id, 0::BIGINT, 0::BIGINT, NULL::BIGINT, 'start', NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, {timed.FLOOR}::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT FROM e GROUP BY id
  UNION ALL
  SELECT id, n, t, event_id, type, probe_at, probe, set_at, CASE type WHEN 'pace_change' THEN greatest({timed.FLOOR}, least({timed.CAP}, value)) WHEN 'block' THEN {timed.FLOOR} ELSE set_at END,
   CASE WHEN type = 'mp3_verified' AND good < set_at AND set_at < fail THEN set_at WHEN type = 'block' AND set_at > {timed.FLOOR} AND (good IS NULL OR good >= set_at) THEN {timed.FLOOR} ELSE good END,
   CASE WHEN type = 'block' AND set_at > {timed.FLOOR} THEN least(coalesce(fail, set_at), set_at) ELSE fail END,
   CASE WHEN type = 'block' THEN greatest(coalesce(cool, 0), t + CASE WHEN set_at <= {timed.FLOOR} AND t - bot < {PACE.again_us} THEN {PACE.long_us} ELSE {PACE.cool_us} END) ELSE cool END,
   CASE WHEN type = 'block' THEN t ELSE bot END, CASE WHEN type = 'block' THEN t WHEN probe_at IS NOT NULL THEN probe_at ELSE step END
  FROM (SELECT *, CASE WHEN due <= t THEN due END AS probe_at, CASE WHEN due <= t THEN mid END AS probe, CASE WHEN due <= t THEN mid ELSE cur END AS set_at
   FROM (SELECT e.id, e.n, e.t, e.event_id, e.type, e.value, cur, good, fail, cool, bot, step, {_DUE} AS due, {_MID} AS mid FROM s JOIN ends e ON e.id = s.id AND e.n = s.n + 1))),
 o AS (SELECT s.*, lag(cur) OVER w AS cur0, lag(good) OVER w AS good0, lag(fail) OVER w AS fail0, lag(cool) OVER w AS cool0, lag(bot) OVER w AS bot0 FROM s WINDOW w AS (PARTITION BY id ORDER BY n))
 SELECT id AS "key", probe_at AS at_us, NULL::BIGINT AS event_id, 'probe' AS kind, cur0 AS was, probe AS now, good0 AS good, fail0 AS fail, cool0 AS cool_until_us FROM o WHERE probe_at IS NOT NULL
 UNION ALL SELECT id, t, event_id, CASE WHEN was > {timed.FLOOR} THEN 'trip' WHEN t - bot0 < {PACE.again_us} THEN 'repeat' ELSE 'floor' END, was, {timed.FLOOR}, good, fail, cool FROM o WHERE type = 'block'"""


QUERIES = {"str_idempotent_requests": _requests, "str_journal_upsert": _checkpoints, "str_live_coverage": _coverage, "str_error_alert": _alerts, "str_change_batches": _batches, "str_trip_state": _trips}

SQL = {name: with_views(sql) for name, sql in {"str_idempotent_requests": REQUEST_SQL, "str_journal_upsert": CHECKPOINT_SQL, "str_live_coverage": COVERAGE_SQL, "str_error_alert": ALERT_SQL, "str_change_batches": BATCH_SQL, "str_trip_state": TRIP_SQL}.items()}
