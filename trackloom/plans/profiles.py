"""Queries of the profile operators over the driver tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import SparkSession as S

from trackloom.functions import keys
from trackloom.operators import profiles
from trackloom.plans.ingest import one_of
from trackloom.plans.oracle import UNIT
from trackloom.sources import views
from trackloom.sources.views import with_views

C = profiles.COST

# ---- items in blocks


def block_items(s: S, d: str) -> DataFrame:
    n = F.col("p_partkey")
    block = one_of(n % 3, "house", "dnb", "swing")
    tempo = one_of(n % 3, 120 + n % 8 + F.col("p_size") / 100, 160 + n % 19 + F.col("p_size") / 100, 78 + n % 11 + F.col("p_size") / 100)
    return views.table(s, d, "part").select(
        n.alias("song_id"), block.alias("block"), tempo.alias("tempo"), (F.col("p_size") / 50.0).alias("energy"), F.col("p_brand").alias("artist"), F.col("p_type").alias("bucket"),
        F.concat((n % 12 + 1).cast("string"), F.when(n % 2 == 0, "A").otherwise("B")).alias("camelot"), F.when(n % 10 != 0, (n * 7 % 100) / 20.0).alias("timbre"), (n % 4 != 0).alias("harmonic"), (n % 5 != 0).alias("locked"),
    )


ITEMS = """items AS (SELECT p_partkey AS song_id, ['house', 'dnb', 'swing'][p_partkey % 3 + 1] AS block, CASE p_partkey % 3 WHEN 0 THEN 120 + p_partkey % 8 WHEN 1 THEN 160 + p_partkey % 19 ELSE 78 + p_partkey % 11 END + p_size / 100.0 AS tempo, p_size / 50.0 AS energy, p_brand AS artist, p_type AS bucket,
 p_partkey % 12 + 1 AS wheel, p_partkey % 2 AS letter, CASE WHEN p_partkey % 10 <> 0 THEN (p_partkey * 7 % 100) / 20.0 END AS timbre, p_partkey % 4 <> 0 AS harmonic, p_partkey % 5 <> 0 AS locked FROM part)"""
PAIR_SQL = f"""WITH {ITEMS}
 SELECT a.block, a.song_id AS a, b.song_id AS b, round({C['tempo']} * abs(ln(b.tempo / a.tempo)) + {C['step']} * greatest(0.0, abs(b.energy - a.energy) - {C['step_free']})
 + CASE WHEN b.harmonic THEN {C['key']} * greatest(0, least(abs(a.wheel - b.wheel), 12 - abs(a.wheel - b.wheel)) + CASE WHEN a.letter <> b.letter THEN 1 ELSE 0 END - 1) ELSE 0 END
 + {C['timbre']} * CASE WHEN a.timbre IS NULL OR b.timbre IS NULL THEN 1.0 ELSE least(2.0, abs(a.timbre - b.timbre)) END + CASE WHEN a.artist = b.artist THEN {C['same_artist']} ELSE 0 END + CASE WHEN a.bucket <> b.bucket THEN {C['bucket']} ELSE 0 END
 + CASE WHEN a.block = 'house' AND b.tempo < a.tempo - {C['house_down_bpm']} THEN {C['house_down']} ELSE 0 END, 6) AS cost FROM items a JOIN items b ON a.block = b.block AND a.song_id <> b.song_id AND a.song_id % 100 = 0"""
BRIDGE_SQL = f"""WITH {ITEMS}, c AS (SELECT a.song_id AS a, b.song_id AS b, abs(a.tempo / (b.tempo * 2) - 1) AS dev, {C['tempo']} * ln(1 + abs(a.tempo / (b.tempo * 2) - 1)) + {C['step']} * greatest(0.0, abs(a.energy - b.energy) - {C['step_free']}) AS cost
 FROM items a JOIN items b ON a.block = 'dnb' AND b.block = 'swing' AND a.locked AND b.locked) SELECT a, b, round(dev, 6) AS deviation, round(cost, 6) AS cost FROM c WHERE dev <= 0.06 ORDER BY 4, a, b LIMIT 1"""

# ---- distances of all pairs


def _distances(s: S, d: str, code: Column, kinds: dict[tuple[int, int], int] | None = None) -> DataFrame:
    v = views.table(s, d, "embeddings").withColumn("code", code)
    return profiles.distance_counts(v, kinds=kinds)


PAIRS = f"u AS ({UNIT}), pairs AS (SELECT a.vec_id AS a, b.vec_id AS b, CAST(round((1 - list_dot_product(a.v, b.v)) * 10000) AS BIGINT) AS distance FROM u a JOIN u b ON a.vec_id < b.vec_id)"
MOOD_SQL = f"WITH {PAIRS} SELECT count(*) AS pairs, round(quantile_cont(distance, 0.5) / 10000, 6) AS typical, round(quantile_cont(distance, 0.9) / 10000, 6) AS clash FROM pairs"


def _threshold(s: S, d: str) -> DataFrame:
    code = lambda c: F.concat((F.col(c) + 1).cast("string"), F.when(F.col(c) % 2 == 0, "A").otherwise("B"))
    twelve = s.range(12).select(F.col("id").cast("int").alias("a"))
    apart = twelve.crossJoin(twelve.withColumnRenamed("a", "b")).select("a", "b", keys.camelot_distance(code("a"), code("b")).alias("apart"))
    kinds = {(r.a, r.b): int(r.apart <= 1) for r in apart.where("apart <= 1 or apart >= 3").collect()}  # of the wheel's codes
    side = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0))
    counts = _distances(s, d, F.pmod("vec_id", F.lit(12)), kinds).groupBy((profiles.STEPS - F.col("distance")).alias("cosine"))
    return profiles.key_threshold(counts.agg(side(1).alias("ok"), side(0).alias("clash")))


THRESHOLD_SQL = f"""WITH {PAIRS}, w AS (SELECT 10000 - distance AS cosine, least(abs(a % 12 - b % 12), 12 - abs(a % 12 - b % 12)) + CASE WHEN a % 2 <> b % 2 THEN 1 ELSE 0 END AS apart FROM pairs),
 c AS (SELECT cosine, count(*) FILTER (apart <= 1) AS ok, count(*) FILTER (apart >= 3) AS clash FROM w WHERE apart <= 1 OR apart >= 3 GROUP BY 1), t AS (SELECT sum(ok) AS n_ok, sum(clash) AS n_clash FROM c),
 g AS (SELECT x * 100 AS x, coalesce(sum(ok) FILTER (cosine >= x * 100), 0) / any_value(n_ok) - coalesce(sum(clash) FILTER (cosine >= x * 100), 0) / any_value(n_clash) AS j FROM range(-50, 96) r(x), c, t GROUP BY 1),
 best AS (SELECT x, j FROM g ORDER BY round(j, 9) DESC, x DESC LIMIT 1), k AS (SELECT *, n_ok >= 20 AND n_clash >= 20 AS enough, CASE WHEN n_ok >= 20 AND n_clash >= 20 THEN least(0.9, greatest(0.1, x / 10000.0)) ELSE 0.5 END AS threshold FROM t, best)
 SELECT any_value(threshold) AS threshold, any_value(CASE WHEN enough THEN round(j, 6) END) AS youden, CAST(any_value(n_ok) AS BIGINT) AS compatible, CAST(any_value(n_clash) AS BIGINT) AS clashing,
 round((SELECT sum(a.ok * (coalesce((SELECT sum(b.clash) FROM c b WHERE b.cosine < a.cosine), 0) + a.clash / 2.0)) FROM c a) / any_value(n_ok * n_clash), 6) AS auc,
 round(coalesce(sum(ok) FILTER (cosine >= round(threshold * 10000)), 0) / any_value(n_ok), 6) AS accept_compatible, round(coalesce(sum(clash) FILTER (cosine >= round(threshold * 10000)), 0) / any_value(n_clash), 6) AS accept_clashing FROM c, k"""


def _profiles(s: S, d: str) -> DataFrame:
    v = views.table(s, d, "embeddings").select(F.col("label").alias("series"), F.when(F.col("vec_id") % 3 == 0, "exit").otherwise("landing").alias("part"), F.col("embedding").alias("chroma"))
    return profiles.key_profiles(v)


def _key_profile(s: S, d: str) -> DataFrame:
    p = _profiles(s, d)
    return p.join(profiles.profile_correlation(p, "exit", "landing"), "series", "left").select("series", "part", "bin", F.round("x", 5).alias("x"), F.round("correlation", 5).alias("correlation"))


PROFILE_SQL = """WITH m AS (SELECT label AS series, CASE WHEN vec_id % 3 = 0 THEN 'exit' ELSE 'landing' END AS part, i - 1 AS bin, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, range(1, 13) r(i) GROUP BY 1, 2, 3),
 c AS (SELECT series, part, bin, x - avg(x) OVER (PARTITION BY series, part) AS x FROM m), p AS (SELECT series, part, bin, x / sqrt(sum(x * x) OVER (PARTITION BY series, part)) AS x FROM c),
 k AS (SELECT a.series, round(sum(a.x * b.x), 5) AS correlation FROM p a JOIN p b ON a.series = b.series AND a.bin = b.bin AND a.part = 'exit' AND b.part = 'landing' GROUP BY 1)
 SELECT p.series, p.part, CAST(p.bin AS INTEGER) AS bin, round(p.x, 5) AS x, k.correlation FROM p LEFT JOIN k ON k.series = p.series"""

# ---- levels and slots


def _levels(s: S, d: str) -> DataFrame:
    n = F.col("p_partkey")
    rows = views.table(s, d, "part").select(n.alias("song_id"), (F.col("p_size") / 50.0).alias("raw"), F.when(n % 4 == 0, (n % 5 + 1).cast("double")).alias("label"), one_of(n % 5, "dance", "rock", "chill", "jazz", None).alias("genre"), F.col("p_brand").alias("bucket"), (n % 3 == 0).alias("anchored"))
    return profiles.level_blend(rows)


LEVEL_SQL = """WITH p AS (SELECT p_partkey AS n, p_size / 50.0 AS raw, CASE WHEN p_partkey % 4 = 0 THEN p_partkey % 5 + 1 END AS label, ['dance', 'rock', 'chill', 'jazz', NULL][p_partkey % 5 + 1] AS genre, p_brand AS bucket, p_partkey % 3 = 0 AS anchored FROM part),
 m AS (SELECT *, 1 + 4 * raw + greatest(-0.3, least(0.3, 0.15 * (raw - avg(raw) OVER ()) / stddev_pop(raw) OVER ())) AS model FROM p), l AS (SELECT *, coalesce(label + 0.25 * greatest(-1.0, least(1.0, model - label)), model) AS level FROM m)
 SELECT n AS song_id, round(level, 3) AS level, round((least(5.0, greatest(1.0, level)) - 1) / 4, 6) AS share, CASE WHEN genre IN ('dance', 'rock', 'chill') AND NOT anchored THEN genre ELSE bucket END AS bucket FROM l"""


def _slots(s: S, d: str) -> DataFrame:
    n = F.col("p_partkey")
    by = Window.partitionBy("p_brand").orderBy("p_partkey")
    rows = views.table(s, d, "part").select(n.alias("song_id"), "p_brand", (F.col("p_size") / 50.0).alias("energy"), one_of(n % 5, "dance", "rock", "chill", "dance", "rock").alias("bucket"), "p_partkey")
    rows = rows.withColumn("before", F.lag("energy").over(by)).withColumn("bucket_before", F.lag("bucket").over(by)).withColumn("rel", (F.row_number().over(by) - 1) / F.greatest(F.count("*").over(Window.partitionBy("p_brand")) - 1, F.lit(1)))
    arc = one_of(F.ascii(F.right("p_brand", F.lit(1))) % 3, "energy", "genre", "free")
    tier = profiles.slot_tier(arc, F.col("rel"), F.col("energy"), F.col("before"), F.col("bucket"), one_of(n % 3, "dance", "rock", "chill"), F.col("bucket_before"), n % 11 != 0, F.when(n % 6 != 0, F.col("energy") + (n % 9 - 4) / 10.0), n % 4 == 0)
    return rows.select("song_id", tier.alias("tier"))


SLOT_SQL = """WITH p AS (SELECT p_partkey AS n, p_brand, p_size / 50.0 AS e, ['dance', 'rock', 'chill', 'dance', 'rock'][p_partkey % 5 + 1] AS bucket, ['dance', 'rock', 'chill'][p_partkey % 3 + 1] AS wave, ['energy', 'genre', 'free'][ascii(right(p_brand, 1)) % 3 + 1] AS arc, CASE WHEN p_partkey % 6 <> 0 THEN p_size / 50.0 + (p_partkey % 9 - 4) / 10.0 END AS target FROM part),
 w AS (SELECT *, lag(e) OVER b AS before, lag(bucket) OVER b AS bucket_before, (row_number() OVER b - 1) / greatest(count(*) OVER (PARTITION BY p_brand) - 1, 1) AS rel FROM p WINDOW b AS (PARTITION BY p_brand ORDER BY n)),
 j AS (SELECT *, (e - before) / 0.25 AS jump, abs(e - target) / 0.25 AS gap FROM w)
 SELECT n AS song_id, CASE WHEN abs(jump) >= 1.5 OR arc = 'energy' AND rel > 0.15 AND jump >= 1.0 AND n % 4 <> 0 THEN 2 WHEN arc = 'free' THEN CASE WHEN abs(jump) >= 1.0 THEN 1 ELSE 0 END
 WHEN arc = 'genre' AND bucket <> wave AND (bucket_before IS NULL OR bucket <> bucket_before) OR n % 11 = 0 OR gap > CASE WHEN arc = 'energy' THEN 1.1 ELSE 1.25 END THEN 2 WHEN gap > CASE WHEN arc = 'energy' THEN 0.6 ELSE 0.75 END OR abs(jump) >= 1.0 THEN 1 ELSE 0 END AS tier FROM j"""


def _forecast(s: S, d: str) -> DataFrame:
    k = F.col("key")
    of = views.event(s, d).groupBy("key").agg(F.max(keys.micros("t")).alias("now"), F.count_if(F.col("type") != "mp3_verified").alias("remaining"), F.count_if(F.col("type") == "mp3_verified").alias("done"), F.count_if(F.col("type") == "block").alias("blocks"))
    rate = F.col("done") / 10.0
    return profiles.recovery_forecast(of.select(
        "key", F.timestamp_micros("now").alias("now"), one_of(k % 3, "running", "waiting-for-recovery", "draining").alias("phase"), F.when(k % 4 == 0, rate * 2).alias("recovered_rate"), F.when(k % 4 == 1, rate).alias("phase_rate"), F.when(k % 11 != 0, rate / 2).otherwise(0.0).alias("run_rate"),
        F.when(k % 5 == 0, F.col("blocks") * 1000).alias("cool_ms"), F.when(k % 5 == 1, F.lit(60_000)).alias("wait_ms"), (k % 7).alias("most"), F.when(k % 3 != 1, F.lit(600_000)).alias("window_ms"), "remaining",
    ))


FORECAST_SQL = """WITH g AS (SELECT "key" AS k, max(epoch_us(t)) AS now, count(*) FILTER (type <> 'mp3_verified') AS remaining, count(*) FILTER (type = 'mp3_verified') / 10.0 AS r, count(*) FILTER (type = 'block') AS blocks FROM event GROUP BY 1),
 s AS (SELECT *, CASE WHEN k % 4 = 0 THEN r * 2 WHEN k % 4 = 1 THEN r WHEN k % 11 <> 0 THEN r / 2 ELSE 0.0 END AS rate, CASE k % 5 WHEN 0 THEN blocks * 1000 WHEN 1 THEN 60000 ELSE 0 END AS wait, CASE WHEN k % 7 > 0 AND k % 3 <> 1 THEN (k % 7) / 10.0 END AS ceiling FROM g)
 SELECT k AS "key", round(rate, 6) AS rate, round(rate / 3, 6) AS multiple, CASE WHEN wait > 0 THEN 'held' ELSE ['running', 'waiting-for-recovery', 'draining'][k % 3 + 1] END AS state, CASE WHEN wait > 0 THEN now // 1000 + wait END AS recovery_ms,
 round(CASE WHEN least(rate, coalesce(ceiling, rate)) > 0 AND remaining > 0 THEN remaining / least(rate, coalesce(ceiling, rate)) / 60 + wait / 3600000.0 END, 6) AS hours, round(CASE WHEN ceiling > 0 AND remaining > 0 THEN remaining / ceiling / 60 + wait / 3600000.0 END, 6) AS ceiling_hours, coalesce(rate > ceiling, false) AS capped FROM s"""

QUERIES = {
    "join_pair_cost_block": lambda s, d: profiles.pair_cost_block(block_items(s, d), block_items(s, d).where("song_id % 100 = 0")),
    "top_bridge_pair": lambda s, d: profiles.bridge_pair(block_items(s, d), "dnb", "swing"),
    "agg_mood_calibration": lambda s, d: profiles.mood_calibration(_distances(s, d, F.lit(0))),
    "agg_key_threshold": _threshold,
    "vec_key_profile": _key_profile,
    "vec_level_blend": _levels,
    "win_slot_tier": _slots,
    "win_recovery_forecast": _forecast,
}

SQL = {
    name: with_views(sql)
    for name, sql in {
        "join_pair_cost_block": PAIR_SQL,
        "top_bridge_pair": BRIDGE_SQL,
        "agg_mood_calibration": MOOD_SQL,
        "agg_key_threshold": THRESHOLD_SQL,
        "vec_key_profile": PROFILE_SQL,
        "vec_level_blend": LEVEL_SQL,
        "win_slot_tier": SLOT_SQL,
        "win_recovery_forecast": FORECAST_SQL,
    }.items()
}
