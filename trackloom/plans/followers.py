"""Queries of pair costs and followers over the driver tables, and their SQL over all pairs of a block."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import SparkSession as S

from trackloom.functions import keys
from trackloom.operators import followers
from trackloom.operators.followers import FLOW
from trackloom.plans.ingest import one_of
from trackloom.plans.oracle import FOLD
from trackloom.sources import views
from trackloom.sources.views import with_views


def items(s: S, d: str) -> DataFrame:
    """Parts as items in blocks of a brand."""
    n = F.col("p_partkey")
    turn = (n * 7 % 100) / 160.0
    return views.table(s, d, "part").select(
        n.alias("song_id"), F.col("p_brand").alias("block"), keys.fold_tempo(F.col("p_retailprice") / 10).alias("tempo"), (n % 9 != 0).alias("beatable"), (F.col("p_size") / 50.0).alias("energy"),
        F.when(n % 23 != 0, (n % 12 + 1).cast("int")).alias("wheel"), (n % 2).cast("int").alias("letter"), F.when(n % 10 != 0, F.array(F.cos(turn), F.sin(turn))).alias("timbre"),
        (-(n % 13) * 1.0).alias("exit_rel"), (-(n * 5 % 17) * 1.0).alias("entry_rel"), one_of(n % 3, "dance", "rock", "chill").alias("bucket"),
    )


def slots(s: S, d: str) -> DataFrame:
    """The items with what the slot after each asks for; some ask for a band that no item is in."""
    n = F.col("song_id")
    arc = one_of(F.ascii(F.right("block", F.lit(1))) % 3, "energy", "genre", "free")
    target = F.when(n % 6 != 0, F.col("energy") + (n % 9 - 4) / 20.0)
    wave = one_of((n / 4).cast("long") % 3, "dance", "rock", "chill")
    quota = F.when(n % 97 == 0, F.array(F.lit("none"))).when(n % 11 == 0, F.array(F.when(F.col("arc") == "genre", F.col("wave")).otherwise(F.bround(1 + 4 * F.col("energy")).cast("int").cast("string"))))
    rows = items(s, d).withColumns({"arc": arc, "rel": (n % 20) / 20.0, "wave": wave, "target": target, "climb": n % 4 == 0})
    return rows.withColumn("quota", quota)


def ratings(s: S, d: str) -> DataFrame:
    """The last vote on each pair of items that follow each other in a playlist, where they are of one brand."""
    w = Window.partitionBy("playlist_id").orderBy("seq")
    pairs = views.occurrence(s, d).select("playlist_id", "seq", F.col("song_id").alias("a"), F.lead("song_id").over(w).alias("b"), (F.col("quantity") * 2).alias("rated"))
    return pairs.where("b is not null and a <> b").groupBy("a", "b").agg(F.max_by("rated", F.struct("playlist_id", "seq")).alias("rated"))


def _costs(s: S, d: str) -> DataFrame:
    return followers.pair_cost(items(s, d), ratings(s, d)).withColumnRenamed("block", "artist")


ITEMS = f"""items AS (SELECT p_partkey AS song_id, p_brand AS block, {FOLD.format(x='(p_retailprice / 10)')} AS tempo, p_partkey % 9 <> 0 AS beatable, p_size / 50.0 AS energy, CASE WHEN p_partkey % 23 <> 0 THEN p_partkey % 12 + 1 END AS wheel, p_partkey % 2 AS letter,
 CASE WHEN p_partkey % 10 <> 0 THEN [cos((p_partkey * 7 % 100) / 160.0), sin((p_partkey * 7 % 100) / 160.0)] END AS timbre, -(p_partkey % 13) * 1.0 AS exit_rel, -(p_partkey * 5 % 17) * 1.0 AS entry_rel, ['dance', 'rock', 'chill'][p_partkey % 3 + 1] AS bucket FROM part),
 hops AS (SELECT playlist_id, seq, song_id AS a, lead(song_id) OVER (PARTITION BY playlist_id ORDER BY seq) AS b, quantity * 2 AS rated FROM occurrence),
 votes AS (SELECT a, b, arg_max(rated, (playlist_id, seq)) AS rated FROM hops WHERE b IS NOT NULL AND a <> b GROUP BY 1, 2)"""


def _pairs() -> str:
    """Every pair of a block with its terms, and the cost of each."""
    w = FLOW
    off = lambda k: f"abs(y.tempo / ({k} * x.tempo) - 1) * 100"
    return f"""met AS (SELECT x.block, x.song_id AS a, y.song_id AS b, x.energy AS ea, y.energy AS eb, x.bucket AS ba, y.bucket AS bb, x.beatable AND y.beatable AS locked,
  CASE WHEN {off('1.0')} <= least({off('0.5')}, {off('2.0')}) + 0.5 THEN {off('1.0')} ELSE least({off('0.5')}, {off('2.0')}) END AS pct,
  coalesce(least(abs(x.wheel - y.wheel), 12 - abs(x.wheel - y.wheel)) + CASE WHEN x.wheel IS NULL OR y.wheel IS NULL THEN NULL WHEN x.letter <> y.letter THEN 1 ELSE 0 END, 6) AS steps,
  1 - list_dot_product(x.timbre, y.timbre) AS apart, x.exit_rel - y.entry_rel AS fall, abs(y.energy - x.energy) / 0.25 AS jump, (50 - v.rated) / 50.0 AS pull
  FROM items x JOIN items y ON x.block = y.block AND x.song_id <> y.song_id LEFT JOIN votes v ON v.a = x.song_id AND v.b = y.song_id),
 costs AS (SELECT *, {w['key']} * CASE steps WHEN 0 THEN 0 WHEN 1 THEN 0.15 WHEN 2 THEN 0.6 ELSE 1 END + {w['tempo']} * CASE WHEN locked THEN least(2.0, pct / {w['stretch']}) ELSE {w['unknown_tempo']} END
  + {w['energy']} * (abs(eb - ea) + 1.5 * greatest(0.0, eb - ea)) + {w['timbre']} * CASE WHEN apart IS NULL THEN 1.0 ELSE least(2.0, apart / {w['typical_timbre']}) END + {w['join']} * greatest(0.0, fall - {w['free_drop']}) / {w['drop_scale']}
  + coalesce(pull * {w['rating']} * CASE WHEN pull > 0 THEN 2 ELSE 1 END, 0) + CASE WHEN apart > {w['clash_timbre']} THEN {w['clash']} ELSE 0 END + CASE WHEN locked AND pct > {w['groove_pct']} THEN {w['groove']} ELSE 0 END
  + CASE WHEN fall > {w['buried_db']} THEN {w['buried']} ELSE 0 END + {w['leap']} * pow(greatest(0.0, jump - 1), 2) + CASE WHEN jump >= 1.5 THEN {w['cliff']} ELSE 0 END AS cost FROM met)"""


COST_SQL = f"WITH {ITEMS}, {_pairs()} SELECT block AS artist, a, b, round(cost, 6) AS cost FROM costs"
TOP_SQL = f"""WITH {ITEMS}, {_pairs()},
 slots AS (SELECT *, ['energy', 'genre', 'free'][ascii(right(block, 1)) % 3 + 1] AS arc, (a % 20) / 20.0 AS rel, ['dance', 'rock', 'chill'][(a // 4) % 3 + 1] AS wave, CASE WHEN a % 6 <> 0 THEN ea + (a % 9 - 4) / 20.0 END AS target FROM costs),
 bands AS (SELECT *, CASE WHEN arc = 'genre' THEN bb ELSE CAST(CAST(round_even(1 + 4 * eb, 0) AS INTEGER) AS VARCHAR) END AS band, CASE WHEN a % 97 = 0 THEN 'none' WHEN a % 11 <> 0 THEN NULL WHEN arc = 'genre' THEN wave ELSE CAST(CAST(round_even(1 + 4 * ea, 0) AS INTEGER) AS VARCHAR) END AS quota, coalesce(abs(eb - target) / 0.25, 0) AS gap FROM slots),
 tiers AS (SELECT *, CASE WHEN quota IS NULL OR band = quota THEN 0 ELSE 1 END AS miss,
  CASE WHEN jump >= 1.5 OR arc = 'energy' AND rel > 0.15 AND (eb - ea) / 0.25 >= 1.0 AND a % 4 <> 0 THEN 2 WHEN arc = 'free' THEN CASE WHEN jump >= 1.0 THEN 1 ELSE 0 END
  WHEN arc = 'genre' AND bb <> wave AND bb <> ba OR quota <> band OR target IS NOT NULL AND gap > CASE WHEN arc = 'energy' THEN 1.1 ELSE 1.25 END THEN 2 WHEN target IS NOT NULL AND gap > CASE WHEN arc = 'energy' THEN 0.6 ELSE 0.75 END OR jump >= 1.0 THEN 1 ELSE 0 END AS tier,
  round(cost + 2 * CASE arc WHEN 'free' THEN 0 WHEN 'genre' THEN CASE WHEN bb = wave THEN 0 ELSE 5 END + 0.6 * gap ELSE 2 * gap END, 6) AS score FROM bands),
 good AS (SELECT *, min(tier) OVER (PARTITION BY a) AS best FROM tiers),
 r AS (SELECT a, b, tier, score, row_number() OVER (PARTITION BY a ORDER BY tier, miss, CASE WHEN tier = 2 THEN round(jump, 1) ELSE 0 END, score, b) AS place FROM good WHERE tier < 2 OR best = 2)
 SELECT a, CAST(place AS INTEGER) AS place, b, tier, score FROM r WHERE place <= 3"""

QUERIES = {
    "join_pair_cost": _costs,
    "top_candidates": lambda s, d: followers.top_followers(items(s, d), slots(s, d), ratings(s, d)),
}

SQL = {name: with_views(sql) for name, sql in {"join_pair_cost": COST_SQL, "top_candidates": TOP_SQL}.items()}
