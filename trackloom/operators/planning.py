"""Work planning and state: what to skip, redo, remove, refresh; reviews, presence and priorities."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import keys
from trackloom.operators.ordering import placed
from trackloom.sources.shared import materialize

# Names left out of a catalog, genre words by bucket in their order, energy target points.
EXCLUDED = r"(?i)^(daily mix(?:es)?(?:\s.*)?|dj|discover weekly|release radar|on repeat|repeat rewind|(?:your )?daily drive)$"
GENRES = {
    "rock": ["rock", "metal", "grunge", "punk", "blues", "guitar", "indie", "alternative"],
    "chill": ["ambient", "chill", "downtempo", "trip", "lounge", "psybient", "idm", "new age", "jazz", "bossa", "acoustic", "folk", "soul"],
    "dance": ["house", "techno", "trance", "edm", "dance", "electro", "pop", "drum", "dnb", "garage", "disco", "funk", "hip", "rap", "r&b"],
}
TRANSIENT = ["not a bot", "Sign in to confirm", "429", "timed out", "YouTube search failed (", "No route to host", "network is unreachable", "fetch failed", "bytes read"]
NETWORK = r"(?i)network|timed out|timeout|rate limit|bot check|Media URL rejected \(403\)"
NO_CANDIDATE = ["YouTube candidate failed Spotify duration check", "No acceptable duration-matched YouTube candidate in the configured search results"]
NO_MATCH = "No duration-matched YouTube candidate"
TARGET = [(0.0, 0.35), (0.25, 0.55), (0.6, 0.9), (0.85, 1.0), (1.0, 0.7)]


def excluded_name(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))).rlike(EXCLUDED)


def genre_bucket(c: Column) -> Column:
    """The first bucket one of whose words occurs in the genre; null if none does."""
    out = None
    for name, words in GENRES.items():
        hit = F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(c), w))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def retry_flags(error: Column) -> list[Column]:
    """Whether an error is transient (its words in any case), comes from the network, or says that no candidate fits; a null is none."""
    holds = F.exists(F.array(*(F.lit(w.lower()) for w in TRANSIENT)), lambda w: F.contains(F.lower(error), w))
    outcome = error.isin(*NO_CANDIDATE) | error.startswith(NO_MATCH)
    return [F.coalesce(c, F.lit(False)).alias(n) for n, c in (("transient", holds), ("network", error.rlike(NETWORK)), ("candidate", outcome))]


def query_variants(artist: Column, name: Column, album: Column) -> Column:
    """At most three distinct searches, the plain one first: with the album or "audio", and with "official audio"."""
    clean = lambda *c: F.trim(F.regexp_replace(F.translate(F.replace(F.concat_ws(" ", *c), F.lit("&"), F.lit(" ")), '"', ""), r"\s+", " "))
    first, title = keys.primary_artist(artist), keys.base_title(name)
    more = F.when(F.coalesce(album, F.lit("")) != "", album).otherwise("audio")
    return F.slice(F.array_distinct(F.filter(F.array(clean(artist, name), clean(first, title, more), clean(first, title, F.lit("official audio"))), lambda q: q != "")), 1, 3)


def interpolate(x: Column, points: list[tuple[float, float]]) -> Column:
    """Piecewise linear through ``points``, constant outside."""
    out = F.when(x <= points[0][0], F.lit(points[0][1]))
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        out = out.when(x <= x1, y0 + (x - x0) * ((y1 - y0) / (x1 - x0)))
    return out.otherwise(F.lit(points[-1][1]))


def tempo_match(a: Column, b: Column) -> Column:
    """The beat ratio (1, then 1/2 or 2 if better by over 0.5) with the least stretch in percent, as a struct (ratio, stretch)."""
    off = lambda k: F.abs(b / (k * a) - 1) * 100
    other = F.array_min(F.array(*(F.struct(off(k).alias("stretch"), F.lit(k).alias("ratio")) for k in (0.5, 2.0))))
    return F.when(off(1.0) <= other["stretch"] + 0.5, F.struct(F.lit(1.0).alias("ratio"), off(1.0).alias("stretch"))).otherwise(F.struct(other["ratio"].alias("ratio"), other["stretch"].alias("stretch")))


def fingerprint(version: str) -> Column:
    """Of a document (doc_id, text; a null text is empty) under a version of what works on it."""
    return F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), F.sha2(F.coalesce("text", F.lit("")), 256), F.lit(version)), 256)


def skip_done(inputs: DataFrame, results: DataFrame, version: str) -> DataFrame:
    """Inputs (doc_id, text) whose fingerprint has no valid result: an anti join on the hash, which any edit of the text changes."""
    mark = fingerprint(version)
    return inputs.select("doc_id", mark.alias("mark")).join(results.select("mark"), "mark", "left_anti").select("doc_id", "mark")


def review_status(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Worst open review of each document: repair before review before resolved; none if unreviewed."""
    rank = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 0).otherwise(1)
    worst = labels.select("doc_id", rank.alias("r")).groupBy("doc_id").agg(F.max("r").alias("r"))
    name = F.when(F.col("r") == 2, "needs-repair").when(F.col("r") == 1, "needs-review").when(F.col("r") == 0, "resolved").otherwise("none")
    return docs.select("doc_id").join(worst, "doc_id", "left").select("doc_id", name.alias("status"))


def review_metrics(status: DataFrame) -> DataFrame:
    s = F.col("status")
    return status.agg(F.count_if(s.isin("needs-repair", "needs-review")).alias("open"), F.count_if(s == "needs-repair").alias("repair"), F.count_if(s == "resolved").alias("resolved"), F.count_if(s == "none").alias("unreviewed"))


def resume_plan(playlists: DataFrame, most_searches: int = 10) -> DataFrame:
    """State of each row when work resumes, then counts by state."""
    state = F.when(F.col("status") == 4, "saved").when(F.col("skipped"), "missing").when((F.col("status") == 5) & (F.col("rank") % 3 != 0), "error").when(F.col("rank") % 11 < most_searches - 5, "ready").otherwise("pending")
    return playlists.select(state.alias("state")).groupBy("state").agg(F.count("*").alias("n"))


def snapshot_drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """Why a playlist needs reading again: no baseline, another snapshot, another count."""
    both = new.join(old.select("playlist_id", F.col("hash").alias("was_hash"), F.col("items").alias("was_items")), "playlist_id", "left")
    why = F.filter(F.array(F.when(F.col("was_hash").isNull(), "no-baseline"), F.when(F.col("hash") != F.col("was_hash"), "snapshot-changed"), F.when(F.col("items") != F.col("was_items"), "count-changed")), lambda x: x.isNotNull())
    return both.select("playlist_id", F.array_join(why, ",").alias("reasons")).where("reasons <> ''")


def removed_work(jobs: DataFrame, removed: DataFrame, present: DataFrame) -> DataFrame:
    """Jobs of removed songs, unless the song is still present somewhere."""
    return jobs.join(removed.select("song_id").distinct(), "song_id", "left_semi").join(present.select("song_id").distinct(), "song_id", "left_anti")


def affected(rows: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """Rows to recompute after ``changed`` keys; the key set is distinct before the join."""
    return rows.join(changed.select(key).distinct(), key, "left_semi")


def eligibility(docs: DataFrame) -> DataFrame:
    """First reason against a document as an item, in order; null if eligible."""
    n = F.col("n_chars")
    return docs.select("doc_id", F.when(n.isNull(), "needs_prep").when(n < 200, "too_short").when(n > 20_000, "too_long").when(~F.col("text").contains("\n"), "no_excerpt").alias("reason"))


def block_assign(items: DataFrame, least: int = 3) -> DataFrame:
    """Tempo block of each item; blocks with fewer than ``least`` items become ``close``."""
    block = F.when(F.col("tempo") < 105, "slow").when(F.col("tempo") < 130, "mid").otherwise("fast")
    rows = items.select("song_id", F.concat_ws("/", "artist", block).alias("block"))
    sizes = rows.groupBy("block").agg(F.count("*").alias("n"))
    return rows.join(sizes, "block").select("song_id", F.when(F.col("n") < least, "close").otherwise(F.col("block")).alias("block"))


def metadata_priority(songs: DataFrame, k: int | None = None) -> DataFrame:
    """Unknown or odd lengths in the order in which to look them up: under a minute, then the longest; the first ``k`` if asked."""
    ms = F.coalesce("expected_ms", F.lit(0))
    rows = placed(songs.select("song_id", F.when(ms < 60_000, 0).otherwise(1).alias("tier"), ms.alias("ms")), [F.asc("tier"), F.desc("ms"), F.asc("song_id")])
    return rows.where(F.col("place") <= k) if k else rows


def ready_order(playlists: DataFrame, k: int | None = None) -> DataFrame:
    """The rows due in their order: recently played, then rank; the first ``k`` if asked."""
    rows = placed(playlists.where("status = 0 and not skipped").select("playlist_id", "rank", "last_played"), [F.desc("last_played"), F.asc("rank"), F.asc("playlist_id")])
    return (rows.where(F.col("place") <= k) if k else rows).drop("last_played")


def curve_bins(events: DataFrame, bin_min: int = 720) -> DataFrame:
    """Mean value of each time bin of a key, with null for the empty bins between its first and last."""
    at = F.floor(keys.micros("t") / (bin_min * 60_000_000)).cast("long")
    filled = events.groupBy("key", at.alias("bin")).agg(F.avg("value").alias("mean"))
    spine = filled.groupBy("key").agg(F.explode(F.sequence(F.min("bin"), F.max("bin"))).alias("bin"))
    return spine.join(filled, ["key", "bin"], "left").select("key", "bin", F.round("mean", 6).alias("mean"))


def kernel_regression(vectors: DataFrame, labelled: DataFrame, width: float = 0.2) -> DataFrame:
    """Mean label weighted by exp(-distance / width) over labelled vectors (a stated query set, in blocks).

    Blocks of vectors meet blocks of the labelled set as matrices; a vector gets one row of sums a block of the set. A vector that
    is unknown or has length zero has no value, and a labelled one counts for nothing.
    """
    from trackloom.operators.features import against, unit
    from trackloom.operators.neighbours import BLOCK, _packed

    def units(rows: DataFrame, name: str, kind: str) -> tuple[DataFrame, Column]:
        rows = materialize(rows.select(F.col(name).cast(kind).alias(name), unit(F.col("embedding")).alias("v")), "units")
        return rows, F.coalesce(~F.exists("v", lambda x: x.isNull()), F.lit(False))

    def blocks(rows: DataFrame, name: str, as_: tuple[str, str]) -> DataFrame:
        part = F.pmod(F.xxhash64("v", name), F.lit(max(1, -(-rows.count() // BLOCK))))
        of = rows.groupBy(part.alias("part")).agg(F.collect_list(F.struct(name, "v")).alias("of"))
        return of.select(F.col(f"of.{name}").alias(as_[0]), _packed(F.col("of.v")).alias(as_[1]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, u, labels, v in zip(*(batch.column(c).to_pylist() for c in ("ids", "u", "labels", "v"))):
                w = np.exp(-(1 - np.frombuffer(u).reshape(len(ids), -1) @ np.frombuffer(v).reshape(len(labels), -1).T) / width)
                known = [x is not None for x in labels]
                a = w @ np.array([x or 0 for x in labels], float)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(a, mask=np.full(len(a), not any(known))), pa.array(w.sum(1))], ["vec_id", "a", "b"])

    mine, whole = units(vectors, "vec_id", "long")
    own, usable = units(labelled, "label", "double")
    met = against(blocks(mine.where(whole), "vec_id", ("ids", "u")), blocks(own.where(usable), "label", ("labels", "v")))
    vectors.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))  # a row holds two blocks
    sums = met.mapInArrow(run, "vec_id long, a double, b double").groupBy("vec_id").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    values = sums.select("vec_id", F.round(F.col("a") / F.col("b"), 6).alias("value"))
    return values.unionByName(mine.where(~whole).select("vec_id", F.lit(None).cast("double").alias("value")))


def nearest_grid(points: DataFrame, grid: DataFrame, within_s: float) -> DataFrame:
    """The nearest grid time of each point of a key, if within ``within_s``: points and grid sorted together, both ways."""
    both = points.select("key", "event_id", keys.micros("t").alias("m"), F.lit(None).cast("long").alias("g")).unionByName(grid.select("key", F.lit(None).cast("long").alias("event_id"), keys.micros("t").alias("m"), keys.micros("t").alias("g")))
    # both frames start at the partition's first row: one that ends at its last is worked out anew for each row
    upto = lambda order: F.last("g", True).over(Window.partitionBy("key").orderBy(order).rangeBetween(Window.unboundedPreceding, 0))
    before, after = upto(F.asc("m")), upto(F.desc("m"))
    out = both.withColumn("b", before).withColumn("a", after).where("event_id is not null")
    near = F.when(F.col("a").isNull() | (F.col("m") - F.col("b") <= F.col("a") - F.col("m")), F.col("b")).otherwise(F.col("a"))
    out = out.select("key", "event_id", "m", near.alias("near"))
    return out.where(F.abs(F.col("m") - F.col("near")) <= within_s * 1_000_000).select("key", "event_id", F.round((F.col("near") - F.col("m")) / 1e6, 6).alias("shift_s"))
