"""Catalog reconciliation: occurrences to songs, coverage of playlists, collisions, latest and best rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import keys

CONFLICT_MS = 5000


def explode_playlists(playlists: DataFrame, occurrences: DataFrame, songs: DataFrame) -> DataFrame:
    """Occurrences of playlists that aren't skipped, of songs with artist and name."""
    named = songs.where("coalesce(artist, '') <> '' and coalesce(name, '') <> ''").select("song_id", "artist", "name", "expected_ms")
    return occurrences.join(playlists.where("not skipped").select("playlist_id"), "playlist_id").join(named, "song_id").select("playlist_id", "song_id", "n", "seq", "artist", "name", "expected_ms")


def keyed(songs: DataFrame) -> DataFrame:
    """``songs`` with ``song_key``; made here, a song's key is folded once and not for each of its occurrences."""
    return songs.withColumn("song_key", F.lower(keys.file_base(F.col("artist"), F.col("name"))))


def dedup(occurrences: DataFrame) -> DataFrame:
    """One row per ``song_key`` (see ``keyed``): ids, first known length in input order, whether any length is over CONFLICT_MS from it.

    ``conflict`` needs the extremes only, so one aggregate suffices: no join back, no list of lengths.
    """
    known = F.col("expected_ms") > 0
    first = F.min_by("expected_ms", F.when(known, F.struct("playlist_id", "seq")))
    out = occurrences.groupBy("song_key").agg(
        F.count_distinct("song_id").alias("ids"), F.count("*").alias("occurrences"), F.count_distinct("playlist_id").alias("playlists"), first.alias("duration_ms"), F.min(F.when(known, F.col("expected_ms"))).alias("lo"), F.max(F.when(known, F.col("expected_ms"))).alias("hi"))
    wide = (F.col("hi") - F.col("duration_ms") > CONFLICT_MS) | (F.col("duration_ms") - F.col("lo") > CONFLICT_MS)
    return out.select("song_key", "ids", "occurrences", "playlists", "duration_ms", F.coalesce(wide, F.lit(False)).alias("conflict"))


def playlist_coverage(occurrences: DataFrame, files: DataFrame) -> DataFrame:
    """Per playlist: members, those with a length-compatible file in their folder, rounded percent, done; the null row is the total."""
    have = files.select("folder", "song_id", (keys.length_reason(F.col("expected_ms"), F.col("seconds")) == "match").alias("ok"))
    rows = occurrences.join(have, ["folder", "song_id"], "left")
    out = rows.rollup("playlist_id").agg(F.count("*").alias("total"), F.count_if(F.coalesce("ok", F.lit(False))).alias("on_disk"))
    return out.select("playlist_id", "total", "on_disk", F.floor(100.0 * F.col("on_disk") / F.col("total") + 0.5).alias("percent"), (F.col("total") == F.col("on_disk")).alias("done"))


def catalog_summary(playlists: DataFrame) -> DataFrame:
    """Counts by state in one pass."""
    s = F.col("status")
    return playlists.agg(F.count("*").alias("total"), F.count_if(s == 4).alias("saved"), F.count_if(s == 5).alias("failed"), F.count_if(s == 0).alias("remaining"), F.count_if((s == 0) & ~F.col("skipped")).alias("ready"), F.count_if(F.col("skipped")).alias("skipped"))


def key_collisions(songs: DataFrame) -> DataFrame:
    """Keys that several songs share, with their spellings and known lengths."""
    out = songs.groupBy(F.lower(keys.file_base(F.col("artist"), F.col("name"))).alias("song_key")).agg(F.count("*").alias("songs"), F.count_distinct("name").alias("spellings"), F.count("expected_ms").alias("known"), F.min("expected_ms").alias("least_ms"), F.max("expected_ms").alias("most_ms"))
    return out.where("songs > 1")


def disjoint_windows(songs: DataFrame) -> DataFrame:
    """Groups of two or more known lengths whose tolerance intervals have no common point."""
    ms = F.col("expected_ms")
    lower, upper = ms / 1000 - keys.tolerance(ms), ms / 1000 + keys.tolerance(ms)
    out = songs.where(ms > 0).groupBy("artist", "name").agg(F.count("*").alias("known"), F.max(lower).alias("max_lower"), F.min(upper).alias("min_upper"))
    return out.where("known >= 2 and max_lower > min_upper").select("artist", "name", "known", F.round("max_lower", 6).alias("max_lower"), F.round("min_upper", 6).alias("min_upper"))


def status_counts(playlists: DataFrame) -> DataFrame:
    return playlists.groupBy("status").agg(F.count("*").alias("n"), F.count_distinct("name").alias("names"))


def best_status(playlists: DataFrame) -> DataFrame:
    """One row per name: the highest status, the smallest id on ties."""
    best = F.max_by(F.struct("status", "playlist_id"), F.struct("status", -F.col("playlist_id")))
    return playlists.groupBy("name").agg(best.alias("b")).select("name", "b.status", "b.playlist_id")


def latest_by_key(events: DataFrame) -> DataFrame:
    """The last event of each key."""
    last = F.max_by(F.struct("event_id", "type", "k"), F.struct("t", "event_id"))
    return events.groupBy("key").agg(last.alias("e")).select("key", "e.event_id", "e.type", "e.k")


def source_variants(songs: DataFrame) -> DataFrame:
    """Per key: variants, those without a length, and whether lengths differ by over CONFLICT_MS."""
    out = songs.groupBy("artist", "name").agg(F.count("*").alias("variants"), F.count_if(F.col("expected_ms").isNull()).alias("unavailable"), (F.max("expected_ms") - F.min("expected_ms")).alias("spread"))
    return out.select("artist", "name", "variants", "unavailable", F.coalesce(F.col("spread") > CONFLICT_MS, F.lit(False)).alias("ambiguous"))


def resolution_funnel(playlists: DataFrame) -> DataFrame:
    """Per name the best outcome of its rows (found, failed, searching), then counts and a null-safe success rate."""
    per = playlists.groupBy("name").agg(F.bool_or(F.col("status") == 4).alias("found"), F.bool_or(F.col("status") == 5).alias("failed"))
    out = per.agg(F.count("*").alias("keys"), F.count_if("found").alias("found"), F.count_if(~F.col("found") & F.col("failed")).alias("no_result"), F.count_if(~F.col("found") & ~F.col("failed")).alias("searching"))
    return out.withColumn("success", F.round(F.col("found") / F.nullif(F.col("found") + F.col("no_result"), F.lit(0)), 6))


def disk_usage(files: DataFrame) -> DataFrame:
    """Bytes by physical file, however many names it has."""
    per = files.groupBy("dev", "ino").agg(F.max("size").alias("size"), F.count("*").alias("paths"))
    return per.agg(F.count("*").alias("files"), F.sum("paths").alias("paths"), F.sum("size").alias("bytes"), F.round(F.avg("size"), 6).alias("mean_bytes"))


def file_manifest(files: DataFrame) -> DataFrame:
    """One row per physical file with its paths in order."""
    return files.groupBy("dev", "ino").agg(F.array_join(F.array_sort(F.collect_list("path")), ",").alias("paths"), F.max("size").alias("size"), F.count("*").alias("names"))


def reconcile(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` that differ from ``old`` in some column, or are new (null-safe)."""
    rest = [c for c in new.columns if c != key]
    before = old.select(key, F.struct(*rest).alias("was"))
    return new.join(before, key, "left").where(~F.struct(*rest).eqNullSafe(F.col("was"))).select(*new.columns)


def upsert(state: DataFrame, changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``state`` with each key's last change in its place."""
    last = changes.groupBy(key).agg(F.max_by(F.struct(*[c for c in state.columns if c != key]), F.struct(*order)).alias("r")).select(key, "r.*")
    return state.join(last.select(key), key, "left_anti").unionByName(last.select(*state.columns))


def reuse_url(songs: DataFrame, urls: DataFrame) -> DataFrame:
    """Songs without an address that take that of the smallest other song of the same artist and name."""
    have = songs.join(urls, "song_id").groupBy("artist", "name").agg(F.min_by(F.struct("song_id", "url"), "song_id").alias("best"))
    return songs.join(urls, "song_id", "left_anti").join(have, ["artist", "name"]).select("song_id", F.col("best.song_id").alias("from_id"), F.col("best.url").alias("url"))


def membership_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Added, removed and kept members of each playlist; a song that occurs twice is two members."""
    w = Window.partitionBy("playlist_id", "song_id").orderBy("seq")
    number = lambda df: df.select("playlist_id", "song_id", F.row_number().over(w).alias("copy"))
    both = number(old).withColumn("a", F.lit(True)).join(number(new).withColumn("b", F.lit(True)), ["playlist_id", "song_id", "copy"], "full_outer")
    return both.groupBy("playlist_id").agg(F.count_if(F.col("a").isNull()).alias("added"), F.count_if(F.col("b").isNull()).alias("removed"), F.count_if(F.col("a") & F.col("b")).alias("kept"))


def observed_membership(saved: DataFrame, observations: DataFrame, members: DataFrame) -> DataFrame:
    """(playlist_id, verdict, accepted, added, removed, kept): what each playlist's observations make of its ``saved`` list.

    ``saved``: (playlist_id, song_id, seq). ``observations``: (playlist_id, obs, declared) in the order of ``obs`` from 1, with the
    number of items that the source declares; ``members``: (playlist_id, obs, song_id, seq). An observation is verified if it has
    as many items as declared. A list that isn't shorter than the one so far is accepted; a shorter one only if it is
    verified and the verified observation before it was the same list, by hash and count: else it is ``pending``,
    ``changed`` if that one was another short list, ``refused`` if not verified, and ``missing`` if it is empty and not
    verified. ``accepted`` is the observation whose list holds at last (0: the saved one), ``verdict`` the last one's. What an
    unverified list lacks isn't removed: removals need verified membership.
    """
    hashed = lambda df, *by: df.groupBy("playlist_id", *by).agg(F.count("*").alias("n"), F.sha2(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("seq", "song_id"))), lambda x: x["song_id"])), 256).alias("hash"))
    seen = observations.join(hashed(members, "obs"), ["playlist_id", "obs"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    log = seen.groupBy("playlist_id").agg(F.array_sort(F.collect_list(F.struct(F.col("obs").cast("int").alias("obs"), "n", F.coalesce("hash", F.lit("")).alias("hash"), (F.col("n") == F.col("declared")).alias("sure")))).alias("log"))
    start = hashed(saved).select("playlist_id", F.col("n").alias("n0"))
    start = log.join(start, "playlist_id", "left")
    null = F.lit(None)
    state = F.struct(F.coalesce("n0", F.lit(0).cast("long")).alias("n"), F.lit(0).alias("obs"), F.lit(True).alias("sure"), null.cast("long").alias("p_n"), null.cast("string").alias("p_hash"), F.lit("none").alias("verdict"))

    def take(a, o):
        shorter = o["n"] < a["n"]
        again = F.coalesce((a["p_n"] == o["n"]) & (a["p_hash"] == o["hash"]), F.lit(False))
        verdict = (
            F.when((o["n"] == 0) & ~o["sure"], "missing").when(shorter & ~o["sure"], "refused").when(~shorter | again, "accepted").when(a["p_n"].isNotNull(), "changed").otherwise("pending")
        )
        ok, wait = verdict == "accepted", verdict.isin("pending", "changed")
        pick = lambda name, keep: F.when(ok, o[name]).otherwise(keep)
        return F.struct(
            pick("n", a["n"]).alias("n"), pick("obs", a["obs"]).alias("obs"), pick("sure", a["sure"]).alias("sure"),
            F.when(wait, o["n"]).when(~ok, a["p_n"]).alias("p_n"), F.when(wait, o["hash"]).when(~ok, a["p_hash"]).alias("p_hash"), verdict.alias("verdict"),
        )

    last = start.select("playlist_id", F.aggregate("log", state, take).alias("s")).select("playlist_id", "s.verdict", F.col("s.obs").alias("accepted"), "s.sure")
    chosen = members.join(last.select("playlist_id", F.col("accepted").alias("obs")), ["playlist_id", "obs"], "left_semi")
    diff = membership_diff(saved.join(last.where("accepted > 0").select("playlist_id"), "playlist_id", "left_semi"), chosen)
    same = saved.groupBy("playlist_id").agg(F.count("*").alias("n"))
    out = last.join(diff, "playlist_id", "left").join(same, "playlist_id", "left")
    zero, n = F.lit(0).cast("long"), F.coalesce("n", F.lit(0).cast("long"))
    held = F.col("accepted") == 0
    removed = F.when(held | ~F.col("sure"), zero).otherwise(F.coalesce("removed", zero))
    return out.select("playlist_id", "verdict", "accepted", F.when(held, zero).otherwise(F.coalesce("added", zero)).alias("added"), removed.alias("removed"), F.when(held, n).otherwise(n - removed).alias("kept"))


def multiset_max(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """Bag union: each value as often as in the side that has it more often."""
    x, y = a.groupBy(value).agg(F.count("*").alias("m")), b.groupBy(value).agg(F.count("*").alias("n"))
    both = x.join(y, value, "full_outer").select(value, F.greatest(F.coalesce("m", F.lit(0)), F.coalesce("n", F.lit(0))).cast("int").alias("times"))
    return both.select(value, F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"))


def ordered_hash(occurrences: DataFrame) -> DataFrame:
    """SHA-256 of each playlist's song ids in order, as a JSON list."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("seq", "song_id"))), lambda x: x["song_id"])
    return occurrences.groupBy("playlist_id").agg(F.count("*").alias("items"), F.sha2(F.to_json(ids), 256).alias("hash"))


def unmatched_coverage(songs: DataFrame, files: DataFrame) -> DataFrame:
    """Songs by whether they have a file, and files of unknown songs."""
    have = files.select("song_id").distinct()
    saved, missing, odd = songs.join(have, "song_id", "left_semi"), songs.join(have, "song_id", "left_anti"), have.join(songs, "song_id", "left_anti")
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("state"), "n")
    return count(saved, "saved").union(count(missing, "missing")).union(count(odd, "unexpected"))
