"""Audits whose every verdict carries its reason: repairs with exclusions, ambiguous editions, admissions, sort modes, manifests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions import keys
from trackloom.operators import matching
from trackloom.operators.ordering import placed
from trackloom.sources.shared import dealt, materialize


def repair_manifest(states: DataFrame, tasks: int | None = None) -> DataFrame:
    """Per physical file whether it is to be repaired: every use must fail; else the reason that speaks against it.
    Uses of a path are put together first, in ``tasks`` if that is given, so paths are counted without a list of them."""
    is_ = lambda s: F.bool_or(F.col("state") == s)
    of = dealt(states, tasks, "dev", "ino", "path").groupBy("dev", "ino", "path").agg(F.count("*").alias("uses"), F.max("size").alias("size"), is_("length-match").alias("fits"), is_("missing-source-metadata").alias("unknown"))
    of = of.groupBy("dev", "ino").agg(F.sum("uses").alias("uses"), F.count("path").alias("paths"), F.max("size").alias("size"), F.bool_or("fits").alias("fits"), F.bool_or("unknown").alias("unknown"))
    reason = F.when(F.col("fits"), "some use matches").when(F.col("unknown"), "some length is unknown")
    return of.select("dev", "ino", "uses", "paths", "size", reason.isNull().alias("repair"), reason.alias("reason"))


def edition_ambiguity(states: DataFrame) -> DataFrame:
    """States per physical file: a unanimous match or mismatch stands; anything else is ambiguous, with what the file's worst use says."""
    candidate = matching.file_state(states).select("dev", "ino", F.col("state").alias("candidate"))
    return matching.edition_ambiguity(states).join(candidate, ["dev", "ino"])


def full_audit(states: DataFrame) -> DataFrame:
    """Per state of physical files: files, uses, bytes, and the distinct songs among their failing uses; and whether the audit
    is complete, that is, no file's state is unknown."""
    files = matching.file_state(states)
    # a file with a failing use is in that state itself, so its songs need no join with the files
    bad = states.where("state = 'probable-bad-duration' and dev is not null and ino is not null")
    keys_of = bad.groupBy("state").agg(F.count_distinct("song_id").alias("bad_songs"))
    complete = files.agg((F.count_if(F.col("state") == "missing-source-metadata") == 0).alias("complete"))
    return matching.full_audit(files).join(keys_of, "state", "left").join(F.broadcast(complete)).select("state", "files", "uses", "bytes", F.coalesce("bad_songs", F.lit(0)).cast("long").alias("bad_songs"), "complete")


def edition_verdict(a: Column, b: Column) -> Column:
    """``match`` if both titles name the same editions, else which side names more."""
    fa, fb = keys.edition_flags(a), keys.edition_flags(b)
    more, less = F.size(F.array_except(fb, fa)) > 0, F.size(F.array_except(fa, fb)) > 0
    return F.struct(F.array_join(fa, ",").alias("wanted"), F.array_join(fb, ",").alias("found"), F.when(more & less, "other").when(more, "extra").when(less, "lacking").otherwise("match").alias("verdict"))


def sort_modes(playlists: DataFrame, k: int | None = None) -> DataFrame:
    """Every playlist's place in each sort mode: name, recents, played (those ever played first) and activity (bucket, remaining,
    rank); the first ``k`` of each if asked."""
    orders = {
        "name": [F.lower("name").asc(), F.col("playlist_id").asc()],
        "recents": [F.desc_nulls_last("last_played"), F.asc("playlist_id")],
        "played": [F.desc("plays"), F.desc_nulls_last("last_played"), F.asc("playlist_id")],
        "activity": [F.asc("bucket"), F.desc("remaining"), F.asc("rank"), F.asc("playlist_id")],
    }
    playlists = materialize(playlists, "playlists")
    modes = [placed(playlists, order).select(F.lit(mode).alias("mode"), "place", "playlist_id", "bucket") for mode, order in orders.items()]
    out = reduce(DataFrame.union, modes)
    return out.where(F.col("place") <= k) if k else out


def manifest(rows: DataFrame, private: str) -> DataFrame:
    """Per file (path, content, seconds) its SHA-256 and bytes, or why it isn't listed; and a last row of totals over the listed ones.

    A content that matches ``private`` is refused.
    """
    refused = F.coalesce(F.col("content").rlike(private), F.lit(False))
    each = rows.select("path", F.when(~refused, F.sha2("content", 256)).alias("sha256"), F.octet_length("content").cast("long").alias("bytes"), "seconds", F.when(refused, "refused").when(F.col("content").isNull(), "empty").otherwise("listed").alias("state"))
    total = each.where("state = 'listed'").agg(F.lit("total").alias("path"), F.lit(None).cast("string").alias("sha256"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.sum("seconds").alias("seconds"), F.concat(F.count("*").cast("string"), F.lit(" files, "), F.count("seconds").cast("string"), F.lit(" with a length")).alias("state"))
    return each.union(total)


def with_identity(found: DataFrame, named: DataFrame) -> DataFrame:
    """``matching.evidence`` with the identity verdict of each candidate (song_id, video, artist, name, title, channel) and a final
    reason: a rejection comes before the identity, and that before the length."""
    from trackloom.operators.evidence import identity_verdict

    verdicts = named.select("song_id", "video", identity_verdict(F.col("artist"), F.col("name"), F.col("title"), F.col("channel")).alias("identity"))
    met = found.join(verdicts, ["song_id", "video"])
    final = F.when(F.col("reason") == "rejected", "rejected").when(F.col("identity") != "match", F.col("identity")).otherwise(F.col("reason"))
    return met.select("song_id", "video", "place", "duplicate", "seconds", "length", "identity", final.alias("reason"))


def rejections(found: DataFrame, most: int = 128) -> DataFrame:
    """(song_id, video, place, kind): the newest ``most`` rejections of each song, one a video, and the candidates that none of them names."""
    kept = matching.keep_rejected(found.where("reason in ('mismatch', 'rejected')"), most)
    left = found.select("song_id", "video", "place").join(kept.select("song_id", "video"), ["song_id", "video"], "left_anti")
    return kept.withColumn("kind", F.lit("rejected")).unionByName(left.withColumn("kind", F.lit("open")))


def playlist_text(rows: DataFrame) -> DataFrame:
    """(playlist_id, body): a header, then for each item (playlist_id, seq, ms, name, path) in order its rounded length with its name, and its path."""
    line = F.concat(F.lit("#EXTINF:"), F.floor(F.coalesce("ms", F.lit(0)) / 1000 + 0.5).cast("string"), F.lit(","), F.coalesce("name", F.lit("")), F.lit("\n"), F.coalesce("path", F.lit("")))
    items = F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))), lambda x: x["line"])
    return rows.groupBy("playlist_id").agg(F.concat(F.lit("#EXTM3U\n"), F.array_join(items, "\n")).alias("body"))
