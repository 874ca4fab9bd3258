"""Candidates to songs under length rules and a rejection ledger, and the audit of files against all their uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import keys
from trackloom.sources.shared import dealt, tasks_for


def evidence(candidates: DataFrame, rejected: DataFrame) -> DataFrame:
    """Per song and video (repeats merged, a later known length wins): first place, length reason, final reason."""
    one = candidates.groupBy("song_id", "video").agg(F.min("place").alias("place"), F.count("*").alias("repeats"), F.max("expected_ms").alias("expected_ms"), F.max_by("seconds", F.when(F.col("seconds").isNotNull(), F.col("place"))).alias("seconds"))
    marks = rejected.select("song_id", "video", F.col("expected_ms").alias("at_ms")).withColumn("hit", F.lit(True))
    out = one.join(marks, ["song_id", "video"], "left")
    length = keys.length_reason(F.col("expected_ms"), F.col("seconds"))
    final = F.when(F.coalesce(F.col("hit") & (F.col("at_ms") == F.col("expected_ms")), F.lit(False)), "rejected").otherwise(length)
    return out.select("song_id", "video", "place", (F.col("repeats") > 1).alias("duplicate"), F.round("seconds", 6).alias("seconds"), length.alias("length"), final.alias("reason"))


def select_candidate(found: DataFrame) -> DataFrame:
    """The first acceptable candidate of each song, from ``evidence``."""
    return found.where("reason = 'match'").groupBy("song_id").agg(F.min_by(F.struct("video", "place"), "place").alias("b")).select("song_id", "b.video", "b.place")


def inspection_pick(found: DataFrame, most: int = 2) -> DataFrame:
    """At most ``most`` candidates of unknown length per song without an accepted one."""
    open_songs = found.join(select_candidate(found).select("song_id"), "song_id", "left_anti").where("reason = 'missing-candidate'")
    rank = F.row_number().over(Window.partitionBy("song_id").orderBy("place"))
    return open_songs.withColumn("pick", rank).where(F.col("pick") <= most).select("song_id", "video", "pick")


def keep_rejected(rejections: DataFrame, most: int = 128) -> DataFrame:
    """The newest ``most`` rejections of each song, one per video."""
    newest = rejections.groupBy("song_id", "video").agg(F.max("place").alias("place"))
    rank = F.row_number().over(Window.partitionBy("song_id").orderBy(F.desc("place"), "video"))
    return newest.withColumn("r", rank).where(F.col("r") <= most).select("song_id", "video", "place")


def nearest_variant(files: DataFrame, songs: DataFrame) -> DataFrame:
    """For each file and the songs of its artist and name: a length that fits, else the nearest; the state and the gap.

    Songs of one name and length are one variant with the smallest id. What fits a file is a range of lengths round its own, as
    the tolerance grows slower than the length, so only the next shorter and the next longer length count. They are found by
    sorting a name's lengths and the distinct lengths of its files together: a file never meets its name's other lengths.
    """
    named = files.where("seconds > 0").join(songs.select("song_id", "artist", "name"), "song_id").select("path", "artist", "name", "seconds")
    lengths = songs.where("expected_ms is not null").groupBy("artist", "name", "expected_ms").agg(F.min("song_id").alias("variant"), F.count("*").alias("songs"))
    name = ["artist", "name"]
    point = F.struct("expected_ms", "variant")
    here = lengths.select(*name, (F.col("expected_ms") / 1000).alias("seconds"), point.alias("point"))
    asked = named.select(*name, "seconds").distinct().withColumn("point", F.lit(None).cast(here.schema["point"].dataType))
    # both frames start at the partition's first row: one that ends at its last is worked out anew for each row
    upto = lambda order: F.last("point", True).over(Window.partitionBy(*name).orderBy(order).rangeBetween(Window.unboundedPreceding, 0))
    found = here.unionByName(asked).select(*name, "seconds", "point", upto(F.asc("seconds")).alias("shorter"), upto(F.desc("seconds")).alias("longer")).where("point is null")

    def judged(side: str) -> Column:
        ms = F.col(side)["expected_ms"]
        gap = F.round(F.abs(F.col("seconds") - ms / 1000), 6)
        return F.when(F.col(side).isNotNull(), F.struct((keys.length_reason(ms, F.col("seconds")) != "match").alias("off"), gap.alias("gap"), F.col(side)["variant"].alias("variant")))

    best = found.select(*name, "seconds", F.least(judged("shorter"), judged("longer")).alias("b")).where("b is not null")
    total = lengths.groupBy(*name).agg(F.sum("songs").alias("variants"))
    out = named.join(best.join(total, name), [*name, "seconds"])
    return out.select("path", "variants", "b.variant", "b.gap", F.when(~F.col("b.off"), "match").otherwise("mismatch").alias("state"))


def occurrence_states(occurrences: DataFrame, files: DataFrame) -> DataFrame:
    """(playlist_id, seq, dev, ino, path, state): each use of a file against its own expected length.

    The state is the file's, so it is worked out before the join, and large tables are dealt out by their number of rows.
    """
    on, tasks = ["folder", "song_id"], tasks_for(occurrences)
    reason = keys.length_reason(F.col("expected_ms"), F.col("seconds"))
    state = F.when(reason == "missing-source", "missing-source-metadata").when(reason == "match", "length-match").otherwise("probable-bad-duration")
    rows = dealt(occurrences, tasks, *on).join(dealt(files.select(*on, "path", "dev", "ino", "size", state.alias("state")), tasks, *on), on)
    return rows.select("playlist_id", "seq", "song_id", "folder", "dev", "ino", "path", "size", "state")


def file_state(states: DataFrame) -> DataFrame:
    """Per physical file the worst state of its uses: bad before missing before match."""
    is_ = lambda s: F.bool_or(F.col("state") == s)
    out = states.groupBy("dev", "ino").agg(F.count("*").alias("uses"), F.max("size").alias("size"), is_("probable-bad-duration").alias("bad"), is_("missing-source-metadata").alias("missing"))
    return out.select("dev", "ino", "uses", "size", F.when(F.col("bad"), "probable-bad-duration").when(F.col("missing"), "missing-source-metadata").otherwise("length-match").alias("state"))


def full_audit(files: DataFrame) -> DataFrame:
    """Files, uses and bytes by state, from ``file_state``."""
    return files.groupBy("state").agg(F.count("*").alias("files"), F.sum("uses").alias("uses"), F.sum("size").alias("bytes"))


def edition_ambiguity(states: DataFrame) -> DataFrame:
    """States per physical file; unless all its uses match or all mismatch, every use is ambiguous."""
    per = states.groupBy("dev", "ino").agg(F.count_distinct("state").alias("kinds"), F.min("state").alias("only"))
    decisive = (F.col("kinds") == 1) & F.col("only").isin("length-match", "probable-bad-duration")
    return per.select("dev", "ino", F.when(decisive, F.col("only")).otherwise("ambiguous-source-editions").alias("state"))


def audit_unique(states: DataFrame) -> DataFrame:
    """Per song: all its uses match, any is bad, or unknown; then counts."""
    per = states.groupBy("song_id").agg(F.bool_and(F.col("state") == "length-match").alias("all_match"), F.bool_or(F.col("state") == "probable-bad-duration").alias("any_bad"))
    verdict = F.when(F.col("any_bad"), "any-bad").when(F.col("all_match"), "all-match").otherwise("unknown")
    return per.select(verdict.alias("verdict")).groupBy("verdict").agg(F.count("*").alias("songs"))


def repair_manifest(states: DataFrame) -> DataFrame:
    """Physical files whose every use fails: paths and uses."""
    out = states.groupBy("dev", "ino").agg(F.bool_and(F.col("state") == "probable-bad-duration").alias("all_bad"), F.count("*").alias("uses"), F.count_distinct("path").alias("paths"), F.max("size").alias("size"))
    return out.where("all_bad").select("dev", "ino", "uses", "paths", "size")


def media_rollup(states: DataFrame) -> DataFrame:
    """Per song the best state over its places."""
    order = F.when(F.col("state") == "length-match", 0).when(F.col("state") == "missing-source-metadata", 1).otherwise(2)
    return states.groupBy("song_id").agg(F.min_by(F.struct("state", "path"), F.struct(order, "path")).alias("b"), F.count("*").alias("places")).select("song_id", "b.state", "b.path", "places")
