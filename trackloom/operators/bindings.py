"""Who owns a file and what length it should have: exact bindings, source lengths, recovered history, repaired findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions import keys
from trackloom.operators import matching
from trackloom.sources.shared import materialize

SOURCE_ID = r"^[A-Za-z0-9]{22}$"
ISRC = r"^[A-Z]{2}[A-Z0-9]{3}[0-9]{7}$"


def exact_binding(files: DataFrame, identities: DataFrame, by_path: DataFrame, by_name: DataFrame) -> DataFrame:
    """(file_id, state, method, identity, candidates) of ``files`` (file_id, path, file_key, tag).

    Identities come from the saved path if any is saved under it, else from the file's name; more than one is unknown. A
    known ``tag`` that says otherwise makes it unknown; where nothing else binds, the known tag does. ``by_path`` (path,
    identity) and ``by_name`` (file_key, identity) may repeat pairs.
    """
    one = lambda df, key: df.groupBy(key).agg(F.count_distinct("identity").alias("n"), F.min("identity").alias("identity"))
    path = one(by_path, "path").select("path", F.col("n").alias("path_n"), F.col("identity").alias("path_id"))
    name = one(by_name, "file_key").select("file_key", F.col("n").alias("name_n"), F.col("identity").alias("name_id"))
    known = identities.select(F.col("identity").alias("tag")).distinct().withColumn("tag_known", F.lit(True))
    met = files.join(path, "path", "left").join(name, "file_key", "left").join(known, "tag", "left")
    n, own = F.coalesce("path_n", "name_n", F.lit(0)), F.coalesce("path_id", "name_id")
    tag = F.when(F.col("tag_known"), F.col("tag"))
    conflict = (n == 1) & tag.isNotNull() & (tag != own)
    bound = F.when((n == 1) & ~F.coalesce(conflict, F.lit(False)), own).when(n == 0, tag)
    method = F.when(n > 1, "several identities").when(F.coalesce(conflict, F.lit(False)), "conflicts with tag").when(F.col("path_n") == 1, "path").when(n == 1, "filename").when(tag.isNotNull(), "tags").otherwise("none")
    candidates = F.when(F.coalesce(conflict, F.lit(False)), 2).otherwise(n)
    return met.select("file_id", F.when(bound.isNull(), "unknown-identity").otherwise("bound").alias("state"), method.alias("method"), bound.alias("identity"), candidates.cast("long").alias("candidates"))


def valid_metadata(id_: Column, name: Column, artist: Column, meta: Column) -> Column:
    """Cached metadata speaks for a song only in the known version, with its id, a length, and the same name and credits."""
    same = (keys.normalize_identity(meta["name"]) == keys.normalize_identity(name)) & (keys.normalize_identity(name) != "") & (keys.normalize_identity(artist) != "")
    return F.coalesce((meta["version"] == 1) & (meta["id"] == id_) & id_.rlike(SOURCE_ID) & (meta["duration_ms"] > 0) & same & keys.credits_match(artist, meta["artist"]), F.lit(False))


def source_duration(songs: DataFrame, metadata: DataFrame) -> DataFrame:
    """(song_id, state, duration_ms) of ``songs`` (song_id, artist, name, expected_ms, ids array, conflict).

    A conflict of lengths or several ids is an error state; else the song's own length counts, or that of valid cached
    ``metadata`` (id, version, name, artist, duration_ms) under its one id.
    """
    ids = F.array_distinct(F.filter("ids", lambda x: x.rlike(SOURCE_ID)))
    rows = songs.withColumn("ids", ids).withColumn("id", F.when(F.size("ids") == 1, F.get("ids", F.lit(0))))
    met = rows.join(metadata.select(F.struct("*").alias("meta")), F.col("id") == F.col("meta.id"), "left")
    own = F.when(F.col("expected_ms") > 0, F.col("expected_ms"))
    cached = F.when(valid_metadata(F.col("id"), F.col("name"), F.col("artist"), F.col("meta")), F.col("meta.duration_ms"))
    state = F.when(F.col("conflict"), "conflict").when(F.size("ids") > 1, "ambiguous").when(own.isNotNull(), "own").when(cached.isNotNull(), "cached").otherwise("unavailable")
    return met.select("song_id", state.alias("state"), F.when(state == "own", own).when(state == "cached", cached).alias("duration_ms"))


def history_recovery(unknown: DataFrame, history: DataFrame) -> DataFrame:
    """Per unknown file (file_id, key) that old records (artist, name, key, ids array, detail) name exactly: how many
    records bind it, the distinct ids they give, and how many name it without an id. Names come before keys; ``detail``,
    free text, never binds. What a key has is counted once, whatever the number of files of that key; a file has one row."""
    named = F.col("artist").isNotNull() & F.col("name").isNotNull()
    exact = F.lower(F.when(named, F.concat_ws(" - ", "artist", "name")).otherwise(F.col("key")))
    records = history.select(exact.alias("key"), F.array_distinct(F.filter("ids", lambda x: x.rlike(SOURCE_ID))).alias("ids"))
    n = F.size("ids")
    counts = records.groupBy("key").agg(F.count_if(n > 0).alias("bindings"), F.count_if(n == 0).alias("observations"))
    ids = records.select("key", F.explode("ids").alias("id")).groupBy("key").agg(F.count_distinct("id").alias("ids"))
    named = unknown.select("file_id", F.lower("key").alias("key")).join(counts.join(ids, "key", "left"), "key")
    return named.select("file_id", "bindings", F.coalesce("ids", F.lit(0)).cast("long").alias("ids"), "observations")


def store_uses(states: DataFrame, path: str, parts: int = 32) -> None:
    """Writes uses of files (dev, ino, path, song_id, state, ...) in ``parts`` partitions by physical file, so that a file's uses are
    in one of them. A partition is a few files, not one task's."""
    part = F.pmod(F.xxhash64("dev", "ino"), F.lit(parts)).cast("int")
    states.withColumn("part", part).repartition("part", F.pmod(F.xxhash64("path"), F.lit(4))).write.partitionBy("part").parquet(path)


def complete_stored(spark: SparkSession, path: str, files: DataFrame, resolved: DataFrame) -> list[int]:
    """Compares the stored uses at ``path`` that lacked a length with the lengths since ``resolved`` (song_id, ms), and writes again
    the partitions that hold one, no others; returns their numbers.

    What changes is worked out and written elsewhere first, then the partitions are overwritten: if that is cut off, running it
    again gives the same, as the uses that were compared no longer lack a length.
    """
    stored = spark.read.parquet(path)
    lacking = stored.where("state = 'missing-source-metadata'").join(resolved.where("ms is not null"), "song_id", "left_semi")
    touched = sorted(r.part for r in lacking.select("part").distinct().collect())  # at most a number a partition
    if not touched:
        return []
    again = materialize(_compared_again(stored.where(F.col("part").isin(touched)), files, resolved).select(stored.columns), "completed")
    again.repartition("part", F.pmod(F.xxhash64("path"), F.lit(4))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    spark.catalog.refreshByPath(path)
    return touched


def _compared_again(states: DataFrame, files: DataFrame, resolved: DataFrame) -> DataFrame:
    met = states.join(files.select("path", "seconds"), "path", "left").join(resolved, "song_id", "left")
    reason = keys.length_reason(F.col("ms"), F.col("seconds"))
    new = F.when(reason == "match", "length-match").when(reason != "missing-source", "probable-bad-duration")
    again = F.when(F.col("state") == "missing-source-metadata", F.coalesce(new, F.col("state"))).otherwise(F.col("state"))
    return met.withColumn("state", again)


def source_completion(spark: SparkSession, path: str, files: DataFrame, resolved: DataFrame) -> DataFrame:
    """``file_state`` of the uses stored at ``path`` after those that lacked a length are compared with the lengths since ``resolved``
    (song_id, ms); all other uses keep their state, and partitions without one keep their files."""
    complete_stored(spark, path, files, resolved)
    return matching.file_state(spark.read.parquet(path))


def _single(df: DataFrame, key: str, what: str) -> DataFrame:
    """``df`` with one row a key; a second one fails the query when it is met."""
    n = F.count("*").over(_by(key))
    return df.withColumn("n", n).withColumn(key, F.when(F.col("n") == 1, F.col(key)).otherwise(F.raise_error(F.concat(F.lit(f"repeated {what}: "), F.col(key).cast("string"))))).drop("n")


def _by(key: str):
    from pyspark.sql import Window

    return Window.partitionBy(key)


def export_enrich(rows: DataFrame, proof: DataFrame, analysis: DataFrame, metadata: DataFrame, scores: DataFrame) -> DataFrame:
    """Members of a list with their file's proof, analysis, metadata and score; a repeated id on any side raises.

    ``isrc`` is kept only in its format; ``complete`` says whether proof, analysis and metadata are all there and agree on the length.
    """
    met = rows
    for side, what in ((proof, "proof"), (analysis, "analysis"), (metadata, "metadata"), (scores, "score")):
        met = met.join(_single(side, "song_id", what), "song_id", "left")
    isrc = F.when(F.upper(F.regexp_replace("isrc", "-", "")).rlike(ISRC), F.upper(F.regexp_replace("isrc", "-", "")))
    agrees = keys.length_reason(F.col("expected_ms"), F.col("seconds")) == "match"
    complete = F.col("path").isNotNull() & F.col("tempo").isNotNull() & F.col("expected_ms").isNotNull() & agrees
    return met.select("playlist_id", "seq", "song_id", "path", F.round("tempo", 6).alias("tempo"), isrc.alias("isrc"), F.round("energy", 6).alias("energy"), F.coalesce(complete, F.lit(False)).alias("complete"))


def local_reuse(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """Open rows (row_id, folder, base, url, status) that a file (folder, base, url, size) already serves: one at the
    destination, else one of its name anywhere, else one that the first row of its url has at its own place."""
    files = stored.where("size > 0")
    at_place = files.select("folder", F.lower("base").alias("base"), F.concat_ws("/", "folder", "base").alias("at_place")).dropDuplicates(["folder", "base"])
    by_name = files.groupBy(F.lower("base").alias("base")).agg(F.min(F.concat_ws("/", "folder", "base")).alias("by_name"))
    rows = wanted.withColumn("base", F.lower("base"))
    placed = rows.join(at_place, ["folder", "base"], "left")
    by_url = placed.where("url is not null and at_place is not null").groupBy("url").agg(F.min_by("at_place", "row_id").alias("by_url"))
    open_rows = placed.where(F.col("status").isin(0, 1, 2, 3)).join(by_name, "base", "left").join(by_url, "url", "left")
    how = F.when(F.col("at_place").isNotNull(), "destination").when(F.col("by_name").isNotNull(), "name").when(F.col("by_url").isNotNull(), "source")
    return open_rows.select("row_id", how.alias("how"), F.coalesce("at_place", "by_name", "by_url").alias("source")).where("how is not null")


def replacement_status(deleted: DataFrame, replaced: DataFrame) -> DataFrame:
    """Per ledger key: ``resolved`` if its evidence (key, file_id, source_id, deleted, expected_ms) names one identity at
    most, all its files are deleted, and the replacement (key, seconds) fits every expected length; else ``needs-review``.
    Keys without a replacement stay ``open``."""
    met = deleted.join(replaced, "key", "left")
    fits = keys.length_reason(F.col("expected_ms"), F.col("seconds")) == "match"
    of = met.groupBy("key").agg(F.count_distinct("source_id").alias("identities"), F.bool_and("deleted").alias("covered"), F.bool_and(fits).alias("all_match"), F.max("seconds").alias("seconds"), F.count("*").alias("files"))
    state = F.when(F.col("seconds").isNull(), "open").when((F.col("identities") <= 1) & F.col("covered") & F.col("all_match"), "resolved").otherwise("needs-review")
    return of.select("key", "files", "identities", state.alias("state"))


def mark_findings(findings: DataFrame, ledger: DataFrame) -> DataFrame:
    """The ledger's latest row of each key after current findings (key, file_id, checked_at) are folded in.

    New keys are added; a resolved row is reopened only by evidence newer than its resolution; an open row takes the
    findings unless it has the same ones. ``ledger``: (key, entry, status, resolved_at, seen), ``seen`` the files it names.
    """
    found = findings.groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("file_id")), ",").alias("found"), F.max("checked_at").alias("checked_at"))
    last = ledger.groupBy("key").agg(F.max_by(F.struct("status", "resolved_at", "seen"), "entry").alias("l")).select("key", "l.*")
    met = last.join(found, "key", "full")
    stale = (F.col("status") == "resolved") & F.col("resolved_at").isNotNull() & (F.col("checked_at") <= F.col("resolved_at"))
    action = F.when(F.col("found").isNull(), "untouched").when(F.col("status").isNull(), "added").when(F.coalesce(stale, F.lit(False)), "stale").when(F.col("status") == "resolved", "reopened").when(F.coalesce(F.col("seen") == F.col("found"), F.lit(False)), "same").otherwise("updated")
    after = F.when(action.isin("added", "reopened"), "needs-review").otherwise(F.col("status"))
    return met.select("key", action.alias("action"), after.alias("status"))
