"""Identity verdicts, file resolution, presence, ratings, intervals and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import keys

# Words that say how a title is presented, not which recording it is.
PRESENTATION = ["official", "audio", "video", "lyric", "lyrics", "hd", "hq", "remaster", "remastered", "version", "mix", "original", "studio", "instrumental"]


def _plain(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def _core(c: Column) -> Column:
    """The title without presentation words, unless nothing else is left."""
    kept = F.array_join(F.filter(F.split(_plain(c), " "), lambda w: ~w.isin(PRESENTATION)), " ")
    return F.when(kept == "", _plain(c)).otherwise(kept)


def _phrase(whole: Column, part: Column) -> Column:
    return F.contains(F.concat(F.lit(" "), whole, F.lit(" ")), F.concat(F.lit(" "), part, F.lit(" ")))


def identity_verdict(artist: Column, name: Column, title: Column, channel: Column) -> Column:
    """The first reason against a candidate title for a song, or match."""
    wanted = _plain(keys.primary_artist(artist))
    by = _phrase(_plain(title), wanted) | _phrase(_plain(channel), wanted)
    same = F.array_join(keys.edition_flags(title), ",") == F.array_join(keys.edition_flags(keys.base_title(name)), ",")
    return F.when(_plain(title) == "", "missing-title").when(~_phrase(_core(title), _core(keys.base_title(name))), "title-mismatch").when((wanted == "") | ~by, "artist-mismatch").when(~same, "edition-mismatch").otherwise("match")


def media_resolve(occurrences: DataFrame, files: DataFrame) -> DataFrame:
    """For each occurrence the best file of its song: same folder first, then a fitting length, then the smallest path."""
    ok = keys.length_reason(F.col("expected_ms"), F.col("seconds"))
    have = files.select("song_id", F.col("folder").alias("at"), "path", ok.alias("reason"))
    # the best file elsewhere is one row a song, so only a song's files in the occurrence's own folder are joined to it
    rank = F.struct(F.col("reason") != "match", F.col("path"))
    anywhere = have.groupBy("song_id").agg(F.min_by(F.struct("path", "reason"), rank).alias("any"))
    own = have.select("song_id", F.col("at").alias("folder"), F.col("path").alias("own_path"), F.col("reason").alias("own_reason"))
    rows = occurrences.join(own, ["song_id", "folder"], "left").join(anywhere, "song_id", "left")
    first = F.col("own_reason") == "match"
    path = F.when(F.coalesce(first, F.lit(False)) | F.col("any.path").isNull(), F.col("own_path")).when(F.col("any.reason") == "match", F.col("any.path")).otherwise(F.coalesce("own_path", "any.path"))
    reason = F.when(F.coalesce(first, F.lit(False)), F.col("own_reason")).when(F.col("any.reason") == "match", F.col("any.reason")).otherwise(F.coalesce("own_reason", "any.reason"))
    verdict = F.when(reason.isNull(), "missing").when(reason == "match", "duration-match").when(reason == "mismatch", "mismatch").otherwise("unverified")
    return rows.select("playlist_id", "seq", path.alias("path"), verdict.alias("verdict"))


def presence(playlists: DataFrame, observed: DataFrame) -> DataFrame:
    """Whether the latest complete observation returned a playlist; unknown without one."""
    last = observed.where("complete").groupBy("playlist_id").agg(F.max_by("returned", "at").alias("returned"))
    out = playlists.select("playlist_id").join(last, "playlist_id", "left")
    return out.select("playlist_id", F.when(F.col("returned"), "present").when(~F.col("returned"), "not-returned").otherwise("unknown").alias("state"))


def ratings_last(votes: DataFrame) -> DataFrame:
    """The last vote of each pair; a null vote takes the pair away."""
    last = votes.groupBy("a", "b").agg(F.max_by(F.struct("vote"), F.struct("t", "event_id")).alias("v"))
    return last.select("a", "b", "v.vote").where("vote is not null")


def event_interval(files: DataFrame, events: DataFrame, slack_s: int = 1) -> DataFrame:
    """Files of a key with an event at or after their time, within two days and ``slack_s``: the count. Equi join on the key and day, so the range is looked for in two neighbouring days only."""
    day = lambda c: F.to_date(c)
    f = files.select("key", "file_id", "at").withColumn("day", F.explode(F.sequence(day("at"), F.date_add(day("at"), 2))))
    both = f.join(events.select("key", "event_id", "t", day("t").alias("day")), ["key", "day"])
    gap = keys.micros("t") - keys.micros("at")
    return both.where((gap >= -slack_s * 1_000_000) & (gap <= 172_800_000_000)).groupBy("key", "file_id").agg(F.count("*").alias("events"), F.min("event_id").alias("first_event"))


def exclusion_overlap(phases: DataFrame, excluded: DataFrame, bucket_s: int = 6 * 3600) -> DataFrame:
    """Phases that overlap an excluded interval of their key, half-open, and how many.

    Intervals meet in buckets of time that both touch, and a pair counts in the bucket of its later start; so a key's rows
    meet those near them, not all of the key's.
    """
    of = lambda c: F.floor(keys.micros(c) / (bucket_s * 1_000_000))
    mine = phases.withColumn("bucket", F.explode(F.sequence(of("start"), of("end"))))
    theirs = excluded.withColumn("bucket", F.explode(F.sequence(of("ex_start"), of("ex_end"))))
    both = mine.join(theirs, ["key", "bucket"]).where("start < ex_end and ex_start < end").where(F.col("bucket") == of(F.greatest("start", "ex_start")))
    return both.groupBy("key", "phase").agg(F.count("*").alias("overlaps"))


def class_report(rows: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """Per class: count, quartiles and a histogram over fixed edges."""
    bins = [F.count_if((F.col(value) >= a) & (F.col(value) < b)).alias(f"bin_{k}") for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    return rows.groupBy("class").agg(F.count("*").alias("n"), *(F.round(F.percentile(value, p), 6).alias(f"p{int(100 * p)}") for p in (0.1, 0.5, 0.9)), *bins)


def tempo_refine(events: DataFrame, span: int = 8, within: float = 0.5) -> DataFrame:
    """Beats a minute from spans of ``span`` beats that lie within ``within`` of the median span."""
    w = Window.partitionBy("key").orderBy("t", "event_id")
    spans = events.select("key", ((F.lead(keys.micros("t"), span).over(w) - keys.micros("t")) / 1e6).alias("s")).where("s > 0")
    mid = spans.groupBy("key").agg(F.percentile("s", 0.5).alias("m"))
    near = spans.join(mid, "key").where(F.abs(F.col("s") - F.col("m")) <= within * F.col("m"))
    return near.groupBy("key").agg(F.count("*").alias("spans"), F.round(60.0 * span / F.avg("s"), 6).alias("per_minute"))


def join_profile(bars: DataFrame, width: int = 3) -> DataFrame:
    """Mean level of the first and the last ``width`` bars of a series, relative to its mean."""
    w = Window.partitionBy("playlist_id")
    rows = bars.withColumn("last", F.max("bar").over(w))
    out = rows.groupBy("playlist_id").agg(F.avg(F.when(F.col("bar") <= width, F.col("level"))).alias("a"), F.avg(F.when(F.col("bar") > F.col("last") - width, F.col("level"))).alias("z"), F.avg("level").alias("m"))
    return out.select("playlist_id", F.round(F.col("a") - F.col("m"), 6).alias("entry"), F.round(F.col("z") - F.col("m"), 6).alias("exit"))


def coverage_assert(intervals: DataFrame) -> DataFrame:
    """Gaps, overlaps and empty pieces among a source's intervals in order."""
    w = Window.partitionBy("playlist_id").orderBy("bar")
    step = F.col("start") - F.lag("end").over(w)
    return intervals.withColumn("step", step).groupBy("playlist_id").agg(F.count_if(F.col("step") > 0).alias("gaps"), F.count_if(F.col("step") < 0).alias("overlaps"), F.count_if(F.col("end") <= F.col("start")).alias("empty"))


def changed_keys(files: DataFrame, folders: DataFrame) -> DataFrame:
    """Songs affected by changed folders, widened through files that share a physical id."""
    hit = files.join(folders.distinct(), "folder", "left_semi").select("dev", "ino").distinct()
    return files.join(hit, ["dev", "ino"], "left_semi").select("song_id").distinct()


def legacy_fallback(jobs: DataFrame, exact: DataFrame, legacy: DataFrame) -> DataFrame:
    """The row under a job's own key; else the parked one under its old key, without its address and flagged."""
    e = exact.select(F.col("key").alias("song_key"), F.col("state").alias("e_state"), F.col("url").alias("e_url"))
    old = legacy.where("state in ('missing', 'error')").select(F.col("key").alias("old_key"), F.col("state").alias("l_state"))
    both = jobs.join(e, "song_key", "left").join(old, "old_key", "left").where("e_state is not null or l_state is not null")
    return both.select("song_key", F.coalesce("e_state", "l_state").alias("state"), F.col("e_url").alias("url"), F.col("e_state").isNull().alias("legacy"))


def job_table(jobs: DataFrame, parents: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Jobs with their parent's name; a column that an older table lacks is read as null."""
    have = [F.col(c) if c in jobs.columns else F.lit(None).cast("string").alias(c) for c in columns]
    return jobs.select(key, *have).join(parents, key, "left")


def display_name(path: Column) -> Column:
    """A file name as a struct (artist, title): without folder, extension and id note; no dash, no artist."""
    stem = F.regexp_replace(F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", ""), r"\s*\[sp-[A-Za-z0-9]{22}\]$", "")
    at = F.instr(stem, " - ")
    return F.struct(F.when(at > 0, F.trim(F.substring(stem, F.lit(1), at - 1))).otherwise("").alias("artist"), F.when(at > 0, F.trim(F.substring(stem, at + 3, F.length(stem)))).otherwise(stem).alias("title"))


def queue_prune(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """Jobs by whether a file of the song already satisfies them: counts a playlist."""
    have = files.select("song_id").distinct().withColumn("ok", F.lit(True))
    out = jobs.join(have, "song_id", "left")
    return out.groupBy("playlist_id").agg(F.count_if(F.col("ok")).alias("satisfied"), F.count_if(F.col("ok").isNull()).alias("open"))


def conflict_files(songs: DataFrame, files: DataFrame) -> DataFrame:
    """For keys whose songs have several known lengths: files by verdict against their own song."""
    mixed = songs.groupBy("artist", "name").agg(F.count_distinct("expected_ms").alias("lengths")).where("lengths > 1").select("artist", "name")
    own = songs.join(mixed, ["artist", "name"], "left_semi").select("song_id", "artist", "name")
    reason = keys.length_reason(F.col("expected_ms"), F.col("seconds"))
    rows = own.join(files.select("song_id", "path", reason.alias("reason")), "song_id", "left")
    return rows.groupBy(F.coalesce("reason", F.lit("no-file")).alias("verdict")).agg(F.count("*").alias("n"), F.count_distinct("song_id").alias("songs"))


def zero_shot(vectors: DataFrame, prompts: DataFrame, scale: float = 10.0) -> DataFrame:
    """The prompt with the largest share of a scaled softmax over cosines; prompts are a stated set, met by broadcast or in blocks."""
    from trackloom.operators.features import against, dot, unit

    ask = prompts.select(F.col("vec_id").alias("prompt"), unit(F.col("embedding")).alias("p"))
    mine = vectors.select("vec_id", unit(F.col("embedding")).alias("u"))
    rows = against(mine, ask).select("vec_id", "prompt", F.exp(scale * dot(F.col("u"), F.col("p"))).alias("e"))
    out = rows.groupBy("vec_id").agg(F.max_by("prompt", F.struct("e", "prompt")).alias("prompt"), F.max("e").alias("top"), F.sum("e").alias("all"))
    return out.select("vec_id", "prompt", F.round(F.col("top") / F.col("all"), 6).alias("share"))


def nearest_section(pooled: DataFrame) -> DataFrame:
    """(series, section, distance) of each section's pooled unit vector to the nearest other section of its series.

    ``pooled``: (series, section, place, x), a row a dimension. A series' sections are few; series never meet each other.
    """
    whole = pooled.groupBy("series", "section").agg(F.array_sort(F.collect_list(F.struct("place", "x"))).alias("v"))
    other = whole.select("series", F.col("section").alias("near"), F.col("v").alias("u"))
    sim = F.aggregate(F.zip_with("v", "u", lambda a, b: a["x"] * b["x"]), F.lit(0.0), lambda s, x: s + x)
    met = whole.join(other, "series").where("section <> near").select("series", "section", sim.alias("sim"))
    return met.groupBy("series", "section").agg(F.round(1 - F.max("sim"), 4).alias("distance"))
