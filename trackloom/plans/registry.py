"""Queries over the driver tables, one for each operator, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.functions import keys
from trackloom.operators import catalog, events, evidence, features, matching, neighbours, planning
from trackloom.plans import audits, bindings, followers, ingest, oracle, profiles, signals, streams
from trackloom.sources import views
from trackloom.streaming import live

S = SparkSession


def _evidence(s: S, d: str) -> DataFrame:
    return matching.evidence(views.candidate(s, d), views.ledger(s, d))


def _states(s: S, d: str) -> DataFrame:
    return matching.occurrence_states(views.occurrence(s, d), views.file(s, d))


def _bars(s: S, d: str) -> DataFrame:
    return views.occurrence(s, d).select("playlist_id", F.col("seq").alias("bar"), (-100 * F.col("discount")).alias("rel_db"), (-100 * F.col("tax")).alias("low_db"), F.col("quantity").alias("level"))


def _items(s: S, d: str) -> DataFrame:
    """Songs as items with tempo, energy and a wheel code."""
    return views.table(s, d, "part").select(F.col("p_partkey").alias("song_id"), F.col("p_brand").alias("artist"), F.col("p_name").alias("name"), keys.fold_tempo(F.col("p_retailprice") / 10).alias("tempo"), (F.col("p_size") / 50.0).alias("energy"), F.concat((F.col("p_partkey") % 12 + 1).cast("string"), F.when(F.col("p_partkey") % 2 == 0, "A").otherwise("B")).alias("camelot"))


def _urls(s: S, d: str) -> DataFrame:
    return views.song(s, d).where("song_id % 3 = 0").select("song_id", F.concat(F.lit("http://h/"), "song_id").alias("url"))


def _vectors(s: S, d: str) -> DataFrame:
    return views.table(s, d, "embeddings")


def _to_do(s: S, d: str) -> DataFrame:
    """Documents without a result; labelled ones have one, but every seventh of those from another text of the same length."""
    docs = views.table(s, d, "documents")
    stale = F.when(F.col("doc_id") % 7 == 0, F.reverse("text")).otherwise(F.col("text"))
    done = docs.join(views.table(s, d, "labels").select("doc_id"), "doc_id", "left_semi").withColumn("text", stale)
    return planning.skip_done(docs, done.select(planning.fingerprint("v1").alias("mark")), "v1")


#: Error lines of each kind; other documents are their own text.
ERRORS = [
    "HTTP Error 429: Too Many Requests", "SIGN IN to confirm you are over 18", "read TIMED OUT", "youtube search failed (1)", "got 5 Bytes Read", "Media URL rejected (403)", "network down", "bot check",
    planning.NO_CANDIDATE[0], planning.NO_CANDIDATE[1], planning.NO_MATCH + " for x", "disk full",
]


def _retries(s: S, d: str) -> DataFrame:
    line = F.element_at(F.array(*map(F.lit, ERRORS)), (F.col("doc_id") % len(ERRORS) + 1).cast("int"))
    error = F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(line)
    return views.table(s, d, "documents").select("doc_id", *planning.retry_flags(error))


def _variants(s: S, d: str) -> DataFrame:
    n = F.col("song_id")
    artist = F.concat("artist", F.when(n % 3 == 0, " feat. Other").when(n % 3 == 1, " & Second").otherwise(""))
    name = F.concat("name", F.when(n % 4 == 0, " - 2011 Remastered").when(n % 4 == 1, ' "live"').otherwise(""))
    return views.song(s, d).select("song_id", F.array_join(planning.query_variants(artist, name, F.when(n % 2 == 0, F.col("bucket"))), "|").alias("variants"))


def _sections(s: S, d: str) -> DataFrame:
    """Sections of eight vectors in series of forty."""
    w = Window.partitionBy("label").orderBy("vec_id")
    v = _vectors(s, d).withColumn("at", F.row_number().over(w) - 1)
    v = v.select(F.concat_ws("-", "label", F.floor(F.col("at") / 40)).alias("series"), F.floor(F.col("at") % 40 / 8).alias("section"), "embedding")
    pooled = features.pool(v.withColumn("of", F.struct("series", "section")), "of")
    return evidence.nearest_section(pooled.select("of.series", "of.section", "place", "x"))


def _membership(s: S, d: str) -> DataFrame:
    """Saved lists and three observations: short ones, confirmed, changed or cut off, and for some playlists a full one."""
    o = views.occurrence(s, d)
    p, q = F.col("playlist_id"), F.col("quantity")
    shown = (q > F.when(p % 3 == 1, F.lit(10)).otherwise(F.lit(14)), q > 14, (p % 5 == 0) | ((p % 5 == 1) & (q > 14)) | ((p % 5 == 2) & (q > 45)) | ((p % 5 > 2) & (q > 25)))
    parts = [o.where(x).select("playlist_id", F.lit(n).alias("obs"), "song_id", "seq") for n, x in enumerate(shown, 1)]
    members = parts[0].union(parts[1]).union(parts[2])
    declared = members.groupBy("playlist_id", "obs").agg((F.count("*") + F.max(F.when((p + F.col("obs")) % 4 == 3, 1).otherwise(0))).alias("declared"))
    every = o.select("playlist_id").distinct().withColumn("obs", F.explode(F.array(*map(F.lit, (1, 2, 3)))))
    return catalog.observed_membership(o.where(q < 40), every.join(declared, ["playlist_id", "obs"], "left").withColumn("declared", F.coalesce("declared", F.col("playlist_id") % 2)), members)


def coverage(s: S, d: str) -> DataFrame:
    """The flagship: per playlist, how many members have a length-compatible file in their folder."""
    open_lists = views.playlist(s, d).where("not skipped").select("playlist_id")
    named = views.song(s, d).where("coalesce(artist, '') <> '' and coalesce(name, '') <> ''").select("song_id")
    rows = views.occurrence(s, d).join(open_lists, "playlist_id", "left_semi").join(named, "song_id", "left_semi")
    return catalog.playlist_coverage(rows, views.file(s, d))


def _titles(s: S, d: str, norm) -> DataFrame:
    """Whole texts with their normal form ``title``. Texts may be long, so Python gets few at once."""
    s.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    s.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    return views.table(s, d, "documents").select("doc_id", norm(F.col("text")).alias("title"))


def _credits(s: S, d: str) -> DataFrame:
    """Ten saved credits of a song's artist against the same, more, fewer, others, and a list of another length."""
    n, credit = F.col("song_id") % 5, lambda k: F.concat("artist", F.lit(f" {k}"))
    ten = F.concat_ws(", ", *(credit(k) for k in range(10)))
    current = F.when(n == 0, ten).when(n == 1, F.concat(ten, F.lit(", "), credit(10))).when(n == 2, F.concat_ws(", ", credit(0), credit(1))).when(n == 3, F.concat(ten, F.lit("x"))).otherwise(F.concat_ws(", ", *(credit(k) for k in range(9, -1, -1))))
    saved = F.when(F.col("song_id") % 7 == 0, F.concat_ws(", ", credit(0), credit(1))).otherwise(ten)
    return views.song(s, d).select("song_id", keys.credits_match(saved, current).alias("ok"))


def _events_old_new(s: S, d: str) -> tuple[DataFrame, DataFrame]:
    e = views.event(s, d)
    return e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1 or event_id % 6 = 0")


def _cosines(s: S, d: str) -> DataFrame:
    """Distances of the stated query vectors to all vectors of their label."""
    v = _vectors(s, d)
    asked = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("a"), F.col("label").alias("of"), features.unit(F.col("embedding")).alias("u"))
    rest = v.select("label", F.col("vec_id").alias("b"), features.unit(F.col("embedding")).alias("v"))
    return features.against(rest, asked).where("label = of").select("a", "b", F.round(1 - features.dot(F.col("u"), F.col("v")), 5).alias("distance"))


def _identities(s: S, d: str) -> DataFrame:
    """Each song against a title and channel that fit, or fail in one way or another, by its id."""
    n = F.col("song_id") % 5
    title = F.when(n == 0, "").when(n == 1, F.concat("artist", F.lit(" - "), "name", F.lit(" (Official Video)"))).when(n == 2, F.concat("name", F.lit(" live"))).when(n == 3, "something else").otherwise(F.col("name"))
    channel = F.when(n == 2, F.col("artist")).otherwise("other")
    return views.song(s, d).select("song_id", evidence.identity_verdict(F.col("artist"), F.col("name"), title, channel).alias("verdict"))


def _exclusions(s: S, d: str) -> DataFrame:
    e = views.event(s, d)
    phases = e.where("type = 'download_start'").select("key", F.col("event_id").alias("phase"), F.col("t").alias("start"), (F.col("t") + F.expr("INTERVAL 6 HOURS")).alias("end"))
    excluded = e.where("type = 'block'").select("key", F.col("t").alias("ex_start"), (F.col("t") + F.expr("INTERVAL 2 HOURS")).alias("ex_end"))
    return evidence.exclusion_overlap(phases, excluded)


def _legacy(s: S, d: str) -> DataFrame:
    songs, n = views.song(s, d), F.col("song_id")
    key, old = F.concat(F.lit("spotify:"), n), F.lower(F.concat_ws(" - ", "artist", n.cast("string")))
    state = F.when(n % 2 == 0, "missing").otherwise("saved").alias("state")
    return evidence.legacy_fallback(songs.select(key.alias("song_key"), old.alias("old_key")), songs.where("song_id % 4 = 0").select(key.alias("key"), F.lit("saved").alias("state"), F.lit("u").alias("url")), songs.where("song_id % 3 = 0").select(old.alias("key"), state))


QUERIES = {
    "src_event_union": lambda s, d: events.log_union(*_events_old_new(s, d)).select("event_id", "key", "type", "source"),
    "src_file_manifest": lambda s, d: catalog.file_manifest(views.file(s, d).withColumn("dev", F.floor(F.col("folder") / 2)).withColumn("ino", F.col("song_id"))),
    "snk_upsert_journal": lambda s, d: catalog.upsert(_events_old_new(s, d)[0].groupBy("key").agg(F.max_by("type", F.struct("t", "event_id")).alias("state"), F.max("event_id").alias("event_id")), _events_old_new(s, d)[1].select("key", F.col("type").alias("state"), "event_id", "t"), "key", ["t", "event_id"]),
    "snk_reconcile_rows": lambda s, d: catalog.reconcile(views.playlist(s, d).select("playlist_id", "status", "skipped"), views.playlist(s, d).select("playlist_id", F.when(F.col("rank") % 5 == 0, 4).otherwise(F.col("status")).alias("status"), "skipped"), "playlist_id"),
    "fn_file_base": lambda s, d: views.table(s, d, "documents").select("doc_id", F.md5(keys.file_base(F.col("source"), F.col("text"))).alias("base_md5")),
    "fn_source_key": lambda s, d: views.song(s, d).select("song_id", keys.source_key(keys.source_id(F.when(F.col("song_id") % 2 == 0, F.concat(F.lit("spotify:track:"), F.lpad(F.col("song_id").cast("string"), 22, "0")))), F.col("artist"), F.col("name")).alias("source_key")),
    "fn_base_title": lambda s, d: views.song(s, d).select("song_id", keys.base_title(F.concat("name", F.when(F.col("song_id") % 3 == 0, " - 2011 Remastered").when(F.col("song_id") % 3 == 1, " (Remaster)").otherwise(""))).alias("title")),
    "fn_primary_artist": lambda s, d: views.song(s, d).select("song_id", keys.primary_artist(F.concat("artist", F.when(F.col("song_id") % 2 == 0, " feat. Other").otherwise(", Second"))).alias("artist")),
    "fn_length_match": lambda s, d: views.candidate(s, d).select("song_id", "place", keys.length_reason(F.col("expected_ms"), F.col("seconds")).alias("reason"), F.round(keys.tolerance(F.col("expected_ms")), 6).alias("tolerance")),
    "fn_fold_tempo": lambda s, d: views.table(s, d, "part").select(F.col("p_partkey").alias("song_id"), F.round(keys.fold_tempo(F.col("p_retailprice") / 10), 6).alias("tempo")),
    "fn_ordered_hash": lambda s, d: catalog.ordered_hash(views.occurrence(s, d)),
    "fn_normalize_title": lambda s, d: _titles(s, d, keys.normalize_title).select("doc_id", F.length("title").alias("n"), F.md5("title").alias("title_md5")),
    "fn_normalize_identity": lambda s, d: _titles(s, d, keys.normalize_identity).select("doc_id", F.md5("title").alias("identity_md5")),
    "agg_catalog_dedup": lambda s, d: catalog.dedup(views.occurrence(s, d).join(catalog.keyed(views.song(s, d)), "song_id")),
    "agg_playlist_coverage": coverage,
    "agg_catalog_summary": lambda s, d: catalog.catalog_summary(views.playlist(s, d)),
    "agg_disjoint_windows": lambda s, d: catalog.disjoint_windows(views.song(s, d)),
    "agg_status_counts": lambda s, d: catalog.status_counts(views.playlist(s, d)),
    "agg_best_status": lambda s, d: catalog.best_status(views.playlist(s, d)),
    "agg_latest_by_key": lambda s, d: catalog.latest_by_key(views.event(s, d)),
    "agg_source_variants": lambda s, d: catalog.source_variants(views.song(s, d)),
    "agg_resolution_funnel": lambda s, d: catalog.resolution_funnel(views.playlist(s, d)),
    "agg_disk_usage": lambda s, d: catalog.disk_usage(views.file(s, d)),
    "agg_audit_unique": lambda s, d: matching.audit_unique(_states(s, d)),
    "agg_media_rollup": lambda s, d: matching.media_rollup(_states(s, d)),
    "agg_energy_score": lambda s, d: features.energy_score(views.table(s, d, "part").select(F.col("p_partkey").alias("song_id"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price")), "song_id", {"size": 1.0, "price": 0.5}),
    "agg_isotonic_curve": lambda s, d: features.isotonic_curve(views.table(s, d, "part").groupBy(F.col("p_size").alias("x")).agg(F.avg("p_retailprice").alias("y"))),
    "agg_output_audit": lambda s, d: events.output_audit(views.event(s, d)),
    "join_nearest_variant": lambda s, d: matching.nearest_variant(views.file(s, d), views.song(s, d)),
    "join_occurrence_compare": lambda s, d: _states(s, d).select("playlist_id", "seq", "state"),
    "join_reuse_url": lambda s, d: catalog.reuse_url(views.song(s, d), _urls(s, d)),
    "join_unmatched_coverage": lambda s, d: catalog.unmatched_coverage(views.song(s, d), views.file(s, d)),
    "set_membership_diff": _membership,
    "set_multiset_max": lambda s, d: catalog.multiset_max(*(e.where("type = 'block'").select("key") for e in _events_old_new(s, d)), "key"),
    "win_trailing_rates": lambda s, d: events.trailing_rates(views.event(s, d)),
    "win_overall_rate": lambda s, d: events.overall_rate(views.event(s, d)),
    "win_trip_episodes": lambda s, d: events.trip_episodes(views.event(s, d)).select("key", "episode", "blocks", "repeated"),
    "win_phase_benchmark": lambda s, d: events.phase_benchmark(views.event(s, d), cool_min=720),
    "win_eta": lambda s, d: events.eta(views.event(s, d).groupBy("key").agg(F.count_if(F.col("type") != "mp3_verified").alias("remaining"), (F.count_if(F.col("type") == "mp3_verified") / 60).alias("rate"))),
    "win_tempo_from_beats": lambda s, d: events.tempo_from_beats(views.event(s, d)),
    "win_second_levels": lambda s, d: events.second_levels(views.event(s, d)),
    "win_active_span": lambda s, d: features.active_span(_bars(s, d), 3.0),
    "win_rolling_median": lambda s, d: features.rolling_median(_bars(s, d)),
    "win_join_jumps": lambda s, d: features.join_jumps(_bars(s, d)),
    "win_timeline": lambda s, d: features.timeline(_bars(s, d)),
    "win_energy_tiers": lambda s, d: features.energy_tiers(_items(s, d), "song_id", "artist"),
    "ord_greedy_sequence": lambda s, d: features.greedy_sequence(_items(s, d), "name"),
    "vec_pool_normalize": lambda s, d: features.pool(_vectors(s, d), "label"),
    "vec_knn_vote": lambda s, d: neighbours.knn_vote(_vectors(s, d), _vectors(s, d).where("vec_id % 3 = 0")),
    "str_throughput": lambda s, d: live.throughput(views.event(s, d)),
    "ingest_skip_done": _to_do,
    "fn_excluded_name": lambda s, d: views.table(s, d, "documents").select("doc_id", planning.excluded_name(F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("Daily Mix "), "doc_id")).when(F.col("doc_id") % 4 == 1, " dj ").otherwise(F.col("text"))).alias("excluded")),
    "fn_genre_bucket": lambda s, d: views.table(s, d, "documents").select("doc_id", planning.genre_bucket(F.col("text")).alias("bucket")),
    "fn_retry_class": _retries,
    "fn_tempo_match": lambda s, d: views.table(s, d, "part").select(F.col("p_partkey").alias("song_id"), planning.tempo_match(F.col("p_retailprice"), F.col("p_size") * 40.0).alias("m")).select("song_id", "m.ratio", F.round("m.stretch", 6).alias("stretch")),
    "fn_e_star": lambda s, d: views.table(s, d, "lineitem").select(F.col("l_linenumber").alias("n")).distinct().select("n", F.round(planning.interpolate(F.col("n") / 7.0, planning.TARGET), 6).alias("target")),
    "fn_query_variants": _variants,
    "fn_camelot_distance": lambda s, d: _items(s, d).select("song_id", keys.camelot_distance(F.col("camelot"), F.when(F.col("song_id") % 5 == 0, "?").otherwise("8A")).alias("distance")),
    "flt_playlist_view": lambda s, d: views.playlist(s, d).where(F.contains(F.lower("name"), F.lit("#00000001")) & (F.col("status") != 4)).select("playlist_id", "name"),
    "flt_eligibility": lambda s, d: planning.eligibility(views.table(s, d, "documents")),
    "flt_block_assign": lambda s, d: planning.block_assign(_items(s, d)),
    "flt_fast_skip": lambda s, d: views.playlist(s, d).where((F.col("status") == 5) & ~((F.col("rank") % 7 == 0) | F.col("skipped"))).select("playlist_id"),
    "join_review_status": lambda s, d: planning.review_status(views.table(s, d, "documents"), views.table(s, d, "labels")),
    "join_nearest_grid": lambda s, d: planning.nearest_grid(views.event(s, d).where("type <> 'download_start'"), views.event(s, d).where("type = 'download_start'"), 36_000.0),
    "agg_review_metrics": lambda s, d: planning.review_metrics(planning.review_status(views.table(s, d, "documents"), views.table(s, d, "labels"))),
    "agg_resume_plan": lambda s, d: planning.resume_plan(views.playlist(s, d)),
    "set_snapshot_drift": lambda s, d: planning.snapshot_drift(catalog.ordered_hash(views.occurrence(s, d).where("playlist_id % 9 <> 0")), catalog.ordered_hash(views.occurrence(s, d).where("quantity > 3"))),
    "set_removed_work": lambda s, d: planning.removed_work(views.occurrence(s, d).select("playlist_id", "song_id", "seq"), views.occurrence(s, d).where("quantity < 10"), views.occurrence(s, d).where("quantity > 45")),
    "set_affected_rows": lambda s, d: planning.affected(views.occurrence(s, d).select("playlist_id", "song_id", "seq"), views.occurrence(s, d).where("quantity = 50 and song_id % 7 = 0"), "song_id"),
    "win_curve_bins": lambda s, d: planning.curve_bins(views.event(s, d)),
    "top_ready_order": lambda s, d: planning.ready_order(views.playlist(s, d)),
    "vec_cosine_distance": _cosines,
    "vec_kernel_regression": lambda s, d: planning.kernel_regression(_vectors(s, d), _vectors(s, d).where("vec_id % 100 = 0")),
    "fn_public_text": lambda s, d: views.table(s, d, "documents").select("doc_id", F.md5(keys.public_text(F.col("text"))).alias("text_md5")),
    "fn_camelot": lambda s, d: views.table(s, d, "part").select(F.col("p_partkey").alias("song_id"), keys.camelot(F.element_at(F.array(*map(F.lit, ("C", "Db", "D", "Bb", "?"))), (F.col("p_partkey") % 5 + 1).cast("int")), F.when(F.col("p_partkey") % 2 == 0, "major").otherwise("minor")).alias("code")),
    "fn_artist_set": lambda s, d: views.song(s, d).select("song_id", F.array_join(keys.artist_set(F.concat("artist", F.lit(" & Zed feat. "), "artist")), "|").alias("artists")),
    "fn_credits_match": lambda s, d: _credits(s, d),
    "flt_identity": _identities,
    "flt_beatable": lambda s, d: events.tempo_from_beats(views.event(s, d)).where("regularity >= 0.1 and gaps >= 8 and per_minute > 0").select("key", "gaps"),
    "join_media_resolve": lambda s, d: evidence.media_resolve(views.occurrence(s, d), views.file(s, d).where("path not like '%7/%'")),
    "join_presence": lambda s, d: evidence.presence(views.playlist(s, d), views.occurrence(s, d).select("playlist_id", (F.col("n") % 2 == 0).alias("complete"), F.col("seq").alias("at"), (F.col("quantity") > 20).alias("returned"))),
    "join_ratings_last": lambda s, d: evidence.ratings_last(views.event(s, d).select((F.col("key") % 10).alias("a"), (F.col("k") % 10).alias("b"), F.when(F.col("type") != "block", F.col("k")).alias("vote"), "t", "event_id")),
    "join_event_interval": lambda s, d: evidence.event_interval(views.event(s, d).where("type = 'download_start'").select("key", F.col("event_id").alias("file_id"), F.col("t").alias("at")), views.event(s, d).where("type = 'mp3_verified'")),
    "join_exclusion_overlap": _exclusions,
    "agg_grid_report": lambda s, d: evidence.class_report(views.table(s, d, "lineitem").select(F.col("l_returnflag").alias("class"), "l_quantity"), "l_quantity", [0.0, 10.0, 20.0, 30.0, 40.0, 51.0]),
    "win_tempo_refine": lambda s, d: evidence.tempo_refine(views.event(s, d)),
    "win_join_profile": lambda s, d: evidence.join_profile(_bars(s, d)),
    "set_changed_keys": lambda s, d: evidence.changed_keys(views.file(s, d), views.file(s, d).where("folder % 50 = 3").select("folder")),
    "join_legacy_fallback": _legacy,
    "top_labels": lambda s, d: features.top_labels(_vectors(s, d).select(F.col("label").alias("series"), "embedding"), 5),
    "fn_source_id": lambda s, d: views.table(s, d, "pages").select("page_id", keys.source_id(F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://open.spotify.com/track/"), F.lpad(F.col("page_id").cast("string"), 22, "a"), F.lit("?si=1"))).otherwise(F.col("url"))).alias("source_id")),
    "fn_display_name": lambda s, d: views.song(s, d).select("song_id", evidence.display_name(F.concat(F.lit("music/x/"), F.when(F.col("song_id") % 2 == 0, F.concat("artist", F.lit(" - "))).otherwise(""), F.col("name"), F.lit(" [sp-1234567890123456789012].mp3"))).alias("n")).select("song_id", "n.artist", "n.title"),
    "join_queue_prune": lambda s, d: evidence.queue_prune(views.occurrence(s, d), views.file(s, d).where("seconds > 300")),
    "agg_conflict_files": lambda s, d: evidence.conflict_files(views.song(s, d), views.file(s, d).where("song_id % 13 <> 0")),
    "vec_zero_shot": lambda s, d: evidence.zero_shot(_vectors(s, d), _vectors(s, d).where("vec_id < 4")),
    "win_nearest_section": _sections,
}

_PARTS = (ingest, bindings, profiles, followers, signals, streams, audits)
for _part in _PARTS:
    QUERIES |= _part.QUERIES
#: The SQL of every query that has one.
SQL = {k: v for part in (oracle, *_PARTS) for k, v in part.SQL.items()}
