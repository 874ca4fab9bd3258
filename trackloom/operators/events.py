"""Event analytics: rates, phases, load, episodes and time estimates over an event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import keys

WINDOWS_MIN = [10, 30, 60, 120]


def log_union(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two logs as one: chosen types, searches counted as starts, each row tagged with its log."""
    tag = lambda df, name: df.where(F.col("type").isin("mp3_verified", "download_start", "search_ok")).select("event_id", "t", "key", F.when(F.col("type") == "search_ok", "download_start").otherwise(F.col("type")).alias("type"), F.lit(name).alias("source"))
    return tag(first, "a").unionByName(tag(second, "b"))


def trailing_rates(events: DataFrame) -> DataFrame:
    """Starts, outputs and their rates in the last 10, 30, 60 and 120 minutes before the last event."""
    end = events.agg(F.max("t")).first()[0]
    rows = events.where(F.col("t") > F.lit(end) - F.expr("INTERVAL 120 MINUTES"))  # the windows end at one instant, so a scan of the last two hours serves all
    rows = rows.select("type", "t", F.explode(F.array(*map(F.lit, WINDOWS_MIN))).alias("minutes")).where(F.col("t") > F.lit(end) - F.make_interval(mins="minutes"))
    out = rows.groupBy("minutes").agg(F.count_if(F.col("type") == "download_start").alias("starts"), F.count_if(F.col("type") == "mp3_verified").alias("done"), F.count_if(F.col("type") == "block").alias("blocks"))
    return out.withColumn("rate", F.round(F.col("done") / F.col("minutes"), 6))


def overall_rate(events: DataFrame) -> DataFrame:
    done = events.where("type = 'mp3_verified'")
    out = done.agg(F.count("*").alias("done"), F.min("t").alias("first"), F.max("t").alias("last"))
    minutes = (keys.micros("last") - keys.micros("first")) / 60e6
    return out.select("done", F.round(F.col("done") / F.nullif(minutes, F.lit(0.0)), 6).alias("per_minute"))


def admission_load(events: DataFrame, most: int = 5) -> DataFrame:
    """Starts of a key in the ten minutes up to each start (one of exactly ten minutes ago is out), and whether one more is too many."""
    w = Window.partitionBy("key").orderBy(keys.micros("t")).rangeBetween(-(600_000_000 - 1), 0)
    rows = events.where("type = 'download_start'").withColumn("load", F.count("*").over(w))
    return rows.select("event_id", "key", "load", (F.col("load") >= most).alias("would_exceed"))


def trip_episodes(events: DataFrame, gap_min: int = 720) -> DataFrame:
    """Block events of a key grouped into episodes: a new one starts after ``gap_min`` minutes without a block."""
    w = Window.partitionBy("key").orderBy("t", "event_id")
    blocks = events.where("type = 'block'").withColumn("new", F.coalesce((keys.micros("t") - F.lag(keys.micros("t")).over(w) > gap_min * 60_000_000).cast("int"), F.lit(1)))
    return blocks.withColumn("episode", F.sum("new").over(w)).groupBy("key", "episode").agg(F.min("t").alias("began"), F.max("t").alias("ended"), F.count("*").alias("blocks"), (F.count("*") > 1).alias("repeated"))


def phase_benchmark(events: DataFrame, floor: tuple[int, int, int] = (1, 1, 8), cool_min: int = 30) -> DataFrame:
    """Phases of a key between its boundaries: a block, which puts the settings to the ``floor`` and cools for ``cool_min`` minutes,
    or a change to other settings than those before. The last phase ends with the key's log.

    Outputs are in [start, end), trips in (start, end]. Carry-over counts the outputs of a block's phase before it has cooled; the
    rate that counts for recovery is without them. The first and last full ten minutes and the last full thirty are null in
    shorter phases. One sort by key and time gives each event its phase by a running count of boundaries; the windows
    are fixed to the phase's edges, so they are counts over its own rows, and no range join is needed.
    """
    changed = F.struct((F.col("k") % 4).cast("int").alias("a"), (F.col("k") % 2).cast("int").alias("b"), (8 * (F.col("k") % 12)).cast("int").alias("c"))
    low = F.struct(*(F.lit(x).cast("int").alias(n) for n, x in zip("abc", floor)))
    w = Window.partitionBy("key").orderBy("t", "event_id")
    edges = events.where("type in ('pace_change', 'block')").withColumn("s", F.when(F.col("type") == "block", low).otherwise(changed)).withColumn("was", F.lag("s").over(w))
    edges = edges.where("type = 'block' or was is null or s <> was").select("key", "t", "event_id", F.lit("edge").alias("type"), F.when(F.col("type") == "block", keys.micros("t") + cool_min * 60_000_000).alias("cool"))
    rows = edges.unionByName(events.where("type in ('mp3_verified', 'block')").select("key", "t", "event_id", "type", F.lit(None).cast("long").alias("cool")))
    # at one instant a trip belongs to the phase that ends, an output to the one that begins
    turn = F.when(F.col("type") == "block", 0).when(F.col("type") == "edge", 1).otherwise(2)
    by = Window.partitionBy("key").orderBy("t", turn, "event_id")
    rows = rows.withColumn("phase", F.sum((F.col("type") == "edge").cast("int")).over(by)).where("phase > 0").withColumn("us", keys.micros("t"))
    ends = events.groupBy("key").agg(F.max(keys.micros("t")).alias("over"))
    phases = rows.where("type = 'edge'").join(ends, "key").select("key", "phase", F.col("us").alias("start"), "cool", F.coalesce(F.lead("us").over(Window.partitionBy("key").orderBy("phase")), F.col("over")).alias("end"))
    of = phases.join(rows.where("type <> 'edge'").select("key", "phase", "us", "type"), ["key", "phase"], "left")
    done, minute = F.col("type") == "mp3_verified", 60_000_000
    long = lambda m: F.max(F.col("end") - F.col("start")) >= m * minute
    counts = of.groupBy("key", "phase").agg(
        F.round(F.max((F.col("end") - F.col("start")) / 60e6), 6).alias("minutes"), F.count_if(done).alias("outputs"), F.count_if(F.col("type") == "block").alias("trips"), F.count_if(done & (F.col("us") < F.col("cool"))).alias("carry_over"),
        F.when(long(10), F.count_if(done & (F.col("us") < F.col("start") + 10 * minute))).alias("first_10"), F.when(long(10), F.count_if(done & (F.col("us") >= F.col("end") - 10 * minute))).alias("last_10"),
        F.when(long(30), F.count_if(done & (F.col("us") >= F.col("end") - 30 * minute))).alias("last_30"),
    )
    per = lambda n: F.coalesce(F.round(n / F.nullif(F.col("minutes"), F.lit(0.0)), 6), F.lit(0.0))
    return counts.select("*", per(F.col("outputs")).alias("rate"), per(F.col("outputs") - F.col("carry_over")).alias("recovered_rate"))


def eta(summary: DataFrame) -> DataFrame:
    """Hours for what remains, and a quarter more; null without a positive rate. ``summary``: (key, remaining, rate per minute)."""
    hours = F.when(F.col("rate") > 0, F.col("remaining") / F.col("rate") / 60)
    return summary.select("key", "remaining", F.round(hours, 6).alias("hours"), F.round(hours * 1.25, 6).alias("buffered_hours"))


def tempo_from_beats(events: DataFrame) -> DataFrame:
    """Per key, over the gaps of its series: median gap, beats a minute, share of regular gaps (within 15 %)."""
    w = Window.partitionBy("key").orderBy("t", "event_id")
    gaps = events.select("key", ((F.lead(keys.micros("t")).over(w) - keys.micros("t")) / 1e6).alias("gap")).where("gap > 0")
    per = gaps.groupBy("key").agg(F.percentile("gap", 0.5).alias("median"))
    out = gaps.join(per, "key").groupBy("key", "median").agg(F.avg((F.abs(F.col("gap") - F.col("median")) <= 0.15 * F.col("median")).cast("double")).alias("r"), F.count("*").alias("gaps"))
    return out.select("key", "gaps", F.round("median", 6).alias("median_gap"), F.round(60 / F.col("median"), 6).alias("per_minute"), F.round("r", 6).alias("regularity"))


def second_levels(events: DataFrame, bin_s: int = 3600) -> DataFrame:
    """Root mean square level in dB of a key's values per time bin."""
    at = F.floor(keys.micros("t") / (bin_s * 1_000_000))
    return events.groupBy("key", at.alias("bin")).agg(F.round(20 * F.log10(F.sqrt(F.avg(F.col("value") * F.col("value"))) + 1e-9), 6).alias("level_db"))


def output_audit(events: DataFrame, baseline: float = 3.0) -> DataFrame:
    """Outputs per day: count, keys that occur twice, multiple of the baseline rate per hour."""
    done = events.where("type = 'mp3_verified'").groupBy(F.to_date("t").alias("day"), "key").agg(F.count("*").alias("n"))
    return done.groupBy("day").agg(F.sum("n").alias("outputs"), F.count_if(F.col("n") > 1).alias("repeated_keys"), F.round(F.sum("n") / 24 / baseline, 6).alias("multiple"))
