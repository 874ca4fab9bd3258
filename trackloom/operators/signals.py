"""Series of a track: sections, landings and exits, repetition, novelty, beats, frames, blends.

A series is one track, so what a window or a join within it holds is bounded by a track's length. ``bars``: (series, bar from 0,
rel_db, low_db, label). Means over any stretch of bars come from running sums, so a landing meets two rows, not its bars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.sources.shared import materialize

from trackloom.operators.features import dot, unit

# Limits and weights of sections, landings, exits, blends, grids.
VETO_REL, VETO_LOW, NATURAL, DIP, TAIL_BARS, TAIL_DB, LULL_DB, LOUD_DB = -4.0, -15.0, 4.0, 3.0, 4, 3.0, -5.0, -6.0
BODY_BARS, BODY_SECONDS, PHRASE = (8, 12, 16, 24, 32), (28.0, 64.0), 8
PRIOR = {"chorus": 1.0, "solo": 0.8, "inst": 0.7, "verse": 0.4, "bridge": 0.3, "intro": 0.1, "break": 0.1, "outro": 0.05}
H = {"level": 0.12, "contrast": 0.06, "contrast_cap": 10.0, "exit": 0.2, "on_grid": 0.2, "lull": -1.5, "ends_in_fade": -0.8, "early": -0.4, "dur": -0.006, "dur_target_s": 50.0, "section_end": 0.15, "verse_bar": -0.03}
DROP_PRIOR, DROP_CONTRAST, DROP_LOW, EARLY_S, ARRIVAL_CONTRAST = 0.95, 3.0, 6.0, 20.0, 2.0
HIGHLIGHT, VERSE = ("chorus", "inst", "solo"), ("verse", "outro", "break")
BLEND = {"dip_free": 3.0, "dip_per": 4.0, "hole_db": 9.0, "hole_w": 60.0, "jump_free": 3.0, "jump_per": 3.0, "clash_free": 0.3, "clash_w": 40.0}
ARRIVAL = {"rise": 3.0, "low": 6.0, "loud": -3.0, "low_share": 0.1, "move": 0.5}
GRID = {"rough": 0.25, "groove_min": 0.005, "groove_max": 0.025, "outlier": 0.04, "least": 16, "locked_rms": 0.006, "locked_max": 0.015, "locked_keep": 0.9, "verify_rms": 0.015, "verify_keep": 0.8}


def _series(order: str = "bar"):
    return Window.partitionBy("series").orderBy(order)


def _running(bars: DataFrame) -> DataFrame:
    """(series, bar, nb, last_loud, sums of what lies before each bar), with a row for the end."""
    ends = bars.groupBy("series").agg((F.max("bar") + 1).alias("nb"), F.coalesce(F.max(F.when(F.col("rel_db") >= LOUD_DB, F.col("bar"))), F.lit(-1)).alias("last_loud"))
    at_end = ends.select("series", F.col("nb").alias("bar"), F.lit(0.0).alias("rel_db"), F.lit(0.0).alias("low_db"), F.lit(None).cast("string").alias("label"))
    before = _series().rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0.0))
    rows = bars.select("series", "bar", "rel_db", "low_db", "label").unionByName(at_end)
    sums = rows.select("series", "bar", total(F.col("rel_db")).alias("rel"), total(F.col("low_db")).alias("low"), total((F.col("rel_db") < LULL_DB).cast("double")).alias("lull"), total(F.col("label").isin(*VERSE).cast("double")).alias("verse"))
    return sums.join(ends, "series")


def _mean(of: str, a: str, b: str) -> Column:
    return (F.col(f"{b}.{of}") - F.col(f"{a}.{of}")) / F.nullif(F.col(f"{b}.bar") - F.col(f"{a}.bar"), F.lit(0))


def _at_most(a: Column, b: Column) -> Column:
    """a <= b for numbers that come from sums: apart from what adding up in another order changes."""
    return F.round(a, 9) <= F.round(b, 9)


def _to_places(c: Column, n: int) -> Column:
    """``c`` at ``n`` decimal places. The number is scaled first, so that a half which adding up left an ulp short is still a half."""
    return F.round(c * 10.0**n) / 10.0**n


def _quantile(c: Column, share: float) -> Column:
    """The ``share`` quantile of a series' numbers, rounded once: ``percentile`` rounds both products and their sum, which ends an ulp
    apart and then on the other side of a half. The product's error is exact (Dekker), and so is the sum's."""
    values = F.array_sort(F.collect_list(c))
    at = (F.size(values) - 1) * F.lit(share)
    lower, upper = F.get(values, F.floor(at).cast("int")), F.get(values, F.ceil(at).cast("int"))
    a, b, add = lower, 1 - (at - F.floor(at)), upper * (at - F.floor(at))
    high = lambda x: 134217729.0 * x - (134217729.0 * x - x)
    (ah, al), (bh, bl), product = (high(a), a - high(a)), (high(b), b - high(b)), a * b
    lost = ((ah * bh - product) + ah * bl + al * bh) + al * bl
    total = product + add
    return total + ((product - (total - (total - product))) + (add - (total - product)) + lost)


def starts_of(bars: DataFrame) -> DataFrame:
    """(series, bar, label, until): the bars where a label begins, and where the next one does."""
    marked = bars.withColumn("new", F.coalesce(F.lag("label").over(_series()) != F.col("label"), F.lit(True)))
    nb = F.max("bar").over(Window.partitionBy("series")) + 1
    starts = marked.withColumn("nb", nb).where("new").select("series", "bar", "label", "nb")
    return starts.withColumn("until", F.coalesce(F.lead("bar").over(_series()), F.col("nb"))).drop("nb")


def _marked(bars: DataFrame) -> DataFrame:
    """Bars with what bodies that start or end there are made of, from one sort of each series: ``last_loud``, the struct
    ``here`` of the running sums before the bar, ``start`` (a label begins here), ``last_rel`` and ``last_label`` of the bar before,
    and the lowest, highest and number (``t_lo``, ``t_hi``, ``t_n``) of the bars of a tail from here. Each series has one more row for its end."""
    whole, ahead = Window.partitionBy("series"), _series().rowsBetween(0, TAIL_BARS - 1)
    before = _series().rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0.0))
    rows = bars.select("series", "bar", "rel_db", "low_db", "label", F.lit(False).alias("end"))
    end = F.when(F.lead("bar").over(_series()).isNull(), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    rows = rows.withColumn("ends", end).select(*rows.columns[:-1], F.explode("ends").alias("end"))
    real = lambda c: F.when(~F.col("end"), F.col(c))
    rows = rows.select("series", (F.col("bar") + F.col("end").cast("int")).alias("bar"), real("rel_db").alias("rel_db"), real("low_db").alias("low_db"), real("label").alias("label"), "end")
    sums = F.struct("bar", total(F.col("rel_db")).alias("rel"), total(F.col("low_db")).alias("low"), total((F.col("rel_db") < LULL_DB).cast("double")).alias("lull"), total(F.col("label").isin(*VERSE).cast("double")).alias("verse"))
    last_label = F.lag("label").over(_series())
    return rows.select(
        "series", "bar", "label", "end", sums.alias("here"), F.coalesce(F.max(F.when(F.col("rel_db") >= LOUD_DB, F.col("bar"))).over(whole), F.lit(-1)).alias("last_loud"),
        (~F.col("end") & F.coalesce(last_label != F.col("label"), F.lit(True))).alias("start"), F.lag("rel_db").over(_series()).alias("last_rel"), last_label.alias("last_label"),
        F.min("rel_db").over(ahead).alias("t_lo"), F.max("rel_db").over(ahead).alias("t_hi"), F.count(F.when(~F.col("end"), 1)).over(ahead).alias("t_n"),
    )


def _ahead(rows: DataFrame) -> DataFrame:
    """Marked bars with ``there``: what is known of an exit at this bar, and the sums ``s_t`` a tail later (at most at the end)."""
    tail = F.coalesce(F.lead("here", TAIL_BARS).over(_series()), F.last("here").over(_series().rowsBetween(0, TAIL_BARS)))
    return rows.withColumn("there", F.struct("here", "start", "end", "last_rel", "last_label", "t_lo", "t_hi", "t_n", tail.alias("s_t")))


def _exit_terms(rows: DataFrame) -> DataFrame:
    """``rows`` (s_j, s_x: sums at the body's first bar and at its exit, last_loud, and ``out``, what is known of the exit) with level,
    natural, dip, tail, lull, fade and verse."""
    rows = rows.withColumns({"s_x": F.col("out.here"), "s_t": F.col("out.s_t")})
    level = _mean("rel", "s_j", "s_x")
    tail = (F.col("out.t_n") == TAIL_BARS) & _at_most(level - TAIL_DB, F.col("out.t_lo")) & _at_most(F.col("out.t_hi"), level + TAIL_DB)
    return rows.withColumns({
        "level": level, "natural": F.coalesce(_at_most(_mean("rel", "s_x", "s_t"), level - NATURAL), F.lit(False)), "dip": F.coalesce(_at_most(F.col("out.last_rel"), level - DIP), F.lit(False)), "tail": F.coalesce(tail, F.lit(False)),
        "lull": F.coalesce(_mean("lull", "s_j", "s_x"), F.lit(0.0)), "fade": F.col("s_x.bar") >= F.col("last_loud") - 1, "verse_bars": F.col("s_x.verse") - F.col("s_j.verse"),
    })


def _sections(rows: DataFrame) -> DataFrame:
    """Section starts among the bars of ``_ahead``, with the struct ``out`` of the next one (or the end), the terms of an exit there, and ``vetoed``."""
    marks = rows.where("start or end").withColumn("out", F.lead("there").over(_series())).where("start")
    marks = _exit_terms(marks.withColumn("s_j", F.col("here")))
    return marks.withColumn("vetoed", _at_most(F.col("level"), F.lit(VETO_REL)) | _at_most(_mean("low", "s_j", "s_x"), F.lit(VETO_LOW)))


def section_stats(bars: DataFrame) -> DataFrame:
    """Per section start: its end, whether it is vetoed as a landing (quiet or without bass), and the terms of an exit at its end."""
    out = _sections(_ahead(_marked(bars)))
    return out.select("series", "bar", "label", F.col("s_x.bar").alias("until"), F.round("level", 8).alias("level"), "vetoed", "natural", "dip", "tail", F.round("lull", 6).alias("lull"), "fade")


def highlight_scores(bars: DataFrame, bar_s: float = 2.0) -> DataFrame:
    """(series, bar, until, score, place, contrast, low_jump) of every valid body from a section start, best first in its series.

    A body has an allowed number of bars and of seconds, ends on a section or phrase boundary before the last loud bar, and
    doesn't start in a vetoed section. Ends lie a fixed number of bars ahead, so they are looked up in one sort of the
    series, without a join. Bars of a series are numbered from 0 without gaps.
    """
    lengths = [n for n in BODY_BARS if BODY_SECONDS[0] <= n * bar_s <= BODY_SECONDS[1]]
    first = _series().rowsBetween(-4, 0)
    rows = _ahead(_marked(bars))
    ends = F.array(*(F.struct(F.lit(n).alias("n"), F.lead("there", n).over(_series()).alias("out")) for n in lengths))
    fitting = F.filter(ends, lambda e: e["out"].isNotNull() & (F.col("bar") + e["n"] < F.col("last_loud")) & (e["out"]["start"] | ((F.col("bar") + e["n"]) % PHRASE == 0)))
    s_2 = F.coalesce(F.lead("here", 2).over(_series()), F.last("here").over(_series().rowsBetween(0, 2)))
    rows = rows.withColumns({"ends": fitting, "s_4": F.first("here").over(first), "s_2": s_2}).where("start or end")
    rows = _sections(rows).where("not vetoed").select("series", F.col("bar").alias("j"), "label", "last_loud", "s_j", "s_2", "s_4", F.explode("ends").alias("e"))
    rows = _exit_terms(rows.select("*", "e.n", "e.out").drop("e")).withColumns({"x": F.col("s_x.bar"), "bound": F.col("out.start"), "end_label": F.col("out.last_label")})
    contrast = F.coalesce(_mean("rel", "s_j", "s_2") - _mean("rel", "s_4", "s_j"), F.lit(0.0))
    low_jump = F.coalesce(_mean("low", "s_j", "s_2") - _mean("low", "s_4", "s_j"), F.lit(0.0))
    prior = F.coalesce(F.create_map(*(F.lit(v) for p in PRIOR.items() for v in p))[F.col("label")], F.lit(0.3))
    drop = F.col("label").isin(*HIGHLIGHT) & _at_most(F.lit(DROP_CONTRAST), contrast) & _at_most(F.lit(DROP_LOW), low_jump)
    is_ = lambda c: c.cast("int")
    score = (
        F.when(drop, F.greatest(prior, F.lit(DROP_PRIOR))).otherwise(prior)
        + H["level"] * F.col("level")
        + H["contrast"] * F.least(contrast, F.lit(H["contrast_cap"]))
        + H["exit"] * is_(F.col("natural") | F.col("tail"))
        + H["on_grid"] * is_(F.col("j") % PHRASE == 0)
        + H["lull"] * F.col("lull")
        + H["ends_in_fade"] * is_(F.col("fade"))
        + H["early"] * is_(F.col("j") * bar_s < EARLY_S)
        + H["dur"] * F.abs(F.col("n") * bar_s - H["dur_target_s"])
        + H["verse_bar"] * F.col("verse_bars")
        + H["section_end"] * is_(F.coalesce("bound", F.lit(False)) & F.col("end_label").isin(*HIGHLIGHT))
    )
    out = rows.select("series", F.col("j").alias("bar"), F.col("x").alias("until"), F.round(score, 4).alias("score"), F.round(contrast, 8).alias("contrast"), F.round(low_jump, 8).alias("low_jump"))
    return out.withColumn("place", F.row_number().over(Window.partitionBy("series").orderBy(F.desc("score"), "bar", "until")))


def top_landings(scores: DataFrame, onsets: DataFrame, top: int = 3) -> DataFrame:
    """The ``top`` landings of each series by their best body, and, where none of them is an arrival (or has an onset on time),
    the best that is. ``onsets``: (series, bar) on time."""
    best = scores.groupBy("series", "bar").agg(F.max("score").alias("score"), F.max("contrast").alias("contrast"), F.max("low_jump").alias("low_jump"))
    ok = onsets.select("series", "bar", F.lit(True).alias("ok")).distinct()
    rows = best.join(ok, ["series", "bar"], "left").select("series", "bar", "score", ((F.col("contrast") >= ARRIVAL_CONTRAST) | (F.col("low_jump") >= DROP_LOW)).alias("arrival"), F.coalesce("ok", F.lit(False)).alias("onset"))
    order = [F.desc("score"), F.col("bar")]
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("series").orderBy(*order))).withColumn("kept", F.col("place") <= top)
    whole = Window.partitionBy("series")
    first = lambda c: (F.min(F.when(F.col(c), F.col("place"))).over(whole) == F.col("place")) & ~F.bool_or(F.col(c) & F.col("kept")).over(whole)
    rows = rows.withColumn("by_arrival", F.coalesce(first("arrival"), F.lit(False)))
    rows = rows.withColumn("kept2", F.col("kept") | F.col("by_arrival"))
    by_onset = (F.min(F.when(F.col("onset"), F.col("place"))).over(whole) == F.col("place")) & ~F.bool_or(F.col("onset") & F.col("kept2")).over(whole)
    return rows.withColumn("by_onset", F.coalesce(by_onset, F.lit(False))).where("kept2 or by_onset").select("series", "bar", "score", "arrival", "onset", "place")


def repetition(vectors: DataFrame, length: int = 4) -> DataFrame:
    """(series, bar, repetition): the best mean cosine of the ``length`` vectors from a bar and those of a stretch that doesn't overlap.

    ``vectors``: (series, bar, v). Products of a series' bars at each distance are averaged along the distance by a window.
    """
    rows = vectors.select("series", "bar", unit(F.col("v")).alias("u"))
    other = rows.select("series", F.col("bar").alias("far"), F.col("u").alias("w"))
    products = rows.join(other, "series").where(F.col("far") - F.col("bar") >= length).select("series", "bar", (F.col("far") - F.col("bar")).alias("apart"), dot(F.col("u"), F.col("w")).alias("x"))
    w = Window.partitionBy("series", "apart").orderBy("bar").rowsBetween(0, length - 1)
    means = products.select("series", "bar", "apart", F.avg("x").over(w).alias("m"), F.count("*").over(w).alias("n")).where(F.col("n") == length)
    both = means.select("series", F.explode(F.array("bar", F.col("bar") + F.col("apart"))).alias("bar"), "m")
    return both.groupBy("series", "bar").agg(F.round(F.max("m"), 5).alias("repetition"))


def novelty_sections(vectors: DataFrame, kernel: int = 8, apart: int = 4) -> DataFrame:
    """(series, bar, until) of the sections between peaks of novelty. ``vectors``: (series, bar, v).

    Features are standardised over the series, vectors made unit; novelty is a checkerboard of similarities around a bar,
    bars beyond an edge standing for the edge. Peaks reach the mean and half a deviation, are the most of five bars, and lie
    ``apart`` bars from the last section's start at least.
    """
    half = kernel // 2
    long = vectors.select("series", "bar", F.posexplode("v").alias("k", "x")).withColumn("x", F.col("x").cast("double"))
    w = Window.partitionBy("series", "k")
    z = long.withColumn("z", (F.col("x") - F.avg("x").over(w)) / (F.stddev_pop("x").over(w) + 1e-9))
    norm = F.sqrt(F.sum(F.col("z") * F.col("z")).over(Window.partitionBy("series", "bar"))) + 1e-9
    units = z.withColumn("u", F.col("z") / norm).groupBy("series", "bar").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "u"))), lambda e: e["u"]).alias("u"))
    other = units.select("series", F.col("bar").alias("far"), F.col("u").alias("w"))
    near = units.select("series", "bar", "u", F.explode(F.sequence(F.col("bar") - kernel, F.col("bar") + kernel)).alias("far")).join(other, ["series", "far"]).select("series", "bar", "far", dot(F.col("u"), F.col("w")).alias("s"))
    # each bar with its band of similarities; the bars around it come as one short list
    bands = near.groupBy("series", "bar").agg(F.map_from_entries(F.collect_list(F.struct("far", "s"))).alias("band"))
    around = bands.select("series", "bar", (F.max("bar").over(Window.partitionBy("series")) + 1).alias("nb"), F.collect_list("band").over(_series().rowsBetween(-half, half - 1)).alias("bands"))
    cells = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit((1.0 if (a + 0.5) * (b + 0.5) > 0 else -1.0) * _taper(a + b + 1.0, half)).alias("g")) for a in range(-half, half) for b in range(-half, half)))
    within = lambda c: F.greatest(F.lit(0), F.least(F.col("nb") - 1, F.col("bar") + c))
    first = F.greatest(F.lit(0), F.col("bar") - half)
    total = F.aggregate(cells, F.lit(0.0), lambda s, c: s + c["g"] * F.element_at(F.element_at("bands", (within(c["a"]) - first + 1).cast("int")), within(c["b"])))
    nov = around.select("series", "bar", F.round(total, 9).alias("novelty"))
    own = Window.partitionBy("series")
    peak = (F.col("bar") >= 1) & (F.col("novelty") >= F.avg("novelty").over(own) + 0.5 * F.stddev_pop("novelty").over(own)) & (F.col("novelty") == F.max("novelty").over(_series().rowsBetween(-2, 2)))
    marked = nov.withColumn("peak", peak)
    of = marked.groupBy("series").agg((F.max("bar") + 1).alias("nb"), F.array_sort(F.collect_list(F.when(F.col("peak"), F.col("bar")))).alias("peaks"))
    chosen = F.aggregate("peaks", F.array(F.lit(0)).cast("array<bigint>"), lambda a, p: F.when(p - F.element_at(a, -1) >= apart, F.concat(a, F.array(p.cast("bigint")))).otherwise(a))
    bounds = of.select("series", "nb", F.explode(chosen).alias("bar"))
    return bounds.select("series", "bar", F.coalesce(F.lead("bar").over(_series()), F.col("nb")).cast("long").alias("until"))


def _taper(u: float, half: int) -> float:
    import math

    return math.exp(-0.5 * (u / (0.5 * half)) ** 2 / 2)


def excerpt_select(tracks: DataFrame, segments: DataFrame, levels: DataFrame, grid: DataFrame, seconds: float = 60.0) -> DataFrame:
    """(series, start, end, reason): the excerpt of each track (series, duration).

    The best labelled segment (series, start, label, strength) by its label's priority, its level, its strength and how early it
    is; without one, a quarter into the track. Start and end snap to the nearest ``grid`` point (series, t) within 3 s. Levels:
    (series, second, db). A track no longer than the excerpt is taken whole.
    """
    priority = F.create_map(*(F.lit(x) for p in {"chorus": 5, "solo": 4, "inst": 3, "section": 3, "verse": 2, "bridge": 1}.items() for x in p))
    fits = segments.join(tracks, "series").where(priority[F.col("label")].isNotNull() & (F.col("start") <= F.col("duration") - seconds))
    db = levels.select(F.col("series").alias("_s"), "second", "db")
    heard = fits.join(db, (F.col("series") == F.col("_s")) & (F.col("second") >= F.floor("start")) & (F.col("second") < F.floor(F.least(F.col("duration"), F.col("start") + seconds))), "left")
    mean = heard.groupBy("series", "start", "label", "strength", "duration").agg(F.coalesce(F.avg("db"), F.lit(-25.0)).alias("level"))
    score = priority[F.col("label")] + 0.03 * F.col("level") - F.col("start") / F.col("duration") * 0.15 + 0.1 * F.coalesce("strength", F.lit(0.0))
    best = mean.groupBy("series").agg(F.max(F.struct(F.round(score, 9).alias("score"), "start", "label")).alias("b"))
    long = tracks.where(F.col("duration") > seconds).join(best, "series", "left")
    long = long.select("series", "duration", F.coalesce("b.start", F.least(F.col("duration") - seconds, F.col("duration") * 0.25)).alias("start"), F.coalesce(F.concat(F.col("b.label"), F.lit(" section")), F.lit("central passage")).alias("reason"))

    def snapped(rows: DataFrame, at: str, lo: Column, hi: Column) -> DataFrame:
        points = grid.select(F.col("series").alias("_s"), "t")
        met = rows.join(points, (F.col("series") == F.col("_s")) & F.col("t").between(F.col(at) - 3, F.col(at) + 3) & F.col("t").between(lo, hi), "left")
        kept = [c for c in rows.columns if c != at]
        near = F.min_by("t", F.struct(F.round(F.abs(F.col("t") - F.col(at)), 9), "t"))
        return met.groupBy(*rows.columns).agg(near.alias("near")).select(*kept, F.coalesce("near", at).alias(at))

    long = snapped(long, "start", F.lit(0.0), F.col("duration") - seconds)
    long = snapped(long.withColumn("end", F.col("start") + seconds), "end", F.lit(0.0), F.col("duration"))
    short = tracks.where(F.col("duration") <= seconds).select("series", F.lit(0.0).alias("start"), F.col("duration").alias("end"), F.lit("complete source").alias("reason"))
    return long.select("series", "start", "end", "reason").union(short).select("series", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "reason")


def vocal_runs(frames: DataFrame, points: DataFrame, threshold: float, pause: int, before: int, frame_s: float) -> DataFrame:
    """(series, frame, run_s) for each point (series, frame): how long the sound runs on to its first pause of ``pause`` frames
    under the threshold; 0 where nothing sounds in the ``before`` frames ahead of it, or it lies at an end of the series.

    ``frames``: (series, frame from 0, db).
    """
    w = _series("frame")
    on = frames.select("series", "frame", (F.col("db") >= threshold).cast("int").alias("on"))
    ahead = w.rowsBetween(0, pause - 1)
    rows = on.select("series", "frame", F.coalesce(F.max("on").over(w.rowsBetween(-before, -1)), F.lit(0)).alias("sounds"), ((F.max("on").over(ahead) == 0) & (F.count("*").over(ahead) == pause)).alias("pause"), (F.max("frame").over(Window.partitionBy("series")) + 1).alias("n"))
    # from the end backwards: a frame that ends at the last row is worked out anew for each row
    onwards = Window.partitionBy("series").orderBy(F.desc("frame")).rowsBetween(Window.unboundedPreceding, 0)
    stop = F.coalesce(F.min(F.when(F.col("pause"), F.col("frame"))).over(onwards), F.col("n"))
    rows = rows.withColumn("stop", stop)
    out = points.join(rows, ["series", "frame"])
    run = F.when((F.col("frame") > 0) & (F.col("sounds") == 1), (F.col("stop") - F.col("frame")) * frame_s).otherwise(0.0)
    return out.select("series", "frame", F.round(run, 6).alias("run_s"))


def _median(values: str) -> Column:
    """The median of a short list; null of an empty one."""
    v, at = F.array_sort(values), (F.size(values) - 1) / 2
    lower, upper = (F.get(v, f(at).cast("int")) for f in (F.floor, F.ceil))
    return lower * 0.5 + upper * 0.5


def beat_repair(beats: DataFrame, merge: int = 4, context: int = 32) -> DataFrame:
    """The stretches of irregular gaps between beats (series, beat from 0, t) and what becomes of them.

    A gap is irregular if it is off the series' median by over 15 %; stretches fewer than ``merge`` good gaps apart are one.
    An interior stretch whose length is a whole number of local periods (the mean of the median good gaps on either side,
    within a quarter) is laid out evenly: (series, first, last, gaps, beats, repaired), ``beats`` the gaps it gets. Series of
    under 24 beats or with fewer good gaps than bad are left alone.
    """
    w = _series("beat")
    gaps = beats.withColumn("gap", F.lead("t").over(w) - F.col("t")).where("gap is not null")
    own = Window.partitionBy("series")
    gaps = gaps.withColumn("median", F.percentile("gap", 0.5).over(own)).withColumn("n", F.count("*").over(own))
    gaps = gaps.withColumn("good", F.abs(F.col("gap") / F.col("median") - 1) <= 0.15)
    gaps = gaps.withColumn("share", F.avg(F.col("good").cast("double")).over(own)).where("n >= 23 and share >= 0.5")
    kept = F.when(F.col("good"), F.col("gap"))
    # the frames' gaps are gathered for every beat, but sorted only where a stretch may begin or end
    near = lambda a, b: F.when(~F.col("good"), F.collect_list(kept).over(w.rowsBetween(a, b)))
    gaps = gaps.select("series", "beat", "t", "gap", "n", "good", near(-context, -1).alias("left"), near(1, context).alias("right"))
    bad = gaps.where("not good").withColumns({"left": _median("left"), "right": _median("right")}).withColumn("apart", F.col("beat") - F.lag("beat").over(w) - 1)
    runs = bad.withColumn("run", F.sum(F.when(F.coalesce(F.col("apart") < merge, F.lit(False)), 0).otherwise(1)).over(w))
    of = runs.groupBy("series", "run").agg(F.min("beat").alias("first"), (F.max("beat") + 1).alias("last"), F.min_by("t", "beat").alias("from"), F.max_by(F.col("t") + F.col("gap"), "beat").alias("to"), F.min_by("left", "beat").alias("left"), F.max_by("right", "beat").alias("right"), F.max("n").alias("n"))
    period = F.coalesce((F.col("left") + F.col("right")) / 2, "left", "right")
    whole = (F.col("to") - F.col("from")) / period
    n = F.bround(whole)
    ok = (F.col("first") > 0) & (F.col("last") < F.col("n")) & (n >= 1) & (F.abs(whole - n) < 0.25)
    return of.select("series", "first", "last", (F.col("last") - F.col("first")).alias("gaps"), n.cast("long").alias("beats"), F.coalesce(ok, F.lit(False)).alias("repaired"))


def repaired_beats(beats: DataFrame, stretches: DataFrame) -> DataFrame:
    """(series, t) after ``beat_repair``: beats inside repaired stretches give way to evenly laid ones."""
    fix = stretches.where("repaired").select("series", "first", "last", "beats")
    inside = beats.join(fix, "series").where((F.col("beat") > F.col("first")) & (F.col("beat") < F.col("last"))).select("series", "beat")
    ends = fix.join(beats.select("series", F.col("beat").alias("first"), F.col("t").alias("a")), ["series", "first"]).join(beats.select("series", F.col("beat").alias("last"), F.col("t").alias("b")), ["series", "last"])
    new = ends.where("beats > 1").select("series", "a", "b", "beats", F.explode(F.sequence(F.lit(1).cast("long"), F.col("beats") - 1)).alias("k")).select("series", (F.col("a") + (F.col("b") - F.col("a")) * F.col("k") / F.col("beats")).alias("t"))
    return beats.join(inside, ["series", "beat"], "left_anti").select("series", "t").union(new)


def _fit_pass(rows: DataFrame) -> DataFrame:
    """One weighted fit of each window and what it says of its beats: ``off`` from the line or its groove, and the new ``keep`` and ``on``.

    Beats of one groove offset are a class with a phase of its own, so the period is that of the pooled moments about the
    classes' means, and the line goes through the mean of the class without an offset.
    """
    own, all_ = Window.partitionBy("series", "window", "cls"), Window.partitionBy("series", "window")
    rows = rows.withColumn("cls", F.when(F.col("on") & F.col("has"), F.col("pos")).otherwise(0)).withColumn("wk", F.when(F.col("keep"), F.col("w")).otherwise(0.0))
    share = lambda c: F.sum(F.col("wk") * F.col(c)).over(own) / F.nullif(F.sum("wk").over(own), F.lit(0.0))
    rows = rows.withColumns({"xm": share("x"), "ym": share("t")})
    dx = F.col("x") - F.col("xm")
    rows = rows.withColumn("period", F.sum(F.col("wk") * dx * (F.col("t") - F.col("ym"))).over(all_) / F.nullif(F.sum(F.col("wk") * dx * dx).over(all_), F.lit(0.0)))
    base = lambda c: F.max(F.when(F.col("cls") == 0, F.col(c))).over(all_)
    rows = rows.withColumn("phase", base("ym") - F.col("period") * base("xm"))
    lag = F.when((F.col("cls") == F.col("pos")) & (F.col("pos") > 0), F.col("ym") - F.col("period") * F.col("xm") - F.col("phase"))
    rows = rows.withColumn("g", F.coalesce(F.max(lag).over(Window.partitionBy("series", "window", "pos")), F.lit(0.0)))
    line = F.col("t") - F.col("phase") - F.col("period") * F.col("x")
    groove = F.when(F.col("has"), line - F.col("g")).otherwise(line)
    on = F.round(F.abs(groove), 9) <= F.round(F.abs(line), 9)
    rows = rows.withColumns({"off": F.when(on, groove).otherwise(line), "was": F.col("keep"), "on": F.coalesce(on, F.lit(True))})
    return rows.withColumn("keep", F.coalesce(F.round(F.abs("off"), 9) <= GRID["outlier"], F.lit(False)))


def grid_fit(beats: DataFrame, window: int = 64, passes: int = 4) -> DataFrame:
    """Per series and window of ``window`` beats a line of time over beat number with a groove: period, phase, the offsets g1 to g3 of
    the places in the bar (null: on the line), rms, largest residual, share kept and class (locked, verify, free).

    ``beats``: (series, beat from 0, t, pos in the bar from 0, refined). Unrefined beats weigh less and don't count for the
    largest residual where there are refined ones. The start is the median period over half a window and the median phase;
    in each pass beats off by more than the outlier bound are left out, and a beat follows its place's offset or the line,
    whichever is nearer. Then offsets too small to be a groove are dropped, all of them if one is too large, and the window is
    fitted again. All sums are weighted moments over windows.
    """
    all_ = Window.partitionBy("series", "window")
    rows = beats.select("series", F.floor(F.col("beat") / window).cast("long").alias("window"), F.col("beat").cast("double").alias("x"), "t", F.col("pos").cast("int").alias("pos"), "refined", F.when(F.col("refined"), 1.0).otherwise(GRID["rough"]).alias("w"))
    inside = all_.orderBy("x")
    # half a window ahead is a fixed step in full windows; only the short ones, at a series' end, need the list of what follows
    rows = rows.withColumn("n", F.count("*").over(all_))
    short = F.collect_list(F.when(F.col("n") != window, F.struct("x", "t"))).over(inside.rowsBetween(0, window // 2))
    rows = rows.withColumns({"at": F.row_number().over(inside), "x1": F.lead("x", window // 2).over(inside), "t1": F.lead("t", window // 2).over(inside), "ahead": short})
    half = F.greatest(F.floor(F.col("n") / 2), F.lit(1)).cast("int")
    far = F.when(F.col("n") == window, F.struct(F.col("x1").alias("x"), F.col("t1").alias("t"))).when(F.col("at") + half <= F.col("n"), F.element_at("ahead", half + 1))
    rows = rows.withColumn("span", (far["t"] - F.col("t")) / (far["x"] - F.col("x"))).drop("ahead", "at", "x1", "t1")
    rows = rows.withColumn("period0", F.percentile("span", 0.5).over(all_)).drop("span")
    start = F.col("t") - F.col("x") * F.col("period0")
    near = F.round(F.abs(start - F.percentile(start, 0.5).over(all_)), 9) <= GRID["outlier"]
    rows = rows.withColumn("near", F.coalesce(near, F.lit(True)))
    rows = rows.withColumn("first", F.when(F.count_if("near").over(all_) >= GRID["least"], F.col("near")).otherwise(True))
    rows = rows.withColumn("has", (F.col("pos") > 0) & (F.count("*").over(Window.partitionBy("series", "window", "pos")) >= 4))
    for stage in (0, 1):
        rows = rows.withColumns({"keep": F.col("first"), "on": F.lit(True)})
        for _ in range(passes):
            rows = _fit_pass(rows)
        rows = materialize(rows, "fits")
        if not stage:
            size = F.round(F.abs("g"), 9)
            most = F.max(F.when(F.col("has"), size)).over(all_)
            rows = rows.withColumn("has", F.col("has") & (size >= GRID["groove_min"]) & (most <= GRID["groove_max"]))
    kept = lambda c: F.when(F.col("was"), c)
    sure = F.max(F.when(F.col("was") & F.col("refined"), F.abs("off")))
    place = lambda p: F.round(F.max(F.when(F.col("has") & (F.col("pos") == p), F.col("g"))), 6).alias(f"g{p}")
    of = rows.groupBy("series", "window").agg(
        F.max("period").alias("period"), F.max("phase").alias("phase"), place(1), place(2), place(3), F.sqrt(F.sum(kept(F.col("w") * F.col("off") * F.col("off"))) / F.nullif(F.sum(kept(F.col("w"))), F.lit(0.0))).alias("rms"),
        F.coalesce(sure, F.max(kept(F.abs("off")))).alias("most"), F.avg(F.col("was").cast("double")).alias("keep"), F.count_if("was").alias("n"),
    )
    usable = (F.col("n") >= GRID["least"]) & (F.col("period") > 0)
    locked = (F.col("rms") <= GRID["locked_rms"]) & (F.col("most") <= GRID["locked_max"]) & (F.col("keep") >= GRID["locked_keep"])
    verify = (F.col("rms") <= GRID["verify_rms"]) & (F.col("keep") >= GRID["verify_keep"])
    kind = F.when(~F.coalesce(usable, F.lit(False)), "free").when(locked, "locked").when(verify, "verify").otherwise("free")
    return of.select("series", "window", F.round("period", 6).alias("period"), F.round("phase", 5).alias("phase"), "g1", "g2", "g3", F.round("rms", 6).alias("rms"), F.round("most", 6).alias("most"), F.round("keep", 6).alias("keep"), kind.alias("class"))


def arrivals(bars: DataFrame) -> DataFrame:
    """(series, bar, heard_at, rise): bars at which a track arrives. ``bars``: (series, bar from 0, rel, low) in dB.

    A bar is heard as one where it and the next are ARRIVAL["rise"] dB over the mean of the four before, or ARRIVAL["low"] in
    the low band. The arrival is the bar itself, unless a neighbour that is loud enough has a clearly larger step of energy,
    or only a neighbour is loud enough (the earlier of two equal ones). In order of the bars, an arrival within one bar of
    an earlier one is left out: a fold over a track's few arrivals, which carries those that were kept.
    """
    w, a = _series(), ARRIVAL
    rise = lambda c: F.avg(c).over(w.rowsBetween(0, 1)) - F.avg(c).over(w.rowsBetween(-4, -1))
    step = (F.col("rel") - F.lag("rel").over(w)) + a["low_share"] * (F.col("low") - F.lag("low").over(w))
    rows = bars.withColumns({"nb": F.max("bar").over(Window.partitionBy("series")) + 1, "rise": rise("rel"), "low_rise": rise("low"), "step": F.when(F.col("rel") >= a["loud"], step)})
    rows = rows.withColumns({"before": F.lag("step").over(w), "after": F.lead("step").over(w)})
    heard = rows.where((F.col("bar") >= 4) & (F.col("bar") < F.col("nb") - 2) & ((F.round("rise", 9) >= a["rise"]) | (F.round("low_rise", 9) >= a["low"])))
    later = F.coalesce(F.round("after", 9) > F.round("before", 9), F.col("before").isNull())
    best = F.when(later, F.col("after")).otherwise(F.col("before"))
    moved = best.isNotNull() & (F.col("step").isNull() | (F.round(best - F.col("step"), 9) > a["move"]))
    at = F.when(~moved, F.col("bar")).when(later, F.col("bar") + 1).otherwise(F.col("bar") - 1).cast("long")
    lists = heard.groupBy("series").agg(F.array_sort(F.collect_list(F.struct(F.col("bar").cast("long").alias("heard_at"), at.alias("bar"), F.greatest(F.lit(0.0), F.col("rise")).alias("rise")))).alias("heard"))
    kept = F.aggregate("heard", F.slice("heard", 1, 0), lambda kept, h: F.when(F.exists(kept, lambda q: F.abs(q["bar"] - h["bar"]) <= 1), kept).otherwise(F.concat(kept, F.array(h))))
    return lists.select("series", F.explode(kept).alias("h")).select("series", "h.bar", "h.heard_at", F.round("h.rise", 6).alias("rise"))


def overlap_clash(frames: DataFrame, pairs: DataFrame, frame_s: float = 0.25, least_s: float = 2.0) -> DataFrame:
    """(a, b, overlap_s, clash) of pairs of series: frames where both sound within 20 dB of their own 95th percentile (and over
    -80); from ``least_s`` of those on, half of one less the correlation of their mean profiles. ``frames``: (series, frame, db, chroma)."""
    level = frames.groupBy("series").agg(F.percentile("db", 0.95).alias("p95"))
    sounding = frames.join(level, "series").where(F.col("db") > F.greatest(F.lit(-80.0), F.col("p95") - 20)).select("series", "frame", "chroma")
    side = lambda name: sounding.select(F.col("series").alias(name), "frame", F.col("chroma").alias(f"c_{name}"))
    both = pairs.join(side("a"), "a").join(side("b"), ["b", "frame"])
    overlap = both.groupBy("a", "b").agg((F.count("*") * frame_s).alias("overlap_s"))
    bins = both.select("a", "b", F.posexplode(F.arrays_zip("c_a", "c_b")).alias("bin", "c")).groupBy("a", "b", "bin").agg(F.avg("c.c_a").alias("x"), F.avg("c.c_b").alias("y"))
    spread = F.sqrt(F.var_pop("x") * F.var_pop("y"))  # corr() raises on a flat profile, which has none
    r = bins.groupBy("a", "b").agg(F.try_divide(F.covar_pop("x", "y"), spread).alias("r"))
    out = pairs.join(overlap, ["a", "b"], "left").join(r, ["a", "b"], "left")
    seconds = F.coalesce("overlap_s", F.lit(0.0))
    return out.select("a", "b", F.round(seconds, 2).alias("overlap_s"), F.when(seconds >= least_s, F.round((1 - F.col("r")) / 2, 3)).alias("clash"))


def blend_quality(levels: DataFrame, regions: DataFrame) -> DataFrame:
    """(series, score, dip, holes, jump) of the blend between frames ``lo`` and ``hi`` of a series, against what lies around it.

    ``levels``: (series, frame, db, low_db); ``regions``: (series, lo, hi, clash). Dip: the outside's median less the inside's
    10th percentile; holes: the share of the inside with its low band 9 dB under the outside's median; jump: the largest
    change over two frames in or next to the region. No score without an inside and an outside.
    """
    w = _series("frame")
    rows = levels.withColumn("step", F.abs(F.lead("db").over(w) - F.lag("db").over(w))).join(regions, "series").withColumn("inside", F.col("frame").between(F.col("lo"), F.col("hi")))
    ref = rows.where("not inside").groupBy("series").agg(_quantile(F.col("db"), 0.5).alias("ref"), _quantile(F.col("low_db"), 0.5).alias("ref_low"))
    met = rows.join(ref, "series")
    of = met.groupBy("series").agg(
        (F.max("ref") - _quantile(F.when(F.col("inside"), F.col("db")), 0.1)).alias("dip"),
        F.avg(F.when(F.col("inside"), (F.col("low_db") < F.col("ref_low") - BLEND["hole_db"]).cast("double"))).alias("holes"),
        F.coalesce(F.max(F.when(F.col("frame").between(F.col("lo") - 1, F.col("hi") + 1), F.col("step"))), F.lit(0.0)).alias("jump"),
        F.coalesce(F.max("clash"), F.lit(0.0)).alias("clash"),
    )
    over = lambda c, free: F.greatest(F.lit(0.0), F.col(c) - free)
    score = 100 - BLEND["dip_per"] * over("dip", BLEND["dip_free"]) - BLEND["hole_w"] * F.col("holes") - BLEND["jump_per"] * over("jump", BLEND["jump_free"]) - BLEND["clash_w"] * over("clash", BLEND["clash_free"])
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))
    return of.where("dip is not null").select("series", _to_places(score, 1).alias("score"), _to_places(F.col("dip"), 2).alias("dip"), _to_places(F.col("holes"), 3).alias("holes"), _to_places(F.col("jump"), 2).alias("jump"))
