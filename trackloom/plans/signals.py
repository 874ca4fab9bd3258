"""Queries of the series operators over the driver tables, and their SQL. A supplier's lines in their order are one track's bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import SparkSession as S

from trackloom.operators import signals
from trackloom.plans.ingest import one_of
from trackloom.sources import views
from trackloom.sources.views import with_views

LABELS = ["chorus", "verse", "inst", "bridge", "solo", "outro", "break", "intro"]
ORDER = ", ".join(views.LINE)


def _lines(s: S, d: str) -> DataFrame:
    w = Window.partitionBy("l_suppkey").orderBy(*views.LINE)
    return views.table(s, d, "lineitem").select(F.col("l_suppkey").alias("series"), (F.row_number().over(w) - 1).alias("bar"), "l_partkey", "l_quantity", "l_discount", "l_tax")


def _bars(s: S, d: str) -> DataFrame:
    """Sections of twelve and eight bars in turn; every fifth is quiet, every seventh has no bass."""
    section = F.floor(F.floor(F.col("bar") / 4) * 2 / 5)
    rel = -60 * F.col("l_discount") - 0.0137 * (F.col("bar") % 7) - F.when(section % 5 == 0, 4.0).otherwise(0.0)
    low = -150 * F.col("l_tax") - 0.0119 * (F.col("bar") % 11) - F.when(section % 7 == 0, 12.0).otherwise(0.0)
    return _lines(s, d).select("series", "bar", rel.cast("double").alias("rel_db"), low.cast("double").alias("low_db"), one_of(section % 8, *LABELS).alias("label"))


LINES = f"lines AS (SELECT l_suppkey AS series, row_number() OVER (PARTITION BY l_suppkey ORDER BY {ORDER}) - 1 AS bar, l_partkey, l_quantity, l_discount, l_tax FROM lineitem)"
BARS = f"""{LINES}, bars AS (SELECT series, bar, -60 * l_discount - 0.0137 * (bar % 7) - CASE WHEN (bar // 4) * 2 // 5 % 5 = 0 THEN 4.0 ELSE 0.0 END AS rel, -150 * l_tax - 0.0119 * (bar % 11) - CASE WHEN (bar // 4) * 2 // 5 % 7 = 0 THEN 12.0 ELSE 0.0 END AS low, {LABELS!r}[(bar // 4) * 2 // 5 % 8 + 1] AS label FROM lines),
 ends AS (SELECT series, max(bar) + 1 AS nb, coalesce(max(bar) FILTER (rel >= -6), -1) AS last_loud FROM bars GROUP BY 1),
 marked AS (SELECT series, bar, label, lag(label) OVER (PARTITION BY series ORDER BY bar) AS before FROM bars),
 starts AS (SELECT m.series, m.bar, m.label, coalesce(lead(m.bar) OVER (PARTITION BY m.series ORDER BY m.bar), e.nb) AS until FROM marked m JOIN ends e ON e.series = m.series WHERE before IS NULL OR before <> m.label)"""
#: The terms of an exit at x of a body from j, for rows ``asked`` (series, j, x).
TERMS = """body AS (SELECT q.series, q.j, q.x, avg(b.rel) AS level, avg(b.low) AS low, avg(CASE WHEN b.rel < -5 THEN 1.0 ELSE 0.0 END) AS lull, count(*) FILTER (b.label IN ('verse', 'outro', 'break')) AS verse_bars FROM asked q JOIN bars b ON b.series = q.series AND b.bar >= q.j AND b.bar < q.x GROUP BY 1, 2, 3),
 after AS (SELECT q.series, q.j, q.x, avg(b.rel) AS rel, min(b.rel) AS lo, max(b.rel) AS hi, count(*) AS n FROM asked q JOIN bars b ON b.series = q.series AND b.bar >= q.x AND b.bar < q.x + 4 GROUP BY 1, 2, 3),
 terms AS (SELECT y.*, coalesce(round(a.rel, 9) <= round(y.level - 4, 9), false) AS "natural", coalesce(round(l.rel, 9) <= round(y.level - 3, 9), false) AS dip, coalesce(a.n = 4 AND round(a.lo, 9) >= round(y.level - 3, 9) AND round(a.hi, 9) <= round(y.level + 3, 9), false) AS tail, y.x >= e.last_loud - 1 AS fade, l.label AS end_label
 FROM body y JOIN ends e ON e.series = y.series LEFT JOIN after a ON a.series = y.series AND a.j = y.j AND a.x = y.x LEFT JOIN bars l ON l.series = y.series AND l.bar = y.x - 1)"""
SECTION_SQL = f"""WITH {BARS}, asked AS (SELECT series, bar AS j, until AS x FROM starts), {TERMS}
 SELECT s.series, s.bar, s.label, s.until, round(t.level, 8) AS level, round(t.level, 9) <= -4 OR round(t.low, 9) <= -15 AS vetoed, t."natural", t.dip, t.tail, round(t.lull, 6) AS lull, t.fade FROM starts s JOIN terms t ON t.series = s.series AND t.j = s.bar"""
H = signals.H
SCORES = f"""{BARS}, sec AS (SELECT s.series, s.bar, s.label, round(avg(b.rel), 9) <= -4 OR round(avg(b.low), 9) <= -15 AS vetoed FROM starts s JOIN bars b ON b.series = s.series AND b.bar >= s.bar AND b.bar < s.until GROUP BY 1, 2, 3),
 asked AS (SELECT c.series, c.bar AS j, c.bar + n AS x, c.label, n, st.bar IS NOT NULL AS bound FROM sec c JOIN ends e ON e.series = c.series CROSS JOIN (VALUES (16), (24), (32)) v(n) LEFT JOIN starts st ON st.series = c.series AND st.bar = c.bar + n WHERE NOT c.vetoed AND c.bar + n <= e.nb AND c.bar + n < e.last_loud AND (st.bar IS NOT NULL OR (c.bar + n) % 8 = 0)),
 {TERMS},
 step AS (SELECT q.series, q.j, coalesce(avg(b.rel) FILTER (b.bar >= q.j) - avg(b.rel) FILTER (b.bar < q.j), 0.0) AS contrast, coalesce(avg(b.low) FILTER (b.bar >= q.j) - avg(b.low) FILTER (b.bar < q.j), 0.0) AS low_jump FROM (SELECT DISTINCT series, j FROM asked) q JOIN bars b ON b.series = q.series AND b.bar >= q.j - 4 AND b.bar < q.j + 2 GROUP BY 1, 2),
 prior AS (SELECT q.series, q.j, q.x, q.n, q.bound, CASE q.label {' '.join(f"WHEN '{k}' THEN {v}" for k, v in signals.PRIOR.items())} ELSE 0.3 END AS p, q.label IN ('chorus', 'inst', 'solo') AND round(s.contrast, 9) >= 3 AND round(s.low_jump, 9) >= 6 AS is_drop, s.contrast, s.low_jump FROM asked q JOIN step s ON s.series = q.series AND s.j = q.j),
 scores AS (SELECT p.series, p.j AS bar, p.x AS until, round(CASE WHEN p.is_drop THEN greatest(p.p, 0.95) ELSE p.p END + {H['level']} * t.level + {H['contrast']} * least(p.contrast, 10.0) + CASE WHEN t."natural" OR t.tail THEN {H['exit']} ELSE 0 END + CASE WHEN p.j % 8 = 0 THEN {H['on_grid']} ELSE 0 END + {H['lull']} * t.lull
 + CASE WHEN t.fade THEN {H['ends_in_fade']} ELSE 0 END + CASE WHEN p.j * 2.0 < 20 THEN {H['early']} ELSE 0 END + {H['dur']} * abs(p.n * 2.0 - 50) + {H['verse_bar']} * t.verse_bars + CASE WHEN p.bound AND t.end_label IN ('chorus', 'inst', 'solo') THEN {H['section_end']} ELSE 0 END, 4) AS score, round(p.contrast, 8) AS contrast, round(p.low_jump, 8) AS low_jump
 FROM prior p JOIN terms t ON t.series = p.series AND t.j = p.j AND t.x = p.x)"""
SCORE_SQL = f"WITH {SCORES} SELECT *, row_number() OVER (PARTITION BY series ORDER BY score DESC, bar, until) AS place FROM scores"
LANDING_SQL = f"""WITH {SCORES}, best AS (SELECT series, bar, max(score) AS score, max(contrast) >= 2 OR max(low_jump) >= 6 AS arrival, bar % 9 = 5 AS onset FROM scores GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY score DESC, bar) AS place FROM best),
 a AS (SELECT *, place <= 3 OR arrival AND place = min(place) FILTER (arrival) OVER w AND NOT bool_or(arrival AND place <= 3) OVER w AS kept FROM r WINDOW w AS (PARTITION BY series)),
 o AS (SELECT *, kept OR onset AND place = min(place) FILTER (onset) OVER w AND NOT bool_or(onset AND kept) OVER w AS kept2 FROM a WINDOW w AS (PARTITION BY series)) SELECT series, bar, score, arrival, onset, place FROM o WHERE kept2"""

# ---- sequences of vectors: thirty-two of a label in their order are one track


def _vectors(s: S, d: str) -> DataFrame:
    w = Window.partitionBy("label").orderBy("vec_id")
    rows = views.table(s, d, "embeddings").withColumn("at", F.row_number().over(w) - 1)
    return rows.select(F.concat_ws("-", F.col("label").cast("string"), F.floor(F.col("at") / 32).cast("string")).alias("series"), (F.col("at") % 32).alias("bar"), F.col("embedding").alias("v"))


VECTORS = "placed AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos FROM embeddings), vec AS (SELECT concat(label, '-', pos // 32) AS series, pos % 32 AS bar, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM placed)"
REPEAT_SQL = f"""WITH {VECTORS}, p AS (SELECT a.series, a.bar, b.bar - a.bar AS apart, list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) AS x FROM vec a JOIN vec b ON a.series = b.series AND b.bar - a.bar >= 4),
 m AS (SELECT series, bar, apart, avg(x) OVER w AS m, count(*) OVER w AS n FROM p WINDOW w AS (PARTITION BY series, apart ORDER BY bar ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING))
 SELECT series, bar, round(max(m), 5) AS repetition FROM (SELECT series, bar, m FROM m WHERE n = 4 UNION ALL SELECT series, bar + apart, m FROM m WHERE n = 4) GROUP BY 1, 2"""
NOVEL_SQL = f"""WITH {VECTORS}, l AS (SELECT series, bar, k, v[k] AS x FROM vec, range(1, 65) r(k)), z AS (SELECT series, bar, k, (x - avg(x) OVER w) / (stddev_pop(x) OVER w + 1e-9) AS z FROM l WINDOW w AS (PARTITION BY series, k)),
 u AS (SELECT series, bar, list(z / n ORDER BY k) AS u FROM (SELECT *, sqrt(sum(z * z) OVER (PARTITION BY series, bar)) + 1e-9 AS n FROM z) GROUP BY 1, 2), e AS (SELECT series, max(bar) AS top FROM u GROUP BY 1),
 g AS (SELECT a, b, CASE WHEN (a + 0.5) * (b + 0.5) > 0 THEN 1.0 ELSE -1.0 END * exp(-0.5 * pow((a + b + 1.0) / 2.0, 2) / 2) AS g FROM range(-4, 4) x(a), range(-4, 4) y(b)),
 nov AS (SELECT c.series, c.bar, round(sum(g.g * list_dot_product(p.u, q.u)), 9) AS nov FROM u c JOIN e ON e.series = c.series CROSS JOIN g JOIN u p ON p.series = c.series AND p.bar = greatest(0, least(e.top, c.bar + g.a)) JOIN u q ON q.series = c.series AND q.bar = greatest(0, least(e.top, c.bar + g.b)) GROUP BY 1, 2),
 k AS (SELECT *, bar >= 1 AND nov >= avg(nov) OVER w + 0.5 * stddev_pop(nov) OVER w AND nov = max(nov) OVER (PARTITION BY series ORDER BY bar ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS peak FROM nov WINDOW w AS (PARTITION BY series)),
 c AS (SELECT series, max(bar) + 1 AS nb, list_reduce(list_prepend([CAST(0 AS BIGINT)], coalesce(list_transform(list(bar ORDER BY bar) FILTER (peak), lambda x: [CAST(x AS BIGINT)]), [])), lambda a, x: CASE WHEN x[1] - a[-1] >= 4 THEN list_concat(a, x) ELSE a END) AS b FROM k GROUP BY 1),
 s AS (SELECT series, nb, unnest(b) AS bar FROM c) SELECT series, bar, coalesce(lead(bar) OVER (PARTITION BY series ORDER BY bar), nb) AS until FROM s"""

# ---- excerpts


def _excerpts(s: S, d: str) -> DataFrame:
    bars = _bars(s, d)
    tracks = bars.groupBy("series").agg(F.max("bar").alias("n")).select("series", F.when(F.col("series") % 7 == 0, 45.0).otherwise((F.col("n") + 1) * 2.0).alias("duration"))
    segments = signals.starts_of(bars).where("series % 5 <> 0").select("series", (F.col("bar") * 2.0).alias("start"), "label", (F.col("bar") % 5 / 10.0).alias("strength"))
    levels = bars.select("series", (F.col("bar") * 2).alias("second"), F.col("rel_db").alias("db"))
    grid = bars.where("bar % 3 = 0 and floor(bar / 30) % 2 = 0").select("series", (F.col("bar") * 2 + 0.3 * (F.col("bar") % 4)).cast("double").alias("t"))
    return signals.excerpt_select(tracks, segments, levels, grid)


EXCERPT_SQL = f"""WITH {BARS}, tracks AS (SELECT series, CASE WHEN series % 7 = 0 THEN 45.0 ELSE nb * 2.0 END AS duration FROM ends), grid AS (SELECT series, bar * 2 + 0.3 * (bar % 4) AS t FROM bars WHERE bar % 3 = 0 AND bar // 30 % 2 = 0),
 seg AS (SELECT s.series, s.bar * 2.0 AS start, s.label, t.duration, CASE s.label WHEN 'chorus' THEN 5 WHEN 'solo' THEN 4 WHEN 'inst' THEN 3 WHEN 'verse' THEN 2 WHEN 'bridge' THEN 1 END AS p, s.bar % 5 / 10.0 AS strength FROM starts s JOIN tracks t ON t.series = s.series WHERE s.series % 5 <> 0 AND s.bar * 2.0 <= t.duration - 60),
 sc AS (SELECT g.series, g.start, g.label, round(g.p + 0.03 * avg(b.rel) - g.start / g.duration * 0.15 + 0.1 * g.strength, 9) AS score FROM seg g JOIN bars b ON b.series = g.series AND b.bar * 2 >= floor(g.start) AND b.bar * 2 < floor(least(g.duration, g.start + 60)) WHERE g.p IS NOT NULL GROUP BY g.series, g.start, g.label, g.p, g.duration, g.strength),
 pick AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY score DESC, start DESC, label DESC) AS r FROM sc) WHERE r = 1),
 a AS (SELECT t.series, t.duration, coalesce(p.start, least(t.duration - 60, t.duration * 0.25)) AS start, coalesce(p.label || ' section', 'central passage') AS reason FROM tracks t LEFT JOIN pick p ON p.series = t.series WHERE t.duration > 60),
 b AS (SELECT a.series, a.duration, a.reason, coalesce((SELECT g.t FROM grid g WHERE g.series = a.series AND abs(g.t - a.start) <= 3 AND g.t BETWEEN 0 AND a.duration - 60 ORDER BY round(abs(g.t - a.start), 9), g.t LIMIT 1), a.start) AS start FROM a),
 c AS (SELECT b.*, coalesce((SELECT g.t FROM grid g WHERE g.series = b.series AND abs(g.t - b.start - 60) <= 3 AND g.t BETWEEN 0 AND b.duration ORDER BY round(abs(g.t - b.start - 60), 9), g.t LIMIT 1), b.start + 60) AS "end" FROM b)
 SELECT series, CAST(round(start, 6) AS DOUBLE) AS start, CAST(round("end", 6) AS DOUBLE) AS "end", reason FROM c UNION ALL SELECT series, 0.0, duration, 'complete source' FROM tracks WHERE duration <= 60"""

# ---- frames


def _runs(s: S, d: str) -> DataFrame:
    rows = _lines(s, d)
    return signals.vocal_runs(rows.select("series", F.col("bar").alias("frame"), (-2 * F.col("l_quantity")).alias("db")), rows.where("bar % 8 = 0").select("series", F.col("bar").alias("frame")), -60.0, 3, 2, 0.01)


RUN_SQL = f"""WITH {LINES}, f AS (SELECT series, bar, CASE WHEN -2 * l_quantity >= -60 THEN 1 ELSE 0 END AS "on" FROM lines), r AS (SELECT series, bar, coalesce(max("on") OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), 0) AS sounds, max("on") OVER (w ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) = 0 AND count(*) OVER (w ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) = 3 AS pause, max(bar) OVER (PARTITION BY series) + 1 AS n FROM f WINDOW w AS (PARTITION BY series ORDER BY bar)),
 t AS (SELECT *, coalesce(min(bar) FILTER (pause) OVER (PARTITION BY series ORDER BY bar ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), n) AS stop FROM r) SELECT series, bar AS frame, CAST(round(CASE WHEN bar > 0 AND sounds = 1 THEN (stop - bar) * 0.01 ELSE 0.0 END, 6) AS DOUBLE) AS run_s FROM t WHERE bar % 8 = 0"""


def _clashes(s: S, d: str) -> DataFrame:
    rows = _lines(s, d).where("series % 4 <> 0 or bar % 8 = 0")
    frames = rows.select("series", F.col("bar").alias("frame"), (-2.0 * F.col("l_quantity")).alias("db"), F.transform(F.sequence(F.lit(1), F.lit(12)), lambda k: (F.col("l_partkey") * k % 17).cast("double")).alias("chroma"))
    pairs = rows.select("series").distinct().select(F.col("series").alias("a"), (F.col("series") + 1).alias("b"))
    return signals.overlap_clash(frames, pairs)


CLASH_SQL = f"""WITH {LINES}, f AS (SELECT series, bar, -2.0 * l_quantity AS db, l_partkey FROM lines WHERE series % 4 <> 0 OR bar % 8 = 0), p AS (SELECT series, quantile_cont(db, 0.95) AS p95 FROM f GROUP BY 1), k AS (SELECT f.* FROM f JOIN p ON p.series = f.series WHERE f.db > greatest(-80.0, p.p95 - 20)),
 both_ AS (SELECT x.series AS a, y.series AS b, x.l_partkey AS pa, y.l_partkey AS pb FROM k x JOIN k y ON y.series = x.series + 1 AND y.bar = x.bar), o AS (SELECT a, count(*) * 0.25 AS s FROM both_ GROUP BY 1),
 m AS (SELECT a, i, avg(pa * i % 17) AS x, avg(pb * i % 17) AS y FROM both_, range(1, 13) r(i) GROUP BY 1, 2), c AS (SELECT a, corr(x, y) AS r FROM m GROUP BY 1)
 SELECT p.series AS a, p.series + 1 AS b, round(coalesce(o.s, 0.0), 2) AS overlap_s, CASE WHEN o.s >= 2 THEN round((1 - c.r) / 2, 3) END AS clash FROM p LEFT JOIN o ON o.a = p.series LEFT JOIN c ON c.a = p.series"""


def _blends(s: S, d: str) -> DataFrame:
    rows = _lines(s, d)
    inside = F.col("bar").between(200, 216)
    levels = rows.select("series", F.col("bar").alias("frame"), (-0.37 * F.col("l_quantity") - F.when(inside, F.col("series") % 3 * 4.0).otherwise(0.0)).alias("db"), (-100 * F.col("l_tax") - F.when(inside, F.col("series") % 4 * 4.1).otherwise(0.0)).alias("low_db"))
    regions = rows.select("series").distinct().select("series", F.lit(200).alias("lo"), F.lit(216).alias("hi"), F.when(F.col("series") % 5 != 0, F.col("series") % 5 / 5.0).alias("clash"))
    return signals.blend_quality(levels, regions)


BLEND_SQL = f"""WITH {LINES}, l AS (SELECT series, bar, bar BETWEEN 200 AND 216 AS inside, -0.37 * l_quantity - CASE WHEN bar BETWEEN 200 AND 216 THEN series % 3 * 4.0 ELSE 0.0 END AS db, -100 * l_tax - CASE WHEN bar BETWEEN 200 AND 216 THEN series % 4 * 4.1 ELSE 0.0 END AS low FROM lines),
 w AS (SELECT *, abs(lead(db) OVER (PARTITION BY series ORDER BY bar) - lag(db) OVER (PARTITION BY series ORDER BY bar)) AS step FROM l), r AS (SELECT series, quantile_cont(db, 0.5) AS ref, quantile_cont(low, 0.5) AS refl FROM l WHERE NOT inside GROUP BY 1),
 q AS (SELECT w.series, any_value(r.ref) - quantile_cont(db, 0.1) FILTER (inside) AS dip, avg(CASE WHEN low < refl - 9 THEN 1.0 ELSE 0.0 END) FILTER (inside) AS holes, max(step) FILTER (bar BETWEEN 199 AND 217) AS jump FROM w JOIN r ON r.series = w.series GROUP BY 1)
 SELECT series, round(greatest(0.0, least(100.0, 100 - 4 * greatest(0.0, dip - 3) - 60 * holes - 3 * greatest(0.0, jump - 3) - 40 * greatest(0.0, series % 5 / 5.0 - 0.3))), 1) AS score, round(dip, 2) AS dip, round(holes, 3) AS holes, round(jump, 2) AS jump FROM q WHERE dip IS NOT NULL"""

# ---- beats


def _beats(s: S, d: str) -> DataFrame:
    q = F.col("l_quantity")
    gap = F.when(q == 50, 0.8).when(q == 49, 1.003).when(q == 48, 0.3).otherwise(0.5 + (F.col("l_discount") - 0.05) * 0.4)
    before = Window.partitionBy("series").orderBy("bar").rowsBetween(Window.unboundedPreceding, -1)
    return _lines(s, d).select("series", F.col("bar").cast("long").alias("beat"), F.round(F.coalesce(F.sum(gap.cast("double")).over(before), F.lit(0.0)), 6).alias("t"))


BEATS = f"{LINES}, beats AS (SELECT series, bar AS beat, round(coalesce(sum(CASE l_quantity WHEN 50 THEN 0.8 WHEN 49 THEN 1.003 WHEN 48 THEN 0.3 ELSE 0.5 + (l_discount - 0.05) * 0.4 END) OVER (PARTITION BY series ORDER BY bar ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 6) AS t FROM lines)"
REPAIR = f"""{BEATS}, g AS (SELECT *, lead(t) OVER (PARTITION BY series ORDER BY beat) - t AS gap FROM beats), h AS (SELECT *, quantile_cont(gap, 0.5) OVER w AS median, count(*) OVER w AS n FROM g WHERE gap IS NOT NULL WINDOW w AS (PARTITION BY series)),
 k AS (SELECT *, abs(gap / median - 1) <= 0.15 AS good FROM h), s AS (SELECT *, quantile_cont(CASE WHEN good THEN gap END, 0.5) OVER (w ROWS BETWEEN 32 PRECEDING AND 1 PRECEDING) AS l, quantile_cont(CASE WHEN good THEN gap END, 0.5) OVER (w ROWS BETWEEN 1 FOLLOWING AND 32 FOLLOWING) AS r, avg(CASE WHEN good THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY series) AS share FROM k WINDOW w AS (PARTITION BY series ORDER BY beat)),
 b AS (SELECT *, beat - lag(beat) OVER (PARTITION BY series ORDER BY beat) - 1 AS apart FROM s WHERE NOT good AND share >= 0.5 AND n >= 23), u AS (SELECT *, sum(CASE WHEN apart < 4 THEN 0 ELSE 1 END) OVER (PARTITION BY series ORDER BY beat) AS run FROM b),
 o AS (SELECT series, run, min(beat) AS first, max(beat) + 1 AS last, arg_min(t, beat) AS f, arg_max(t + gap, beat) AS x, arg_min(l, beat) AS l, arg_max(r, beat) AS r, max(n) AS n FROM u GROUP BY 1, 2), p AS (SELECT *, (x - f) / coalesce((l + r) / 2, l, r) AS whole FROM o),
 stretch AS (SELECT series, first, last, last - first AS gaps, CAST(round_even(whole, 0) AS BIGINT) AS beats, coalesce(first > 0 AND last < n AND round_even(whole, 0) >= 1 AND abs(whole - round_even(whole, 0)) < 0.25, false) AS repaired FROM p)"""
REPAIR_SQL = f"""WITH {REPAIR}, fix AS (SELECT z.*, a.t AS a, c.t AS c FROM stretch z JOIN beats a ON a.series = z.series AND a.beat = z.first JOIN beats c ON c.series = z.series AND c.beat = z.last WHERE z.repaired),
 laid AS (SELECT series, a + (c - a) * k / beats AS t FROM fix, LATERAL (SELECT unnest(range(1, beats)) AS k) WHERE beats > 1 UNION ALL SELECT e.series, e.t FROM beats e WHERE NOT EXISTS (SELECT 1 FROM fix z WHERE z.series = e.series AND e.beat > z.first AND e.beat < z.last)),
 n AS (SELECT series, count(*) AS after, round(sum(t), 4) AS total FROM laid GROUP BY 1) SELECT z.series, z.first, z.last, z.gaps, z.beats, z.repaired, n.after, n.total FROM stretch z JOIN n ON n.series = z.series"""


def _repair(s: S, d: str) -> DataFrame:
    beats = _beats(s, d)
    stretches = signals.beat_repair(beats)
    after = signals.repaired_beats(beats, stretches).groupBy("series").agg(F.count("*").alias("after"), F.round(F.sum("t"), 4).alias("total"))
    return stretches.join(after, "series")


def _level_bars(s: S, d: str) -> DataFrame:
    """Bars whose levels rise and fall often enough for every way in which a track arrives."""
    quiet = F.when(F.floor(F.col("bar") / 6) % 3 == 0, 7.0).otherwise(0.0)
    low_quiet = F.when(F.floor(F.col("bar") / 9) % 2 == 0, 9.0).otherwise(0.0)
    return _lines(s, d).select("series", "bar", (F.col("l_discount") * -60 - quiet).alias("rel"), (F.col("l_tax") * -100 - low_quiet).alias("low"))


ARRIVAL_SQL = f"""WITH {LINES}, b AS (SELECT series, bar, l_discount * -60 - CASE WHEN bar // 6 % 3 = 0 THEN 7.0 ELSE 0.0 END AS rel, l_tax * -100 - CASE WHEN bar // 9 % 2 = 0 THEN 9.0 ELSE 0.0 END AS low FROM lines),
 r AS (SELECT *, count(*) OVER (PARTITION BY series) AS nb, avg(rel) OVER (w ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) - avg(rel) OVER (w ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS rise, avg(low) OVER (w ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) - avg(low) OVER (w ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS low_rise,
  CASE WHEN rel >= -3.0 THEN rel - lag(rel) OVER w + 0.1 * (low - lag(low) OVER w) END AS step FROM b WINDOW w AS (PARTITION BY series ORDER BY bar)),
 n AS (SELECT *, lag(step) OVER w AS before, lead(step) OVER w AS after FROM r WINDOW w AS (PARTITION BY series ORDER BY bar)),
 c AS (SELECT *, CASE WHEN before IS NULL OR round(after, 9) > round(before, 9) THEN {{'k': bar + 1, 'sc': after}} ELSE {{'k': bar - 1, 'sc': before}} END AS best FROM n WHERE bar >= 4 AND bar < nb - 2 AND (round(rise, 9) >= 3 OR round(low_rise, 9) >= 6)),
 h AS (SELECT series, bar AS heard_at, CASE WHEN best.sc IS NOT NULL AND (step IS NULL OR round(best.sc - step, 9) > 0.5) THEN best.k ELSE bar END AS bar, greatest(0.0, rise) AS rise FROM c),
 l AS (SELECT series, list({{'heard_at': heard_at, 'bar': bar, 'rise': rise}} ORDER BY heard_at) AS heard FROM h GROUP BY 1),
 f AS (SELECT series, unnest(list_reduce(list_transform(heard, lambda x: [x]), lambda kept, x: CASE WHEN len(list_filter(kept, lambda q: abs(q.bar - x[1].bar) <= 1)) > 0 THEN kept ELSE list_concat(kept, x) END)) AS h FROM l)
 SELECT series, h.bar AS bar, h.heard_at AS heard_at, round(h.rise, 6) AS rise FROM f"""


def _grid(s: S, d: str) -> DataFrame:
    """Beats with jitter, outliers and a groove on some places of the bar."""
    bar, series = F.col("bar"), F.col("series")
    width = one_of(series % 3, F.lit(0.06), F.lit(0.25), F.lit(0.9))
    groove = F.when(bar % 4 == 1, one_of(series % 4, F.lit(0.0), F.lit(0.012), F.lit(0.003), F.lit(0.03))).when((bar % 4 == 3) & (series % 5 == 0), -0.01).otherwise(0.0)
    t = bar * 0.5 + (F.col("l_discount") - 0.05) * width + F.when(F.col("l_quantity") >= 49, 0.2).otherwise(0.0) + groove
    return signals.grid_fit(_lines(s, d).select("series", bar.alias("beat"), t.cast("double").alias("t"), (bar % 4).alias("pos"), (F.col("l_quantity") > 10).alias("refined")))


def _pass_sql(of: str, to: str) -> str:
    """The tables of one weighted fit of each window of ``of``."""
    return f"""{to}a AS (SELECT series, win, x, t, pos, refined, w, first, has, CASE WHEN on_g AND has THEN pos ELSE 0 END AS cls, CASE WHEN keep THEN w ELSE 0.0 END AS wk, keep FROM {of}),
 {to}b AS (SELECT *, sum(wk * x) OVER c / nullif(sum(wk) OVER c, 0) AS xm, sum(wk * t) OVER c / nullif(sum(wk) OVER c, 0) AS ym FROM {to}a WINDOW c AS (PARTITION BY series, win, cls)),
 {to}c AS (SELECT *, sum(wk * (x - xm) * (t - ym)) OVER v / nullif(sum(wk * (x - xm) * (x - xm)) OVER v, 0) AS period, max(CASE WHEN cls = 0 THEN ym END) OVER v AS y0, max(CASE WHEN cls = 0 THEN xm END) OVER v AS x0 FROM {to}b WINDOW v AS (PARTITION BY series, win)),
 {to}d AS (SELECT *, y0 - period * x0 AS phase, coalesce(max(CASE WHEN cls = pos AND pos > 0 THEN ym - period * xm - (y0 - period * x0) END) OVER (PARTITION BY series, win, pos), 0.0) AS g FROM {to}c),
 {to}e AS (SELECT *, t - phase - period * x AS line, t - phase - period * x - CASE WHEN has THEN g ELSE 0.0 END AS groove FROM {to}d),
 {to} AS (SELECT series, win, x, t, pos, refined, w, first, has, period, phase, g, keep AS was, coalesce(round(abs(groove), 9) <= round(abs(line), 9), true) AS on_g, CASE WHEN round(abs(groove), 9) <= round(abs(line), 9) THEN groove ELSE line END AS off,
  coalesce(round(abs(CASE WHEN round(abs(groove), 9) <= round(abs(line), 9) THEN groove ELSE line END), 9) <= 0.04, false) AS keep FROM {to}e)"""


GRID_SQL = f"""WITH {LINES}, b AS (SELECT series, bar // 64 AS win, CAST(bar AS DOUBLE) AS x, bar * 0.5 + (l_discount - 0.05) * [0.06, 0.25, 0.9][series % 3 + 1] + CASE WHEN l_quantity >= 49 THEN 0.2 ELSE 0.0 END + CASE WHEN bar % 4 = 1 THEN [0.0, 0.012, 0.003, 0.03][series % 4 + 1] WHEN bar % 4 = 3 AND series % 5 = 0 THEN -0.01 ELSE 0.0 END AS t, CAST(bar % 4 AS INTEGER) AS pos, l_quantity > 10 AS refined, CASE WHEN l_quantity > 10 THEN 1.0 ELSE 0.25 END AS w FROM lines),
 r AS (SELECT *, count(*) OVER (PARTITION BY series, win) AS n, row_number() OVER (PARTITION BY series, win ORDER BY x) AS at FROM b), h AS (SELECT a.*, (o.t - a.t) / (o.x - a.x) AS span FROM r a LEFT JOIN r o ON o.series = a.series AND o.win = a.win AND o.at = a.at + greatest(a.n // 2, 1)),
 p AS (SELECT *, quantile_cont(span, 0.5) OVER (PARTITION BY series, win) AS p0 FROM h), q AS (SELECT *, coalesce(round(abs(t - x * p0 - quantile_cont(t - x * p0, 0.5) OVER (PARTITION BY series, win)), 9) <= 0.04, true) AS near FROM p),
 s0 AS (SELECT series, win, x, t, pos, refined, w, CASE WHEN count(*) FILTER (near) OVER (PARTITION BY series, win) >= 16 THEN near ELSE true END AS first, pos > 0 AND count(*) OVER (PARTITION BY series, win, pos) >= 4 AS has FROM q), f0 AS (SELECT *, first AS keep, true AS on_g FROM s0),
 {_pass_sql('f0', 'f1')}, {_pass_sql('f1', 'f2')}, {_pass_sql('f2', 'f3')}, {_pass_sql('f3', 'f4')},
 k0 AS (SELECT series, win, x, t, pos, refined, w, first, first AS keep, true AS on_g, has AND round(abs(g), 9) >= 0.005 AND coalesce(max(CASE WHEN has THEN round(abs(g), 9) END) OVER (PARTITION BY series, win) <= 0.025, true) AS has FROM f4),
 {_pass_sql('k0', 'k1')}, {_pass_sql('k1', 'k2')}, {_pass_sql('k2', 'k3')}, {_pass_sql('k3', 'k4')},
 o AS (SELECT series, win, max(period) AS period, max(phase) AS phase, max(CASE WHEN has AND pos = 1 THEN g END) AS g1, max(CASE WHEN has AND pos = 2 THEN g END) AS g2, max(CASE WHEN has AND pos = 3 THEN g END) AS g3, sqrt(sum(w * off * off) FILTER (was) / nullif(sum(w) FILTER (was), 0)) AS rms,
  coalesce(max(abs(off)) FILTER (was AND refined), max(abs(off)) FILTER (was)) AS most, avg(CASE WHEN was THEN 1.0 ELSE 0.0 END) AS keep, count(*) FILTER (was) AS n FROM k4 GROUP BY 1, 2)
 SELECT series, win AS "window", round(period, 6) AS period, round(phase, 5) AS phase, round(g1, 6) AS g1, round(g2, 6) AS g2, round(g3, 6) AS g3, round(rms, 6) AS rms, round(most, 6) AS most, round(keep, 6) AS keep,
 CASE WHEN n < 16 OR period <= 0 OR period IS NULL THEN 'free' WHEN rms <= 0.006 AND most <= 0.015 AND keep >= 0.9 THEN 'locked' WHEN rms <= 0.015 AND keep >= 0.8 THEN 'verify' ELSE 'free' END AS class FROM o"""

QUERIES = {
    "win_section_stats": lambda s, d: signals.section_stats(_bars(s, d)),
    "win_highlight_score": lambda s, d: signals.highlight_scores(_bars(s, d)),
    "top_landings": lambda s, d: signals.top_landings(signals.highlight_scores(_bars(s, d)), _bars(s, d).where("bar % 9 = 5").select("series", "bar")),
    "win_repetition": lambda s, d: signals.repetition(_vectors(s, d)),
    "win_novelty_sections": lambda s, d: signals.novelty_sections(_vectors(s, d)),
    "win_excerpt_select": _excerpts,
    "win_vocal_runs": _runs,
    "win_overlap_clash": _clashes,
    "win_blend_quality": _blends,
    "win_beat_repair": _repair,
    "win_grid_fit": _grid,
    "win_arrivals": lambda s, d: signals.arrivals(_level_bars(s, d)),
}

SQL = {
    name: with_views(sql)
    for name, sql in {
        "win_section_stats": SECTION_SQL,
        "win_highlight_score": SCORE_SQL,
        "top_landings": LANDING_SQL,
        "win_repetition": REPEAT_SQL,
        "win_novelty_sections": NOVEL_SQL,
        "win_excerpt_select": EXCERPT_SQL,
        "win_vocal_runs": RUN_SQL,
        "win_overlap_clash": CLASH_SQL,
        "win_blend_quality": BLEND_SQL,
        "win_beat_repair": REPAIR_SQL,
        "win_grid_fit": GRID_SQL,
        "win_arrivals": ARRIVAL_SQL,
    }.items()
}
