"""Feature analytics: scores, tiers, levels, pair costs, neighbours and running orders."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators.ordering import placed
from trackloom.sources.shared import materialize


def energy_score(items: DataFrame, id_: str, weights: dict[str, float]) -> DataFrame:
    """Weighted sum of population z-scores clipped at 3, missing values as the median, scaled to 0..1 (0.5 if all are equal).

    The statistics are one row, read once; scoring is then a projection without a shuffle.
    """
    stats = items.agg(*(F.percentile(f, 0.5).alias(f"m_{f}") for f in weights)).first()
    filled = items.select(id_, *(F.coalesce(F.col(f).cast("double"), F.lit(stats[f"m_{f}"])).alias(f) for f in weights))
    s = filled.agg(*(g(f).alias(f"{n}_{f}") for f in weights for n, g in (("a", F.avg), ("s", F.stddev_pop)))).first()
    z = lambda f: F.least(F.lit(3.0), F.greatest(F.lit(-3.0), (F.col(f) - s[f"a_{f}"]) / s[f"s_{f}"])) if (s[f"s_{f}"] or 0) > 1e-9 else F.lit(0.0)
    total = filled.select(id_, sum((w * z(f) for f, w in weights.items()), F.lit(0.0)).alias("total"))
    lo, hi = total.agg(F.min("total"), F.max("total")).first()
    score = (F.col("total") - lo) / (hi - lo) if lo is not None and hi > lo else F.lit(0.5)
    return total.select(id_, F.round(score, 6).alias("energy"))


def energy_tiers(scores: DataFrame, id_: str, by: str, top: float = 0.25, middle: float = 0.5) -> DataFrame:
    """Tiers by rank within a group: the top share, the middle share, the rest; shares rounded half to even."""
    w = Window.partitionBy(by)
    n, r = F.count("*").over(w), F.row_number().over(w.orderBy(F.desc("energy"), id_))
    a, b = F.bround(n * top), F.bround(n * middle)
    return scores.select(by, id_, F.when(r <= a, "peak").when(r <= a + b, "middle").otherwise("rest").alias("tier"))


#: Rows of a stated set that one broadcast holds; a larger set is met slice by slice.
BLOCK_ROWS = 32_768


def against(rows: DataFrame, stated: DataFrame, on: str | None = None, most: int | None = None) -> DataFrame:
    """Every row of ``rows`` with every row of a ``stated`` set, or those that agree in ``on``: by broadcast, one for every BLOCK_ROWS
    rows of the set (``most``, where rows are large).

    ``rows`` are dealt out evenly first, by count: a few rows make much work, and neither the number of slices nor of values of
    ``on`` may decide how many tasks do it. No pair is shuffled.
    """
    slices = max(1, -(-stated.count() // min(BLOCK_ROWS, most or BLOCK_ROWS)))
    dealt = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if slices > 1:
        stated = materialize(stated.withColumn("slice", F.pmod(F.xxhash64(*(c for c, kind in stated.dtypes if not kind.startswith("map"))), F.lit(slices))), "stated")
    met = []
    for k in range(slices):
        own = F.broadcast(stated if slices == 1 else stated.where(F.col("slice") == k).drop("slice"))
        met.append(dealt.join(own, on) if on else dealt.crossJoin(own))
    return reduce(DataFrame.unionByName, met)


def active_span(bars: DataFrame, within: float = 6.0) -> DataFrame:
    """First and last bar of each series within ``within`` dB of its 90th percentile."""
    level = bars.groupBy("playlist_id").agg(F.percentile("rel_db", 0.9).alias("p90"))
    loud = bars.join(level, "playlist_id").where(F.col("rel_db") >= F.col("p90") - within)
    return loud.groupBy("playlist_id").agg(F.min("bar").alias("first_bar"), F.max("bar").alias("last_bar"), F.count("*").alias("bars"))


def rolling_median(bars: DataFrame) -> DataFrame:
    w = Window.partitionBy("playlist_id").orderBy("bar").rowsBetween(-3, 3)
    return bars.select("playlist_id", "bar", F.round(F.percentile("level", 0.5).over(w), 6).alias("median"))


def join_jumps(bars: DataFrame) -> DataFrame:
    """Per series the largest jump of level between neighbours."""
    w = Window.partitionBy("playlist_id").orderBy("bar")
    return bars.withColumn("jump", F.abs(F.col("level") - F.lag("level").over(w))).groupBy("playlist_id").agg(F.max("jump").alias("worst_jump"), F.count("jump").alias("joins"))


def timeline(bars: DataFrame, overlap: float = 2.0) -> DataFrame:
    """Start of each item in the output: lengths before it, less an overlap for each join."""
    w = Window.partitionBy("playlist_id").orderBy("bar")
    before = F.coalesce(F.sum("level").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return bars.select("playlist_id", "bar", F.round(before - overlap * (F.row_number().over(w) - 1), 6).alias("start"))


def isotonic_curve(points: DataFrame) -> DataFrame:
    """Monotone regression of ``y`` on ``x``: (x, fitted), from Spark's own regression."""
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=["x"], outputCol="features").transform(points.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("label")))
    fitted = IsotonicRegression().fit(rows).transform(rows)
    return fitted.groupBy("x").agg(F.round(F.max("prediction"), 6).alias("fitted"))


def six_places(c: Column) -> Column:
    """``c`` (not negative) at six decimal places, without the decimal number that ``round`` makes of each value of billions."""
    return F.floor(c * 1e6 + 0.5) / 1e6


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """``v`` at length one. The length comes as a lambda's variable: as an expression inside it would be worked out for each number."""
    return F.aggregate(F.array(F.sqrt(dot(v, v))), F.transform(v, lambda x: x.cast("double")), lambda u, norm: F.transform(u, lambda x: x / norm))


def top_labels(predictions: DataFrame, k: int) -> DataFrame:
    """(series, class, mean, place): the ``k`` classes with the largest mean prediction over a series' rows (series, embedding)."""
    long = predictions.select("series", F.posexplode("embedding").alias("class", "x"))
    mean = long.groupBy("series", "class").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))
    place = F.row_number().over(Window.partitionBy("series").orderBy(F.desc("mean"), "class"))
    return mean.withColumn("place", place).where(F.col("place") <= k)


def pool(vectors: DataFrame, by: str) -> DataFrame:
    """Per group the mean of its unit vectors, made a unit vector: rows (group, place, value)."""
    parts = vectors.select(by, F.posexplode(unit(F.col("embedding"))).alias("place", "x")).groupBy(by, "place").agg(F.avg("x").alias("x"))
    norm = parts.groupBy(by).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return parts.join(norm, by).select(by, "place", F.round(F.col("x") / F.col("norm"), 6).alias("x"))


def _improved(path, c, free_start: bool, free_end: bool):
    """``path`` after turning pieces round (2-opt) and moving single items (or-opt) while that gains; ends that aren't free stay."""
    import numpy as np

    n = len(path)
    c = np.pad(c, (0, 1))  # item n stands for what lies beyond a free end, at no cost
    path, better = np.array(path), n > 2
    lo, hi = (0 if free_start else 1), (n if free_end else n - 1)  # places that may change
    while better:
        better = False
        for i in range(lo, hi - 1):  # costs are the same both ways, so turning a piece changes its two edges only
            before = path[i - 1] if i else n
            last = path[i + 1 : hi]
            beyond = np.append(path[i + 2 :], n)[: hi - i - 1]
            change = c[before, last] + c[path[i], beyond] - c[before, path[i]] - c[last, beyond]
            k = int(change.argmin())
            if change[k] < -1e-9:
                path[i : i + k + 2] = path[i : i + k + 2][::-1]
                better = True
        for i in range(lo, hi):
            x, rest = path[i], np.delete(path, i)
            front = np.concatenate([[n], rest]) if free_start else rest
            back = np.append(rest, n) if free_start else np.append(rest[1:], n)
            if not free_end:
                front, back = front[:-1], back[:-1]
            adds = c[front, x] + c[x, back] - c[front, back]
            k = int(adds.argmin())
            now = c[path[i - 1] if i else n, x] + c[x, path[i + 1] if i + 1 < n else n] - c[path[i - 1] if i else n, path[i + 1] if i + 1 < n else n]
            if adds[k] < now - 1e-9:
                path, better = np.insert(rest, k if free_start else k + 1, x), True
    return path


def greedy_sequence(items: DataFrame, block: str, most: int = 64) -> DataFrame:
    """(block, place, song_id): a running order of each block.

    Blocks are walked cell by cell of tempo, energy and key, and cut into stretches of at most ``most`` items, each ordered from its
    first by nearest neighbour and improved by turning pieces round and moving single items. Then the cuts move by half a stretch, ends of
    a stretch stay and its inside is improved again, until neither of the two cuts gains anything: no such move inside
    ``most`` items of a cut, or across the border of the other, is left. Longer moves aren't tried. Each pass lowers the
    cost, so it ends. A task holds one stretch at a time, whatever the size of the block; places come from a distributed sort.
    """
    kind = dict(items.dtypes)[block]
    schema = f"{block} {kind}, pos long, n long, song_id long, tempo double, energy double, wheel int, letter string, moved boolean"
    rows = items.select(block, "song_id", F.col("tempo").cast("double").alias("tempo"), F.col("energy").cast("double").alias("energy"), F.regexp_extract("camelot", r"^(\d+)", 1).try_cast("int").alias("wheel"), F.right("camelot", F.lit(1)).alias("letter"))
    of = rows.groupBy(block).agg(F.count("*").alias("n"), F.min(F.log2("tempo")).alias("t0"), F.max(F.log2("tempo")).alias("t1"), F.min("energy").alias("e0"), F.max("energy").alias("e1"))
    # cells of a few items each, as wide in cost on every side, walked to and fro
    span = lambda a, b, w: F.greatest(w * (F.col(b) - F.col(a)), F.lit(0.5))
    side = F.pow(3 * span("t0", "t1", 10) * span("e0", "e1", 2) * 6 / F.col("n"), F.lit(1 / 3))
    cell = lambda c: F.floor(c / F.col("side"))
    rows = rows.join(of.withColumn("side", side), block).withColumns({"i": cell(10 * (F.log2("tempo") - F.col("t0"))), "j": cell(2 * (F.col("energy") - F.col("e0"))), "k": cell(0.5 * F.coalesce("wheel", F.lit(0)))})
    to_and_fro = lambda c, after: F.when(after % 2 == 0, F.col(c)).otherwise(-F.col(c)).asc()
    rows = placed(rows, [F.col(block).asc(), F.asc("i"), to_and_fro("j", F.col("i")), to_and_fro("k", F.col("i") + F.col("j")), F.asc("letter"), F.asc("tempo"), F.asc("song_id")], "pos")
    rows = rows.join(rows.groupBy(block).agg(F.min("pos").alias("first")), block).withColumn("pos", F.col("pos") - F.col("first")).withColumn("moved", F.lit(True))

    def order(first: bool):
        def run(pdf):
            import numpy as np

            pdf = pdf.sort_values("pos", ignore_index=True)
            log, energy, wheel, letter = np.log2(pdf.tempo.to_numpy(float)), pdf.energy.to_numpy(float), pdf.wheel.to_numpy(), pdf.letter.to_numpy()
            turn = np.abs(wheel[:, None] - wheel)
            c = 10 * np.abs(log[:, None] - log) + 2 * np.abs(energy[:, None] - energy) + 0.5 * (np.minimum(turn, 12 - turn) + (letter[:, None] != letter))
            path, left = [0], set(range(1, len(pdf)))
            while first and left:
                path.append(min(left, key=lambda j: (c[path[-1], j], j)))
                left.remove(path[-1])
            path = path if first else list(range(len(pdf)))
            whole = bool(pdf.pos.iloc[-1] == pdf.n.iloc[0] - 1)
            after = _improved(path, c, False, first or whole)
            out = pdf.iloc[after].assign(pos=pdf.pos.to_numpy(), moved=bool((after != np.arange(len(pdf))).any()))
            return out[[block, "pos", "n", "song_id", "tempo", "energy", "wheel", "letter", "moved"]]

        return run

    columns = [f.split()[0] for f in schema.split(", ")]
    stretch = lambda shift: F.floor((F.col("pos") + shift) / most).alias("stretch")
    done = materialize(rows.select(*columns, stretch(0)).groupBy(block, "stretch").applyInPandas(order(True), schema), "order")
    quiet, shift = 0, most // 2
    while quiet < 2:
        done = materialize(done.select(*columns, stretch(shift)).groupBy(block, "stretch").applyInPandas(order(False), schema), "order")
        quiet = quiet + 1 if done.where("moved").isEmpty() else 0
        shift = 0 if shift else most // 2
    return done.select(block, (F.col("pos") + 1).cast("int").alias("place"), "song_id")
