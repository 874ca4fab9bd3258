"""SimHash near-duplicate components by the generalised pigeonhole principle.

1. One pass over the texts gives each document the 64-bit fingerprint of its 3-word shingles, repeats included. Documents
   with one fingerprint are one class, so copies cost one row from here on.
2. The 64 by 64 table of joint bit counts over all classes gives correlations; bits that go together are put in one part,
   as together they tell fewer documents apart than bits from all over.
3. Two fingerprints that differ in at most t of m parts' bits differ, whatever thresholds t_i >= -1 with sum t - m + 1 are
   given to the parts, in at most t_i bits of some part i (-1: the part is left out). The buckets' sizes in each part,
   counted over all classes, and the bits' frequencies give an estimate of the comparisons for each threshold; dynamic
   programming over the parts finds the cheapest thresholds, and the number of parts with the least total is taken.
4. Buckets are classes that agree in a part but for t_i masked bits. Pairs of a bucket of at most ``CROWD`` classes are
   compared. In a fuller one no pairs are made: with ``differ`` = 2 two fingerprints differ in at most 2 bits exactly if
   they share a point at distance 1 or 0 from both, so each class names itself and its neighbours in the bits outside the
   part, and all who name one point (65 at most) link with the smallest. With ``differ`` = 1 it asks for the neighbours
   themselves.
5. Components of the links; copies get their class's component.

Defined results: null text is empty; a text without words has fingerprint zero, linked like any other; fewer words than a
shingle: the whole sequence is one shingle; every row is judged by its own text, also where a ``doc_id`` repeats; a row
without ``doc_id`` gets its fingerprint, is in no component (``component_id`` null) and names none; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import common
from trackloom.llm.components import components

BITS, SEED = 64, 42
#: Buckets of more classes than this are linked by common neighbours, not by pairs.
CROWD = 32
#: Shingles whose hashes are held at a time.
STEP = 1 << 16
_PLACE = 256 * np.arange(8)
#: The bits of each byte.
_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str, k: int = 3) -> int:
    """The 64-bit SimHash of the ``k``-word shingles of a text, A-Z lower-cased: bit j is 1 if it is set in over half of the
    shingles' XXH64. No word: 0."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: lower() and split() know ASCII only
    if not words:
        return 0
    line, k = b" ".join(words), min(k, len(words))
    starts = np.cumsum([0, *(len(w) + 1 for w in words)])
    n, ones = len(words) - k + 1, np.zeros(BITS, np.int64)
    for at in range(0, n, STEP):
        m = min(STEP, n - at)
        h = np.fromiter((xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts[at : at + m].tolist(), (starts[at + k : at + k + m] - 1).tolist())), "<u8", m)
        seen = np.bincount((h.view(np.uint8).reshape(m, 8) + _PLACE).ravel(), minlength=8 * 256).reshape(8, 256)
        ones += (seen @ _OF_BYTE).ravel()
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = np.array([fingerprint(t, k) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(f)], ["doc_id", "fp"])

    return common.texts(docs).mapInArrow(run, "doc_id long, fp long")


def _joint(classes: DataFrame) -> np.ndarray:
    """How many fingerprints have bits i and j both set: 4096 sums, added up in Spark."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS))
        for batch in batches:
            x = np.unpackbits(batch.column("fp").to_numpy(zero_copy_only=False).astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS)), pa.array(total.ravel().astype(np.int64))], ["at", "n"])

    sums = classes.select("fp").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BITS * BITS)
    for r in sums:
        out[r.at] = r.n
    return out.reshape(BITS, BITS)


def grouped_bits(joint: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """``parts`` groups of bits of about one size: each starts with the free bit of the strongest ties and takes in the bit
    that is most correlated with the group, by phi, whatever its sign."""
    p = np.diag(joint) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    phi = np.abs(joint / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(phi, 0)
    free, out = list(range(BITS)), []
    for i in range(parts):
        size = BITS * (i + 1) // parts - BITS * i // parts
        group = [max(free, key=lambda b: (phi[b, free].sum(), -b))]
        free.remove(group[0])
        while len(group) < size:
            b = max(free, key=lambda b: (phi[b, group].mean(), -b))
            group.append(b)
            free.remove(b)
        out.append(sorted(group))
    return out


def allocate(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """The thresholds, one a part from ``costs`` (threshold to cost), of the given sum and the least cost."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for options in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for s, (cost, chosen) in best.items():
            for t, c in options.items():
                if s + t not in after or cost + c < after[s + t][0]:
                    after[s + t] = (cost + c, [*chosen, t])
        best = after
    return best[total]


def _mask(bits: list[int]) -> int:
    x = sum(1 << b for b in bits)
    return x - (1 << 64) if x >> 63 else x


def _plan(classes: DataFrame, n: int, differ: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each part that is probed, by the estimated number of rows and comparisons."""
    joint = _joint(classes)
    p = np.diag(joint) / max(n, 1)
    odds = 2 * p * (1 - p) / np.maximum(p**2 + (1 - p) ** 2, 1e-12)  # of two fingerprints differing in a bit, to their agreeing
    layouts = [grouped_bits(joint, n, m) for m in range(2, differ + 3)]
    numbered = [(layout, i) for layout in range(len(layouts)) for i in range(len(layouts[layout]))]
    keys = F.array(*(F.struct(F.lit(at).alias("at"), F.col("fp").bitwiseAND(F.lit(_mask(layouts[a][i]))).alias("v")) for at, (a, i) in enumerate(numbered)))
    sizes = classes.select(F.explode(keys).alias("k")).groupBy("k.at", "k.v").agg(F.count("*").alias("n"))
    width = F.lit(float(BITS + 1)) - F.element_at(F.array(*(F.lit(len(layouts[a][i])) for a, i in numbered)), F.col("at") + 1)
    found = sizes.where("n > 1").groupBy("at").agg(F.sum(F.least(F.col("n") * (F.col("n") - 1.0) / 2, F.col("n") * width)).alias("cost"))
    agree = {r.at: r.cost for r in found.collect()}
    best = (math.inf, [], [])
    for a, layout in enumerate(layouts):
        costs = []
        for i, bits in enumerate(layout):
            base, sums = agree.get(numbered.index((a, i)), 0.0), [1.0]  # sums: elementary symmetric sums of the odds
            for o in odds[bits]:
                sums = [x + o * y for x, y in zip([*sums, 0.0], [0.0, *sums])][: differ + 1]
            options = {-1: 0.0}
            for t in range(min(differ, len(bits)) + 1):
                options[t] = math.comb(len(bits), t) * n + base * sum(sums[: t + 1])
            costs.append(options)
        cost, chosen = allocate(costs, differ - len(layout) + 1)
        best = min(best, (cost, layout, chosen), key=lambda x: x[0])
    return [(bits, t) for bits, t in zip(best[1], best[2]) if t >= 0]


def _masks(plan: list[tuple[list[int], int]]) -> list[list[int]]:
    """The bits that agree: each part's, without each choice of as many bits as its threshold."""
    return [[b for b in bits if b not in out] for bits, t in plan for out in itertools.combinations(bits, t)]


def _buckets(classes: DataFrame, masks: list[list[int]]) -> DataFrame:
    """(at, v, fp): a row for each bucket that a fingerprint is in; ``at`` numbers the masks, whose bits agree in a bucket."""
    keys = F.array(*(F.struct(F.lit(at).alias("at"), F.col("fp").bitwiseAND(F.lit(_mask(bits))).alias("v")) for at, bits in enumerate(masks)))
    return classes.select("fp", F.explode(keys).alias("k")).select("k.at", "k.v", "fp")


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _crowded(rows: DataFrame, masks: list[list[int]]) -> DataFrame:
    """Links of the fingerprints of full buckets: all that name one point at distance 0 or 1 differ in at most 2 bits."""
    free = F.array(*(F.array(F.lit(0).cast("long"), *(F.lit(_mask([b])) for b in range(BITS) if b not in bits)) for bits in masks))
    points = rows.select("fp", F.explode(F.element_at(free, F.col("at") + 1)).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    named = points.groupBy("point").agg(F.collect_set("fp").alias("who"))  # at most 65: a point has no more neighbours
    return named.where(F.size("who") > 1).select(F.array_min("who").alias("lo"), F.explode("who").alias("hi")).where("lo < hi")


def simhash_links(classes: DataFrame, differ: int = 2) -> DataFrame:
    """(lo, hi): links between the distinct fingerprints ``classes`` (fp) that make the components of all pairs which differ
    in at most ``differ`` bits, 1 or 2; every link is such a pair."""
    if differ not in (1, 2):
        raise ValueError("common neighbours link what differs in one or two bits")
    n = classes.count()
    if n < 2:
        return classes.sparkSession.createDataFrame([], "lo long, hi long")
    masks = _masks(_plan(classes, n, differ))
    rows = _buckets(classes, masks)
    sizes = common.materialize(rows.groupBy("at", "v").agg(F.count("*").alias("n")).where("n > 1"), "bucket-sizes")
    shared = common.materialize(rows.join(sizes, ["at", "v"]), "buckets")
    few, many = shared.where(F.col("n") <= CROWD), shared.where(F.col("n") > CROWD)
    a, b = few.select("at", "v", F.col("fp").alias("lo")), few.select("at", "v", F.col("fp").alias("hi"))
    pairs = a.join(b, (a.at == b.at) & (a.v == b.v) & (F.col("lo") < F.col("hi")) & (_distance("lo", "hi") <= differ)).select("lo", "hi")
    links = pairs.union(_crowded(many, masks) if differ == 2 else _crowded_by_one(many, masks))
    return common.materialize(links.distinct(), "links")


def _crowded_by_one(rows: DataFrame, masks: list[list[int]]) -> DataFrame:
    """Links of full buckets at distance 1: each fingerprint asks for its neighbours with one more bit set."""
    free = F.array(*(F.array(*(F.lit(_mask([b])) for b in range(BITS) if b not in bits)) for bits in masks))
    up = rows.select("fp", F.explode(F.element_at(free, F.col("at") + 1)).alias("flip")).where(F.col("fp").bitwiseAND(F.col("flip")) == 0)
    up = up.select(F.col("fp").alias("of"), F.col("fp").bitwiseOR(F.col("flip")).alias("fp")).distinct()
    return up.join(rows.select("fp").distinct(), "fp").select(F.least("of", "fp").alias("lo"), F.greatest("of", "fp").alias("hi"))


def simhash_components(docs: DataFrame, shingle: int = 3, differ: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of ``docs`` (doc_id, text)."""
    common.small_batches(docs.sparkSession)
    signed = common.materialize(_fingerprints(docs, shingle), "fingerprints")
    classes = common.materialize(signed.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    labels = components(simhash_links(classes.select("fp"), differ))
    of = common.materialize(classes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label")), "labelled")
    smallest = of.groupBy("label").agg(F.min("least").alias("component_id"))
    named = common.materialize(of.join(smallest, "label").select("fp", "component_id"), "named")
    out = signed.join(named, "fp", "left")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose fingerprints differ in at most 2 bits."""
    return simhash_components(common.table(spark, sf_dir, "documents"))
