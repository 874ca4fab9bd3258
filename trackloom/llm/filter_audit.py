"""How five document filters interact in each of their 120 orders, with duplicates found behind a counting-Bloom prepass.

1. One pass over the texts gives each document the mask of the filters A to D that it fails and a 64-bit hash.
2. Tasks build counting-Bloom sketches of the hashes: ``PROBES`` cells a text, each counting 0, 1 or "2 or more" as two bit
   arrays, which merge by OR. A text with a cell of count 1 is the only one of its kind, for sure. The merged sketch has at most
   ``CELLS`` cells whatever the input (8 MB as it is broadcast); beyond some 30 million documents it clears less and less,
   which costs time, never a result.
3. Only texts that the sketch doesn't clear are shuffled, whole, and grouped by exact equality with their smallest id; groups
   are summed before the shuffle, so that a text of a third of all rows costs a row a task. A text fails E unless its
   id is the smallest of its group.
4. Flags meet the labels by id and become counts by (part, mask): at most 32 a part, which add up. All that the 120 orders
   ask for comes from these counts.

Failing masks: bit 0 is A, bit 4 is E. Defined results: null text is empty; null language is the part ''; the labels of an id
count as 1 if any of its rows says so, null labels are 0; rows that repeat an id with the same text don't fail E against
each other; a row without id is smaller than none and no row is smaller than it, so it doesn't fail E; empty texts are equal
to each other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import common

FILTERS = "ABCDE"
#: Least words, least share of distinct words, largest share of capitals, in hundredths.
WORDS, DISTINCT, CAPITALS = 200, 50, 3
_CAPITAL, _SYMBOL = re.compile("[A-Z]+"), re.compile("[#$%&*|]")
#: Cells of a sketch at most and at least, cells for each document, cells that a text counts in, tasks that build sketches.
CELLS, LEAST_CELLS, SPREAD, PROBES, BUILDERS = 1 << 26, 1 << 16, 8, 4, 64
#: Cells of a piece, the unit in which sketches are merged.
PIECE = 1 << 20


def failing(text: str) -> int:
    """The mask of the filters A to D that a text fails."""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes: split() knows ASCII white space only
    capitals = sum(map(len, _CAPITAL.findall(text)))
    return (len(words) < WORDS) | (100 * len(set(words)) < DISTINCT * len(words)) << 1 | (100 * capitals > CAPITALS * len(text)) << 2 | (_SYMBOL.search(text) is not None) << 3


def _flags(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, h) of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks = [failing(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(masks, pa.int32()), batch.column("h")], ["doc_id", "part", "mask", "h"])

    rows = common.texts(docs, F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"))
    return rows.withColumn("h", F.xxhash64("text")).mapInArrow(run, "doc_id long, part string, mask int, h long")


def _cells(h: np.ndarray, cells: int) -> np.ndarray:
    """The cells (rows, PROBES) of hashes; ``cells`` is a power of two."""
    x = h.astype(np.uint64)
    a, b = x & np.uint64(0xFFFFFFFF), (x >> np.uint64(32)) | np.uint64(1)
    return ((a[:, None] + b[:, None] * np.arange(PROBES, dtype=np.uint64)) & np.uint64(cells - 1)).astype(np.int64)


def unique_cells(hashes: DataFrame, rows: int) -> tuple[np.ndarray, int]:
    """The merged sketch of ``hashes`` (h): packed bits of the cells that count exactly one, and the number of cells."""
    cells = min(CELLS, max(LEAST_CELLS, 1 << (SPREAD * max(rows, 1) - 1).bit_length()))
    piece = min(PIECE, cells)

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, more = np.zeros(cells, bool), np.zeros(cells, bool)
        for batch in batches:
            at = _cells(batch.column("h").to_numpy(zero_copy_only=False), cells)
            at.sort(axis=1)
            fresh = np.ones(at.shape, bool)
            fresh[:, 1:] = at[:, 1:] != at[:, :-1]  # a text counts once in a cell that it has twice
            at, n = np.unique(at[fresh], return_counts=True)
            more[at[n > 1]] = True
            more[at[once[at]]] = True
            once[at] = True
        for k in range(cells // piece):
            a, b = once[k * piece : (k + 1) * piece], more[k * piece : (k + 1) * piece]
            if a.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(a).tobytes()]), pa.array([np.packbits(b).tobytes()])], ["k", "a", "b"])

    def merge(group: pa.Table) -> pa.Table:  # a piece of each builder, 16 MB at most
        once, more = np.zeros(piece // 8, np.uint8), np.zeros(piece // 8, np.uint8)
        for a, b in zip(group.column("a").to_pylist(), group.column("b").to_pylist()):
            a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
            more |= b | (once & a)
            once |= a
        return pa.table({"k": group.column("k").slice(0, 1), "one": [(once & ~more).tobytes()]})

    built = common.materialize(hashes.select("h").coalesce(BUILDERS).mapInArrow(build, "k int, a binary, b binary"), "sketches")
    out = np.zeros(cells // 8, np.uint8)
    for r in built.groupBy("k").applyInArrow(merge, "k int, one binary").collect():  # CELLS / 8 bytes at most
        out[r.k * piece // 8 : (r.k + 1) * piece // 8] = np.frombuffer(r.one, np.uint8)
    return out, cells


def _may_repeat(spark: SparkSession, ones: np.ndarray, cells: int) -> Column:
    """Whether the text of hash ``h`` may occur again: none of its cells counts exactly one."""
    shared = spark.sparkContext.broadcast(ones.tobytes())

    @F.pandas_udf("boolean")
    def may(h: pd.Series) -> pd.Series:
        bits, at = np.frombuffer(shared.value, np.uint8), _cells(h.to_numpy(), cells)
        return pd.Series(~((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).any(axis=1))

    return may("h")


def flagged(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask) of every row of ``docs`` (doc_id, text, lang), with E in the mask."""
    spark = docs.sparkSession
    common.small_batches(spark)
    flags = common.materialize(_flags(docs), "flags")
    ones, cells = unique_cells(flags, flags.count())
    marked = common.materialize(flags.withColumn("again", _may_repeat(spark, ones, cells)), "marked")
    pool = common.texts(docs).withColumn("h", F.xxhash64("text")).where(_may_repeat(spark, ones, cells))
    firsts = pool.groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.xxhash64("text").alias("h"), F.lit(True).alias("is_first"))
    firsts = common.materialize(firsts.where("doc_id is not null"), "firsts")
    repeats = marked.where("again").join(firsts, ["doc_id", "h"], "left")
    late = F.col("is_first").isNull() & F.col("doc_id").isNotNull()
    repeats = repeats.select("doc_id", "part", (F.col("mask") + F.when(late, 16).otherwise(0)).alias("mask"))
    return marked.where("not again").select("doc_id", "part", "mask").unionByName(repeats)


def mask_counts(flags: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents, those of quality 1 and toxic ones."""
    one = lambda name: F.max(F.coalesce((F.col(name) == 1).cast("long"), F.lit(0).cast("long"))).alias(name)
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(one("quality"), one("toxic"))
    met = flags.join(known, "doc_id", "left")
    total = lambda name: F.coalesce(F.sum(name), F.lit(0).cast("long"))
    return met.groupBy("part", "mask").agg(F.count("*").alias("n"), total("quality").alias("good"), total("toxic").alias("toxic"))


def interactions(counts: DataFrame) -> DataFrame:
    """The report of all orders from ``counts`` (part, mask, n, good, toxic), which may have several rows a mask."""
    spark = counts.sparkSession
    steps = [(order, k, 1 << FILTERS.index(f), sum(1 << FILTERS.index(g) for g in order[: k - 1])) for order in map("".join, itertools.permutations(FILTERS)) for k, f in enumerate(order, 1)]
    parts = counts.groupBy("part").agg(*(F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0).cast("long")).alias(f"{c}{m}") for m in range(1 << len(FILTERS)) for c in ("n", "good", "toxic")))
    cells = F.array(*(F.struct(F.lit(m).alias("mask"), *(F.col(f"{c}{m}").alias(c) for c in ("n", "good", "toxic"))) for m in range(1 << len(FILTERS))))
    rows = common.materialize(parts.select("part", cells.alias("cells")), "masks")

    def total(column: str, test) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda s, c: s + F.when(test(c["mask"]), c[column]).otherwise(0))

    fails = lambda m: m.bitwiseAND(F.col("bit")) != 0
    there = lambda m: m.bitwiseAND(F.col("before")) == 0
    each = rows.select("part", "cells", F.explode(F.sequence(F.lit(0), F.lit(len(steps) - 1))).alias("i"))
    each = each.join(F.broadcast(spark.createDataFrame([(i, *s) for i, s in enumerate(steps)], "i int, filter_order string, step int, bit int, before int")), "i")  # 600 fixed rows
    out = each.select(
        "part", "filter_order", "step", "bit",
        total("n", lambda m: there(m) & ~fails(m)).alias("kept"), total("n", lambda m: there(m) & fails(m)).alias("removed"),
        total("n", lambda m: ~there(m) & fails(m)).alias("redundant"), total("n", lambda m: m == F.col("bit")).alias("unique_fails"),
        total("good", lambda m: there(m) & fails(m)).alias("good_lost"), total("toxic", lambda m: there(m) & fails(m)).alias("toxic_lost"),
    )
    shapley = out.groupBy("part", "bit").agg(F.sum("removed").alias("shapley"))
    return out.join(shapley, ["part", "bit"]).drop("bit")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    return interactions(mask_counts(flagged(docs), labels))


def op13_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five filters on ``documents``, with ``labels``."""
    return audit(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


SQL = """
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part FROM documents),
split AS (SELECT *, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM docs),
known AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
masks AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN first < split.doc_id THEN 16 ELSE 0 END AS mask
  FROM split LEFT JOIN known USING (doc_id)),
counts AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY part, mask),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(name, bit)),
orders AS (SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a, f b, f c, f d, f e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
steps AS (SELECT filter_order, s AS step, bits[s] AS bit, coalesce(list_sum(bits[1:s - 1]), 0)::INTEGER AS before FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS s)),
found AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (WHERE mask & (before | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (WHERE mask & before = 0 AND mask & bit <> 0), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE mask & before <> 0 AND mask & bit <> 0), 0) AS redundant, coalesce(sum(n) FILTER (WHERE mask = bit), 0) AS unique_fails,
    coalesce(sum(good) FILTER (WHERE mask & before = 0 AND mask & bit <> 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE mask & before = 0 AND mask & bit <> 0), 0) AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM found
"""
