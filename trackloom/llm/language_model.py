"""Language-model scoring by cross-entropy difference of two matched n-gram models.

Both models are interpolated bigram models with one vocabulary, one pair of weights and one unknown class; the target
model is counted over the documents named as target, the background model over all documents. A document's score is its
mean loss per token under the target model less that under the background model: the lower, the more it is like the
target.

The vocabulary is all words of all documents (lower-cased, ASCII white space), and every bigram has a count of its own:
rare words are told apart by 63-bit hashes, and the tables grow with the corpus. What moves is kept small:

1. Words are counted; the frequent ones (one token in ``FREQUENT_WORD`` or more, so at most that many) go to the tasks
   by broadcast, and a word's code is its place in that table or else its hash.
2. Every token first gets the loss as if its bigram occurred nowhere else. Tokens of two frequent words have all they
   need for that in the task; the others meet the word counts in a join on the rare word.
3. Bigrams are counted, and those that occur more than once get the difference between their true loss and that first
   one. Documents meet these by a join on the bigram, and the frequent bigrams (one token in ``FREQUENT_BIGRAM`` or more)
   by broadcast, so no key of a join is hot. Both bounds decide speed only, never a score.

Each step is written to the shared folder, and a step's shuffle files go when it ends.

Defined results: a text without words has no tokens and null losses and score; without target documents the target
model is uniform over the vocabulary; a null ``doc_id`` is scored and never a target; repeated rows each count and each
get a row; an empty table gives an empty result; other columns are ignored. ``docs`` is read once a step and must come
out in the same partitions each time, as a table does; a step that sees others raises.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import common, shingles

#: Interpolation weights of bigram and unigram; the rest goes to the uniform distribution.
BIGRAM, UNIGRAM = 0.6, 0.39
#: A word or bigram is frequent from one in so many tokens; there are no more than that of them.
FREQUENT_WORD, FREQUENT_BIGRAM = 1 << 21, 1 << 20
#: Tokens or words that a task adds up at a time, and rows of an output batch.
CHUNK, ROWS = 2_000_000, 50_000
#: Slices of the documents whose bigrams go to their join at a time.
SLICES = 2
#: Set in every hash of a word, so that none is a place in the table of frequent words (0: the start of a text).
RARE = 1 << 62
COUNTS = ["one_target", "one_background", "first_target", "first_background"]


def befores(ids: np.ndarray, starts=0) -> np.ndarray:
    """The word before each of ``ids``; 0 at the places ``starts``, where documents start."""
    before = np.empty(len(ids), np.uint64)
    before[1:] = ids[:-1]
    before[starts] = 0
    return before


def _cell(before: np.ndarray, ids: np.ndarray) -> np.ndarray:
    h = (before * np.uint64(0x9E3779B97F4A7C15)) ^ (shingles.mix(ids.astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F))
    return shingles.mix(h).view(np.int64)


def cells(ids: np.ndarray, starts=0) -> np.ndarray:
    """The 64-bit hash of each bigram of ``ids``."""
    return _cell(befores(ids, starts), ids)


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of each word in the batch's distinct words, their hashes, words of each text). Each distinct word is hashed once a batch."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = lists.flatten()
    full = np.asarray(pc.greater(pc.binary_length(flat), 0))
    upto = np.concatenate([[0], np.cumsum(full)])
    edges = np.asarray(lists.offsets)
    lengths = np.diff(upto[edges - edges[0]])
    coded = flat.filter(pa.array(full)).dictionary_encode()
    n, (_, offsets, data) = len(coded.dictionary), coded.dictionary.buffers()
    ends = np.frombuffer(offsets, np.int32, n + 1).tolist() if n else [0]
    data = data.to_pybytes() if data else b""
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(ends, ends[1:])), np.uint64, n) | np.uint64(RARE)
    return np.asarray(coded.indices), hashes, lengths


def _starts(lengths: np.ndarray) -> np.ndarray:
    """The places where texts with words start."""
    return (np.cumsum(lengths) - lengths)[lengths > 0]


def _tokens(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes of all words, words of each text, places where texts with words start); ``table``: sorted hashes of the frequent words."""
    place, hashes, lengths = _words(texts)
    at = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
    codes = np.where(table[at] == hashes, at.astype(np.uint64), hashes)
    return codes[place], lengths, _starts(lengths)


def _batches(columns: dict[str, np.ndarray | pa.Array]) -> Iterator[pa.RecordBatch]:
    arrays = {k: c if isinstance(c, pa.Array) else pa.array(c) for k, c in columns.items()}
    for at in range(0, len(next(iter(arrays.values()))), ROWS):
        yield pa.RecordBatch.from_arrays([c.slice(at, ROWS) for c in arrays.values()], list(arrays))


def _chunks(batches: Iterable[pa.RecordBatch], make: Callable, add: Callable) -> Iterator[pa.RecordBatch]:
    """Gathers what ``make`` gives of a batch until it holds CHUNK tokens, and yields ``add`` of that."""
    chunk, n = [], 0
    for batch in batches:
        part = make(batch)
        chunk.append(part)
        n += len(part[0])
        if n >= CHUNK:
            yield from add(chunk)
            chunk, n = [], 0
    if n:
        yield from add(chunk)


def word_counts(docs: DataFrame) -> DataFrame:
    """(id, COUNTS) of every word of ``docs`` (text, is_target), written out: how often it occurs, and how often it comes
    before a word; id 0 is the start of a text."""

    def make(batch: pa.RecordBatch) -> tuple:
        place, hashes, lengths = _words(batch.column("text"))
        ids, starts = place.astype(np.int64) + 1, _starts(lengths)
        before = befores(ids, starts).astype(np.int64)
        target = np.repeat(np.array(batch.column("is_target").to_pylist(), bool), lengths)
        sums = [np.bincount(x, minlength=len(hashes) + 1) for x in (ids[target], ids, before[target], before)]
        return np.append(np.uint64(0), hashes), *sums

    def add(chunk: list) -> Iterator[pa.RecordBatch]:
        ids, *sums = (np.concatenate(x) for x in zip(*chunk))
        order = np.argsort(ids)
        at = np.flatnonzero(np.diff(ids[order], prepend=ids[order[0]] + np.uint64(1)))
        yield from _batches({"id": ids[order[at]].view(np.int64), **{c: np.add.reduceat(x[order], at) for c, x in zip(COUNTS, sums)}})

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _chunks(batches, make, add)

    parts = docs.mapInArrow(count, "id long, " + ", ".join(f"{c} long" for c in COUNTS))
    # a chunk's words are distinct already: rows go to their word's task before they are added up
    return common.materialize(parts.repartition("id").groupBy("id").agg(*(F.sum(c).alias(c) for c in COUNTS)), "words")


class Model:
    """The frequent words and the totals that every task needs: at most FREQUENT_WORD + 1 rows of numbers."""

    def __init__(self, frequent: pa.Table, n_target: int, tokens: int, known: int):
        ids = np.asarray(frequent.column("id")).view(np.uint64)
        order = np.argsort(ids)
        self.ids, self.counts = ids[order], {c: np.asarray(frequent.column(c))[order] for c in COUNTS}
        self.totals, self.known = {"target": max(n_target, 1), "background": max(tokens, 1)}, known

    def loss(self, side: str, two, first, one, log=np.log, most=np.maximum):
        """The loss of a word that occurs ``one`` times, ``two`` times after one that comes first ``first`` times: of arrays or columns."""
        return -log(BIGRAM * two / most(first, 1) + UNIGRAM * one / self.totals[side] + (1 - BIGRAM - UNIGRAM) / self.known)

    def column_loss(self, side: str, two: Column) -> Column:
        return self.loss(side, two, F.col(f"first_{side}"), F.col(f"one_{side}"), F.log, lambda c, k: F.greatest(c, F.lit(k)))

    def loss_of(self, side: str, two, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """For codes of frequent words."""
        return self.loss(side, two, self.counts[f"first_{side}"][before], self.counts[f"one_{side}"][ids])

    def revealed(self, before: np.ndarray, ids: np.ndarray) -> dict[str, pa.Array]:
        """REVEALED: as w and u the codes that are not of frequent words, else null; and COUNTS of the others."""
        n, out = len(self.ids), {}
        for name, code, sides in (("w", ids, COUNTS[:2]), ("u", before, COUNTS[2:])):
            frequent = code < n
            out[name] = pa.array(code.view(np.int64), mask=frequent)
            at = np.where(frequent, code, 0).astype(np.int64)
            for c in sides:
                out[c] = pa.array(self.counts[c][at], mask=~frequent)
        return out


REVEALED = "w long, one_target long, one_background long, u long, first_target long, first_background long"


def _filled(rows: DataFrame, rare: DataFrame) -> DataFrame:
    """``rows`` with the COUNTS of u and w where these are given. At least one of them is in every row, so no join key is null or hot."""
    for name, other, sides in (("w", "u", COUNTS[:2]), ("u", "w", COUNTS[2:])):
        own = rare.select(F.col("id").alias("of"), *(F.col(c).alias(f"of_{c}") for c in sides))
        met = rows.withColumn("key", F.coalesce(name, other)).join(own.hint("shuffle_hash"), F.col("key") == F.col("of"), "left")
        rows = met.select(*(F.coalesce(c, f"of_{c}").alias(c) if c in sides else c for c in rows.columns))
    return rows


def first_losses(docs: DataFrame, model: Model, rare: DataFrame) -> DataFrame:
    """(row, n, sum_target, sum_background) of ``docs`` (row, text), written out: the first losses of tokens with a rare word."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            ids, lengths, starts = _tokens(batch.column("text"), own.ids)
            before = befores(ids, starts)
            at = np.flatnonzero(np.maximum(before, ids) >= len(own.ids))
            row = np.repeat(np.asarray(batch.column("row")), lengths)[at]
            yield from _batches({"row": row, **own.revealed(before[at], ids[at])})

    tokens = _filled(docs.select("row", "text").mapInArrow(emit, f"row long, {REVEALED}"), rare)
    own = F.col("row").bitwiseAND(F.lit(1))
    sums = tokens.groupBy("row").agg(F.count("*").alias("n"), F.sum(model.column_loss("target", own)).alias("sum_target"), F.sum(model.column_loss("background", F.lit(1))).alias("sum_background"))
    return common.materialize(sums, "first-losses")


def bigrams(docs: DataFrame, model: Model) -> DataFrame:
    """(u, w, target, background): the counts of the bigrams of ``docs`` (text, is_target) that occur more than once, written out."""
    shared = docs.sparkSession.sparkContext.broadcast(model.ids)

    def make(batch: pa.RecordBatch) -> tuple:
        ids, lengths, starts = _tokens(batch.column("text"), shared.value)
        before = befores(ids, starts)
        return _cell(before, ids), before, ids, np.repeat(np.array(batch.column("is_target").to_pylist(), bool), lengths)

    def add(chunk: list) -> Iterator[pa.RecordBatch]:
        cell, before, word, target = (np.concatenate(x) for x in zip(*chunk))
        order = np.argsort(cell)
        cell = cell[order]
        at = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        sums = {"target": np.add.reduceat(target[order].astype(np.int64), at).astype(np.int32), "background": np.diff(np.append(at, len(cell))).astype(np.int32)}
        yield from _batches({"u": before[order[at]].view(np.int64), "w": word[order[at]].view(np.int64), **sums})

    parts = docs.select("text", "is_target").mapInArrow(lambda batches: _chunks(batches, make, add), "u long, w long, target int, background int")
    total = parts.repartition("u", "w").groupBy("u", "w").agg(F.sum("target").alias("target"), F.sum("background").alias("background"))
    return common.materialize(total.where("background > 1"), "bigrams")


SIDES = ("add_background", "add_target", "add_other")


def corrections(found: DataFrame, model: Model, rare: DataFrame) -> DataFrame:
    """(cell, background, SIDES) of the bigrams ``found``, written out: what their losses are above the first ones, under the
    background model, and under the target model in target documents and in others."""
    shared, n = found.sparkSession.sparkContext.broadcast(model), len(model.ids)

    def codes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return np.asarray(batch.column("u")).view(np.uint64), np.asarray(batch.column("w")).view(np.uint64)

    def correct(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            u, w = codes(batch)
            a, b = u.astype(np.int64), w.astype(np.int64)
            two, target = np.asarray(batch.column("background")), own.loss_of("target", np.asarray(batch.column("target")), a, b)
            added = own.loss_of("background", two, a, b) - own.loss_of("background", 1, a, b), target - own.loss_of("target", 1, a, b), target - own.loss_of("target", 0, a, b)
            yield from _batches({"cell": _cell(u, w), "background": two, **dict(zip(SIDES, added))})

    def reveal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, w = codes(batch)
            yield from _batches({"cell": _cell(u, w), "target": batch.column("target"), "background": batch.column("background"), **shared.value.revealed(u, w)})

    both = F.col("u").between(0, n - 1) & F.col("w").between(0, n - 1)
    near = found.where(both).mapInArrow(correct, "cell long, background long, " + ", ".join(f"{s} double" for s in SIDES))
    far = _filled(found.where(~both).mapInArrow(reveal, f"cell long, target long, background long, {REVEALED}"), rare)
    loss = model.column_loss
    added = loss("background", F.col("background")) - loss("background", F.lit(1)), loss("target", F.col("target")) - loss("target", F.lit(1)), loss("target", F.col("target")) - loss("target", F.lit(0))
    return common.materialize(near.union(far.select("cell", "background", *(c.alias(s) for c, s in zip(added, SIDES)))), "corrections")


def _totals(docs: DataFrame, model: Model, table: DataFrame, first: DataFrame, tokens: int) -> DataFrame:
    """(doc_id, n_tokens, losses) per row of ``docs`` (row, doc_id, text)."""
    often = F.col("background") * FREQUENT_BIGRAM >= tokens
    got = table.where(often).toArrow()  # FREQUENT_BIGRAM rows at most
    cell = np.asarray(got.column("cell"))
    order = np.argsort(cell)
    shared = docs.sparkSession.sparkContext.broadcast((model, cell[order], *(np.asarray(got.column(c))[order] for c in SIDES)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known, background, target, other = shared.value
        n = len(own.ids)
        for batch in batches:
            ids, lengths, starts = _tokens(batch.column("text"), own.ids)
            row, full = np.asarray(batch.column("row")), lengths > 0
            of = np.repeat(row, lengths)
            before = befores(ids, starts)
            cell, near = _cell(before, ids), np.maximum(before, ids) < n
            a, b = (np.where(near, x, 0).astype(np.int64) for x in (before, ids))
            at = np.minimum(np.searchsorted(known, cell), max(len(known) - 1, 0))
            hit = known[at] == cell if len(known) else np.zeros(len(cell), bool)
            added = _added(hit, at, of, background, target, other)
            losses = [np.where(near, own.loss_of(side, two, a, b), 0.0) + more for side, two, more in (("target", of & 1, added[1]), ("background", 1, added[0]))]
            sums = []
            for x in (*losses, (~near).astype(np.float64)):
                x_of = np.zeros(len(row))
                if len(ids):
                    x_of[full] = np.add.reduceat(x, starts)
                sums.append(x_of)
            # a list for each document: a number of its own, which meets nothing, then its tokens' bigrams that are not frequent
            left = np.zeros(len(row), np.int64)
            if len(ids):
                left[full] = np.add.reduceat((~hit).astype(np.int64), starts)
            edges = np.concatenate([[0], np.cumsum(left + 1)])
            values = np.empty(edges[-1], np.int64)
            own_place = np.zeros(len(values), bool)
            own_place[edges[:-1]] = True
            values[own_place], values[~own_place] = shingles.mix(row.astype(np.uint64)).view(np.int64), cell[~hit]
            lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column("row"), lists, batch.column("doc_id"), pa.array(lengths), pa.array(-sums[2].astype(np.int64)), pa.array(sums[0]), pa.array(sums[1])], COLUMNS)

    kinds = ["long", "array<long>", "long", "long", "long", "double", "double"]
    parts = docs.select("row", "doc_id", "text").mapInArrow(run, ", ".join(f"{c} {k}" for c, k in zip(COLUMNS, kinds)))
    tokens_of = parts.select("row", F.struct(*COLUMNS[2:]).alias("whole"), F.posexplode("cells").alias("at", "cell")).select("row", "cell", F.when(F.col("at") == 0, F.col("whole")).alias("own"))
    met = tokens_of.join(table.where(~often).drop("background").hint("shuffle_hash"), "cell", "left")
    added = F.when(F.col("row").bitwiseAND(F.lit(1)) == 1, F.col("add_target")).otherwise(F.col("add_other"))
    met = met.select("row", "own.doc_id", "own.n_tokens", "own.rare", F.coalesce("own.sum_target", added).alias("sum_target"), F.coalesce("own.sum_background", "add_background").alias("sum_background"))
    early = first.select("row", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("n_tokens"), F.col("n").alias("rare"), "sum_target", "sum_background")
    total = met.union(early).groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), *(F.sum(c).alias(c) for c in ("rare", "sum_target", "sum_background")))
    sound = F.when(F.col("rare") == 0, F.col("n_tokens")).otherwise(F.raise_error(F.lit("the documents came in other partitions in one step than in another: write them first")))
    total = total.withColumn("n_tokens", sound)
    mean = [F.when(F.col("n_tokens") > 0, F.col(f"sum_{s}") / F.col("n_tokens")).alias(f"loss_{s}") for s in ("target", "background")]
    return total.select("doc_id", "n_tokens", *mean).withColumn("loss_difference", F.col("loss_target") - F.col("loss_background"))


COLUMNS = ["row", "cells", "doc_id", "n_tokens", "rare", "sum_target", "sum_background"]


def _added(hit: np.ndarray, at: np.ndarray, of: np.ndarray, background: np.ndarray, target: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What frequent bigrams add under the background and the target model, at the tokens ``hit``."""
    out = np.zeros(len(hit)), np.zeros(len(hit))
    k = at[hit]
    out[0][hit], out[1][hit] = background[k], np.where(of[hit] & 1, target[k], other[k])
    return out


def score(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, loss_target, loss_background, loss_difference) per row of ``docs`` (doc_id, text), written out."""
    spark = docs.sparkSession
    own = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.files.minPartitionNum": str(spark.sparkContext.defaultParallelism)}
    with common.settings(spark, common.BATCHES | own):
        marks = target_ids.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("t", F.lit(True))
        few = marks.limit(common.BROADCAST_ROWS + 1).count() <= common.BROADCAST_ROWS
        met = common.texts(docs).join(F.broadcast(marks) if few else marks, "doc_id", "left").select("doc_id", "text", F.coalesce("t", F.lit(False)).alias("is_target"))
        rows = met if few else common.materialize(met, "marked")
        rows = rows.withColumn("row", F.monotonically_increasing_id() * 2 + F.col("is_target").cast("long"))
        counts = word_counts(rows)
        n_target, tokens, known = counts.agg(F.coalesce(F.sum("one_target"), F.lit(0)), F.coalesce(F.sum("one_background"), F.lit(0)), F.count_if(F.col("id") != 0)).first()
        often = (F.col("id") == 0) | (F.col("one_background") * FREQUENT_WORD >= tokens)
        model, rare = Model(counts.where(often).toArrow(), n_target, tokens, known + 1), counts.where(~often)
        first = first_losses(rows, model, rare)
        found = bigrams(rows, model)
        table = corrections(found, model, rare)
        common.discard(found, counts)
        out = None
        for k in range(SLICES):  # one after the other: the bigrams of one slice are on disk at a time
            own = F.pmod(F.shiftright("row", 1), F.lit(SLICES)) == k
            part = common.materialize(_totals(rows.where(own), model, table, first.where(own), tokens), "scores")
            out = part if out is None else out.union(part)
        common.discard(table, first)
        return out


def op7_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored against the documents labelled as of good quality."""
    good = common.table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return score(common.table(spark, sf_dir, "documents"), good)
