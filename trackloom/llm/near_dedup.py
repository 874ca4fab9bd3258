"""Near-duplicate components by banded MinHash with sequential Bayesian verification.

1. One pass over the texts gives each document its set size, a fingerprint of its shingle set, band keys and a
   signature of 16-bit minima. Documents with equal sets form one class; its smallest id stands for it from here on,
   so copies cost one row each and are never paired.
2. Star round: in each bucket (documents with an equal band key) every member is paired with the bucket's smallest id
   only.
3. Verification: signatures are compared batch by batch. After m minima with k matches and a uniform prior, the chance
   that the similarity reaches the threshold is P(Binomial(m + 1, threshold) <= k); a pair is pruned once this falls
   under ``miss``. Survivors are settled on their full shingle sets, hashed to 64 bits.
4. Components of the links so far. Then some more star rounds: what isn't yet in a bucket's largest component is paired
   with one other member of that, picked by a hash; so most of a group of near copies is one component after a number of
   comparisons in proportion to its members.
5. The pairs of a bucket that still lie in different components and weren't compared are verified too, after a first look
   at one-bit minima inside the join; a large component and the documents beside it are compared block against block.
   After this each pair of a bucket is in one component or was compared, as if all pairs had been. Documents whose
   similarities lie just under the threshold all around have no shorter proof: each must be held against all that share a
   bucket with it. No step compares sets whose sizes alone rule the threshold out.
Chance to miss a pair at the threshold: (1 - t^rows)^bands, 5e-6 for 40 bands of 6 at 0.8, plus ``miss``.

Defined results: no words or null text: empty set, linked with nothing; fewer words than a shingle: the whole sequence
is one shingle; rows that repeat a ``doc_id`` are one document and stay or go together; a null ``doc_id`` is linked with
nothing, its ``component_id`` is null and it is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import common
from trackloom.llm.components import components, merged
from trackloom.llm.shingles import mix, shingle_set

SEED = 7
#: Components of at least LARGE members in unsettled buckets are compared block by block, in blocks of about BLOCK.
LARGE, BLOCK = 32, 64
#: Bytes of shingle sets in a block, about; and star rounds after the first.
BLOCK_BYTES, ROUNDS = 2 << 20, 2
#: Bytes of signatures or sets that are sent to all executors rather than shuffled together with the pairs.
SENT_BYTES = 8 << 20
SIGNED = "doc_id long, n_shingles long, set_key binary, bands array<long>, sig binary, b0 long, b1 long"
#: One-bit minima in the two bit columns: the first batch of the sequential test, made where candidates are joined.
BITS = 128


def _hashes(bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    n = bands * rows
    return rng.integers(0, 1 << 32, n, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, np.uint32)


def signature(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The minimum of each of the hash functions a * x + b modulo 2^32 over a set."""
    low, out = (x >> np.uint64(32)).astype(np.uint32), np.full(len(a), 0xFFFFFFFF, np.uint32)
    for k in range(0, len(low), 1024):
        np.minimum(out, (low[k : k + 1024, None] * a + b).min(axis=0), out=out)
    return out


def least_matches(m: int, t: float, miss: float) -> int:
    """The fewest matches among ``m`` minima with which a pair may still reach similarity ``t``."""
    total, k = 0.0, 0
    while True:
        total += math.comb(m + 1, k) * t**k * (1 - t) ** (m + 1 - k)
        if total >= miss or k >= m:
            return k
        k += 1


def _signed(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    a, b = _hashes(bands, rows)
    weights = mix(np.arange(1, bands * rows + 1, dtype=np.uint64)).reshape(bands, rows) | np.uint64(1)
    salt = mix(np.arange(bands, dtype=np.uint64) + np.uint64(1 << 40))

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, sigs = [], [], []
            for text in batch.column("text").to_pylist():
                x = shingle_set(text, shingle)
                sizes.append(len(x))
                keys.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None)
                sigs.append(signature(x, a, b))
            m = np.array(sigs, np.uint32).reshape(-1, bands * rows)
            key = mix((m.reshape(-1, bands, rows).astype(np.uint64) * weights).sum(axis=2, dtype=np.uint64) + salt).view(np.int64)
            full = np.array(sizes, np.int64) > 0
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(full * bands)]), pa.int32()), pa.array(key[full].ravel()))
            cut = m.astype("<u2")
            sig = pa.array([row.tobytes() if f else None for row, f in zip(cut, full)], pa.binary())
            bits = np.packbits(m[:, :BITS] & 1, axis=1)
            bits = np.pad(bits, ((0, 0), (0, BITS // 8 - bits.shape[1]))).view("<i8")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), lists, sig, pa.array(bits[:, 0].copy()), pa.array(bits[:, 1].copy())], ["doc_id", "n_shingles", "set_key", "bands", "sig", "b0", "b1"])

    return common.texts(docs).mapInArrow(sign, SIGNED)


def _restricted(big: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``big`` whose doc_id is in ``ids``: by broadcast if those are few enough, else by a shuffle."""
    small = ids.limit(common.BROADCAST_ROWS + 1).count() <= common.BROADCAST_ROWS
    return big.join(F.broadcast(ids) if small else ids, "doc_id", "left_semi")


def _verified(pairs: DataFrame, signed: DataFrame, docs: DataFrame, shingle: int, num: int, den: int, miss: float) -> DataFrame:
    """The ``pairs`` (lo, hi) whose sets reach the similarity num / den."""

    def prune(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(batch.num_rows, -1) for c in ("sig_lo", "sig_hi"))
            alive, matches = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for at in range(0, x.shape[1], 16):
                matches = matches + (x[alive, at : at + 16] == y[alive, at : at + 16]).sum(axis=1)
                stay = matches >= least_matches(min(at + 16, x.shape[1]), num / den, miss)
                alive, matches = alive[stay], matches[stay]
            yield batch.select(["lo", "hi"]).take(pa.array(alive))

    def exact(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (p, q) in enumerate(zip(batch.column("set_lo").to_pylist(), batch.column("set_hi").to_pylist())):
                both = np.intersect1d(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), assume_unique=True).size
                if den * both >= num * (len(p) // 8 + len(q) // 8 - both):
                    keep.append(i)
            yield batch.select(["lo", "hi"]).take(pa.array(keep, pa.int64()))

    def with_both(p: DataFrame, of: DataFrame, name: str) -> DataFrame:
        few = (of.agg(F.sum(F.octet_length("of"))).first()[0] or 0) <= SENT_BYTES
        for side in ("lo", "hi"):
            one = of.select(F.col("doc_id").alias(side), F.col("of").alias(f"{name}_{side}"))
            p = p.join(F.broadcast(one) if few else one, side)
        return p

    def ends(p: DataFrame) -> DataFrame:
        return p.select(F.col("lo").alias("doc_id")).union(p.select("hi")).distinct()

    sigs = common.materialize(_restricted(signed.select("doc_id", F.col("sig").alias("of")), ends(pairs)), "sigs")
    live = common.materialize(with_both(pairs, sigs, "sig").mapInArrow(prune, "lo long, hi long"), "live")
    full = common.materialize(_restricted(common.texts(docs), ends(live)).mapInArrow(_sets(shingle), "doc_id long, of binary"), "sets")
    return common.materialize(with_both(live, full, "set").mapInArrow(exact, "lo long, hi long").distinct(), "links")


def _open_buckets(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, node, n, label, major): members of the buckets that hold several components, written out; ``major`` has most members."""
    marked = common.materialize(shared.join(labels, "node", "left").select("key", "node", "n", F.coalesce("label", "node").alias("label")).distinct(), "marked")
    counts = marked.groupBy("key", "label").agg(F.count("*").alias("n"))
    major = common.materialize(counts.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("major"), F.count("*").alias("labels")).where("labels > 1").select("key", "major"), "major")
    return common.materialize(marked.join(major, "key"), "open")


def _sets(shingle: int):
    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = [shingle_set(t, shingle).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s, pa.binary())], ["doc_id", "of"])

    return sets


def _fits(a: str, b: str, num: int, den: int) -> Column:
    """Whether sets of these sizes can reach the similarity num / den."""
    return den * F.least(a, b) >= num * F.greatest(a, b)


def _pairs(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).distinct()


def _beside_large(open_rows: DataFrame, large: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(label, node) of the ``large`` components' members, and of the nodes of others that share a bucket with them."""
    members = open_rows.join(large, "label").select("label", "node").distinct()
    held = open_rows.join(large, "label").select("key", F.col("label").alias("big")).distinct()
    other = open_rows.select("key", "node", "label").join(large.select("label", F.lit(True).alias("is_big")), "label", "left")
    beside = other.join(held, "key").where("label <> big and (is_big is null or big < label)").select(F.col("big").alias("label"), "node").distinct()
    return common.materialize(members, "members"), common.materialize(beside, "beside")


def _against_large(members: DataFrame, beside: DataFrame, signed: DataFrame, docs: DataFrame, shingle: int, num: int, den: int, miss: float) -> DataFrame:
    """Links of the nodes ``beside`` large components with the ``members`` and with each other.

    Members and nodes are dealt into blocks of about BLOCK; a row holds two blocks, whose pairs are compared by
    signature and then by set in one go. So a large component and its many near misses cost a row for each pair of
    blocks, not for each pair of documents.
    """
    spark = docs.sparkSession
    members = common.materialize(members.union(beside).distinct(), "members")
    need = members.select(F.col("node").alias("doc_id")).union(beside.select("node")).distinct()
    need = common.materialize(need, "need")
    full = _restricted(common.texts(docs), need).mapInArrow(_sets(shingle), "doc_id long, of binary")
    of = common.materialize(full.join(_restricted(signed.select("doc_id", "sig"), need), "doc_id").select(F.col("doc_id").alias("node"), "sig", "of").dropDuplicates(["node"]), "block-sets")
    size = F.greatest(F.count("*") / BLOCK, F.sum(F.octet_length("of")) / BLOCK_BYTES)
    parts = lambda df, n: df.join(of, "node").groupBy("label").agg(F.ceil(size).cast("int").alias(n))
    count = common.materialize(parts(members, "m_parts").join(parts(beside, "x_parts"), "label"), "block-counts")

    def blocks(df: DataFrame, n: str, no: str, name: str) -> DataFrame:
        rows = df.join(count, "label").join(of, "node").withColumn(no, F.pmod(F.xxhash64("node"), F.col(n)).cast("int"))
        return rows.groupBy("label", no, "m_parts").agg(F.collect_list(F.struct("node", "sig", "of")).alias(name))

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for xs, ms in zip(batch.column("xs").to_pylist(), batch.column("ms").to_pylist()):
                sig = np.frombuffer(b"".join(m["sig"] for m in ms), "<u2").reshape(len(ms), -1)
                least = least_matches(sig.shape[1], num / den, miss)
                sets = [np.frombuffer(m["of"], np.uint64) for m in ms]
                sizes = np.array([len(y) for y in sets])
                for x in xs:
                    own = np.frombuffer(x["of"], np.uint64)
                    near = np.flatnonzero(den * np.minimum(sizes, own.size) >= num * np.maximum(sizes, own.size))
                    for j in near[(sig[near] == np.frombuffer(x["sig"], "<u2")).sum(axis=1) >= least]:
                        both = np.intersect1d(own, sets[j], assume_unique=True).size
                        if x["node"] != ms[j]["node"] and den * both >= num * (own.size + sets[j].size - both):
                            out.append(sorted((x["node"], ms[j]["node"])))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], ["lo", "hi"])

    ms = common.materialize(blocks(members, "m_parts", "m_no", "ms").drop("m_parts"), "m-blocks")
    xs = common.materialize(blocks(beside, "x_parts", "x_no", "xs"), "x-blocks")
    pairs = xs.select("label", "xs", F.explode(F.sequence(F.lit(0), F.col("m_parts") - 1)).alias("m_no")).join(ms, ["label", "m_no"])
    with common.settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "4"}):  # a row holds two blocks
        return common.materialize(pairs.select("xs", "ms").mapInArrow(compare, "lo long, hi long").distinct(), "links")


def near_duplicates(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, bands: int = 40, rows: int = 6, miss: float = 1e-6, compared_pairs: dict | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs`` (doc_id, text).

    ``compared_pairs``, if given, gets the number of pairs whose signatures each step compares.
    """
    common.small_batches(docs.sparkSession)
    fits = lambda a, b: _fits(a, b, num, den)
    verify = lambda pairs: _verified(pairs, signed, docs, shingle, num, den, miss)
    signed = common.materialize(_signed(docs, shingle, bands, rows), "signed")
    named = signed.where("doc_id is not null and set_key is not null")
    classes = common.materialize(named.groupBy("set_key").agg(F.min("doc_id").alias("node")), "classes")
    reps = named.select("doc_id", "set_key", "n_shingles", "bands").join(classes.withColumnRenamed("node", "doc_id"), ["set_key", "doc_id"], "left_semi")
    buckets = reps.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    heads = common.materialize(buckets.groupBy("key").agg(F.min(F.struct("node", "n")).alias("head"), F.max("node").alias("last")).where("head.node < last").select("key", F.col("head.node").alias("head"), F.col("head.n").alias("head_n")), "heads")
    shared = common.materialize(buckets.join(heads, "key"), "buckets")
    stars = common.materialize(_pairs(shared.where((F.col("node") > F.col("head")) & fits("n", "head_n")), "head", "node"), "stars")
    links, compared = verify(stars), stars
    labels = components(links)
    open_rows = _open_buckets(shared, labels)
    for turn in range(ROUNDS):
        best = open_rows.where("label = major").groupBy("key").agg(F.min_by(F.struct("node", "n"), F.struct(F.xxhash64(F.lit(turn), "node"), "node")).alias("h"))
        best = best.select("key", F.col("h.node").alias("head"), F.col("h.n").alias("head_n"))
        more = _pairs(open_rows.where("label <> major").join(best, "key").where(fits("n", "head_n")), "head", "node").join(compared, ["lo", "hi"], "left_anti")
        more = common.materialize(more, "stars")
        found = verify(more)
        compared = compared.union(more)
        if found.isEmpty():
            break
        labels = merged(labels, found)
        open_rows = _open_buckets(shared, labels)

    # all pairs of a bucket that are still in different components and weren't compared
    large = common.materialize(open_rows.groupBy("label").agg(F.count_distinct("node").alias("nodes")).where(F.col("nodes") >= LARGE).select("label"), "large")
    all_open, open_rows = open_rows, open_rows.join(large, "label", "left_anti")
    members, beside = _beside_large(all_open, large)
    near = beside.groupBy("node").agg(F.min("label").alias("big"))
    of = _restricted(signed.select("doc_id", "b0", "b1"), open_rows.select(F.col("node").alias("doc_id")).distinct())
    open_rows = common.materialize(open_rows.join(of.withColumnRenamed("doc_id", "node").dropDuplicates(["node"]), "node").join(near, "node", "left"), "open-bits")
    # one-bit minima of a pair differ with chance (1 - similarity) / 2 each; most pairs that merely share a passage stop here
    bits = min(BITS, bands * rows)
    apart = bits - least_matches(bits, (1 + num / den) / 2, miss)
    # two nodes beside one large component meet in its blocks
    minor = open_rows.where("label <> major").select("key", F.col("node").alias("p"), F.col("n").alias("p_n"), F.col("label").alias("p_label"), F.col("b0").alias("p0"), F.col("b1").alias("p1"), F.col("big").alias("p_big"))
    close = F.bit_count(F.col("p0").bitwiseXOR(F.col("b0"))) + F.bit_count(F.col("p1").bitwiseXOR(F.col("b1"))) <= apart
    cross = minor.join(open_rows, (minor.key == open_rows.key) & (F.col("p_label") != F.col("label")) & ((F.col("label") == F.col("major")) | (F.col("p") < F.col("node"))) & fits("p_n", "n") & F.coalesce(F.col("p_big") != F.col("big"), F.lit(True)) & close)
    rest = common.materialize(_pairs(cross, "p", "node").join(compared, ["lo", "hi"], "left_anti"), "rest")
    if not rest.isEmpty():
        labels = merged(labels, verify(rest))
    if not large.isEmpty():
        labels = merged(labels, _against_large(members, beside, signed, docs, shingle, num, den, miss))
    if compared_pairs is not None:
        groups = members.groupBy("label").agg(F.count("*").alias("m")).join(beside.groupBy("label").agg(F.count("*").alias("x")), "label")
        blocks = groups.agg(F.coalesce(F.sum((F.col("m") + F.col("x")) * F.col("x")), F.lit(0))).first()[0]
        compared_pairs.update(stars=compared.count(), rest=rest.count(), blocks=blocks)

    named_class = common.materialize(classes.join(labels, "node", "left").select("set_key", F.coalesce("label", "node").alias("component_id")), "named")
    out = signed.select("doc_id", "n_shingles", "set_key").join(named_class, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets have similarity 0.8 or more."""
    return near_duplicates(common.table(spark, sf_dir, "documents"), shingle=4)


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that are not their component's smallest id; all columns stay."""
    gone = near_duplicates(docs, **options).where("not kept").select("doc_id").distinct()
    return common.without(docs, common.materialize(gone, "gone"))
