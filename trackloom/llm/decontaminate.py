"""Benchmark decontamination by latent semantic retrieval, with sequence and answer checks.

1. Terms are the words of the benchmark items (lower-cased, outer punctuation off). One pass over all documents counts how
   often each occurs. Retrieval uses the terms that are rarer than one in ``COMMON`` passages, and each item's
   ``RAREST`` rarest whatever their counts; passages are windows of ``WINDOW`` words, half a window apart.
2. A randomised SVD gives the latent basis: with A the TF-IDF rows of the passages of the benchmark and of all documents,
   tasks add up A'(A G) for a random G and later A'(A Q); only matrices of terms x RANK are summed, and orthonormalised on
   the driver.
3. Every passage of every document is projected (sums of basis rows over half windows, so each word is looked up once)
   and compared with all benchmark passages in one matrix product; cosines of ``COSINE`` or more are candidates.
4. A candidate is checked word by word: the longest common subsequence of the item and stretches of the document about
   as long as the item. A document leaks an item if the subsequence holds ``LEAK`` of the item's words, or ``PARAPHRASE``
   of them together with the answer (the item's last sentence) and half of its rare words.

The benchmark is worked through in blocks of ``BLOCK`` items, so what is broadcast is bounded whatever its size.

Defined results: null or empty texts and items leak nothing and are never leaked; a null ``doc_id`` or ``item_id`` is
kept as it is; repeated rows of a document or item give the same pair once; empty tables give an empty result; other
columns are ignored, or kept by ``drop_leaks``, which keeps rows of a null ``doc_id``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import common

WINDOW, RANK, COSINE = 48, 64, 0.55
COMMON, RAREST = 50, 6
LEAK, PARAPHRASE, ANSWER, RARE = 0.75, 0.5, 0.75, 0.5
BLOCK, WORDS, SEEN = 2000, 1 << 15, 1 << 17
HALF = WINDOW // 2
EDGES = ".,;:!?\"'()[]|*#$%&<>"
_STRIP = EDGES.encode()


def tokens(text: str) -> list[bytes]:
    """Words of a text, A-Z lower-cased, outer punctuation off (a word of nothing else stays empty, to keep places)."""
    return [w.strip(_STRIP) for w in text.encode("utf-8", "replace").lower().split()]


@dataclass
class Item:
    item_id: int | None
    words: list[bytes]
    answer: list[bytes]
    distinct: frozenset[bytes]


class Seen(dict):
    """Term ids of words as they stand in texts, at most SEEN of them kept."""

    def __init__(self, terms: dict[bytes, int]) -> None:
        self.terms = terms

    def __missing__(self, word: bytes) -> int:
        k = self.terms.get(word.strip(_STRIP), -1)
        if len(self) < SEEN:
            self[word] = k
        return k


@dataclass
class Index:
    """What a task needs to search one block of items: bounded by BLOCK items."""

    items: list[Item]
    terms: dict[bytes, int]
    weight: dict[bytes, float] = field(default_factory=dict)  # of every item word
    idf: np.ndarray = field(default_factory=lambda: np.zeros(0))
    basis: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    passages: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    owner: np.ndarray = field(default_factory=lambda: np.zeros(0, int))
    seen: Seen | None = None

    def ids(self, words: list[bytes]) -> np.ndarray:
        get = self.terms.get
        return np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))

    def known(self, text: str) -> np.ndarray:
        """``ids`` of the ``tokens`` of a text, most of them looked up without taking the punctuation off."""
        if self.seen is None:
            self.seen = Seen(self.terms)
        words = text.encode("utf-8", "replace").lower().split()
        return np.fromiter(map(self.seen.__getitem__, words), np.int64, len(words))


def make_items(rows: list) -> list[Item]:
    out = []
    for item_id, text in rows:
        words = [w for w in tokens(text or "") if w]
        if words:
            parts = [p for p in re.split(r"[.\n]+", text) if p.split()]
            out.append(Item(item_id, words, [w for w in tokens(parts[-1] if len(parts) > 1 else "") if w], frozenset(words)))
    return out


def halves(batch_ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Known term ids of a batch, the half window of each, and each document's first half window (and the end)."""
    count = np.array([-(-len(x) // HALF) for x in batch_ids])
    first = np.concatenate([[0], np.cumsum(count)])
    half = np.concatenate([np.arange(len(x)) // HALF + f for x, f in zip(batch_ids, first)] or [np.zeros(0, int)])
    flat = np.concatenate([*batch_ids, np.zeros(0, np.int64)])
    known = flat >= 0
    return flat[known], half[known], first


def windows_of(first: np.ndarray) -> np.ndarray:
    """The first half window of each passage: a passage is two neighbouring halves, or the only one of a short document."""
    n = first[1:] - first[:-1]
    return np.concatenate([np.arange(f, f + max(1, k - 1)) for f, k in zip(first, n) if k] or [np.zeros(0, int)])


def _sums(values: np.ndarray, half: np.ndarray, n: int) -> np.ndarray:
    """Row sums of ``values`` by ``half`` (ascending): the first rows of all halves, then the second; a half has HALF words at most."""
    out = np.zeros((n, values.shape[1]), np.float32)
    at = np.flatnonzero(np.diff(half, prepend=-1))
    place = np.arange(len(half)) - np.repeat(at, np.diff(np.append(at, len(half))))
    for k in range(place.max(initial=-1) + 1):
        nth = np.flatnonzero(place == k)
        out[half[nth]] += values[nth]
    return out


def project(index: Index, batch_ids: list[np.ndarray], matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """TF-IDF passages times ``matrix``, and for each passage its document and its first word."""
    flat, half, first = halves(batch_ids)
    h = _sums((matrix * index.idf[:, None]).astype(np.float32)[flat], half, int(first[-1]))
    w = windows_of(first)
    doc = np.searchsorted(first, w, side="right") - 1
    paired = w + 1 < first[doc + 1]
    v = h[w]
    v[paired] += h[w[paired] + 1]
    return v, doc, (w - first[doc]) * HALF


def _gram_times(index: Index, batch_ids: list[np.ndarray], m: np.ndarray) -> np.ndarray:
    """A'(A m) over the passages of a batch, A their normalised TF-IDF rows; some WORDS words at a time.

    A passage's row times ``m`` is the sum of its two halves', over its norm; what a passage gives back goes to the terms of both.
    """
    out, right = np.zeros(m.shape), (m * index.idf[:, None]).astype(np.float32)
    upto = np.cumsum([len(x) for x in batch_ids]) // WORDS
    for part in np.split(np.arange(len(batch_ids)), np.flatnonzero(np.diff(upto)) + 1):
        flat, half, first = halves([batch_ids[k] for k in part])
        if not len(flat):
            continue
        n = int(first[-1])
        key, count = np.unique(half * len(index.terms) + flat, return_counts=True)
        half, term = np.divmod(key, len(index.terms))
        weight = count * index.idf[term]
        in_next = np.minimum(np.searchsorted(key, key + len(index.terms)), len(key) - 1)
        also = key[in_next] == key + len(index.terms)
        own = np.bincount(half, weight * weight, n)
        shared = np.bincount(half, np.where(also, 2 * weight * weight[in_next], 0.0), n)  # with the half behind
        h = _sums(right[term] * count[:, None].astype(np.float32), half, n)
        w = windows_of(first)
        paired = w[w + 1 < first[np.searchsorted(first, w, side="right")]]
        alone = w[w + 1 >= first[np.searchsorted(first, w, side="right")]]
        norm = np.maximum(own[paired] + own[paired + 1] + shared[paired], 1e-30)[:, None]
        v, back = (h[paired] + h[paired + 1]) / norm.astype(np.float32), np.zeros((n, m.shape[1]), np.float32)
        back[paired] = v
        back[paired + 1] += v
        back[alone] = h[alone] / np.maximum(own[alone], 1e-30)[:, None]
        order = np.argsort(term, kind="stable")
        at = np.flatnonzero(np.diff(term[order], prepend=-1))
        out[term[order][at]] += np.add.reduceat(back[half[order]] * weight[order, None].astype(np.float32), at, axis=0)
    return out


def _frequency(docs: DataFrame, terms: dict[bytes, int]) -> tuple[np.ndarray, int]:
    n_terms, shared = len(terms), docs.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, index = np.zeros(n_terms, np.int64), 0, Index([], shared.value)
        for batch in batches:
            for t in batch.column("text").to_pylist():
                x = index.known(t)
                df += np.bincount(x[x >= 0], minlength=n_terms)
                n += -(-len(x) // HALF)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], ["term", "n"])

    rows = docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df, total = np.zeros(n_terms), 1
    for r in rows:
        if r.term < 0:
            total = max(1, r.n)
        else:
            df[r.term] = r.n
    return df, total


def _sum_over(docs: DataFrame, index: Index, m: np.ndarray) -> np.ndarray:
    """A'(A m) over the passages of ``docs``: tasks send blocks of rows, which Spark adds up."""
    shared = docs.sparkSession.sparkContext.broadcast((index, m))

    def part(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, right = shared.value
        total = np.zeros(right.shape)
        for batch in batches:
            total += _gram_times(own, [own.known(t) for t in batch.column("text").to_pylist()], right)
        at = np.flatnonzero(total.any(axis=1))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * right.shape[1]), pa.array(total[at].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(at), lists], ["term", "v"])

    rows = docs.select("text").mapInArrow(part, "term long, v array<double>")
    added = rows.groupBy("term").agg(F.array(*(F.sum(F.col("v")[k]) for k in range(m.shape[1]))).alias("v"))
    out = np.zeros(m.shape)
    for r in added.collect():  # one row for each term
        out[r.term] = r.v
    return out


def build_index(docs: DataFrame, items: list[Item]) -> Index:
    """Term weights over all documents, and the latent basis by randomised SVD."""
    every = {w: k for k, w in enumerate(dict.fromkeys(w for i in items for w in i.words))}
    count, n = _frequency(docs, every)
    weight = np.log((n + 1) / (np.minimum(count, n) + 1)) + 1e-3
    rare = {w for w, k in every.items() if count[k] * COMMON <= n}
    rare |= {w for i in items for w in sorted(set(i.words), key=lambda w: (count[every[w]], w))[:RAREST]}
    terms = {w: k for k, w in enumerate(w for w in every if w in rare)}
    index = Index(items, terms, {w: float(weight[k]) for w, k in every.items()}, np.array([weight[every[w]] for w in terms]))
    own = [index.ids(i.words) for i in items]
    rank = min(RANK, len(terms))
    q = np.random.default_rng(3).standard_normal((len(terms), rank))
    for _ in range(2):
        # the benchmark's passages weigh as much as the corpus's, else rare items would be lost below the cut
        mine, theirs = _gram_times(index, own, q), _sum_over(docs, index, q)
        scale = np.linalg.norm(mine) / max(np.linalg.norm(theirs), 1e-9)
        q, _ = np.linalg.qr(mine + min(1.0, scale) * theirs)
    index.basis = q.astype(np.float32)
    parts = [(k, x[s : s + HALF]) for k, x in enumerate(own) for s in range(0, max(1, len(x) - HALF // 2), HALF)]
    v, doc, _ = project(index, [x for _, x in parts], index.basis)
    norm = np.linalg.norm(v, axis=1)
    index.passages, index.owner = v[norm > 0] / norm[norm > 0, None], np.array([k for k, _ in parts])[doc][norm > 0]
    return index


def lcs(item: list[bytes], stretch: list[bytes], places: dict[bytes, int] | None = None) -> int:
    """Length of the longest common subsequence, on bits of one integer."""
    if places is None:
        places = {}
        for k, w in enumerate(item):
            places[w] = places.get(w, 0) | 1 << k
    full = (1 << len(item)) - 1
    row = full
    for w in stretch:
        m = places.get(w, 0)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(item) - row.bit_count()


def check(item: Item, words: list[bytes], at: int, index: Index) -> tuple[float, float] | None:
    """(share of the item in sequence, share of its answer) if the document leaks the item around word ``at``."""
    n = len(item.words)
    region = words[max(0, at - n) : at + WINDOW + n]
    own = item.distinct
    found = own.intersection(region)
    if len(found) < PARAPHRASE * len(own):
        return None
    weight = index.weight
    if sum(weight[w] for w in found) < RARE * sum(weight[w] for w in own):
        return None
    places: dict[bytes, int] = {}
    for k, w in enumerate(item.words):
        places[w] = places.get(w, 0) | 1 << k
    size, step = n + max(2, n // 4), max(1, n // 6)
    best = max((lcs(item.words, region[s : s + size], places), -s) for s in range(0, max(1, len(region) - size + step), step))
    share = best[0] / n
    stretch = region[-best[1] : -best[1] + size]
    answer = lcs(item.answer, stretch) / len(item.answer) if item.answer else 0.0
    if share >= LEAK or share >= PARAPHRASE and answer >= ANSWER:
        return share, answer
    return None


def search(docs: DataFrame, index: Index) -> DataFrame:
    """(doc_id, item_id, cosine, sequence_share, answer_share), a pair once per document row."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        basis = own.basis
        for batch in batches:
            ids, texts, out = batch.column("doc_id").to_pylist(), [tokens(t) for t in batch.column("text").to_pylist()], []
            v, doc, at = project(own, [own.ids(w) for w in texts], basis)
            norm = np.maximum(np.linalg.norm(v, axis=1), 1e-12)
            best: dict[tuple[int, int], tuple] = {}
            for k in range(0, len(v), 4096):
                cosine = (v[k : k + 4096] / norm[k : k + 4096, None]) @ own.passages.T
                seen = set()
                for r, p in zip(*np.nonzero(cosine >= COSINE)):
                    d, i = int(doc[k + r]), int(own.owner[p])
                    if (r, i) not in seen:
                        seen.add((r, i))
                        got = check(own.items[i], texts[d], int(at[k + r]), own)
                        if got and ((d, i) not in best or (got, float(cosine[r, p])) > best[d, i]):
                            best[d, i] = (got, float(cosine[r, p]))
            for (d, i), ((share, answer), c) in best.items():
                out.append((ids[d], own.items[i].item_id, c, share, answer))
            yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()))], ["doc_id", "item_id", "cosine", "sequence_share", "answer_share"])

    return docs.mapInArrow(run, "doc_id long, item_id long, cosine double, sequence_share double, answer_share double")


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, cosine, sequence_share, answer_share): the documents that leak benchmark items."""
    common.small_batches(docs.sparkSession)
    docs, out, block = common.texts(docs), None, []

    def searched(rows: list) -> DataFrame | None:
        items = make_items(rows)
        return search(docs, build_index(docs, items)) if items else None

    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct().orderBy("item_id", "text").toLocalIterator():
        block.append((r.item_id, r.text))
        if len(block) == BLOCK:
            part, block = searched(block), []
            out = part if out is None else out.union(part) if part is not None else out
    part = searched(block)
    out = part if out is None else out.union(part) if part is not None else out
    if out is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, cosine double, sequence_share double, answer_share double")
    return out.groupBy("doc_id", "item_id").agg(F.max("cosine").alias("cosine"), F.max("sequence_share").alias("sequence_share"), F.max("answer_share").alias("answer_share"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that leak an item; all columns stay."""
    bad = common.materialize(find_leaks(docs, benchmark).where("doc_id is not null").select("doc_id").distinct(), "leaks")
    return common.without(docs, bad)


def op1_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that leak benchmark items, with the items and the evidence."""
    return find_leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
