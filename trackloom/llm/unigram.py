"""Sentencepiece-style encoding by unigram Viterbi over a double-array trie, and decoding.

Pieces and their scores come from a sentencepiece model file: log probabilities if it holds a unigram model. The scores of
a BPE model (as the queries use) are negated merge ranks, which order pieces as the model does but aren't probabilities. Blanks become the white-space marker, and a text gets
one marker in front. The best segmentation has the largest sum of scores (exact in double precision); of equal sums
the one whose last piece starts first wins, position by position. A character that no one-character piece covers costs
the least score less ten and becomes its UTF-8 byte pieces.

No piece holds a marker after another character, so a text's best segmentation is that of its words (markers and what
follows them) put together. Words new to a worker go through the trie a batch at a time: all words of about one length
move in step, one array operation for a position and depth, not one call for each word. Words of over ``LONG`` bytes are
done one by one in time linear in their length.

Decoding joins the pieces, byte pieces as bytes (damaged UTF-8 becomes U+FFFD), turns markers into blanks and drops the
one put in front. So decode(encode(text)) is the text, but for markers in the text itself, which come back as blanks.

Defined results: a null or empty text has no ids and decodes to the empty text; null ids decode to the empty text; ids
outside the vocabulary raise; a null ``doc_id`` is kept; repeated rows each get a row; an empty table gives an empty
result.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from trackloom.llm import common
from trackloom.llm.token_counts import MARK, WORDS

LONG = 96


class DoubleArray:
    """A trie in two arrays: from state s, byte c leads to base[s] + c if check there is s. State 0 is the root."""

    def __init__(self, words: dict[bytes, int]):
        tree: dict = {}
        for w, v in words.items():
            node = tree
            for c in w:
                node = node.setdefault(c, {})
            node[-1] = v
        size = 1 << 18
        base, check, value = [0] * size, [-1] * size, [-1] * size
        used, first, todo = bytearray(size), 1, [(0, tree)]
        used[0] = 1
        while todo:
            state, node = todo.pop()
            value[state] = node.get(-1, -1)
            codes = sorted(c for c in node if c >= 0)
            if not codes:
                continue
            while used[first]:
                first += 1
            b = max(1, first - codes[0])
            while any(used[b + c] for c in codes):
                b += 1
            if b - first > 256:
                first = b  # what lies before is nearly full: leave its gaps
            if b + 512 >= len(used):
                more = len(used)
                used, base, check, value = used + bytearray(more), base + [0] * more, check + [-1] * more, value + [-1] * more
            base[state] = b
            for c in codes:
                used[b + c], check[b + c] = 1, state
                todo.append((b + c, node[c]))
        self.base, self.check, self.value = (np.array(x, np.int32) for x in (base, check, value))


class Vocabulary:
    """What encoding and decoding need of a model file; its size is that of the vocabulary, so it may be broadcast."""

    def __init__(self, path: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.vocab_size()
        normal = [i for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        pieces = [lib.id_to_piece(i) for i in range(n)]
        if any(MARK in pieces[i].lstrip(MARK) for i in normal):
            raise ValueError("a piece spans words")
        self.score = np.array([lib.get_score(i) for i in range(n)], np.float64)
        self.unknown = self.score[normal].min() - 10.0
        self.trie = DoubleArray({pieces[i].encode(): i for i in normal})
        self.width = np.uint16 if n <= 1 << 16 else np.int32
        self.bytes = np.array([lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)], self.width)
        self.out = [bytes([int(p[3:5], 16)]) if lib.is_byte(i) else b"" if lib.is_control(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]


class Encoder:
    def __init__(self, vocabulary: Vocabulary, cached: int = 150_000):
        self.v, self.seen, self.cached = vocabulary, {}, cached
        t = vocabulary.trie
        self.base, self.check, self.value, self.score = t.base, t.check, t.value, vocabulary.score
        self.lists = None

    def _together(self, words: list[bytes]) -> list[np.ndarray]:
        """Best ids of words of at most LONG bytes, position by position for all at once."""
        n, size = len(words), np.array([len(w) for w in words])
        longest = int(size.max())
        text = np.frombuffer(b"".join(w.ljust(longest, b"\0") for w in words), np.uint8).reshape(n, longest)
        width = np.where(text < 0x80, 1, np.where(text < 0xE0, 2, np.where(text < 0xF0, 3, 4)))
        best = np.full((n, longest + 1), -np.inf)
        best[:, 0] = 0
        back, piece = np.zeros((n, longest + 1), np.int32), np.full((n, longest + 1), -1, np.int32)
        for s in range(longest):
            start = np.flatnonzero((best[:, s] > -np.inf) & (size > s))
            if not len(start):
                continue
            single = np.zeros(n, bool)
            rows, state, d = start, np.zeros(len(start), np.int32), 0
            while len(rows):
                t = self.base[state] + text[rows, s + d]
                ok = self.check[t] == state
                rows, state = rows[ok], t[ok]
                d += 1
                v = self.value[state]
                hit = v >= 0
                r, v = rows[hit], v[hit]
                single[r[width[r, s] == d]] = True
                total = best[r, s] + self.score[v]
                up = total > best[r, s + d]
                r, v = r[up], v[up]
                best[r, s + d], back[r, s + d], piece[r, s + d] = total[up], s, v
                more = size[rows] > s + d
                rows, state = rows[more], state[more]
            r = start[~single[start]]
            end = np.minimum(s + width[r, s], size[r])
            total = best[r, s] + self.v.unknown
            up = total > best[r, end]
            r, end = r[up], end[up]
            best[r, end], back[r, end], piece[r, end] = total[up], s, -1
        ids, at, rows, k = np.zeros((n, longest), np.int32), size.copy(), np.arange(n), 0
        unknown = np.zeros(n, bool)
        while len(rows):
            p = piece[rows, at[rows]]
            ids[rows, k] = np.where(p >= 0, p, -(at[rows] * 256 + back[rows, at[rows]]) - 1)
            unknown[rows[p < 0]] = True
            at[rows] = back[rows, at[rows]]
            k += 1
            rows = rows[at[rows] > 0]
        count = (ids != 0).sum(axis=1)
        out = []
        for i in range(n):
            row = ids[i, : count[i]][::-1]
            if unknown[i]:
                row = np.concatenate([self.v.bytes[np.frombuffer(words[i], np.uint8)[(-x - 1) % 256 : (-x - 1) // 256]] if x < 0 else np.array([x], self.v.width) for x in row])
            out.append(row.astype(self.v.width))
        return out

    def _alone(self, word: bytes) -> np.ndarray:
        """Best ids of one word, in time linear in its length."""
        if self.lists is None:
            self.lists = [x.tolist() for x in (self.base, self.check, self.value, self.score)]
        base, check, value, score = self.lists
        n = len(word)
        best, back, piece = [-np.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for s in range(n):
            if best[s] == -np.inf:
                continue
            c = word[s]
            width, single, state = 1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4, False, 0
            for e in range(s, n):
                t = base[state] + word[e]
                if check[t] != state:
                    break
                state = t
                v = value[t]
                if v >= 0:
                    single = single or e + 1 - s == width
                    if best[s] + score[v] > best[e + 1]:
                        best[e + 1], back[e + 1], piece[e + 1] = best[s] + score[v], s, v
            if not single and best[s] + self.v.unknown > best[min(n, s + width)]:
                e = min(n, s + width)
                best[e], back[e], piece[e] = best[s] + self.v.unknown, s, -1
        out, e = [], n
        while e:
            out.append([piece[e]] if piece[e] >= 0 else self.v.bytes[np.frombuffer(word[back[e] : e], np.uint8)].tolist())
            e = back[e]
        return np.array([x for part in reversed(out) for x in part], self.v.width)

    def _learn(self, words: list[str]) -> None:
        raw = sorted(((len(b), b, w) for w in words if (b := (MARK + w).encode("utf-8", "replace"))), key=lambda x: x[0])
        short = [x for x in raw if x[0] <= LONG]
        for k in range(0, len(short), 8192):
            part = short[k : k + 8192]
            for (_, _, w), ids in zip(part, self._together([b for _, b, _ in part])):
                self.seen[w] = ids.tobytes()
        for _, b, w in raw[len(short) :]:
            self.seen[w] = self._alone(b).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        words = []
        for t in texts:
            if "  " in t or MARK in t or t[:1] == " ":
                words.append([w[1:] for w in WORDS.findall(MARK + t.replace(" ", MARK))])
            else:
                words.append(t.split(" ") if t else [])
        if len(self.seen) > self.cached:
            self.seen = {}
        self._learn(list(set().union(*words).difference(self.seen)))
        get = self.seen.__getitem__
        return [np.frombuffer(b"".join(map(get, w)), self.v.width) for w in words]


def decode_ids(ids: np.ndarray, out: list[bytes]) -> str:
    return b"".join(map(out.__getitem__, ids.tolist())).decode("utf-8", "replace").removeprefix(" ")


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _vocabulary(spark: SparkSession, model: str):
    """(broadcast vocabulary, key for the workers' cache): a few MB, bounded by the vocabulary's size."""
    return spark.sparkContext.broadcast(Vocabulary(model)), uuid.uuid4().hex


def _encoded(texts: list[str | None], enc: Encoder) -> tuple[list[np.ndarray], list[pa.Array]]:
    """Ids of each text, and the columns ids, n_byte_ids and ids_crc32."""
    ids = enc.encode([t or "" for t in texts])
    flat = np.concatenate([*ids, np.zeros(0, enc.v.width)])
    edges = np.cumsum([0, *map(len, ids)])
    is_byte = np.zeros(len(enc.score), bool)
    is_byte[enc.v.bytes] = True
    of_bytes = np.concatenate([[0], np.cumsum(is_byte[flat])])
    lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(flat.astype(np.int32)))
    sums = pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())
    return ids, [lists, pa.array(of_bytes[edges[1:]] - of_bytes[edges[:-1]], pa.int64()), sums]


IDS, SUMS = StructField("ids", ArrayType(IntegerType())), [StructField("n_byte_ids", LongType()), StructField("ids_crc32", LongType())]


def encode(docs: DataFrame, model: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, the columns ``keep``, ids array<int>, n_byte_ids, ids_crc32) per row; the checksum is of the ids as little-endian uint32."""
    common.small_batches(docs.sparkSession)
    shared, key = _vocabulary(docs.sparkSession, model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(_quoted(c)) for c in keep if c != "doc_id"), F.col("text").alias("text of a row"))
    names, codes_of = rows.columns[:-1], [IDS, *SUMS]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = common.worker_state(key, lambda: Encoder(shared.value))
        for batch in batches:
            _, codes = _encoded(batch.column(len(names)).to_pylist(), enc)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *codes], [f"c{k}" for k in range(len(names))] + [f.name for f in codes_of])

    return common.map_rows(rows, run, StructType([*rows.schema.fields[:-1], *codes_of]))


def round_trip(docs: DataFrame, model: str, keep_ids: bool = True) -> DataFrame:
    """``docs`` with ids array<int> (if ``keep_ids``), n_ids, n_byte_ids, ids_crc32 and round_trip: whether decoding the
    ids gives the text back, markers as blanks. Both ways in one step, so a task has one Python worker with one
    vocabulary. Columns of ``docs`` under these names are replaced."""
    common.small_batches(docs.sparkSession)
    shared, key = _vocabulary(docs.sparkSession, model)
    new = [*([IDS] if keep_ids else []), StructField("n_ids", LongType()), *SUMS, StructField("round_trip", BooleanType())]
    mine = {f.name for f in new}
    rows = docs.select(*(F.col(_quoted(c)) for c in docs.columns if c.lower() not in mine))
    names, at = rows.columns, rows.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = common.worker_state(key, lambda: Encoder(shared.value))
        for batch in batches:
            texts = batch.column(at).to_pylist()
            ids, (lists, n_bytes, sums) = _encoded(texts, enc)
            same = [decode_ids(x, enc.v.out) == (t or "").replace(MARK, " ") for x, t in zip(ids, texts)]
            n = pa.array([len(x) for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, *([lists] if keep_ids else []), n, n_bytes, sums, pa.array(same, pa.bool_())], [f"c{k}" for k in range(len(names))] + [f.name for f in new])

    return common.map_rows(rows, run, StructType([*rows.schema.fields, *new]))


def decode(encoded: DataFrame, model: str, into: str = "decoded") -> DataFrame:
    """``encoded`` with the column ``into``: the text of ``ids``."""
    shared, _ = _vocabulary(encoded.sparkSession, model)
    at = encoded.columns.index("ids")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = shared.value.out
        for batch in batches:
            ids = batch.column(at)
            flat, edges = np.asarray(ids.flatten()), np.concatenate([[0], np.cumsum([0 if n is None else n for n in ids.value_lengths().to_pylist()])]).astype(int)
            texts = [decode_ids(flat[a:b], out) for a, b in zip(edges, edges[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, into])

    return common.map_rows(encoded, run, StructType([*encoded.schema.fields, StructField(into, StringType())]))


def op8_unigram_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: ids' count, byte pieces, checksum, and whether decoding gives the text back (markers as blanks)."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    got = round_trip(common.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, keep_ids=False)
    return got.drop("text")
