"""Token-id output as length-delimited binary records with a separate offset index.

A record file is a run of frames. A frame is::

    uint64 length | uint32 masked CRC-32C of those 8 bytes | payload | uint32 masked CRC-32C of the payload

all little-endian; the mask is the rotation by 15 bits plus a constant that record formats of this kind use, so that
a checksum of data holding checksums stays strong. A payload is ``int64 doc_id | uint8 doc_id is null | uint8 bytes per
id (2 or 4) | ids``. Ids take two bytes if the vocabulary fits. Files hold documents in ascending ``doc_id`` order, file
by file. The index, a Parquet table beside the files, has one row per frame (file, byte offset and length, token
count, tokens before it in its file), so a reader can fetch any frame in any order.

A task writes a file of its own under a name that no other attempt uses; only files that the index names count, so
lost or repeated tasks leave no wrong data. Writing goes through ``pyarrow.fs``, to any store that it knows.

Defined results: a null text counts as empty (the frame holds only the end id); a null ``doc_id`` sorts first; repeated
rows each get a frame; an empty table gives an empty index; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.llm import common

#: Fixed values of the framing: the reflected Castagnoli polynomial and the mask's constant.
CASTAGNOLI = 0x82F63B78
MASK_DELTA = 0xA282EAD8

HEAD = struct.Struct("<qBB")
INDEX = "file string, file_no int, doc_id long, offset long, length long, n_tokens long, first_token long"
BLOCK = 64
_STATE: dict = {}


def _crc_tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """The 16-bit step table, and four byte tables that move a checksum past BLOCK zero bytes."""
    if "crc" not in _STATE:
        v = np.arange(1 << 16, dtype=np.uint32)
        for _ in range(16):
            v = np.where(v & 1, (v >> 1) ^ np.uint32(CASTAGNOLI), v >> 1).astype(np.uint32)

        def past_block(x: np.ndarray) -> np.ndarray:
            for _ in range(BLOCK // 2):
                x = v[x & 0xFFFF] ^ (x >> 16)
            return x

        _STATE["crc"] = v, [past_block(np.arange(256, dtype=np.uint32) << np.uint32(8 * k)) for k in range(4)]
    return _STATE["crc"]


def crc32c(parts: list[bytes]) -> np.ndarray:
    """CRC-32C of each byte string, all strings at once: blocks in parallel, then joined along each string."""
    step, skip = _crc_tables()
    if not parts:
        return np.zeros(0, np.uint32)
    sizes = np.array([len(p) for p in parts])
    long = np.maximum(sizes, 4)  # a register of ones is four inverted first bytes; shorter strings are done singly below
    blocks = -(-long // BLOCK)
    ends = np.cumsum(blocks)
    data = np.zeros(int(ends[-1]) * BLOCK, np.uint8)
    for p, end, n in zip(parts, ends * BLOCK, sizes):
        if n >= 4:
            at = end - n  # zeros in front leave a zero register as it is
            data[at:end] = np.frombuffer(p, np.uint8)
            data[at : at + 4] ^= 0xFF
    words = data.view("<u2").reshape(-1, BLOCK // 2)
    crc = np.zeros(len(words), np.uint32)
    for k in range(BLOCK // 2):
        crc = step[(crc ^ words[:, k]) & 0xFFFF] ^ (crc >> 16)
    order = np.argsort(-blocks, kind="stable")
    first, count = (ends - blocks)[order], blocks[order]
    total = np.zeros(len(parts), np.uint32)
    for k in range(int(count[0])):
        live = int(np.searchsorted(-count, -k, side="left"))
        t = total[:live]
        total[:live] = skip[0][t & 255] ^ skip[1][(t >> 8) & 255] ^ skip[2][(t >> 16) & 255] ^ skip[3][t >> 24] ^ crc[first[:live] + k]
    out = np.empty(len(parts), np.uint32)
    out[order] = total ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(sizes < 4):
        c = 0xFFFFFFFF
        for b in parts[i]:
            c ^= b
            for _ in range(8):
                c = (c >> 1) ^ (CASTAGNOLI if c & 1 else 0)
        out[i] = c ^ 0xFFFFFFFF
    return out


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK_DELTA)


class PretokenEncoder:
    """Encodes whole texts with a tokenizer file of the tokenizers library, remembering the ids of each chunk.

    A byte-level pre-tokenizer splits at every edge between white space and other characters, but for one blank that
    goes with what follows, and between letters and such marks as a comma; so a text is encoded chunk by chunk and each
    new chunk goes through the library once. A chunk of Latin letters is one pre-token, so the library's merge model
    takes it as it is; other chunks go through the library's whole chain.
    Texts that hold an added token's string, or one of the control characters that ``re`` and the library class
    differently, and tokenizers of any other kind go through the library whole.
    """

    LETTERS = " ?[A-Za-zÀ-ÖØ-öø-ɏ]+"
    CHUNK = re.compile(LETTERS + r"(?=[\s.,|!&%$*#]|\Z)| ?\S+|\s+(?!\S)|\s+")
    PLAIN = re.compile(LETTERS)
    ODD = re.compile("[\x1c-\x1f]")

    def __init__(self, path: str, cached: int = 500_000):
        from tokenizers import Tokenizer

        self.lib, spec = Tokenizer.from_file(path), json.load(open(path))
        pre = spec.get("pre_tokenizer") or {}
        self.chunked = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True) and not spec.get("normalizer")
        added = [x["content"] for x in spec.get("added_tokens", [])]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.dtype = np.dtype("<u2") if self.lib.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.kind = "H" if self.dtype.itemsize == 2 else "I"
        own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]  # bytes that stand for themselves
        self.alias = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in own)}  # the others, in order
        self.model = self.lib.model
        self.seen: dict[str, bytes] = {}
        self.cached = cached

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _chunks(self, new: list[str]) -> None:
        rest = []
        for c in new:
            if self.PLAIN.fullmatch(c):
                self.seen[c] = array(self.kind, [t.id for t in self.model.tokenize(c.encode().decode("latin-1").translate(self.alias))]).tobytes()
            else:
                rest.append(c)
        for k in range(0, len(rest), 4096):
            self.seen.update(zip(rest[k : k + 4096], self._library(rest[k : k + 4096])))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian bytes of ``dtype``."""
        whole = [i for i, t in enumerate(texts) if not self.chunked or self.ODD.search(t) or (self.added and self.added.search(t))]
        chunks = [None if not self.chunked else self.CHUNK.findall(t) for t in texts]
        for i in whole:
            chunks[i] = None
        if len(self.seen) > self.cached:
            self.seen = {}
        if self.chunked:
            self._chunks(list(set().union(*(c for c in chunks if c)).difference(self.seen)))
        get = self.seen.__getitem__
        out = [b"" if c is None else b"".join(map(get, c)) for c in chunks]
        if whole:
            for i, b in zip(whole, self._library([texts[i] for i in whole])):
                out[i] = b
        return out


def encoder(path: str) -> PretokenEncoder:
    """One encoder per Python worker and tokenizer."""
    return common.worker_state(f"encoder {path}", lambda: PretokenEncoder(path))


def frames(doc_ids: list, bodies: list[bytes], width: int) -> tuple[bytes, list[int]]:
    """The framed records of a batch, and the length of each frame."""
    payload = [HEAD.pack(0 if d is None else d, d is None, width) + b for d, b in zip(doc_ids, bodies)]
    lengths = [struct.pack("<Q", len(p)) for p in payload]
    sums = masked(crc32c(lengths + payload)).astype("<u4")
    n, out = len(payload), []
    for k, p in enumerate(payload):
        out += [lengths[k], sums[k].tobytes(), p, sums[n + k].tobytes()]
    return b"".join(out), [16 + len(p) for p in payload]


def parse(blobs: list[bytes]) -> list[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of each frame; raises ValueError if a length or a checksum doesn't hold."""
    lengths, payload = [b[:8] for b in blobs], [b[12:-4] for b in blobs]
    sums, n, out = masked(crc32c(lengths + payload)), len(blobs), []
    for k, (b, p) in enumerate(zip(blobs, payload)):
        if int.from_bytes(b[:8], "little") != len(p) or int.from_bytes(b[8:12], "little") != sums[k] or int.from_bytes(b[-4:], "little") != sums[n + k]:
            raise ValueError("damaged record")
        d, null, width = HEAD.unpack_from(p)
        out.append((None if null else d, np.frombuffer(p, f"<u{width}", offset=HEAD.size)))
    return out


def write_records(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> DataFrame:
    """Encodes ``docs`` (doc_id, text) and writes record files and index under ``path``; returns the index as read back.

    One range exchange of the texts by ``doc_id``; a task streams its sorted rows into one file. Equal ids are spread
    by a hash of the text, so many rows of one id don't make one long task unless they are copies.
    """
    common.small_batches(docs.sparkSession)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        no, name = task.partitionId(), f"part-{task.partitionId():06d}-{uuid.uuid4().hex}.rec"
        enc, end = encoder(tokenizer), None
        store, root = fs.FileSystem.from_uri(path)
        sink, at, token = None, 0, 0
        try:
            for batch in batches:
                if sink is None:
                    store.create_dir(root, recursive=True)
                    sink, end = store.open_output_stream(f"{root}/{name}"), np.array([end_id], enc.dtype).tobytes()
                ids = batch.column("doc_id").to_pylist()
                bodies = [b + end for b in enc.encode(batch.column("text").to_pylist())]
                blob, sizes = frames(ids, bodies, enc.dtype.itemsize)
                sink.write(blob)
                counts = np.array([len(b) // enc.dtype.itemsize for b in bodies], np.int64)
                offsets = at + np.cumsum([0, *sizes[:-1]], dtype=np.int64)
                firsts = token + np.cumsum(counts) - counts
                n = len(ids)
                at, token = at + len(blob), token + int(counts.sum())
                yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array([no] * n, pa.int32()), pa.array(ids, pa.int64()), pa.array(offsets), pa.array(sizes, pa.int64()), pa.array(counts), pa.array(firsts)], ["file", "file_no", "doc_id", "offset", "length", "n_tokens", "first_token"])
        finally:
            if sink is not None:
                sink.close()

    order = ["doc_id", "_spread"]
    rows = common.texts(docs).withColumn("_spread", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order).drop("_spread")
    rows.mapInArrow(write, INDEX).write.parquet(f"{path}/index")
    return docs.sparkSession.read.schema(INDEX).parquet(f"{path}/index")


def read_records(index: DataFrame, path: str) -> DataFrame:
    """Reads the frames that ``index`` names, in any order: (file_no, doc_id, first_token, n_tokens, ids binary of uint32)."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        open_files: dict = {}
        try:
            for batch in batches:
                blobs = []
                for name, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):
                    if name not in open_files:
                        for f in open_files.values():
                            f.close()
                        open_files = {name: store.open_input_file(f"{root}/{name}")}
                    open_files[name].seek(offset)
                    blobs.append(open_files[name].read(length))
                got = parse(blobs)
                yield pa.RecordBatch.from_arrays([batch.column("file_no"), pa.array([d for d, _ in got], pa.int64()), batch.column("first_token"), pa.array([len(x) for _, x in got], pa.int64()), pa.array([x.astype("<u4").tobytes() for _, x in got], pa.binary())], ["file_no", "doc_id", "first_token", "n_tokens", "ids"])
        finally:
            for f in open_files.values():
                f.close()

    return index.select("file", "file_no", "offset", "length", "first_token").mapInArrow(read, "file_no int, doc_id long, first_token long, n_tokens long, ids binary")


def file_starts(index: DataFrame) -> DataFrame:
    """(file_no, file_start): tokens in the files before each. One row per file, so the ordered window is as short as the file list."""
    per_file = index.groupBy("file_no").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1))
    return per_file.select("file_no", F.coalesce(before, F.lit(0)).alias("file_start"))


def op3_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document, from the files read back: start, n_tokens with the end id, CRC-32 of its ids as uint32."""
    import public_tokenizers

    path = common.scratch(spark, "records")
    index = write_records(common.table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    read = read_records(index, path).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return read.join(file_starts(index), "file_no").select("doc_id", (F.col("file_start") + F.col("first_token")).alias("start"), "n_tokens", "ids_crc32")
