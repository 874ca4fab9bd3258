import zlib

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from trackloom.llm import common, records

BPE = P.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(BPE)


def slow_crc32c(data):
    c = 0xFFFFFFFF
    for b in data:
        c ^= b
        for _ in range(8):
            c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def test_crc32c():
    assert records.crc32c([b"123456789"])[0] == 0xE3069283
    rng = np.random.default_rng(1)
    parts = [rng.bytes(n) for n in (0, 1, 3, 4, 5, 63, 64, 65, 127, 128, 129, 1000, 4097)]
    assert records.crc32c(parts).tolist() == [slow_crc32c(p) for p in parts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab' \n\t\r  \x1c\x85é漢0<|>s!endoftext"), max_size=30) | st.text(max_size=20), max_size=4))
def test_encoder_equals_library(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts] + ["a<|endoftext|>b", ""]
    enc = records.encoder(BPE)
    assert [np.frombuffer(b, enc.dtype).tolist() for b in enc.encode(texts)] == [e.ids for e in LIB.encode_batch(texts, add_special_tokens=False)]


def test_damage_is_found():
    blob, _ = records.frames([5], [b"\x01\x00"], 2)
    assert records.parse([blob])[0][0] == 5
    for k in range(len(blob)):
        bad = bytearray(blob)
        bad[k] ^= 1
        try:
            records.parse([bytes(bad)])
            raise AssertionError(k)
        except ValueError:
            pass


def run(spark, rows, schema="doc_id long, text string, n_tokens string, file string"):
    path = common.scratch(spark, "t")
    docs = spark.createDataFrame(rows, schema)
    index = records.write_records(docs, path, BPE, 2)
    got = {}
    for r in records.read_records(index, path).join(records.file_starts(index), "file_no").collect():
        got.setdefault(r.doc_id, []).append((r.file_start + r.first_token, r.n_tokens, zlib.crc32(r.ids)))
    return got


def test_round_trip(spark):
    rows = [(i, t, "x", "y") for i, t in [(7, "the end"), (3, None), (None, "no id"), (9, ""), (4, "word " * 30000), (7, "the end"), (12, "<|endoftext|>\n\n a")]]
    got, start = run(spark, rows), 0
    for i, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = LIB.encode(t or "", add_special_tokens=False).ids + [2]
        assert (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) in got[i]
        start += len(ids)
    assert sum(map(len, got.values())) == len(rows)


def test_empty(spark):
    assert run(spark, []) == {}
