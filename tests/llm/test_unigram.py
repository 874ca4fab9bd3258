import random

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from trackloom.llm import unigram

MODEL = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def enc():
    return unigram.Encoder(unigram.Vocabulary(MODEL), cached=100)


def brute(text, v, lib):
    """Plain quadratic Viterbi over characters of the whole text."""
    t = "▁" + text.replace(" ", "▁") if text else ""
    pieces = {lib.id_to_piece(i): i for i in range(lib.vocab_size()) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))}
    best, back = [0.0] + [float("-inf")] * len(t), [None] * (len(t) + 1)
    for s in range(len(t)):
        for e in range(s + 1, min(len(t), s + 16) + 1):
            i = pieces.get(t[s:e])
            c = best[s] + (lib.get_score(i) if i is not None else v.unknown if e == s + 1 else float("-inf"))
            if c > best[e]:
                best[e], back[e] = c, (s, i)
    out, e = [], len(t)
    while e:
        s, i = back[e]
        out.append([i] if i is not None else [lib.piece_to_id(f"<0x{b:02X}>") for b in t[s:e].encode()])
        e = s
    return [x for part in reversed(out) for x in part]


TEXTS = st.text(st.sampled_from("abeinthou \n\t▁é漢😀\x00.,'"), max_size=40) | st.text(max_size=15)


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXTS, max_size=4))
def test_equals_brute_force(texts):
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    e = test_equals_brute_force.enc = getattr(test_equals_brute_force, "enc", None) or unigram.Encoder(unigram.Vocabulary(MODEL), cached=100)
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    got = e.encode(texts)
    assert [x.tolist() for x in got] == [brute(t, e.v, lib) for t in texts]
    assert [unigram.decode_ids(x, e.v.out) for x in got] == [t.replace("▁", " ") for t in texts]
    assert [unigram.decode_ids(x, e.v.out) for x in got] == [lib.decode(x.tolist()) for x in got]


def test_long_words_alike(enc):
    rng = random.Random(2)
    for n in (1, 5, 30, 60):
        w = ("▁" + "".join(rng.choice("abcé漢ing") for _ in range(n))).encode()
        if len(w) <= unigram.LONG:
            assert enc._together([w])[0].tolist() == enc._alone(w).tolist()
    assert len(enc._alone(b"\xe2\x96\x81" + b"xyz" * 20000)) > 1000


def test_query(spark):
    rows = [(1, None, "a"), (2, "", "b"), (None, "the café \n▁x", "c"), (2, "dup", "d"), (2, "dup", "d"), (5, "word " * 20000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = unigram.decode(unigram.encode(docs, MODEL, keep=("text",)), MODEL).collect()
    assert sorted((str(r.doc_id), r.decoded) for r in got) == sorted((str(i), (t or "").replace("▁", " ")) for i, t, _ in rows)
    assert all(len(r.ids) == 0 for r in got if not r.text)
    assert unigram.encode(docs.limit(0), MODEL).count() == 0
