"""The latent basis comes from the passages of all documents."""

import random

import numpy as np

from trackloom.llm import decontaminate as dc


def test_every_document_counts(spark, monkeypatch):
    rng = random.Random(1)
    vocab = ["".join(rng.choice("abcdef") for _ in range(5)) for _ in range(300)]
    docs = spark.createDataFrame([(d if d % 50 else None, " ".join(rng.choices(vocab, k=12))) for d in range(4300)], "doc_id long, text string")
    seen, whole = [], dc._sum_over
    monkeypatch.setattr(dc, "_sum_over", lambda d, index, m: seen.append(d.count()) or whole(d, index, m))
    dc.build_index(docs, dc.make_items([(1, " ".join(vocab[:40])), (2, " ".join(vocab[40:70]))]))
    assert seen == [4300, 4300]


def test_gram_equals_passage_by_passage(monkeypatch):
    monkeypatch.setattr(dc, "WORDS", 60)
    rng = np.random.default_rng(2)
    index = dc.Index([], {bytes([k]): k for k in range(30)}, idf=rng.uniform(0.1, 3, 30))
    m = rng.standard_normal((30, 7))
    batch = [rng.integers(-1, 30, n) for n in (0, 1, 5, 23, 24, 25, 47, 48, 49, 72, 73, 200)] + [np.full(60, -1)]
    want = np.zeros(m.shape)
    for x in batch:
        for s in range(0, max(1, len(x) - dc.HALF), dc.HALF):
            t, n = np.unique(x[s : s + dc.WINDOW][x[s : s + dc.WINDOW] >= 0], return_counts=True)
            if len(t):
                v = n * index.idf[t] / np.linalg.norm(n * index.idf[t])
                want[t] += v[:, None] * (v @ m[t])
    assert np.abs(dc._gram_times(index, batch, m) - want).max() < 1e-4
    assert not dc._gram_times(index, [], m).any()


def test_words_as_they_stand(monkeypatch):
    index = dc.Index([], {b"a": 0, b"bc": 1, b"": 2})
    text = "A, a (bc) x .. BC! \ud800 a"
    for most in (0, 2, 100):
        monkeypatch.setattr(dc, "SEEN", most)
        index.seen = None
        assert index.known(text).tolist() == index.known(text).tolist() == index.ids(dc.tokens(text)).tolist()
        assert len(index.seen) <= most
