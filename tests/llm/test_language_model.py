import collections
import math
import random

from trackloom.llm import language_model as lm


def brute(docs, target):
    import numpy as np

    count = collections.Counter(w for _, t in docs for w in (t or "").encode().lower().split())
    vocab = {w: k for k, (w, _) in enumerate(sorted(count.items(), key=lambda x: (-x[1], x[0])), 2)}
    n = len(vocab) + 1
    out = []
    models = []
    for pick in (lambda i: i in target, lambda i: True):
        uni, bi, first = collections.Counter(), collections.Counter(), collections.Counter()
        for i, t in docs:
            ids = [vocab[w] for w in (t or "").encode().lower().split()]
            if pick(i) and ids:
                uni.update(ids)
                bi.update(lm.cells(np.array(ids)).tolist())
                first.update([0] + ids[:-1])
        models.append((uni, bi, first))
    for i, t in docs:
        ids = [vocab[w] for w in (t or "").encode().lower().split()]
        losses = []
        for uni, bi, first in models:
            total = max(sum(uni.values()), 1)
            cells = lm.cells(np.array(ids)).tolist() if ids else []
            losses.append([-math.log(lm.BIGRAM * min(1, bi[c] / max(first[b], 1)) + lm.UNIGRAM * uni[w] / total + (1 - lm.BIGRAM - lm.UNIGRAM) / n) for b, w, c in zip([0] + ids, ids, cells)])
        out.append((i, len(ids), *(sum(x) / len(x) if x else None for x in losses)))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(6)
    docs = [(i, " ".join(rng.choice("red Green blue é x y".split() if i % 3 else "one two THREE four".split()) for _ in range(rng.randint(0, 40)))) for i in range(60)]
    docs += [(100, None), (101, " \n"), (None, "one two"), (3, "one two"), (102, "one " * 30000)]
    target = {i for i in range(60) if i % 3 == 0}
    d = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, n_tokens int")
    got = lm.score(d, spark.createDataFrame([(i,) for i in target] + [(None,)], "doc_id long")).collect()
    want = brute(docs, target)
    key = lambda r: (str(r[0]), r[1], r[3] or 0)
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[:2] == w[:2]
        assert (g[2] is None and w[2] is None) or abs(g[2] - w[2]) < 1e-5 and abs(g[3] - w[3]) < 1e-5
    by = {r.doc_id: r.loss_difference for r in got if r.n_tokens > 5 and r.doc_id is not None and r.doc_id < 60}
    assert max(v for i, v in by.items() if i in target) < min(v for i, v in by.items() if i not in target)
    assert lm.score(d.limit(0), spark.createDataFrame([], "doc_id long")).count() == 0


def exact(docs, target):
    """The same losses from counts of word tuples, without any function of the operator."""
    texts = [(i, ["", *(t or "").encode().lower().split()]) for i, t in docs]
    n = len({w for _, t in texts for w in t[1:]}) + 1
    sides = []
    for own in ([t for i, t in texts if i in target], [t for _, t in texts]):
        one, two, first = (collections.Counter(x) for x in ((w for t in own for w in t[1:]), (p for t in own for p in zip(t, t[1:])), (w for t in own for w in t[:-1])))
        total = max(one.total(), 1)
        sides.append(lambda b, w, one=one, two=two, first=first, total=total: -math.log(0.6 * two[b, w] / max(first[b], 1) + 0.39 * one[w] / total + 0.01 / n))
    return {i: (len(t) - 1, *(sum(f(b, w) for b, w in zip(t, t[1:])) / (len(t) - 1) for f in sides)) for i, t in texts}


def test_many_words_and_bigrams_are_counted_exactly(spark, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT_WORD", 300, raising=False)
    monkeypatch.setattr(lm, "FREQUENT_BIGRAM", 300, raising=False)
    rng = random.Random(8)
    docs = [(i, " ".join("the of" if rng.random() < 0.05 else f"w{rng.randrange(60_000)}{'x' * (70 * (rng.random() < 0.01))}" for _ in range(600))) for i in range(400)]
    target = set(range(0, 400, 5))
    got = lm.score(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i,) for i in target], "doc_id long")).collect()
    want = exact(docs, target)
    assert len(got) == len(want)
    for r in got:
        n, a, b = want[r.doc_id]
        assert r.n_tokens == n and abs(r.loss_target - a) < 1e-9 and abs(r.loss_background - b) < 1e-9
