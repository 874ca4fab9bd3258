import math
import random

import numpy as np
from pyspark.sql import functions as F

from trackloom.llm import toxicity

DATA = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    got = toxicity.op9_weak_supervision_toxicity(spark, DATA)
    seen = got.where("held_out").join(spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "toxic"), "doc_id")
    c = {(r.toxic, r.predicted): r["count"] for r in seen.groupBy("toxic", "predicted").count().collect()}
    assert c[1, 1] >= 0.85 * (c[1, 1] + c[1, 0])
    assert c.get((0, 1), 0) <= 0.05 * c[1, 1] + 5
    assert got.where("score is null or score < 0 or score > 1").isEmpty()


def test_fold(spark):
    import zlib

    rows = spark.range(200).select("id", toxicity.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in rows)


def test_edges(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice(["fine", "day", "tree", "book"]) for _ in range(20)) + (" vile nasty" if i % 5 == 0 else ""), "x") for i in range(300)]
    docs += [(900, None, "x"), (901, "", "x"), (None, "vile nasty", "x"), (5, "vile nasty " * 40000, "x"), (900, None, "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)] + [(7, None)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(d, labels).collect()
    assert len(got) == len(docs)
    assert all(r.predicted == (r.doc_id is None or r.doc_id < 300 and r.doc_id % 5 == 0) for r in got)
    none = toxicity.score_toxicity(d, labels.limit(0)).collect()
    assert len(none) == len(docs) and {r.score for r in none} == {0.0}
    assert toxicity.score_toxicity(d.limit(0), labels).count() == 0


def test_label_model_equals_plain_python(spark):
    """Expectation maximisation, correlations and posterior of the label model, again by loops over all votes."""
    rng = random.Random(17)
    m, prior, silent = 5, 0.3, 0.05
    start = np.array([0.9, 0.8, 0.7, 0.85, 0.6])
    votes = []
    for _ in range(700):
        toxic = rng.random() < 0.3
        v = [rng.random() < (0.5 if toxic else 0.1) for _ in range(m)]
        v[3] = v[0] if rng.random() < 0.8 else v[3]  # two voters that say the same
        votes.append(v)
    bits = [sum(1 << j for j, x in enumerate(v) if x) for v in votes]
    got = toxicity.fit_label_model(spark.createDataFrame([(b,) for b in bits], "votes long"), m, prior, start, silent)

    logit = lambda p: math.log(min(max(p, 1e-3), 1 - 1e-3)) - math.log(1 - min(max(p, 1e-3), 1 - 1e-3))
    accuracy, weight, share = start.copy(), np.ones(m), prior

    def posterior(v):
        if not any(v):
            return silent
        base = logit(share)
        return 1 / (1 + math.exp(-(base + sum((logit(accuracy[j]) - base) * weight[j] for j in range(m) if v[j]))))

    for step in range(3):
        for _ in range(3 if step else 1):
            p = [posterior(v) for v in votes]
            hits = np.array([sum(v[j] for v in votes) for j in range(m)], float)
            hot = np.array([sum(q for q, v in zip(p, votes) if v[j]) for j in range(m)])
            toxic_total = sum(p)
            accuracy = np.where(hits > 0, (hot / np.maximum(hits, 1) + start) / 2, start)
            share = (toxic_total / len(p) + prior) / 2
        if step < 2:
            p = [posterior(v) for v in votes]
            totals = len(p) - toxic_total, toxic_total
            rates = [np.clip(x / max(n, 1.0), 1e-6, 1 - 1e-3) for x, n in zip((hits - hot, hot), totals)]
            corr = np.zeros((m, m))
            for j in range(m):
                for k in range(j + 1, m):
                    both = [(q, v) for q, v in zip(p, votes) if v[j] and v[k]]
                    if both:
                        for y, joint in enumerate((sum(1 - q for q, _ in both), sum(q for q, _ in both))):
                            a, b = rates[y][j], rates[y][k]
                            rho = (joint / max(totals[y], 1.0) - a * b) / math.sqrt(a * (1 - a) * b * (1 - b))
                            corr[j, k] += max(-1.0, min(1.0, rho)) / 2
                        corr[k, j] = corr[j, k]
            weight = 1 / (1 + np.clip(corr, 0, 1).sum(axis=1))
    assert np.allclose(got.accuracy, accuracy) and np.allclose(got.weight, weight) and abs(got.prior - share) < 1e-9
    assert got.weight[3] < got.weight[1]  # voters that repeat each other count for less
    rows = spark.createDataFrame([(b,) for b in sorted(set(bits))], "votes long").select("votes", got.posterior().alias("p")).collect()
    for r in rows:
        assert abs(r.p - posterior([bool(r.votes >> j & 1) for j in range(m)])) < 1e-9
