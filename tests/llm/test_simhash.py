import random

import numpy as np
import pytest
import xxhash

from trackloom.llm import simhash


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def brute_components(prints, differ=2):
    """Smallest id that each of ``prints`` (id to fingerprint) reaches."""
    ids, parent = sorted(prints), {i: i for i in prints}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= differ:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in ids}


def corpus(seed, n=150):
    rng = random.Random(seed)
    words, texts = [f"w{i}é" for i in range(300)], []
    for _ in range(n):
        if texts and rng.random() < 0.6:
            w = rng.choice(texts).split()
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(words)
        else:
            w = [rng.choice(words) for _ in range(rng.choice((1, 2, 3, 5, 60, 200)))]
        texts.append(" ".join(w))
    return [(7 * i % (n * 3), t if rng.random() < 0.8 else t.upper().replace(" ", "\n\t").replace("É", "é")) for i, t in enumerate(texts)]


def test_equals_brute_force(spark):
    rows = corpus(1) + [(9001, None), (9002, ""), (9000, " \r\n")]
    docs = spark.createDataFrame([(t, i, "clash") for i, t in rows], "text string, doc_id long, fingerprint string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_components(docs).collect()}
    prints = {i: brute_fingerprint(t) for i, t in rows}
    whole = brute_components(prints)
    assert got == {i: (f"{prints[i]:016x}", whole[i]) for i in prints}
    assert len(set(whole.values())) < len(whole) - 20


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op11_simhash_near_dedup(spark, "/root/testdata/sf0.001").collect()}
    prints = {r.doc_id: brute_fingerprint(r.text) for r in docs.collect()}
    whole = brute_components(prints)
    assert got == {i: (f"{prints[i]:016x}", whole[i]) for i in prints}


@pytest.mark.parametrize("differ", [1, 2])
@pytest.mark.parametrize("crowd", [2, 32])
def test_links_of_crowded_fingerprints(spark, monkeypatch, differ, crowd):
    """Fingerprints around a few centres: full buckets give the components that all pairs give, and no wrong link."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng, prints = random.Random(5), set()
    centres = [rng.getrandbits(64) for _ in range(4)]
    while len(prints) < 400:
        x = rng.choice(centres)
        for _ in range(rng.randint(0, 5)):
            x ^= 1 << rng.randrange(64)
        prints.add(x if rng.random() < 0.9 else rng.getrandbits(64))
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    links = simhash.simhash_links(spark.createDataFrame([(x,) for x in signed], "fp long"), differ).collect()
    assert all(((r.lo ^ r.hi) % (1 << 64)).bit_count() <= differ and r.lo != r.hi for r in links)
    parent = {x: x for x in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in links:
        a, b = sorted((find(r.lo), find(r.hi)))
        parent[b] = a
    want = brute_components({x: x % (1 << 64) for x in signed}, differ)
    assert {x: find(x) for x in signed} == want and len(set(want.values())) > 10


def test_thresholds():
    costs = [{-1: 0, 0: 5, 1: 9}, {-1: 0, 0: 100, 1: 900}, {-1: 0, 0: 5, 1: 200}, {-1: 0, 0: 7, 1: 70}]
    assert simhash.allocate(costs, -1) == (14, [1, -1, 0, -1])
    assert simhash.allocate(costs[:3], 0) == (14, [1, -1, 0])


def test_groups_hold_correlated_bits():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2, (500, 64))
    x[:, 40:56] = x[:, [40]] ^ (rng.random((500, 16)) < 0.05)
    groups = simhash.grouped_bits((x.T @ x).astype(float), 500, 4)
    assert sorted(b for g in groups for b in g) == list(range(64)) and list(range(40, 56)) in groups


def test_edges(spark):
    rows = [(5, "a b"), (5, "c d e f"), (None, "a b"), (4, "A\tB"), (None, "x y z"), (6, None)]
    got = sorted(map(tuple, simhash.simhash_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    p = lambda t: f"{brute_fingerprint(t):016x}"
    want = [(5, p("a b"), 4), (5, p("c d e f"), 5), (None, p("a b"), None), (4, p("a b"), 4), (None, p("x y z"), None), (6, "0" * 16, 6)]
    assert got == sorted(want, key=str)
    assert simhash.simhash_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_text():
    rng = random.Random(3)
    text = " ".join(f"w{rng.randrange(5000)}" for _ in range(70_000))
    assert simhash.fingerprint(text) == brute_fingerprint(text)
