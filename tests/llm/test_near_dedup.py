import random

import pytest

from trackloom.llm import near_dedup
from trackloom.llm import components as component_tables
from trackloom.llm.components import components, merged


def brute(rows, k, num=80, den=100):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        s = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        sets[i] = s
    ids, parent = sorted(sets), {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            both = len(sets[i] & sets[j])
            if both and den * both >= num * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def corpus(seed, n=140):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    shared = [rng.choice(words) for _ in range(40)]
    rows, texts = [], []
    for i in range(n):
        r = rng.random()
        if texts and r < 0.5:
            w = rng.choice(texts).split()
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = rng.choice(words)
            w = w[rng.randint(0, 3) :]
        else:
            w = [rng.choice(words) for _ in range(rng.choice((2, 3, 4, 30, 90, 200)))]
            if r > 0.8:
                w += shared
        texts.append(" ".join(w) or "x")
        rows.append((i * 3, texts[-1] if rng.random() < 0.8 else texts[-1].upper().replace(" ", "\t\n")))
    return rows


@pytest.mark.parametrize("k", [4, 5])
def test_equals_brute_force(spark, k):
    rows = corpus(k)
    docs = spark.createDataFrame([(t, i, "clash") for i, t in rows], "text string, doc_id long, component_id string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs, k).collect()}
    assert got == brute(rows, k)


def test_large_component_with_near_misses(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "LARGE", 5)
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    rng = random.Random(12)
    words = [f"w{i}" for i in range(5000)]
    base = [rng.choice(words) for _ in range(120)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randint(0, 7)):
            w[rng.randrange(120)] = rng.choice(words)
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs, 4).collect()}
    want = brute(rows, 4)
    assert got == want and len({c for _, c, _ in want.values()}) > 3


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "A b"), (5, "a\tB"), (6, "a b c d"), (None, "a b"), (7, "a b c d"), (7, "a b c d")]
    got = sorted(map(tuple, near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()), key=str)
    want = [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (7, 1, 6, False), (7, 1, 6, False), (None, 1, None, True)]
    assert got == sorted(want, key=str)
    assert near_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_chain(spark):
    got = components(spark.createDataFrame([(i, i + 1) for i in range(100)], "lo long, hi long")).collect()
    assert len(got) == 101 and {r.label for r in got} == {0}


def test_bounds_keep_true_pairs():
    for m in (16, 64, 240):
        assert 0 <= near_dedup.least_matches(m, 0.8, 1e-6) < 0.8 * m


@pytest.mark.parametrize("order", ["shuffled", "inward"])
def test_chains_of_any_order(spark, order):
    n = 1000
    ids = list(range(n))
    if order == "shuffled":
        random.Random(3).shuffle(ids)
    else:  # the smallest id's neighbour is the largest
        ids = [0, *range(n - 1, 0, -1)]
    links = [tuple(sorted(p)) for p in zip(ids, ids[1:])] + [(n + 5, n + 7), (n + 6, n + 7), (n + 9, n + 9)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "lo long, hi long")).collect()}
    assert got == dict.fromkeys(range(n), 0) | {n + 5: n + 5, n + 6: n + 5, n + 7: n + 5, n + 9: n + 9}


def test_comparisons_of_a_large_group_grow_with_its_members(spark):
    """Near copies that mostly link: the star rounds grow with the documents; what is held against all others is only the
    few that link with none of their stars. Components stay exact."""
    rng = random.Random(21)
    words = [f"w{i}" for i in range(5000)]
    base = [rng.choice(words) for _ in range(150)]
    totals = []
    for n in (150, 300):
        rows = []
        for i in range(n):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(150)] = rng.choice(words)
            rows.append((i, " ".join(w)))
        counts = {}
        got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, compared_pairs=counts).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute(rows, 4)
        totals.append(counts)
    assert totals[1]["stars"] <= 3 * totals[0]["stars"], totals
    assert sum(totals[1].values()) < 300 * 299 / 2 / 5, totals


@pytest.mark.parametrize("few", [0, 1_000])
def test_labels_after_more_links(spark, monkeypatch, few):
    monkeypatch.setattr(component_tables, "FEW", few)
    rng = random.Random(5)
    first, more = ([tuple(sorted(rng.sample(range(60), 2))) for _ in range(n)] for n in (20, 25))
    rows = lambda links: spark.createDataFrame(links, "lo long, hi long")
    labels = components(rows(first))
    walked = []
    monkeypatch.setattr(component_tables, "components", lambda links: walked.append(links.count()) or components(links))
    got = {r.node: r.label for r in merged(labels, rows(more)).collect()}
    assert got == {r.node: r.label for r in components(rows(first + more)).collect()}
    assert walked == [len(more)]  # the links before are not walked again
