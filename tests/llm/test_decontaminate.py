import random

from trackloom.llm import decontaminate as dc

SCHEMA = "doc_id long, text string, item_id string"


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_lcs():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(rng.randint(1, 80))] for _ in "ab")
        assert dc.lcs(a, b) == slow_lcs(a, b)


def world(seed=8):
    rng = random.Random(seed)
    vocab = ["the", "of", "and"] * 30 + ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(900)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, f"{text(rng.randint(9, 50))}. {text(6)}.") for i in range(60)]
    docs, want = [], set()
    for d in range(300):
        body = text(rng.randint(20, 400)).split()
        if d % 4 == 0:
            i = rng.randrange(60)
            w = items[i][1].split()
            if d % 8 == 0:  # a paraphrase: a few words replaced, left out and put in
                for _ in range(len(w) // 8):
                    w[rng.randrange(len(w) - 6)] = rng.choice(vocab)
                w.insert(3, "so")
            at = rng.randint(0, len(body))
            body[at:at] = w
            want.add((d, i))
        docs.append((d, " ".join(body), "x"))
    return docs, items, want


def test_recall_and_precision(spark):
    docs, items, want = world()
    got = {(r.doc_id, r.item_id) for r in dc.find_leaks(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(got & want) >= 0.97 * len(want) and not got - want


def test_blocks_give_the_same(spark, monkeypatch):
    docs, items, want = world(9)
    monkeypatch.setattr(dc, "BLOCK", 25)
    got = {(r.doc_id, r.item_id) for r in dc.find_leaks(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(got & want) >= 0.97 * len(want) and not got - want


def test_edges(spark):
    docs, items, want = world()
    odd = [(None, docs[0][1], "x"), (500, None, "x"), (501, "", "x"), (502, "word " * 30000 + docs[4][1], "x"), docs[0]]
    d = spark.createDataFrame(docs + odd, SCHEMA)
    b = spark.createDataFrame(items + [(None, None), (70, ""), items[0]], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.find_leaks(d, b).collect()}
    item = dict(want)
    assert {(None, item[0]), (502, item[4])} <= got
    left = dc.drop_leaks(d, b)
    assert left.columns == d.columns
    assert left.where("doc_id is null").count() == 1 and left.where("doc_id in (0, 4, 502)").count() == 0 and left.where("doc_id in (1, 500, 501)").count() == 3
    assert dc.find_leaks(d.limit(0), b).count() == 0 and dc.find_leaks(d, b.limit(0)).count() == 0


def exhaustive(docs, items):
    """(doc_id, item_id) of all leaks, from every item against stretches all over every document."""
    out = set()
    for d, text, *_ in docs:
        w = dc.tokens(text or "")
        here = set(w)
        for it in dc.make_items(items):
            n = len(it.words)
            if len(it.distinct & here) < dc.PARAPHRASE * len(it.distinct):
                continue
            size = n + max(2, n // 4)
            best = max((slow_lcs(it.words, w[s : s + size]), -s) for s in range(0, max(1, len(w) - size + 1), max(1, n // 8)))
            stretch = w[-best[1] : -best[1] + size]
            answer = slow_lcs(it.answer, stretch) / len(it.answer) if it.answer else 0
            if best[0] >= dc.LEAK * n or best[0] >= dc.PARAPHRASE * n and answer >= dc.ANSWER:
                out.add((d, it.item_id))
    return out


def test_equals_exhaustive_check(spark):
    """On the given documents: the same pairs as every item against every document, word by word."""
    data = "/root/testdata/sf0.01"
    docs, bench = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in dc.find_leaks(docs, bench).collect()}
    want = exhaustive([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in bench.select("item_id", "text").collect()])
    assert len(want) > 10 and got == want


def test_paraphrases_among_more_items_than_the_rank(spark):
    """Several times more items than dimensions: copies are all found, and paraphrases that keep three words in four to 97 in 100."""
    rng = random.Random(31)
    vocab = ["the", "of", "and"] * 60 + ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(4000)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, f"{text(rng.randint(12, 50))}. {text(6)}.") for i in range(6 * dc.RANK)]
    docs, copies, changed = [], set(), set()
    for d in range(600):
        body = text(rng.randint(40, 300)).split()
        if d % 3:
            i = rng.randrange(len(items))
            w = items[i][1].split()
            if d % 3 == 2:
                for k in rng.sample(range(len(w) - 6), len(w) // 5):
                    w[k] = rng.choice(vocab)
            at = rng.randint(0, len(body))
            body[at:at] = w
            (changed if d % 3 == 2 else copies).add((d, i))
        docs.append((d, " ".join(body), "x"))
    got = {(r.doc_id, r.item_id) for r in dc.find_leaks(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert copies <= got and len(got & changed) >= 0.97 * len(changed) and not got - copies - changed
