import itertools
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from trackloom.llm import filter_audit

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
SCHEMA = "doc_id long, text string, lang string, part string"


def brute(docs, labels):
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    failing = []
    for i, text, lang in docs:
        text = text or ""
        words = [w for w in text.translate(dict.fromkeys(map(ord, "\t\n\x0b\x0c\r"), " ")).split(" ") if w]
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": i is not None and least[text] < i,
        }
        failing.append((lang or "", i, {f for f, x in fails.items() if x}))
    out = []
    for part in {p for p, _, _ in failing}:
        rows = [(i, f) for p, i, f in failing if p == part]
        steps, by_filter = [], Counter()
        for order in itertools.permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [(i, x) for i, x in left if f in x]
                left = [(i, x) for i, x in left if f not in x]
                all_failing = sum(f in x for _, x in rows)
                by_filter[f] += len(gone)
                steps.append((f, (part, "".join(order), step, len(left), len(gone), all_failing - len(gone), sum(x == {f} for _, x in rows), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone))))
        out += [(*s, by_filter[f]) for f, s in steps]
    return sorted(out)


def run(spark, docs, labels):
    df = spark.createDataFrame([(*d, "clash") for d in docs], SCHEMA)
    got = filter_audit.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert got.columns == COLUMNS
    return sorted(map(tuple, got.collect()))


def made(seed, n=400):
    rng, docs = random.Random(seed), []
    words = [f"w{i}é" for i in range(400)]
    for i in range(n):
        if docs and rng.random() < 0.3:
            text = rng.choice(docs)[1]
        else:
            few = rng.sample(words, rng.choice((3, 60, 400)))
            text = " ".join(rng.choice(few) for _ in range(rng.choice((0, 1, 199, 200, 201, 300))))
            text = text.title() if rng.random() < 0.2 else text.replace(" ", "\r\n\x0b") if rng.random() < 0.2 else text
            text += rng.choice(("", "", "", " #", "|", " x", "\x1cA"))
        docs.append((rng.randrange(10**6), text or rng.choice((None, "")), rng.choice(("en", "de", None, ""))))
    return docs


@pytest.mark.parametrize("least", [64, 1 << 16])
def test_equals_brute_force(spark, monkeypatch, least):
    """With 64 cells the sketch clears next to nothing, by default nearly all unique texts."""
    monkeypatch.setattr(filter_audit, "LEAST_CELLS", least)
    monkeypatch.setattr(filter_audit, "CELLS", least)
    docs = made(least) + [(None, "same text", "en"), (None, "same text", "en"), (7, "same text", "en"), (7, "same text", "en"), (7, "other", "fr"), (3, "other", "fr"), (7, None, "fr")]
    labels = [(d[0], random.Random(i).choice((0, 1, None)), random.Random(-i).choice((0, 1))) for i, d in enumerate(docs) if d[0] is not None and i % 2] + [(7, 1, 0), (7, 0, 1), (None, 1, 1)]
    assert run(spark, docs, labels) == brute(docs, labels)


def test_edges(spark):
    assert run(spark, [], []) == []
    assert run(spark, [(1, None, None)], [(1, None, None)]) == brute([(1, None, None)], [])


def test_given_documents_and_sql(spark):
    at = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet'")
    cur = con.execute(filter_audit.SQL)
    assert [c[0] for c in cur.description] == COLUMNS
    by_sql = sorted(cur.fetchall())
    want = brute(con.execute("SELECT doc_id, text, lang FROM documents").fetchall(), con.execute("SELECT doc_id, quality, toxic FROM labels").fetchall())
    got = sorted(map(tuple, filter_audit.op13_filter_interaction_audit(spark, at).collect()))
    assert got == want == by_sql


def test_sketch_never_clears_a_repeat(spark):
    rng = np.random.default_rng(4)
    h = rng.integers(-(1 << 63), 1 << 63, 3000)
    h[2000:] = h[:1000]
    rows = spark.createDataFrame([(int(x),) for x in h], "h long").repartition(7)
    ones, cells = filter_audit.unique_cells(rows, len(h))
    cleared = {r.h for r in rows.where(~filter_audit._may_repeat(spark, ones, cells)).collect()}
    assert not cleared & set(h[:1000].tolist()) and len(cleared) > 900
