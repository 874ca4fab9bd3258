"""Queries that SQL can't express, against plain Python on the given tables."""

import hashlib
import re
import unicodedata
from collections import defaultdict

import pytest

from trackloom.operators import features
from trackloom.plans import registry

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("form", ["title", "identity"])
def test_normal_forms(spark, form):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()}
    got = registry.QUERIES[f"fn_normalize_{form}"](spark, DIR).collect()
    assert len(got) == len(texts)
    for r in got:
        if form == "title":
            t = "".join(c for c in unicodedata.normalize("NFKD", texts[r.doc_id]) if not unicodedata.category(c).startswith("M")).lower()
            want = re.sub(r"(?:[^\w]|_)+", " ", t).strip(" ")
        else:
            want = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", texts[r.doc_id]).lower()).strip(" ")
        assert r[f"{form}_md5"] == hashlib.md5(want.encode()).hexdigest()


def test_isotonic_curve_equals_pooled_violators(spark):
    parts = defaultdict(list)
    for r in spark.read.parquet(f"{DIR}/part.parquet").select("p_size", "p_retailprice").collect():
        parts[float(r.p_size)].append(float(r.p_retailprice))
    pools = []
    for x in sorted(parts):
        pools.append([sum(parts[x]) / len(parts[x]), 1, [x]])
        while len(pools) > 1 and pools[-2][0] > pools[-1][0]:
            b, a = pools.pop(), pools.pop()
            pools.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    want = {x: y for y, _, xs in pools for x in xs}
    got = {r.x: r.fitted for r in registry.QUERIES["agg_isotonic_curve"](spark, DIR).collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-5 for x in want)


def test_sequences_hold_every_item_and_no_turn_gains(spark, monkeypatch):
    items = registry._items(spark, DIR)
    rows = {r.song_id: r for r in items.collect()}
    got = defaultdict(list)
    for r in features.greedy_sequence(items, "artist", 16).orderBy("artist", "place").collect():
        got[r.artist].append((r.place, r.song_id))
    assert sorted(i for v in got.values() for _, i in v) == sorted(rows)
    assert all([p for p, _ in v] == list(range(1, len(v) + 1)) for v in got.values())

    def cost(a, b):
        import math

        turn = abs(int(a.camelot[:-1]) - int(b.camelot[:-1]))
        return 10 * abs(math.log2(a.tempo / b.tempo)) + 2 * abs(a.energy - b.energy) + 0.5 * (min(turn, 12 - turn) + (a.camelot[-1] != b.camelot[-1]))

    total = lambda p: sum(cost(rows[x], rows[y]) for x, y in zip(p, p[1:]))
    for v in got.values():
        path = [i for _, i in v][:16]
        for i in range(1, len(path) - 1):
            for j in range(i + 1, len(path)):
                assert total(path[:i] + path[i : j + 1][::-1] + path[j + 1 :]) > total(path) - 1e-6


def test_sequence_of_a_large_block(spark):
    """Whole blocks: no turn or move inside a stretch, or across the border of the other cut, gains; the cost is near that of the
    form that orders the block in one task, and far below the order of tempo."""
    import numpy as np

    items = registry._items(spark, "/root/testdata/sf0.01").where("song_id < 400").withColumn("all", registry.F.lit("one"))
    rows = items.orderBy("song_id").collect()
    at = {r.song_id: i for i, r in enumerate(rows)}
    log, energy = (np.array([f(r) for r in rows]) for f in (lambda r: np.log2(r.tempo), lambda r: r.energy))
    wheel, letter = np.array([int(r.camelot[:-1]) for r in rows]), np.array([r.camelot[-1] for r in rows])
    turn = np.abs(wheel[:, None] - wheel)
    c = 10 * np.abs(log[:, None] - log) + 2 * np.abs(energy[:, None] - energy) + 0.5 * (np.minimum(turn, 12 - turn) + (letter[:, None] != letter))
    total = lambda p: c[p[:-1], p[1:]].sum()

    def ordered(most):
        got = features.greedy_sequence(items, "all", most).orderBy("place").collect()
        assert [r.place for r in got] == list(range(1, 401)) and len({r.song_id for r in got}) == 400
        return np.array([at[r.song_id] for r in got])

    path = ordered(64)
    for shift in (0, 32):
        for lo in range(-shift, 400, 64):
            piece = path[max(lo, 0) : lo + 64]
            for i in range(1, len(piece) - 1):
                for j in range(i + 1, len(piece) - 1):
                    assert total(np.concatenate([piece[:i], piece[i : j + 1][::-1], piece[j + 1 :]])) > total(piece) - 1e-6
                rest = np.delete(piece, i)
                assert all(total(np.insert(rest, j, piece[i])) > total(piece) - 1e-6 for j in range(1, len(rest)))
    ratio = total(path) / total(ordered(400))
    assert ratio <= 1.6, ratio
    assert total(path) < 0.6 * total(np.argsort(log, kind="stable"))


def test_stated_sets_meet_all_rows(spark, monkeypatch):
    monkeypatch.setattr(features, "BLOCK_ROWS", 40)
    v = registry._vectors(spark, DIR)
    assert features.against(v.select("vec_id"), v.select(registry.F.col("vec_id").alias("q"))).count() == v.count() ** 2
