import numpy as np
import pytest

from trackloom.operators import neighbours

SCHEMA = "vec_id long, label long, embedding array<double>"


def brute(vectors, labelled, k):
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    out = {}
    for i, _, v in vectors:
        sims = sorted((-round(float(unit(v) @ unit(w)), 9), j) for j, _, w in labelled if j != i)
        out[i] = [j for _, j in sims[:k]]
    return out


@pytest.mark.parametrize("block", [8, 1024])
def test_exact_search(spark, monkeypatch, block):
    """Also where cells are cut into many blocks, and a third of all vectors are equal."""
    monkeypatch.setattr(neighbours, "BLOCK", block)
    monkeypatch.setattr(neighbours, "QUERIES", 16)
    rng = np.random.default_rng(6)
    rows = [(i, int(rng.integers(3)), [1.0, 2.0, 0.0, 1.0, 0.0, 0.5] if i % 3 == 1 else rng.normal(size=6).tolist()) for i in range(240)]
    labelled = [r for r in rows if r[0] % 2]
    index = neighbours.build_index(spark.createDataFrame(labelled, SCHEMA), cells=12)
    got = {}
    for r in neighbours.nearest(spark.createDataFrame(rows, SCHEMA), index, 5, probe=2).orderBy("id", "place").collect():
        got.setdefault(r.id, []).append(r.near)
    assert got == brute(rows, labelled, 5)


def test_recall_of_probing(spark):
    """The given vectors have no clusters: sixteen of the 26 cells give nine tenths of the true neighbours, four half of them."""
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    index = neighbours.build_index(vectors.where("vec_id % 3 = 0"))
    some, all_ = ({(r.id, r.near) for r in neighbours.nearest(vectors, index, 5, probe=16, exact=x).collect()} for x in (False, True))
    assert len(all_) == 5 * vectors.count() and len(some & all_) >= 0.9 * len(all_), len(some & all_) / len(all_)


def test_edges(spark):
    none = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([(1, 4, [1.0, 0.0]), (2, 5, [0.0, 1.0]), (3, 6, None), (4, 6, [0.0, 0.0])], SCHEMA)
    assert neighbours.knn_vote(one, none).count() == 0 and neighbours.knn_vote(none, one).count() == 0
    assert {tuple(r) for r in neighbours.knn_vote(one, one).collect()} == {(1, 5), (2, 4)}
