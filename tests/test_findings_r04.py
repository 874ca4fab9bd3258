"""Whole jobs that were cut to a stated set, and figures that outgrew their type."""

import math
import random
from collections import Counter

import pytest

from trackloom.operators import followers, profiles
from trackloom.plans import followers as follower_plans
from trackloom.plans import profiles as profile_plans


@pytest.fixture
def vectors(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)], 0) for i in range(1, 61)]  # no id of a hundred
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def test_calibration_counts_all_pairs(spark, vectors):
    assert profile_plans.QUERIES["agg_mood_calibration"](spark, vectors).first().pairs == 60 * 59 // 2


def test_blocks_count_every_pair_once(spark, monkeypatch):
    rng = random.Random(6)
    vectors = [(i, i % 3, [rng.gauss(0, 1) for _ in range(5)]) for i in rng.sample(range(1, 500), 70)]
    kinds = {(a, b): int(a == b) for a in range(3) for b in range(3) if {a, b} != {0, 1}}
    want = Counter()
    for i, c, x in vectors:
        for j, e, y in vectors:
            if i < j and (c, e) in kinds:
                cosine = sum(map(lambda p, q: p * q, x, y)) / math.sqrt(sum(p * p for p in x) * sum(p * p for p in y))
                want[kinds[c, e], math.floor((1 - cosine) * profiles.STEPS + 0.5)] += 1
    df = spark.createDataFrame(vectors, "vec_id long, code int, embedding array<double>")
    for name, n in (("ROWS", 9), ("STEP_ROWS", 4), ("SLICE", 20)):
        monkeypatch.setattr(profiles, name, n)
    assert {(r.kind, r.distance): r.n for r in profiles.distance_counts(df, kinds=kinds).collect()} == want


def test_threshold_of_all_pairs(spark, vectors):
    got = profile_plans.QUERIES["agg_key_threshold"](spark, vectors).first()
    apart = [min(abs(a % 12 - b % 12), 12 - abs(a % 12 - b % 12)) + (a % 2 != b % 2) for a in range(1, 61) for b in range(a + 1, 61)]
    assert (got.compatible, got.clashing) == (sum(x <= 1 for x in apart), sum(x >= 3 for x in apart))


def test_threshold_of_more_pairs_than_a_product_of_longs_holds(spark):
    counts = spark.createDataFrame([(9000, 5 * 10**9, 0), (1000, 0, 5 * 10**9)], "cosine long, ok long, clash long")
    got = profiles.key_threshold(counts).first()
    assert (got.compatible, got.clashing, got.auc, got.accept_compatible, got.accept_clashing) == (5 * 10**9, 5 * 10**9, 1.0, 1.0, 0.0)


def test_costs_of_all_pairs_of_a_block(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    blocks = Counter(r.p_brand for r in spark.read.parquet(f"{d}/part.parquet").collect())
    want = sorted(map(tuple, follower_plans.QUERIES["join_pair_cost"](spark, d).collect()))
    assert len(want) == sum(n * (n - 1) for n in blocks.values())
    for name, n in (("TILE", 3), ("STRIP", 2), ("TILES", 20), ("MOST_VOTES", 1)):
        monkeypatch.setattr(followers, name, n)
    assert sorted(map(tuple, follower_plans.QUERIES["join_pair_cost"](spark, d).collect())) == want


def test_pairs_of_tiles_are_shuffled_once(spark, monkeypatch):
    plans, searched = [], followers._searched
    monkeypatch.setattr(followers, "_searched", lambda met: plans.append(met._jdf.queryExecution().executedPlan().toString()) or searched(met))
    follower_plans.QUERIES["top_candidates"](spark, "/root/testdata/sf0.001")
    assert len(plans) == 2 and "RoundRobin" not in plans[1] and "SortMergeJoin" not in plans[1]
