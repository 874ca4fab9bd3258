import random

import duckdb
import pandas as pd

from test_oracle import rows
from trackloom.operators import followers
from trackloom.plans import followers as plans

ITEM = "song_id long, block string, tempo double, beatable boolean, energy double, wheel int, letter int, timbre array<double>, exit_rel double, entry_rel double, bucket string"


def test_one_block_of_thousands(spark, tmp_path):
    """All pairs of a block of 4,500 items by SQL, and the search, agree; so they do for a few small blocks beside it."""
    rng = random.Random(4)
    part = pd.DataFrame({"p_partkey": range(1, 4701), "p_brand": ["Brand#12"] * 4500 + [f"Brand#{b}" for b in rng.choices(range(20, 60), k=200)]})
    part["p_name"], part["p_type"], part["p_container"] = "n", "t", "c"
    part["p_size"] = [rng.randint(1, 50) for _ in range(4700)]
    part["p_retailprice"] = [900 + rng.randint(0, 90000) / 100 for _ in range(4700)]
    line = pd.DataFrame({"l_orderkey": [i // 40 for i in range(4000)], "l_partkey": [rng.randint(1, 4700) for _ in range(4000)], "l_linenumber": [i % 40 for i in range(4000)]})
    for c in ("l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"):
        line[c] = [float(rng.randint(1, 50)) for _ in range(4000)]
    line["l_returnflag"], line["l_linestatus"], line["l_shipdate"] = "N", "O", pd.Timestamp("2024-01-01")
    part.to_parquet(tmp_path / "part.parquet")
    line.to_parquet(tmp_path / "lineitem.parquet")
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    for name, query in plans.QUERIES.items():
        got = query(spark, str(tmp_path))
        cur = con.execute(plans.SQL[name])
        names = [c[0] for c in cur.description]
        assert rows(got.columns, got.collect()) == rows(names, cur.fetchall()), name


def slots_of(items):
    return items.selectExpr("*", "'free' as arc", "0.5D as rel", "'dance' as wave", "cast(null as double) as target", "false as climb", "cast(null as array<string>) as quota")


def test_equal_items_add_no_pairs(spark):
    same = ("block", 120.0, True, 0.5, 3, 0, [1.0, 0.0], -3.0, -3.0, "dance")
    items = spark.createDataFrame([(i, *same) for i in range(400)], ITEM)
    votes = spark.createDataFrame([(7, 0, 10), (7, 1, 90), (399, 398, None)], "a long, b long, rated int")
    got = {}
    for r in sorted(followers.top_followers(items, slots_of(items), votes).collect(), key=lambda r: (r.a, r.place)):
        got.setdefault(r.a, []).append(r.b)
    assert got.pop(7) == [1, 2, 3]
    assert got == {i: [x for x in range(4) if x != i][:3] for i in range(400) if i != 7}


def test_few_and_none(spark):
    one = spark.createDataFrame([(1, "a", 120.0, False, 0.5, None, 0, None, 0.0, 0.0, None), (2, "b", 90.0, True, 0.1, 1, 0, None, 0.0, 0.0, "x"), (3, "b", 90.0, True, 0.9, 1, 0, None, 0.0, 0.0, "x")], ITEM)
    none = spark.createDataFrame([], "a long, b long, rated int")
    got = [tuple(r) for r in followers.top_followers(one, slots_of(one), none).select("a", "place", "b", "tier").orderBy("a").collect()]
    assert got == [(2, 1, 3, 2), (3, 1, 2, 2)]
    empty = spark.createDataFrame([], ITEM)
    assert followers.top_followers(empty, slots_of(empty), none).count() == 0
