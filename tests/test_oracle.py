"""Every query with SQL gives the rows that DuckDB gives."""

import math
import os

import duckdb
import pytest

from trackloom.plans import registry

DIR = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def cell(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5) + 0.0
    if hasattr(x, "isoformat"):
        return x.isoformat()
    return x


def rows(names, found):
    at = [names.index(n) for n in sorted(names)]
    return sorted((tuple(cell(r[i]) for i in at) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DIR)
    cur = duck.execute(registry.SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    got, want = rows(df.columns, df.collect()), rows(names, cur.fetchall())
    assert len(got) == len(want)
    bad = [(g, w) for g, w in zip(got, want) if g != w and not all(a == b or isinstance(a, float) and isinstance(b, float) and abs(a - b) < 2e-5 for a, b in zip(g, w))]
    assert not bad, bad[:3]
