import subprocess
import sys
from pathlib import Path

import __spark_entry__
from trackloom.plans import registry

ROOT = Path(__file__).resolve().parents[1]


def test_names():
    assert set(registry.SQL) <= set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["playlist_id", "total", "on_disk", "percent", "done"] and df.count() > 0


def test_without_the_subpackage(tmp_path):
    """The rest imports and registers its queries where the training-data folders and the pipeline are gone."""
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    for d in ("trackloom", *(f"trackloom/{x}" for x in ("operators", "sources", "functions", "plans", "streaming"))):
        (tmp_path / d).mkdir()
        for f in (ROOT / d).glob("*.py"):
            (tmp_path / d / f.name).write_text(f.read_text())
    code = "import __spark_entry__ as e; assert 'agg_catalog_dedup' in e.queries() and not any(q.startswith('op1') for q in e.queries()); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})


def test_streamed_query(spark):
    assert registry.QUERIES["str_trip_state"](spark, "/root/testdata/sf0.001").count() > 0


def test_greedy_orders_every_song(spark):
    got = registry.QUERIES["ord_greedy_sequence"](spark, "/root/testdata/sf0.001")
    assert got.groupBy("name").count().count() == got.where("place = 1").count()
