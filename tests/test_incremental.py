"""Changes are merged into what is stored: partitions that they don't touch keep their files."""

from pathlib import Path

from trackloom.operators import bindings, matching
from trackloom.sources import views

DIR = "/root/testdata/sf0.001"


def test_untouched_partitions_keep_their_files(spark, tmp_path):
    path = str(tmp_path / "uses")
    states = matching.occurrence_states(views.occurrence(spark, DIR), views.file(spark, DIR)).cache()
    bindings.store_uses(states, path, parts=16)
    listed = lambda: {str(f.relative_to(path)) for f in Path(path).rglob("*.parquet")}
    files = views.file(spark, DIR).fillna({"seconds": 200.0})
    lacking = [r.song_id for r in states.where("state = 'missing-source-metadata'").select("song_id").distinct().orderBy("song_id").collect()]
    resolved = spark.createDataFrame([(lacking[0], 200_000), (lacking[1], None), (10**9, 5)], "song_id long, ms long")
    before = listed()
    touched = bindings.complete_stored(spark, path, files, resolved)
    after = listed()
    part = lambda f: int(f.split("part=")[1].split("/")[0])
    assert 0 < len(touched) < 16 and {part(f) for f in before - after} == {part(f) for f in after - before} == set(touched)
    got = {(r.path, r.playlist_id, r.seq): r.state for r in spark.read.parquet(path).collect()}
    was = {(r.path, r.playlist_id, r.seq): (r.song_id, r.state) for r in states.collect()}
    assert got.keys() == was.keys()
    changed = {k for k in got if got[k] != was[k][1]}
    assert changed and all(was[k] == (lacking[0], "missing-source-metadata") and got[k] != "missing-source-metadata" for k in changed)
    assert not any(got[k] == "missing-source-metadata" for k in was if was[k][0] == lacking[0])
    # again: nothing is left to do, and nothing is written
    assert bindings.complete_stored(spark, path, files, resolved) == [] and listed() == after
