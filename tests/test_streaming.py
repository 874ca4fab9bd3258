"""Streams give what tables give when nothing is late."""

import random

import pytest
from pyspark.sql import functions as F

from trackloom.sources import views
from trackloom.streaming import journal, live, timed

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def slices(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events"))
    e = views.event(spark, DIR).select("event_id", "t", "key", "type").orderBy("t")
    e.repartitionByRange(4, "t").write.mode("overwrite").parquet(path)
    return path


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_throughput(spark, slices):
    stream = live.throughput(live.read_events(spark, slices, 100))
    got = live.collect_stream(stream, "tp", "complete")
    assert rows(got) == rows(live.throughput(spark.read.parquet(slices)))


def made(seed, n=160):
    rng, kinds = random.Random(seed), ["pace_change", "mp3_verified", "block", "search_ok"]
    return [(rng.randrange(3), i, 10**12 + rng.randrange(400) * 1_000_000, rng.choice(kinds), rng.choice((8, 40, 64, 88, None))) for i in range(n)]


ROW = "key long, event_id long, t_us long, type string, value long"


def test_batches_of_fixed_length(spark):
    """Notices come in any order within the delay, over several runs from one checkpoint; later ones don't extend a batch."""
    events = made(1)
    got = timed.replayed(spark, spark.createDataFrame(events, ROW), lambda e: timed.change_batches(e, 10_000, "1 hour"), 3, F.col("event_id") % 3)
    want = []
    for key in range(3):
        own = sorted((t, kind) for k, _, t, kind, _ in events if k == key)
        while own:
            batch = [x for x in own if x[0] < own[0][0] + 10_000_000]
            want.append((key, own[0][0], len(batch), ",".join(sorted({k for _, k in batch}))))
            own = own[len(batch) :]
    assert rows(got) == sorted(want, key=str) and max(w[2] for w in want) > 2


def test_search_for_a_pace(spark):
    events, pace = made(2), timed.Pace(30_000_000, 40_000_000, 5_000_000, 9_000_000)
    got = timed.replayed(spark, spark.createDataFrame(events, ROW), lambda e: timed.trip_state(e, pace, "1 hour"), 2, F.col("event_id") % 2)
    want = []
    for key in range(3):
        cur, good, fail, cool, bot, step = 8, None, None, 0, None, 0
        for _, e, t, kind, value in [*sorted((r for r in events if r[0] == key), key=lambda r: (r[2], r[1])), (key, None, 10**15, "end", None)]:
            mid = max((good + fail) // 2, good + 1) if fail is not None and fail > good + 1 else None
            at = max(bot or 0, step) + pace.clean_us
            if mid and mid != cur and at <= t:
                want.append((key, at, None, "probe", cur, mid, good, fail, cool))
                cur, step = mid, at
            if kind == "pace_change" and value:
                cur = value
            elif kind == "mp3_verified" and fail and good < cur < fail:
                good = cur
            elif kind == "block":
                again = cur == 8 and bot is not None and t - bot < pace.again_us
                word = "repeat" if again else "floor" if cur == 8 else "trip"
                if cur > 8:
                    fail = min(fail or cur, cur)
                    good = 8 if good is None or good >= cur else good
                cool = max(cool, t + (pace.long_us if again else pace.cool_us))
                want.append((key, t, e, word, cur, 8, good, fail, cool))
                cur, bot, step = 8, t, t
    assert rows(got) == sorted(want, key=str) and {w[3] for w in want} == {"trip", "floor", "repeat", "probe"}


def test_journal_over_many_batches(spark, tmp_path, monkeypatch):
    """Batches merge to the latest row of each key, also where journals are compacted and where a batch is put twice."""
    monkeypatch.setattr(journal, "COMPACT", 2)
    rows = [(i % 4, f"s{i}", 7 - i % 3, i) for i in range(14)]
    (tmp_path / "in").mkdir()
    for n in range(7):
        spark.createDataFrame(rows[2 * n : 2 * n + 2], "key long, state string, t long, event_id long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    last = {k: max((t, e, s) for k2, s, t, e in rows if k2 == k)[2] for k in range(4)}
    j = journal.Journal(spark, str(tmp_path / "j"), ["key"], ["t", "event_id"])
    for n in range(7):
        part = spark.createDataFrame(rows[2 * n : 2 * n + 2], "key long, state string, t long, event_id long")
        j.put(part, n)
        if n == 3:
            j.put(part, n)
    # older events that come in later batches don't overwrite newer ones; another object reads the folder
    again = journal.Journal(spark, str(tmp_path / "j"), ["key"], ["t", "event_id"])
    assert {r.key: r.state for r in again.rows().collect()} == last
    stream = spark.readStream.schema("key long, state string, t long, event_id long").option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in"))
    assert {r.key: r.state for r in journal.journal_upsert(stream, ["key"], ["t", "event_id"]).collect()} == last
    more = spark.readStream.schema("key long, state string, t long, event_id long").parquet(str(tmp_path / "in"))
    base = str(tmp_path / "kept")
    journal.journal_upsert(more, ["key"], ["t", "event_id"], base)
    spark.createDataFrame([(0, "newest", 99, 99), (1, "oldest", 0, 98)], "key long, state string, t long, event_id long").write.mode("append").parquet(str(tmp_path / "in"))
    assert {r.key: r.state for r in journal.journal_upsert(more, ["key"], ["t", "event_id"], base).collect()} == last | {0: "newest"}
