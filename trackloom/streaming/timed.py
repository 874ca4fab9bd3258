"""Streams in the order of event time, with timers: batches of fixed length from their first notice, the search for a pace,
idempotent requests and alerts by incident.

Rows wait in their key's state until the watermark has passed them, so batches of a stream and rows of a batch may come in any
order within the watermark's delay. A timer at the earliest waiting row, or at the next instant at which something is due
by itself, takes them up in order. What has been taken up leaves the state.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from trackloom.functions import keys
from trackloom.sources.shared import materialize, shared_path

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A heartbeat of this key and instant closes a finite stream: all that waits is due by then.
HEARTBEAT, END_US = -1, 4_102_444_800_000_000


@contextlib.contextmanager
def timer_store(spark: SparkSession) -> Iterator[None]:
    """The state store that timers need, while a query starts; whatever was set is back afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def in_time(events: DataFrame, delay: str) -> DataFrame:
    """A stream (key, event_id, t_us, type, value) with the watermark that its timers go by."""
    return events.withColumn("t", F.timestamp_micros("t_us")).withWatermark("t", delay)


def replayed(spark: SparkSession, rows: DataFrame, run, slices: int = 2, by=None) -> DataFrame:
    """The rows that ``run`` (stream to stream) makes of a table (key, event_id, t_us, type, value) given as a stream in ``slices``
    files, by time or by the number ``by``, and a heartbeat.

    Each file is a run of its own from the checkpoint that the run before left, so state and timers outlive their query.
    """
    base = shared_path(spark, "replay")
    rows = materialize(rows, "replayed")
    lo, hi = rows.agg(F.min("t_us"), F.max("t_us")).first()
    cut = by if by is not None else F.floor((F.col("t_us") - F.lit(lo)) * slices / (F.lit((hi or 0) - (lo or 0) + 1)))
    beat = spark.range(1).select(*(F.lit({"key": HEARTBEAT, "t_us": END_US}.get(f.name)).cast(f.dataType).alias(f.name) for f in rows.schema))
    out = None
    for part in [*(rows.where(cut == n) for n in range(slices)), beat]:
        part.write.mode("append").parquet(f"{base}/in")
        stream = run(spark.readStream.schema(rows.schema).parquet(f"{base}/in"))
        with timer_store(spark):
            stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/log").outputMode("append").trigger(availableNow=True).start().awaitTermination()
        out = stream
    of = out.schema[0]
    return spark.read.schema(out.schema).parquet(f"{base}/out").where(F.col(of.name) != F.lit(HEARTBEAT).cast(of.dataType))


class Kept:
    """A key's value state while rows are taken up: read once, written once by ``save``, whatever lies in between."""

    def __init__(self, state) -> None:
        self.state = state
        self.before = self.value = tuple(state.get()) if state.exists() else None

    def exists(self) -> bool:
        return self.value is not None

    def get(self) -> tuple | None:
        return self.value

    def update(self, value: tuple) -> None:
        self.value = tuple(value)

    def clear(self) -> None:
        self.value = None

    def save(self) -> None:
        if self.value is None and self.before is not None:
            self.state.clear()
        elif self.value != self.before:
            self.state.update(self.value)


class InOrder(StatefulProcessor):
    """Takes a key's rows up in the order of (t_us, event_id) once the watermark has passed them.

    ``columns`` come out; ``take`` gets a row, ``due`` says at which microsecond something happens by itself, ``happen`` does it.
    ``kept`` is the key's value of ``schema`` in the meantime: a timer asks the state store once, not for every row.
    """

    columns: list[str] = []
    state, schema = "kept", ""

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t_us long, event_id long, type string, value long")
        self.value = handle.getValueState(self.state, self.schema)

    def take(self, row: tuple, out: list) -> None: ...

    def due(self) -> int | None: ...

    def happen(self, at: int, out: list) -> None: ...

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:  # chunk by chunk: a key's rows are never together here
            first = int(pdf.t_us.min())
            self.waiting.appendList([(int(t), int(e) if pd.notna(e) else None, k, int(v) if pd.notna(v) else None) for t, e, k, v in zip(pdf.t_us, pdf.event_id, pdf.type, pdf.value)])
            self.handle.registerTimer(-(-first // 1000))
        yield pd.DataFrame(columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out = timerValues.getCurrentWatermarkInMs() * 1000, []
        self.kept = Kept(self.value)
        rows = sorted(self.waiting.get(), key=lambda r: (r[0], r[1] or 0)) if self.waiting.exists() else []
        ready = [r for r in rows if r[0] <= now]
        for row in ready:
            while (at := self.due()) is not None and at <= row[0]:
                self.happen(at, out)
            self.take(tuple(row), out)
        while (at := self.due()) is not None and at <= now:
            self.happen(at, out)
        self.kept.save()
        rest = rows[len(ready) :]
        if rest:
            self.waiting.put([tuple(r) for r in rest])
        elif rows:
            self.waiting.clear()
        following = [x for x in (rest[0][0] if rest else None, self.due()) if x is not None]
        if following:
            self.handle.registerTimer(-(-min(following) // 1000))
        yield pd.DataFrame([(key[0], *o) for o in out], columns=self.columns)

    def close(self) -> None: ...


class ChangeBatches(InOrder):
    """Notices within ``hold_us`` of the first are one batch; later ones don't extend it."""

    columns = ["key", "start_us", "notices", "kinds"]
    state, schema = "open", "start_us long, notices long, kinds string"

    def __init__(self, hold_us: int) -> None:
        self.hold_us = hold_us

    def due(self) -> int | None:
        return self.kept.get()[0] + self.hold_us if self.kept.exists() else None

    def take(self, row: tuple, out: list) -> None:
        t, _, kind, _ = row
        start, n, kinds = self.kept.get() if self.kept.exists() else (t, 0, "")
        self.kept.update((start, n + 1, ",".join(sorted({*filter(None, kinds.split(",")), kind or "none"}))))

    def happen(self, at: int, out: list) -> None:
        out.append(tuple(self.kept.get()))
        self.kept.clear()  # a key without an open batch has no state


def change_batches(events: DataFrame, hold_ms: int = 350, delay: str = "0 seconds") -> DataFrame:
    """(key, start_us, notices, kinds) of each batch of a stream of notices: all that come within ``hold_ms`` after its first one."""
    out = in_time(events, delay).groupBy("key").transformWithStateInPandas(ChangeBatches(hold_ms * 1000), "key long, start_us long, notices long, kinds string", "append", "eventtime")
    return out


# The floor and cap of starts in a window.
FLOOR, CAP = 8, 240


@dataclass
class Pace:
    """``clean_us`` without a block before a probe; a block within ``again_us`` of the last, at the floor, cools for ``long_us``, any other for ``cool_us``."""

    clean_us: int
    again_us: int
    cool_us: int
    long_us: int


def midpoint(good: int | None, fail: int | None) -> int | None:
    """The setting to try between one that held and one that failed; null if none is left."""
    if good is None or fail is None or fail <= good + 1:
        return None
    return max((good + fail) // 2, good + 1)


class TripState(InOrder):
    """The search for a pace: a block puts the setting back to the floor and remembers where it failed; outputs tell what holds; a
    clean interval tries the midpoint."""

    columns = ["key", "at_us", "event_id", "kind", "was", "now", "good", "fail", "cool_until_us"]
    schema = "cur long, good long, fail long, cool long, bot long, step long"

    def __init__(self, pace: Pace) -> None:
        self.pace = pace

    def _get(self) -> list:
        return list(self.kept.get()) if self.kept.exists() else [FLOOR, None, None, None, None, None]

    def due(self) -> int | None:
        cur, good, fail, _, bot, step = self._get()
        probe = midpoint(good, fail)
        return None if probe is None or probe == cur or probe > CAP else max(bot or 0, step or 0) + self.pace.clean_us

    def happen(self, at: int, out: list) -> None:
        cur, good, fail, cool, bot, _ = self._get()
        probe = midpoint(good, fail)
        out.append((at, None, "probe", cur, probe, good, fail, cool))
        self.kept.update((probe, good, fail, cool, bot, at))

    def take(self, row: tuple, out: list) -> None:
        t, event, kind, value = row
        cur, good, fail, cool, bot, step = self._get()
        if kind == "pace_change" and value is not None:
            cur = max(FLOOR, min(CAP, value))
        elif kind == "mp3_verified" and good is not None and fail is not None and good < cur < fail:
            good = cur
        elif kind == "block":
            at_floor = cur <= FLOOR
            again = at_floor and bot is not None and t - bot < self.pace.again_us
            if not at_floor:
                fail = cur if fail is None else min(fail, cur)
                good = FLOOR if good is None or good >= cur else good
            cool = max(cool or 0, t + (self.pace.long_us if again else self.pace.cool_us))
            out.append((t, event, "repeat" if again else "floor" if at_floor else "trip", cur, FLOOR, good, fail, cool))
            cur, bot, step = FLOOR, t, t
        else:
            return
        self.kept.update((cur, good, fail, cool, bot, step))


def trip_state(events: DataFrame, pace: Pace, delay: str = "0 seconds") -> DataFrame:
    """(key, at_us, event_id, kind, was, now, good, fail, cool_until_us): a row for each block (trip, floor, repeat) and each probe
    (without event) of a stream (key, event_id, t_us, type, value); ``value`` is the setting of a ``pace_change``."""
    schema = "key long, at_us long, event_id long, kind string, was long, now long, good long, fail long, cool_until_us long"
    return in_time(events, delay).groupBy("key").transformWithStateInPandas(TripState(pace), schema, "append", "eventtime")


class Requests(InOrder):
    """The first event of a request is admitted; the others get what has become of it."""

    columns = ["request", "event_id", "verdict"]
    schema = "first string, completed boolean, seen long"

    def __init__(self, forget_us: int | None) -> None:
        self.forget_us = forget_us

    def due(self) -> int | None:
        return self.kept.get()[2] + self.forget_us if self.forget_us and self.kept.exists() else None

    def happen(self, at: int, out: list) -> None:
        self.kept.clear()

    def take(self, row: tuple, out: list) -> None:
        t, event, fingerprint, completes = row
        if not self.kept.exists():
            first, completed, verdict = fingerprint, False, "admitted"
        else:
            first, completed, _ = self.kept.get()
            verdict = "conflict" if fingerprint != first else "completed" if completed else "unfinished"
        out.append((event, verdict))
        self.kept.update((first, completed or bool(completes and fingerprint == first), t))


def idempotent_requests(events: DataFrame, forget_us: int | None = None, delay: str = "0 seconds") -> DataFrame:
    """(request, event_id, verdict) of each event of a stream (key, event_id, t_us, type, value): ``key`` is the request, ``type`` its
    fingerprint, ``value`` 1 if the event completes it.

    The first event of a request is ``admitted``; one with another fingerprint is a ``conflict``; with the same it gets the
    result if the request has ``completed``, else it is ``unfinished`` and nothing is done again. After ``forget_us`` without
    an event a request's state goes.
    """
    return in_time(events, delay).groupBy("key").transformWithStateInPandas(Requests(forget_us), "request string, event_id long, verdict string", "append", "eventtime")


class Alerts(InOrder):
    """The first sign of trouble of an incident."""

    columns = ["key", "event_id", "cause"]
    schema = "last long, errors long"

    def __init__(self, quiet_s: int) -> None:
        self.quiet_s = quiet_s

    def take(self, row: tuple, out: list) -> None:
        t, event, kind, n = row
        last, errors = self.kept.get() if self.kept.exists() else (None, None)
        cause = "block" if kind == "block" else "errors" if n is not None and errors is not None and n > errors else None
        now = t // 1_000_000
        if cause and (last is None or now - last > self.quiet_s):
            out.append((event, cause))
        if cause or n is not None:
            self.kept.update((now if cause else last, errors if n is None else n))


def error_alerts(events: DataFrame, quiet_s: int, delay: str = "0 seconds") -> DataFrame:
    """(key, event_id, cause) of the first event of each incident in a stream (key, event_id, t_us, type, value): ``value`` is a count of
    errors or null.

    A ``block``, or a count above the reading before, belongs to an incident; one that comes ``quiet_s`` or less after the last
    such event belongs to the same and raises nothing.
    """
    return in_time(events, delay).groupBy("key").transformWithStateInPandas(Alerts(quiet_s), "key long, event_id long, cause string", "append", "eventtime")


def event_rows(events: DataFrame) -> DataFrame:
    """(key, event_id, t_us, type, value) of an event table (key, event_id, t, type, k); ``value`` is the setting that ``k`` stands for."""
    return events.select(F.col("key").cast("long").alias("key"), F.col("event_id").cast("long").alias("event_id"), keys.micros("t").alias("t_us"), "type", (8 * (F.col("k") % 12)).cast("long").alias("value"))
