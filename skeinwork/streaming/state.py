"""Keyed state of a stream of actions: bursts of a path become its last action, and an upsert that changes nothing is left out."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .watch import DELETE

_OUT = "path string, action string, seq long, at long, events long"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Debounce(StatefulProcessor):
    """Of each path, the last action of a burst once no other follows within ``seconds``.

    ``seen`` marks what was last let through: an upsert with the same size and time of change isn't let through again, until
    the path changes or goes. By event time bursts are cut where events lie ``seconds`` apart and end when the watermark has
    passed; by processing time they are cut where events arrive that far apart.
    """

    def __init__(self, seconds: float, by_event_time: bool):
        self.wait, self.by_event_time = int(seconds * 1000), by_event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "action string, seq long, at long, size long, mtime_ns long, events long, due long")
        self.seen = handle.getValueState("seen", "size long, mtime_ns long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        held = self.pending.get() if self.pending.exists() else None
        before = held and held[6]
        for r in sorted(rows, key=lambda r: (r["at"], r["seq"])):
            at = r["at"] // 1000 if self.by_event_time else now
            if held and at >= held[6]:
                yield from self._through(key, held)
                held = None
            if held and (r["at"], r["seq"]) < (held[2], held[1]):  # older than what is held: it adds to the burst alone
                held = (*held[:5], held[5] + 1, held[6])
            else:
                held = (r["action"], r["seq"], r["at"], r["size"], r["mtime_ns"], (held[5] if held else 0) + 1, at + self.wait)
        self.pending.update(held)
        if before != held[6]:
            if before:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(held[6])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.pending.exists():
            held = self.pending.get()
            self.pending.clear()
            yield from self._through(key, held)

    def _through(self, key, held: tuple) -> Iterator[Row]:
        action, seq, at, size, mtime, events, _ = held
        if action == DELETE:
            self.seen.clear()
        elif self.seen.exists() and tuple(self.seen.get()) == (size, mtime):
            return
        else:
            self.seen.update((size, mtime))
        yield Row(path=key[0], action=action, seq=seq, at=at, events=events)

    def close(self) -> None:
        pass


def settled(actions: DataFrame, seconds: float = 2, late: str | None = None) -> DataFrame:
    """(path, action, seq, ts, events) of a stream of (path, action, seq, ts, size, mtime_ns): see ``Debounce``. With ``late`` by event time, and events
    that come later than that are left out; else by processing time."""
    rows = actions.select("path", "action", "seq", "ts", F.unix_micros("ts").alias("at"), "size", "mtime_ns")
    rows = rows.withWatermark("ts", late) if late else rows
    out = rows.groupBy("path").transformWithState(Debounce(seconds, late is not None), _OUT, "Append", "EventTime" if late else "ProcessingTime")
    return out.select("path", "action", "seq", F.timestamp_micros("at").alias("ts"), "events")


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Queries with keyed state that start inside keep it in RocksDB, as it has to be."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)
