"""Live totals: every quantity event updates its session's summary.

State is a map of each session's lines to their quantities, in RocksDB: a batch reads and writes the lines that its events name, not the others. In
a batch a session's events are applied in (ts, event_id) order; events behind the watermark are dropped by the stream. After all events the
totals equal the batch forms: ``quantities`` and ``compute_budget``.

A session that has had no event for ``idle`` is settled: when the watermark passes that time a timer drops its state. An event that comes
later still begins a new session under the same id, from nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import budget, menu

STORE, ROCKSDB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
IDLE = "30 days"
LINES = "session_id long, menu_id long, item_id string, variant_id string, qty long"


def apply_events(lines: dict[str, int], events: pd.DataFrame) -> dict[str, int]:
    """Quantities by line after a session's events, which come sorted."""
    for key, op, qty in zip(events["key"], events["op"], events["qty"]):
        before = lines.get(key, 0)
        after = {"set": max(0, int(qty)) if op == "set" and pd.notna(qty) else 0, "add": before + 1, "remove": max(0, before - 1), "delete": 0, "clear": 0}.get(op, before)
        lines.pop(key, None)
        if after:
            lines[key] = after
    return lines


class _Lines(StatefulProcessor):
    """A session's lines (menu_id, item_id, variant_id) to qty, and one timer, ``idle_ms`` after its last event."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lines = handle.getMapState("lines", "menu_id long, item_id string, variant_id string", "qty long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        events["key"] = list(zip(events["menu_id"].astype(int), events["item_id"], events["variant_id"]))
        before = {line: self.lines.getValue(line)[0] for line in events["key"].unique() if self.lines.containsKey(line)}
        after = apply_events(dict(before), events)
        for line in before.keys() - after.keys():
            self.lines.removeKey(line)
        for line, qty in after.items():
            if before.get(line) != qty:
                self.lines.updateValue(line, (qty,))
        settled = int(events["ts"].max().timestamp() * 1000) + self.idle_ms
        for timer in list(self.handle.listTimers()):
            settled = max(settled, timer)
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(settled)
        found = [(key[0], int(line[0]), line[1], line[2], qty[0]) for line, qty in self.lines.iterator()]
        # A session without lines is told by one row without an item.
        yield pd.DataFrame(found or [(key[0], None, None, None, 0)], columns=["session_id", "menu_id", "item_id", "variant_id", "qty"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.lines.clear()
        return iter(())


def live_lines(events: DataFrame, *, watermark: str = "1 day", idle: str = IDLE) -> DataFrame:
    """All lines of each session that a batch touched, after it; ``events`` stream: session_id, menu_id, item_id, variant_id, ts,
    event_id, op, qty. The session's state store must be RocksDB (``start_live_totals`` sees to it)."""
    own = events.select(F.col("session_id").cast("bigint").alias("session_id"), F.col("menu_id").cast("bigint").alias("menu_id"), "item_id", "variant_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "op", F.col("qty").cast("double").alias("qty"))
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    return own.withWatermark("ts", watermark).groupBy("session_id").transformWithStateInPandas(_Lines(idle_ms), LINES, "Update", "EventTime")


def summaries(lines: DataFrame, sessions: DataFrame, items: DataFrame) -> DataFrame:
    """The touched sessions' summaries."""
    touched = sessions.join(lines.select("session_id").distinct(), "session_id", "left_semi")
    return budget.compute_budget(touched, menu.resolve_selections(lines.filter("item_id is not null"), items))


def start_live_totals(events: DataFrame, sessions: DataFrame, items: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, *, watermark: str = "1 day", idle: str = IDLE, **trigger) -> StreamingQuery:
    """Start the stream; ``sink`` gets the touched sessions' summaries of each batch, and its number to be idempotent by."""

    def batch(lines: DataFrame, number: int) -> None:
        lines.persist()
        try:
            sink(summaries(lines, sessions, items), number)
        finally:
            lines.unpersist()

    spark = events.sparkSession
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKSDB)
    try:
        out = live_lines(events, watermark=watermark, idle=idle).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        return out.trigger(**(trigger or {"availableNow": True})).foreachBatch(batch).start()
    finally:
        spark.conf.set(STORE, before)
