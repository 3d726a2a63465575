"""Keyed folds in event time: a stream's rows wait in state until the watermark has passed them, then go through a fold in order.

A fold sees the rows of its key in the order of (time, tie), whatever order and batches they arrived in, so it gives what a batch
over the same rows gives; rows later than the lateness bound are dropped by Spark before they reach it. Waiting rows are a list
state, the fold's memory a value state, and event-time timers call the fold when the watermark reaches the next waiting row or a
time that the fold itself has asked for, so that it can end something when no row comes any more. State is the rows of one lateness
bound and one memory a key; a fold that returns no memory leaves nothing of its key.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

Memory = dict[str, Any]


class Fold(Protocol):
    """Memory is JSON-ready; times are microseconds; rows that a fold emits are tuples of the output columns after the key."""

    def step(self, memory: Memory | None, at: int, row: dict) -> tuple[Memory, list[tuple]]:
        """Take the next row of the key."""

    def until(self, memory: Memory, watermark: int) -> tuple[Memory | None, list[tuple], int | None]:
        """No row up to the watermark can come any more: the memory to keep (None: nothing), rows, and when to ask again."""


class Replay(StatefulProcessor):
    def __init__(self, fold: Fold, columns: list[str]) -> None:
        self.fold, self.columns = fold, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, tie string, body string")
        self.memory = handle.getValueState("memory", "memory string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        return self.advance(key, timerValues, [(r["at"], r["tie"], r["body"]) for r in rows])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        return self.advance(key, timerValues, [])

    def close(self) -> None:
        pass

    def advance(self, key: Any, timers: Any, new: list[tuple]) -> Iterator[Row]:
        watermark = timers.getCurrentWatermarkInMs() * 1000
        rows = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        had, rows = bool(rows), rows + new
        ready = sorted((r for r in rows if r[0] <= watermark), key=lambda r: (r[0], int(r[1])))
        later = [r for r in rows if r[0] > watermark]
        memory, out = (json.loads(self.memory.get()[0]) if self.memory.exists() else None), []
        kept = memory is not None
        for at, _, body in ready:
            memory, emitted = self.fold.step(memory, at, json.loads(body))
            out += emitted
        due = None
        if memory is not None:
            memory, emitted, due = self.fold.until(memory, watermark)
            out += emitted
        if memory is not None:
            self.memory.update((json.dumps(memory),))
        elif kept:
            self.memory.clear()
        if later and (new or ready):
            self.waiting.put(later)
        elif had and not later:
            self.waiting.clear()
        # a timer in whole milliseconds, after what it waits for
        wanted = {-(-t // 1000) for t in (min((r[0] for r in later), default=None), due) if t is not None}
        for t in [t for t in self.handle.listTimers() if t not in wanted]:
            self.handle.deleteTimer(t)
        for t in wanted:
            self.handle.registerTimer(t)
        return iter([Row(**dict(zip(self.columns, (*key, *emitted)))) for emitted in out])


def replayed(rows: DataFrame, keys: list[str], fold: Fold, out: str, ts: str = "ts", tie: str | None = None, body: list[str | Column] | None = None) -> DataFrame:
    """The rows that `fold` emits: columns keys, then `out`. rows is a stream with a watermark on ts; `tie` (an integer) orders rows of
    one time; `body` are the columns the fold reads. State is kept by RocksDB, which timers and list states need."""
    spark = rows.sparkSession
    if spark.conf.get(_PROVIDER, "") != _ROCKSDB:
        spark.conf.set(_PROVIDER, _ROCKSDB)
    order = F.lit("0") if tie is None else F.col(tie).cast("string")
    given = rows.select(*keys, ts, F.unix_micros(ts).alias("at"), order.alias("tie"), F.to_json(F.struct(*(body or [F.lit(0).alias("none")]))).alias("body"))
    types = {f.name: f.dataType.simpleString() for f in given.schema}
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), out])
    columns = StructType.fromDDL(schema).names
    return given.groupBy(*keys).transformWithState(Replay(fold, columns), schema, "append", "eventTime")
