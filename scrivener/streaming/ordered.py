"""Folds over a key's events in order of event time, with timers, as streams and over tables.

A `Fold` is a state machine: it takes events in order of (ts, event_id), may ask for one timer, and gives
rows. `stream` holds a key's events in state until the watermark has passed them, so that any
deal of the events into files and batches gives the rows of `over_table`, which are those of the sorted table;
rows later than the watermark allows are dropped, which begins at 1970. A timer runs by event time: it goes off before the first
event at or after its instant, and a machine that no longer wants it moves or withdraws it, so a timer that
was set for a state long left does nothing. Rows without an instant are dropped; rows that repeat are taken each;
a null key is a key; empty inputs give no rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor

#: The event that closes a stream (`closing`), which no fold gets to see.
CLOSE = "close"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Fold:
    """One key's machine. `state` is what JSON can hold; instants are microseconds."""

    schema: str

    def start(self):
        """The state before the first event."""

    def step(self, state, ts: int, event_id: int, event: str) -> tuple[object, Iterable[tuple]]:
        """The state after an event, and rows."""
        raise NotImplementedError

    def due(self, state) -> int | None:
        """The instant of the state's timer."""

    def timed(self, state, ts: int) -> tuple[object, Iterable[tuple]]:
        """The state after its timer went off, and rows."""
        return state, ()


def advanced(fold: Fold, state, events: Iterable[tuple[int, int, str]], until: int | None = None) -> tuple[object, list[tuple]]:
    """The state after the sorted `events` and every timer due before them or at most `until` (all, if None)."""
    out: list[tuple] = []

    def timers(state, before: int | None):
        while (due := fold.due(state)) is not None and (before is None or due <= before):
            state, rows = fold.timed(state, due)
            out.extend(rows)
        return state

    for ts, event_id, event in events:
        state = timers(state, ts)
        state, rows = fold.step(state, ts, event_id, event)
        out.extend(rows)
    return timers(state, until), out


def keyed(events: DataFrame, key: str, event: Column, ts: str = "ts") -> DataFrame:
    """(key_, ts, at_, event_id, event_) of the rows with an instant and an event."""
    kind = F.col(ts).cast("timestamp")
    return events.select(F.col(key).cast("long").alias("key_"), kind.alias("ts"), F.unix_micros(kind).alias("at_"), F.col("event_id").cast("long").alias("event_id"), event.alias("event_")).filter("ts is not null and event_ is not null")


def _frame(key, rows: list[tuple], names: list[str]):
    import pandas as pd

    made = pd.DataFrame(rows, columns=names[1:], dtype=object)
    made.insert(0, names[0], pd.Series([key] * len(rows), dtype=object))
    return made


class InOrder(StatefulProcessor):
    """Buffers what the watermark has not passed; a timer a key wakes it for its next event or its fold's timer."""

    def __init__(self, fold: Fold, names: list[str]):
        self.fold, self.names = fold, names

    def init(self, handle) -> None:
        self.handle = handle
        # an entry holds what a batch brought as a JSON list: a state store's cost is by entry
        self.buffer = handle.getListState("buffer", "events string")
        self.state = handle.getValueState("state", "json string, woken long")

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        columns = [[frame[c].tolist() for c in ("at_", "event_id", "event_")] for frame in rows]
        new = [e for c in columns for e in zip(*c, strict=True) if e[2] != CLOSE]
        if new:
            self.buffer.appendValue((json.dumps(new),))
            held = self.state.get()
            self._wake(held[0] if held else json.dumps(self.fold.start()), held[1] if held else None, min(new)[0])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(tuple(e) for (events,) in self.buffer.get() for e in json.loads(events))
        ready, rest = [e for e in held if e[0] < until], [e for e in held if e[0] >= until]
        state, rows = advanced(self.fold, json.loads(self.state.get()[0]), ready, until - 1)
        if len(rest) < len(held):
            self.buffer.clear()
            if rest:
                self.buffer.put([(json.dumps(rest),)])
        self.state.update((json.dumps(state), None))
        due = [x for x in (rest[0][0] if rest else None, self.fold.due(state)) if x is not None]
        if due:
            self._wake(json.dumps(state), None, min(due))
        if rows:
            yield _frame(key[0], rows, self.names)

    def _wake(self, state: str, set_for: int | None, at: int) -> None:
        ms = at // 1000
        if set_for is None or ms < set_for:
            if set_for is not None:
                self.handle.deleteTimer(set_for)
            self.handle.registerTimer(ms)
            set_for = ms
        self.state.update((state, set_for))

    def close(self) -> None:
        pass


def stream(events: DataFrame, fold: Fold, key: str = "user_id", late: str = "1 hour") -> DataFrame:
    """`fold` over a stream of `keyed` events: (key, *fold.schema)."""
    schema = f"{key} bigint, {fold.schema}"
    names = [c.split()[0] for c in schema.split(", ")]
    waiting = events.withWatermark("ts", late)
    return waiting.groupBy("key_").transformWithStateInPandas(InOrder(fold, names), schema, "append", "eventTime")


def over_table(events: DataFrame, fold: Fold, key: str = "user_id") -> DataFrame:
    """`fold` over a table of `keyed` events, to the end of time. A task streams its keys' events in
    order and holds one batch and one state."""
    schema = f"{key} bigint, {fold.schema}"
    arrow = to_arrow_schema(events.sparkSession.createDataFrame([], schema).schema)

    def run(batches):
        current, state, out = None, None, []

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), arrow.types, strict=True)], schema=arrow)

        def take(events: list[tuple], closing: bool) -> None:
            nonlocal state
            # `until` lies before any instant, unless the key is at its end
            state, rows = advanced(fold, state, events, None if closing else -(1 << 62))
            out.extend((current[0], *r) for r in rows)

        for batch in batches:
            held: list[tuple] = []
            for k, at, event_id, event in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if current is None or k != current[0]:
                    if current is not None:
                        take(held, True)
                    current, state, held = (k,), fold.start(), []
                held.append((at, event_id, event))
            if current is not None:
                take(held, False)
            if out:
                yield packed()
                out = []
        if current is not None:
            take([], True)
        if out:
            yield packed()

    rows = events.select("key_", "at_", "event_id", "event_")
    return rows.repartition("key_").sortWithinPartitions("key_", "at_", "event_id", "event_").mapInArrow(run, schema)


def run_to_end(source: Callable[[], DataFrame], closing: str, write: Callable[[DataFrame, int], None], checkpoint: str, of: Callable[[DataFrame], DataFrame]) -> None:
    """Process what `source` (a stream of `keyed` rows) has, then close it: a row far in the future,
    written to the folder `closing`, lets the watermark pass all events and timers. To be run again after a failure."""
    session = source().sparkSession
    old = session.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    end = session.range(1).select(F.lit(None).cast("long").alias("key_"), F.to_timestamp(F.lit("2250-01-01 00:00:00")).alias("ts"), F.lit(0).cast("long").alias("at_"), F.lit(0).cast("long").alias("event_id"), F.lit(CLOSE).alias("event_"))
    end.limit(0).write.mode("append").parquet(closing)
    try:
        for last in (False, True):
            if last:
                end.write.mode("append").parquet(closing)
            ends = session.readStream.schema(end.schema).parquet(closing)
            rows = of(source().unionByName(ends))
            rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    finally:
        if old is None:
            session.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            session.conf.set("spark.sql.streaming.stateStore.providerClass", old)
