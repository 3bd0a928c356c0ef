"""Dictation as streams: event logs, daily totals, expiry, rate limits, recorder states."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, timedelta
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivener.operators.app import state_after, state_map

from .limits import NEVER, accepted_at
from .recorder import FEEDBACK_GAP, SECOND

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def file_stream(spark: SparkSession, folder: str, name: str, schema: str, files_each: int = 1) -> DataFrame:
    """A stream of the file (or folder of files) `name` in `folder`."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(f"{folder}/{name}")
    return reader.option("pathGlobFilter", name).parquet(folder)


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet", files_each: int = 1) -> DataFrame:
    """The events of `file_stream`; `ts` becomes an instant, as watermarks need."""
    return file_stream(spark, folder, name, EVENTS, files_each).withColumn("ts", F.col("ts").cast("timestamp"))


def run_once(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process what is there by micro-batches, exactly once by batch id, and stop."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def appended_log(path: str) -> Callable[[DataFrame, int], None]:
    """A batch writer that puts each batch in a folder of its own, so that repeating one after a
    failure replaces it."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def upserted(path: str) -> Callable[[DataFrame, int], None]:
    """A writer of update-mode batches: each batch's totals in a folder of its number, so that repeating
    one changes nothing; `latest` reads the newest total of each key."""
    return appended_log(path)


def latest(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """Of what `upserted` wrote the row of the highest batch for each key."""
    rows = spark.read.parquet(path)
    others = [c for c in rows.columns if c not in keys and c != "batch"]
    newest = rows.groupBy(*keys).agg(F.max(F.struct("batch", *others)).alias("row_"))
    return newest.select(*keys, *[F.col(f"row_.{c}").alias(c) for c in others])


def daily_words(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """(day, words, n) by event time, with a watermark for rows up to `late` late. To be run in update
    mode into `upserted`: the totals so far of each day that a batch has changed, the open day too."""
    words = F.get_json_object("props", "$.k").cast("long")
    by_day = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"))
    return by_day.agg(F.sum(words).alias("words"), F.count("*").alias("n")).select(F.col("w.start").alias("day"), "words", "n")


def kept_within(events: DataFrame, ttl: str = "30 days") -> DataFrame:
    """Events without repeats of an id within `ttl`; older state is dropped."""
    return events.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["event_id"])


class ExpiringLog:
    """A log whose rows expire `days` after its newest event, as a setting says that may change: batches lie in
    folders by day and batch, and beside them one row a batch holds the newest instant and the setting so far,
    so that neither a batch nor a change of the setting reads the log. Days that have passed as a whole
    are deleted; what has expired of the last one is left out by `rows`. Without a setting, or where it
    is not positive, nothing expires. Rows without an instant are not kept; repeating a batch or a setting's
    batch replaces it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _files(self, pattern: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = hadoop(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        return fs, [f.getPath() for f in fs.globStatus(hadoop(f"{self.path}/{pattern}")) or []]

    def _held(self, kind: str, below: int | None = None) -> tuple[int, int] | None:
        """The latest row of `kind` (of batches under `below`): when it counts from, and its value."""
        _, there = self._files(f"{kind}/batch=*")
        there = [p.toString() for p in there if below is None or int(p.getName().removeprefix("batch=")) < below]
        rows = [tuple(r) for r in self.spark.read.schema("at long, value long").json(there).collect()] if there else []
        return max(rows, default=None)

    def _hold(self, kind: str, number: int, at: int, value: int) -> None:
        row = max((at, value), self._held(kind, number) or (at, value))
        self.spark.createDataFrame([row], "at long, value long").coalesce(1).write.mode("overwrite").json(f"{self.path}/{kind}/batch={number}")
        # this row and the one before it, should the batch be repeated, are enough
        fs, there = self._files(f"{kind}/batch=*")
        for old in sorted(there, key=lambda p: int(p.getName().removeprefix("batch=")))[:-2]:
            fs.delete(old, True)

    def newest(self) -> int | None:
        """The newest event's instant in microseconds."""
        return (self._held("newest") or (None, None))[1]

    def days(self) -> int | None:
        return (self._held("setting") or (None, None))[1]

    def write(self, batch: DataFrame, number: int) -> None:
        """A batch of events."""
        us = F.unix_micros(F.col("ts").cast("timestamp"))
        kept = batch.filter("ts is not null").withColumns({"day": F.to_date("ts"), "batch": F.lit(number)})
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(f"{self.path}/rows")
        newest = batch.agg(F.max(us)).first()[0]
        if newest is not None:
            self._hold("newest", number, newest, newest)
        self.expire()

    def set(self, settings: DataFrame, number: int) -> None:
        """A batch of settings (ts, days), of which the latest holds from now on."""
        us = F.unix_micros(F.col("ts").cast("timestamp"))
        row = settings.filter("ts is not null").agg(F.max(F.struct(us.alias("at"), "days")).alias("s")).first()[0]
        if row is not None:
            self._hold("setting", number, row[0], row[1])
        self.expire()

    def bound(self) -> int | None:
        """The instant before which rows have expired."""
        newest, days = self.newest(), self.days()
        return None if newest is None or not days or days < 0 else newest - days * 86_400_000_000

    def expire(self) -> None:
        """Delete the days that have passed; lists days, reads no events."""
        if (bound := self.bound()) is None:
            return
        last = (datetime(1970, 1, 1) + timedelta(microseconds=bound)).date()
        fs, folders = self._files("rows/day=*")
        for folder in folders:
            day = folder.getName().removeprefix("day=")
            if day[:4].isdigit() and date.fromisoformat(day) < last:
                fs.delete(folder, True)

    def rows(self) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.path}/rows").drop("batch", "day")
        bound = self.bound()
        return rows if bound is None else rows.filter(F.unix_micros(F.col("ts").cast("timestamp")) >= bound)


def rate_limited_table(events: DataFrame, gap: int = FEEDBACK_GAP) -> DataFrame:
    """(user_id, event_id, ts): of each user's events those at least `gap` seconds after the last one accepted.
    A task streams its users' events in order and holds one batch and one instant. `limits.limited` is the
    limit over all users; `recorder.Accepted` this one as a stream."""
    kind = events.schema["ts"].dataType.simpleString()
    rows = events.filter("ts is not null").select("user_id", "event_id", "ts")

    def run(batches):
        user, last = None, NEVER
        for batch in batches:
            at = batch.column(2).cast(pa.timestamp("us", batch.column(2).type.tz)).cast(pa.int64()).to_numpy()
            users = batch.column(0).fill_null(np.iinfo(np.int64).min).to_numpy()
            cuts = [0, *(np.flatnonzero(users[1:] != users[:-1]) + 1).tolist(), len(at)]
            found = []
            for a, b in pairwise(cuts):
                if a < b and users[a] != user:
                    user, last = users[a], NEVER
                places = accepted_at(at[a:b], gap * SECOND, last)
                last = int(at[a + places[-1]]) if places else last
                found += [a + p for p in places]
            if found:
                yield batch.take(pa.array(found, pa.int64()))

    return rows.repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id").mapInArrow(run, f"user_id bigint, event_id bigint, ts {kind}")


def recorder_states(events: DataFrame, event: Column) -> DataFrame:
    """(user_id, state, n): the recorder's state after all of a user's events in order. A day's events
    are one map from the state before to the state after; a user's days are then applied in order, so
    no task holds more than a user's day or a user's list of days."""
    day = F.date_trunc("day", "ts").alias("day_")
    listed = events.groupBy("user_id", day).agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", event.alias("e")))).alias("rows"), F.count("*").alias("n"))
    days = listed.select("user_id", "day_", "n", state_map(F.transform("rows", lambda r: r["e"])).alias("map_"))
    rows = days.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("day_", "map_"))).alias("days_"), F.sum("n").alias("n"))
    return rows.select("user_id", state_after(F.transform("days_", lambda d: d["map_"])).alias("state"), "n")


def buffered(frames: DataFrame, samples: str = "samples") -> DataFrame:
    """(clip_id, samples): frames (clip_id, frame, samples) joined in order into one buffer a clip."""
    rows = frames.groupBy("clip_id").agg(F.sort_array(F.collect_list(F.struct("frame", samples))).alias("rows"))
    return rows.select("clip_id", F.flatten(F.transform("rows", lambda r: r[samples])).alias("samples"))
