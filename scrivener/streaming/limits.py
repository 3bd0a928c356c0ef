"""One rate limit over all events of a process, without one task: what is accepted depends on the last
event accepted before, so each range of instants becomes a map from "last accepted before it" to
"last accepted after it"; maps are composed in a tree, and every range then marks its own.

A map is a step function: thresholds of `last + gap` and the exits they lead to. Chains from
different entries soon meet, so a map is mostly a few steps; at worst it has as many as the range's instants
in its first `gap`. A task holds the maps of `FAN` ranges. Rows without an instant are dropped;
ties go by event_id; repeated rows are taken each; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivener.sources.storage import stored

from .recorder import FEEDBACK_GAP, SECOND

#: Ranges that are composed in one task.
FAN = 16
#: Rows of a range, about: what a task holds of them at a time.
RANGE_ROWS = 100_000
#: Before any instant, and not in danger of passing 64 bits when a gap is added.
NEVER = -(1 << 62)


def range_map(at: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Thresholds and exits of the sorted instants `at`: the first threshold not below `last + gap` gives
    the last accepted instant; beyond all of them nothing is accepted."""
    exits, n = at.copy(), np.searchsorted(at, at + gap)
    # the next accepted of each, doubled until all chains have ended
    to = np.where(n < len(at), n, np.arange(len(at)))
    while (further := to[to]).tolist() != to.tolist():
        to = further
    return shortened(at, exits[to])


def shortened(thresholds: np.ndarray, exits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of neighbouring steps with one exit the last."""
    if not len(exits):
        return thresholds, exits
    ends = np.append(exits[1:] != exits[:-1], True)
    return thresholds[ends], exits[ends]


def through(last: np.ndarray, gap: int, thresholds: np.ndarray, exits: np.ndarray) -> np.ndarray:
    """The last accepted instants after a map, from those before it."""
    k = np.searchsorted(thresholds, last + gap)
    return np.where(k < len(exits), np.append(exits, 0)[np.minimum(k, len(exits))], last)


def composed(first: tuple[np.ndarray, np.ndarray], then: tuple[np.ndarray, np.ndarray], gap: int) -> tuple[np.ndarray, np.ndarray]:
    """The map of `first` and `then` in turn: what the first accepts nothing of goes to the second as it is."""
    beyond = then[0] > (first[0][-1] if len(first[0]) else NEVER)
    return shortened(np.concatenate((first[0], then[0][beyond])), np.concatenate((through(first[1], gap, *then), then[1][beyond])))


def accepted_at(at: np.ndarray, gap: int, last: int) -> list[int]:
    """Places in the sorted instants `at` that are accepted after `last`."""
    places, i = [], int(at.searchsorted(last + gap))
    while i < len(at):
        places.append(i)
        i = int(at.searchsorted(at[i] + gap)) if gap > 0 else i + 1
    return places


def limited(events: DataFrame, gap: int = FEEDBACK_GAP, last: int = NEVER, ranges: int | None = None) -> DataFrame:
    """(user_id, event_id, ts) of the events that are at least `gap` seconds after the last one accepted of all,
    `last` (in microseconds) being the one before them."""
    import pandas as pd

    gap *= SECOND
    kind = events.schema["ts"].dataType.simpleString()
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events.filter("ts is not null").select("user_id", "event_id", "ts", us.alias("us"))
    # as many as the rows need, so that no range grows with the table
    dealt = rows.repartitionByRange(ranges or 1 + rows.count() // RANGE_ROWS, "us", "event_id")
    # written, so that a range is what it was, whatever is lost
    rows = stored(dealt.withColumn("range", F.spark_partition_id().cast("long")), "limit-ranges")
    spark = rows.sparkSession
    if gap <= 0:
        return rows.select("user_id", "event_id", "ts")
    blank = "id long, thresholds array<long>, exits array<long>"

    def of_range(key, pdf):
        t, e = range_map(np.sort(pdf["us"].to_numpy()), gap)
        return pd.DataFrame({"id": [key[0]], "thresholds": [t], "exits": [e]})

    def of_group(key, pdf):
        pdf = pdf.sort_values("id")
        found = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
        for t, e in zip(pdf["thresholds"], pdf["exits"], strict=True):
            found = composed(found, (np.asarray(t, dtype=np.int64), np.asarray(e, dtype=np.int64)), gap)
        return pd.DataFrame({"id": [key[0]], "thresholds": [found[0]], "exits": [found[1]]})

    def entries(key, pdf):
        """(id, last) of a group's members, from the group's own."""
        pdf, at, out = pdf.sort_values("id"), None, []
        for i, t, e, given in zip(pdf["id"], pdf["thresholds"], pdf["exits"], pdf["last"], strict=True):
            at = np.array([given]) if at is None else at
            out.append((i, int(at[0])))
            at = through(at, gap, np.asarray(t, dtype=np.int64), np.asarray(e, dtype=np.int64))
        return pd.DataFrame(out, columns=["id", "last"])

    # up the tree, until one map is left
    levels = [stored(rows.select("range", "us").groupBy("range").applyInPandas(of_range, blank), "limit-maps")]
    width = rows.agg(F.max("range")).first()[0]
    while width:
        width //= FAN
        levels.append(stored(levels[-1].groupBy(F.floor(F.col("id") / FAN).alias("group")).applyInPandas(of_group, blank), "limit-maps"))
    # and down again: what was accepted last before each
    before = spark.createDataFrame([(0, last)], "id long, last long")
    for level in reversed(levels[:-1]):
        below = level.withColumn("group", F.floor(F.col("id") / FAN)).join(before.withColumnRenamed("id", "of"), F.col("group") == F.col("of"))
        before = stored(below.groupBy("group").applyInPandas(entries, "id long, last long"), "limit-lasts")

    def marked(key, pdf):
        pdf = pdf.sort_values(["us", "event_id"])
        return pdf.iloc[accepted_at(pdf["us"].to_numpy(), gap, int(pdf["last"].iloc[0]))][["user_id", "event_id", "us"]]

    # a range has one row of `before`; instants stay microseconds until they are given back
    found = rows.drop("ts").join(before, F.col("range") == F.col("id")).groupBy("range").applyInPandas(marked, "user_id long, event_id long, us long")
    return found.select("user_id", "event_id", F.timestamp_micros("us").cast(kind).alias("ts"))


def limiting(path: str, gap: int = FEEDBACK_GAP, late: int = 3600) -> tuple[Callable[[DataFrame, int], None], Callable]:
    """A batch writer and its end. The writer holds events until they are `late` seconds older than the
    newest, so that batches may bring them in any order within that; each batch writes what it accepted, what waits
    and where it stands into folders of its number, which repeating it replaces. Events older than what
    has been decided are dropped. The end decides what still waits."""
    where = "newest bigint, decided bigint, last bigint"

    def state(spark, number: int) -> tuple[int, int, int]:
        row = spark.read.schema(where).json(f"{path}/state/batch={number}").first() if number >= 0 else None
        return tuple(row) if row else (NEVER, NEVER, NEVER)

    def decide(batch: DataFrame | None, number: int, spark) -> None:
        newest, decided, last = state(spark, number - 1)
        us = F.unix_micros(F.col("ts").cast("timestamp"))
        rows = [] if batch is None else [batch.filter("ts is not null").select("user_id", "event_id", "ts").filter(us >= decided)]
        if number > 0:
            rows.append(spark.read.parquet(f"{path}/waiting/batch={number - 1}"))
        held = rows[0].unionByName(rows[1]) if len(rows) > 1 else rows[0]
        held = stored(held, "limit-held")
        newest = max(newest, held.agg(F.max(us)).first()[0] or NEVER)
        until = newest + 1 if batch is None else max(decided, newest - late * SECOND)
        accepted = limited(held.filter(us < until), gap, last)
        accepted.write.mode("overwrite").parquet(f"{path}/out/batch={number}")
        held.filter(us >= until).write.mode("overwrite").parquet(f"{path}/waiting/batch={number}")
        now = spark.read.parquet(f"{path}/out/batch={number}").agg(F.max(us)).first()[0]
        spark.createDataFrame([(newest, until, last if now is None else now)], where).coalesce(1).write.mode("overwrite").json(f"{path}/state/batch={number}")

    def write(batch: DataFrame, number: int) -> None:
        decide(batch, number, batch.sparkSession)

    def end(spark, number: int) -> None:
        decide(None, number, spark)

    return write, end
