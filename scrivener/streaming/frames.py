"""Clips as streams of numbered frames, each folded in the batch that brings it: the numbers tell what comes next,
so no watermark has to pass and no clip is kept whole.

A clip's buffer holds its last samples, however long it runs. A batch folds the frames that follow the last one folded;
those with one missing before them are held until it comes, and a frame that comes again is dropped. So any deal of
the frames into batches gives the same rows. What is open after a batch (buffers and held frames) lies in the
batch's folder and goes into the next one; a clip's `last` frame closes it, and its key is not to be used again.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from scrivener.operators.audio import BAR_SCALE, BAR_WINDOW, BARS

#: Kinds of rows, as they sort: what a frame gave, frames, and buffers, whose `frame` is the last one folded.
SHOWN, FRAME, BUFFER = "bars", "frame", "tail"
ROWS = "clip string, clip_id bigint, kind string, frame bigint, samples array<double>, last boolean, n bigint, bars array<double>"
NONE = np.zeros(0)


def loudness(tail: np.ndarray, bars: int = BARS, scale: float = BAR_SCALE) -> np.ndarray:
    """`audio.amplitude_bars` of a buffer, with sums in the order of its samples."""
    each = max(len(tail) // bars, 1)
    whole = min(len(tail) // each, bars)
    slices = np.ascontiguousarray(tail[: whole * each].reshape(whole, each).T)  # sums of columns go row by row
    out = np.zeros(bars)
    out[:whole] = np.fmin(np.sqrt((slices * slices).sum(axis=0) / each) * scale, 1.0)
    return out


def numbered_frames(clips: DataFrame, size: int) -> DataFrame:
    """The frames of `size` samples of whole clips (clip, clip_id, samples); a clip without samples is one empty frame."""
    whole = clips.withColumn("samples", F.coalesce("samples", F.array().cast("array<double>")))
    ends = F.greatest(F.ceil(F.size("samples") / size).cast("int") - 1, F.lit(0))
    at = whole.withColumn("end_", ends).withColumn("frame", F.explode(F.sequence(F.lit(0), F.col("end_"))))
    return at.select("clip", "clip_id", F.col("frame").cast("long").alias("frame"), F.slice("samples", F.col("frame") * size + 1, F.lit(size)).alias("samples"), (F.col("frame") == F.col("end_")).alias("last"))


def folded(rows: DataFrame, window: int = BAR_WINDOW) -> DataFrame:
    """Of frames and what was open before them (ROWS) the bars after each frame that follows, and what is open now.
    A null sample is silence. A task holds one batch of rows and one clip's buffer."""
    arrow = to_arrow_schema(rows.sparkSession.createDataFrame([], ROWS).schema)

    def run(batches):
        clip, state = None, None  # the clip's key and id; its last frame, its samples so far, its buffer, whether it is closed
        out: list[tuple] = []

        def packed() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            lists = {4: columns[4], 7: columns[7]}
            made = [pa.array(c, f.type) if i not in lists else _lists(c, f.type) for i, (c, f) in enumerate(zip(columns, arrow, strict=True))]
            return pa.RecordBatch.from_arrays(made, schema=arrow)

        def leave() -> None:
            at, n, tail, closed = state
            if not closed and at >= 0:
                out.append((*clip, BUFFER, at, tail, False, n, None))

        for batch in batches:
            keys, ids, kinds, frames, lasts, counts = (batch.column(k).to_pylist() for k in ("clip", "clip_id", "kind", "frame", "last", "n"))
            lists = batch.column("samples")
            values = lists.flatten()
            values = values.fill_null(0.0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            for i, key in enumerate(keys):
                if clip is None or key != clip[0]:
                    if clip is not None:
                        leave()
                    clip, state = (key, ids[i]), (-1, 0, NONE, False)
                at, n, tail, closed = state
                samples = values[ends[i - 1] if i else 0 : ends[i]]
                if kinds[i] == BUFFER:
                    state = (frames[i], counts[i], samples.copy(), False)
                elif frames[i] == at + 1 and not closed:
                    tail = np.concatenate((tail, samples))[-window:]
                    state = (at + 1, n + len(samples), tail, lasts[i])
                    out.append((*clip, SHOWN, at + 1, None, lasts[i], state[1], loudness(tail)))
                elif frames[i] > at and not closed:
                    out.append((*clip, FRAME, frames[i], samples, lasts[i], None, None))
            if out:
                yield packed()
                out.clear()
        if clip is not None:
            leave()
        if out:
            yield packed()

    order = ["clip", F.col("kind").desc(), "frame"]
    # by number: frames are packed so well that by their bytes a few tasks would get them all
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, "clip").sortWithinPartitions(*order).mapInArrow(run, ROWS)


def _lists(arrays: tuple, kind: pa.DataType) -> pa.Array:
    """A column of lists of doubles; None gives null."""
    lengths = np.array([0 if a is None else len(a) for a in arrays])
    offsets = pa.array(np.append(0, np.cumsum(lengths)), pa.int32())
    values = pa.array(np.concatenate([NONE, *[a for a in arrays if a is not None]]))
    return pa.ListArray.from_arrays(offsets, values, type=kind, mask=pa.array([a is None for a in arrays]))


def tails(path: str) -> Callable[[DataFrame, int], None]:
    """A writer of batches of frames (clip, clip_id, frame, samples, last) into folders of their numbers, which
    repeating one replaces; `shown` reads them."""

    def write(batch: DataFrame, number: int) -> None:
        frames = batch.withColumns({"kind": F.lit(FRAME), "n": F.lit(None).cast("long"), "bars": F.lit(None).cast("array<double>")})
        if number > 0:
            before = batch.sparkSession.read.schema(ROWS).parquet(f"{path}/batch={number - 1}")
            frames = frames.unionByName(before.filter(F.col("kind") != SHOWN))
        folded(frames).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def shown(spark: SparkSession, path: str) -> DataFrame:
    """(clip, clip_id, frame, last, n, bars): the bars after each frame, and how many samples had come."""
    return spark.read.parquet(path).filter(F.col("kind") == SHOWN).select("clip", "clip_id", "frame", "last", "n", "bars")
