"""Plumbing shared by the training-data operators: tables, shared storage, Arrow rows."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivener.sources.storage import shared_folder

#: Rows a Python operator holds as Python objects at a time; batches are cut to it.
SLICE = 256
#: Characters, bytes and list entries after which an output batch leaves.
SLICE_SIZE = 4_000_000

#: A word of the size laws: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder every executor sees."""
    return f"{shared_folder(spark)}/scrivener/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, work: str | None = None) -> DataFrame:
    """Write `df` once to the shared folder (below `work`, if given) and read it back: cuts lineage,
    survives lost executors."""
    spark = df.sparkSession
    path = f"{work}/{name}-{uuid.uuid4().hex}" if work else scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop_stored(spark: SparkSession, df: DataFrame) -> None:
    """Delete a `stored` table that nothing will read again."""
    for file in df.inputFiles()[:1]:
        delete(spark, os.path.dirname(file))


def spread(df: DataFrame) -> DataFrame:
    """Deal a scan of fewer partitions than cores out evenly; larger inputs are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Rows of a driver-made table that may be broadcast; a longer one is joined by shuffle.
FEW = 100_000


def few(df: DataFrame, n: int) -> DataFrame:
    """`df`, of `n` rows, to be broadcast if they are few."""
    return F.broadcast(df) if n <= FEW else df


def ship(spark: SparkSession) -> None:
    """Make this package importable on executors that do not have it on their path."""
    sc, root = spark.sparkContext, Path(__file__).resolve().parents[2]
    on_path = {os.path.realpath(p or ".") for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(":")]}
    if str(root) in on_path or getattr(sc, "_scrivener_shipped", False):
        return
    target = Path(tempfile.mkdtemp()) / "scrivener_pkg.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in (root / "scrivener").rglob("*.py"):
            z.write(p, p.relative_to(root))
    sc.addPyFile(str(target))
    sc._scrivener_shipped = True


def give_back() -> None:
    """Return to the system what this worker has freed: workers are used again, and what tasks of earlier
    stages have left would add to an executor's memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_rows(df: DataFrame, make: Callable[[], Callable[..., Iterable[tuple]]], schema: str) -> DataFrame:
    """`mapInArrow` over rows: `make()` runs once a task and returns a function from the columns of
    a slice (lists) to output tuples; output leaves in small batches, so memory stays bounded."""
    ship(df.sparkSession)
    names = df.columns
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        cols = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, arrow.types, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        fn = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                held, size = [], 0
                for row in fn(*[part.column(i).to_pylist() for i in range(len(names))]):
                    held.append(row)
                    size += sum(len(x) for x in row if isinstance(x, str | bytes | list))
                    if len(held) >= SLICE or size > SLICE_SIZE:
                        yield packed(held)
                        held, size = [], 0
                if held:
                    yield packed(held)
        fn = batch = part = held = None
        give_back()

    return df.mapInArrow(run, schema)


def n_words(text) -> F.Column:
    """Number of words (runs of anything but ASCII white space); null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def map_groups(df: DataFrame, keys: list[str], fn: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """Rows that agree in `keys` go to `fn` together, as column lists in `df`'s order; a task streams
    its groups one after another, so it holds one group at a time."""
    ship(df.sparkSession)
    n_keys, names = len(keys), df.columns
    if names[:n_keys] != keys:
        raise ValueError("keys must be the first columns")
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group, key = [], [[] for _ in names], None

        def packed() -> pa.RecordBatch:
            cols = zip(*held, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, arrow.types, strict=True)], schema=arrow)

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if group[0] and row[:n_keys] != key:
                    held.extend(fn(*group))
                    group = [[] for _ in names]
                    if len(held) >= 4096:
                        yield packed()
                        held = []
                key = row[:n_keys]
                for column, x in zip(group, row, strict=True):
                    column.append(x)
        if group[0]:
            held.extend(fn(*group))
        if held:
            yield packed()
        held = group = batch = None
        give_back()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
