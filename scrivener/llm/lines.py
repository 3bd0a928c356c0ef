"""Rows of a group laid end to end in a pseudo-random order, without putting a group in one task.

A group is dealt into hash blocks; block sums give each block its offset, and only the rows of
one block are ordered together. The blocks of a group are capped (`MOST_BLOCKS`), which bounds the
table of offsets, not the rows: a group of any size keeps all its rows, and of 50 TB a block has 50 MB.

The block of a row follows from its key and `ties`, so rows of one key (null is a key) are dealt to all
blocks unless they tie in these too; such rows are alike, and any order of them is the same; empty tables
give no rows. Columns named block_, rank_, from_, sum_ and start_ must be free.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most hash blocks of a group.
MOST_BLOCKS = 1 << 20


def blocks_of(n: int, each: int) -> int:
    """Blocks for `n` units, `each` to a block."""
    return min(MOST_BLOCKS, max(1, -(-n // each)))


def in_blocks(rows: DataFrame, key: list[Column | str], n_blocks: Column, seed: int) -> DataFrame:
    """`rows` with `block_`, the hash block of the columns `key` within its group."""
    return rows.withColumn("block_", F.pmod(F.xxhash64(*key, F.lit(seed)), n_blocks.cast("long")).cast("int"))


def offsets(rows: DataFrame, group: str, size: str, seed: int) -> DataFrame:
    """A row a block: `rank_`, its place (from 0) among the group's blocks of some size in their
    pseudo-random order, `from_`, the sum of `size` before it, and `sum_`, its own."""
    order = Window.partitionBy(group).orderBy(F.xxhash64("block_", F.lit(seed)), "block_")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("sum_").over(past), F.lit(0)).cast("long")
    sums = rows.groupBy(group, "block_").agg(F.sum(size).cast("long").alias("sum_"))
    return sums.select(group, "block_", F.count(F.when(F.col("sum_") > 0, 1)).over(past).cast("int").alias("rank_"), before.alias("from_"), "sum_")


def lay_out(rows: DataFrame, starts: DataFrame, group: str, key: Column, size: str, seed: int, ties: list[Column]) -> DataFrame:
    """`rows` with their block's `rank_` and `start_`, the sum of `size` over the group's rows that
    come before. `group` must not be null; `ties` decide between equal hashes of `key`."""
    inner = Window.partitionBy(group, "block_").orderBy(F.xxhash64(key, F.lit(seed + 1)), *ties)
    before = F.coalesce(F.sum(size).over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    return rows.join(starts.select(group, "block_", "rank_", "from_"), [group, "block_"]).withColumn("start_", F.col("from_") + before).drop("from_")
