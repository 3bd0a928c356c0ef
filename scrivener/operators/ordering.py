"""Global order without a global task: rows are dealt to ranges, numbered in each, and the ranges'
counts give their offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivener.sources.storage import stored

#: monotonically_increasing_id holds a partition's number above these bits and the row's place below.
ROW_BITS = 33


def numbered(df: DataFrame, *order: str | Column, name: str = "number", first: int = 0) -> DataFrame:
    """`df` with `name`, the place of each row in the given order, from `first`. Rows that tie have
    places in no defined order. The table of offsets has a row a partition."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # the row as one struct, so that no name of its columns clashes
    rows = stored(ranged.select(F.struct(*df.columns).alias("row_"), F.monotonically_increasing_id().alias("at_")), "numbered")
    part = F.shiftright("at_", ROW_BITS)
    counts = rows.groupBy(part.alias("part_")).agg(F.count("*").alias("n_"))
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("from_"))
    at = F.col("from_") + F.col("at_") - F.shiftleft("part_", ROW_BITS) + first
    return rows.join(F.broadcast(starts), part == F.col("part_")).select("row_.*", at.cast("long").alias(name))
