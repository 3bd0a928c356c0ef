"""Interaction audit of document filters by a subset-zeta transform.

Each text gets the mask of the filters that it fails. Documents are counted by part and mask, so that a
part of any size is at most 32 rows; the zeta transform (sums over subsets, one bit at a time) turns
these counts into the survivors of every subset of filters. A step of an order is the difference between two
neighbouring subsets, and so are its good and toxic losses.

Filters, by their letters; a document fails
  A  under `MIN_WORDS` words (runs of anything but ASCII white space)
  B  distinct words (case-sensitive) under 65 in 100
  C  characters `[A-Z]` over 5 in 100 code points
  D  any of `#$%&*|`
  E  a text equal to that of any smaller id, wherever that document stands and whatever removes it.

Null texts count as empty (they fail A, and E where a smaller id's text is null or empty). Null sources are
the part of the empty source. Rows that repeat an id and its text are counted each and are no copies of
one another; a row without an id neither fails E nor makes others fail. Several label rows of an id count as one that
has each mark any of them has; rows without a label are neither good nor toxic. Equal texts are told by
SHA-256. Extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, map_groups, stored

LETTERS = "ABCDE"
MIN_WORDS = 50
#: Parts of a hash that rows without an id are dealt to where rows meet by id.
SALTS = 64


def own_mask(text: Column) -> Column:
    """Bits 0 to 3: the filters A to D that a text fails by itself. `text` must not be null."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))

    def mask(w: Column) -> Column:
        n, capitals = F.size(w), F.regexp_count(text, F.lit("[A-Z]"))
        fails = [n < MIN_WORDS, 100 * F.size(F.array_distinct(w)) < 65 * n, 100 * capitals.cast("long") > 5 * F.length(text).cast("long"), text.rlike(r"[#$%&*|]")]
        return sum((F.when(f, 1 << b).otherwise(0) for b, f in enumerate(fails)), F.lit(0))

    # the array is bound once, as an expression that mentions it twice would build it twice
    return F.transform(F.array(words), mask)[0].cast("int")


def masked(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, quality, toxic, n): how many documents of a part with such labels fail just the
    filters of `mask`."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).cast("long").alias("id_"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("same_"), own_mask(text).alias("mask_"))
    # repeats of a row are counted before anything is shuffled
    rows = stored(own.groupBy("id_", "part", "same_", "mask_").agg(F.count("*").alias("n_")), "audit-rows")
    first = rows.groupBy("same_").agg(F.min("id_").alias("first_"))
    marks = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("label_id_")).agg(F.max((F.col("quality") == 1).cast("int")).alias("quality_"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic_"))
    # by text and id: a text with very many copies is spread over its ids
    firsts = first.filter("first_ is not null").select(F.col("same_").alias("of_"), "first_")
    joined = rows.join(firsts, (F.col("same_") == F.col("of_")) & (F.col("id_") == F.col("first_")), "left")
    joined = joined.select("id_", "part", (F.col("mask_") + F.when(F.col("id_").isNotNull() & F.col("first_").isNull(), 16).otherwise(0)).alias("mask"), "n_")
    salt = F.when(F.col("id_").isNull(), F.pmod(F.xxhash64("part", "mask", "n_"), F.lit(SALTS))).otherwise(0)
    joined = joined.join(marks.withColumn("salt_", F.lit(0).cast("long")), (F.col("id_") == F.col("label_id_")) & (salt == F.col("salt_")), "left")
    return joined.groupBy("part", "mask", F.coalesce("quality_", F.lit(0)).alias("quality"), F.coalesce("toxic_", F.lit(0)).alias("toxic")).agg(F.sum("n_").cast("long").alias("n"))


def zeta(counts: np.ndarray) -> np.ndarray:
    """Sums of `counts` (last axis: masks) over the subsets of every mask."""
    out = counts.copy()
    for bit in range(len(LETTERS)):
        with_bit = np.flatnonzero(np.arange(out.shape[-1]) >> bit & 1)
        out[..., with_bit] += out[..., with_bit ^ (1 << bit)]
    return out


def audit(counts: DataFrame) -> DataFrame:
    """A row for each part of `masked`'s counts, each of the 120 orders and each of its steps."""
    orders = ["".join(p) for p in permutations(LETTERS)]
    full = (1 << len(LETTERS)) - 1

    def part_of(parts, masks, ns, goods, toxics):
        by = np.zeros((3, full + 1), dtype=np.int64)
        for values, row in zip((ns, goods, toxics), by, strict=True):
            np.add.at(row, masks, values)
        below = zeta(by)
        left = below[:, full ^ np.arange(full + 1)]  # by the subset of filters that were applied
        gone = {(s, b): left[:, s] - left[:, s | 1 << b] for b in range(len(LETTERS)) for s in range(full + 1) if not s >> b & 1}
        # of 120 orders, k! (4 - k)! apply just a given subset of k before a filter
        before = {k: n for k, n in enumerate((24, 6, 4, 6, 24))}
        shapley = [sum(before[s.bit_count()] * int(gone[s, b][0]) for s in range(full + 1) if not s >> b & 1) for b in range(len(LETTERS))]
        failing = [int(gone[0, b][0]) for b in range(len(LETTERS))]
        for order in orders:
            applied = 0
            for step, letter in enumerate(order, 1):
                b = LETTERS.index(letter)
                removed, good, toxic = (int(x) for x in gone[applied, b])
                applied |= 1 << b
                yield parts[0], order, step, int(left[0, applied]), removed, failing[b] - removed, int(by[0, 1 << b]), good, toxic, shapley[b]

    masks = counts.groupBy("part", "mask").agg(F.sum("n").cast("long").alias("n"), F.sum(F.col("n") * F.col("quality")).cast("long").alias("good"), F.sum(F.col("n") * F.col("toxic")).cast("long").alias("bad"))
    schema = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    return map_groups(masks, ["part"], part_of, schema)
