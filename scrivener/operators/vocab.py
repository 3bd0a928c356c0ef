"""Vocabulary pruning: keep the tokens a corpus uses, renumber them densely, and cut merges and
added tokens to match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivener.functions.text import words
from scrivener.sources.storage import stored

from .ordering import numbered


def used_tokens(texts: DataFrame, columns: list[str], always: DataFrame | None = None) -> DataFrame:
    """(token): distinct tokens of text columns and of `always`."""
    found = texts.select(F.explode(F.flatten(F.array(*[words(F.coalesce(c, F.lit(""))) for c in columns]))).alias("token"))
    return (found.unionByName(always.select("token")) if always is not None else found).distinct()


def dense_index(ids: DataFrame, column: str = "old_id") -> DataFrame:
    """(old_id, new_id): distinct ids in order, numbered from 0, however sparse they are; nulls have none."""
    return numbered(ids.select(column).filter(F.col(column).isNotNull()).distinct(), column, name="new_id")


def vocabulary(tokens: DataFrame, step: int = 1) -> DataFrame:
    """(token, old_id): distinct tokens in code point order, numbered `step`, 2 * `step` and so on."""
    rows = numbered(tokens.select("token").distinct(), "token", name="old_id", first=1)
    return rows.select("token", (F.col("old_id") * step).alias("old_id"))


def pruned(vocab: DataFrame, kept: DataFrame) -> DataFrame:
    """(token, old_id, new_id) of the `vocab` (token, old_id) rows that `kept` (old_id, new_id) names."""
    return vocab.join(kept, "old_id").select("token", "old_id", "new_id")


def marked(tokens: DataFrame) -> DataFrame:
    """(token, listed, used): each token once, true where any of its rows in `tokens` is."""
    return tokens.groupBy("token").agg(F.bool_or("listed").alias("listed"), F.bool_or("used").alias("used"))


def kept_numbered(marks: DataFrame, step: int = 1) -> DataFrame:
    """(token, old_id, new_id) of the listed tokens that are used, of `marked` rows: `vocabulary` numbers all
    listed ones, `dense_index` those kept, and no join is needed for either."""
    rows = numbered(marks.filter("listed").select("token", "used"), "token", name="old_id", first=1)
    rows = rows.filter("used").select("token", (F.col("old_id") * step).alias("old_id"))
    return numbered(rows, "old_id", name="new_id")


def adjacent_words(texts: DataFrame, column: str) -> DataFrame:
    """(a, b): each word of a text column and the word after it; the last word's `b` is null."""
    at = texts.select(words(F.coalesce(column, F.lit(""))).alias("w_")).select("w_", F.posexplode("w_").alias("i_", "a"))
    return at.select("a", F.get("w_", F.col("i_") + 1).alias("b"))


def two_parts(merges: DataFrame) -> DataFrame:
    """The merges ("a b") of exactly two parts, with these as `a_` and `b_`."""
    parts = F.split("merge", " ", 3)  # no more than tells two parts from three
    return merges.filter(F.size(parts) == 2).withColumns({"a_": parts[0], "b_": parts[1]})


def pairs_without(pairs: DataFrame, lacking: DataFrame, first: str = "a_", second: str = "b_") -> DataFrame:
    """The rows of `pairs` neither part of which is `lacking` (token). A small file of these is broadcast and the
    pairs stay where they are; otherwise both are joined by part."""
    columns = pairs.columns
    for part in (first, second):
        pairs = pairs.join(lacking.select(F.col("token").alias(part)), part, "left_anti")
    return pairs.select(*columns)


def merges_kept(merges: DataFrame, vocab: DataFrame) -> DataFrame:
    """The merges ("a b") of exactly two parts that are both in `vocab` (token). `merges` is read twice."""
    pairs = two_parts(merges)
    parts = pairs.select(F.explode(F.array("a_", "b_")).alias("token")).distinct()
    lacking = stored(parts.join(vocab.select("token"), "token", "left_anti"), "lacking")
    return pairs_without(pairs, lacking).drop("a_", "b_")


def added_remapped(added: DataFrame, kept: DataFrame) -> DataFrame:
    """Added tokens (old_id, content) that are kept, by their new ids."""
    return added.join(kept, "old_id").select(F.col("new_id").alias("id"), "content")


def sizes(old_size: int, hidden: int, kept: DataFrame) -> DataFrame:
    """(new_size, ratio_pct, params_old, params_new) of embedding and output layer together."""
    n = F.count("*")
    return kept.agg(n.alias("new_size"), (n * 100.0 / old_size).alias("ratio_pct"), F.lit(old_size * hidden * 2).cast("long").alias("params_old"), (n * hidden * 2).alias("params_new"))
