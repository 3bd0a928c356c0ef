"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source is laid out as a line of words in hash blocks of permuted order. A source's quota is
the blocks that hold the first `target` words of the line, over again from its start where the target
passes the source's size. A binary tree over the output shards splits the quotas: at each node the
left half's blocks by source are one multivariate-hypergeometric draw, so each shard holds equally
many blocks (within one) and all quotas are met exactly. A shard draws its share of each source as
consecutive, disjoint ranks of the permuted blocks; what no shard draws is not in the mix. The
last block of a pass is cut at the target, so a source's words are met to the word and at most one
document of it is cut per pass. `mix` gathers a shard's blocks into files and shuffles each locally.

Only counts by source reach the driver; a source's rows are never in one task. Null source is a
source of its own, the last; null or empty text has size 0 and is never drawn; empty tables give
no rows; repeated rows are drawn as rows of their own; extra columns are kept where asked for.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few, n_words, stored
from .lines import blocks_of, in_blocks, lay_out, offsets

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
SHARDS = 16
BLOCK_WORDS = 65_536
SEED = 20_240
#: Words of a file of a shard.
FILE_WORDS = 4 << 20
DRAWS = "array<struct<epoch:int,shard:int,block:int,file:int,words:long,order:long>>"


def targets(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Share `total` by weight; what passes `most` times a size is reshared until none is above."""
    out = [0.0] * len(sizes)
    open_ = [i for i in range(len(sizes)) if sizes[i] > 0]
    left = total
    while open_:
        per = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if per * weights[i] > most * sizes[i]]
        for i in over or open_:
            out[i] = most * sizes[i] if over else per * weights[i]
        if not over:
            break
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out


def splitting_tree(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """Blocks by (shard, source): exact in both, each split one multivariate-hypergeometric draw."""
    out = np.zeros((shards, len(quotas)), dtype=np.int64)

    def split(lo: int, hi: int, counts: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = counts
            return
        mid = (lo + hi) // 2
        n = int(counts.sum())
        # floor(n * k / shards) boundaries keep every shard within one block of the mean
        take = n * (mid - lo) // (hi - lo)
        rng = np.random.default_rng([seed, lo, hi])
        left = _hypergeometric(rng, counts, take)
        split(lo, mid, left)
        split(mid, hi, counts - left)

    if len(quotas):
        split(0, shards, np.asarray(quotas, dtype=np.int64))
    return out


def _hypergeometric(rng, counts: np.ndarray, take: int) -> np.ndarray:
    """One multivariate-hypergeometric draw by its conditional marginals."""
    left, rest, out = take, int(counts.sum()), np.zeros_like(counts)
    for i, c in enumerate(counts.tolist()):
        out[i] = rng.hypergeometric(c, rest - c, left) if left else 0
        left -= int(out[i])
        rest -= c
    return out


def plan(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", *, weights=WEIGHTS, share: float = SHARE, most: float = MOST, shards: int = SHARDS, block_words: int = BLOCK_WORDS, file_words: int = FILE_WORDS, seed: int = SEED, keep: list[str] = ()) -> DataFrame:
    """One row per row of `docs`: id, `size`, `source_size`, `target` (its source's), `draws` (what the
    shards draw of it: pass, shard, block of its source's line, file of the shard, words and place in the
    file's shuffle) and `row`, a struct of the columns `keep`."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id_"), F.col(source_col).alias("source_"), n_words(F.col(text_col)).alias("size_"), F.xxhash64(text_col).alias("tie_"), *([F.struct(*keep).alias("row_")] if keep else []))
    light = stored(rows.select("id_", "source_", "size_", "tie_"), "mix-sizes")
    found = {r[0]: r[1] for r in light.groupBy("source_").agg(F.sum("size_")).collect()}
    names = sorted((x for x in found if x is not None)) + [None] * (None in found)
    sizes = [int(found[x]) for x in names]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(names))], share * sum(sizes), most)
    words = [min(int(g + 0.5), int(most * s)) for g, s in zip(goal, sizes, strict=True)]
    number = [blocks_of(s, block_words) for s in sizes]
    sources = spark.createDataFrame(list(zip(range(len(names)), names, number, sizes, goal, words, strict=True)), "source_no_ int, name_ string, blocks_ int, source_size_ long, target_ double, take_ long")

    def keyed(df: DataFrame) -> DataFrame:
        df = df.join(few(sources, len(names)), F.col("source_").eqNullSafe(F.col("name_"))).drop("source_", "name_")
        return in_blocks(df, [F.col("id_"), F.col("tie_")], F.col("blocks_"), seed)

    starts = offsets(keyed(light), "source_no_", "size_", seed)
    passes = range(int(np.ceil(most)))
    limit = [F.least(F.greatest(F.col("take_") - F.col("source_size_") * e, F.lit(0)), F.col("source_size_")) for e in passes]
    # blocks drawn by source and pass: those with words before the pass's limit
    drawn = starts.join(few(sources, len(names)), "source_no_").groupBy("source_no_").agg(*[F.count(F.when((F.col("from_") < limit[e]) & (F.col("sum_") > 0), 1)) for e in passes]).collect()
    drawn = {r[0]: list(r[1:]) for r in drawn}
    counts = [drawn.get(i, [0] * len(passes)) for i in range(len(names))]
    tree = np.cumsum(splitting_tree([sum(c) for c in counts], shards, seed), axis=0)
    edges = spark.createDataFrame([(i, [int(x) for x in tree[:, i]], [int(sum(c[:e])) for e in range(len(c))]) for i, c in enumerate(counts)], "source_no_ int, edges_ array<long>, first_ array<long>")

    files = max(1, -(-sum(words) // (shards * file_words)))

    def draw(e: int):
        # the shard whose ranks hold the block's; beyond the last edge no shard draws it
        at = F.col("rank_") + F.col("first_")[e]
        return F.struct(
            F.lit(e).alias("epoch"),
            F.size(F.filter("edges_", lambda x: x <= at)).alias("shard"),
            F.col("block_").alias("block"),
            F.pmod(F.xxhash64("source_no_", "block_", F.lit(e), F.lit(seed)), F.lit(files)).alias("file"),
            F.greatest(F.least(F.col("size_"), limit[e] - F.col("start_")), F.lit(0)).alias("words"),
            F.xxhash64("id_", "tie_", F.lit(e), F.lit(seed)).alias("order"),
        )

    draws = F.filter(F.array(*[draw(e) for e in passes]), lambda d: (d["words"] > 0) & (d["shard"] < shards)).cast(DRAWS)
    line = lay_out(keyed(rows if keep else light), starts, "source_no_", F.col("id_"), "size_", seed, [F.col("id_"), F.col("size_"), F.col("tie_")])
    out = line.join(few(edges, len(names)), "source_no_")
    return out.select(F.col("id_").alias(id_col), F.col("size_").alias("size"), F.col("source_size_").alias("source_size"), F.col("target_").alias("target"), draws.alias("draws"), *([F.col("row_").alias("row")] if keep else []))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The mixed corpus, gathered by shard and shuffled: a row of `docs` for each draw, with its text
    cut to the words drawn (one space between them) where a pass ends inside it, plus `mix_shard` and
    `mix_file`. A shard's blocks are dealt by hash into files of about `file_words` words; a file is in one
    partition, its rows in pseudo-random order. Columns of `docs` named mix_shard or mix_file are replaced."""
    columns = [c for c in docs.columns if c not in ("mix_shard", "mix_file")]
    planned = plan(docs, id_col, source_col, text_col, keep=columns, **options)
    taken = planned.select(F.col("size").alias("size_"), F.explode("draws").alias("draw_"), F.col("row").alias("row_"))
    text = F.col("row_")[text_col]
    words = F.slice(F.split(F.ltrim(text, F.lit(" \t\n\x0b\x0c\r")), r"[\x20\x09-\x0D]+"), F.lit(1), F.col("draw_.words").cast("int"))
    cut = F.when(F.col("draw_.words") < F.col("size_"), F.array_join(words, " ")).otherwise(text)
    rows = taken.select(*[(cut if c == text_col else F.col("row_")[c]).alias(c) for c in columns], F.col("draw_.shard").alias("mix_shard"), F.col("draw_.file").alias("mix_file"), F.col("draw_.order").alias("mix_order_"))
    return rows.repartition("mix_shard", "mix_file").sortWithinPartitions("mix_shard", "mix_file", "mix_order_").drop("mix_order_")
