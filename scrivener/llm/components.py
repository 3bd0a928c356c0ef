"""Connected components of a link table: partitions of it are settled locally first, then alternating
large and small stars join what is left, all in joins.

Every round is written to the shared folder and counted against the one before it; nothing but
counts reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, ship, stored

ROUNDS = 60
#: Links that one task settles before the rounds.
LOCAL_LINKS = 200_000


def settled_locally(edges: DataFrame, parts: int) -> DataFrame:
    """`edges` (u > v) with each of `parts` partitions replaced by links of its nodes to their least one."""
    ship(edges.sparkSession)

    def run(batches):
        import pyarrow as pa

        up: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while (above := up.get(top, top)) != top:
                top = above
            while x != top:
                up[x], x = top, up.get(x, top)
            return top

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(u), root(v)
                up[max(a, b)] = min(a, b)
        nodes = [x for x in up if root(x) != x]
        for at in range(0, len(nodes), 65_536):
            some = nodes[at : at + 65_536]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([root(x) for x in some], pa.int64())], names=["u", "v"])

    return edges.repartition(parts).mapInArrow(run, "u long, v long")


def _sign(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b", work: str | None = None) -> DataFrame:
    """(node, component): every node of `links`, with the least node of its component. Loops and
    repeated links are ignored; nulls link nothing; empty tables give no rows. What is written stands
    below `work`."""
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u is not null and v is not null and u > v").distinct()
    spark, first = links.sparkSession, stored(edges, "cc", work)
    edges = stored(settled_locally(first, 1 + first.count() // LOCAL_LINKS).distinct(), "cc", work)
    drop_stored(spark, first)
    sign = _sign(edges)
    for _ in range(ROUNDS):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that the join has a plain shuffle on either side, which adaptive execution can
        # split where one node is linked to very many
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")), "cc-least", work)
        large = stored(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct(), "cc-large", work)
        drop_stored(spark, least)
        # a node without smaller neighbours keeps its links through the larger ones' rows above
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "cc-least", work)
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").unionByName(joined.select("u", F.col("m").alias("v"))).distinct()
        before, edges = edges, stored(small, "cc", work)
        now = _sign(edges)
        for old in (before, large, least):
            drop_stored(spark, old)
        if now == sign:
            break
        sign = now
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
