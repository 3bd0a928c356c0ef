"""Resharding by minimum-cost flow: from old shard sizes to equal new ones, moving the fewest bytes.

Old shards supply their bytes, new shards take up to their capacity, a byte that stays costs
nothing and one that moves costs 1 (or what `cost` says): the cheapest flow says how many bytes
each old shard sends to each new one. Every document goes by a flow. An old shard is laid out as a
line of hash blocks, which the flow cuts: a document goes where its middle falls, so a block is
transferred whole unless a cut falls in it. Cuts cannot place documents evenly that are
large beside a shard (over `LARGE` of a capacity; there are at most shards / LARGE of them, whatever
the input): these are dealt, largest first, to the destinations that the flow gives their old shard, the
fullest share first, and the flow is solved again for all others with the room that is left. A large document that
fits none of its shares goes where most room is.

`rewrite` finds a document's new file from its block; only large documents and the rows of
blocks that a cut divides are looked up one by one. Each text is shuffled once, straight to its
file. A file holds whole blocks of one shard, as far as they are not divided; slots number a shard's rows
without gaps, from counts by file, so that no shard is ever in one task.

Null text counts as no bytes, plus 1 for the row; empty tables give no rows; repeated rows keep
slots of their own; a null old shard is a shard outside the new range (-1).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import delete, few, scratch, stored
from .lines import blocks_of, in_blocks, lay_out, offsets

LARGE = 1 / 1000
BLOCK_ROWS = 1024
#: Bytes of text of a file of a shard.
FILE_BYTES = 128 << 20
SEED = 7_919
#: What deals a row to its block: rows of one id are spread by size and crc32 of their texts.
ALIKE = ["id_", "size_", "crc_"]


class Network:
    """A flow network: arcs in pairs, forward and back, by node."""

    def __init__(self, n: int):
        self.arcs: list[list[int]] = [[] for _ in range(n)]
        self.head: list[int] = []
        self.room: list[int] = []
        self.price: list[int] = []

    def arc(self, a: int, b: int, room: int, price: int) -> int:
        for x, y, r, p in ((a, b, room, price), (b, a, 0, -price)):
            self.arcs[x].append(len(self.head))
            self.head.append(y)
            self.room.append(r)
            self.price.append(p)
        return len(self.head) - 2

    def distances(self, start: int) -> list[int | None]:
        """Cheapest prices from `start` over arcs with room."""
        far: list[int | None] = [None] * len(self.arcs)
        far[start] = 0
        wave = [start]
        while wave:
            after = set()
            for a in wave:
                for k in self.arcs[a]:
                    b, d = self.head[k], far[a] + self.price[k]
                    if self.room[k] > 0 and (far[b] is None or d < far[b]):
                        far[b] = d
                        after.add(b)
            wave = sorted(after)
        return far

    def ship(self, start: int, end: int) -> None:
        """The cheapest of the greatest flows: while there is a way, fill the cheapest ways until
        none is left at their price."""
        while (far := self.distances(start))[end] is not None:
            at = [0] * len(self.arcs)
            path: list[int] = []
            here, on = start, {start}
            while True:
                if here == end:
                    push = min(self.room[k] for k in path)
                    for k in path:
                        self.room[k] -= push
                        self.room[k ^ 1] += push
                    path, here, on = [], start, {start}
                    continue
                while at[here] < len(self.arcs[here]):
                    k = self.arcs[here][at[here]]
                    b = self.head[k]
                    if self.room[k] > 0 and b not in on and far[b] is not None and far[here] + self.price[k] == far[b]:
                        break
                    at[here] += 1
                else:
                    if here == start:
                        break
                    on.discard(here)
                    here = self.head[path.pop() ^ 1]
                    at[here] += 1
                    continue
                path.append(k)
                here = b
                on.add(b)


def min_cost_flow(supply: dict[int, int], room: list[int], cost=None) -> dict[tuple[int, int], int]:
    """Units by (old, new) of the cheapest flow that ships all supplies within the rooms. Without
    `cost`, where what stays is free and what moves costs 1, moves run through one middle node, so the
    network has as many arcs as shards, not as pairs of them."""
    olds = sorted(i for i in supply if supply[i] > 0)
    n, m = len(olds), len(room)
    start, end, middle = n + m, n + m + 1, n + m + 2
    net = Network(n + m + 3)
    ways: list[tuple[int, int, int]] = []
    out: dict[tuple[int, int], int] = {}
    for a, i in enumerate(olds):
        net.arc(start, a, supply[i], 0)
    for j, r in enumerate(room):
        net.arc(n + j, end, r, 0)
    if cost is not None:
        ways = [(i, j, net.arc(a, n + j, supply[i], cost(i, j))) for a, i in enumerate(olds) for j in range(m)]
        net.ship(start, end)
        return {(i, j): f for i, j, k in ways if (f := net.room[k ^ 1])}
    stay = [(i, net.arc(a, n + i, supply[i], 0)) for a, i in enumerate(olds) if 0 <= i < m]
    leave = [(i, net.arc(a, middle, supply[i], 1)) for a, i in enumerate(olds)]
    enter = [(j, net.arc(middle, n + j, r, 0)) for j, r in enumerate(room)]
    net.ship(start, end)
    out = {(i, i): f for i, k in stay if (f := net.room[k ^ 1])}
    wants = [[j, net.room[k ^ 1]] for j, k in enter if net.room[k ^ 1]]
    for i, k in leave:
        left = net.room[k ^ 1]
        while left:
            j, want = wants[-1]
            f = min(left, want)
            out[i, j] = out.get((i, j), 0) + f
            left -= f
            wants[-1][1] -= f
            if not wants[-1][1]:
                wants.pop()
    return out


def level_rooms(taken: list[int], total: int) -> list[int]:
    """Room of each shard so that `total` more bytes fill all to one level, or as near as it goes."""
    order = sorted(range(len(taken)), key=lambda j: (taken[j], j))
    level, used = 0, 0
    for k in range(1, len(order) + 1):
        used += taken[order[k - 1]]
        level = -(-(total + used) // k)
        if k == len(order) or level <= taken[order[k]]:
            break
    return [max(0, level - t) for t in taken]


def deal(large: list[tuple[int, int]], flow: dict[tuple[int, int], int], room: list[int]) -> list[int]:
    """The new shard of each large document (old shard, size; largest first): the destination with
    the most left of what the flow sends there, its own first if the document fits; the shard with
    the most room where all destinations are too small for half of it."""
    left, to, out, free = dict(flow), {}, [], list(room)
    for i, j in flow:
        to.setdefault(i, []).append(j)
    for i, size in large:
        fits = [j for j in to.get(i, ()) if 2 * left[i, j] >= size and 2 * free[j] >= size]
        if i in fits and left[i, i] >= size:
            j = i
        else:
            j = max(fits or range(len(room)), key=lambda j: (left[i, j] if fits else free[j], j == i, -j))
        if (i, j) in left:
            left[i, j] -= size
        free[j] -= size
        out.append(j)
    return out


class Plan:
    """Where the rows of a table go: whole blocks by old shard, single rows of blocks that a cut
    divides and large documents, and the files of each new shard."""

    def __init__(self, docs: DataFrame, old_shard: Column, shards: int, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES):
        self.shards, self.id_col = shards, id_col
        text = F.coalesce(F.col(text_col), F.lit(""))
        own = [F.col(id_col).alias("id_"), (F.octet_length(text) + 1).cast("long").alias("size_"), F.crc32(text.cast("binary")).alias("crc_"), F.coalesce(old_shard.cast("int"), F.lit(-1)).alias("old_")]
        self._keyed = lambda df: df.select(*own, F.struct(*df.columns).alias("row_"))
        self.work = scratch(docs.sparkSession, "reshard-work")
        rows = stored(docs.select(*own), "reshard-rows", self.work)
        supply = {r[0]: (int(r[1]), r[2]) for r in rows.groupBy("old_").agg(F.sum("size_"), F.count("*")).collect()}
        total = sum(s for s, _ in supply.values())
        room = level_rooms([0] * shards, total)
        self.flow = min_cost_flow({i: s for i, (s, _) in supply.items()}, room)
        self.cut = max(1, int(total / shards * LARGE))
        large = rows.filter(F.col("size_") > self.cut).orderBy(F.desc("size_"), "id_", "crc_", "old_").collect()  # fewer than shards / LARGE
        to = deal([(r["old_"], r["size_"]) for r in large], self.flow, room)
        taken, rest = [0] * shards, {i: s for i, (s, _) in supply.items()}
        for r, j in zip(large, to, strict=True):
            taken[j] += r["size_"]
            rest[r["old_"]] -= r["size_"]
        self.rest_flow = min_cost_flow(rest, level_rooms(taken, sum(rest.values())))
        self._lay_out(rows, [(*r, -1 - k, j) for k, (r, j) in enumerate(zip(large, to, strict=True))], supply, file_bytes)

    def close(self) -> None:
        """Delete what the plan wrote; it cannot be used after."""
        delete(self.rows.sparkSession, self.work)

    def _lay_out(self, rows: DataFrame, large: list[tuple], supply: dict, file_bytes: int) -> None:
        spark = rows.sparkSession
        pieces = []
        for i, (_, n) in supply.items():
            to = sorted((j for a, j in self.rest_flow if a == i), key=lambda j: (j != i, j))
            ends, at = [], 0
            for j in to:
                at += self.rest_flow[i, j]
                ends.append(at)
            pieces.append((i, blocks_of(n, BLOCK_ROWS), ends[:-1], to or [0]))
        self._pieces = few(spark.createDataFrame(pieces, "old_ int, blocks_ int, cuts_ array<long>, to_ array<int>"), len(pieces))
        small = in_blocks(rows.filter(F.col("size_") <= self.cut).join(self._pieces, "old_"), ALIKE, F.col("blocks_"), SEED)
        line = lay_out(small, offsets(small, "old_", "size_", SEED), "old_", F.col("id_"), "size_", SEED, [F.col(c) for c in ALIKE])
        middle = F.col("start_") * 2 + F.col("size_")
        line = line.withColumn("shard_", F.element_at("to_", F.size(F.filter("cuts_", lambda c: c * 2 <= middle)) + 1))
        names = ["id_", "size_", "crc_", "old_", "block_", "shard_"]
        kinds = f"id_ {rows.schema['id_'].dataType.simpleString()}, size_ long, crc_ long, old_ int, block_ int, shard_ int"
        line = stored(line.select(*names).unionByName(spark.createDataFrame(large, kinds)), "reshard-line", self.work)
        sums = line.groupBy("old_", "block_", "shard_").agg(F.count("*").alias("n_"), F.sum("size_").alias("bytes_"))
        along = Window.partitionBy("shard_").orderBy("old_", "block_").rowsBetween(Window.unboundedPreceding, -1)
        file = F.floor(F.coalesce(F.sum("bytes_").over(along), F.lit(0)) / file_bytes).cast("int")
        ways = F.count("*").over(Window.partitionBy("old_", "block_"))
        self.blocks = stored(sums.select("old_", "block_", "shard_", "n_", file.alias("file_"), ways.alias("ways_")), "reshard-blocks", self.work)
        alone = (F.col("ways_") > 1) | (F.col("block_") < 0)
        self.n_blocks, self._n_single = self.blocks.agg(F.count("*"), F.coalesce(F.sum(F.when(alone, F.col("n_"))), F.lit(0))).first()
        #: (id, size, crc, old shard, block, new shard, file) of every row; large documents are blocks below 0.
        self.rows = line.join(few(self.blocks.drop("n_", "ways_"), self.n_blocks), ["old_", "block_", "shard_"]).select(*names, "file_")

    def _slots(self, rows: DataFrame, files: DataFrame) -> DataFrame:
        """`rows` dealt to files, with `slot_`: their place in the file after all rows of the files before."""
        counts = files.groupBy("shard_", "file_").agg(F.sum("n_").alias("n_"))
        before = Window.partitionBy("shard_").orderBy("file_").rowsBetween(Window.unboundedPreceding, -1)
        at = counts.select("shard_", "file_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("at_"))
        order = Window.partitionBy("shard_", "file_").orderBy("old_", "block_", F.xxhash64("id_", F.lit(SEED + 1)), "id_", "size_", "crc_")
        rows = rows.join(few(at, self.n_blocks), ["shard_", "file_"]).repartition("shard_", "file_")
        return rows.withColumn("slot_", (F.row_number().over(order) - 1 + F.col("at_")).cast("long"))

    def assignment(self) -> DataFrame:
        """(id, size, text_crc32, old_shard, shard, slot) of every row."""
        out = self._slots(self.rows, self.blocks)
        return out.select(F.col("id_").alias(self.id_col), F.col("size_").alias("size"), F.col("crc_").alias("text_crc32"), F.col("old_").alias("old_shard"), F.col("shard_").alias("shard"), F.col("slot_").alias("slot"))

    def affected(self) -> list[int]:
        """The new shards whose files must be rewritten: those that rows enter or leave."""
        moved = self.blocks.filter("old_ <> shard_").select(F.explode(F.array("old_", "shard_")).alias("s")).distinct()
        return sorted(r[0] for r in moved.collect())

    def placed(self, docs: DataFrame, which: list[int]) -> DataFrame:
        """The rows of `docs` that belong to the shards `which`, as (row_, old_, block_, shard_, file_, slot_)."""
        keyed = in_blocks(self._keyed(docs).join(self._pieces.drop("cuts_", "to_"), "old_"), ALIKE, F.col("blocks_"), SEED).drop("blocks_")
        small = F.col("size_") <= self.cut
        whole = few(self.blocks.filter("ways_ = 1 and block_ >= 0").select("old_", "block_", "shard_", "file_"), self.n_blocks)
        by_block = keyed.filter(small).join(whole, ["old_", "block_"])
        # rows that must be found one by one: equal ones are numbered, as any of them may go to any place
        split = few(self.blocks.filter("ways_ > 1 or block_ < 0").select("old_", "block_", "shard_"), self.n_blocks)
        alike = ["id_", "size_", "crc_", "old_"]
        copy = lambda *by: F.row_number().over(Window.partitionBy(*alike).orderBy(*by))
        one = self.rows.join(split, ["old_", "block_", "shard_"]).select(*alike, "block_", "shard_", "file_", copy("block_", "shard_", "file_").alias("copy_"))
        one = few(one.select(*[F.col(c).alias(f"{c}1") for c in one.columns]), self._n_single)
        divided = few(self.blocks.filter("ways_ > 1 and block_ >= 0").select("old_", "block_").distinct(), self.n_blocks)
        loose = keyed.filter(small).join(divided, ["old_", "block_"], "left_semi").unionByName(keyed.filter(~small)).drop("block_").withColumn("copy_", copy("crc_"))
        same = [F.col(c).eqNullSafe(F.col(f"{c}1")) for c in (*alike, "copy_")]
        by_row = loose.join(one, same).select("row_", *alike, F.col("block_1").alias("block_"), F.col("shard_1").alias("shard_"), F.col("file_1").alias("file_"))
        rows = by_block.select(*by_row.columns).unionByName(by_row).filter(F.col("shard_").isin(which))
        return self._slots(rows, self.blocks)


def assign(docs: DataFrame, old_shard: Column, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, old_shard, shard, slot) for every row of `docs`."""
    return Plan(docs, old_shard, shards, id_col, text_col).assignment()


def rewrite(docs: DataFrame, plan: Plan, path: str) -> list[int]:
    """Rewrite the affected shards of `docs` under `path`/shard=N, each row with its `slot` (columns of these
    two names are replaced), and return their numbers. The new files are complete in a folder of their own
    before any old one goes, so `docs` may be read from `path` itself; a shard that loses all its rows
    loses its folder; the others' files stay as they are. `settle` ends a swap that was broken off."""
    spark, which = docs.sparkSession, plan.affected()
    if not which:
        return []
    columns = [c for c in docs.columns if c not in ("shard", "slot")]
    rows = plan.placed(docs, which).select(*[F.col("row_")[c].alias(c) for c in columns], F.col("shard_").alias("shard"), F.col("slot_").alias("slot"))
    staged = f"{path}/_reshard-{uuid.uuid4().hex}"
    rows.write.partitionBy("shard").parquet(f"{staged}/new")
    # the list of shards stands last: only a staging folder that has it is complete
    spark.createDataFrame([(i,) for i in which], "shard int").coalesce(1).write.parquet(f"{staged}/which")
    settle(spark, path)
    return which


def settle(spark: SparkSession, path: str) -> None:
    """Move complete staged shards under `path` into place; repeating it does no harm."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    base = hadoop(path)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    for staged in [s.getPath() for s in fs.listStatus(base) if s.getPath().getName().startswith("_reshard-")] if fs.exists(base) else []:
        if fs.exists(hadoop(staged, "which/_SUCCESS")):
            for i in [r[0] for r in spark.read.schema("shard int").parquet(hadoop(staged, "which").toString()).collect()]:
                new, there, done = hadoop(staged, f"new/shard={i}"), hadoop(base, f"shard={i}"), hadoop(staged, f"done-{i}")
                if not fs.exists(done):
                    fs.delete(there, True)
                    if fs.exists(new) and not fs.rename(new, there):
                        raise RuntimeError(f"shard {i} could not be moved to {there}")
                    fs.mkdirs(done)
        fs.delete(staged, True)


def resharded(docs: DataFrame, old_shard: Column, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` rewritten into new shards and read back from their files: their columns, `shard` and `slot`,
    and `old_shard`. For tables that are in no shard files yet, so that every shard is written."""
    plan = Plan(docs, old_shard, shards, id_col, text_col)
    path = scratch(docs.sparkSession, "reshard-files")
    every = list(range(shards))
    placed = plan.placed(docs, every)
    columns = [c for c in docs.columns if c not in ("shard", "slot", "old_shard")]
    rows = placed.select(*[F.col("row_")[c].alias(c) for c in columns], F.col("old_").alias("old_shard"), F.col("shard_").alias("shard"), F.col("slot_").alias("slot"))
    rows.write.partitionBy("shard").parquet(path)
    plan.close()
    return docs.sparkSession.read.schema(rows.schema).parquet(path)
