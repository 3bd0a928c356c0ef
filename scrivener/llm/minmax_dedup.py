"""Near-duplicates by min-max hashing: documents linked where their sets of three-word shingles
have a similarity of 0.85 or more.

Of each of `HASHES` hash functions both the least and the greatest value of a set are kept, so a
signature has twice as many places as hashes were evaluated, each of which agrees for two sets with
their similarity's probability. A band joins least values of some functions with greatest values of others,
so that its places are independent; `BANDS` bands of `PLACES` miss a pair of similarity 0.85 once in 26,000.

Equal shingle sets are one node. In a band's bucket, nodes are linked whose signatures nearly agree
(`SLACK` below the threshold); buckets of the same members are read once. The links' components gather the
nodes whose whole shingle sets are compared. Both comparisons want a spanning forest, not all pairs
(`settle`): a group is dealt into blocks, each of which also gets a few hubs of the group, so a group of
copies is joined by work in proportion to its rows; what a hub's component has not taken in meets all blocks
of the group, so no link is lost. Pairs that are joined already are not compared.

Texts are lower-cased (A to Z only), words are runs of anything but ASCII white space; a text of 1 or 2 words
is one shingle. Null, empty and wordless texts have no shingles, link with nothing and are components of
their own. Rows that repeat an id are nodes of their texts; repeats are kept together. A row without an id
takes the least id it is linked with, or null, and is kept only in the latter case. Extra columns are
ignored; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, map_groups, map_rows, scratch, stored
from .components import components
from .jaccard_join import BLOCK_NODES, BLOCK_SHINGLES, BROADCAST_NODES, Words, overlaps, shingles, signed, text_key

N = 3
THRESHOLD = 0.85
HASHES = 128
BANDS, PLACES = 32, 8
#: Agreement of signatures below the threshold by which a pair is still compared: over six standard deviations.
SLACK = 0.15
BUCKET = 1_000
HUBS = 8


def minmax_numbers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(12)
    return (rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None], rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)[:, None]


def signature(tokens: np.ndarray, numbers) -> np.ndarray:
    """`2 * HASHES` values of 16 bits: of each function the low bits of the least value, then of each of the greatest."""
    a, b = numbers
    low = (tokens >> np.uint64(32)).astype(np.uint32)[None, :]
    least, most = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32), np.zeros(HASHES, dtype=np.uint32)
    for at in range(0, low.shape[1], 1024):
        h = a * low[:, at : at + 1024] + b
        np.minimum(least, h.min(axis=1), out=least)
        np.maximum(most, h.max(axis=1), out=most)
    return np.concatenate((least, most)).astype(np.uint16)


def band_places() -> np.ndarray:
    """`BANDS` rows of places: least values of some functions, greatest values of others."""
    half = PLACES // 2
    low = np.arange(BANDS * half).reshape(BANDS, half)
    return np.concatenate((low, HASHES + (low + HASHES // 2) % HASHES), axis=1)


def sketched(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_, key_, high, low, size, sketch): 128 bits that tell the shingle set, null without shingles."""

    def make():
        words, numbers = Words(), minmax_numbers()

        def rows(ids, keys, texts):
            for i, key, text in zip(ids, keys, texts, strict=True):
                s = shingles(text, words, N, lower=True)
                if len(s):
                    high, low = divmod(xxhash.xxh3_128_intdigest(s.tobytes()), 1 << 64)
                    yield i, key, *signed(np.array([high, low], dtype=np.uint64)), len(s), signature(s, numbers).tobytes()
                else:
                    yield i, key, None, None, 0, None

        return rows

    return map_rows(docs.select(F.col(id_col).cast("long"), text_key(F.col(text_col)), F.col(text_col)), make, "id_ long, key_ struct<h:long,g:long,n:int>, high long, low long, size long, sketch binary")


def buckets(nodes: DataFrame, work: str) -> DataFrame:
    """(group, node, size): the members of bands' buckets with more than one, each set of members once."""

    def make():
        places = band_places()

        def rows(keys, sketches):
            matrix = np.frombuffer(b"".join(sketches), dtype=np.uint16).reshape(-1, 2 * HASHES)
            for b, some in enumerate(places):
                values = np.ascontiguousarray(matrix[:, some])
                for k, value in zip(keys, values, strict=True):
                    yield signed(np.array([xxhash.xxh64_intdigest(value.tobytes(), b)], dtype=np.uint64))[0], k

        return rows

    bands = stored(map_rows(nodes.select("node", "sketch"), make, "band long, node long"), "bands", work)
    counts = bands.groupBy("band").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("members"), F.min("node").alias("first")).filter("n > 1")
    told = stored(counts.groupBy("n", "members", "first").agg(F.min("band").alias("group")).select("group"), "band-groups", work)
    return bands.join(told, F.col("band") == F.col("group")).select("group", "node", F.lit(1).cast("long").alias("size"))


class Labels:
    """Labels of the nodes of a comparison and the links that joined some."""

    def __init__(self, labels: list[int]):
        self.of = np.unique(np.array(labels, dtype=np.int64), return_inverse=True)[1]
        self.links: list[tuple[int, int]] = []

    def join(self, i: int, hits: np.ndarray) -> None:
        """Link i with one of `hits` of each label that is not its own yet."""
        labels, first = np.unique(self.of[hits], return_index=True)
        for label, k in zip(labels.tolist(), first.tolist(), strict=True):
            if label != self.of[i]:
                self.links.append((i, int(hits[k])))
                self.of[self.of == label] = self.of[i]


def near_signatures(least: int) -> Callable:
    def link(payloads: list[bytes], other: np.ndarray, labels: Labels) -> None:
        matrix = np.frombuffer(b"".join(payloads), dtype=np.uint16).reshape(-1, 2 * HASHES)
        for i in np.flatnonzero(other):
            rest = np.flatnonzero(labels.of != labels.of[i])
            if len(rest):
                labels.join(int(i), rest[np.count_nonzero(matrix[rest] == matrix[i], axis=1) >= least])

    return link


def near_sets(threshold: float) -> Callable:
    def link(payloads: list[bytes], other: np.ndarray, labels: Labels) -> None:
        sets = [np.frombuffer(x, dtype=np.uint64) for x in payloads]
        sizes = np.array([len(s) for s in sets])

        def like(common: np.ndarray, mine: int) -> np.ndarray:
            return 100 * common >= round(100 * threshold) * (sizes + mine - common)

        # one set against all: copies of it are done in a pass over them
        i = int(np.flatnonzero(other)[0])
        tokens = np.concatenate(sets)
        at = np.minimum(np.searchsorted(sets[i], tokens), sizes[i] - 1)
        common = np.add.reduceat((sets[i][at] == tokens).astype(np.int64), np.concatenate(([0], np.cumsum(sizes)[:-1])))
        labels.join(i, np.flatnonzero(like(common, sizes[i])))
        if len(sets) > 2 and len(np.unique(labels.of)) > 1:
            shared = overlaps(sets)
            for i in np.flatnonzero(other):
                labels.join(int(i), np.flatnonzero(like(shared[i], sizes[i]) & (labels.of != labels.of[i])))

    return link


def settle(members: DataFrame, attach: Callable[[DataFrame], DataFrame], link: Callable, most: int, most_size: int, work: str) -> DataFrame:
    """(a, b): links that join all nodes of a group (`members`: group, node, size; rows distinct) that
    are linked within it, directly or through others of it. `attach` adds `payload` to rows of nodes."""

    def compare(group, i, j, nodes, other, labels, payloads):
        wanted: dict[int, int] = {}  # a node may come as one of the rest and as a member
        for x, k in enumerate(nodes):
            if k not in wanted or other[x]:
                wanted[k] = x
        at = [wanted[k] for k in sorted(wanted)]
        if len(at) > 1 and any(other[x] for x in at):
            held = Labels([labels[x] for x in at])
            link([payloads[x] for x in at], np.array([other[x] for x in at]), held)
            for x, y in held.links:
                yield nodes[at[x]], nodes[at[y]]

    def compared(dealt: DataFrame) -> DataFrame:
        rows = attach(dealt).select("group", "i", "j", "node", "other", "label", "payload")
        return stored(map_groups(rows, ["group", "i", "j"], compare, "a long, b long").distinct(), "settled", work)

    stats = members.groupBy("group").agg(F.count("*").alias("n"), F.sum("size").alias("s")).filter("n > 1")
    blocks = F.greatest(F.ceil(F.col("n") / most), F.ceil(F.col("s") / most_size)).cast("int")
    stats = stats.select(F.col("group").alias("of"), "n", blocks.alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int")
    hub = F.pmod(F.xxhash64("node", F.lit(1)), F.col("n")) < HUBS
    placed = stored(members.join(stats, F.col("group") == F.col("of")).select("group", "node", "blocks", own.alias("own"), hub.alias("hub")), "settle-placed", work)
    to = F.when(F.col("hub"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own"))
    out = compared(placed.select("group", F.explode(to).alias("i"), F.lit(-1).alias("j"), "node", F.lit(True).alias("other"), F.col("node").alias("label")))
    large = placed.filter("blocks > 1")
    if large.isEmpty():
        return out
    # of a group in blocks, what is not in its most frequent component meets every block
    found = components(out, work=work).select(F.col("node").alias("of"), "component")
    labelled = large.join(found, F.col("node") == F.col("of"), "left").select("group", "node", "blocks", "own", F.coalesce("component", "node").alias("label"))
    labelled = stored(labelled, "settle-labels", work)
    by_label = labelled.groupBy("group", "label").agg(F.count("*").alias("n"))
    main = by_label.groupBy(F.col("group").alias("of")).agg(F.max(F.struct("n", "label")).alias("main"), F.sum("n").alias("all"))
    main = main.filter(F.col("all") > F.col("main.n")).select("of", F.col("main.label").alias("main"), F.ceil((F.col("all") - F.col("main.n")) / most).cast("int").alias("others"))
    rest = stored(labelled.join(main, F.col("group") == F.col("of")).select("group", "node", "blocks", "own", "label", (F.col("label") != F.col("main")).alias("other"), "others"), "settle-rest", work)
    part = F.pmod(F.xxhash64("node", F.lit(2)), F.col("others").cast("long")).cast("int")
    one = rest.filter("other").select("group", part.alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), "node", "other", "label")
    all_ = rest.select("group", F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("i"), F.col("own").alias("j"), "node", F.lit(False).alias("other"), "label")
    return out.unionByName(compared(one.unionByName(all_)))


def with_sets(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> Callable[[DataFrame], DataFrame]:
    """Adds the shingle set of each row's node, from the text of the node's least document."""

    def attach(dealt: DataFrame) -> DataFrame:
        reps = nodes.select(F.col("node").alias("of"), F.col("rep.id_").alias("rep_id"), F.col("rep.key_.h").alias("rep_hash"), "high", "low")
        wanted = dealt.join(reps, F.col("node") == F.col("of")).drop("of")
        texts = docs.select(F.col(id_col).cast("long").alias("id_"), F.xxhash64(text_col).alias("hash_"), F.col(text_col).alias("text"))
        same = F.col("id_").eqNullSafe(F.col("rep_id")) & (F.col("hash_") == F.col("rep_hash"))
        found = texts.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_NODES else wanted, same)

        def make():
            words, seen = Words(), set()

            def rows(group, i, j, node, other, label, high, low, texts):
                for at, text in enumerate(texts):
                    place = group[at], i[at], j[at], node[at], other[at]
                    if place in seen:  # a repeated row of the document
                        continue
                    s = shingles(text, words, N, lower=True)
                    told = divmod(xxhash.xxh3_128_intdigest(s.tobytes()), 1 << 64)
                    # a text that meets a node by chance of its hash is told by its shingles
                    if signed(np.array(told, dtype=np.uint64)) == [high[at], low[at]]:
                        seen.add(place)
                        yield *place[:4], other[at], label[at], s.tobytes()

            return rows

        return map_rows(found.select("group", "i", "j", "node", "other", "label", "high", "low", "text"), make, "group long, i int, j int, node long, other boolean, label long, payload binary")

    return attach


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = THRESHOLD, bucket: int = BUCKET, block: int = BLOCK_NODES) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row: the size of its set, the least id it is linked
    with, directly or through others, itself included, and whether that is its own."""
    work = scratch(docs.sparkSession, "minmax-work")
    rows = stored(sketched(docs, id_col, text_col), "minmax-rows")
    rep = F.min(F.struct(F.col("id_").isNull().alias("none"), "id_", "key_")).alias("rep")
    sets = rows.filter("high is not null").groupBy("high", "low").agg(rep, F.max("size").alias("size"), F.max("sketch").alias("sketch"))
    # the numbers are what was written, however often a lost task was run
    nodes = stored(sets.withColumn("node", F.monotonically_increasing_id()), "minmax-nodes", work)
    sketches = nodes.select(F.col("node").alias("of"), F.col("sketch").alias("payload"))
    near = settle(buckets(nodes, work), lambda dealt: dealt.join(sketches, F.col("node") == F.col("of")), near_signatures(math.ceil((threshold - SLACK) * 2 * HASHES)), bucket, 1 << 40, work)
    groups = components(near, work=work).select(F.col("node").alias("of"), F.col("component").alias("group"))
    members = nodes.join(groups, F.col("node") == F.col("of")).select("group", "node", "size")
    exact = settle(members, with_sets(docs, nodes, id_col, text_col), near_sets(threshold), block, BLOCK_SHINGLES, work)
    linked = nodes.select("node", "rep").join(components(exact, work=work), "node")
    least = linked.groupBy("component").agg(F.min("rep.id_").alias("least_"))
    heads = linked.join(least, "component").select("node", "least_")
    # written, so that the join has a plain shuffle on either side and copies of one node can be split
    told = stored(nodes.select("node", F.col("high").alias("of_high"), F.col("low").alias("of_low"), "rep.id_").join(heads, "node", "left").select("of_high", "of_low", F.coalesce("least_", "id_").alias("least_")), "minmax-told")
    delete(docs.sparkSession, work)
    out = rows.join(told, (F.col("high") == F.col("of_high")) & (F.col("low") == F.col("of_low")), "left")
    component = F.coalesce("least_", "id_")
    return out.select(F.col("id_").alias(id_col), F.col("size").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("id_")).alias("kept"))
