"""N-gram Jaccard self-join by chosen paths: documents whose sets of five-word shingles have a
similarity of 0.8 or more.

Equal shingle sets are joined into one node first, so exact copies are never compared. Each node
gets a sketch of `SKETCH` min-hash tokens. From a root a node follows paths: at every step the path
itself samples one or (a quarter of the time) two sketch positions, and the node goes on to the
bucket of each token it has there. 1.25 steps on average at a similarity of 0.8 keep the number of
buckets two such nodes share at 1 in the mean, however deep the paths are; the number of runs from
fresh roots is the least that finds a pair of similarity 0.8 with probability `RECALL`, counted
over what its sketches may agree in. Buckets
beyond `LIMIT` nodes are split further, down to `DEEPEST`; what is left is compared by brute force, in
blocks of pairs where a bucket is too large for one task. A bucket gives a spanning forest of its
pairs whose sketches agree nearly enough (`SLACK` below the threshold), never all pairs.

The forests' components gather the nodes to verify. Each node's whole shingle set is sent to its
component once (or once a block pair), and every pair in it is compared exactly; a node gets its
number of links, and a spanning forest of the exact links gives the classes.

Words are runs of anything but ASCII white space; a text of 1 to 4 words is one shingle; null or
wordless texts have no shingles, link to nothing and are classes of their own. Repeated rows are
copies. Extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import delete, map_groups, map_rows, scratch, stored
from .components import components

N = 5
THRESHOLD = 0.8
SKETCH = 64
RECALL = 0.999
DEPTH = 4
DEEPEST = 6
LIMIT = 2_000
SLACK = 0.25
#: Nodes and shingles of a block of an exact comparison.
BLOCK_NODES = 512
BLOCK_SHINGLES = 2_000_000
#: Rows of node tables that may be broadcast (seven numbers each, some 20 MB), else they are joined
#: by shuffle.
BROADCAST_NODES = 250_000
#: A token in more sets than this is counted by matrix product, else pair by pair.
DENSE = 32

_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
_S = np.uint64(31)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S)) * _C[0]
    x = (x ^ (x >> np.uint64(29))) * _C[1]
    return x ^ (x >> np.uint64(32))


class Words(dict):
    """64-bit hashes of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str | None, words: Words, size: int = N, lower: bool = False) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles of `size` words; `lower`: A to Z are as a to z."""
    found = (text or "").encode("utf-8", "surrogatepass")
    found = (found.lower() if lower else found).split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter(map(words.__getitem__, found), dtype=np.uint64, count=len(found))
    n = min(size, len(w))
    total = np.full(len(w) - n + 1, n, dtype=np.uint64)
    for j in range(n):
        total += w[j : len(w) - n + 1 + j] * _C[j]
    return np.unique(mixed(total))


def sketch_numbers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    return (rng.integers(0, 1 << 31, SKETCH, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None], rng.integers(0, 1 << 32, SKETCH, dtype=np.uint32)[:, None]


def sketch(tokens: np.ndarray, numbers) -> np.ndarray:
    """Min-hash of the tokens under `SKETCH` hash functions."""
    a, b = numbers
    low = (tokens >> np.uint64(32)).astype(np.uint32)[None, :]
    out = np.full(SKETCH, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, low.shape[1], 2048):
        np.minimum(out, (a * low[:, at : at + 2048] + b).min(axis=1), out=out)
    return out


def survival(depth: int, similarity: float) -> float:
    """Probability that two nodes share a bucket after `depth` steps of one run."""
    lost = 0.0
    for _ in range(depth):
        x = 1 - similarity + similarity * lost
        lost = 0.75 * x + 0.25 * x * x
    return 1 - lost


def recall_of(runs: int, depth: int, similarity: float, least: int = 0) -> float:
    """Probability that a pair of that similarity is found: all runs read one sketch, whose equal
    places are binomial, and pairs under `least` of them are not taken."""
    total = 0.0
    for k in range(least, SKETCH + 1):
        chance = math.comb(SKETCH, k) * similarity**k * (1 - similarity) ** (SKETCH - k)
        total += chance * (1 - (1 - survival(depth, k / SKETCH)) ** runs)
    return total


def runs_for(recall: float, depth: int, similarity: float, least: int = 0) -> int:
    """The least runs that reach `recall`, or half of what the cut at `least` leaves to be missed."""
    wanted = min(recall, (1 + recall_of(1 << 20, depth, similarity, least)) / 2 - 1e-9)
    runs = 1
    while recall_of(runs, depth, similarity, least) < wanted and runs < 200:
        runs += 1
    return runs


def step(paths: np.ndarray, owners: np.ndarray, sketches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One more step of every path: the sampled positions' tokens choose where it goes on."""
    h = mixed(paths)
    one = (h >> np.uint64(8)) % np.uint64(SKETCH)
    two = (one + np.uint64(1) + (h >> np.uint64(20)) % np.uint64(SKETCH - 1)) % np.uint64(SKETCH)
    forks = (h & np.uint64(3)) == 0
    place, base, who = np.concatenate((one, two[forks])), np.concatenate((h, h[forks])), np.concatenate((owners, owners[forks]))
    token = sketches[who, place.astype(np.int64)].astype(np.uint64)
    return mixed(base * _C[2] + place * _C[3] + token), who


def paths_of(sketches: np.ndarray, runs: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(sketches)
    paths = mixed(np.repeat(np.arange(1, runs + 1, dtype=np.uint64), n))
    owners = np.tile(np.arange(n), runs)
    for _ in range(depth):
        paths, owners = step(paths, owners, sketches)
    return paths, owners


def signed(x: np.ndarray) -> list[int]:
    return x.astype(np.uint64).view(np.int64).tolist()


class Forest:
    """Union-find over 0..n-1 that remembers the links that joined something."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.links: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def add(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.links.append((i, j))

    def add_row(self, i: int, js: np.ndarray) -> None:
        for j in js.tolist():
            self.add(i, j)


def text_key(text: Column) -> Column:
    """Two hashes and the length of a text: rows of one id and one such key are the same document."""
    return F.struct(F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("g"), F.coalesce(F.octet_length(text), F.lit(-1)).alias("n"))


def sketched(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_, key_, node, size, sketch): `key_` is the text's, node identifies the shingle set; null
    without shingles."""

    def make():
        words, numbers = Words(), sketch_numbers()

        def rows(ids, keys, texts):
            for i, key, text in zip(ids, keys, texts, strict=True):
                s = shingles(text, words)
                if len(s):
                    yield i, key, signed(np.array([xxhash.xxh64_intdigest(s.tobytes())], dtype=np.uint64))[0], len(s), sketch(s, numbers).tobytes()
                else:
                    yield i, key, None, 0, None

        return rows

    return map_rows(docs.select(F.col(id_col).cast("long"), text_key(F.col(text_col)), F.col(text_col)), make, "id_ long, key_ struct<h:long,g:long,n:int>, node long, size long, sketch binary")


def _near(left: np.ndarray, right: np.ndarray, least: int):
    """Yields (row of `left`, rows of `right`) whose sketches agree in `least` positions or more."""
    for i, s in enumerate(left):
        yield i, np.flatnonzero(np.count_nonzero(right == s, axis=1) >= least)


def bucket_links(nodes: DataFrame, threshold: float, recall: float, depth: int, deepest: int, limit: int, work: str) -> DataFrame:
    """(a, b): spanning forests of the nearly similar pairs of every bucket."""
    least = math.ceil((threshold - SLACK) * SKETCH)
    runs = runs_for(recall, deepest, threshold, least)

    def start():
        def rows(keys, sketches):
            matrix = np.frombuffer(b"".join(sketches), dtype=np.uint32).reshape(-1, SKETCH)
            paths, owners = paths_of(matrix, runs, depth)
            pairs = np.unique(np.stack((paths.view(np.int64), owners)), axis=1)
            yield from ((p, keys[o]) for p, o in zip(*pairs.tolist(), strict=True))

        return rows

    def further():
        def rows(paths, keys, sketches):
            matrix = np.frombuffer(b"".join(sketches), dtype=np.uint32).reshape(-1, SKETCH)
            deeper, owners = step(np.array(paths, dtype=np.int64).view(np.uint64), np.arange(len(keys)), matrix)
            yield from ((p, keys[o]) for p, o in zip(signed(deeper), owners.tolist(), strict=True))

        return rows

    drawn = nodes.select("node", "sketch")
    level, done = stored(map_rows(drawn, start, "path long, node long"), "paths", work), []
    for at in range(depth, deepest + 1):
        counts = level.groupBy("path").agg(F.count("*").alias("n")).filter("n > 1")
        if at == deepest:
            done.append(level.join(counts, "path"))
            break
        done.append(level.join(counts.filter(F.col("n") <= limit), "path"))
        big = level.join(counts.filter(F.col("n") > limit).select("path"), "path")
        level = stored(map_rows(big.join(drawn, "node").select("path", "node", "sketch"), further, "path long, node long").distinct(), "paths", work)
        if level.isEmpty():
            break
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionByName(more)
    # buckets too large for one task: a node goes to every pair of blocks that its own block is in
    blocks = F.ceil(F.col("n") / limit).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks.cast("long")).cast("int")
    dealt = rows.select("path", "node", blocks.alias("blocks"), own.alias("own")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("path", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "own").join(drawn, "node").select("path", "i", "j", "node", "own", "sketch")

    def compare(paths, i, j, keys, own, sketches):
        if len(keys) < 2:
            return
        matrix = np.frombuffer(b"".join(sketches), dtype=np.uint32).reshape(-1, SKETCH)
        forest = Forest(len(keys))
        if i[0] == j[0]:
            for k, hits in _near(matrix[:-1], matrix, least):
                forest.add_row(k, hits[hits > k])
        else:
            side = np.array(own) == i[0]
            left, right = np.flatnonzero(side), np.flatnonzero(~side)
            for k, hits in _near(matrix[left], matrix[right], least):
                forest.add_row(int(left[k]), right[hits])
        for a, b in forest.links:
            yield max(keys[a], keys[b]), min(keys[a], keys[b])

    return map_groups(dealt, ["path", "i", "j"], compare, "a long, b long").distinct()


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets."""
    n = len(sets)
    out = np.zeros(n * n, dtype=np.int64)
    tokens, where = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(tokens, kind="stable")
    tokens, where = tokens[order], where[order]
    begins = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
    counts = np.diff(np.append(begins, len(tokens)))
    for size in np.unique(counts[(counts > 1) & (counts <= DENSE)]):
        rows = where[begins[counts == size][:, None] + np.arange(size)[None, :]]
        for x, y in combinations(range(size), 2):
            out += np.bincount(rows[:, x] * n + rows[:, y], minlength=n * n)
    out = out.reshape(n, n)
    out = out + out.T
    dense = np.flatnonzero(counts > DENSE)
    for at in range(0, len(dense), 4096):
        some = dense[at : at + 4096]
        matrix = np.zeros((n, len(some)), dtype=np.float32)
        for c, k in enumerate(some):
            matrix[where[begins[k] : begins[k] + counts[k]], c] = 1
        out += (matrix @ matrix.T).astype(np.int64)
    return out


def exact_links(docs: DataFrame, members: DataFrame, id_col: str, text_col: str, threshold: float, work: str) -> tuple[DataFrame, DataFrame]:
    """Of `members` (node, rep, copies, size, component): (node, links), the documents a node is
    linked to, and (a, b), spanning forests of the exact links."""
    stats = members.groupBy("component").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_NODES), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("int")
    placed = members.join(stats.select("component", blocks.alias("blocks")), "component")
    placed = stored(placed.select("component", "node", F.col("rep.id_").alias("rep_id"), F.col("rep.key_.h").alias("rep_hash"), "copies", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int").alias("own")), "jaccard-members", work)
    # a text that meets a node by chance of its hash is told by its shingles below
    texts = docs.select(F.col(id_col).cast("long").alias("id_"), F.xxhash64(text_col).alias("hash_"), F.col(text_col).alias("text"))
    same = F.col("id_").eqNullSafe(F.col("rep_id")) & (F.col("hash_") == F.col("rep_hash"))
    found = texts.join(F.broadcast(placed) if placed.count() <= BROADCAST_NODES else placed, same)

    def make():
        words = Words()

        def rows(component, node, copies, blocks, own, texts):
            for c, k, m, b, o, text in zip(component, node, copies, blocks, own, texts, strict=True):
                s = shingles(text, words)
                if len(s) and signed(np.array([xxhash.xxh64_intdigest(s.tobytes())], dtype=np.uint64))[0] == k:
                    yield c, k, m, b, o, s.tobytes()

        return rows

    sets = map_rows(found.select("component", "node", "copies", "blocks", "own", "text"), make, "component long, node long, copies long, blocks int, own int, tokens binary")
    dealt = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "own", "copies", "tokens")

    def compare(component, i, j, nodes, own, copies, tokens):
        first = list({k: x for x, k in reversed(list(enumerate(nodes)))}.values())  # repeated rows of a representative
        first.sort(key=lambda x: nodes[x])
        keys, mult, side = [nodes[x] for x in first], np.array([copies[x] for x in first]), np.array([own[x] for x in first])
        arrays = [np.frombuffer(tokens[x], dtype=np.uint64) for x in first]
        if len(keys) < 2:
            return
        sizes = np.array([len(a) for a in arrays])
        common = overlaps(arrays)
        linked = common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-9
        np.fill_diagonal(linked, False)
        if i[0] != j[0]:
            linked &= side[:, None] != side[None, :]
        forest = Forest(len(keys))
        for x in range(len(keys)):
            hits = np.flatnonzero(linked[x])
            forest.add_row(x, hits[hits > x])
        for k, n in zip(keys, (linked @ mult).tolist(), strict=True):
            if n:
                yield k, None, n
        for a, b in forest.links:
            yield keys[a], keys[b], None

    out = stored(map_groups(dealt, ["component", "i", "j"], compare, "a long, b long, n long"), "jaccard-links", work)
    return out.filter("n is not null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links")), out.filter("b is not null").select("a", "b")


def classes(docs: DataFrame, id_col: str, text_col: str, threshold: float, recall: float, depth: int, deepest: int, limit: int) -> DataFrame:
    """(id_, key_, node, class_, links_) of every row: `class_` is the least id of all documents it is
    linked with, directly or through others, itself included; null for rows without an id that are
    linked with none that has one."""
    spark = docs.sparkSession
    work = scratch(spark, "jaccard-work")
    rows = stored(sketched(docs, id_col, text_col), "jaccard-sketches")
    nodes = stored(rows.filter("node is not null").groupBy("node").agg(F.min(F.struct(F.col("id_").isNull().alias("none"), "id_", "key_")).alias("rep"), F.count("*").alias("copies"), F.max("size").alias("size"), F.max("sketch").alias("sketch")), "jaccard-nodes", work)
    near = components(bucket_links(nodes, threshold, recall, depth, deepest, limit, work), work=work)
    members = nodes.drop("sketch").join(near, "node")
    links, forest = exact_links(docs, members, id_col, text_col, threshold, work)
    final = components(forest, work=work)
    heads = nodes.select("node", "rep").join(final, "node")
    heads = heads.join(heads.groupBy("component").agg(F.min("rep.id_").alias("class")), "component").select("node", "class", "component")
    table = nodes.select("node", "rep", "copies").join(heads, "node", "left").join(links, "node", "left")
    table = table.select("node", F.coalesce("component", "node").alias("group_"), F.coalesce("class", "rep.id_").alias("class_"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links_"))
    # written, so that the join has a plain shuffle on either side and copies of one node can be split
    table = stored(table, "jaccard-nodes-linked")
    delete(spark, work)
    return rows.select("id_", "key_", "node").join(table, "node", "left").select("id_", "key_", "node", "group_", F.coalesce("class_", "id_").alias("class_"), F.coalesce("links_", F.lit(0)).cast("long").alias("links_"))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = THRESHOLD, recall: float = RECALL, depth: int = DEPTH, deepest: int = DEEPEST, limit: int = LIMIT) -> DataFrame:
    """(id, class_id, n_links) of every row: `class_id` is the least id of all documents it is
    linked with, directly or through others; `n_links` the number of other rows of similarity
    `threshold` or more."""
    found = classes(docs, id_col, text_col, threshold, recall, depth, deepest, limit)
    return found.select(F.col("id_").alias(id_col), F.col("class_").alias("class_id"), F.col("links_").alias("n_links"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = THRESHOLD, recall: float = RECALL, depth: int = DEPTH, deepest: int = DEEPEST, limit: int = LIMIT) -> DataFrame:
    """`docs` with one row of each class of `join`: that of the least id (a row without an id only
    where none has one), of rows with that id the one of the least text hash, of its repeats one.
    Rows are told apart by id and text, so an id that stands on several texts loses none that is the
    only one of its class. A row without words is a class of its own and stays, but for repeats of it
    under the same id."""
    found = stored(classes(docs, id_col, text_col, threshold, recall, depth, deepest, limit), "jaccard-classes")
    order = F.struct(F.col("id_").isNull().alias("none"), "id_", "key_")
    groups = found.filter("node is not null").groupBy("group_").agg(F.min(order).alias("head_"), F.count("*").alias("n_")).filter("n_ > 1")
    # written, as above: rows of a hot group can be split
    told = found.join(stored(groups.select("group_", "head_"), "jaccard-heads"), "group_", "left")
    told = told.filter("node is not null or id_ is not null").select("id_", "key_", F.coalesce(order != F.col("head_"), F.lit(False)).alias("goes_"))
    told = told.groupBy("id_", "key_").agg(F.max("goes_").alias("goes_"), F.count("*").alias("n_")).filter("goes_ or n_ > 1")
    told = stored(told.select(F.col("id_").alias("told_id_"), F.col("key_").alias("told_key_"), "goes_"), "jaccard-told")
    few = told.count() <= BROADCAST_NODES
    # the row as one struct, so that no name of its columns clashes
    own = docs.select(F.struct(*docs.columns).alias("row_"), F.col(id_col).cast("long").alias("id_"), text_key(F.col(text_col)).alias("key_"))
    same = F.col("id_").eqNullSafe(F.col("told_id_")) & (F.col("key_") == F.col("told_key_"))
    some = lambda df: F.broadcast(df.drop("goes_")) if few else df.drop("goes_")
    single = own.join(some(told), same, "left_anti")
    repeated = own.join(some(told.filter("not goes_")), same, "left_semi").dropDuplicates(["id_", "key_"])
    return single.unionByName(repeated).select("row_.*")
