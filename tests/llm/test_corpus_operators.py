"""Jaccard join, mixing, token counts, sharding and the pipeline against brute force."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from itertools import combinations, pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scrivener.llm import components as cc
from scrivener.llm import jaccard_join, mixing, queries, resharding
from scrivener.llm.common import scratch, stored
from scrivener.llm.components import components
from scrivener.llm.lines import in_blocks
from scrivener.llm.token_counts import Rollup, count_pieces, revised, signed


# --- components ---------------------------------------------------------------------------------


def roots(n, links):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return [root(i) for i in range(n)]


def test_components(spark, monkeypatch):
    rng = random.Random(2)
    chain = list(pairwise(rng.sample(range(60), 60)))
    star = [(100, i) for i in range(101, 140)]
    mixed = [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    links = chain + star + mixed + [(5, 5), (7, 5), (5, 7)]
    table = spark.createDataFrame([*links, (None, 3)], "a long, b long")
    expected, linked = roots(260, links), {x for a, b in links if a != b for x in (a, b)}
    assert {r["node"]: r["component"] for r in components(table).collect()} == {i: expected[i] for i in linked}
    assert components(table.limit(0)).count() == 0
    monkeypatch.setattr(cc, "LOCAL_LINKS", 7)  # many partitions, so that the rounds have work left
    assert {r["node"]: r["component"] for r in components(table).collect()} == {i: expected[i] for i in linked}


# --- Jaccard join -------------------------------------------------------------------------------


def shingle_set(text):
    w = (text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_force(rows, threshold=0.8):
    """{id: (class_id, n_links)} of rows with distinct ids."""
    sets = [shingle_set(t) for _, t in rows]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    shared = Counter()
    for group in holders.values():
        shared.update(combinations(group, 2))
    links = [(a, b) for (a, b), c in shared.items() if c >= threshold * (len(sets[a]) + len(sets[b]) - c) - 1e-9]
    top, number = roots(len(rows), links), Counter(x for ab in links for x in ab)
    least = defaultdict(list)
    for i, r in enumerate(top):
        least[r].append(rows[i][0])
    return {rows[i][0]: (min(least[r]), number[i]) for i, r in enumerate(top)}


def near_copies(n, seed=1, words=120, edits=3):
    """Texts around one base, each a few edits away from it, so that their links form no clique."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    base = [word() for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(words)] = word()
        out.append(" ".join(w))
    return out


def found(df):
    return {r["doc_id"]: (r["class_id"], r["n_links"]) for r in df.collect()}


def test_join_is_exact_on_the_small_tables(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert found(jaccard_join.join(documents)) == brute_force(rows)


@pytest.mark.parametrize("limits", [{}, {"limit": 12, "depth": 2, "deepest": 5}])
def test_join_of_a_large_group_in_small_blocks(spark, limits):
    """All buckets split or are dealt into block pairs; exact comparisons too."""
    texts = near_copies(160) + near_copies(40, seed=9) + [f"w{i} x{i} y{i} z{i} q{i} r{i}" for i in range(30)]
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    old = jaccard_join.BLOCK_NODES
    try:
        jaccard_join.BLOCK_NODES = 32 if limits else old
        assert found(jaccard_join.join(docs, **limits)) == brute_force(rows)
    finally:
        jaccard_join.BLOCK_NODES = old


def test_join_edges(spark, edge_docs, no_docs):
    got = jaccard_join.join(edge_docs).collect()
    by_id = defaultdict(list)
    for r in got:
        by_id[r["doc_id"]].append((r["class_id"], r["n_links"]))
    assert len(got) == edge_docs.count()
    # "word" stands in rows 3 (twice) and 50
    assert by_id[3] == [(3, 2)] * 2 and by_id[50] == [(3, 2)] and by_id[0] == [(0, 0)] and by_id[1] == [(1, 0)] and by_id[2] == [(2, 0)]
    assert jaccard_join.join(no_docs).count() == 0
    kept = jaccard_join.deduplicate(edge_docs)
    ids = sorted(r["doc_id"] for r in kept.collect())
    assert kept.columns == edge_docs.columns and ids == sorted(set(by_id) - {50})
    assert jaccard_join.deduplicate(no_docs).count() == 0


def test_recall_of_runs():
    """The recall holds over all that sketches of a pair may agree in, not at their mean."""
    n = jaccard_join.SKETCH
    runs = jaccard_join.runs_for(0.999, 6, 0.8, 36)
    assert runs > jaccard_join.runs_for(0.999, 4, 0.8, 36) and jaccard_join.recall_of(runs, 6, 0.8, 36) >= 0.999
    rng = np.random.default_rng(0)
    hits = 0
    for _ in range(1000):
        a = rng.integers(0, 1 << 32, n, dtype=np.uint32)
        b = np.where(rng.random(n) < 0.8, a, a + np.uint32(1)).astype(np.uint32)
        paths, owners = jaccard_join.paths_of(np.stack((a, b)), runs, 6)
        hits += bool(set(paths[owners == 0].tolist()) & set(paths[owners == 1].tolist()))
    assert hits >= 993


def test_deduplicate_goes_by_row_not_by_id(spark):
    """The only copy of a text stays whatever its id; rows without an id and repeated rows are told apart by text."""
    same, other, bare = "the same text of many words " * 3, "another text of other words here " * 3, "no id but these words stand alone " * 3
    rows = [(1, same, 1), (5, same, 2), (5, other, 3), (None, same, 4), (None, bare, 5), (None, bare, 6), (7, "", 7), (7, "", 8), (None, "", 9), (None, None, 10), (1, same, 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, told_id_ int").withColumn("node", F.lit("clash"))
    kept = jaccard_join.deduplicate(docs)
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    assert kept.columns == docs.columns
    assert got == Counter({(1, same): 1, (5, other): 1, (None, bare): 1, (7, ""): 1, (None, ""): 1, (None, None): 1})


def test_near_copies_without_ids_are_linked(spark):
    texts = near_copies(30)
    docs = spark.createDataFrame([(None, t) for t in texts] + [(4, "x y z")], "doc_id long, text string")
    expected = Counter(n for _, n in brute_force(list(enumerate(texts))).values())
    assert Counter(r["n_links"] for r in jaccard_join.join(docs.filter("doc_id is null")).collect()) == expected
    classes = {c for c, _ in brute_force(list(enumerate(texts))).values()}
    assert jaccard_join.deduplicate(docs).count() == len(classes) + 1


def test_overlaps_sparse_and_dense():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 90)).astype(np.uint64)) for _ in range(70)]
    expected = np.array([[len(np.intersect1d(a, b)) if i != j else 0 for j, b in enumerate(sets)] for i, a in enumerate(sets)])
    got = jaccard_join.overlaps(sets)
    np.fill_diagonal(got, 0)
    assert np.array_equal(got, expected)


# --- mixing -------------------------------------------------------------------------------------


def test_targets_reshare_what_passes_the_most():
    assert mixing.targets([100, 100, 100], [5, 2, 1], 450, 2) == [200, 2 / 3 * 250, 1 / 3 * 250]
    assert mixing.targets([0, 10], [5, 2], 15, 2) == [0.0, 15.0] and mixing.targets([], [], 0, 2) == []
    got = mixing.targets([1, 10, 100, 1000], [5, 2, 1, 5], 1666.5, 2)
    assert abs(sum(got) - 1666.5) < 1e-9 and got[:2] == [2, 20]


def test_splitting_tree_keeps_quotas_and_evens_shards():
    quotas = [1000, 10, 0, 333, 7]
    for shards in (1, 3, 16):
        tree = mixing.splitting_tree(quotas, shards, 5)
        assert tree.sum(axis=0).tolist() == quotas and (tree >= 0).all()
        assert tree.sum(axis=1).max() - tree.sum(axis=1).min() <= 2 and np.array_equal(tree, mixing.splitting_tree(quotas, shards, 5))
    # the hypergeometric law: a shard's share of a source has its mean and variance
    draws = np.array([mixing.splitting_tree([400, 1200], 4, s)[0, 0] for s in range(400)])
    assert abs(draws.mean() - 100) < 2 and 0.7 < draws.var() / (400 * 0.25 * 0.75 * 1200 / 1599) < 1.3


def words(text):
    return len((text or "").encode().split())


def shared_out(sizes, weights, total):
    """Shares by weight, at most twice each size, found by raising one common level until all is shared."""
    low, high = 0.0, 4.0 * total
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(level * w, 2 * n) for n, w in zip(sizes, weights, strict=True)) < total else (low, level)
    return [min(high * w, 2 * n) for n, w in zip(sizes, weights, strict=True)]


def test_mixing_meets_targets(spark, sf_dir, documents):
    rows = queries.op4_mixing(spark, sf_dir).collect()
    source = {r["doc_id"]: r["source"] for r in documents.collect()}
    size = {r["doc_id"]: words(r["text"]) for r in documents.collect()}
    assert {r["doc_id"]: r["size"] for r in rows} == size and all(r["taken"] <= 2 * r["size"] for r in rows)
    names = sorted(set(source.values()))
    totals = [sum(size[i] for i in source if source[i] == n) for n in names]
    goal = dict(zip(names, shared_out(totals, [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5 * sum(totals)), strict=True))
    taken = Counter()
    for r in rows:
        taken[source[r["doc_id"]]] += r["taken"]
        assert abs(r["target"] - goal[source[r["doc_id"]]]) < 1e-3 and r["source_size"] == totals[names.index(source[r["doc_id"]])]
        assert len(r["shards"]) == len(r["blocks"]) == (r["taken"] > 0) + (r["taken"] > r["size"])
    assert all(abs(taken[n] - goal[n]) <= 0.5 for n in names)
    again = queries.op4_mixing(spark, sf_dir).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))


def test_what_the_tree_does_not_draw_is_not_in_the_mix(spark, documents, monkeypatch):
    """The tree decides: without its draws nothing is taken, and each shard has the blocks it drew."""
    drawn = []
    real = mixing.splitting_tree
    monkeypatch.setattr(mixing, "splitting_tree", lambda *a: drawn.append(real(*a)) or drawn[-1])
    rows = mixing.plan(documents, shards=4, block_words=300).collect()
    source = {r["doc_id"]: r["source"] for r in documents.collect()}
    names = sorted(set(source.values()))
    blocks = defaultdict(set)
    for r in rows:
        for d in r["draws"]:
            blocks[d["shard"], names.index(source[r["doc_id"]])].add((d["epoch"], d["block"]))
    assert {k: len(v) for k, v in blocks.items()} == {(s, i): int(n) for s, row in enumerate(drawn[0]) for i, n in enumerate(row) if n}
    monkeypatch.setattr(mixing, "splitting_tree", lambda quotas, shards, seed: np.zeros((shards, len(quotas)), dtype=np.int64))
    assert all(not r["draws"] for r in mixing.plan(documents).collect())


def test_shards_are_gathered_and_shuffled(spark, documents):
    made = stored(mixing.mix(documents, shards=4, file_words=20_000), "test-mix")
    at = made.select("*", F.input_file_name().alias("part"), F.monotonically_increasing_id().alias("row")).collect()
    files = defaultdict(set)
    for r in at:
        files[r["mix_shard"], r["mix_file"]].add(r["part"])
    assert {s for s, _ in files} == set(range(4)) and len(files) > 4 and all(len(p) == 1 for p in files.values())
    runs = [r["source"] for r in sorted(at, key=lambda r: r["row"])]
    changes = sum(a != b for a, b in pairwise(runs))
    assert changes > 0.4 * len(runs)  # sources alternate within files


def test_mixing_edges_and_draws(spark, edge_docs, no_docs):
    small = mixing.plan(edge_docs, block_words=7, shards=4).collect()
    assert len(small) == edge_docs.count() and all(sum(d["words"] for d in r["draws"]) <= 2 * r["size"] for r in small)
    assert {s for r in small for s in [d["shard"] for d in r["draws"]]} <= set(range(4))
    made = mixing.mix(edge_docs)
    assert made.columns == [*edge_docs.columns, "mix_shard", "mix_file"]
    assert sum(words(r["text"]) for r in made.collect()) == sum(d["words"] for r in mixing.plan(edge_docs).collect() for d in r["draws"])
    assert mixing.plan(no_docs).count() == 0 and mixing.mix(no_docs).count() == 0


# --- token counts -------------------------------------------------------------------------------


def test_rollup_is_idempotent_and_additive(spark):
    counts = lambda *rows: spark.createDataFrame(rows, "source string, lang string, tokenizer string, n_tokens long")
    roll = Rollup(spark, scratch(spark, "rollup"))
    assert roll.totals().count() == 0
    first = counts(("a", "en", "v1", 10), ("a", "en", "v1", 5), ("b", None, "v1", 7), (None, None, None, None))
    assert roll.commit("one", signed(first, 1)) and not roll.commit("one", signed(first, 1))
    assert roll.commit("gone", signed(counts(("b", None, "v1", 7)), -1))
    assert roll.commit("revised", revised(counts(("a", "en", "v1", 5)), counts(("a", "en", "v2", 6))))
    assert roll.commit("empty", signed(first.limit(0), 1))
    again = Rollup(spark, roll.path)
    assert sorted((tuple(r) for r in again.totals().collect()), key=str) == sorted([("a", "en", "v1", 1, 10), ("a", "en", "v2", 1, 6), (None, None, None, 1, 0)], key=str)
    # a batch that broke off before its rename does not count, whatever it has written
    signed(counts(("x", "x", "x", 99)), 1).write.parquet(f"{roll.path}/_staged-broken")
    assert "x" not in {r["source"] for r in roll.totals().collect()}
    # of two writers of one batch the second finds the first's
    changes = signed(counts(("y", "y", "y", 1)), 1)
    again.committed = lambda batch: False  # it looked before the first was done
    assert roll.commit("both", changes) and not again.commit("both", changes)
    assert {r["source"]: r["n_docs"] for r in roll.totals().collect()}["y"] == 1


def test_compaction_changes_no_total(spark):
    roll = Rollup(spark, scratch(spark, "rollup"))
    one = spark.createDataFrame([("a", "en", "v1", 3)], "source string, lang string, tokenizer string, n_tokens long")
    assert not roll.compact()
    for k in range(3):
        assert roll.commit(f"b{k}", signed(one, 1)) and roll.compact() and not roll.commit(f"b{k}", signed(one, 1)) and not roll.commit("b0", signed(one, 1))
        assert [tuple(r) for r in roll.totals().collect()] == [("a", "en", "v1", k + 1, 3 * k + 3)]
    assert roll.commit("gone", signed(one, -1)) and roll.commit("more", signed(one, 1))
    # broken off after the rename: the merged batches' folders are still there
    real, roll._fs = roll._fs, type("Kept", (), {"__getattr__": lambda _, name: (lambda *a: True) if name == "delete" else getattr(real, name)})()
    assert roll.compact()
    roll._fs = real
    assert [tuple(r) for r in roll.totals().collect()] == [("a", "en", "v1", 3, 9)] and roll.compact() is False
    assert len([n for n in roll._names() if n.startswith("batch-")]) == 2


def test_an_overtaken_compaction_gives_way(spark):
    """The folders it reads are merged and deleted by another: False, totals right, nothing left behind."""
    roll = Rollup(spark, scratch(spark, "rollup"))
    one = spark.createDataFrame([("a", "en", "v1", 3)], "source string, lang string, tokenizer string, n_tokens long")
    for k in range(3):
        roll.commit(f"b{k}", signed(one, 1))
    other, real = Rollup(spark, roll.path), roll._summed

    def late(rows):
        assert other.compact()
        return real(rows)

    roll._summed = late
    assert roll.compact() is False
    assert [tuple(r) for r in other.totals().collect()] == [("a", "en", "v1", 3, 9)]
    assert not [n for n in other._names() if n.startswith("_staged")]
    spark.range(1).write.parquet(f"{roll.path}/_staged-dead")
    assert roll.sweep() == 0 and roll.sweep(-1) == 1 and not [n for n in other._names() if n.startswith("_staged")]


def test_token_counts_are_those_of_all_documents(spark, sf_dir, documents, edge_docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    expected = defaultdict(lambda: [0, 0])
    for r in documents.collect():
        for version, n in (("words_v1", words(r["text"])), ("piece_bpe_32k", len(sp.encode(r["text"] or "")))):
            expected[r["source"], r["lang"], version][0] += 1
            expected[r["source"], r["lang"], version][1] += n
    got = {(r["source"], r["lang"], r["tokenizer"]): [r["n_docs"], r["n_tokens"]] for r in queries.op5_token_counts(spark, sf_dir).collect()}
    assert got == expected
    assert count_pieces(edge_docs, queries.piece_model()).count() == edge_docs.count()


# --- sharding -----------------------------------------------------------------------------------


def least_cost(supply, room, cost):
    """Cheapest way to ship units one by one (Bellman-Ford over single units), for small networks."""
    best = None

    def go(units, left, paid):
        nonlocal best
        if best is not None and paid >= best:
            return
        if not units:
            best = paid
            return
        for j in range(len(left)):
            if left[j]:
                left[j] -= 1
                go(units[1:], left, paid + cost(units[0], j))
                left[j] += 1

    go([i for i, n in supply.items() for _ in range(n)], list(room), 0)
    return best


def test_flow_is_the_cheapest():
    flow = resharding.min_cost_flow({0: 10, 1: 4, 2: 1}, [5, 5, 5])
    assert sum(f for (i, j), f in flow.items() if i != j) == 5 and all(sum(f for (i, _), f in flow.items() if i == k) == s for k, s in ((0, 10), (1, 4), (2, 1)))
    cost = lambda i, j: [[4, 1], [2, 9]][i][j]
    assert resharding.min_cost_flow({0: 3, 1: 2}, [2, 3], cost) == {(0, 1): 3, (1, 0): 2}
    assert resharding.min_cost_flow({}, [1]) == {} and resharding.level_rooms([9, 0, 1], 5) == [0, 3, 2]
    rng = random.Random(4)
    for _ in range(25):
        supply = {i: rng.randrange(4) for i in rng.sample(range(-1, 4), 3)}
        room = [rng.randrange(1, 5) for _ in range(3)]
        while sum(room) < sum(supply.values()):
            room[0] += 1
        for price in (None, lambda i, j: (i * 7 + j * 5) % 6):
            flow = resharding.min_cost_flow(supply, room, price)
            price = price or (lambda i, j: int(i != j))
            assert all(sum(f for (a, _), f in flow.items() if a == i) == s for i, s in supply.items()) and all(sum(f for (_, b), f in flow.items() if b == j) <= r for j, r in enumerate(room))
            assert sum(f * price(i, j) for (i, j), f in flow.items()) == least_cost(supply, room, price)
    # as many arcs as shards, not as pairs of shards
    many = resharding.min_cost_flow({i: 1000 + i % 7 for i in range(3000)}, [900] * 3400)
    assert sum(many.values()) == sum(1000 + i % 7 for i in range(3000)) and len(many) < 3 * 3400


def shards_of(rows):
    held, slots = Counter(), defaultdict(list)
    for r in rows:
        held[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return held


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_shards_are_even_gapless_and_move_little(spark, sf):
    rows = queries.op9_sharding(spark, f"/root/testdata/{sf}").collect()
    text = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()}
    import zlib

    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in text.items()}
    held, old = shards_of(rows), Counter()
    for r in rows:
        old[r["old_shard"]] += r["size"]
    mean = sum(held.values()) / 16
    assert set(held) == set(range(16)) and max(held.values()) <= 1.02 * mean and min(held.values()) >= 0.98 * mean
    moved, least = sum(r["size"] for r in rows if r["shard"] != r["old_shard"]), sum(max(0, b - mean) for b in old.values())
    assert 0.99 * least <= moved <= 1.01 * least


def test_the_flow_decides(spark, sf_dir, documents, monkeypatch):
    """Another flow moves other bytes, whether documents are large or small beside a shard."""
    real = resharding.min_cost_flow
    small = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit("s").alias("source"))
    for docs, old in ((documents, F.pmod(F.xxhash64("source"), F.lit(12))), (small, F.pmod("doc_id", F.lit(3)))):
        moved = lambda: {(r["old_shard"], r["shard"]): r["b"] for r in resharding.assign(docs, old, 4).groupBy("old_shard", "shard").agg(F.sum("size").alias("b")).collect()}  # noqa: B023, E731
        first = moved()
        monkeypatch.setattr(resharding, "min_cost_flow", lambda supply, room: real(supply, room, lambda i, j: int(i == j)))
        second = moved()
        monkeypatch.setattr(resharding, "min_cost_flow", real)
        stays = lambda found: sum(b for (i, j), b in found.items() if i == j)
        assert stays(first) > 2 * stays(second)


def test_small_documents_follow_the_flow(spark):
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 7).cast("int")).alias("text"), F.lit("clash").alias("slot"))
    old = F.when(F.col("doc_id") % 10 < 6, 0).otherwise(F.col("doc_id") % 10 - 5)
    out = stored(resharding.assign(docs, old, 8), "test-shards")
    held = {r["shard"]: (r["b"], r["n"], r["top"]) for r in out.groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.max("slot").alias("top")).collect()}
    mean = sum(b for b, *_ in held.values()) / 8
    assert set(held) == set(range(8)) and all(abs(b - mean) < 0.01 * mean and n == top + 1 for b, n, top in held.values())
    assert out.select("shard", "slot").distinct().count() == 40_000
    moved = out.filter("old_shard <> shard").agg(F.sum("size")).first()[0]
    least = sum(max(0, r[0] - mean) for r in out.groupBy("old_shard").agg(F.sum("size")).select("sum(size)").collect())
    assert 0.99 * least <= moved <= 1.02 * least


def test_rewriting_from_more_shards_to_fewer_and_back(spark):
    """The folder holds every row once after each change, and no shard that is no longer there; files
    of shards that nothing enters or leaves stay."""
    docs = spark.range(1600).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 90).cast("int")).alias("text"), F.lit(5).alias("size_"))
    path = scratch(spark, "test-reshard")
    placed = resharding.Plan(docs, F.lit(0), 16)
    assert resharding.rewrite(docs, placed, path) == list(range(16))
    for n in (12, 16, 16, 5):
        here = spark.read.parquet(path)
        files = {f for f in here.inputFiles()}
        which = resharding.rewrite(here, resharding.Plan(here, F.col("shard"), n), path)
        rows = spark.read.parquet(path)
        assert rows.count() == 1600 and rows.select("doc_id").distinct().count() == 1600 and rows.columns == ["doc_id", "text", "size_", "slot", "shard"]
        got = rows.select("shard", "slot", (F.length("text") + 1).alias("size")).collect()
        held = shards_of(got)
        assert set(held) == set(range(n)) and max(held.values()) - min(held.values()) <= 180
        if not which:
            assert files == set(rows.inputFiles())
    # a swap that broke off half-way is ended by the next call
    staged = f"{path}/_reshard-broken"
    spark.read.parquet(path).filter("shard = 1").write.partitionBy("shard").parquet(f"{staged}/new")
    spark.createDataFrame([(1,), (4,)], "shard int").write.parquet(f"{staged}/which")
    resharding.settle(spark, path)
    assert {r["shard"] for r in spark.read.parquet(path).select("shard").distinct().collect()} == {0, 1, 2, 3}


def test_rewriting_rows_of_one_id(spark):
    """Copies of a row, and other texts under its id, are each written once, at slots of their own."""
    rows = [(i, f"text {i} " * 5) for i in range(40)] + [(3, "text 3 " * 5), (3, "another text"), (None, "x"), (None, None)] + [(9, "hot")] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash"))
    path = scratch(spark, "test-reshard")
    plan = resharding.Plan(docs, F.lit(0), 3)
    assert resharding.rewrite(docs, plan, path) == [0, 1, 2]
    written = spark.read.parquet(path)
    assert Counter((r["doc_id"], r["text"]) for r in written.collect()) == Counter(rows)
    size = (F.octet_length(F.coalesce("text", F.lit(""))) + 1).alias("size")
    held = shards_of(written.select("shard", "slot", size).collect())
    assert max(held.values()) - min(held.values()) <= 100
    assigned = plan.assignment().groupBy("shard").count().collect()
    assert {r["shard"]: r["count"] for r in assigned} == {r["shard"]: r["count"] for r in written.groupBy("shard").count().collect()}


def test_sharding_edges(spark, edge_docs, no_docs):
    out = resharding.assign(edge_docs, F.lit(None).cast("int"), 3).collect()
    assert len(out) == edge_docs.count() and {r["shard"] for r in out} <= {0, 1, 2}
    assert resharding.assign(no_docs, F.lit(0), 3).count() == 0 and resharding.resharded(no_docs, F.lit(0), 3).count() == 0
    assert resharding.resharded(edge_docs, F.lit(0), 3).count() == edge_docs.count()


# --- pipeline -----------------------------------------------------------------------------------


def test_pipeline_stages(spark, sf_dir, documents):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "ngram_jaccard", "mixing", "sentencepiece"] and corpus_pipeline.ORACLE_SQL is None
    docs, seen = documents, []
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, sf_dir), "test-stage")
        if name != "sentencepiece":
            assert out.columns == documents.columns
        seen.append((docs, out))
        docs = out
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    gone = {r["doc_id"] for r in seen[0][0].collect()} - {r["doc_id"] for r in seen[0][1].collect()}
    assert gone and sum(labels.get(i, 1) == 0 for i in gone) <= 0.02 * documents.count()
    rows = [(r["doc_id"], r["text"]) for r in seen[1][0].collect()]
    assert sorted(r["doc_id"] for r in seen[1][1].collect()) == sorted(i for i, (c, _) in brute_force(rows).items() if i == c)
    before, after = ({r["doc_id"]: r for r in df.collect()} for df in seen[2])
    n = Counter(r["doc_id"] for r in seen[2][1].collect())
    assert max(n.values()) <= 2 and set(after) <= set(before) and all(r["n_chars"] == len(r["text"]) for r in after.values())
    total = sum(words(r["text"]) for r in seen[2][1].collect())
    assert abs(total - 1.5 * sum(words(r["text"]) for r in before.values())) <= 20
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    encoded = seen[3][1].collect()
    expected = Counter((r["doc_id"], tuple(sp.encode(r["text"] or ""))) for r in seen[3][0].collect())
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in encoded) == expected


def test_pipeline_runs_as_one(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_stages_take_edges(spark, sf_dir, edge_docs, no_docs):
    """What each stage keeps of the edges is what brute force keeps."""
    docs = edge_docs
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, sf_dir), "test-stage")
        before, after = (df.collect() for df in (docs, out))
        if name == "toxicity":
            assert {r["text"] for r in before} >= {r["text"] for r in after} and {None, "", "word"} <= {r["text"] for r in after}
        elif name == "ngram_jaccard":
            counted = [r for r in before if words(r["text"])]
            rows = {r["doc_id"]: r["text"] for r in counted}
            heads = {i for i, (c, _) in brute_force(sorted(rows.items())).items() if i == c}
            assert sorted(r["doc_id"] for r in after if words(r["text"])) == sorted(heads)
            assert sorted(r["doc_id"] for r in after if not words(r["text"])) == sorted({r["doc_id"] for r in before if not words(r["text"])})
        elif name == "mixing":
            taken = sum(words(r["text"]) for r in after)
            assert all(words(r["text"]) for r in after) and abs(taken - 1.5 * sum(words(r["text"]) for r in before)) <= 4
        else:
            assert len(after) == len(before) and all(r["n_tokens"] == len(r["ids"]) for r in after)
        docs = out
    docs = no_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0


def test_rows_of_one_id_are_dealt_to_all_blocks(spark):
    """A third of all rows without an id: no block holds more than its share, and all words are drawn."""

    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.concat(F.lit("word number "), F.col("id").cast("string")).alias("text"), F.lit("s").alias("source"))
    keyed = rows.select(F.col("doc_id").alias("id_"), F.octet_length("text").alias("size_"), F.crc32("text").alias("crc_"))
    blocks = in_blocks(keyed, resharding.ALIKE, F.lit(50), 1).filter("id_ is null").groupBy("block_").count().collect()
    assert len(blocks) == 50 and max(r["count"] for r in blocks) < 60
    mixed = mixing.plan(rows, block_words=180).select("doc_id", "size", "target", F.explode("draws").alias("d")).select("doc_id", "d.*")
    nulls = mixed.filter("doc_id is null").groupBy("block").agg(F.countDistinct("order").alias("n")).collect()
    assert len(nulls) == 50 and max(r["n"] for r in nulls) < 60
    assert mixed.agg(F.sum("words")).first()[0] == 13_500
    placed = resharding.resharded(rows, F.lit(0), 4, id_col="doc_id").collect()
    assert len(placed) == 3000 and len({(r["shard"], r["slot"]) for r in placed}) == 3000
