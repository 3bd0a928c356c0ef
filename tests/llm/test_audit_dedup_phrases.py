"""Filter audit, min-max deduplication and collocations against brute force and their SQL."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from itertools import combinations, permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from scrivener.llm import collocations, filter_audit, minmax_dedup, queries
from scrivener.llm.jaccard_join import Words, shingles

TABLES = "documents labels pages conversations".split()


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_minmax_dedup", "op13_collocations"])
def test_query_against_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = con.execute(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    expected = sorted(tuple(r[names.index(c)] for c in columns) for r in found.fetchall())
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == expected and expected


# --- filter audit -------------------------------------------------------------------------------


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def fails(rows):
    """The letters that each row fails, one filter after another as they are stated."""
    out = []
    for i, text, *_ in rows:
        t, w = text or "", words(text)
        copy = i is not None and any(j is not None and j < i and (u or "") == t for j, u, *_ in rows)
        out.append({x for x, bad in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), copy), strict=True) if bad})
    return out


def audit_by_hand(rows, good, toxic):
    failed, out = fails(rows), {}
    for part in {r[2] or "" for r in rows}:
        mine = [k for k, r in enumerate(rows) if (r[2] or "") == part]
        total = Counter()
        for order in map("".join, permutations("ABCDE")):
            alive = set(mine)
            for step, x in enumerate(order, 1):
                gone = {k for k in alive if x in failed[k]}
                alive -= gone
                total[x] += len(gone)
                marked = lambda of: sum(rows[k][0] in of for k in gone)  # noqa: B023, E731
                out[part, order, step] = [len(alive), len(gone), sum(x in failed[k] for k in mine) - len(gone), sum(failed[k] == {x} for k in mine), marked(good), marked(toxic)]
        for order in map("".join, permutations("ABCDE")):
            for step, x in enumerate(order, 1):
                out[part, order, step].append(total[x])
    return out


COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_against_one_order_after_another(spark):
    rng = random.Random(3)
    long = lambda k: " ".join(f"w{rng.randrange(k)}" for _ in range(60))
    rows = [(i, rng.choice([long(30), long(500), long(500).upper(), "short", "", None, long(400) + " #1", "A & B " * 40, "same text " * 30]), rng.choice(["s", "t", None, ""])) for i in range(60)]
    rows += [(None, "same text " * 30, "s"), (None, None, None), rows[5], rows[5], (-4, rows[7][1], "t"), (70, "x" * 100_000 + " $", "u")]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 60, 2)] + [(4, 1, True), (4, 0, False), (None, 1, True), (99, 1, True), (6, None, None)]
    good, toxic = {i for i, q, _ in labels if q and i is not None}, {i for i, _, x in labels if x and i is not None}
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_", F.lit("clash")).withColumn("mask", F.lit(9))
    marks = spark.createDataFrame([(i, q, None if x is None else int(x)) for i, q, x in labels], "doc_id long, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in COLUMNS] for r in filter_audit.audit(filter_audit.masked(docs, marks)).collect()}
    assert got == audit_by_hand(rows, good, toxic) and len(got) == 4 * 600


def test_audit_of_nothing(spark, edge_docs, no_docs):
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.masked(no_docs, marks)).count() == 0
    rows = filter_audit.audit(filter_audit.masked(edge_docs, marks)).collect()
    assert len(rows) == 600 * edge_docs.select(F.coalesce("source", F.lit(""))).distinct().count() and all(r["good_lost"] == r["toxic_lost"] == 0 for r in rows)


def test_zeta_sums_over_subsets():
    counts = np.arange(64).reshape(2, 32)
    want = [[sum(int(row[s]) for s in range(32) if s & m == s) for m in range(32)] for row in counts]
    assert filter_audit.zeta(counts).tolist() == want


# --- min-max deduplication ------------------------------------------------------------------------


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()


def components_by_hand(rows):
    sets = [shingle_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
            up[root(i)] = root(j)
    least = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        least[root(i)].append(key)
    out = []
    for i, (key, _) in enumerate(rows):
        c = min((k for k in least[root(i)] if k is not None), default=None)
        out.append((key, len(sets[i]), c, key == c))
    return sorted(out, key=repr)


def chained(n, seed=4, size=120, step=2):
    """Texts of which each is near the next, the first and the last far apart."""
    rng = random.Random(seed)
    base = [f"v{rng.randrange(10**6)}" for _ in range(size)]
    out = []
    for k in range(n):
        out.append(" ".join(base))
        for _ in range(step):
            base[rng.randrange(size)] = f"n{k}{rng.randrange(10**6)}"
    return out


def as_rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


@pytest.mark.parametrize("limits", [{}, {"bucket": 8, "block": 8}])
def test_components_of_chains_groups_and_edges(spark, limits):
    """Groups beyond a block too, whose hubs do not reach everything."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(200)]
    near = [" ".join([*base[:k], f"c{k}", *base[k + 1 :]]) for k in rng.sample(range(200), 60)]
    texts = [*chained(40), *near, near[0].upper(), near[0], "One two", "one TWO", "one two three", None, "", " \n ", "É é", "é é", *[f"alone{i} x{i} y{i} z{i}" for i in range(30)]]
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)] + [(None, near[3]), (None, "nobody else says this"), (3, near[5]), (3, near[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1)).withColumn("group", F.lit("x"))
    assert as_rows(minmax_dedup.near_duplicates(docs, **limits)) == components_by_hand(rows)


def test_no_link_of_a_loose_group_is_lost(spark, monkeypatch):
    """All nodes in one bucket: many small classes of it, far beyond a block, are each found."""
    rng = random.Random(6)
    texts = []
    for _ in range(25):
        own = [f"w{rng.randrange(10**9)}" for _ in range(60)]
        texts += [" ".join([*own, f"e{rng.randrange(10**9)}"]) for _ in range(4)]
    rows = list(enumerate(texts))
    monkeypatch.setattr(minmax_dedup, "SLACK", 2.0)  # every pair of a bucket is near
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = lambda nodes, work: nodes.select(F.lit(0).cast("long").alias("group"), "node", F.lit(1).cast("long").alias("size"))
    monkeypatch.setattr(minmax_dedup, "buckets", one)
    monkeypatch.setattr(minmax_dedup, "HUBS", 2)
    assert as_rows(minmax_dedup.near_duplicates(docs, bucket=16, block=16)) == components_by_hand(rows)


def test_dedup_edges(spark, edge_docs, no_docs):
    assert minmax_dedup.near_duplicates(no_docs).count() == 0
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    assert as_rows(minmax_dedup.near_duplicates(edge_docs)) == components_by_hand(rows)


def test_signatures_agree_as_their_sets_do():
    rng, numbers, words_ = random.Random(1), minmax_dedup.minmax_numbers(), Words()
    for share in (0.5, 0.85, 0.95):
        agree = []
        for k in range(20):
            base = [f"t{k}_{i}" for i in range(400)]
            other = [w if rng.random() < share ** (1 / 3) else w + "x" for w in base]
            a, b = (shingles(" ".join(x), words_, 3, lower=True) for x in (base, other))
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            sa, sb = minmax_dedup.signature(a, numbers), minmax_dedup.signature(b, numbers)
            assert len(sa) == 2 * minmax_dedup.HASHES
            agree.append(float((sa == sb).mean()) - true)
        assert abs(np.mean(agree)) < 0.02
    places = minmax_dedup.band_places()
    assert places.shape == (32, 8) and all(len({p % minmax_dedup.HASHES for p in row}) == 8 for row in places.tolist())


# --- collocations -------------------------------------------------------------------------------


def phrases_by_hand(rows, least, top):
    counts, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows_ = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) and 100 * b >= 80 * a for q, b in candidates.items()):
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            rows_.append((-score, -a, " ".join(p).encode(), a, f[p[:k]], f[p[k:]], score))
        for rank, (_, _, phrase, a, left, right, score) in enumerate(sorted(rows_)[:top], 1):
            out.append((lang, rank, phrase.decode(), a, left, right, n[lang], score))
    return sorted(out)


def mined(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


@pytest.mark.parametrize("size", [300, 400_000])
def test_phrases_against_counting_them(spark, monkeypatch, size):
    """Small portions too, so that phrases meet across them; wide characters, tabs, repeated separators."""
    rng = random.Random(9)
    vocabulary = ["New", "york", "city", "São", "Paulo", "the", "of", "日本", "a\x00b", "x-y"]
    rows = []
    for _ in range(120):
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "?!"]) for _ in range(rng.randrange(40)))
        rows.append((text, rng.choice(["en", "en", "pt", None, "und"])))
    rows += [(None, "en"), ("", None), ("new york city hall " * 3000, "en"), ("lonely", "fr"), rows[0], rows[0]]
    docs = spark.createDataFrame(rows, "text string, lang string").withColumn("phrase", F.lit(1)).withColumn("k", F.lit(2))
    monkeypatch.setattr(collocations, "BYTES", size)
    assert mined(collocations.collocations(docs, least=5, top=40)) == phrases_by_hand(rows, 5, 40)


def test_a_full_bitmap_loses_nothing(spark, monkeypatch):
    """Where every bit is set, all grams are counted and the same are kept."""
    rows = [("one two three four five. " * 7 + "two three " * k, "en") for k in range(9)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    monkeypatch.setattr(collocations, "bitmap_of", lambda level, k: b"\xff" * (collocations.BITS // 8))
    assert mined(collocations.collocations(docs)) == phrases_by_hand(rows, 30, 2000)


def test_grams_whose_hashes_meet_are_told_apart(monkeypatch):
    powers = collocations.two_powers()
    w = collocations.words_of(b"aa bb aa cc aa bb", "en", powers)
    w.hashes[:] = 7
    phrases, n = collocations.tallied(w, np.arange(5), 2)
    total = Counter()
    for p, k in zip(phrases.to_pylist(), n.tolist(), strict=True):
        total[p] += k
    assert total == {b"aa bb": 2, b"bb aa": 1, b"aa cc": 1, b"cc aa": 1}


def test_collocation_edges(spark, edge_docs, no_docs):
    assert collocations.collocations(no_docs).count() == 0
    rows = [(r["text"], r["lang"]) for r in edge_docs.collect()]
    assert mined(collocations.collocations(edge_docs)) == phrases_by_hand(rows, 30, 2000)
