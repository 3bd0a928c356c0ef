"""Every registered query of the engine against its SQL, on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as entry
from scrivener.plans import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Queries whose SQL holds only where the tables have what they look for.
MAY_BE_EMPTY = {"f3_clear"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, list | tuple):
        return tuple(plain(v) for v in x)
    if isinstance(x, dict):
        return tuple(plain(v) for v in x.values())
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 7)
    return x if x is None or isinstance(x, int | bool) else str(x)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert rows or name in MAY_BE_EMPTY
    if name in ORACLES:
        found = duck.execute(ORACLES[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        expected = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
        assert rows == expected


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["j3_kept_merges", "c7_pruned_vocabulary", "j4_kept_tokens", "s26_vocab_sizes"])
def test_pruning_of_odd_texts(spark, tmp_path, name):
    """Texts that hold tokens of the vocabulary's own, one word, none or the same ones: as the SQL says, with its repeats."""
    texts = [("a unused_3 b", 3), ("a unused_3 b", 303), ("a x", 3), ("unused_7", 7), ("The", 4), ("", 5), (None, 6), (" \n", 8), ("x x x x", 9), ("b a", None), ("never seen é", -3), ("b a\tb a", 12)]
    rows = spark.createDataFrame([(i, t) for t, i in texts], "doc_id long, text string")
    rows.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    df = QUERIES[name](spark, str(tmp_path))
    found = sorted(map(plain, con.execute(f"select {', '.join(df.columns)} from ({ORACLES[name]})").fetchall()), key=repr)
    assert sorted((plain(tuple(r)) for r in df.collect()), key=repr) == found


@pytest.mark.parametrize("name", ["j3_kept_merges", "c7_pruned_vocabulary"])
def test_merges_are_not_shuffled_for_their_parts(spark, sf_dir, name):
    """The pairs are deduplicated once; what the vocabulary lacks goes to them."""
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    shuffled = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert "LeftAnti, BuildRight" in plan and "SortMergeJoin" not in plan and not any(c in line for line in shuffled for c in ("merge#", "a_#", "b_#"))


def test_mapping_file_of_odd_texts(spark, tmp_path):
    """Old ids are strings in the file, new ones are dense, whatever the texts hold."""
    texts = ['a "b" \\ é', "unused_3 a", "", None, "x\ta"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    df = QUERIES["io16_token_mapping_file"](spark, str(tmp_path))
    assert dict(df.dtypes) == {"old_id": "string", "new_id": "int"}
    found = con.execute(f"select old_id, new_id from ({ORACLES['io16_token_mapping_file']})").fetchall()
    assert sorted(map(tuple, df.select("old_id", "new_id").collect())) == sorted(found) and len(found) == 6
