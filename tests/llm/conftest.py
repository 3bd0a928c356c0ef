from __future__ import annotations

import pytest

#: Texts of the edges: null, empty, blank, one word, controls, wide characters, very long.
EDGES = [None, "", "   \n\t ", "word", "a", "a▁b </s> <s> ▁ ", "x\x00y\x0b z", "日本語 😀 ñandú", "ab" * 40_000, "lorem ipsum dolor " * 6_000]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, shard string, sketch binary, node string"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Edge texts, a repeated row, ties of text, null columns, and extra columns with clashing names."""
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 == 0 else f"s{i % 3}", len(t or ""), 7, "own", b"x", "n") for i, t in enumerate(EDGES)]
    rows += [rows[3], (50, "word", None, "s1", 4, 7, "own", None, None), (-3, "one two three four five six seven", "en", "s2", 33, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
