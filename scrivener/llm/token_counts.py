"""Token counts kept as additive rollups by source, language and tokenizer version.

A batch of changes is a table of signed counts: an insert adds a document's tokens, a delete
subtracts them, a revised count subtracts the old and adds the new. A batch is summed to its
deltas by key, which are written aside and then renamed to a folder named by the batch's id: the
rename makes them visible at once or not at all, and of two writers of one batch only one succeeds.
A batch that is there, or named in a compacted folder, is not applied again; what broke off before its rename
counts for nothing. Totals are the sum of all committed deltas, a few rows a batch; `compact` merges
them into one folder.

Null sources, languages and versions are keys of their own; null counts add nothing; keys whose
documents and tokens both come to 0 leave the totals; empty batches commit and change nothing;
extra columns are ignored; repeated rows count each.
"""

from __future__ import annotations

import hashlib
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, n_words
from .sentencepiece_table import WordTable

KEYS = ["source", "lang", "tokenizer"]
DELTAS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def signed(counts: DataFrame, sign: int) -> DataFrame:
    """Changes that insert (`sign` 1) or delete (-1) the documents of `counts` (keys, n_tokens)."""
    return counts.select(*KEYS, F.lit(sign).cast("long").alias("n_docs"), (F.coalesce("n_tokens", F.lit(0)) * sign).cast("long").alias("n_tokens"))


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes that replace the counts of `old` by those of `new`."""
    return signed(old, -1).unionByName(signed(new, 1))


class Rollup:
    """Totals under `path`, a folder every executor sees."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path, self._conf = hadoop.Path, spark._jsc.hadoopConfiguration()
        self._fs = hadoop.Path(path).getFileSystem(self._conf)
        self._files = hadoop.FileContext.getFileContext(self._fs.getUri(), self._conf)
        self._plain = spark._sc._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)

    @staticmethod
    def _name(batch: str) -> str:
        return f"batch-{hashlib.sha256(batch.encode()).hexdigest()[:32]}"

    def _put(self, staged: str, name: str) -> bool:
        """Rename a complete folder into place; False if another was there before it."""
        try:
            self._files.rename(self._files.makeQualified(self._path(staged)), self._files.makeQualified(self._path(self.path, name)), self._plain)
            return True
        except Py4JJavaError:
            there = self._fs.exists(self._path(self.path, name))
            self._fs.delete(self._path(staged), True)
            if not there:
                raise
            return False

    def _names(self) -> list[str]:
        here = self._path(self.path)
        return [s.getPath().getName() for s in self._fs.listStatus(here)] if self._fs.exists(here) else []

    def _base(self, names: list[str]) -> tuple[str | None, set[str]]:
        """The latest compacted folder and the batches in it."""
        number = max((int(n.removeprefix("base-")) for n in names if n.startswith("base-")), default=None)
        if number is None:
            return None, set()
        base = f"{self.path}/base-{number}"
        return base, {r[0] for r in self.spark.read.schema("name string").parquet(f"{base}/batches").collect()}

    def committed(self, batch: str) -> bool:
        names = self._names()
        return self._name(batch) in names or self._name(batch) in self._base(names)[1]

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch; False if it was applied before, or by another writer meanwhile."""
        if self.committed(batch):
            return False
        staged = f"{self.path}/_staged-{uuid.uuid4().hex}"
        changes.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).write.parquet(staged)
        return self._put(staged, self._name(batch))

    def _deltas(self) -> tuple[DataFrame, list[str], set[str]]:
        """All committed deltas, the batches that stand in folders of their own, and those compacted."""
        names = self._names()
        base, merged = self._base(names)
        own = [n for n in names if n.startswith("batch-") and n not in merged]
        paths = [f"{self.path}/{n}" for n in own] + ([f"{base}/deltas"] if base else [])
        return self.spark.read.schema(DELTAS).parquet(*paths) if paths else self.spark.createDataFrame([], DELTAS), own, merged

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) over all committed batches."""
        return self._summed(self._deltas()[0])

    @staticmethod
    def _summed(rows: DataFrame) -> DataFrame:
        out = rows.groupBy(*KEYS).agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"))
        return out.filter("n_docs <> 0 or n_tokens <> 0")

    def sweep(self, seconds: int = 86_400) -> int:
        """Delete what writers that died have left: folders not yet renamed into place that have not been
        touched for so long. How many there were."""
        old = [s.getPath() for s in self._fs.listStatus(self._path(self.path)) if s.getPath().getName().startswith("_staged-") and time.time() - s.getModificationTime() / 1000 > seconds] if self._fs.exists(self._path(self.path)) else []
        for path in old:
            self._fs.delete(path, True)
        return len(old)

    def compact(self) -> bool:
        """Merge all committed batches into one folder that also names them, then delete theirs; a
        batch stays applied once whenever this breaks off. False if there was nothing to merge or
        another compaction came first. Batches may be committed meanwhile, but a reader of
        `totals` made before must be done."""
        rows, own, merged = self._deltas()
        if not own:
            return False
        number = 1 + max((int(n.removeprefix("base-")) for n in self._names() if n.startswith("base-")), default=0)
        staged = f"{self.path}/_staged-{uuid.uuid4().hex}"
        try:
            self._summed(rows).write.parquet(f"{staged}/deltas")
        except Exception:
            self._fs.delete(self._path(staged), True)
            if f"base-{number}" in self._names():  # another has merged these batches and deleted their folders
                return False
            raise
        self.spark.createDataFrame([(n,) for n in sorted({*own, *merged})], "name string").write.parquet(f"{staged}/batches")
        if not self._put(staged, f"base-{number}"):
            return False
        for name in [*own, *(n for n in self._names() if n.startswith("base-") and int(n.removeprefix("base-")) < number)]:
            self._fs.delete(self._path(self.path, name), True)
        return True


def count_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, source, lang, words, pieces) of every row: counts of words and of SentencePiece ids."""

    def make():
        table = WordTable(model_path)

        def rows(keys, sources, langs, words, texts):
            for *key, ids in zip(keys, sources, langs, words, table.encode(texts), strict=True):
                yield *key, len(ids)

        return rows

    kind = docs.schema[id_col].dataType.simpleString()
    columns = docs.select(id_col, "source", "lang", n_words(F.col(text_col)).alias("words"), text_col)
    return map_rows(columns, make, f"`{id_col}` {kind}, source string, lang string, words long, pieces long")
