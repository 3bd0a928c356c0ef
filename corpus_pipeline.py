"""Corpus pipeline: toxic documents go, one of each group of near-duplicates stays, sources are mixed
to their target weights, and the mix is encoded.

Each stage takes (spark, docs, sf_dir), works on all rows it is given and returns a DataFrame; all
but the last return the columns of `documents`. SQL cannot express the learned score, so the
stages are tested against brute force instead (ORACLE_SQL is None).

An empty table passes all stages as an empty table. Columns beside doc_id, text, source and n_chars
are carried along whatever their names, but for mix_shard and mix_file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivener.llm.common import drop_stored, spread, stored, table
from scrivener.llm.jaccard_join import deduplicate
from scrivener.llm.mixing import mix
from scrivener.llm.queries import piece_model
from scrivener.llm.sentencepiece_table import encode_decode
from scrivener.llm.toxicity import clean, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores below 0.5; a null text scores as an empty one,
    which is the bias alone, and each of repeated rows is judged alike."""
    return clean(spread(docs), train(docs, table(spark, sf_dir, "labels")))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each near-duplicate group; texts without words are no copies of
    one another and stay, repeats of a row go."""
    return deduplicate(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each draw of a document, gathered by shard and shuffled in its files; a text that a
    pass cuts has its own length. Null or wordless texts are never drawn."""
    drawn = mix(docs).select(*docs.columns)
    return drawn.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256) of every row of the mix, repeats too; a null text has no
    ids and decodes to the empty text."""
    encoded = encode_decode(docs, piece_model())
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", toxicity), ("ngram_jaccard", ngram_jaccard), ("mixing", mixing), ("sentencepiece", sentencepiece)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each stage's rows written to the shared folder for the next."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            drop_stored(spark, before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
