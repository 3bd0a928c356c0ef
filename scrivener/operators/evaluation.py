"""Scores of model outputs: rows (model, mode, id, raw_input, output, expected, time_ms)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivener.functions.text import trimmed, words

#: Words that say nothing about content.
EMPTY_WORDS = ["like", "basically", "just", "really", "actually", "know", "mean", "that", "this", "what", "trying"]
CLEAN_ID = 10


def content_words(text: Column) -> Column:
    """Distinct lower-cased words of more than three letters, less those that say nothing."""
    long = F.transform(F.filter(words(text), lambda w: F.length(w) > 3), F.lower)
    return F.array_except(F.array_distinct(long), F.array(*[F.lit(w) for w in EMPTY_WORDS]))


def match_flag(output: Column, expected: Column) -> Column:
    return F.when(trimmed(output) == trimmed(expected), "MATCH").otherwise("DIFF")


def scored(results: DataFrame) -> DataFrame:
    """`results` with exact, preservation, passthrough and len_ratio, rounded half to even."""
    rows = results.withColumns({"out_": trimmed(F.col("output")), "exp_": trimmed(F.col("expected")), "raw_": trimmed(F.col("raw_input")), "words_": content_words(F.col("raw_input"))})
    low = F.lower("out_")
    kept = F.size(F.filter("words_", lambda w: F.contains(low, w)))
    preserved = F.when(F.size("words_") == 0, F.lit(1.0)).otherwise(kept / F.size("words_"))
    ratio = F.when(F.col("exp_") == "", F.lit(1.0)).otherwise(F.length("out_") / F.length("exp_"))
    return rows.withColumns(
        {
            "exact": F.col("out_") == F.col("exp_"),
            "preservation": F.bround(preserved, 2),
            "passthrough": (F.col("out_") == F.col("raw_")) | (F.col("out_") == F.concat("raw_", F.lit("."))),
            "len_ratio": F.bround(ratio, 2),
        }
    ).drop("out_", "exp_", "raw_", "words_")


def timings(results: DataFrame) -> DataFrame:
    """(mode, avg_ms, min_ms, max_ms)."""
    return results.groupBy("mode").agg(F.avg("time_ms").alias("avg_ms"), F.min("time_ms").alias("min_ms"), F.max("time_ms").alias("max_ms"))


def by_transcript(results: DataFrame) -> DataFrame:
    """(id, modes): each transcript's results in order of mode and model."""
    entry = F.struct("mode", "model", match_flag(F.col("output"), F.col("expected")).alias("match"))
    return results.groupBy("id").agg(F.sort_array(F.collect_list(entry)).alias("modes"))


def summary(scores: DataFrame) -> DataFrame:
    """A row by model and mode: avg_time_ms, exact_matches, total, avg_preservation, passthrough (of
    the transcript that is clean already)."""
    clean = F.coalesce(F.bool_or((F.col("id") == CLEAN_ID) & (F.col("passthrough") | F.col("exact"))), F.lit(False))
    return scores.groupBy("model", "mode").agg(
        F.bround(F.avg("time_ms"), 0).cast("long").alias("avg_time_ms"),
        F.count_if("exact").alias("exact_matches"),
        F.count("*").alias("total"),
        F.bround(F.avg("preservation"), 2).alias("avg_preservation"),
        clean.alias("passthrough"),
    )


def by_speed(summaries: DataFrame) -> DataFrame:
    return summaries.orderBy("avg_time_ms", F.desc("avg_preservation"), "model", "mode")


def best_quality(summaries: DataFrame) -> DataFrame:
    return summaries.orderBy(F.desc("avg_preservation"), F.desc("exact_matches"), "avg_time_ms", "model", "mode").limit(1)


def best_speed(summaries: DataFrame) -> DataFrame:
    return by_speed(summaries).limit(1)


def mode_effect(scores: DataFrame, a: str = "regex+AI", b: str = "AI-only") -> DataFrame:
    """(model, diff, winner): mean preservation of mode `a` less that of `b`, for models that have
    both; equal means `b`."""
    means = scores.groupBy("model").pivot("mode", [a, b]).agg(F.avg("preservation"))
    diff = F.col(f"`{a}`") - F.col(f"`{b}`")
    return means.filter(diff.isNotNull()).select("model", diff.alias("diff"), F.when(diff > 0, a).otherwise(b).alias("winner"))


def with_results(transcripts: DataFrame, results: DataFrame) -> DataFrame:
    """Transcripts with their results, those without any too."""
    return transcripts.join(results, "id", "left")


def percent(x: Column) -> Column:
    return F.format_string("%.0f%%", F.bround(x * 100, 0))


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, "[^a-zA-Z0-9._-]", "_")
