"""Curation of text pairs (`input`, `output`) for training.

Null inputs and outputs count as failing every test that needs them; repeated rows stay repeated;
random choices are hashes of keys and a seed, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivener.functions import markdown as M
from scrivener.functions.text import let, trimmed, word_count

#: Fillers that a cleaned input must not hold.
LEFT_FILLERS = r"(?i)\b(um|uh|like you know|i mean,|basically,)\b"
INSTRUCTION = "Clean up the dictated text and output nothing else."


def adjacent_pairs(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, input, output): user turns with the assistant turn that follows."""
    user = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("input"))
    reply = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output"))
    return user.join(reply, ["conv_id", "turn"])


def is_passthrough() -> Column:
    return trimmed(F.col("input")) == trimmed(F.col("output"))


def has_output() -> Column:
    return trimmed(F.col("output")) != ""


def is_expanded() -> Column:
    """Output over half as long again as an input of more than 20 code points."""
    return (F.length("output") > F.length("input") * 1.5) & (F.length("input") > 20)


def output_cleaned(df: DataFrame) -> DataFrame:
    """Markdown out of `output`, a projection a step."""
    for step in (M.without_bold, M.without_headers, M.bullets_flattened, M.without_first_bullet):
        df = df.withColumn("output", step(F.col("output")))
    return df


def lists_flattened(df: DataFrame) -> DataFrame:
    """Forced lists become sentences; `flattened` marks those that changed."""
    def flat(o: Column) -> Column:
        return let(F.when(M.is_forced_list(F.col("input"), o), M.numbered_flattened(o)).otherwise(o), lambda f: F.struct(f.alias("output"), (f != o).alias("flattened")))

    made = df.withColumn("flat_", let(F.col("output"), flat))
    return made.withColumns({"output": F.col("flat_.output"), "flattened": F.col("flat_.flattened")}).drop("flat_")


def is_valid() -> Column:
    """A pair fit for training: both sides there, 5 to 200 words, no filler left, no output over 2.5
    times as long, no bracketed placeholder."""
    given, made = trimmed(F.col("input")), trimmed(F.col("output"))
    ok = (given != "") & (made != "") & word_count(given).between(5, 200) & ~F.rlike(given, F.lit(LEFT_FILLERS)) & (F.length(made) <= F.length(given) * 2.5) & ~F.rlike(made, F.lit(r"(?d)\[.*?\]"))
    return F.coalesce(ok, F.lit(False))


def split_counts(df: DataFrame, ok: Column) -> DataFrame:
    """(valid, rejected)."""
    return df.agg(F.count_if(ok).alias("valid"), F.count_if(~ok).alias("rejected"))


def counters(df: DataFrame) -> DataFrame:
    """(pairs, bold, bullets, passthroughs)."""
    return df.agg(F.count("*").alias("pairs"), F.count_if(M.has_bold(F.col("output"))).alias("bold"), F.count_if(M.has_bullets(F.col("output"))).alias("bullets"), F.count_if(is_passthrough()).alias("passthroughs"))


def quota(df: DataFrame, share: float = 0.15) -> DataFrame:
    """(wanted): passthroughs missing to `share` of the pairs."""
    return df.agg(F.greatest(F.lit(0), F.floor(F.count("*") * share) - F.count_if(is_passthrough())).cast("long").alias("wanted"))


#: Rows that one task makes at a time.
BLOCK_ROWS = 65_536


def passthroughs(sentences: DataFrame, wanted: DataFrame, seed: int = 42) -> DataFrame:
    """`wanted` unchanged pairs: the `sentences` (ord, text) in order, then pseudo-random repeats."""
    n = F.broadcast(sentences.agg(F.count("*").alias("n_")))
    # numbered in blocks that are dealt out, so that no task holds all
    blocks = wanted.filter("wanted > 0").select("wanted", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("wanted") - 1) / BLOCK_ROWS))).alias("block_")).repartition("block_")
    last = F.least(F.col("wanted"), (F.col("block_") + 1) * BLOCK_ROWS) - 1
    rows = blocks.select(F.explode(F.sequence(F.col("block_") * BLOCK_ROWS, last)).alias("k")).crossJoin(n)
    rows = rows.withColumn("ord", F.when(F.col("k") < F.col("n_"), F.col("k")).otherwise(F.pmod(F.xxhash64("k", F.lit(seed)), F.col("n_"))))
    return rows.join(sentences, "ord").select("k", F.col("text").alias("input"), F.col("text").alias("output"))


def shuffled(df: DataFrame, *keys: str, seed: int = 42) -> DataFrame:
    return df.orderBy(F.xxhash64(*keys, F.lit(seed)), *keys)


def curated(pairs: DataFrame, sentences: DataFrame, seed: int = 42) -> DataFrame:
    """The whole clean-up: markdown out, lists flattened, empty and expanded outputs dropped,
    passthroughs added to their share, shuffled by hash."""
    kept = lists_flattened(output_cleaned(pairs)).filter(has_output() & ~is_expanded()).select("input", "output")
    added = passthroughs(sentences, quota(kept), seed).select("input", "output")
    return shuffled(kept.unionByName(added), "input", "output", seed=seed)


def chat_records(df: DataFrame, instruction: str = INSTRUCTION) -> DataFrame:
    """(messages): system, user and assistant messages of every pair."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return df.select(F.array(message("system", F.lit(instruction)), message("user", F.col("input")), message("assistant", F.col("output"))).alias("messages"))


def pairs_of_answer(text: Column) -> Column:
    """array<struct<input,output>> between an answer's first `[` and last `]`; null without one."""
    return F.from_json(F.regexp_extract(text, r"(?s)(\[.*\])", 1), "array<struct<input:string,output:string>>")


def prompt_filled(template: str, **parts: Column) -> Column:
    """`template` with its {names} replaced, in order of the names given."""
    out = F.lit(template)
    for name, value in parts.items():
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return out


def shares(categories: DataFrame) -> DataFrame:
    """Categories with their share of all weights, in percent."""
    total = F.broadcast(categories.agg(F.sum("weight").alias("total_")))
    return categories.crossJoin(total).withColumn("share", F.col("weight") / F.col("total_") * 100).drop("total_")


def cumulative(categories: DataFrame) -> DataFrame:
    """Categories with the half-open range (`above`, `upto`] of their weight (a few rows)."""
    w = Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return categories.withColumn("upto", F.sum("weight").over(w)).withColumn("above", F.col("upto") - F.col("weight"))


def weighted_choice(draws: DataFrame, categories: DataFrame, u: Column) -> DataFrame:
    """`draws` with the category (`name`) that a uniform number `u` in [0, 1) falls on."""
    bounds = cumulative(categories)
    ranges = F.broadcast(bounds.agg(F.sum("weight").alias("total_"), F.sort_array(F.collect_list(F.struct("ord", "upto", "name"))).alias("bounds_")))
    r = draws.crossJoin(ranges).withColumn("r_", u * F.col("total_"))
    hit = F.filter("bounds_", lambda b: F.col("r_") <= b["upto"])
    return r.withColumn("name", F.coalesce(F.get(hit, F.lit(0))["name"], F.element_at("bounds_", -1)["name"])).drop("total_", "bounds_", "r_")


def hashed_uniform(*keys: str, seed: int = 42) -> Column:
    """A number in [0, 1) from keys and a seed."""
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)


def throughput(done: Column, seconds: Column, total: Column) -> tuple[Column, Column]:
    """(items a second, seconds left); 0 where there is no base."""
    rate = F.when(seconds > 0, done / seconds).otherwise(F.lit(0.0))
    return rate, F.when(rate > 0, (total - done) / rate).otherwise(F.lit(0.0))
