"""Dictation history: one row an entry with `ord` (stored order), `text`, `ts`, `timestamp` (its
RFC 3339 text), `word_count`, `duration_ms`, `speech_duration_ms`, `was_cleaned_up`.

Operators take and return DataFrames; "now" is an argument (`as_of`). Aggregates over an empty
history give zeros (nulls where the ratio has no base); null timestamps belong to no day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrivener.functions.clock import half_up, seconds_between

from .ordering import numbered

DAY = F.to_date


def zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0)).cast("long")


def from_events(events: DataFrame) -> DataFrame:
    """The driver's `events` read as a history."""
    speech = F.floor("value").cast("long") * 1000
    return events.select(
        F.col("event_id").alias("ord"),
        F.col("event_type").alias("text"),
        "ts",
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00")).alias("timestamp"),
        F.get_json_object("props", "$.k").cast("long").alias("word_count"),
        (speech + 500).alias("duration_ms"),
        speech.alias("speech_duration_ms"),
        (F.col("event_type") == "purchase").alias("was_cleaned_up"),
        "user_id",
    )


def retained(history: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Entries of the last `days` days; all if `days` is not positive."""
    return history if days <= 0 else history.filter(F.col("ts") >= as_of - F.make_dt_interval(F.lit(days)))


def retained_by_text(history: DataFrame, cutoff: str) -> DataFrame:
    """As `retained`, by comparing timestamps as text."""
    return history.filter(F.col("timestamp") >= cutoff)


def without_timestamp(history: DataFrame, timestamp: str) -> DataFrame:
    """All entries but those with this timestamp."""
    return history.filter(~F.col("timestamp").eqNullSafe(timestamp))


def cleared(history: DataFrame) -> DataFrame:
    return history.limit(0)


def searched(history: DataFrame, sought: str) -> DataFrame:
    """Entries whose text holds `sought`, in any case, taken literally; all if it is blank."""
    return history.filter(F.contains(F.lower("text"), F.lower(F.lit(sought)))) if sought.strip() else history


#: Code points of what the index knows, rows of a block of an indexed history, and blocks that a search
#: names one by one; where more may hold what is sought, their numbers are joined.
GRAM, BLOCK_ROWS, NAMED = 3, 10_000, 5_000


def _grams(text: Column) -> Column:
    """Distinct runs of `GRAM` code points of the lower-cased text."""
    low, n = F.lower(text), F.length(F.lower(text))
    runs = F.transform(F.sequence(F.lit(1), n - GRAM + 1), lambda i: F.substring(low, i, F.lit(GRAM)))
    return F.when(n >= GRAM, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def write_indexed(history: DataFrame, path: str, order: str = "ord", block_rows: int = BLOCK_ROWS) -> None:
    """`history` in folders of some `block_rows` neighbours in `order`, and beside them which three-letter
    runs each block holds: an index of a bounded size a block, however long the history. Rows without a text
    are in no index, as no search finds them; `block` and columns of that name give way."""
    block = F.floor(F.col("at_") / block_rows).cast("int")
    rows = numbered(history, order, name="at_").withColumn("block", block).drop("at_")
    # rows of a block lie together already, as they were numbered in ranges; few tasks share one
    rows.write.mode("overwrite").partitionBy("block").parquet(f"{path}/rows")
    rows.limit(0).write.mode("overwrite").parquet(f"{path}/shape")
    kept = indexed(history.sparkSession, path).select("block", F.explode(_grams(F.col("text"))).alias("gram"))
    kept.distinct().repartitionByRange("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{path}/grams")


def indexed(spark: SparkSession, path: str) -> DataFrame:
    """The rows that `write_indexed` wrote, with their block; none of an empty history."""
    return spark.read.schema(spark.read.parquet(f"{path}/shape").schema).parquet(f"{path}/rows")


def blocks_with(spark: SparkSession, path: str, sought: str) -> DataFrame | None:
    """(block): those that hold every run of `sought`, among them all that hold it; None if it is too short to tell."""
    one = spark.range(1).select(F.explode(_grams(F.lit(sought))).alias("wanted"))
    wanted = [r[0] for r in one.collect()]
    if not wanted:
        return None
    found = spark.read.parquet(f"{path}/grams").filter(F.col("gram").isin(wanted))
    return found.groupBy("block").agg(F.count("*").alias("n")).filter(F.col("n") == len(wanted)).select("block")


def searched_indexed(spark: SparkSession, path: str, sought: str) -> DataFrame:
    """As `searched`, over what `write_indexed` wrote: only blocks that may hold `sought` are read."""
    rows = indexed(spark, path)
    blocks = blocks_with(spark, path, sought) if sought.strip() else None
    if blocks is not None:
        few = [r[0] for r in blocks.limit(NAMED + 1).collect()]
        rows = rows.filter(F.col("block").isin(few)) if len(few) <= NAMED else rows.join(blocks, "block", "left_semi")
    return searched(rows, sought).drop("block")


def on_day(history: DataFrame, day: Column) -> DataFrame:
    return history.filter(DAY("ts") == day)


def with_speech(history: DataFrame) -> DataFrame:
    return history.filter(F.col("speech_duration_ms") > 0)


def newest(history: DataFrame, n: int = 1000) -> DataFrame:
    """The last `n` entries in stored order."""
    return history.orderBy(F.desc("ord")).limit(n)


def appended(history: DataFrame, entry: DataFrame) -> DataFrame:
    """History with one more entry at its end: numbered after the last one."""
    last = history.agg(F.coalesce(F.max("ord") + 1, F.lit(0)).alias("next_"))
    new = entry.crossJoin(F.broadcast(last)).withColumn("ord", F.col("next_")).drop("next_")
    return history.unionByName(new, allowMissingColumns=True)


def deduplicated(history: DataFrame, key: str | Column = "timestamp") -> DataFrame:
    """One entry a key: the newest, of equals the first stored."""
    # an aggregate, so that the entries of a hot key are reduced before they are shuffled
    best = F.max_by(F.struct(*history.columns), F.struct("ts", -F.col("ord"))).alias("row_")
    return history.groupBy((F.col(key) if isinstance(key, str) else key).alias("key_")).agg(best).select("row_.*")


def newest_first(history: DataFrame) -> DataFrame:
    return history.orderBy(F.desc("ts"), "ord")


def totals(history: DataFrame, today: Column) -> DataFrame:
    """total_words, today_words, today_sessions."""
    now = DAY("ts") == today
    return history.agg(zero(F.sum("word_count")).alias("total_words"), zero(F.sum(F.when(now, F.col("word_count")))).alias("today_words"), F.count(F.when(now, 1)).alias("today_sessions"))


def wpm(words: Column, speech_ms: Column) -> Column:
    """Words a minute of an entry; null without speech."""
    return F.when(speech_ms > 0, words / (speech_ms / 60000))


def average_wpm(history: DataFrame) -> DataFrame:
    """Rounded mean of the entries' own rates; 0 if none has speech."""
    rate = F.avg(wpm(F.col("word_count"), F.col("speech_duration_ms")))
    return history.agg(zero(half_up(rate)).alias("avg_wpm"), F.count(F.when(F.col("speech_duration_ms") > 0, 1)).alias("n"))


def daily(history: DataFrame) -> DataFrame:
    """(day, words, sessions)."""
    return history.filter("ts is not null").groupBy(DAY("ts").alias("day")).agg(F.sum("word_count").alias("words"), F.count("*").alias("sessions"))


def week(history: DataFrame, today: Column) -> DataFrame:
    """(day, words) of the seven days to `today`, days without entries at 0."""
    spark = history.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(F.date_sub(today, 6), today)).alias("day"))
    recent = history.filter(DAY("ts").between(F.date_sub(today, 6), today))
    return days.join(daily(recent).select("day", "words"), "day", "left").select("day", zero(F.col("words")).alias("words"))


def bars(week_: DataFrame, height: float = 40, least: float = 4) -> DataFrame:
    """`week` with each day's bar height against the highest (seven rows)."""
    top = F.greatest(F.max("words").over(Window.partitionBy()), F.lit(1))
    return week_.withColumn("height", F.greatest(F.lit(float(least)), F.col("words") / top * height))


def against_day_before(week_: DataFrame) -> DataFrame:
    """`week` with the words of the day before and the change in percent, null from 0."""
    before = F.lag("words").over(Window.orderBy("day"))
    change = F.when(before != 0, half_up((F.col("words") - before) / before * 100))
    return week_.select("day", "words", before.alias("before"), change.alias("change_pct"))


def against_yesterday(history: DataFrame, today: Column) -> DataFrame:
    """change_pct of today's words against yesterday's; null if there were none."""
    a = zero(F.sum(F.when(DAY("ts") == today, F.col("word_count"))))
    b = zero(F.sum(F.when(DAY("ts") == F.date_sub(today, 1), F.col("word_count"))))
    return history.agg(a.alias("today"), b.alias("yesterday")).select("today", "yesterday", F.when(F.col("yesterday") != 0, half_up((F.col("today") - F.col("yesterday")) / F.col("yesterday") * 100)).alias("change_pct"))


def time_saved(words: Column, typed: int = 40, spoken: int = 150) -> Column:
    """"N min", or "x.y hrs" from an hour on."""
    minutes = words / typed - words / spoken
    return F.when(minutes < 60, F.concat(half_up(minutes).cast("string"), F.lit(" min"))).otherwise(F.format_string("%.1f hrs", F.round(minutes / 60, 1)))


def usage(history: DataFrame, as_of: Column) -> DataFrame:
    """(entries, age_days): number of entries, whole days since the first stored one's timestamp."""
    out = history.agg(F.count("*").alias("entries"), F.min_by("ts", "ord").alias("first_"))
    return out.select("entries", F.floor(seconds_between(as_of, F.col("first_")) / 86400).cast("long").alias("age_days"))


def monthly_minutes(history: DataFrame) -> DataFrame:
    """(user_id, month, minutes)."""
    return history.groupBy("user_id", F.to_date(F.date_trunc("month", "ts")).alias("month")).agg((F.sum("speech_duration_ms") / 60000).alias("minutes"))


def export_line(history: DataFrame) -> DataFrame:
    """(ord, line): an entry's text of the export."""
    when = F.date_format("ts", "M/d/yyyy, h:mm:ss a")
    return history.select("ord", F.concat(F.lit("["), when, F.lit("] ("), F.col("word_count").cast("string"), F.lit(" words)\n"), F.col("text"), F.lit("\n")).alias("line"))
