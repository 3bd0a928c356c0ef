"""Queries of the dictation history, over `events`."""

from __future__ import annotations

from pyspark.sql import functions as F

from scrivener.functions import clock
from scrivener.operators import history as H

from scrivener.sources.storage import place

from .registry import query, table

AS_OF = "2024-01-30 12:00:00"


def now():
    return clock.as_instant(AS_OF)


def today():
    return F.lit("2024-01-30").cast("date")


VIEW = """WITH h AS (SELECT event_id AS ord, event_type AS text, ts, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS "timestamp",
 CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT) AS word_count, CAST(floor(value) AS BIGINT) * 1000 + 500 AS duration_ms,
 CAST(floor(value) AS BIGINT) * 1000 AS speech_duration_ms, event_type = 'purchase' AS was_cleaned_up, user_id FROM events),
 d AS (SELECT CAST(ts AS DATE) AS day, CAST(sum(word_count) AS BIGINT) AS words, count(*) AS sessions FROM h GROUP BY 1),
 w AS (SELECT CAST(s.day AS DATE) AS day, coalesce(words, 0) AS words FROM (SELECT unnest(generate_series(DATE '2024-01-24', DATE '2024-01-30', INTERVAL 1 DAY)) AS day) s LEFT JOIN d ON d.day = CAST(s.day AS DATE)) """
ROUND = "CAST(floor({} + 0.5) AS BIGINT)"


def history(spark, sf_dir):
    return H.from_events(table(spark, sf_dir, "events"))


@query(VIEW + "SELECT ord, word_count FROM h WHERE ts >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 7 DAY")
def f1_retention(spark, sf_dir):
    return H.retained(history(spark, sf_dir), now(), 7).select("ord", "word_count")


@query(VIEW + "SELECT ord FROM h")
def f1_retention_keep_all(spark, sf_dir):
    return H.retained(history(spark, sf_dir), now(), 0).select("ord")


@query(VIEW + "SELECT ord FROM h WHERE \"timestamp\" >= '2024-01-23T12:00:00+00:00'")
def f1_retention_by_text(spark, sf_dir):
    return H.retained_by_text(history(spark, sf_dir), "2024-01-23T12:00:00+00:00").select("ord")


@query(VIEW + "SELECT ord FROM h WHERE \"timestamp\" <> '2024-01-01T00:03:52.824425+00:00'")
def f2_delete_entry(spark, sf_dir):
    return H.without_timestamp(history(spark, sf_dir), "2024-01-01T00:03:52.824425+00:00").select("ord")


@query(VIEW + "SELECT ord FROM h WHERE false")
def f3_clear(spark, sf_dir):
    return H.cleared(history(spark, sf_dir)).select("ord")


@query(VIEW + "SELECT ord, text FROM h WHERE contains(lower(text), lower('CHAS'))")
def f4_search(spark, sf_dir):
    return H.searched(history(spark, sf_dir), "CHAS").select("ord", "text")


@query(VIEW + "SELECT ord, text FROM h WHERE contains(lower(text), lower('CHAS'))")
def f4_indexed_search(spark, sf_dir):
    """The history in blocks with an index of what each holds."""
    path = place(spark, "indexed")
    H.write_indexed(history(spark, sf_dir).select("ord", "text"), path)
    return H.searched_indexed(spark, path, "CHAS").select("ord", "text")


@query(VIEW + "SELECT ord FROM h WHERE CAST(ts AS DATE) = DATE '2024-01-30'")
def f5_same_day(spark, sf_dir):
    return H.on_day(history(spark, sf_dir), today()).select("ord")


@query(VIEW + "SELECT ord, speech_duration_ms FROM h WHERE speech_duration_ms > 0")
def f6_with_speech(spark, sf_dir):
    return H.with_speech(history(spark, sf_dir)).select("ord", "speech_duration_ms")


@query(VIEW + "SELECT CAST(sum(word_count) AS BIGINT) AS total_words, CAST(sum(CASE WHEN CAST(ts AS DATE) = DATE '2024-01-30' THEN word_count END) AS BIGINT) AS today_words, count(CASE WHEN CAST(ts AS DATE) = DATE '2024-01-30' THEN 1 END) AS today_sessions FROM h")
def h1_totals(spark, sf_dir):
    return H.totals(history(spark, sf_dir), today())


@query(VIEW + "SELECT ord, text, word_count FROM h ORDER BY ord DESC LIMIT 1000")
def h2_newest_1000(spark, sf_dir):
    return H.newest(history(spark, sf_dir)).select("ord", "text", "word_count")


@query(VIEW + f"SELECT {ROUND.format('avg(word_count / (speech_duration_ms / 60000))')} AS avg_wpm, count(*) AS n FROM h WHERE speech_duration_ms > 0")
def h3_average_wpm(spark, sf_dir):
    return H.average_wpm(history(spark, sf_dir))


@query(VIEW + "SELECT ord, CASE WHEN speech_duration_ms > 0 THEN round(word_count / (speech_duration_ms / 60000), 4) END AS wpm FROM h")
def h4_entry_wpm(spark, sf_dir):
    return history(spark, sf_dir).select("ord", F.round(H.wpm(F.col("word_count"), F.col("speech_duration_ms")), 4).alias("wpm"))


@query(VIEW + "SELECT day, words FROM w")
def h5_week(spark, sf_dir):
    return H.week(history(spark, sf_dir), today())


@query(VIEW + "SELECT day, words FROM w")
def j7_week_spine(spark, sf_dir):
    return H.week(history(spark, sf_dir), today())


@query(VIEW + f", x AS (SELECT max(CASE WHEN day = DATE '2024-01-30' THEN words END) AS today, max(CASE WHEN day = DATE '2024-01-29' THEN words END) AS yesterday FROM w) SELECT today, yesterday, {ROUND.format('(today - yesterday) / yesterday * 100')} AS change_pct FROM x")
def h6_against_yesterday(spark, sf_dir):
    return H.against_yesterday(history(spark, sf_dir), today())


@query(VIEW + "SELECT 0::BIGINT AS today, 0::BIGINT AS yesterday, NULL::BIGINT AS change_pct")
def h6_no_yesterday(spark, sf_dir):
    return H.against_yesterday(history(spark, sf_dir), F.lit("2030-01-01").cast("date"))


@query(VIEW + ", m AS (SELECT user_id, sum(word_count) / 40 - sum(word_count) / 150 AS minutes FROM h GROUP BY 1) SELECT user_id, CASE WHEN minutes < 60 THEN CAST(floor(minutes + 0.5) AS BIGINT) || ' min' ELSE printf('%.1f', round(minutes / 60, 1)) || ' hrs' END AS saved FROM m")
def h7_time_saved(spark, sf_dir):
    words = history(spark, sf_dir).groupBy("user_id").agg(F.sum("word_count").alias("words"))
    return words.select("user_id", H.time_saved(F.col("words")).alias("saved"))


@query(VIEW + "SELECT day, words, sessions FROM d")
def h8_daily_totals(spark, sf_dir):
    return H.daily(history(spark, sf_dir))


@query(VIEW + "SELECT day, words, greatest(4.0::DOUBLE, words / greatest(max(words) OVER (), 1) * 40) AS height FROM w")
def h9_bars(spark, sf_dir):
    return H.bars(H.week(history(spark, sf_dir), today()))


@query(VIEW + "SELECT day, words, greatest(4.0::DOUBLE, words / greatest(max(words) OVER (), 1) * 40) AS height FROM w")
def w5_global_max(spark, sf_dir):
    return H.bars(H.week(history(spark, sf_dir), today()))


@query(VIEW + "SELECT count(*) AS entries, CAST(floor(epoch(TIMESTAMP '2024-01-30 12:00:00' - arg_min(ts, ord)) / 86400) AS BIGINT) AS age_days FROM h")
def h10_usage(spark, sf_dir):
    return H.usage(history(spark, sf_dir), now())


@query(VIEW + "SELECT user_id, CAST(date_trunc('month', ts) AS DATE) AS month, sum(speech_duration_ms) / 60000 AS minutes FROM h GROUP BY 1, 2")
def h16_monthly_minutes(spark, sf_dir):
    return H.monthly_minutes(history(spark, sf_dir))


HOURLY = VIEW + ", k AS (SELECT *, date_trunc('hour', ts) AS hour, row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY ts DESC, ord) AS rn FROM h) "


@query(HOURLY + "SELECT ord, hour FROM k WHERE rn = 1")
def d1_deduplicated(spark, sf_dir):
    h = history(spark, sf_dir).withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return H.deduplicated(h, "hour").select("ord", "hour")


@query(HOURLY + "SELECT ord, hour FROM k WHERE rn = 1")
def w1_first_per_key(spark, sf_dir):
    h = history(spark, sf_dir).withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return H.deduplicated(h, "hour").select("ord", "hour")


@query(VIEW + ", x AS (SELECT day, words, lag(words) OVER (ORDER BY day) AS \"before\" FROM w) SELECT day, words, \"before\", CASE WHEN \"before\" <> 0 THEN CAST(floor((words - \"before\") / \"before\" * 100 + 0.5) AS BIGINT) END AS change_pct FROM x")
def w6_against_day_before(spark, sf_dir):
    return H.against_day_before(H.week(history(spark, sf_dir), today()))


@query(VIEW + "SELECT ord, ts FROM h ORDER BY ts DESC, ord")
def o1_newest_first(spark, sf_dir):
    return H.newest_first(history(spark, sf_dir)).select("ord", "ts")


@query(VIEW + "SELECT ord, text, word_count FROM h UNION ALL SELECT max(ord) + 1, 'new entry', 2 FROM h")
def e6_append_entry(spark, sf_dir):
    entry = spark.range(1).select(F.lit("new entry").alias("text"), F.lit(2).cast("long").alias("word_count"))
    return H.appended(history(spark, sf_dir), entry).select("ord", "text", "word_count")


AGO = VIEW + ", s AS (SELECT ord, ts, CAST(floor(date_diff('microsecond', ts, TIMESTAMP '2024-01-30 12:00:00') / 1000000) AS BIGINT) AS s FROM h), t AS (SELECT *, CAST(floor(s / 60) AS BIGINT) AS mi, CAST(floor(s / 3600) AS BIGINT) AS ho, CAST(floor(s / 86400) AS BIGINT) AS da FROM s) "


@query(AGO + "SELECT ord, CASE WHEN s < 60 THEN 'just now' WHEN mi < 60 THEN mi || ' min ago' WHEN ho < 24 THEN ho || ' hour' || CASE WHEN ho > 1 THEN 's' ELSE '' END || ' ago' WHEN da < 7 THEN da || ' day' || CASE WHEN da > 1 THEN 's' ELSE '' END || ' ago' ELSE strftime(ts, '%b %-d') END AS ago FROM t")
def s10_relative_time(spark, sf_dir):
    return history(spark, sf_dir).select("ord", clock.relative_time(F.col("ts"), now()).alias("ago"))


@query(VIEW + "SELECT ord, CASE WHEN hour(ts) < 12 THEN 'Good morning' WHEN hour(ts) < 18 THEN 'Good afternoon' ELSE 'Good evening' END AS greeting FROM h")
def s11_greeting(spark, sf_dir):
    return history(spark, sf_dir).select("ord", clock.greeting(F.col("ts")).alias("greeting"))


@query(VIEW + "SELECT day, strftime(day, '%A, %B %-d') AS label FROM d")
def s12_long_date(spark, sf_dir):
    return H.daily(history(spark, sf_dir)).select("day", clock.long_date(F.col("day")).alias("label"))


@query(VIEW + "SELECT day, CASE WHEN day = DATE '2024-01-30' THEN 'Today — ' || strftime(day, '%B %-d') WHEN day = DATE '2024-01-29' THEN 'Yesterday — ' || strftime(day, '%B %-d') ELSE strftime(day, '%A, %B %-d') END AS label FROM d")
def f21_day_label(spark, sf_dir):
    return H.daily(history(spark, sf_dir)).select("day", clock.day_label(F.col("day"), today()).alias("label"))


@query(VIEW + "SELECT ord, printf('%.1fs', round(speech_duration_ms / 1000, 1)) AS seconds FROM h")
def s13_seconds(spark, sf_dir):
    return history(spark, sf_dir).select("ord", F.format_string("%.1fs", F.round(F.col("speech_duration_ms") / 1000, 1)).alias("seconds"))


@query(VIEW + "SELECT ord, try_cast(CASE WHEN ord % 5 = 0 THEN 'not a time' ELSE \"timestamp\" END AS TIMESTAMP) AS at FROM h")
def s27_safe_instant(spark, sf_dir):
    said = F.when(F.col("ord") % 5 == 0, "not a time").otherwise(F.col("timestamp"))
    # the text's own clock reading, so that the session's zone plays no part
    at = F.when(clock.safe_instant(said).isNotNull(), F.try_to_timestamp(F.substring(said, 1, 26), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).cast("timestamp_ntz"))
    return history(spark, sf_dir).select("ord", at.alias("at"))


@query(VIEW + "SELECT ord, '[' || strftime(ts, '%-m/%-d/%Y, %-I:%M:%S %p') || '] (' || word_count || ' words)' || chr(10) || text || chr(10) AS line FROM h")
def io11_text_export(spark, sf_dir):
    return H.export_line(history(spark, sf_dir))


@query(VIEW + "SELECT ord, CAST(floor(word_count * (1 - pow(1 - least(speech_duration_ms / 100000, 1), 3)) + 0.5) AS BIGINT) AS shown FROM h")
def s23_count_up(spark, sf_dir):
    shown = clock.eased(F.col("word_count"), F.col("speech_duration_ms") / 100_000)
    return history(spark, sf_dir).select("ord", shown.alias("shown"))
