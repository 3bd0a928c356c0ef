"""Streaming queries: each runs its stream over the event file until it is used up."""

from __future__ import annotations

from pyspark.sql import functions as F

from scrivener.sources.storage import place
from scrivener.streaming import dictation as D
from scrivener.streaming import frames as FR
from scrivener.streaming import limits as L
from scrivener.streaming import ordered as O
from scrivener.streaming import recorder as R

from .audio import BARS, of_embeddings, rounded
from .registry import query, table

NTZ = "timestamp_ntz"


def ran(spark, sf_dir, of, mode="append"):
    """What a stream over the events wrote, as a table."""
    path = place(spark, "stream")
    D.run_once(of(D.event_stream(spark, sf_dir)), D.appended_log(f"{path}/out"), f"{path}/state", mode)
    return spark.read.parquet(f"{path}/out").drop("batch")


@query("SELECT event_id, ts, event_type AS text, CAST(regexp_extract(props, '\"k\": ([0-9]+)', 1) AS BIGINT) AS word_count FROM events WHERE event_type <> 'error'")
def st5_event_log(spark, sf_dir):
    rows = ran(spark, sf_dir, lambda s: s.filter("event_type <> 'error'"))
    return rows.select("event_id", F.col("ts").cast(NTZ).alias("ts"), F.col("event_type").alias("text"), F.get_json_object("props", "$.k").cast("long").alias("word_count"))


def folded(spark, sf_dir, event, fold):
    """What a fold over the closed stream of events wrote, as a table."""
    path = place(spark, "fold")
    source = lambda: O.keyed(D.event_stream(spark, sf_dir), "user_id", event)
    O.run_to_end(source, f"{path}/close", D.appended_log(f"{path}/out"), f"{path}/state", lambda s: O.stream(s, fold))
    return spark.read.parquet(f"{path}/out").drop("batch")


def folded_table(spark, sf_dir, event, fold):
    return O.over_table(O.keyed(table(spark, sf_dir, "events"), "user_id", event), fold)


def named(**of):
    """The event that an event type stands for; null where it stands for none."""
    out = F.lit(None).cast("string")
    for kind, event in of.items():
        out = F.when(F.col("event_type") == kind, event).otherwise(out)
    return out


def instant(column):
    return F.timestamp_micros(column).cast(NTZ)


# a start points to the next one that is not within its recording; the pointers are followed from the first
RECORDINGS = """WITH RECURSIVE s AS (SELECT user_id, ts, event_type = 'click' AS starts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type IN ('click', 'view')),
 n AS (SELECT *, min(CASE WHEN NOT starts THEN k END) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS stop_k FROM s),
 x AS (SELECT n.user_id, n.k, n.ts, n.stop_k, CASE WHEN p.ts < n.ts + INTERVAL 10 MINUTE THEN p.ts ELSE n.ts + INTERVAL 10 MINUTE END AS "end", NOT coalesce(p.ts < n.ts + INTERVAL 10 MINUTE, false) AS timed_out
 FROM n LEFT JOIN s p ON p.user_id = n.user_id AND p.k = n.stop_k WHERE n.starts),
 t AS (SELECT x.*, (SELECT min(y.k) FROM s y WHERE y.user_id = x.user_id AND y.starts AND y.k > x.k AND CASE WHEN x.timed_out THEN y.ts >= x."end" ELSE y.k > x.stop_k END) AS next_k FROM x),
 r AS (SELECT user_id, min(k) AS k, 1 AS generation FROM t GROUP BY 1 UNION ALL SELECT r.user_id, t.next_k, generation + 1 FROM r JOIN t ON t.user_id = r.user_id AND t.k = r.k WHERE t.next_k IS NOT NULL)
 SELECT r.user_id, CAST(generation AS BIGINT) AS generation, ts AS start, "end", timed_out FROM r JOIN t ON t.user_id = r.user_id AND t.k = r.k"""


def recordings(rows):
    return rows.select("user_id", "generation", instant("start_us").alias("start"), instant("end_us").alias("end"), "timed_out")


@query(RECORDINGS)
def st4_recording_timeouts(spark, sf_dir):
    return recordings(folded(spark, sf_dir, named(click="start", view="stop"), R.Recordings()))


@query(RECORDINGS)
def st4_recording_timeouts_table(spark, sf_dir):
    return recordings(folded_table(spark, sf_dir, named(click="start", view="stop"), R.Recordings()))


LIMITED = "WITH l AS (SELECT user_id, list_reduce(list([epoch_us(ts)] ORDER BY ts, event_id), lambda a, x: CASE WHEN x[1] - a[len(a)] >= 300000000 THEN list_concat(a, x) ELSE a END) AS kept FROM events GROUP BY 1) SELECT user_id, event_id, ts FROM events JOIN l USING (user_id) WHERE list_contains(kept, epoch_us(ts))"


@query(LIMITED)
def st6_rate_limited(spark, sf_dir):
    rows = folded(spark, sf_dir, F.lit("sent"), R.Accepted())
    return rows.select("user_id", "event_id", instant("at_us").alias("ts"))


@query(LIMITED)
def st6_rate_limited_table(spark, sf_dir):
    return D.rate_limited_table(table(spark, sf_dir, "events"))


LIMITED_ALL = LIMITED.replace("SELECT user_id, list_reduce", "SELECT list_reduce").replace(" GROUP BY 1) SELECT", ") SELECT").replace("JOIN l USING (user_id) WHERE list_contains(kept, epoch_us(ts))", ", l WHERE list_contains(kept, epoch_us(ts))")


@query(LIMITED_ALL)
def st6_rate_limited_process(spark, sf_dir):
    """All events under one limit, as one process has it."""
    path = place(spark, "limit")
    write, end = L.limiting(path)
    D.run_once(D.event_stream(spark, sf_dir), write, f"{path}/checkpoint")
    end(spark, spark.read.parquet(f"{path}/out").agg(F.max("batch")).first()[0] + 1)
    return spark.read.parquet(f"{path}/out").select("user_id", "event_id", F.col("ts").cast(NTZ).alias("ts"))


@query(LIMITED_ALL)
def st6_rate_limited_process_table(spark, sf_dir):
    return L.limited(table(spark, sf_dir, "events"))


@query("SELECT event_id, ts FROM events")
def st7_without_repeats(spark, sf_dir):
    rows = ran(spark, sf_dir, lambda s: D.kept_within(s.unionByName(s)))
    return rows.select("event_id", F.col("ts").cast(NTZ).alias("ts"))


@query("SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def st7_time_to_live(spark, sf_dir):
    """Events of the last seven days before the newest: they are written under a retention of thirty
    days, then a later setting of seven comes in."""
    path = place(spark, "expiring")
    log = D.ExpiringLog(spark, f"{path}/log")
    setting = lambda at, days: spark.range(1).select(F.timestamp_seconds(F.lit(at)).alias("ts"), F.lit(days).alias("days"))
    log.set(setting(1, 30), 0)
    D.run_once(D.event_stream(spark, sf_dir), log.write, f"{path}/state")
    log.set(setting(2, 7), 1)
    return log.rows().select("event_id", F.col("ts").cast(NTZ).alias("ts"))


@query("SELECT CAST(ts AS DATE) AS day, CAST(sum(CAST(regexp_extract(props, '\"k\": ([0-9]+)', 1) AS BIGINT)) AS BIGINT) AS words, count(*) AS n FROM events GROUP BY 1")
def st5_daily_words(spark, sf_dir):
    path = place(spark, "daily")
    D.run_once(D.daily_words(D.event_stream(spark, sf_dir)), D.upserted(f"{path}/out"), f"{path}/state", "update")
    return D.latest(spark, f"{path}/out", "day").select(F.to_date("day").alias("day"), "words", "n")


STATE = "CASE WHEN s = 'Idle' AND e = 'start' THEN 'Recording' WHEN s = 'Recording' AND e = 'stop' THEN 'Processing' WHEN s = 'Processing' AND e = 'polish' THEN 'Polishing' WHEN s IN ('Processing', 'Polishing') AND e = 'done' THEN 'Idle' WHEN s <> 'Idle' AND e = 'error' THEN 'Idle' ELSE s END"


FINAL = f"WITH r AS (SELECT user_id, list(CASE event_type WHEN 'click' THEN 'start' WHEN 'view' THEN 'stop' WHEN 'signup' THEN 'polish' WHEN 'purchase' THEN 'done' ELSE 'error' END ORDER BY ts, event_id) AS es, count(*) AS n FROM events GROUP BY 1) SELECT user_id, list_reduce(list_prepend('Idle', es), lambda s, e: {STATE}) AS state, n FROM r"
RECORDER = dict(click="start", view="stop", signup="polish", purchase="done", error="error")


@query(FINAL)
def st8_recorder_states(spark, sf_dir):
    return D.recorder_states(table(spark, sf_dir, "events"), F.coalesce(named(**RECORDER), F.lit("error")))


@query(FINAL)
def st8_recorder_states_stream(spark, sf_dir):
    rows = folded(spark, sf_dir, F.coalesce(named(**RECORDER), F.lit("error")), R.States())
    last = rows.groupBy("user_id").agg(F.max(F.struct("n", "state")).alias("last"))
    return last.select("user_id", "last.state", "last.n")


#: Presses, releases and what the recorder reports, by event type.
HOLD = dict(click="press", view="release", signup="started", purchase="done", error="error")


@query()
def st9_recorder_changes(spark, sf_dir):
    rows = folded(spark, sf_dir, named(**HOLD), R.Recorder())
    return rows.select("user_id", "event_id", instant("at_us").alias("ts"), "state", "generation")


@query()
def st9_recorder_changes_table(spark, sf_dir):
    rows = folded_table(spark, sf_dir, named(**HOLD), R.Recorder())
    return rows.select("user_id", "event_id", instant("at_us").alias("ts"), "state", "generation")


@query("SELECT vec_id AS clip_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS samples FROM embeddings")
def st1_sample_buffer(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("clip_id"), F.col("embedding").cast("array<double>").alias("s"))
    frame = F.slice("s", F.col("frame") * 10 + 1, F.lit(10))
    frames = rows.select("clip_id", "s", F.explode(F.sequence(F.lit(0), F.ceil(F.size("s") / 10).cast("int") - 1)).alias("frame"))
    return D.buffered(frames.select("clip_id", "frame", frame.alias("samples")))


@query(BARS + "SELECT clip_id, list_transform(b, lambda x: round(x, 6)) AS bars FROM bars")
def st3_tail_stream(spark, sf_dir):
    """Clips as a stream of frames of 800 samples, of which each clip's buffer keeps the last half second;
    the bars are those after the last frame. A row of the file is a clip, also where ids repeat."""
    path = place(spark, "tail")
    rows = D.file_stream(spark, sf_dir, "embeddings.parquet", "vec_id bigint, embedding array<float>, label int")
    named = rows.select("vec_id", "embedding", F.concat_ws("#", "_metadata.file_path", F.col("_metadata.row_index").cast("string")).alias("clip"))
    # a file is often one task, and its clips are far larger than its rows
    frames = FR.numbered_frames(of_embeddings(named.repartition(spark.sparkContext.defaultParallelism), "clip"), 800)
    D.run_once(frames, FR.tails(f"{path}/out"), f"{path}/state")
    return FR.shown(spark, f"{path}/out").filter("last").select("clip_id", rounded(F.col("bars")).alias("bars"))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k % 3 = 0")
def st2_throttled(spark, sf_dir):
    """Frames of 100 samples: every third refreshes a 60 Hz display."""
    return folded_table(spark, sf_dir, F.lit("100"), R.Refreshes()).select("user_id", "event_id")
