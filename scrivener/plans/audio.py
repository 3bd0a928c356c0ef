"""Queries of audio windows, over samples taken from `embeddings`."""

from __future__ import annotations

from pyspark.sql import functions as F

from scrivener.operators import audio as A

from .registry import dealt, query, table

CLIPS = """WITH c AS (SELECT vec_id AS clip_id, flatten(list_transform(range(0, 1 + vec_id % 170), lambda k: list_transform(embedding, lambda x: CAST(x AS DOUBLE)))) AS s FROM embeddings),
 e AS (SELECT vec_id AS clip_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS s FROM embeddings) """
RMS = "sqrt(list_sum(list_transform({0}, lambda x: x * x)) / len({0}))"


def of_embeddings(rows, *others):
    """Clips of one to 170 times the length of an embedding, beside `others`."""
    return rows.select(*others, F.col("vec_id").alias("clip_id"), F.flatten(F.array_repeat(F.col("embedding").cast("array<double>"), (1 + F.col("vec_id") % 170).cast("int"))).alias("samples"))


def clips(spark, sf_dir):
    return of_embeddings(dealt(table(spark, sf_dir, "embeddings")))


def short(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("clip_id"), F.col("embedding").cast("array<double>").alias("samples"))


def places(x, n=6):
    """`x` to `n` places as SQL rounds it: scaled in doubles, halves away from zero, a negative zero stays one."""
    y = x * 10.0**n
    return F.rint(F.when(F.abs(y - F.rint(y)) == 0.5, y + F.signum(y) * 0.5).otherwise(y)) / 10.0**n


def rounded(values, n=6):
    return F.transform(values, lambda x: places(x, n))


@query(CLIPS + "SELECT clip_id, list_transform(s, lambda x: round(CAST(trunc(x * 32767) AS INT) / 32767, 6)) AS a, list_transform(s, lambda x: round(CAST(trunc((x + 1) * 32767) AS INT) / 65535 * 2 - 1, 6)) AS b FROM e")
def a1_pcm_to_float(spark, sf_dir):
    rows = short(spark, sf_dir)
    a = A.from_int16(F.transform("samples", lambda x: (x * 32767).cast("int")))
    b = A.from_uint16(F.transform("samples", lambda x: ((x + 1) * 32767).cast("int")))
    return rows.select("clip_id", rounded(a).alias("a"), rounded(b).alias("b"))


@query(CLIPS + "SELECT clip_id, list_transform(range(1, len(s) + 1, 3), lambda i: round((s[i] + coalesce(s[i + 1], 0) + coalesce(s[i + 2], 0)) / 3, 6)) AS mono FROM e")
def a2_downmixed(spark, sf_dir):
    return short(spark, sf_dir).select("clip_id", rounded(A.downmixed(F.col("samples"), 3)).alias("mono"))


@query(CLIPS + "SELECT clip_id, list_transform(s, lambda x: CAST(trunc(least(greatest(x * 6 * 32767, -32768), 32767)) AS INT)) AS pcm FROM e")
def a3_float_to_pcm(spark, sf_dir):
    return short(spark, sf_dir).select("clip_id", A.to_int16(F.transform("samples", lambda x: x * 6)).alias("pcm"))


@query(CLIPS + "SELECT clip_id, CAST(len(s) // 441 AS INT) AS blocks, CAST(len(s) % 441 AS INT) AS carry, CAST(len(s) // 441 * 160 + floor(len(s) % 441 / 441 * 160 + 0.5) AS INT) AS samples FROM c")
def a4_resampler_blocks(spark, sf_dir):
    return clips(spark, sf_dir).select("clip_id", A.resampling(F.size("samples"), F.lit(44_100)).alias("r")).select("clip_id", "r.*")


@query(CLIPS + "SELECT clip_id, CAST(len(s) // 441 * 160 + floor(len(s) % 441 / 441 * 160 + 0.5) AS INT) AS n FROM c")
def a4_resampled(spark, sf_dir):
    """Clips taken as 44.1 kHz, at 16 kHz; the SQL checks the lengths, tests the signal."""
    return A.resampled(clips(spark, sf_dir), 44_100).select("clip_id", F.size("samples").alias("n"))


@query(CLIPS + f"SELECT clip_id, round({RMS.format('s')}, 6) AS rms, round(list_max(list_transform(s, lambda x: abs(x))), 6) AS peak, CAST(len(list_filter(s, lambda x: abs(x) > 0.001)) AS INT) AS nonzero, round(len(list_filter(s, lambda x: abs(x) > 0.001)) / len(s) * 100, 6) AS nonzero_pct FROM c")
def a5_levels(spark, sf_dir):
    rows = A.levels(clips(spark, sf_dir))
    return rows.select("clip_id", F.round("rms", 6).alias("rms"), F.round("peak", 6).alias("peak"), "nonzero", F.round("nonzero_pct", 6).alias("nonzero_pct"))


@query(CLIPS + f", t AS (SELECT clip_id, s[greatest(len(s) - 1599, 1):] AS s FROM c) SELECT clip_id, round(least({RMS.format('s')} * 5, 1), 6) AS level FROM t")
def a6_input_level(spark, sf_dir):
    return clips(spark, sf_dir).select("clip_id", F.round(A.input_level(F.col("samples")), 6).alias("level"))


BARS = CLIPS + f", t AS (SELECT clip_id, s[greatest(len(s) - 7999, 1):] AS s FROM c), n AS (SELECT clip_id, s, greatest(len(s) // 48, 1) AS n FROM t), bars AS (SELECT clip_id, list_transform(range(0, 48), lambda i: CASE WHEN i * n < len(s) THEN least({RMS.format('s[i * n + 1:(i + 1) * n]')} * 12, 1) ELSE 0 END) AS b FROM n) "


def bars(spark, sf_dir):
    return clips(spark, sf_dir).select("clip_id", A.amplitude_bars(F.col("samples")).alias("b"))


@query(BARS + "SELECT clip_id, list_transform(b, lambda x: round(x, 6)) AS bars FROM bars")
def a8_amplitude_bars(spark, sf_dir):
    return bars(spark, sf_dir).select("clip_id", rounded(F.col("b")).alias("bars"))


@query(BARS + "SELECT clip_id, list_transform(b, lambda x: round(x, 6)) AS bars FROM bars")
def st3_tail_window(spark, sf_dir):
    return bars(spark, sf_dir).select("clip_id", rounded(F.col("b")).alias("bars"))


@query(BARS + "SELECT clip_id, round(list_avg(b), 6) AS level FROM bars")
def a7_mean_of_bars(spark, sf_dir):
    return bars(spark, sf_dir).select("clip_id", F.round(A.mean(F.col("b")), 6).alias("level"))


SHOWN = BARS + ", shown AS (SELECT clip_id, list_transform(range(0, 16), lambda i: coalesce(b[CAST(floor(i / 16 * len(b) + 0.5) AS INT) + 1], 0.06)) AS v FROM bars) "


@query(SHOWN + "SELECT clip_id, list_transform(v, lambda x: round(greatest(3, sqrt(x) * 24), 5)) AS heights FROM shown")
def s22_waveform_heights(spark, sf_dir):
    return bars(spark, sf_dir).select("clip_id", rounded(A.bar_heights(A.shown_bars(F.col("b"))), 5).alias("heights"))


CHUNKS = CLIPS + ", k AS (SELECT clip_id, s, unnest(range(0, 1 + CAST(ceil(greatest(len(s) - 480, 0) / 464) AS BIGINT))) AS chunk_no FROM c) SELECT clip_id, CAST(chunk_no AS INT) AS chunk_no, CAST(chunk_no * 464 AS INT) AS start, CAST(len(s[chunk_no * 464 + 1:chunk_no * 464 + 480]) AS INT) AS n, round(list_sum(s[chunk_no * 464 + 1:chunk_no * 464 + 480]), 5) AS total FROM k"


def _chunks(spark, sf_dir):
    rows = A.chunked(clips(spark, sf_dir), seconds=0.03, overlap=0.001)
    return rows.select("clip_id", "chunk_no", "start", F.size("samples").alias("n"), F.round(A.total(F.col("samples")), 5).alias("total"))


@query(CHUNKS)
def a9_chunked(spark, sf_dir):
    return _chunks(spark, sf_dir)


@query(CHUNKS)
def w7_positional_windows(spark, sf_dir):
    return _chunks(spark, sf_dir)


@query(CLIPS + "SELECT clip_id, CASE WHEN clip_id % 7 = 0 THEN NULL ELSE len(s) / 16000 / ((clip_id % 7) / 10) > 1.5 OR len(s) / 16000 / ((clip_id % 7) / 10) < 0.5 END AS mismatch FROM c")
def a10_clock_mismatch(spark, sf_dir):
    wall = F.when(F.col("clip_id") % 7 != 0, F.col("clip_id") % 7 / 10)
    return clips(spark, sf_dir).select("clip_id", A.clock_mismatch(F.size("samples"), wall).alias("mismatch"))


@query(CLIPS + "SELECT clip_id, len(s) / 16000 AS seconds, CAST(floor(len(s) / 16000 * 1000) AS BIGINT) AS speech_ms, len(s) < 16000 AS too_short FROM c")
def a11_durations(spark, sf_dir):
    return clips(spark, sf_dir).select("clip_id", *[c.alias(n) for n, c in A.durations(F.size("samples")).items()])


@query(CLIPS + f"SELECT clip_id, {RMS.format('s')} * (clip_id % 3) < 0.0001 AND clip_id % 2 = 0 AS gone FROM e")
def a12_disconnected(spark, sf_dir):
    quiet = F.transform("samples", lambda x: x * (F.col("clip_id") % 3))
    return short(spark, sf_dir).select("clip_id", A.disconnected(A.rms(quiet), F.col("clip_id") % 2 == 0).alias("gone"))
