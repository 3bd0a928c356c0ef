"""Queries of the evaluation of model outputs: `benchmark` texts by two models in two modes."""

from __future__ import annotations

from pyspark.sql import functions as F

from scrivener.functions.text import capital
from scrivener.operators import evaluation as E

from .registry import query, table

WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
RESULTS = r"""WITH r AS (SELECT m.model, d.mode, item_id AS id, text AS raw_input, upper(substr(text, 1, 1)) || substr(text, 2) AS expected,
 CASE (item_id + m.k * 3 + d.k) % 5 WHEN 0 THEN text || ' ' WHEN 1 THEN substr(text, 1, length(text) // 2) WHEN 2 THEN upper(replace(text, 'ß', 'ss')) WHEN 3 THEN substr(text, 1, length(text) - 1) ELSE upper(substr(text, 1, 1)) || substr(text, 2) END AS output,
 (item_id * 37 + m.k * 11 + d.k * 5) % 400 + 100.25::DOUBLE AS time_ms
 FROM benchmark, (VALUES ('small', 0), ('large q', 1)) m(model, k), (VALUES ('AI-only', 0), ('regex+AI', 1)) d(mode, k)),
 b AS (SELECT *, list_filter(list_distinct(list_transform(list_filter(regexp_split_to_array(raw_input, '\s+'), lambda x: length(x) > 3), lambda x: lower(x))), lambda x: x NOT IN ('like', 'basically', 'just', 'really', 'actually', 'know', 'mean', 'that', 'this', 'what', 'trying')) AS cw, trim(output, """ + WS + ") AS o, trim(expected, " + WS + ") AS e, trim(raw_input, " + WS + r""") AS i FROM r),
 s AS (SELECT model, mode, id, time_ms, o = e AS exact, round_even(CASE WHEN len(cw) = 0 THEN 1.0 ELSE len(list_filter(cw, lambda x: contains(lower(o), x))) / len(cw) END, 2) AS preservation, o = i OR o = i || '.' AS passthrough, round_even(CASE WHEN e = '' THEN 1.0 ELSE length(o) / length(e) END, 2) AS len_ratio FROM b),
 g AS (SELECT model, mode, CAST(round_even(avg(time_ms), 0) AS BIGINT) AS avg_time_ms, count(*) FILTER (exact) AS exact_matches, count(*) AS total, round_even(avg(preservation), 2) AS avg_preservation, coalesce(bool_or(id = 10 AND (passthrough OR exact)), false) AS passthrough FROM s GROUP BY ALL)"""


def results(spark, sf_dir):
    models = spark.createDataFrame([("small", 0, "AI-only", 0), ("small", 0, "regex+AI", 1), ("large q", 1, "AI-only", 0), ("large q", 1, "regex+AI", 1)], "model string, mk int, mode string, dk int")
    t, i = F.col("text"), F.col("item_id")
    rows = table(spark, sf_dir, "benchmark").crossJoin(F.broadcast(models))
    expected = capital(t)
    k = (i + F.col("mk") * 3 + F.col("dk")) % 5
    output = F.when(k == 0, F.concat(t, F.lit(" "))).when(k == 1, F.substring(t, F.lit(1), F.floor(F.length(t) / 2).cast("int"))).when(k == 2, F.upper(F.replace(t, F.lit("ß"), F.lit("ss")))).when(k == 3, F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(expected)
    ms = (i * 37 + F.col("mk") * 11 + F.col("dk") * 5) % 400 + F.lit(100.25)
    return rows.select("model", "mode", i.alias("id"), t.alias("raw_input"), expected.alias("expected"), output.alias("output"), ms.alias("time_ms"))


def scores(spark, sf_dir):
    return E.scored(results(spark, sf_dir))


def summaries(spark, sf_dir):
    return E.summary(scores(spark, sf_dir))


@query(RESULTS + " SELECT model, mode, id, exact, preservation, passthrough, len_ratio FROM s")
def s14_scores(spark, sf_dir):
    return scores(spark, sf_dir).select("model", "mode", "id", "exact", "preservation", "passthrough", "len_ratio")


@query(RESULTS + " SELECT mode, avg(time_ms) AS avg_ms, min(time_ms) AS min_ms, max(time_ms) AS max_ms FROM r GROUP BY mode")
def b1_timings(spark, sf_dir):
    return E.timings(results(spark, sf_dir))


@query(RESULTS + " SELECT id, list({'mode': mode, 'model': model, 'match': CASE WHEN o = e THEN 'MATCH' ELSE 'DIFF' END} ORDER BY mode, model) AS modes FROM b GROUP BY id")
def b2_by_transcript(spark, sf_dir):
    return E.by_transcript(results(spark, sf_dir))


@query(RESULTS + " SELECT model, mode, avg_time_ms, exact_matches, total, avg_preservation, passthrough FROM g")
def b3_summary(spark, sf_dir):
    return summaries(spark, sf_dir)


EFFECT = RESULTS + ", x AS (SELECT model, avg(preservation) FILTER (mode = 'regex+AI') - avg(preservation) FILTER (mode = 'AI-only') AS diff FROM s GROUP BY 1) SELECT model, round(diff, 8) AS diff, CASE WHEN diff > 0 THEN 'regex+AI' ELSE 'AI-only' END AS winner FROM x"


@query(EFFECT)
def b4_mode_effect(spark, sf_dir):
    return E.mode_effect(scores(spark, sf_dir)).withColumn("diff", F.round("diff", 8))


@query(EFFECT)
def j8_both_modes(spark, sf_dir):
    return E.mode_effect(scores(spark, sf_dir)).withColumn("diff", F.round("diff", 8))


@query(RESULTS + " SELECT model, mode, avg_time_ms FROM g ORDER BY 3, avg_preservation DESC, 1, 2")
def o3_by_speed(spark, sf_dir):
    return E.by_speed(summaries(spark, sf_dir)).select("model", "mode", "avg_time_ms")


@query(RESULTS + ", q AS (SELECT 'quality' AS best, model, mode FROM g ORDER BY avg_preservation DESC, exact_matches DESC, avg_time_ms, model, mode LIMIT 1), v AS (SELECT 'speed' AS best, model, mode FROM g ORDER BY avg_time_ms, avg_preservation DESC, model, mode LIMIT 1) SELECT * FROM q UNION ALL SELECT * FROM v")
def o4_best(spark, sf_dir):
    rows = summaries(spark, sf_dir)
    pick = lambda kind, df: df.select(F.lit(kind).alias("best"), "model", "mode")
    return pick("quality", E.best_quality(rows)).unionByName(pick("speed", E.best_speed(rows)))


@query(RESULTS + " SELECT DISTINCT mode FROM r ORDER BY 1")
def o9_modes(spark, sf_dir):
    return results(spark, sf_dir).select("mode").distinct().orderBy("mode")


@query(RESULTS + " SELECT id, model, mode, time_ms FROM (SELECT item_id AS id FROM benchmark UNION ALL SELECT -1 - item_id FROM benchmark) t LEFT JOIN r USING (id)")
def j1_transcripts_with_results(spark, sf_dir):
    """All transcripts, and as many that no model was run on."""
    ids = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"))
    transcripts = ids.unionByName(ids.select((-1 - F.col("id")).alias("id")))
    return E.with_results(transcripts, results(spark, sf_dir)).select("id", "model", "mode", "time_ms")


@query(RESULTS + " SELECT model, mode, id, CASE WHEN o = e THEN 'MATCH' ELSE 'DIFF' END AS match FROM b")
def f22_match_flag(spark, sf_dir):
    return results(spark, sf_dir).select("model", "mode", "id", E.match_flag(F.col("output"), F.col("expected")).alias("match"))


@query(RESULTS + " SELECT id, list_sort(cw) AS words FROM b WHERE model = 'small' AND mode = 'AI-only'")
def e5_content_words(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark")
    return rows.select(F.col("item_id").alias("id"), F.sort_array(E.content_words(F.col("text"))).alias("words"))


@query(RESULTS + " SELECT id, mode FROM r WHERE mode = 'AI-only' UNION ALL SELECT id, mode FROM r WHERE mode = 'regex+AI'")
def e1_union_of_modes(spark, sf_dir):
    rows = results(spark, sf_dir).select("id", "mode")
    return rows.filter("mode = 'AI-only'").unionByName(rows.filter("mode = 'regex+AI'"))


@query("SELECT item_id, round_even(item_id / 8, 2) AS two, round_even(item_id / 4, 1) AS one, round_even(item_id / 2, 0) AS none FROM benchmark")
def s15_rounding(spark, sf_dir):
    i = F.col("item_id")
    return table(spark, sf_dir, "benchmark").select("item_id", F.bround(i / 8, 2).alias("two"), F.bround(i / 4, 1).alias("one"), F.bround(i / 2, 0).alias("none"))


@query(RESULTS + " SELECT model, mode, printf('%.0f%%', round_even(avg_preservation * 100, 0)) AS preserved FROM g")
def s16_percent(spark, sf_dir):
    return summaries(spark, sf_dir).select("model", "mode", E.percent(F.col("avg_preservation")).alias("preserved"))


@query(RESULTS + " SELECT id, model, mode, substr(output, 1, 60) AS output FROM r")
def s17_truncated(spark, sf_dir):
    return results(spark, sf_dir).select("id", "model", "mode", F.substring("output", 1, 60).alias("output"))


@query(RESULTS + " SELECT DISTINCT model, regexp_replace(model || '/ü:' || mode, '[^a-zA-Z0-9._-]', '_', 'g') AS file FROM r")
def s24_safe_name(spark, sf_dir):
    return results(spark, sf_dir).select("model", E.safe_name(F.concat("model", F.lit("/ü:"), "mode")).alias("file")).distinct()


@query("SELECT event_id, 'Qwen' || event_id % 5 || '-' || upper(event_type) AS model, event_id % 5 = 3 AS thinks FROM events")
def s25_thinking_model(spark, sf_dir):
    model = F.concat(F.lit("Qwen"), (F.col("event_id") % 5).cast("string"), F.lit("-"), F.upper("event_type"))
    return table(spark, sf_dir, "events").select("event_id", model.alias("model"), F.contains(F.lower(model), F.lit("qwen3")).alias("thinks"))
