"""Edges of the history, corpus, vocabulary, evaluation, audio and app operators."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from scrivener.functions.version import version_in_range, version_key
from scrivener.operators import app as P
from scrivener.operators import audio as A
from scrivener.operators import corpus as C
from scrivener.operators import evaluation as E
from scrivener.operators import history as H
from scrivener.operators import vocab as V
from scrivener.sources import files as S
from scrivener.streaming import dictation as D

HISTORY = "ord long, text string, ts timestamp_ntz, timestamp string, word_count long, speech_duration_ms long"


def today():
    return F.lit("2024-03-10").cast("date")



def history(spark, rows):
    return spark.createDataFrame([(i, t, ts, str(ts), w, s) for i, (t, ts, w, s) in enumerate(rows)], HISTORY)


def day(d, h=9):
    return dt.datetime(2024, 3, d, h)


def test_empty_history(spark):
    h = history(spark, [])
    assert tuple(H.totals(h, today()).first()) == (0, 0, 0)
    assert tuple(H.average_wpm(h).first()) == (0, 0)
    assert H.usage(h, F.lit("2024-03-10").cast("timestamp_ntz")).first()["age_days"] is None
    assert [r["words"] for r in H.week(h, today()).orderBy("day").collect()] == [0] * 7
    assert H.against_yesterday(h, today()).first()["change_pct"] is None


def test_history_numbers(spark):
    h = history(spark, [("Alpha", day(9), 50, 60_000), ("beta", day(10), 75, 30_000), ("beta", day(10), 25, 0), ("x%_", None, None, None)])
    assert tuple(H.totals(h, today()).first()) == (150, 100, 2)
    assert H.average_wpm(h).first()["avg_wpm"] == 100  # mean of 50 and 150
    assert H.against_yesterday(h, today()).first()["change_pct"] == 100
    assert [r["ord"] for r in H.deduplicated(h.filter("ts is not null"), "ts").orderBy("ord").collect()] == [0, 1]
    assert H.searched(h, "BET").count() == 2 and H.searched(h, "%_").count() == 1 and H.searched(h, "  ").count() == 4
    assert H.retained(h, F.lit("2024-03-11 00:00:00").cast("timestamp_ntz"), -1).count() == 4
    assert [r["ord"] for r in H.newest(h, 2).orderBy("ord").collect()] == [2, 3]
    assert H.cleared(h).count() == 0


@pytest.mark.parametrize(("words", "saved"), [(0, "0 min"), (3272, "60 min"), (3273, "1.0 hrs"), (10_000, "3.1 hrs")])
def test_time_saved(spark, words, saved):
    assert spark.range(1).select(H.time_saved(F.lit(words))).first()[0] == saved


def test_pair_tests_at_their_bounds(spark):
    five = "one two three four five"
    rows = [(five, five), ("one two three four", "x"), (" ".join(["w"] * 200), "x"), (" ".join(["w"] * 201), "x"), (five, ""), (None, "x"), (five, "[a]"), (five, "x" * 58), ("um " + five, "x")]
    df = spark.createDataFrame(rows, "input string, output string")
    assert [r[0] for r in df.select(C.is_valid()).collect()] == [True, False, True, False, False, False, False, False, False]
    sizes = spark.createDataFrame([("a" * 20, "b" * 31), ("a" * 21, "b" * 31), ("a" * 21, "b" * 32)], "input string, output string")
    assert [r[0] for r in sizes.select(C.is_expanded()).collect()] == [False, False, True]


def test_curation_reaches_its_share_and_agrees_with_itself(spark):
    pairs = spark.createDataFrame([(f"sentence number {i} is said", f"sentence {i}") for i in range(100)], "input string, output string")
    lines = spark.createDataFrame([(0, "Clean one."), (1, "Clean two.")], "ord long, text string")
    one, two = (C.curated(pairs, lines).collect() for _ in range(2))
    assert one == two and len(one) == 115 and sum(r["input"] == r["output"] for r in one) == 15


def test_curation_is_its_steps_and_the_quota(spark, sf_dir):
    """C2 against its parts (each of which has its SQL) and C4's random rows against their hash."""
    from collections import Counter

    from scrivener.plans import corpus

    pairs, texts = corpus.pairs(spark, sf_dir), [r["text"] for r in corpus.sentences(spark, sf_dir).orderBy("ord").collect()]
    kept = [(r["input"], r["output"]) for r in C.lists_flattened(C.output_cleaned(pairs)).collect()]
    kept = [(i, o) for i, o in kept if o.strip() and not (len(o) > 1.5 * len(i) and len(i) > 20)]
    wanted = max(0, int(len(kept) * 0.15) - sum(i.strip() == o.strip() for i, o in kept))
    added = Counter((r["input"], r["output"]) for r in corpus.c2_curated(spark, sf_dir).collect())
    added.subtract(Counter(kept))
    assert all(n >= 0 for n in added.values()) and sum(added.values()) == wanted and all(i == o and i in texts for (i, o), n in added.items() if n)
    few = C.passthroughs(corpus.sentences(spark, sf_dir), spark.createDataFrame([(len(texts) + 500,)], "wanted long"))
    by_k = {r["k"]: r["input"] for r in few.collect()}
    hashes = {r["id"]: r["h"] for r in spark.range(len(texts) + 500).select("id", F.xxhash64("id", F.lit(42)).alias("h")).collect()}
    assert by_k == {k: texts[k if k < len(texts) else h % len(texts)] for k, h in hashes.items()}


def test_weighted_sampling_against_its_bounds(spark, sf_dir):
    from scrivener.plans import corpus

    got = {r["event_id"]: r["name"] for r in corpus.c5_weighted_sampling(spark, sf_dir).collect()}
    hashes = {r["event_id"]: r["h"] for r in spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.xxhash64("event_id", F.lit(42)).alias("h")).collect()}
    total = sum(w for _, w in corpus.CATEGORIES)

    def name(u):
        upto = 0
        for n, w in corpus.CATEGORIES:
            upto += w
            if u * total <= upto:
                return n

    assert got == {k: name(h % (1 << 53) / (1 << 53)) for k, h in hashes.items()}


def test_weighted_choice_bounds_and_share(spark):
    cats = spark.createDataFrame([(0, "a", 1), (1, "b", 3)], "ord int, name string, weight int")
    draws = spark.createDataFrame([(0.0,), (0.25,), (0.2501,), (0.9999,)], "u double")
    assert [r["name"] for r in C.weighted_choice(draws, cats, F.col("u")).orderBy("u").collect()] == ["a", "a", "b", "b"]
    many = C.weighted_choice(spark.range(4000), cats, C.hashed_uniform("id")).filter("name = 'b'").count()
    assert 2800 < many < 3200


def test_dense_index_over_blocks_and_ties(spark):
    ids = spark.createDataFrame([(i * 50_000,) for i in (3, 1, 1, 0, 2)] + [(None,)], "old_id long")
    assert [tuple(r) for r in V.dense_index(ids).orderBy("old_id").collect()] == [(i * 50_000, i) for i in range(4)]


def test_scores_of_edges(spark):
    rows = [("m", "AI-only", 10, "ab cd", "ab cd.", "ab cd", 1.0), ("m", "AI-only", 1, "", "", "", 1.0), ("m", "regex+AI", 1, "Wonderful thing", "thing", "x", 2.0)]
    s = E.scored(spark.createDataFrame(rows, "model string, mode string, id int, raw_input string, output string, expected string, time_ms double"))
    got = {(r["mode"], r["id"]): (r["exact"], r["preservation"], r["passthrough"], r["len_ratio"]) for r in s.collect()}
    assert got == {("AI-only", 10): (False, 1.0, True, 1.2), ("AI-only", 1): (True, 1.0, True, 1.0), ("regex+AI", 1): (False, 0.5, False, 5.0)}
    assert {r["mode"]: r["passthrough"] for r in E.summary(s).collect()} == {"AI-only": True, "regex+AI": False}


def test_versions(spark):
    order = ["1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "1.0.1+build", "1.10.0"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(order)], "i int, v string")
    assert [r["i"] for r in df.orderBy(version_key(F.col("v"))).collect()] == list(range(len(order)))
    fits = lambda v, a, b: spark.range(1).select(version_in_range(F.lit(v), F.lit(a).cast("string"), F.lit(b).cast("string"))).first()[0]
    assert fits("1.2.3", None, None) and fits("dev", "9.0.0", None) and fits("1.2.3", "bad", "1.2.3") and not fits("1.2.4", None, "1.2.3") and not fits("1.2.3-rc.1", "1.2.3", None)


def test_audio_edges(spark):
    clip = spark.createDataFrame([([],), ([0.5],), (None,)], "s array<float>")
    got = clip.select(A.rms(F.col("s")), A.input_level(F.col("s")), A.amplitude_bars(F.col("s"))).collect()
    assert got[0][0] == 0 and got[0][2] == [0.0] * 48 and got[1][1] == 1.0 and got[1][2] == [1.0] + [0.0] * 47 and got[2][0] is None
    sizes = spark.createDataFrame([(n,) for n in (0, 1, 480_000, 480_001, 944_000, 944_001)], "n int")
    assert [len(r[0]) for r in sizes.select(A.chunk_starts(F.col("n"), 480_000, 16_000)).collect()] == [1, 1, 1, 2, 2, 3]
    assert spark.createDataFrame([([1.0, 3.0, 5.0],)], "s array<float>").select(A.downmixed(F.col("s"), 2)).first()[0] == [2.0, 2.5]
    assert spark.createDataFrame([([2.0, -2.0, 0.5],)], "s array<float>").select(A.to_int16(F.col("s"))).first()[0] == [32767, -32768, 16383]


def test_indexed_search_reads_few_blocks_and_finds_all(spark, tmp_path, monkeypatch):
    import random

    rng = random.Random(3)
    said = lambda k: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(6)) + (" Needle É" if k % 97 == 5 else "")
    rows = [(k, said(k), "clash") for k in range(400)] + [(400, None, "x"), (401, "", "x"), (402, "ab", "x"), (403, "İnteresting", "x"), (7, "needle again", "x")]
    h = spark.createDataFrame(rows, "ord long, text string, block string")
    path = f"file://{tmp_path}/h"
    H.write_indexed(h.drop("block"), path, block_rows=20)
    found = lambda df: sorted((r["ord"], r["text"] or "") for r in df.collect())
    for sought in ("NEEDLE", "needle é", "é", "ab", "  ", "", "no such thing", "edl", "a" * 200, "İnt"):
        for most in (5_000, 1):
            monkeypatch.setattr(H, "NAMED", most)
            assert found(H.searched_indexed(spark, path, sought)) == found(H.searched(h, sought)), sought
    monkeypatch.setattr(H, "NAMED", 5_000)
    df = H.searched_indexed(spark, path, "needle")
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    assert 1 <= leaf.metrics().apply("numFiles").value() <= 8
    H.write_indexed(h.limit(0).drop("block"), path)
    assert H.searched_indexed(spark, path, "needle").count() == H.searched_indexed(spark, path, "").count() == 0


def test_work_is_done_once_or_dead(spark, tmp_path):
    from scrivener.sources.queue import Queue

    q = Queue(spark, f"file://{tmp_path}/q", most=3)
    with pytest.raises(ValueError, match="own"):
        q.put(spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "task int, text string"))
    q.put(spark.createDataFrame([(k, f"t{k}") for k in range(40)], "task int, text string"))
    fails = F.pmod(F.hash("task", "attempts"), F.lit(2)) == 0
    answer = lambda rows: rows.select("task", F.when(~fails, F.upper("text")).alias("result"), F.when(fails, F.concat(F.lit("attempt "), "attempts")).alias("failure"))

    def dies(rows):
        return rows.select("task", F.raise_error(F.lit("lost")).cast("string").alias("result"), F.lit(None).cast("string").alias("failure"))

    with pytest.raises(Exception, match="lost"):
        q.step(dies)
    assert q.outcomes() is None and q.waiting().count() == 40
    assert q.step(answer) == 40
    waiting = {r["task"]: (r["attempts"], r["due"]) for r in q.waiting().collect()}
    assert 0 < len(waiting) < 40 and set(waiting.values()) == {(1, 2)}
    # another runner had the same round and finds it taken
    other = Queue(spark, q.path, most=3)
    other._rounds = lambda: []
    assert other.step(answer) is None
    q.run(answer)
    done, dead = q.done().collect(), q.dead().collect()
    assert sorted(r["task"] for r in [*done, *dead]) == list(range(40)) and q.waiting().count() == 0
    assert all(r["result"] == f"T{r['task']}" and r["attempts"] <= 3 for r in done) and all(r["attempts"] == 3 and r["failure"] == "attempt 2" for r in dead)
    assert q.outcomes().filter("failure is null").groupBy("task").count().filter("count > 1").count() == 0
    assert q.run(answer) == 0


def test_wav_reads_back(spark):
    import io
    import wave

    clips = spark.createDataFrame([(1, [0.0, 0.5, -1.0]), (2, []), (3, None)], "clip_id int, samples array<float>")
    for row in S.wav_encoded(clips).collect():
        with wave.open(io.BytesIO(bytes(row["wav"]))) as w:
            assert (w.getnchannels(), w.getframerate(), w.getsampwidth(), w.getnframes()) == (1, 16000, 2, 3 if row["clip_id"] == 1 else 0)


def test_wav_files_in_a_folder_and_as_a_stream(spark, tmp_path):
    import struct
    import wave

    def put(name, width, channels, frames, rate=8000):
        with wave.open(str(tmp_path / "in" / name), "wb") as w:
            w.setnchannels(channels)
            w.setsampwidth(width)
            w.setframerate(rate)
            w.writeframes(frames)

    (tmp_path / "in").mkdir()
    put("a.wav", 2, 2, struct.pack("<6h", 32767, -32767, 0, 16384, 1, -1))
    put("b.wav", 1, 1, bytes([255, 128, 1]))
    put("c.wav", 3, 1, (8388607).to_bytes(3, "little") + (-8388607).to_bytes(3, "little", signed=True))
    put("d.wav", 4, 1, struct.pack("<i", -(1 << 31) + 1))
    whole = (tmp_path / "in" / "a.wav").read_bytes()
    for name, data in {"cut.wav": whole[:-3], "head.wav": whole[:20], "none.wav": b"", "text.wav": b"hello there, world", "bare.wav": whole[:12], "odd.wav": whole[:12] + b"note" + struct.pack("<I", 3) + b"abc\0" + whole[12:], "float.wav": whole[:20] + struct.pack("<H", 3) + whole[22:32] + struct.pack("<HH", 4, 32) + b"data" + struct.pack("<If", 4, 0.25), "not.txt": whole}.items():
        (tmp_path / "in" / name).write_bytes(data)
    got = {r["path"].rpartition("/")[2]: r for r in S.read_wav(spark, f"file://{tmp_path}/in").collect()}
    near = lambda name, values: [round(x, 6) for x in got[name]["samples"]] == [round(x, 6) for x in values]
    assert len(got) == 10 and near("a.wav", [1, -1, 0, 16384 / 32767, 1 / 32767, -1 / 32767]) and (got["a.wav"]["rate"], got["a.wav"]["channels"]) == (8000, 2)
    assert near("b.wav", [1, 0, -1]) and near("c.wav", [1, -1]) and near("d.wav", [-1]) and near("odd.wav", got["a.wav"]["samples"])
    assert near("cut.wav", got["a.wav"]["samples"][:4]) and got["cut.wav"]["problem"] == "data cut short" and got["a.wav"]["problem"] is None
    assert "none.wav" not in got and got["text.wav"]["problem"] == S.wav_samples(None)[3] == S.wav_samples(b"")[3] == "no wave file" and got["bare.wav"]["problem"] == "no data" and got["head.wav"]["problem"] == "header cut short"
    assert all(got[n]["samples"] is None for n in ("head.wav", "text.wav", "bare.wav"))
    out = f"file://{tmp_path}/out"
    D.run_once(S.wav_stream(spark, f"file://{tmp_path}/in", 3), D.appended_log(out), f"file://{tmp_path}/state")
    rows = spark.read.parquet(out)
    assert rows.count() == 10 and rows.select("batch").distinct().count() == 4
    assert {r["path"].rpartition("/")[2]: r["samples"] for r in rows.collect()} == {k: r["samples"] for k, r in got.items()}


def test_bad_json_records_drop_one_by_one(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": "x"}\nnot json\n{"id": "y"}\n')
    rows = S.read_jsonl(spark, f"file://{tmp_path}/a.json", "id string, title string")
    assert sorted(r["id"] for r in rows.collect()) == ["x", "y"] and rows.count() == 2
    assert S.read_jsonl(spark, f"file://{tmp_path}/none", "id string").count() == 0
    assert S.read_snippets(spark, f"file://{tmp_path}/none").count() == 2


def test_export_keeps_its_order(spark, tmp_path):
    h = history(spark, [("a", day(9), 1, 0), ("b", day(10, 15), 2, 0)])
    S.write_text(H.export_line(h), "line", "ord", f"file://{tmp_path}/export")
    text = "".join(p.read_text() for p in sorted((tmp_path / "export").glob("part-*")))
    assert text == "[3/9/2024, 9:00:00 AM] (1 words)\na\n\n---\n\n[3/10/2024, 3:00:00 PM] (2 words)\nb\n\n---\n\n"


def test_numbered_keeps_a_global_order(spark):
    from scrivener.operators.ordering import numbered

    rows = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k"), F.lit("clash").alias("part_"))
    got = numbered(rows, "k", name="n", first=1).orderBy("n").collect()
    assert [r["k"] for r in got] == sorted(i * 7919 % 5003 for i in range(5000)) and [r["n"] for r in got] == list(range(1, 5001))
    down = numbered(rows, F.desc("k"), name="n").filter("n < 3").orderBy("n").collect()
    assert [r["k"] for r in down] == sorted((i * 7919 % 5003 for i in range(5000)), reverse=True)[:3] and numbered(rows.limit(0), "k").count() == 0


def test_vocabulary_numbers(spark):
    tokens = spark.createDataFrame([("b",), ("a",), ("É",), ("b",), ("z",)], "token string")
    assert sorted(map(tuple, V.vocabulary(tokens, 3).collect())) == [("a", 3), ("b", 6), ("z", 9), ("É", 12)]
    cut = V.pruned(V.vocabulary(tokens), V.dense_index(V.vocabulary(tokens).filter("token in ('b', 'z')")))
    assert sorted(map(tuple, cut.collect())) == [("b", 2, 0), ("z", 3, 1)]


def test_passthroughs_are_the_sentences_in_order_then_repeats(spark, monkeypatch):
    """Whatever the block, the same rows: each number once, sentences first, then only sentences."""
    sentences = spark.createDataFrame([(i, f"s{i}") for i in range(5)], "ord long, text string")
    made = {}
    for block in (65_536, 7):
        monkeypatch.setattr(C, "BLOCK_ROWS", block)
        for wanted in (0, 3, 1000):
            rows = sorted(map(tuple, C.passthroughs(sentences, spark.createDataFrame([(wanted,)], "wanted long")).collect()))
            assert [r[0] for r in rows] == list(range(wanted)) and [r[1] for r in rows[:5]] == [f"s{i}" for i in range(min(wanted, 5))]
            assert all(a == b and a in {f"s{i}" for i in range(5)} for _, a, b in rows) and made.setdefault(wanted, rows) == rows
    count = {s: sum(r[1] == s for r in made[1000]) for s in ("s0", "s4")}
    assert all(140 < n < 260 for n in count.values())


def test_recorder_states_over_days(spark):
    start = dt.datetime(2024, 3, 1, 23, 59)
    said = ["start", "stop", "polish", "x", "done", "start", "error", "start"]
    rows = [(1, start + dt.timedelta(hours=9 * i), i, e) for i, e in enumerate(said)] + [(2, start, 0, "stop"), (None, start, 0, "start")]
    events = spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, event_id long, e string")
    got = {r["user_id"]: (r["state"], r["n"]) for r in D.recorder_states(events, F.col("e")).collect()}
    assert got == {1: ("Recording", 8), 2: ("Idle", 1), None: ("Recording", 1)}


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from scrivener.sources.storage import shared_folder

    conf = SimpleNamespace(get=lambda *a: None)
    session = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://somewhere:7077", getConf=lambda: conf))
    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_folder(session)


@pytest.mark.parametrize("rate", [44_100, 48_000, 8_000])
def test_resampling_keeps_tones_and_drops_what_does_not_fit(spark, rate):
    import numpy as np

    t = np.arange(rate // 2 + 37) / rate
    tone = lambda hertz: np.sin(2 * np.pi * hertz * t).tolist()
    clips = spark.createDataFrame([(1, tone(440)), (2, tone(11_000)), (3, []), (4, None), (5, [1.0] * (rate // 10)), (6, [0.5])], "clip_id int, samples array<double>")
    got = {r["clip_id"]: r["samples"] for r in A.resampled(clips, rate).collect()}
    counted = clips.select("clip_id", A.resampling(F.size("samples"), F.lit(rate)).alias("r")).select("clip_id", "r.samples").collect()
    assert all(len(got[r["clip_id"]]) == r["samples"] for r in counted if r["clip_id"] != 4) and got[3] == [] and got[4] is None
    delay = (rate // 100 - 1) / 2 / rate
    heard, at = np.array(got[1][400:-400]), np.arange(len(got[1]))[400:-400] / 16_000
    assert np.abs(heard - np.sin(2 * np.pi * 440 * (at - delay))).max() < 0.01
    if rate > 22_000:  # 11 kHz does not fit 16 kHz; at a lower rate it is another tone to begin with
        assert np.abs(np.array(got[2][400:-400])).max() < 0.01
    assert np.allclose(got[5][400:-400], 1.0, atol=0.01)
    same = A.resampled(clips, 16_000).filter("clip_id = 6").first()["samples"]
    assert same == [0.5]


def test_places_are_those_of_sql(spark):
    """Halves after scaling in doubles, negative zeros: as the SQL rounds, bit by bit."""
    import duckdb

    from scrivener.plans.audio import rounded

    values = [-1e-7, 1e-7, -0.0, 0.0, 2.5e-6, -2.5e-6, 0.5 / 32767, 1.0000005, 0.1234565, -0.1234565, 3.0000015, 1 / 3, -2 / 3]
    got = spark.createDataFrame([(values,)], "s array<double>").select(rounded(F.col("s"))).first()[0]
    assert repr(got) == repr(duckdb.execute("select list_transform(?::double[], lambda x: round(x, 6))", [values]).fetchone()[0])


def test_wav_queries_keep_the_sign_of_a_zero(spark, tmp_path):
    from scrivener.plans import QUERIES

    spark.createDataFrame([(1, [-1e-5, 1e-5, 0.5, -0.5])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    row = QUERIES["io14_wav_read_back"](spark, str(tmp_path)).first()
    assert repr(row["samples"][:2]) == "[-0.0, 0.0]" and row["problem"] is None


def test_history_of_many_users_lies_in_few_folders(spark, tmp_path):
    rows = [(u, f"t{u}-{k}", "2024-01-01", 1, 2, 3, True) for u in range(200) for k in range(3)]
    df = spark.createDataFrame(rows, f"user long, {S.HISTORY}")
    S.write_json_arrays(df, f"{tmp_path}/h", "user")
    assert len([p for p in (tmp_path / "h").iterdir() if p.is_dir()]) <= S.FOLDERS
    back = S.read_history(spark, f"{tmp_path}/h", whole=False)
    assert sorted(r["text"] for r in back.collect()) == sorted(r[1] for r in rows)


def test_long_clips_leave_in_several_batches(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa

    clips, got = spark.createDataFrame([(1, [0.5])], "clip_id long, samples array<double>"), []
    monkeypatch.setattr(type(clips.select("clip_id")), "mapInArrow", lambda self, fn, schema: got.append(fn))
    A.resampled(clips, 44_100)
    values = [np.full(300_000, 0.5) if k % 7 else None for k in range(30)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(30)), pa.array(values, pa.list_(pa.float64()))], names=["clip_id", "samples"])
    out = list(got[0](iter([batch])))
    assert len(out) > 2 and [i for b in out for i in b.column(0).to_pylist()] == list(range(30))
    assert [None if v is None else 108_844 for v in values] == [len(x) if x.is_valid else None for b in out for x in b.column(1)]


def test_merges_kept_where_the_parts_are(spark):
    """Exactly two parts, both in the vocabulary; the same whether what it lacks is broadcast or joined."""
    merges = spark.createDataFrame([(m,) for m in ("a b", "b c", "c b", "a", "a b c", "a ", "a  b", "", " b", "a b", None)], "merge string")
    vocab = spark.createDataFrame([("a",), ("b",), ("b",), ("",), (None,)], "token string")
    for limit in ("10m", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        assert sorted(r["merge"] for r in V.merges_kept(merges, vocab).collect()) == [" b", "a ", "a b", "a b"]
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    left = V.pairs_without(spark.createDataFrame([("x", "y"), ("y", "z"), ("z", "x")], "a_ string, b_ string"), spark.createDataFrame([("z",)], "token string"))
    assert [tuple(r) for r in left.collect()] == [("x", "y")]


def test_adjacent_words_with_the_last_one(spark):
    texts = spark.createDataFrame([(" a b  a\n",), ("c",), ("",), (None,)], "text string")
    assert sorted(map(tuple, V.adjacent_words(texts, "text").collect()), key=str) == [("a", "b"), ("a", None), ("b", "a"), ("c", None)]


def test_kept_numbered_is_vocabulary_dense_index_and_pruned(spark):
    """One order numbers both; a token once, whatever its rows say."""
    rows = [("b", True, True), ("a", True, False), ("É", True, True), ("b", False, False), ("z", False, True), ("c", True, False), ("c", False, True), ("y", False, False)]
    marks = V.marked(spark.createDataFrame(rows, "token string, listed boolean, used boolean"))
    listed, used = marks.filter("listed"), marks.filter("used")
    vocab = V.vocabulary(listed, 3)
    expected = V.pruned(vocab, V.dense_index(vocab.join(used, "token", "left_semi")))
    got = sorted(map(tuple, V.kept_numbered(marks, 3).collect()))
    assert got == sorted(map(tuple, expected.collect())) == [("b", 6, 0), ("c", 9, 1), ("É", 12, 2)]
