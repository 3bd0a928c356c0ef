"""Folds with timers, limits, totals and expiry: streams of any deal of the events against tables and
against one event after another in plain Python."""

from __future__ import annotations

import datetime as dt
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scrivener.streaming import dictation as D
from scrivener.streaming import frames as FR
from scrivener.streaming import limits as L
from scrivener.streaming import ordered as O
from scrivener.streaming import recorder as R

START = dt.datetime(2024, 3, 1)
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def made(n, span, kinds, seed=7):
    rng = random.Random(seed)
    rows = [(i, START + dt.timedelta(seconds=rng.randrange(span)), rng.choice([1, 1, 1, 2, 3, None]), rng.choice(kinds), 0.0, None) for i in range(n)]
    return [*rows, (n, None, 1, kinds[0], 0.0, None), (n + 1, START, 2, None, 0.0, None), rows[0]]


def dealt_to_files(spark, rows, folder, files=4, late=3000, seed=8):
    """Files in an order that brings events up to `late` seconds out of order, a file's time its place."""
    rng = random.Random(seed)
    rows = sorted(rows, key=lambda r: (r[1] or START) + dt.timedelta(seconds=rng.randrange(late)))
    each = -(-len(rows) // files)
    (folder / "events.parquet").mkdir(parents=True)
    for k in range(files):
        spark.createDataFrame(rows[k * each : (k + 1) * each], EVENTS).coalesce(1).write.parquet(f"file://{folder}/part-{k}")
        (file,) = (folder / f"part-{k}").glob("*.parquet")
        target = folder / "events.parquet" / f"{k}.parquet"
        os.rename(file, target)
        os.utime(target, (1_700_000_000 + k, 1_700_000_000 + k))
    return f"file://{folder}"


def us(t):
    return (t - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)


def by_user(rows):
    users = {}
    for i, t, user, kind, *_ in rows:
        if t is not None and kind is not None:
            users.setdefault(user, []).append((us(t), i, kind))
    return {u: sorted(x) for u, x in users.items()}


def recordings_by_hand(rows):
    out = []
    for user, events in by_user(rows).items():
        generation, k = 0, 0
        while k < len(events):
            at, _, kind = events[k]
            k += 1
            if kind != "start":
                continue
            generation += 1
            stop = next((j for j in range(k, len(events)) if events[j][2] == "stop" or events[j][0] >= at + 600_000_000), None)
            timed_out = stop is None or events[stop][0] >= at + 600_000_000
            out.append((user, generation, at, at + 600_000_000 if timed_out else events[stop][0], timed_out))
            k = len(events) if stop is None else stop if timed_out else stop + 1
    return out


def accepted_by_hand(rows, gap=300, per_user=True):
    last, out = {}, []
    for user, events in (by_user(rows) if per_user else {0: sorted(e for x in by_user(rows).values() for e in x)}).items():
        for at, i, _ in events:
            if user not in last or at - last[user] >= gap * 1_000_000:
                out.append(i)
                last[user] = at
    return sorted(out)


def streamed(spark, folder, fold, tmp_path):
    source = lambda: O.keyed(D.event_stream(spark, folder), "user_id", F.col("event_type"))
    out = f"file://{tmp_path}/out"
    O.run_to_end(source, f"file://{tmp_path}/close", D.appended_log(out), f"file://{tmp_path}/state", lambda s: O.stream(s, fold))
    return spark.read.parquet(out).drop("batch")


def in_order(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_recordings_stop_ten_minutes_after_their_start_in_any_deal(spark, tmp_path):
    rows = made(500, 40_000, ["start", "stop", "other"])
    expected = sorted(recordings_by_hand(rows), key=repr)
    assert {True, False} == {r[4] for r in expected}
    table = O.over_table(O.keyed(spark.createDataFrame(rows, EVENTS), "user_id", F.col("event_type")), R.Recordings())
    assert in_order(table) == expected
    assert in_order(streamed(spark, dealt_to_files(spark, rows, tmp_path / "in"), R.Recordings(), tmp_path)) == expected


def test_a_restart_does_not_meet_the_old_timer():
    minute = 60 * R.SECOND
    events = [(0, 0, "start"), (2 * minute, 1, "stop"), (5 * minute, 2, "start"), (14 * minute, 3, "stop"), (20 * minute, 4, "start"), (25 * minute, 5, "start")]
    _, out = O.advanced(R.Recordings(), R.Recordings().start(), events)
    assert out == [(1, 0, 2 * minute, False), (2, 5 * minute, 14 * minute, False), (3, 20 * minute, 30 * minute, True)]


def test_recorder_queues_stops_and_frees_a_stuck_start(spark, tmp_path):
    s = R.SECOND
    run = lambda events: [(e[0], e[2]) for e in O.advanced(R.Recorder(), R.Recorder().start(), [(at * s, at, e) for at, e in events])[1]]
    assert run([(0, "press"), (1, "release"), (2, "started"), (3, "done")]) == [(0, "Recording"), (2, "Processing"), (3, "Idle")]
    assert run([(0, "press"), (1, "started"), (9, "release"), (10, "polish"), (11, "done")]) == [(0, "Recording"), (9, "Processing"), (10, "Polishing"), (11, "Idle")]
    assert run([(0, "press"), (1, "started"), (2, "release"), (3, "error"), (4, "press"), (5, "started"), (6, "error")]) == [(0, "Recording"), (2, "Processing"), (3, "Idle"), (4, "Recording"), (6, "Idle")]
    assert run([(0, "press"), (1, "started"), (700, "release")]) == [(0, "Recording"), (None, "Processing")]
    assert run([(0, "press"), (1, "error"), (2, "press"), (3, "started"), (601, "other")]) == [(0, "Recording"), (1, "Idle"), (2, "Recording"), (None, "Processing")]
    rows = made(400, 30_000, ["press", "started", "release", "polish", "done", "error"])
    table = in_order(O.over_table(O.keyed(spark.createDataFrame(rows, EVENTS), "user_id", F.col("event_type")), R.Recorder()))
    assert in_order(streamed(spark, dealt_to_files(spark, rows, tmp_path / "in"), R.Recorder(), tmp_path)) == table
    one_by_one = [(u, *r) for u, events in by_user(rows).items() for r in O.advanced(R.Recorder(), R.Recorder().start(), events)[1]]
    assert sorted(one_by_one, key=repr) == table


def test_late_events_are_limited_as_in_the_table(spark, tmp_path):
    rows = made(600, 20_000, ["sent"])
    events = spark.createDataFrame(rows, EVENTS)
    expected = accepted_by_hand(rows)
    # a repeat of an event has its instant and is refused with it; so is it by hand
    assert sorted(r["event_id"] for r in D.rate_limited_table(events.filter("event_type is not null")).collect()) == expected
    assert sorted(r["event_id"] for r in streamed(spark, dealt_to_files(spark, rows, tmp_path / "in"), R.Accepted(), tmp_path).collect()) == expected


def test_a_buffer_of_fixed_size_shows_what_the_whole_clip_does(spark):
    import json

    from scrivener.operators import audio as A

    rng = random.Random(4)
    frames = [[rng.uniform(-0.1, 0.1) for _ in range(rng.choice([0, 1, 700, 3000]))] for _ in range(30)]
    state, rows = O.advanced(R.Tail(), R.Tail().start(), [(k, k, json.dumps(f)) for k, f in enumerate(frames)])
    assert len(state[1]) == 8000 and state[0] == sum(map(len, frames))
    so_far = [sum(frames[: k + 1], []) for k in range(30)]
    clips = spark.createDataFrame(list(enumerate(so_far)), "k int, samples array<double>")
    bars = {r["k"]: r["bars"] for r in clips.select("k", A.amplitude_bars(F.col("samples")).alias("bars")).collect()}
    assert all(np.allclose(r[3], bars[r[0]], atol=1e-12) and r[2] == len(so_far[r[0]]) for r in rows) and len(rows) == 30


def test_refreshes_and_empty_inputs(spark):
    frames = [(i, START + dt.timedelta(seconds=i), 1, str(n), 0.0, None) for i, n in enumerate([266, 100, 166, 1])]
    over = lambda rows, fold: O.over_table(O.keyed(spark.createDataFrame(rows, EVENTS), "user_id", F.col("event_type")), fold)
    assert [r["event_id"] for r in over(frames, R.Refreshes()).collect()] == [0, 2]
    assert over([], R.Recordings()).count() == 0 and L.limited(spark.createDataFrame([], EVENTS)).count() == 0


@pytest.mark.parametrize("span", [400, 90_000, 3_000_000])
def test_composed_maps_limit_as_one_process_does(spark, span):
    rows = made(1500, span, ["sent"], seed=span)
    events = spark.createDataFrame(rows, EVENTS).filter("event_type is not null").withColumn("clash", F.lit(1))
    expected = accepted_by_hand(rows, per_user=False)
    assert sorted(r["event_id"] for r in L.limited(events, ranges=37).collect()) == expected


def test_maps_compose_like_their_ranges():
    rng = np.random.default_rng(3)
    for gap in (1, 7, 100, 2000):
        at = np.sort(rng.integers(0, 3000, 200))
        cuts = [0, *sorted(rng.integers(0, 200, 5).tolist()), 200]
        whole = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
        for a, b in zip(cuts, cuts[1:], strict=False):
            whole = L.composed(whole, L.range_map(at[a:b], gap), gap)
        for last in (L.NEVER, -50, int(at[0]) - gap, 0):
            places = L.accepted_at(at, gap, last)
            assert L.through(np.array([last]), gap, *whole)[0] == (at[places[-1]] if places else last)


def test_limiting_batches_in_any_order_and_twice(spark, tmp_path):
    rows = [r for r in made(300, 20_000, ["sent"])[:300]]
    late = sorted(rows, key=lambda r: r[1] + dt.timedelta(seconds=random.Random(r[0]).randrange(3000)))
    write, end = L.limiting(f"file://{tmp_path}/limit", late=3600)
    for number in range(3):
        batch = spark.createDataFrame(late[number * 100 : (number + 1) * 100], EVENTS)
        write(batch, number)
        if number == 1:
            write(batch, number)
    end(spark, 3)
    got = sorted(r["event_id"] for r in spark.read.parquet(f"file://{tmp_path}/limit/out").collect())
    assert got == accepted_by_hand(rows, per_user=False)


def test_totals_of_open_days_and_repeated_batches(spark, tmp_path):
    path = f"file://{tmp_path}/totals"
    write = D.upserted(path)
    batches = [[(1, 5), (2, 7)], [(2, 9)], [(3, 1)]]
    for number, rows in enumerate(batches):
        write(spark.createDataFrame(rows, "day int, words long"), number)
    write(spark.createDataFrame(batches[1], "day int, words long"), 1)
    assert sorted(map(tuple, D.latest(spark, path, "day").collect())) == [(1, 5), (2, 9), (3, 1)]


def test_a_shorter_retention_expires_at_once(spark, tmp_path):
    log = D.ExpiringLog(spark, f"file://{tmp_path}/log")
    event = lambda d: (d, None if d == 0 else dt.datetime(2024, 3, d, 12))
    setting = lambda at, days: spark.createDataFrame([(dt.datetime(2024, 3, at), days)], "ts timestamp, days int")
    for number, days in enumerate([[1, 2, 3], [5, 0], [4, 6], []]):
        batch = spark.createDataFrame([event(d) for d in days], "event_id long, ts timestamp")
        log.write(batch, number)
        if number == 1:
            log.write(batch, number)
    held = lambda: sorted(r["event_id"] for r in log.rows().collect())
    folders = lambda: sorted(d for _, dirs, _ in os.walk(tmp_path / "log") for d in dirs if d.startswith("day="))
    assert held() == [1, 2, 3, 4, 5, 6]
    log.set(setting(2, 4), 0)
    assert held() == [2, 3, 4, 5, 6] and folders()[0] == "day=2024-03-02"
    log.set(setting(3, 2), 1)
    log.set(setting(1, 50), 2)  # an older setting does not hold
    assert held() == [4, 5, 6] and len(folders()) == 3
    assert len(os.listdir(tmp_path / "log" / "newest")) <= 2
    log.set(setting(9, 0), 3)
    assert held() == [4, 5, 6] and log.bound() is None


def test_tail_stream_reads_a_folder_of_files(spark, tmp_path):
    from scrivener.plans import QUERIES

    rows = [(k, [0.01 * (k + 1)] * 64) for k in range(20)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["clip_id"]: r["bars"] for r in QUERIES["st3_tail_stream"](spark, str(tmp_path)).collect()}
    assert got == {r["clip_id"]: r["bars"] for r in QUERIES["a8_amplitude_bars"](spark, str(tmp_path)).collect()} and len(got) == 20


def test_ranges_of_the_limit_grow_in_number_not_in_rows(spark, monkeypatch):
    seen, kept = [], L.stored
    monkeypatch.setattr(L, "RANGE_ROWS", 100)
    monkeypatch.setattr(L, "stored", lambda df, name: seen.append(kept(df, name)) or seen[-1])
    rows = made(2000, 90_000, ["sent"])
    got = sorted(r["event_id"] for r in L.limited(spark.createDataFrame(rows, EVENTS).filter("event_type is not null")).collect())
    sizes = [r["count"] for r in seen[0].groupBy("range").count().collect()]
    assert max(sizes) <= 300 and got == accepted_by_hand(rows, per_user=False)


def test_a_batch_is_one_entry_of_a_keys_buffer():
    import pandas as pd

    class Held(list):
        appendValue = list.append
        appendList = list.extend

    class Value:
        get = update = lambda self, *x: None

    class Handle:
        buffer = Held()
        getListState = lambda self, *x: self.buffer
        getValueState = lambda self, *x: Value()
        registerTimer = deleteTimer = lambda self, ms: None

    machine = O.InOrder(R.States(), [])
    machine.init(Handle())
    frame = pd.DataFrame({"at_": range(100), "event_id": range(100), "event_": ["start"] * 100})
    list(machine.handleInputRows((1,), iter([frame, frame]), None))
    assert len(Handle.buffer) == 1


def test_numbered_frames_in_any_batches_are_the_fold_of_their_clip(spark, tmp_path):
    """Frames ahead of their turn wait, those that come again are dropped, a closed clip leaves nothing open."""
    import json

    rng = random.Random(6)
    clips = {name: [[rng.uniform(-0.1, 0.1) for _ in range(rng.choice([0, 1, 47, 700, 3000]))] for _ in range(n)] for name, n in (("a", 9), ("b", 1), ("c", 14), (None, 5))}
    rows = [(name, 7, k, f, k == len(clips[name]) - 1 and name != "c") for name in clips for k, f in enumerate(clips[name])]
    dealt = sorted(rows, key=lambda r: r[2] + rng.uniform(0, 5))
    batches = [dealt[:8], dealt[8:9], [], dealt[9:20], dealt[20:]]
    batches[2] = [r for r in dealt[:9] if r[0] == "c"]
    write = FR.tails(f"{tmp_path}/out")
    for number, batch in enumerate(batches):
        for _ in range(2 if number == 3 else 1):
            write(spark.createDataFrame(batch, "clip string, clip_id long, frame long, samples array<double>, last boolean"), number)
    got = {(r["clip"], r["frame"]): r for r in FR.shown(spark, f"{tmp_path}/out").collect()}
    assert FR.shown(spark, f"{tmp_path}/out").count() == len(got) == len(rows)
    for name, frames in clips.items():
        _, expected = O.advanced(R.Tail(), R.Tail().start(), [(k, k, json.dumps(f)) for k, f in enumerate(frames)])
        assert all(got[name, k]["n"] == n and np.allclose(got[name, k]["bars"], bars, atol=1e-12) and got[name, k]["clip_id"] == 7 for k, _, n, bars in expected)
    (left,) = spark.read.parquet(f"{tmp_path}/out/batch=4").filter("kind <> 'bars'").collect()
    assert (left["clip"], left["kind"], left["frame"], len(left["samples"])) == ("c", FR.BUFFER, 13, min(8000, sum(map(len, clips["c"]))))


def test_loudness_sums_as_the_table_does(spark):
    from scrivener.operators import audio as A

    rng = random.Random(9)
    clips = [(k, [rng.gauss(0, 0.05) for _ in range(n)]) for k, n in enumerate([0, 1, 47, 48, 95, 96, 100, 7999, 8000])] + [(9, [float("nan"), 0.01])]
    bars = spark.createDataFrame(clips, "k int, samples array<double>").select("k", A.amplitude_bars(F.col("samples")).alias("bars")).collect()
    assert all(FR.loudness(np.array(clips[r["k"]][1])).tolist() == r["bars"] for r in bars)


def test_tail_stream_of_odd_rows_as_the_sql_says(spark, tmp_path):
    """Ids that repeat, no id, no samples; no watermark holds clips back in a state store."""
    import duckdb

    from scrivener.plans import ORACLES, QUERIES

    rows = [(5, [0.01] * 64), (5, [0.02] * 64), (169, [0.03, -0.01] * 32), (7, []), (8, None), (None, [0.01] * 64), (0, [0.5] * 3)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    expected = con.execute(f"select clip_id, bars from ({ORACLES['st3_tail_stream']})").fetchall()
    got = [(r["clip_id"], list(r["bars"])) for r in QUERIES["st3_tail_stream"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(((k, list(b)) for k, b in expected), key=str) and len(got) == 7
