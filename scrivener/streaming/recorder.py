"""The recorder as folds over its events: recordings with their time limit, states with the queued
stop and the reset of a stale start, accepted feedback."""

from __future__ import annotations

import json
from collections.abc import Iterable

from scrivener.operators.app import STATES, TRANSITIONS
from scrivener.operators.audio import BAR_SCALE, BAR_WINDOW, BARS

from .ordered import Fold

SECOND = 1_000_000
#: Seconds after which a recording is stopped, a start counts as stuck, feedback is taken again.
LIMIT, STALE, FEEDBACK_GAP = 600, 5, 300
#: Samples a second, refreshes of the display a second.
RATE, HERTZ = 16_000, 60


class Recordings(Fold):
    """A recording runs from a `start` to the next `stop`, at most `limit` seconds from its start. A start
    while one runs changes nothing. Every recording has a generation; the timer is the running one's."""

    schema = "generation bigint, start_us bigint, end_us bigint, timed_out boolean"

    def __init__(self, limit: int = LIMIT):
        self.limit = limit * SECOND

    def start(self):
        return [0, None]  # generation, start

    def step(self, state, ts: int, event_id: int, event: str) -> tuple[object, Iterable[tuple]]:
        generation, began = state
        if event == "start" and began is None:
            return [generation + 1, ts], ()
        if event == "stop" and began is not None:
            return [generation, None], [(generation, began, ts, False)]
        return state, ()

    def due(self, state) -> int | None:
        return None if state[1] is None else state[1] + self.limit

    def timed(self, state, ts: int) -> tuple[object, Iterable[tuple]]:
        generation, began = state
        return [generation, None], [(generation, began, ts, True)]


class Recorder(Fold):
    """The states of hold-to-record, a row for each change. `press` starts (state Recording, busy until
    `started`), `release` stops (Processing, busy until `done`); a release while busy is queued and is done
    when the start has finished. A press finds a recorder that has been busy for over five seconds free
    again. `polish` leads from Processing to Polishing, `done` and `error` to Idle. A recording that is
    still running `limit` seconds after its start is released by its timer."""

    schema = "event_id bigint, at_us bigint, state string, generation bigint"

    def __init__(self, limit: int = LIMIT, stale: int = STALE):
        self.limit, self.stale = limit * SECOND, stale * SECOND

    def start(self):
        return {"state": "Idle", "generation": 0, "until": None, "busy": None, "queued": False}

    def _to(self, s: dict, state: str, ts: int, event_id: int | None) -> list[tuple]:
        s["state"] = state
        if state != "Recording":
            s["until"] = None
        return [(event_id, ts, state, s["generation"])]

    def _release(self, s: dict, ts: int, event_id: int | None) -> list[tuple]:
        if s["busy"] is not None:
            s["queued"] = True
            return []
        if s["state"] != "Recording":
            return []
        s["busy"] = ts
        return self._to(s, "Processing", ts, event_id)

    def step(self, state, ts: int, event_id: int, event: str) -> tuple[object, Iterable[tuple]]:
        s = dict(state)
        if event == "press":
            if s["busy"] is not None and ts - s["busy"] > self.stale:
                s["busy"] = None
            if s["busy"] is not None or s["state"] != "Idle":
                return s, ()
            s |= {"generation": s["generation"] + 1, "until": ts + self.limit, "busy": ts, "queued": False}
            return s, self._to(s, "Recording", ts, event_id)
        if event == "started" and s["state"] == "Recording":
            s["busy"] = None
            if s["queued"]:
                s["queued"] = False
                return s, self._release(s, ts, event_id)
        elif event == "release":
            return s, self._release(s, ts, event_id)
        elif event == "polish" and s["state"] == "Processing":
            return s, self._to(s, "Polishing", ts, event_id)
        elif event == "done" and s["state"] in ("Processing", "Polishing") or event == "error" and s["state"] != "Idle":
            s["busy"] = None
            return s, self._to(s, "Idle", ts, event_id)
        return s, ()

    def due(self, state) -> int | None:
        return state["until"]

    def timed(self, state, ts: int) -> tuple[object, Iterable[tuple]]:
        s = dict(state) | {"until": None}
        return s, self._release(s, ts, None)


class Accepted(Fold):
    """Events at least `gap` seconds after the last one that was accepted."""

    schema = "event_id bigint, at_us bigint"

    def __init__(self, gap: int = FEEDBACK_GAP):
        self.gap = gap * SECOND

    def step(self, state, ts: int, event_id: int, event: str) -> tuple[object, Iterable[tuple]]:
        if state is not None and ts - state < self.gap:
            return state, ()
        return ts, [(event_id, ts)]


class States(Fold):
    """The recorder's plain states (no timers, nothing queued): a row an event, with the state after it
    and the number of events so far."""

    schema = "event_id bigint, at_us bigint, state string, n bigint"

    def start(self):
        return [STATES[0], 0]

    def step(self, state, ts: int, event_id: int, event: str) -> tuple[object, Iterable[tuple]]:
        now, n = TRANSITIONS.get((state[0], event), state[0]), state[1] + 1
        return [now, n], [(event_id, ts, now, n)]


class Refreshes(Fold):
    """Of a clip's frames (an event is its number of samples) those at which a display of `hertz` is
    refreshed: when `rate / hertz` samples have come since the last time."""

    schema = "event_id bigint, at_us bigint"

    def __init__(self, hertz: int = HERTZ, rate: int = RATE):
        self.every = rate // hertz

    def start(self):
        return 0

    def step(self, state, ts: int, event_id: int, event: str) -> tuple[object, Iterable[tuple]]:
        held = state + int(event)
        return (0, [(event_id, ts)]) if held >= self.every else (held, ())


class Tail(Fold):
    """A clip's buffer as its last `window` samples, however long it runs: an event is a frame's samples as a
    JSON array; each gives the loudness of `bars` equal slices of the buffer, 0 to 1 (what
    `audio.amplitude_bars` gives of all samples so far), and how many samples have come."""

    schema = "event_id bigint, at_us bigint, samples bigint, bars array<double>"

    def __init__(self, window: int = BAR_WINDOW, bars: int = BARS, scale: float = BAR_SCALE):
        self.window, self.bars, self.scale = window, bars, scale

    def start(self):
        return [0, []]

    def step(self, state, ts: int, event_id: int, event: str) -> tuple[object, Iterable[tuple]]:
        frame = json.loads(event)
        n, tail = state[0] + len(frame), [*state[1], *frame][-self.window :]
        each = max(len(tail) // self.bars, 1)
        slices = [tail[i * each : (i + 1) * each] for i in range(self.bars)]
        loud = [min((sum(x * x for x in s) / len(s)) ** 0.5 * self.scale, 1.0) if s else 0.0 for s in slices]
        return [n, tail], [(event_id, ts, n, loud)]
