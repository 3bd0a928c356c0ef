"""What surrounds dictation: announcements, settings, hotkeys, feedback, logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivener.functions.text import trimmed
from scrivener.functions.version import version_in_range

# Synced settings, retired models, hotkey names and orders, log phrases, error codes.
SYNCED = [
    "hotkey", "launchAtLogin", "playSoundOnComplete", "autoDismissOverlay", "smartFormatting", "inputDevice", "model", "onboardingComplete",
    "aiCleanup", "beamSearch", "toneMode", "overlayPosition", "showPassiveOverlay", "historyRetentionDays", "helpImprove",
]
RETIRED_MODELS, DEFAULT_MODEL = ["tiny", "base", "small", "medium"], "parakeet-tdt-0.6b"
OLD_KEYS = {
    "Ctrl": "ControlLeft", "Control": "ControlLeft", "Cmd": "MetaLeft", "Command": "MetaLeft", "Meta": "MetaLeft", "Super": "MetaLeft", "Shift": "ShiftLeft",
    "Option": "Alt", "Return": "Enter", "Esc": "Escape", "Up": "ArrowUp", "Down": "ArrowDown", "Left": "ArrowLeft", "Right": "ArrowRight",
}
KEY_LABELS = {
    "ControlLeft": "Ctrl", "ControlRight": "Ctrl", "ShiftLeft": "Shift", "ShiftRight": "Shift", "AltLeft": "Alt", "AltRight": "Alt", "MetaLeft": "Win", "MetaRight": "Win",
    "Fn": "fn", "ArrowUp": "Up", "ArrowDown": "Down", "ArrowLeft": "Left", "ArrowRight": "Right", "Backquote": "`", "Minus": "-", "Equal": "=", "BracketLeft": "[",
    "BracketRight": "]", "Semicolon": ";", "Quote": "'", "Backslash": "\\", "IntlBackslash": "\\", "Comma": ",", "Period": ".", "Slash": "/", "CmdOrCtrl": "Ctrl",
}
MODIFIERS = ["ControlLeft", "ControlRight", "AltLeft", "AltRight", "ShiftLeft", "ShiftRight", "MetaLeft", "MetaRight"]
PRIVATE_LOGS = ["After regex", "Parakeet chunk", "LLM cleanup:", "After AI cleanup", "clipboard", "dictionary"]
LONG_VALUE, SCRUBBED = 200, "[scrubbed — value too long]"
ERROR_CODES = ["model_not_loaded", "mic_not_found", "mic_permission", "transcription_failed", "injection_failed"]
FEEDBACK_BYTES = 2000


def unseen(announcements: DataFrame, seen: DataFrame) -> DataFrame:
    return announcements.join(seen.select("id").distinct(), "id", "left_anti")


def for_version(announcements: DataFrame, version: Column) -> DataFrame:
    return announcements.filter(version_in_range(version, F.col("min_version"), F.col("max_version")))


def to_show(announcements: DataFrame, seen: DataFrame, version: Column) -> DataFrame:
    """The first announcement (by `ord`) that is for this version and not seen."""
    return for_version(unseen(announcements, seen), version).orderBy("ord").limit(1)


def marked_seen(seen: DataFrame, ids: DataFrame) -> DataFrame:
    return seen.select("id").union(ids.select("id")).distinct()


def without_private_logs(logs: DataFrame, message: str = "message") -> DataFrame:
    """Log rows that quote no dictated text; those without a message stay."""
    phrases = F.array(*[F.lit(p) for p in PRIVATE_LOGS])
    return logs.filter(~F.coalesce(F.exists(phrases, lambda p: F.contains(F.col(message), p)), F.lit(False)))


def scrubbed(value: Column) -> Column:
    return F.when(F.octet_length(value) > LONG_VALUE, SCRUBBED).otherwise(value)


def valid_feedback(text: Column) -> Column:
    """Trimmed feedback text, null where it is empty or too long."""
    t = trimmed(text)
    return F.when((t != "") & (F.octet_length(t) <= FEEDBACK_BYTES), t)


def without_index(rows: DataFrame, at: int) -> DataFrame:
    """A list without its item `at`; the places behind it move up."""
    return rows.filter(F.col("ord") != at).withColumn("ord", F.when(F.col("ord") > at, F.col("ord") - 1).otherwise(F.col("ord")))


def with_index(rows: DataFrame, at: int, **values: str) -> DataFrame:
    """A list with fields of its item `at` replaced."""
    return reduce(lambda df, x: df.withColumn(x[0], F.when(F.col("ord") == at, x[1]).otherwise(F.col(x[0]))), values.items(), rows)


def addable(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Rows with both fields trimmed, if neither is then empty."""
    return rows.withColumns({a: trimmed(F.col(a)), b: trimmed(F.col(b))}).filter((F.col(a) != "") & (F.col(b) != ""))


def changed_keys(before: DataFrame, after: DataFrame, keys: list[str], on: str) -> DataFrame:
    """(on, changed): the keys whose values differ between two states, null-safe."""
    both = before.select(on, F.struct(*keys).alias("b_")).join(after.select(on, F.struct(*keys).alias("a_")), on)
    flags = F.array(*[F.when(~F.col(f"b_.{k}").eqNullSafe(F.col(f"a_.{k}")), F.lit(k)) for k in keys])
    return both.select(on, F.array_compact(flags).alias("changed"))


def patched(base: Column, patch: Column) -> Column:
    """A map with another's entries put over it."""
    kept = F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(patch), k))
    return F.map_concat(kept, patch)


def migrated_model(model: Column) -> Column:
    return F.when(model.isin(RETIRED_MODELS), DEFAULT_MODEL).otherwise(model)


def migrated_hotkey(hotkey: Column, mac: bool = False) -> Column:
    """Old shortcut names as key codes; a hotkey without an old name stays as it is."""
    has = lambda x: F.contains(hotkey, F.lit(x))
    old = has("Cmd") | (has("Ctrl") & ~has("Control")) | (has("Shift") & ~has("ShiftLeft") & ~has("ShiftRight")) | (has("Alt") & ~has("AltGr"))

    def key(part: Column) -> Column:
        p = trimmed(part)
        named = F.when(p == "CmdOrCtrl", "MetaLeft" if mac else "ControlLeft")
        named = reduce(lambda c, x: c.when(p == x[0], x[1]), OLD_KEYS.items(), named)
        return named.when(F.rlike(p, F.lit("^[A-Za-z]$")), F.concat(F.lit("Key"), F.upper(p))).otherwise(p)

    return F.when(old, F.array_join(F.transform(F.split(hotkey, r"\+", -1), key), "+")).otherwise(hotkey)


def key_label(code: Column) -> Column:
    c = F.when(F.rlike(code, F.lit("^Key.$")), F.substring(code, 4, 1)).when(F.rlike(code, F.lit("^Digit.$")), F.substring(code, 6, 1))
    return reduce(lambda e, x: e.when(code == x[0], x[1]), KEY_LABELS.items(), c).otherwise(code)


def hotkey_labels(hotkey: Column) -> Column:
    return F.transform(F.split(hotkey, r"\+", -1), lambda c: key_label(trimmed(c)))


def ordered_keys(codes: Column) -> Column:
    """Distinct codes, modifiers first in their fixed order, the others alphabetically."""
    fixed = F.array(*[F.lit(m) for m in MODIFIERS])
    keyed = F.transform(F.array_distinct(codes), lambda c: F.struct(F.when(F.array_contains(fixed, c), F.array_position(fixed, c)).otherwise(len(MODIFIERS) + 1).alias("rank"), c.alias("code")))
    return F.transform(F.sort_array(keyed), lambda k: k["code"])


def error_code(message: Column) -> Column:
    """The known code that a message names, else `unknown`."""
    first = F.when(F.contains(message, F.lit(ERROR_CODES[0])), ERROR_CODES[0])
    return reduce(lambda e, c: e.when(F.contains(message, F.lit(c)), c), ERROR_CODES[1:], first).otherwise("unknown")


def device_error(message: Column) -> Column:
    absent = F.contains(message, F.lit("No default input")) | F.contains(message, F.lit("Device not found"))
    return F.when(absent, "mic_not_found").otherwise("mic_permission")


#: The recorder's states and what leads from one to the next.
TRANSITIONS = {("Idle", "start"): "Recording", ("Recording", "stop"): "Processing", ("Processing", "polish"): "Polishing", ("Processing", "done"): "Idle", ("Polishing", "done"): "Idle", ("Recording", "error"): "Idle", ("Processing", "error"): "Idle", ("Polishing", "error"): "Idle"}


def next_state(state: Column, event: Column) -> Column:
    """The recorder's state after an event; events that do not apply change nothing."""
    (first, then), *rest = TRANSITIONS.items()
    c = F.when((state == first[0]) & (event == first[1]), then)
    return reduce(lambda e, x: e.when((state == x[0][0]) & (event == x[0][1]), x[1]), rest, c).otherwise(state)


#: All states, the first one first.
STATES = ["Idle", "Recording", "Processing", "Polishing"]


def state_map(events: Column) -> Column:
    """The state after the ordered `events`, for each of `STATES` as the state before."""
    return F.aggregate(events, F.array(*map(F.lit, STATES)), lambda acc, e: F.transform(acc, lambda s: next_state(s, e)))


def state_after(maps: Column) -> Column:
    """The state after the ordered `maps`, from the first of `STATES`."""
    places = F.array(*map(F.lit, STATES))
    return F.aggregate(maps, F.lit(STATES[0]), lambda s, m: F.element_at(m, F.array_position(places, s).cast("int")))


def is_safe_name(name: Column) -> Column:
    """Whether a file name stays within its folder."""
    return ~(F.contains(name, F.lit("..")) | F.contains(name, F.lit("/")) | F.contains(name, F.lit("\\")))
