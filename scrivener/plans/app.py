"""Queries of announcements, settings, hotkeys, feedback and logs, over rows made of `events` and `benchmark`."""

from __future__ import annotations

from pyspark.sql import functions as F

from scrivener.functions.version import version_in_range
from scrivener.operators import app as P

from . import history as hist
from .registry import query, table

VERSIONS = ["1.2.0", "1.9.3", "2.0.1", "dev"]


def lit(x) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


#: Expressions that Spark and the SQL beside it read alike: an event as an announcement, for some versions.
ANNOUNCEMENT = {
    "ord": "event_id",
    "id": "'a' || event_id",
    "min_version": "CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'one' ELSE (event_id % 3) || '.' || (event_id % 11) || '.' || (event_id % 7) END",
    "max_version": "CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'x.y' ELSE (event_id % 3) || '.' || (event_id % 13) || '.0' END",
}


def made_sql(columns: dict[str, str], of: str = "events") -> str:
    return "SELECT " + ", ".join(f"{e} AS {c}" for c, e in columns.items()) + f" FROM {of}"


def made(spark, sf_dir, columns: dict[str, str], of: str = "events"):
    return table(spark, sf_dir, of).select(*[F.expr(e).alias(c) for c, e in columns.items()])


ANNOUNCED = f"WITH a AS ({made_sql(ANNOUNCEMENT)}), seen(id) AS (SELECT 'a' || event_id FROM events WHERE event_type IN ('click', 'view') UNION ALL SELECT 'a' || event_id FROM events WHERE event_type = 'view' UNION ALL SELECT 'gone'), v(app) AS (VALUES " + ", ".join(f"({lit(v)})" for v in VERSIONS) + r"), parts AS (SELECT *, CASE WHEN regexp_matches(app, '^\d+\.\d+\.\d+$') THEN list_transform(string_split(app, '.'), lambda x: CAST(x AS INT)) END AS pv, CASE WHEN regexp_matches(min_version, '^\d+\.\d+\.\d+$') THEN list_transform(string_split(min_version, '.'), lambda x: CAST(x AS INT)) END AS pa, CASE WHEN regexp_matches(max_version, '^\d+\.\d+\.\d+$') THEN list_transform(string_split(max_version, '.'), lambda x: CAST(x AS INT)) END AS pb FROM a, v), ok AS (SELECT *, pv IS NULL OR (coalesce(pv >= pa, true) AND coalesce(pv <= pb, true)) AS fits FROM parts)"


def announcements(spark, sf_dir):
    return made(spark, sf_dir, ANNOUNCEMENT)


def seen(spark, sf_dir):
    """Announcements that some have been shown, one that is gone, and repeats."""
    of = lambda kinds: table(spark, sf_dir, "events").filter(F.col("event_type").isin(kinds)).select(F.expr(ANNOUNCEMENT["id"]).alias("id"))
    return of(["click", "view"]).unionByName(of(["view"])).unionByName(spark.createDataFrame([("gone",)], "id string"))


@query(ANNOUNCED + " SELECT id FROM a ANTI JOIN seen USING (id)")
def j2_unseen(spark, sf_dir):
    return P.unseen(announcements(spark, sf_dir), seen(spark, sf_dir)).select("id")


@query(ANNOUNCED + " SELECT id, ord FROM a WHERE id NOT IN (SELECT id FROM seen)")
def f7_not_seen(spark, sf_dir):
    return P.unseen(announcements(spark, sf_dir), seen(spark, sf_dir)).select("id", "ord")


@query(ANNOUNCED + " SELECT id FROM ok WHERE app = '1.9.3' AND fits")
def f8_version_range(spark, sf_dir):
    return P.for_version(announcements(spark, sf_dir), F.lit("1.9.3")).select("id")


@query(ANNOUNCED + " SELECT app, id FROM ok WHERE fits")
def j9_versions_by_range(spark, sf_dir):
    apps = F.broadcast(spark.createDataFrame([(v,) for v in VERSIONS], "app string"))
    return announcements(spark, sf_dir).join(apps, version_in_range(F.col("app"), F.col("min_version"), F.col("max_version"))).select("app", "id")


@query(ANNOUNCED + " SELECT id FROM a ORDER BY ord LIMIT 1")
def o8_first_announcement(spark, sf_dir):
    return announcements(spark, sf_dir).orderBy("ord").limit(1).select("id")


@query(ANNOUNCED + " SELECT id FROM ok ANTI JOIN seen USING (id) WHERE app = '1.9.3' AND fits ORDER BY ord LIMIT 1")
def m1_announcement_to_show(spark, sf_dir):
    return P.to_show(announcements(spark, sf_dir), seen(spark, sf_dir), F.lit("1.9.3")).select("id")


@query(ANNOUNCED + " SELECT id FROM seen UNION SELECT 'a' || event_id FROM events WHERE event_type IN ('view', 'signup')")
def io13_mark_seen(spark, sf_dir):
    now = table(spark, sf_dir, "events").filter(F.col("event_type").isin(["view", "signup"])).select(F.expr(ANNOUNCEMENT["id"]).alias("id"))
    return P.marked_seen(seen(spark, sf_dir), now)


LOGS = "WITH l AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'After regex: ' || event_type WHEN 1 THEN 'copied to clipboard' WHEN 2 THEN NULL ELSE 'took ' || value END AS message, repeat('é', CAST(event_id % 210 AS INT)) AS detail FROM events)"


def logs(spark, sf_dir):
    k = F.col("event_id") % 5
    message = F.when(k == 0, F.concat(F.lit("After regex: "), "event_type")).when(k == 1, "copied to clipboard").when(k > 2, F.concat(F.lit("took "), F.col("value").cast("string")))
    return table(spark, sf_dir, "events").select("event_id", message.alias("message"), F.repeat(F.lit("é"), (F.col("event_id") % 210).cast("int")).alias("detail"))


@query(LOGS + " SELECT event_id, CASE WHEN octet_length(encode(detail)) > 200 THEN '[scrubbed — value too long]' ELSE detail END AS detail FROM l WHERE message IS NULL OR NOT (contains(message, 'After regex') OR contains(message, 'clipboard') OR contains(message, 'dictionary'))")
def f18_log_redaction(spark, sf_dir):
    return P.without_private_logs(logs(spark, sf_dir)).select("event_id", P.scrubbed(F.col("detail")).alias("detail"))


FEEDBACK = "WITH f AS (SELECT item_id, CASE item_id % 5 WHEN 0 THEN '  ' || chr(10) WHEN 1 THEN repeat(text, CAST(2000 // octet_length(encode(text)) + 1 AS BIGINT)) WHEN 2 THEN text || repeat('ü', CAST(greatest(0, 2000 - octet_length(encode(text))) // 2 AS BIGINT)) || ' ' WHEN 3 THEN chr(10) || text || chr(10) ELSE ' ' || text END AS text FROM benchmark), t AS (SELECT item_id, trim(text, ' ' || chr(10)) AS text FROM f)"


def feedback(spark, sf_dir):
    """The whole texts of `benchmark` as feedback: blank, too long by repeating, just short enough, padded."""
    k, size = F.col("item_id") % 5, F.octet_length("text")
    long = F.repeat("text", (F.floor(F.lit(2000) / size) + 1).cast("int"))
    filled = F.concat("text", F.repeat(F.lit("ü"), F.floor(F.greatest(F.lit(0), F.lit(2000) - size) / 2).cast("int")), F.lit(" "))
    text = F.when(k == 0, "  \n").when(k == 1, long).when(k == 2, filled).when(k == 3, F.concat(F.lit("\n"), "text", F.lit("\n"))).otherwise(F.concat(F.lit(" "), "text"))
    return table(spark, sf_dir, "benchmark").select("item_id", text.alias("text"))


@query(FEEDBACK + " SELECT item_id, text FROM t WHERE text <> '' AND octet_length(encode(text)) <= 2000")
def f19_valid_feedback(spark, sf_dir):
    return feedback(spark, sf_dir).select("item_id", P.valid_feedback(F.col("text")).alias("text")).filter("text is not null")


@query(FEEDBACK + ", h AS (SELECT count(*) AS n, CAST(floor(epoch(TIMESTAMP '2024-01-30 12:00:00' - arg_min(ts, event_id)) / 86400) AS BIGINT) AS d FROM events), s AS (SELECT item_id, text, item_id * 100 AS sec FROM t WHERE text <> '' AND octet_length(encode(text)) <= 2000), r AS (SELECT list_reduce(list([sec] ORDER BY sec), lambda a, x: CASE WHEN x[1] - a[len(a)] >= 300 THEN list_concat(a, x) ELSE a END) AS ok FROM s) SELECT item_id, text, n AS dictations, d AS age_days FROM s, h, r WHERE list_contains(ok, sec)")
def m4_feedback_payloads(spark, sf_dir):
    sent = feedback(spark, sf_dir).select("item_id", P.valid_feedback(F.col("text")).alias("text")).filter("text is not null")
    from scrivener.operators.history import usage
    from scrivener.streaming.limits import limited

    events = sent.select(F.lit(0).cast("long").alias("user_id"), F.col("item_id").alias("event_id"), F.timestamp_seconds(F.col("item_id") * 100).alias("ts"))
    accepted = limited(events).select(F.col("event_id").alias("item_id"))
    context = usage(hist.history(spark, sf_dir), hist.now())
    return sent.join(accepted, "item_id", "left_semi").crossJoin(F.broadcast(context)).select("item_id", "text", F.col("entries").alias("dictations"), "age_days")


#: An event as a dictionary entry: padded, empty and blank fields among others.
ENTRY = {
    "ord": "event_id",
    "a": "CASE event_id % 5 WHEN 1 THEN ' ' || event_type || '  ' WHEN 2 THEN '' ELSE event_type END",
    "b": "CASE event_id % 7 WHEN 3 THEN '   ' WHEN 4 THEN ' ' || coalesce(props, '') ELSE coalesce(props, '') END",
}
LIST = f"WITH d AS ({made_sql(ENTRY)})"


@query(LIST + " SELECT CASE WHEN ord > 1 THEN ord - 1 ELSE ord END AS ord, a, CASE WHEN ord = 4 THEN 'ZED' ELSE b END AS b FROM d WHERE ord <> 1")
def f20_list_edits(spark, sf_dir):
    return P.without_index(P.with_index(made(spark, sf_dir, ENTRY), 4, b="ZED"), 1)


@query(LIST + " SELECT ord, trim(a) AS a, trim(b) AS b FROM d WHERE trim(a) <> '' AND trim(b) <> ''")
def f23_addable_entries(spark, sf_dir):
    return P.addable(made(spark, sf_dir, ENTRY), "a", "b")


#: A setting before and after an event.
STATES = {
    "hotkey": ("event_type", "CASE event_id % 3 WHEN 0 THEN 'click' ELSE event_type END"),
    "model": ("CASE event_id % 4 WHEN 0 THEN NULL ELSE 'base' END", "CASE event_id % 8 WHEN 0 THEN NULL WHEN 1 THEN 'small' ELSE 'base' END"),
    "inputDevice": ("user_id || ''", "CASE event_id % 5 WHEN 0 THEN NULL ELSE user_id || '' END"),
    "toneMode": ("CAST(NULL AS CHAR(1))", "CAST(NULL AS CHAR(1))"),
    "helpImprove": ("'true'", "CASE event_id % 2 WHEN 0 THEN NULL ELSE 'true' END"),
}


@query("SELECT event_id AS id, list_filter([" + ", ".join(f"CASE WHEN ({a}) IS DISTINCT FROM ({b}) THEN '{k}' END" for k, (a, b) in STATES.items()) + "], lambda x: x IS NOT NULL) AS changed FROM events")
def e7_changed_keys(spark, sf_dir):
    before, after = (made(spark, sf_dir, {"id": "event_id"} | {k: e[side] for k, e in STATES.items()}) for side in (0, 1))
    return P.changed_keys(before, after, list(STATES), "id")


#: Hotkeys as users have set them over the years, with an event's first letter, and the model of that time.
HOTKEYS = ["CmdOrCtrl+Shift+Space", "ControlLeft+ShiftLeft+Space", "Ctrl+Alt+k", "Cmd+Up", "Fn", "Shift+F5", "AltGr+x", " Ctrl + Return ", "KeyA", "ControlRight+Digit7", "Control+Option+,", "Super+Esc"]
SETTINGS = {
    "event_id": "event_id",
    "hotkey": f"CASE event_id % {len(HOTKEYS)} " + " ".join(f"WHEN {k} THEN {lit(h)}" for k, h in enumerate(HOTKEYS)) + " END || CASE user_id % 3 WHEN 0 THEN '' WHEN 1 THEN '+' || substr(event_type, 1, 1) ELSE '+Left' END",
    "model": "CASE event_id % 6 WHEN 0 THEN 'tiny' WHEN 1 THEN 'base' WHEN 2 THEN 'small' WHEN 3 THEN 'medium' WHEN 4 THEN event_type ELSE 'Qwen3-' || user_id END",
}
CASES = lambda of: " ".join(f"WHEN {lit(a)} THEN {lit(b)}" for a, b in of.items())
_OLD = "contains(hotkey, 'Cmd') OR contains(hotkey, 'Ctrl') AND NOT contains(hotkey, 'Control') OR contains(hotkey, 'Shift') AND NOT contains(hotkey, 'ShiftLeft') AND NOT contains(hotkey, 'ShiftRight') OR contains(hotkey, 'Alt') AND NOT contains(hotkey, 'AltGr')"
_KEY = f"CASE trim(p) WHEN 'CmdOrCtrl' THEN 'ControlLeft' {CASES(P.OLD_KEYS)} ELSE CASE WHEN regexp_matches(trim(p), '^[A-Za-z]$') THEN 'Key' || upper(trim(p)) ELSE trim(p) END END"
_LABEL = f"CASE WHEN regexp_matches(trim(c), '^Key.$') THEN substr(trim(c), 4, 1) WHEN regexp_matches(trim(c), '^Digit.$') THEN substr(trim(c), 6, 1) ELSE CASE trim(c) {CASES(P.KEY_LABELS)} ELSE trim(c) END END"
SET = f"WITH s AS ({made_sql(SETTINGS)}), m AS (SELECT *, CASE WHEN {_OLD} THEN array_to_string(list_transform(string_split(hotkey, '+'), lambda p: {_KEY}), '+') ELSE hotkey END AS migrated FROM s)"


@query(SET + " SELECT event_id, hotkey, migrated FROM m")
def s19_migrated_hotkeys(spark, sf_dir):
    return made(spark, sf_dir, SETTINGS).select("event_id", "hotkey", P.migrated_hotkey(F.col("hotkey")).alias("migrated"))


@query(SET + f" SELECT DISTINCT migrated AS hotkey, array_to_string(list_transform(string_split(migrated, '+'), lambda c: {_LABEL}), '+') AS labels FROM m")
def s18_hotkey_labels(spark, sf_dir):
    rows = made(spark, sf_dir, SETTINGS).select(P.migrated_hotkey(F.col("hotkey")).alias("hotkey")).distinct()
    return rows.select("hotkey", F.array_join(P.hotkey_labels(F.col("hotkey")), "+").alias("labels"))


@query(SET + " SELECT event_id, model, CASE WHEN model IN ('tiny', 'base', 'small', 'medium') THEN 'parakeet-tdt-0.6b' ELSE model END AS migrated FROM s")
def s20_migrated_models(spark, sf_dir):
    return made(spark, sf_dir, SETTINGS).select("event_id", "model", P.migrated_model(F.col("model")).alias("migrated"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'tiny' ELSE 'dark' END AS model0, CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 2 = 0 THEN 'tiny' ELSE 'dark' END AS model, CASE WHEN event_id % 3 = 0 THEN 'yes' END AS added FROM events")
def s21_settings_patch(spark, sf_dir):
    base = F.create_map(F.lit("model"), F.when(F.col("event_id") % 2 == 0, "tiny").otherwise("dark"))
    patch = F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("model"), "event_type", F.lit("added"), F.lit("yes"))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    rows = table(spark, sf_dir, "events").select("event_id", base["model"].alias("model0"), P.patched(base, patch).alias("m"))
    return rows.select("event_id", "model0", F.try_element_at("m", F.lit("model")).alias("model"), F.try_element_at("m", F.lit("added")).alias("added"))


@query(SET + " SELECT event_id, migrated AS hotkey, CASE WHEN model IN ('tiny', 'base', 'small', 'medium') THEN 'parakeet-tdt-0.6b' ELSE model END AS model FROM m")
def m2_migrated_settings(spark, sf_dir):
    rows = made(spark, sf_dir, SETTINGS)
    return rows.select("event_id", P.migrated_hotkey(F.col("hotkey")).alias("hotkey"), P.migrated_model(F.col("model")).alias("model"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 AND event_type <> 'click' THEN ['mode'] ELSE CAST([] AS VARCHAR[]) END AS changed FROM events")
def m3_patch_and_diff(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.lit("click").alias("mode"), "event_type")
    base = F.create_map(F.lit("mode"), F.col("mode"))
    patch = F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("mode"), F.col("event_type"))).otherwise(base)
    after = rows.select("event_id", P.patched(base, patch)["mode"].alias("mode"))
    return P.changed_keys(rows, after, ["mode"], "event_id")


#: Keys that are held down, from a place that an event gives and as many as another.
HELD = ["KeyB", "ShiftLeft", "AltLeft", "KeyA", "ControlLeft", "KeyA", "MetaLeft", "Space", "ShiftRight", "ControlRight"]
_HELD, _MODS = (f"[{', '.join(map(lit, x))}]" for x in (HELD * 2, P.MODIFIERS))


@query(f"WITH h AS (SELECT event_id, list_distinct(({_HELD})[event_id % 10 + 1:event_id % 10 + 1 + user_id % 7]) AS codes FROM events) SELECT event_id, array_to_string(list_transform(list_sort(list_transform(codes, lambda c: {{'r': coalesce(nullif(list_position({_MODS}, c), 0), 9), 'c': c}})), lambda x: x.c), '+') AS keys FROM h")
def o10_ordered_keys(spark, sf_dir):
    held = F.slice(F.array(*map(F.lit, HELD * 2)), (F.col("event_id") % 10 + 1).cast("int"), (F.col("user_id") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(P.ordered_keys(held), "+").alias("keys"))


@query("SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'mic_not_found' WHEN 1 THEN 'injection_failed' ELSE 'unknown' END AS code, CASE item_id % 4 WHEN 2 THEN 'mic_not_found' ELSE 'mic_permission' END AS device FROM benchmark")
def s28_error_codes(spark, sf_dir):
    k = F.col("item_id") % 4
    said = F.when(k == 0, "Error: mic_not_found").when(k == 1, "injection_failed: x").when(k == 2, "Device not found").otherwise("boom")
    return table(spark, sf_dir, "benchmark").select("item_id", P.error_code(said).alias("code"), P.device_error(said).alias("device"))


NAMED = {"name": "CASE event_id % 5 WHEN 0 THEN event_type || '.gguf' WHEN 1 THEN '../' || event_type WHEN 2 THEN event_type || '/b' WHEN 3 THEN event_type || chr(92) || 'b' ELSE 'v1..' || event_id END"}


@query(f"SELECT name, NOT (contains(name, '..') OR contains(name, '/') OR contains(name, chr(92))) AS safe FROM ({made_sql(NAMED)})")
def s29_safe_names(spark, sf_dir):
    return made(spark, sf_dir, NAMED).select("name", P.is_safe_name(F.col("name")).alias("safe"))
