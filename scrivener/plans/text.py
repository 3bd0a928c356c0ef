"""Queries of the transcript text pipeline. The driver's documents hold no spoken noise, so the whole
text of every document (null: empty) gets some, by id, the same in SQL.

DuckDB's patterns know word characters of ASCII only: in SQL the letters from U+00C0 to U+00FF are
spelled as words of ASCII characters while patterns with word boundaries run."""

from __future__ import annotations

import string

from pyspark.sql import functions as F

from scrivener.functions import text as T
from scrivener.operators import transcript as X
from scrivener.operators.ordering import numbered

from .registry import dealt, query, table

NOISY_SQL = r"""WITH b AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
 n AS (SELECT doc_id, CASE doc_id % 8
 WHEN 0 THEN 'um, uh ' || t || ' hmm okay'
 WHEN 1 THEN substr(t, 1, 60) || ' oh wait, ' || substr(t, 61)
 WHEN 2 THEN 'i think comma ' || t || ' question mark and i know'
 WHEN 3 THEN 'step three is about fifty percent, line ten was four ' || t || ' period new paragraph also this'
 WHEN 4 THEN 'send it to bob at test dot com dash ' || t
 WHEN 5 THEN 'Uhh mmm hmm, , so ' || t || ' one hundred percent exclamation point'
 WHEN 6 THEN substr(t, 1, 40) || ' scratch that ' || substr(t, 41, 40) || ' no I mean ' || substr(t, 81)
 ELSE 'open paren ' || t || ' close paren semicolon version  two' END AS t FROM b)"""


def noisy(spark, sf_dir):
    t, tail = F.col("t"), lambda a: F.substr("t", F.lit(a))
    docs = dealt(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t")))
    parts = [
        (F.lit("um, uh "), t, F.lit(" hmm okay")),
        (F.substring("t", 1, 60), F.lit(" oh wait, "), tail(61)),
        (F.lit("i think comma "), t, F.lit(" question mark and i know")),
        (F.lit("step three is about fifty percent, line ten was four "), t, F.lit(" period new paragraph also this")),
        (F.lit("send it to bob at test dot com dash "), t),
        (F.lit("Uhh mmm hmm, , so "), t, F.lit(" one hundred percent exclamation point")),
        (F.substring("t", 1, 40), F.lit(" scratch that "), F.substring("t", 41, 40), F.lit(" no I mean "), tail(81)),
        (F.lit("open paren "), t, F.lit(" close paren semicolon version  two")),
    ]
    made = F.concat(*parts[7])
    for k in range(7):
        made = F.when(F.col("doc_id") % 8 == k, F.concat(*parts[k])).otherwise(made)
    return docs.select("doc_id", made.alias("text"))


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


LETTERS = [chr(c) for c in range(0xC0, 0x100) if chr(c).isalpha()]


def spelled(pairs) -> str:
    out = "t"
    for a, b in pairs:
        out = f"replace({out}, {lit(a)}, {lit(b)})"
    return out


SPELL = spelled((c, f"_{ord(c):x}_") for c in LETTERS)
UNSPELL = spelled((f"_{ord(c):x}_", c) for c in LETTERS)


def chained(*stages: str, base: str = NOISY_SQL, last: str = "doc_id, t AS text") -> str:
    """SQL that applies expressions of t one after another, each in a SELECT of its own; accented letters
    are spelled out for those with word boundaries."""
    steps: list[str] = []
    is_spelled = False
    for stage in stages:
        if (r"\b" in stage) != is_spelled:
            is_spelled = not is_spelled
            steps.append(SPELL if is_spelled else UNSPELL)
        steps.append(stage)
    out, at = base, "n"
    for k, stage in enumerate([*steps, *([UNSPELL] if is_spelled else [])]):
        out += f", s{k} AS (SELECT doc_id, {stage} AS t FROM {at})"
        at = f"s{k}"
    return f"{out} SELECT {last} FROM {at}"


def rr(pattern: str, by: str, flags: str = "g") -> str:
    return f"regexp_replace(t, {lit(pattern)}, {lit(by)}, '{flags}')"


SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
TRIM, FIRST = f"trim(t, {SPACE})", "upper(substr(t, 1, 1)) || substr(t, 2)"
TIDY = [rr(r",\s*,", ","), rr(r"^\s*,\s*", "", ""), TRIM, rr(r"\s{2,}", " ")]
FILLERS = [*[rr(rf"\b{p}\b", "", "gi") for p in T.FILLERS], *TIDY]
CORRECTIONS = [rr(r".*\b(?:" + "|".join(T.SIGNALS) + r")\s*,?\s*", "", "i"), TRIM]
CAPITAL = [TRIM, FIRST]
NUMBERS = [rr(rf"(\b(?:{c})\s+)\b{w}\b", rf"\1{d}", "gi") for c in T.NUMBER_CONTEXTS for w, d in T.DIGITS.items()]
PERCENTS = [*[rr(rf"\b{w}\s+percent\b", d + "%", "gi") for w, d in T.TENS.items()], rr(r"\b(?:one )?hundred percent\b", "100%", "gi")]
MARKS = [rr(rf"\b{p}\b", by, "gi") for p, by in T.PUNCTUATION]
SPACING = [rr(r"\s+([.,!?;:)])", r"\1"), rr(r"([.,!?;:])([A-Za-z])", r"\1 \2"), rr(rf"\b(\w+)\s+at\s+(\w+)\s+dot\s+({T.DOMAINS})\b", r"\1@\2.\3", "gi")]
PERIOD = [f"CASE WHEN rtrim(t, {SPACE}) = '' OR contains({lit(T.ENDINGS)}, right(rtrim(t, {SPACE}), 1)) THEN t ELSE rtrim(t, {SPACE}) || '.' END"]
SENTENCES = [
    "regexp_replace(t, '([.!?])\\s+([a-z])', '\\1' || chr(1) || '\\2', 'g')",
    "array_to_string(list_transform(string_split(t, chr(1)), lambda p, i: CASE WHEN i = 1 THEN p ELSE upper(substr(p, 1, 1)) || substr(p, 2) END), ' ')",
    rr(r"\bi\b", "I"),
]
SMART = [*FILLERS, *CORRECTIONS, *NUMBERS, *PERCENTS, *MARKS, *SPACING, *CAPITAL, *PERIOD, *SENTENCES]


@query(chained(*FILLERS))
def t1_without_fillers(spark, sf_dir):
    return X.staged(noisy(spark, sf_dir), "text", T.without_fillers)


# RE2 has no lookahead: what follows is captured and put back; only patterns whose matches cannot
# share it are applied, on text made for them
AHEAD_SQL = "WITH n AS (SELECT item_id AS doc_id, 'um so, you know, it was basically, like the ' || coalesce(text, '') || ' actually, i mean, kind of like uh that' AS t FROM benchmark)"


def _ahead(text):
    return F.concat(F.lit("um so, you know, it was basically, like the "), F.coalesce(text, F.lit("")), F.lit(" actually, i mean, kind of like uh that"))


AHEAD = [
    *[rr(rf"\b{p}\b", "", "gi") for p in T.FILLERS],
    rr(r"\byou know\b(\s*,?\s)", r"\1", "gi"),
    rr(r"\blike\b(\s+(?:the|a|an|i|we|they|he|she|it|my|our|this|that)\b)", r"\1", "gi"),
    rr(r"\bbasically\b(\s*,)", r"\1", "gi"),
    rr(r"\bactually\b(\s*,)", r"\1", "gi"),
    rr(r"\bso\b(\s*,\s)", r"\1", "gi"),
    rr(r"\bi mean\b(\s*,)", r"\1", "gi"),
    rr(r"\bkind of\b(\s+(?:like|a|the)\b)", r"\1", "gi"),
    rr(r"\bsort of\b(\s+(?:like|a|the)\b)", r"\1", "gi"),
]


@query(chained(*AHEAD, *TIDY, FIRST, base=AHEAD_SQL))
def t1b_without_all_fillers(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), _ahead(F.col("text")).alias("text"))
    return X.staged(rows, "text", T.without_all_fillers)


@query(chained(*CORRECTIONS))
def t2_without_corrections(spark, sf_dir):
    return X.staged(noisy(spark, sf_dir), "text", T.without_corrections)


@query(chained(*CAPITAL))
def t3_capitalized(spark, sf_dir):
    return X.staged(noisy(spark, sf_dir), "text", T.capitalized)


@query(chained(*NUMBERS, *PERCENTS))
def t4_spoken_numbers(spark, sf_dir):
    return X.staged(noisy(spark, sf_dir), "text", T.with_numbers, T.with_percents)


@query(chained(*MARKS, *SPACING))
def t5_spoken_punctuation(spark, sf_dir):
    return X.staged(noisy(spark, sf_dir), "text", T.with_punctuation, T.with_spacing)


@query(chained(*PERIOD, *SENTENCES))
def t6_sentences(spark, sf_dir):
    return X.staged(noisy(spark, sf_dir), "text", T.with_period, T.with_sentences)


@query(chained(*SMART))
def t7_cleaned(spark, sf_dir):
    return X.cleaned(noisy(spark, sf_dir))


@query(chained(*FILLERS, *CORRECTIONS, *CAPITAL))
def t7_cleaned_plain(spark, sf_dir):
    return X.cleaned(noisy(spark, sf_dir), smart=False)


DICTIONARY = [("the", "teh"), ("teh thnt", "joined"), ("", "never"), ("AND", "&"), ("ing", "$1\\"), ("c++", "cpp"), ("bob", "Robert")]
SNIPPETS = [("of", "OF"), ("and, the", "and also the"), ("...", "never"), ("and", "plus"), ("My Sign-off", "Best")]


def escaped_sql(by: str) -> str:
    return by.replace("\\", "\\\\")


RULES = [rr(rf"\b{X.escaped(a)}\b", escaped_sql(b), "gi") for a, b in DICTIONARY if a]
EXPANSIONS = [rr(rf"\b{a}\b", b, "gi") for a, b in [("My Signoff", "Best"), ("and the", "and also the"), ("and", "plus"), ("of", "OF")]]


@query(chained(*RULES))
def t8_dictionary(spark, sf_dir):
    rules = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(DICTIONARY)], "ord int, `from` string, `to` string")
    return X.with_dictionary(noisy(spark, sf_dir), X.rules_of(rules, "from", "to", X.MOST_DICTIONARY))


@query(chained(*EXPANSIONS))
def t9_snippets(spark, sf_dir):
    return X.with_snippets(noisy(spark, sf_dir), SNIPPETS)


#: The first sentence of a text of `benchmark`, of none and of marks alone, as a trigger.
TRIGGERS = "SELECT item_id AS ord, CASE item_id % 4 WHEN 1 THEN '' WHEN 2 THEN '!?' ELSE split_part(text, '.', 1) END AS trigger FROM benchmark"


def triggers(spark, sf_dir):
    k = F.col("item_id") % 4
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ord"), F.when(k == 1, "").when(k == 2, "!?").otherwise(F.split_part("text", F.lit("."), F.lit(1))).alias("trigger"))


@query(f"SELECT ord, trigger, row_number() OVER (ORDER BY octet_length(encode(trigger)) DESC, ord) AS place FROM ({TRIGGERS})")
def o2_snippet_order(spark, sf_dir):
    return numbered(triggers(spark, sf_dir), *X.longest_first(), name="place", first=1)


@query(f"SELECT ord, trigger FROM ({TRIGGERS}) WHERE trigger NOT IN ('', '!?')")
def f16_usable_rules(spark, sf_dir):
    return triggers(spark, sf_dir).filter(F.regexp_replace("trigger", r"(?U)[^\w\s]|_", "") != "")


# Each segment is compared with the end of the one before it, which has all eight words that matter.
SEGMENTS_SQL = rf"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '') AS w FROM documents),
 g AS (SELECT doc_id, k, w[8 * k + 1:8 * k + 12] AS p FROM (SELECT doc_id, w, unnest(range(0, (len(w) + 7) // 8)) AS k FROM w)),
 s AS (SELECT doc_id, k, CASE k % 3 WHEN 0 THEN array_to_string(p, ' ') WHEN 1 THEN translate(array_to_string(p, ' '), '{string.ascii_lowercase}', '{string.ascii_uppercase}') || '!' ELSE array_to_string(p, '  ') END AS s FROM g),
 o AS (SELECT *, list_filter(regexp_split_to_array(s, '\s+'), lambda x: x <> '') AS own FROM s),
 e AS (SELECT *, list_transform(own, lambda x: trim(lower(x), '!"#$%&''()*+,-./:;<=>?@[\]^_`{{|}}~')) AS bare FROM o),
 l AS (SELECT *, coalesce(lag(bare) OVER (PARTITION BY doc_id ORDER BY k), []) AS tail FROM e),
 z AS (SELECT *, coalesce(list_max(list_filter(range(1, least(len(tail), len(bare), 8) + 1), lambda n: tail[len(tail) - n + 1:] = bare[1:n])), 0) AS shared FROM l),
 m AS (SELECT doc_id, string_agg(CASE WHEN k = 0 THEN s WHEN shared = 0 THEN ' ' || s WHEN shared = len(own) THEN '' ELSE ' ' || array_to_string(own[shared + 1:], ' ') END, '' ORDER BY k) AS t FROM z GROUP BY doc_id),
 n AS (SELECT doc_id, coalesce(m.t, '') AS t FROM documents LEFT JOIN m USING (doc_id))"""


def segments(spark, sf_dir):
    """Whole texts as overlapping segments: twelve words every eight, each third shouted, each third
    with double spaces."""
    docs = dealt(table(spark, sf_dir, "documents").select("doc_id", T.words(F.coalesce("text", F.lit(""))).alias("w")))
    part = lambda k, by: F.array_join(F.slice("w", k * 8 + 1, F.lit(12)), by)
    shouted = lambda k: F.concat(F.translate(part(k, " "), string.ascii_lowercase, string.ascii_uppercase), F.lit("!"))
    numbers = F.when(F.size("w") > 0, F.sequence(F.lit(0), F.floor((F.size("w") - 1) / 8).cast("int"))).otherwise(F.array().cast("array<int>"))
    return docs.select("doc_id", F.transform(numbers, lambda k: F.when(k % 3 == 0, part(k, " ")).when(k % 3 == 1, shouted(k)).otherwise(part(k, "  "))).alias("segments"))


@query(SEGMENTS_SQL + " SELECT doc_id, t AS text FROM n")
def t10_merged_segments(spark, sf_dir):
    return segments(spark, sf_dir).select("doc_id", X.merged(F.col("segments")).alias("text"))


@query("SELECT doc_id, CAST(coalesce(len(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '^\\s*$'))), 0) AS INT) AS n FROM documents")
def f17_nonblank_segments(spark, sf_dir):
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.filter(F.transform(lines, T.trimmed), lambda s: s != "")).alias("n"))


WORDS = r"list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '')"


@query(chained(f"array_to_string({WORDS}, '^')"))
def t11_datamarked(spark, sf_dir):
    return X.staged(noisy(spark, sf_dir), "text", T.datamarked)


@query(chained("replace(t, ' ', '^')", "replace(t, '^', ' ')", f"array_to_string({WORDS}, ' ')"))
def t12_undatamarked(spark, sf_dir):
    return X.staged(noisy(spark, sf_dir), "text", lambda t: F.replace(t, F.lit(" "), F.lit("^")), T.undatamarked)


N = f"len({WORDS})"


@query(NOISY_SQL + f", g AS (SELECT doc_id, t, repeat('more ', CAST(doc_id % 100 AS INT)) || t AS o, {N} AS w FROM n) SELECT doc_id, CASE WHEN w + doc_id % 100 > w * 3 // 2 + 10 THEN t ELSE o END AS text FROM g")
def t13_guarded(spark, sf_dir):
    rows = noisy(spark, sf_dir).withColumn("o", F.concat(F.repeat(F.lit("more "), (F.col("doc_id") % 100).cast("int")), F.col("text")))
    return rows.select("doc_id", T.guarded(F.col("o"), F.col("text")).alias("text"))


@query(f"WITH n AS (SELECT doc_id, text AS t FROM documents) SELECT doc_id, CAST(least(greatest(CAST(trunc({N} * 1.3::DOUBLE) AS INT) * 2, 64), 1024) AS INT) AS budget FROM n")
def t14_token_budget(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.token_budget(F.col("text")).alias("budget"))


ANSWER_SQL = "CASE doc_id % 4 WHEN 0 THEN ' {\"cleaned_text\": \" fine ' || doc_id || ' \"} ' WHEN 1 THEN '{\"other\": 1}' WHEN 2 THEN 'plain {answer' ELSE '{\"cleaned_text\": 5}' END"


@query(NOISY_SQL + f", a AS (SELECT doc_id, t, {ANSWER_SQL} AS r FROM n) SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'fine ' || doc_id WHEN 2 THEN r ELSE trim(t, {SPACE}) END AS text FROM a")
def t15_cleaned_text(spark, sf_dir):
    k, i = F.col("doc_id") % 4, F.col("doc_id").cast("string")
    said = F.when(k == 0, F.concat(F.lit(' {"cleaned_text": " fine '), i, F.lit(' "} '))).when(k == 1, '{"other": 1}').when(k == 2, "plain {answer").otherwise('{"cleaned_text": 5}')
    return noisy(spark, sf_dir).select("doc_id", T.cleaned_text_of(said, F.col("text")).alias("text"))


EMAIL, PLAIN = "Format the dictated text as an e-mail.", "Fix the dictated text."


@query(f"SELECT doc_id, CASE WHEN source = 'src1' THEN {lit(EMAIL)} ELSE {lit(PLAIN)} END AS prompt FROM documents")
def t16_prompt(spark, sf_dir):
    mode = F.when(F.col("source") == "src1", "email").otherwise(F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", T.prompt_for(mode, {"email": EMAIL}, PLAIN).alias("prompt"))


@query(f"""SELECT item_id, '{{"model":"m","messages":[{{"role":"system","content":"{PLAIN}"}},{{"role":"user","content":' || CAST(to_json(coalesce(text, '') || ' "quoted" \\ ' || chr(9)) AS VARCHAR) || '}}],"temperature":0.0,"max_tokens":64,"stream":false}}' AS request FROM benchmark""")
def t17_chat_request(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(' "quoted" \\ \t')))
    return rows.select("item_id", T.chat_request(F.lit(PLAIN), F.col("text"), F.lit(64), "m").alias("request"))


@query(chained(f"CASE WHEN doc_id % 2 = 0 THEN '<think>a' || chr(10) || 'b</think> ' || t || ' <think></think>' ELSE t END", rr(r"(?s)<think>.*?</think>\s*", ""), TRIM))
def t18_without_thoughts(spark, sf_dir):
    rows = noisy(spark, sf_dir).withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("<think>a\nb</think> "), F.col("text"), F.lit(" <think></think>"))).otherwise(F.col("text")))
    return X.staged(rows, "text", T.without_thoughts)


@query(f"WITH n AS (SELECT doc_id, text AS t FROM documents) SELECT doc_id, {N} AS words FROM n")
def t19_word_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.word_count(F.col("text")).alias("words"))


@query(chained(*SMART, *RULES, *EXPANSIONS, base=SEGMENTS_SQL))
def t20_dictated(spark, sf_dir):
    return X.dictated(segments(spark, sf_dir), "segments", DICTIONARY, SNIPPETS).select("doc_id", "text")


@query(chained(*RULES))
def j6_rows_by_ordered_rules(spark, sf_dir):
    """Every row under every rule in order: the rule table is read as a list and folded."""
    rules = spark.createDataFrame([(9 - i, a, b) for i, (a, b) in enumerate(reversed(DICTIONARY))], "ord int, `from` string, `to` string")
    return X.with_dictionary(noisy(spark, sf_dir), X.rules_of(rules, "from", "to", X.MOST_DICTIONARY))
