"""Transcript operators: DataFrame in, DataFrame out, over a text column.

Every stage is a projection of its own: one fused expression would repeat the chain of regular
expressions for each mention of its input.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivener.functions import text as T

#: Limits of the rule lists, and rules that are applied without an index.
MOST_DICTIONARY, MOST_SNIPPETS, RULES_EACH = 500, 100, 20


def staged(df: DataFrame, column: str, *stages: Callable[[Column], Column]) -> DataFrame:
    for stage in stages:
        df = df.withColumn(column, stage(F.col(column)))
    return df


def cleaned(df: DataFrame, column: str = "text", smart: bool = True) -> DataFrame:
    """Fillers and self-corrections removed; with `smart`, numbers, punctuation and sentences
    formatted, else only the first letter. An empty text stays empty."""
    df = staged(df, column, T.without_fillers, T.without_corrections)
    if not smart:
        return staged(df, column, T.capitalized)
    return staged(df, column, T.with_numbers, T.with_percents, T.with_punctuation, T.with_spacing, T.capitalized, T.with_period, T.with_sentences)


def rules_of(rules: DataFrame, key: str, value: str, most: int, order: str = "ord") -> list[tuple[str, str]]:
    """A rule table as a list in order; rule tables have a fixed limit."""
    rows = rules.orderBy(order).select(key, value).take(most + 1)
    if len(rows) > most:
        raise ValueError(f"more than {most} rules")
    return [(r[0], r[1]) for r in rows]


def escaped(phrase: str) -> str:
    """`phrase` as a pattern that means itself."""
    return "".join("\\" + c if c.isascii() and not c.isalnum() and c != "_" and not c.isspace() else c for c in phrase)


def _chained(text: Column, rules: Sequence[tuple[str, str]], expand: bool) -> Column:
    for phrase, by in rules:
        text = F.regexp_replace(text, rf"(?iU)\b{escaped(phrase)}\b", T.expanded(by) if expand else T.literal(by))
    return text


def _folded(text: Column) -> Column:
    """Text whose words are equal where patterns in any case find them equal: letters that have a form in
    one case only are brought to the others first."""
    upper = F.translate(F.upper(F.translate(text, "ẞ", "ß")), "İ", "I")
    return F.translate(F.lower(upper), "ς", "σ")


def _tokens(text: Column) -> Column:
    return F.split(_folded(text), r"(?U)\W+", -1)


def rule_index(df: DataFrame, rules: Sequence[tuple[str, str]], expand: bool) -> tuple[dict[str, list[int]], list[int]]:
    """Which rules (from 1) a text with a given word may meet, and which any text may. A rule is found by the
    longest word of its phrase, folded: where the phrase stands, that stands as a whole word. What a rule
    writes has words too, by which later rules may then be met; a rule that can join its neighbours' words
    (its phrase ends in a mark, or what it found is written again) may lead to any later one."""
    made = df.sparkSession.createDataFrame([(k, p, by) for k, (p, by) in enumerate(rules, 1)], "k int, p string, by string")
    words_ = lambda c: F.filter(_tokens(F.col(c)), lambda w: w != "")
    longest = F.element_at(F.sort_array(F.transform(words_("p"), lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))), -1)["w"]
    key = F.when(F.size(words_("p")) > 0, longest)
    rows = sorted(tuple(r) for r in made.select("k", key, words_("by"), F.rlike("p", F.lit(r"(?Us)^\w(.*\w)?$"))).collect())
    keys = {k: key for k, key, _, _ in rows}
    later: dict[int, set[int]] = {}
    for k, _, written, closed in reversed(rows):
        wild = expand or not closed
        later[k] = {n for n in keys if n > k and (wild or keys[n] is None or keys[n] in written)}
        later[k] |= {m for n in later[k] for m in later[n]}
    of: dict[str, set[int]] = {}
    always: set[int] = set()
    for k, key in keys.items():
        (always if key is None else of.setdefault(key, set())).update({k} | later[k])
    return {w: sorted(x) for w, x in of.items()}, sorted(always)


def _applied(df: DataFrame, column: str, rules: Sequence[tuple[str, str]], expand: bool = False) -> DataFrame:
    """Few rules are a chain of replacements. Of many, a text meets in order only those that it may meet by
    `rule_index`, which are looked up for the words it has."""
    if len(rules) <= RULES_EACH:
        return df.withColumn(column, _chained(F.col(column), rules, expand)) if rules else df
    by_word, always = rule_index(df, rules, expand)
    fixed = lambda x, kind: F.from_json(F.lit(json.dumps(x)), kind)  # noqa: E731  one literal, folded once a query
    index, patterns = fixed(by_word, "map<string,array<int>>"), fixed([rf"(?iU)\b{escaped(p)}\b" for p, _ in rules], "array<string>")
    written = fixed([T.expanded(by) if expand else T.literal(by) for _, by in rules], "array<string>")
    met = F.transform(F.array_intersect(_tokens(F.col(column)), fixed(sorted(by_word), "array<string>")), lambda w: F.element_at(index, w))
    df = df.withColumn("met_", F.array_sort(F.array_union(fixed(always, "array<int>"), F.flatten(met))))
    step = lambda text, k: F.regexp_replace(text, F.element_at(patterns, k), F.element_at(written, k))
    return df.withColumn(column, F.when(F.size("met_") > 0, F.aggregate("met_", F.col(column), step)).otherwise(F.col(column))).drop("met_")


def with_dictionary(df: DataFrame, rules: Sequence[tuple[str, str]], column: str = "text", expand: bool = False) -> DataFrame:
    """Ordered whole-word replacements in any case; later rules see what earlier ones wrote. Empty
    phrases are skipped; replacements mean themselves, unless `expand` lets $0 stand for what was found."""
    return _applied(df, column, [(a, b) for a, b in rules if a], expand)


def longest_first() -> list[Column]:
    """Longest trigger (in bytes) first, of equals the first stored."""
    return [F.desc(F.octet_length("trigger")), F.col("ord")]


def snippet_order(snippets: DataFrame) -> DataFrame:
    return snippets.orderBy(*longest_first())


def with_snippets(df: DataFrame, snippets: Sequence[tuple[str, str]], column: str = "text") -> DataFrame:
    """Triggers, stripped to letters, digits and spaces, expand longest first."""
    ordered = sorted(snippets, key=lambda s: -len(s[0].encode()))
    stripped = [("".join(c for c in t if c.isalnum() or c.isspace()), by) for t, by in ordered]
    return _applied(df, column, [(t, by) for t, by in stripped if t])


OVERLAP = 8
#: Segments that are joined before their text is put to the rest.
STRETCH = 64


def _bare(tokens: Column) -> Column:
    """Tokens as overlaps compare them: lower case, ASCII punctuation off both ends."""
    edge = f"[{T.ASCII_PUNCTUATION}]+"
    return F.transform(tokens, lambda w: F.regexp_replace(F.lower(w), f"^{edge}|{edge}$", ""))


def merged(segments: Column) -> Column:
    """One text of an array of overlapping segments: of each segment, the words that repeat the
    longest matching end of what came before (up to eight words) are left out."""
    usable = F.filter(F.transform(segments, T.trimmed), lambda s: s != "")
    # words and bare words of a segment are made once, before the fold
    read = F.transform(usable, lambda s: T.let(T.words(s), lambda own: F.struct(s.alias("text"), own.alias("own"), _bare(own).alias("bare"))))
    none = F.array().cast("array<string>")

    def shared_of(tail: Column, bare: Column) -> Column:
        most = F.least(F.size(tail), F.size(bare), F.lit(OVERLAP))
        # an end is cut out only where its first word fits
        begins = lambda n: F.get(tail, F.size(tail) - n) == F.get(bare, F.lit(0))
        lengths = F.when(most > 0, F.sequence(most, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
        return F.coalesce(F.get(F.filter(lengths, lambda n: begins(n) & (F.slice(tail, F.size(tail) - n + 1, n) == F.slice(bare, F.lit(1), n))), F.lit(0)), F.lit(0))

    def joined(acc: Column, segment: Column, shared: Column) -> Column:
        rest = F.array_join(F.slice(segment["own"], shared + 1, F.size(segment["own"])), " ")
        after = F.when(shared == 0, segment["text"]).otherwise(rest)
        text = F.when(shared == F.size(segment["own"]), acc["text"]).when(acc["text"] == "", after).otherwise(F.concat(acc["text"], F.lit(" "), after))
        tail = F.concat(acc["tail"], F.slice(segment["bare"], shared + 1, F.size(segment["bare"])))
        return F.struct(text.alias("text"), T.let(tail, lambda t: F.slice(t, F.greatest(F.size(t) - OVERLAP + 1, F.lit(1)), F.lit(OVERLAP))).alias("tail"))

    def step(acc: Column, segment: Column) -> Column:
        return T.let(shared_of(acc["tail"], segment["bare"]), lambda shared: joined(acc, segment, shared))

    def stretch(acc: Column, segments_: Column) -> Column:
        """The text of some segments, after the tail of those before."""
        own = F.aggregate(segments_, F.struct(F.lit("").alias("text"), acc["tail"].alias("tail")), step)
        return T.let(own, lambda o: F.struct(F.when(o["text"] == "", acc["parts"]).otherwise(F.concat(acc["parts"], F.array(o["text"]))).alias("parts"), o["tail"].alias("tail")))

    # a step copies the text of its stretch, not all there is
    def stretches(all_: Column) -> Column:
        places = F.when(F.size(all_) > 0, F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / STRETCH).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda k: F.slice(all_, k * STRETCH + 1, F.lit(STRETCH)))

    return F.aggregate(T.let(read, stretches), F.struct(none.alias("parts"), none.alias("tail")), stretch, lambda acc: F.array_join(acc["parts"], " "))


def dictated(df: DataFrame, segments: str, dictionary: Sequence[tuple[str, str]], snippets: Sequence[tuple[str, str]], smart: bool = True, polish: Callable[[Column], Column] | None = None) -> DataFrame:
    """`df` with `text`, the finished transcript of its `segments`: merged, cleaned, rewritten by
    dictionary and snippets, then polished by an optional expression of raw answers, whose output
    is read, unmarked and guarded against running on."""
    df = cleaned(df.withColumn("text", merged(F.col(segments))), "text", smart)
    df = with_snippets(with_dictionary(df, dictionary), snippets)
    if polish is None:
        return df
    df = df.withColumn("answer_", T.undatamarked(T.cleaned_text_of(polish(T.datamarked(F.col("text"))), F.col("text"))))
    return df.withColumn("text", T.guarded(F.col("answer_"), F.col("text"))).drop("answer_")
