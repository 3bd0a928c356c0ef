"""Column functions that take markdown out of model outputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import capital, let, trimmed

#: Words by which an input asks for a list.
ORDINALS = r"(?i)\b(first|second|third|fourth|fifth)\b"
#: Bullets that become one sentence; longer lists are numbered.
INLINE_ITEMS = 5


def without_bold(text: Column) -> Column:
    return F.regexp_replace(text, r"(?d)\*\*(.+?)\*\*", "$1")


def without_headers(text: Column) -> Column:
    """Header marks at line starts, with the white space after them, line breaks too."""
    return F.regexp_replace(text, r"(?dm)^#{1,3}\s*", "")


def bullets_flattened(text: Column) -> Column:
    """Blocks of two or more bullet lines become a sentence (up to five items) or a numbered list;
    a block takes the line break after it along."""
    lines = F.split(text, "\n", -1)
    none = F.array().cast("array<string>")

    def block(run: Column, end: Column) -> Column:
        items = F.transform(run, lambda x: trimmed(F.regexp_replace(trimmed(x), "^[- ]+", "")))
        inline = F.concat(F.array_join(items, ", "), F.lit("."))
        numbered = F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
        listed = F.when(F.size(run) <= INLINE_ITEMS, inline).otherwise(numbered)
        return F.when(F.size(run) == 0, "").when(F.size(run) == 1, F.concat(run[0], end)).otherwise(listed)

    def step(acc: Column, line: Column) -> Column:
        bullet = F.startswith(line, F.lit("- ")) & (F.length(line) > 2)
        out = F.when(bullet, acc["out"]).otherwise(F.concat(acc["out"], block(acc["run"], F.lit("\n")), line, F.lit("\n")))
        run = F.when(bullet, F.concat(acc["run"], F.array(line))).otherwise(none)
        return F.struct(out.alias("out"), run.alias("run"))

    def finish(acc: Column) -> Column:
        last_is_text = F.size(acc["run"]) == 0
        return F.when(last_is_text, F.substring(acc["out"], F.lit(1), F.length(acc["out"]) - 1)).otherwise(F.concat(acc["out"], block(acc["run"], F.lit(""))))

    return F.aggregate(lines, F.struct(F.lit("").alias("out"), none.alias("run")), step, finish)


def without_first_bullet(text: Column) -> Column:
    return trimmed(F.regexp_replace(text, r"\A- ", ""))


def has_bold(text: Column) -> Column:
    return F.contains(text, F.lit("**"))


def has_bullets(text: Column) -> Column:
    return F.contains(text, F.lit("\n- ")) | F.startswith(text, F.lit("- "))


def _filled_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n", -1), trimmed), lambda x: x != "")


def is_forced_list(given: Column, made: Column) -> Column:
    """A numbered list of three or more items and nothing else, made of an input without ordinals."""
    fits = lambda lines: (F.size(lines) >= 3) & F.forall(lines, lambda x: F.rlike(x, F.lit(r"^\d+\.")))
    return ~F.rlike(given, F.lit(ORDINALS)) & F.rlike(made, F.lit(r"(?dm)^\d+\.")) & F.contains(made, F.lit("\n")) & let(_filled_lines(made), fits)


def numbered_flattened(text: Column) -> Column:
    """A numbered list, perhaps after one line of preamble, as a sentence; other texts unchanged."""
    numbered = lambda x: F.rlike(x, F.lit(r"^\d+\."))
    item = lambda x: trimmed(F.regexp_replace(F.regexp_extract(x, r"(?d)^\d+\.\s*(.*)", 1), r"\.+\z", ""))

    def sentence(lead: Column, items: Column) -> Column:
        joined = F.concat(F.array_join(F.slice(items, F.lit(1), F.size(items) - 1), ", "), F.lit(", and "), F.element_at(items, -1))
        plain = F.concat(capital(joined), F.lit("."))
        return F.when(lead != "", F.concat(lead, F.lit(": "), joined, F.lit("."))).otherwise(plain)

    def of(lines: Column) -> Column:
        first = F.element_at(lines, 1)
        led = ~numbered(first)
        rest = F.when(led, F.slice(lines, F.lit(2), F.size(lines))).otherwise(lines)
        lead = F.when(led, trimmed(F.regexp_replace(first, r":+\z", ""))).otherwise("")
        return let(rest, lambda r: F.when(F.forall(r, numbered) & (F.size(r) >= 2), let(F.transform(r, item), lambda items: sentence(lead, items))).otherwise(text))

    return let(_filled_lines(text), lambda lines: F.when(F.size(lines) > 0, of(lines)).otherwise(text))
