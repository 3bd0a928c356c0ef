"""Column functions over transcript text. All are built-in expressions; null stays null."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space, spoken words and what they stand for, in the order they apply.
WHITE = " \t\n\x0b\x0c\r\x85\xa0                　"
FILLERS = [r"um+", r"uh+", r"uh huh", r"mm+ ?hmm+", r"hmm+"]
FILLERS_AHEAD = [
    r"\byou know\b(?=\s*,?\s)",
    r"\blike\b(?=\s+(?:the|a|an|i|we|they|he|she|it|my|our|this|that)\b)",
    r"\bbasically\b(?=\s*,)",
    r"\bactually\b(?=\s*,)",
    r"\bso\b(?=\s*,\s)",
    r"\bi mean\b(?=\s*,)",
    r"\bkind of\b(?=\s+(?:like|a|the)\b)",
    r"\bsort of\b(?=\s+(?:like|a|the)\b)",
    r"\bright\s*\?\s*(?=\b)",
]
SIGNALS = [
    r"wait(?:\s+no)?",
    r"no\s+wait",
    r"oh\s+wait",
    r"actually\s+(?:wait|no)",
    r"(?:oh\s+)?no\s+(?:actually|i\s+mean[st]?)",
    r"(?:wait\s+)?i\s+mean[st]?",
    r"or\s+(?:rather|actually)",
    r"scratch\s+that",
    r"never\s*mind",
    r"sorry",
]
DIGITS = {"zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10"}
NUMBER_CONTEXTS = [
    r"number|step|item|option|version|v|chapter|page|line|row|column|level|grade|score|count|total",
    r"is|are|was|were|equals?|=",
    r"about|around|approximately|roughly|nearly|over|under",
]
TENS = {"twenty": "20", "thirty": "30", "forty": "40", "fifty": "50", "sixty": "60", "seventy": "70", "eighty": "80", "ninety": "90"}
PUNCTUATION = [
    (r"period", "."),
    (r"comma", ","),
    (r"question mark", "?"),
    (r"exclamation (?:mark|point)", "!"),
    (r"colon", ":"),
    (r"semicolon", ";"),
    (r"dash", " —"),
    (r"hyphen", "-"),
    (r"open (?:paren|parenthesis)", "("),
    (r"close (?:paren|parenthesis)", ")"),
    (r"new line", "\n"),
    (r"new paragraph", "\n\n"),
]
DOMAINS = r"com|org|net|io|dev|co"
ENDINGS = ".!?:;\")"
ASCII_PUNCTUATION = r"!-/:-@\[-`{-~"

#: Unicode classes and case, as word boundaries and spaces are meant in all patterns here.
_U, _IU = "(?U)", "(?iU)"


def let(value: Column, fn) -> Column:
    """`fn(value)` with `value` computed once, however often `fn` mentions it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def replaced(text: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(text, pattern, by)


def literal(by: str) -> str:
    """`by` as a replacement that means itself."""
    return by.replace("\\", "\\\\").replace("$", "\\$")


def expanded(by: str) -> str:
    """`by` as a replacement in which $0 and ${0} are what was found, $$ is a dollar sign, and other
    $names, of which a phrase has none, are empty."""
    part = lambda m: "\\$" if m[0] == "$$" else "$0" if (m[1] or m[2]) == "0" else ""
    return re.sub(r"\$\$|\$(?:(\w+)|\{(\w+)\})", part, by.replace("\\", "\\\\"), flags=re.A)


#: Letters whose capital is written as several, and that as one letter, as SQL's `upper` has it.
LONG_CAPITALS = ("ßᾀᾁᾂᾃᾄᾅᾆᾇᾐᾑᾒᾓᾔᾕᾖᾗᾠᾡᾢᾣᾤᾥᾦᾧᾳῃῳ", "ẞᾈᾉᾊᾋᾌᾍᾎᾏᾘᾙᾚᾛᾜᾝᾞᾟᾨᾩᾪᾫᾬᾭᾮᾯᾼῌῼ")


def capital(text: Column) -> Column:
    """`text` with a capital first letter, always one character for one."""

    def of(t: Column) -> Column:
        return let(F.substring(t, 1, 1), lambda c: F.concat(F.when(F.length(F.upper(c)) > 1, F.translate(c, *LONG_CAPITALS)).otherwise(F.upper(c)), F.substr(t, F.lit(2))))

    return let(text, of)


def words(text: Column) -> Column:
    """White-space tokens."""
    return F.filter(F.split(text, _U + r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def tidied(text: Column) -> Column:
    """Commas and spaces that removals leave: doubled and leading commas, runs of spaces."""
    text = replaced(text, _U + r",\s*,", ",")
    text = replaced(text, _U + r"^\s*,\s*", "")
    return replaced(trimmed(text), _U + r"\s{2,}", " ")


def without_fillers(text: Column) -> Column:
    """Fillers of the app: um, uh, hmm and the like. They share no text, so one pass removes all."""
    return tidied(replaced(text, _IU + r"(?=[umh])\b(?:" + "|".join(FILLERS) + r")\b", ""))


def without_all_fillers(text: Column) -> Column:
    """All fillers, also those that depend on what follows; the first letter becomes a capital."""
    text = replaced(text, _IU + r"\b(?:" + "|".join(FILLERS) + r")\b", "")
    return capital(tidied(reduce(lambda t, p: replaced(t, _IU + p, ""), FILLERS_AHEAD, text)))


def without_corrections(text: Column) -> Column:
    """What follows the last self-correction signal of the first line that has one."""
    # anchored, so it replaces once; lines before the first with a signal are kept. A single character
    # is repeated, not a group, so that a text of many lines takes no deep recursion.
    signal = r"^[^\n]*\b(?:" + "|".join(SIGNALS) + r")\s*,?\s*"
    return trimmed(replaced(text, r"(?iUdm)\A((?s:.*?))" + signal, "$1"))


def capitalized(text: Column) -> Column:
    """Trimmed, with a capital first letter."""
    return capital(trimmed(text))


def with_numbers(text: Column) -> Column:
    """Spoken numbers to ten after a word that asks for one."""

    def after(context: str):
        wanted = _IU + rf"\b(?:{context})\s+\b(?:{'|'.join(DIGITS)})\b"

        def step(t: Column) -> Column:
            changed = reduce(lambda x, w: replaced(x, _IU + rf"(\b(?:{context})\s+)\b{w}\b", "$1" + DIGITS[w]), DIGITS, t)
            return F.when(F.rlike(t, F.lit(wanted)), changed).otherwise(t)

        return step

    # most texts have no spoken number; the beginnings are looked at before the words
    spoken = _IU + rf"\s(?=[zotfsen])(?:{'|'.join(DIGITS)})\b"
    changed = reduce(lambda t, context: let(t, after(context)), NUMBER_CONTEXTS, text)
    return F.when(F.rlike(text, F.lit(spoken)), changed).otherwise(text)


def with_percents(text: Column) -> Column:
    """"fifty percent" and "one hundred percent"."""
    changed = reduce(lambda t, w: replaced(t, _IU + rf"\b{w}\s+percent\b", TENS[w] + "%"), TENS, text)
    changed = replaced(changed, _IU + r"\b(?:one )?hundred percent\b", "100%")
    return F.when(F.rlike(text, F.lit(_IU + r"\spercent\b")), changed).otherwise(text)


def with_punctuation(text: Column) -> Column:
    """Spoken punctuation marks and breaks."""
    found = F.rlike(text, F.lit(_IU + r"(?=[pcqesdhon])\b(?:" + "|".join(p for p, _ in PUNCTUATION) + r")\b"))
    changed = reduce(lambda t, x: replaced(t, _IU + rf"\b{x[0]}\b", x[1]), PUNCTUATION, text)
    return F.when(found, changed).otherwise(text)


def with_spacing(text: Column) -> Column:
    """No space before a mark, one after it; then spoken e-mail addresses."""
    text = replaced(text, _U + r"\s+([.,!?;:)])", "$1")
    text = replaced(text, r"([.,!?;:])([A-Za-z])", "$1 $2")
    return replaced(text, _IU + rf"\b(\w+)\s+at\s+(\w+)\s+dot\s+({DOMAINS})\b", "$1@$2.$3")


def with_period(text: Column) -> Column:
    """A period at the end unless the text is blank or ends in a mark; trailing space goes with it."""
    bare = F.regexp_replace(text, _U + r"\s+\z", "")
    return let(bare, lambda b: F.when((b == "") | F.contains(F.lit(ENDINGS), F.right(b, F.lit(1))), text).otherwise(F.concat(b, F.lit("."))))


def with_sentences(text: Column) -> Column:
    """A capital after each sentence end, one space between, and the pronoun I."""
    parts = F.split(text, _U + r"(?<=[.!?])\s+(?=[a-z])", -1)
    text = F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2))))), " ")
    return replaced(text, _U + r"\bi\b", "I")


def datamarked(text: Column) -> Column:
    return F.array_join(words(text), "^")


def undatamarked(text: Column) -> Column:
    return F.array_join(words(F.translate(text, "^", " ")), " ")


def guarded(output: Column, text: Column) -> Column:
    """`output`, or `text` where the output has over half as many words more, and ten."""
    most = F.floor(word_count(text) * 3 / 2) + 10
    return F.when(word_count(output) > most, text).otherwise(output)


def token_budget(text: Column) -> Column:
    """Twice the estimated tokens, from 64 to 1024."""
    return F.least(F.greatest((word_count(text) * 1.3).cast("int") * 2, F.lit(64)), F.lit(1024))


def cleaned_text_of(raw: Column, text: Column) -> Column:
    """The `cleaned_text` of a JSON answer; `text` if the JSON has none, the answer itself if it is no JSON."""
    raw = trimmed(raw)
    json = F.try_parse_json(raw)
    said = F.try_variant_get(json, "$.cleaned_text", "string")
    is_text = F.schema_of_variant(F.try_variant_get(json, "$.cleaned_text", "variant")) == "STRING"
    return F.when(json.isNull(), raw).otherwise(trimmed(F.when(is_text, said).otherwise(text)))


def prompt_for(mode: Column, prompts: dict[str, str], default: str) -> Column:
    """The prompt of a mode, or the default."""
    return reduce(lambda c, x: F.when(mode == x[0], x[1]).otherwise(c), prompts.items(), F.lit(default))


def chat_request(prompt: Column, text: Column, budget: Column, model: str) -> Column:
    """JSON of a chat completion request."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.to_json(F.struct(F.lit(model).alias("model"), F.array(message("system", prompt), message("user", text)).alias("messages"), F.lit(0.0).alias("temperature"), budget.alias("max_tokens"), F.lit(False).alias("stream")))


def without_thoughts(text: Column) -> Column:
    return trimmed(replaced(text, r"(?s)<think>.*?</think>\s*", ""))
