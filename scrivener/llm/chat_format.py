"""Chat formatting by prefix-target expansion: every assistant turn becomes its own example, with all
turns before it as context and only that reply trainable.

A turn is `<|im_start|>role\\ntext<|im_end|>\\n`. Control strings of this and other common templates
inside roles and texts are escaped by one backslash before their last part (`<|` becomes `<\\|`,
`<\\|` becomes `<\\\\|`), which is undone exactly; a role's backslashes and line breaks are escaped
too. A conversation that ends without an assistant turn gets a last example without loss, so that
no turn is lost.

Rows are put in order of turn, then role and text; null roles and texts count as empty, a null
conversation id is one conversation, repeated rows are turns of their own, extra columns are
ignored, empty tables give no rows. All of it is native expressions. One conversation is one row,
as its last example must be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, END = "<|im_start|>", "<|im_end|>\n"
#: Control strings of common chat templates, as opening, escapes and closing part.
_OPEN, _CLOSE = r"(<</|<<|</|<|\[/|\[)", r"(\||s>|INST\]|SYS>>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"{_OPEN}(\\*){_CLOSE}", r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"{_OPEN}(\\*)\\{_CLOSE}", "$1$2$3")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    parts = F.split(unescape(role), r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def examples(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = "assistant") -> DataFrame:
    """(conv, example, n_turns, is_whole, text, loss_start, loss_length): an example for each turn of
    role `trained`, numbered by its turn's place from 1; `is_whole` marks the one with all turns.
    The loss mask covers `loss_length` code points of `text` from `loss_start` (0-based)."""
    empty = F.lit("")
    turns = rows.select(F.col(conv).alias("conv_"), F.struct(F.col(turn).alias("t"), F.coalesce(F.col(role), empty).alias("r"), F.coalesce(F.col(text), empty).alias("x")).alias("turn_"))
    convs = turns.groupBy("conv_").agg(F.sort_array(F.collect_list("turn_")).alias("turns_"))
    made = F.transform("turns_", lambda t: F.struct((t["r"] == trained).alias("own"), F.length(escape(t["x"])).alias("n"), F.concat(F.lit(BEGIN), escape_role(t["r"]), F.lit("\n"), escape(t["x"]), F.lit(END)).alias("f")))
    convs = convs.select("conv_", F.size("turns_").alias("n_turns"), made.alias("made_"))
    ends = F.filter(F.sequence(F.lit(1), F.col("n_turns")), lambda i: F.element_at("made_", i)["own"] | (i == F.col("n_turns")))
    each = convs.select("conv_", "n_turns", "made_", F.explode(ends).alias("example"))
    last = F.element_at("made_", F.col("example"))
    each = each.select("conv_", "example", "n_turns", F.array_join(F.transform(F.slice("made_", F.lit(1), F.col("example")), lambda m: m["f"]), "").alias("text"), F.when(last["own"], last["n"]).otherwise(0).alias("loss_length"))
    return each.select(F.col("conv_").alias(conv), "example", "n_turns", (F.col("example") == F.col("n_turns")).alias("is_whole"), "text", (F.length("text") - len(END) - F.col("loss_length")).alias("loss_start"), "loss_length")


def read_turns(text: Column) -> Column:
    """array<struct<role,text>> of a formatted text, unescaped."""
    parts = F.slice(F.split(text, r"<\|im_start\|>", -1), F.lit(2), F.lit(2_000_000_000))
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
            unescape(F.substring(p, F.instr(p, "\n") + 1, F.length(p) - F.instr(p, "\n") - len(END))).alias("text"),
        ),
    )


def read_loss(text: Column, start: Column, length: Column) -> Column:
    """What stands under an example's loss mask, unescaped."""
    return unescape(F.substring(text, start + 1, length))


def digests(found: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Digests by conversation of `examples`' rows, read back from their texts: n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars (over all its examples)."""
    whole = F.when(F.col("is_whole"), read_turns(F.col("text")))
    line = F.array_join(F.transform("turns_", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = found.select(conv, F.length("text").alias("chars_"), F.struct("example", read_loss(F.col("text"), F.col("loss_start"), F.col("loss_length")).alias("x")).alias("loss_"), whole.alias("turns_"))
    read = read.select(conv, "chars_", "loss_", F.size("turns_").alias("n_"), F.sha2(line, 256).alias("sha_"))
    out = read.groupBy(conv).agg(F.max(F.when(F.col("sha_").isNotNull(), F.col("n_"))).cast("long").alias("n_turns"), F.max("sha_").alias("turns_sha256"), F.array_join(F.transform(F.sort_array(F.collect_list("loss_")), lambda s: s["x"]), "").alias("loss_text"), F.sum("chars_").alias("formatted_chars"))
    return out.select(conv, "n_turns", "turns_sha256", F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars")
