"""Chat formatting by prefix-target expansion, with DataFrame functions alone.

Every assistant turn becomes an example of its own: all turns before it are
context, and only that reply is under the loss mask.  Turns after the last
reply make one more example without a target, so that nothing is lost.

A turn is written ``### <role>: <text></turn>`` and a line end.  Within roles
and texts a backslash is written ``\\\\``, ``###`` as ``\\h`` and ``</turn>``
as ``\\e`` (in roles also ``:`` as ``\\c``), so no text can imitate a mark and
:func:`parsed` gets every turn back.

Null text or role: empty. Turns are ordered by turn, then role, then text;
null turns come first; repeated rows are repeated turns. A null conv_id is a
conversation. No rows: no examples. A conversation is one row while it is
formatted; its examples are as long as their contexts, which is the feature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
_CODES = (("###", "\\h"), ("</turn>", "\\e"))


def escaped(text: Column, role: bool = False) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for raw, code in (*_CODES, (":", "\\c")) if role else _CODES:
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    """Codes are read from left to right: double backslashes are set apart first."""

    def part(x: Column) -> Column:
        for raw, code in (*_CODES, (":", "\\c")):
            x = F.replace(x, F.lit(code), F.lit(raw))
        return x

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), part), "\\")


def conversations_of(rows: DataFrame) -> DataFrame:
    """One row a conversation: conv_id and ``turns``, an ordered array of (turn, role, text)."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turn = F.struct(F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"))
    one = rows.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    return one.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))


def examples(rows: DataFrame, target: str = "assistant") -> DataFrame:
    """conv_id, example, formatted, loss_start, loss_end: code points, the end exclusive; equal where there is no target."""
    conv = conversations_of(rows)
    head = lambda t: F.concat(F.lit(OPEN), escaped(t["role"], True), F.lit(MIDDLE))
    parts = F.transform("turns", lambda t: F.struct(head(t).alias("head"), escaped(t["text"]).alias("body"), (t["role"] == target).alias("goal")))
    at = F.filter(F.transform("parts", lambda p, i: F.struct(i.alias("i"), p["goal"].alias("goal"))), lambda x: x["goal"] | (x["i"] == F.size("parts") - 1))
    each = conv.select("conv_id", parts.alias("parts")).select("conv_id", "parts", F.posexplode(at).alias("example", "last"))
    whole = lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))
    context = F.array_join(F.transform(F.slice("parts", F.lit(1), F.col("last.i")), whole), "")
    each = each.select("conv_id", "example", context.alias("context"), F.element_at("parts", F.col("last.i") + 1).alias("reply"), "last")
    start = F.length("context") + F.length("reply.head")
    return each.select(
        "conv_id", "example", F.concat("context", whole(F.col("reply"))).alias("formatted"), start.cast("long").alias("loss_start"),
        (start + F.when(F.col("last.goal"), F.length("reply.body")).otherwise(0)).cast("long").alias("loss_end"),
    )


def parsed(formatted: Column) -> Column:
    """The turns of a formatted example: an array of (role, text), unescaped."""
    turns = F.split(formatted, CLOSE, -1)
    turns = F.slice(turns, 1, F.size(turns) - 1)

    def read(x: Column) -> Column:
        cut = F.instr(x, MIDDLE)  # a role has no colon, so the first one ends it
        role = F.substring(x, F.lit(len(OPEN) + 1), cut - len(OPEN) - 1)
        return F.struct(unescaped(role).alias("role"), unescaped(F.substring(x, cut + len(MIDDLE), F.length(x))).alias("text"))

    return F.transform(turns, read)


def read_back(made: DataFrame) -> DataFrame:
    """Per conversation, from its examples: n_turns, digest of all turns, and what lies under the loss masks."""
    loss = unescaped(F.substring(F.col("formatted"), (F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int")))
    one = made.select("conv_id", "example", "formatted", loss.alias("loss"))
    # The last example holds the whole conversation, and there are at most as many as it has turns.
    conv = one.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("whole"), F.array_sort(F.collect_list(F.struct("example", "loss"))).alias("losses"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"), F.count("*").alias("n_examples"),
    )
    conv = conv.select("conv_id", parsed(F.col("whole")).alias("turns"), F.array_join("losses.loss", "").alias("loss"), "formatted_chars", "n_examples")
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return conv.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(text.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars", "n_examples",
    )
