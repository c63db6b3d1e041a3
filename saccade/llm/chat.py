"""Chat formatting in DataFrame expressions only.

A conversation's turns are collected as structs and sorted by turn; adjacent turns of one role are merged under one header:

    ### Role: assistant
    text</turn>
    text of the next turn of the same role</turn>

Inside roles and texts a backslash is doubled, ``</turn>`` becomes ``<\\/turn>`` and each # after two # gets a backslash, so
neither control string can occur in them and formatting can be undone exactly; newlines in roles become ``\\n``. The loss mask
is a list of spans of the formatted text, one per assistant text: its turn (turns end in ``</turn>`` and a newline), and the code
points before it within that turn and in it.

Edge cases: null text is empty; a null role is ``\\0``, told apart from an empty one; rows of equal turn are ordered by role, then text;
null turns come first; a null conv_id is one conversation; repeated rows are turns of their own; no rows, no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEADER, END = "### Role: ", "</turn>"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    ended = F.replace(doubled, F.lit(END), F.lit("<\\/turn>"))
    return F.regexp_replace(ended, "(?<=##)#", "\\\\#")


def unescape(text: Column) -> Column:
    """Undoes escape(): a backslash goes, the character after it stays (n of a role's \\n is handled by its caller)."""
    return F.regexp_replace(text, "(?s)\\\\(.)", "$1")


def _escape_role(role: Column) -> Column:
    return F.when(role.isNull(), F.lit("\\0")).otherwise(F.replace(escape(role), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    newline = F.regexp_replace(role, "(?<!\\\\)((?:\\\\\\\\)*)\\\\n", "$1\n")
    return F.when(role == "\\0", F.lit(None)).otherwise(unescape(newline))


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss of turns (conv_id, turn, role, text).

    loss is an array<struct<turn int, start int, length int>> of places in formatted, from 0.
    """
    row = F.struct(F.col("turn"), F.col("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("t"))
    starts = F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: (i == 0) | ~F.get("t", i).role.eqNullSafe(F.get("t", i - 1).role))
    merged = ordered.withColumn("start", starts).select("conv_id", F.transform("start", lambda s, k: F.slice("t", s + 1, F.coalesce(F.get("start", k + 1), F.size("t")) - s)).alias("run"))

    def block(run: Column) -> Column:
        role = F.get(run, F.lit(0)).role
        header = F.concat(F.lit(HEADER), _escape_role(role), F.lit("\n"))
        ours = F.coalesce(role == ASSISTANT, F.lit(False))
        return F.transform(run, lambda x, i: F.struct(F.when(i == 0, header).otherwise(F.lit("")).alias("before"), escape(x.text).alias("text"), ours.alias("loss")))

    written = merged.select("conv_id", F.flatten(F.transform("run", block)).alias("w"))
    text = F.array_join(F.transform("w", lambda x: F.concat(x.before, x.text, F.lit(END + "\n"))), "")
    spans = F.transform("w", lambda x, i: F.when(x.loss, F.struct(i.cast("int").alias("turn"), F.char_length(x.before).alias("start"), F.char_length(x.text).alias("length"))))
    return written.select("conv_id", text.alias("formatted"), F.filter(spans, lambda s: s.isNotNull()).alias("loss"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text, array<struct<role, text>>, from the text alone."""
    pieces = F.split(formatted, END + "\n", -1)
    parts = F.slice(pieces, 1, F.size(pieces) - 1)
    return _turns(parts)


def _turns(parts: Column) -> Column:
    def opens(part: Column) -> Column:
        return F.startswith(part, F.lit(HEADER))

    starts = F.filter(F.sequence(F.lit(1), F.size(parts)), lambda i: opens(F.get(parts, i - 1)))
    ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.size(parts) + 1))

    def run(bounds: Column) -> Column:
        mine = F.slice(parts, bounds.start, bounds.end - bounds.start)
        first = F.get(mine, F.lit(0))
        role = _unescape_role(F.substring(first, F.lit(len(HEADER) + 1), F.locate("\n", first) - len(HEADER) - 1))
        return F.transform(mine, lambda x, i: F.struct(role.alias("role"), unescape(F.when(i == 0, F.substring(x, F.locate("\n", x) + 1, F.char_length(x))).otherwise(x)).alias("text")))

    return F.flatten(F.transform(F.arrays_zip(starts.alias("start"), ends.alias("end")), run))


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from format_conversations()."""
    pieces = formatted.withColumn("pieces", F.split("formatted", END + "\n", -1))
    parts = pieces.withColumn("parts", F.slice("pieces", 1, F.size("pieces") - 1))
    turns = parts.withColumn("turns", _turns(F.col("parts")))
    loss = F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.get("pieces", s.turn), s.start + 1, s.length))), "")
    said = F.array_join(F.transform("turns", lambda x: F.concat(F.coalesce(x.role, F.lit("")), F.lit("\n"), x.text, F.lit("\n"))), "")
    both = turns.select("conv_id", "formatted", F.size("turns").cast("long").alias("n_turns"), said.alias("said"), loss.alias("loss"))
    return both.select(
        "conv_id",
        "n_turns",
        F.sha2(F.col("said").cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
