"""Chat formatting with Spark expressions only: sort collected turns, merge runs of one role, escape, concatenate.

A run of turns of one role is one block of the output:

    <|im_start|>role<|im_sep|>text<|im_join|>text<|im_end|>

The texts of a run are divided by <|im_join|>, so reading back gives the turns as they were. Inside roles and texts a
backslash is put behind the first character of everything that could be read as a control string, of this template or
of others, and before every backslash; unescaping drops it. No control string is left in an escaped text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, JOIN, END = "<|im_start|>", "<|im_sep|>", "<|im_join|>", "<|im_end|>"
#: Role whose texts are learned.
LEARNED = "assistant"

#: What control strings begin with: <| of this and similar templates, <s> </s> <<SYS>> [INST] [/INST].
_OPENINGS = r"(?:(?<=<)(?=\||/?s>|<)|(?<=\[)(?=/?INST\]))"


def escaped(text: Column) -> Column:
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(doubled, _OPENINGS, r"\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def collected(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns, sorted by turn (null first), then role and text. Null roles and texts count as empty."""
    turn = F.struct(
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))


def _runs(turns: Column) -> Column:
    """Adjacent turns of one role merged: role and texts."""
    n = F.size(turns)
    places = F.sequence(F.lit(0), n - 1)
    role = lambda i: F.get(turns, i)["role"]
    firsts = F.filter(places, lambda i: (i == 0) | (role(i) != role(i - 1)))
    return F.transform(
        firsts,
        lambda i, k: F.struct(
            role(i).alias("role"),
            F.transform(F.slice(turns, i + 1, F.coalesce(F.get(firsts, k + 1), n) - i), lambda t: t["text"]).alias("texts"),
        ),
    )


def _blocks(runs: Column) -> Column:
    """The output of each run, and which of its pieces are learned: an array of (text, learned) for each run."""

    def pieces(run: Column) -> Column:
        head = F.concat(F.lit(START), escaped(run["role"]), F.lit(SEP))
        texts = F.transform(run["texts"], lambda text, i: F.array(
            F.struct(F.when(i == 0, head).otherwise(F.lit(JOIN)).alias("text"), F.lit(False).alias("learned")),
            F.struct(escaped(text).alias("text"), (run["role"] == LEARNED).alias("learned")),
        ))
        end = F.array(F.struct(F.lit(END + "\n").alias("text"), F.lit(False).alias("learned")))
        return F.concat(F.flatten(texts), end)

    return F.flatten(F.transform(runs, pieces))


def formatted(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted and loss_mask of each conversation.

    ``loss_mask`` has (start, length) in code points of each learned text in ``formatted``. A conversation is one row, so
    its turns have to fit into a task; the shuffle is by conv_id. Turns with the same number are ordered by role and text,
    repeated rows are kept as turns of their own, rows without conv_id are one conversation, other columns aren't
    read, and an empty table gives no rows.
    """
    pieces = collected(conversations).select("conv_id", _blocks(_runs(F.col("turns"))).alias("pieces"))
    start = F.struct(F.lit(0).cast("long").alias("place"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def onward(so_far: Column, piece: Column) -> Column:
        length = F.length(piece["text"]).cast("long")
        span = F.array(F.struct(so_far["place"].alias("start"), length.alias("length")))
        return F.struct(
            (so_far["place"] + length).alias("place"),
            F.when(piece["learned"], F.concat(so_far["spans"], span)).otherwise(so_far["spans"]).alias("spans"),
        )

    return pieces.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"),
        F.aggregate("pieces", start, onward, lambda a: a["spans"]).alias("loss_mask"),
    )


def turns_of(text: Column) -> Column:
    """The turns (role, text) read back from a formatted conversation."""
    literal = lambda mark: mark.replace("|", r"\|")
    blocks = F.filter(F.split(text, literal(END) + "\n"), lambda b: b != "")

    def turns(block: Column) -> Column:
        parts = F.split(F.substring(block, len(START) + 1, 2147483647), literal(SEP))
        return F.transform(
            F.split(parts[1], literal(JOIN)),
            lambda t: F.struct(unescaped(parts[0]).alias("role"), unescaped(t).alias("text")),
        )

    return F.flatten(F.transform(blocks, turns))


def learned_of(text: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(mask, lambda m: unescaped(F.substring(text, (m["start"] + 1).cast("int"), m["length"].cast("int")))), "")
