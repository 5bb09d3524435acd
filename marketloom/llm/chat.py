"""Multi-party chat formatting by perspective rotation.

Every speaker of a conversation gets the whole dialogue from their own side: their turns are the
assistant's, everybody else is a user with a name, and a mask marks the characters that the assistant
says (and the end marks it has to learn). System turns instruct and are nobody's side; they stay
as they are in every rendering.

A rendering is cut into parts by turn number (`turn div turns_per_part`), so a conversation of any length
is spread over many rows and none is gathered whole; joined by part, the texts are the dialogue. A
part is made from the turns of its own range and from the list of the conversation's speakers.

Cases: a null text is an empty turn; a null role speaks as "unknown"; turns without a number come
first, in a part of their own (-1); turns of one number are ordered by role and text, and rows that
repeat number, role and text are one turn; a conversation of system turns alone has no speaker
and no rendering; a null conversation id is a conversation of its own; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYSTEM = "system"
UNKNOWN = "unknown"
TURNS_PER_PART = 64
OPEN, CLOSE = "<|", "|>"
END = "<|end|>\n"


def _header(role: Column, speaker: Column) -> Column:
    name = F.when(role == speaker, "assistant").when(role == SYSTEM, SYSTEM).otherwise(F.concat(F.lit("user name="), role))
    return F.concat(F.lit(OPEN), name, F.lit(CLOSE), F.lit("\n"))


def perspectives(
    turns: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    turns_per_part: int = TURNS_PER_PART,
) -> DataFrame:
    """`conv_id`, `speaker`, `part`, `n_turns`, `rendered`, `mask`, `masked_chars`.

    mask: array of (start, end) places in `rendered`, end exclusive, in characters."""
    said = turns.select(
        F.col(id_col).alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit(UNKNOWN)).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).distinct()
    part = F.coalesce(F.floor(F.col("turn") / turns_per_part), F.lit(-1)).cast("long")
    parts = said.groupBy("conv_id", part.alias("part")).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    speakers = said.filter(F.col("role") != SYSTEM).select(F.col("conv_id").alias("of"), F.col("role").alias("speaker")).distinct()
    sides = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("of")))
    piece = lambda t: F.struct(
        _header(t["role"], F.col("speaker")).alias("head"), F.concat(t["text"], F.lit(END)).alias("body"), (t["role"] == F.col("speaker")).alias("own")
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def place(acc: Column, p: Column) -> Column:
        begin = acc["at"] + F.char_length(p["head"])
        end = begin + F.char_length(p["body"])
        span = F.array(F.struct(begin.alias("start"), end.alias("end"))).cast("array<struct<start:int,end:int>>")
        return F.struct(end.alias("at"), F.when(p["own"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    made = sides.select("conv_id", "speaker", "part", F.transform("turns", piece).alias("pieces"))
    masked = made.withColumn("mask", F.aggregate("pieces", start, place, lambda acc: acc["spans"]))
    return masked.select(
        "conv_id",
        "speaker",
        "part",
        F.size("pieces").cast("long").alias("n_turns"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), "").alias("rendered"),
        "mask",
        F.aggregate("mask", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"]).alias("masked_chars"),
    )
