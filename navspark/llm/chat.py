"""Multi-party dialogues seen from each participant in turn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

START, END = "<|im_start|>", "<|im_end|>"
SYSTEM = "system"
NOBODY = "unknown"
#: Turns whose offsets are summed in one task.
BLOCK = 512


def _defused(text: Column) -> Column:
    """Text in which no control mark can be read."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def perspectives(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per dialogue, participant and turn: the turn as that participant's training text has it.

    ``perspective`` is the speaker who plays the assistant. Its own turns have role assistant, all
    others' role user and their speaker's name; system turns stay system turns, and system is no participant. ``rendered``
    is the turn's text in the template, ``start_char`` its place in the whole, which is all of the perspective's rows
    strung together by ``position``; ``mask_start`` and ``mask_end`` bound what is trained on, the
    assistant's words and their end mark, and are null in other turns.

    Turns are ordered by turn, null first, then role, then text; repeated rows are turns of their own. A null role
    is the participant ``unknown``, a null text is empty, and control marks inside texts and
    names are broken up. Dialogues with no participant, and rows without dialogue id, give no rows.
    """
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        _defused(F.coalesce(F.col(role_col).cast("string"), F.lit(NOBODY))).alias("speaker"), _defused(F.col(text_col)).alias("content"),
    )
    # Turns are cut into blocks by number, so that a dialogue of any length is numbered in many tasks.
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 60))))
    seats = rows.where(F.col("speaker") != SYSTEM).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    seen = rows.join(seats, "conv_id")
    own = F.col("speaker") == F.col("perspective")
    role = F.when(F.col("speaker") == SYSTEM, SYSTEM).when(own, "assistant").otherwise("user")
    name = F.when(role == "user", F.col("speaker"))
    head = F.concat(F.lit(START), role, F.coalesce(F.concat(F.lit(" name="), name), F.lit("")), F.lit("\n"))
    seen = seen.withColumns({"role": role, "name": name, "head": F.length(head), "rendered": F.concat(head, "content", F.lit(END + "\n"))})
    seen = seen.withColumn("size", F.length("rendered").cast("long"))
    keys = ["conv_id", "perspective"]
    blocks = seen.groupBy(*keys, "block").agg(F.count("*").alias("n"), F.sum("size").alias("chars"))
    before = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        *keys, "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("turns_before"), F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("chars_before")
    )
    order = Window.partitionBy(*keys, "block").orderBy("turn", "speaker", "content")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    placed = seen.join(blocks, [*keys, "block"]).withColumns(
        {
            "position": (F.col("turns_before") + F.row_number().over(order) - 1).cast("long"),
            "start_char": F.col("chars_before") + F.sum("size").over(upto) - F.col("size"),
        }
    )
    trained = F.col("role") == "assistant"
    return placed.select(
        "conv_id", "perspective", "position", "turn", "role", "name", "rendered", "start_char",
        F.when(trained, F.col("start_char") + F.col("head")).alias("mask_start"),
        F.when(trained, F.col("start_char") + F.col("size") - 1).alias("mask_end"),
    )
