"""Chat formatting by perspective rotation.

A conversation is rendered once for every participant: that participant's turns as the
assistant's, which are trained on, and all others' as turns of named users. The result
has one row per participant and turn: the rendered turn, where it begins and ends in the
whole rendering (in code points), and the span to train on. Rows of one rendering in the
order of `start` join to the dialogue; no task ever holds a whole dialogue. Turns are
sorted over all tasks by ranges, and what a task has got is a block: sums of blocks are
running sums over few rows, and only a conversation's turns within a block are numbered in
one task. So conversations of any length, and turns that all have one number or none, are
spread like others.

A null role is the speaker "unknown", a null text is empty, null turns come first; turns
with equal numbers are ordered by speaker and text, and repeated rows are turns each, in no
set order. A null conversation id is a conversation. Very long texts are taken whole. Other
columns, whatever their names, are left out. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm._spark import saved

ASSISTANT, USER, END = "<|assistant|>", "<|user|>", "<|end|>\n"


def rotate(conversations: DataFrame, blocks: int | None = None) -> DataFrame:
    """conv_id, perspective, turn, position, speaker, trained, rendered, start, mask_start, mask_end, end. blocks: how many at most, as many as there are shuffle partitions if not said."""
    turns = conversations.select(
        F.col("conv_id"), F.col("turn"), F.coalesce("role", F.lit("unknown")).alias("speaker"), F.coalesce("text", F.lit("")).alias("content"), F.monotonically_increasing_id().alias("tie")
    )
    order = ("conv_id", "turn", "speaker", "content", "tie")
    turns = turns.repartitionByRange(blocks, *order) if blocks else turns.repartitionByRange(*order)
    turns = saved(turns.withColumn("block", F.spark_partition_id()), "turns")
    size = F.length("content") + len(END)
    as_user = F.length("speaker") + len(USER) + 2

    # Sums of each block and speaker; a rendering's length before a block follows from them.
    sums = turns.groupBy("conv_id", "block", "speaker").agg(
        F.count(F.lit(1)).alias("n"), F.sum(size).cast("long").alias("all"), F.sum(as_user).cast("long").alias("user"), F.sum(F.lit(len(ASSISTANT))).cast("long").alias("own")
    )
    blocks_of = sums.groupBy("conv_id", "block").agg(F.sum("n").alias("n"), F.sum(F.col("all") + F.col("user")).alias("length"))
    speakers = sums.select("conv_id", F.col("speaker").alias("perspective")).distinct()
    own = sums.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), F.col("speaker").alias("s"), (F.col("own") - F.col("user")).alias("change"))
    both = blocks_of.join(speakers, blocks_of["conv_id"].eqNullSafe(speakers["conv_id"])).select(blocks_of["conv_id"], "block", "n", "length", "perspective")
    both = both.join(own, both["conv_id"].eqNullSafe(own["c"]) & (both["block"] == own["b"]) & (both["perspective"] == own["s"]), "left")
    earlier = Window.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begins = both.select(
        F.col("conv_id").alias("c"),
        F.col("block").alias("b"),
        "perspective",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("turns_before"),
        F.coalesce(F.sum(F.col("length") + F.coalesce("change", F.lit(0))).over(earlier), F.lit(0)).alias("length_before"),
    )
    rows = turns.join(begins, turns["conv_id"].eqNullSafe(begins["c"]) & (turns["block"] == begins["b"]))
    trained = F.col("speaker") == F.col("perspective")
    head = F.when(trained, F.lit(ASSISTANT)).otherwise(F.concat(F.lit(USER), F.col("speaker"), F.lit(": ")))
    rows = rows.select("*", trained.alias("trained"), head.alias("head"), F.concat("content", F.lit(END)).alias("body"))
    within = Window.partitionBy("conv_id", "block", "perspective").orderBy("turn", "speaker", "content", "tie")
    end = F.col("length_before") + F.sum(F.length("head") + F.length("body")).over(within.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.select("*", (F.col("turns_before") + F.row_number().over(within) - 1).alias("position"), end.alias("end"))
    return rows.select(
        "conv_id",
        "perspective",
        "turn",
        F.col("position").cast("long").alias("position"),
        "speaker",
        "trained",
        F.concat("head", "body").alias("rendered"),
        (F.col("end") - F.length("head") - F.length("body")).cast("long").alias("start"),
        F.when(F.col("trained"), F.col("end") - F.length("body")).cast("long").alias("mask_start"),
        F.when(F.col("trained"), F.col("end") - 1).cast("long").alias("mask_end"),
        F.col("end").cast("long").alias("end"),
    )
