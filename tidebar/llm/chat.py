"""Chat formatting by multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant and all others as
named users; only the assistant's text is trained on. A rendered dialogue is a run of segments with their places in it,
so that a conversation of any length spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns of a conversation that share a window partition.
BLOCK = 256


def harmless(text: Column) -> Column:
    """text with a blank inside every opening of a mark, so that no turn can write one."""
    return F.replace(text, F.lit("<|im_"), F.lit("< |im_"))


def render(role: Column, name: Column, text: Column) -> tuple[Column, Column]:
    """Opening mark, and text with the closing mark, of one turn."""
    return F.concat(F.lit("<|im_start|>"), role, F.when(name.isNotNull(), F.concat(F.lit(" name="), name)).otherwise(""), F.lit("\n")), F.concat(text, F.lit("<|im_end|>\n"))


def perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", context: tuple[str, ...] = ("system",)) -> DataFrame:
    """One row per conversation, perspective and turn: conv_id, speaker, turn, seq, role, name, segment, start, end, train_start, train_end.

    speaker: the participant who is the assistant. start and end place the segment in the rendered dialogue, in
    characters; train_start and train_end (null unless the turn is the speaker's) enclose what the loss is taken on, the
    text and its closing mark. Roles in context belong to nobody: they are rendered by their own name and never trained
    on. Null text is empty; a null role is the participant 'unknown'; null turns come first; ties are ordered by role,
    then text, and repeated rows are repeated turns. Null conversation ids are one conversation. A conversation of
    context only has no perspective. Texts, names and roles that write a mark (<|im_...) have a blank put into it, and line
    ends in names and roles become blanks. Empty tables give no rows; further columns are not looked at. Each block of turns is
    numbered and measured by itself and the blocks' sums are added up, so no task needs a whole conversation.
    """
    base = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("unknown")).alias("who"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.withColumn("block", F.floor(F.coalesce("turn", F.lit(-1)) / F.lit(BLOCK)))
    speakers = base.where(~F.col("who").isin(*context)).select(F.col("conv_id").alias("c"), F.col("who").alias("speaker")).distinct()
    rows = base.join(speakers, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    own, aside = F.col("who") == F.col("speaker"), F.col("who").isin(*context)
    role = F.when(own, "assistant").when(aside, F.col("who")).otherwise("user")
    name = F.when(~own & ~aside, F.col("who"))
    head, body = render(harmless(F.translate(role, "\r\n", "  ")), harmless(F.translate(name, "\r\n", "  ")), harmless(F.col("text")))
    rows = rows.select("conv_id", "speaker", "turn", "block", "who", role.alias("role"), name.alias("name"), own.alias("own"), F.concat(head, body).alias("segment"), F.length(head).alias("head"), F.length(F.concat(head, body)).cast("long").alias("size"))
    sums = rows.groupBy("conv_id", "speaker", "block").agg(F.sum("size").alias("chars"), F.count("*").alias("turns"))
    before = Window.partitionBy("conv_id", "speaker").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("conv_id").alias("c"), F.col("speaker").alias("s"), F.col("block").alias("b"), F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("chars_before"), F.coalesce(F.sum("turns").over(before), F.lit(0)).alias("turns_before"))
    rows = rows.join(sums, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("speaker") == F.col("s")) & (F.col("block") == F.col("b"))).drop("c", "s", "b")
    order = Window.partitionBy("conv_id", "speaker", "block").orderBy(F.col("turn").asc_nulls_first(), "who", "segment")
    until = order.rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("chars_before") + F.sum("size").over(until)
    rows = rows.withColumns({"end": end, "seq": F.col("turns_before") + F.row_number().over(order) - 1})
    start = F.col("end") - F.col("size")
    return rows.select(
        "conv_id", "speaker", "turn", "seq", "role", "name", "segment", start.alias("start"), "end", F.when(F.col("own"), start + F.col("head")).alias("train_start"), F.when(F.col("own"), F.col("end")).alias("train_end"),
    )


def dialogues(turns: DataFrame, **columns) -> DataFrame:
    """One row per conversation and perspective: conv_id, speaker, rendered, masks (array of start and end). For conversations that fit in a row."""
    rows = perspectives(turns, **columns)
    every = F.array_sort(F.collect_list(F.struct("seq", "segment", "train_start", "train_end")))
    masks = F.transform(F.filter("all", lambda x: x["train_start"].isNotNull()), lambda x: F.struct(x["train_start"].alias("start"), x["train_end"].alias("end")))
    return rows.groupBy("conv_id", "speaker").agg(every.alias("all")).select("conv_id", "speaker", F.array_join(F.transform("all", lambda x: x["segment"]), "").alias("rendered"), masks.alias("masks"))
