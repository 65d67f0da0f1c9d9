"""Exact duplicates by distributed MSD radix partitioning.

Documents are split by successive bytes of the normalised text: each round a group is divided by its next digit (a run
of bytes, wider each round) until a group has one document or all its texts have ended. Groups that ended hold equal
texts: every byte was compared as a digit, and no digest decides equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.llm.store import small, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of the first digit, how much wider each next one is, and the widest.
FIRST_DIGIT, WIDER, WIDEST = 256, 16, 1 << 18


def normalised(text: Column) -> Column:
    """A-Z lower-cased, nothing else; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256 (and with carry, row: a struct of all its columns).

    Null text equals empty text. Of equal texts the row with the largest id stays; a null id counts as smaller than any
    other, and of rows that also share that id just one stays. Empty tables give no rows; further columns are not looked
    at, so their names cannot clash. Rows are told apart by their number in a written table. A group of any size is only ever counted with
    map-side combining and joined, which adaptive execution splits if skewed.
    """
    text = normalised(F.col(text_col))
    base = docs.select(
        F.col(id_col).alias("doc_id"), F.sha2(text, 256).alias("text_sha256"), F.struct("*").alias("row") if carry else text.cast("binary").alias("body"), F.lit(0).cast("long").alias("node"),
    )
    body = normalised(F.col(f"row.{text_col}")).cast("binary") if carry else F.col("body")
    active, depth, width, done = base, 0, FIRST_DIGIT, []
    while True:
        active = active.withColumn("digit", F.substring(body, depth + 1, width))
        split = active.groupBy("node", "digit").agg(F.count("*").alias("group_size"), F.max("doc_id").alias("keep"))
        split = written(split.where("group_size > 1").withColumn("child", F.monotonically_increasing_id()), "radix-groups")
        over = F.col("child").isNull() | (F.length("digit") < width)
        state = active.join(split.hint("merge"), ["node", "digit"], "left").withColumn("over", over).drop("digit", "node")
        if not carry:  # a text that is placed is not needed any longer
            state = state.withColumn("body", F.when(~F.col("over"), F.col("body")))
        state = written(state.withColumn("tie", F.monotonically_increasing_id()), "radix")
        done.append(state.where("over"))
        active = state.where("not over").drop("group_size", "keep", "over", "tie").withColumnRenamed("child", "node")
        if split.where(F.length("digit") == width).isEmpty():
            break
        depth, width = depth + width, min(width * WIDER, WIDEST)
    out = None
    for part in done:
        alone, first = F.col("child").isNull(), F.col("doc_id").eqNullSafe(F.col("keep"))
        # rows that share the largest id: one of them, by its number in the written table
        twice = part.where(~alone & first).groupBy("child").agg(F.count("*").alias("n"), F.max("tie").alias("one")).where("n > 1").drop("n")
        part = part.join(small(written(twice, "twice")), "child", "left").select(
            "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
            (alone | (first & (F.col("one").isNull() | (F.col("tie") == F.col("one"))))).alias("kept"), "text_sha256", *(["row"] if carry else []),
        )
        out = part if out is None else out.unionByName(part)
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts, all columns as they were; nulls, repeated rows and empty tables as in exact_groups."""
    kept = exact_groups(docs, id_col, text_col, carry=True).where("kept")
    return kept.select("row.*")
