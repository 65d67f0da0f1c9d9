"""Taking candidates one at a time by list ranking.

A candidate's successor is the first one that enters after it has exited. Candidates are cut into blocks of time. Inside a
block the chain of successors is followed from every candidate at once, which gives where each leaves the block; between
blocks pointers are doubled until all blocks are marked that the chain of the first candidate enters. Blocks are then
walked by themselves. No task needs more of a symbol than a block, and rounds grow with the logarithm of the blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.sources.scratch import settled

#: Length of a block, in microseconds of time or in numbers of bars.
OF_TIME, OF_BARS = 64 * 86_400_000_000, 1 << 16


def micros(time: str) -> Column:
    return F.unix_micros(F.col(time).cast("timestamp"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by symbol and block, a block at a time."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        symbol, block = batch.column("symbol").dictionary_encode().indices.to_numpy(zero_copy_only=False), batch.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero((symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = batch.slice(a, b - a)
            if rest and (rest[0].column("symbol")[0], rest[0].column("block")[0]) != (part.column("symbol")[0], part.column("block")[0]):
                yield pa.Table.from_batches(rest)
                rest = []
            rest.append(part)
    if rest:
        yield pa.Table.from_batches(rest)


def _chain(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries and exits in order, and the place of each one's successor."""
    a, b = (table.column(c).to_numpy() for c in ("a", "b"))
    return a, b, np.searchsorted(a, b, side="right")


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each entry the exit of the last one of its chain that enters in its block."""
    for table in _blocks(batches):
        a, b, after = _chain(table)
        leave = b.copy()
        for i in range(len(a) - 1, -1, -1):
            if after[i] < len(a):
                leave[i] = leave[after[i]]
        first = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
        take = pa.array(first)
        yield pa.RecordBatch.from_arrays([*(table.column(c).combine_chunks().take(take) for c in ("symbol", "block")), pa.array(a[first]), pa.array(leave[first])], names=["symbol", "block", "a", "leave"])


def _taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Those of a block's candidates that are taken, from where the chain enters it."""
    for table in _blocks(batches):
        a, b, after = _chain(table)
        enter = table.column("enter")[0].as_py()
        at, found = int(np.searchsorted(a, enter)), []
        while at < len(a):
            found.append(at)
            at = int(after[at])
        take = pa.array(np.array(found, dtype=np.int64))
        yield pa.RecordBatch.from_arrays([table.column(c).combine_chunks().take(take) for c in ("symbol", "a", "b")], names=["symbol", "a", "b"])


def _entered(leaves: DataFrame, length: int) -> DataFrame:
    """symbol, block and enter: where the chain of a symbol's first candidate enters each of its blocks."""
    block = lambda c: F.floor(F.col(c) / length)
    asked = leaves.select("symbol", F.col("leave").alias("at"), F.lit(1).alias("kind")).distinct()
    both = leaves.select("symbol", F.col("a").alias("at"), F.lit(0).alias("kind")).unionByName(asked).withColumn("block", block("at"))
    inside = Window.partitionBy("symbol", "block").orderBy("at", "kind").rowsBetween(1, Window.unboundedFollowing)
    later = Window.partitionBy("symbol").orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    entry = F.when(F.col("kind") == 0, F.col("at"))
    beyond = both.groupBy("symbol", "block").agg(F.min(entry).alias("first")).select("symbol", "block", F.first("first", ignorenulls=True).over(later).alias("beyond"))
    after = both.withColumn("near", F.first(entry, ignorenulls=True).over(inside)).where("kind = 1").join(beyond, ["symbol", "block"])
    after = after.select("symbol", F.col("at").alias("leave"), F.coalesce("near", "beyond").alias("to")).where("to is not null")
    jump = settled(leaves.join(after, ["symbol", "leave"]).select("symbol", "a", "to"))
    marked = settled(leaves.groupBy("symbol").agg(F.min("a").alias("a")))
    count = marked.count()
    while True:
        marked = settled(marked.unionByName(marked.join(jump, ["symbol", "a"]).select("symbol", F.col("to").alias("a"))).distinct())
        now = marked.count()
        if now == count:
            break
        count = now
        twice = jump.select("symbol", F.col("a").alias("to"), F.col("to").alias("then"))
        jump = settled(jump.join(twice, ["symbol", "to"]).select("symbol", "a", F.col("then").alias("to")))
    return marked.select("symbol", block("a").alias("block"), F.col("a").alias("enter"))


def one_at_a_time(candidates: DataFrame, wait: int = 0, length: int | None = None) -> DataFrame:
    """Of candidates (symbol, entry_ts, exit_ts, ...; times, or numbers of bars) those taken when each enters after the last one taken has exited, and wait has passed (microseconds or bars). The first to enter, and of those the first to exit, is taken first."""
    timed = candidates.schema["entry_ts"].dataType.simpleString().startswith("timestamp")
    number = micros if timed else (lambda c: F.col(c).cast("long"))
    length = length or (OF_TIME if timed else OF_BARS)
    a = number("entry_ts")
    base = settled(candidates.withColumns({"a": a, "b": F.greatest(number("exit_ts"), a) + wait, "block": F.floor(a / length)}))
    rows = base.select("symbol", "block", "a", "b").repartition("symbol", "block").sortWithinPartitions("symbol", "block", "a", "b")
    if base.groupBy("symbol").agg(F.countDistinct("block").alias("n")).where("n > 1").isEmpty():
        entered = base.groupBy("symbol", "block").agg(F.min("a").alias("enter"))
    else:
        entered = _entered(settled(rows.mapInArrow(_leaves, "symbol string, block long, a long, leave long")), length)
    rows = base.select("symbol", "block", "a", "b").join(entered, ["symbol", "block"]).repartition("symbol", "block").sortWithinPartitions("symbol", "block", "a", "b")
    taken = rows.mapInArrow(_taken, "symbol string, a long, b long").distinct()
    return base.join(taken, ["symbol", "a", "b"], "left_semi").drop("a", "b", "block")
