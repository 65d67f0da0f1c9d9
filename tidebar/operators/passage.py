"""First passages: the first bar from a place on that meets a level, found by way of stretches of 32, 1024, ... bars.

What a stretch must tell whether a bar of it meets a level is kept for each (its extremes, and how far its prices fall below
earlier ones), so a search looks at the few stretches that make up the bars from its place on, and then only into the
first one that meets the level. Bars are mirrored for shorts, so that all searches are those of a long position.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A stretch has 2 ** FAN of those below it. Levels above bars: for bars of one session, and of a symbol's whole history.
FAN, OF_SESSION, OF_SYMBOL = 5, 2, 4


def positions(bars: DataFrame, keys: list[str]) -> DataFrame:
    """bars with pos, from 0 in the order of ts in each series of keys; a whole symbol is numbered by trading dates, which are added up."""
    if "session_id" in keys:
        return bars.withColumn("pos", (F.row_number().over(Window.partitionBy(*keys).orderBy("ts")) - 1).cast("long"))
    before = Window.partitionBy(*keys).orderBy("trading_date").rowsBetween(Window.unboundedPreceding, -1)
    dates = bars.groupBy(*keys, "trading_date").agg(F.count("*").alias("_n")).select(*keys, "trading_date", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"))
    own = F.row_number().over(Window.partitionBy(*keys, "trading_date").orderBy("ts"))
    return bars.withColumn("_k", own).join(dates, [*keys, "trading_date"]).withColumn("pos", F.col("_n") + F.col("_k") - 1).drop("_n", "_k")


def both_sides(bars: DataFrame, keys: list[str], long: dict[str, Column], short: dict[str, Column], inclusive: bool, *shared: Column) -> DataFrame:
    """Bars as the lowest stretches, once a side: long and short (mirrored) give low, top, high, level (low as far as it is to be met by an earlier high) and fall (low where the fall from an earlier high is to be met). inclusive: earlier means up to the bar itself. shared: last, and bar, a struct of what is to be told of it."""
    side = lambda is_long, x: F.struct(F.lit(is_long).alias("is_long"), *(v.alias(k) for k, v in x.items()))
    df = bars.select(*keys, F.col("pos").alias("node"), *shared, F.explode(F.array(side(True, long), side(False, short))).alias("x")).select(*keys, "node", "last", "bar", "x.*")
    none = F.lit(None).cast("double")
    return df.withColumns({"over": F.col("high") - F.col("level") if inclusive else none, "fell": F.col("high") - F.col("fall") if inclusive else none})


def stretches(lowest: DataFrame, keys: list[str], levels: int) -> DataFrame:
    """Rows of both_sides, and above them levels of stretches: over and fell are the most that an earlier high of the stretch is above a level, and above a fall's low."""
    key = [*keys, "is_long"]
    at, out = lowest, lowest.withColumn("tier", F.lit(0))
    kind = lowest.schema["bar"].dataType
    for tier in range(1, levels + 1):
        w = Window.partitionBy(*key, "up").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
        at = at.withColumn("up", F.shiftright("node", FAN)).withColumn("_high", F.max("high").over(w))
        at = at.withColumns({"over": F.greatest("over", F.col("_high") - F.col("level")), "fell": F.greatest("fell", F.col("_high") - F.col("fall"))})
        at = at.groupBy(*key, "up").agg(F.bool_or("last").alias("last"), *(F.min(c).alias(c) for c in ("low", "level", "fall")), *(F.max(c).alias(c) for c in ("top", "high", "over", "fell"))).withColumnRenamed("up", "node")
        out = out.unionByName(at.withColumns({"tier": F.lit(tier), "bar": F.lit(None).cast(kind)}))
    return out


def first_passage(starts: DataFrame, nodes: DataFrame, keys: list[str], by: list[str], levels: int, hit: Callable[[], Column]) -> DataFrame:
    """Each of starts with found: the first bar from pos on that is hit, or NULL.

    starts have keys, is_long, by (which tells them apart), pos (NULL: nothing is looked for), high (the highest price
    before pos that counts, or NULL) and what hit reads. hit: whether a stretch has such a bar, of its columns low, top,
    level, fall, over, fell and last, and _high, the highest price before it. found: pos, bar, low, top, own (the bar's
    high), high (the highest before it).
    """
    own = starts.columns
    of = lambda tier: lambda x: F.struct(F.lit(tier).alias("tier"), x.alias("node"))
    spans = []
    for tier in range(levels + 1):
        a = F.shiftright("pos", FAN * tier) + (1 if tier else 0)
        b = F.shiftright("pos", FAN * tier).bitwiseOR((1 << FAN) - 1)
        spans.append(F.when(a <= b, F.transform(F.sequence(a, b), of(tier))).otherwise(F.array().cast("array<struct<tier:int,node:bigint>>")))
    df = starts.withColumns({"_in": F.col("high"), "_ask": F.when(F.col("pos").isNotNull(), F.flatten(F.array(*spans)))}).drop("high")
    carried = [c for c in own if c != "high"]
    told = ["low", "top", "level", "fall", "over", "fell", "last", "bar"]
    seen = nodes.select(*keys, "is_long", "tier", "node", F.col("high").alias("_own"), *told)
    for tier in range(levels, -1, -1):
        rows = df.select(*carried, "_in", F.explode_outer("_ask").alias("_n")).select(*carried, "_in", "_n.tier", "_n.node")
        rows = rows.join(seen, [*keys, "is_long", "tier", "node"], "left").withColumn("_at", F.call_function("shiftleft", "node", F.col("tier") * FAN))
        w = Window.partitionBy(*by).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("_high", F.greatest("_in", F.max("_own").over(w)))
        first = F.min_by(F.struct("tier", "node", F.col("_at").alias("pos"), "bar", "low", "top", F.col("_own").alias("own"), F.col("_high").alias("high")), F.when(F.coalesce(hit(), F.lit(False)), F.col("_at")))
        df = rows.groupBy(*carried).agg(first.alias("found"))
        if tier:  # into the stretches of this tier; what is found below it is asked for again as it is
            inner = F.sequence(F.shiftleft("found.node", FAN), F.shiftleft("found.node", FAN) + ((1 << FAN) - 1))
            inner = F.transform(inner, lambda x: F.struct((F.col("found.tier") - 1).alias("tier"), x.alias("node")))
            same = F.array(F.struct(F.col("found.tier").alias("tier"), F.col("found.node").alias("node")))
            df = df.select(*carried, F.col("found.high").alias("_in"), F.when(F.col("found.tier") == tier, inner).when(F.col("found").isNotNull(), same).alias("_ask"))
    return df
