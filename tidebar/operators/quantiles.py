"""Exact quantiles without a buffer for each group, and distinct counts that can be merged."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.sources.scratch import settled


def ranked_quantiles(df: DataFrame, x: str, at: Sequence[float] = (0.01, 0.5, 0.99), keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Exact quantiles with linear interpolation, as quantiles of tables gives them, for groups of any size.

    Equal values are counted together and dealt out in order of keys and value, so that a large group is many ranges. How
    many rows a group has in each range tells which ranges hold the ranks that are asked for, and only these are read
    again, each in order by itself. NULLs of x do not count (a group without other values has NULL quantiles), NaN is the
    greatest value, a NULL key is a group; an empty table gives no rows.
    """
    keys = list(keys)
    counted = df.select(*keys, F.col(x).cast("double").alias("_x")).groupBy(*keys, "_x").agg(F.count("_x").alias("_n"))
    ranged = settled(counted.repartitionByRange(*keys, "_x").withColumn("_part", F.spark_partition_id()))
    parts = ranged.groupBy(*keys, "_part").agg(F.sum("_n").alias("_rows"))
    so_far = F.sum("_rows").over(Window.partitionBy(*keys).orderBy("_part"))  # one row for each range of a group
    parts = parts.withColumns({"_before": so_far - F.col("_rows"), "_total": F.sum("_rows").over(Window.partitionBy(*keys))})

    place = lambda q: F.lit(float(q)) * (F.col("_total") - 1)
    lower, upper = (lambda q: F.floor(place(q)).cast("long")), (lambda q: F.ceil(place(q)).cast("long"))
    ranks = F.array_distinct(F.array(*(f(q) for q in at for f in (lower, upper))))
    here = F.filter(ranks, lambda k: (k >= F.col("_before")) & (k < F.col("_before") + F.col("_rows")))
    asked = parts.withColumn("_ranks", here).where(F.size("_ranks") > 0).select(*(F.col(k).alias(f"_key_{k}") for k in keys), F.col("_part").alias("_at"), "_before", "_ranks")

    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys), F.col("_part") == F.col("_at"))
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy(*keys, "_part").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0))
    near = ranged.join(asked, same).withColumn("_upto", upto)
    hits = F.filter("_ranks", lambda k: (k >= F.col("_upto") - F.col("_n")) & (k < F.col("_upto")))
    found = near.select(*keys, F.explode(hits).alias("_rank"), "_x")
    # at most two ranks for each quantile asked for
    values = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_x"))).alias("_values")).select(*(F.col(k).alias(f"_key_{k}") for k in keys), "_values")
    groups = parts.groupBy(*keys).agg(F.max("_total").alias("_total"))
    out = groups.join(values, reduce(and_, (F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys), F.lit(True)), "left")

    def quantile(q: float) -> Column:
        a, b = F.element_at("_values", lower(q)), F.element_at("_values", upper(q))
        return F.when((lower(q) == upper(q)) | (a == b), a).otherwise((upper(q) - place(q)) * a + (place(q) - lower(q)) * b)

    return out.select(*keys, *(quantile(q).alias(f"p{round(100 * q):02d}") for q in at))


def distinct_sketches(bars: DataFrame, size: int = 12) -> DataFrame:
    """Per symbol and trading date HyperLogLog sketches of bar times and contracts (2**size registers, standard error about 1.04 / 2**(size / 2)); kept, they are merged with those of later dates without reading the bars again."""
    sketch = lambda c: F.hll_sketch_agg(c, F.lit(size))
    return bars.groupBy("symbol", "trading_date").agg(sketch(F.unix_micros(F.col("ts").cast("timestamp"))).alias("times"), sketch(F.col("contract").cast("string")).alias("contracts"))


def merged_distinct(sketches: DataFrame) -> DataFrame:
    """Per symbol the estimated numbers of times and contracts over all dates and loads, and the exact number of dates."""
    merged = lambda c: F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c)
    return sketches.groupBy("symbol").agg(merged("times"), F.countDistinct("trading_date").alias("dates"), merged("contracts"))
