"""Quantiles by rank and merged sketches against exact ones."""

import datetime as dt
import math
import random

from pyspark.sql import functions as F

from tidebar.operators import quantiles as Q
from tidebar.operators import tables as T


def test_quantiles_by_rank_are_exact(spark):
    rng = random.Random(3)
    rows = [("hot", rng.gauss(0, 1) if k % 3 else 0.25) for k in range(6000)] + [("ties", float(k % 2)) for k in range(501)] + [("one", 7.5), ("nulls", None), ("nulls", None), (None, 1.0), (None, 2.0), ("mixed", None), ("mixed", 3.0), ("mixed", -5.0)]
    rows += [("ends", x) for x in (float("inf"), 1.0, 2.0, -1e308, 1e308)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "symbol string, v double, _rank int, part int")
    at = (0.0, 0.01, 0.1, 0.5, 0.75, 0.99, 1.0)
    got = {r["symbol"]: r for r in Q.ranked_quantiles(df, "v", at).collect()}
    want = {r["symbol"]: r for r in T.quantiles(df, "v", at).collect()}
    assert set(got) == set(want) == {"hot", "ties", "one", "nulls", None, "mixed", "ends"}
    for key, row in want.items():
        for a, b in zip(got[key][1:], row[1:], strict=True):
            assert a == b or (a is not None and b is not None and (math.isclose(a, b, rel_tol=1e-12) or math.isnan(a) and math.isnan(b))), (key, got[key], row)
    two = {(r["symbol"], r["part"]): r["p50"] for r in Q.ranked_quantiles(df, "v", (0.5,), ("symbol", "part")).collect()}
    assert two["ties", 2] == 0.0 and two["mixed", 2] == -1.0 and len(two) == 7
    assert Q.ranked_quantiles(df.where("false"), "v").count() == 0


def test_a_large_group_is_many_ranges(spark):
    df = spark.range(40_000).select(F.lit("a").alias("symbol"), F.hash("id").cast("double").alias("v"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranged = df.groupBy("symbol", "v").count().repartitionByRange("symbol", "v").groupBy(F.spark_partition_id().alias("p")).count().collect()
        got = Q.ranked_quantiles(df, "v").first()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(ranged) == 4 and max(r["count"] for r in ranged) < 20_000
    assert tuple(got) == tuple(T.quantiles(df, "v").first())


def test_sketches_merge(spark):
    start = dt.datetime(2024, 1, 2, 9)
    rows = [(s, start + dt.timedelta(days=d, minutes=k), (start + dt.timedelta(days=d)).date(), f"{s}{d // 10}") for s, n in (("A", 400), ("B", 3)) for d in range(30) for k in range(n)]
    bars = spark.createDataFrame(rows + [("C", None, None, None)], "symbol string, ts timestamp, trading_date date, contract string")
    exact = {r["symbol"]: r for r in T.distinct_counts(bars).collect()}
    days = Q.distinct_sketches(bars)
    for got in (Q.merged_distinct(days).collect(), Q.merged_distinct(days.unionByName(Q.distinct_sketches(bars.where("symbol = 'A'")))).collect()):
        assert {r["symbol"] for r in got} == set(exact)
        for r in got:
            assert (r["dates"], r["contracts"]) == (exact[r["symbol"]]["dates"], exact[r["symbol"]]["contracts"])
            assert abs(r["times"] - exact[r["symbol"]]["times"]) <= 0.05 * exact[r["symbol"]]["times"]  # three standard errors
    assert Q.merged_distinct(Q.distinct_sketches(bars.where("false"))).count() == 0
