"""Connected components of an edge table, by alternating large-star and small-star steps on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm.store import scope, written


def _large(edges: DataFrame) -> DataFrame:
    """Every neighbour greater than a node is linked to the least one around that node."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")  # read as a table, so that a node of very many edges can be split in the join
    return both.join(least.hint("merge"), "u").where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """A node and its lesser neighbours are linked to the least one of them."""
    least = written(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    joined = edges.join(least.hint("merge"), "u")
    return joined.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v of comparable kinds, u and v differing. Returns node and component (its least node), of nodes with edges only.

    Each step is a written table; minima are combined map-side and joins on a node of very many edges can be split.
    """
    keep: list[DataFrame] = []
    with scope(edges.sparkSession, keep):
        edges = _converged(edges)
        keep.append(edges)
    own = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return own.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _converged(edges: DataFrame) -> DataFrame:
    edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).alias("m")
    last = edges.agg(mark).first()["m"]
    while last["n"]:
        edges = written(_small(written(_large(edges), "stars")), "edges")
        now = edges.agg(mark).first()["m"]
        if now == last:
            break
        last = now
    return edges
