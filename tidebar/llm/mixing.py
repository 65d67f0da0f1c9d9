"""Mixing sources to target weights by Poisson replication.

Each document's number of copies inverts the Poisson distribution at a uniform value hashed from its id and a seed; the
mean is its source's target repetition rate, so that expected shares of text equal the target weights. Copies are then
shuffled globally by a hashed key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.llm.store import small, written


def uniform(*parts: Column | str | int) -> Column:
    """A value in [0, 1) fixed by the parts: 52 bits of their MD5."""
    text = F.concat_ws(":", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def poisson_cdf(mean: Column) -> Column:
    """Array of P(X <= k) for k = 0, 1, ... until far beyond the resolution of a double."""
    top = F.ceil(mean + 12 * F.sqrt(mean) + 40).cast("int")
    # terms are kept as logarithms: exp(-mean) alone is 0 for means over 745
    zero = F.struct((-mean).alias("p"), F.exp(-mean).alias("c"), F.array(F.exp(-mean)).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        p = F.when(mean > 0, acc["p"] + F.log(mean) - F.log(k.cast("double"))).otherwise(F.lit(float("-inf")))
        c = acc["c"] + F.exp(p)
        return F.struct(p.alias("p"), c.alias("c"), F.array_append(acc["all"], c).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), top), zero, step, lambda acc: acc["all"])


#: Means above this are drawn in equal parts, so that no table of probabilities is longer than some 800.
PART_MEAN = 500.0


def poisson_draw(mean: Column, cdf: Column, id_text: Column, seed: int) -> Column:
    """A Poisson number of that mean: inverted at uniform values fixed by id and seed, one for each part of the mean; cdf: poisson_cdf of one part."""
    below = lambda u: F.size(F.filter(cdf, lambda c: c <= u))
    parts = F.ceil(mean / PART_MEAN).cast("int")
    more = F.aggregate(F.sequence(F.lit(1), parts - 1), F.lit(0), lambda a, i: a + F.aggregate(F.array(uniform(id_text, seed, i)), F.lit(0), lambda b, u: b + below(u)))
    return below(F.col("mix_u")) + F.when(parts > 1, more).otherwise(0)


def rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, source_col: str = "source", text_col: str = "text", epochs: float = 1.0) -> DataFrame:
    """Per source: n_bytes, target_weight and rate, the mean number of copies of its documents.

    weights: target shares by source (they are normalised; a source without one gets none). None: shares follow size to
    the power temperature. epochs: expected total size in units of all text read. Null is a source of its own, ''.
    """
    sizes = docs.groupBy(F.coalesce(F.col(source_col), F.lit("")).alias("source")).agg(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")).alias("n_bytes"))
    if weights is None:
        sizes = sizes.withColumn("raw", F.pow(F.col("n_bytes").cast("double"), F.lit(float(temperature))))
    else:
        table = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, raw double")
        sizes = sizes.join(table, "source", "left").fillna(0.0, ["raw"])
    sums = sizes.agg(F.sum("raw").alias("all_raw"), F.sum("n_bytes").alias("all_bytes"))
    share = F.coalesce(F.try_divide("raw", "all_raw"), F.lit(0.0))
    rate = F.coalesce(F.try_divide(share * F.lit(float(epochs)) * F.col("all_bytes"), F.col("n_bytes").cast("double")), F.lit(0.0))
    return sizes.crossJoin(sums).select("source", "n_bytes", share.alias("target_weight"), rate.alias("rate"))  # sums is one row


def mix(docs: DataFrame, weights: dict[str, float] | None = None, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **kw) -> DataFrame:
    """docs replicated to the target weights: columns mix_doc (a struct of all columns), mix_rate, mix_copies, mix_copy (from 1) and mix_key, in order of mix_key.

    Means over PART_MEAN are sums of draws of equal parts. A row with a null id draws as the id ''. Rows of equal ids draw equally. Sources with no text have rate 0. Empty
    tables give no rows. Column names of docs stay inside the struct, so they cannot clash.
    """
    table = rates(docs, weights, source_col=source_col, text_col=text_col, **kw)
    # written with its arrays of probabilities, so that the size that is checked is the size that is broadcast
    table = written(table.select(F.col("source").alias("mix_source"), F.col("rate").alias("mix_rate"), poisson_cdf(F.col("rate") / F.greatest(F.lit(1.0), F.ceil(F.col("rate") / PART_MEAN))).alias("mix_cdf")), "rates")
    table = small(table, beside=8 * F.size("mix_cdf"))
    rows = docs.select(F.struct("*").alias("mix_doc"), F.coalesce(F.col(source_col), F.lit("")).alias("mix_source"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("mix_id"))
    u = uniform(F.col("mix_id"), seed)
    copies = poisson_draw(F.col("mix_rate"), F.col("mix_cdf"), F.col("mix_id"), seed)
    rows = rows.join(table, "mix_source").withColumn("mix_u", u).withColumn("mix_copies", copies).where("mix_copies > 0")
    rows = rows.select("mix_doc", "mix_id", "mix_rate", "mix_copies", F.explode(F.sequence(F.lit(1), F.col("mix_copies"))).alias("mix_copy"))
    rows = rows.withColumn("mix_key", uniform(F.col("mix_id"), F.col("mix_copy"), seed + 1)).drop("mix_id")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # keys are uniform, so equal ranges hold equal numbers and nothing is sampled first
    return rows.repartitionById(parts, F.floor(F.col("mix_key") * parts).cast("int")).sortWithinPartitions("mix_key")
