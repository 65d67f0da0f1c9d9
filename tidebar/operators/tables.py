"""Joins, daily activity, liquidity and top rows over tables of bars and days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def _by_day() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("trading_date")




def filter_pool(df: DataFrame, pool: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    df = df.where(F.col("symbol").isin(*pool)) if pool else df
    return df.where(~F.col("symbol").isin(*exclude)) if exclude else df


def rth_only(bars: DataFrame, ts: str = "timestamp", zone: str = "America/New_York") -> DataFrame:
    """UTC bars whose local time is from 09:30 up to, and not at, 16:00."""
    local = F.from_utc_timestamp(ts, zone)
    minute = F.hour(local) * 60 + F.minute(local)
    return bars.where((minute >= 570) & (minute < 960))


def clock_columns(bars: DataFrame, ts: str = "ts") -> DataFrame:
    minute = F.hour(ts) * 60 + F.minute(ts)
    return bars.withColumns({"minute_of_day": minute, "calendar_date": F.to_date(ts), "night": (minute >= 21 * 60) | (minute < 3 * 60)})


def common_window(bars: DataFrame, weeks: int) -> DataFrame:
    """Bars of the last weeks before the earliest of the symbols' last times."""
    last = bars.groupBy("symbol").agg(F.max("ts").alias("m")).agg((F.min("m") - F.expr(f"INTERVAL {7 * weeks} DAYS")).alias("cut"))
    return bars.crossJoin(F.broadcast(last)).where("ts >= cut").drop("cut")  # one row


def map_exchange(df: DataFrame, exchanges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """df with exchange from a dimension (symbol, exchange), and the symbols that it lacks."""
    return df.join(exchanges, "symbol", "left"), df.select("symbol").distinct().join(exchanges, "symbol", "left_anti")


def align_common(bars: DataFrame) -> DataFrame:
    """Bars at times that every symbol has."""
    total = bars.agg(F.countDistinct("symbol").alias("total"))
    every = bars.groupBy("ts").agg(F.countDistinct("symbol").alias("n")).crossJoin(F.broadcast(total)).where("n = total").select("ts")  # total is one row
    return bars.join(every, "ts", "left_semi")


def day_compare(daily: DataFrame, date: str) -> DataFrame:
    """Each symbol's day against its previous one: ratios of close and volume."""
    df = daily.withColumns({"close_before": F.lag("close").over(_by_day()), "volume_before": F.lag("volume").over(_by_day())}).where(F.col("trading_date") == F.lit(date).cast("date"))
    return df.select("symbol", "trading_date", (F.col("close") / F.col("close_before")).alias("close_ratio"), F.try_divide(F.col("volume"), F.col("volume_before")).alias("volume_ratio"))


def missing_days(daily: DataFrame) -> DataFrame:
    """Dates on which any symbol has a row, inside a symbol's own life, on which it has none."""
    life = daily.groupBy("symbol").agg(F.min("trading_date").alias("a"), F.max("trading_date").alias("b"))
    expected = life.select("symbol", F.explode(F.sequence("a", "b")).alias("trading_date")).join(daily.select("trading_date").distinct(), "trading_date", "left_semi")
    return expected.join(daily.select("symbol", "trading_date"), ["symbol", "trading_date"], "left_anti")


def diff_tables(raw: DataFrame, clean: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Rows removed, added or changed from raw to clean."""
    a = raw.select(*keys, F.struct(*values).alias("before"))
    b = clean.select(*keys, F.struct(*values).alias("after"))
    df = a.join(b, list(keys), "full_outer")
    kind = F.when(F.col("after").isNull(), "removed").when(F.col("before").isNull(), "added").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return df.withColumn("kind", kind).where("kind is not null")


def daily_activity(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol", "trading_date").agg(F.sum("volume").alias("volume"), F.sum("total_turnover").alias("turnover"), F.max_by("open_interest", "ts").alias("oi_end"), F.count("*").alias("bars"), F.max_by("close", "ts").alias("close"))


def liquidity(daily: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """Per symbol mean volume over all of the last 250 and 60 dates (a date without trade counts 0), median over traded dates, coverage and dead days."""
    dates = (calendar if calendar is not None else daily).select("trading_date").distinct()
    ranked = dates.withColumn("back", F.row_number().over(Window.orderBy(F.desc("trading_date"))))  # one row for each date
    total = ranked.agg(F.max("back").alias("dates"))
    df = daily.join(F.broadcast(ranked), "trading_date").crossJoin(F.broadcast(total))
    mean = lambda n: F.sum(F.when(F.col("back") <= n, F.col("volume")).otherwise(0)) / F.least(F.lit(n), F.max("dates"))
    return df.groupBy("symbol").agg(
        mean(250).alias("mean_250"), mean(60).alias("mean_60"), F.median(F.when(F.col("volume") > 0, F.col("volume"))).alias("median_traded"),
        (F.count_if(F.col("volume") > 0) / F.max("dates")).alias("coverage"), F.count_if(F.col("volume") == 0).alias("dead_days"),
    )


def liquidity_medians(daily: DataFrame, least: float = 1000.0) -> DataFrame:
    df = daily.groupBy("symbol").agg(F.median("volume").alias("median_volume"), F.median("turnover").alias("median_turnover"), F.median("oi_end").alias("median_oi"))
    return df.withColumn("illiquid", F.col("median_volume") < least)


def distinct_counts(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.countDistinct("ts").alias("times"), F.countDistinct("trading_date").alias("dates"), F.countDistinct("contract").alias("contracts"))


def bars_per_day_by_year(daily: DataFrame, years: Sequence[int]) -> DataFrame:
    return daily.groupBy("symbol").pivot("year", list(years)).agg(F.median("bars")) if "year" in daily.columns else daily.withColumn("year", F.year("trading_date")).groupBy("symbol").pivot("year", list(years)).agg(F.median("bars"))


def bars_per_day_variants(daily: DataFrame) -> DataFrame:
    """The commonest number of bars a day (of as common ones the least), how many numbers there are, and their range."""
    n = daily.groupBy("symbol", "bars").agg(F.count("*").alias("days"))
    return n.groupBy("symbol").agg(F.max_by("bars", F.struct("days", -F.col("bars"))).alias("mode_bars"), F.count("*").alias("variants"), F.min("bars").alias("min_bars"), F.max("bars").alias("max_bars"))


def quantiles(df: DataFrame, x: str, at: Sequence[float] = (0.01, 0.5, 0.99), keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Exact quantiles with linear interpolation."""
    return df.groupBy(*keys).agg(*(F.percentile(x, F.lit(q)).alias(f"p{round(100 * q):02d}") for q in at))


def roll_regression(rolls: DataFrame) -> DataFrame:
    """Slope and correlation of the log jump at rolls on the log ratio of K; NULL where either does not vary."""
    cov, vx, vy = F.covar_pop("jump", "k_ratio"), F.var_pop("k_ratio"), F.var_pop("jump")
    return rolls.agg(F.count("*").alias("n"), F.try_divide(cov, vx).alias("slope"), F.try_divide(cov, F.sqrt(vx * vy)).alias("corr"))


def vintage(daily: DataFrame) -> DataFrame:
    """Symbols by their last date."""
    last = daily.groupBy("symbol").agg(F.max("trading_date").alias("last"))
    return last.groupBy("last").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("symbol")), ",").alias("symbols"))


def top(df: DataFrame, by: Column, n: int, *ties: str, ascending: bool = False) -> DataFrame:
    """The n rows of greatest by, or of least with ascending; rows where it is NULL come last, ties in the order of columns named."""
    return df.orderBy(by.asc_nulls_last() if ascending else by.desc_nulls_last(), *ties).limit(n)


def first_per_symbol(df: DataFrame, n: int, order: str = "trading_date", last: bool = False) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy(F.desc(order) if last else F.asc(order))
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def every_kth(df: DataFrame, k: int, order: str = "ts") -> DataFrame:
    """A baseline sample: each k-th row of a symbol."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy("symbol").orderBy(order))).where(F.col("_n") % k == 0).drop("_n")


def last_close(bars: DataFrame, ts: str = "ts") -> DataFrame:
    """Last close of each calendar date."""
    return bars.groupBy("symbol", F.to_date(ts).alias("date")).agg(F.max_by("close", ts).alias("close"))
