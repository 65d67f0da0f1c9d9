"""Higher timeframes without lookahead: resampling and as-of joins to closed bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidebar.functions.scalars import floor_time
from tidebar.operators.sessions import by_time, segments



def _in_segment() -> WindowSpec:
    return Window.partitionBy("symbol", "segment_id").orderBy("ts")


_OHLCV = ("open", "high", "low", "close", "volume")


def bin_start(bars: DataFrame, minutes: int | Column, merge_leading: Column | bool = True) -> DataFrame:
    """bars (with segment_id) with bin: the floored start of each bar, inside its segment; a segment's first bar alone in its bin joins the next one. minutes and merge_leading may be columns."""
    start = floor_time(F.col("ts") - F.expr("INTERVAL 1 MINUTE"), minutes)
    df = bars.withColumn("bin", start)
    if merge_leading is not False:
        merge = F.lit(True) if merge_leading is True else merge_leading
        first = F.lag("bin").over(_in_segment()).isNull()
        after = F.lead("bin").over(_in_segment())
        df = df.withColumn("bin", F.when(merge & first & after.isNotNull() & (after != F.col("bin")), after).otherwise(F.col("bin")))
    return df


def resample_segment(bars: DataFrame, minutes: int | Column, merge_leading: Column | bool = True) -> DataFrame:
    """Bars of a longer rule that never cross a segment; stamped with their last member's ts."""
    df = bin_start(bars if "segment_id" in bars.columns else segments(bars), minutes, merge_leading)
    return df.groupBy("symbol", "segment_id", "bin").agg(
        F.max("ts").alias("ts"), F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"), F.max("trading_date").alias("trading_date"), F.count("*").alias("members"),
    )


def resample_daily(bars: DataFrame) -> DataFrame:
    """One bar for each trading date, stamped with its last member's ts."""
    return bars.groupBy("symbol", "trading_date").agg(F.max("ts").alias("ts"), F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"))


def resample_session(bars: DataFrame, minutes: int, date: str = "trading_date", start: str = "bar_start") -> DataFrame:
    """Open-labelled bars anchored at the first bar of each date: bin k holds what begins in its k-th stretch; empty bins do not exist."""
    at = F.unix_seconds(F.col(start).cast("timestamp"))
    first = F.min(at).over(Window.partitionBy("symbol", date))
    df = bars.withColumn("anchor", first).withColumn("n", F.floor((at - F.col("anchor")) / (60 * minutes)))
    out = df.groupBy("symbol", date, "anchor", "n").agg(F.min_by("open", start).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", start).alias("close"), F.sum("volume").alias("volume"))
    return out.withColumn("bar_start", F.timestamp_seconds(F.col("anchor") + F.col("n") * 60 * minutes)).drop("anchor", "n")


def asof(left: DataFrame, right: DataFrame, left_time: Column, right_time: Column, columns: list[str], key: str = "symbol", prefix: str = "tf_") -> DataFrame:
    """For each left row the columns of the last right row of its key with right_time <= left_time; NULL if there is none.

    Both sides are laid into one order and the last right row is carried forward: linear, with no range join. Days are
    laid out by themselves, and each begins with the last right row of the days before it.
    """
    names = left.columns
    a = left.select(key, F.struct(*names).alias("row"), left_time.alias("at"), F.lit(1).alias("side"), F.lit(None).cast(right.select(F.struct(*columns)).schema[0].dataType).alias("seen"))
    b = right.select(key, F.lit(None).cast(a.schema["row"].dataType).alias("row"), right_time.alias("at"), F.lit(0).alias("side"), F.struct(*columns).alias("seen"))
    both = a.unionByName(b).withColumn("day", F.to_date("at"))
    earlier = Window.partitionBy(key).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = both.groupBy(key, "day").agg(F.max_by("seen", F.when(F.col("side") == 0, F.col("at"))).alias("seen"))
    days = days.select(key, "day", F.last("seen", ignorenulls=True).over(earlier).alias("before"))
    w = Window.partitionBy(key, "day").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("seen", F.last("seen", ignorenulls=True).over(w)).where("side = 1").join(days, [key, "day"])
    seen = F.coalesce("seen", "before")
    return both.select(*(F.col(f"row.{x}").alias(x) for x in names), *(seen[x].alias(f"{prefix}{x}") for x in columns))


def asof_closed(bars: DataFrame, tf: DataFrame, columns: list[str], prefix: str = "tf_") -> DataFrame:
    """The last higher bar that had ended when each bar began (a bar is stamped at its end, a minute after its start)."""
    return asof(bars, tf, F.col("ts") - F.expr("INTERVAL 1 MINUTE"), F.col("ts"), columns, prefix=prefix)


def asof_closed_open(bars: DataFrame, tf: DataFrame, minutes: int, columns: list[str], prefix: str = "tf_") -> DataFrame:
    """The same for bars stamped at their start: the last one whose start plus rule is not after the bar's start."""
    return asof(bars, tf, F.col("bar_start"), F.col("bar_start") + F.expr(f"INTERVAL {minutes} MINUTES"), columns, prefix=prefix)


def snap_to_bin(events: DataFrame, bars: DataFrame, minutes: int) -> DataFrame:
    """Events at bar times (symbol, ts) with bin_ts, the end label of the bin that holds the bar."""
    df = bin_start(bars if "segment_id" in bars.columns else segments(bars), minutes)
    label = F.max("ts").over(Window.partitionBy("symbol", "segment_id", "bin"))
    return events.join(df.select("symbol", "ts", label.alias("bin_ts")), ["symbol", "ts"], "left")


def snap_to_session_bin(events: DataFrame, bars: DataFrame, minutes: int, date: str = "trading_date", start: str = "bar_start") -> DataFrame:
    """Events at bar times (symbol, ts) with bin_start, the open label of the stretch of minutes that holds the bar, counted from the first bar of its date (as in resample_session)."""
    at = F.unix_seconds(F.col(start).cast("timestamp"))
    first = F.min(at).over(Window.partitionBy("symbol", date))
    label = F.timestamp_seconds(first + F.floor((at - first) / (60 * minutes)) * (60 * minutes))
    return events.join(bars.select("symbol", "ts", label.alias("bin_start")), ["symbol", "ts"], "left")


def forming_candle(bars: DataFrame, minutes: int) -> DataFrame:
    """Running open, high, low and close inside the higher window of each bar."""
    w = Window.partitionBy("symbol", "window_start").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    df = bars.withColumn("window_start", floor_time(F.col("ts") - F.expr("INTERVAL 1 MINUTE"), minutes))
    return df.withColumns({"live_open": F.first("open").over(w), "live_high": F.max("high").over(w), "live_low": F.min("low").over(w), "live_close": F.col("close")})


def last_of_window(rows: DataFrame, minutes: int, columns: list[str]) -> DataFrame:
    """Live values brought down to the last of each window."""
    df = rows.withColumn("window_start", floor_time(F.col("ts") - F.expr("INTERVAL 1 MINUTE"), minutes))
    return df.groupBy("symbol", "window_start").agg(*(F.max_by(x, "ts").alias(x) for x in columns))


def bad_bins(tf: DataFrame) -> DataFrame:
    """Bars whose high or low does not enclose open and close, or whose stamp does not grow: should be empty."""
    shape = (F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close"))
    return tf.withColumn("bad", shape | F.coalesce(F.col("ts") <= F.lag("ts").over(by_time()), F.lit(False))).where("bad").drop("bad")
