"""Indicators over bars ordered by ts in each symbol; NULL until warm."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.functions.scalars import divided
from tidebar.operators.sessions import by_time, in_blocks


def _rows(n: int):
    return by_time().rowsBetween(-(n - 1), 0)


def sma(x: Column | str, n: int) -> Column:
    w = _rows(n)
    return F.when(F.count(x).over(w) == n, F.avg(x).over(w))


def true_range() -> Column:
    before = F.lag("close").over(by_time())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def with_atr(df: DataFrame, n: int = 14, name: str = "atr") -> DataFrame:
    return df.withColumn("tr", true_range()).withColumn(name, sma("tr", n)).drop("tr")


def with_ema(df: DataFrame, x: str, span: int, name: str) -> DataFrame:
    """Exponential mean that begins at the first value: e = (1 - a) * e + a * x, a = 2 / (span + 1).

    It is NULL before the first value; later rows without a value keep the mean as it is.
    Rows are cut in blocks so long that a block's start weighs under 1e-7 at its end. Blocks are summed by themselves, and
    what comes before is three earlier blocks' sums at most: beyond them it is under a double's resolution.
    """
    a = 2 / (span + 1)
    b = 1 - a
    size = max(8, math.ceil(math.log(1e-7) / math.log(b)))
    df = df.withColumn("_at", F.count(x).over(by_time().rowsBetween(Window.unboundedPreceding, 0)) - 1)
    df = df.withColumns({"_block": F.floor(F.col("_at") / size), "_j": F.col("_at") % size})
    weight = F.when(F.col("_at") == 0, F.lit(1.0)).otherwise(F.lit(a))
    inside = Window.partitionBy("symbol", "_block").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_local", F.sum(weight * F.col(x) * F.pow(F.lit(b), -F.col("_j"))).over(inside) * F.pow(F.lit(b), F.col("_j")))
    ends = df.groupBy("symbol", "_block").agg(F.max_by("_local", "_j").alias("_end"))
    w = Window.partitionBy("symbol").orderBy("_block")
    carry = sum((F.coalesce(F.lag("_end", m).over(w), F.lit(0.0)) * F.lit(b ** (size * (m - 1))) for m in range(1, 5)), F.lit(0.0))
    df = df.join(ends.select("symbol", "_block", carry.alias("_carry")), ["symbol", "_block"])
    return df.withColumn(name, F.col("_local") + F.col("_carry") * F.pow(F.lit(b), F.col("_j") + 1)).drop("_at", "_block", "_j", "_local", "_carry")


def with_macd(df: DataFrame, x: str = "close", fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    df = with_ema(with_ema(df, x, fast, "_fast"), x, slow, "_slow").withColumn("macd", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
    df = with_ema(df, "macd", signal, "macd_signal")
    return df.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))


def macd_cross(df: DataFrame, min_bars: int = 36) -> DataFrame:
    """cross: 1 where macd less its signal turns positive, -1 where it turns negative, else 0."""
    diff = F.col("macd") - F.col("macd_signal")
    df = df.withColumns({"_d": diff, "_n": F.row_number().over(by_time())}).withColumn("_b", F.lag("_d").over(by_time()))
    cross = F.when(F.col("_n") < min_bars, 0).when((F.col("_b") <= 0) & (F.col("_d") > 0), 1).when((F.col("_b") >= 0) & (F.col("_d") < 0), -1).otherwise(0)
    return df.withColumn("cross", cross).drop("_d", "_b", "_n")


def ma_state2(fast: Column | str, mid: Column | str) -> Column:
    f, m = (F.col(x) if isinstance(x, str) else x for x in (fast, mid))
    return F.when(f > m, 1).when(f < m, -1).otherwise(0).cast("byte")


def ma_state3(fast: str, mid: str, slow: str) -> Column:
    up, down = (F.col(fast) > F.col(mid)) & (F.col(mid) > F.col(slow)), (F.col(fast) < F.col(mid)) & (F.col(mid) < F.col(slow))
    return F.when(up, 1).when(down, -1).otherwise(0).cast("byte")


def structure_break(*averages: str) -> Column:
    """The candle's body holds at least two of the averages."""
    inside = [F.coalesce(F.col(x).between(F.least("open", "close"), F.greatest("open", "close")), F.lit(False)).cast("int") for x in averages]
    return sum(inside[1:], inside[0]) >= 2


def with_swings(df: DataFrame, k: int = 2) -> DataFrame:
    """swing_high and swing_low: extremes of the k bars on either side, ties included; never within k of the ends."""
    w = by_time().rowsBetween(-k, k)
    full = F.count("*").over(w) == 2 * k + 1
    return df.withColumns({"swing_high": full & (F.col("high") == F.max("high").over(w)), "swing_low": full & (F.col("low") == F.min("low").over(w))})


def rolling_vol(daily: DataFrame, n: int = 20) -> DataFrame:
    """Standard deviation of n daily changes, as known the day before. A change from a close of 0 is infinite, or NaN where the next is 0 too."""
    w = Window.partitionBy("symbol").orderBy("trading_date")
    df = daily.withColumn("change", divided("close", F.lag("close").over(w)) - 1)
    frame = w.rowsBetween(-(n - 1), 0)
    df = df.withColumn("_v", F.when(F.count("change").over(frame) == n, F.stddev_samp("change").over(frame)))
    return df.withColumn("vol", F.lag("_v").over(w)).drop("_v")


def atr_vol(daily: DataFrame, n: int = 14) -> DataFrame:
    """Daily ATR over close, as known the day before. daily needs ts or trading_date in order."""
    df = daily if "ts" in daily.columns else daily.withColumn("ts", F.col("trading_date"))
    return with_atr(df, n).withColumn("vol", F.lag(F.col("atr") / F.col("close")).over(by_time()))


def inverse_vol_weights(vols: DataFrame) -> DataFrame:
    """Per date, weights in proportion to 1 / vol; symbols without a positive vol have none."""
    w = Window.partitionBy("trading_date")
    return vols.where("vol > 0").withColumn("weight", (1 / F.col("vol")) / F.sum(1 / F.col("vol")).over(w)).select("symbol", "trading_date", "weight")


def live_indicators(bars: DataFrame, tf: DataFrame, minutes: int, atr: int = 14) -> DataFrame:
    """MACD and ATR as if the forming higher candle closed now: the closed bars' state and one step more. tf is stamped at its end."""
    from tidebar.operators.timeframes import asof_closed, forming_candle

    state = with_ema(with_ema(tf, "close", 12, "e12"), "close", 26, "e26").withColumn("m", F.col("e12") - F.col("e26"))
    state = with_ema(state, "m", 9, "e9").withColumn("tr", true_range())
    w = _rows(atr - 1)
    state = state.withColumns({"tr_sum": F.when(F.count("tr").over(w) == atr - 1, F.sum("tr").over(w)), "last_close": F.col("close")})
    df = asof_closed(forming_candle(bars, minutes), state, ["e12", "e26", "e9", "tr_sum", "last_close"])
    step = lambda e, x, span: F.col(e) * (1 - 2 / (span + 1)) + x * (2 / (span + 1))
    df = df.withColumn("live_macd", step("tf_e12", F.col("live_close"), 12) - step("tf_e26", F.col("live_close"), 26))
    df = df.withColumn("live_signal", step("tf_e9", F.col("live_macd"), 9))
    tr = F.greatest(F.col("live_high") - F.col("live_low"), F.abs(F.col("live_high") - F.col("tf_last_close")), F.abs(F.col("live_low") - F.col("tf_last_close")))
    return df.withColumn("live_atr", (F.col("tf_tr_sum") + tr) / atr)


def live_cross(live: DataFrame) -> DataFrame:
    """live (live_macd, live_signal) with cross: 1 where the first rises over the second from one bar to the next, -1 where it falls under it, else 0; so too on a symbol's first bar and where either is missing."""
    def work(df: DataFrame) -> DataFrame:
        df = df.withColumn("_d", F.col("live_macd") - F.col("live_signal")).withColumn("_b", F.lag("_d").over(by_time()))
        return df.withColumn("cross", F.when((F.col("_b") <= 0) & (F.col("_d") > 0), 1).when((F.col("_b") >= 0) & (F.col("_d") < 0), -1).otherwise(0)).drop("_d", "_b")

    return in_blocks(live, work, 1)
