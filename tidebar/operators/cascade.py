"""Trend states of several timeframes side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebar.operators import indicators as N
from tidebar.operators import timeframes as TF
from tidebar.operators.sessions import in_blocks

SIZES = (3, 6, 12)


def averages(df: DataFrame, sizes: tuple[int, int, int] = SIZES, digits: int = 6) -> DataFrame:
    """df with f, m and s: its fast, middle and slow averages, rounded so that equal ones compare as equal."""
    return df.withColumns({name: F.round(N.sma("close", n), digits) for name, n in zip("fms", sizes)})


def with_places(tf: DataFrame, atr: int = 14) -> DataFrame:
    """Thirty-minute bars with ATR30 and their place P30 in their symbol, from 1."""
    return N.with_atr(tf, atr, "ATR30").withColumn("P30", F.row_number().over(Window.partitionBy("symbol").orderBy("ts")).cast("long"))


def cascade_features(bars: DataFrame, sizes: tuple[int, int, int] = SIZES, atr: int = 14) -> DataFrame:
    """bars (with segment_id) with what is known at each: S1, S5 and S30 (fast against middle average on one, five and thirty
    minutes), DSTATE and DBREAK (three averages of closed days), DAY (the last closed day), ATR1, ATR30 and P30, the number of closed thirty-minute bars.

    Higher bars count once they have closed. NULL before the first of them.
    """
    df = in_blocks(bars, lambda b: N.with_atr(averages(b, sizes).withColumn("S1", N.ma_state2("f", "m")).drop("f", "m", "s"), atr, "ATR1"), max(*sizes, atr + 1))
    for minutes, name in ((5, "S5"), (30, "S30")):
        tf = averages(TF.resample_segment(bars, minutes), sizes).withColumn(name, N.ma_state2("f", "m"))
        if minutes == 30:
            tf = with_places(tf, atr)
        df = TF.asof_closed(df, tf, [name] + ["ATR30", "P30"] * (minutes == 30), prefix="")
    day = averages(TF.resample_daily(bars), sizes).select("symbol", "ts", F.col("trading_date").alias("DAY"), N.ma_state3("f", "m", "s").alias("DSTATE"), N.structure_break("f", "m", "s").alias("DBREAK"))
    return TF.asof_closed(df, day, ["DSTATE", "DBREAK", "DAY"], prefix="")
