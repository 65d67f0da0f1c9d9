"""Rules as columns: a strategy is some functions from bars to columns, so that Catalyst sees it whole.

An entry rule marks bars (1 long, -1 short, NULL none), an exit rule tells why a bar closes the open position (NULL: it
does not) and at which price, a sizing rule weighs symbols on a date. What they may read is said where they are applied.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.functions import scalars as X

Rule = Callable[[DataFrame], Column]


@dataclass(frozen=True)
class Strategy:
    """enters: over bars, the side to take on a bar (NULL: none); fills: the price of an entry there. best: over bars from the entry on (side, entry_price and all columns of bars), what the position is carried by, of which the running maximum up to the bar before is best; seed: the least that is. reason and price: of an exit, over the same bars with best, bars_held (0 on the entry bar) and entered, a struct of the entry bar's columns."""

    enters: Rule
    reason: Rule
    price: Rule
    fills: Rule = lambda bars: bars["open"]
    best: Rule = lambda bars: F.when(bars["side"] == 1, bars["high"]).otherwise(-bars["low"])
    seed: Rule = lambda bars: F.lit(None).cast("double")
    held_at_least: int = 1


def trades(bars: DataFrame, strategy: Strategy, stretch: str = "session_id", cost_bps: float = 0.0) -> DataFrame:
    """The first entry of each stretch (a session, or any run of bars that a trade does not outlive) and its first exit: symbol, stretch, direction, entry_ts, entry_price, exit_ts, exit_price, reason, best, pnl. Entries without an exit have no row."""
    w = Window.partitionBy("symbol", stretch)
    columns = bars.columns
    df = bars.withColumn("_side", strategy.enters(bars))
    df = df.withColumn("_fill", strategy.fills(df))
    first = F.min_by(F.struct(F.col("_side").alias("side"), F.col("ts").alias("ts"), F.col("_fill").alias("price"), F.struct(*columns).alias("bar")), F.when(F.col("_side").isNotNull(), F.col("ts"))).over(w)
    df = df.withColumn("_e", first).where(F.col("_e").isNotNull() & (F.col("ts") >= F.col("_e.ts"))).withColumns({"side": F.col("_e.side"), "entry_ts": F.col("_e.ts"), "entry_price": F.col("_e.price"), "entered": F.col("_e.bar")})
    order = w.orderBy("ts")
    df = df.withColumns({"_best": strategy.best(df), "_seed": strategy.seed(df), "bars_held": F.row_number().over(order) - 1})
    df = df.withColumn("best", F.greatest(F.max("_best").over(order.rowsBetween(Window.unboundedPreceding, -1)), "_seed"))
    df = df.withColumn("_reason", F.when(F.col("bars_held") >= strategy.held_at_least, strategy.reason(df)))
    out = F.min_by(F.struct("ts", F.col("_reason").alias("reason"), strategy.price(df).alias("price"), "best"), F.when(F.col("_reason").isNotNull(), F.col("ts")))
    df = df.groupBy("symbol", stretch, "side", "entry_ts", "entry_price").agg(out.alias("x")).where("x is not null")
    long = F.col("side") == 1
    return df.select(
        "symbol", stretch, F.when(long, "long").otherwise("short").alias("direction"), "entry_ts", "entry_price", F.col("x.ts").alias("exit_ts"), F.col("x.price").alias("exit_price"), F.col("x.reason").alias("reason"), F.col("x.best").alias("best"),
        X.trade_return(long, F.col("entry_price"), F.col("x.price"), cost_bps).alias("pnl"),
    )


def weights(rows: DataFrame, size: Rule) -> DataFrame:
    """symbol, trading_date and weight: each date's positive sizes as shares of their sum."""
    df = rows.withColumn("_size", size(rows)).where("_size > 0")
    return df.select("symbol", "trading_date", (F.col("_size") / F.sum("_size").over(Window.partitionBy("trading_date"))).alias("weight"))


def breakout(d: float = 2.0) -> Strategy:
    """The breakout trades of signals.breakout_trades, told as rules; bars need the six lines."""

    def enters(bars: DataFrame) -> Column:
        before = Window.partitionBy("symbol", "session_id").orderBy("ts")
        may = bars["valid"] & bars["tradable"] & ~bars["is_session_first"] & ~bars["is_session_last"]
        return F.when(may & (F.lag("high").over(before) > bars["Bbreak"]), 1).when(may & (F.lag("low").over(before) < bars["Sbreak"]), -1)

    long = F.col("side") == 1
    stop = X.breakout_stop(long, F.when(long, F.col("best")).otherwise(-F.col("best")), d)
    hit = F.when(long, F.col("low") <= stop).otherwise(F.col("high") >= stop)
    return Strategy(
        enters, reason=lambda bars: F.when(hit, "TRAIL").when(bars["is_session_last"], "SESSION_END"), price=lambda bars: F.when(hit, X.gap_fill(long, stop, bars["open"])).otherwise(bars["close"]),
        seed=lambda bars: F.when(bars["side"] == 1, bars["Bbreak"]).otherwise(-bars["Sbreak"]),
    )


def macd(take: float = 2.0, stop: float = 1.0, hold: int = 2) -> Strategy:
    """Entries at the close of a MACD cross, exits at the close that gained take or lost stop times the ATR of the entry; stretches are runs from cross to cross, which may enter at their first bar only."""
    move = (F.col("close") - F.col("entry_price")) * F.col("side")
    atr = F.col("entered.atr")
    return Strategy(
        enters=lambda bars: F.when(bars["cross"] != 0, bars["cross"]), fills=lambda bars: bars["close"], held_at_least=hold,
        reason=lambda bars: F.when(move >= take * atr, "TP").when(move <= -stop * atr, "SL"), price=lambda bars: bars["close"],
    )
