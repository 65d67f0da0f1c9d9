"""Signals and trade paths as table operators: conditions are columns, a trade's exit is the first row that meets one."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidebar.functions import scalars as X
from tidebar.operators import passage, ranking, sessions
from tidebar.operators.timeframes import asof, resample_segment
from tidebar.sources.scratch import settled


def fold(rows: DataFrame, order: list[str], start: Callable, step: Callable, schema: pa.Schema, spark_schema: str, end: Callable | None = None) -> DataFrame:
    """For rules whose state depends on what came before: step(state, row) is called for a symbol's rows in order and gives rows.

    Rows are sorted by Spark and read one after the other, so a task holds one state, not a symbol's history. The state is a
    dict that start() begins and, after a symbol's last row, end(state) may turn into rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, state = None, None
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                if state is None or row["symbol"] != symbol:
                    out += end(state) if end and state is not None else []
                    symbol, state = row["symbol"], start()
                    state["symbol"] = symbol
                out += step(state, row)
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if end and state is not None:
            yield pa.RecordBatch.from_pylist(end(state), schema=schema)

    return rows.repartition("symbol").sortWithinPartitions("symbol", *order).mapInArrow(run, spark_schema)


def _in_session() -> WindowSpec:
    return Window.partitionBy("symbol", "session_id").orderBy("ts")


def _before() -> WindowSpec:
    return _in_session().rowsBetween(Window.unboundedPreceding, -1)


TRADE = ("symbol", "session_id", "direction", "entry_ts", "entry_price", "exit_ts", "exit_price", "reason", "extreme", "stop_at_exit", "gapped", "pnl")


def _allowed() -> Column:
    return F.col("valid") & F.col("tradable") & ~F.col("is_session_first") & ~F.col("is_session_last")


def _broke(on_range: Column | bool, lag: Column | int, most: int = 3) -> tuple[Column, Column]:
    """Whether the bar before (lag: that many bars earlier still) broke the upper and the lower line."""
    ago = lambda c: F.lag(c, 1 + lag).over(_in_session()) if isinstance(lag, int) else reduce(lambda x, k: F.when(lag == k, F.lag(c, 1 + k).over(_in_session())).otherwise(x), range(most, -1, -1), F.lit(None).cast("double"))
    return X.switched(on_range, ago("high"), ago("close")) > F.col("Bbreak"), X.switched(on_range, ago("low"), ago("close")) < F.col("Sbreak")


def breakout_entries(bars: DataFrame, on_range: Column | bool = True, lag: Column | int = 0) -> DataFrame:
    """bars (with lines) with signal: 1 or -1 on the one bar of a session that enters, at its open, as the bar before (lag: up to three bars earlier) broke a line. Switches may be columns."""
    up, down = _broke(on_range, lag)
    df = bars.withColumn("hit", F.when(_allowed() & up, 1).when(_allowed() & down, -1))
    first = F.min(F.when(F.col("hit").isNotNull(), F.col("ts"))).over(Window.partitionBy("symbol", "session_id"))
    return df.withColumn("signal", F.when(F.col("ts") == first, F.col("hit"))).drop("hit")


def arm_events(bars: DataFrame, arm_first: bool = False) -> DataFrame:
    """armed: -1 once the session's earlier bars reached Ssetup, 1 once they reached Bsetup, the later of both; 0 if on one bar, or neither.

    arm_first: armed as of one bar earlier.
    """
    high, low = F.max("high").over(_before()), F.min("low").over(_before())
    df = bars.withColumns({"at_s": F.col("valid") & F.coalesce(high >= F.col("Ssetup"), F.lit(False)), "at_l": F.col("valid") & F.coalesce(low <= F.col("Bsetup"), F.lit(False))})
    new = lambda x: F.col(x) & ~F.coalesce(F.lag(x).over(_in_session()), F.lit(False))  # noqa: E731  both stay true once reached
    df = df.withColumns({"new_s": new("at_s"), "new_l": new("at_l")})
    event = F.when(F.col("new_s") & F.col("new_l"), 0).when(F.col("new_s"), -1).when(F.col("new_l"), 1)
    df = df.withColumn("event", event)
    armed = F.last("event", ignorenulls=True).over(_in_session().rowsBetween(Window.unboundedPreceding, -1 if arm_first else 0))
    return df.withColumn("armed", F.coalesce(armed, F.lit(0))).drop("at_s", "at_l", "new_s", "new_l", "event")


def reversal_entries(bars: DataFrame, on_range: bool = True, arm_first: bool = False) -> DataFrame:
    """signal: -1 where armed short and the bar before fell below Senter, 1 where armed long and it rose above Benter; once a session."""
    df = arm_events(bars, arm_first)
    down = (F.col("armed") == -1) & (F.lag("low" if on_range else "close").over(_in_session()) < F.col("Senter"))
    up = (F.col("armed") == 1) & (F.lag("high" if on_range else "close").over(_in_session()) > F.col("Benter"))
    df = df.withColumn("hit", F.when(_allowed() & down, -1).when(_allowed() & up, 1))
    first = F.min(F.when(F.col("hit").isNotNull(), F.col("ts"))).over(Window.partitionBy("symbol", "session_id"))
    return df.withColumn("signal", F.when(F.col("ts") == first, F.col("hit"))).drop("hit")


def trade_path(entered: DataFrame, kind: str = "breakout", d: Column | float = 2.0, fill_gaps: Column | bool = True) -> DataFrame:
    """Every bar from entry on, with side, the extreme up to the bar before, and the stop tested on this bar (NULL on the entry bar).

    Needs signal. The extreme of a breakout is seeded at the broken line; that of a reversal is its excursion, from 0.
    """
    session = Window.partitionBy("symbol", "session_id")
    df = entered.withColumns({"side": F.first("signal", ignorenulls=True).over(session.orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "entry_ts": F.min(F.when(F.col("signal").isNotNull(), F.col("ts"))).over(session)})
    df = df.withColumn("entry_price", F.first(F.when(F.col("signal").isNotNull(), F.col("open")), ignorenulls=True).over(session.orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    df = df.where("ts >= entry_ts")
    long = F.col("side") == 1
    if kind == "breakout":
        best = F.when(long, F.greatest(F.max("high").over(_before()), F.col("Bbreak"))).otherwise(F.least(F.min("low").over(_before()), F.col("Sbreak")))
        stop = X.breakout_stop(long, "extreme", d)
    else:
        best = F.greatest(F.lit(0.0), F.when(long, F.max("high").over(_before()) - F.col("Benter")).otherwise(F.col("Senter") - F.min("low").over(_before())))
        stop = X.reversal_stop(long, "extreme", d)
    df = df.withColumn("extreme", best).withColumn("stop", F.when(F.col("ts") > F.col("entry_ts"), stop))
    hit = F.coalesce(F.when(long, F.col("low") <= F.col("stop")).otherwise(F.col("high") >= F.col("stop")), F.lit(False))
    df = df.withColumn("exits", F.when(hit, "TRAIL").when(F.col("is_session_last") & (F.col("ts") > F.col("entry_ts")), "SESSION_END"))
    level = X.gap_fill(long, "stop", "open", fill_gaps)
    return df.withColumn("exit_price", F.when(F.col("exits") == "TRAIL", level).when(F.col("exits") == "SESSION_END", F.col("close")))


def trades_of(path: DataFrame, cost_bps: float = 0.0) -> DataFrame:
    """One row for each trade of a path: its first exit."""
    first = F.min_by(F.struct("ts", "exit_price", F.col("exits").alias("reason"), "extreme", "stop"), F.when(F.col("exits").isNotNull(), F.col("ts")))
    df = path.groupBy("symbol", "session_id", "side", "entry_ts", "entry_price").agg(first.alias("x"), F.count_if(F.col("exits").isNotNull()).alias("n")).where("n > 0")
    long = F.col("side") == 1
    return df.select(
        "symbol", "session_id", F.when(long, "long").otherwise("short").alias("direction"), "entry_ts", "entry_price", F.col("x.ts").alias("exit_ts"), F.col("x.exit_price").alias("exit_price"),
        F.col("x.reason").alias("reason"), F.col("x.extreme").alias("extreme"), F.col("x.stop").alias("stop_at_exit"), ((F.col("x.reason") == "TRAIL") & (F.col("x.exit_price") != F.col("x.stop"))).alias("gapped"),
        X.trade_return(long, F.col("entry_price"), F.col("x.exit_price"), cost_bps).alias("pnl"),
    )


def breakout_trades(bars: DataFrame, d: Column | float = 2.0, on_range: Column | bool = True, fill_gaps: Column | bool = True, cost_bps: float = 0.0, lag: Column | int = 0) -> DataFrame:
    return trades_of(trade_path(breakout_entries(bars, on_range, lag), "breakout", d, fill_gaps), cost_bps)


def reversal_trades(bars: DataFrame, d: float = 2.0, on_range: bool = True, arm_first: bool = False, fill_gaps: bool = True, cost_bps: float = 0.0) -> DataFrame:
    return trades_of(trade_path(reversal_entries(bars, on_range, arm_first), "reversal", d, fill_gaps), cost_bps)


def reentry_trades(bars: DataFrame, d: float = 2.0, on_range: bool = True, fill_gaps: bool = True, cost_bps: float = 0.0) -> DataFrame:
    """Breakout trades that may follow one another in a session: every bar that could enter is labelled with its exit, then they are taken one at a time."""
    keys = ["symbol", "session_id"]
    df = passage.positions(bars, keys)
    high, low = F.lag("high" if on_range else "close").over(_in_session()), F.lag("low" if on_range else "close").over(_in_session())
    df = df.withColumn("side", F.when(_allowed() & (high > F.col("Bbreak")), 1).when(_allowed() & (low < F.col("Sbreak")), -1))
    # a stop is met where what it would take to hold is not above the best price so far; prices of shorts are mirrored
    sides = {"low": F.col("low"), "top": F.col("high"), "high": F.col("high"), "level": (F.col("low") - F.col("Senter")) * d + F.col("Ssetup"), "fall": F.lit(None).cast("double")}
    mirrored = {"low": -F.col("high"), "top": -F.col("low"), "high": -F.col("low"), "level": (F.col("Benter") - F.col("high")) * d - F.col("Bsetup"), "fall": F.lit(None).cast("double")}
    told = F.struct("ts", "open", "close", "Senter", "Ssetup", "Benter", "Bsetup").alias("bar")
    nodes = settled(passage.stretches(passage.both_sides(df, keys, sides, mirrored, False, F.col("is_session_last").alias("last"), told), keys, passage.OF_SESSION))
    long = F.col("is_long")
    best = F.when(F.col("side") == 1, F.greatest("high", "Bbreak")).otherwise(F.greatest(-F.col("low"), -F.col("Sbreak")))
    starts = df.where("side is not null").select(*keys, (F.col("side") == 1).alias("is_long"), F.col("ts").alias("entry_ts"), F.col("open").alias("entry_price"), (F.col("pos") + 1).alias("pos"), best.alias("high"))
    met = lambda: (F.col("level") <= F.col("_high")) | (F.col("over") >= 0)
    df = passage.first_passage(starts, nodes, keys, [*keys, "entry_ts"], passage.OF_SESSION, lambda: met() | F.col("last")).where("found is not null")
    x = F.col("found.bar")
    df = df.withColumn("extreme", F.when(long, F.col("found.high")).otherwise(-F.col("found.high"))).select(*keys, "is_long", "entry_ts", "entry_price", "extreme", "found.low", x["ts"].alias("exit_ts"), *(x[c].alias(c) for c in ("open", "close", "Senter", "Ssetup", "Benter", "Bsetup")))
    need = F.when(long, (F.col("low") - F.col("Senter")) * d + F.col("Ssetup") <= F.col("extreme")).otherwise((F.col("Benter") + F.col("low")) * d - F.col("Bsetup") <= -F.col("extreme"))
    df = df.withColumns({"reason": F.when(need, "TRAIL").otherwise("SESSION_END"), "stop": X.breakout_stop(long, "extreme", d)})
    df = df.withColumn("exit_price", F.when(need, X.gap_fill(long, "stop", "open", fill_gaps)).otherwise(F.col("close")))
    trades = df.select(
        *keys, F.when(long, "long").otherwise("short").alias("direction"), "entry_ts", "entry_price", "exit_ts", "exit_price", "reason", "extreme", F.col("stop").alias("stop_at_exit"),
        ((F.col("reason") == "TRAIL") & (F.col("exit_price") != F.col("stop"))).alias("gapped"), X.trade_return(long, "entry_price", "exit_price", cost_bps).alias("pnl"),
    )
    return select_trades(trades)


def macd_trades(df: DataFrame, take: float = 2.0, stop: float = 1.0, hold: int = 2, cooldown: int = 5) -> DataFrame:
    """Trades at the close of bars with a MACD cross (columns cross and atr), one at a time.

    They close at the first close, hold bars on or later, that gained take or lost stop times the ATR of the entry, or at
    the next cross, which may enter the other way at once; after other exits, cooldown bars pass. As crosses alternate, a
    bar belongs to the last cross before it.
    """
    w = Window.partitionBy("symbol").orderBy("ts")
    df = df.withColumns({"idx": F.row_number().over(w), "run": F.sum(F.when(F.col("cross") != 0, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    first = Window.partitionBy("symbol", "run").orderBy("ts")
    df = df.withColumns({x: F.first(y).over(first) for x, y in (("side", "cross"), ("entry_ts", "ts"), ("entry_idx", "idx"), ("entry_price", "close"), ("entry_atr", "atr"))})
    move = (F.col("close") - F.col("entry_price")) * F.col("side")
    reason = F.when(F.col("idx") - F.col("entry_idx") < hold, None).when(move >= take * F.col("entry_atr"), "TP").when(move <= -stop * F.col("entry_atr"), "SL")
    hit = F.min(F.when(reason.isNotNull(), F.struct("idx", "ts", "close", reason.alias("reason"))))
    runs = df.where("run > 0").groupBy("symbol", "run", "side", "entry_ts", "entry_idx", "entry_price", "entry_atr").agg(hit.alias("hit"))
    after = Window.partitionBy("symbol").orderBy("run")
    flip = F.struct(F.lead("entry_idx").over(after).alias("idx"), F.lead("entry_ts").over(after).alias("ts"), F.lead("entry_price").over(after).alias("close"), F.lit("FLIP").alias("reason"))
    runs = runs.withColumn("flip", flip).withColumn("x", F.coalesce("hit", F.when(F.col("flip.idx").isNotNull(), F.col("flip")))).where("x is not null and entry_atr is not null")
    free = F.when(F.col("x.reason") == "FLIP", F.col("x.idx") - 1).otherwise(F.col("x.idx") + cooldown)
    few = runs.select("symbol", F.col("entry_idx").alias("entry_ts"), free.alias("exit_ts"), F.struct("side", "entry_ts", "entry_price", "x").alias("t"))
    long = F.col("t.side") == 1
    return select_trades(few).select(
        "symbol", F.when(long, "long").otherwise("short").alias("direction"), F.col("t.entry_ts").alias("entry_ts"), F.col("t.entry_price").alias("entry_price"), F.col("t.x.ts").alias("exit_ts"),
        F.col("t.x.close").alias("exit_price"), F.col("t.x.reason").alias("reason"), X.trade_return(long, F.col("t.entry_price"), F.col("t.x.close")).alias("pnl"),
    )


def mark_to_market(bars: DataFrame, trades: DataFrame, start_capital: float = 1.0, cost_bps: float = 0.0) -> DataFrame:
    """Per bar: position and equity, the product of closed trades times the open one's move less cost.

    Trades of a symbol do not overlap; there may be several in a session, or one over several. A bar belongs to the last
    trade that has been entered by then, which is carried forward as in an as-of join, so bars are never repeated.
    After a trade that lost more than everything (prices may fall below zero) equity is NaN.
    """
    w = Window.partitionBy("symbol").orderBy("entry_ts")
    t = trades.withColumn("before", F.coalesce(F.exp(F.sum(X.log_growth("pnl")).over(w.rowsBetween(Window.unboundedPreceding, -1))), F.lit(1.0)))
    own = ["direction", "entry_ts", "entry_price", "exit_ts", "pnl", "before"]
    df = asof(bars.select("symbol", "ts", "trading_date", "session_id", "close"), t.select("symbol", *own), F.col("ts"), F.col("entry_ts"), own, prefix="_")
    open_ = F.col("ts") < F.col("_exit_ts")
    move = X.trade_return(F.col("_direction") == "long", "_entry_price", "close", cost_bps)
    position = F.when(open_ & (F.col("_direction") == "long"), 1).when(open_, -1).otherwise(0)
    equity = F.coalesce(F.col("_before") * (1 + F.when(open_, move).otherwise(F.col("_pnl"))), F.lit(1.0)) * start_capital
    return df.select("symbol", "ts", "trading_date", "session_id", "close", position.alias("position"), equity.alias("equity"))


def bias_runs(features: DataFrame, bias: str) -> DataFrame:
    """bias_run: broken where the bias changes."""
    w = Window.partitionBy("symbol").orderBy("ts")
    edge = F.coalesce(F.col(bias) != F.lag(bias).over(w), F.lit(True))
    return features.withColumn("_e", edge.cast("int")).withColumn("bias_run", F.sum("_e").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_e")


def pullback_events(features: DataFrame, bias: str = "DSTATE", s1: str = "S1", s5: str = "S5", s30: str = "S30", may: Column | None = None) -> DataFrame:
    """confirm: S30 and one of S1, S5 against the bias; trigger: both S1 and S5 with it, as the bias run's last such event was a confirmation.

    may: where triggers may act; one elsewhere is none and leaves the confirmation in force.
    """
    df = bias_runs(features, bias)
    b = F.col(bias)
    confirm = (b != 0) & (F.col(s30) == -b) & ((F.col(s1) == -b) | (F.col(s5) == -b))
    ready = (b != 0) & ~confirm & (F.col(s1) == b) & (F.col(s5) == b) & (F.lit(True) if may is None else may)
    w = Window.partitionBy("symbol", "bias_run").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    event = F.when(confirm, 1).when(ready, 0)
    df = df.withColumns({"confirm": F.coalesce(confirm, F.lit(False)), "_v": event})
    return df.withColumn("trigger", F.coalesce(ready & (F.last("_v", ignorenulls=True).over(w) == 1), F.lit(False))).drop("_v")


def nearest_platform(entries: DataFrame, swings: DataFrame, k: int = 2) -> DataFrame:
    """Each entry (symbol, entry_id, is_long, price, closed_idx, any more) with platform: the highest swing low below (lowest swing high above) the price, of swings up to closed_idx - k.

    Swings up to an index are a union of stretches of 2^level of them, one for each bit set in their number, and in each
    stretch the nearest price is a running last in order of price (of shorts, less the price): n log n rows, no pairs.
    """
    s = swings.select("symbol", F.col("idx").alias("at"), F.explode(F.array(F.when(F.col("swing_low"), F.struct(F.lit(True).alias("up"), F.col("low").alias("v"))), F.when(F.col("swing_high"), F.struct(F.lit(False).alias("up"), (-F.col("high")).alias("v"))))).alias("x")).where("x is not null")
    s = s.select("symbol", "at", "x.up", "x.v", F.lit(None).cast(entries.select(F.struct("*")).schema[0].dataType).alias("row"))
    up = F.coalesce(F.col("is_long"), F.lit(False))
    e = entries.select("symbol", F.greatest(F.col("closed_idx") - k + 1, F.lit(0)).alias("at"), up.alias("up"), F.when(up, F.col("price")).otherwise(-F.col("price")).alias("v"), F.struct("*").alias("row"))
    both = s.unionByName(e).withColumn("at", F.col("at").cast("long")).withColumn("top", F.length(F.bin(F.max("at").over(Window.partitionBy("symbol")))).cast("int"))
    levels = F.sequence(F.lit(0), "top")
    part = lambda l: F.call_function("shiftright", F.col("at"), l)
    asked = F.transform(F.filter(levels, lambda l: part(l) % 2 == 1), lambda l: F.struct(l.alias("level"), (part(l) - 1).alias("node")))
    held = F.transform(F.filter(levels, lambda l: part(l) % 2 == 0), lambda l: F.struct(l.alias("level"), part(l).alias("node")))
    both = both.select("symbol", "up", "v", "row", F.explode_outer(F.when(F.col("row").isNull(), held).otherwise(asked)).alias("n"))
    w = Window.partitionBy("symbol", "up", "n").orderBy("v", F.col("row").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    near = F.last(F.when(F.col("row").isNull(), F.col("v")), ignorenulls=True).over(w)
    df = both.withColumn("near", F.when(F.col("n").isNotNull(), near)).where("row is not null").groupBy("row").agg(F.max("near").alias("near"))
    return df.select("row.*", F.when(F.col("row.is_long"), F.col("near")).otherwise(-F.col("near")).alias("platform"))


def pullback_candidates(features: DataFrame, swings: DataFrame, on_completed: bool = True, fast_atr: bool = False, discard: int = 0, k: int = 2) -> DataFrame:
    """Every trigger of pullback_events as an entry with platform, stop and target, for bracket_label.

    features: bars with session_id, tradable, is_session_last, DSTATE, S1, S5, S30, ATR1, ATR30 and P30, the index in
    swings (30-minute bars with idx, swing_low, swing_high) of the last one closed at the bar's start. A bar reads S1 of
    the bar before and enters at its own open; on_completed=False reads its own S1 and enters at the next open.
    fast_atr: the risk ATR is that of bars (as far as S1 is read), not of 30 minutes. There is no entry on bars that are
    not tradable, among a symbol's first discard ones or on the last bar of a session, and these leave the confirmation
    in force; without an ATR there is none either, but the trigger is spent. signal: open, or reentry after a symbol's first.
    """
    w = Window.partitionBy("symbol").orderBy("ts")
    read = (lambda c: F.lag(c).over(w)) if on_completed else F.col
    fill = F.col if on_completed else (lambda c: F.lead(c).over(w))
    df = features.withColumns({"_i": F.row_number().over(w), "_s1": read("S1"), "_atr": read("ATR1") if fast_atr else F.col("ATR30"), "_last": F.coalesce(fill("is_session_last"), F.lit(True))})
    df = df.withColumns({"_ts": fill("ts"), "_open": fill("open"), "_session": fill("session_id")})
    df = pullback_events(df, s1="_s1", may=F.col("tradable") & (F.col("_i") > discard) & ~F.col("_last")).where("trigger and _atr is not null")
    signal = F.when(F.row_number().over(w) == 1, "open").otherwise("reentry")
    entry_id = (F.col("_i") + (0 if on_completed else 1)).cast("long")
    df = df.select("symbol", F.col("_session").alias("session_id"), entry_id.alias("entry_id"), (F.col("DSTATE") == 1).alias("is_long"), F.col("_ts").alias("entry_ts"), F.col("_open").alias("price"), F.col("_atr").alias("atr"), signal.alias("signal"), F.col("P30").alias("closed_idx"))
    df = nearest_platform(df, swings, k).drop("closed_idx").withColumnRenamed("price", "entry_price")
    df = df.withColumn("stop", X.entry_stop(F.col("is_long"), "entry_price", "atr", "platform"))
    return df.withColumn("target", X.partial_target(F.col("is_long"), "entry_price", "stop"))


def bracket_label(
    candidates: DataFrame, bars: DataFrame, mult: float = 3.0, share: float = 0.5, on_range: bool = True, fill_gaps: bool = True, extreme_before: bool = True, atr_now: Column | None = None,
    pessimistic: bool = True, forces_flat: bool = True, cost_bps: float = 0.0,
) -> DataFrame:
    """Legs of each candidate (symbol, session_id, entry_id, is_long, entry_ts, entry_price, stop, target, atr), entered on the bar of entry_ts.

    From the entry bar on: the stop (also if the target is met on the same bar) closes all; the target closes share, and
    a chandelier stop with the first stop as floor the rest, from the next bar on; what is open at the session's end is
    closed at its close. Leg columns: entry_id, reason (SL, TP, TRAIL, END), exit_ts, exit_price, fraction, pnl.
    on_range=False: closes alone hit; fill_gaps=False: stops fill at their level; extreme_before=False: the chandelier's
    best price has the bar's own; atr_now: over bars, the ATR that the chandelier reads at each, where it is NULL or not
    given the entry's; pessimistic=False: a target met with the stop on one bar comes first; forces_flat=False: trades
    outlive their session, and what is open after a symbol's last bar has no leg. Searched by stretches of bars: a candidate
    meets some hundred rows at most, however long it stays open.
    """
    keys, levels = (["symbol", "session_id"], passage.OF_SESSION) if forces_flat else (["symbol"], passage.OF_SYMBOL)
    b = passage.positions(bars.withColumn("_atr_now", F.lit(None).cast("double") if atr_now is None else atr_now), keys)
    none = F.lit(None).cast("double")

    def side(low: Column, top: Column, high: Column) -> dict[str, Column]:
        known = F.col("_atr_now").isNotNull()
        return {"low": low, "top": top, "high": high, "level": F.when(known, low + mult * F.col("_atr_now")).otherwise(none), "fall": F.when(~known, low).otherwise(none)}

    down, up = (F.col("low"), F.col("high")) if on_range else (F.col("close"), F.col("close"))
    last = (F.col("is_session_last") if forces_flat else F.lit(False)).alias("last")
    told = F.struct("ts", "open", "close", last, F.col("_atr_now").alias("atr_now")).alias("bar")
    lowest = passage.both_sides(b, keys, side(down, up, F.col("high")), side(-up, -down, -F.col("low")), not extreme_before, last, told)
    nodes = settled(passage.stretches(lowest, keys, levels))
    long, sign = F.col("is_long"), F.when(F.col("is_long"), 1.0).otherwise(-1.0)
    starts = candidates.select(*keys, "entry_id", "is_long", "entry_ts", "entry_price", "stop", (F.col("stop") * sign).alias("floor"), (F.col("target") * sign).alias("aim"), "target", "atr")
    starts = starts.join(b.select(*keys, F.col("ts").alias("entry_ts"), "pos"), [*keys, "entry_ts"]).withColumn("high", none)
    sl, tp = F.col("low") <= F.col("floor"), F.col("top") >= F.col("aim")
    one = passage.first_passage(starts, nodes, keys, ["symbol", "entry_id"], levels, lambda: F.coalesce(sl, F.lit(False)) | F.coalesce(tp, F.lit(False)) | F.col("last")).where("found is not null")
    met = lambda c, level: F.coalesce(c <= level, F.lit(False))
    stopped, aimed = met(F.col("found.low"), F.col("floor")), F.coalesce(F.col("found.top") >= F.col("aim"), F.lit(False))
    first = F.when(stopped & (F.lit(pessimistic) | ~aimed), "SL").when(aimed, "TP").otherwise("END")
    one = one.withColumn("one", F.struct("found.*", first.alias("first"))).drop("found")
    more = (F.col("one.first") == "TP") & ~F.col("one.bar.last")
    best = F.greatest("one.high", "one.own")
    one = one.drop("pos").withColumns({"pos": F.when(more, F.col("one.pos") + 1), "high": best})
    trail = lambda: met(F.col("low"), F.col("floor")) | met(F.col("level"), F.col("_high")) | F.coalesce(F.col("over") >= 0, F.lit(False)) | F.coalesce((F.col("_high") - F.col("fall")) >= mult * F.col("atr"), F.lit(False)) | F.coalesce(F.col("fell") >= mult * F.col("atr"), F.lit(False))
    two = passage.first_passage(one, nodes, keys, ["symbol", "entry_id"], levels, lambda: trail() | F.col("last"))
    x, y = F.col("one"), F.col("found")
    peak = y["high"] if extreme_before else F.greatest(y["high"], y["own"])
    two = two.withColumn("trail", X.chandelier(long, peak * sign, F.coalesce(y["bar"]["atr_now"], F.col("atr")), "stop", mult))
    low, atr = y["low"], y["bar"]["atr_now"]
    trailed = met(low, F.col("floor")) | F.coalesce(F.when(atr.isNotNull(), low + mult * atr <= peak).otherwise(peak - low >= mult * F.col("atr")), F.lit(False))
    price1 = F.when(x["first"] == "SL", X.gap_fill(long, "stop", x["bar"]["open"], fill_gaps)).when(x["first"] == "TP", F.col("target")).otherwise(x["bar"]["close"])
    leg = lambda n, reason, ts, price, part: F.struct(F.lit(n).alias("leg"), reason.alias("reason"), ts.alias("exit_ts"), price.alias("exit_price"), part.alias("fraction"))
    leg1 = leg(1, x["first"], x["bar"]["ts"], price1, F.when(x["first"] == "TP", F.lit(share)).otherwise(F.lit(1.0)))
    leg2 = F.when((x["first"] == "TP") & x["bar"]["last"], leg(2, F.lit("END"), x["bar"]["ts"], x["bar"]["close"], F.lit(1 - share))).when(
        y.isNotNull(), leg(2, F.when(trailed, "TRAIL").otherwise("END"), y["bar"]["ts"], F.when(trailed, X.gap_fill(long, "trail", y["bar"]["open"], fill_gaps)).otherwise(y["bar"]["close"]), F.lit(1 - share))
    )
    rows = two.select("symbol", "entry_id", "is_long", "entry_ts", "entry_price", F.explode(F.array_compact(F.array(leg1, leg2))).alias("x")).select("symbol", "entry_id", "is_long", "entry_ts", "entry_price", "x.*")
    return rows.withColumn("pnl", X.trade_return(long, "entry_price", "exit_price", cost_bps))


def select_trades(candidates: DataFrame, cooldown_seconds: int = 0) -> DataFrame:
    """Of labelled candidates (symbol, entry_ts, exit_ts, ...), those taken one at a time: each enters after the last one taken has exited. entry_ts and exit_ts are times, or numbers of bars."""
    return ranking.one_at_a_time(candidates, cooldown_seconds * 1_000_000)


class _Cooling:
    """Whether a strategy cools down: begun by a structure break or the losses-th stop in a row in one direction, ended by calm equal days that are not neutral."""

    def __init__(self, losses: int, calm: int) -> None:
        self.losses, self.calm = losses, calm
        self.on, self.same, self.state, self.stops, self.side = False, 0, None, 0, 0

    def arm(self) -> None:
        self.on, self.same, self.state, self.stops, self.side = True, 0, None, 0, 0

    def day(self, state: int, broke: bool) -> bool:
        """A new closed day; whether cooling begins or ends on it."""
        if not self.on:
            if broke:
                self.arm()
            return broke
        self.same = self.same + 1 if state != 0 and state == self.state else int(state != 0)
        self.state = state
        if self.same >= self.calm:
            self.on, self.same, self.state = False, 0, None
        return not self.on

    def stopped(self, side: int) -> bool:
        """A pure stop; whether cooling begins with it."""
        self.stops = self.stops + 1 if side == self.side else 1
        self.side = side
        if self.stops >= self.losses:
            self.arm()
            return True
        return False

    def took(self) -> None:
        self.stops, self.side = 0, 0


#: Steps of cooling down: a closed day's state plus 1, and 3 more if it broke the structure; a target taken; a stop, plus its side.
_TOOK, _STOPPED = 6, 8
#: Days of a block that is worked out by itself.
DAYS_TOGETHER = 256


def automaton(losses: int, calm: int) -> tuple[list[list[int]], list[bool]]:
    """Of each step the state that each state goes to, from 0, the first one; and which states cool down."""
    fields = ("on", "same", "state", "stops", "side")
    known = {tuple(getattr(_Cooling(losses, calm), f) for f in fields): 0}
    todo, table = list(known), [[] for _ in range(_STOPPED + 2)]
    for now in todo:  # grows while it is read
        for step in range(len(table)):
            c = _Cooling(losses, calm)
            for f, v in zip(fields, now, strict=True):
                setattr(c, f, v)
            if step < _TOOK:
                c.day(step % 3 - 1, step >= 3)
            elif step == _TOOK:
                c.took()
            elif not c.on:
                c.stopped(step - _STOPPED)
            then = tuple(getattr(c, f) for f in fields)
            if then not in known:
                known[then] = len(todo)
                todo.append(then)
            table[step].append(known[then])
    return table, [s[0] for s in todo]


def cooldown_spans(daily: DataFrame, exits: DataFrame, losses: int = 3, calm: int = 3) -> DataFrame:
    """Spans (symbol, start, end) of cooling down, over days (symbol, trading_date, state, broke) and exits (symbol, trading_date, direction, n, and at, their order within a day, if there is one).

    n: pure stops in a row in that direction; 0: a target was taken, which sets the count of stops back, as a stop the other
    way does. It begins on a structure break or at the losses-th stop in a row, and ends after calm equal non-neutral days.
    end is NULL while it lasts. A day is read before its exits. What a run of days does to the few states there can be is
    worked out for all of them at once, by blocks of days; blocks are put together in their order and then read again by
    themselves, so no task reads a symbol's whole history.
    """
    state = F.coalesce(F.signum(F.col("state").cast("double")).cast("int"), F.lit(0))
    days = daily.select("symbol", "trading_date", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("at"), F.array(state + 1 + F.when(F.col("broke"), 3).otherwise(0)).alias("steps"))
    at = (ranking.micros("at") if exits.schema["at"].dataType.simpleString().startswith("timestamp") else F.col("at").cast("long")) if "at" in exits.columns else F.lit(0).cast("long")
    side = F.when(F.col("direction") > 0, 1).otherwise(-1)
    outs = exits.select("symbol", "trading_date", F.lit(1).alias("kind"), at.alias("at"), F.when(F.col("n") == 0, F.array(F.lit(_TOOK))).otherwise(F.array_repeat(F.lit(_STOPPED) + side, F.col("n").cast("int"))).alias("steps"))
    table, cools = automaton(losses, calm)
    move = F.array(*(F.array(*map(F.lit, row)) for row in table))
    then = lambda state, step: F.get(F.get(move, step), state)
    block = F.floor(F.datediff("trading_date", F.lit("1970-01-01").cast("date")) / DAYS_TOGETHER)
    events = days.unionByName(outs).withColumn("block", block)
    each = F.array_sort(F.collect_list(F.struct("trading_date", "kind", "at", "steps")))
    blocks = events.groupBy("symbol", "block").agg(each.alias("events"))
    # a block as a map of states, then the state that each block begins in, then blocks by themselves
    steps = F.flatten(F.transform("events", lambda e: e["steps"]))
    ends = F.aggregate(steps, F.array(*map(F.lit, range(len(cools)))), lambda states, step: F.transform(states, lambda s: then(s, step)))
    blocks = settled(blocks.withColumn("ends", ends))
    order = F.array_sort(F.collect_list(F.struct("block", "ends")))
    grown = F.aggregate("maps", F.struct(F.lit(0).alias("state"), F.array().cast("array<int>").alias("all")), lambda x, m: F.struct(F.get(m["ends"], x["state"]).alias("state"), F.concat(x["all"], F.array(x["state"])).alias("all")))
    starts = blocks.groupBy("symbol").agg(order.alias("maps")).select("symbol", F.explode(F.arrays_zip(F.transform("maps", lambda m: m["block"]).alias("block"), grown["all"].alias("state"))).alias("x"))
    rows = blocks.drop("ends").join(starts.select("symbol", "x.block", "x.state"), ["symbol", "block"])
    on = lambda state: F.get(F.array(*map(F.lit, cools)), state)
    flips = F.array().cast("array<struct<day:date,kind:int,at:bigint,on:boolean>>")

    def walk(x: Column, e: Column) -> Column:
        state = F.aggregate(e["steps"], x["state"], then)
        flip = F.struct(e["trading_date"].alias("day"), e["kind"].alias("kind"), e["at"].alias("at"), on(state).alias("on"))
        return F.struct(state.alias("state"), F.when(on(state) != on(x["state"]), F.concat(x["flips"], F.array(flip))).otherwise(x["flips"]).alias("flips"))

    found = F.aggregate("events", F.struct(F.col("state").alias("state"), flips.alias("flips")), walk)
    w = Window.partitionBy("symbol").orderBy("day", "kind", "at")
    flips = rows.select("symbol", F.explode(found["flips"]).alias("x")).select("symbol", "x.*").withColumn("end", F.lead("day").over(w))
    return flips.where("on").select("symbol", F.col("day").alias("start"), "end")


def pullback_trades(features: DataFrame, swings: DataFrame, losses: int = 3, calm: int = 3, breaks_arm: bool = True, fast_atr: bool = False, k: int = 2, **bracket) -> tuple[DataFrame, DataFrame]:
    """The pullback strategy: legs of the trades taken (as of bracket_label, with signal), and the spans (symbol, start, end) of cooling down, in bars' times, end being the bar that ended it.

    features: as for pullback_candidates, with DAY (any name of the last closed day, e.g. its date) and DBREAK. One trade at
    a time; while one is open or the strategy cools down no confirmation counts and the bias is not looked at. What was
    confirmed when a structure break began to cool it down still counts afterwards if the bias is the same. Every entry that
    can follow is labelled by itself; only days and these entries are then read in order, with the state of one symbol.
    """
    w = Window.partitionBy("symbol").orderBy("ts")
    atr = F.lag("ATR1").over(w) if fast_atr else F.col("ATR30")
    df = features.withColumns({"_i": F.row_number().over(w).cast("long"), "_s1": F.lag("S1").over(w), "_atr": atr, "_day": F.col("DAY").isNotNull() & ~F.col("DAY").eqNullSafe(F.lag("DAY").over(w)), "_at": ranking.micros("ts")})
    df = pullback_events(df, s1="_s1")
    ready = F.coalesce((F.col("DSTATE") != 0) & ~F.col("confirm") & (F.col("_s1") == F.col("DSTATE")) & (F.col("S5") == F.col("DSTATE")) & F.col("tradable") & ~F.coalesce("is_session_last", F.lit(True)), F.lit(False))
    days = w.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({"_ready": ready, "_dayno": F.sum(F.col("_day").cast("int")).over(days)})
    run = Window.partitionBy("symbol", "bias_run").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    confirmed = F.max(F.when(F.col("confirm"), F.col("_at"))).over(run)
    last = F.last(F.when(F.col("confirm"), 1).when(F.col("_ready"), 0), ignorenulls=True).over(run)
    first_of_day = F.max(F.col("_ready").cast("int")).over(Window.partitionBy("symbol", "_dayno").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumns({"_confirmed": confirmed, "_may": F.col("_ready") & ((last == 1) | (F.coalesce(first_of_day, F.lit(0)) == 0))})
    upto = F.greatest("_confirmed", F.when(F.col("confirm"), F.col("_at")))
    df = df.withColumns({"_run_before": F.lag("bias_run").over(w), "_confirmed_before": F.lag(upto).over(w)})
    entries = df.where("_may and _atr is not null").select(
        "symbol", "session_id", F.col("_i").alias("entry_id"), (F.col("DSTATE") == 1).alias("is_long"), F.col("ts").alias("entry_ts"), F.col("open").alias("price"), F.col("_atr").alias("atr"), F.col("P30").alias("closed_idx"),
    )
    entries = nearest_platform(entries, swings, k).drop("closed_idx").withColumnRenamed("price", "entry_price")
    entries = entries.withColumn("stop", X.entry_stop(F.col("is_long"), "entry_price", "atr", "platform"))
    entries = entries.withColumn("target", X.partial_target(F.col("is_long"), "entry_price", "stop"))
    legs = bracket_label(entries, features, atr_now=F.lag("ATR1").over(w) if fast_atr else F.col("ATR30"), **bracket)
    ends = legs.groupBy("symbol", "entry_id").agg(F.max(ranking.micros("exit_ts")).alias("exit_at"), F.bool_or(F.col("reason") == "SL").alias("stopped"), F.bool_or(F.col("reason") == "TP").alias("took"))
    none = lambda kind: F.lit(None).cast(kind)
    moves = df.where("_may").select("symbol", F.col("_at").alias("at"), F.lit(1).alias("kind"), "bias_run", F.col("DSTATE").cast("int").alias("bias"), F.col("_confirmed").alias("confirmed"), F.col("_i").alias("entry_id"), F.col("_atr").isNull().alias("spent"), none("long").alias("run_before"), none("boolean").alias("broke"))
    moves = moves.join(ends, ["symbol", "entry_id"], "left")
    edges = df.where("_day").select(
        "symbol", F.col("_at").alias("at"), F.lit(0).alias("kind"), "bias_run", F.coalesce(F.col("DSTATE").cast("int"), F.lit(0)).alias("bias"), F.col("_confirmed_before").alias("confirmed"), none("long").alias("entry_id"), none("boolean").alias("spent"),
        F.col("_run_before").cast("long").alias("run_before"), (F.coalesce(F.col("DBREAK"), F.lit(False)) & F.lit(breaks_arm)).alias("broke"), none("long").alias("exit_at"), none("boolean").alias("stopped"), none("boolean").alias("took"),
    )
    schema = pa.schema([("symbol", pa.string()), ("entry_id", pa.int64()), ("since", pa.int64()), ("until", pa.int64()), ("signal", pa.string())])
    done = fold(moves.unionByName(edges), ["at", "kind"], lambda: _pullback_state(losses, calm), _pullback_step, schema, "symbol string, entry_id long, since long, until long, signal string", _pullback_end)
    spans = done.where("entry_id is null").select("symbol", F.timestamp_micros("since").alias("start"), F.timestamp_micros("until").alias("end"))
    return legs.join(done.where("entry_id is not null").select("symbol", "entry_id", "signal"), ["symbol", "entry_id"]), spans


def _pullback_state(losses: int, calm: int) -> dict:
    """since: from when on confirmations count. held: the bias run in which one from before a cooling still counts; frozen: the bias it had when the cooling began."""
    return {"cooling": _Cooling(losses, calm), "bias_before": 0, "since": -(1 << 62), "held": None, "frozen": None, "trade": None, "signal": "open", "began": None}


def _settled(s: dict, at: int) -> None:
    """The open trade is closed if it ended before at."""
    t, c = s["trade"], s["cooling"]
    if t is None or t["exit_at"] >= at:
        return
    s["trade"], s["since"] = None, t["exit_at"] + 1
    if t["took"]:
        c.took()
    elif t["stopped"]:
        was = c.on
        if c.stopped(t["bias"]) and not was:
            s["began"], s["frozen"] = t["exit_at"], None


def _pullback_step(s: dict, row: dict) -> list[dict]:
    _settled(s, row["at"])
    c: _Cooling = s["cooling"]
    if row["kind"] == 0:
        seen = s["trade"] is None and ((s["held"] is not None and s["held"] == row["run_before"]) or (row["confirmed"] is not None and row["confirmed"] >= s["since"]))
        if not c.on:
            if c.day(row["bias"], row["broke"]):
                s["began"], s["frozen"] = row["at"], s["bias_before"] if seen else None
        elif c.day(row["bias"], row["broke"]):
            s["held"] = row["bias_run"] if s["frozen"] is not None and s["frozen"] == row["bias"] else None
            s["since"] = max(s["since"], row["at"])
            out = [{"symbol": s["symbol"], "entry_id": None, "since": s["began"], "until": row["at"], "signal": None}]
            s["began"], s["bias_before"] = None, row["bias"]
            return out
        s["bias_before"] = row["bias"]
        return []
    if s["trade"] is not None or c.on:
        return []
    if not (s["held"] == row["bias_run"] or (row["confirmed"] is not None and row["confirmed"] >= s["since"])):
        return []
    s["held"] = None
    if row["spent"] or row["exit_at"] is None:
        s["since"] = row["at"] + 1
        return []
    s["trade"] = row
    signal, s["signal"] = s["signal"], "reentry"
    return [{"symbol": s["symbol"], "entry_id": row["entry_id"], "since": None, "until": None, "signal": signal}]


def _pullback_end(s: dict) -> list[dict]:
    _settled(s, 1 << 62)
    return [] if s["began"] is None else [{"symbol": s["symbol"], "entry_id": None, "since": s["began"], "until": None, "signal": None}]


def in_spans(rows: DataFrame, spans: DataFrame, time: str = "trading_date") -> DataFrame:
    """cooling: whether a row's time lies after a span's start and up to its end; by a running sum of starts and ends, without a range join."""
    a = rows.select("symbol", F.col(time).alias("at"), F.lit(1).alias("order"), F.lit(0).alias("step"), F.struct(*rows.columns).alias("row"))
    edge = lambda c, order, step: spans.where(F.col(c).isNotNull()).select("symbol", F.col(c).alias("at"), F.lit(order).alias("order"), F.lit(step).alias("step"), F.lit(None).cast(a.schema["row"].dataType).alias("row"))
    both = a.unionByName(edge("start", 2, 1)).unionByName(edge("end", 2, -1))
    w = Window.partitionBy("symbol").orderBy("at", "order").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("open", F.sum("step").over(w)).where("row is not null").select("row.*", (F.col("open") > 0).alias("cooling"))


#: Switches of a variant, and the most variants of a sweep.
SWITCHES, MOST_VARIANTS = ("mode", "minutes", "lag", "d", "on_range", "fill_gaps"), 1000


def sweep(bars: DataFrame, lines: DataFrame, table: DataFrame, cost_bps: float = 0.0) -> DataFrame:
    """Breakout trades of every row of a table of named switches: variant, mode (of session_mode), minutes (1 or a longer rule), lag (0 to 3), d, on_range, fill_gaps.

    bars: minute bars; lines: as of prev_day_lines. Variants are data: bars are brought to all timeframes and modes in one
    pass, meet the variants of each in one join, and a symbol's variant is part of every key from then on; switches are
    columns. The plan is the same for any number of variants, of which there may be MOST_VARIANTS.
    """
    if table.count() > MOST_VARIANTS:
        raise ValueError(f"at most {MOST_VARIANTS} variants at once")
    seg = bars if "segment_id" in bars.columns else sessions.segments(bars)
    rules = F.broadcast(table.select("minutes").distinct().agg(F.collect_set("minutes").alias("_rules")).withColumn("_k", F.lit(1)))  # one row
    timed = seg.withColumn("_k", F.lit(1)).join(rules, "_k").withColumn("_m", F.explode("_rules")).drop("_k", "_rules").withColumn("symbol", F.struct("symbol", F.col("_m").alias("minutes")))
    tf = sessions.night_flag(resample_segment(timed, F.col("symbol.minutes"), F.col("symbol.minutes") > 1))
    moded = sessions.all_modes(tf.select("symbol", "segment_id", "night", "ts", "trading_date", "open", "high", "low", "close"))
    named = table.select("variant", *SWITCHES)
    df = moded.withColumn("minutes", F.col("symbol.minutes")).join(F.broadcast(named), ["minutes", "mode"]).withColumn("symbol", F.struct(F.col("symbol.symbol").alias("symbol"), "variant"))
    first = F.first("trading_date").over(Window.partitionBy("symbol", "session_id").orderBy("ts"))
    own = lines.select(F.col("symbol").alias("_s"), F.col("trading_date").alias("line_date"), *X.LINES, "valid")
    df = df.withColumns({"line_date": first, "_s": F.col("symbol.symbol")}).join(own, ["_s", "line_date"], "left").withColumn("valid", F.coalesce("valid", F.lit(False)))
    trades = breakout_trades(df, F.col("d"), F.col("on_range"), F.col("fill_gaps"), cost_bps, F.col("lag"))
    return trades.select(F.col("symbol.variant").alias("variant"), F.col("symbol.symbol").alias("symbol"), *TRADE[1:])


def custom_rule(bars: DataFrame, rule, schema: str) -> DataFrame:
    """For rules that cannot be columns: rule takes and returns a pandas frame of one symbol's session, which is of bounded length."""
    return bars.groupBy("symbol", "session_id").applyInPandas(rule, schema)
