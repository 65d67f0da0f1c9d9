"""Streams of ticks and bars. Ticks: symbol, ts, price, volume; bars: symbol, ts, open, high, low, close, volume."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def tick_bars(ticks: DataFrame, minutes: int = 1, late: str = "2 minutes") -> DataFrame:
    """Tumbling bars. In append mode only closed ones come out; in update mode the forming ones do too."""
    w = F.window("ts", f"{minutes} minutes")
    out = ticks.withWatermark("ts", late).groupBy("symbol", w).agg(F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("ticks"))
    return out.select("symbol", F.col("window.start").alias("bar_start"), F.col("window.end").alias("ts"), "open", "high", "low", "close", "volume", "ticks")


def gap_sessions(bars: DataFrame, gap: str = "3 hours", late: str = "10 minutes") -> DataFrame:
    """Sessions of a symbol and trading date that a gap ends."""
    out = bars.withWatermark("ts", late).groupBy("symbol", "trading_date", F.session_window("ts", gap)).agg(F.count("*").alias("bars"), F.max("high").alias("high"), F.min("low").alias("low"))
    return out.select("symbol", "trading_date", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "bars", "high", "low")


def unique_bars(bars: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Bars without those that come again within the watermark."""
    return bars.withWatermark("ts", late).dropDuplicatesWithinWatermark(["symbol", "ts"])


class InOrder(StatefulProcessor):
    """Keeps a symbol's bars until the watermark has passed them and steps over them in order of time, so that the order of
    arrival within the watermark does not matter. An event-time timer wakes a symbol at its earliest waiting bar; another
    ends it when the watermark is KEEP beyond its last bar: what is held of it goes, and a later bar begins anew.

    Bars of the same time are taken in order of their values. Times are microseconds (column at), whatever the session's time zone.
    """

    BAR: tuple[str, ...] = ()  # columns of a bar, at first
    BAR_SCHEMA = HELD = ""  # what waits; what is held between bars, whose first field is the last bar's time
    OUT: tuple[str, ...] = ()

    def __init__(self, keep_seconds: float) -> None:
        self.keep = int(keep_seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.BAR_SCHEMA)
        self.held = handle.getValueState("held", self.HELD)

    def step(self, symbol: str, held: tuple | None, bar: tuple, out: list[tuple]) -> tuple:
        """What is held after bar; rows that come out are appended to out."""
        raise NotImplementedError

    def end(self, symbol: str, held: tuple, out: list[tuple]) -> None:
        """Rows that come out when a symbol ends."""

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = [bar for part in rows for bar in part[list(self.BAR)].itertuples(index=False, name=None)]
        self.waiting.appendList(came)
        self.handle.registerTimer(_millis(min(bar[0] for bar in came)))
        yield self._frame([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(tuple(bar) for bar in self.waiting.get()) if self.waiting.exists() else []
        due = [bar for bar in waiting if bar[0] <= now]
        later = waiting[len(due) :]
        held = tuple(self.held.get()) if self.held.exists() else None
        before, out = held and held[0], []
        for bar in due:
            if held is not None and held[0] + self.keep <= bar[0]:
                self.end(key[0], held, out)
                held = None
            held = self.step(key[0], held, bar, out)
        if held is not None and held[0] + self.keep <= now:
            self.end(key[0], held, out)
            held = None
        if due:
            if later:
                self.waiting.put(later)
                self.handle.registerTimer(_millis(later[0][0]))
            else:
                self.waiting.clear()
        if held is None:
            self.held.clear()
        elif due:
            if before is not None:
                self.handle.deleteTimer(_millis(before + self.keep))
            self.held.update(held)
            self.handle.registerTimer(_millis(held[0] + self.keep))
        yield self._frame(out)

    def close(self) -> None:
        pass

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["symbol", *self.OUT])


def _millis(micros: int) -> int:
    return -(-micros // 1000)


class LiveIndicators(InOrder):
    """Keeps a symbol's exponential means and the last true ranges; gives MACD, its signal and ATR for each bar."""

    ATR = 14
    BAR = ("at", "high", "low", "close")
    BAR_SCHEMA = "at long, high double, low double, close double"
    HELD = "at long, fast double, slow double, signal double, close double, ranges array<double>"
    OUT = ("at", "macd", "signal", "atr")

    def step(self, symbol, held, bar, out):
        at, high, low, now = bar
        _, fast, slow, signal, close, ranges = held or (None, None, None, None, None, [])
        mean = lambda e, x, span: x if e is None else e + (x - e) * 2 / (span + 1)
        fast, slow = mean(fast, now, 12), mean(slow, now, 26)
        signal = mean(signal, fast - slow, 9)
        tr = high - low if close is None else max(high - low, abs(high - close), abs(low - close))
        ranges = [*ranges, tr][-self.ATR :]
        out.append((symbol, at, fast - slow, signal, sum(ranges) / self.ATR if len(ranges) == self.ATR else None))
        return at, fast, slow, signal, now, ranges


class ArmAndTrigger(InOrder):
    """Per symbol: armed by a session's extremes beyond the setup lines, triggers a reversal once. A session ends with the
    first bar of another one or by its timer; if it never triggered it then comes out as unarmed, or armed when it was."""

    BAR = ("at", "session_id", "open", "high", "low", "Ssetup", "Bsetup", "Senter", "Benter")
    BAR_SCHEMA = "at long, session_id long, open double, high double, low double, Ssetup double, Bsetup double, Senter double, Benter double"
    HELD = "at long, session long, high double, low double, arm int, done boolean, high1 double, low1 double"
    OUT = ("session_id", "at", "event", "side", "price")

    def step(self, symbol, held, bar, out):
        at, session_id, opened, high_now, low_now, s_setup, b_setup, s_enter, b_enter = bar
        if held is not None and held[1] != session_id:
            self.end(symbol, held, out)
            held = None
        _, _, high, low, arm, done, high1, low1 = held or (None, None, None, None, 0, False, None, None)
        if high is not None:
            above, below = high >= s_setup, low <= b_setup
            new_s, new_l = above and not arm & 1, below and not arm & 2
            arm |= (1 if above else 0) | (2 if below else 0)
            arm = (arm & 3) | (12 if new_s and new_l else 4 if new_s else 8 if new_l else arm & 12)
            side = {4: -1, 8: 1}.get(arm & 12, 0)
            if not done and ((side == -1 and low1 < s_enter) or (side == 1 and high1 > b_enter)):
                done = True
                out.append((symbol, session_id, at, "reversal", side, opened))
        return at, session_id, high_now if high is None else max(high, high_now), low_now if low is None else min(low, low_now), arm, done, high_now, low_now

    def end(self, symbol, held, out):
        at, session, _, _, arm, done, _, _ = held
        if not done:
            out.append((symbol, session, at, "armed" if arm & 12 else "unarmed", {4: -1, 8: 1}.get(arm & 12, 0), None))


def _stepped(bars: DataFrame, processor: InOrder, schema: str, late: str, needed: tuple[str, ...]) -> DataFrame:
    """bars through processor, which sees those without missing values in needed, once the watermark has passed them."""
    whole = bars.withWatermark("ts", late).where(" and ".join(f"{x} is not null" for x in ("symbol", "ts", *needed)))
    columns = ["symbol", "ts", F.unix_micros(F.col("ts")).alias("at"), *(x for x in processor.BAR if x != "at")]
    out = whole.select(*columns).groupBy("symbol").transformWithStateInPandas(processor, schema, "Append", "EventTime")
    return out.withColumn("ts", F.timestamp_micros("at")).drop("at")


def live_indicators(bars: DataFrame, late: str = "2 minutes", keep_days: float = 30) -> DataFrame:
    """MACD, its signal and ATR of each bar, when the watermark has passed it: bars may come in any order within late. A symbol without bars for keep_days begins anew; bars with missing prices do not count."""
    return _stepped(bars, LiveIndicators(keep_days * 86400), "symbol string, at long, macd double, signal double, atr double", late, ("high", "low", "close"))


def live_reversals(bars: DataFrame, late: str = "2 minutes", gap_hours: float = 3) -> DataFrame:
    """bars with session_id and lines (missing lines arm nothing): the reversal of each session, and sessions that end without one, by a timer gap_hours after their last bar."""
    return _stepped(bars, ArmAndTrigger(gap_hours * 3600), "symbol string, session_id long, at long, event string, side int, price double", late, ("session_id", "high", "low"))
