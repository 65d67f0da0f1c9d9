"""Scalar functions of prices and trades, as column expressions. NULL in gives NULL out unless said otherwise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Factors of the six reference lines.
F1, F2, F3 = 0.35, 0.07, 0.25
LINES = ("Bbreak", "Ssetup", "Senter", "Benter", "Bsetup", "Sbreak")


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def price_lines(high: Column | str, low: Column | str, close: Column | str, f1: float = F1, f2: float = F2, f3: float = F3) -> dict[str, Column]:
    """The six lines of a reference day, by name."""
    h, l, k = c(high), c(low), c(close)
    sell, buy = h + f1 * (k - l), l - f1 * (h - k)
    half = F.lit((1 + f2) / 2)
    return {
        "Bbreak": sell + f3 * (sell - buy), "Ssetup": sell, "Senter": half * (h + k) - f2 * l,
        "Benter": half * (l + k) - f2 * h, "Bsetup": buy, "Sbreak": buy - f3 * (sell - buy),
    }


def breakout_stop(is_long: Column, extreme: Column | str, d: float = 2.0) -> Column:
    """Trailing stop of a breakout trade, from the best price since entry (seeded at the broken line)."""
    x = c(extreme)
    return F.when(is_long, F.col("Senter") + (x - F.col("Ssetup")) / d).otherwise(F.col("Benter") - (F.col("Bsetup") - x) / d)


def breakout_stop_by_giveback(is_long: Column, extreme: Column | str, d: float = 2.0) -> Column:
    """The same stop told as what is given back of the best price: for checking the closed form."""
    x = c(extreme)
    up = F.col("Bbreak") - F.col("Senter") - (F.col("Bbreak") - F.col("Ssetup")) / d + (x - F.col("Bbreak")) * (1 - 1 / d)
    down = F.col("Benter") - F.col("Sbreak") - (F.col("Bsetup") - F.col("Sbreak")) / d + (F.col("Sbreak") - x) * (1 - 1 / d)
    return F.when(is_long, x - up).otherwise(x + down)


def reversal_stop(is_long: Column, excursion: Column | str, d: float = 2.0) -> Column:
    """Trailing stop of a reversal trade, from its best excursion beyond the entry line."""
    e = c(excursion)
    return F.when(is_long, F.col("Sbreak") + (F.col("Bsetup") - F.col("Sbreak") + e) / d).otherwise(F.col("Bbreak") - (F.col("Bbreak") - F.col("Ssetup") + e) / d)


def entry_stop(is_long: Column, entry: Column | str, atr: Column | str, platform: Column | str, mult: float = 1.5, offset: float = 0.003) -> Column:
    """The nearer of an ATR stop and the platform (a tie takes the ATR), moved away by a share of the entry price."""
    e, p = c(entry), c(platform)
    by_atr = F.when(is_long, e - mult * c(atr)).otherwise(e + mult * c(atr))
    chosen = F.when(F.abs(e - p) < F.abs(e - by_atr), p).otherwise(by_atr)
    return F.when(is_long, chosen - e * offset).otherwise(chosen + e * offset)


def partial_target(is_long: Column, entry: Column | str, stop: Column | str, ratio: float = 2.0) -> Column:
    risk = F.abs(c(entry) - c(stop))
    return F.when(is_long, c(entry) + ratio * risk).otherwise(c(entry) - ratio * risk)


def chandelier(is_long: Column, extreme: Column | str, atr: Column | str, floor: Column | str, mult: float = 3.0) -> Column:
    """A stop that hangs from the best price and is never worse than the first one."""
    return F.when(is_long, F.greatest(c(extreme) - mult * c(atr), c(floor))).otherwise(F.least(c(extreme) + mult * c(atr), c(floor)))


def switched(on: Column | bool, yes: Column, no: Column) -> Column:
    """yes or no, by a switch that is given, or is a column of its own."""
    return F.when(on, yes).otherwise(no) if isinstance(on, Column) else yes if on else no


def gap_fill(is_long: Column, level: Column | str, bar_open: Column | str, enabled: Column | bool = True) -> Column:
    """A stop fills at the worse of its level and the bar's open."""
    worse = F.when(is_long, F.least(c(level), c(bar_open))).otherwise(F.greatest(c(level), c(bar_open)))
    return switched(enabled, worse, c(level))


def divided(a: Column | str, b: Column | str) -> Column:
    """a / b as doubles: over zero it is infinite, or NaN where a is zero too, and no error."""
    x, y = c(a).cast("double"), c(b).cast("double")
    return F.coalesce(F.try_divide(x, y), F.when(y == 0, x * F.lit(float("inf"))))


def log_growth(ret: Column | str) -> Column:
    """ln(1 + ret), for products as sums: -inf where all is lost, and NaN where more than that is, as such a loss has no growth rate (log1p gives NULL for both, which a sum leaves out)."""
    x = c(ret)
    return F.when(x > -1, F.log1p(x)).when(x == -1, float("-inf")).when(x < -1, float("nan"))


def trade_return(is_long: Column, entry: Column | str, exit_: Column | str, cost_bps: float = 0.0) -> Column:
    move = F.when(is_long, c(exit_) - c(entry)).otherwise(c(entry) - c(exit_))
    return divided(move, entry) - cost_bps / 1e4


def log_jumps(price: Column | str, before: Column | str, k: Column | str, k_before: Column | str) -> dict[str, Column]:
    """Absolute log change as it is, with prices times K, and over K."""
    raw, ratio = F.log(c(price) / c(before)), F.log(c(k) / c(k_before))
    return {"raw": F.abs(raw), "times_k": F.abs(raw + ratio), "over_k": F.abs(raw - ratio)}


def snap(value: Column | str, candidates: Sequence[float]) -> Column:
    """The candidate nearest in ratio; of two as near, the lesser."""
    items = F.array(*(F.lit(float(x)) for x in sorted(candidates)))
    near = F.transform(items, lambda x: F.struct(F.abs(F.log(c(value) / x)).alias("far"), x.alias("x")))
    return F.when(c(value) > 0, F.array_min(near)["x"])


def state_name(state: Column | str) -> Column:
    return F.when(c(state) > 0, "long").when(c(state) < 0, "short").when(c(state) == 0, "neutral").otherwise("n/a")


def _unbounded(x: Column, plus: str) -> Column:
    """What printf shows of NaN and infinity; NULL for other numbers."""
    return F.when(F.isnan(x), f"{plus}nan").when(x == float("inf"), f"{plus}inf").when(x == float("-inf"), "-inf")


def percent(x: Column | str, digits: int = 2) -> Column:
    return F.coalesce(F.concat(_unbounded(c(x), "+"), F.lit("%")), F.when(c(x).isNotNull(), F.format_string(f"%+.{digits}f%%", c(x) * 100)), F.lit("n/a"))


def ratio(x: Column | str, digits: int = 2) -> Column:
    return F.coalesce(_unbounded(c(x), ""), F.when(c(x).isNotNull(), F.format_string(f"%.{digits}f", c(x))), F.lit("n/a"))


def price_decimals(price: Column | str) -> Column:
    """Decimals to show: fewer for greater prices."""
    p = F.abs(c(price))
    return F.when(p >= 1000, 1).when(p >= 100, 2).when(p >= 1, 3).otherwise(5)


def contract_digits(contract: Column | str, symbol: Column | str) -> Column:
    return F.length(c(contract)) - F.length(c(symbol))


def zero_pattern() -> Column:
    """Which of the four prices are zero, as letters."""
    return F.concat_ws("", *(F.when(F.col(x) == 0, x[0].upper()) for x in ("open", "high", "low", "close")))


def floor_time(ts: Column | str, minutes: int | Column) -> Column:
    """ts (without zone) floored to a multiple of minutes since midnight of 1970."""
    seconds = F.unix_seconds(c(ts).cast("timestamp"))
    return F.timestamp_seconds(seconds - seconds % (minutes * 60))
