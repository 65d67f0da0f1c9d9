"""Runs, segments, trading sessions and calendars of bars.

Windows over bars are by symbol and trading date: dates do not overlap in time, and each begins a run, a segment and, in
most modes, a session, so what a date must know of others is in one row for each of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidebar.functions.scalars import price_lines


def by_time() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("ts")


def numbered(df: DataFrame, name: str, bucket: Column | None = None) -> DataFrame:
    """df with each row's place in its symbol in order of ts, from 0: places inside a bucket (a coarser ts, its date if none is given) and the numbers of rows before it, so that no symbol is one task. Rows without a ts come first."""
    df = df.withColumn("_bucket", F.to_date("ts") if bucket is None else bucket)
    earlier = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(F.col("symbol").alias("_s"), F.col("_bucket").alias("_b")).agg(F.count("*").alias("_n"))
    counts = counts.select("_s", "_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    df = df.withColumn(name, F.row_number().over(Window.partitionBy("symbol", "_bucket").orderBy("ts")) - 1)
    df = df.join(counts, F.col("symbol").eqNullSafe(F.col("_s")) & F.col("_bucket").eqNullSafe(F.col("_b")))
    return df.withColumn(name, F.col(name) + F.col("_before")).drop("_bucket", "_s", "_b", "_before")


def in_blocks(df: DataFrame, work: Callable[[DataFrame], DataFrame], before: int, after: int = 0, rows: int = 65_536, bucket: Column | None = None) -> DataFrame:
    """work(df), for work that adds columns by windows over by_time() which read at most before rows ahead of a row and after rows behind it.

    A symbol is cut in blocks of equal numbers of rows, each with copies of the rows around it that its windows read; work
    sees a block as a symbol of its own. So tasks have the same size however many bars a symbol has, and results are those
    of the whole series. Columns that df has must stay.
    """
    if max(before, after) > rows:
        raise ValueError("blocks are shorter than what windows read around them")
    df = numbered(df, "_at", bucket)
    at, own = F.col("_at") % rows, F.floor(F.col("_at") / rows)
    blocks = F.array_compact(F.array(own, F.when(at >= rows - before, own + 1), F.when((at < after) & (own > 0), own - 1)))
    df = df.withColumns({"_in": own, "_block": F.explode(blocks)}).withColumn("symbol", F.struct("symbol", "_block"))
    return work(df).where("_in = _block").withColumn("symbol", F.col("symbol.symbol")).drop("_at", "_in", "_block")


MODES = ("night", "day", "night_day", "day_night", "split")
SPLIT_GAP_SECONDS = 3 * 3600


def gap_seconds() -> Column:
    return F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.lag("ts").over(by_time()).cast("timestamp"))


def new_date() -> Column:
    return F.coalesce(F.col("trading_date") != F.lag("trading_date").over(by_time()), F.lit(True))


def _of_date() -> WindowSpec:
    return Window.partitionBy("symbol", "trading_date").orderBy("ts")


def _numbered(df: DataFrame, name: str, gap: int) -> DataFrame:
    """Running number, from 0, of stretches that end with a trading date or where more than gap seconds pass: inside dates, plus those of the dates before."""
    seconds = lambda c: F.unix_seconds(c.cast("timestamp"))
    edge = F.coalesce(seconds(F.col("ts")) - seconds(F.lag("ts").over(_of_date())) > gap, F.lit(True))
    df = df.withColumn("_edge", edge.cast("long")).withColumn("_own", F.sum("_edge").over(_of_date().rowsBetween(Window.unboundedPreceding, 0)))
    before = Window.partitionBy("symbol").orderBy("trading_date").rowsBetween(Window.unboundedPreceding, -1)
    dates = df.groupBy("symbol", "trading_date").agg(F.sum("_edge").alias("_n")).select("symbol", "trading_date", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return df.join(dates, ["symbol", "trading_date"]).withColumn(name, F.col("_before") + F.col("_own") - 1).drop("_edge", "_own", "_before")


def contiguous_runs(bars: DataFrame) -> DataFrame:
    """run: broken where more than a minute passes or the trading date changes."""
    return _numbered(bars, "run", 60)


def segments(bars: DataFrame) -> DataFrame:
    """segment_id: broken where the trading date changes or more than three hours pass."""
    return _numbered(bars, "segment_id", SPLIT_GAP_SECONDS)


def with_dead(bars: DataFrame, min_bars: int = 20, max_traded: int = 2) -> DataFrame:
    """Marks bars of runs that hardly trade: many bars with at most max_traded traded, or no volume at all."""
    w = Window.partitionBy("symbol", "run")
    traded, n, volume = F.count_if(F.col("volume") > 0).over(w), F.count("*").over(w), F.sum("volume").over(w)
    return contiguous_runs(bars).withColumn("dead", ((n >= min_bars) & (traded <= max_traded)) | (volume == 0))


def drop_dead_runs(bars: DataFrame, min_bars: int = 20, max_traded: int = 2) -> tuple[DataFrame, DataFrame]:
    """Bars without dead runs, and a table of the runs dropped."""
    marked = with_dead(bars, min_bars, max_traded)
    gone = marked.where("dead").groupBy("symbol", "run").agg(F.first("trading_date").alias("trading_date"), F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("bars"), F.count_if(F.col("volume") > 0).alias("traded"), F.sum("volume").alias("vol"))
    return marked.where("not dead").drop("run", "dead"), gone.drop("run")


def night_flag(bars: DataFrame) -> DataFrame:
    """night: every segment of a trading date but its last."""
    w = Window.partitionBy("symbol", "trading_date")
    return bars.withColumn("night", F.col("segment_id") < F.max("segment_id").over(w))


def _with_sessions(bars: DataFrame, modes: tuple[str, ...]) -> DataFrame:
    """Segments and nights, and for each of modes a struct of its session columns. Windows over bars are by trading date; what crosses dates (the day's session that the next night prolongs) is told by how many segments dates have."""
    df = bars if {"segment_id", "night"} <= set(bars.columns) else night_flag(segments(bars))
    by_symbol = Window.partitionBy("symbol").orderBy("trading_date")
    dates = df.groupBy("symbol", "trading_date").agg(F.countDistinct("segment_id").alias("_segments"))
    dates = dates.withColumns({"_rank": F.row_number().over(by_symbol), "_next": F.lead("_segments").over(by_symbol)})
    dates = dates.withColumn("_early", (F.first("_segments").over(by_symbol) > 1).cast("int"))  # the first date begins with a night
    df = df.join(dates, ["symbol", "trading_date"])
    w = _of_date()
    df = df.withColumns({"_b": F.lag("segment_id").over(w), "_a": F.lead("segment_id").over(w), "_an": F.lead("night").over(w), "_bn": F.lag("night").over(w)})
    opens, closes = F.col("_b").isNull(), F.col("_a").isNull()
    night = F.col("night")
    edges = {
        "segment": (opens | (F.col("_b") != F.col("segment_id")), closes | (F.col("_a") != F.col("segment_id")), F.col("segment_id") + 1),
        "night_day": (opens, closes, F.col("_rank").cast("long")),
        "day_night": (
            F.when(opens, ~night | (F.col("_rank") == 1)).otherwise(F.col("_bn") & ~night), F.when(closes, F.coalesce(F.col("_next") == 1, F.lit(True))).otherwise(night & ~F.col("_an")),
            (F.col("_rank") - night.cast("int") + F.col("_early")).cast("long"),
        ),
    }
    tradable = {"night": night, "day": ~night}
    sessions = {}
    for m in modes:
        first, last, session = edges.get(m, edges["segment"])
        sessions[f"_in_{m}"] = F.struct(tradable.get(m, F.lit(True)).alias("tradable"), first.alias("is_session_first"), last.alias("is_session_last"), session.alias("session_id"), F.lit(m).alias("mode"))
    return df.withColumns(sessions).drop("_segments", "_rank", "_next", "_early", "_b", "_a", "_an", "_bn")


def session_mode(bars: DataFrame, mode: str = "split") -> DataFrame:
    """session_id, is_session_first, is_session_last and tradable under one of MODES."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; one of {MODES}")
    df = _with_sessions(bars, (mode,))
    return df.withColumns({c: F.col(f"_in_{mode}.{c}") for c in ("tradable", "is_session_first", "is_session_last", "session_id")}).drop(f"_in_{mode}")


def all_modes(bars: DataFrame) -> DataFrame:
    """All five modes as one table with a column mode; segments and nights are worked out once."""
    df = _with_sessions(bars, MODES)
    kept = [c for c in df.columns if not c.startswith("_in_")]
    return df.select(*kept, F.inline(F.array(*(f"_in_{m}" for m in MODES))))


def daily_ohlc(bars: DataFrame) -> DataFrame:
    """Per symbol and trading date: open, high, low, close (first and last by time), volume, bars."""
    return bars.groupBy("symbol", "trading_date").agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("bars"))


def prev_day_lines(daily: DataFrame, min_ref_bars: int = 30, max_gap_days: int = 15, tradable_from: str | None = None) -> DataFrame:
    """For each day the previous one's high, low, close and the six lines, and whether they may be used."""
    w = Window.partitionBy("symbol").orderBy("trading_date")
    ref = {f"ref_{k}": F.lag(v).over(w) for k, v in (("h", "high"), ("l", "low"), ("c", "close"), ("bars", "bars"), ("date", "trading_date"))}
    df = daily.withColumns(ref).withColumns(price_lines("ref_h", "ref_l", "ref_c"))
    valid = (F.col("ref_bars") >= min_ref_bars) & (F.datediff("trading_date", "ref_date") <= max_gap_days) & F.col("ref_h").isNotNull()
    if tradable_from:
        valid = valid & (F.col("trading_date") >= F.lit(tradable_from).cast("date"))
    return df.withColumn("valid", F.coalesce(valid, F.lit(False)))


def attach_lines(bars: DataFrame, lines: DataFrame) -> DataFrame:
    """Every bar gets the lines of the trading date of its session's first bar."""
    w = Window.partitionBy("symbol", "session_id").orderBy("ts")
    names = ["Bbreak", "Ssetup", "Senter", "Benter", "Bsetup", "Sbreak", "valid"]
    dated = bars.withColumn("line_date", F.first("trading_date").over(w))
    return dated.join(lines.select("symbol", F.col("trading_date").alias("line_date"), *names), ["symbol", "line_date"], "left").withColumn("valid", F.coalesce("valid", F.lit(False)))


def adjust_prices(bars: DataFrame) -> DataFrame:
    """Prices over K times the K of each symbol's first bar, of those in the window where window_cut has marked one (its warm-up days are adjusted to the same base); volume as it is."""
    shown = F.when(F.col("in_window"), F.col("ts")) if "in_window" in bars.columns else F.col("ts")
    k0 = bars.groupBy("symbol").agg(F.min_by("K", shown).alias("k0"))
    df = bars.join(k0, "symbol")
    return df.withColumns({x: F.col(x) / F.col("K") * F.col("k0") for x in ("open", "high", "low", "close")})


def window_cut(bars: DataFrame, start: str, end: str, warmup_days: int = 0) -> DataFrame:
    """Trading dates from start to end with warmup_days earlier ones; in_window marks the former, warmup_days_found how many of the latter there are."""
    day = bars.select("symbol", "trading_date").distinct()
    before = F.col("trading_date") < F.lit(start).cast("date")
    rank = F.row_number().over(Window.partitionBy("symbol", before).orderBy(F.desc("trading_date")))
    keep = day.where(F.col("trading_date") <= F.lit(end).cast("date")).withColumns({"in_window": ~before, "back": rank}).where(F.col("in_window") | (F.col("back") <= warmup_days))
    found = F.count_if(~F.col("in_window")).over(Window.partitionBy("symbol"))
    return bars.join(keep.withColumn("warmup_days_found", found).drop("back"), ["symbol", "trading_date"])


def day_context(bars: DataFrame, date: str, n: int = 3) -> DataFrame:
    """Daily rows within n trading dates of a date."""
    daily = daily_ohlc(bars).withColumn("rank", F.dense_rank().over(Window.partitionBy("symbol").orderBy("trading_date")))
    at = daily.where(F.col("trading_date") == F.lit(date).cast("date")).select("symbol", F.col("rank").alias("centre"))
    return daily.join(at, "symbol").where(F.abs(F.col("rank") - F.col("centre")) <= n).drop("rank", "centre")


def tradable_days(bars: DataFrame) -> DataFrame:
    """Distinct dates with tradable bars of a valid reference day."""
    return bars.groupBy("symbol").agg(F.countDistinct(F.when(F.col("tradable") & F.col("valid"), F.col("trading_date"))).alias("tradable_days"))


def ambiguous_gaps(bars: DataFrame) -> DataFrame:
    """Gaps inside a trading date that are neither a break nor clearly a session edge: over 2 h 15 min, under 6 h."""
    df = bars.withColumns({"gap": gap_seconds(), "same": ~new_date()})
    return df.where("same and gap > 8100 and gap < 21600").select("symbol", "ts", "trading_date", "gap")


def misplaced_segments(bars: DataFrame) -> DataFrame:
    """Segments whose first bar is at an hour that a night (20-04) or day (08-14) segment does not begin at."""
    first = night_flag(segments(bars)).groupBy("symbol", "segment_id").agg(F.min("ts").alias("ts"), F.first("night").alias("night"))
    hour = F.hour("ts") + F.minute("ts") / 60
    return first.where((F.col("night") & ~((hour >= 20) | (hour < 4))) | (~F.col("night") & ~((hour >= 8) & (hour < 14))))
