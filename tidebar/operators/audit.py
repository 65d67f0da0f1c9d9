"""Data-quality audit: each check returns rows for each symbol, or the rows at fault."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidebar.functions import scalars as X
from tidebar.operators.sessions import by_time, contiguous_runs, gap_seconds, in_blocks, new_date, numbered
from tidebar.sources.bars import hard_error, is_night


def _by_day() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("trading_date")




def duplicates(bars: DataFrame, arrival: str | None = None) -> DataFrame:
    """Bars and how many of them have a time that another one has. With arrival, a whole number that tells the order in which
    bars came: also how many repeat the time of the bar that came before (adjacent), and how many go back behind it (backward)."""
    out = bars.groupBy("symbol").agg(F.count("*").alias("bars"), (F.count("*") - F.countDistinct("ts")).alias("duplicates"))
    if arrival is None:
        return out
    came = bars.select("symbol", F.col("ts").alias("stamp"), F.struct(F.col(arrival).alias("n"), "ts").alias("ts"))
    came = in_blocks(came, lambda b: b.withColumn("last", F.lag("stamp").over(by_time())), 1, bucket=F.floor(F.col("ts.n") / 65_536))
    steps = came.groupBy("symbol").agg(F.count_if(F.col("stamp") == F.col("last")).alias("adjacent"), F.count_if(F.col("stamp") < F.col("last")).alias("backward"))
    return out.join(steps, "symbol")


def coverage(bars: DataFrame, as_of: str, short_bars: int = 1000) -> DataFrame:
    df = bars.groupBy("symbol").agg(F.count("*").alias("bars"), F.min("trading_date").alias("first"), F.max("trading_date").alias("last"), F.countDistinct("trading_date").alias("dates"))
    return df.withColumns({"stale_days": F.datediff(F.lit(as_of).cast("date"), "last"), "too_short": F.col("bars") < short_bars})


def ohlc_violations(bars: DataFrame) -> DataFrame:
    o, h, l, k = (F.col(x) for x in ("open", "high", "low", "close"))
    return bars.groupBy("symbol").agg(F.count_if(h < l).alias("high_below_low"), F.count_if(h < F.greatest(o, k)).alias("high_below_body"), F.count_if(l > F.least(o, k)).alias("low_above_body"), F.count_if((o <= 0) | (h <= 0) | (l <= 0) | (k <= 0)).alias("not_positive"), F.count_if(o.isNull() | h.isNull() | l.isNull() | k.isNull()).alias("missing"))


def amount_violations(bars: DataFrame) -> DataFrame:
    v, t, i = F.col("volume"), F.col("total_turnover"), F.col("open_interest")
    return bars.groupBy("symbol").agg(F.count_if(v < 0).alias("volume_negative"), F.count_if(t < 0).alias("turnover_negative"), F.count_if(i < 0).alias("oi_negative"), F.count_if((v == 0) != (t == 0)).alias("contradicting"), F.avg(F.when(F.coalesce(i, F.lit(0.0)) == 0, 1.0).otherwise(0.0)).alias("oi_zero_share"))


def k_availability(bars: DataFrame) -> DataFrame:
    """How many factors are missing, infinite or not positive; median, least and greatest of the finite ones."""
    k = F.col("K")
    infinite = k.isin(float("inf"), float("-inf"))
    finite = F.when(~F.isnan(k) & ~infinite, k)
    return bars.groupBy("symbol").agg(F.count_if(k.isNull() | F.isnan(k)).alias("k_missing"), F.count_if(infinite).alias("k_infinite"), F.count_if(finite <= 0).alias("k_not_positive"), F.percentile(finite, F.lit(0.5)).alias("k_median"), F.min(finite).alias("k_min"), F.max(finite).alias("k_max"))


def padding(bars: DataFrame) -> DataFrame:
    flat = (F.col("open") == F.col("high")) & (F.col("high") == F.col("low")) & (F.col("low") == F.col("close")) & (F.col("volume") == 0)
    per = bars.groupBy("symbol", F.to_date("ts").alias("d")).agg(F.sum("volume").alias("v"), F.count_if(flat).alias("pads"), F.count("*").alias("n"))
    return per.groupBy("symbol").agg(F.sum("pads").alias("padding"), F.sum("n").alias("bars"), F.count_if(F.col("v") == 0).alias("dead_dates"))


def calendar_spread(bars: DataFrame) -> DataFrame:
    """How many calendar dates a trading date spans: the commonest and the greatest number."""
    per = bars.groupBy("symbol", "trading_date").agg(F.countDistinct(F.to_date("ts")).alias("n"))
    return per.groupBy("symbol", "n").agg(F.count("*").alias("days")).groupBy("symbol").agg(F.max_by("n", F.struct("days", -F.col("n"))).alias("mode_days"), F.max("n").alias("max_days"))


def polluted_dates(bars: DataFrame) -> DataFrame:
    """Trading dates over more calendar dates than is usual for their symbol that have a stretch without volume."""
    per = bars.groupBy("symbol", "trading_date").agg(F.countDistinct(F.to_date("ts")).alias("n"))
    many = per.join(calendar_spread(bars), "symbol").where(F.col("n") > F.col("mode_days")).select("symbol", "trading_date", "n")
    return many.join(fake_segments(bars), ["symbol", "trading_date"], "left_semi")


def session_fingerprint(bars: DataFrame, share: float = 0.2) -> DataFrame:
    """Minutes that at least a share of dates have, as text of their runs; whether there are night minutes, and some past midnight."""
    minute = (F.hour("ts") * 60 + F.minute("ts")).alias("m")
    dates = bars.groupBy("symbol").agg(F.countDistinct("trading_date").alias("dates"))
    usual = bars.select("symbol", "trading_date", minute).distinct().groupBy("symbol", "m").agg(F.count("*").alias("n")).join(dates, "symbol").where(F.col("n") >= share * F.col("dates"))
    w = Window.partitionBy("symbol").orderBy("m")
    runs = usual.withColumn("run", F.col("m") - F.row_number().over(w)).groupBy("symbol", "run").agg(F.min("m").alias("a"), F.max("m").alias("b"))
    clock = lambda x: F.format_string("%02d:%02d", F.floor(F.col(x) / 60), F.col(x) % 60)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", F.concat(clock("a"), F.lit("-"), clock("b")).alias("t")))), lambda r: r["t"]), " ")
    return runs.groupBy("symbol").agg(text.alias("sessions"), F.bool_or((F.col("b") >= 21 * 60) | (F.col("a") < 180)).alias("has_night"), F.bool_or(F.col("a") < 180).alias("crosses_midnight"))


def fingerprint_changes(bars: DataFrame, since: str) -> DataFrame:
    """Symbols with sessions before and from a date on, and whether they differ."""
    day = F.lit(since).cast("date")
    part = lambda rows, name: session_fingerprint(bars.where(rows)).select("symbol", F.col("sessions").alias(name))
    both = part(F.col("trading_date") < day, "before").join(part(F.col("trading_date") >= day, "since"), "symbol", "full")
    return both.withColumn("changed", ~F.col("before").eqNullSafe(F.col("since")))


def bars_in_breaks(bars: DataFrame) -> DataFrame:
    m = F.hour("ts") * 60 + F.minute("ts")
    return bars.groupBy("symbol").agg(F.count_if((m >= 616) & (m <= 630)).alias("morning"), F.count_if((m >= 691) & (m <= 810)).alias("noon"))


def night_close_tier(bars: DataFrame) -> DataFrame:
    """The last usual night minute, past midnight counted on."""
    m = F.hour("ts") * 60 + F.minute("ts")
    on = F.when(m < 180, m + 1440).otherwise(m)
    df = bars.where(is_night("ts")).groupBy("symbol").agg(F.max(on).alias("last"))
    return df.withColumn("tier", F.when(F.col("last") > 1560, "02:30").when(F.col("last") > 1380, "01:00").otherwise("23:00"))


def night_attribution(bars: DataFrame) -> DataFrame:
    evening = F.hour("ts") >= 21
    friday = F.dayofweek("ts") == 6
    return bars.groupBy("symbol").agg(F.count_if(evening & (F.col("trading_date") <= F.to_date("ts"))).alias("not_forward"), F.count_if(evening & friday & (F.dayofweek("trading_date") != 2)).alias("friday_not_monday"), F.count_if(F.dayofweek("trading_date").isin(1, 7)).alias("weekend"))


def night_by_gap(bars: DataFrame) -> DataFrame:
    """Whether a date has night bars, by how many days after the previous date it comes."""
    per = bars.groupBy("symbol", "trading_date").agg(F.bool_or(is_night("ts")).alias("has_night"), F.sum(F.when(is_night("ts"), F.col("volume"))).alias("night_volume"))
    gap = F.datediff("trading_date", F.lag("trading_date").over(_by_day()))
    bucket = F.when(gap == 1, "1").when(gap <= 3, "2-3").when(gap > 3, "4+").otherwise("first")
    return per.withColumn("gap", bucket).groupBy("symbol", "gap").agg(F.count("*").alias("dates"), F.count_if("has_night").alias("with_night"), F.count_if(F.col("night_volume") == 0).alias("night_without_volume"))


def fake_nights(bars: DataFrame, exchanges: DataFrame) -> DataFrame:
    """Nights without any volume by exchange (a dimension symbol, exchange), year and days since the date before."""
    per = bars.groupBy("symbol", "trading_date").agg(F.count_if(is_night("ts")).alias("night_bars"), F.sum(F.when(is_night("ts"), F.col("volume"))).alias("night_volume"))
    per = per.withColumn("gap", F.datediff("trading_date", F.lag("trading_date").over(_by_day()))).where("night_bars > 0").join(exchanges, "symbol", "left")
    return per.groupBy("exchange", F.year("trading_date").alias("year"), "gap").agg(F.count("*").alias("nights"), F.count_if(F.col("night_volume") == 0).alias("fake"))


def year_edges(bars: DataFrame) -> DataFrame:
    """The first date of each year: its bars against the symbol's median, and how many have no volume."""
    day = bars.groupBy("symbol", "trading_date").agg(F.count("*").alias("bars"), F.count_if(F.col("volume") == 0).alias("idle"))
    usual = day.groupBy("symbol").agg(F.median("bars").alias("usual"))
    w = Window.partitionBy("symbol", F.year("trading_date")).orderBy("trading_date")
    return day.withColumn("n", F.row_number().over(w)).where("n = 1").join(usual, "symbol").select("symbol", "trading_date", "bars", "idle", (F.col("bars") / F.col("usual")).alias("times_usual"))


def misdated_bars(bars: DataFrame) -> DataFrame:
    """Day bars of another calendar date than their trading date, and bars after midnight that do not follow a Friday night: how many, and how many without volume."""
    other = F.col("trading_date") != F.to_date("ts")
    day, early = ~is_night("ts") & other, (F.hour("ts") <= 2) & other & (F.dayofweek("ts") != 7)
    idle = F.col("volume") == 0
    return bars.groupBy("symbol").agg(F.count_if(day).alias("day_bars"), F.count_if(day & idle).alias("day_idle"), F.count_if(early).alias("early_bars"), F.count_if(early & idle).alias("early_idle"))


def fake_segments(bars: DataFrame) -> DataFrame:
    """(trading date, calendar date, night) stretches without any volume."""
    return bars.groupBy("symbol", "trading_date", F.to_date("ts").alias("calendar_date"), is_night("ts").alias("night")).agg(F.sum("volume").alias("volume"), F.count("*").alias("bars")).where("volume = 0").drop("volume")


def fake_survivors(bars: DataFrame, jump: float = 0.01) -> DataFrame:
    """Bars that jump to the price at which the next bar opens, in runs that hardly trade."""
    from tidebar.operators.sessions import with_dead

    df = with_dead(bars).withColumns({"r": F.col("close") / F.lag("close").over(by_time()) - 1, "next_open": F.lead("open").over(by_time())})
    return df.where((F.abs("r") >= jump) & F.col("dead") & (F.abs(F.try_divide("close", "next_open") - 1) < jump / 10)).select("symbol", "ts", "r", "run")


def tail_evidence(bars: DataFrame, night_minute: int, open_minute: int, close_minute: int) -> DataFrame:
    """How often a night's last bar closes at the next morning's open, or at the close of the day before."""
    m = F.hour("ts") * 60 + F.minute("ts")
    at = lambda k, x: F.max(F.when(m == k, F.col(x)))
    day = bars.groupBy("symbol", "trading_date").agg(at(night_minute, "close").alias("tail"), at(open_minute, "open").alias("morning"), at(close_minute, "close").alias("shut"))
    day = day.withColumn("shut_before", F.lag("shut").over(_by_day()))
    return day.groupBy("symbol").agg(F.count("tail").alias("nights"), F.count_if(F.col("tail") == F.col("morning")).alias("as_morning"), F.count_if(F.col("tail") == F.col("shut_before")).alias("as_close_before"))


def auction_presence(bars: DataFrame, minute: int, key: str = "symbol") -> DataFrame:
    """Per key (symbol, or another column such as exchange), year and whether a date has a night: the share of dates that have a bar at this minute of the day."""
    m = F.hour("ts") * 60 + F.minute("ts")
    day = bars.groupBy(*dict.fromkeys((key, "symbol")), "trading_date").agg(F.bool_or(is_night("ts")).alias("night"), F.bool_or(m == minute).alias("there"))
    return day.groupBy(key, F.year("trading_date").alias("year"), "night").agg(F.count("*").alias("dates"), F.avg(F.col("there").cast("int")).alias("share"))


def auction_shape(bars: DataFrame, minutes: Sequence[int], key: str = "symbol") -> DataFrame:
    """Per key (symbol, or another column such as exchange) and year, bars at these minutes of the day: how many are flat, their range over close, their median volume."""
    m = F.hour("ts") * 60 + F.minute("ts")
    return bars.where(m.isin(*minutes)).groupBy(key, F.year("ts").alias("year")).agg(F.count("*").alias("n"), F.avg(F.when(F.col("high") == F.col("low"), 1.0).otherwise(0.0)).alias("flat_rate"), F.avg((F.col("high") - F.col("low")) / F.col("close")).alias("range"), F.median("volume").alias("median_volume"))


def rolls(bars: DataFrame) -> DataFrame:
    """Bars at which the contract changes: jump and ratio of K in logs, whether at a date's edge, and the jump three ways."""
    before = {f"{x}_before": F.lag(x).over(by_time()) for x in ("contract", "close", "K")}
    df = bars.withColumns(before | {"at_edge": new_date()}).where(F.col("contract") != F.col("contract_before"))
    ways = X.log_jumps("open", "close_before", "K", "K_before")
    return df.withColumns({"gap": F.col("open") / F.col("close_before") - 1, "jump": F.log(F.col("open") / F.col("close_before")), "k_ratio": F.log(F.col("K") / F.col("K_before"))} | ways)


def roll_continuity(bars: DataFrame) -> DataFrame:
    """Median jump at rolls as it is, with K and over K; which is least, and K at either end."""
    m = rolls(bars).groupBy("symbol").agg(*(F.median(x).alias(x) for x in ("raw", "times_k", "over_k")), F.count("*").alias("rolls"))
    best = F.when((F.col("raw") <= F.col("times_k")) & (F.col("raw") <= F.col("over_k")), "raw").when(F.col("over_k") <= F.col("times_k"), "over_k").otherwise("times_k")
    ends = bars.groupBy("symbol").agg(F.min_by("K", "ts").alias("k_first"), F.max_by("K", "ts").alias("k_last"))
    return m.withColumn("best", best).join(ends, "symbol")


def k_changes(bars: DataFrame) -> DataFrame:
    """K changing inside a contract, contracts changing inside a date, and contracts that come back."""
    df = bars.withColumns({"c0": F.lag("contract").over(by_time()), "k0": F.lag("K").over(by_time()), "edge": new_date()})
    runs = df.where("c0 is null or contract <> c0").groupBy("symbol", "contract").agg(F.count("*").alias("runs"))
    back = runs.groupBy("symbol").agg(F.count_if(F.col("runs") > 1).alias("coming_back"))
    return df.groupBy("symbol").agg(F.count_if((F.col("contract") == F.col("c0")) & (F.col("K") != F.col("k0"))).alias("k_inside"), F.count_if((F.col("contract") != F.col("c0")) & ~F.col("edge")).alias("intraday")).join(back, "symbol")


def turnover_identity(bars: DataFrame, multipliers: Sequence[float] = (1, 5, 10, 20, 50, 100)) -> DataFrame:
    """Per symbol and year the implied multiplier, turnover over volume times close: its median, the nearest usual one, and how often the implied price lies in the bar."""
    df = bars.where("volume > 0 and close > 0").withColumns({"year": F.year("trading_date"), "implied": F.col("total_turnover") / F.col("volume") / F.col("close")})
    m = df.groupBy("symbol", "year").agg(F.median("implied").alias("implied")).withColumn("multiplier", X.snap("implied", multipliers))
    price = F.col("total_turnover") / F.col("volume") / F.col("multiplier")
    tol = 1e-9
    inside = df.drop("implied").join(m, ["symbol", "year"]).groupBy("symbol", "year", "implied", "multiplier").agg(F.avg(F.when((price >= F.col("low") * (1 - tol)) & (price <= F.col("high") * (1 + tol)), 1.0).otherwise(0.0)).alias("inside"))
    w = Window.partitionBy("symbol").orderBy("year")
    return inside.withColumn("changed", F.coalesce(F.col("multiplier") != F.lag("multiplier").over(w), F.lit(False)))


def cross_section_steps(daily: DataFrame, x: str = "volume", drop: float = 0.4) -> DataFrame:
    """Per date the median log change over symbols, and the share that fell by more than drop."""
    r = F.log(F.col(x) / F.lag(x).over(_by_day()))
    df = daily.where(F.col(x) > 0).withColumn("r", r).where("r is not null")
    return df.groupBy("trading_date").agg(F.count("*").alias("n"), F.median("r").alias("median_change"), F.avg(F.when(F.col("r") < F.log(F.lit(1 - drop)), 1.0).otherwise(0.0)).alias("share_dropping"))


def locked_days(daily: DataFrame) -> DataFrame:
    return daily.where("high = low").select("symbol", "trading_date", "close", "volume")


def large_moves(daily: DataFrame, th: float = 0.15) -> DataFrame:
    return daily.withColumn("r", F.col("close") / F.lag("close").over(_by_day()) - 1).where(F.abs("r") > th).select("symbol", "trading_date", "r")


def first_night(bars: DataFrame) -> DataFrame:
    """Per symbol the first trading date with night bars; NULL where there is none."""
    return bars.groupBy("symbol").agg(F.min(F.when(is_night("ts"), F.col("trading_date"))).alias("first_night"))


def night_by_week(bars: DataFrame) -> DataFrame:
    per = bars.groupBy("symbol", "trading_date").agg(F.max(is_night("ts").cast("double")).alias("night"))
    return per.groupBy("symbol", F.date_trunc("week", "trading_date").cast("date").alias("week")).agg(F.avg("night").alias("night_share"), F.count("*").alias("dates"))


def dead_or_cut(daily: DataFrame) -> DataFrame:
    """Last open interest over its median, and the volume of the last five dates over the median: cut off or dying."""
    w = Window.partitionBy("symbol").orderBy(F.desc("trading_date"))
    m = daily.groupBy("symbol").agg(F.median("volume").alias("mv"), F.median("oi_end").alias("mo"), F.max_by("oi_end", "trading_date").alias("oi_last"))
    last = daily.withColumn("n", F.row_number().over(w)).where("n <= 5").groupBy("symbol").agg(F.avg("volume").alias("v5"))
    return m.join(last, "symbol").select("symbol", F.try_divide("oi_last", "mo").alias("oi_ratio"), F.try_divide("v5", "mv").alias("volume_ratio"))


def thin_days(daily: DataFrame, lots: float = 100) -> DataFrame:
    return daily.groupBy("symbol").agg(F.count_if(F.col("volume") == 0).alias("zero_days"), F.count_if(F.col("volume") < lots).alias("thin_days"), F.max(F.when(F.col("volume") < lots, F.col("trading_date"))).alias("last_thin"))


def zero_prices(bars: DataFrame) -> DataFrame:
    df = bars.withColumns({"pattern": X.zero_pattern(), "close_before": F.lag("close").over(by_time()), "open_after": F.lead("open").over(by_time())})
    return df.where(F.col("pattern") != "").select("symbol", "ts", "pattern", "close_before", "open_after", "volume")


def stale_runs(bars: DataFrame) -> DataFrame:
    """Longest and 99th percentile run of bars without volume, and the longest contiguous run."""
    df = contiguous_runs(bars)
    edge = F.when((F.col("volume") == 0) == F.coalesce(F.lag("volume").over(by_time()) == 0, F.lit(False)), 0).otherwise(1)
    df = df.withColumn("e", edge).withColumn("z", F.sum("e").over(by_time().rowsBetween(Window.unboundedPreceding, 0)))
    idle = df.where("volume = 0").groupBy("symbol", "run", "z").agg(F.count("*").alias("n")).groupBy("symbol").agg(F.max("n").alias("longest_idle"), F.percentile("n", F.lit(0.99)).alias("p99_idle"))
    all_ = df.groupBy("symbol", "run").agg(F.count("*").alias("n"), F.count_if(F.col("volume") > 0).alias("t")).groupBy("symbol").agg(F.max("n").alias("longest_run"), (F.sum("t") / F.sum("n")).alias("traded_share"))
    return all_.join(idle, "symbol", "left")


def traded_share_quantiles(bars: DataFrame) -> DataFrame:
    day = bars.groupBy("symbol", "trading_date").agg(F.avg(F.when(F.col("volume") > 0, 1.0).otherwise(0.0)).alias("share"))
    return day.groupBy("symbol").agg(F.percentile("share", F.lit(0.1)).alias("p10"), F.percentile("share", F.lit(0.5)).alias("p50"), F.avg(F.when(F.col("share") == 0, 1.0).otherwise(0.0)).alias("dead_share"))


def zero_atr(bars: DataFrame, size: int = 1, n: int = 14) -> DataFrame:
    """Bars whose ATR is 0, on bars of size rows."""
    from tidebar.operators.indicators import with_atr

    df = bars.withColumn("_g", F.floor((F.row_number().over(by_time()) - 1) / size)).groupBy("symbol", "_g").agg(F.max("ts").alias("ts"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"))
    return with_atr(df, n).groupBy("symbol").agg(F.count("atr").alias("warm"), F.count_if(F.col("atr") == 0).alias("zero"), F.median("atr").alias("median_atr"))


def zero_atr_bias(raw: DataFrame, clean: DataFrame, sizes: Sequence[int] = (1, 5, 30), n: int = 14) -> DataFrame:
    """Per symbol and size of bucket (rows in order; a last one that is not full does not count) how many ATRs are 0 in raw and in clean bars, their share of clean buckets, and how far the raw median lies from the clean one."""
    from tidebar.operators.indicators import with_atr

    both = raw.select(F.struct("symbol", F.lit("raw").alias("side")).alias("symbol"), "ts", "high", "low", "close")
    both = both.unionByName(clean.select(F.struct("symbol", F.lit("clean").alias("side")).alias("symbol"), "ts", "high", "low", "close"))
    each = F.explode(F.array(*map(F.lit, sizes)))
    df = numbered(both, "_at").withColumn("size", each).withColumn("symbol", F.struct("symbol.symbol", "symbol.side", "size")).withColumn("_g", F.floor(F.col("_at") / F.col("size")))
    df = df.groupBy("symbol", "_g").agg(F.count("*").alias("rows"), F.max("ts").alias("ts"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close")).where("rows = symbol.size")
    df = in_blocks(df, lambda b: with_atr(b, n), n)
    side = lambda x: F.col("symbol.side") == x
    zero = lambda x: F.count_if(side(x) & (F.col("atr") == 0))
    median = lambda x: F.median(F.when(side(x), F.col("atr")))
    out = df.groupBy("symbol.symbol", "symbol.size").agg(zero("raw").alias("zero_raw"), zero("clean").alias("zero_clean"), (zero("clean") / F.greatest(F.count_if(side("clean")), F.lit(1))).alias("clean_share"), median("raw").alias("median_raw"), median("clean").alias("median_clean"))
    return out.withColumn("bias", F.try_divide("median_raw", "median_clean") - 1).drop("median_raw", "median_clean")


def jumps(bars: DataFrame, th: float = 0.05) -> DataFrame:
    """Moves of more than th from one minute to the next, but for rolls."""
    df = bars.withColumns({"r": F.col("close") / F.lag("close").over(by_time()) - 1, "gap": gap_seconds(), "c0": F.lag("contract").over(by_time())})
    return df.where((F.abs("r") > th) & (F.col("gap") == 60) & (F.col("contract") == F.col("c0"))).select("symbol", "ts", "r")


def spikes(bars: DataFrame, th: float = 0.03, back: float = 0.5) -> DataFrame:
    """Moves of more than th of which the next bar takes back more than half."""
    df = bars.withColumn("r", F.col("close") / F.lag("close").over(by_time()) - 1).withColumn("next", F.lead("r").over(by_time()))
    return df.where((F.abs("r") > th) & (F.signum("r") == -F.signum("next")) & (F.abs("next") > back * F.abs("r"))).select("symbol", "ts", "r", F.col("next").alias("next_r"))


def k_deviation(bars: DataFrame) -> DataFrame:
    w = by_time()
    df = bars.withColumn("e", F.when(F.col("K") == F.lag("K").over(w), 0).otherwise(1))
    return df.groupBy("symbol").agg(F.greatest(F.abs(1 / F.min("K") - 1), F.abs(1 / F.max("K") - 1)).alias("deviation"), F.min_by("K", "ts").alias("k_first"), F.max_by("K", "ts").alias("k_last"), F.sum("e").alias("k_runs"))


def usable_from_forward(daily: DataFrame, share: float = 0.1, window: int = 250, least: int = 60) -> DataFrame:
    """First date from which the median volume of the dates ahead is a share of the overall median."""
    w = _by_day().rowsBetween(0, window - 1)
    df = daily.withColumns({"ahead": F.expr(f"percentile(volume, 0.5) over (partition by symbol order by trading_date rows between current row and {window - 1} following)"), "n": F.count("volume").over(w)})
    whole = daily.groupBy("symbol").agg(F.median("volume").alias("whole"))
    return df.join(whole, "symbol").where((F.col("n") >= least) & (F.col("ahead") >= share * F.col("whole"))).groupBy("symbol").agg(F.min("trading_date").alias("usable_from"))


def last_padded_day(day_pads: DataFrame, limit: float = 0.5, window: int = 60, least: int = 30) -> DataFrame:
    """Last date on which the rolling median share of padding exceeds limit."""
    w = _by_day().rowsBetween(-(window - 1), 0)
    df = day_pads.withColumns({"m": F.expr(f"percentile(share, 0.5) over (partition by symbol order by trading_date rows between {window - 1} preceding and current row)"), "n": F.count("share").over(w)})
    return df.groupBy("symbol").agg(F.max(F.when((F.col("n") >= least) & (F.col("m") > limit), F.col("trading_date"))).alias("last_bad"))


def drop_rows_mask(bars: DataFrame, jump: float = 0.05) -> DataFrame:
    """bars with the reason a row would be dropped for, or NULL: a price that cannot be, a broken bar, an amount that cannot be, a calendar date of its symbol without any volume, a jump."""
    r = F.abs(F.col("close") / F.lag("close").over(by_time()) - 1)
    fake = F.sum("volume").over(Window.partitionBy("symbol", F.to_date("ts"))) == 0
    shape = (F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close"))
    price = (F.least("open", "high", "low", "close") <= 0) | F.col("close").isNull()
    return bars.withColumn("drop_reason", F.when(price, "price").when(shape, "shape").when(hard_error(), "amount").when(fake, "fake").when((r > jump) & (gap_seconds() == 60), "jump"))


def drop_counts(bars: DataFrame, jump: float = 0.05) -> DataFrame:
    """Per symbol how many rows would be dropped for each reason, and which share in all."""
    reasons = ("price", "shape", "amount", "fake", "jump")
    why = F.col("drop_reason")
    return drop_rows_mask(bars, jump).groupBy("symbol").agg(*(F.count_if(why == x).alias(f"drop_{x}") for x in reasons), F.avg(why.isNotNull().cast("int")).alias("drop_share"))


def verdict(score: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """score with the text of the rules it breaks, and keep where there is none."""
    df = score.withColumn("reasons", F.concat_ws("; ", *(F.when(rule, F.lit(name)) for name, rule in rules.items())))
    return df.withColumn("keep", F.col("reasons") == "")


def scorecard(tables: Sequence[DataFrame]) -> DataFrame:
    """Tables of one row for each symbol, side by side."""
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, "symbol", "left")
    return out


def single_day(bars: DataFrame, symbol: str, date: str) -> DataFrame:
    """One symbol's date, run by run, with what is wrong in it."""
    day = bars.where((F.col("symbol") == symbol) & (F.col("trading_date") == F.lit(date).cast("date")))
    return contiguous_runs(day).groupBy("symbol", "trading_date", "run").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("bars"), F.count_if(hard_error()).alias("errors"), F.sum("volume").alias("volume"))


def trade_invariants(legs: DataFrame, trades: DataFrame, bars: DataFrame) -> DataFrame:
    """How many rows break what must hold: fractions that add up to 1, exits not before entries, no overlap in a symbol, exits in the session of their entry, at most one stop or target-and-rest for each entry, and fills of targets that gain."""
    part = legs.groupBy("symbol", "entry_id").agg(F.sum("fraction").alias("f"), F.count("*").alias("n"), F.count_if(F.col("reason").isin("SL", "TP")).alias("firsts"), F.count_if((F.col("reason") == "TP") & (F.col("pnl") <= 0)).alias("losing_targets"))
    part = part.agg(F.count_if(F.abs(F.col("f") - 1) > 1e-9).alias("bad_fractions"), F.count_if((F.col("n") > 2) | (F.col("firsts") > 1)).alias("bad_legs"), F.coalesce(F.sum("losing_targets"), F.lit(0)).alias("losing_targets"))
    at = lambda name, session: bars.select("symbol", F.col("ts").alias(name), F.col("session_id").alias(session))
    away = legs.join(at("entry_ts", "_a"), ["symbol", "entry_ts"]).join(at("exit_ts", "_b"), ["symbol", "exit_ts"]).agg(F.count_if(F.col("_a") != F.col("_b")).alias("other_session"))
    w = Window.partitionBy("symbol").orderBy("entry_ts")
    t = trades.withColumn("until", F.lag("exit_ts").over(w)).agg(F.count_if(F.col("exit_ts") < F.col("entry_ts")).alias("exit_before_entry"), F.count_if(F.col("entry_ts") <= F.col("until")).alias("overlapping"))
    return part.crossJoin(t).crossJoin(away)  # three single rows
