"""Data frames for charts and reports; drawing is left to others."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebar.functions import scalars as X


def step_points(bars: DataFrame, line: str) -> DataFrame:
    """A line's value at the first bar of each session (hidden where not valid, then shown at the next known value, or the last one), and the last bar as end."""
    first = bars.where("is_session_first").select("symbol", "ts", F.when(F.col("valid"), F.col(line)).alias("value"), (~F.col("valid")).alias("hidden"))
    w = Window.partitionBy("symbol").orderBy("ts")
    after = F.first("value", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    before = F.last("value", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    points = first.withColumn("value", F.coalesce(after, before))
    end = bars.groupBy("symbol").agg(F.max("ts").alias("ts")).join(points.groupBy("symbol").agg(F.max_by("value", "ts").alias("value")), "symbol").withColumn("hidden", F.lit(True))
    return points.unionByName(end.select("symbol", "ts", "value", "hidden"))


def stop_points(path: DataFrame, trades: DataFrame) -> DataFrame:
    """Stops tested on each bar of a trade up to its exit; the last one of a trade is hidden."""
    t = trades.select("symbol", "session_id", "exit_ts")
    df = path.join(t, ["symbol", "session_id"]).where("ts <= exit_ts and stop is not null")
    return df.select("symbol", "session_id", "ts", "stop", (F.col("ts") == F.col("exit_ts")).alias("hidden"))


def markers(trades: DataFrame) -> DataFrame:
    """Entry and exit of each trade with text and a class of colour, in order of time. An exit by FLIP at whose time the symbol's next trade enters the other way is one marker with that entry."""
    w = Window.partitionBy("symbol").orderBy("entry_ts", "exit_ts")
    near = lambda f: f(F.struct("entry_ts", "exit_ts", "direction", "reason")).over(w)
    trades = trades.withColumns({"_last": near(F.lag), "_next": near(F.lead)})
    flips = lambda a, b: F.coalesce((a["reason"] == "FLIP") & (a["exit_ts"] == b["entry_ts"]) & (a["direction"] != b["direction"]), F.lit(False))
    this = F.struct("entry_ts", "exit_ts", "direction", "reason")
    trades = trades.withColumns({"_entered": flips(F.col("_last"), this), "_left": flips(this, F.col("_next"))})
    flip = trades.where("_left").select("symbol", F.col("exit_ts").alias("ts"), F.lit("flip").alias("kind"), F.concat(F.lit("FLIP "), F.initcap("_next.direction")).alias("text"), F.lit("flip").alias("colour"))
    entry = trades.where("not _entered").select("symbol", F.col("entry_ts").alias("ts"), F.lit("entry").alias("kind"), F.format_string("%s %.2f", F.upper("direction"), F.col("entry_price")).alias("text"), F.col("direction").alias("colour"))
    exit_ = trades.where("not _left").select("symbol", F.col("exit_ts").alias("ts"), F.lit("exit").alias("kind"), F.format_string("%s %.2f %s", F.col("reason"), F.col("exit_price"), X.percent("pnl")).alias("text"), F.when(F.col("pnl") > 0, "win").otherwise("loss").alias("colour"))
    return entry.unionByName(exit_).unionByName(flip).orderBy("symbol", "ts", "kind")


def tiles(bars: DataFrame, start: str) -> DataFrame:
    """Rows from a start time on; indicators were computed over all of them."""
    return bars.where(F.col("ts") >= F.lit(start).cast("timestamp"))


def shaded_bins(flagged: DataFrame, bins: DataFrame) -> DataFrame:
    """Bins (symbol, segment_id, bin) with whether any member cools down."""
    return bins.join(flagged.select("symbol", "ts", "cooling"), ["symbol", "ts"]).groupBy("symbol", "segment_id", "bin").agg(F.max("ts").alias("ts"), F.bool_or("cooling").alias("shaded"))


def equity_steps(equity: DataFrame) -> DataFrame:
    """Change of equity at each bar with its sign; the first one is 0."""
    w = Window.partitionBy("symbol").orderBy("ts")
    change = F.coalesce(F.col("equity") - F.lag("equity").over(w), F.lit(0.0))
    return equity.withColumn("change", change).withColumn("colour", F.when(F.col("change") > 0, "up").when(F.col("change") < 0, "down").otherwise("flat"))


def weights_by_date(weights: DataFrame) -> DataFrame:
    """Every symbol's weight on every date, 0 where it has none."""
    grid = weights.select("trading_date").distinct().crossJoin(F.broadcast(weights.select("symbol").distinct()))  # the size of the result
    return grid.join(weights, ["trading_date", "symbol"], "left").fillna(0.0, ["weight"])


def statistics_page(stats: DataFrame, percents: list[str], ratios: list[str]) -> DataFrame:
    """Statistics as text, one row for each symbol and item; missing ones are n/a."""
    items = [F.struct(F.lit(x).alias("item"), X.percent(x).alias("value")) for x in percents] + [F.struct(F.lit(x).alias("item"), X.ratio(x).alias("value")) for x in ratios]
    return stats.select("symbol", F.explode(F.array(*items)).alias("i")).select("symbol", "i.item", "i.value")
