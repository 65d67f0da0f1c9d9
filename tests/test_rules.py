"""Strategies told as rules against the operators that they stand for."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.test_bars import lined, make_bars
from tidebar.operators import indicators, rules, signals


def test_breakout_by_rules_is_the_breakout_operator(spark):
    df = lined(make_bars(spark, days=7, seed=3))
    one = lambda r: (r["symbol"], r["session_id"], r["direction"], r["entry_ts"], r["entry_price"], r["exit_ts"], round(r["exit_price"], 9), r["reason"], round(r["pnl"], 12))
    want = sorted(map(one, signals.breakout_trades(df).collect()))
    assert sorted(map(one, rules.trades(df, rules.breakout()).collect())) == want and {x[7] for x in want} == {"TRAIL", "SESSION_END"}
    far = sorted(map(one, signals.breakout_trades(df, d=4.0).collect()))
    assert sorted(map(one, rules.trades(df, rules.breakout(4.0)).collect())) == far != want


def test_macd_by_rules_has_the_exits_of_the_macd_operator(spark):
    df = indicators.macd_cross(indicators.with_macd(indicators.with_atr(make_bars(spark, days=6, per=60, seed=8), 14)))
    w = Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    runs = df.withColumn("run", F.sum((F.col("cross") != 0).cast("int")).over(w)).where("run > 0")
    by_rules = {(r["symbol"], r["entry_ts"]): (r["direction"], r["exit_ts"], r["exit_price"], r["reason"]) for r in rules.trades(runs, rules.macd(), "run").collect()}
    taken = [r for r in signals.macd_trades(df).collect() if r["reason"] != "FLIP"]
    assert taken and all(by_rules[r["symbol"], r["entry_ts"]] == (r["direction"], r["exit_ts"], r["exit_price"], r["reason"]) for r in taken)


def test_weights_by_a_sizing_rule(spark):
    rows = spark.createDataFrame([("A", 1, 0.5), ("B", 1, 0.25), ("C", 1, 0.0), ("A", 2, None), ("B", 2, 0.1)], "symbol string, trading_date int, vol double")
    got = {(r["symbol"], r["trading_date"]): round(r["weight"], 9) for r in rules.weights(rows, lambda df: F.when(df["vol"] > 0, 1 / df["vol"])).collect()}
    assert got == {("A", 1): round(1 / 3, 9), ("B", 1): round(2 / 3, 9), ("B", 2): 1.0}
