"""Registered queries against DuckDB where an earlier round failed or differed."""

import math
import random
from collections import Counter
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from test_queries import SF, shown
from tidebar.functions import scalars as X
from tidebar.operators import stats as P
from tidebar.plans import queries


def same(spark, name, folder):
    """Whether a query and its SQL give the same rows on the tables of folder."""
    c = duckdb.connect()
    for t in ("events", "lineitem"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder if t == 'events' else SF}/{t}.parquet'")
    got, want = shown(queries.QUERIES[name](spark, str(folder)).toPandas()), shown(c.sql(queries.SQL[name]).df())
    number = lambda x: tuple(str(float(v)) if v.replace(".", "", 1).replace("-", "", 1).replace("e", "", 1).isdigit() else v for v in x)
    return got[1] == want[1] and sorted(map(number, got[0])) == sorted(map(number, want[0]))


@pytest.mark.parametrize("name", ["g11_cooldown", "j9_in_spans", "c5_shaded_bins"])
def test_cooling(spark, name):
    assert same(spark, name, SF)


@pytest.fixture(scope="module")
def fallen(tmp_path_factory):
    """The events of sf0.01 sixty times, at the same times: prices fall below zero, and a trade loses more than everything."""
    folder = tmp_path_factory.mktemp("fallen")
    duckdb.sql(f"COPY (SELECT * REPLACE (event_id + 10000 * k AS event_id) FROM '/root/testdata/sf0.01/events.parquet', range(60) t(k)) TO '{folder}/events.parquet' (FORMAT parquet)")
    return folder


@pytest.mark.parametrize("name", ["g5_mark_to_market", "c9_equity_steps", "w18_session_returns", "w19_sharpe", "a20_contribution", "a15_strategy_stats", "c7_statistics", "g16_report", "g16_portfolio", "g17_rebalance"])
def test_lost_more_than_everything(spark, fallen, name):
    assert same(spark, name, fallen)


@pytest.mark.parametrize("name", ["c5_shaded_bins", "j9_in_spans"])
def test_cooling_below_zero(spark, fallen, name):
    assert same(spark, name, fallen)


def missing(spark, name, folder):
    """How many values of each column are NULL and how many NaN, in a query and in its SQL (shown gives both as nothing)."""
    c = duckdb.connect()
    for t in ("events", "lineitem"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder if t == 'events' else SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, str(folder))
    columns = ", ".join(f'"{x}"' for x in df.columns)
    count = lambda rows: Counter((x, "NULL" if v is None else "NaN") for row in rows for x, v in zip(df.columns, row) if v is None or v != v)
    return count(df.collect()), count(c.sql(f"SELECT {columns} FROM ({queries.SQL[name]})").fetchall())


@pytest.fixture(scope="module")
def worthless(tmp_path_factory):
    """Twenty days of ten events, after some of which on the tenth day the price is exactly 0."""
    dice, rows, price = random.Random(1), [], 100000
    for day in range(20):
        steps = [dice.randint(-100, 100) for _ in range(10)]
        while day == 9 and price + sum(steps):
            steps.append(max(-100, min(100, -price - sum(steps))))
        price += sum(steps)
        rows += [(len(rows) + i, datetime(2024, 1, 1 + day, 10) + timedelta(seconds=10 * i), i % 7 + 1, (x + 100) / 100) for i, x in enumerate(steps)]
    folder = tmp_path_factory.mktemp("worthless")
    values = ", ".join(f"({i}, TIMESTAMP '{ts}', {user}, 'view', {value})" for i, ts, user, value in rows)
    duckdb.sql(f"COPY (SELECT event_id::BIGINT AS event_id, ts, user_id::BIGINT AS user_id, event_type, value::DOUBLE AS value FROM (VALUES {values}) t(event_id, ts, user_id, event_type, value)) TO '{folder}/events.parquet' (FORMAT parquet)")
    return folder


@pytest.mark.parametrize("name", ["g16_portfolio"])
def test_close_of_zero(spark, worthless, name):
    assert same(spark, name, worthless)
    got, want = missing(spark, name, worthless)
    assert got == want and want["ret", "NaN"]


@pytest.mark.parametrize("name", ["g16_portfolio", "a20_contribution", "c9_equity_steps", "w18_session_returns", "w19_sharpe"])
def test_no_growth_is_not_missing(spark, fallen, name):
    got, want = missing(spark, name, fallen)
    assert got == want and sum(want.values())


def test_log_growth_and_divided(spark):
    df = spark.createDataFrame([(0.0,), (-1.0,), (-1.5,), (None,)], "x double")
    got = [r[0] for r in df.select(X.log_growth("x")).collect()]
    assert got[:2] == [0.0, float("-inf")] and math.isnan(got[2]) and got[3] is None
    got = [r[0] for r in df.select(X.divided("x", F.lit(0.0))).collect()]
    assert math.isnan(got[0]) and got[1:] == [float("-inf"), float("-inf"), None]


@pytest.mark.parametrize("name", ["x_scalars"])
def test_prices_below_zero(spark, fallen, name):
    assert same(spark, name, fallen)


def test_compound(spark):
    for rets, want in (([0.5, -1.0, 0.5], [3.0, 0.0, 0.0]), ([0.5, -1.5, 0.5], [3.0, None, None]), ([-1.0, -1.5], [0.0, None])):
        df = P.compound(spark.createDataFrame(list(enumerate(rets)), "trading_date int, ret double"), 2.0)
        got = [r["equity"] for r in df.orderBy("trading_date").collect()]
        assert [None if math.isnan(x) else round(x, 9) for x in got] == want


def test_text_of_what_is_not_finite(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (None,), (0.5,)], "x double")
    got = [tuple(r) for r in df.select(X.percent("x"), X.ratio("x")).collect()]
    assert got == [("+nan%", "nan"), ("+inf%", "inf"), ("-inf%", "-inf"), ("n/a", "n/a"), ("+50.00%", "0.50")]
