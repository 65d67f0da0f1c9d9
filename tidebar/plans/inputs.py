"""Bars derived from the events table.

Every event is a tick of its type and of the symbol ALL; prices walk in whole hundredths, so that both engines agree exactly.
The SQL for comparison walks over a symbol at once. Spark sums each day first and walks inside days, since ALL holds half of all ticks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidebar.sources.scratch import prepared

_TICKS = """
ev AS (SELECT event_id, ts, user_id, event_type, CAST(round(value * 100) AS BIGINT) % 201 - 100 AS d FROM {events}
  WHERE hour(ts) >= 21 OR hour(ts) <= 2 OR (hour(ts) >= 9 AND hour(ts) <= 14)),
ticks AS (SELECT event_id, ts, user_id, d, event_type AS symbol FROM ev UNION ALL SELECT event_id, ts, user_id, d, 'ALL' AS symbol FROM ev),
"""
_WALK = """walk AS (SELECT *, 100000 + sum(d) OVER (PARTITION BY symbol ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS px FROM ticks),
opened AS (SELECT *, coalesce(lag(px) OVER (PARTITION BY symbol ORDER BY ts, event_id), 100000) AS op, date_trunc('minute', ts) AS bar_start FROM walk),
"""
#: The same walk by days: a day starts at the sum of the days before it, and a tick opens where the one before it ended.
_WALK_BY_DAY = """dated AS (SELECT *, CAST(ts AS DATE) AS day FROM ticks),
totals AS (SELECT symbol, day, sum(d) AS d FROM dated GROUP BY symbol, day),
starts AS (SELECT symbol, day, 100000 + coalesce(sum(d) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM totals),
steps AS (SELECT *, coalesce(sum(d) OVER (PARTITION BY symbol, day ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0) AS step FROM dated),
opened AS (SELECT symbol, event_id, ts, user_id, start + step AS px, start + step - coalesce(d, 0) AS op, date_trunc('minute', ts) AS bar_start FROM steps JOIN starts USING (symbol, day)),
"""
_MINUTES = """mins AS (SELECT symbol, bar_start, min_by(op, event_id) AS o, max(greatest(op, px) + user_id % 17) AS h, min(least(op, px) - event_id % 17) AS l, max_by(px, event_id) AS c, sum(user_id) AS v
  FROM opened GROUP BY symbol, bar_start),
bars AS (SELECT symbol, bar_start, bar_start + INTERVAL 1 MINUTE AS ts, CAST(bar_start + INTERVAL 3 HOUR AS DATE) AS trading_date,
  CAST(o AS DOUBLE) / 100 AS open, CAST(h AS DOUBLE) / 100 AS high, CAST(l AS DOUBLE) / 100 AS low, CAST(c AS DOUBLE) / 100 AS close, CAST(v AS DOUBLE) AS volume,
  CAST(v AS DOUBLE) * CAST(c AS DOUBLE) / 10 AS total_turnover, CAST(1000 + v AS DOUBLE) AS open_interest,
  concat(symbol, CAST(month(bar_start) AS VARCHAR(9)), CAST(CAST(floor(day(bar_start) / CAST(10 AS DOUBLE)) AS INT) AS VARCHAR(9))) AS contract,
  1 + floor(day(bar_start) / CAST(10 AS DOUBLE)) / CAST(100 AS DOUBLE) AS K
  FROM mins)
"""

BARS_CTE = _TICKS + _WALK + _MINUTES
_SPARK_CTE = (_TICKS + _WALK_BY_DAY + _MINUTES).replace("VARCHAR(9)", "STRING")

#: Bars with faults of every kind, by rules on their volume.
DIRTY_CTE = """
dirty AS (SELECT symbol, bar_start, ts, trading_date, CASE WHEN CAST(volume AS BIGINT) % 97 = 5 THEN 0 ELSE open END AS open,
  CASE WHEN CAST(volume AS BIGINT) % 89 = 3 THEN low - 1 ELSE high END AS high, low, CASE WHEN CAST(volume AS BIGINT) % 53 = 1 THEN close * 1.1 ELSE close END AS close,
  CASE WHEN CAST(volume AS BIGINT) % 11 = 2 THEN 0 WHEN CAST(volume AS BIGINT) % 101 = 7 THEN -volume ELSE volume END AS volume,
  CASE WHEN CAST(volume AS BIGINT) % 22 = 2 THEN 0 ELSE total_turnover END AS total_turnover, open_interest, contract, K FROM bars)
"""


def bars_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars, derived once in an application and read from then on as a table partitioned by symbol."""
    derive = lambda: spark.sql("WITH " + _SPARK_CTE + " SELECT * FROM bars", events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    return prepared(spark, "bars", sf_dir, derive, "symbol")


def dirty_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "WITH " + DIRTY_CTE.replace(" 1.1 ", " CAST(1.1 AS DOUBLE) ").replace("THEN 0 ", "THEN CAST(0 AS DOUBLE) ").replace("FROM bars", "FROM {bars}") + " SELECT * FROM dirty"
    return spark.sql(text.replace("close * 1.1", "close * CAST(1.1 AS DOUBLE)"), bars=bars_from_events(spark, sf_dir))


def order_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily activity from line items: symbol is the return flag and line status, a date its ship date."""
    text = """SELECT concat(l_returnflag, l_linestatus) AS symbol, CAST(l_shipdate AS DATE) AS trading_date, sum(l_quantity) AS volume, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS turnover,
      CAST(max(l_quantity) AS DOUBLE) AS oi_end, count(*) AS bars, CAST(max(l_partkey) AS DOUBLE) AS close FROM {lineitem} GROUP BY 1, 2"""
    return spark.sql(text, lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


DAYS_CTE = """
days AS (SELECT concat(l_returnflag, l_linestatus) AS symbol, CAST(l_shipdate AS DATE) AS trading_date, sum(l_quantity) AS volume, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS turnover,
  CAST(max(l_quantity) AS DOUBLE) AS oi_end, count(*) AS bars, CAST(max(l_partkey) AS DOUBLE) AS close FROM lineitem GROUP BY 1, 2)
"""


def with_bars(sql: str, dirty: bool = False) -> str:
    """DuckDB SQL that begins with the bars."""
    return "WITH " + BARS_CTE.format(events="events") + ("," + DIRTY_CTE if dirty else "") + sql


def with_days(sql: str) -> str:
    return "WITH " + DAYS_CTE + sql
