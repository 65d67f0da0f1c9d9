"""Sources and sinks of bar tables. A minute bar is stamped at its end; NULL, never NaN, is missing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAR_SCHEMA = T.StructType([
    T.StructField("symbol", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("trading_date", T.DateType()),
    *(T.StructField(x, T.DoubleType()) for x in ("open", "high", "low", "close", "volume", "total_turnover", "open_interest")),
    T.StructField("contract", T.StringType()), T.StructField("K", T.DoubleType()),
])
CSV_SCHEMA = "timestamp timestamp, symbol string, sector string, open double, high double, low double, close double, volume double"
PRICES = ("open", "high", "low", "close")


def load_bars(bars: DataFrame, symbols: Sequence[str] | None = None, start: str | None = None, end: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Bars of symbols from start to the whole end day; filters and columns reach the scan (and, on symbol, its partitions)."""
    if symbols is not None:
        bars = bars.where(F.col("symbol").isin(*symbols))
    if start is not None:
        bars = bars.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end is not None:
        bars = bars.where(F.col("ts") <= F.lit(end).cast("timestamp") + F.expr("INTERVAL 1 DAY"))
    return bars.select(*columns) if columns else bars


def read_bars_csv(spark: SparkSession, path: str) -> DataFrame:
    """Five-minute bars with a header; timestamps are bar opens in UTC."""
    return spark.read.schema(CSV_SCHEMA).csv(path, header=True)


def hard_error() -> Column:
    """A missing or non-positive price, a negative amount, or volume without turnover (or the reverse)."""
    bad = F.lit(False)
    for x in PRICES:
        bad = bad | F.coalesce(F.isnan(x) | (F.col(x) <= 0), F.lit(True))
    for x in ("volume", "total_turnover", "open_interest"):
        bad = bad | F.coalesce(F.col(x) < 0, F.lit(False))
    return bad | ((F.coalesce("volume", F.lit(0.0)) == 0) != (F.coalesce("total_turnover", F.lit(0.0)) == 0))


def is_night(ts: Column | str = "bar_start") -> Column:
    """From 21:00 to 02:59."""
    return (F.hour(ts) >= 21) | (F.hour(ts) <= 2)


def fake_session() -> Column:
    """Whether a bar's (symbol, trading date, calendar date, night) has no volume at all."""
    from pyspark.sql import Window

    w = Window.partitionBy("symbol", "trading_date", F.to_date("ts"), is_night("ts"))
    return F.sum(F.coalesce("volume", F.lit(0.0))).over(w) == 0


def clean_bars(raw: DataFrame, pool: Sequence[str] | None = None, usable_from: dict[str, str] | None = None) -> DataFrame:
    """Bars of the pool without hard errors and fake sessions, each symbol from its usable date."""
    bars = raw if pool is None else raw.where(F.col("symbol").isin(*pool))
    bars = bars.withColumn("fake", fake_session()).where(~F.col("fake") & ~hard_error()).drop("fake")
    return trim_usable_from(bars, usable_from) if usable_from else bars


def trim_usable_from(bars: DataFrame, cuts: dict[str, str]) -> DataFrame:
    """Only rows from each symbol's date in cuts; other symbols are kept whole."""
    pairs = [F.lit(x) for kv in cuts.items() for x in kv]
    cut = F.element_at(F.create_map(*pairs), F.col("symbol")).cast("date")
    return bars.where(cut.isNull() | (F.col("trading_date") >= cut))


def ingest_bars(raw: DataFrame, path: str, **options) -> None:
    """Cleans and writes one partition for each symbol; rows of a symbol are sorted by time, so that time filters skip row groups."""
    clean = clean_bars(raw, **options)
    clean.repartition("symbol", F.year("trading_date")).sortWithinPartitions("symbol", "ts").write.partitionBy("symbol").option("compression", "zstd").parquet(path)


def manifest(bars: DataFrame, cuts: dict[str, str] | None = None) -> DataFrame:
    """One row for each symbol: bars, first and last time, sessions, megabytes of its values (widths of their types, text by its bytes), and whether it is trimmed at a usable date (cuts)."""
    mb = F.round(F.sum(_width(bars)) / 1e6, 3)
    trimmed = F.col("symbol").isin(*cuts) if cuts else F.lit(False)
    return bars.groupBy("symbol").agg(F.count("*").alias("bars"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.countDistinct("trading_date").alias("sessions"), mb.alias("mb")).withColumn("trimmed", trimmed)


def _width(df: DataFrame) -> Column:
    """Bytes of a row's values; missing ones have none."""
    widths = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "date": 4, "float": 4}
    one = lambda name, kind: F.octet_length(name) if kind == "string" else F.when(F.col(name).isNotNull(), widths.get(kind, 8))
    return sum((F.coalesce(one(f"`{name}`", kind), F.lit(0)) for name, kind in df.dtypes), F.lit(0)).cast("long")


def write_report(df: DataFrame, path: str, kind: str = "csv") -> None:
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.parquet(path)


def load_trading_hours(hours: DataFrame, contracts: DataFrame, code: str, start: str, end: str) -> DataFrame:
    """Session hours of a contract between two dates; the tables come from spark.read.jdbc or anywhere else."""
    both = hours.join(contracts.select("ContractInnerCode", "ContractCode"), "ContractInnerCode")
    return both.where((F.col("ContractCode") == code) & F.col("TradingDate").between(start, end)).orderBy("TradingDate", "StartTime")


def read_trading_hours(spark: SparkSession, url: str, code: str, start: str, end: str, hours: str = "TradingHours", contracts: str = "ContractMaster", partitions: int = 8, **options: str) -> DataFrame:
    """load_trading_hours on two tables of a database. The code, the dates and the columns go into the database's own queries,
    and hours are read in stretches of dates, each by its own task and connection; options (driver, user, fetchsize) go to the JDBC source."""
    source = lambda table: spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    stretches = source(hours).options(partitionColumn="TradingDate", lowerBound=start, upperBound=end, numPartitions=str(partitions))
    return load_trading_hours(stretches.load(), source(contracts).load(), code, start, end)


def list_tables(spark: SparkSession, pattern: str) -> DataFrame:
    """Tables of the current database whose name is like pattern, with row counts (one count query for each)."""
    rows = [(t.name, spark.table(t.name).count()) for t in spark.catalog.listTables() if _like(t.name, pattern)]
    return spark.createDataFrame(rows, "name string, rows long")


def describe(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([(x.name, x.dataType, x.nullable) for x in spark.catalog.listColumns(table)], "name string, type string, nullable boolean")


def _like(name: str, pattern: str) -> bool:
    import fnmatch

    return fnmatch.fnmatchcase(name.lower(), pattern.lower().replace("%", "*").replace("_", "?"))


def fix_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Repairs text whose GB18030 bytes were read as Latin-1; text with any character beyond U+00FF is left as it is."""
    out = {}
    for x in columns:
        narrow = ~F.col(x).rlike("[^\\x00-\\xFF]")
        out[x] = F.when(narrow, F.decode(F.encode(F.when(narrow, F.col(x)), "ISO-8859-1"), "GB18030")).otherwise(F.col(x))
    return df.withColumns(out)
