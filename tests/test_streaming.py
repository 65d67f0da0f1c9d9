import datetime as dt
import random

import pytest

from tidebar.streaming import bars as L

T0 = dt.datetime(2024, 1, 2, 9)


def run(spark, tmp_path, rows, schema, build, mode="append", conf=None):
    """The rows as files of a stream, one batch each, through to a table in memory."""
    path = str(tmp_path / "in")
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    df = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path))
    name = "t" + str(abs(hash(str(tmp_path))))
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name).collect()


def test_tick_bars(spark, tmp_path):
    ticks = [[("A", T0 + dt.timedelta(seconds=20 * k), 100.0 + k, 1.0) for k in range(9)], [("A", T0 + dt.timedelta(minutes=30), 1.0, 1.0)]]
    got = sorted(run(spark, tmp_path, ticks, "symbol string, ts timestamp, price double, volume double", L.tick_bars), key=lambda r: r["ts"])
    assert [(r["open"], r["high"], r["low"], r["close"], r["volume"]) for r in got] == [(100, 102, 100, 102, 3), (103, 105, 103, 105, 3), (106, 108, 106, 108, 3)]


def test_forming_bars_come_in_update_mode(spark, tmp_path):
    tick = lambda s, price: ("A", T0 + dt.timedelta(seconds=s), price, 1.0)
    got = run(spark, tmp_path, [[tick(5, 10.0), tick(20, 12.0)], [tick(40, 9.0)]], "symbol string, ts timestamp, price double, volume double", L.tick_bars, "update")
    assert sorted((r["ticks"], r["open"], r["high"], r["low"], r["close"]) for r in got) == [(2, 10, 12, 10, 12), (3, 10, 12, 9, 9)]


def test_gap_sessions_and_duplicates(spark, tmp_path):
    day = T0.date()
    bar = lambda h: ("A", T0 + dt.timedelta(hours=h), day, 2.0, 1.0)
    schema = "symbol string, ts timestamp, trading_date date, high double, low double"
    got = run(spark, tmp_path / "a", [[bar(0), bar(1), bar(5)], [bar(24)]], schema, L.gap_sessions)
    assert sorted(r["bars"] for r in got) == [1, 2]
    assert len(run(spark, tmp_path / "b", [[bar(0), bar(0)], [bar(0), bar(1)]], schema, L.unique_bars)) == 2


@pytest.fixture
def rocks(spark):
    pytest.importorskip("google.protobuf", reason="stateful pandas processors need it")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def minute(k):
    return T0 + dt.timedelta(minutes=k)


def test_live_indicators_of_shuffled_batches_are_those_of_the_ordered_series(spark, tmp_path, rocks):
    bars = [("A", minute(k), 5.0 + k % 7, 3.0, 4.0 + k % 3) for k in range(40)]
    mixed = bars[:]
    random.Random(5).shuffle(mixed)
    late = [("A", minute(3), 99.0, 1.0, 50.0), ("A", minute(1001), None, 1.0, 2.0)]  # beyond the watermark; without a high
    batches = [mixed[:15], mixed[15:28], mixed[28:], [("B", minute(1000), 1.0, 1.0, 1.0)], [("B", minute(1002), 1.0, 1.0, 1.0)], late, [("B", minute(2000), 1.0, 1.0, 1.0)]]
    schema = "symbol string, ts timestamp, high double, low double, close double"
    got = run(spark, tmp_path, batches, schema, lambda s: L.live_indicators(s, "100 minutes"))
    got = sorted((r for r in got if r["symbol"] == "A"), key=lambda r: r["ts"])
    assert [r["ts"] for r in got] == [b[1] for b in bars]
    fast = slow = signal = None
    close, ranges = None, []
    for r, (_, _, h, l, c) in zip(got, bars):
        fast, slow = (c if e is None else e + (c - e) * 2 / (n + 1) for e, n in ((fast, 12), (slow, 26)))
        signal = fast - slow if signal is None else signal + (fast - slow - signal) * 2 / 10
        ranges.append(h - l if close is None else max(h - l, abs(h - close), abs(l - close)))
        close = c
        assert abs(r["macd"] - (fast - slow)) < 1e-9 and abs(r["signal"] - signal) < 1e-9
        assert r["atr"] is None if len(ranges) < 14 else abs(r["atr"] - sum(ranges[-14:]) / 14) < 1e-9


def test_live_indicators_of_a_symbol_that_was_away_begin_anew(spark, tmp_path, rocks):
    batches = [[("A", minute(0), 9.0, 1.0, 5.0), ("A", minute(1), 9.0, 1.0, 8.0)], [("B", minute(5000), 1.0, 1.0, 1.0)], [("A", minute(5001), 9.0, 1.0, 3.0)], [("B", minute(9000), 1.0, 1.0, 1.0)]]
    schema = "symbol string, ts timestamp, high double, low double, close double"
    got = run(spark, tmp_path, batches, schema, lambda s: L.live_indicators(s, keep_days=1))
    macd = {r["ts"]: r["macd"] for r in got if r["symbol"] == "A"}
    assert macd[minute(0)] == 0 and macd[minute(1)] != 0 and macd[minute(5001)] == 0


def test_live_reversals_and_sessions_ended_by_their_timer(spark, tmp_path, rocks):
    def bar(k, session, high, low, s_setup=110.0):
        return ("A", minute(k), session, 100.0 + k / 100, high, low, s_setup, 90.0, 105.0, 95.0)

    one = [bar(0, 1, 112.0, 108.0), bar(1, 1, 109.0, 104.0), bar(2, 1, 104.0, 103.0)]  # armed short at 0, low of 1 is under 105: at 2
    two = [bar(500, 2, 101.0, 99.0), bar(501, 2, 102.0, 99.0)]  # unarmed
    three = [bar(1000, 3, 112.0, 108.0), bar(1001, 3, 112.0, 108.0)]  # armed, no trigger
    four = [bar(1500, 4, 112.0, 80.0, None), bar(1501, 4, 100.0, 99.0, None)]  # armed long by its low alone; high of 1500 is over 95
    clock = lambda k: [("Z", minute(k), 9, 1.0, 1.0, 1.0, None, None, None, None)]
    schema = "symbol string, ts timestamp, session_id long, open double, high double, low double, Ssetup double, Bsetup double, Senter double, Benter double"
    batches = [[one[2], one[0]], [one[1], two[1]], [two[0]], clock(900), three[::-1], clock(1400), four, clock(3000)]
    got = run(spark, tmp_path, batches, schema, lambda s: L.live_reversals(s, "600 minutes"))
    got = sorted((r["session_id"], r["event"], r["side"], r["ts"], r["price"]) for r in got if r["symbol"] == "A")
    assert got == [(1, "reversal", -1, minute(2), 100.02), (2, "unarmed", 0, minute(501), None), (3, "armed", -1, minute(1001), None), (4, "reversal", 1, minute(1501), 115.01)]
