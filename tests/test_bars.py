"""Operators on hand-made bars, against plain Python where a rule needs state, and no lookahead: garbled later bars change nothing earlier."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidebar.functions import scalars as X
from tidebar.operators import audit as Q
from tidebar.operators import frames as C
from tidebar.operators import indicators as N
from tidebar.operators import sessions as S
from tidebar.operators import signals as G
from tidebar.operators import stats as P
from tidebar.operators import timeframes as TF
from tidebar.sources import bars as B


def make_bars(spark, days=6, per=40, seed=1, symbols=("A", "B")):
    """A night and a day segment for each trading date, prices in a random walk."""
    rng, rows = random.Random(seed), []
    for symbol in symbols:
        price = 1000
        for k in range(days):
            date = dt.date(2024, 1, 2) + dt.timedelta(days=k)
            for start in (dt.datetime.combine(date - dt.timedelta(days=1), dt.time(21)), dt.datetime.combine(date, dt.time(9))):
                for m in range(per):
                    o = price
                    price += rng.randint(-12, 12)
                    h, l = max(o, price) + rng.randint(0, 6), min(o, price) - rng.randint(0, 6)
                    rows.append((symbol, start + dt.timedelta(minutes=m + 1), start + dt.timedelta(minutes=m), date, o / 10, h / 10, l / 10, price / 10, float(rng.randint(0, 50)), 1.0))
    return spark.createDataFrame(rows, "symbol string, ts timestamp, bar_start timestamp, trading_date date, open double, high double, low double, close double, volume double, K double")


@pytest.fixture(scope="module")
def bars(spark):
    return make_bars(spark).cache()


def lined(bars, mode="split"):
    return S.attach_lines(S.session_mode(bars, mode), S.prev_day_lines(S.daily_ohlc(bars), 30))


def walk_breakout(rows, d=2.0):
    """Bar by bar, one trade in a session."""
    out, by = [], {}
    for r in rows:
        by.setdefault((r["symbol"], r["session_id"]), []).append(r)
    for key, session in by.items():
        side = None
        for i, b in enumerate(session):
            if side:
                stop = b["Senter"] + (best - b["Ssetup"]) / d if side == 1 else b["Benter"] - (b["Bsetup"] - best) / d
                hit = b["low"] <= stop if side == 1 else b["high"] >= stop
                if hit or b["is_session_last"]:
                    px = (min(stop, b["open"]) if side == 1 else max(stop, b["open"])) if hit else b["close"]
                    out.append((*key, side, entry, b["ts"], round(px, 6), "TRAIL" if hit else "SESSION_END"))
                    break
                best = max(best, b["high"]) if side == 1 else min(best, b["low"])
            elif b["valid"] and b["tradable"] and not b["is_session_first"] and not b["is_session_last"]:
                before = session[i - 1]
                side = 1 if before["high"] > b["Bbreak"] else -1 if before["low"] < b["Sbreak"] else None
                if side:
                    entry, best = b["ts"], max(b["Bbreak"], b["high"]) if side == 1 else min(b["Sbreak"], b["low"])
    return sorted(out)


@pytest.mark.parametrize("mode", ["split", "night_day", "day_night", "night"])
def test_breakout_trades_bar_by_bar(bars, mode):
    df = lined(bars, mode)
    got = sorted((r["symbol"], r["session_id"], 1 if r["direction"] == "long" else -1, r["entry_ts"], r["exit_ts"], round(r["exit_price"], 6), r["reason"]) for r in G.breakout_trades(df).collect())
    assert got and got == walk_breakout(df.orderBy("symbol", "ts").collect())


def walk_many(rows, d=2.0):
    out, by = [], {}
    for r in rows:
        by.setdefault((r["symbol"], r["session_id"]), []).append(r)
    for key, session in by.items():
        side = None
        for i, b in enumerate(session):
            if side:
                stop = b["Senter"] + (best - b["Ssetup"]) / d if side == 1 else b["Benter"] - (b["Bsetup"] - best) / d
                hit = b["low"] <= stop if side == 1 else b["high"] >= stop
                if hit or b["is_session_last"]:
                    out.append((*key, side, entry, b["ts"]))
                    side = None
                    continue
                best = max(best, b["high"]) if side == 1 else min(best, b["low"])
            elif b["valid"] and not b["is_session_first"] and not b["is_session_last"]:
                before = session[i - 1]
                side = 1 if before["high"] > b["Bbreak"] else -1 if before["low"] < b["Sbreak"] else None
                if side:
                    entry, best = b["ts"], max(b["Bbreak"], b["high"]) if side == 1 else min(b["Sbreak"], b["low"])
    return sorted(out)


def test_reentry_bar_by_bar(bars):
    df = lined(bars)
    got = sorted((r["symbol"], r["session_id"], 1 if r["direction"] == "long" else -1, r["entry_ts"], r["exit_ts"]) for r in G.reentry_trades(df).collect())
    want = walk_many(df.orderBy("symbol", "ts").collect())
    assert got == want and len(want) > len(walk_breakout(df.orderBy("symbol", "ts").collect()))


def test_macd_trades_bar_by_bar(spark):
    df = N.macd_cross(N.with_macd(N.with_atr(make_bars(spark, days=8, seed=9), 14))).select("symbol", "ts", "close", "atr", "cross").cache()
    want, state = [], {}
    for b in df.orderBy("symbol", "ts").collect():
        s = state.setdefault(b["symbol"], {"i": 0, "open": None, "free": 0})
        s["i"] += 1
        i, t = s["i"], s["open"]
        if t:
            move = (b["close"] - t["price"]) * t["side"]
            why = None if i - t["i"] < 2 else "TP" if move >= 2 * t["atr"] else "SL" if move <= -t["atr"] else None
            why = why if not b["cross"] else "FLIP"
            if why:
                want.append((b["symbol"], t["ts"], b["ts"], why))
                s["open"], s["free"] = None, i if why == "FLIP" else i + 5 + 1
        if not s["open"] and b["cross"] and i >= s["free"] and b["atr"] is not None:
            s["open"] = {"i": i, "side": b["cross"], "price": b["close"], "atr": b["atr"], "ts": b["ts"]}
    got = [(r["symbol"], r["entry_ts"], r["exit_ts"], r["reason"]) for r in G.macd_trades(df).collect()]
    assert want and sorted(got) == sorted(want)


def walk_reversal(rows, d=2.0):
    out, by = [], {}
    for r in rows:
        by.setdefault((r["symbol"], r["session_id"]), []).append(r)
    for key, session in by.items():
        high = low = side = None
        was_s = was_l = False
        armed = 0
        for i, b in enumerate(session):
            if side:
                stop = b["Sbreak"] + (b["Bsetup"] - b["Sbreak"] + ext) / d if side == 1 else b["Bbreak"] - (b["Bbreak"] - b["Ssetup"] + ext) / d
                hit = b["low"] <= stop if side == 1 else b["high"] >= stop
                if hit or b["is_session_last"]:
                    px = (min(stop, b["open"]) if side == 1 else max(stop, b["open"])) if hit else b["close"]
                    out.append((*key, side, entry, b["ts"], round(px, 6)))
                    break
                ext = max(ext, b["high"] - b["Benter"] if side == 1 else b["Senter"] - b["low"])
            elif b["valid"]:
                s, l = high is not None and high >= b["Ssetup"], low is not None and low <= b["Bsetup"]
                new_s, new_l = s and not was_s, l and not was_l
                was_s, was_l = was_s or s, was_l or l
                armed = 0 if new_s and new_l else -1 if new_s else 1 if new_l else armed
                if b["tradable"] and not b["is_session_first"] and not b["is_session_last"]:
                    before = session[i - 1]
                    side = -1 if armed == -1 and before["low"] < b["Senter"] else 1 if armed == 1 and before["high"] > b["Benter"] else None
                    if side:
                        entry, ext = b["ts"], max(0.0, b["high"] - b["Benter"] if side == 1 else b["Senter"] - b["low"])
            high, low = b["high"] if high is None else max(high, b["high"]), b["low"] if low is None else min(low, b["low"])
    return sorted(out)


def test_reversal_trades_bar_by_bar(spark):
    df = lined(make_bars(spark, days=12, seed=4))
    got = sorted((r["symbol"], r["session_id"], 1 if r["direction"] == "long" else -1, r["entry_ts"], r["exit_ts"], round(r["exit_price"], 6)) for r in G.reversal_trades(df).collect())
    assert got and got == walk_reversal(df.orderBy("symbol", "ts").collect())


def test_no_lookahead(spark, bars):
    cut = dt.datetime(2024, 1, 5, 12)
    late = F.col("ts") > F.lit(cut)
    garbled = bars.withColumns({x: F.when(late, F.col(x) * 3).otherwise(F.col(x)) for x in ("open", "high", "low", "close")})
    for run in (G.breakout_trades, G.reversal_trades):
        a, b = (sorted(map(tuple, run(lined(x)).where(F.col("exit_ts") < F.lit(cut)).collect())) for x in (bars, garbled))
        assert a == b
    a, b = (sorted(map(tuple, TF.asof_closed(x, TF.resample_segment(x, 5), ["close"]).where(~late).select("symbol", "ts", "tf_close").collect()), key=str) for x in (bars, garbled))
    assert a == b


def test_closed_forms_are_giveback_forms(bars):
    df = lined(bars).where("valid").withColumn("x", F.col("Bbreak") + 3)
    far = df.select(F.max(F.abs(X.breakout_stop(F.lit(True), "x") - X.breakout_stop_by_giveback(F.lit(True), "x"))).alias("a"), F.max(F.abs(X.breakout_stop(F.lit(False), F.col("Sbreak") - 2) - X.breakout_stop_by_giveback(F.lit(False), F.col("Sbreak") - 2))).alias("b")).first()
    assert far["a"] < 1e-9 and far["b"] < 1e-9


def test_segments_at_exactly_three_hours(spark):
    t = dt.datetime(2024, 1, 2, 9)
    times = [t, t + dt.timedelta(hours=3), t + dt.timedelta(hours=6, seconds=1)]
    df = spark.createDataFrame([("A", x, dt.date(2024, 1, 2)) for x in times], "symbol string, ts timestamp, trading_date date")
    assert [r["segment_id"] for r in S.segments(df).orderBy("ts").collect()] == [0, 0, 1]


def test_five_modes_differ(bars):
    n = {r["mode"]: (r["s"], r["t"]) for r in S.all_modes(bars).groupBy("mode").agg(F.countDistinct("symbol", "session_id").alias("s"), F.count_if("tradable").alias("t")).collect()}
    assert n == {"split": (24, 960), "night": (24, 480), "day": (24, 480), "night_day": (12, 960), "day_night": (14, 960)}


def test_ema_over_many_blocks(spark):
    rng = random.Random(2)
    values = [rng.uniform(50, 60) for _ in range(3000)]
    df = spark.createDataFrame([("A", i, v) for i, v in enumerate(values)], "symbol string, ts long, x double")
    for span in (3, 12, 200):
        e, want = None, []
        for v in values:
            e = v if e is None else e + (v - e) * 2 / (span + 1)
            want.append(e)
        got = [r["e"] for r in N.with_ema(df, "x", span, "e").orderBy("ts").collect()]
        assert max(abs(a - b) for a, b in zip(got, want)) < 1e-9


def test_bracket_labels(spark):
    t = lambda m: dt.datetime(2024, 1, 2, 9, m)
    rows = [(10, 11, 9, 10), (10, 12, 10, 12), (12, 15, 12, 15), (15, 15, 9, 9), (9, 10, 8, 10)]
    b = spark.createDataFrame([("A", 1, t(i), *map(float, r), i == 4) for i, r in enumerate(rows)], "symbol string, session_id long, ts timestamp, open double, high double, low double, close double, is_session_last boolean")
    c = spark.createDataFrame([("A", 1, k, True, t(0), 10.0, stop, target, 1.0) for k, (stop, target) in enumerate([(8.5, 12.0), (9.0, 11.0), (1.0, 99.0)])], "symbol string, session_id long, entry_id long, is_long boolean, entry_ts timestamp, entry_price double, stop double, target double, atr double")
    got = sorted((r["entry_id"], r["reason"], r["exit_ts"].minute, r["exit_price"], r["fraction"]) for r in G.bracket_label(c, b).collect())
    assert got == [(0, "TP", 1, 12.0, 0.5), (0, "TRAIL", 3, 12.0, 0.5), (1, "SL", 0, 9.0, 1.0), (2, "END", 4, 10.0, 1.0)]
    batch = P.batch_pnl(G.bracket_label(c, b))
    taken, until = [], None
    for r in batch.orderBy("symbol", "entry_ts", "exit_ts").collect():
        if until is None or r["symbol"] != until[0] or r["entry_ts"] > until[1]:
            taken.append((r["symbol"], r["entry_id"]))
            until = r["symbol"], r["exit_ts"]
    assert sorted((r["symbol"], r["entry_id"]) for r in G.select_trades(batch).collect()) == sorted(taken)


def test_select_trades_one_at_a_time(spark):
    t = lambda h: dt.datetime(2024, 1, 2, h)
    df = spark.createDataFrame([("A", t(1), t(4)), ("A", t(2), t(3)), ("A", t(4), t(5)), ("A", t(5), t(6)), ("B", t(2), t(3))], "symbol string, entry_ts timestamp, exit_ts timestamp")
    assert sorted((r["symbol"], r["entry_ts"].hour) for r in G.select_trades(df).collect()) == [("A", 1), ("A", 5), ("B", 2)]
    assert sorted((r["symbol"], r["entry_ts"].hour) for r in G.select_trades(df, 3600).collect()) == [("A", 1), ("B", 2)]


def test_cooldown(spark):
    d = lambda k: dt.date(2024, 1, k)
    days = [("A", d(k), s, b) for k, s, b in [(1, 1, False), (2, 1, True), (3, 1, False), (4, 1, False), (5, 1, False), (6, 0, False), (7, 1, False), (8, -1, False)]]
    daily = spark.createDataFrame(days, "symbol string, trading_date date, state int, broke boolean")
    stops = spark.createDataFrame([("A", d(7), 1, 2), ("A", d(8), 1, 1)], "symbol string, trading_date date, direction int, n int")
    spans = G.cooldown_spans(daily, stops)
    assert [tuple(r)[1:] for r in spans.orderBy("start").collect()] == [(d(2), d(5)), (d(8), None)]
    inside = {r["trading_date"].day: r["cooling"] for r in G.in_spans(daily.select("symbol", "trading_date"), spans).collect()}
    assert [k for k, v in inside.items() if v] == [3, 4, 5]


def test_statistics(spark):
    t = spark.createDataFrame([("A", 0.1), ("A", 0.0), ("A", -0.05), ("B", 0.2)], "symbol string, pnl double")
    got = {r["symbol"]: r for r in P.trade_stats(t, ["symbol"]).collect()}
    assert got["A"]["wins"] == 1 and got["A"]["avg_loss"] == pytest.approx(-0.025) and got["A"]["payoff"] == pytest.approx(4) and got["B"]["payoff"] is None


def test_clean_write_read(spark, tmp_path):
    raw = make_bars(spark, days=2).withColumns({"total_turnover": F.col("volume") * 5, "open_interest": F.lit(1.0), "contract": F.lit("A1")})
    bad = raw.withColumn("close", F.when(F.minute("ts") == 7, 0.0).otherwise(F.col("close")))
    B.ingest_bars(bad, str(tmp_path / "bars"), pool=["A"])
    again = spark.read.parquet(str(tmp_path / "bars"))
    assert again.count() == raw.where("symbol = 'A'").count() - 4 and not [f for f in again.where(B.hard_error()).collect()]
    plan = B.load_bars(again, ["A"], "2024-01-02", "2024-01-02", ["ts", "close"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [symbol" in plan.replace("isnotnull(symbol", "symbol") or "symbol" in plan.split("PartitionFilters")[1][:80]


def test_fix_text(spark):
    good = "螺纹钢"
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    try:
        df = spark.createDataFrame([(good.encode("gb18030").decode("latin-1"),), (good,), ("abc",), (None,)], "name string")
        assert [r["name"] for r in B.fix_text(df, ["name"]).collect()] == [good, good, "abc", None]
    finally:
        spark.conf.unset("spark.sql.legacy.javaCharsets")


def test_catalogue_and_hours(spark):
    spark.range(3).createOrReplaceTempView("qt_one")
    assert [tuple(r) for r in B.list_tables(spark, "qt%").collect()] == [("qt_one", 3)]
    assert B.describe(spark, "qt_one").first()["name"] == "id"
    hours = spark.createDataFrame([(1, "2024-01-03", "09:00"), (1, "2024-01-02", "21:00"), (2, "2024-01-02", "09:00")], "ContractInnerCode int, TradingDate string, StartTime string")
    names = spark.createDataFrame([(1, "RB"), (2, "AG")], "ContractInnerCode int, ContractCode string")
    assert [r["StartTime"] for r in B.load_trading_hours(hours, names, "RB", "2024-01-01", "2024-01-31").collect()] == ["21:00", "09:00"]


def test_audit_of_clean_bars_finds_nothing(bars):
    assert all(r[x] == 0 for r in Q.ohlc_violations(bars).collect() for x in ("high_below_low", "high_below_body", "low_above_body", "not_positive"))
    assert TF.bad_bins(TF.resample_segment(bars, 5)).count() == 0 and S.misplaced_segments(bars).count() == 0


def test_empty_tables(spark, bars):
    none = bars.where("false")
    assert G.breakout_trades(lined(none)).count() == 0 and TF.resample_segment(none, 5).count() == 0 and N.with_macd(none).count() == 0


def test_nearest_platform_is_exact(spark):
    rng = random.Random(4)
    price = lambda: rng.randint(90, 110) / 10
    swings = [(s, i, rng.random() < 0.3, rng.random() < 0.3, price(), price()) for s in "AB" for i in range(1, 140)]
    entries = [(s, e, rng.random() < 0.5, price(), rng.choice((-1, 0, 1, 2, 3, rng.randint(0, 200)))) for s in "ABC" for e in range(150)]
    got = G.nearest_platform(spark.createDataFrame(entries, "symbol string, entry_id long, is_long boolean, price double, closed_idx long"), spark.createDataFrame(swings, "symbol string, idx long, swing_low boolean, swing_high boolean, low double, high double"))
    want = {}
    for s, e, long, p, closed in entries:
        own = [(lo if long else hi) for t, i, is_lo, is_hi, lo, hi in swings if t == s and i <= closed - 2 and (is_lo if long else is_hi) and (lo < p if long else hi > p)]
        want[s, e] = (max(own) if long else min(own)) if own else None
    assert {(r["symbol"], r["entry_id"]): r["platform"] for r in got.collect()} == want


def walk_candidates(rows, on_completed=True, fast_atr=False, discard=0):
    """Bar by bar, with the state of one symbol."""
    out, bias, seen = [], None, False
    for i, b in enumerate(rows):
        f = i if on_completed else i + 1
        s1 = (rows[i - 1]["S1"] if i else None) if on_completed else b["S1"]
        d = b["DSTATE"]
        if d != bias:
            bias, seen = d, False
        if not d:
            continue
        if not seen:
            seen = b["S30"] == -d and -d in (s1, b["S5"])
            continue
        if not (s1 == d and b["S5"] == d) or f >= len(rows) or not b["tradable"] or i < discard or rows[f]["is_session_last"]:
            continue
        seen = False
        atr = b["ATR30"] if not fast_atr else rows[i - on_completed]["ATR1"]
        if atr is not None:
            out.append((f + 1, d == 1, rows[f]["ts"], rows[f]["open"], "reentry" if out else "open", atr))
    return out


@pytest.mark.parametrize("options", [{}, {"on_completed": False}, {"fast_atr": True}, {"discard": 200}, {"on_completed": False, "fast_atr": True}])
def test_pullback_candidates_take_every_trigger(spark, options):
    rng = random.Random(7)
    t, rows, day = dt.datetime(2024, 1, 2, 9), [], 0
    for i in range(600):
        day = rng.choice((-1, 0, 1)) if i % 60 == 0 else day
        rows.append(("A", t + dt.timedelta(minutes=i), i // 20, i % 20 == 19, rng.random() < 0.8, day, *(rng.choice((-1, 0, 1)) for _ in range(3)), 0.5 if i > 60 and i % 7 else None, 1.0 if i > 30 and i % 5 else None, i // 30, 100.0 + rng.randint(-20, 20) / 10))
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, session_id long, is_session_last boolean, tradable boolean, DSTATE int, S1 int, S5 int, S30 int, ATR1 double, ATR30 double, P30 long, open double")
    swings = spark.createDataFrame([("A", i, True, True, 99.0 + i % 3 / 10, 101.0 - i % 3 / 10) for i in range(1, 21)], "symbol string, idx long, swing_low boolean, swing_high boolean, low double, high double")
    got = G.pullback_candidates(df, swings, **options).orderBy("entry_id").collect()
    want = walk_candidates([r.asDict() for r in df.orderBy("ts").collect()], **options)
    assert len(want) > 5 and [(r["entry_id"], r["is_long"], r["entry_ts"], r["entry_price"], r["signal"], r["atr"]) for r in got] == want
    for r in got:
        side = 1 if r["is_long"] else -1
        by_atr = r["entry_price"] - side * 1.5 * r["atr"]
        level = r["platform"] if r["platform"] is not None and abs(r["entry_price"] - r["platform"]) < abs(r["entry_price"] - by_atr) else by_atr
        assert r["stop"] == pytest.approx(level - side * 0.003 * r["entry_price"]) and r["target"] == pytest.approx(r["entry_price"] + side * 2 * abs(r["entry_price"] - r["stop"]))
    assert any(r["platform"] is not None for r in got)


def test_bracket_switches(spark):
    t = lambda m: dt.datetime(2024, 1, 2, 9, m)
    rows = [(10, 11, 9, 10), (10, 12, 10, 12), (12, 15, 12, 15), (11, 15, 11, 11), (9, 10, 8, 10)]
    b = spark.createDataFrame([("A", 1, t(i), *map(float, r), i == 4) for i, r in enumerate(rows)], "symbol string, session_id long, ts timestamp, open double, high double, low double, close double, is_session_last boolean")
    c = spark.createDataFrame([("A", 1, 0, True, t(0), 10.0, 9.0, 12.0, 1.0)], "symbol string, session_id long, entry_id long, is_long boolean, entry_ts timestamp, entry_price double, stop double, target double, atr double")
    legs = lambda **kw: sorted((r["leg"], r["reason"], r["exit_ts"].minute, r["exit_price"]) for r in G.bracket_label(c, b, **kw).collect())
    assert legs() == [(1, "SL", 0, 9.0)]
    assert legs(on_range=False) == [(1, "TP", 1, 12.0), (2, "TRAIL", 3, 11.0)]
    assert legs(on_range=False, fill_gaps=False) == [(1, "TP", 1, 12.0), (2, "TRAIL", 3, 12.0)]
    assert legs(on_range=False, atr_now=F.lit(2.0)) == [(1, "TP", 1, 12.0), (2, "END", 4, 10.0)]
    c = c.withColumn("stop", F.lit(8.5))
    assert legs() == [(1, "TP", 1, 12.0), (2, "TRAIL", 3, 11.0)]
    assert legs(extreme_before=False) == [(1, "TP", 1, 12.0), (2, "TRAIL", 2, 12.0)]


def walk_pullback(rows, losses=3, calm=3):
    """The strategy bar by bar, with platforms left out: entries with their exits and reasons, and spans of cooling down."""
    entries, spans, trade, seen, bias = [], [], None, False, 0
    cool, stops, side, same, stable, last_day, began = False, 0, 0, 0, None, None, None
    for i, r in enumerate(rows):
        if r["DAY"] is not None and r["DAY"] != last_day:
            last_day, s = r["DAY"], r["DSTATE"]
            if not cool:
                if r["DBREAK"]:
                    cool, same, stable, stops, side = True, 0, None, 0, 0
            else:
                if s == 0 or s != stable:
                    stable, same = s, int(s != 0)
                else:
                    same += 1
                if s != 0 and same >= calm:
                    cool, same, stable = False, 0, None
        if trade is None and not cool and r["DAY"] is not None:
            b = r["DSTATE"]
            if b != bias:
                bias, seen = b, False
            s1 = rows[i - 1]["S1"] if i else 0
            if b != 0 and not seen:
                seen = r["S30"] == -b and (s1 == -b or r["S5"] == -b)
            elif b != 0 and s1 == b and r["S5"] == b and r["tradable"] and not r["is_session_last"]:
                seen = False
                if r["ATR30"] is not None:
                    stop = r["open"] - b * 1.5 * r["ATR30"] - b * 0.003 * r["open"]
                    trade = {"i": i + 1, "b": b, "price": r["open"], "stop": stop, "target": r["open"] + 2 * b * abs(r["open"] - stop), "half": False, "best": r["open"]}
        if trade is not None:
            b, closed = trade["b"], None
            worst, best = (r["low"], r["high"]) if b == 1 else (r["high"], r["low"])
            if not trade["half"]:
                if b * (worst - trade["stop"]) <= 0:
                    closed = "SL"
                    stops, side = (stops + 1 if b == side else 1), b
                    if stops >= losses:
                        cool, same, stable, stops, side = True, 0, None, 0, 0
                elif b * (best - trade["target"]) >= 0:
                    entries.append((trade["i"], "TP", r["ts"]))
                    trade["half"], stops, side = True, 0, 0
            else:
                trail = trade["best"] - b * 3.0 * r["ATR30"] if r["ATR30"] is not None else trade["stop"]
                trail = max(trail, trade["stop"]) if b == 1 else min(trail, trade["stop"])
                if b * (worst - trail) <= 0:
                    closed = "TRAIL"
            if closed is None and r["is_session_last"]:
                closed = "END"
            if closed:
                entries.append((trade["i"], closed, r["ts"]))
                trade = None
            else:
                trade["best"] = max(trade["best"], r["high"]) if b == 1 else min(trade["best"], r["low"])
        if cool and began is None:
            began = r["ts"]
        elif not cool and began is not None:
            spans.append((began, r["ts"]))
            began = None
    return entries, spans + ([(began, None)] if began else [])


@pytest.mark.parametrize(("losses", "calm"), [(3, 3), (1, 1), (2, 2)])
def test_pullback_trades_follow_the_bar_by_bar_rule(spark, losses, calm):
    schema = "symbol string, ts timestamp, session_id long, is_session_last boolean, tradable boolean, DAY int, DSTATE int, DBREAK boolean, S1 int, S5 int, S30 int, ATR1 double, ATR30 double, P30 long, open double, high double, low double, close double"
    rows = []
    for n in range(50):
        rng = random.Random(100 * losses + n)
        t, price, day, state = dt.datetime(2024, 1, 2, 9), 100.0, 0, 0
        for i in range(400):
            if i % 20 == 10:
                day, state = day + 1, rng.choice((-1, 0, 1, 1, 1)) if rng.random() < 0.5 else state
                broke = rng.random() < 0.15
            o = price
            price = round(price + rng.gauss(0, 0.25), 2)
            known = day > 0
            rows.append((f"s{n}", t + dt.timedelta(minutes=i), i // 25, i % 25 == 24, rng.random() < 0.9, day if known else None, state if known else None, broke if known else None, *(rng.choice((-1, 0, 1)) for _ in range(3)), None, 0.3 + i / 2000 if i > 60 else None, 0, o, max(o, price) + 0.05, min(o, price) - 0.05, price))
    df = spark.createDataFrame(rows, schema)
    swings = spark.createDataFrame([], "symbol string, idx long, swing_low boolean, swing_high boolean, low double, high double")
    legs, spans = G.pullback_trades(df, swings, losses, calm)
    got, cooled = {}, {}
    for r in legs.collect():
        got.setdefault(r["symbol"], []).append((r["entry_id"], r["reason"], r["exit_ts"]))
    for r in spans.collect():
        cooled.setdefault(r["symbol"], []).append((r["start"], r["end"]))
    reasons = set()
    for n in range(50):
        want, cooling = walk_pullback([r for r in map(lambda x: dict(zip([c.split()[0] for c in schema.split(", ")], x, strict=True)), rows) if r["symbol"] == f"s{n}"], losses, calm)
        key = lambda x: (x[0], x[2], x[1] != "TP")
        assert sorted(got.get(f"s{n}", []), key=key) == sorted(want, key=key), n
        assert sorted(cooled.get(f"s{n}", []), key=str) == sorted(cooling, key=str), n
        reasons |= {x[1] for x in want}
    assert reasons >= {"SL", "TP", "END"}


def test_cooldown_needs_stops_in_a_row(spark):
    d = lambda k: dt.date(2024, 1, k)
    daily = spark.createDataFrame([("A", d(k), 0, False) for k in range(1, 20)], "symbol string, trading_date date, state int, broke boolean")
    spans = lambda sides: G.cooldown_spans(daily, spark.createDataFrame([("A", d(k + 1), side, int(side != 0)) for k, side in enumerate(sides)], "symbol string, trading_date date, direction int, n int")).collect()
    assert spans((1, -1, 1, -1, 1)) == [] and spans((1, 1, 0, 1, 1)) == []
    assert [tuple(r)[1:] for r in spans((-1, 1, 1, 1))] == [(d(4), None)]


def test_csv_and_reports(spark, tmp_path):
    path = str(tmp_path / "five.csv")
    with open(path, "w") as f:
        f.write("timestamp,symbol,sector,open,high,low,close,volume\n2024-01-02 14:30:00,X,Tech,1,2,0.5,1.5,100\n2024-01-02 14:35:00,X,,1.5,,1,2,\n")
    df = B.read_bars_csv(spark, path)
    a, b = df.orderBy("timestamp").collect()
    assert (a["timestamp"], a["sector"], a["close"], a["volume"]) == (dt.datetime(2024, 1, 2, 14, 30), "Tech", 1.5, 100.0)
    assert b["sector"] is None and b["high"] is None and b["volume"] is None
    for kind in ("csv", "parquet"):
        for _ in range(2):  # a second report replaces the first
            B.write_report(df, str(tmp_path / kind), kind)
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2


def test_custom_rule_sees_sessions(spark, bars):
    def rule(pdf):
        return pdf.assign(n=len(pdf)).groupby(["symbol", "session_id"], as_index=False)["n"].max()

    sessions = S.session_mode(bars)
    got = {tuple(x) for x in G.custom_rule(sessions.select("symbol", "session_id", "ts"), rule, "symbol string, session_id long, n long").collect()}
    assert got == {tuple(x) for x in sessions.groupBy("symbol", "session_id").count().collect()}


def test_spans_count_bars_of_the_session(spark, bars):
    rows = S.session_mode(bars)
    one = rows.where("symbol = 'A' and session_id = 2").orderBy("ts").collect()
    trades = spark.createDataFrame([("A", one[3]["ts"], one[10]["ts"], 1.0), ("A", one[5]["ts"], one[5]["ts"], 2.0), ("A", one[5]["ts"], None, 3.0)], "symbol string, entry_ts timestamp, exit_ts timestamp, pnl double")
    assert sorted((r["pnl"], r["bars"]) for r in P.with_spans(trades, rows).collect()) == [(1.0, 7), (2.0, 0), (3.0, None)]


def test_polluted_locked_and_changed(spark):
    day = lambda d: dt.date(2024, 1, d)
    bar = lambda d, ts, volume=5.0, high=2.0: ("A", ts, day(d), 1.0, high, 1.0, 1.0, volume)
    at = lambda d, h: dt.datetime(2024, 1, d, h)
    rows = [bar(2, at(2, 9)), bar(3, at(3, 9), high=1.0), bar(4, at(4, 10)), bar(5, at(4, 21), 0.0), bar(5, at(5, 10)), bar(8, at(7, 22)), bar(8, at(8, 10))]
    b = spark.createDataFrame(rows, "symbol string, ts timestamp, trading_date date, open double, high double, low double, close double, volume double")
    assert [tuple(r) for r in Q.polluted_dates(b).collect()] == [("A", day(5), 2)]  # the 8th is real
    assert [r["trading_date"] for r in Q.locked_days(S.daily_ohlc(b)).collect()] == [day(3)]
    assert Q.first_night(b).first()["first_night"] == day(5)
    change = Q.fingerprint_changes(b, "2024-01-04").first()
    assert change["changed"] and change["before"] == "09:00-09:00"


def test_missing_items_are_not_available(spark):
    df = spark.createDataFrame([(None, 0.125)], "a double, b double").select(X.percent("a").alias("a"), X.ratio("a").alias("ra"), X.percent("b").alias("b"))
    assert tuple(df.first()) == ("n/a", "n/a", "+12.50%")


def test_report_of_a_portfolio(spark):
    day = lambda d: dt.date(2024, 1, d)
    w = spark.createDataFrame([("A", day(d), 0.5) for d in (2, 3, 4)] + [("B", day(d), 0.5) for d in (2, 3, 4)], "symbol string, trading_date date, weight double")
    rets = {"A": (0.1, -0.2, 0.0), "B": (0.0, 0.1, 0.3)}
    r = spark.createDataFrame([(s, day(2 + k), x) for s, v in rets.items() for k, x in enumerate(v)], "symbol string, trading_date date, ret double")
    fee, curve, e = 0.01, [], 1.0
    for k in range(3):
        e *= 1 + sum(v[k] for v in rets.values()) / 2 - fee * (1.0 if k == 0 else 0.0)
        curve.append(e)
    got = {x["series"]: x for x in P.portfolio_report(w, r, r.withColumn("ret", F.lit(0.0)), fee).collect()}
    steps = [curve[1] / curve[0] - 1, curve[2] / curve[1] - 1]
    mean = sum(steps) / 2
    sharpe = mean / (sum((x - mean) ** 2 for x in steps)) ** 0.5 * 252**0.5
    s = got["strategy"]
    assert s["days"] == 3 and abs(s["total_return"] - (curve[-1] - 1)) < 1e-9 and abs(s["max_drawdown"] - (curve[1] / curve[0] - 1)) < 1e-9 and abs(s["sharpe"] - sharpe) < 1e-9
    assert got["benchmark"]["total_return"] == 0 and got["benchmark"]["sharpe"] is None


def test_mean_with_missing_values(spark):
    rng = random.Random(5)
    xs = [None if k in (0, 1, 7, 60, 61) else rng.uniform(1, 9) for k in range(120)]
    df = spark.createDataFrame([("A", dt.datetime(2024, 1, 2) + dt.timedelta(minutes=k), x) for k, x in enumerate(xs)] + [("B", dt.datetime(2024, 1, 2), None)], "symbol string, ts timestamp, x double")
    want, e = [], None
    for x in xs:
        e = e if x is None else x if e is None else e + (x - e) * 2 / 4
        want.append(e)
    got = [r["e"] for r in N.with_ema(df, "x", 3, "e").where("symbol = 'A'").orderBy("ts").collect()]
    assert got[:2] == [None, None] and max(abs(a - b) for a, b in zip(got[2:], want[2:])) < 1e-9
    assert N.with_ema(df, "x", 3, "e").where("symbol = 'B'").first()["e"] is None


T0 = dt.datetime(2024, 1, 2, 9)


def test_trading_hours_from_a_database(spark, tmp_path):
    """An embedded database; its queries carry the code, the dates and only the columns that are needed."""
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    hours = [(k % 2 + 1, dt.date(2024, 1, 1) + dt.timedelta(days=k), f"{9 + k % 3:02d}:00", "15:00") for k in range(60)]
    hours = spark.createDataFrame(hours, "ContractInnerCode int, TradingDate date, StartTime string, EndTime string")
    names = spark.createDataFrame([(1, "RB", "x"), (2, "CU", "y")], "ContractInnerCode int, ContractCode string, Remark string")
    for df, table, types in ((hours, "TradingHours", "StartTime VARCHAR(8), EndTime VARCHAR(8)"), (names, "ContractMaster", "ContractCode VARCHAR(8), Remark VARCHAR(8)")):
        df.write.jdbc(url, table, properties=driver | {"createTableColumnTypes": types})
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)  # whole filters in plans
    got = B.read_trading_hours(spark, url, "RB", "2024-01-05", "2024-01-20", partitions=4, **driver)
    want = B.load_trading_hours(hours, names, "RB", "2024-01-05", "2024-01-20")
    rows = got.collect()
    assert len(rows) == 8 and [tuple(r) for r in rows] == [tuple(r) for r in want.select(got.columns).collect()]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "numPartitions=4" in plan
    pushed = [line for line in plan.splitlines() if "PushedFilters" in line]
    assert any("EqualTo(ContractCode,RB)" in line and "Remark" not in line for line in pushed)
    assert any("TradingDate,2024-01-05" in line and "TradingDate,2024-01-20" in line for line in pushed)


def test_manifest_tells_megabytes_and_trimmed(spark):
    bars = spark.createDataFrame([("A", dt.datetime(2024, 1, 2, 9, k), dt.date(2024, 1, 2), 1.0 if k else None) for k in range(3)] + [("BB", None, None, 2.0)], "symbol string, ts timestamp, trading_date date, close double")
    got = {r["symbol"]: r for r in B.manifest(bars, {"A": "2024-01-02"}).collect()}
    assert (got["A"]["bars"], got["A"]["trimmed"], got["BB"]["trimmed"]) == (3, True, False)
    big = B.manifest(bars.where("symbol = 'A'").crossJoin(spark.range(1000).select(F.lit(1).alias("_")))).first()
    assert big["mb"] == round(1000 * (3 * (1 + 8 + 4 + 4) + 2 * 8) / 1e6, 3)


def test_windows_in_blocks_are_those_of_the_whole_series(spark):
    """Blocks of any size, symbols of very different sizes, rows without a time or a symbol, repeated times in other symbols."""
    rnd = random.Random(11)
    rows = [(s, T0 + dt.timedelta(minutes=37 * k), *(lambda c: (c + rnd.random(), c - rnd.random(), c))(100.0 + rnd.randint(-5, 5))) for s, n in (("A", 230), ("B", 9), (None, 12), ("C", 1)) for k in range(n)]
    rows += [("D", None, 1.0, 1.0, 1.0), ("D", T0, 2.0, 1.0, 1.5)]
    bars = spark.createDataFrame(rows, "symbol string, ts timestamp, high double, low double, close double")
    work = lambda b: N.with_swings(N.with_atr(b.withColumn("ma", N.sma("close", 4)), 5))
    key = lambda r: tuple(str(v) for v in r)
    want = sorted(map(key, work(bars).collect()))
    for size in (6, 7, 64, 100_000):
        got = S.in_blocks(bars, work, 6, 2, size)
        assert sorted(got.columns) == sorted(work(bars).columns)
        assert sorted(map(key, got.select(*work(bars).columns).collect())) == want
    assert [r["n"] for r in S.numbered(bars.where("symbol = 'A'"), "n").orderBy("ts").collect()] == list(range(230))
    assert S.in_blocks(bars.limit(0), work, 6, 2).count() == 0
    with pytest.raises(ValueError):
        S.in_blocks(bars, work, 6, 2, 5)


def test_no_task_of_blocked_windows_holds_a_symbol(spark):
    bars = spark.range(4000).select(F.lit("A").alias("symbol"), F.timestamp_seconds(F.col("id") * 3600).alias("ts"), F.col("id").cast("double").alias("close"))
    of = S.in_blocks(bars, lambda b: b.withColumn("seen", F.count("*").over(S.by_time().rowsBetween(-(10**6), 10**6))), 3, 3, 100)
    assert of.agg(F.max("seen")).first()[0] == 106


def test_arrivals_that_repeat_or_go_back(spark):
    rows = [("A", T0, 1), ("A", T0, 2), ("A", T0 + dt.timedelta(minutes=2), 70_000), ("A", T0 + dt.timedelta(minutes=1), 70_001), ("A", T0, 140_000), ("B", T0, 5)]
    got = {r["symbol"]: tuple(r)[1:] for r in Q.duplicates(spark.createDataFrame(rows, "symbol string, ts timestamp, n long"), "n").collect()}
    assert got == {"A": (5, 2, 1, 2), "B": (1, 0, 0, 0)}


def test_rows_of_dates_without_volume_are_dropped_as_fake(spark):
    bar = lambda day, k, v, c=10.0: ("A", T0 + dt.timedelta(days=day, minutes=k), c, c, c, c, v, v * 10, 1.0)
    rows = [bar(0, 0, 5.0), bar(0, 1, 0.0), bar(0, 2, 1.0, 12.0), bar(1, 0, 0.0), bar(1, 1, 0.0), bar(2, 0, 3.0, -1.0)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double, total_turnover double, open_interest double")
    got = Q.drop_counts(df).first()
    assert (got["drop_price"], got["drop_shape"], got["drop_amount"], got["drop_fake"], got["drop_jump"]) == (1, 0, 0, 2, 1) and abs(got["drop_share"] - 4 / 6) < 1e-12


def test_a_flip_and_the_entry_it_makes_are_one_marker(spark):
    at = lambda k: T0 + dt.timedelta(minutes=k)
    rows = [("A", "long", at(0), 10.0, at(3), 11.0, "FLIP", 0.1), ("A", "short", at(3), 11.0, at(5), 12.0, "SL", -0.1), ("A", "long", at(9), 11.0, at(10), 12.0, "FLIP", 0.1), ("B", "short", at(10), 1.0, at(12), 1.0, "FLIP", 0.0)]
    got = C.markers(spark.createDataFrame(rows, "symbol string, direction string, entry_ts timestamp, entry_price double, exit_ts timestamp, exit_price double, reason string, pnl double")).collect()
    assert [(r["symbol"], r["ts"], r["kind"], r["colour"]) for r in got] == [("A", at(0), "entry", "long"), ("A", at(3), "flip", "flip"), ("A", at(5), "exit", "loss"), ("A", at(9), "entry", "long"), ("A", at(10), "exit", "win"), ("B", at(10), "entry", "short"), ("B", at(12), "exit", "loss")]
    assert [r["text"] for r in got if r["kind"] == "flip"] == ["FLIP Short"]


def test_live_cross_needs_two_known_rows(spark):
    rows = [("A", T0 + dt.timedelta(minutes=k), m, 0.0) for k, m in enumerate((1.0, -1.0, 0.0, 2.0, None, 3.0, 0.0, -1.0))]
    got = N.live_cross(spark.createDataFrame(rows, "symbol string, ts timestamp, live_macd double, live_signal double")).orderBy("ts").collect()
    assert [r["cross"] for r in got] == [0, -1, 0, 1, 0, 0, 0, -1]


def test_atr_bias_leaves_out_buckets_that_are_not_full(spark):
    rows = [("A", T0 + dt.timedelta(minutes=k), 5.0 if k < 40 else 6.0, 5.0, 5.0) for k in range(61)]
    raw = spark.createDataFrame(rows, "symbol string, ts timestamp, high double, low double, close double")
    got = {r["size"]: r for r in Q.zero_atr_bias(raw, raw.where("high = 6"), (1, 2, 30), 14).collect()}
    assert (got[1]["zero_raw"], got[1]["zero_clean"], got[1]["bias"] < 0) == (27, 0, True)
    assert got[2]["zero_raw"] == 7 and got[30]["zero_raw"] == 0 and got[30]["bias"] is None
