"""First passages, list ranking and composed transitions against plain loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidebar.operators import passage, ranking
from tidebar.operators import signals as G

START = dt.datetime(2024, 1, 1)


def walk_brackets(cands, bars, mult=3.0, share=0.5, on_range=True, fill_gaps=True, before=True, pessimistic=True, flat=True, atr_now=True):
    """Bar by bar."""
    by, out = {}, []
    for b in bars:
        by.setdefault((b["symbol"], b["session_id"]) if flat else b["symbol"], []).append(b)
    for c in cands:
        s = 1 if c["is_long"] else -1
        rest, peak, taken = 1.0, None, False
        series = by[(c["symbol"], c["session_id"]) if flat else c["symbol"]]
        worse = lambda level, b: (min if s == 1 else max)(level, b["open"]) if fill_gaps else level  # noqa: E731, B023
        for b in series:
            if b["ts"] < c["entry_ts"]:
                continue
            high = b["high"] if s == 1 else -b["low"]
            down, up = ((b["low"], b["high"]) if s == 1 else (-b["high"], -b["low"])) if on_range else (s * b["close"],) * 2
            if not before:
                peak = high if peak is None else max(peak, high)
            legs = []
            if not taken:
                sl, tp = down <= s * c["stop"], up >= s * c["target"]
                if sl and (pessimistic or not tp):
                    legs.append(("SL", worse(c["stop"], b), 1.0))
                elif tp:
                    legs.append(("TP", c["target"], share))
                    taken = True
            else:
                atr = b["atr_now"] if atr_now and b["atr_now"] is not None else c["atr"]
                trail = max(peak - mult * atr, s * c["stop"])
                if down <= trail:
                    legs.append(("TRAIL", worse(s * trail, b), 1 - share))
            rest -= sum(x[2] for x in legs)
            if rest > 1e-9 and flat and b["is_session_last"]:
                legs.append(("END", b["close"], rest))
                rest = 0
            out += [(c["symbol"], c["entry_id"], r, b["ts"], round(p, 6), round(f, 6)) for r, p, f in legs]
            if rest <= 1e-9:
                break
            if before:
                peak = high if peak is None else max(peak, high)
    return sorted(out)


def series(spark, per, seed, symbols=("A", "B"), sessions=3):
    rng, bars, cands = random.Random(seed), [], []
    for symbol in symbols:
        price, ts = 1000, START
        for k in range(sessions):
            for m in range(per):
                o = price
                price += rng.randint(-9, 9)
                ts += dt.timedelta(minutes=1)
                row = {"symbol": symbol, "session_id": k, "ts": ts, "trading_date": START.date() + dt.timedelta(days=k), "open": o + rng.randint(-3, 3), "high": max(o, price) + rng.randint(3, 6), "low": min(o, price) - rng.randint(3, 6), "close": price, "is_session_last": m == per - 1, "atr_now": rng.choice((None, 4.37, 6.91, 11.13))}
                bars.append({c: float(v) if c in ("open", "high", "low", "close") else v for c, v in row.items()})
                if rng.random() < 0.2 and m < per - 1:
                    long, risk = rng.random() < 0.5, rng.choice((5.3, 17.7, 60.1, 400.3))
                    s = 1 if long else -1
                    cands.append({"symbol": symbol, "session_id": k, "entry_id": len(bars), "is_long": long, "entry_ts": ts, "entry_price": float(o), "stop": o - s * risk, "target": o + s * risk * rng.choice((0.5, 2)), "atr": rng.choice((3.41, 8.17))})
    b = spark.createDataFrame(bars, "symbol string, session_id long, ts timestamp, trading_date date, open double, high double, low double, close double, is_session_last boolean, atr_now double")
    c = spark.createDataFrame(cands, "symbol string, session_id long, entry_id long, is_long boolean, entry_ts timestamp, entry_price double, stop double, target double, atr double")
    return bars, cands, b, c


@pytest.mark.parametrize(
    ("per", "options", "walked"),
    [
        (70, {}, {}),
        (1100, {}, {}),
        (70, {"on_range": False, "fill_gaps": False}, {"on_range": False, "fill_gaps": False}),
        (70, {"extreme_before": False, "pessimistic": False}, {"before": False, "pessimistic": False}),
        (40, {"forces_flat": False}, {"flat": False}),
        (400, {"forces_flat": False, "mult": 5.0, "share": 0.25}, {"flat": False, "mult": 5.0, "share": 0.25}),
    ],
)
def test_brackets_bar_by_bar(spark, per, options, walked):
    bars, cands, b, c = series(spark, per, per + len(options), symbols=("A",) if per > 100 else ("A", "B"), sessions=2 if per > 100 else 3)
    legs = G.bracket_label(c, b, atr_now=F.col("atr_now"), **options)
    got = sorted((r["symbol"], r["entry_id"], r["reason"], r["ts"] if "ts" in r else r["exit_ts"], round(r["exit_price"], 6), round(r["fraction"], 6)) for r in legs.collect())
    assert got == walk_brackets(cands, bars, **walked) and {x[2] for x in got} >= {"SL", "TP", "TRAIL"}


def test_entry_atr_where_no_other_is_given(spark):
    bars, cands, b, c = series(spark, 60, 5)
    got = sorted((r["symbol"], r["entry_id"], r["reason"], r["exit_ts"], round(r["exit_price"], 6), round(r["fraction"], 6)) for r in G.bracket_label(c, b).collect())
    assert got == walk_brackets(cands, bars, atr_now=False)


def test_positions_of_symbols_are_those_of_all_bars(spark):
    bars, _, b, _ = series(spark, 30, 6)
    got = [(r["symbol"], r["pos"]) for r in passage.positions(b, ["symbol"]).orderBy("symbol", "ts").collect()]
    assert got == [(s, k) for s in "AB" for k in range(90)] and len(bars) == 180


@pytest.mark.parametrize("length", [7, 50, 10_000])
def test_one_at_a_time_is_that_of_a_loop(spark, length):
    rng = random.Random(length)
    rows = [(s, a, a + rng.choice((0, 1, 5, 30, 200)), k) for s in ("A", "B", "C") for k, a in enumerate(rng.sample(range(600), 150))]
    rows += [(s, a, b + 3, k + 1000) for s, a, b, k in rows[::7]] + [("D", 5, 5, 1)]
    want, until = [], {}
    for s, a, b, k in sorted(rows):
        if s not in until or a > until[s] + 2:
            until[s] = b
            want.append((s, a, b))
    df = spark.createDataFrame(rows, "symbol string, entry_ts long, exit_ts long, k long")
    got = sorted({(r["symbol"], r["entry_ts"], r["exit_ts"]) for r in ranking.one_at_a_time(df, 2, length).collect()})
    assert got == want
    assert ranking.one_at_a_time(df.where("false")).count() == 0


@pytest.mark.parametrize(("losses", "calm", "together"), [(3, 3, 256), (2, 2, 5), (1, 4, 1)])
def test_cooling_is_that_of_a_loop(spark, monkeypatch, losses, calm, together):
    monkeypatch.setattr(G, "DAYS_TOGETHER", together)
    rng = random.Random(losses)
    days = [(s, dt.date(2024, 1, 1) + dt.timedelta(days=k), rng.choice((-1, 0, 1, 1, 1, None)), rng.random() < 0.08) for s in ("A", "B") for k in range(120) if k % 7 < 5]
    exits = [(s, d, rng.choice((-1, 1)), rng.choice((0, 1, 1, 2)), k) for s, d, *_ in days for k in range(rng.choice((0, 0, 1, 2)))]
    want = []
    for symbol in ("A", "B"):
        cooling, since = G._Cooling(losses, calm), None
        events = [(d, 0, 0, x, b) for s, d, x, b in days if s == symbol] + [(d, 1, k, x, n) for s, d, x, n, k in exits if s == symbol]
        for day, kind, _, x, y in sorted(events, key=lambda e: e[:3]):
            was = cooling.on
            if kind == 0:
                cooling.day(x or 0, y)
            elif y == 0:
                cooling.took()
            else:
                for _ in range(y):
                    if not cooling.on:
                        cooling.stopped(x)
            if cooling.on and not was:
                since = day
            elif was and not cooling.on:
                want.append((symbol, since, day))
        if cooling.on:
            want.append((symbol, since, None))
    daily = spark.createDataFrame(days, "symbol string, trading_date date, state int, broke boolean")
    outs = spark.createDataFrame(exits, "symbol string, trading_date date, direction int, n int, at long")
    assert sorted((tuple(r) for r in G.cooldown_spans(daily, outs, losses, calm).collect()), key=repr) == sorted(want, key=repr)


def test_invariants_count_what_is_broken(spark):
    from tidebar.operators import audit

    t = lambda m: START + dt.timedelta(minutes=m)
    bars = spark.createDataFrame([("A", t(m), m // 5) for m in range(20)], "symbol string, ts timestamp, session_id long")
    legs = spark.createDataFrame([("A", 1, t(0), t(2), "TP", 0.5, 0.1), ("A", 1, t(0), t(3), "END", 0.5, -0.1), ("A", 2, t(4), t(6), "TP", 0.5, -0.2), ("A", 2, t(4), t(6), "SL", 0.6, -0.2)], "symbol string, entry_id long, entry_ts timestamp, exit_ts timestamp, reason string, fraction double, pnl double")
    trades = spark.createDataFrame([("A", t(0), t(3)), ("A", t(3), t(2))], "symbol string, entry_ts timestamp, exit_ts timestamp")
    got = audit.trade_invariants(legs, trades, bars).first().asDict()
    assert got == {"bad_fractions": 1, "bad_legs": 1, "losing_targets": 1, "exit_before_entry": 1, "overlapping": 1, "other_session": 2}


def test_displayed_prices_keep_the_windows_base(spark):
    from tidebar.operators import sessions

    rows = [("A", START + dt.timedelta(days=k, minutes=m), START.date() + dt.timedelta(days=k), 10.0 * (1 + k), 1.0 + k) for k in range(6) for m in range(3)]
    bars = spark.createDataFrame(rows, "symbol string, ts timestamp, trading_date date, close double, K double").selectExpr("*", "close AS open", "close AS high", "close AS low")
    cut = sessions.window_cut(bars, "2024-01-04", "2024-01-05", 2)
    got = {(r["trading_date"].day, r["in_window"], r["close"]) for r in sessions.adjust_prices(cut).collect()}
    assert got == {(2, False, 40.0), (3, False, 40.0), (4, True, 40.0), (5, True, 40.0)}
    assert {r["close"] for r in sessions.adjust_prices(bars).collect()} == {10.0}


def test_equity_of_several_trades_in_a_session(spark):
    t = lambda m: START + dt.timedelta(minutes=m)
    close = [100.0, 101.0, 102.0, 103.0, 102.0, 101.0, 100.0, 99.0]
    bars = spark.createDataFrame([("A", t(m), START.date(), 1, c) for m, c in enumerate(close)], "symbol string, ts timestamp, trading_date date, session_id long, close double")
    trades = spark.createDataFrame([("A", 1, "long", t(1), 101.0, t(3), 2 / 101), ("A", 1, "short", t(4), 102.0, t(6), 2 / 102)], "symbol string, session_id long, direction string, entry_ts timestamp, entry_price double, exit_ts timestamp, pnl double")
    got = [(r["position"], round(r["equity"], 9)) for r in G.mark_to_market(bars, trades).orderBy("ts").collect()]
    won = 1 + 2 / 101
    both = won * (1 + 2 / 102)
    assert got == [(0, 1.0), (1, 1.0), (1, round(102 / 101, 9)), (0, round(won, 9)), (-1, round(won, 9)), (-1, round(won * (1 + 1 / 102), 9)), (0, round(both, 9)), (0, round(both, 9))]


def test_stored_bars_are_pruned(spark, tmp_path):
    from tidebar.sources import bars as B
    from tidebar.sources.scratch import prepared

    _, _, b, _ = series(spark, 30, 2)
    stored = prepared(spark, "pruned", str(tmp_path), lambda: b, "symbol")
    df = B.load_bars(stored, ["A"], "2024-01-01", "2024-01-01", ["symbol", "ts", "close"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan parquet" in line)
    assert "PartitionFilters: [" in scan and "symbol" in scan.split("PartitionFilters: [")[1].split("]")[0] and "GreaterThanOrEqual(ts" in scan.split("PushedFilters: [")[1] and "open" not in scan.split("ReadSchema")[1]
    assert df.count() == b.where("symbol = 'A'").count() and prepared(spark, "pruned", str(tmp_path), lambda: 1 / 0, "symbol").count() == b.count()


def test_sweep_is_each_variant_by_itself(spark):
    from tests.test_bars import make_bars
    from tidebar.operators import sessions
    from tidebar.operators import timeframes as TF

    bars = make_bars(spark, days=8, per=60, seed=4)
    lines = sessions.prev_day_lines(sessions.daily_ohlc(bars), 30)
    rows = [("a", "split", 1, 0, 2.0, True, True), ("b", "day_night", 1, 2, 3.0, False, True), ("c", "night_day", 5, 1, 2.0, True, False)]
    table = spark.createDataFrame(rows, "variant string, mode string, minutes int, lag int, d double, on_range boolean, fill_gaps boolean")
    seen = G.sweep(bars, lines, table)
    one = lambda r: (r["symbol"], r["session_id"], r["entry_ts"], r["exit_ts"], round(r["exit_price"], 9), r["reason"])
    for name, mode, minutes, lag, d, on_range, fill in rows:
        seg = sessions.segments(bars)
        own = seg if minutes == 1 else TF.resample_segment(seg, minutes)
        lined = sessions.attach_lines(sessions.session_mode(sessions.night_flag(own), mode), lines)
        want = sorted(map(one, G.breakout_trades(lined, d, on_range, fill, lag=lag).collect()))
        assert sorted(map(one, seen.where(F.col("variant") == name).collect())) == want and want
