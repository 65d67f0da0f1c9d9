"""Registered queries of the bar library against DuckDB on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from tidebar.plans import queries

SF = "/root/testdata/sf0.001"
CHECKED = ("io3_clean_bars", "w5_modes", "j1_attach_lines", "a3_resample_segment", "j2_asof_closed", "w9_macd", "w12_ma_states", "a21_portfolio_returns", "a8_liquidity", "g2_breakout_trades", "g4_reversal_trades", "g5_mark_to_market", "q8_fingerprint", "q19_roll_continuity", "q30_stale_runs", "j11_platform", "w24_live_indicators", "g8_pullback_events", "g11_cooldown", "g16_report", "c7_directions", "q8_changed", "j13_scorecard", "g6_reentry", "g10_brackets", "g12_one_at_a_time", "g14_sweep", "a20_contribution", "q38_invariants", "a9_medians", "a23_by_rank", "t2_top_moves", "t3_least_moves", "g7_cascade", "c3_flips", "w25_live_cross", "q1_duplicates", "q18_presence", "q23_multiplier", "q31_atr_bias", "a15_warmup", "pf9_drop_counts", "j12_snap_open", "io4_manifest")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("region", "nation", "events", "lineitem", "orders"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def shown(df):
    cols = sorted(df.columns)
    text = lambda v: "" if pd.isna(v) else f"{v:.8g}" if isinstance(v, float) else str(pd.Timestamp(v)) if hasattr(v, "year") else str(v)
    return sorted(tuple(text(v) for v in row) for row in df[cols].astype(object).itertuples(index=False)), cols


@pytest.mark.parametrize("name", CHECKED)
def test_same_as_sql(spark, duck, name):
    got, want = shown(queries.QUERIES[name](spark, SF).toPandas()), shown(duck.sql(queries.SQL[name]).df())
    number = lambda x: tuple(str(float(v)) if v.replace(".", "", 1).replace("-", "", 1).replace("e", "", 1).isdigit() else v for v in x)
    assert got[1] == want[1] and sorted(map(number, got[0])) == sorted(map(number, want[0]))


def test_every_sql_has_its_query():
    assert set(queries.SQL) <= set(queries.QUERIES)
