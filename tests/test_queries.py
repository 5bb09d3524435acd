"""Registered plans against their SQL on the smallest tables, and the driver contract."""

import sys

import duckdb
import pytest

sys.path.insert(0, __file__.rsplit("/", 2)[0])

import __spark_entry__ as entry  # noqa: E402
from tools.check_oracle import connect, rows_of  # noqa: E402

SAMPLE = (
    "golden_cross sma ema macd resample_ohlcv indicator_table drawdown risk_windows ols_market ic_buckets bh_fdr pf_returns cov_matrix risk_contrib "
    "pairs_scan rolling_coint fifo_lots book_metrics participation_schedule chain_iv signal_outcome momentum_backtest outcome_frequencies opportunity_union turnover fill_blanks src_filings_xml "
    "clean_symbols multi_format_date upsert_latest alt_features st_bars st_alerts st_sink state_transitions factor_scores"
).split()


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", SAMPLE)
def test_plan_equals_sql(spark, con, folder, name):
    df = entry.queries()[name](spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(entry.oracle_sql()[name])
    want = rows_of([d[0] for d in res.description], res.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    for a, b in zip(got[1], want[1]):
        for x, y in zip(a, b):
            assert x == pytest.approx(y, rel=1e-6, abs=1e-6) if isinstance(x, float) else x == y


def test_contract(spark, folder):
    assert entry.entry(spark).columns == ["ticker", "date", "close", "sma50", "sma200"]
    names = set(entry.queries())
    assert len(names) >= 217 and set(entry.oracle_sql()) <= names
    assert duckdb.__version__
