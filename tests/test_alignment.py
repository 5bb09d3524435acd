"""Lookups, alignment and streams on cases the shared tables do not hold."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.operators import cleaning, events, filings, pairs, portfolio, signals
from marketloom.streaming import streams

DAY = dt.date(2020, 3, 2)


def bars(spark, closes, ticker="A", start=DAY):
    rows = [(ticker, "S", start + dt.timedelta(days=i), float(c)) for i, c in enumerate(closes)]
    out = spark.createDataFrame(rows, "ticker string, sector string, date date, close double")
    return out.withColumn("open", F.col("close")).withColumn("high", F.col("close")).withColumn("low", F.col("close")).withColumn("volume", F.lit(100.0))


def test_signals_at_any_distance(spark):
    prices = bars(spark, range(100, 140))
    days = [dt.date(2001, 1, 1), DAY - dt.timedelta(days=30), DAY + dt.timedelta(days=2), DAY + dt.timedelta(days=39), DAY + dt.timedelta(days=41)]
    asked = spark.createDataFrame([("A", d, None, i) for i, d in enumerate(days)], "ticker string, date date, entry_price double, id int")
    bench = bars(spark, range(200, 230)).select("date", "close")
    got = {r.id: r for r in signals.signal_outcome(asked, prices, bench).collect()}
    assert set(got) == {0, 1, 2, 3}  # the last one lies after every bar
    assert got[0].return_1w == pytest.approx(105 / 100 - 1) and got[1].return_1w == got[0].return_1w
    assert got[2].return_1m == pytest.approx(123 / 102 - 1)
    assert got[0].sp500_relative_return == pytest.approx((121 / 100 - 1) - (221 / 200 - 1))
    assert got[2].date == days[2] and got[3].return_1w is None
    short = signals.signal_outcome(asked, prices, bench.filter(F.col("date") < F.lit(DAY + dt.timedelta(days=1)))).collect()
    assert len(short) == 4 and all(r.sp500_relative_return is None for r in short)


def test_limits_are_optional(spark):
    lists = spark.createDataFrame([(1, ",".join([*(f"T{i}" for i in range(40)), "bad one!"]))], "list_id long, raw string")
    ok, bad = cleaning.clean_symbols(lists)
    assert ok.count() == 40 and bad.count() == 1
    reports = spark.createDataFrame([("A", DAY + dt.timedelta(days=90 * i), 1.0, 2.0) for i in range(9)], "ticker string, date date, eps_estimate double, eps_actual double")
    assert filings.earnings_streak(reports).first().beat_streak == 9
    assert filings.earnings_streak(reports, last=8).first().beat_streak == 8


def test_a_late_listing_concerns_its_holders_only(spark):
    r = np.random.default_rng(3)
    walk = lambda n: 100 * np.exp(np.cumsum(r.normal(0, 0.01, n)))
    early, second, late = walk(200), walk(200), walk(20)
    prices = bars(spark, early, "A").unionByName(bars(spark, second, "B")).unionByName(bars(spark, late, "C", DAY + dt.timedelta(days=180)))
    held = spark.createDataFrame([("p", "A", "S", 1.0), ("p", "B", "S", 1.0), ("q", "A", "S", 1.0), ("q", "C", "S", 1.0)], "portfolio_id string, ticker string, sector string, shares double")
    matrix = portfolio.price_matrix(prices)
    weights = portfolio.weights(held, prices)
    days = {x.portfolio_id: x["count"] for x in portfolio.aligned_portfolio_returns(matrix, weights).groupBy("portfolio_id").count().collect()}
    assert days == {"p": 199, "q": 19}
    assert portfolio.portfolio_returns(matrix, weights).filter("portfolio_id = 'q'").count() == 199
    pairs = {(x.portfolio_id, x.a, x.b): x for x in portfolio.holding_pairs(matrix, weights).collect()}
    assert set(pairs) == {("p", "A", "B"), ("q", "A", "C")}
    change = lambda x: x[1:] / x[:-1] - 1
    assert pairs["p", "A", "B"]["corr"] == pytest.approx(np.corrcoef(change(early), change(second))[0, 1])
    assert pairs["q", "A", "C"]["corr"] == pytest.approx(np.corrcoef(change(early[180:]), change(late))[0, 1])


def test_upsert_stream_keeps_the_newest_event(spark, tmp_path):
    schema = "ticker string, event_id long, x long"
    batches = [[("A", 5, 1), ("B", 1, 1)], [("A", 3, 2), ("B", 2, 2)], [("A", 4, 3), ("C", 9, 3)], [("A", 5, 4)], [("B", 0, 5)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for every in (100, 2):
        base = streams.upsert_stream(stream, ["ticker"], "event_id", buckets=3, compact_every=every)
        got = {r.ticker: r.event_id for r in streams.read_upserted(spark, base, ["ticker"], "event_id").collect()}
        assert got == {"A": 5, "B": 2, "C": 9}
        assert len(streams._versions(spark, base)) <= (5 if every == 100 else 2)


def test_a_zero_price_has_no_score_in_batch_and_stream(spark):
    r = np.random.default_rng(1)
    closes = np.round(50 + r.normal(0, 1, 400), 2)
    closes[40] = 0.0
    start = dt.datetime(2024, 1, 1)
    rows = [("A", start + dt.timedelta(minutes=5 * i), float(c) + 0.5, max(float(c) - 0.5, 0.0), float(c), 100.0 + i % 7) for i, c in enumerate(closes)]
    frame = spark.createDataFrame(rows, "ticker string, ts timestamp, high double, low double, close double, volume double")
    batch = {x.ts: x for x in events.intraday_reasons(frame).collect()}
    made = streams.bar_features(np.array([x[2:] for x in rows]), 0, step=64)
    z = made[:, streams.FEATURES.index("z_score")]
    assert np.isnan(z[41:200]).all() and not np.isnan(z[295:]).any()
    order = sorted(batch)
    for i, at in enumerate(order):
        want = batch[at].z_score
        assert (want is None) == np.isnan(z[i]) and (want is None or z[i] == pytest.approx(want, abs=1e-9))
        for name in ("prior_high", "sma50", "prev20", "vwap", "prev_vwap", "move_pct", "volume_ratio"):
            have, want = made[i, streams.FEATURES.index(name)], batch[at][name]
            assert (want is None and np.isnan(have)) or have == pytest.approx(want, abs=1e-9), name


@pytest.mark.parametrize(("n", "step"), [(60, 20), (50, 16), (40, 40), (45, 60)])
def test_windows_from_cells_equal_windows_of_rows(spark, n, step):
    """Every window fitted alone by numpy; borders that meet no multiple of the step, windows apart and on end, a constant leg, levels far from zero."""
    r = np.random.default_rng(n)
    rows = []
    for pair, size, level in (("p", 230, 4.0), ("q", 119, 9.0), ("flat", 130, 3.0)):
        x = level + np.cumsum(r.normal(0, 0.01, size)) * (pair != "flat")
        noise = np.zeros(size)
        for i in range(1, size):
            noise[i] = 0.8 * noise[i - 1] + r.normal(0, 0.01)
        y = 1 + 0.7 * x + noise
        rows += [(pair, "b", dt.date(2020, 1, 1) + dt.timedelta(days=i), float(y[i]), float(x[i])) for i in range(size)]
    frame = spark.createDataFrame(rows, "a string, b string, date date, y double, x double")
    got = {(g.a, g.win): g for g in pairs.window_fits(frame, n, step).collect()}
    wanted = 0
    for pair in ("p", "q", "flat"):
        y, x = np.array([t[3:] for t in rows if t[0] == pair]).T
        for win, at in enumerate(range(0, len(y) - n + 1, step)):
            wanted += 1
            g, (u, v) = got[pair, win], (y[at : at + n], x[at : at + n])
            assert g.n_rows == len(y)
            if pair == "flat":
                assert g.hedge_ratio is None and g.intercept is None
                continue
            h, c = np.polyfit(v, u, 1)
            s = u - c - h * v
            b, a = np.polyfit(s[:-1], np.diff(s), 1)
            error = np.sqrt(((np.diff(s) - a - b * s[:-1]) ** 2).sum() / (n - 2)) / np.sqrt(((s[:-1] - s[:-1].mean()) ** 2).sum())
            assert (g.hedge_ratio, g.intercept, g.std) == pytest.approx((h, c, s.std(ddof=1)), rel=1e-7)
            assert g.raw_pvalue == pytest.approx(min(max(np.exp(b / error), 0.0001), 1.0), rel=1e-6)
    assert len(got) == wanted
