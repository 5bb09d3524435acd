"""Shared building blocks against plain loops and NumPy."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketloom.functions.expr import correlation, norm_cdf, product
from marketloom.functions.gram import pair_moments
from marketloom.functions.prefix import with_prefix_sums
from marketloom.functions.ranks import quantile_edges, with_avg_rank
from marketloom.functions.rolling import with_emas, with_rsi
from marketloom.operators import backtest, micro, pairs, regress


def series(spark, values, ticker="A"):
    days = pd.bdate_range("2000-01-03", periods=len(values)).date
    return spark.createDataFrame(pd.DataFrame({"ticker": ticker, "date": days, "close": np.asarray(values, float)}))


@pytest.mark.parametrize("spans", [(9, 12, 26), (2, 200)])
def test_ema_of_a_long_series(spark, spans):
    x = 100 + np.random.default_rng(1).normal(0, 1, 3000).cumsum()
    got = with_emas(series(spark, x), [("close", f"e{s}", s) for s in spans]).orderBy("date").toPandas()
    for s in spans:
        want = pd.Series(x).ewm(span=s, adjust=False).mean()
        assert np.abs(got[f"e{s}"] - want).max() < 1e-8


def test_rsi_is_null_without_losses(spark):
    got = with_rsi(series(spark, range(100, 130)), "close", "rsi").toPandas()
    assert got["rsi"].isna().all()
    x = 100 + np.random.default_rng(2).normal(0, 1, 80).cumsum()
    got = with_rsi(series(spark, x), "close", "rsi").orderBy("date").toPandas()["rsi"]
    d = pd.Series(x).diff()
    want = 100 - 100 / (1 + d.clip(lower=0).rolling(14).mean() / (-d.clip(upper=0)).rolling(14).mean())
    assert np.nanmax(np.abs(got - want)) < 1e-8


def test_rank_and_quantiles_with_a_hot_group(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": np.where(rng.random(4000) < 0.8, "hot", "cold"), "v": np.round(rng.normal(0, 1, 4000), 1)})
    pdf.loc[:500, "v"] = 0.5
    pdf.loc[10:20, "v"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v"))).withColumn("id", F.monotonically_increasing_id())
    got = with_avg_rank(df, ["k"], "v", "r", "n").toPandas()
    want = pdf.groupby("k")["v"].rank(method="average")
    assert sorted(got["r"].dropna()) == sorted(want.dropna())
    assert got["r"].isna().sum() == pdf["v"].isna().sum()
    probs = [0.0, 0.05, 0.33, 0.5, 1.0]
    edges = {r["k"]: r["edges"] for r in quantile_edges(df, ["k"], "v", probs).collect()}
    for k, part in pdf.dropna().groupby("k"):
        assert np.allclose(edges[k], np.quantile(part["v"], probs))


def test_prefix_sums_over_chunks(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"k": np.where(rng.random(500) < 0.9, "hot", "x"), "d": np.sort(rng.integers(0, 9, 500)), "o": range(500), "v": rng.integers(0, 5, 500).astype(float)})
    got = with_prefix_sums(spark.createDataFrame(pdf), ["k"], "d", ["o"], {"s": F.col("v"), "n": F.lit(1)}).toPandas().sort_values("o")
    assert list(got["s"]) == list(pdf.groupby("k")["v"].cumsum())
    assert list(got["n"]) == list(pdf.groupby("k").cumcount() + 1)


def test_pair_moments_across_blocks(spark):
    rng = np.random.default_rng(5)
    wide = pd.DataFrame(rng.normal(0, 1, (60, 9)), columns=[f"S{i}" for i in range(9)])
    wide.iloc[5:20, 2] = np.nan
    long = wide.stack().reset_index()
    long.columns = ["d", "s", "r"]
    got = pair_moments(spark.createDataFrame(long), "s", "d", "r", block=2).toPandas()
    assert len(got) == 45 and (got["a"] <= got["b"]).all()
    want_cov, want_corr = wide.cov(), wide.corr()
    for row in got.itertuples():
        assert row.cov == pytest.approx(want_cov.loc[row.a, row.b], abs=1e-10)
        assert row.corr == pytest.approx(want_corr.loc[row.a, row.b], abs=1e-10)


def test_normal_distribution_is_double_precise(spark):
    xs = [-38.0, -8.0, -3.2, -1.0, -0.1, 0.0, 0.3, 1.96, 5.0, 7.5, 40.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", norm_cdf(F.col("x")).alias("p")).collect()
    for r in got:
        assert r["p"] == pytest.approx(0.5 * math.erfc(-r["x"] / math.sqrt(2)), abs=2e-15)


def test_product_and_constant_correlation(spark):
    df = spark.createDataFrame([("a", 2.0, 1.0), ("a", -3.0, 1.0), ("b", 0.0, 1.0), ("b", 5.0, 1.0)], "k string, x double, y double")
    got = {r["k"]: r for r in df.groupBy("k").agg(product(F.col("x")).alias("p"), correlation("x", "y").alias("c")).collect()}
    assert got["a"]["p"] == pytest.approx(-6.0) and got["b"]["p"] == 0.0
    assert got["a"]["c"] is None


def fifo_loop(trades):
    lots, out = [], []
    for t in trades:
        if t[1] == "buy":
            lots.append([t[2], t[3]])
            continue
        left = t[2]
        while left > 0 and lots:
            m = min(left, lots[0][0])
            out.append((m, lots[0][1], t[3]))
            lots[0][0] -= m
            left -= m
            if lots[0][0] <= 0:
                lots.pop(0)
    return out, sum(q for q, _ in lots)


def test_fifo_lots_match_a_queue(spark):
    rng = np.random.default_rng(6)
    rows, want, opened = [], [], {}
    for ticker, n in (("HOT", 300), ("B", 40), ("C", 5)):
        trades = [(i, "buy" if rng.random() < 0.48 else "sell", float(rng.integers(1, 60)), float(rng.integers(10, 90))) for i in range(n)]
        got, opened[ticker] = fifo_loop(trades)
        want += [(ticker, *g) for g in got]
        rows += [(i, ticker, a, q, p, f"2024-01-{1 + i * 9 // n:02d}") for i, a, q, p in trades]
    df = spark.createDataFrame(rows, "trade_id long, ticker string, action string, shares double, price double, d string").withColumn("date", F.to_date("d"))
    closed, last = micro.fifo_lots(df)
    got = sorted((r["ticker"], r["shares"], r["entry_price"], r["exit_price"]) for r in closed.collect())
    assert got == sorted(want)
    assert {r["ticker"]: r["open_shares"] for r in last.collect()} == opened


def test_participation_schedule_stops_and_leaves_a_residual(spark):
    df = spark.createDataFrame(
        [("a", 1, i, 100.0, 25.0) for i in range(5)] + [("b", i // 2, i, 100.0, 95.0) for i in range(4)],
        "p string, d int, i int, expected_volume double, total_shares double",
    )
    got = {k: [(r["slice"], r["shares"], r["residual"]) for r in sorted(g, key=lambda r: r["slice"])] for k, g in _by(micro.participation_schedule(df, ("p",), "d", ("i",)).collect(), "p")}
    assert got["a"] == [(1, 10.0, False), (2, 10.0, False), (3, 5.0, False)]
    assert got["b"] == [(1, 10.0, False), (2, 10.0, False), (3, 10.0, False), (4, 10.0, False), (5, 55.0, True)]


def _by(rows, key):
    out = {}
    for r in rows:
        out.setdefault(r[key], []).append(r)
    return out.items()


def test_hold_state_equals_the_loop(spark):
    rng = np.random.default_rng(7)
    s = rng.normal(0, 1, 300)
    days = pd.bdate_range("2001-01-01", periods=300).date
    df = spark.createDataFrame(pd.DataFrame({"a": "X", "b": "Y", "date": days, "spread": s}))
    got = pairs.spread_positions(df, "spread").orderBy("date").toPandas()["position"].to_numpy()
    p = pd.Series(s)
    z = (p - p.rolling(60).mean()) / p.rolling(60).std()
    current, want = 0.0, []
    for v in z:
        if not np.isnan(v):
            current = 0.0 if abs(v) <= 0.5 else -1.0 if v >= 2 else 1.0 if v <= -2 else current
        want.append(current)
    assert list(got) == want


def test_hashed_resampling_is_repeatable_and_inside_the_history(spark):
    x = 100 * np.exp(np.random.default_rng(8).normal(0, 0.01, 200).cumsum())
    bars = series(spark, x)
    one = backtest.bootstrap_scenarios(bars, 10, 300).first()
    two = backtest.bootstrap_scenarios(bars, 10, 300).first()
    assert one == two
    r = x[1:] / x[:-1] - 1
    assert x[-1] * (1 + r.min()) ** 10 <= one["p5"] <= one["p50"] <= one["p95"] <= x[-1] * (1 + r.max()) ** 10
    weak = backtest.bootstrap_scenarios(bars, 10, 300, method="regime_conditioned", condition="Weak").first()
    assert weak["p50"] < one["p50"]
    assert backtest.bootstrap_scenarios(series(spark, x[:20]), 10, 300).count() == 0


def test_adjusted_p_values_rise_with_p(spark):
    ps = [0.01, 0.03, 0.2, None, 0.03, 0.9]
    df = spark.createDataFrame([(i, p, "f") for i, p in enumerate(ps)], "id int, p double, fam string")
    got = {r["id"]: r["adjusted_p"] for r in regress.benjamini_hochberg(df, ("fam",), "p").collect()}
    assert got[3] is None
    assert got[0] == pytest.approx(0.05) and got[1] == got[4] == pytest.approx(0.05) and got[2] == pytest.approx(0.25) and got[5] == pytest.approx(0.9)
