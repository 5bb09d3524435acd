"""Grouped performance and risk statistics of return series (columns: keys, date, r)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.expr import product, safe_div
from marketloom.functions.rolling import with_position
from marketloom.operators import indicators

ROOT = math.sqrt(252.0)
# fixed values: window label and rows
RISK_WINDOWS = (("3M", 63), ("6M", 126), ("1Y", 252), ("3Y", 756))
# fixed values: scenario, shock (a null shock is -0.35 x portfolio volatility)
SCENARIOS = (
    ("Market falls 10%", -0.10),
    ("Market rises 10%", 0.10),
    ("Volatility doubles", None),
    ("Interest rates rise", -0.04),
    ("Interest rates fall", 0.035),
    ("Oil rises 20%", -0.015),
    ("Tech sector sells off", -0.08),
    ("Recession scenario", -0.18),
    ("2008-style crisis", -0.35),
    ("COVID-style crash", -0.28),
    ("2022 inflation shock", -0.20),
)
# fixed values: historical event, scenario it is read from
STRESS_EVENTS = (
    ("2008 financial crisis", "2008-style crisis"),
    ("COVID crash", "COVID-style crash"),
    ("Dot-com crash", "Tech sector sells off"),
    ("2022 inflation bear market", "2022 inflation shock"),
    ("Black Monday-style shock", "Market falls 10%"),
)


def cagr_of(growth: Column, n: Column) -> Column:
    return F.when((n > 0) & (growth > 0), F.pow(growth, 252.0 / n) - 1).otherwise(F.lit(0.0))


def performance(returns: DataFrame, keys: Sequence[str] = ("ticker",), rf: float = 0.0) -> DataFrame:
    """CAGR, Sharpe, Sortino, drawdown, Calmar, win rate and profit factor in one aggregate."""
    path = indicators.drawdown(returns, keys)
    r = F.col("r")
    ex = r - rf / 252.0
    out = path.groupBy(*keys).agg(
        F.count("r").alias("sample_size"),
        product(1 + r).alias("growth"),
        F.avg(ex).alias("mean_excess"),
        F.stddev_samp(ex).alias("sd"),
        F.stddev_samp(F.when(ex < 0, ex)).alias("sd_down"),
        F.min("drawdown").alias("max_drawdown"),
        F.avg((r > 0).cast("double")).alias("win_rate"),
        F.sum(F.when(r > 0, r).otherwise(0.0)).alias("gains"),
        F.abs(F.sum(F.when(r < 0, r).otherwise(0.0))).alias("losses"),
    )
    zero = F.lit(0.0)
    out = out.withColumn("cagr", cagr_of(F.col("growth"), F.col("sample_size")))
    out = out.withColumn("volatility", F.col("sd")).withColumn("annualized_volatility", F.col("sd") * ROOT)
    out = out.withColumn("sharpe_ratio", F.coalesce(ROOT * safe_div(F.col("mean_excess"), F.col("sd")), zero))
    out = out.withColumn("sortino_ratio", F.coalesce(ROOT * safe_div(F.col("mean_excess"), F.col("sd_down")), zero))
    out = out.withColumn("calmar_ratio", F.coalesce(safe_div(F.col("cagr"), F.abs("max_drawdown")), zero))
    return out.withColumn("profit_factor", F.coalesce(safe_div(F.col("gains"), F.col("losses")), zero)).drop("sd", "sd_down")


def performance_report(returns: DataFrame, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    cols = ("cagr", "sharpe_ratio", "sortino_ratio", "max_drawdown", "win_rate", "profit_factor")
    return performance(returns, keys).select(*keys, "sample_size", *[F.round(c, 4).alias(c) for c in cols])


def sharpe_engine(returns: DataFrame, keys: Sequence[str], rf: float = 0.045) -> DataFrame:
    from marketloom.operators.portfolio import classify_sharpe

    return performance(returns, keys, rf).withColumn("classification", classify_sharpe(F.col("sharpe_ratio")))


def var_cvar(returns: DataFrame, keys: Sequence[str] = ("ticker",), confidence: float = 0.95) -> DataFrame:
    """Linear-percentile VaR and the mean of the returns at or below it. The percentile state
    is one series of daily returns, bounded by its dates."""
    var = F.percentile("r", F.lit(1 - confidence)).over(Window.partitionBy(*keys))
    near = F.col("r") <= F.col("value_at_risk") + 1e-12
    return (
        returns.withColumn("value_at_risk", var)
        .groupBy(*keys)
        .agg(F.max("value_at_risk").alias("value_at_risk"), F.avg(F.when(near, F.col("r"))).alias("expected_shortfall"))
    )


def downside_tail(returns: DataFrame, keys: Sequence[str], rf: float = 0.045, confidence: float = 0.95) -> DataFrame:
    under = F.least(F.col("r") - rf / 252.0, F.lit(0.0))
    stats = returns.groupBy(*keys).agg(
        F.count("r").alias("sample_size"),
        product(1 + F.col("r")).alias("growth"),
        (F.sqrt(F.avg(under * under)) * ROOT).alias("downside_deviation"),
    )
    stats = stats.withColumn("cagr", cagr_of(F.col("growth"), F.col("sample_size")))
    tail = var_cvar(returns, keys, confidence).withColumnRenamed("expected_shortfall", "conditional_value_at_risk")
    return stats.join(tail, list(keys)).withColumn(
        "sortino_ratio", F.coalesce(safe_div(F.col("cagr") - rf, F.col("downside_deviation")), F.lit(0.0))
    )


def risk_windows(returns: DataFrame, windows: Sequence[tuple[str, int]] = RISK_WINDOWS, least: int = 63) -> DataFrame:
    """One row per (ticker, window) over the last rows of the window; a row is listed once per
    window it falls in, so the fan-out is the number of windows."""
    ranked = with_position(returns).filter(F.col("n_rows") >= least)
    spec = F.explode(F.array(*[F.struct(F.lit(w).alias("window"), F.lit(d).alias("days")) for w, d in windows]))
    listed = ranked.withColumn("_w", spec).select("ticker", "date", "r", "rn", "_w.*").filter(F.col("rn") <= F.col("days"))
    keys = ("ticker", "window")
    path = indicators.drawdown(listed, keys).withColumn("drawdown", F.round("drawdown", 12))
    r = F.col("r")
    stats = path.groupBy(*keys).agg(
        F.count("r").alias("observations"),
        (F.avg("r") * 252).alias("annual_return"),
        (F.stddev_samp("r") * ROOT).alias("annual_vol"),
        (F.stddev_samp(F.when(r < 0, r)) * ROOT).alias("downside_deviation"),
        F.min("drawdown").alias("max_drawdown"),
        F.avg((r > 0).cast("double")).alias("consistency"),
        F.percentile("r", F.lit(0.05)).alias("tail_5pct"),
    )
    stats = stats.join(indicators.recovery_time(path, keys), list(keys))
    flat = F.coalesce(F.col("annual_vol"), F.lit(0.0)) == 0
    down = F.col("downside_deviation")
    out = stats.withColumn("sharpe", safe_div(F.col("annual_return"), F.col("annual_vol"))).withColumn(
        "sortino", F.when(down > 0, F.col("annual_return") / down)
    )
    for c in ("sharpe", "sortino", "max_drawdown", "downside_deviation", "consistency", "recovery_time", "tail_5pct"):
        out = out.withColumn(c, F.when(~flat, F.col(c)))
    return out


def risk_headline(windows: DataFrame) -> DataFrame:
    """Conclusion per ticker from its shortest window."""
    head = windows.filter(F.col("window") == "3M")
    s, so, dd = F.col("sharpe"), F.col("sortino"), F.col("max_drawdown")
    longest = windows.groupBy("ticker").agg(F.max("observations").alias("returns"))
    return (
        head.join(longest, "ticker")
        .withColumn(
            "conclusion",
            F.when(s.isNull(), "Risk-Adjusted Consistency: Unavailable")
            .when((s > 1) & (so > 1), "Risk-Adjusted Consistency: Strong but descriptive only.")
            .when(dd < -0.2, "Risk-Adjusted Consistency: Weak due to meaningful drawdowns.")
            .otherwise("Risk-Adjusted Consistency: Mixed."),
        )
        .withColumn(
            "confidence",
            F.when(s.isNull(), "Low").when((s > 1) & (so > 1), "Medium").when(dd < -0.2, "Medium").when(F.col("returns") >= 126, "Medium").otherwise("Low"),
        )
    )


def momentum_horizons(bars: DataFrame, horizons: Sequence[int] = (63, 126, 252, 504)) -> DataFrame:
    """Latest multi-horizon returns and the share of positive ones x 100."""
    ranked = with_position(bars).filter(F.col("rn").isin(1, *[h + 1 for h in horizons]))
    px = lambda n: F.max(F.when(F.col("rn") == n, F.col("close")))
    out = ranked.groupBy("ticker").agg(*[(px(1) / px(h + 1) - 1).alias(f"ret_{h}") for h in horizons])
    hits = sum(F.when(F.coalesce(F.col(f"ret_{h}") > 0, F.lit(False)), 100.0 / len(horizons)).otherwise(0.0) for h in horizons)
    out = out.withColumn("momentum_score", F.round(hits, 2))
    return out.select("ticker", "momentum_score", *[F.coalesce(f"ret_{h}", F.lit(0.0)).alias(f"ret_{h}") for h in horizons])


def period_returns(bars: DataFrame) -> DataFrame:
    spans = (("daily", 1), ("weekly", 5), ("monthly", 21), ("annual", 252))
    ranked = with_position(bars).filter(F.col("rn").isin(1, *[n + 1 for _, n in spans]))
    px = lambda n: F.max(F.when(F.col("rn") == n, F.col("close")))
    return ranked.groupBy("ticker").agg(*[F.coalesce(px(1) / px(n + 1) - 1, F.lit(0.0)).alias(name) for name, n in spans])


def quant_score(a: DataFrame) -> DataFrame:
    """Points for momentum, trend stack, Sharpe, drawdown, volume spike and volatility."""
    sh, dd = F.col("sharpe_ratio"), F.col("max_drawdown")
    stack = (F.col("sma200") > 0) & (F.col("sma20") > F.col("sma50")) & (F.col("sma50") > F.col("sma200"))
    pts = (
        F.when(F.col("momentum_score") >= 75, 25).when(F.col("momentum_score") >= 50, 15).otherwise(0)
        + F.when(stack, 20).otherwise(0)
        + F.when(sh > 1, 20).when(sh > 0, 10).otherwise(0)
        + F.when(dd > -0.2, 15).when(dd > -0.35, 8).otherwise(0)
        + F.when(F.col("volume_spike"), 10).otherwise(0)
        + F.when(F.coalesce("annualized_volatility", F.lit(1.0)) <= 0.45, 10).otherwise(0)
    )
    return a.withColumn("quant_score", pts).withColumn(
        "quant_label",
        F.when(pts >= 75, "Research priority").when(pts >= 55, "Watch closely").when(pts >= 35, "Neutral").otherwise("High risk / weak setup"),
    )


def stock_analysis(bars: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per ticker: period returns, risk, market beta, trend, momentum, volume, score.
    Every part is grouped by ticker, so the joins reuse one partitioning."""
    from marketloom.operators.regress import beta_alpha, market_returns

    returns = indicators.daily_returns(bars)
    perf = performance(returns).drop("growth", "mean_excess", "gains", "losses")
    beta = beta_alpha(returns, market_returns(benchmark))
    latest = (
        with_position(indicators.relative_volume(indicators.ema(indicators.sma(bars))))
        .filter(F.col("rn") == 1)
        .select("ticker", "close", "sma20", "sma50", "sma200", "ema20", "ema50", "ema200", "vol_avg", "rv", "volume_spike")
    )
    regime = indicators.vol_regime(returns).select("ticker", F.col("regime").alias("volatility_regime"))
    out = period_returns(bars)
    for part in (perf, beta, latest, momentum_horizons(bars), regime):
        out = out.join(part, "ticker", "left")
    return quant_score(out)


def factor_decomposition(a: DataFrame) -> DataFrame:
    """Market, momentum, volatility-drag and alpha components and their share of the absolute sum."""
    market, alpha = F.col("capm_expected_return"), F.col("alpha")
    mom = F.greatest(F.col("ret_252"), F.lit(0.0)) * 0.25
    drag = -F.greatest(F.col("annualized_volatility") - 0.25, F.lit(0.0)) * 0.20
    out = a.withColumn("market_component", market).withColumn("momentum_component", mom)
    out = out.withColumn("volatility_drag", drag).withColumn("alpha_component", alpha)
    names = ("market_component", "momentum_component", "volatility_drag", "alpha_component")
    total = F.aggregate(F.array(*[F.abs(n) for n in names]), F.lit(0.0), lambda x, y: x + y)
    out = out.withColumn("_total", F.when(total == 0, F.lit(1.0)).otherwise(total))
    for n in names:
        out = out.withColumn(n.split("_")[0] + "_pct", F.round(F.abs(n) / F.col("_total") * 100, 2))
    return out.drop("_total")


def market_snapshot(snapshots: DataFrame, proxies: Sequence[str]) -> DataFrame:
    out = snapshots.filter(F.col("ticker").isin(*proxies)).agg(
        F.count("daily_change_pct").alias("proxies"), F.avg("daily_change_pct").alias("average_change")
    )
    c = F.col("average_change")
    return out.withColumn(
        "condition",
        F.when(c.isNull(), "Unavailable").when(c > 0.003, "Supportive").when(c < -0.003, "Weak").otherwise("Mixed"),
    )


def scenario_table(portfolios: DataFrame) -> DataFrame:
    """Every fixed shock per portfolio; the scenario list is a literal array, exploded in place.
    Needs portfolio_id, annual_volatility and `top3` (names joined in order)."""
    vol = F.col("annual_volatility")
    spec = F.explode(
        F.array(
            *[
                F.struct(F.lit(name).alias("scenario"), (F.lit(float(s)) if s is not None else -vol * 0.35).alias("shock"))
                for name, s in SCENARIOS
            ]
        )
    )
    s = F.col("shock")
    return (
        portfolios.withColumn("_s", spec)
        .select("*", "_s.*")
        .withColumn("estimated_return", F.round(s * 100, 2))
        .withColumn("estimated_drawdown", F.round(F.least(s * 1.25, s) * 100, 2))
        .withColumn("estimated_vol_change", F.round(F.abs(s) * 100 + vol * 25, 2))
        .drop("_s")
    )


def stress_events(scenarios: DataFrame) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(e).alias("event"), F.lit(s).alias("source")) for e, s in STRESS_EVENTS]))
    return scenarios.withColumn("_e", pairs).select("*", "_e.*").filter(F.col("source") == F.col("scenario"))
