"""Portfolio tables: price matrix, weights, returns, covariance, risk shares, scores, reports.

wSw and w_i(Sw)_i are read off the portfolio's own return series (variance, and covariance
of each holding with it), which needs one pass over holdings instead of a table of pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.expr import clip, correlation, notes, safe_div, truth
from marketloom.functions.gram import pair_moments
from marketloom.functions.rolling import pct_change, rolling_mean, rolling_std, with_position
from marketloom.operators import indicators, risk
from marketloom.session import keep


def by_portfolio():
    return Window.partitionBy("portfolio_id")


def price_matrix(bars: DataFrame) -> DataFrame:
    """Close for every trading date from a ticker's first price on, carried forward.

    A price holds until the day before the ticker's next one; those spans are expanded and
    cut to the trading calendar, so no ticker x date grid is built and re-scanned.
    """
    nxt = F.lead("date").over(Window.partitionBy("ticker").orderBy("date"))
    spans = bars.select("ticker", "date", "close", nxt.alias("_next"))
    last = bars.agg(F.max("date").alias("_last"))  # one row
    upto = F.coalesce(F.date_sub("_next", 1), F.col("_last"))
    days = (
        spans.crossJoin(F.broadcast(last))
        .select("ticker", "close", F.explode(F.sequence(F.col("date"), upto)).alias("date"))
    )
    return days.join(bars.select("date").distinct(), "date", "left_semi")


def matrix_returns(matrix: DataFrame) -> DataFrame:
    return matrix.withColumn("r", pct_change("close"))


def aligned_returns(matrix: DataFrame) -> DataFrame:
    """Returns on the dates where every ticker of the matrix has one."""
    start = matrix.groupBy("ticker").agg(F.min("date").alias("f")).agg(F.max("f").alias("_start"))  # one row
    return (
        matrix_returns(matrix)
        .crossJoin(F.broadcast(start))
        .filter((F.col("date") > F.col("_start")) & F.col("r").isNotNull())
        .drop("_start")
    )


def held_returns(matrix: DataFrame, held: DataFrame, by: str = "portfolio_id") -> DataFrame:
    """Rows of `held` (`by`, ticker, ...) with date and return, on the dates where every ticker of the
    group has one. A ticker that a group does not hold has no part in it."""
    first = matrix.groupBy("ticker").agg(F.min("date").alias("_f"))
    start = held.select(by, "ticker").join(first, "ticker").groupBy(by).agg(F.max("_f").alias("_start"))
    returns = matrix_returns(matrix).select("ticker", "date", "r").filter(F.col("r").isNotNull())
    return held.join(start, by).join(returns, "ticker").filter(F.col("date") > F.col("_start")).drop("_start")


def last_prices(bars: DataFrame) -> DataFrame:
    return bars.groupBy("ticker").agg(F.max_by("close", "date").alias("price"))


def weights(positions: DataFrame, bars: DataFrame) -> DataFrame:
    """Weights from shares x last price; else from explicit weights; else equal."""
    if "weight" not in positions.columns:
        positions = positions.withColumn("weight", F.lit(None).cast("double"))
    priced = positions.withColumnRenamed("weight", "given").join(last_prices(bars), "ticker")
    any_shares = F.max(F.col("shares").isNotNull().cast("int")).over(by_portfolio()) == 1
    any_given = F.max(F.col("given").isNotNull().cast("int")).over(by_portfolio()) == 1
    value = F.when(any_shares, F.col("shares") * F.col("price")).when(any_given, F.col("given")).otherwise(F.lit(1.0))
    valued = priced.withColumn("value", value).filter(F.col("value").isNotNull())
    total = F.sum("value").over(by_portfolio())
    return valued.withColumn(
        "weight", F.when(total > 0, F.col("value") / total).otherwise(1 / F.count(F.lit(1)).over(by_portfolio()))
    )


def portfolio_returns(matrix: DataFrame, wts: DataFrame) -> DataFrame:
    """Weighted daily return from the second date on that any holding has a price; a holding without a
    return that day counts as 0."""
    rows = matrix_returns(matrix).join(wts.select("portfolio_id", "ticker", "weight"), "ticker")
    return (
        rows.groupBy("portfolio_id", "date")
        .agg(F.sum(F.col("weight") * F.coalesce("r", F.lit(0.0))).alias("r"), F.count("r").alias("_returns"))
        .filter(F.col("_returns") > 0)
        .drop("_returns")
    )


def aligned_portfolio_returns(matrix: DataFrame, wts: DataFrame) -> DataFrame:
    rows = held_returns(matrix, wts.select("portfolio_id", "ticker", "weight"))
    return rows.groupBy("portfolio_id", "date").agg(F.sum(F.col("weight") * F.col("r")).alias("r"))


def classify(x: Column, bands: Sequence[tuple[float, str]], otherwise: str, at_least: bool = True) -> Column:
    out = None
    for limit, label in bands:
        cond = x >= limit if at_least else x < limit
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(otherwise)


def classify_volatility(x: Column) -> Column:
    return classify(x, [(0.08, "Very Low"), (0.15, "Low"), (0.25, "Moderate"), (0.40, "High")], "Very High", at_least=False)


def classify_sharpe(x: Column) -> Column:
    return classify(x, [(0.5, "Weak"), (1.0, "Average"), (2.0, "Strong")], "Excellent", at_least=False)


def classify_quality(x: Column) -> Column:
    return classify(x, [(85, "Excellent"), (70, "Good"), (50, "Moderate"), (30, "Weak")], "Poor")


def covariance_pairs(matrix: DataFrame) -> DataFrame:
    return pair_moments(aligned_returns(matrix), "ticker", "date", "r")


def variance_metrics(matrix: DataFrame, wts: DataFrame) -> DataFrame:
    v = F.col("daily_variance")
    out = aligned_portfolio_returns(matrix, wts).groupBy("portfolio_id").agg(F.var_samp("r").alias("daily_variance"))
    out = out.withColumn("monthly_variance", v * 21).withColumn("annual_variance", v * 252).withColumn("daily_volatility", F.sqrt(v))
    out = out.withColumn("monthly_volatility", F.sqrt(v) * F.sqrt(F.lit(21.0))).withColumn(
        "annual_volatility", F.sqrt(v) * F.sqrt(F.lit(252.0))
    )
    return out.withColumn("risk_classification", classify_volatility(F.col("annual_volatility")))


def holding_pairs(matrix: DataFrame, wts: DataFrame) -> DataFrame:
    """Correlation pairs (a < b) of the holdings of each portfolio; no other pair is computed."""
    rows = held_returns(matrix, wts.select("portfolio_id", "ticker"))
    pairs = pair_moments(rows, "ticker", "date", "r", within="portfolio_id")
    return pairs.filter((F.col("a") < F.col("b")) & F.col("corr").isNotNull()).withColumn("correlation", F.round("corr", 4))


def correlation_rows(held_pairs: DataFrame) -> DataFrame:
    """Ranked pairs: rank 1 = highest; low_rank 1 = lowest. Ties fall to the pair's names."""
    names = ("a", "b")
    return (
        held_pairs.withColumn("high_rank", F.row_number().over(by_portfolio().orderBy(F.desc("correlation"), *names)))
        .withColumn("low_rank", F.row_number().over(by_portfolio().orderBy("correlation", *names)))
        .withColumn("redundant", F.col("correlation") >= 0.80)
        .withColumn("diversifier", F.col("correlation") <= 0.30)
    )


def correlation_summary(held_pairs: DataFrame) -> DataFrame:
    c = F.col("correlation")
    return held_pairs.groupBy("portfolio_id").agg(
        F.round(F.avg(c), 4).alias("average_correlation"),
        F.max(c).alias("highest"),
        F.min(c).alias("lowest"),
        F.sum((c >= 0.80).cast("int")).alias("redundant"),
        F.sum((c <= 0.30).cast("int")).alias("diversifiers"),
    )


def risk_contributions(matrix: DataFrame, wts: DataFrame) -> DataFrame:
    """Share of portfolio variance per holding, in percent."""
    whole = aligned_portfolio_returns(matrix, wts).withColumnRenamed("r", "pr")
    out = (
        held_returns(matrix, wts.select("portfolio_id", "ticker", "sector", "weight"))
        .join(whole, ["portfolio_id", "date"])
        .groupBy("portfolio_id", "ticker", "sector", "weight")
        .agg(F.covar_samp("r", "pr").alias("marginal"))
    )
    part = F.col("weight") * F.col("marginal")
    total = F.sum(part).over(by_portfolio())
    return out.withColumn("contribution_pct", F.when(total > 0, F.round(part / total * 100, 2)).otherwise(F.lit(0.0)))


def risk_contribution_rows(contributions: DataFrame) -> DataFrame:
    c = F.col("contribution_pct")
    top = F.row_number().over(by_portfolio().orderBy(F.desc("contribution_pct"), "ticker"))
    return (
        contributions.withColumn("rank", top)
        .withColumn("position_weight_pct", F.round(F.col("weight") * 100, 2))
        .withColumn("concentration_risk", F.when(c >= 35, "High").when(c >= 20, "Medium").otherwise("Low"))
        .withColumn(
            "warning",
            F.when((F.col("rank") == 1) & (c >= 35), F.format_string("%s dominates portfolio risk at %.1f%%.", "ticker", c)),
        )
    )


def network(held_pairs: DataFrame, threshold: float = 0.70) -> tuple[DataFrame, DataFrame]:
    """Edges at or above the threshold, and the nodes they touch."""
    edges = held_pairs.filter(F.col("correlation") >= threshold).withColumn(
        "reason", F.format_string("Correlation %.4f", "correlation")
    )
    nodes = edges.select("portfolio_id", F.explode(F.array("a", "b")).alias("node")).groupBy("portfolio_id", "node").agg(
        F.count(F.lit(1)).alias("degree")
    )
    return edges, nodes


def sector_exposure(wts: DataFrame) -> DataFrame:
    return wts.groupBy("portfolio_id", F.coalesce("sector", F.lit("Unknown")).alias("sector")).agg(F.sum("weight").alias("weight"))


def diversification(wts: DataFrame, correlation: DataFrame) -> DataFrame:
    sectors = sector_exposure(wts).groupBy("portfolio_id").agg(F.max("weight").alias("sector_max"))
    held = wts.groupBy("portfolio_id").agg(
        F.count(F.lit(1)).alias("holdings"),
        F.sum(F.col("weight") * F.col("weight")).alias("hhi"),
        F.max(F.struct(F.round("weight", 12).alias("w"), "ticker")).alias("top"),
    )
    out = held.join(sectors, "portfolio_id").join(correlation, "portfolio_id", "left")
    corr = F.coalesce("average_correlation", F.lit(0.0))
    score = (
        F.least(F.col("holdings") / 20.0, F.lit(1.0)) * 25
        + (1 - F.col("hhi")) * 35
        + F.greatest(F.lit(0.0), 1 - corr) * 25
        + F.greatest(F.lit(0.0), 1 - F.col("sector_max")) * 15
    )
    out = out.withColumn("score", F.round(clip(score, 0, 100), 2))
    return (
        out.withColumn("classification", classify_quality(F.col("score")))
        .withColumn("position_concentration", F.round(F.col("hhi") * 100, 2))
        .withColumn("largest_ticker", F.col("top.ticker"))
        .withColumn("largest_weight", F.round(F.col("top.w") * 100, 2))
        .withColumn("largest_sector_weight", F.round(F.col("sector_max") * 100, 2))
    )


def analytics(matrix: DataFrame, wts: DataFrame, benchmark: DataFrame) -> DataFrame:
    from marketloom.operators.regress import beta_alpha

    series = aligned_portfolio_returns(matrix, wts)
    hhi = wts.groupBy("portfolio_id").agg(F.sum(F.col("weight") * F.col("weight")).alias("hhi"))
    bench = benchmark.withColumn("bench_r", F.col("close") / F.lag("close").over(Window.partitionBy(F.lit(0)).orderBy("date")) - 1)
    beta = beta_alpha(series, bench.select("date", "bench_r"), keys=("portfolio_id",))
    return (
        risk.performance(series, ("portfolio_id",))
        .join(hhi, "portfolio_id")
        .join(beta, "portfolio_id", "left")
        .withColumn("diversification_score", F.round((1 - F.col("hhi")) * 100, 2))
        .withColumn("concentration_risk", F.round(F.col("hhi") * 100, 2))
    )


def drift(wts: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Current against target weight; without a target the portfolio aims at equal weights."""
    equal = 1 / F.count(F.lit(1)).over(by_portfolio())
    target = F.coalesce(F.col("target_weight"), equal) if "target_weight" in wts.columns else equal
    out = wts.withColumn("target", target).withColumn("drift", (F.col("weight") - F.col("target")) * 100)
    return (
        out.withColumn("current_weight_pct", F.round(F.col("weight") * 100, 2))
        .withColumn("target_weight_pct", F.round(F.col("target") * 100, 2))
        .withColumn("drift_pct", F.round("drift", 2))
        .withColumn("status", F.when(F.abs("drift") >= threshold, "rebalance_watch").otherwise("in_band"))
    )


def turnover(current: DataFrame, target: DataFrame) -> DataFrame:
    """Half the absolute weight change over the union of tickers; weights in percent."""
    a = current.select("portfolio_id", "ticker", F.col("weight_pct").alias("a"))
    b = target.select("portfolio_id", "ticker", F.col("weight_pct").alias("b"))
    gap = F.abs(F.coalesce("b", F.lit(0.0)) - F.coalesce("a", F.lit(0.0)))
    return a.join(b, ["portfolio_id", "ticker"], "full_outer").groupBy("portfolio_id").agg((F.sum(gap) / 2).alias("turnover_pct"))


def time_series_rows(series: DataFrame) -> DataFrame:
    """63-row rolling Sharpe and 21-row rolling volatility of a portfolio."""
    k = ("portfolio_id",)
    r = F.col("r")
    return series.withColumn("rolling_vol", rolling_std(r, 21, k) * F.sqrt(F.lit(252.0))).withColumn(
        "rolling_sharpe", safe_div(rolling_mean(r, 63, k), rolling_std(r, 63, k)) * F.sqrt(F.lit(252.0))
    )


def trend_label(series: DataFrame, value: str, keys: Sequence[str], up: str = "Rising", down: str = "Falling") -> DataFrame:
    """Mean of the last 5 against the first 10 of the last 20 defined values, at +-10 %."""
    ranked = with_position(series.filter(F.col(value).isNotNull()), keys)
    first = F.least(F.col("n_rows"), F.lit(20))
    prior = (F.col("rn") <= first) & (F.col("rn") > first - 10)
    out = ranked.filter(F.col("rn") <= 20).groupBy(*keys).agg(
        F.max("n_rows").alias("values"),
        F.avg(F.when(F.col("rn") <= 5, F.col(value))).alias("recent"),
        F.avg(F.when(prior, F.col(value))).alias("prior"),
    )
    return out.withColumn(
        "trend",
        F.when(F.col("values") < 10, "Unknown")
        .when(F.col("recent") > F.col("prior") * 1.10, up)
        .when(F.col("recent") < F.col("prior") * 0.90, down)
        .otherwise("Stable"),
    )


def rolling_correlation(matrix: DataFrame, candidates: DataFrame, n: int = 63) -> DataFrame:
    """Average over pairs of the n-row rolling correlation, per date. `candidates` lists the
    pairs (a, b); the join is on ticker, so work grows with the listed pairs."""
    r = aligned_returns(matrix).select("ticker", "date", "r")
    both = (
        candidates.select("a", "b")
        .join(r.withColumnRenamed("ticker", "a").withColumnRenamed("r", "ra"), "a")
        .join(r.withColumnRenamed("ticker", "b").withColumnRenamed("r", "rb"), ["b", "date"])
    )
    f = Window.partitionBy("a", "b").orderBy("date").rowsBetween(-(n - 1), 0)
    c = F.when(F.count(F.lit(1)).over(f) >= n, correlation("ra", "rb", f))
    return both.withColumn("c", c).groupBy("date").agg(F.avg("c").alias("average_correlation")).filter(F.col("average_correlation").isNotNull())


def rolling_correlation_trend(rolling: DataFrame) -> DataFrame:
    # a top-k of 20 dates, then a ranking of those 20 rows
    tail = rolling.orderBy(F.desc("date")).limit(20)
    rn = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("date")))
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    c = F.col("average_correlation")
    out = tail.withColumn("rn", rn).withColumn("n", n).agg(
        F.max("n").alias("dates"),
        F.avg(F.when(F.col("rn") <= 5, c)).alias("latest"),
        F.avg(F.when(F.col("rn") > F.col("n") - 10, c)).alias("prior"),
    )
    return out.withColumn(
        "trend",
        F.when(F.col("dates") < 5, "Unknown")
        .when(F.col("latest") > F.col("prior") * 1.10, "Rising")
        .when(F.col("latest") < F.col("prior") * 0.90, "Falling")
        .otherwise("Stable"),
    ).withColumn("latest", F.round("latest", 4))


def metrics(positions: DataFrame, bars: DataFrame, rf: float = 0.045) -> DataFrame:
    """One wide row per portfolio that the scores, warnings and reports read."""
    matrix = keep(price_matrix(bars))  # read by every part below
    wts = keep(weights(positions, bars))
    series = keep(portfolio_returns(matrix, wts))
    corr = correlation_summary(holding_pairs(matrix, wts))
    contrib = risk_contributions(matrix, wts).groupBy("portfolio_id").agg(
        F.max(F.struct("contribution_pct", "ticker")).alias("_risk"),
    )
    vol_trend = trend_label(time_series_rows(series), "rolling_vol", ("portfolio_id",)).select("portfolio_id", F.col("trend").alias("volatility_trend"))
    tail = risk.downside_tail(series, ("portfolio_id",), rf).select(
        "portfolio_id", F.col("sortino_ratio").alias("tail_sortino"), "value_at_risk", "conditional_value_at_risk"
    )
    direction = indicators.autocorr(series, ("portfolio_id",)).select("portfolio_id", "risk_direction")
    perf = risk.performance(series, ("portfolio_id",), rf).select("portfolio_id", "cagr", "sharpe_ratio", "max_drawdown")
    return (
        variance_metrics(matrix, wts)
        .join(diversification(wts, corr.select("portfolio_id", "average_correlation")), "portfolio_id")
        .join(contrib, "portfolio_id")
        .join(perf, "portfolio_id")
        .join(tail, "portfolio_id")
        .join(vol_trend, "portfolio_id", "left")
        .join(direction, "portfolio_id", "left")
        .withColumn("top_risk", F.col("_risk.contribution_pct"))
        .withColumn("top_risk_ticker", F.col("_risk.ticker"))
        .withColumnRenamed("score", "diversification_score")
        .drop("top", "_risk", "classification")
    )


def health(m: DataFrame) -> DataFrame:
    vol, sharpe, dd = F.col("annual_volatility"), F.col("sharpe_ratio"), F.abs("max_drawdown")
    corr, div, top = F.col("average_correlation"), F.col("diversification_score"), F.col("top_risk")
    one = F.lit(1.0)
    score = (
        100
        - F.least(vol / 0.50, one) * 20
        + F.least(F.greatest(sharpe, F.lit(0.0)) / 2, one) * 20
        - F.least(dd / 0.40, one) * 20
        - F.least(corr / 0.90, one) * 15
        + div * 0.25
        - F.when(top > 40, 15).when(top > 30, 8).otherwise(0)
    )
    return (
        m.withColumn("health_score", F.round(clip(score, 0, 100), 2))
        .withColumn("health", classify_quality(F.col("health_score")))
        .withColumn(
            "strengths",
            notes((sharpe >= 1, "Strong risk-adjusted return"), (div >= 70, "Diversification profile is healthy"), (dd <= 0.15, "Drawdown has been contained")),
        )
        .withColumn(
            "weaknesses",
            notes(
                (~truth(sharpe >= 1), "Sharpe ratio is not yet strong"),
                (~truth(div >= 70), "Diversification can improve"),
                (~truth(dd <= 0.15), "Drawdown risk is meaningful"),
                (top > 35, "One position contributes too much portfolio risk"),
            ),
        )
    )


def warnings_and_trigger(m: DataFrame) -> DataFrame:
    """Warning texts, and the strongest trigger at the first place among equals."""
    text = F.format_string
    out = m.withColumn(
        "warnings",
        notes(
            (F.col("top_risk") >= 35, text("%s contributes %.1f%% of portfolio variance.", "top_risk_ticker", "top_risk")),
            (F.col("largest_weight") >= 20, text("%s is %.1f%% of portfolio value.", "largest_ticker", "largest_weight")),
            (F.col("largest_sector_weight") >= 35, text("Largest sector exposure is %.1f%%.", "largest_sector_weight")),
            (F.col("average_correlation") >= 0.65, text("Average holding correlation is elevated at %.2f.", "average_correlation")),
            (F.col("conditional_value_at_risk") <= -0.03, text("Historical one-day CVaR is %.2f%%.", F.col("conditional_value_at_risk") * 100)),
        ),
    )
    rules = [
        (F.col("volatility_trend") == "Rising", "Portfolio volatility spike", 75),
        (F.col("correlation_trend") == "Rising", "Correlation spike", 75),
        (F.col("diversification_score") < 50, "Diversification weakness", 65),
        (F.col("top_risk") >= 40, "Risk concentration", 80),
        (F.col("risk_direction") == "Increasing", "Forecasted volatility increase", 70),
    ]
    if "correlation_trend" not in m.columns:
        rules = [r for r in rules if r[1] != "Correlation spike"]
    found = F.array_compact(
        F.array(
            *[
                F.when(truth(c), F.struct(F.lit(s).alias("strength"), F.lit(-i).alias("place"), F.lit(t).alias("reason")))
                for i, (c, t, s) in enumerate(rules)
            ]
        )
    )
    best = F.array_max("triggers")
    return (
        out.withColumn("triggers", found)
        .withColumn("send_alert", F.size("triggers") > 0)
        .withColumn("reason", F.coalesce(best["reason"], F.lit("No clear portfolio Why Now trigger")))
        .withColumn("strength", F.coalesce(best["strength"], F.lit(0)))
    )


def attribution(m: DataFrame, benchmark_pct: DataFrame, momentum_exposure: DataFrame) -> DataFrame:
    """Benchmark, sector, factor and unexplained part of the portfolio return, in points."""
    ret = F.when(F.abs("cagr") <= 1, F.col("cagr") * 100).otherwise(F.col("cagr"))
    sector = F.col("largest_sector_weight") - 25
    factor = F.col("momentum") - 50
    return (
        m.crossJoin(F.broadcast(benchmark_pct))  # one row
        .join(momentum_exposure, "portfolio_id", "left")
        .withColumn("momentum", F.coalesce("momentum", F.lit(50.0)))
        .withColumn("relative", ret - F.col("benchmark_return_pct"))
        .withColumn("sector_allocation_effect", F.when(sector > 0, F.round(sector * 0.03, 2)).otherwise(F.lit(0.0)))
        .withColumn("factor_exposure_effect", F.round(factor * 0.05, 2))
        .withColumn(
            "alpha_unexplained_return",
            F.round(F.col("relative") - factor * 0.05 - F.greatest(sector, F.lit(0.0)) * 0.03, 2),
        )
    )


def assumption_checks(m: DataFrame, regime: DataFrame) -> DataFrame:
    vol, corr = F.col("annual_volatility"), F.col("average_correlation")
    checks = F.array(
        F.struct(
            F.lit("volatility").alias("assumption"),
            F.when(vol >= 0.35, "Breaking").when(vol >= 0.25, "Watch").otherwise("OK").alias("status"),
            F.format_string("Portfolio annual volatility is %.1f%%.", vol * 100).alias("evidence"),
        ),
        F.struct(
            F.lit("correlation").alias("assumption"),
            F.when(corr >= 0.75, "Breaking").when(corr >= 0.60, "Watch").otherwise("OK").alias("status"),
            F.format_string("Average correlation is %.2f.", corr).alias("evidence"),
        ),
        F.struct(
            F.lit("regime").alias("assumption"),
            F.when(F.col("regime").isin("Crash", "High Volatility", "Bear Trend"), "Watch").otherwise("OK").alias("status"),
            F.concat(F.lit("Current regime is "), F.col("regime"), F.lit(".")).alias("evidence"),
        ),
    )
    return m.crossJoin(F.broadcast(regime)).select("portfolio_id", F.inline(checks))  # regime is one row


def score_candidates(matrix: DataFrame, candidates: DataFrame, rf: float = 0.045, step: float = 0.01) -> DataFrame:
    """Return, volatility and Sharpe of each candidate weight vector (set_id, ticker, weight);
    flags the best Sharpe and the best return per volatility bucket."""
    series = (
        held_returns(matrix, candidates, "set_id")
        .groupBy("set_id", "date")
        .agg(F.sum(F.col("weight") * F.col("r")).alias("r"))
    )
    out = series.groupBy("set_id").agg(
        (F.avg("r") * 252).alias("annual_return"), F.sqrt(F.greatest(F.var_samp("r") * 252, F.lit(1e-12))).alias("annual_volatility")
    )
    out = out.withColumn("sharpe", (F.col("annual_return") - rf) / F.col("annual_volatility")).withColumn(
        "vol_bucket", F.floor(F.round(F.col("annual_volatility"), 9) / step)
    )
    best = out.agg(F.max(F.struct(F.round("sharpe", 9).alias("s"), "set_id"))["set_id"].alias("best_set"))
    front = out.groupBy("vol_bucket").agg(F.max(F.struct(F.round("annual_return", 9).alias("x"), "set_id"))["set_id"].alias("front_set"))
    return (
        out.crossJoin(F.broadcast(best))  # one row
        .join(front, "vol_bucket")
        .withColumn("is_best", F.col("set_id") == F.col("best_set"))
        .withColumn("on_frontier", F.col("set_id") == F.col("front_set"))
    )


def portfolio_fit(universe: DataFrame, wts: DataFrame) -> DataFrame:
    """Assessment of every (portfolio, universe ticker): held, crowding a sector, or a diversifier.
    `universe` carries portfolio_id, ticker and sector."""
    held = wts.select("portfolio_id", "ticker", F.lit(True).alias("held"))
    sectors = sector_exposure(wts).select("portfolio_id", "sector", F.round(F.col("weight") * 100, 2).alias("sector_weight"))
    return (
        universe.join(held, ["portfolio_id", "ticker"], "left")
        .join(sectors, ["portfolio_id", "sector"], "left")
        .withColumn("sector_weight", F.coalesce("sector_weight", F.lit(0.0)))
        .withColumn(
            "assessment",
            F.when(truth(F.col("held")), "Already held; monitor risk contribution and thesis quality.")
            .when(F.col("sector_weight") > 35, "May increase sector concentration risk.")
            .otherwise("Potential diversifier; evaluate correlation and volatility before adding."),
        )
    )


def positions_pnl(positions: DataFrame, bars: DataFrame) -> DataFrame:
    px, cost, sh = F.col("price"), F.col("cost_basis"), F.col("shares")
    return (
        positions.join(last_prices(bars), "ticker", "left")
        .withColumn("market_value", sh * px)
        .withColumn("unrealized_pnl", (px - cost) * sh)
        .withColumn("unrealized_return_pct", F.when((cost != 0) & (px != 0), px / cost - 1))
        .withColumn("data_quality", F.when(sh.isNotNull() & cost.isNotNull(), "actual_position").otherwise("model_weight_only"))
    )
