"""Expected value and probability tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions.expr import clip, norm_cdf, safe_div, truth


def ev_weighted(outcomes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Probability-weighted payoff per group; a group whose probabilities do not sum to one (or
    lie outside 0..1) is rejected and keeps a null value."""
    p = F.col("probability")
    out = outcomes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("outcomes"), F.sum("probability").alias("probability_sum"), F.sum(p * F.col("payoff")).alias("_ev"), F.min(p).alias("_lo"), F.max(p).alias("_hi")
    )
    ok = (F.abs(F.col("probability_sum") - 1) <= 1e-6) & (F.col("_lo") >= 0) & (F.col("_hi") <= 1)
    return out.withColumn("accepted", ok).withColumn("expected_value", F.when(ok, F.col("_ev"))).drop("_ev", "_lo", "_hi")


def ev_trades(trades: DataFrame, keys: Sequence[str], ret: str = "ret", cost_per_trade: float = 0.0, cost: float = 0.0, slippage: float = 0.0) -> DataFrame:
    """Mean net return, win rate, binary value from mean win and loss, and value after costs."""
    v = F.col(ret) - cost_per_trade
    out = trades.groupBy(*keys).agg(
        F.count(ret).alias("trade_count"),
        F.avg(v).alias("strategy_ev"),
        F.avg((v > 0).cast("double")).alias("win_rate"),
        F.coalesce(F.avg(F.when(v > 0, v)), F.lit(0.0)).alias("average_win"),
        F.coalesce(F.avg(F.when(v <= 0, v)), F.lit(0.0)).alias("average_loss"),
    )
    w = F.col("win_rate")
    out = out.withColumn("simple_ev", w * F.col("average_win") + (1 - w) * F.col("average_loss"))
    out = out.withColumn("trade_ev", w * F.col("average_win") - (1 - w) * F.abs("average_loss") - cost)
    return out.withColumn("ev_after_cost", F.col("strategy_ev") - cost).withColumn("ev_after_slippage", F.col("strategy_ev") - slippage)


def ev_portfolio(weights: DataFrame, expected: DataFrame) -> DataFrame:
    """Sum of weight x expected return; a portfolio with a missing return lists the tickers and
    has no value. `expected`: ticker, expected_return."""
    both = weights.select("portfolio_id", "ticker", "weight").join(expected.select("ticker", "expected_return"), "ticker", "left")
    none = F.col("expected_return").isNull()
    out = both.groupBy("portfolio_id").agg(
        F.sum(none.cast("int")).alias("missing_count"),
        F.array_sort(F.collect_list(F.when(none, F.col("ticker")))).alias("missing"),
        F.sum(F.col("weight") * F.col("expected_return")).alias("_v"),
    )
    return out.withColumn("expected_value", F.when(F.col("missing_count") == 0, F.col("_v"))).drop("_v")


def event_rate(rows: DataFrame, keys: Sequence[str], event: Column, condition: Column) -> DataFrame:
    """Frequency of an event, its probability given a condition, the posterior from Bayes' rule
    on the counted likelihoods, and the event probability less the condition's drag."""
    e, c = truth(event), truth(condition)
    one = lambda x: F.sum(x.cast("long"))
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trials"), one(e).alias("successes"), one(c).alias("conditions"), one(e & c).alias("joint"), one(~e & c).alias("joint_false")
    )
    n = F.col("trials")
    prior = F.col("successes") / n
    lt, lf = safe_div(F.col("joint"), F.col("successes")), safe_div(F.col("joint_false"), n - F.col("successes"))
    return (
        out.withColumn("event_probability", prior)
        .withColumn("conditional_probability", F.least(F.lit(1.0), safe_div(F.col("joint") / n, F.col("conditions") / n)))
        .withColumn("bayes_posterior", safe_div(lt * prior, lt * prior + lf * (1 - prior)))
        .withColumn("probability_of_profit", F.greatest(F.lit(0.0), prior - F.col("conditions") / n))
    )


# fixed values: horizon name and rows
HORIZONS = (("1 week", 5), ("1 month", 21), ("3 months", 63))
TARGETS = (0.05, 0.10)


def cross_grid(assets: DataFrame, horizons: Sequence[tuple[str, int]] = HORIZONS, targets: Sequence[float] = TARGETS) -> DataFrame:
    """Every asset with every (horizon, target); the grid is a literal list expanded in place."""
    cells = [F.struct(F.lit(h).alias("horizon"), F.lit(d).alias("days"), F.lit(float(t)).alias("target")) for h, d in horizons for t in targets]
    return assets.select("*", F.inline(F.array(*cells)))


def target_probabilities(grid: DataFrame) -> DataFrame:
    """Normal chances of ending above +target and below -target, and the logistic variant.
    Needs annual `expected_return` and `volatility`."""
    scale = F.col("days") / 252.0
    mean, sd = F.col("expected_return") * scale, F.col("volatility") * F.sqrt(scale)
    z = lambda x: safe_div(x - F.col("_m"), F.col("_s"))
    logistic = lambda edge: F.when(F.col("_s") <= 0, F.lit(0.0)).otherwise(
        clip(100 / (1 + F.pow(F.lit(2.71828), -1.7 * safe_div(edge - F.col("target"), F.col("_s")))), 0.0, 100.0)
    )
    return (
        grid.withColumn("_m", mean)
        .withColumn("_s", sd)
        .withColumn("probability_above_target", 1 - norm_cdf(z(F.col("target"))))
        .withColumn("probability_below_negative_target", norm_cdf(z(-F.abs("target"))))
        .withColumn("logistic_up", logistic(F.col("_m")))
        .withColumn("logistic_down", logistic(-F.col("_m")))
        .drop("_m", "_s")
    )


def confidence_score(sample: Column, quality: Column, stability: Column) -> Column:
    return 0.4 * F.least(sample / 100, F.lit(1.0)) + 0.35 * quality + 0.25 * stability


def uncertainty_score(missing: Column, volatility: Column, disagreement: Column) -> Column:
    return clip(0.35 * missing + 0.35 * volatility + 0.30 * disagreement, 0.0, 1.0)
