"""Cross-sectional ranks and factor scores, sector tables, breadth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.expr import clip, notes, safe_div, truth
from marketloom.functions.ranks import with_avg_rank
from marketloom.functions.rolling import with_position

# fixed values: factor weights, and the inputs of each factor with "higher is better"
FACTOR_WEIGHTS = {"momentum": 0.25, "quality": 0.22, "growth": 0.20, "value": 0.18, "low_volatility": 0.15}
FACTOR_INPUTS: dict[str, tuple[tuple[str, bool], ...]] = {
    "momentum": (("return_12m_ex_1m", True), ("return_6m", True), ("relative_strength", True)),
    "value": (("forward_pe", False), ("price_to_book", False), ("ev_to_ebitda", False), ("fcf_yield", True)),
    "quality": (
        ("return_on_equity", True), ("return_on_invested_capital", True), ("gross_margin", True),
        ("operating_margin", True), ("debt_to_equity", False),
    ),
    "growth": (("revenue_growth", True), ("earnings_growth", True), ("free_cashflow_growth", True), ("analyst_revision", True)),
    "low_volatility": (("annualized_volatility", False), ("maximum_drawdown", True), ("downside_deviation", False)),
}


def pct_rank_avg(df: DataFrame, keys: Sequence[str], value: str, out: str, inverse: str | None = None) -> DataFrame:
    """Percentile rank 0..100 within the keys, ties averaged, nulls unranked; `inverse` names a
    second column for inputs where lower is better (100 minus the rank)."""
    ranked = with_avg_rank(df, keys, value, "_rank", "_count")
    pct = F.col("_rank") / F.col("_count") * 100
    ranked = ranked.withColumn(out, pct)
    if inverse is not None:
        ranked = ranked.withColumn(inverse, 100 - F.col(out))
    return ranked.drop("_rank", "_count")


def price_inputs(bars: DataFrame, mrs: DataFrame, risk: DataFrame) -> DataFrame:
    """Factor inputs that come from prices; `mrs`: ticker, relative_strength; `risk`: ticker,
    annualized_volatility, maximum_drawdown, downside_deviation."""
    ranked = with_position(bars).filter(F.col("rn").isin(1, 22, 127, 253))
    px = lambda n: F.max(F.when(F.col("rn") == n, F.col("close")))
    out = ranked.groupBy("ticker").agg((px(22) / px(253) - 1).alias("return_12m_ex_1m"), (px(1) / px(127) - 1).alias("return_6m"))
    return out.join(mrs, "ticker", "left").join(risk, "ticker", "left")


def factor_scores(features: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean of the available input ranks per factor, weighted composite (a missing factor counts
    as 50) and input coverage. One long table of inputs is ranked in a single pass."""
    group = list(keys)
    items = []
    for factor, inputs in FACTOR_INPUTS.items():
        for name, up in inputs:
            if name in features.columns:
                items.append(
                    F.struct(F.lit(factor).alias("factor"), F.lit(name).alias("input"), F.lit(up).alias("up"), F.col(name).cast("double").alias("value"))
                )
    long = features.select(*group, "ticker", F.inline(F.array(*items)))
    ranked = with_avg_rank(long, [*group, "input"], "value", "_rank", "_count")
    pct = F.col("_rank") / F.col("_count") * 100
    scored = ranked.withColumn("score", F.when(F.col("up"), pct).otherwise(100 - pct))
    wide = (
        scored.groupBy(*group, "ticker")
        .agg(
            *[F.avg(F.when(F.col("factor") == f, F.col("score"))).alias(f) for f in FACTOR_WEIGHTS],
            *[F.avg(F.when(F.col("factor") == f, F.col("score").isNotNull().cast("double"))).alias(f"_c_{f}") for f in FACTOR_WEIGHTS],
        )
    )
    composite = sum(F.coalesce(f, F.lit(50.0)) * w for f, w in FACTOR_WEIGHTS.items())
    coverage = sum(F.coalesce(f"_c_{f}", F.lit(0.0)) for f in FACTOR_WEIGHTS) / len(FACTOR_WEIGHTS)
    return wide.withColumn("composite", composite).withColumn("coverage", coverage).drop(*[f"_c_{f}" for f in FACTOR_WEIGHTS])


def semi_weights(weights: DataFrame, scored: DataFrame) -> DataFrame:
    """Weights of scored tickers only, renormalised per portfolio."""
    kept = weights.join(scored.select("ticker"), "ticker", "left_semi")
    return kept.withColumn("weight", safe_div(F.col("weight"), F.sum("weight").over(Window.partitionBy("portfolio_id"))))


def portfolio_exposure(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """One row per (portfolio, factor): exposure, largest holder and its share, warnings."""
    held = semi_weights(weights.select("portfolio_id", "ticker", "weight"), scores).join(scores, "ticker")
    items = F.array(*[F.struct(F.lit(f).alias("factor"), F.coalesce(F.round(F.round(f, 9), 1), F.lit(50.0)).alias("score")) for f in FACTOR_WEIGHTS])
    rows = held.select("portfolio_id", "ticker", "weight", F.inline(items)).withColumn("contribution", F.round(F.col("weight") * F.col("score"), 9))
    out = rows.groupBy("portfolio_id", "factor").agg(
        F.sum("contribution").alias("exposure"),
        F.max(F.struct(F.abs("contribution").alias("c"), F.col("ticker"))).alias("_top"),
        F.sum(F.abs("contribution")).alias("_total"),
    )
    by = Window.partitionBy("portfolio_id")  # five factors
    share = safe_div(F.col("_top.c"), F.col("_total"))
    return (
        out.withColumn("top_holder", F.col("_top.ticker"))
        .withColumn("top_share", share)
        .withColumn("concentration_score", F.max("exposure").over(by) - F.min("exposure").over(by))
        .withColumn(
            "warnings",
            notes(
                (F.col("exposure") >= 75, F.concat(F.lit("Portfolio has a strong "), F.col("factor"), F.lit(" tilt."))),
                (share >= 0.35, F.concat(F.col("top_holder"), F.lit(" supplies at least 35% of portfolio "), F.col("factor"), F.lit(" exposure."))),
            ),
        )
        .drop("_top", "_total")
    )


def tilt_share(exposures: DataFrame) -> DataFrame:
    """Distance from neutral as a share of all factors, with extreme-tilt flags."""
    gap = F.abs(F.col("exposure") - 50)
    total = F.sum(gap).over(Window.partitionBy("portfolio_id"))
    return exposures.withColumn("share_pct", F.coalesce(safe_div(gap, total) * 100, F.lit(0.0))).withColumn(
        "extreme", (F.col("exposure") >= 75) | (F.col("exposure") <= 25)
    )


def style(scores: DataFrame) -> DataFrame:
    at = lambda c: F.coalesce(F.round(c, 9), F.lit(50.0))
    g, v = at("growth"), at("value")
    return scores.withColumn(
        "style",
        F.when(g >= v + 10, "Growth").when(v >= g + 10, "Value").when(at("quality") >= 70, "Quality").when(at("momentum") >= 70, "Momentum").otherwise("Blend"),
    )


def sector_rankings(rows: DataFrame, leaders: int = 5) -> DataFrame:
    """Average score, members and leaders per sector. Leaders are cut to the top few per sector
    before they are listed, so no sector is collected whole."""
    named = rows.withColumn("sector", F.coalesce("sector", F.lit("Unknown"))).withColumn("final_score", F.coalesce("final_score", F.lit(0.0)))
    stats = named.groupBy("sector").agg(F.avg("final_score").alias("average_score"), F.count(F.lit(1)).alias("leader_count"))
    rn = F.row_number().over(Window.partitionBy("sector").orderBy(F.desc("final_score"), "ticker"))
    top = named.withColumn("_rn", rn).filter(F.col("_rn") <= leaders)
    lists = top.groupBy("sector").agg(F.transform(F.sort_array(F.collect_list(F.struct("_rn", "ticker"))), lambda s: s["ticker"]).alias("leaders"))
    return stats.join(lists, "sector")


def sector_rotation(rankings: DataFrame, exposure: DataFrame | None = None) -> DataFrame:
    """Rotation label and list membership per sector (sectors are few: one ordered partition)."""
    s = F.col("average_score")
    whole = Window.partitionBy(F.lit(0)).orderBy(F.desc("average_score"), "sector")
    out = (
        rankings.withColumn("relative_strength", s - 50)
        .withColumn("rotation_signal", F.when(s >= 65, "Leading").when(s <= 40, "Deteriorating").otherwise("Neutral"))
        .withColumn("leadership_rank", F.row_number().over(whole))
    )
    out = out.withColumn("improving", F.col("relative_strength") > 5).withColumn("deteriorating", F.col("relative_strength") < -10)
    return out if exposure is None else out.join(exposure, "sector", "left")


def sector_momentum(proxy: DataFrame, key: str = "sector") -> DataFrame:
    """Clamped 1- and 3-month momentum plus 25 above the 50-row mean, shifted and clipped."""
    ranked = with_position(proxy, (key,)).filter(F.col("rn") <= 64)
    px = lambda n: F.max(F.when(F.col("rn") == n, F.col("close")))
    out = ranked.groupBy(key).agg(
        px(1).alias("latest"),
        F.coalesce(px(1) / px(22) - 1, F.lit(0.0)).alias("one_month_return"),
        F.coalesce(px(1) / px(64) - 1, F.lit(0.0)).alias("three_month_return"),
        F.when(F.max("n_rows") >= 50, F.avg(F.when(F.col("rn") <= 50, F.col("close")))).alias("sma50"),
    )
    above = truth(F.col("latest") > F.col("sma50"))
    raw = (F.greatest(F.col("one_month_return"), F.lit(-0.25)) + F.greatest(F.col("three_month_return"), F.lit(-0.35))) * 100
    return out.withColumn("above_sma50", above).withColumn(
        "momentum_score", clip(raw + F.when(above, 25).otherwise(0) + 50, 0.0, 100.0)
    )


def breadth(rows: DataFrame) -> DataFrame:
    """Share above the moving averages, advance/decline and the breadth score.
    `rows`: price_above_sma50, price_above_sma200, quant_score."""
    either = truth(F.col("price_above_sma50")) | truth(F.col("price_above_sma200"))
    pct = lambda c: F.avg(c.cast("double")) * 100
    out = rows.agg(
        F.count(F.lit(1)).alias("members"),
        pct(either).alias("percent_above_sma50"),
        pct(truth(F.col("price_above_sma200"))).alias("percent_above_sma200"),
        F.sum((F.coalesce("quant_score", F.lit(0)) >= 50).cast("int")).alias("advancing"),
    )
    declining = F.greatest(F.lit(1), F.col("members") - F.col("advancing"))
    ratio: Column = F.col("advancing") / declining
    score = (F.col("percent_above_sma50") + F.col("percent_above_sma200") + F.least(ratio, F.lit(2.0)) / 2 * 100) / 3
    out = out.withColumn("advance_decline_ratio", ratio).withColumn("market_breadth_score", score)
    s = F.round("market_breadth_score", 2)
    return out.withColumn("breadth_trend", F.when(s >= 65, "Healthy").when(s >= 45, "Fragile").otherwise("Weak")).withColumn(
        "divergence_warning", s < 45
    )
