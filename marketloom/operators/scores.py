"""Rule-based scores, ratings and rankings over one row per ticker."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.expr import clip, notes, points, safe_div, truth
from marketloom.functions.rolling import lagged, rolling_mean, with_position

# fixed values: composite weights, catalyst points
COMPOSITE = {"technical": 0.25, "momentum": 0.25, "volume": 0.15, "fundamental": 0.15, "risk": 0.15, "catalyst": 0.05}
CATALYSTS = (("earnings_surprise", 20), ("analyst_revision", 20), ("insider_buying", 15), ("sector_strength", 20), ("major_news", 15), ("guidance_change", 10))


def latest_rows(table: DataFrame) -> DataFrame:
    return with_position(table).filter(F.col("rn") == 1)


def rating_tier(latest: DataFrame, rsi_leader: float = 50.0, alert: float = 2.0, watch: float = 1.5, extension: float = 3.0) -> DataFrame:
    """Stage, RSI, volume and relative-strength points with an extension penalty, in five tiers."""
    c, s50, s200 = F.col("close"), F.col("sma50"), F.col("sma200")
    rv, mrs = F.coalesce("rv", F.lit(1.0)), F.col("mrs")
    stage2 = truth((c > s50) & (s50 > s200))
    extended = truth(F.col("dist_sma20") > extension)
    leading = truth(mrs > 0)
    pts = (
        F.when(stage2, 30).when(truth(c > s200), 15).when(truth(c > s50), 5).otherwise(0)
        + points((F.col("rsi_monthly") > rsi_leader, 10), (F.col("rsi_weekly") > rsi_leader, 10))
        + F.when(rv >= alert, 20).when(rv >= watch, 10).otherwise(0)
        + F.when(leading, F.lit(20) + F.when(F.col("rs_breakout"), 10).otherwise(0)).when(truth(F.col("rs_line") > F.col("rs_sma20")), 5).otherwise(0)
        - F.when(extended, 25).otherwise(0)
    )
    s = F.col("rating_score")
    return (
        latest.withColumn("rating_score", F.greatest(pts.cast("double"), F.lit(0.0)))
        .withColumn("is_extended", extended)
        .withColumn("stage_2", stage2)
        .withColumn(
            "rating",
            F.when(s >= 80, "Tier 1: Market Leader").when(s >= 60, "Tier 2: Improving").when(s >= 40, "Tier 3: Neutral").when(s >= 20, "Tier 4: Lagging").otherwise("Tier 5: Avoid"),
        )
        .withColumn("dist_high_pct", safe_div(F.col("high_52w") - c, F.col("high_52w")) * 100)
        .withColumn("dist_low_pct", safe_div(c - F.col("low_52w"), F.col("low_52w")) * 100)
    )


def leader_score(latest: DataFrame) -> DataFrame:
    c, s50, s200 = F.col("close"), F.col("sma50"), F.col("sma200")
    known = s200.isNotNull() & F.col("rsi_weekly").isNotNull() & F.col("mrs").isNotNull()
    pts = (
        F.when(truth((c > s50) & (s50 > s200)), 40).when(truth(c > s200), 20).otherwise(0)
        + points(
            (F.col("mrs") > 0, 20), (F.col("rs_line") > F.col("rs_sma20"), 10), (F.col("rsi_weekly") > 50, 10), (F.col("rsi_monthly") > 50, 10),
            (F.col("rv") > 1.5, 10), (F.col("dist_sma20") > 3.0, -20),
        )
    )
    return latest.withColumn("leader_score", F.when(known, clip(pts.cast("double"), 0.0, 100.0)).otherwise(F.lit(0.0)))


def technical_score(latest: DataFrame, levels: DataFrame) -> DataFrame:
    """`levels`: ticker, support, resistance, risk_reward."""
    c = F.col("close")
    rsi, dist = F.col("rsi"), F.col("dist_sma20")
    sma_stack = (F.col("sma20") > F.col("sma50")) & (F.col("sma50") > F.col("sma200"))
    rules = (
        (c > F.col("sma20"), 8, "Price above SMA20"),
        (c > F.col("sma50"), 10, "Price above SMA50"),
        (c > F.col("sma200"), 12, "Price above SMA200"),
        (sma_stack, 15, "SMA alignment is constructive"),
        (F.col("ema20") > F.col("ema50"), 10, "EMA trend is positive"),
        (rsi.between(50, 70), 15, "RSI confirms momentum without extreme extension"),
        (F.col("macd") > F.col("macd_signal"), 10, "MACD is above signal"),
        (dist <= 3, 10, "Stock is not materially extended from SMA20"),
        (dist > 3, 0, "Stock is extended from SMA20"),
        (F.col("risk_reward") >= 2, 10, "Support/resistance profile offers positive risk/reward"),
    )
    out = latest.join(levels.select("ticker", "support", "resistance", "risk_reward"), "ticker", "left")
    total = points(*[(cond, p) for cond, p, _ in rules]) + F.when(truth(((rsi >= 40) & (rsi < 50)) | ((rsi > 70) & (rsi <= 80))), 8.0).otherwise(0.0)
    return out.withColumn("technical_score", clip(total, 0.0, 100.0)).withColumn("technical_evidence", notes(*[(cond, t) for cond, _, t in rules]))


def momentum_score(bars: DataFrame, benchmark: DataFrame, sectors: DataFrame) -> DataFrame:
    """Momentum points of the latest row; `benchmark`: date, close; `sectors`: sector, date, close."""
    ranked = with_position(bars).filter(F.col("rn").isin(1, 22, 64, 127, 253))
    px = lambda n: F.max(F.when(F.col("rn") == n, F.col("close")))
    names = (("1m", 21, 10), ("3m", 63, 15), ("6m", 126, 15), ("12m", 252, 20))
    out = ranked.groupBy("ticker", "sector").agg(*[(px(1) / px(n + 1) - 1).alias(f"ret_{k}") for k, n, _ in names])
    b = benchmark.orderBy(F.desc("date")).limit(64)
    market = b.agg(F.when(F.count(F.lit(1)) == 64, F.max_by("close", "date") / F.min_by("close", "date") - 1).alias("bench_3m"))
    sec = with_position(sectors, ("sector",)).filter(F.col("rn").isin(1, 64)).groupBy("sector").agg((px(1) / px(64) - 1).alias("sector_3m"))
    out = out.crossJoin(F.broadcast(market)).join(sec, "sector", "left")  # market is one row
    z = F.lit(0.0)
    acc = F.coalesce("ret_3m", z) - F.coalesce("ret_6m", z) / 2
    rules = [(F.col(f"ret_{k}") > 0, p, f"{k} return is positive") for k, _, p in names]
    rules += [
        (acc > 0, 10, "Momentum is accelerating"),
        (F.col("ret_3m") > F.col("bench_3m"), 15, "Outperforming S&P 500 over 3 months"),
        (F.col("ret_3m") > F.col("sector_3m"), 15, "Outperforming sector ETF over 3 months"),
    ]
    return (
        out.withColumn("acceleration", acc)
        .withColumn("momentum_score", clip(points(*[(c, p) for c, p, _ in rules]), 0.0, 100.0))
        .withColumn("momentum_evidence", notes(*[(c, t) for c, _, t in rules]))
    )


def volume_score(bars: DataFrame) -> DataFrame:
    w20 = rolling_mean(F.col("volume"), 20)
    up = F.col("close") > F.col("_prev")
    heavy = F.col("volume") > F.col("vol_avg")
    rows = with_position(bars.withColumn("vol_avg", w20).withColumn("_prev", lagged("close"))).filter(F.col("rn") <= 63)
    last = lambda c: F.max(F.when(F.col("rn") == 1, F.col(c)))
    count = lambda cond: F.sum(F.when((F.col("rn") <= 20) & truth(cond & heavy), 1).otherwise(0))
    out = rows.groupBy("ticker").agg(
        last("vol_avg").alias("average_volume"),
        safe_div(last("volume"), last("vol_avg")).alias("relative_volume"),
        last("close").alias("_c"),
        last("_prev").alias("_p"),
        count(up).alias("accumulation_days"),
        count(F.col("close") < F.col("_prev")).alias("distribution_days"),
        F.when(F.max("n_rows") >= 63, F.max("close")).alias("_hi"),
    )
    rv = F.col("relative_volume")
    rules = (
        (rv >= 1.5, 25, "Relative volume is elevated"),
        ((F.col("_c") > F.col("_p")) & (rv >= 1.25), 25, "Price advanced on above-average volume"),
        (F.col("accumulation_days") > F.col("distribution_days"), 25, "Accumulation days exceed distribution days"),
        ((F.col("_c") >= F.col("_hi") * 0.98) & (rv >= 1.5), 25, "High-volume breakout behavior"),
    )
    return (
        out.withColumn("volume_score", clip(points(*[(c, p) for c, p, _ in rules]), 0.0, 100.0))
        .withColumn("volume_evidence", notes(*[(c, t) for c, _, t in rules]))
        .drop("_c", "_p", "_hi")
    )


def risk_score(analysis: DataFrame, returns: DataFrame) -> DataFrame:
    """100 minus penalties; `analysis`: ticker, annualized_volatility, max_drawdown, beta."""
    recent = with_position(returns).groupBy("ticker").agg(
        F.stddev_samp(F.when(F.col("rn") <= 21, F.col("r"))).alias("_short"), F.stddev_samp("r").alias("_long")
    )
    rules = (
        (F.col("annualized_volatility") > 0.55, 25, "Volatility is elevated"),
        (F.col("max_drawdown") < -0.35, 25, "Historical drawdown is severe"),
        (F.abs("beta") > 1.5, 15, "Beta indicates elevated market sensitivity"),
        (F.col("_short") > F.col("_long") * 1.25, 15, "Short-term volatility is rising"),
    )
    out = analysis.join(recent, "ticker", "left")
    return (
        out.withColumn("risk_score", clip(100 - points(*[(c, p) for c, p, _ in rules]), 0.0, 100.0))
        .withColumn("risk_evidence", notes(*[(c, t) for c, _, t in rules]))
        .drop("_short", "_long")
    )


def catalyst_flags(rows: DataFrame) -> DataFrame:
    """Six flags from news, growth, analyst, ownership and technical fields of a row."""
    bull, bear = F.coalesce("bullish_news", F.lit(0)), F.coalesce("bearish_news", F.lit(0))
    grow = truth(F.col("eps_growth") > 0.10) | truth(F.col("revenue_growth") > 0.10)
    return (
        rows.withColumn("earnings_surprise", truth(F.col("last_surprise_pct") > 2) | grow)
        .withColumn("analyst_revision", truth(F.lower("recommendation").isin("buy", "strong_buy")) | truth((F.col("target_mean_price") > 0) & (F.col("forward_pe") != 0)))
        .withColumn("insider_buying", truth(F.col("insider_ownership") >= 0.05))
        .withColumn("sector_strength", truth(F.col("price_above_sma50")) & truth(F.col("price_above_sma200")))
        .withColumn("major_news", truth(F.col("top_importance") >= 60))
        .withColumn("guidance_change", F.abs(bull - bear) >= 2)
    )


def catalyst_score(flags: DataFrame) -> DataFrame:
    pairs = [(F.col(c), p) for c, p in CATALYSTS]
    return flags.withColumn("catalyst_score", clip(points(*pairs), 0.0, 100.0)).withColumn(
        "catalyst_evidence", notes(*[(F.col(c), c.replace("_", " ")) for c, _ in CATALYSTS])
    )


def first_of(items: Column, n: int | None) -> Column:
    """The first n entries of an array, all of them without n."""
    return items if n is None else F.slice(items, 1, n)


def final_score(rows: DataFrame, note_limit: int | None = None) -> DataFrame:
    """Weighted composite, dispersion-based confidence, rating and risk level. `rows` carry the
    six category scores and their evidence arrays; `note_limit` cuts the explanation to its first notes."""
    cats = [F.coalesce(f"{k}_score", F.lit(0.0)) for k in COMPOSITE]
    final = sum(c * w for c, w in zip(cats, COMPOSITE.values()))
    values = F.array(*cats)
    n = len(cats)
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n
    out = rows.withColumn("final_score", final).withColumn("_mean", mean)
    var = F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - F.col("_mean")) * (x - F.col("_mean"))) / n
    zeros = F.size(F.filter(values, lambda x: x == 0))
    f, r = F.col("final_score"), F.col("risk_score")
    evidence = F.concat(*[F.coalesce(f"{k}_evidence", F.array().cast("array<string>")) for k in ("technical", "momentum", "volume", "fundamental", "catalyst")])
    return (
        out.withColumn("score_confidence", clip(F.col("_mean") - F.sqrt(var) * 0.25 - zeros * 5, 0.0, 100.0))
        .withColumn(
            "score_rating",
            F.when(r < 35, "Avoid").when(f >= 80, "Buy Watch").when(f >= 65, "Watch").when(f >= 45, "Hold").when(f >= 30, "Drop").otherwise("Avoid"),
        )
        .withColumn("risk_level", F.when(r < 45, "High").when(r < 70, "Moderate").otherwise("Controlled"))
        .withColumn("explanation", F.when(F.size(evidence) > 0, F.array_join(first_of(evidence, note_limit), "; ")).otherwise("No high-conviction evidence yet."))
        .drop("_mean")
    )


def liquidity(rv: Column) -> Column:
    return clip(55 + F.least(F.greatest((rv - 1) * 20, F.lit(-20.0)), F.lit(25.0)), 0.0, 100.0)


def research_rows(rows: DataFrame, driver_limit: int | None = None) -> DataFrame:
    """Research score, liquidity, direction, uncertainty, drivers and missing fields per ticker.
    `driver_limit` cuts each list of drivers."""
    rv = F.coalesce("relative_volume", F.lit(1.0))
    above = truth(F.col("price_above_sma200"))
    lead = F.lower("rs_status") == "leading"
    conf = F.coalesce("confidence", F.lit(0.0))
    score = F.coalesce(F.nullif("quant_score", F.lit(0.0)), F.lit(50.0))
    pos = notes(
        (above, "Price is above the 200-day trend line."),
        (lead, "Relative strength is leading the benchmark/watchlist."),
        (F.col("sharpe_ratio") >= 1, "Risk-adjusted return is constructive."),
        (F.col("why_now") != "No clear Why Now trigger", F.concat(F.lit("Why-now trigger: "), F.col("why_now"), F.lit("."))),
    )
    neg = notes(
        (~above, "Price is not above the 200-day trend line."),
        (F.col("rs_status").isNotNull() & ~lead, "Relative strength is lagging."),
        (F.coalesce("sharpe_ratio", F.lit(0.0)) < 1, "Sharpe ratio is below institutional quality."),
        (F.abs("max_drawdown") >= 0.35, "Historical drawdown has been severe."),
        (F.col("annualized_volatility") >= 0.45, "Realized volatility is elevated."),
    )
    vol_pct = F.when(F.abs("annualized_volatility") <= 1, F.col("annualized_volatility") * 100).otherwise(F.coalesce("annualized_volatility", F.lit(0.0)))
    liq = liquidity(rv)
    return (
        rows.withColumn("overall_score", score)
        .withColumn("liquidity_score", liq)
        .withColumn("slippage_risk", F.when(liq < 45, "High").when(liq < 65, "Medium").otherwise("Low"))
        .withColumn("research_risk_score", F.greatest(F.lit(0.0), 100 - vol_pct))
        .withColumn("regime_compatibility", F.when(above, 75).otherwise(40))
        .withColumn("signal_direction", F.when(score >= 65, "Constructive").when(score <= 40, "Defensive").otherwise("Neutral"))
        .withColumn("data_quality_score", F.least(F.lit(100.0), conf + 35))
        .withColumn("uncertainty", F.when(100 - conf >= 75, "High").when(100 - conf >= 50, "Medium").otherwise("Low"))
        .withColumn("top_positive_drivers", first_of(pos, driver_limit))
        .withColumn("top_negative_drivers", first_of(neg, driver_limit))
        .withColumn(
            "missing_data",
            notes(*[(F.col(c).isNull(), c) for c in ("quant_score", "confidence", "annualized_volatility", "sharpe_ratio")]),
        )
    )


def top_k(rows: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The n first rows with their rank; Spark keeps n per task before the final merge."""
    kept = rows.orderBy(*order).limit(n)
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def discover(screened: DataFrame, all_rows: DataFrame, screener: str = "quality_momentum", top: int = 20) -> tuple[DataFrame, DataFrame]:
    """Screener matches in order of (trigger strength, score), and the top rows by score."""
    hits = screened.filter(F.col("screener") == screener)
    by = (F.desc_nulls_last("strength"), F.desc("final_score"), F.asc("ticker"))
    matches = hits.withColumn("rank", F.row_number().over(Window.partitionBy("screener").orderBy(*by)))
    return matches, top_k(all_rows, (F.desc("final_score"), F.asc("ticker")), top)


def leaders_laggards(rows: DataFrame, n: int = 3) -> DataFrame:
    best = top_k(rows, (F.desc("score"), F.asc("ticker")), n).withColumn("side", F.lit("leader"))
    worst = top_k(rows, (F.asc("score"), F.asc("ticker")), n).withColumn("side", F.lit("laggard"))
    return best.unionByName(worst)
