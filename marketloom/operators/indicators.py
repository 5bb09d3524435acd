"""Returns, indicators and volatility over bars: one row per (ticker, date) in, same out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.expr import correlation, safe_div, truth
from marketloom.functions.rolling import (
    full_frame,
    lagged,
    over,
    pct_change,
    rolling_mean,
    rolling_std,
    trailing,
    with_ema,
    with_emas,
    with_position,
    with_rsi,
)

HORIZONS = (1, 5, 20, 21, 63, 126, 252, 504)


def simple_returns(bars: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    return bars.select("*", *[pct_change("close", n).alias(f"ret_{n}") for n in horizons])


def daily_returns(bars: DataFrame, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """Rows with a defined one-row return `r`."""
    return bars.withColumn("r", pct_change("close", 1, keys)).filter(F.col("r").isNotNull())


def rebased(bars: DataFrame) -> DataFrame:
    first = F.first("close").over(over().rowsBetween(Window.unboundedPreceding, 0))
    return bars.withColumn("rebased", F.col("close") / first - 1)


def basket_against_benchmark(
    matrix: DataFrame, benchmark: DataFrame, horizons: Sequence[tuple[str, int]] = (("1M", 21), ("3M", 63), ("6M", 126), ("1Y", 252))
) -> DataFrame:
    """Equal-weight basket and benchmark over the last rows. The base row is the n-th from
    the end, so a 21-row horizon spans 20 changes."""
    basket = rebased(matrix).groupBy("date").agg(F.avg(F.col("rebased") + 1).alias("basket"))
    both = basket.join(benchmark.select("date", F.col("close").alias("bench")), "date")
    longest = max(n for _, n in horizons)
    # only the latest rows take part: a top-k, then one small global ranking
    tail = both.orderBy(F.desc("date")).limit(longest + 1)
    ranked = tail.withColumn("rn", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("date"))))
    last = lambda c, n: F.max(F.when(F.col("rn") == n, F.col(c)))
    one = ranked.agg(
        F.count(F.lit(1)).alias("rows"),
        last("basket", 1).alias("p0"),
        last("bench", 1).alias("b0"),
        F.array(
            *[
                F.struct(F.lit(name).alias("period"), F.lit(n).alias("days"), last("basket", n).alias("p"), last("bench", n).alias("b"))
                for name, n in horizons
            ]
        ).alias("h"),
    )
    return (
        one.select("rows", "p0", "b0", F.inline("h"))
        .filter(F.col("rows") > F.col("days"))
        .withColumn("portfolio_return", F.col("p0") / F.col("p") - 1)
        .withColumn("benchmark_return", F.col("b0") / F.col("b") - 1)
        .withColumn("relative_return", F.col("portfolio_return") - F.col("benchmark_return"))
    )


def sma(bars: DataFrame, lengths: Sequence[int] = (20, 50, 200)) -> DataFrame:
    return bars.select("*", *[rolling_mean(F.col("close"), n).alias(f"sma{n}") for n in lengths])


def ema(bars: DataFrame, spans: Sequence[int] = (20, 50, 200)) -> DataFrame:
    return with_emas(bars, [("close", f"ema{span}", span) for span in spans])


def rsi(bars: DataFrame, n: int = 14) -> DataFrame:
    return with_rsi(bars, "close", "rsi", n)


def true_range() -> Column:
    prev = lagged("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))


def atr(bars: DataFrame, n: int = 14) -> DataFrame:
    return bars.withColumn("tr", true_range()).withColumn("atr", rolling_mean(F.col("tr"), n)).drop("tr")


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    return macd_lines(with_emas(bars, [("close", "_fast", fast), ("close", "_slow", slow)]), signal)


def macd_lines(table: DataFrame, signal: int = 9) -> DataFrame:
    """MACD, signal and histogram from the two means `_fast` and `_slow`."""
    out = with_ema(table.withColumn("macd", F.col("_fast") - F.col("_slow")), "macd", "macd_signal", signal)
    return out.withColumn("macd_hist", F.col("macd") - F.col("macd_signal")).drop("_fast", "_slow")


def roc(bars: DataFrame, n: int = 20) -> DataFrame:
    return bars.withColumn(f"roc_{n}", pct_change("close", n) * 100)


def relative_strength(bars: DataFrame, benchmark: DataFrame, slow: int = 50, fast: int = 20) -> DataFrame:
    """Keeps the dates both sides have."""
    line = F.col("rs_line")
    return (
        bars.join(benchmark.select("date", F.col("close").alias("bench_close")), "date")
        .withColumn("rs_line", F.col("close") / F.col("bench_close"))
        .withColumn("rs_sma50", rolling_mean(line, slow))
        .withColumn("rs_sma20", rolling_mean(line, fast))
        .withColumn("mrs", (line / F.col("rs_sma50") - 1) * 100)
    )


def relative_volume(bars: DataFrame, n: int = 20, alert: float = 2.0) -> DataFrame:
    return (
        bars.withColumn("vol_avg", rolling_mean(F.col("volume"), n))
        .withColumn("rv", safe_div(F.col("volume"), F.col("vol_avg")))
        .withColumn("volume_spike", truth(F.col("rv") >= alert))
    )


def high_low_52w(bars: DataFrame, n: int = 252) -> DataFrame:
    f = trailing(n)
    return bars.withColumn("high_52w", F.max("close").over(f)).withColumn("low_52w", F.min("close").over(f))


def period_label(rule: str) -> Column:
    """Closing date of the week (Sunday) or month a date falls in."""
    if rule == "W":
        return F.next_day(F.date_sub("date", 1), "SUN")
    if rule == "ME":
        return F.last_day("date")
    raise ValueError(f"unsupported rule {rule}")


def resample_ohlcv(bars: DataFrame, rule: str) -> DataFrame:
    """OHLCV per period, with empty periods kept as rows without prices (volume 0), so a
    row window over periods spans calendar time."""
    step = F.expr("interval 7 days") if rule == "W" else F.expr("interval 1 month")
    grouped = (
        bars.withColumn("label", period_label(rule))
        .groupBy("ticker", "label")
        .agg(
            F.min_by("open", "date").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "date").alias("close"),
            F.sum("volume").alias("volume"),
        )
    )
    lo, hi = F.min("label"), F.max("label")
    if rule == "ME":
        lo = F.trunc(lo, "month")
    labels = grouped.groupBy("ticker").agg(F.explode(F.sequence(lo, hi, step)).alias("label"))
    if rule == "ME":
        labels = labels.withColumn("label", F.last_day("label"))
    return labels.join(grouped, ["ticker", "label"], "left").withColumn("volume", F.coalesce("volume", F.lit(0.0)))


def asof_ffill(rows: DataFrame, marks: DataFrame, value: str, out: str) -> DataFrame:
    """Value of the last mark with label <= date, null values included: one union, one window."""
    width = [c for c in rows.columns if c not in ("ticker", "date")]
    left = rows.select("ticker", "date", F.lit(1).alias("_side"), F.struct(*width).alias("_row"), F.lit(None).cast("struct<v:double>").alias("_mark"))
    row_type = left.schema["_row"].dataType.simpleString()
    right = marks.select(
        "ticker",
        F.col("label").alias("date"),
        F.lit(0).alias("_side"),
        F.lit(None).cast(row_type).alias("_row"),
        F.struct(F.col(value).cast("double").alias("v")).alias("_mark"),
    )
    w = Window.partitionBy("ticker").orderBy("date", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return (
        left.unionByName(right)
        .withColumn("_mark", F.last("_mark", ignorenulls=True).over(w))
        .filter(F.col("_side") == 1)
        .select("ticker", "date", "_row.*", F.col("_mark.v").alias(out))
    )


def period_rsi(bars: DataFrame, rule: str, n: int = 14) -> DataFrame:
    return with_rsi(resample_ohlcv(bars, rule), "close", "rsi", n, order="label")


def indicator_table(bars: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every indicator of a bar in one table; all windows share the ticker partitioning."""
    out = with_position(
        bars.join(benchmark.select("date", F.col("close").alias("bench_close")), "date")
    )
    spans = [("close", f"ema{n}", n) for n in (20, 50, 200)] + [("close", "_fast", 12), ("close", "_slow", 26)]
    out = sma(macd_lines(with_emas(out, spans)))
    line = F.col("rs_line")
    out = (
        high_low_52w(relative_volume(atr(out)))
        .withColumn("rs_line", F.col("close") / F.col("bench_close"))
        .withColumn("rs_sma50", rolling_mean(line, 50))
        .withColumn("rs_sma20", rolling_mean(line, 20))
        .withColumn("mrs", (line / F.col("rs_sma50") - 1) * 100)
        .withColumn("dist_sma20", safe_div(F.col("close") - F.col("sma20"), F.col("atr")))
    )
    out = roc(with_rsi(out, "close", "rsi"))
    out = out.withColumn("golden_cross", crossed_above("sma50", "sma200")).withColumn(
        "rs_breakout", truth((F.col("mrs") > 0) & (lagged("mrs") <= 0))
    )
    out = asof_ffill(out, period_rsi(bars, "W"), "rsi", "rsi_weekly")
    return asof_ffill(out, period_rsi(bars, "ME"), "rsi", "rsi_monthly")


def crossed_above(a: str, b: str) -> Column:
    return truth((F.col(a) > F.col(b)) & (lagged(a) <= lagged(b)))


def crossed_below(a: str, b: str) -> Column:
    return truth((F.col(a) < F.col(b)) & (lagged(a) >= lagged(b)))


def snapshot(bars: DataFrame, fundamentals: DataFrame) -> DataFrame:
    """Latest price, 1/5/20-row changes and volume ratio, with fundamentals attached.
    A ticker of the dimension without prices keeps a row with an error text."""
    ranked = with_position(bars)
    px = lambda n: F.max(F.when(F.col("rn") == n, F.col("close")))
    recent = F.avg(F.when(F.col("rn") <= 20, F.col("volume")))
    latest = (
        ranked.filter(F.col("rn") <= 21)
        .groupBy("ticker")
        .agg(
            F.max("date").alias("as_of"),
            px(1).alias("price"),
            (px(1) / px(2) - 1).alias("daily_change_pct"),
            (px(1) / px(6) - 1).alias("five_day_change_pct"),
            (px(1) / px(21) - 1).alias("twenty_day_change_pct"),
            F.when(F.max("n_rows") >= 21, safe_div(F.max(F.when(F.col("rn") == 1, F.col("volume"))), recent)).alias("volume_ratio"),
        )
    )
    return fundamentals.join(latest, "ticker", "left").withColumn(
        "error", F.when(F.col("price").isNull(), F.lit("No price data returned"))
    )


def dist_atr(bars: DataFrame) -> DataFrame:
    return atr(sma(bars, (20,))).withColumn("dist_sma20", safe_div(F.col("close") - F.col("sma20"), F.col("atr")))


def realized_vol(returns: DataFrame, n: int = 21, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    return returns.withColumn("realized_vol", rolling_std(F.col("r"), n, keys) * F.sqrt(F.lit(252.0)))


def vol_regime(returns: DataFrame, n: int = 21) -> DataFrame:
    """Share of the rolling-volatility history at or below the latest value."""
    vols = realized_vol(returns, n).filter(F.col("realized_vol").isNotNull())
    latest = F.last("realized_vol").over(over().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    share = F.avg((F.col("realized_vol") <= F.col("latest")).cast("double"))
    return (
        vols.withColumn("latest", latest)
        .groupBy("ticker")
        .agg(F.count(F.lit(1)).alias("observations"), F.max("latest").alias("latest_vol"), share.alias("percentile"))
        .withColumn(
            "regime",
            F.when(F.col("observations") < 20, "Unknown")
            .when(F.col("percentile") >= 0.8, "High volatility")
            .when(F.col("percentile") <= 0.2, "Low volatility")
            .otherwise("Normal volatility"),
        )
    )


def support_resistance(bars: DataFrame, n: int = 63) -> DataFrame:
    recent = with_position(bars).filter(F.col("rn") <= n)
    out = recent.groupBy("ticker").agg(
        F.max(F.when(F.col("rn") == 1, F.col("close"))).alias("close"),
        F.min("close").alias("support"),
        F.max("close").alias("resistance"),
    )
    down, up = F.col("close") - F.col("support"), F.col("resistance") - F.col("close")
    return out.withColumn("risk_reward", F.when(down > 0, F.round(up / down, 2)).otherwise(F.lit(0.0)))


def drawdown(returns: DataFrame, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """Equity, running peak and drawdown after each row. A return of -100 % or worse ends at 0.
    The peak starts from the first equity value, not from 1."""
    run = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    growth = F.when(F.col("r") > -1, F.log1p("r"))
    wiped = F.max((F.col("r") <= -1).cast("int")).over(run) == 1
    return (
        returns.withColumn("equity", F.when(wiped, F.lit(0.0)).otherwise(F.exp(F.sum(growth).over(run))))
        .withColumn("peak", F.max("equity").over(run))
        .withColumn("drawdown", safe_div(F.col("equity"), F.col("peak")) - 1)
    )


def recovery_time(drawdowns: DataFrame, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """Longest run of consecutive rows under water."""
    run = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    under = F.col("drawdown") < 0
    return (
        drawdowns.withColumn("island", F.sum((~under).cast("int")).over(run))
        .groupBy(*keys, "island")
        .agg(F.sum(under.cast("int")).alias("length"))
        .groupBy(*keys)
        .agg(F.max("length").alias("recovery_time"))
    )


def autocorr(returns: DataFrame, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """Lag-1 autocorrelation, and the direction of 63-row against 21-row volatility."""
    ranked = with_position(returns, keys).withColumn("prev", lagged("r", 1, keys))
    vol = lambda n: F.stddev_samp(F.when(F.col("rn") <= n, F.col("r"))) * F.sqrt(F.lit(252.0))
    out = ranked.groupBy(*keys).agg(
        correlation("r", "prev").alias("autocorrelation_1d"), vol(21).alias("current_volatility"), vol(63).alias("expected_volatility")
    )
    ac, cur, exp = F.col("autocorrelation_1d"), F.col("current_volatility"), F.col("expected_volatility")
    return out.withColumn(
        "momentum_state",
        F.when(ac > 0.05, "Momentum continuing").when(ac < -0.05, "Mean reversion likely").otherwise("No clear short-term edge"),
    ).withColumn(
        "risk_direction", F.when(exp > cur * 1.15, "Increasing").when(exp < cur * 0.85, "Decreasing").otherwise("Stable")
    )


def ewma_terms(decay: float = 0.94) -> Column:
    """Squared return times its weight in the exponential variance; needs `i` and `n_rows`.
    The first return seeds the recursion with full weight."""
    age = F.col("n_rows") - 1 - F.col("i")
    return F.pow(F.lit(decay), age) * F.when(F.col("i") == 0, F.lit(1.0)).otherwise(F.lit(1 - decay)) * F.col("r") * F.col("r")


def ewma_vol(returns: DataFrame, decay: float = 0.94) -> DataFrame:
    return (
        with_position(returns)
        .groupBy("ticker")
        .agg(F.sqrt(F.sum(ewma_terms(decay))).alias("ewma_daily"), F.count(F.lit(1)).alias("observations"))
    )


def vol_forecast(returns: DataFrame, horizon: int = 30, decay: float = 0.94) -> DataFrame:
    out = (
        with_position(returns)
        .groupBy("ticker")
        .agg(
            F.count(F.lit(1)).alias("observations"),
            F.sqrt(F.sum(ewma_terms(decay))).alias("ewma_daily"),
            F.stddev_samp(F.when(F.col("rn") <= 20, F.col("r"))).alias("realized_daily"),
        )
    )
    ready = F.col("observations") >= 60
    e, r = F.col("ewma_daily"), F.col("realized_daily")
    return (
        out.withColumn("annualized", F.when(ready, e * F.sqrt(F.lit(252.0))))
        .withColumn("horizon_vol", F.when(ready, e * F.sqrt(F.lit(float(horizon)))))
        .withColumn(
            "expected",
            F.when(~ready, "Insufficient Data").when(e > r * 1.15, "Elevated").when(e < r * 0.85, "Lower").otherwise("Normal"),
        )
    )


def vol_forecast_eval(returns: DataFrame, horizon: int = 20, first: int = 60, decay: float = 0.94) -> DataFrame:
    """Walk-forward error of the EWMA and the 20-row forecasts against the next `horizon` rows.

    The EWMA at a cut is a prefix of one recursion, so it is read off a running window
    (`with_ema` shaped sum) instead of refitting per cut: linear in rows, not rows x cuts.
    """
    ranked = with_position(returns).withColumn("sq", F.col("r") * F.col("r"))
    # decay = 1 - 2/(span+1)
    span = 2.0 / (1.0 - decay) - 1.0
    run = with_ema(ranked, "sq", "variance", span)
    ahead = over().rowsBetween(0, horizon - 1)
    before = over().rowsBetween(-20, -1)
    cuts = (
        run.withColumn("ewma", F.sqrt(lagged("variance")))
        .withColumn("baseline", F.stddev_samp("r").over(before))
        .withColumn("actual", F.stddev_samp("r").over(ahead))
        .filter((F.col("i") >= first) & ((F.col("i") - first) % horizon == 0) & (F.col("i") < F.col("n_rows") - horizon))
        .filter(F.col("n_rows") >= 80)
    )
    return (
        cuts.groupBy("ticker")
        .agg(
            F.count(F.lit(1)).alias("sample_size"),
            F.avg(F.abs(F.col("ewma") - F.col("actual"))).alias("mae"),
            F.avg(F.abs(F.col("baseline") - F.col("actual"))).alias("baseline_mae"),
        )
        .withColumn("ewma_beats_baseline", F.col("mae") <= F.col("baseline_mae"))
    )


def regime_features(prices: DataFrame, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    close = F.col("close")
    high = full_frame(F.max(close), close, 252, trailing(252, keys), 60)
    return (
        prices.withColumn("r", pct_change("close", 1, keys))
        .withColumn("return_21d", pct_change("close", 21, keys))
        .withColumn("volatility_21d", rolling_std(F.col("r"), 21, keys) * F.sqrt(F.lit(252.0)))
        .withColumn("trend_50d", close / rolling_mean(close, 50, keys) - 1)
        .withColumn("drawdown", close / high - 1)
        .dropna(subset=["return_21d", "volatility_21d", "trend_50d", "drawdown"])
    )


def vol_target_returns(returns: DataFrame, targets: Sequence[float], n: int = 21, cap: float = 2.0, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """One row per (row, target): the return scaled by yesterday's capped leverage."""
    vol = F.nullif(F.col("realized_vol"), F.lit(0.0))
    scaled = realized_vol(returns, n, keys)
    for t in targets:
        lev = F.when(F.col("realized_vol") == 0, F.lit(cap)).otherwise(F.least(F.lit(t) / vol, F.lit(cap)))
        lev = F.when(F.col("realized_vol").isNotNull(), lev)
        scaled = scaled.withColumn(f"_l{round(t * 100)}", lev)
    legs = F.array(
        *[
            F.struct(F.lit(float(t)).alias("target"), F.coalesce(lagged(f"_l{round(t * 100)}", 1, keys), F.lit(0.0)).alias("leverage"))
            for t in targets
        ]
    )
    return (
        scaled.withColumn("legs", legs)
        .select(*keys, "date", F.col("r").alias("base_r"), F.inline("legs"))
        .withColumn("r", F.col("base_r") * F.col("leverage"))
    )
