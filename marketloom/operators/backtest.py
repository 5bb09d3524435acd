"""Walk-forward tests, rotation backtests and resampled scenarios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.expr import product
from marketloom.functions.rolling import lagged, pct_change, with_position
from marketloom.operators import risk
from marketloom.session import keep


def wf_positions(rows: DataFrame, train: int = 252, test: int = 63, percentile: float = 0.75, cost_bps: float = 10) -> DataFrame:
    """Out-of-sample positions and net returns of a long-only signal (columns close, signal).

    Each fold's threshold is the percentile of the `train` rows before it; a row is listed once
    per fold it trains (train/test + 1 at most). Positions act on the next row.
    """
    clean = with_position(rows.filter(F.col("signal").isNotNull())).filter(F.col("n_rows") >= train + test)
    fold = F.floor((F.col("i") - train) / test)
    # row i trains fold f when f*test <= i < f*test + train
    lo = F.greatest(F.ceil((F.col("i") - train + 1) / test), F.lit(0))
    hi = F.least(F.floor(F.col("i") / test), F.ceil((F.col("n_rows") - train) / test) - 1)
    trained = clean.filter(lo <= hi).withColumn("fold", F.explode(F.sequence(lo, hi)))
    limits = trained.groupBy("ticker", "fold").agg(F.percentile("signal", F.lit(percentile)).alias("threshold"))
    placed = clean.withColumn("fold", F.when(F.col("i") >= train, fold)).join(limits, ["ticker", "fold"], "left")
    hold = F.when(F.col("threshold").isNotNull(), (F.round("signal", 12) >= F.round("threshold", 12)).cast("double")).otherwise(F.lit(0.0))
    out = (
        placed.withColumn("ret", F.coalesce(pct_change("close"), F.lit(0.0)))
        .withColumn("position", hold)
        .withColumn("gross", F.coalesce(lagged("position"), F.lit(0.0)) * F.col("ret"))
        .withColumn("turnover", F.coalesce(F.abs(F.col("position") - lagged("position")), F.lit(0.0)))
        .withColumn("cost", F.col("turnover") * cost_bps / 10000)
        .withColumn("r", F.col("gross") - F.col("cost"))
    )
    return out.filter(F.col("i") >= train)


def wf_summary(positions: DataFrame) -> DataFrame:
    return positions.groupBy("ticker").agg(
        (product(1 + F.col("gross")) - 1).alias("gross_return"),
        (product(1 + F.col("r")) - 1).alias("net_return"),
        F.sum("cost").alias("drag"),
        F.avg("position").alias("average_exposure"),
        F.sum("turnover").alias("turnover"),
        F.countDistinct("fold").alias("folds"),
    )


def wf_signal_backtest(rows: DataFrame, **options) -> DataFrame:
    pos = wf_positions(rows, **options)
    return wf_summary(pos).join(risk.performance_report(pos), "ticker")


def equity_curve(returns: DataFrame, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    run = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return returns.withColumn("equity", F.exp(F.sum(F.log1p("r")).over(run)))


def fold_robustness(positions: DataFrame) -> DataFrame:
    folds = positions.groupBy("ticker", "fold").agg((product(1 + F.col("r")) - 1).alias("fold_return"), F.count(F.lit(1)).alias("rows"))
    return folds.groupBy("ticker").agg(
        F.sum("rows").alias("sample_size"),
        F.count(F.lit(1)).alias("fold_count"),
        F.avg((F.round("fold_return", 14) > 0).cast("double")).alias("positive_fold_pct"),
        F.min("fold_return").alias("worst_fold_return"),
        F.max("fold_return").alias("best_fold_return"),
        F.stddev_samp("fold_return").alias("return_stability"),
    )


def momentum_backtest(matrix: DataFrame, horizons: Sequence[int] = (126,), top_n: int = 5, cost_bps: float = 10) -> tuple[DataFrame, DataFrame]:
    """Month-end rotation into the top names by lookback return: (daily returns, selections).

    Only month-end rows are ranked, the selections (top_n per horizon and month) are joined to
    the returns of the days they cover, and turnover compares neighbouring selections.
    """
    matrix = keep(matrix)  # calendar, ranking and returns read it
    # the calendar: one row per trading date, so its ordered partition is bounded
    cal = matrix.select("date").distinct()
    whole = Window.partitionBy(F.lit(0)).orderBy("date")
    cal = cal.withColumn("pos", F.row_number().over(whole) - 1).withColumn("month", F.last_day("date"))
    ends = cal.groupBy("month").agg(F.max("date").alias("date"), F.max("pos").alias("pos"))
    w = Window.partitionBy("ticker").orderBy("date")
    legs = F.array(*[F.struct(F.lit(h).alias("lookback"), (F.col("close") / F.lag("close", h).over(w) - 1).alias("momentum")) for h in horizons])
    scored = (
        matrix.withColumn("legs", legs)
        .join(ends.select("date", "pos"), "date")
        .select("ticker", "date", "pos", F.inline("legs"))
        .filter(F.col("momentum").isNotNull() & (F.col("pos") >= F.col("lookback")))
    )
    rank = F.row_number().over(Window.partitionBy("lookback", "date").orderBy(F.desc("momentum"), "ticker"))
    size = F.count(F.lit(1)).over(Window.partitionBy("lookback", "date"))
    picks = scored.withColumn("rank", rank).filter(F.col("rank") <= top_n).withColumn("weight", 1.0 / size).drop("pos", "rank")
    picks = keep(picks)  # a few rows per month, read by the returns and the turnover
    # rebalance dates per horizon, each with the next one (at most one per month)
    turns = picks.select("lookback", "date").distinct().withColumn("until", F.lead("date").over(Window.partitionBy("lookback").orderBy("date")))
    returns = matrix.withColumn("r", pct_change("close")).select("ticker", "date", "r")
    # a return on day t belongs to the last rebalance before t
    last = cal.agg(F.max("date").alias("_last"))  # one row
    owner = (
        turns.withColumnRenamed("date", "start")
        .crossJoin(F.broadcast(last))
        .filter(F.col("start") < F.col("_last"))
        .select("lookback", "start", F.explode(F.sequence(F.date_add("start", 1), F.coalesce("until", "_last"))).alias("date"))
        .join(cal.select("date"), "date", "left_semi")
    )
    held = picks.withColumnRenamed("date", "start").select("lookback", "start", "ticker", "weight")
    gross = (
        owner.join(held, ["lookback", "start"])
        .join(returns, ["ticker", "date"])
        .groupBy("lookback", "date")
        .agg(F.sum(F.col("weight") * F.coalesce("r", F.lit(0.0))).alias("gross"))
    )
    prev = turns.select("lookback", F.col("until").alias("date"), F.col("date").alias("start")).filter(F.col("date").isNotNull())
    old = prev.join(held, ["lookback", "start"]).select("lookback", "date", "ticker", F.col("weight").alias("old"))
    new = picks.select("lookback", "date", "ticker", F.col("weight").alias("new"))
    turnover = (
        new.join(old, ["lookback", "date", "ticker"], "full_outer")
        .groupBy("lookback", "date")
        .agg(F.sum(F.abs(F.coalesce("new", F.lit(0.0)) - F.coalesce("old", F.lit(0.0)))).alias("turnover"))
    )
    hs = F.explode(F.array(*[F.lit(h) for h in horizons])).alias("lookback")
    daily = (
        cal.select("date", "pos", hs)
        .join(gross, ["lookback", "date"], "left")
        .join(turnover, ["lookback", "date"], "left")
        .withColumn("turnover", F.when(F.col("pos") > 0, F.coalesce("turnover", F.lit(0.0))).otherwise(F.lit(0.0)))
        .withColumn("r", F.coalesce("gross", F.lit(0.0)) - F.col("turnover") * cost_bps / 10000)
    )
    return daily.select("lookback", "date", "r", "turnover"), picks


def resample_index(seed: int, ticker: Column, sim: Column, day: Column, n: Column, mode: str) -> Column:
    """Which historical return a (simulation, day) draws. `hash` mixes all keys; `arithmetic`
    is the plain modular form that other engines can repeat."""
    if mode == "hash":
        return F.pmod(F.xxhash64(F.lit(seed), ticker, sim, day), n)
    if mode == "arithmetic":
        return F.pmod(sim * 7919 + day * 104729 + seed, n)
    raise ValueError("mode is hash or arithmetic")


def return_arrays(bars: DataFrame, lookback: int | None = 252) -> DataFrame:
    """One row per ticker: its returns in time order (the last `lookback`, or all: one value per
    trading date) and its last price."""
    ranked = with_position(bars.withColumn("r", pct_change("close")))
    rows = ranked if lookback is None else ranked.filter(F.col("rn") <= lookback)
    return rows.groupBy("ticker").agg(
        F.transform(F.sort_array(F.collect_list(F.when(F.col("r").isNotNull(), F.struct("i", "r")))), lambda s: s["r"]).alias("returns"),
        F.max_by("close", "i").alias("price"),
    )


def sorted_quantile(values: Column, p: float) -> Column:
    """Linearly interpolated quantile of an ascending array."""
    at = (F.size(values) - 1) * p
    lo, hi = F.get(values, F.floor(at).cast("int")), F.get(values, F.ceil(at).cast("int"))
    w = at - F.floor(at)
    return lo * (1 - w) + hi * w


def regime_filter(series: DataFrame, condition: str | None, least: int = 20) -> DataFrame:
    """Keep the returns at or below (Weak) or above (Supportive) the median, if enough remain."""
    if condition not in ("Weak", "Supportive"):
        return series
    mid = sorted_quantile(F.sort_array("returns"), 0.5)
    kept = F.filter("returns", (lambda r: r <= F.col("_m")) if condition == "Weak" else (lambda r: r >= F.col("_m")))
    rows = series.withColumn("_m", mid).withColumn("_f", kept)
    return rows.withColumn("returns", F.when(F.size("_f") >= least, F.col("_f")).otherwise(F.col("returns"))).drop("_m", "_f")


def path_array(n: Column, horizon: int, simulations: int, seed: int, block: int | None, mode: str) -> Column:
    """Array of (g, dd) per simulation: terminal growth and worst drawdown of a path drawn from
    the row's own `returns`. Everything happens inside the row."""

    def draw(sim: Column, day: Column) -> Column:
        if block:
            starts = F.greatest(n - block + 1, F.lit(1))
            first = resample_index(seed, F.col("ticker"), sim, F.floor(day / block), starts, mode)
            at = F.pmod(first + F.pmod(day, F.lit(block)), n)
        else:
            at = resample_index(seed, F.col("ticker"), sim, day, n, mode)
        return F.get(F.col("returns"), at.cast("int"))

    zero = F.struct(F.lit(1.0).alias("g"), F.lit(0.0).alias("top"), F.lit(0.0).alias("dd"))

    def step(sim: Column, acc: Column, day: Column) -> Column:
        g = acc["g"] * (1 + draw(sim, day))
        top = F.greatest(acc["top"], g)
        return F.struct(g.alias("g"), top.alias("top"), F.least(acc["dd"], g / top - 1).alias("dd"))

    days = F.sequence(F.lit(0), F.lit(horizon - 1))
    return F.transform(F.sequence(F.lit(0), F.lit(simulations - 1)), lambda sim: F.aggregate(days, zero, lambda acc, day: step(sim, acc, day)))


def bootstrap_scenarios(
    bars: DataFrame, horizon: int = 30, simulations: int = 5000, lookback: int = 252, minimum: int = 90, seed: int = 42,
    method: str = "standard", block: int = 5, condition: str | None = None, mode: str = "hash",
) -> DataFrame:
    """Terminal percentiles, tail shares and drawdown percentiles of resampled paths.

    A ticker's paths are drawn, folded and summarised inside its own row from the array of its
    last returns; after the returns are gathered nothing is exploded or shuffled.
    """
    series = return_arrays(bars, lookback).filter(F.size("returns") >= minimum)
    if method == "regime_conditioned":
        series = regime_filter(series, condition)
    n = F.size("returns")
    rows = series.withColumn("paths", path_array(n, horizon, simulations, seed, block if method == "block" else None, mode))
    rows = rows.select(
        "ticker",
        n.alias("sample"),
        F.col("price").alias("current_price"),
        F.sort_array(F.transform("paths", lambda p: F.col("price") * p["g"])).alias("_end"),
        F.sort_array(F.transform("paths", lambda p: p["dd"] * 100)).alias("_dd"),
        F.transform("paths", lambda p: p["g"] - 1).alias("_t"),
    )
    share = lambda test: F.size(F.filter("_t", test)) / F.size("_t") * 100
    out = rows.select(
        "ticker",
        "sample",
        "current_price",
        *[sorted_quantile(F.col("_end"), p / 100).alias(f"p{p}") for p in (5, 10, 25, 50, 75, 90, 95)],
        *[sorted_quantile(F.col("_dd"), p / 100).alias(f"dd{p}") for p in (50, 80, 90, 95)],
        share(lambda t: t > 0).alias("ending_higher_pct"),
        share(lambda t: t <= -0.05).alias("down_5_pct"),
        share(lambda t: t <= -0.10).alias("down_10_pct"),
        share(lambda t: t >= 0.05).alias("up_5_pct"),
        share(lambda t: t >= 0.10).alias("up_10_pct"),
    )
    up, down = F.col("ending_higher_pct"), F.col("down_10_pct")
    return (
        out.withColumn("outlook", F.when(up >= 58, "Moderately Positive").when(up <= 45, "Cautious").otherwise("Mixed"))
        .withColumn("risk_level", F.when(down >= 25, "High").when(down >= 10, "Moderate").otherwise("Lower"))
        .withColumn("confidence", F.when(F.col("sample") >= 180, "Medium").otherwise("Low"))
        .withColumn("coverage", F.when(F.col("sample") >= lookback * 0.8, "Good").otherwise("Partial"))
    )


def outcome_frequencies(bars: DataFrame, horizon: int = 30) -> DataFrame:
    """How often a ticker stood higher, or at least a tenth lower, `horizon` bars after each of its bars.
    Plain historical shares in percent, no model; bars without a positive close and tickers without a whole
    horizon are left out."""
    own = Window.partitionBy("ticker").orderBy("date")
    later = bars.filter(F.col("close") > 0).select("ticker", F.round(F.lead("close", horizon).over(own) / F.col("close") - 1, 9).alias("r"))
    n, r = F.col("sample_size"), F.col("r")
    counted = later.groupBy("ticker").agg(
        F.count("r").alias("sample_size"), F.count(F.when(r > 0, 1)).alias("_up"), F.count(F.when(r <= -0.1, 1)).alias("_down")
    )
    return counted.filter(n > 0).select(
        "ticker", "sample_size", (100.0 * F.col("_up") / n).alias("ending_higher_pct"), (100.0 * F.col("_down") / n).alias("down_10_pct"),
        F.when(n >= 180, "Medium").otherwise("Low").alias("confidence"),
    )


def model_disagreement(returns: DataFrame, lookback: int = 252) -> DataFrame:
    """30-row against lookback volatility."""
    out = with_position(returns).groupBy("ticker").agg(
        F.max("n_rows").alias("n"),
        F.stddev_samp(F.when(F.col("rn") <= 30, F.col("r"))).alias("recent"),
        F.stddev_samp(F.when(F.col("rn") <= lookback, F.col("r"))).alias("longer"),
    )
    ratio = F.try_divide(F.col("recent"), F.col("longer"))
    out = out.withColumn("ratio", ratio)
    r = F.col("ratio")
    return out.withColumn(
        "model_disagreement",
        F.when((F.col("n") < 120) | r.isNull(), "High").when((r > 1.8) | (r < 0.55), "High").when((r > 1.35) | (r < 0.75), "Medium").otherwise("Low"),
    )


def forecast_calibration(bars: DataFrame, horizon: int = 30, simulations: int = 500, minimum: int = 90, step: int = 10, seed: int = 7, mode: str = "hash") -> DataFrame:
    """Interval and direction calibration of resampled forecasts from every `step`-th row, each
    drawn only from the returns before it."""
    series = return_arrays(bars, None).join(bars.groupBy("ticker").agg(F.transform(F.sort_array(F.collect_list(F.struct("date", "close"))), lambda s: s["close"]).alias("closes")), "ticker")
    n = F.size("returns")
    origins = series.filter(n - horizon > minimum).withColumn("origin", F.explode(F.sequence(F.lit(minimum), n - horizon - 1, F.lit(step))))
    origins = origins.withColumn("now", F.get("closes", F.col("origin"))).withColumn("then", F.get("closes", F.col("origin") + horizon)).drop("closes", "price")
    paths = path_array(F.col("origin"), horizon, simulations, seed, None, mode)
    ends = origins.withColumn("_e", F.sort_array(F.transform(paths, lambda p: F.col("now") * p["g"]))).drop("returns")
    f = ends.select(
        "ticker",
        "now",
        "then",
        *[sorted_quantile(F.col("_e"), int(q) / 100).alias(f"q{q}") for q in ("05", "10", "25", "50", "75", "90", "95")],
        (F.size(F.filter("_e", lambda e: e > F.col("now"))) / F.size("_e")).alias("prob_up"),
    )
    up = F.col("then") >= F.col("now")
    y = up.cast("double")
    hit = (F.col("prob_up") >= 0.5) == up
    inside = lambda a, b: F.col("then").between(F.col(a), F.col(b)).cast("double")
    out = f.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("sample_size"),
        F.avg(inside("q25", "q75")).alias("coverage_50"),
        F.avg(inside("q10", "q90")).alias("coverage_80"),
        F.avg(inside("q05", "q95")).alias("coverage_90"),
        F.avg(hit.cast("double")).alias("directional_hit_rate"),
        F.avg((F.col("prob_up") - y) * (F.col("prob_up") - y)).alias("brier_score"),
        F.median(F.abs(F.col("q50") - F.col("then")) / F.col("now")).alias("median_absolute_error"),
        F.avg(((F.abs(F.col("prob_up") - 0.5) >= 0.25) & ~hit).cast("double")).alias("false_confidence_rate"),
        F.avg(y).alias("baseline_hit_rate"),
    )
    return out.withColumn("calibration_error", F.abs(F.col("coverage_80") - 0.8)).withColumn(
        "warning", F.when(F.col("sample_size") < 30, "Small validation sample; treat calibration as provisional.")
    )
