"""Event detection over ordered rows: crosses, setups, transitions, signals, reasons, alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.expr import norm_cdf, notes, safe_div, truth
from marketloom.functions.rolling import lagged, over, pct_change, rolling_mean, with_position
from marketloom.operators.indicators import crossed_above, crossed_below, sma


def golden_cross(bars: DataFrame) -> DataFrame:
    return sma(bars, (50, 200)).withColumn("golden_cross", crossed_above("sma50", "sma200")).filter("golden_cross")


def cross_events(table: DataFrame) -> DataFrame:
    """One row per (ticker, date, event) over an indicator table."""
    rules = (
        (crossed_above("close", "sma50"), "price above SMA50"),
        (crossed_below("close", "sma50"), "price below SMA50"),
        (crossed_above("close", "sma200"), "price above SMA200"),
        (crossed_below("close", "sma200"), "price below SMA200"),
        (crossed_above("sma50", "sma200"), "golden cross"),
        (crossed_above("macd", "macd_signal"), "MACD bullish"),
        (truth((F.col("mrs") > 0) & (lagged("mrs") <= 0)), "RS breakout"),
    )
    flags = table
    names = []
    for i, (cond, _) in enumerate(rules):
        names.append(f"_e{i}")
        flags = flags.withColumn(names[-1], cond)
    found = notes(*[(F.col(n), text) for n, (_, text) in zip(names, rules)])
    return flags.select("ticker", "date", F.explode(found).alias("event"))


def technical_screen(table: DataFrame, levels: DataFrame) -> DataFrame:
    """Setup flags of the latest row; `levels` carries support and resistance per ticker."""
    flagged = table.withColumn("macd_cross", crossed_above("macd", "macd_signal"))
    latest = with_position(flagged).filter(F.col("rn") == 1)
    c, hi = F.col("close"), F.col("high_52w")
    trend = (c > F.col("sma50")) & (F.col("sma50") > F.col("sma200"))
    out = (
        latest.withColumn("breakout", truth(c >= hi * 0.98))
        .withColumn("new_52w_high", truth(c >= hi * 0.995))
        .withColumn("price_above_sma50", truth(c > F.col("sma50")))
        .withColumn("price_above_sma200", truth(c > F.col("sma200")))
    )
    setup = notes(
        (F.col("breakout"), "52-week high pressure"),
        (F.col("macd_cross"), "MACD bullish crossover"),
        (trend, "trend continuation"),
        (F.col("rv") >= 1.5, "volume surge"),
    )
    out = out.withColumn("setup_type", F.when(F.size(setup) > 0, F.array_join(setup, ", ")).otherwise("No clear setup"))
    return out.join(levels.select("ticker", "support", "resistance", "risk_reward"), "ticker", "left")


def why_now(table: DataFrame, scores: DataFrame, market: DataFrame) -> DataFrame:
    """Best trigger per ticker. `scores`: ticker, risk_reward, final_score, previous_score;
    `market`: one row with risk_environment."""
    reclaim = crossed_above("close", "sma50") | crossed_above("close", "sma200")
    latest = (
        with_position(table.withColumn("reclaimed", reclaim).withColumn("rs_break", truth((F.col("mrs") > 0) & (lagged("mrs") <= 0))))
        .filter(F.col("rn") == 1)
        .join(scores, "ticker", "left")
        .crossJoin(F.broadcast(market.select("risk_environment")))  # one row
    )
    c = F.col("close")
    gain = F.col("final_score") - F.col("previous_score")
    rules: list[tuple[Column, str, Column | str, int, str]] = [
        (F.col("reclaimed"), "Breakout", "Price reclaimed a major moving average", 75, "Close back below the reclaimed moving average"),
        (F.col("rs_break"), "Relative strength acceleration", "Relative strength moved from lagging to leading", 80, "Relative strength falls back below its signal line"),
        (F.col("rv") >= 1.8, "Volume spike", F.format_string("Relative volume reached %.2fx", "rv"), 70, "Volume fades and price cannot hold the move"),
        (c >= F.col("high_52w") * 0.995, "52-week high", "Price is pressing against 52-week highs", 65, "Failed breakout below prior range high"),
        ((F.col("risk_reward") >= 2) & (c > F.coalesce("sma50", F.lit(0.0))), "Pullback to support", "Risk/reward is favorable near recent support", 55, "Support breaks on heavy volume"),
        (gain >= 10, "Rank improvement", F.format_string("Score improved by %.1f points", gain), 85, "Score falls back below prior level"),
    ]
    off = F.col("risk_environment") == "Risk-off"
    items = []
    for i, (cond, reason, text, strength, invalid) in enumerate(rules):
        evidence = text if isinstance(text, Column) else F.lit(text)
        items.append(
            F.when(
                truth(cond),
                F.struct(
                    F.when(off, F.lit(max(0, strength - 25))).otherwise(F.lit(strength)).alias("strength"),
                    F.lit(-i).alias("place"),
                    F.lit(reason).alias("reason"),
                    F.when(off, F.concat(evidence, F.lit("; market regime is risk-off"))).otherwise(evidence).alias("evidence"),
                    F.lit(invalid).alias("invalidates"),
                ),
            )
        )
    out = latest.withColumn("triggers", F.array_compact(F.array(*items))).withColumn("best", F.array_max("triggers"))
    sends = truth(F.col("best.strength") >= 50)
    out = (
        out.withColumn("send_alert", sends)
        .withColumn("reason", F.when(sends, F.col("best.reason")).otherwise("No clear Why Now trigger"))
        .withColumn("evidence", F.when(sends, F.col("best.evidence")).otherwise("No recent statistically meaningful change was detected."))
        .withColumn("strength", F.when(sends, F.col("best.strength")).otherwise(0))
        .withColumn("invalidates", F.when(sends, F.col("best.invalidates")).otherwise("N/A"))
        .withColumn("trigger_count", F.size("triggers"))
    )
    return out.withColumn("signal_type", signal_type(F.col("reason")))


def signal_type(reason: Column) -> Column:
    text = F.lower(reason)
    return (
        F.when(text.contains("breakout"), "breakout")
        .when(text.contains("relative strength"), "relative_strength")
        .when(text.contains("volume"), "volume_spike")
        .when(text.contains("rank"), "rank_improvement")
        .when(text.contains("support"), "pullback_to_support")
        .otherwise("watchlist_change")
    )


STATE_COLUMNS = ("close", "sma50", "sma200", "rsi_weekly", "rsi_monthly", "mrs", "rv", "high_52w", "low_52w", "is_stage_2")


def state_row(latest: DataFrame, *others: str) -> DataFrame:
    """The stored state of a ticker, with the defaults for missing values; `others` are kept beside it."""
    fill = {"close": 0.0, "sma50": 0.0, "sma200": 0.0, "rsi_weekly": 50.0, "rsi_monthly": 50.0, "mrs": 0.0, "rv": 1.0}
    cols = [F.coalesce(c, F.lit(v)).alias(c) for c, v in fill.items()]
    out = latest.select("ticker", *others, *cols, "high_52w", "low_52w")
    return out.withColumn("is_stage_2", (F.col("close") > F.col("sma50")) & (F.col("sma50") > F.col("sma200")))


def transition_alerts(
    now: str, before: str, weekly_breakdown: float = 40.0, monthly_breakout: float = 40.0, volume_alert: float = 2.0
) -> Column:
    """Alert texts between two snapshots held in the structs `now` and `before`."""
    c = lambda n: F.col(f"{now}.{n}")
    p = lambda n: F.col(f"{before}.{n}")
    stage = truth((c("close") > c("sma50")) & (c("sma50") > c("sma200")))
    was = truth(p("is_stage_2"))
    rs, prs = F.coalesce(c("mrs"), F.lit(0.0)), F.coalesce(p("mrs"), F.lit(0.0))
    rv, prv = F.coalesce(c("rv"), F.lit(1.0)), F.coalesce(p("rv"), F.lit(1.0))

    def above(a: Column, pa: Column, b: Column, pb: Column) -> Column:
        return truth((a > b) & (pa <= pb))

    def below(a: Column, pa: Column, b: Column, pb: Column) -> Column:
        return truth((a < b) & (pa >= pb))

    mb, wb = F.lit(monthly_breakout), F.lit(weekly_breakdown)
    rules = [
        (stage & ~was, F.lit("Entered Stage 2 alignment")),
        (~stage & was, F.lit("Exited Stage 2 alignment")),
        ((rs > 0) & (prs <= 0), F.lit("RS breakout vs benchmark")),
        ((rs < 0) & (prs >= 0), F.lit("RS breakdown vs benchmark")),
        ((rv >= volume_alert) & (prv < volume_alert), F.format_string("Volume spike: %.1fx normal", rv)),
        (above(c("close"), p("close"), c("sma200"), p("sma200")), F.lit("Price crossed above SMA200")),
        (below(c("close"), p("close"), c("sma200"), p("sma200")), F.lit("Price crossed below SMA200")),
        (above(c("close"), p("close"), c("sma50"), p("sma50")), F.lit("Price crossed above SMA50")),
        (below(c("close"), p("close"), c("sma50"), p("sma50")), F.lit("Price crossed below SMA50")),
        (above(c("rsi_monthly"), p("rsi_monthly"), mb, mb), F.format_string("Monthly RSI crossed above %.0f", mb)),
        (below(c("rsi_weekly"), p("rsi_weekly"), wb, wb), F.format_string("Weekly RSI crossed below %.0f", wb)),
        (truth((c("close") >= c("high_52w")) & (p("close") < p("high_52w"))), F.lit("New 52-week high")),
        (truth((c("close") <= c("low_52w")) & (p("close") > p("low_52w"))), F.lit("New 52-week low")),
    ]
    return notes(*rules)


FIRST_RUN = "Initial data recorded. Monitoring for transitions."


def state_transitions(current: DataFrame, previous: DataFrame, **limits: float) -> DataFrame:
    """Alerts per ticker against the stored state; a ticker without state reports its first run."""
    fields = [c for c in STATE_COLUMNS if c != "is_stage_2"]
    now = current.select("ticker", F.struct(*fields).alias("now"))
    old = previous.select("ticker", F.struct(*STATE_COLUMNS).alias("before"))
    out = now.join(old, "ticker", "left")
    return out.withColumn(
        "alerts", F.when(F.col("before").isNull(), F.array(F.lit(FIRST_RUN))).otherwise(transition_alerts("now", "before", **limits))
    )


def field_changes(current: DataFrame, previous: DataFrame, fields: Sequence[str] = ("overall_view", "trend", "volume_status", "confidence")) -> DataFrame:
    """First changed label per ticker, in field order; null labels compare as equal."""
    cur = current.select("ticker", F.struct(*fields).alias("cur"))
    old = previous.select("ticker", F.struct(*fields).alias("old"))
    changes = F.array_compact(
        F.array(
            *[
                F.when(
                    ~F.col(f"cur.{f}").eqNullSafe(F.col(f"old.{f}")),
                    F.struct(F.lit(f).alias("field"), F.col(f"old.{f}").alias("from_label"), F.col(f"cur.{f}").alias("to_label")),
                )
                for f in fields
            ]
        )
    )
    return (
        cur.join(old, "ticker")
        .withColumn("_c", changes)
        .filter(F.size("_c") > 0)
        .select("ticker", F.col("_c")[0].alias("_first"))
        .select("ticker", "_first.*")
    )


# fixed values: signal type, score, reason
HIST_SIGNALS = (
    ("sma50_reclaim", 62, "Price reclaimed SMA50 while above SMA200."),
    ("high_volume_52w_breakout", 72, "Price pressed a 52-week high with above-average volume."),
    ("relative_strength_leadership", 68, "60-day return outperformed SPY by more than 5 percentage points."),
)


def hist_signals(bars: DataFrame, benchmark: DataFrame, ahead: int = 126, per_day: int | None = None) -> DataFrame:
    """Historical signals with at least 201 rows behind and `ahead` rows after them. Every
    rule that holds on a day counts; `per_day` keeps only the first so many. The benchmark close is carried onto the ticker's dates."""
    joined = bars.join(benchmark.select("date", F.col("close").alias("bench_close")), "date", "left")
    c = F.col("close")
    prior_high = F.max(c).over(over().rowsBetween(-252, -1))
    full = F.count(c).over(over().rowsBetween(-252, -1)) >= 252
    t = (
        with_position(joined)
        .withColumn("bench_close", F.last("bench_close", ignorenulls=True).over(over().rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("sma50", rolling_mean(c, 50))
        .withColumn("sma200", rolling_mean(c, 200))
        .withColumn("vol_avg", rolling_mean(F.col("volume"), 20))
        .withColumn("high_252", F.when(full, prior_high))
        .withColumn("rs_60", pct_change("close", 60) - pct_change("bench_close", 60))
        .withColumn("prev_close", lagged("close"))
        .withColumn("prev_sma50", lagged("sma50"))
    )
    rules = (
        (F.col("prev_close") <= F.col("prev_sma50")) & (c > F.col("sma50")) & (c > F.col("sma200")),
        (c >= F.col("high_252") * 0.995) & (F.col("volume") > F.col("vol_avg") * 1.2),
        (F.col("rs_60") > 0.05) & (c > F.col("sma50")) & (F.col("sma50") > F.col("sma200")),
    )
    found = F.array_compact(
        F.array(
            *[
                F.when(truth(cond), F.struct(F.lit(n).alias("signal_type"), F.lit(s).alias("score"), F.lit(r).alias("reason")))
                for cond, (n, s, r) in zip(rules, HIST_SIGNALS)
            ]
        )
    )
    keep = (F.col("n_rows") >= 260) & (F.col("i") >= 201) & (F.col("i") < F.col("n_rows") - ahead) & F.col("sma200").isNotNull()
    return t.filter(keep).withColumn("_s", found if per_day is None else F.slice(found, 1, per_day)).select(
        "ticker", "sector", "date", c.alias("entry_price"), F.inline("_s")
    )


def return_zscore(bars: DataFrame, keys: Sequence[str] = ("ticker",), order: str = "date", lookback: int = 252) -> DataFrame:
    """Every row's return against the up to lookback-1 returns before it (at least 30 in all). A zero price makes
    the return after it infinite, so there is no score while one lies in the lookback."""
    r = F.col("r")
    before = over(keys, order).rowsBetween(-(lookback - 1), -1)
    seen = F.count(r).over(before)
    sd = F.stddev_samp(r).over(before)
    after_zero = (lagged("close", 1, keys, order) == 0).cast("int")
    broken = F.coalesce(F.max("_after_zero").over(over(keys, order).rowsBetween(-(lookback - 1), 0)), F.lit(0)) == 1
    out = bars.withColumn("r", pct_change("close", 1, keys, order)).withColumn("_after_zero", after_zero)
    out = out.withColumn("z_score", F.when((seen >= 29) & ~broken, safe_div(r - F.avg(r).over(before), sd)))
    return with_abnormality(out.drop("_after_zero"))


def with_abnormality(scored: DataFrame) -> DataFrame:
    """`abnormality` and `normal_percentile` of the column `z_score`."""
    z = F.col("z_score")
    side = F.when(z > 0, "upside").otherwise("downside")
    return scored.withColumn(
        "abnormality",
        F.when(z.isNull(), "Normal")
        .when(F.abs(z) >= 3, F.concat(F.lit("extremely unusual "), side, F.lit(" move")))
        .when(F.abs(z) >= 2, F.concat(F.lit("unusual "), side, F.lit(" move")))
        .otherwise("normal range"),
    ).withColumn("normal_percentile", (2 * norm_cdf(F.abs(z)) - 1) * 100)


def session_vwap(bars: DataFrame, keys: Sequence[str] = ("ticker",), order: str = "ts", n: int = 78) -> DataFrame:
    """Cumulative typical-price VWAP of the last n bars, per bar; `prev_vwap` is its value one
    bar earlier within the same n bars."""
    tp = (F.col("high") + F.col("low") + F.col("close")) / 3
    flow = tp * F.coalesce("volume", F.lit(0.0))
    vol = F.coalesce("volume", F.lit(0.0))
    here, before = over(keys, order).rowsBetween(-(n - 1), 0), over(keys, order).rowsBetween(-(n - 1), -1)
    return bars.withColumn("vwap", safe_div(F.sum(flow).over(here), F.sum(vol).over(here))).withColumn(
        "prev_vwap", safe_div(F.sum(flow).over(before), F.sum(vol).over(before))
    )


def intraday_reasons(bars: DataFrame, move_pct: float = 2.0, ratio: float = 2.0, lookback: int = 20, z_limit: float = 2.0) -> DataFrame:
    """Reasons per five-minute bar, as if it were the latest. Frames are bounded row counts."""
    keys, order = ("ticker",), "ts"
    w = over(keys, order)
    c = F.col("close")
    out = session_vwap(return_zscore(bars, keys, order), keys, order)
    prior = w.rowsBetween(-lookback, -1)
    # the mean volume runs over the rows present, the bar included
    avg_vol = F.avg("volume").over(w.rowsBetween(-19, 0))
    out = (
        out.withColumn("i", F.row_number().over(w) - 1)
        .withColumn("prev", lagged("close", 1, keys, order))
        .withColumn("move_pct", F.coalesce(safe_div(c - F.col("prev"), F.col("prev")) * 100, F.lit(0.0)))
        .withColumn("volume_ratio", F.coalesce(safe_div(F.col("volume"), avg_vol), F.lit(0.0)))
        .withColumn("prior_high", F.when(F.col("i") >= lookback, F.max("high").over(prior)))
        .withColumn("prior_low", F.when(F.col("i") >= lookback, F.min("low").over(prior)))
        .withColumn("sma20", rolling_mean(c, 20, keys, order))
        .withColumn("sma50", rolling_mean(c, 50, keys, order))
        .withColumn("prev20", lagged("sma20", 1, keys, order))
        .withColumn("prev50", lagged("sma50", 1, keys, order))
    )
    return bar_rules(out, move_pct, ratio, z_limit)


def bar_rules(features: DataFrame, move_pct: float = 2.0, ratio: float = 2.0, z_limit: float = 2.0) -> DataFrame:
    """`reasons` of a bar from its features; the one rule table of the batch and the stream."""
    out, c = features, F.col("close")
    p, m = F.col("prev"), F.col("move_pct")
    long = F.col("i") >= 50
    wide = F.col("i") >= 2
    z = F.col("z_score")
    fmt = F.format_string
    reasons = notes(
        (F.abs(z) >= z_limit, fmt("abnormal move z-score %+.2f (%s; larger than ~%.1f%% of normal bars)", z, "abnormality", "normal_percentile")),
        (F.abs(m) >= move_pct, fmt("5m price move %+.2f%%", m)),
        (F.col("volume_ratio") >= ratio, fmt("volume spike %.1fx", "volume_ratio")),
        (c >= F.col("prior_high"), fmt("intraday breakout above %.2f", "prior_high")),
        (c <= F.col("prior_low"), fmt("intraday breakdown below %.2f", "prior_low")),
        (long & (p <= F.col("prev20")) & (c > F.col("sma20")), "price reclaimed intraday SMA20"),
        (long & (p >= F.col("prev20")) & (c < F.col("sma20")), "price lost intraday SMA20"),
        (long & (F.col("prev20") <= F.col("prev50")) & (F.col("sma20") > F.col("sma50")), "intraday SMA20 crossed above SMA50"),
        (long & (F.col("prev20") >= F.col("prev50")) & (F.col("sma20") < F.col("sma50")), "intraday SMA20 crossed below SMA50"),
        (wide & (p <= F.col("prev_vwap")) & (c > F.col("vwap")), "price reclaimed session VWAP"),
        (wide & (p >= F.col("prev_vwap")) & (c < F.col("vwap")), "price lost session VWAP"),
    )
    return out.withColumn("reasons", F.array_sort(F.array_distinct(reasons)))


def alert_key(ticker: Column, at: Column, reasons: Column) -> Column:
    return F.concat_ws(":", ticker, at.cast("string"), F.array_join(F.array_sort(F.array_distinct(reasons)), "|"))


def alert_union(price: DataFrame, earnings: DataFrame, portfolio: DataFrame) -> DataFrame:
    """(ticker, reason) rows of three sources merged into one sorted reason list per ticker.
    Reasons collapse per (ticker, reason) first, so a list holds distinct texts only."""
    rows = price.select("ticker", "reason").unionByName(earnings.select("ticker", "reason")).unionByName(
        portfolio.select(F.lit("PORTFOLIO").alias("ticker"), "reason")
    )
    return rows.distinct().groupBy("ticker").agg(F.sort_array(F.collect_list("reason")).alias("reasons"))


def confounders(bars: DataFrame, earnings_dates: DataFrame, as_of: DataFrame, first: int = -2, last: int = 10) -> DataFrame:
    """Common reasons why abnormal activity needs no buyer. `earnings_dates`: ticker,
    next_earnings_date; `as_of`: one row with the report date."""
    ranked = with_position(bars.withColumn("r", pct_change("close")).filter(F.col("r").isNotNull()))
    moves = ranked.filter(F.col("rn") <= 20).groupBy("ticker").agg(
        F.max("n_rows").alias("returns"),
        F.max(F.when(F.col("rn") == 1, F.abs("r"))).alias("last_move"),
        F.stddev_samp("r").alias("sd20"),
    )
    days = F.datediff(F.col("next_earnings_date"), F.col("as_of"))
    near = truth((days >= first) & (days <= last))
    large = truth((F.col("returns") >= 20) & (F.col("last_move") > F.greatest(F.lit(0.07), F.col("sd20") * 3)))
    return (
        moves.join(earnings_dates, "ticker", "left")
        .crossJoin(F.broadcast(as_of))  # one row
        .withColumn("days_to_earnings", days)
        .withColumn("earnings_near", near)
        .withColumn("large_move", large)
        .withColumn(
            "confounders",
            notes(
                (near, F.concat(F.lit("Earnings are near ("), F.col("next_earnings_date").cast("string"), F.lit(")."))),
                (large, "A very large price move may reflect news or event trading."),
            ),
        )
    )
