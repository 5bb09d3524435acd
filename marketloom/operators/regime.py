"""Market regime: index trend, health score, environment, clustered states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.expr import safe_div, truth
from marketloom.functions.rolling import with_position
from marketloom.operators.factors import sector_momentum
from marketloom.session import cut_lineage, keep

# fixed values: sectors that lead in risk-on and in defensive markets
RISK_ON = ("Technology", "Consumer Discretionary", "Financials", "Industrials")
DEFENSIVE = ("Utilities", "Consumer Staples", "Healthcare")

# fixed values: regime, posture, preferred, avoid
STRATEGIES = (
    ("Bull Trend", "Risk-on", ("momentum", "growth", "breakouts"), ("premature mean reversion",)),
    ("Bear Trend", "Defensive", ("quality", "low volatility", "cash"), ("leveraged dip buying",)),
    ("Sideways", "Selective", ("pairs trading", "mean reversion", "income"), ("late breakouts",)),
    ("High Volatility", "Reduced size", ("quality", "volatility targeting"), ("tight stops", "high leverage")),
    ("Crash", "Capital preservation", ("liquidity", "hedges"), ("uncapped leverage", "illiquid trades")),
    ("Recovery", "Gradually add risk", ("cyclicals", "small caps", "improving momentum"), ("chasing the first rebound",)),
)
NEUTRAL = ("Neutral", ("diversification",), ("concentrated bets",))


def index_trend(indices: DataFrame, key: str = "name") -> DataFrame:
    """Latest close against its 20/50/200-row means, 1/3-month returns and 21-row volatility."""
    ranked = with_position(indices, (key,))
    r = safe_div(F.col("close"), F.lag("close").over(Window.partitionBy(key).orderBy("date"))) - 1
    ranked = ranked.withColumn("r", r).filter(F.col("rn") <= 200)
    px = lambda n: F.max(F.when(F.col("rn") == n, F.col("close")))
    mean = lambda n: F.when(F.max("n_rows") >= n, F.avg(F.when(F.col("rn") <= n, F.col("close"))))
    out = ranked.groupBy(key).agg(
        px(1).alias("latest"),
        mean(20).alias("sma20"),
        mean(50).alias("sma50"),
        mean(200).alias("sma200"),
        F.coalesce(px(1) / px(22) - 1, F.lit(0.0)).alias("one_month_return"),
        F.coalesce(px(1) / px(64) - 1, F.lit(0.0)).alias("three_month_return"),
        F.coalesce(F.stddev_samp(F.when(F.col("rn") <= 21, F.col("r"))) * F.sqrt(F.lit(252.0)), F.lit(0.0)).alias("volatility"),
    )
    for n in (20, 50, 200):
        out = out.withColumn(f"above_sma{n}", truth(F.col("latest") > F.col(f"sma{n}")))
    above = sum(F.col(f"above_sma{n}").cast("int") for n in (20, 50, 200))
    return out.withColumn("trend_score", F.round(above / 3 * 100, 2))


def vix_status(level: Column) -> Column:
    return F.when(level.isNull(), "Unknown").when(level >= 30, "Stress").when(level >= 22, "Elevated").when(level <= 15, "Calm").otherwise("Normal")


def regime_heuristic(indices: DataFrame, sectors: DataFrame, vix: DataFrame, main: str = "sp500") -> DataFrame:
    """One row: health score, risk-on spread, volatility band, environment, regime label."""
    idx = index_trend(indices)
    m = F.col("name") == main
    pick = lambda c: F.max(F.when(m, F.col(c)))
    market = idx.agg(
        F.avg("trend_score").alias("trend"),
        (F.avg((F.col("one_month_return") > 0).cast("double")) * 100).alias("breadth"),
        *[pick(f"above_sma{n}").alias(f"above{n}") for n in (50, 200)],
        pick("one_month_return").alias("main_return"),
    )
    sec = sector_momentum(sectors, "name").withColumn("momentum_score", F.round("momentum_score", 2))
    avg = lambda names: F.avg(F.when(F.col("name").isin(*names), F.col("momentum_score")))
    groups = sec.agg(
        (F.avg(F.col("above_sma50").cast("double")) * 100).alias("participation"),
        (avg(RISK_ON) - avg(DEFENSIVE)).alias("risk_on_spread"),
    )
    level = vix.agg(F.max_by("close", "date").alias("vix_level"))
    out = market.crossJoin(groups).crossJoin(level)  # one row each
    health = F.col("trend") * 0.5 + F.round("breadth", 2) * 0.25 + F.round("participation", 2) * 0.25
    spread, a50, a200 = F.col("risk_on_spread"), truth(F.col("above50")), truth(F.col("above200"))
    out = (
        out.withColumn("health_score", F.round(health, 2))
        .withColumn("risk_label", F.when(spread > 5, "Risk-on").when(spread < -5, "Risk-off").otherwise("Neutral"))
        .withColumn("vix_regime", vix_status(F.col("vix_level")))
    )
    out = out.withColumn(
        "risk_environment",
        F.when(F.col("vix_regime").isin("Stress", "Elevated") & ~a50, "Risk-off")
        .when((F.col("risk_label") == "Risk-on") & a50 & a200, "Risk-on")
        .when(~a200, "High-risk")
        .otherwise("Neutral"),
    )
    h, env = F.col("health_score"), F.col("risk_environment")
    return out.withColumn(
        "regime",
        F.when(env == "Risk-off", "Risk-off")
        .when((h >= 75) & a50 & a200, "Bull market")
        .when((h <= 30) & ~a200, "Bear market")
        .when(a200 & ~a50, "Correction")
        .when(~a200 & (F.col("main_return") > 0), "Recovery")
        .when(h.between(40, 60), "Sideways")
        .when(env == "High-risk", "High-risk")
        .otherwise("Neutral"),
    ).withColumn(
        "buy_environment", F.when((h >= 65) & (env != "Risk-off"), "Favorable").when(h >= 45, "Selective").otherwise("Dangerous")
    )


def regime_sma(indices: DataFrame, key: str = "name", n: int = 200) -> DataFrame:
    ranked = with_position(indices, (key,)).filter(F.col("rn") <= n)
    out = ranked.groupBy(key).agg(
        F.max("n_rows").alias("rows"), F.max(F.when(F.col("rn") == 1, F.col("close"))).alias("close"), F.avg("close").alias("sma")
    )
    return out.withColumn(
        "regime",
        F.when(F.col("rows") < n, "Unknown (Incomplete Data)").when(F.col("close") > F.col("sma"), "Bullish (Above SMA200)").otherwise("Bearish (Below SMA200)"),
    )


FEATURES = ("return_21d", "volatility_21d", "trend_50d", "drawdown")


def state_name(vol_median: float | Column) -> Column:
    return (
        F.when((F.col("drawdown") <= -0.20) & (F.col("return_21d") <= -0.08), "Crash")
        .when(F.col("volatility_21d") >= vol_median * 1.35, "High Volatility")
        .when((F.col("trend_50d") < -0.03) & (F.col("return_21d") < 0), "Bear Trend")
        .when((F.col("drawdown") < -0.05) & (F.col("return_21d") > 0.03), "Recovery")
        .when((F.col("trend_50d") > 0.02) & (F.col("return_21d") > 0), "Bull Trend")
        .otherwise("Sideways")
    )


def lloyd(rows: DataFrame, keys: Sequence[str], values: str, states: str, start: str, rounds: int) -> tuple[DataFrame, DataFrame]:
    """k-means of every group at once from given first labels: the rows with `state`, and `keys`, `state`, `centre` (a struct), `members`.

    values: an array column; states: the group's number of clusters; start: the first label. A round sums the
    members of each cluster (combined before the shuffle) and hands a group's centres, a small array, to its rows. A cluster that
    loses all members keeps its centre; ties go to the smaller label. Runs a job a round; the centres are checkpointed."""
    size = len(FEATURES)
    labelled = rows.withColumn("state", F.col(start))
    centres = None
    for _ in range(rounds + 1):
        sums = labelled.groupBy(*keys, "state").agg(F.count(F.lit(1)).alias("members"), F.struct(*[F.avg(F.get(values, F.lit(i))).alias(f"c{i}") for i in range(size)]).alias("centre"))
        entry = F.struct("state", "centre", "members")
        found = sums.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("_found"))  # at most `states` rows a group
        if centres is not None:
            old = centres.select(*keys, F.col("centres").alias("_old"))
            lost = F.filter("_old", lambda o: ~F.exists("_found", lambda f: f["state"] == o["state"]))
            lost = F.transform(lost, lambda o: F.struct(o["state"].alias("state"), o["centre"].alias("centre"), F.lit(0).cast("long").alias("members")))
            found = found.join(old, list(keys)).withColumn("_found", F.sort_array(F.concat("_found", lost)))
        centres = cut_lineage(found.select(*keys, F.col("_found").alias("centres")))
        apart = lambda c: sum((F.pow(F.get(values, F.lit(i)) - c["centre"][f"c{i}"], 2) for i in range(1, size)), F.pow(F.get(values, F.lit(0)) - c["centre"]["c0"], 2))
        nearest = F.array_min(F.transform("centres", lambda c: F.struct(apart(c).alias("d"), c["state"].alias("state"))))
        labelled = rows.join(centres, list(keys)).withColumn("_near", nearest).withColumn("state", F.col("_near.state")).withColumn("_apart", F.sqrt("_near.d")).drop("_near", "centres")
    return keep(labelled), centres.select(*keys, F.inline("centres"))


def regime_cluster(features: DataFrame, keys: Sequence[str] = ("ticker",), states: int = 6, least: int = 120, per_state: int = 60, rounds: int = 10) -> DataFrame:
    """Clusters of the standardised regime features of every series, named by their centres, with the
    chances of the next state out of the latest one (0.5 smoothing per state).

    A series of n rows has n / `per_state` states, 2 at least and `states` at most; below `least` rows it has none. First labels are
    shares of equal size in the order of volatility; `rounds` rounds of Lloyd's algorithm follow, see `lloyd`. `confidence` falls with the
    distance of the latest row from its centre. `features`: keys, date plus FEATURES."""
    whole = Window.partitionBy(*keys)
    shape = features.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.avg(c).alias(f"_m{i}") for i, c in enumerate(FEATURES)], *[F.stddev_pop(c).alias(f"_s{i}") for i, c in enumerate(FEATURES)])
    shape = shape.filter(F.col("_n") >= least).withColumn("_k", F.least(F.lit(states), F.greatest(F.lit(2), F.floor(F.col("_n") / per_state).cast("int"))))
    unit = lambda i: F.when(F.col(f"_s{i}") > 0, F.col(f"_s{i}")).otherwise(1.0)
    z = F.array(*[(F.col(c) - F.col(f"_m{i}")) / unit(i) for i, c in enumerate(FEATURES)])
    # a series' rows are its trading days: the one order per series is bounded by the calendar
    rank = F.row_number().over(whole.orderBy("volatility_21d", "date")) - 1
    rows = features.select(*keys, "date", *FEATURES).join(shape, list(keys))
    rows = keep(rows.select(*keys, "date", "_k", F.array(*[F.array(F.col(f"_m{i}"), unit(i)) for i in range(len(FEATURES))]).alias("_scale"), z.alias("_z"), F.floor(rank * F.col("_k") / F.col("_n")).cast("int").alias("_start")))
    labelled, centres = lloyd(rows, keys, "_z", "_k", "_start", rounds)
    scale = rows.groupBy(*keys).agg(F.first("_scale").alias("_scale"))
    back = [(F.col(f"centre.c{i}") * F.get(F.get("_scale", F.lit(i)), F.lit(1)) + F.get(F.get("_scale", F.lit(i)), F.lit(0))).alias(c) for i, c in enumerate(FEATURES)]
    named = centres.join(scale, list(keys)).select(*keys, "state", *back)
    named = named.withColumn("_median", F.median("volatility_21d").over(whole))  # at most `states` rows a series
    named = named.withColumn("state_name", state_name(F.col("_median"))).select(*keys, "state", "state_name")
    moves = labelled.withColumn("next_state", F.lead("state").over(whole.orderBy("date")))
    latest = labelled.groupBy(*keys).agg(F.max_by("state", "date").alias("now"), F.max_by("_apart", "date").alias("_apart"))
    counts = moves.groupBy(*keys, "state", "next_state").agg(F.count(F.lit(1)).alias("moves"))
    days = labelled.groupBy(*keys, "state").agg(F.count(F.lit(1)).alias("days"))
    onward = counts.select(*keys, F.col("state").alias("now"), F.col("next_state").alias("state"), "moves")
    out = named.join(days, [*keys, "state"], "left").join(latest, list(keys)).join(onward, [*keys, "now", "state"], "left")
    out = out.withColumn("_weight", F.coalesce("moves", F.lit(0)) + 0.5)
    out = out.withColumn("_p", F.col("_weight") / F.sum("_weight").over(whole))
    return out.groupBy(*keys, "state_name").agg(
        F.max(F.col("state") == F.col("now")).alias("is_current"),
        F.round(F.sum("_p") * 100, 2).alias("probability_pct"),
        F.coalesce(F.sum("days"), F.lit(0)).alias("days"),
        F.round(F.max(100 / (1 + F.col("_apart"))), 1).alias("confidence"),
    )


def strategy_for_regime(rows: DataFrame, column: str = "regime") -> DataFrame:
    """Posture, preferred and avoid lists of a regime (a literal map)."""
    def entry(posture: str, good: Sequence[str], bad: Sequence[str]) -> Column:
        arr = lambda xs: F.array(*[F.lit(x) for x in xs])
        return F.struct(F.lit(posture).alias("risk_posture"), arr(good).alias("preferred"), arr(bad).alias("avoid"))

    table = F.create_map(*[x for name, *rest in STRATEGIES for x in (F.lit(name), entry(*rest))])
    return rows.withColumn("_s", F.coalesce(F.try_element_at(table, F.col(column)), entry(*NEUTRAL))).select("*", "_s.*").drop("_s")
