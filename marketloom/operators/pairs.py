"""Pair spreads, stationarity, walk-forward validation and pair backtests.

A pair frame holds one row per (a, b, date) for a list of candidate pairs: work and data grow
with the list. Only `pairs_scan` looks at every pair; it runs on blocks of series (see
functions/gram.py), so no table of pairs x dates is ever shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.expr import clip, correlation, notes, safe_div
from marketloom.functions.gram import pair_moments, per_block, wide
from marketloom.functions.rolling import lagged, over, rolling_mean, rolling_std, with_position
from marketloom.operators import regress, risk
from marketloom.session import keep

PAIR = ("a", "b")


def all_pairs(returns: DataFrame) -> DataFrame:
    """Every unordered pair of series with its overlap and return correlation."""
    return pair_moments(returns, "ticker", "date", "r").filter(F.col("a") < F.col("b"))


def peer_candidates(relationships: DataFrame, bars: DataFrame, watchlist: DataFrame, least: int = 252) -> DataFrame:
    """Curated pairs with either leg on the watchlist and enough common dates."""
    legs = relationships.withColumn("leg", F.explode(F.array("a", "b")))
    wanted = legs.join(watchlist.select(F.col("ticker").alias("leg")), "leg", "left_semi").select(*relationships.columns).distinct()
    overlap = pair_frame(bars, wanted).groupBy(*PAIR).agg(F.count(F.lit(1)).alias("overlap")).filter(F.col("overlap") >= least)
    return wanted.join(overlap, list(PAIR))


def pair_frame(bars: DataFrame, candidates: DataFrame) -> DataFrame:
    """(a, b, date, pa, pb) on common dates with positive prices; logs as y and x."""
    px = bars.select("ticker", "date", "close").filter(F.col("close") > 0)
    out = (
        candidates.select(*PAIR)
        .distinct()
        .join(px.withColumnRenamed("ticker", "a").withColumnRenamed("close", "pa"), "a")
        .join(px.withColumnRenamed("ticker", "b").withColumnRenamed("close", "pb"), ["b", "date"])
    )
    return out.withColumn("y", F.log("pa")).withColumn("x", F.log("pb"))


def with_spread(frame: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    """Least-squares hedge of y on x per key, and the residual spread."""
    whole = Window.partitionBy(*keys)
    return (
        frame.withColumn("hedge_ratio", F.regr_slope("y", "x").over(whole))
        .withColumn("intercept", F.regr_intercept("y", "x").over(whole))
        .withColumn("spread", F.col("y") - (F.col("intercept") + F.col("hedge_ratio") * F.col("x")))
    )


def lag_pvalue(slope: Column, sse: Column, sxx: Column, n: Column) -> Column:
    """The rough p-value of mean reversion from the regression of changes on lagged levels."""
    error = F.sqrt(sse / F.greatest(n - 1, F.lit(1))) / F.sqrt(F.greatest(sxx, F.lit(1e-12)))
    return clip(F.exp(F.coalesce(safe_div(slope, error), F.lit(0.0))), 0.0001, 1.0)


def spread_stats(spreads: DataFrame, keys: Sequence[str] = PAIR, window: int = 60) -> DataFrame:
    """Level, z-scores, half-life and the one-lag residual statistics of each spread."""
    ranked = with_position(spreads, keys).withColumn("lag_s", lagged("spread", 1, keys)).withColumn("ds", F.col("spread") - F.col("lag_s"))
    recent = F.when(F.col("rn") <= window, F.col("spread"))
    # the lag regression moments are centred sums of n_d = rows - 1 pairs
    out = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sample_size"),
        F.min("date").alias("data_start"),
        F.max("date").alias("data_end"),
        F.first("hedge_ratio").alias("hedge_ratio"),
        F.first("intercept").alias("intercept"),
        F.max(F.when(F.col("rn") == 1, F.col("spread"))).alias("latest_spread"),
        F.avg("spread").alias("mean"),
        F.stddev_samp("spread").alias("std"),
        F.avg(recent).alias("recent_mean"),
        F.stddev_samp(recent).alias("recent_std"),
        F.regr_slope("ds", "lag_s").alias("reversion"),
        F.regr_sxx("ds", "lag_s").alias("sxx"),
        F.regr_syy("ds", "lag_s").alias("syy"),
        F.regr_count("ds", "lag_s").alias("n_d"),
    )
    b, n = F.col("reversion"), F.col("n_d")
    sse = F.greatest(F.col("syy") - b * b * F.col("sxx"), F.lit(0.0))
    t1 = b / F.sqrt(F.greatest(safe_div(sse / F.greatest(n - 2, F.lit(1)), F.col("sxx")), F.lit(1e-12)))
    half = F.when((n >= 30) & (b < 0), -F.log(F.lit(2.0)) / b)
    return (
        out.withColumn("z_recent", F.when(F.col("sample_size") >= max(10, window // 2), F.coalesce(safe_div(F.col("latest_spread") - F.col("recent_mean"), F.col("recent_std")), F.lit(0.0))))
        .withColumn("z_full", safe_div(F.col("latest_spread") - F.col("mean"), F.col("std")))
        .withColumn("half_life_days", half)
        .withColumn("test_statistic", F.when(F.col("sample_size") >= 60, t1))
        .withColumn("cointegrated", F.coalesce(F.col("test_statistic") < -3.34, F.lit(False)))
        .withColumn("raw_pvalue", lag_pvalue(b, sse, F.col("sxx"), n))
        .drop("sxx", "syy", "n_d", "reversion", "recent_mean", "recent_std")
    )


def pair_signal(z: Column, entry: float = 2.0, exit_level: float = 0.5) -> Column:
    z = F.coalesce(z, F.lit(0.0))
    return F.when(z >= entry, "short_y_long_x").when(z <= -entry, "long_y_short_x").when(F.abs(z) <= exit_level, "exit").otherwise("hold")


def spread_positions(frame: DataFrame, value: str, entry: float = 2.0, exit_level: float = 0.5, n: int = 60, keys: Sequence[str] = PAIR) -> DataFrame:
    """Hold-state position: 0 inside the exit band, -1/+1 beyond the entry bands, else kept.
    The state is the last decision seen, so no row loop is needed."""
    x = F.col(value)
    z = safe_div(x - rolling_mean(x, n, keys), rolling_std(x, n, keys))
    decision = F.when(F.abs("z") <= exit_level, 0.0).when(F.col("z") >= entry, -1.0).when(F.col("z") <= -entry, 1.0)
    run = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return frame.withColumn("z", z).withColumn("position", F.coalesce(F.last(decision, ignorenulls=True).over(run), F.lit(0.0)))


def spread_backtest(spreads: DataFrame, entry: float = 2.0, exit_level: float = 0.5, n: int = 60, cost_bps: float = 10, keys: Sequence[str] = PAIR) -> DataFrame:
    run = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    rows = spread_positions(spreads, "spread", entry, exit_level, n, keys)
    rows = rows.withColumn("turn", F.coalesce(F.abs(F.col("position") - lagged("position", 1, keys)), F.lit(0.0)))
    pnl = lagged("position", 1, keys) * (F.col("spread") - lagged("spread", 1, keys)) - F.col("turn") * cost_bps / 10000
    rows = rows.withColumn("pnl", pnl).withColumn("equity", F.sum(F.coalesce("pnl", F.lit(0.0))).over(run))
    rows = rows.withColumn("under", F.col("equity") - F.max("equity").over(run))
    p = F.col("pnl")
    out = rows.groupBy(*keys).agg(
        F.sum((F.col("turn") > 0).cast("int")).alias("trades"),
        F.avg(F.when(F.round(p, 15) > 0, 1.0).otherwise(0.0)).alias("win_rate"),
        F.coalesce(F.avg("pnl"), F.lit(0.0)).alias("average_daily_pnl"),
        F.sum(F.when(p > 0, p).otherwise(0.0)).alias("_up"),
        F.abs(F.sum(F.when(p < 0, p).otherwise(0.0))).alias("_down"),
        F.min("under").alias("maximum_drawdown"),
    )
    return out.withColumn("profit_factor", safe_div(F.col("_up"), F.col("_down"))).drop("_up", "_down")


def coint_score(frame: DataFrame) -> DataFrame:
    """Hedge, z, half-life, one-lag test, strength, signal and confidence of each pair.
    The correlation is that of the relative changes of the (log) series, as scored upstream."""
    spreads = with_spread(frame)
    change = lambda c: safe_div(F.col(c), lagged(c, 1, PAIR)) - 1
    corr = frame.withColumn("_dy", change("y")).withColumn("_dx", change("x")).groupBy(*PAIR).agg(correlation("_dy", "_dx").alias("correlation"))
    out = spread_stats(spreads).join(corr, list(PAIR)).join(spread_backtest(spreads), list(PAIR)).filter(F.col("sample_size") >= 30)
    c, hl, ok = F.col("correlation"), F.col("half_life_days"), F.col("cointegrated")
    part = lambda x: F.coalesce(clip(x, 0.0, 20.0), F.lit(0.0))
    confidence = part((F.coalesce(c, F.lit(0.0)) - 0.30) / 0.50 * 20) + part((90 - hl) / 90 * 20) + part((F.col("profit_factor") - 1) * 20)
    return (
        out.withColumn("strength", F.when(ok & (c > 0.5) & (hl < 60), "Strong").when(ok & (c > 0.35), "Moderate").otherwise("Weak"))
        .withColumn("signal", pair_signal(F.col("z_recent")))
        .withColumn("confidence", clip(confidence, 0.0, 100.0))
    )


SCAN_SCHEMA = "a string, b string, sample_size long, hedge_ratio double, test_statistic double, z_recent double, half_life_days double"


SCAN_LEAST = 60  # common dates a pair needs; also the rows of the recent z-score
SLACK = 0.05  # the screen's distance from the limits; rounding of moments is far below it
FLAT = 1e-9  # a spread that keeps less of a series' variance than this is not judged by moments


def _same_dates(grid: np.ndarray) -> list[np.ndarray]:
    """Columns of a (dates x series) matrix, grouped by the dates on which they have values."""
    groups: dict[bytes, list[int]] = {}
    for i, bits in enumerate(np.packbits(~np.isnan(grid), axis=0).T):
        groups.setdefault(bits.tobytes(), []).append(i)
    return [np.array(g) for g in groups.values()]


def _centred(v: np.ndarray) -> np.ndarray:
    return v - v.mean(axis=0)


def _candidates(u: np.ndarray, v: np.ndarray, forward: np.ndarray, t_limit: float, z_limit: float) -> np.ndarray:
    """Mask (columns of u x columns of v) of the pairs that may pass both limits, from matrix products only.

    The spread of a pair is linear in its two series, so every moment of its lag regression and of its last
    rows is a combination of cross products. `forward`: the series of u is the dependent one."""
    n, sides = len(u), []
    for m in (u, v):
        full, tail = _centred(m), m[-SCAN_LEAST:]
        sides.append({"full": full, "lag": _centred(full[:-1]), "diff": _centred(np.diff(full, axis=0)), "tail": _centred(tail)})
    one, two = sides

    def both(name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums of squares of the dependent and of the other series, and their products."""
        p, q = (one[name] ** 2).sum(axis=0)[:, None], (two[name] ** 2).sum(axis=0)[None, :]
        return np.where(forward, p, q), np.where(forward, q, p), one[name].T @ two[name]

    own = [(side["lag"] * side["diff"]).sum(axis=0) for side in sides]
    yd, xd = np.where(forward, own[0][:, None], own[1][None, :]), np.where(forward, own[1][None, :], own[0][:, None])
    crossed = one["lag"].T @ two["diff"] + one["diff"].T @ two["lag"]
    _, xx, xy = both("full")
    beta = xy / np.maximum(xx, 1e-300)
    spread = lambda yy, xx, xy: yy - 2 * beta * xy + beta**2 * xx
    lag, diff, tail = both("lag"), both("diff"), both("tail")
    sxx, dd, tt = spread(*lag), spread(*diff), spread(*tail)
    sxd = yd - beta * crossed + beta**2 * xd
    with np.errstate(all="ignore"):
        slope = sxd / sxx
        t = slope / np.sqrt(np.maximum((dd - slope * sxd) / (n - 3) / sxx, 1e-12))
        end = np.where(forward, one["tail"][-1][:, None], two["tail"][-1][None, :]) - beta * np.where(forward, two["tail"][-1][None, :], one["tail"][-1][:, None])
        z = end / np.sqrt(tt / (SCAN_LEAST - 1))
        clear = (sxx > FLAT * lag[0]) & (dd > FLAT * diff[0]) & (tt > FLAT * tail[0])
        return ~clear | ((t < t_limit + SLACK) & (np.abs(z) >= z_limit - SLACK))


def _spread_columns(y: np.ndarray, x: np.ndarray) -> dict[str, np.ndarray]:
    """Spread statistics of y[:, k] on x[:, k] for every k, from the spreads themselves."""
    dx, dy = _centred(x), _centred(y)
    beta = (dx * dy).sum(axis=0) / np.maximum((dx * dx).sum(axis=0), 1e-300)
    s = dy - beta * dx
    lag, d = _centred(s[:-1]), _centred(np.diff(s, axis=0))
    sxx = (lag * lag).sum(axis=0)
    tail = s[-SCAN_LEAST:]
    sd = tail.std(axis=0, ddof=1)
    with np.errstate(all="ignore"):
        slope = (lag * d).sum(axis=0) / sxx
        sse = np.maximum((d * d).sum(axis=0) - slope * slope * sxx, 0.0)
        t = slope / np.sqrt(np.maximum(sse / (len(s) - 3) / sxx, 1e-12))
        z = np.where(sd > 0, (tail[-1] - tail.mean(axis=0)) / sd, 0.0)
        half = np.where(slope < 0, -np.log(2) / slope, np.nan)
    t = np.where(sxx > 0, t, np.nan)  # a spread without variance has no test
    return {"hedge_ratio": beta, "test_statistic": t, "z_recent": z, "half_life_days": half}


def _scan_block(t_limit: float, z_limit: float, step: int = 512) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Statistics of the pairs between the two blocks of a group that pass the limits.

    Series with values on the same dates are taken together: their pairs are screened by matrix products, and
    only those that may pass get their spreads computed, `step` pairs at a time."""

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right, xs, ys = wide(pdf)
        same = pdf["p"].iloc[0] == pdf["q"].iloc[0]
        names, others = np.array(left, dtype=object), np.array(right, dtype=object)
        found = []
        for i in _same_dates(xs):
            for j in _same_dates(ys):
                common = ~np.isnan(xs[:, i[0]]) & ~np.isnan(ys[:, j[0]])
                n = int(common.sum())
                if n < SCAN_LEAST:
                    continue
                u, v = xs[np.ix_(common, i)], ys[np.ix_(common, j)]
                forward = names[i][:, None] < others[j][None, :]
                wanted = forward if same else names[i][:, None] != others[j][None, :]
                k, m = np.nonzero(_candidates(u, v, forward, t_limit, z_limit) & wanted)
                for at in range(0, len(k), step):
                    kk, mm = k[at : at + step], m[at : at + step]
                    ahead = forward[kk, mm]
                    stats = _spread_columns(np.where(ahead, u[:, kk], v[:, mm]), np.where(ahead, v[:, mm], u[:, kk]))
                    one, two = names[i][kk], others[j][mm]
                    ids = {"a": np.where(ahead, one, two), "b": np.where(ahead, two, one), "sample_size": np.full(len(kk), n)}
                    found.append(pd.DataFrame({**ids, **stats}))
        columns = [c.split()[0] for c in SCAN_SCHEMA.split(", ")]
        out = pd.concat(found) if found else pd.DataFrame(columns=columns)
        return out[(out["test_statistic"] < t_limit) & (out["z_recent"].abs() >= z_limit)]

    return scan


def pairs_scan(bars: DataFrame, z_limit: float = 2.0, block: int = 64, t_limit: float = -3.34) -> DataFrame:
    """Every pair of log prices: the cointegrated ones whose spread is stretched."""
    logs = bars.filter(F.col("close") > 0).withColumn("logp", F.log("close"))
    out = per_block(logs, _scan_block(t_limit, z_limit), SCAN_SCHEMA, "ticker", "date", "logp", block)
    return out.withColumn("half_life_days", F.when(~F.isnan("half_life_days"), F.col("half_life_days")))


def structural_break(spreads: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    ranked = with_position(spreads, keys)
    late = F.col("i") >= F.floor(F.col("n_rows") / 2)
    out = ranked.groupBy(*keys).agg(
        F.max("n_rows").alias("n"),
        (F.avg(F.when(late, F.col("spread"))) - F.avg(F.when(~late, F.col("spread")))).alias("shift"),
        F.stddev_samp("spread").alias("sd"),
    )
    ratio = F.abs("shift") / F.when(F.coalesce(F.col("sd"), F.lit(0.0)) == 0, 1.0).otherwise(F.col("sd"))
    return out.withColumn("shift_ratio", ratio).withColumn(
        "structural_break_status",
        F.when(F.col("n") < 160, "Not enough data for break test").when(ratio > 1.25, "Possible structural break").otherwise("No obvious break"),
    ).drop("n", "shift", "sd")


LAGS = ("ly", "lx", "dy", "dx")


def window_fits(frame: DataFrame, n: int, step: int) -> DataFrame:
    """Least-squares spread of each full window of `n` rows that starts at a multiple of `step`: (a, b, win, n_rows,
    hedge_ratio, intercept, std, raw_pvalue); `n_rows` is the pair's history.

    Every row is summed once, into the cell between two neighbouring window borders; a window adds up its cells. Levels
    are taken from the pair's first row, so that products of sums cancel little. The change into a window's first
    row leaves the window again."""
    whole = n // step
    rest = n % step
    ranked = with_position(frame, PAIR)
    order = over(PAIR).rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranked.withColumns({"y0": F.first("y").over(order), "x0": F.first("x").over(order), "_y": lagged("y", 1, PAIR), "_x": lagged("x", 1, PAIR)})
    v = F.col
    ranked = ranked.select(
        *PAIR, "i", "n_rows", "y0", "x0", (v("y") - v("y0")).alias("y"), (v("x") - v("x0")).alias("x"),
        (v("_y") - v("y0")).alias("ly"), (v("_x") - v("x0")).alias("lx"), (v("y") - v("_y")).alias("dy"), (v("x") - v("_x")).alias("dx"),
    )
    # windows start where a multiple of step lies and end `rest` rows behind one
    cell = 2 * F.floor(F.col("i") / step) + (F.col("i") % step >= rest).cast("long")
    enters = F.col("i") % step == 0
    products = [*combinations_with_replacement(("y", "x"), 2), *combinations_with_replacement(LAGS, 2)]
    sums = {c: F.col(c) for c in ("y", "x", *LAGS)} | {u + v: F.col(u) * F.col(v) for u, v in products}
    cells = ranked.withColumn("cell", cell).groupBy(*PAIR, "cell").agg(
        F.first("n_rows").alias("n_rows"),
        F.first("y0").alias("y0"),
        F.first("x0").alias("x0"),
        *[F.sum(F.when(enters, F.col(c))).alias(f"{c}_in") for c in LAGS],
        *[F.sum(e).alias(c) for c, e in sums.items()],
    )
    reach = Window.partitionBy(*PAIR).orderBy("cell").rangeBetween(0, 2 * whole - (0 if rest else 2))
    win = F.floor(F.col("cell") / 2)
    added = cells.select(*PAIR, "cell", "n_rows", "y0", "x0", *[f"{c}_in" for c in LAGS], win.alias("win"), *[F.sum(c).over(reach).alias(c) for c in sums])
    added = added.filter((F.col("cell") % 2 == (0 if rest else 1)) & (F.col("win") * step + n <= F.col("n_rows")))
    entry = lambda c: F.coalesce(f"{c}_in", F.lit(0.0))
    added = added.withColumns({c: F.col(c) - entry(c) for c in LAGS} | {u + v: F.col(u + v) - entry(u) * entry(v) for u, v in products if u in LAGS})

    def co(u: str, v: str) -> Column:
        return F.col(u + v) - F.col(u) * F.col(v) / (n - 1 if u in LAGS else n)

    h = F.col("hedge_ratio")
    fitted = added.withColumn("hedge_ratio", F.when(co("x", "x") > 1e-13 * F.col("xx"), co("y", "x") / co("x", "x")))

    def spread(y: str, x: str) -> Column:
        return F.greatest(co(y, y) - 2 * h * co(y, x) + h * h * co(x, x), F.lit(0.0))

    fitted = fitted.withColumns({
        "sxx": spread("ly", "lx"),
        "syy": spread("dy", "dx"),
        "sxy": co("ly", "dy") - h * (co("ly", "dx") + co("lx", "dy")) + h * h * co("lx", "dx"),
    })
    slope = F.when(F.col("sxx") > 0, F.col("sxy") / F.col("sxx"))
    sse = F.greatest(F.col("syy") - slope * slope * F.col("sxx"), F.lit(0.0))
    return fitted.select(
        *PAIR, "win", "n_rows", "hedge_ratio",
        (F.col("y0") + F.col("y") / n - h * (F.col("x0") + F.col("x") / n)).alias("intercept"),
        F.sqrt(spread("y", "x") / (n - 1)).alias("std"),
        lag_pvalue(slope, sse, F.col("sxx"), F.lit(n - 1)).alias("raw_pvalue"),
    )


def rolling_coint(frame: DataFrame, n: int = 126, step: int | None = None) -> DataFrame:
    """Share of windows with a stationary residual, and the stability of the hedge ratio."""
    stats = window_fits(frame, n, step or max(n // 3, 1)).filter(F.col("n_rows") >= 2 * n)
    out = stats.groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("windows"),
        F.avg((F.col("raw_pvalue") < 0.1).cast("double")).alias("rolling_stability"),
        F.stddev_pop("hedge_ratio").alias("_sd"),
        F.avg("hedge_ratio").alias("_mean"),
    )
    return out.withColumn("hedge_stability", clip(1 - F.col("_sd") / F.greatest(F.abs("_mean"), F.lit(1e-6)), 0.0, 1.0)).drop("_sd", "_mean")


def coint_stats(frame: DataFrame, least: int = 252) -> DataFrame:
    """Curated-pair diagnostics with warnings; short pairs keep a row without numbers."""
    spreads = keep(with_spread(frame))
    stats = spread_stats(spreads)
    out = stats.join(structural_break(spreads), list(PAIR)).join(rolling_coint(frame), list(PAIR), "left")
    ready = F.col("sample_size") >= least
    out = out.withColumn("half_life_days", clip(F.col("half_life_days"), 0.0, 10000.0)).withColumnRenamed("z_full", "spread_zscore")
    for c in ("hedge_ratio", "intercept", "spread_zscore", "half_life_days", "raw_pvalue", "rolling_stability", "hedge_stability"):
        out = out.withColumn(c, F.when(ready, F.col(c)))
    out = out.withColumn("structural_break_status", F.when(ready, F.col("structural_break_status")).otherwise("Insufficient data"))
    hl = F.col("half_life_days")
    return out.withColumn(
        "warnings",
        F.when(~ready, F.array(F.lit("Insufficient overlapping history."))).otherwise(
            notes(
                (hl.isNull() | (hl <= 1) | (hl > 90), "Mean-reversion half-life is not in a useful range."),
                (F.col("rolling_stability") < 0.55, "Rolling relationship stability is weak."),
                (F.col("structural_break_status") != "No obvious break", "Structural-break check weakened the relationship."),
            )
        ),
    )


def pair_walk_forward(frame: DataFrame, train: int = 252, test: int = 42, z_limit: float = 1.5, cost_bps: float = 20) -> DataFrame:
    """Folds of `train` rows followed by `test` rows: does a stretched spread narrow to half?

    Training windows are fitted from cells of sums (`window_fits`); a row is tested in one fold at most, since
    folds are no closer than their tests are long.
    """
    step = max(test, 10)
    need = train + test + 30
    # folds start at 0, step, ... and must leave one row after the test rows
    last_fold = F.ceil((F.col("n_rows") - (train + test)) / step) - 1
    fit = window_fits(frame, train, step).filter((F.col("n_rows") >= need) & (F.col("win") <= last_fold)).withColumnRenamed("win", "fold").drop("n_rows")
    ranked = with_position(frame, PAIR).filter((F.col("n_rows") >= need) & (F.col("i") >= train))
    ranked = ranked.withColumn("fold", F.floor((F.col("i") - train) / step)).withColumn("k", F.col("i") - train - F.col("fold") * step)
    keys = (*PAIR, "fold")
    tested = ranked.filter((F.col("k") < test) & (F.col("fold") <= last_fold)).join(fit, list(keys))
    z = (F.col("y") - (F.col("intercept") + F.col("hedge_ratio") * F.col("x"))) / F.greatest(F.col("std"), F.lit(1e-9))
    folds = tested.withColumn("z", z).groupBy(*keys).agg(
        F.first("raw_pvalue").alias("p"),
        F.min_by("z", "k").alias("z0"),
        F.max(F.abs("z")).alias("worst"),
        F.min(F.abs("z")).alias("best"),
    )
    alive = F.col("p") <= 0.15
    used = alive & (F.abs("z0") >= z_limit)
    narrowed = F.col("best") <= 0.5 * F.abs("z0")
    out = folds.groupBy(*PAIR).agg(
        F.sum(used.cast("int")).alias("sample_size"),
        F.avg(F.when(used, narrowed.cast("double"))).alias("narrowing_rate"),
        F.max(F.when(used, F.col("worst") - F.abs("z0"))).alias("max_adverse_move"),
        F.avg(alive.cast("double")).alias("relationship_survival_rate"),
    )
    rate = F.col("narrowing_rate")
    none = F.col("sample_size") == 0
    passed = (rate >= 0.55) & F.lit(cost_bps <= 30)
    return (
        out.withColumn("false_positive_rate", 1 - rate)
        # reported as a constant by definition, not measured
        .withColumn("median_time_to_normalization", F.when(rate > 0, F.lit(test / 2)))
        .withColumn(
            "after_cost_status",
            F.when(none, "No validated divergences").when(passed, "Passed conservative cost check").otherwise("Costs or weak normalization reduce usefulness"),
        )
        .withColumn(
            "warning",
            F.when(none, "No historical divergences passed the validation filter.").when(
                F.col("sample_size") < 20, "Small sample; treat as relationship research, not a strategy track record."
            ),
        )
    )


def relationship_status(z: Column, raw_p: Column, adj_p: Column, stability: Column, brk: Column, sample: Column) -> Column:
    return (
        F.when(z.isNull() | raw_p.isNull(), "Insufficient Evidence")
        .when(brk != "No obvious break", "Relationship Broken")
        .when(adj_p > 0.15, "Relationship Weakening")
        .when(stability < 0.55, "Relationship Weakening")
        .when((F.abs(z) >= 2.0) & (sample > 0), "Unusual Divergence")
        .when(F.abs(z) >= 1.25, "Moderate Divergence")
        .otherwise("Normal Relationship")
    )


def relative_value(candidates: DataFrame, bars: DataFrame) -> DataFrame:
    """Diagnostics, validation and multiple-testing control of curated pairs, with labels."""
    frame = keep(pair_frame(bars, candidates))  # diagnostics and validation read it
    stats = coint_stats(frame)
    checks = pair_walk_forward(frame).select(*PAIR, F.col("sample_size").alias("validation_sample"), "narrowing_rate", "after_cost_status")
    out = candidates.select(*PAIR).distinct().join(stats, list(PAIR), "left").join(checks, list(PAIR), "left")
    out = regress.benjamini_hochberg(out.withColumn("_family", F.lit(1)), ("_family",), "raw_pvalue").drop("_family").withColumnRenamed("adjusted_p", "adjusted_pvalue")
    z, st, adj = F.col("spread_zscore"), F.col("rolling_stability"), F.col("adjusted_pvalue")
    brk = F.coalesce("structural_break_status", F.lit("Insufficient data"))
    sample = F.coalesce("validation_sample", F.lit(0))
    # the final status counts a pair as validated once a narrowing rate exists
    validated = F.when(F.col("narrowing_rate").isNotNull(), 1).otherwise(0)
    # the confidence looks at the status before the multiple-testing control
    first = relationship_status(z, F.col("raw_pvalue"), F.lit(None).cast("double"), st, brk, sample)
    status = relationship_status(z, F.col("raw_pvalue"), adj, st, brk, validated)
    low = first.isin("Insufficient Evidence", "Relationship Broken")
    return (
        out.withColumn("relationship_status", status)
        .withColumn(
            "divergence_direction",
            F.when(z < -1, "below").when(z > 1, "above").when(z.isNotNull(), "near").otherwise("none"),
        )
        .withColumn("confidence", F.when(~low & (adj < 0.1) & (F.coalesce(st, F.lit(0.0)) >= 0.7), "Medium").otherwise("Low"))
        .withColumn("cost_warning", F.when(F.col("after_cost_status") != "Passed conservative cost check", F.col("after_cost_status")))
        .withColumn(
            "supporting",
            notes(
                (F.col("raw_pvalue") < 0.1, "Residual mean reversion"),
                (st >= 0.55, "Rolling stability"),
                (brk == "No obvious break", "Structural-break check"),
            ),
        )
        .withColumn(
            "contradicting",
            notes(
                (~F.coalesce(F.col("raw_pvalue") < 0.1, F.lit(False)), "Weak stationarity"),
                (~F.coalesce(st >= 0.55, F.lit(False)), "Rolling instability"),
                (brk != "No obvious break", "Structural-break check"),
            ),
        )
    )


def pairs_backtest(frame: DataFrame, entry: float = 2.0, exit_level: float = 0.5, n: int = 60, exit_mode: str = "as_is") -> DataFrame:
    """Log-ratio pair strategy. `as_is` keeps a position until the opposite entry (an exit row is
    carried over, as the report does); `flat` goes to zero inside the exit band."""
    if exit_mode not in ("as_is", "flat"):
        raise ValueError("exit_mode is as_is or flat")
    x = F.col("spread")
    rows = frame.withColumn("spread", F.col("y") - F.col("x"))
    rows = rows.withColumn("z", safe_div(x - rolling_mean(x, n, PAIR), rolling_std(x, n, PAIR)))
    inside = F.abs("z") < exit_level
    entered = F.when(F.col("z") > entry, -1.0).when(F.col("z") < -entry, 1.0)
    decision = F.when(inside, F.lit(None).cast("double") if exit_mode == "as_is" else F.lit(0.0)).otherwise(entered)
    run = Window.partitionBy(*PAIR).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    ret = lambda c: safe_div(F.col(c), lagged(c, 1, PAIR)) - 1
    rows = (
        rows.withColumn("position", F.coalesce(F.last(decision, ignorenulls=True).over(run), F.lit(0.0)))
        .withColumn("ra", ret("pa"))
        .withColumn("rb", ret("pb"))
        .withColumn("r", lagged("position", 1, PAIR) * (F.col("ra") - F.col("rb")))
    )
    latest = rows.groupBy(*PAIR).agg(
        correlation("ra", "rb").alias("correlation"),
        F.max_by("spread", "date").alias("latest_spread"),
        F.coalesce(F.max_by("z", "date"), F.lit(0.0)).alias("latest_zscore"),
        F.max_by("position", "date").alias("_p"),
    )
    latest = latest.withColumn("latest_signal", F.when(F.col("_p") > 0, "long_a_short_b").when(F.col("_p") < 0, "short_a_long_b").otherwise("exit")).drop("_p")
    return latest.join(risk.performance_report(rows.filter(F.col("r").isNotNull()), PAIR), list(PAIR))
