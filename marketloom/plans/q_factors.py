"""Queries: cross-sectional factors, sectors, pairs."""

from pyspark.sql import functions as F

from marketloom.functions.rolling import pct_change
from marketloom.operators import factors, pairs, risk
from marketloom.operators import indicators as ind
from marketloom.operators import portfolio as pf
from marketloom.plans import q_sources
from marketloom.plans.q_events import table
from marketloom.plans.q_portfolio import sector_pairs, wts
from marketloom.plans.registry import query, view
from marketloom.plans.views import roll


def pct_sql(x, by, up=True):
    r = f"(rank() OVER (PARTITION BY {by}, ({x}) IS NULL ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2e0) / count({x}) OVER (PARTITION BY {by}) * 100"
    return f"CASE WHEN {x} IS NOT NULL THEN {r if up else '100 - (' + r + ')'} END"


query("pct_rank_avg", "ticker date:d pct_up:6 pct_down:6",
      f"SELECT ticker, date, {pct_sql('x', 'date')} AS pct_up, {pct_sql('x', 'date', False)} AS pct_down FROM (SELECT ticker, date, round(close / lag(close, 126) OVER (PARTITION BY ticker ORDER BY date) - 1, 2) AS x FROM bars)", "bars")(
    lambda m: factors.pct_rank_avg(m.bars.withColumn("x", F.round(pct_change("close", 126), 2)), ("date",), "x", "pct_up", "pct_down"))


def features(m):
    returns = ind.daily_returns(m.bars)
    r = risk.performance(returns).select("ticker", "annualized_volatility", F.col("max_drawdown").alias("maximum_drawdown"))
    down = returns.groupBy("ticker").agg((F.stddev_samp(F.when(F.col("r") < 0, F.col("r"))) * 252 ** 0.5).alias("downside_deviation"))
    mrs = ind.relative_strength(m.bars, m.benchmark).groupBy("ticker").agg(F.max_by("mrs", "date").alias("relative_strength"))
    rounded = factors.price_inputs(m.bars, mrs, r.join(down, "ticker"))
    rounded = rounded.select("ticker", *[F.round(c, 9).alias(c) for c in rounded.columns if c != "ticker"])
    return m.fundamentals.join(rounded, "ticker", "left")


view("feat", """SELECT f.*, round(h.p22 / h.p253 - 1, 9) AS return_12m_ex_1m, round(h.p1 / h.p127 - 1, 9) AS return_6m, round(q.relative_strength, 9) AS relative_strength, round(p.annualized_volatility, 9) AS annualized_volatility, round(p.max_drawdown, 9) AS maximum_drawdown, round(d.dd, 9) AS downside_deviation
 FROM fund f LEFT JOIN (SELECT ticker, max(CASE WHEN rn = 1 THEN close END) AS p1, max(CASE WHEN rn = 22 THEN close END) AS p22, max(CASE WHEN rn = 127 THEN close END) AS p127, max(CASE WHEN rn = 253 THEN close END) AS p253 FROM bx GROUP BY 1) h USING (ticker)
 LEFT JOIN (SELECT ticker, arg_max(mrs, date) AS relative_strength FROM rs GROUP BY 1) q USING (ticker) LEFT JOIN perf p USING (ticker) LEFT JOIN (SELECT ticker, stddev_samp(CASE WHEN r < 0 THEN r END) * sqrt(252) AS dd FROM rets GROUP BY 1) d USING (ticker)""", "fund", "bx", "rs", "perf", "rets")


def score_sql():
    parts, comp, cov = [], [], []
    for f, inputs in factors.FACTOR_INPUTS.items():
        ranks = [f"({pct_sql(n, '1', up)})" for n, up in inputs]
        parts.append(f"list_avg([{', '.join(ranks)}]) AS {f}")
        cov.append(f"({' + '.join(f'CASE WHEN {n} IS NOT NULL THEN 1e0 ELSE 0e0 END' for n, _ in inputs)}) / {len(inputs)}")
    for f, w in factors.FACTOR_WEIGHTS.items():
        comp.append(f"coalesce({f}, 50) * {w!r}::DOUBLE")
    return f"SELECT *, {' + '.join(comp)} AS composite FROM (SELECT ticker, sector, {', '.join(parts)}, ({' + '.join(cov)}) / 5 AS coverage FROM feat)"


view("fs", score_sql(), "feat")
query("factor_scores", "ticker momentum:6 value:6 quality:6 growth:6 low_volatility:6 composite:6 coverage:6", "SELECT * FROM fs", "fs")(lambda m: factors.factor_scores(features(m)))

query("join_semi_weights", "portfolio_id ticker weight:9",
      "SELECT portfolio_id, ticker, weight / sum(weight) OVER (PARTITION BY portfolio_id) AS weight FROM wts WHERE ticker IN (SELECT ticker FROM cf WHERE available)", "wts cf")(
    lambda m: factors.semi_weights(wts(m), q_sources.fundamentals(m).filter("available")))

FW = list(factors.FACTOR_WEIGHTS)
view("fx", f"""SELECT *, tc / total AS top_share, max(exposure) OVER (PARTITION BY portfolio_id) - min(exposure) OVER (PARTITION BY portfolio_id) AS concentration_score FROM (
 SELECT portfolio_id, factor, sum(c) AS exposure, arg_max(ticker, struct_pack(c := abs(c), t := ticker)) AS top_holder, max(abs(c)) AS tc, sum(abs(c)) AS total FROM (SELECT portfolio_id, ticker, factor, round(weight * coalesce(round(round(score, 9), 1), 50), 9) AS c FROM (
 SELECT portfolio_id, ticker, weight, unnest([{', '.join(f"'{f}'" for f in FW)}]) AS factor, unnest([{', '.join('fs.' + f for f in FW)}]) AS score FROM wts JOIN fs USING (ticker))) GROUP BY 1, 2)""", "wts", "fs")
query("factor_exposure_pf", "portfolio_id factor exposure:6 top_holder top_share:7 concentration_score:6 warnings",
      """SELECT *, concat_ws('|', CASE WHEN exposure >= 75 THEN 'Portfolio has a strong ' || factor || ' tilt.' END, CASE WHEN top_share >= 0.35 THEN top_holder || ' supplies at least 35% of portfolio ' || factor || ' exposure.' END) AS warnings FROM fx""", "fx")(
    lambda m: factors.portfolio_exposure(factors.factor_scores(features(m)), wts(m)).withColumn("warnings", F.array_join("warnings", "|")))
query("factor_tilt_share", "portfolio_id factor share_pct:6 extreme",
      "SELECT *, coalesce(abs(exposure - 50) / nullif(sum(abs(exposure - 50)) OVER (PARTITION BY portfolio_id), 0) * 100, 0) AS share_pct, exposure >= 75 OR exposure <= 25 AS extreme FROM fx", "fx")(
    lambda m: factors.tilt_share(factors.portfolio_exposure(factors.factor_scores(features(m)), wts(m))))
query("factor_style", "ticker style",
      """SELECT ticker, CASE WHEN g >= v + 10 THEN 'Growth' WHEN v >= g + 10 THEN 'Value' WHEN coalesce(round(quality, 9), 50) >= 70 THEN 'Quality' WHEN coalesce(round(momentum, 9), 50) >= 70 THEN 'Momentum' ELSE 'Blend' END AS style FROM (SELECT *, coalesce(round(growth, 9), 50) AS g, coalesce(round(value, 9), 50) AS v FROM fs)""", "fs")(
    lambda m: factors.style(factors.factor_scores(features(m))))


def scored(m):
    return risk.stock_analysis(m.bars, m.benchmark).join(m.bars.select("ticker", "sector").distinct(), "ticker").select("ticker", "sector", F.col("quant_score").cast("double").alias("final_score"), "quant_score")


view("scored", "SELECT ticker, sector, CAST(quant_score AS DOUBLE) AS final_score, quant_score FROM sa JOIN (SELECT DISTINCT ticker, sector FROM bars) USING (ticker)", "sa", "bars")
view("srank", "SELECT sector, avg(final_score) AS average_score, count(*) AS leader_count, array_to_string(array_agg(ticker ORDER BY final_score DESC, ticker)[1:5], '|') AS leaders FROM scored GROUP BY 1", "scored")
query("sector_rank", "sector average_score:6 leader_count:i leaders", "SELECT * FROM srank", "srank")(
    lambda m: factors.sector_rankings(scored(m)).withColumn("leaders", F.array_join("leaders", "|")))
query("sector_rotation", "sector average_score:6 relative_strength:6 rotation_signal leadership_rank:i improving deteriorating",
      """SELECT *, average_score - 50 AS relative_strength, CASE WHEN average_score >= 65 THEN 'Leading' WHEN average_score <= 40 THEN 'Deteriorating' ELSE 'Neutral' END AS rotation_signal, row_number() OVER (ORDER BY average_score DESC, sector) AS leadership_rank,
 average_score - 50 > 5 AS improving, average_score - 50 < -10 AS deteriorating FROM srank""", "srank")(lambda m: factors.sector_rotation(factors.sector_rankings(scored(m))))

view("smom", """SELECT *, least(greatest((greatest(one_month_return, -0.25e0) + greatest(three_month_return, -0.35e0)) * 100 + CASE WHEN above_sma50 THEN 25 ELSE 0 END + 50, 0), 100) AS momentum_score FROM (SELECT sector, c1 AS latest, coalesce(c1 / c22 - 1, 0) AS one_month_return, coalesce(c1 / c64 - 1, 0) AS three_month_return, coalesce(c1 > s50, false) AS above_sma50 FROM (
 SELECT sector, max(CASE WHEN rn = 1 THEN close END) AS c1, max(CASE WHEN rn = 22 THEN close END) AS c22, max(CASE WHEN rn = 64 THEN close END) AS c64, CASE WHEN max(n_rows) >= 50 THEN avg(CASE WHEN rn <= 50 THEN close END) END AS s50 FROM sectx GROUP BY 1))""", "sectx")
query("sector_momentum", "sector latest:6 one_month_return:8 three_month_return:8 above_sma50 momentum_score:6", "SELECT * FROM smom", "smom")(lambda m: factors.sector_momentum(m.sector_proxy))

view("brd", """SELECT *, (percent_above_sma50 + percent_above_sma200 + least(advance_decline_ratio, 2) / 2 * 100) / 3 AS market_breadth_score FROM (SELECT avg(CASE WHEN close > sma50 OR close > sma200 THEN 1e0 ELSE 0e0 END) * 100 AS percent_above_sma50, avg(CASE WHEN close > sma200 THEN 1e0 ELSE 0e0 END) * 100 AS percent_above_sma200,
 sum(CASE WHEN quant_score >= 50 THEN 1 ELSE 0 END) / CAST(greatest(1, count(*) - sum(CASE WHEN quant_score >= 50 THEN 1 ELSE 0 END)) AS DOUBLE) AS advance_decline_ratio FROM sa)""", "sa")
query("breadth", "percent_above_sma50:6 percent_above_sma200:6 advance_decline_ratio:6 market_breadth_score:6 breadth_trend divergence_warning",
      "SELECT *, CASE WHEN round(market_breadth_score, 2) >= 65 THEN 'Healthy' WHEN round(market_breadth_score, 2) >= 45 THEN 'Fragile' ELSE 'Weak' END AS breadth_trend, round(market_breadth_score, 2) < 45 AS divergence_warning FROM brd", "brd")(
    lambda m: factors.breadth(risk.stock_analysis(m.bars, m.benchmark).withColumn("price_above_sma50", F.col("close") > F.col("sma50")).withColumn("price_above_sma200", F.col("close") > F.col("sma200"))))

# --- pairs -------------------------------------------------------------------------------
view("pf0", "SELECT p.a || '~' || p.b AS k, p.a, p.b, x.date, x.close AS pa, y.close AS pb, ln(x.close) AS y, ln(y.close) AS x FROM peers p JOIN bars x ON x.ticker = p.a JOIN bars y ON y.ticker = p.b AND x.date = y.date", "peers", "bars")


def spread_sql(src, key):
    return f"""SELECT *, y - (al + be * x) AS s FROM (SELECT *, regr_slope(y, x) OVER (PARTITION BY {key}) AS be, regr_intercept(y, x) OVER (PARTITION BY {key}) AS al FROM {src})"""


def stats_sql(src, key):
    """Spread statistics per key of rows with a spread s."""
    return f"""SELECT *, CASE WHEN n >= 30 THEN (ls - rm) / rsd END AS z_recent, (ls - mean) / sd AS z_full, CASE WHEN nd >= 30 AND rev < 0 THEN -ln(2e0) / rev END AS half_life_days,
 CASE WHEN n >= 60 THEN rev / sqrt(greatest(sse / (nd - 2) / sxx, 1e-12)) END AS test_statistic, coalesce(n >= 60 AND rev / sqrt(greatest(sse / (nd - 2) / sxx, 1e-12)) < -3.34, false) AS cointegrated,
 least(greatest(exp(rev / (sqrt(sse / (nd - 1)) / sqrt(greatest(sxx, 1e-12)))), 0.0001e0), 1) AS raw_pvalue FROM (SELECT *, greatest(syy - rev * rev * sxx, 0) AS sse FROM (
 SELECT {key}, count(*) AS n, min(date) AS data_start, max(date) AS data_end, any_value(be) AS hedge_ratio, any_value(al) AS intercept, max(CASE WHEN rn = 1 THEN s END) AS ls, avg(s) AS mean, stddev_samp(s) AS sd, avg(CASE WHEN rn <= 60 THEN s END) AS rm, stddev_samp(CASE WHEN rn <= 60 THEN s END) AS rsd,
 regr_slope(s - pl, pl) AS rev, regr_sxx(s - pl, pl) AS sxx, regr_syy(s - pl, pl) AS syy, regr_count(s - pl, pl) AS nd FROM (SELECT *, lag(s) OVER (PARTITION BY {key} ORDER BY date) AS pl, row_number() OVER (PARTITION BY {key} ORDER BY date DESC) AS rn FROM {src}) GROUP BY {key}))"""


view("psp", spread_sql("pf0", "k"), "pf0")
view("pst", f"SELECT split_part(k, '~', 1) AS a, split_part(k, '~', 2) AS b, * FROM ({stats_sql('psp', 'k')})", "psp")


def frame(m):
    return pairs.pair_frame(m.bars, sector_pairs(m))


query("join_inner_align", "ticker date:d r:8 bench_r:8", "SELECT x.ticker, x.date, x.r, b.r AS bench_r FROM rets x JOIN benchx b USING (date) WHERE b.r IS NOT NULL", "rets benchx")(
    lambda m: q_align(m))


def q_align(m):
    from marketloom.operators import regress
    return regress.align_returns(ind.daily_returns(m.bars), regress.market_returns(m.benchmark))


query("join_multi_align", "ticker date:d r:8 bench_r:8 sector_r:8", "SELECT ticker, date, y AS r, x1 AS bench_r, x2 AS sector_r FROM f2", "f2")(lambda m: q_multi(m))


def q_multi(m):
    from marketloom.operators import regress
    return regress.two_factor_frame(ind.daily_returns(m.bars), regress.market_returns(m.benchmark), regress.group_returns(m.sector_proxy, "sector", "sector_r"))


query("join_pairs_theta", "a b n:i corr:7", "SELECT x.ticker AS a, y.ticker AS b, count(*) AS n, corr(x.r, y.r) AS corr FROM rets x JOIN rets y ON x.date = y.date AND x.ticker < y.ticker GROUP BY 1, 2", "rets")(
    lambda m: pairs.all_pairs(ind.daily_returns(m.bars)))


def watchlist(m):
    """Tickers whose suppliers hold more than the average balance."""
    s = m.table("supplier").join(m.places, F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("ticker")).agg(F.avg("s_acctbal").alias("bal"))
    return s.filter("bal > 4500").select("ticker")


view("wl", "SELECT ticker FROM (SELECT n_name AS ticker, avg(s_acctbal) AS bal FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1) WHERE bal > 4500")
query("join_peer_candidates", "a b sector overlap:i", "SELECT p.*, overlap FROM peers p JOIN (SELECT a, b, count(*) AS overlap FROM pf0 GROUP BY 1, 2) USING (a, b) WHERE overlap >= 252 AND (a IN (SELECT ticker FROM wl) OR b IN (SELECT ticker FROM wl))", "peers pf0 wl")(
    lambda m: pairs.peer_candidates(sector_pairs(m), m.bars, watchlist(m)))

query("hedge_ratio", "a b date:d hedge_ratio:7 intercept:6 spread:8", "SELECT a, b, date, be AS hedge_ratio, al AS intercept, s AS spread FROM psp", "psp")(lambda m: pairs.with_spread(frame(m)))
query("spread_z", "a b z_recent:6 z_full:6 mean:8 std:8 latest_spread:8", "SELECT *, sd AS std, ls AS latest_spread FROM pst", "pst")(lambda m: pairs.spread_stats(pairs.with_spread(frame(m))))
query("half_life", "a b sample_size:i half_life_days:7", "SELECT *, n AS sample_size FROM pst", "pst")(lambda m: pairs.spread_stats(pairs.with_spread(frame(m))))
query("adf_lite", "a b test_statistic:5 cointegrated raw_pvalue:7", "SELECT * FROM pst", "pst")(lambda m: pairs.spread_stats(pairs.with_spread(frame(m))))

R60 = "(PARTITION BY k ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"
view("sbt0", f"""SELECT *, (s - avg(s) OVER {R60}) / nullif(CASE WHEN count(s) OVER {R60} >= 60 THEN stddev_samp(s) OVER {R60} END, 0) AS z FROM psp""", "psp")
view("sbt", """SELECT k, sum(CASE WHEN turn > 0 THEN 1 ELSE 0 END) AS trades, avg(CASE WHEN round(pnl, 15) > 0 THEN 1e0 ELSE 0e0 END) AS win_rate, avg(pnl) AS average_daily_pnl, sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) / nullif(abs(sum(CASE WHEN pnl < 0 THEN pnl ELSE 0 END)), 0) AS profit_factor, min(eq - pk) AS maximum_drawdown FROM (
 SELECT *, max(eq) OVER w AS pk FROM (SELECT *, sum(coalesce(pnl, 0)) OVER w AS eq FROM (SELECT *, lag(p) OVER w * (s - lag(s) OVER w) - coalesce(abs(p - lag(p) OVER w), 0) * 10 / 1e4 AS pnl, coalesce(abs(p - lag(p) OVER w), 0) AS turn FROM (
 SELECT *, coalesce(last_value(CASE WHEN abs(z) <= 0.5 THEN 0e0 WHEN z >= 2 THEN -1e0 WHEN z <= -2 THEN 1e0 END IGNORE NULLS) OVER (PARTITION BY k ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS p FROM sbt0) WINDOW w AS (PARTITION BY k ORDER BY date)) WINDOW w AS (PARTITION BY k ORDER BY date)) WINDOW w AS (PARTITION BY k ORDER BY date)) GROUP BY k""", "sbt0")
query("spread_backtest", "a b trades:i win_rate:8 average_daily_pnl:9 profit_factor:6 maximum_drawdown:8", "SELECT split_part(k, '~', 1) AS a, split_part(k, '~', 2) AS b, * FROM sbt", "sbt")(
    lambda m: pairs.spread_backtest(pairs.with_spread(frame(m))))

view("lcor", "SELECT k, corr(dy, dx) AS correlation FROM (SELECT k, y / lag(y) OVER w - 1 AS dy, x / lag(x) OVER w - 1 AS dx FROM pf0 WINDOW w AS (PARTITION BY k ORDER BY date)) GROUP BY k", "pf0")
query("coint_score", "a b correlation:7 hedge_ratio:7 z_recent:6 half_life_days:7 cointegrated strength signal confidence:5",
      """SELECT *, CASE WHEN cointegrated AND correlation > 0.5 AND half_life_days < 60 THEN 'Strong' WHEN cointegrated AND correlation > 0.35 THEN 'Moderate' ELSE 'Weak' END AS strength, CASE WHEN z_recent >= 2 THEN 'short_y_long_x' WHEN z_recent <= -2 THEN 'long_y_short_x' WHEN abs(z_recent) <= 0.5 THEN 'exit' ELSE 'hold' END AS signal,
 least(greatest((correlation - 0.3e0) / 0.5e0 * 20, 0), 20) + CASE WHEN half_life_days IS NULL THEN 0 ELSE least(greatest((90 - half_life_days) / 90 * 20, 0), 20) END + CASE WHEN profit_factor IS NULL THEN 0 ELSE least(greatest((profit_factor - 1) * 20, 0), 20) END AS confidence FROM pst JOIN lcor USING (k) JOIN sbt USING (k)""", "pst lcor sbt")(
    lambda m: pairs.coint_score(frame(m)))

view("ap0", "SELECT x.ticker || '~' || y.ticker AS k, x.date, ln(x.close) AS y, ln(y.close) AS x FROM bars x JOIN bars y ON x.date = y.date AND x.ticker < y.ticker", "bars")
view("aps", spread_sql("ap0", "k"), "ap0")
query("pairs_scan", "a b sample_size:i hedge_ratio:7 test_statistic:5 z_recent:6 half_life_days:6", f"SELECT split_part(k, '~', 1) AS a, split_part(k, '~', 2) AS b, n AS sample_size, * FROM ({stats_sql('aps', 'k')}) WHERE cointegrated AND abs(z_recent) >= 2", "aps")(
    lambda m: pairs.pairs_scan(m.bars))

view("brk", """SELECT k, abs(shift) / sd AS shift_ratio, CASE WHEN n < 160 THEN 'Not enough data for break test' WHEN abs(shift) / sd > 1.25 THEN 'Possible structural break' ELSE 'No obvious break' END AS structural_break_status FROM (
 SELECT k, max(n) AS n, avg(CASE WHEN i >= n // 2 THEN s END) - avg(CASE WHEN i < n // 2 THEN s END) AS shift, stddev_samp(s) AS sd FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM psp) GROUP BY k)""", "psp")
query("structural_break", "a b shift_ratio:7 structural_break_status", "SELECT split_part(k, '~', 1) AS a, split_part(k, '~', 2) AS b, * FROM brk", "brk")(lambda m: pairs.structural_break(pairs.with_spread(frame(m))))

view("rw0", """SELECT p.k || '~' || w.win AS kw, p.* EXCLUDE (k), p.k FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM pf0) p JOIN (SELECT DISTINCT k AS wk, i // 42 AS win FROM (SELECT k, row_number() OVER (PARTITION BY k ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM pf0) WHERE i % 42 = 0 AND i + 126 <= n AND n >= 252) w
 ON p.k = w.wk AND p.i >= w.win * 42 AND p.i < w.win * 42 + 126""", "pf0")
view("rw1", spread_sql("rw0", "kw"), "rw0")
view("rco", f"""SELECT split_part(kw, '~', 1) || '~' || split_part(kw, '~', 2) AS k, count(*) AS windows, avg(CASE WHEN raw_pvalue < 0.1 THEN 1e0 ELSE 0e0 END) AS rolling_stability, least(greatest(1 - stddev_pop(hedge_ratio) / greatest(abs(avg(hedge_ratio)), 1e-6), 0), 1) AS hedge_stability FROM ({stats_sql('rw1', 'kw')}) GROUP BY 1""", "rw1")
query("rolling_coint", "a b windows:i rolling_stability:7 hedge_stability:6", "SELECT split_part(k, '~', 1) AS a, split_part(k, '~', 2) AS b, * FROM rco", "rco")(lambda m: pairs.rolling_coint(frame(m)))

view("cst", """SELECT p.a, p.b, p.k, p.n AS sample_size, p.hedge_ratio, p.intercept, p.z_full AS spread_zscore, CASE WHEN p.half_life_days IS NOT NULL THEN least(p.half_life_days, 10000) END AS half_life_days, p.raw_pvalue, r.rolling_stability, r.hedge_stability, b.structural_break_status, p.data_start, p.data_end,
 concat_ws('|', CASE WHEN p.half_life_days IS NULL OR p.half_life_days <= 1 OR p.half_life_days > 90 THEN 'Mean-reversion half-life is not in a useful range.' END, CASE WHEN r.rolling_stability < 0.55 THEN 'Rolling relationship stability is weak.' END, CASE WHEN b.structural_break_status <> 'No obvious break' THEN 'Structural-break check weakened the relationship.' END) AS warnings
 FROM pst p JOIN brk b USING (k) LEFT JOIN rco r USING (k)""", "pst", "brk", "rco")
query("coint_stats", "a b sample_size:i hedge_ratio:7 intercept:6 spread_zscore:6 half_life_days:7 raw_pvalue:7 rolling_stability:7 hedge_stability:6 structural_break_status data_start:d data_end:d warnings", "SELECT * FROM cst", "cst")(
    lambda m: pairs.coint_stats(frame(m)).withColumn("warnings", F.array_join("warnings", "|")))

view("wf0", """SELECT p.k || '~' || f AS kf, p.k, p.date, p.y, p.x, p.i - f * 42 AS pos FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM pf0) p JOIN (SELECT k AS wk, unnest(range(0, CAST(ceil((n - 294) / 42e0) AS BIGINT))) AS f FROM (SELECT k, count(*) AS n FROM pf0 GROUP BY k) WHERE n >= 324) w
 ON p.k = w.wk AND p.i >= f * 42 AND p.i < f * 42 + 294""", "pf0")
view("wf1", spread_sql("(SELECT * FROM wf0 WHERE pos < 252)", "kf"), "wf0")
view("wf2", f"""SELECT t.kf, any_value(t.k) AS k, any_value(f.raw_pvalue) AS p, arg_min((t.y - (f.intercept + f.hedge_ratio * t.x) - f.mean) / greatest(f.sd, 1e-9), t.pos) AS z0, max(abs((t.y - (f.intercept + f.hedge_ratio * t.x) - f.mean) / greatest(f.sd, 1e-9))) AS worst, min(abs((t.y - (f.intercept + f.hedge_ratio * t.x) - f.mean) / greatest(f.sd, 1e-9))) AS best
 FROM (SELECT * FROM wf0 WHERE pos >= 252) t JOIN ({stats_sql('wf1', 'kf')}) f USING (kf) GROUP BY t.kf""", "wf0", "wf1")
view("pwf", """SELECT *, 1 - narrowing_rate AS false_positive_rate, CASE WHEN narrowing_rate > 0 THEN 21 END AS median_time_to_normalization, CASE WHEN validation_sample = 0 THEN 'No validated divergences' WHEN narrowing_rate >= 0.55 THEN 'Passed conservative cost check' ELSE 'Costs or weak normalization reduce usefulness' END AS after_cost_status FROM (
 SELECT k, sum(CASE WHEN p <= 0.15 AND abs(z0) >= 1.5 THEN 1 ELSE 0 END) AS validation_sample, avg(CASE WHEN p <= 0.15 AND abs(z0) >= 1.5 THEN CASE WHEN best <= 0.5 * abs(z0) THEN 1e0 ELSE 0e0 END END) AS narrowing_rate, max(CASE WHEN p <= 0.15 AND abs(z0) >= 1.5 THEN worst - abs(z0) END) AS max_adverse_move, avg(CASE WHEN p <= 0.15 THEN 1e0 ELSE 0e0 END) AS relationship_survival_rate FROM wf2 GROUP BY k)""", "wf2")
query("pair_walk_forward", "a b sample_size:i narrowing_rate:7 max_adverse_move:6 false_positive_rate:7 relationship_survival_rate:7 median_time_to_normalization:2 after_cost_status", "SELECT split_part(k, '~', 1) AS a, split_part(k, '~', 2) AS b, validation_sample AS sample_size, * FROM pwf", "pwf")(
    lambda m: pairs.pair_walk_forward(frame(m)))


def status_sql(adj, sample):
    return f"""CASE WHEN structural_break_status <> 'No obvious break' THEN 'Relationship Broken' WHEN {adj} > 0.15 THEN 'Relationship Weakening' WHEN rolling_stability < 0.55 THEN 'Relationship Weakening' WHEN abs(spread_zscore) >= 2 AND {sample} > 0 THEN 'Unusual Divergence' WHEN abs(spread_zscore) >= 1.25 THEN 'Moderate Divergence' ELSE 'Normal Relationship' END"""


view("relv", f"""SELECT *, {status_sql('adjusted_pvalue', '(CASE WHEN narrowing_rate IS NOT NULL THEN 1 ELSE 0 END)')} AS relationship_status, CASE WHEN spread_zscore < -1 THEN 'below' WHEN spread_zscore > 1 THEN 'above' ELSE 'near' END AS divergence_direction,
 CASE WHEN structural_break_status = 'No obvious break' AND adjusted_pvalue < 0.1 AND rolling_stability >= 0.7 THEN 'Medium' ELSE 'Low' END AS confidence, concat_ws('|', CASE WHEN raw_pvalue < 0.1 THEN 'Residual mean reversion' END, CASE WHEN rolling_stability >= 0.55 THEN 'Rolling stability' END, CASE WHEN structural_break_status = 'No obvious break' THEN 'Structural-break check' END) AS supporting,
 concat_ws('|', CASE WHEN raw_pvalue >= 0.1 THEN 'Weak stationarity' END, CASE WHEN rolling_stability < 0.55 THEN 'Rolling instability' END, CASE WHEN structural_break_status <> 'No obvious break' THEN 'Structural-break check' END) AS contradicting FROM (
 SELECT *, least(1, min(raw_pvalue * m / hi) OVER (ORDER BY raw_pvalue DESC, hi DESC)) AS adjusted_pvalue FROM (SELECT c.*, w.* EXCLUDE (k), count(*) OVER () AS m, count(*) OVER (ORDER BY raw_pvalue) AS hi FROM cst c JOIN pwf w USING (k)))""", "cst", "pwf")
query("relative_value", "a b relationship_status divergence_direction spread_zscore:6 raw_pvalue:7 adjusted_pvalue:7 rolling_stability:7 narrowing_rate:7 confidence supporting contradicting", "SELECT * FROM relv", "relv")(
    lambda m: pairs.relative_value(sector_pairs(m), m.bars).withColumn("supporting", F.array_join("supporting", "|")).withColumn("contradicting", F.array_join("contradicting", "|")))


def pbt_sql(exit_value):
    from marketloom.plans.q_risk import perf_sql
    src = f"""(SELECT k, date, lag(p) OVER w * (ra - rb) AS r FROM (SELECT *, coalesce(last_value(CASE WHEN abs(z) < 0.5 THEN {exit_value} WHEN z > 2 THEN -1e0 WHEN z < -2 THEN 1e0 END IGNORE NULLS) OVER (PARTITION BY k ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS p FROM pbt0) WINDOW w AS (PARTITION BY k ORDER BY date) QUALIFY r IS NOT NULL)"""
    return perf_sql(src, "k")


view("pbt0", f"""SELECT *, (g - avg(g) OVER {R60}) / nullif(CASE WHEN count(g) OVER {R60} >= 60 THEN stddev_samp(g) OVER {R60} END, 0) AS z, pa / lag(pa) OVER (PARTITION BY k ORDER BY date) - 1 AS ra, pb / lag(pb) OVER (PARTITION BY k ORDER BY date) - 1 AS rb FROM (SELECT *, y - x AS g FROM pf0)""", "pf0")
query("pairs_backtest", "a b exit_mode correlation:6 latest_spread:8 latest_zscore:6 cagr:4 sharpe_ratio:4 max_drawdown:4 win_rate:4 profit_factor:4",
      f"""SELECT split_part(k, '~', 1) AS a, split_part(k, '~', 2) AS b, * FROM (SELECT 'as_is' AS exit_mode, * FROM ({pbt_sql('NULL')}) UNION ALL SELECT 'flat' AS exit_mode, * FROM ({pbt_sql('0e0')})) JOIN (SELECT k, corr(ra, rb) AS correlation, arg_max(g, date) AS latest_spread, arg_max(z, date) AS latest_zscore FROM pbt0 GROUP BY k) USING (k)""", "pbt0")(
    lambda m: pairs.pairs_backtest(frame(m)).withColumn("exit_mode", F.lit("as_is")).unionByName(pairs.pairs_backtest(frame(m), exit_mode="flat").withColumn("exit_mode", F.lit("flat"))))
