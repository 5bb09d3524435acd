"""Queries: grouped performance, risk and regressions."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketloom.operators import indicators as ind
from marketloom.operators import portfolio as pf
from marketloom.operators import regress, risk
from marketloom.plans import q_indicators  # noqa: F401  (views)
from marketloom.plans.registry import query, view
from marketloom.plans.views import cdf


def rets(m):
    return ind.daily_returns(m.bars)


def perf_sql(src, key, rf=0.0, r="r"):
    """One row per key with the performance statistics of the series."""
    ex = f"({r} - {rf!r}::DOUBLE / 252)"
    return f"""SELECT *, CASE WHEN n > 0 AND growth > 0 THEN pow(growth, 252e0 / n) - 1 ELSE 0 END AS cagr, sd AS volatility, sd * sqrt(252) AS annualized_volatility,
 coalesce(sqrt(252) * mex / nullif(sd, 0), 0) AS sharpe_ratio, coalesce(sqrt(252) * mex / nullif(sdd, 0), 0) AS sortino_ratio,
 coalesce(CASE WHEN n > 0 AND growth > 0 THEN pow(growth, 252e0 / n) - 1 ELSE 0 END / nullif(abs(max_drawdown), 0), 0) AS calmar_ratio,
 coalesce(gains / nullif(losses, 0), 0) AS profit_factor FROM (
 SELECT {key}, count({r}) AS n, exp(sum(ln(1 + {r}))) AS growth, avg{ex} AS mex, stddev_samp{ex} AS sd, stddev_samp(CASE WHEN {ex} < 0 THEN {ex} END) AS sdd,
  min(dd) AS max_drawdown, avg(CASE WHEN {r} > 0 THEN 1e0 ELSE 0e0 END) AS win_rate, sum(CASE WHEN {r} > 0 THEN {r} ELSE 0 END) AS gains, abs(sum(CASE WHEN {r} < 0 THEN {r} ELSE 0 END)) AS losses
 FROM (SELECT *, eq / max(eq) OVER (PARTITION BY {key} ORDER BY date) - 1 AS dd FROM
  (SELECT *, exp(sum(ln(1 + {r})) OVER (PARTITION BY {key} ORDER BY date)) AS eq FROM {src})) GROUP BY {key})"""


view("perf", perf_sql("rets", "ticker"), "rets")
query("cagr", "ticker n:i growth:7 cagr:8", "SELECT * FROM perf", "perf")(
    lambda m: risk.performance(rets(m)).withColumnRenamed("sample_size", "n"))
query("sharpe", "ticker sharpe_ratio:7 volatility:8 annualized_volatility:7", "SELECT * FROM perf", "perf")(lambda m: risk.performance(rets(m)))
view("pfperf", perf_sql("pfr", "portfolio_id", 0.045), "pfr")
SHARPE = "CASE WHEN sharpe_ratio < 0.5 THEN 'Weak' WHEN sharpe_ratio < 1 THEN 'Average' WHEN sharpe_ratio < 2 THEN 'Strong' ELSE 'Excellent' END"


def pfseries(m):
    return pf.portfolio_returns(pf.price_matrix(m.bars), pf.weights(m.positions, m.bars))


query("sharpe_engine", "portfolio_id cagr:7 annualized_volatility:7 sharpe_ratio:6 classification",
      f"SELECT *, {SHARPE} AS classification FROM pfperf", "pfperf")(lambda m: risk.sharpe_engine(pfseries(m), ("portfolio_id",)))
query("sortino", "ticker sortino_ratio:7", "SELECT * FROM perf", "perf")(lambda m: risk.performance(rets(m)))
query("calmar", "ticker max_drawdown:8 calmar_ratio:6", "SELECT * FROM perf", "perf")(lambda m: risk.performance(rets(m)))

view("varq", """SELECT ticker, max(v) AS value_at_risk, avg(CASE WHEN r <= v + 1e-12 THEN r END) AS expected_shortfall FROM
 (SELECT *, quantile_cont(r, 0.05) OVER (PARTITION BY ticker) AS v FROM rets) GROUP BY ticker""", "rets")
query("var_cvar", "ticker value_at_risk:8 expected_shortfall:8", "SELECT * FROM varq", "varq")(lambda m: risk.var_cvar(rets(m)))

view("pftail", """SELECT portfolio_id, max(v) AS value_at_risk, avg(CASE WHEN r <= v + 1e-12 THEN r END) AS conditional_value_at_risk,
 sqrt(avg(pow(least(r - 0.045e0 / 252, 0), 2))) * sqrt(252) AS downside_deviation, count(*) AS n, exp(sum(ln(1 + r))) AS growth FROM
 (SELECT *, quantile_cont(r, 0.05) OVER (PARTITION BY portfolio_id) AS v FROM pfr) GROUP BY portfolio_id""", "pfr")
query("downside_tail", "portfolio_id sortino_ratio:6 downside_deviation:8 value_at_risk:8 conditional_value_at_risk:8",
      "SELECT *, (pow(growth, 252e0 / n) - 1 - 0.045e0) / downside_deviation AS sortino_ratio FROM pftail", "pftail")(
    lambda m: risk.downside_tail(pfseries(m), ("portfolio_id",)))

view("rwx", """SELECT x.ticker || ':' || w.win AS k, x.ticker, w.win AS "window", x.date, x.r FROM rx x JOIN (VALUES ('3M', 63), ('6M', 126), ('1Y', 252), ('3Y', 756)) AS w(win, days)
 ON x.rn <= w.days WHERE x.n_rows >= 63""", "rx")
view("rwd", """SELECT *, round(eq / max(eq) OVER (PARTITION BY k ORDER BY date) - 1, 12) AS drawdown FROM (SELECT *, exp(sum(ln(1 + r)) OVER (PARTITION BY k ORDER BY date)) AS eq FROM rwx)""", "rwx")
view("rwin", f"""SELECT ticker, "window", observations, annual_return / annual_vol AS sharpe, CASE WHEN dd > 0 THEN annual_return / dd END AS sortino, max_drawdown, dd AS downside_deviation,
 consistency, recovery_time, tail_5pct FROM (SELECT k, any_value(ticker) AS ticker, any_value("window") AS "window", count(*) AS observations, avg(r) * 252 AS annual_return,
 stddev_samp(r) * sqrt(252) AS annual_vol, stddev_samp(CASE WHEN r < 0 THEN r END) * sqrt(252) AS dd, min(drawdown) AS max_drawdown, avg(CASE WHEN r > 0 THEN 1e0 ELSE 0e0 END) AS consistency,
 quantile_cont(r, 0.05) AS tail_5pct FROM rwd GROUP BY k) JOIN ({q_indicators.islands('rwd', 'k')}) USING (k)""", "rwd")
query("risk_windows", "ticker span observations:i sharpe:6 sortino:6 max_drawdown:8 downside_deviation:8 consistency:8 recovery_time:i tail_5pct:8",
      'SELECT *, "window" AS span FROM rwin', "rwin")(lambda m: risk.risk_windows(rets(m)).withColumn("span", F.col("window")))
view("rhead", """SELECT h.ticker, CASE WHEN sharpe IS NULL THEN 'Risk-Adjusted Consistency: Unavailable' WHEN sharpe > 1 AND sortino > 1 THEN 'Risk-Adjusted Consistency: Strong but descriptive only.'
 WHEN max_drawdown < -0.2 THEN 'Risk-Adjusted Consistency: Weak due to meaningful drawdowns.' ELSE 'Risk-Adjusted Consistency: Mixed.' END AS conclusion,
 CASE WHEN sharpe IS NULL THEN 'Low' WHEN sharpe > 1 AND sortino > 1 THEN 'Medium' WHEN max_drawdown < -0.2 THEN 'Medium' WHEN o >= 126 THEN 'Medium' ELSE 'Low' END AS confidence
 FROM rwin h JOIN (SELECT ticker, max(observations) AS o FROM rwin GROUP BY ticker) USING (ticker) WHERE "window" = '3M'""", "rwin")
query("risk_headline", "ticker conclusion confidence", "SELECT * FROM rhead", "rhead")(lambda m: risk.risk_headline(risk.risk_windows(rets(m))))

query("perf_report", "ticker cagr:4 sharpe_ratio:4 sortino_ratio:4 max_drawdown:4 win_rate:4 profit_factor:4", "SELECT * FROM perf", "perf")(
    lambda m: risk.performance_report(rets(m)))

view("momh", """SELECT ticker, coalesce(ret_63, 0) AS ret_63, coalesce(ret_126, 0) AS ret_126, coalesce(ret_252, 0) AS ret_252, coalesce(ret_504, 0) AS ret_504,
 25e0 * (CASE WHEN ret_63 > 0 THEN 1 ELSE 0 END + CASE WHEN ret_126 > 0 THEN 1 ELSE 0 END + CASE WHEN ret_252 > 0 THEN 1 ELSE 0 END + CASE WHEN ret_504 > 0 THEN 1 ELSE 0 END) AS momentum_score FROM (
 SELECT ticker, max(CASE WHEN rn = 1 THEN close END) / max(CASE WHEN rn = 64 THEN close END) - 1 AS ret_63, max(CASE WHEN rn = 1 THEN close END) / max(CASE WHEN rn = 127 THEN close END) - 1 AS ret_126,
 max(CASE WHEN rn = 1 THEN close END) / max(CASE WHEN rn = 253 THEN close END) - 1 AS ret_252, max(CASE WHEN rn = 1 THEN close END) / max(CASE WHEN rn = 505 THEN close END) - 1 AS ret_504 FROM bx GROUP BY ticker)""", "bx")
query("momentum_horizons", "ticker momentum_score:2 ret_63:8 ret_126:8 ret_252:8 ret_504:8", "SELECT * FROM momh", "momh")(
    lambda m: risk.momentum_horizons(m.bars))

view("ba", """SELECT *, actual_return - capm_expected_return AS alpha FROM (SELECT *, beta * market_return AS capm_expected_return FROM (
 SELECT x.ticker, count(*) AS aligned, covar_samp(x.r, b.r) / var_samp(b.r) AS beta, avg(x.r) * 252 AS actual_return, avg(b.r) * 252 AS market_return
 FROM rets x JOIN benchx b USING (date) WHERE b.r IS NOT NULL GROUP BY x.ticker))""", "rets", "benchx")


def from_views(name):
    from marketloom.plans.views import roll
    return roll


_roll = from_views("roll")
view("lastrow", f"""SELECT * FROM (SELECT ticker, rn, close, volume, {_roll('avg', 'close', 20)} AS sma20, {_roll('avg', 'close', 50)} AS sma50, {_roll('avg', 'close', 200)} AS sma200,
 {_roll('avg', 'volume', 20)} AS vol_avg, close AS c0 FROM bx) WHERE rn = 1""", "bx")
view("sa", """SELECT *, CASE WHEN quant_score >= 75 THEN 'Research priority' WHEN quant_score >= 55 THEN 'Watch closely' WHEN quant_score >= 35 THEN 'Neutral' ELSE 'High risk / weak setup' END AS quant_label FROM (
 SELECT *, CASE WHEN momentum_score >= 75 THEN 25 WHEN momentum_score >= 50 THEN 15 ELSE 0 END + CASE WHEN sma200 > 0 AND sma20 > sma50 AND sma50 > sma200 THEN 20 ELSE 0 END
  + CASE WHEN sharpe_ratio > 1 THEN 20 WHEN sharpe_ratio > 0 THEN 10 ELSE 0 END + CASE WHEN max_drawdown > -0.2 THEN 15 WHEN max_drawdown > -0.35 THEN 8 ELSE 0 END
  + CASE WHEN volume_spike THEN 10 ELSE 0 END + CASE WHEN annualized_volatility <= 0.45 THEN 10 ELSE 0 END AS quant_score FROM (
 SELECT p.*, b.* EXCLUDE (ticker), l.sma20, l.sma50, l.sma200, l.close, l.vol_avg, l.volume / l.vol_avg AS rv, coalesce(l.volume / l.vol_avg >= 2, false) AS volume_spike, h.* EXCLUDE (ticker), g.regime AS volatility_regime,
  q.* EXCLUDE (ticker)
 FROM perf p JOIN ba b USING (ticker) JOIN lastrow l USING (ticker) JOIN momh h USING (ticker) JOIN vreg g USING (ticker) JOIN
  (SELECT ticker, max(CASE WHEN rn = 1 THEN close END) / max(CASE WHEN rn = 2 THEN close END) - 1 AS daily, max(CASE WHEN rn = 1 THEN close END) / max(CASE WHEN rn = 6 THEN close END) - 1 AS weekly,
   max(CASE WHEN rn = 1 THEN close END) / max(CASE WHEN rn = 22 THEN close END) - 1 AS monthly, max(CASE WHEN rn = 1 THEN close END) / max(CASE WHEN rn = 253 THEN close END) - 1 AS annual FROM bx GROUP BY ticker) q USING (ticker)))""",
     "perf", "ba", "lastrow", "momh", "vreg", "bx")
query("stock_analysis", "ticker daily:8 weekly:8 monthly:8 annual:8 volatility:8 max_drawdown:8 sharpe_ratio:6 sortino_ratio:6 calmar_ratio:6 beta:7 alpha:7 sma20:8 sma50:8 sma200:8 rv:7 volume_spike momentum_score:2 volatility_regime",
      "SELECT * FROM sa", "sa")(lambda m: risk.stock_analysis(m.bars, m.benchmark))
query("quant_score", "ticker quant_score:i quant_label", "SELECT * FROM sa", "sa")(lambda m: risk.stock_analysis(m.bars, m.benchmark))

PROXIES = ("NATION_0", "NATION_1")
query("market_snapshot", "proxies:i average_change:8 condition",
      """SELECT *, CASE WHEN average_change > 0.003 THEN 'Supportive' WHEN average_change < -0.003 THEN 'Weak' ELSE 'Mixed' END AS condition FROM (
 SELECT count(daily_change_pct) AS proxies, avg(daily_change_pct) AS average_change FROM snap WHERE ticker IN ('NATION_0', 'NATION_1'))""", "snap")(
    lambda m: risk.market_snapshot(ind.snapshot(m.bars, m.fundamentals), PROXIES))

query("factor_decomp", "ticker market_component:7 momentum_component:7 volatility_drag:7 alpha_component:7 market_pct:2 momentum_pct:2 volatility_pct:2 alpha_pct:2",
      """SELECT *, abs(market_component) / t * 100 AS market_pct, abs(momentum_component) / t * 100 AS momentum_pct, abs(volatility_drag) / t * 100 AS volatility_pct, abs(alpha_component) / t * 100 AS alpha_pct FROM (
 SELECT *, coalesce(nullif(abs(market_component) + abs(momentum_component) + abs(volatility_drag) + abs(alpha_component), 0), 1) AS t FROM (
 SELECT ticker, capm_expected_return AS market_component, greatest(ret_252, 0) * 0.25e0 AS momentum_component, -greatest(annualized_volatility - 0.25e0, 0) * 0.2e0 AS volatility_drag, alpha AS alpha_component FROM sa))""",
      "sa")(lambda m: risk.factor_decomposition(risk.stock_analysis(m.bars, m.benchmark)))

# --- regressions -------------------------------------------------------------------------
query("beta_alpha", "ticker aligned:i beta:7 alpha:7 capm_expected_return:7 actual_return:7 market_return:7 beta_band alpha_sign",
      """SELECT *, CASE WHEN beta >= 1.25 THEN 'more than the market' WHEN beta <= 0.75 THEN 'less than the market' ELSE 'in line with the market' END AS beta_band,
 CASE WHEN alpha > 0 THEN 'positive alpha versus CAPM' WHEN alpha < 0 THEN 'negative alpha versus CAPM' ELSE 'no CAPM alpha detected' END AS alpha_sign FROM ba""", "ba")(
    lambda m: regress.beta_text(regress.beta_alpha(rets(m), regress.market_returns(m.benchmark))))

view("mm", """SELECT ticker, count(*) AS sample_size, count(*) >= 20 AS available, regr_slope(y, x) AS beta, regr_intercept(y, x) * 252 AS alpha_annualized, regr_r2(y, x) AS r_squared,
 sqrt((regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / (count(*) - 1)) * sqrt(252) AS residual_volatility, corr(y, x) AS benchmark_correlation
 FROM (SELECT x.ticker, x.r - 0.045e0 / 252 AS y, b.r - 0.045e0 / 252 AS x FROM rets x JOIN benchx b USING (date) WHERE b.r IS NOT NULL) GROUP BY ticker""", "rets", "benchx")
query("ols_market", "ticker sample_size:i available beta:7 alpha_annualized:7 r_squared:7 residual_volatility:7 benchmark_correlation:7", "SELECT * FROM mm", "mm")(
    lambda m: regress.market_model(rets(m), regress.market_returns(m.benchmark), rf=0.045))

view("f3", """SELECT x.ticker, x.sector, x.date, x.r AS y, b.r AS x1, s.r AS x2, b.p AS x3 FROM rets x JOIN (SELECT date, r, lag(r) OVER (ORDER BY date) AS p FROM benchx) b USING (date) JOIN sectx s USING (sector, date)
 WHERE b.r IS NOT NULL AND s.r IS NOT NULL AND b.p IS NOT NULL""", "rets", "benchx", "sectx")


def ols3(src, key):
    c = lambda a, b: f"covar_pop({a}, {b}) * count(*)"
    return f"""SELECT {key}, n, r2 AS r_squared, sqrt(sse / (n - 1)) AS residual_std, unnest(['alpha', 'bench_r', 'sector_r', 'prev_r']) AS term,
 unnest([my - b1 * m1 - b2 * m2 - b3 * m3, b1, b2, b3]) AS coefficient, unnest([sqrt(mse * (1e0 / n + m1 * m1 * i11 + m2 * m2 * i22 + m3 * m3 * i33 + 2 * (m1 * m2 * i12 + m1 * m3 * i13 + m2 * m3 * i23))), sqrt(mse * i11), sqrt(mse * i22), sqrt(mse * i33)]) AS std_error
 FROM (SELECT *, sse / (n - 4) AS mse, 1 - sse / syy AS r2 FROM (SELECT *, syy - b1 * c1 - b2 * c2 - b3 * c3 AS sse FROM (
 SELECT *, i11 * c1 + i12 * c2 + i13 * c3 AS b1, i12 * c1 + i22 * c2 + i23 * c3 AS b2, i13 * c1 + i23 * c2 + i33 * c3 AS b3 FROM (
 SELECT *, (s22 * s33 - s23 * s23) / det AS i11, (s13 * s23 - s12 * s33) / det AS i12, (s12 * s23 - s13 * s22) / det AS i13, (s11 * s33 - s13 * s13) / det AS i22, (s12 * s13 - s11 * s23) / det AS i23, (s11 * s22 - s12 * s12) / det AS i33 FROM (
 SELECT *, s11 * (s22 * s33 - s23 * s23) - s12 * (s12 * s33 - s13 * s23) + s13 * (s12 * s23 - s13 * s22) AS det FROM (
 SELECT {key}, count(*) AS n, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3, var_pop(y) * count(*) AS syy, {c('x1', 'y')} AS c1, {c('x2', 'y')} AS c2, {c('x3', 'y')} AS c3,
  {c('x1', 'x1')} AS s11, {c('x1', 'x2')} AS s12, {c('x1', 'x3')} AS s13, {c('x2', 'x2')} AS s22, {c('x2', 'x3')} AS s23, {c('x3', 'x3')} AS s33 FROM {src} GROUP BY {key}))))))"""


def factor_frame(m):
    prev = F.lag("bench_r").over(Window.partitionBy(F.lit(0)).orderBy("date"))  # one row per date
    market = regress.market_returns(m.benchmark).withColumn("prev_r", prev)
    sectors = regress.group_returns(m.sector_proxy, "sector", "sector_r")
    return regress.two_factor_frame(rets(m), market, sectors)


query("ols_multi", "ticker sample_size:i r_squared:7 residual_std:8 term coefficient:6 std_error:6 t_stat:4",
      f"SELECT ticker, n AS sample_size, r_squared, residual_std, term, CASE WHEN term = 'alpha' THEN coefficient * 252 ELSE coefficient END AS coefficient, std_error, coefficient / std_error AS t_stat FROM ({ols3('f3', 'ticker')})", "f3")(
    lambda m: regress.ols_multi(factor_frame(m), ("ticker",), "r", ("bench_r", "sector_r", "prev_r"), scale=252.0))

view("f2", "SELECT x.ticker, x.date, x.r AS y, b.r AS x1, s.r AS x2 FROM rets x JOIN benchx b USING (date) JOIN sectx s USING (sector, date) WHERE b.r IS NOT NULL AND s.r IS NOT NULL", "rets", "benchx", "sectx")


def ols2(src, key):
    return f"""SELECT *, least(greatest((b1 * sym + b2 * sys) / syy, 0), 1) AS r2 FROM (SELECT *, (sym * sss - sys * sms) / (smm * sss - sms * sms) AS b1, (sys * smm - sym * sms) / (smm * sss - sms * sms) AS b2 FROM (
 SELECT {key}, count(*) AS n, covar_pop(y, x1) AS sym, covar_pop(y, x2) AS sys, covar_pop(x1, x2) AS sms, var_pop(x1) AS smm, var_pop(x2) AS sss, var_pop(y) AS syy FROM {src} GROUP BY {key}))"""


view("bstab", f"""SELECT ticker, blocks, CASE WHEN blocks >= 2 THEN least(greatest(1 - d, 0), 1) END AS stability FROM (SELECT ticker, count(*) AS blocks,
 (stddev_pop(b1) / greatest(abs(avg(b1)), 1e-6) + stddev_pop(b2) / greatest(abs(avg(b2)), 1e-6)) / 2 AS d FROM ({ols2('''(SELECT *, CAST(floor(i / 63) AS BIGINT) AS block FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY ticker) AS nn FROM f2)
 WHERE (floor(i / 63) + 1) * 63 <= nn)''', 'ticker, block')}) GROUP BY ticker)""", "f2")
query("beta_stability", "ticker blocks:i stability:6", "SELECT * FROM bstab", "bstab")(
    lambda m: regress.beta_stability(regress.two_factor_frame(rets(m), regress.market_returns(m.benchmark), regress.group_returns(m.sector_proxy, "sector", "sector_r"))))
view("tf", f"""SELECT o.ticker, n AS sample_size, b1 AS market_beta, b2 AS sector_beta, r2 AS r_squared, momentum, stability,
 CASE WHEN r2 >= 0.45 THEN 'Performance Driver: Mostly Market and Sector Environment' ELSE 'Performance Driver: Meaningful Company-Specific Movement' END AS driver,
 CASE WHEN stability >= 0.5 THEN 'Medium' ELSE 'Low' END AS confidence FROM ({ols2('f2', 'ticker')}) o JOIN (SELECT ticker, sum(r) AS momentum FROM rx WHERE rn <= 63 GROUP BY ticker) USING (ticker) JOIN bstab USING (ticker)""",
     "f2", "rx", "bstab")
query("ols_two_factor", "ticker sample_size:i market_beta:6 sector_beta:6 r_squared:7 momentum:8 stability:6 driver confidence", "SELECT * FROM tf", "tf")(
    lambda m: regress.two_factor(regress.two_factor_frame(rets(m), regress.market_returns(m.benchmark), regress.group_returns(m.sector_proxy, "sector", "sector_r")), rets(m)))

SECTORS = ("AFRICA", "AMERICA", "ASIA")


def portfolio_factors(m):
    wide = regress.group_returns(m.sector_proxy, "sector", "f").groupBy("date").pivot("sector", list(SECTORS)).agg(F.first("f"))
    return pfseries(m).join(wide, "date")


query("factor_sensitivity", "portfolio_id term signed_exposure:4 share_pct:2 concentrated",
      f"""SELECT *, share_pct >= 35 AS concentrated FROM (SELECT portfolio_id, CASE term WHEN 'bench_r' THEN 'AFRICA' WHEN 'sector_r' THEN 'AMERICA' ELSE 'ASIA' END AS term, coefficient AS signed_exposure,
 round(abs(coefficient) / sum(abs(coefficient)) OVER (PARTITION BY portfolio_id) * 100, 2) AS share_pct FROM ({ols3('''(SELECT portfolio_id, p.date, p.r AS y, a.r AS x1, b.r AS x2, c.r AS x3 FROM pfr p
 JOIN (SELECT date, r FROM sectx WHERE sector = 'AFRICA') a USING (date) JOIN (SELECT date, r FROM sectx WHERE sector = 'AMERICA') b USING (date) JOIN (SELECT date, r FROM sectx WHERE sector = 'ASIA') c USING (date)
 WHERE a.r IS NOT NULL AND b.r IS NOT NULL AND c.r IS NOT NULL)''', 'portfolio_id')}) WHERE term <> 'alpha')""", "pfr sectx")(
    lambda m: regress.factor_sensitivity(portfolio_factors(m), ("portfolio_id",), "r", SECTORS))

# the leading eigenvector of a symmetric matrix is what its powers tend to: square it 34 times, keep the row of the
# largest diagonal entry, take its share out of the matrix, and again
view("pc0", "SELECT list(r ORDER BY a) AS m, list(a ORDER BY a) AS names FROM (SELECT a, list(corr ORDER BY b) AS r FROM covp GROUP BY a)", "covp")
for _k in range(1, 6):
    view(f"pw{_k}", f"""WITH RECURSIVE p(n, x) AS (SELECT 0, m FROM pc{_k - 1} UNION ALL SELECT n + 1, list_transform(y, lambda r: list_transform(r, lambda e: e / t)) FROM (
 SELECT n, y, list_sum(list_transform(range(1, len(y) + 1), lambda i: y[i][i])) AS t FROM (SELECT n, list_transform(x, lambda r: list_transform(x, lambda c: list_dot_product(r, c))) AS y FROM p WHERE n < 34))) SELECT x FROM p WHERE n = 34""", f"pc{_k - 1}")
    view(f"pv{_k}", f"""SELECT m, names, v, list_sum(list_transform(range(1, len(v) + 1), lambda i: v[i] * list_dot_product(m[i], v))) AS l FROM (SELECT m, names, list_transform(w, lambda e: e / sqrt(list_dot_product(w, w)) * sign(w[list_position(list_transform(w, lambda z: abs(z)), list_max(list_transform(w, lambda z: abs(z))))])) AS v FROM (
 SELECT m, names, x[list_position(d, list_max(d))] AS w FROM (SELECT x, list_transform(range(1, len(x) + 1), lambda i: x[i][i]) AS d FROM pw{_k}), pc{_k - 1}))""", f"pw{_k}", f"pc{_k - 1}")
    view(f"pc{_k}", f"SELECT list_transform(range(1, len(v) + 1), lambda i: list_transform(range(1, len(v) + 1), lambda j: m[i][j] - l * v[i] * v[j])) AS m, names FROM pv{_k}", f"pv{_k}")
query("pca", "component:i explained_variance_pct:6 ticker loading:6 effective_factor_count:i",
      "SELECT *, l / n * 100 AS explained_variance_pct, sum(CASE WHEN first AND l / n > 0.05 THEN 1 ELSE 0 END) OVER () AS effective_factor_count FROM ("
      + " UNION ALL ".join(f"SELECT {k} AS component, l, len(names) AS n, unnest(names) AS ticker, unnest(v) AS loading, unnest(range(1, len(v) + 1)) = 1 AS first FROM pv{k}" for k in range(1, 6)) + ")",
      " ".join(f"pv{k}" for k in range(1, 6)))(
    lambda m: regress.pca(pf.aligned_returns(pf.price_matrix(m.bars))))


def score_future(m):
    w = Window.partitionBy("ticker").orderBy("date")
    return m.bars.select("ticker", "sector", "date",
                         (F.col("close") / F.lag("close", 126).over(w) - 1).alias("score"),
                         (F.lead("close", 21).over(w) / F.col("close") - 1).alias("future")).dropna()


view("icf", """SELECT * FROM (SELECT ticker, sector, date, close / lag(close, 126) OVER w - 1 AS score, lead(close, 21) OVER w / close - 1 AS future FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date))
 WHERE score IS NOT NULL AND future IS NOT NULL""", "bars")
view("icb", """SELECT sector, b AS bucket, avg(future) AS mr, count(*) AS rows FROM (SELECT f.*, CASE WHEN round(score, 12) <= round(q[2], 12) THEN 0 WHEN round(score, 12) <= round(q[3], 12) THEN 1 WHEN round(score, 12) <= round(q[4], 12) THEN 2
 WHEN round(score, 12) <= round(q[5], 12) THEN 3 ELSE 4 END AS b FROM icf f JOIN (SELECT sector, quantile_cont(score, [0, 0.2, 0.4, 0.6, 0.8, 1]) AS q FROM icf GROUP BY sector) USING (sector)) GROUP BY 1, 2""", "icf")
query("ic_buckets", "sector observations:i top_minus_bottom_return:8 information_coefficient:7 positive_monotonicity bucket_returns",
      """SELECT sector, observations, top - bottom AS top_minus_bottom_return, ic AS information_coefficient, mono AS positive_monotonicity, bucket_returns FROM (
 SELECT sector, sum(rows) AS observations, arg_max(mr, bucket) AS top, arg_min(mr, bucket) AS bottom, coalesce(min(step) >= 0, true) AS mono, string_agg(printf('%.6f', mr), '|' ORDER BY bucket) AS bucket_returns
 FROM (SELECT *, mr - lag(mr) OVER (PARTITION BY sector ORDER BY bucket) AS step FROM icb) GROUP BY sector) JOIN (
 SELECT sector, corr(rs, rf) AS ic FROM (SELECT sector, rank() OVER (PARTITION BY sector ORDER BY score) + (count(*) OVER (PARTITION BY sector, score) - 1) / 2e0 AS rs,
  rank() OVER (PARTITION BY sector ORDER BY future) + (count(*) OVER (PARTITION BY sector, future) - 1) / 2e0 AS rf FROM icf) GROUP BY sector) USING (sector)""", "icb icf")(
    lambda m: regress.ic_buckets(score_future(m), ("sector",), "score", "future"))

# p-values: mean monthly return of each ticker against zero
view("mret", "SELECT ticker, sector, date_trunc('month', date) AS mon, sum(r) AS r FROM rets GROUP BY 1, 2, 3", "rets")
view("tt", f"""SELECT *, mean - 1.96e0 * sd / sqrt(n) AS ci_low, mean + 1.96e0 * sd / sqrt(n) AS ci_high, 2 * (1 - {cdf('abs(mean / (sd / sqrt(n)))')}) AS p_value FROM (
 SELECT ticker, sector, yr, count(*) AS n, avg(r) AS mean, stddev_samp(r) AS sd FROM (SELECT *, year(mon) AS yr FROM mret) GROUP BY 1, 2, 3) WHERE n >= 3""", "mret")


def yearly_tests(m):
    monthly = rets(m).groupBy("ticker", "sector", F.trunc("date", "month").alias("mon")).agg(F.sum("r").alias("r"))
    yearly = regress.one_sample_t(monthly.withColumn("yr", F.year("mon")), ("ticker", "sector", "yr"), "r")
    return yearly.filter(F.col("sample_size") >= 3).withColumnRenamed("sample_size", "n")


query("one_sample_t", "ticker yr:i n:i mean:8 ci_low:8 ci_high:8 p_value:7", "SELECT * FROM tt", "tt")(yearly_tests)
query("bh_fdr", "ticker yr:i p_value:6 adjusted_p:6",
      """SELECT ticker, yr, p_value, least(1, min(raw) OVER (ORDER BY pv DESC, hi DESC)) AS adjusted_p FROM (SELECT ticker, yr, p_value, pv, count(*) OVER (ORDER BY pv) AS hi, pv * count(*) OVER () / count(*) OVER (ORDER BY pv) AS raw
 FROM (SELECT *, round(p_value, 6) AS pv FROM tt))""", "tt")(
    lambda m: regress.benjamini_hochberg(yearly_tests(m).withColumn("p_value", F.round("p_value", 6)).withColumn("family", F.lit("all")), ("family",), "p_value"))
query("bonferroni", "sector strategy_count:i raw_best_p_value:6 bonferroni_adjusted_p_value:6 warning",
      """SELECT *, bonferroni_adjusted_p_value > 0.05 AS warning FROM (SELECT sector, count(*) AS strategy_count, min(p_value) AS raw_best_p_value, least(1, min(p_value) * count(*)) AS bonferroni_adjusted_p_value FROM tt GROUP BY sector)""", "tt")(
    lambda m: regress.bonferroni(yearly_tests(m), ("sector",), "p_value"))
