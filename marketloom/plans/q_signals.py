"""Queries: signal outcomes and statistics, backtests, resampling."""

from pyspark.sql import functions as F

from marketloom.functions.rolling import pct_change
from marketloom.operators import backtest, events, regress, risk, signals
from marketloom.operators import indicators as ind
from marketloom.operators import portfolio as pf
from marketloom.plans import q_factors  # noqa: F401  (views)
from marketloom.plans.q_risk import ols3, perf_sql
from marketloom.plans.registry import query, view
from marketloom.plans.views import cdf

view("fwd", """SELECT ticker, date, lead(close, 5) OVER w AS c5, lead(close, 21) OVER w AS c21, lead(close, 63) OVER w AS c63, lead(close, 126) OVER w AS c126, min(close) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS low, rn FROM bx WINDOW w AS (PARTITION BY ticker ORDER BY date)""", "bx")
view("outc", """SELECT s.*, c5 / entry_price - 1 AS return_1w, c21 / entry_price - 1 AS return_1m, c63 / entry_price - 1 AS return_3m, c126 / entry_price - 1 AS return_6m, CASE WHEN rn > 1 THEN low / entry_price - 1 END AS max_drawdown, c21 / entry_price - 1 - (b21 / b0 - 1) AS sp500_relative_return
 FROM sig s JOIN fwd USING (ticker, date) JOIN (SELECT date, close AS b0, lead(close, 21) OVER (ORDER BY date) AS b21 FROM bench) USING (date)""", "sig", "fwd", "bench")


def raw_signals(m):
    return events.hist_signals(m.bars, m.benchmark)


def outcomes(m):
    return signals.signal_outcome(raw_signals(m), m.bars, m.benchmark)


# signals of any day, some of them years before the first bar, and a benchmark that ends half a year early
view("sigm", "SELECT * REPLACE (CASE WHEN day(date) = 13 THEN date - 9000 ELSE date - CAST(day(date) % 4 AS INTEGER) END AS date) FROM sig", "sig")
view("outm", """SELECT s.*, c5 / entry_price - 1 AS return_1w, c21 / entry_price - 1 AS return_1m, c63 / entry_price - 1 AS return_3m, c126 / entry_price - 1 AS return_6m, CASE WHEN rn > 1 THEN low / entry_price - 1 END AS max_drawdown, c21 / entry_price - 1 - (b21 / b0 - 1) AS sp500_relative_return
 FROM sigm s ASOF JOIN fwd f ON s.ticker = f.ticker AND s.date <= f.date ASOF LEFT JOIN (SELECT date, close AS b0, lead(close, 21) OVER (ORDER BY date) AS b21 FROM bench WHERE date < (SELECT max(date) - 180 FROM bench)) b ON s.date <= b.date""", "sigm", "fwd", "bench")


def moved_outcomes(m):
    day = F.dayofmonth("date")
    moved = raw_signals(m).withColumn("date", F.when(day == 13, F.date_sub("date", 9000)).otherwise(F.date_sub("date", day % 4)))
    last = m.benchmark.agg(F.max("date").alias("_last"))  # one row
    short = m.benchmark.crossJoin(F.broadcast(last)).filter(F.col("date") < F.date_sub("_last", 180)).drop("_last")
    return signals.signal_outcome(moved, m.bars, short)


query("signal_outcome", "ticker date:d signal_type return_1w:8 return_1m:8 return_3m:8 return_6m:8 max_drawdown:8 sp500_relative_return:8", "SELECT * FROM outm", "outm")(moved_outcomes)


def with_id(df):
    return df.withColumn("id", F.concat_ws("~", "ticker", F.col("date").cast("string"), "signal_type"))


def partial_outcomes(m):
    """Outcomes on file: the reclaim signals only, without a six-month return after 2000."""
    o = with_id(outcomes(m)).filter("signal_type <> 'high_volume_52w_breakout'")
    return o.select(F.col("id").alias("signal_id"), "return_1w", "return_1m", "return_3m", F.when(F.col("date") < "2000-01-01", F.col("return_6m")).alias("return_6m"), "max_drawdown", "sp500_relative_return")


query("join_left_pending", "ticker date:d signal_type", "SELECT * FROM outc WHERE signal_type = 'high_volume_52w_breakout' OR date >= DATE '2000-01-01' OR return_6m IS NULL", "outc")(
    lambda m: signals.pending(with_id(raw_signals(m)), partial_outcomes(m)))
query("join_outcomes", "ticker date:d signal_type score:i return_1m:8 return_6m:8", "SELECT ticker, date, signal_type, score, return_1m, CASE WHEN date < DATE '2000-01-01' THEN return_6m END AS return_6m FROM outc WHERE signal_type <> 'high_volume_52w_breakout'", "outc")(
    lambda m: signals.with_outcomes(with_id(raw_signals(m)), partial_outcomes(m)))

view("ssum", f"""SELECT *, average_return - 1.96e0 * sd / sqrt(sample_size) AS ci_low, average_return + 1.96e0 * sd / sqrt(sample_size) AS ci_high, 2 * (1 - {cdf('abs(average_return / (sd / sqrt(sample_size)))')}) AS p_value, expected_value / sd AS sharpe_like FROM (SELECT *, win_rate * average_win + (1 - win_rate) * average_loss AS expected_value, sqrt(variance) AS sd FROM (
 SELECT signal_type, count(return_1m) AS sample_size, avg(CASE WHEN return_1m > 0 THEN 1e0 WHEN return_1m <= 0 THEN 0e0 END) AS win_rate, avg(CASE WHEN return_1m > 0 THEN return_1m END) AS average_win, avg(CASE WHEN return_1m <= 0 THEN return_1m END) AS average_loss, avg(return_1m) AS average_return, var_samp(return_1m) AS variance, median(return_1m) AS median_return,
 avg(sp500_relative_return) AS average_relative_return, avg(max_drawdown) AS average_max_drawdown, avg(CASE WHEN return_1m <= 0 THEN 1e0 WHEN return_1m > 0 THEN 0e0 END) AS false_positive_rate FROM outc GROUP BY 1))""", "outc")
query("signal_summary", "signal_type sample_size:i win_rate:8 average_win:8 average_loss:8 expected_value:8 average_return:8 median_return:8 variance:9 sharpe_like:7 p_value:7 ci_low:8 ci_high:8 average_relative_return:8 average_max_drawdown:8 false_positive_rate:8", "SELECT * FROM ssum", "ssum")(
    lambda m: signals.signal_summary(outcomes(m)))

view("tspl", """SELECT *, test_average_return - train_average_return AS generalization_gap, test_average_return > 0 AS passes_out_of_sample FROM (SELECT signal_type, sum(CASE WHEN p <= floor(n * 0.7e0) THEN 1 ELSE 0 END) AS train_size, sum(CASE WHEN p > floor(n * 0.7e0) THEN 1 ELSE 0 END) AS test_size, avg(CASE WHEN p <= floor(n * 0.7e0) THEN return_1m END) AS train_average_return, avg(CASE WHEN p > floor(n * 0.7e0) THEN return_1m END) AS test_average_return FROM (
 SELECT *, row_number() OVER (PARTITION BY signal_type ORDER BY CAST(date AS VARCHAR) || ticker) AS p, count(*) OVER (PARTITION BY signal_type) AS n FROM outc WHERE return_1m IS NOT NULL) GROUP BY 1)""", "outc")


def ordered_numeric(m):
    """Order value as a number: days since 1970, then the ticker's alphabetical place."""
    o = outcomes(m)
    place = m.table("nation").agg(F.array_sort(F.collect_list("n_name")).alias("_names"))  # 25 names
    return o.crossJoin(F.broadcast(place)).withColumn("ord", (F.unix_date("date") * 1000 + F.array_position("_names", F.col("ticker"))).cast("double")).drop("_names")


query("time_split", "signal_type train_size:i test_size:i train_average_return:8 test_average_return:8 generalization_gap:8 passes_out_of_sample", "SELECT * FROM tspl", "tspl")(
    lambda m: signals.time_split(ordered_numeric(m), ("signal_type",), "ord", "return_1m"))


query("signal_labels", "signal_type confidence attractiveness",
      """SELECT signal_type, CASE WHEN sample_size < 30 THEN 'Low sample size' WHEN p_value <= 0.01 THEN 'High' WHEN p_value <= 0.05 THEN 'Moderate' ELSE 'Low / likely noisy' END AS confidence, CASE WHEN sample_size < 10 THEN 'Too early' WHEN expected_value <= 0 THEN 'Unattractive' WHEN test_average_return <= 0 THEN 'Fails out-of-sample check'
 WHEN p_value > 0.1 AND sample_size >= 30 THEN 'Positive but not statistically convincing' WHEN expected_value >= 0.04 AND variance <= 0.01 THEN 'Very attractive signal' WHEN expected_value >= 0.04 AND variance > 0.04 THEN 'High EV but dangerous variance' WHEN variance <= 0.02 THEN 'Constructive' ELSE 'Positive EV but monitor risk' END AS attractiveness FROM ssum JOIN tspl USING (signal_type)""", "ssum tspl")(
    lambda m: signals.signal_labels(signals.signal_summary(outcomes(m)), signals.time_split(ordered_numeric(m), ("signal_type",), "ord", "return_1m")))


def regression_rows(m):
    """Outcomes with a varying score (points plus entry price over 100) and confidence (drawdown)."""
    return outcomes(m).withColumn("confidence", F.col("max_drawdown") * 100).withColumn("score", F.col("score") + F.col("entry_price") - 100)


query("signal_regression", "sector sample_size:i r_squared:6 term coefficient:6 std_error:6 t_stat:4",
      """SELECT sector, n AS sample_size, 1 - sse / syy AS r_squared, unnest(['alpha', 'score', 'confidence']) AS term, unnest([my - b1 * m1 - b2 * m2, b1, b2]) AS coefficient, unnest([sqrt(mse * (1e0 / n + (m1 * m1 * s22 + m2 * m2 * s11 - 2 * m1 * m2 * s12) / det)), sqrt(mse * s22 / det), sqrt(mse * s11 / det)]) AS std_error,
 unnest([(my - b1 * m1 - b2 * m2) / sqrt(mse * (1e0 / n + (m1 * m1 * s22 + m2 * m2 * s11 - 2 * m1 * m2 * s12) / det)), b1 / sqrt(mse * s22 / det), b2 / sqrt(mse * s11 / det)]) AS t_stat FROM (SELECT *, sse / (n - 3) AS mse FROM (SELECT *, syy - b1 * c1 - b2 * c2 AS sse FROM (SELECT *, (c1 * s22 - c2 * s12) / det AS b1, (c2 * s11 - c1 * s12) / det AS b2 FROM (SELECT *, s11 * s22 - s12 * s12 AS det FROM (
 SELECT sector, count(*) AS n, avg(y) AS my, avg(a) AS m1, avg(b) AS m2, var_pop(y) * count(*) AS syy, covar_pop(a, y) * count(*) AS c1, covar_pop(b, y) * count(*) AS c2, var_pop(a) * count(*) AS s11, var_pop(b) * count(*) AS s22, covar_pop(a, b) * count(*) AS s12 FROM (SELECT sector, return_1m AS y, score + entry_price - 100 AS a, max_drawdown * 100 AS b FROM outc WHERE return_1m IS NOT NULL AND max_drawdown IS NOT NULL) GROUP BY 1)))))""", "outc")(
    lambda m: signals.signal_regression(regression_rows(m), ("sector",)))

query("signal_reliability", "signal_type reliability_score:5 classification warnings",
      """SELECT *, CASE WHEN reliability_score >= 70 AND warnings = '' THEN 'Promising' WHEN reliability_score >= 45 THEN 'Needs validation' ELSE 'Noisy' END AS classification FROM (SELECT signal_type, least(100, greatest(0, sample_size / 100e0 * 40 + abs(expected_value) * 2000 + greatest(0, win_rate - 0.5) * 80)) AS reliability_score,
 concat_ws('|', CASE WHEN sample_size < 30 THEN 'Sample size is too small for strong statistical confidence.' END, CASE WHEN abs(expected_value) <= 0.006 THEN 'Most or all edge disappears after estimated transaction costs.' END, CASE WHEN win_rate BETWEEN 0.45 AND 0.55 AND abs(expected_value) < 0.01 THEN 'Win rate and edge are close to noise.' END) AS warnings FROM ssum)""", "ssum")(
    lambda m: signals.reliability(signals.signal_summary(outcomes(m)).withColumn("average_edge", F.col("expected_value")).withColumn("cost_drag", F.lit(0.006))).withColumn("warnings", F.array_join("warnings", "|")))
query("overfit_gap", "signal_type generalization_gap:8 overfitting_risk",
      "SELECT signal_type, train_average_return - test_average_return AS generalization_gap, CASE WHEN train_average_return - test_average_return > abs(train_average_return) * 0.5 THEN 'High' WHEN train_average_return - test_average_return > abs(train_average_return) * 0.25 THEN 'Medium' ELSE 'Low' END AS overfitting_risk FROM tspl", "tspl")(
    lambda m: signals.overfit_gap(signals.time_split(ordered_numeric(m), ("signal_type",), "ord", "return_1m")))


def learning_frame(m):
    t = ind.simple_returns(m.bars, (5, 20, 63))
    fwd = F.lead("close", 21).over(ind.over())
    t = t.withColumn("future_return", fwd / F.col("close") - 1).withColumn("outperformed", (F.col("future_return") > 0).cast("double"))
    return signals.model_frame(t, ("ret_5", "ret_20", "ret_63"), "future_return", ("date",))


view("lrn", """SELECT 1 AS g, date, y, x1, x2, x3, datediff('day', DATE '1970-01-01', date) <= quantile_cont(datediff('day', DATE '1970-01-01', date)::DOUBLE, 0.7) OVER () AS train FROM (SELECT date, close / lag(close, 5) OVER w - 1 AS x1, close / lag(close, 20) OVER w - 1 AS x2, close / lag(close, 63) OVER w - 1 AS x3, lead(close, 21) OVER w / close - 1 AS y FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)) WHERE x3 IS NOT NULL AND y IS NOT NULL""", "bars")
view("lfit", f"SELECT max(coefficient) FILTER (term = 'alpha') AS b0, max(coefficient) FILTER (term = 'bench_r') AS b1, max(coefficient) FILTER (term = 'sector_r') AS b2, max(coefficient) FILTER (term = 'prev_r') AS b3 FROM ({ols3('(SELECT * FROM lrn WHERE train)', 'g')})", "lrn")
query("linear_model", "term coefficient:6 train_size:i test_size:i test_mae:7",
      """SELECT unnest(['intercept', 'ret_5', 'ret_20', 'ret_63']) AS term, unnest([b0, b1, b2, b3]) AS coefficient, train_size, test_size, test_mae FROM (SELECT any_value(b0) AS b0, any_value(b1) AS b1, any_value(b2) AS b2, any_value(b3) AS b3, count(*) FILTER (train) AS train_size, count(*) FILTER (NOT train) AS test_size, avg(abs(b0 + b1 * x1 + b2 * x2 + b3 * x3 - y)) FILTER (NOT train) AS test_mae FROM lrn, lfit)""", "lrn lfit")(
    lambda m: signals.linear_model(learning_frame(m), ("ret_5", "ret_20", "ret_63"), "future_return"))

# Newton's method, a pair of views a round: sums of gradient and Hessian, and the step by a Cholesky factor of the four by four system
view("lgx", """SELECT ticker, date, y, train, 1e0 AS z0, """ + ", ".join(f"(x{i} - avg(x{i}) FILTER (train) OVER t) / coalesce(nullif(stddev_samp(x{i}) FILTER (train) OVER t, 0), 1) AS z{i}" for i in (1, 2, 3)) + """ FROM (
 SELECT ticker, date, CASE WHEN f > 0 THEN 1e0 ELSE 0e0 END AS y, x1, x2, x3, datediff('day', DATE '1970-01-01', date) <= quantile_cont(datediff('day', DATE '1970-01-01', date)::DOUBLE, 0.7) OVER () AS train FROM (SELECT ticker, date, close / lag(close, 5) OVER w - 1 AS x1, close / lag(close, 20) OVER w - 1 AS x2, close / lag(close, 63) OVER w - 1 AS x3, lead(close, 21) OVER w / close - 1 AS f FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)) WHERE x3 IS NOT NULL AND f IS NOT NULL)
 WINDOW t AS (PARTITION BY ticker) QUALIFY count(*) OVER t >= 30""", "bars")
view("lgw0", "SELECT ticker, " + ", ".join(f"0e0 AS w{i}" for i in range(4)) + " FROM lgx GROUP BY ticker", "lgx")
STEP = (
    "sqrt(h00 + 1e-9) AS a0, h01 / a0 AS a1, h02 / a0 AS a2, h03 / a0 AS a3, sqrt(h11 + 1e-9 - a1 * a1) AS b1, (h12 - a2 * a1) / b1 AS b2, (h13 - a3 * a1) / b1 AS b3, sqrt(h22 + 1e-9 - a2 * a2 - b2 * b2) AS c2, "
    "(h23 - a3 * a2 - b3 * b2) / c2 AS c3, sqrt(h33 + 1e-9 - a3 * a3 - b3 * b3 - c3 * c3) AS e3, g0 / a0 AS u0, (g1 - a1 * u0) / b1 AS u1, (g2 - a2 * u0 - b2 * u1) / c2 AS u2, (g3 - a3 * u0 - b3 * u1 - c3 * u2) / e3 AS u3, "
    "u3 / e3 AS d3, (u2 - c3 * d3) / c2 AS d2, (u1 - b2 * d2 - b3 * d3) / b1 AS d1, (u0 - a1 * d1 - a2 * d2 - a3 * d3) / a0 AS d0"
)
for _r in range(1, 9):
    view(f"lgs{_r}", "SELECT ticker, " + ", ".join(f"any_value(w{i}) AS w{i}, sum(z{i} * (y - p)) AS g{i}" for i in range(4)) + ", " + ", ".join(f"sum(z{i} * z{j} * p * (1 - p)) AS h{i}{j}" for i in range(4) for j in range(i, 4))
         + f" FROM (SELECT *, 1 / (1 + exp(-(w0 + w1 * z1 + w2 * z2 + w3 * z3))) AS p FROM lgx JOIN lgw{_r - 1} USING (ticker) WHERE train) GROUP BY ticker", "lgx", f"lgw{_r - 1}")
    view(f"lgw{_r}", "SELECT ticker, " + ", ".join(f"w{i} + greatest(least(d{i}, 5), -5) AS w{i}" for i in range(4)) + f" FROM (SELECT *, {STEP} FROM lgs{_r})", f"lgs{_r}")
query("logistic_model", "ticker term coefficient:5 train_size:i test_size:i test_accuracy:8",
      """SELECT ticker, unnest(['intercept', 'ret_5', 'ret_20', 'ret_63']) AS term, unnest([w0, w1, w2, w3]) AS coefficient, train_size, test_size, test_accuracy FROM (SELECT ticker, any_value(w0) AS w0, any_value(w1) AS w1, any_value(w2) AS w2, any_value(w3) AS w3, count(*) FILTER (train) AS train_size, count(*) FILTER (NOT train) AS test_size,
 avg(CASE WHEN (w0 + w1 * z1 + w2 * z2 + w3 * z3 >= 0) = (y > 0.5) THEN 1e0 ELSE 0e0 END) FILTER (NOT train) AS test_accuracy FROM lgx JOIN lgw8 USING (ticker) GROUP BY ticker)""", "lgx lgw8")(
    lambda m: signals.logistic_model(learning_frame(m), ("ret_5", "ret_20", "ret_63"), "outperformed"))

# --- backtests ---------------------------------------------------------------------------
view("wfr", """SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS j, count(*) OVER (PARTITION BY ticker) AS nj FROM (SELECT ticker, date, close, close / lag(close, 20) OVER (PARTITION BY ticker ORDER BY date) - 1 AS signal FROM bars) WHERE signal IS NOT NULL""", "bars")
view("wfp", """SELECT *, gross - cost AS r FROM (SELECT *, coalesce(lag(p) OVER w, 0) * coalesce(close / lag(close) OVER w - 1, 0) AS gross, coalesce(abs(p - lag(p) OVER w), 0) AS turnover, coalesce(abs(p - lag(p) OVER w), 0) * 10 / 1e4 AS cost FROM (
 SELECT t.*, CASE WHEN round(signal, 12) >= round(thr, 12) THEN 1e0 ELSE 0e0 END AS p FROM (SELECT *, CASE WHEN j >= 252 THEN CAST(floor((j - 252) / 63) AS BIGINT) END AS fold FROM wfr WHERE nj >= 315) t LEFT JOIN (SELECT f.ticker, f.fold, quantile_cont(x.signal, 0.75) AS thr FROM (SELECT DISTINCT ticker, CAST(floor((j - 252) / 63) AS BIGINT) AS fold FROM wfr WHERE j >= 252) f JOIN wfr x ON x.ticker = f.ticker AND x.j >= f.fold * 63 AND x.j < f.fold * 63 + 252 GROUP BY 1, 2) q
 ON t.ticker = q.ticker AND t.fold = q.fold) WINDOW w AS (PARTITION BY ticker ORDER BY date)) WHERE j >= 252""", "wfr")


def wf_rows(m):
    return m.bars.withColumn("signal", pct_change("close", 20))


query("wf_signal_backtest", "ticker gross_return:8 net_return:8 drag:8 average_exposure:8 turnover:4 folds:i cagr:4 sharpe_ratio:4 max_drawdown:4 win_rate:4 profit_factor:4",
      f"""SELECT s.*, p.* EXCLUDE (ticker) FROM (SELECT ticker, exp(sum(ln(1 + gross))) - 1 AS gross_return, exp(sum(ln(1 + r))) - 1 AS net_return, sum(cost) AS drag, avg(p) AS average_exposure, sum(turnover) AS turnover, count(DISTINCT fold) AS folds FROM wfp GROUP BY 1) s JOIN ({perf_sql('wfp', 'ticker')}) p USING (ticker)""", "wfp")(
    lambda m: backtest.wf_signal_backtest(wf_rows(m)))
query("wf_attribution", "ticker beta:7 alpha_annualized:7 residual_volatility:7 benchmark_correlation:6",
      """SELECT ticker, regr_slope(y, x) AS beta, regr_intercept(y, x) * 252 AS alpha_annualized, sqrt((regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / (count(*) - 1)) * sqrt(252) AS residual_volatility, corr(y, x) AS benchmark_correlation FROM (SELECT w.ticker, w.r AS y, b.r AS x FROM wfp w JOIN benchx b USING (date) WHERE b.r IS NOT NULL) GROUP BY 1 HAVING count(*) >= 30""", "wfp benchx")(
    lambda m: regress.market_model(backtest.wf_positions(wf_rows(m)), regress.market_returns(m.benchmark), least=30))
query("fold_robustness", "ticker sample_size:i fold_count:i positive_fold_pct:7 worst_fold_return:8 best_fold_return:8 return_stability:8",
      """SELECT ticker, sum(n) AS sample_size, count(*) AS fold_count, avg(CASE WHEN round(fr, 14) > 0 THEN 1e0 ELSE 0e0 END) AS positive_fold_pct, min(fr) AS worst_fold_return, max(fr) AS best_fold_return, stddev_samp(fr) AS return_stability FROM (SELECT ticker, fold, exp(sum(ln(1 + r))) - 1 AS fr, count(*) AS n FROM wfp GROUP BY 1, 2) GROUP BY 1""", "wfp")(
    lambda m: backtest.fold_robustness(backtest.wf_positions(wf_rows(m))))
query("equity_curve", "ticker date:d equity:7", "SELECT ticker, date, exp(sum(ln(1 + r)) OVER (PARTITION BY ticker ORDER BY date)) AS equity FROM wfp", "wfp")(
    lambda m: backtest.equity_curve(backtest.wf_positions(wf_rows(m))))

view("cal", "SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos, last_day(date) AS mon FROM (SELECT DISTINCT date FROM pm)", "pm")
view("mpick", """SELECT lookback, date, ticker, 1e0 / count(*) OVER (PARTITION BY lookback, date) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY lookback, date ORDER BY mom DESC, ticker) AS rk FROM (
 SELECT h.lookback, x.date, x.ticker, CASE h.lookback WHEN 63 THEN m63 WHEN 126 THEN m126 WHEN 252 THEN m252 ELSE m504 END AS mom FROM (SELECT ticker, date, close / lag(close, 63) OVER w - 1 AS m63, close / lag(close, 126) OVER w - 1 AS m126, close / lag(close, 252) OVER w - 1 AS m252, close / lag(close, 504) OVER w - 1 AS m504 FROM pm WINDOW w AS (PARTITION BY ticker ORDER BY date)) x
 JOIN (SELECT max(date) AS date, max(pos) AS pos FROM cal GROUP BY mon) e USING (date) JOIN (VALUES (63), (126), (252), (504)) AS h(lookback) ON e.pos >= h.lookback) WHERE mom IS NOT NULL) WHERE rk <= 5""", "pm", "cal")
view("mturn", "SELECT lookback, date, lead(date) OVER (PARTITION BY lookback ORDER BY date) AS until FROM (SELECT DISTINCT lookback, date FROM mpick)", "mpick")
view("mret2", """SELECT c.lookback, c.date, coalesce(g.gross, 0) - coalesce(t.turnover, 0) * 10 / 1e4 AS r, coalesce(t.turnover, 0) AS turnover FROM (SELECT lookback, date FROM cal, (VALUES (63), (126), (252), (504)) AS h(lookback)) c LEFT JOIN (
 SELECT u.lookback, r.date, sum(p.weight * coalesce(r.r, 0)) AS gross FROM mturn u JOIN mpick p ON p.lookback = u.lookback AND p.date = u.date JOIN pmr r ON r.ticker = p.ticker AND r.date > u.date AND (u.until IS NULL OR r.date <= u.until) GROUP BY 1, 2) g USING (lookback, date)
 LEFT JOIN (SELECT coalesce(a.lookback, b.lookback) AS lookback, coalesce(a.date, b.date) AS date, sum(abs(coalesce(a.weight, 0) - coalesce(b.weight, 0))) AS turnover FROM mpick a FULL JOIN (SELECT u.lookback, u.until AS date, p.ticker, p.weight FROM mturn u JOIN mpick p ON p.lookback = u.lookback AND p.date = u.date WHERE u.until IS NOT NULL) b ON a.lookback = b.lookback AND a.date = b.date AND a.ticker = b.ticker GROUP BY 1, 2) t USING (lookback, date)""", "cal", "mturn", "mpick", "pmr")
query("momentum_backtest", "lookback:i date:d r:9 turnover:6", "SELECT * FROM mret2", "mret2")(lambda m: backtest.momentum_backtest(pf.price_matrix(m.bars), (63, 126, 252, 504))[0])
query("momentum_research", "lookback:i cagr:4 sharpe_ratio:4 sortino_ratio:4 max_drawdown:4 win_rate:4 profit_factor:4", perf_sql("mret2", "lookback"), "mret2")(
    lambda m: risk.performance_report(backtest.momentum_backtest(pf.price_matrix(m.bars), (63, 126, 252, 504))[0], ("lookback",)))

SIMS = 5000
view("arr", "SELECT ticker, array_agg(r ORDER BY date) AS rs, count(*) AS n FROM (SELECT ticker, date, r FROM bx WHERE rn <= 252 AND r IS NOT NULL) GROUP BY 1", "bx")


def paths_sql(src, index):
    return f"""SELECT ticker, sim, exp(sum(ln(1 + x))) - 1 AS t, min(g / pk - 1) * 100 AS dd, any_value(n) AS n FROM (SELECT *, max(g) OVER (PARTITION BY ticker, sim ORDER BY day) AS pk FROM (SELECT *, exp(sum(ln(1 + x)) OVER (PARTITION BY ticker, sim ORDER BY day)) AS g FROM (
 SELECT ticker, sim, day, n, rs[CAST({index} AS BIGINT) + 1] AS x FROM {src}, range(0, {SIMS}) AS s(sim), range(0, 30) AS d(day)))) GROUP BY 1, 2"""


def ends_sql(src):
    return f"""SELECT ticker, max(n) AS sample, quantile_cont(price * (1 + t), 0.05) AS p5, quantile_cont(price * (1 + t), 0.5) AS p50, quantile_cont(price * (1 + t), 0.95) AS p95, avg(CASE WHEN t > 0 THEN 1e2 ELSE 0 END) AS ending_higher_pct FROM {src} JOIN lastpx USING (ticker) GROUP BY 1"""


view("paths", paths_sql("arr", "(sim * 7919 + day * 104729 + 42) % n"), "arr")
view("paths_block", paths_sql("arr", "((sim * 7919 + (day // 5) * 104729 + 42) % (n - 4) + day % 5) % n"), "arr")
view("arrw", "SELECT ticker, CASE WHEN len(w) >= 20 THEN w ELSE rs END AS rs, len(CASE WHEN len(w) >= 20 THEN w ELSE rs END) AS n FROM (SELECT ticker, rs, list_filter(rs, lambda r: r <= md) AS w FROM (SELECT *, list_median(rs) AS md FROM arr))", "arr")
view("paths_weak", paths_sql("arrw", "(sim * 7919 + day * 104729 + 42) % n"), "arrw")
query("bootstrap_scenarios", "ticker sample:i current_price:4 p5:6 p10:6 p25:6 p50:6 p75:6 p90:6 p95:6 dd50:6 dd80:6 dd90:6 dd95:6 ending_higher_pct:4 down_5_pct:4 down_10_pct:4 up_5_pct:4 up_10_pct:4 outlook risk_level confidence",
      f"""SELECT *, CASE WHEN ending_higher_pct >= 58 THEN 'Moderately Positive' WHEN ending_higher_pct <= 45 THEN 'Cautious' ELSE 'Mixed' END AS outlook, CASE WHEN down_10_pct >= 25 THEN 'High' WHEN down_10_pct >= 10 THEN 'Moderate' ELSE 'Lower' END AS risk_level, CASE WHEN sample >= 180 THEN 'Medium' ELSE 'Low' END AS confidence FROM (
 SELECT ticker, max(n) AS sample, max(price) AS current_price, {', '.join(f'quantile_cont(price * (1 + t), {p / 100}) AS p{p}' for p in (5, 10, 25, 50, 75, 90, 95))}, {', '.join(f'quantile_cont(dd, {p / 100}) AS dd{p}' for p in (50, 80, 90, 95))},
 avg(CASE WHEN t > 0 THEN 1e2 ELSE 0 END) AS ending_higher_pct, avg(CASE WHEN t <= -0.05 THEN 1e2 ELSE 0 END) AS down_5_pct, avg(CASE WHEN t <= -0.1 THEN 1e2 ELSE 0 END) AS down_10_pct, avg(CASE WHEN t >= 0.05 THEN 1e2 ELSE 0 END) AS up_5_pct, avg(CASE WHEN t >= 0.1 THEN 1e2 ELSE 0 END) AS up_10_pct FROM paths JOIN lastpx USING (ticker) GROUP BY 1)""", "paths lastpx")(
    lambda m: backtest.bootstrap_scenarios(m.bars, 30, SIMS, mode="arithmetic"))
BRIEF = "ticker sample:i p5:6 p50:6 p95:6 ending_higher_pct:4"
query("bootstrap_block", BRIEF, ends_sql("paths_block"), "paths_block lastpx")(lambda m: backtest.bootstrap_scenarios(m.bars, 30, SIMS, method="block", mode="arithmetic"))
query("bootstrap_regime", BRIEF, ends_sql("paths_weak"), "paths_weak lastpx")(lambda m: backtest.bootstrap_scenarios(m.bars, 30, SIMS, method="regime_conditioned", condition="Weak", mode="arithmetic"))

query("model_disagreement", "ticker ratio:7 model_disagreement",
      """SELECT *, CASE WHEN n < 120 OR ratio IS NULL OR ratio > 1.8 OR ratio < 0.55 THEN 'High' WHEN ratio > 1.35 OR ratio < 0.75 THEN 'Medium' ELSE 'Low' END AS model_disagreement FROM (SELECT ticker, max(n_rows) AS n, stddev_samp(CASE WHEN rn <= 30 THEN r END) / nullif(stddev_samp(CASE WHEN rn <= 252 THEN r END), 0) AS ratio FROM rx GROUP BY 1)""", "rx")(
    lambda m: backtest.model_disagreement(ind.daily_returns(m.bars)))

CAL_SIMS = 500
view("callr", "SELECT ticker, array_agg(r ORDER BY date) AS rs, count(*) AS n FROM rets GROUP BY 1", "rets")
view("calc", "SELECT ticker, array_agg(close ORDER BY date) AS cs FROM bars GROUP BY 1", "bars")
view("calo", f"""SELECT ticker, origin, any_value(now) AS now, any_value(later) AS later, {', '.join(f'quantile_cont(e, {q}) AS q{int(q * 100):02d}' for q in (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95))}, avg(CASE WHEN e > now THEN 1e0 ELSE 0e0 END) AS pu FROM (SELECT ticker, origin, sim, any_value(now) AS now, any_value(later) AS later, any_value(now) * exp(sum(ln(1 + x))) AS e FROM (
 SELECT ticker, origin, sim, cs[origin + 1] AS now, cs[origin + 31] AS later, rs[CAST((sim * 7919 + day * 104729 + 7) % origin AS BIGINT) + 1] AS x FROM (SELECT callr.*, cs, unnest(range(90, n - 30, 10)) AS origin FROM callr JOIN calc USING (ticker)), range(0, {CAL_SIMS}) AS s(sim), range(0, 30) AS d(day)) GROUP BY 1, 2, 3) GROUP BY 1, 2""", "callr", "calc")
query("forecast_calibration", "ticker sample_size:i coverage_50:6 coverage_80:6 coverage_90:6 directional_hit_rate:6 brier_score:9 median_absolute_error:9 false_confidence_rate:6 baseline_hit_rate:6 calibration_error:6",
      """SELECT *, abs(coverage_80 - 0.8e0) AS calibration_error FROM (SELECT ticker, count(*) AS sample_size, avg(CASE WHEN later BETWEEN q25 AND q75 THEN 1e0 ELSE 0e0 END) AS coverage_50, avg(CASE WHEN later BETWEEN q10 AND q90 THEN 1e0 ELSE 0e0 END) AS coverage_80, avg(CASE WHEN later BETWEEN q05 AND q95 THEN 1e0 ELSE 0e0 END) AS coverage_90,
 avg(CASE WHEN (pu >= 0.5) = (later >= now) THEN 1e0 ELSE 0e0 END) AS directional_hit_rate, avg(pow(pu - CASE WHEN later >= now THEN 1e0 ELSE 0e0 END, 2)) AS brier_score, median(abs(q50 - later) / now) AS median_absolute_error, avg(CASE WHEN abs(pu - 0.5) >= 0.25 AND (pu >= 0.5) <> (later >= now) THEN 1e0 ELSE 0e0 END) AS false_confidence_rate, avg(CASE WHEN later >= now THEN 1e0 ELSE 0e0 END) AS baseline_hit_rate FROM calo GROUP BY 1)""", "calo")(
    lambda m: backtest.forecast_calibration(m.bars, simulations=CAL_SIMS, mode="arithmetic"))
