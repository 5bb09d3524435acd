"""Queries: returns, indicators, volatility."""

from pyspark.sql import functions as F

from marketloom.operators import indicators as ind
from marketloom.operators import portfolio as pf
from marketloom.plans.registry import query, view
from marketloom.plans.views import ema, roll, rsi

H = ind.HORIZONS


def W(n):
    return f"(PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


T = "(PARTITION BY ticker ORDER BY date)"

query("ret_simple", "ticker date:d " + " ".join(f"ret_{n}:8" for n in H),
      f"SELECT ticker, date, {', '.join(f'close / lag(close, {n}) OVER {T} - 1 AS ret_{n}' for n in H)} FROM bars", "bars")(
    lambda m: ind.simple_returns(m.bars))

query("ret_rebased", "ticker date:d rebased:8",
      f"SELECT ticker, date, close / first_value(close) OVER {T} - 1 AS rebased FROM bars", "bars")(
    lambda m: ind.rebased(m.bars))

query("ret_rebased_periods", "period portfolio_return:8 benchmark_return:8 relative_return:8",
      """SELECT period, p0 / p - 1 AS portfolio_return, b0 / b - 1 AS benchmark_return, p0 / p - b0 / b AS relative_return FROM (
  SELECT period, days, count(*) AS rows, max(CASE WHEN rn = 1 THEN basket END) AS p0, max(CASE WHEN rn = 1 THEN bench END) AS b0,
         max(CASE WHEN rn = days THEN basket END) AS p, max(CASE WHEN rn = days THEN bench END) AS b
  FROM (SELECT row_number() OVER (ORDER BY date DESC) AS rn, basket, bench FROM
         (SELECT date, avg(x) AS basket FROM (SELECT date, close / first_value(close) OVER (PARTITION BY ticker ORDER BY date) AS x FROM pm) GROUP BY date)
         JOIN (SELECT date, close AS bench FROM bench) USING (date)),
       (VALUES ('1M', 21), ('3M', 63), ('6M', 126), ('1Y', 252)) AS h(period, days) GROUP BY period, days) WHERE rows > days""",
      "pm bench")(lambda m: ind.basket_against_benchmark(pf.price_matrix(m.bars), m.benchmark))

query("sma", "ticker date:d sma20:8 sma50:8 sma200:8",
      f"SELECT ticker, date, {', '.join(roll('avg', 'close', n) + f' AS sma{n}' for n in (20, 50, 200))} FROM bars", "bars")(
    lambda m: ind.sma(m.bars))

query("ema", "ticker date:d ema20:7 ema50:7 ema200:7",
      f"SELECT ticker, date, {', '.join(ema('close', n) + f' AS ema{n}' for n in (20, 50, 200))} FROM bx", "bx")(
    lambda m: ind.ema(m.bars))

view("chg", """SELECT *, CASE WHEN close - prev > 0 THEN close - prev WHEN prev IS NOT NULL THEN 0 END AS up,
 CASE WHEN close - prev < 0 THEN prev - close WHEN prev IS NOT NULL THEN 0 END AS down FROM bx""", "bx")
query("rsi", "ticker date:d rsi:7", f"SELECT ticker, date, {rsi('up', 'down')} AS rsi FROM chg", "chg")(lambda m: ind.rsi(m.bars))

view("tr", "SELECT *, greatest(high - low, coalesce(abs(high - prev), 0), coalesce(abs(low - prev), 0)) AS tr FROM bx", "bx")
query("atr", "ticker date:d atr:8", f"SELECT ticker, date, {roll('avg', 'tr', 14)} AS atr FROM tr", "tr")(lambda m: ind.atr(m.bars))

view("macd0", f"SELECT *, {ema('close', 12)} - {ema('close', 26)} AS macd FROM bx", "bx")
view("macd1", f"SELECT *, {ema('macd', 9)} AS macd_signal FROM macd0", "macd0")
query("macd", "ticker date:d macd:7 macd_signal:7 macd_hist:7",
      "SELECT ticker, date, macd, macd_signal, macd - macd_signal AS macd_hist FROM macd1", "macd1")(lambda m: ind.macd(m.bars))

view("rs0", "SELECT x.*, x.close / b.close AS rs_line FROM bx x JOIN bench b USING (date)", "bx", "bench")
view("rs", f"""SELECT *, (rs_line / rs_sma50 - 1) * 100 AS mrs FROM (SELECT *, {roll('avg', 'rs_line', 50)} AS rs_sma50,
 {roll('avg', 'rs_line', 20)} AS rs_sma20 FROM rs0)""", "rs0")
query("relative_strength", "ticker date:d rs_line:8 rs_sma20:8 rs_sma50:8 mrs:7",
      "SELECT * FROM rs", "rs")(lambda m: ind.relative_strength(m.bars, m.benchmark))

view("snap", """SELECT ticker, as_of, price, price / p2 - 1 AS daily_change_pct, price / p6 - 1 AS five_day_change_pct,
 price / p21 - 1 AS twenty_day_change_pct, CASE WHEN n_rows >= 21 THEN v / nullif(v20, 0) END AS volume_ratio FROM (
 SELECT ticker, max(date) AS as_of, max(n_rows) AS n_rows, max(CASE WHEN rn = 1 THEN close END) AS price, max(CASE WHEN rn = 2 THEN close END) AS p2,
 max(CASE WHEN rn = 6 THEN close END) AS p6, max(CASE WHEN rn = 21 THEN close END) AS p21, max(CASE WHEN rn = 1 THEN volume END) AS v,
 avg(CASE WHEN rn <= 20 THEN volume END) AS v20 FROM bx GROUP BY ticker)""", "bx")
query("snapshot_row",
      "ticker as_of:d price:4 daily_change_pct:8 five_day_change_pct:8 twenty_day_change_pct:8 volume_ratio:7 revenue_growth:6 forward_pe:6 error",
      "SELECT f.*, s.* EXCLUDE (ticker), CASE WHEN price IS NULL THEN 'No price data returned' END AS error FROM fund f LEFT JOIN snap s USING (ticker)",
      "fund snap")(lambda m: ind.snapshot(m.bars, m.fundamentals))

view("rvx", f"""SELECT *, volume / nullif(vol_avg, 0) AS rv, coalesce(volume / nullif(vol_avg, 0) >= 2, false) AS volume_spike FROM
 (SELECT *, {roll('avg', 'volume', 20)} AS vol_avg FROM bx)""", "bx")
query("relative_volume", "ticker date:d vol_avg:6 rv:8 volume_spike", "SELECT * FROM rvx", "rvx")(lambda m: ind.relative_volume(m.bars))

query("high_low_52w", "ticker date:d high_52w:4 low_52w:4",
      f"SELECT ticker, date, max(close) OVER {W(252)} AS high_52w, min(close) OVER {W(252)} AS low_52w FROM bars", "bars")(
    lambda m: ind.high_low_52w(m.bars))

for name, label, step in (
    ("weekly", "CAST(date AS DATE) + CAST((7 - isodow(date)) AS INTEGER)", "INTERVAL 7 DAY"),
    ("monthly", "last_day(date)", "INTERVAL 1 MONTH"),
):
    lo = "min(label)" if name == "weekly" else "date_trunc('month', min(label))"
    wrap = "CAST(g AS DATE)" if name == "weekly" else "last_day(CAST(g AS DATE))"
    view(f"{name}0", f"""SELECT ticker, {label} AS label, arg_min(open, date) AS open, max(high) AS high, min(low) AS low,
 arg_max(close, date) AS close, sum(volume) AS volume FROM bars GROUP BY 1, 2""", "bars")
    view(f"{name}1", f"""SELECT l.ticker, l.label, open, high, low, close, coalesce(volume, 0) AS volume,
 lag(close) OVER (PARTITION BY l.ticker ORDER BY l.label) AS prev FROM
 (SELECT ticker, {wrap} AS label FROM (SELECT ticker, unnest(generate_series(CAST({lo} AS TIMESTAMP), CAST(max(label) AS TIMESTAMP), {step})) AS g FROM {name}0 GROUP BY ticker)) l
 LEFT JOIN {name}0 w ON l.ticker = w.ticker AND l.label = w.label""", f"{name}0")
    view(name, f"""SELECT *, {rsi('up', 'down', 14, 'ticker', 'label')} AS rsi FROM (SELECT *,
 CASE WHEN close - prev > 0 THEN close - prev WHEN close IS NOT NULL AND prev IS NOT NULL THEN 0 END AS up,
 CASE WHEN close - prev < 0 THEN prev - close WHEN close IS NOT NULL AND prev IS NOT NULL THEN 0 END AS down FROM {name}1)""", f"{name}1")

query("resample_ohlcv", "rule ticker label:d open:4 high:4 low:4 close:4 volume:4 rsi:7",
      "SELECT 'W' AS rule, * FROM weekly UNION ALL SELECT 'ME' AS rule, * FROM monthly", "weekly monthly")(
    lambda m: ind.period_rsi(m.bars, "W").withColumn("rule", F.lit("W")).unionByName(
        ind.period_rsi(m.bars, "ME").withColumn("rule", F.lit("ME"))))

view("tra", f"SELECT *, {roll('avg', 'tr', 14)} AS atr, {roll('avg', 'close', 20)} AS sma20 FROM tr", "tr")
query("dist_atr", "ticker date:d atr:8 dist_sma20:7",
      "SELECT ticker, date, atr, (close - sma20) / nullif(atr, 0) AS dist_sma20 FROM tra", "tra")(lambda m: ind.dist_atr(m.bars))

view("rvol", f"SELECT *, {roll('stddev_samp', 'r', 21)} * sqrt(252) AS realized_vol FROM rets", "rets")
query("realized_vol", "ticker date:d realized_vol:8", "SELECT * FROM rvol", "rvol")(
    lambda m: ind.realized_vol(ind.daily_returns(m.bars)))

view("vreg", """SELECT *, CASE WHEN observations < 20 THEN 'Unknown' WHEN percentile >= 0.8 THEN 'High volatility'
 WHEN percentile <= 0.2 THEN 'Low volatility' ELSE 'Normal volatility' END AS regime FROM (
 SELECT ticker, count(*) AS observations, max(latest) AS latest_vol, avg(CASE WHEN realized_vol <= latest THEN 1e0 ELSE 0e0 END) AS percentile
 FROM (SELECT *, arg_max(realized_vol, date) OVER (PARTITION BY ticker) AS latest FROM rvol WHERE realized_vol IS NOT NULL) GROUP BY ticker)""", "rvol")
query("vol_regime", "ticker observations:i latest_vol:8 percentile:8 regime", "SELECT * FROM vreg", "vreg")(
    lambda m: ind.vol_regime(ind.daily_returns(m.bars)))

view("sr", """SELECT *, CASE WHEN close - support > 0 THEN round((resistance - close) / (close - support), 2) ELSE 0 END AS risk_reward FROM (
 SELECT ticker, max(CASE WHEN rn = 1 THEN close END) AS close, min(close) AS support, max(close) AS resistance FROM bx WHERE rn <= 63 GROUP BY ticker)""", "bx")
query("support_resistance", "ticker close:4 support:4 resistance:4 risk_reward:2", "SELECT * FROM sr", "sr")(
    lambda m: ind.support_resistance(m.bars))

view("ddx", """SELECT *, equity / peak - 1 AS drawdown FROM (SELECT *, max(equity) OVER (PARTITION BY ticker ORDER BY date) AS peak FROM
 (SELECT *, exp(sum(ln(1 + r)) OVER (PARTITION BY ticker ORDER BY date)) AS equity FROM rets))""", "rets")
query("drawdown", "ticker date:d equity:8 peak:8 drawdown:8", "SELECT * FROM ddx", "ddx")(
    lambda m: ind.drawdown(ind.daily_returns(m.bars)))


def islands(src, key):
    return f"""SELECT {key}, max(length) AS recovery_time FROM (SELECT {key}, island, sum(CASE WHEN dd < 0 THEN 1 ELSE 0 END) AS length FROM
 (SELECT *, sum(CASE WHEN dd < 0 THEN 0 ELSE 1 END) OVER (PARTITION BY {key} ORDER BY date) AS island FROM
  (SELECT {key}, date, round(drawdown, 12) AS dd FROM {src})) GROUP BY {key}, island) GROUP BY {key}"""


query("recovery_time", "ticker recovery_time:i", islands("ddx", "ticker"), "ddx")(
    lambda m: ind.recovery_time(
        ind.drawdown(ind.daily_returns(m.bars)).withColumn("drawdown", F.round("drawdown", 12))))

view("acx", """SELECT *, CASE WHEN autocorrelation_1d > 0.05 THEN 'Momentum continuing' WHEN autocorrelation_1d < -0.05 THEN 'Mean reversion likely'
  ELSE 'No clear short-term edge' END AS momentum_state, CASE WHEN expected_volatility > current_volatility * 1.15 THEN 'Increasing'
  WHEN expected_volatility < current_volatility * 0.85 THEN 'Decreasing' ELSE 'Stable' END AS risk_direction FROM (
 SELECT portfolio_id, corr(r, prev) AS autocorrelation_1d, stddev_samp(CASE WHEN rn <= 21 THEN r END) * sqrt(252) AS current_volatility,
  stddev_samp(CASE WHEN rn <= 63 THEN r END) * sqrt(252) AS expected_volatility FROM
 (SELECT *, lag(r) OVER w AS prev, count(*) OVER (PARTITION BY portfolio_id) - row_number() OVER w + 1 AS rn FROM pfr
  WINDOW w AS (PARTITION BY portfolio_id ORDER BY date)) GROUP BY portfolio_id)""", "pfr")
query("autocorr", "portfolio_id autocorrelation_1d:7 current_volatility:8 expected_volatility:8 momentum_state risk_direction",
      "SELECT * FROM acx", "acx")(lambda m: ind.autocorr(pf.portfolio_returns(pf.price_matrix(m.bars), pf.weights(m.positions, m.bars)), ("portfolio_id",)))

view("rx", """SELECT ticker, date, r, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY ticker) AS n_rows,
 count(*) OVER (PARTITION BY ticker) - row_number() OVER (PARTITION BY ticker ORDER BY date) + 1 AS rn FROM rets""", "rets")
EW = "sqrt(sum(pow(0.94e0, n_rows - 1 - i) * (CASE WHEN i = 0 THEN 1e0 ELSE 0.06e0 END) * r * r))"
query("ewma_vol", "ticker observations:i ewma_daily:8", f"SELECT ticker, count(*) AS observations, {EW} AS ewma_daily FROM rx GROUP BY ticker", "rx")(
    lambda m: ind.ewma_vol(ind.daily_returns(m.bars)))

view("vfc", f"""SELECT *, CASE WHEN observations >= 60 THEN ewma_daily * sqrt(252) END AS annualized,
 CASE WHEN observations >= 60 THEN ewma_daily * sqrt(30) END AS horizon_vol, CASE WHEN observations < 60 THEN 'Insufficient Data'
 WHEN ewma_daily > realized_daily * 1.15 THEN 'Elevated' WHEN ewma_daily < realized_daily * 0.85 THEN 'Lower' ELSE 'Normal' END AS expected FROM (
 SELECT ticker, count(*) AS observations, {EW} AS ewma_daily, stddev_samp(CASE WHEN rn <= 20 THEN r END) AS realized_daily FROM rx GROUP BY ticker)""", "rx")
query("vol_forecast", "ticker observations:i ewma_daily:8 realized_daily:8 annualized:8 horizon_vol:8 expected", "SELECT * FROM vfc", "vfc")(
    lambda m: ind.vol_forecast(ind.daily_returns(m.bars)))

query("vol_forecast_eval", "ticker sample_size:i mae:8 baseline_mae:8 ewma_beats_baseline",
      """SELECT ticker, count(*) AS sample_size, avg(abs(ewma - actual)) AS mae, avg(abs(baseline - actual)) AS baseline_mae,
  avg(abs(ewma - actual)) <= avg(abs(baseline - actual)) AS ewma_beats_baseline FROM (
 SELECT t.ticker, t.cut, sqrt(sum(CASE WHEN i < cut THEN pow(0.94e0, cut - 1 - i) * (CASE WHEN i = 0 THEN 1e0 ELSE 0.06e0 END) * r * r END)) AS ewma,
  stddev_samp(CASE WHEN i < cut AND i >= cut - 20 THEN r END) AS baseline, stddev_samp(CASE WHEN i >= cut AND i < cut + 20 THEN r END) AS actual
 FROM rx JOIN (SELECT ticker, i AS cut FROM rx WHERE i >= 60 AND (i - 60) % 20 = 0 AND i < n_rows - 20 AND n_rows >= 80) t ON rx.ticker = t.ticker AND rx.i < t.cut + 20
 GROUP BY t.ticker, t.cut) GROUP BY ticker""", "rx")(lambda m: ind.vol_forecast_eval(ind.daily_returns(m.bars)))

query("regime_features", "ticker date:d return_21d:8 volatility_21d:8 trend_50d:8 drawdown:8",
      f"""SELECT * FROM (SELECT ticker, date, close / lag(close, 21) OVER {T} - 1 AS return_21d, {roll('stddev_samp', 'r', 21)} * sqrt(252) AS volatility_21d,
  close / ({roll('avg', 'close', 50)}) - 1 AS trend_50d, close / ({roll('max', 'close', 252, 60)}) - 1 AS drawdown FROM bx)
 WHERE return_21d IS NOT NULL AND volatility_21d IS NOT NULL AND trend_50d IS NOT NULL AND drawdown IS NOT NULL""", "bx")(
    lambda m: ind.regime_features(m.bars))
