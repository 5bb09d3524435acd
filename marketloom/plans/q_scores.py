"""Queries: regime, scores, evidence, nested rows."""

from pyspark.sql import functions as F

from marketloom.functions.rolling import with_position
from marketloom.operators import backtest, cleaning, events, evidence, pairs, regime, risk, scores
from marketloom.operators import indicators as ind
from marketloom.plans import q_events, q_signals, q_sources  # noqa: F401  (views)
from marketloom.plans.q_events import latest_benchmark, table
from marketloom.plans.q_portfolio import sector_pairs
from marketloom.plans.registry import query, view

# --- regime ------------------------------------------------------------------------------
# the market benchmark and two regions stand for the indices, regions for sectors
INDEX_NAMES = (("AFRICA", "nasdaq"), ("AMERICA", "dow"))
SECTOR_NAMES = (("AFRICA", "Technology"), ("AMERICA", "Financials"), ("ASIA", "Utilities"), ("EUROPE", "Healthcare"), ("MIDDLE EAST", "Energy"))


def renamed(m, names):
    table = F.create_map(*[F.lit(x) for pair in names for x in pair])
    return m.sector_proxy.withColumn("name", F.try_element_at(table, F.col("sector"))).filter(F.col("name").isNotNull()).select("name", "date", "close")


def indices(m):
    return m.benchmark.select(F.lit("sp500").alias("name"), "date", "close").unionByName(renamed(m, INDEX_NAMES))


def case(names, col):
    return "CASE " + col + " " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in names) + " END"


view("idx", f"SELECT 'sp500' AS name, date, close FROM bench UNION ALL SELECT {case(INDEX_NAMES, 'sector')} AS name, date, close FROM sect WHERE sector IN ('AFRICA', 'AMERICA')", "bench", "sect")
view("idt", """SELECT *, round((above_sma20::INT + above_sma50::INT + above_sma200::INT) / 3e0 * 100, 2) AS trend_score FROM (SELECT name, c1 AS latest, coalesce(c1 > s20, false) AS above_sma20, coalesce(c1 > s50, false) AS above_sma50, coalesce(c1 > s200, false) AS above_sma200, coalesce(c1 / c22 - 1, 0) AS one_month_return, coalesce(c1 / c64 - 1, 0) AS three_month_return, v AS volatility FROM (
 SELECT name, max(CASE WHEN rn = 1 THEN close END) AS c1, max(CASE WHEN rn = 22 THEN close END) AS c22, max(CASE WHEN rn = 64 THEN close END) AS c64, avg(CASE WHEN rn <= 20 THEN close END) AS s20, avg(CASE WHEN rn <= 50 THEN close END) AS s50, CASE WHEN max(n) >= 200 THEN avg(CASE WHEN rn <= 200 THEN close END) END AS s200, stddev_samp(CASE WHEN rn <= 21 THEN r END) * sqrt(252) AS v FROM (
 SELECT *, close / lag(close) OVER (PARTITION BY name ORDER BY date) - 1 AS r, row_number() OVER (PARTITION BY name ORDER BY date DESC) AS rn, count(*) OVER (PARTITION BY name) AS n FROM idx) GROUP BY 1))""", "idx")
query("index_trend", "name latest:6 above_sma20 above_sma50 above_sma200 trend_score:2 one_month_return:8 three_month_return:8 volatility:8", "SELECT * FROM idt", "idt")(lambda m: regime.index_trend(indices(m)))


def vix(m):
    """Realised 21-row volatility of the benchmark in percent."""
    r = ind.daily_returns(m.benchmark.withColumn("ticker", F.lit("market")))
    return ind.realized_vol(r).select("date", (F.col("realized_vol") * 100).alias("close")).filter(F.col("close").isNotNull())


view("heur", f"""SELECT *, CASE WHEN environment = 'Risk-off' THEN 'Risk-off' WHEN health_score >= 75 AND a50 AND a200 THEN 'Bull market' WHEN health_score <= 30 AND NOT a200 THEN 'Bear market' WHEN a200 AND NOT a50 THEN 'Correction' WHEN NOT a200 AND mr > 0 THEN 'Recovery' WHEN health_score BETWEEN 40 AND 60 THEN 'Sideways' WHEN environment = 'High-risk' THEN 'High-risk' ELSE 'Neutral' END AS regime,
 CASE WHEN health_score >= 65 AND environment <> 'Risk-off' THEN 'Favorable' WHEN health_score >= 45 THEN 'Selective' ELSE 'Dangerous' END AS buy_environment FROM (SELECT *, CASE WHEN vix_regime IN ('Stress', 'Elevated') AND NOT a50 THEN 'Risk-off' WHEN risk_label = 'Risk-on' AND a50 AND a200 THEN 'Risk-on' WHEN NOT a200 THEN 'High-risk' ELSE 'Neutral' END AS environment FROM (
 SELECT *, round(trend * 0.5e0 + round(breadth, 2) * 0.25e0 + round(part, 2) * 0.25e0, 2) AS health_score, CASE WHEN spread > 5 THEN 'Risk-on' WHEN spread < -5 THEN 'Risk-off' ELSE 'Neutral' END AS risk_label, CASE WHEN vl >= 30 THEN 'Stress' WHEN vl >= 22 THEN 'Elevated' WHEN vl <= 15 THEN 'Calm' ELSE 'Normal' END AS vix_regime FROM
 (SELECT avg(trend_score) AS trend, avg(CASE WHEN one_month_return > 0 THEN 1e0 ELSE 0e0 END) * 100 AS breadth, bool_or(above_sma50) FILTER (name = 'sp500') AS a50, bool_or(above_sma200) FILTER (name = 'sp500') AS a200, max(one_month_return) FILTER (name = 'sp500') AS mr FROM idt),
 (SELECT avg(CASE WHEN above_sma50 THEN 1e0 ELSE 0e0 END) * 100 AS part, avg(round(momentum_score, 2)) FILTER (nm IN ('Technology', 'Financials')) - avg(round(momentum_score, 2)) FILTER (nm IN ('Utilities', 'Healthcare')) AS spread FROM (SELECT *, {case(SECTOR_NAMES, 'sector')} AS nm FROM smom)),
 (SELECT stddev_samp(r) * sqrt(252) * 100 AS vl FROM benchx WHERE rn <= 21)))""", "idt", "smom", "benchx")
query("regime_heuristic", "health_score:2 risk_on_spread:6 risk_label vix_level:6 vix_regime risk_environment regime buy_environment", "SELECT *, spread AS risk_on_spread, vl AS vix_level, environment AS risk_environment FROM heur", "heur")(
    lambda m: regime.regime_heuristic(indices(m), renamed(m, SECTOR_NAMES), vix(m)))
query("regime_sma", "name close:6 sma:7 regime", "SELECT name, c AS close, s AS sma, CASE WHEN n < 200 THEN 'Unknown (Incomplete Data)' WHEN c > s THEN 'Bullish (Above SMA200)' ELSE 'Bearish (Below SMA200)' END AS regime FROM (SELECT name, count(*) AS n, arg_max(close, date) AS c, avg(CASE WHEN rn <= 200 THEN close END) AS s FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY date DESC) AS rn FROM idx) GROUP BY 1)", "idx")(
    lambda m: regime.regime_sma(indices(m)))


# named state per (ticker, day): the centre rules applied to the row itself
view("rfeat", """SELECT ticker, date, return_21d, volatility_21d, trend_50d, dd, median(volatility_21d) OVER () AS vm FROM (SELECT ticker, date, close / lag(close, 21) OVER w - 1 AS return_21d, CASE WHEN count(r) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) >= 21 THEN stddev_samp(r) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) * sqrt(252) END AS volatility_21d,
 close / CASE WHEN i >= 49 THEN avg(close) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) END - 1 AS trend_50d, close / CASE WHEN i >= 59 THEN max(close) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) END - 1 AS dd FROM bx WINDOW w AS (PARTITION BY ticker ORDER BY date))
 WHERE return_21d IS NOT NULL AND volatility_21d IS NOT NULL AND trend_50d IS NOT NULL AND dd IS NOT NULL""", "bx")
_Z = ("return_21d", "volatility_21d", "trend_50d", "dd")
view("rz", "SELECT ticker, date, k, " + ", ".join(f"a{i}, s{i}, (x{i} - a{i}) / s{i} AS z{i}" for i in range(4)) + ", CAST(floor(rk * k / n) AS BIGINT) AS state FROM (SELECT ticker, date, count(*) OVER t AS n, least(6, greatest(2, CAST(floor(count(*) OVER t / 60) AS BIGINT))) AS k, row_number() OVER (PARTITION BY ticker ORDER BY volatility_21d, date) - 1 AS rk, "
     + ", ".join(f"{c} AS x{i}, avg({c}) OVER t AS a{i}, coalesce(nullif(stddev_pop({c}) OVER t, 0), 1) AS s{i}" for i, c in enumerate(_Z)) + " FROM rfeat WINDOW t AS (PARTITION BY ticker) QUALIFY n >= 120)", "rfeat")
_MEANS = ", ".join(f"avg(z{i}) AS m{i}" for i in range(4))
view("rk0", f"SELECT ticker, state, {_MEANS} FROM rz GROUP BY 1, 2", "rz")
for _r in range(11):
    view(f"rl{_r}", f"SELECT * FROM (SELECT x.* EXCLUDE (state), c.state, {' + '.join(f'(z{i} - m{i}) * (z{i} - m{i})' for i in range(4))} AS d FROM rz x JOIN rk{_r} c USING (ticker)) QUALIFY row_number() OVER (PARTITION BY ticker, date ORDER BY d, state) = 1", "rz", f"rk{_r}")
    view(f"rk{_r + 1}", f"SELECT o.ticker, o.state, {', '.join(f'coalesce(f.m{i}, o.m{i}) AS m{i}' for i in range(4))} FROM rk{_r} o LEFT JOIN (SELECT ticker, state, {_MEANS} FROM rl{_r} GROUP BY 1, 2) f USING (ticker, state)", f"rk{_r}", f"rl{_r}")
query("regime_cluster", "ticker state_name is_current probability_pct:2 days:i confidence:1", """
 SELECT ticker, state_name, bool_or(state = now) AS is_current, round(sum(p) * 100, 2) AS probability_pct, coalesce(sum(days), 0) AS days, round(max(100 / (1 + sqrt(last_d))), 1) AS confidence FROM (
 SELECT n.*, l.now, last_d, y.days, (coalesce(moves, 0) + 0.5e0) / sum(coalesce(moves, 0) + 0.5e0) OVER (PARTITION BY ticker) AS p FROM (
  SELECT ticker, state, CASE WHEN c3 <= -0.20 AND c0 <= -0.08 THEN 'Crash' WHEN c1 >= median(c1) OVER (PARTITION BY ticker) * 1.35e0 THEN 'High Volatility' WHEN c2 < -0.03 AND c0 < 0 THEN 'Bear Trend' WHEN c3 < -0.05 AND c0 > 0.03 THEN 'Recovery' WHEN c2 > 0.02 AND c0 > 0 THEN 'Bull Trend' ELSE 'Sideways' END AS state_name
  FROM (SELECT k.ticker, k.state, """ + ", ".join(f"m{i} * s{i} + a{i} AS c{i}" for i in range(4)) + """ FROM rk10 k JOIN (SELECT DISTINCT ON (ticker) * EXCLUDE (state) FROM rz) USING (ticker))) n
 JOIN (SELECT ticker, arg_max(state, date) AS now, arg_max(d, date) AS last_d FROM rl10 GROUP BY 1) l USING (ticker)
 LEFT JOIN (SELECT ticker, state, count(*) AS days FROM rl10 GROUP BY 1, 2) y USING (ticker, state)
 LEFT JOIN (SELECT ticker, state AS now, nx AS state, count(*) AS moves FROM (SELECT ticker, state, lead(state) OVER (PARTITION BY ticker ORDER BY date) AS nx FROM rl10) WHERE nx IS NOT NULL GROUP BY ALL) v USING (ticker, now, state)) GROUP BY ticker, state_name""", "rz rk10 rl10")(
    lambda m: regime.regime_cluster(ind.regime_features(m.bars)))
POSTURE = " ".join(f"WHEN '{n}' THEN '{p}'" for n, p, _, _ in regime.STRATEGIES)
PREF = " ".join(f"WHEN '{n}' THEN '{'|'.join(g)}'" for n, _, g, _ in regime.STRATEGIES)
AVOID = " ".join(f"WHEN '{n}' THEN '{'|'.join(b)}'" for n, _, _, b in regime.STRATEGIES)
query("regime_strategy", "ticker date:d state risk_posture preferred avoid",
      f"""SELECT *, CASE state {POSTURE} ELSE 'Neutral' END AS risk_posture, CASE state {PREF} ELSE 'diversification' END AS preferred, CASE state {AVOID} ELSE 'concentrated bets' END AS avoid FROM (SELECT ticker, date, CASE WHEN dd <= -0.2 AND return_21d <= -0.08 THEN 'Crash' WHEN volatility_21d >= 0.6 * 1.35e0 THEN 'High Volatility' WHEN trend_50d < -0.03 AND return_21d < 0 THEN 'Bear Trend'
 WHEN dd < -0.05 AND return_21d > 0.03 THEN 'Recovery' WHEN trend_50d > 0.02 AND return_21d > 0 THEN 'Bull Trend' ELSE 'Unclear' END AS state FROM rfeat)""", "rfeat")(
    lambda m: _strategy(m))


def _strategy(m):
    s = regime.state_name(0.6)
    rows = ind.regime_features(m.bars).withColumn("state", F.when(s == "Sideways", "Unclear").otherwise(s))
    out = regime.strategy_for_regime(rows, "state")
    return out.withColumn("preferred", F.array_join("preferred", "|")).withColumn("avoid", F.array_join("avoid", "|"))


# --- ratings and scores ------------------------------------------------------------------
def latest(m):
    return scores.latest_rows(table(m))


view("l1", "SELECT * FROM ind WHERE rn = 1", "ind")
view("rat", """SELECT *, CASE WHEN rating_score >= 80 THEN 'Tier 1: Market Leader' WHEN rating_score >= 60 THEN 'Tier 2: Improving' WHEN rating_score >= 40 THEN 'Tier 3: Neutral' WHEN rating_score >= 20 THEN 'Tier 4: Lagging' ELSE 'Tier 5: Avoid' END AS rating FROM (
 SELECT *, greatest(0, CASE WHEN stage_2 THEN 30 WHEN close > sma200 THEN 15 WHEN close > sma50 THEN 5 ELSE 0 END + CASE WHEN rsi_monthly > 50 THEN 10 ELSE 0 END + CASE WHEN rsi_weekly > 50 THEN 10 ELSE 0 END + CASE WHEN coalesce(rv, 1) >= 2 THEN 20 WHEN coalesce(rv, 1) >= 1.5 THEN 10 ELSE 0 END
 + CASE WHEN mrs > 0 THEN 20 + CASE WHEN rs_breakout THEN 10 ELSE 0 END WHEN rs_line > rs_sma20 THEN 5 ELSE 0 END - CASE WHEN is_extended THEN 25 ELSE 0 END) AS rating_score FROM (SELECT *, coalesce(close > sma50 AND sma50 > sma200, false) AS stage_2, coalesce(dist_sma20 > 3, false) AS is_extended FROM l1))""", "l1")
query("rating_tier", "ticker rating_score:2 rating stage_2 is_extended dist_high_pct:6 dist_low_pct:6", "SELECT *, (high_52w - close) / high_52w * 100 AS dist_high_pct, (close - low_52w) / low_52w * 100 AS dist_low_pct FROM rat", "rat")(lambda m: scores.rating_tier(latest(m)))
query("leader_score", "ticker leader_score:2",
      """SELECT ticker, CASE WHEN sma200 IS NULL OR rsi_weekly IS NULL OR mrs IS NULL THEN 0 ELSE greatest(0, least(100, CASE WHEN close > sma50 AND sma50 > sma200 THEN 40 WHEN close > sma200 THEN 20 ELSE 0 END + CASE WHEN mrs > 0 THEN 20 ELSE 0 END + CASE WHEN rs_line > rs_sma20 THEN 10 ELSE 0 END + CASE WHEN rsi_weekly > 50 THEN 10 ELSE 0 END
 + CASE WHEN rsi_monthly > 50 THEN 10 ELSE 0 END + CASE WHEN rv > 1.5 THEN 10 ELSE 0 END - CASE WHEN dist_sma20 > 3 THEN 20 ELSE 0 END)) END AS leader_score FROM l1""", "l1")(lambda m: scores.leader_score(latest(m)))

view("tsc", """SELECT l1.ticker, l1.sector, least(100, CASE WHEN l1.close > sma20 THEN 8 ELSE 0 END + CASE WHEN l1.close > sma50 THEN 10 ELSE 0 END + CASE WHEN l1.close > sma200 THEN 12 ELSE 0 END + CASE WHEN sma20 > sma50 AND sma50 > sma200 THEN 15 ELSE 0 END + CASE WHEN ema20 > ema50 THEN 10 ELSE 0 END + CASE WHEN rsi BETWEEN 50 AND 70 THEN 15 WHEN (rsi >= 40 AND rsi < 50) OR (rsi > 70 AND rsi <= 80) THEN 8 ELSE 0 END
 + CASE WHEN macd > macd_signal THEN 10 ELSE 0 END + CASE WHEN dist_sma20 <= 3 THEN 10 ELSE 0 END + CASE WHEN risk_reward >= 2 THEN 10 ELSE 0 END) AS technical_score, concat_ws('|', CASE WHEN l1.close > sma20 THEN 'Price above SMA20' END, CASE WHEN l1.close > sma50 THEN 'Price above SMA50' END, CASE WHEN l1.close > sma200 THEN 'Price above SMA200' END,
 CASE WHEN sma20 > sma50 AND sma50 > sma200 THEN 'SMA alignment is constructive' END, CASE WHEN ema20 > ema50 THEN 'EMA trend is positive' END, CASE WHEN rsi BETWEEN 50 AND 70 THEN 'RSI confirms momentum without extreme extension' END, CASE WHEN macd > macd_signal THEN 'MACD is above signal' END, CASE WHEN dist_sma20 <= 3 THEN 'Stock is not materially extended from SMA20' END,
 CASE WHEN dist_sma20 > 3 THEN 'Stock is extended from SMA20' END, CASE WHEN risk_reward >= 2 THEN 'Support/resistance profile offers positive risk/reward' END) AS technical_evidence FROM l1 JOIN sr USING (ticker)""", "l1", "sr")
query("tech_score", "ticker technical_score:2 technical_evidence", "SELECT * FROM tsc", "tsc")(
    lambda m: scores.technical_score(latest(m), ind.support_resistance(m.bars)).withColumn("technical_evidence", F.array_join("technical_evidence", "|")))

view("msc", """SELECT ticker, acc AS acceleration, least(100, CASE WHEN r21 > 0 THEN 10 ELSE 0 END + CASE WHEN r63 > 0 THEN 15 ELSE 0 END + CASE WHEN r126 > 0 THEN 15 ELSE 0 END + CASE WHEN r252 > 0 THEN 20 ELSE 0 END + CASE WHEN acc > 0 THEN 10 ELSE 0 END + CASE WHEN r63 > b THEN 15 ELSE 0 END + CASE WHEN r63 > s THEN 15 ELSE 0 END) AS momentum_score,
 concat_ws('|', CASE WHEN r21 > 0 THEN '1m return is positive' END, CASE WHEN r63 > 0 THEN '3m return is positive' END, CASE WHEN r126 > 0 THEN '6m return is positive' END, CASE WHEN r252 > 0 THEN '12m return is positive' END, CASE WHEN acc > 0 THEN 'Momentum is accelerating' END, CASE WHEN r63 > b THEN 'Outperforming S&P 500 over 3 months' END, CASE WHEN r63 > s THEN 'Outperforming sector ETF over 3 months' END) AS momentum_evidence FROM (
 SELECT *, coalesce(r63, 0) - coalesce(r126, 0) / 2 AS acc FROM (SELECT ticker, any_value(sector) AS sector, max(close) FILTER (rn = 1) / max(close) FILTER (rn = 22) - 1 AS r21, max(close) FILTER (rn = 1) / max(close) FILTER (rn = 64) - 1 AS r63, max(close) FILTER (rn = 1) / max(close) FILTER (rn = 127) - 1 AS r126, max(close) FILTER (rn = 1) / max(close) FILTER (rn = 253) - 1 AS r252 FROM bx GROUP BY 1)
 JOIN (SELECT sector, max(close) FILTER (rn = 1) / max(close) FILTER (rn = 64) - 1 AS s FROM sectx GROUP BY 1) USING (sector), (SELECT max(close) FILTER (rn = 1) / max(close) FILTER (rn = 64) - 1 AS b FROM benchx))""", "bx", "sectx", "benchx")
query("mom_score", "ticker momentum_score:2 acceleration:8 momentum_evidence", "SELECT * FROM msc", "msc")(
    lambda m: scores.momentum_score(m.bars, m.benchmark, m.sector_proxy).withColumn("momentum_evidence", F.array_join("momentum_evidence", "|")))

view("vsc", """SELECT *, CASE WHEN relative_volume >= 1.5 THEN 25 ELSE 0 END + CASE WHEN c > p AND relative_volume >= 1.25 THEN 25 ELSE 0 END + CASE WHEN accumulation_days > distribution_days THEN 25 ELSE 0 END + CASE WHEN c >= hi * 0.98e0 AND relative_volume >= 1.5 THEN 25 ELSE 0 END AS volume_score,
 concat_ws('|', CASE WHEN relative_volume >= 1.5 THEN 'Relative volume is elevated' END, CASE WHEN c > p AND relative_volume >= 1.25 THEN 'Price advanced on above-average volume' END, CASE WHEN accumulation_days > distribution_days THEN 'Accumulation days exceed distribution days' END, CASE WHEN c >= hi * 0.98e0 AND relative_volume >= 1.5 THEN 'High-volume breakout behavior' END) AS volume_evidence FROM (
 SELECT ticker, max(vol_avg) FILTER (rn = 1) AS average_volume, max(volume) FILTER (rn = 1) / max(vol_avg) FILTER (rn = 1) AS relative_volume, max(close) FILTER (rn = 1) AS c, max(prev) FILTER (rn = 1) AS p, count(*) FILTER (rn <= 20 AND close > prev AND volume > vol_avg) AS accumulation_days, count(*) FILTER (rn <= 20 AND close < prev AND volume > vol_avg) AS distribution_days, max(close) FILTER (rn <= 63) AS hi FROM rvx GROUP BY 1)""", "rvx")
query("vol_score", "ticker volume_score:2 average_volume:6 relative_volume:7 accumulation_days:i distribution_days:i volume_evidence", "SELECT * FROM vsc", "vsc")(
    lambda m: scores.volume_score(m.bars).withColumn("volume_evidence", F.array_join("volume_evidence", "|")))


def analysis(m):
    return risk.stock_analysis(m.bars, m.benchmark)


view("rsc", """SELECT sa.*, 100 - CASE WHEN annualized_volatility > 0.55 THEN 25 ELSE 0 END - CASE WHEN max_drawdown < -0.35 THEN 25 ELSE 0 END - CASE WHEN abs(beta) > 1.5 THEN 15 ELSE 0 END - CASE WHEN s21 > sall * 1.25 THEN 15 ELSE 0 END AS risk_score, concat_ws('|', CASE WHEN annualized_volatility > 0.55 THEN 'Volatility is elevated' END, CASE WHEN max_drawdown < -0.35 THEN 'Historical drawdown is severe' END,
 CASE WHEN abs(beta) > 1.5 THEN 'Beta indicates elevated market sensitivity' END, CASE WHEN s21 > sall * 1.25 THEN 'Short-term volatility is rising' END) AS risk_evidence FROM sa JOIN (SELECT ticker, stddev_samp(CASE WHEN rn <= 21 THEN r END) AS s21, stddev_samp(r) AS sall FROM rx GROUP BY 1) USING (ticker)""", "sa", "rx")
query("risk_score", "ticker risk_score:2 risk_evidence", "SELECT * FROM rsc", "rsc")(
    lambda m: scores.risk_score(analysis(m), ind.daily_returns(m.bars)).withColumn("risk_evidence", F.array_join("risk_evidence", "|")))
query("fund_score", "ticker fundamental_score:2 classification", "SELECT * FROM cf", "cf")(q_sources.fundamentals)

# news words per ticker feed the catalyst flags
BULL = ("beat", "raise", "growth", "upgrade", "record", "profit", "strong")
BEAR = ("miss", "cut", "downgrade", "probe", "lawsuit", "weak", "risk")


def words_sql(words):
    return " + ".join(f"CASE WHEN contains(lower(text), '{w}') THEN 1 ELSE 0 END" for w in words)


view("newsx", f"SELECT doc_id, n_name AS ticker, source, {words_sql(BULL)} AS bullish_score, {words_sql(BEAR)} AS bearish_score FROM documents JOIN nation ON doc_id % 25 = n_nationkey")
view("catx", """SELECT *, coalesce(last_surprise_pct > 2, false) OR coalesce(eps_growth > 0.1, false) OR coalesce(revenue_growth > 0.1, false) AS earnings_surprise, coalesce(recommendation = 'buy', false) OR (coalesce(target_mean_price, 0) > 0 AND forward_pe IS NOT NULL) AS analyst_revision, coalesce(insider_ownership >= 0.05, false) AS insider_buying, price_above_sma50 AND price_above_sma200 AS sector_strength, coalesce(top_importance >= 60, false) AS major_news, abs(coalesce(bull, 0) - coalesce(bear, 0)) >= 2 AS guidance_change FROM (
 SELECT t.ticker, t.price_above_sma50, t.price_above_sma200, f.eps_growth, f.revenue_growth, f.forward_pe, n.bull, n.bear, n.top_importance, CASE WHEN f.roe > 0.335 THEN 'buy' ELSE 'hold' END AS recommendation, CAST(NULL AS DOUBLE) AS target_mean_price, f.fcf_yield * 2 AS insider_ownership, f.eps_growth * 10 AS last_surprise_pct FROM tech t JOIN cf f USING (ticker) LEFT JOIN
 (SELECT ticker, sum(bullish_score) AS bull, sum(bearish_score) AS bear, max(least(100, 30 + 15 * (bullish_score + bearish_score))) AS top_importance FROM newsx GROUP BY 1) n USING (ticker))""", "tech", "cf", "newsx")
view("csc", """SELECT *, 20 * earnings_surprise::INT + 20 * analyst_revision::INT + 15 * insider_buying::INT + 20 * sector_strength::INT + 15 * major_news::INT + 10 * guidance_change::INT AS catalyst_score, concat_ws('|', CASE WHEN earnings_surprise THEN 'earnings surprise' END, CASE WHEN analyst_revision THEN 'analyst revision' END, CASE WHEN insider_buying THEN 'insider buying' END,
 CASE WHEN sector_strength THEN 'sector strength' END, CASE WHEN major_news THEN 'major news' END, CASE WHEN guidance_change THEN 'guidance change' END) AS catalyst_evidence FROM catx""", "catx")


def news_counts(m):
    from marketloom.operators.filings import news_tone
    tone = news_tone(m.news)
    return tone.groupBy("ticker").agg(F.sum("bullish_score").alias("bullish_news"), F.sum("bearish_score").alias("bearish_news"), F.max("importance_score").alias("top_importance"))


def catalysts(m):
    tech = events.technical_screen(table(m), ind.support_resistance(m.bars)).drop("sector")
    f = q_sources.fundamentals(m).drop("sector")
    rows = tech.join(f, "ticker").join(news_counts(m), "ticker", "left").withColumn("recommendation", F.when(F.col("roe") > 0.335, "buy").otherwise("hold")).withColumn("target_mean_price", F.lit(None).cast("double"))
    rows = rows.withColumn("insider_ownership", F.col("fcf_yield") * 2).withColumn("last_surprise_pct", F.col("eps_growth") * 10)
    return scores.catalyst_score(scores.catalyst_flags(rows))


query("catalyst_score", "ticker catalyst_score:2 earnings_surprise analyst_revision insider_buying sector_strength major_news guidance_change catalyst_evidence", "SELECT * FROM csc", "csc")(
    lambda m: catalysts(m).withColumn("catalyst_evidence", F.array_join("catalyst_evidence", "|")))

view("fin", """SELECT *, CASE WHEN risk_score < 35 THEN 'Avoid' WHEN final_score >= 80 THEN 'Buy Watch' WHEN final_score >= 65 THEN 'Watch' WHEN final_score >= 45 THEN 'Hold' WHEN final_score >= 30 THEN 'Drop' ELSE 'Avoid' END AS score_rating, CASE WHEN risk_score < 45 THEN 'High' WHEN risk_score < 70 THEN 'Moderate' ELSE 'Controlled' END AS risk_level,
 greatest(0, least(100, mean - sd * 0.25e0 - zeros * 5)) AS score_confidence FROM (SELECT *, list_avg(v) AS mean, list_stddev_pop(v) AS sd, len(list_filter(v, lambda x: x = 0)) AS zeros, v[1] * 0.25e0 + v[2] * 0.25e0 + v[3] * 0.15e0 + v[4] * 0.15e0 + v[5] * 0.15e0 + v[6] * 0.05e0 AS final_score FROM (
 SELECT t.ticker, t.sector, t.technical_score, m.momentum_score, v.volume_score, coalesce(f.fundamental_score, 0) AS fundamental_score, r.risk_score, c.catalyst_score, c.earnings_surprise, c.analyst_revision, c.major_news, f.revenue_growth, f.eps_growth, f.roe, f.forward_pe, f.available, f.price_to_book, f.gross_margin, v.relative_volume, r.quant_score, r.sharpe_ratio, r.max_drawdown, r.annualized_volatility,
 CAST([t.technical_score, m.momentum_score, v.volume_score, coalesce(f.fundamental_score, 0), r.risk_score, c.catalyst_score] AS DOUBLE[]) AS v, array_to_string(string_split(concat_ws('|', nullif(technical_evidence, ''), nullif(momentum_evidence, ''), nullif(volume_evidence, ''), nullif(catalyst_evidence, '')), '|'), '; ') AS ex FROM tsc t JOIN msc m USING (ticker) JOIN vsc v USING (ticker) JOIN rsc r USING (ticker) JOIN cf f USING (ticker) JOIN csc c USING (ticker)))""", "tsc", "msc", "vsc", "rsc", "cf", "csc")


def categories(m):
    """All six category scores with their evidence, one row per ticker."""
    tech = scores.technical_score(latest(m), ind.support_resistance(m.bars)).select("ticker", "sector", "technical_score", "technical_evidence")
    mom = scores.momentum_score(m.bars, m.benchmark, m.sector_proxy).select("ticker", "momentum_score", "momentum_evidence")
    vol = scores.volume_score(m.bars).select("ticker", "volume_score", "relative_volume", "volume_evidence")
    rk = scores.risk_score(analysis(m), ind.daily_returns(m.bars)).select("ticker", "risk_score", "quant_score", "sharpe_ratio", "max_drawdown", "annualized_volatility")
    cat = catalysts(m).select("ticker", "catalyst_score", "catalyst_evidence", "earnings_surprise", "analyst_revision", "major_news", "fundamental_score", "available", "revenue_growth", "eps_growth", "roe", "forward_pe", "gross_margin",
                              "price_to_book", "breakout", "price_above_sma50", "price_above_sma200", "rsi")
    out = tech
    for part in (mom, vol, rk, cat):
        out = out.join(part, "ticker")
    return scores.final_score(out.withColumn("fundamental_evidence", F.array().cast("array<string>")))


query("final_score", "ticker technical_score:2 momentum_score:2 volume_score:2 fundamental_score:2 risk_score:2 catalyst_score:2 final_score:6 score_confidence:6 score_rating risk_level explanation",
      "SELECT *, coalesce(nullif(ex, ''), 'No high-conviction evidence yet.') AS explanation FROM fin", "fin")(
    lambda m: categories(m).withColumn("fundamental_score", F.coalesce("fundamental_score", F.lit(0.0))))

view("rr0", """SELECT f.*, t.price_above_sma200, l.mrs > 0 AS lead, CASE WHEN f.score_confidence >= 5 THEN f.score_confidence END AS confidence FROM fin f JOIN tech t USING (ticker) JOIN l1 l USING (ticker)""", "fin", "tech", "l1")
view("rrow", """SELECT ticker, sector, CASE WHEN quant_score <> 0 THEN CAST(quant_score AS DOUBLE) ELSE 50 END AS overall_score, greatest(0, least(100, 55 + least(greatest((relative_volume - 1) * 20, -20), 25))) AS liquidity_score, greatest(0, 100 - CASE WHEN annualized_volatility <= 1 THEN annualized_volatility * 100 ELSE annualized_volatility END) AS research_risk_score, coalesce(confidence, 0) AS c0,
 concat_ws('|', CASE WHEN price_above_sma200 THEN 'Price is above the 200-day trend line.' END, CASE WHEN lead THEN 'Relative strength is leading the benchmark/watchlist.' END, CASE WHEN sharpe_ratio >= 1 THEN 'Risk-adjusted return is constructive.' END) AS top_positive_drivers,
 concat_ws('|', CASE WHEN NOT price_above_sma200 THEN 'Price is not above the 200-day trend line.' END, CASE WHEN NOT lead THEN 'Relative strength is lagging.' END, CASE WHEN sharpe_ratio < 1 THEN 'Sharpe ratio is below institutional quality.' END, CASE WHEN abs(max_drawdown) >= 0.35 THEN 'Historical drawdown has been severe.' END, CASE WHEN annualized_volatility >= 0.45 THEN 'Realized volatility is elevated.' END) AS top_negative_drivers,
 CASE WHEN confidence IS NULL THEN 'confidence' ELSE '' END AS missing_data FROM rr0""", "rr0")
query("research_rows", "ticker overall_score:2 liquidity_score:6 slippage_risk research_risk_score:6 signal_direction data_quality_score:6 uncertainty top_positive_drivers top_negative_drivers missing_data",
      """SELECT *, CASE WHEN liquidity_score < 45 THEN 'High' WHEN liquidity_score < 65 THEN 'Medium' ELSE 'Low' END AS slippage_risk, CASE WHEN overall_score >= 65 THEN 'Constructive' WHEN overall_score <= 40 THEN 'Defensive' ELSE 'Neutral' END AS signal_direction, least(100, c0 + 35) AS data_quality_score, CASE WHEN 100 - c0 >= 75 THEN 'High' WHEN 100 - c0 >= 50 THEN 'Medium' ELSE 'Low' END AS uncertainty FROM rrow""", "rrow")(
    lambda m: _research(m))


def research_input(m):
    lead = latest(m).select("ticker", F.when(F.col("mrs") > 0, "Leading").otherwise("Lagging").alias("rs_status"))
    return categories(m).join(lead, "ticker").withColumn("confidence", F.when(F.col("score_confidence") >= 5, F.col("score_confidence"))).withColumn("why_now", F.lit("No clear Why Now trigger"))


def _research(m):
    out = scores.research_rows(research_input(m))
    for c in ("top_positive_drivers", "top_negative_drivers", "missing_data"):
        out = out.withColumn(c, F.array_join(c, "|"))
    return out


def why_rows(m):
    return events.why_now(table(m), analysis(m).select("ticker", F.col("quant_score").alias("final_score"), (F.col("momentum_score") * 0.8).alias("previous_score")).join(ind.support_resistance(m.bars).select("ticker", "risk_reward"), "ticker"),
                          latest_benchmark(m)).select("ticker", "strength", "reason", "send_alert")


query("discover", "list rank:i ticker final_score:6",
      """SELECT 'match' AS list, row_number() OVER (ORDER BY final_score DESC, ticker) AS rank, ticker, final_score FROM (SELECT f.*, t.rsi, t.price_above_sma200 FROM fin f JOIN tech t USING (ticker)) WHERE final_score >= 45 AND forward_pe <= 25 AND price_to_book <= 5 AND screener_ok UNION ALL SELECT 'top', row_number() OVER (ORDER BY final_score DESC, ticker), ticker, final_score FROM fin QUALIFY row_number() OVER (ORDER BY final_score DESC, ticker) <= 20""".replace(" AND screener_ok", ""), "fin tech")(
    lambda m: _discover(m))


def _discover(m):
    rows = categories(m).withColumn("strength", F.lit(0))
    hits, top = scores.discover(cleaning.screen_stock(rows), rows, "value_watch")
    pick = lambda df, name: df.select(F.lit(name).alias("list"), "rank", "ticker", "final_score")
    return pick(hits, "match").unionByName(pick(top, "top"))


query("leaders_laggards", "side rank:i ticker score:2",
      """SELECT * FROM (SELECT 'leader' AS side, row_number() OVER (ORDER BY quant_score DESC, ticker) AS rank, ticker, quant_score AS score FROM sa UNION ALL SELECT 'laggard', row_number() OVER (ORDER BY quant_score, ticker), ticker, quant_score FROM sa) WHERE rank <= 3""", "sa")(
    lambda m: scores.leaders_laggards(analysis(m).select("ticker", F.col("quant_score").alias("score"))))

# --- probability and features ------------------------------------------------------------
SC = "CASE WHEN ({x}) IS NULL THEN 0 ELSE {a} + least(greatest((({x}) - {lo}) / ({hi} - {lo})::DOUBLE, 0), 1) * ({b} - ({a})) END"


def sc(x, lo, hi, a, b):
    return SC.format(x=x, lo=lo, hi=hi, a=a, b=b)


# a fifth of the tickers lacks all but scores and events, another fifth its fundamental, technical and risk fields
OF_SCORE = "final_score score_confidence score_rating risk_level".split()
OF_REST = "revenue_growth eps_growth roe forward_pe gross_margin price_to_book relative_volume breakout price_above_sma50 price_above_sma200 rsi quant_score sharpe_ratio max_drawdown annualized_volatility".split()
ALWAYS = "technical_score momentum_score volume_score fundamental_score risk_score catalyst_score earnings_surprise analyst_revision major_news".split()
LISTS = "technical_evidence momentum_evidence volume_evidence catalyst_evidence explanation".split()  # never null
FIFTH = "CAST(substr(ticker, 8) AS INT) % 5"
view("fq", f"""SELECT *, 5 + {' + '.join(f'CASE WHEN {c} IS NULL THEN 0 ELSE 1 END' for c in OF_SCORE + OF_REST + ALWAYS)} AS filled FROM (SELECT ticker, {', '.join(f'CASE WHEN {FIFTH} <> 1 THEN {c} END AS {c}' for c in OF_SCORE)}, {', '.join(f'CASE WHEN {FIFTH} NOT IN (1, 2) THEN {c} END AS {c}' for c in OF_REST)},
 technical_score, momentum_score, volume_score, CASE WHEN available THEN fundamental_score END AS fundamental_score, risk_score, catalyst_score, earnings_surprise, analyst_revision, major_news FROM (SELECT f.*, breakout, price_above_sma50, price_above_sma200, rsi FROM fin f JOIN tech t USING (ticker)))""", "fin", "tech")
query("outperf_prob", "ticker raw_points:6 probability:7 filled_fields:i probability_confidence evidence",
      f"""SELECT *, least(greatest(1 / (1 + exp(-(-0.15e0 + raw_points / 25))), 0.05), 0.95) AS probability, filled AS filled_fields, CASE WHEN filled >= 30 THEN 'High' WHEN filled >= 16 THEN 'Moderate' ELSE 'Low' END AS probability_confidence, CASE WHEN e = '' THEN 'Insufficient feature evidence; using baseline probability.' ELSE e END AS evidence FROM (SELECT f.ticker, filled, {sc('momentum_score', 50, 100, 0, 18)} + {sc('technical_score', 50, 100, 0, 14)} + {sc('fundamental_score', 50, 100, 0, 14)} + {sc('volume_score', 40, 100, 0, 10)} + {sc('risk_score', 40, 100, -10, 10)} + {sc('catalyst_score', 0, 100, 0, 10)}
 + CASE WHEN revenue_growth >= 0.2 THEN 6 ELSE 0 END + CASE WHEN eps_growth >= 0.15 THEN 5 ELSE 0 END + CASE WHEN relative_volume >= 1.5 THEN 5 ELSE 0 END + CASE WHEN breakout THEN 5 ELSE 0 END + CASE WHEN earnings_surprise THEN 5 ELSE 0 END + CASE WHEN analyst_revision THEN 4 ELSE 0 END - CASE WHEN h.environment = 'Risk-off' THEN 8 ELSE 0 END - CASE WHEN h.buy_environment = 'Dangerous' THEN 8 ELSE 0 END AS raw_points,
 concat_ws('|', CASE WHEN revenue_growth >= 0.2 THEN 'Revenue growth above 20%' END, CASE WHEN eps_growth >= 0.15 THEN 'EPS growth above 15%' END, CASE WHEN relative_volume >= 1.5 THEN 'Volume surge above 1.5x' END, CASE WHEN breakout THEN 'Breakout pressure detected' END, CASE WHEN earnings_surprise THEN 'Positive earnings surprise/catalyst' END, CASE WHEN analyst_revision THEN 'Analyst data is supportive' END,
 CASE WHEN h.environment = 'Risk-off' THEN 'Risk-off market regime lowers probability' END, CASE WHEN h.buy_environment = 'Dangerous' THEN 'Buy environment is dangerous' END, CASE WHEN final_score IS NOT NULL THEN printf('Composite score %.2f/100', CAST(final_score AS DOUBLE)) END) AS e FROM fq f, heur h)""", "fq heur")(
    lambda m: _outperf(m))


def _outperf(m):
    from marketloom.operators import signals
    market = regime.regime_heuristic(indices(m), renamed(m, SECTOR_NAMES), vix(m)).select("risk_environment", "buy_environment")
    rows = categories(m).withColumn("fundamental_score", F.when(F.col("available"), F.col("fundamental_score"))).crossJoin(F.broadcast(market))  # one row
    fifth = F.substring("ticker", 8, 9).cast("int") % 5
    hide = {c: F.when(fifth != 1, F.col(c)) for c in OF_SCORE} | {c: F.when(~fifth.isin(1, 2), F.col(c)) for c in OF_REST}
    return signals.outperformance(rows.withColumns(hide), OF_SCORE + OF_REST + ALWAYS + LISTS).withColumn("evidence", F.array_join("evidence", "|"))


query("feature_row", "ticker final_score:6 technical_score:2 momentum_score:2 volume_score:2 fundamental_score:2 risk_score:2 catalyst_score:2 revenue_growth:6 eps_growth:6 roe:6 forward_pe:6 relative_volume:7 breakout price_above_sma50 price_above_sma200 earnings_surprise analyst_revision major_news",
      "SELECT f.*, t.breakout, t.price_above_sma50, t.price_above_sma200 FROM fin f JOIN (SELECT ticker, breakout, price_above_sma50, price_above_sma200 FROM tech) t USING (ticker)", "fin tech")(lambda m: _features(m))


def _features(m):
    from marketloom.operators import signals
    c = categories(m).withColumn("fundamental_score", F.coalesce("fundamental_score", F.lit(0.0)))
    cats = F.struct(*[F.col(f"{k}_score").alias(k) for k in scores.COMPOSITE])
    nested = c.select("ticker", F.struct("final_score", cats.alias("categories")).alias("score"), F.struct("revenue_growth", "eps_growth", "roe", "forward_pe").alias("fundamentals"),
                      F.struct("relative_volume", "breakout", "price_above_sma50", "price_above_sma200").alias("technical"), F.struct("earnings_surprise", "analyst_revision", "major_news").alias("catalysts"))
    return signals.feature_row(nested)


# --- evidence ----------------------------------------------------------------------------
def ev_sql(src, snap):
    return f"""SELECT *, CASE WHEN price IS NULL THEN 'Not Enough Evidence' WHEN nn >= 3 THEN 'High Risk' WHEN trend = 'Improving' AND np >= 2 THEN 'Positive' WHEN trend = 'Weakening' THEN 'Cautious' WHEN np + nn > 0 THEN 'Worth Watching' ELSE 'Mixed' END AS overall_view,
 2 * (s1::INT + s2::INT) + 3 * (vol::INT + tr::INT) + CASE WHEN vol THEN 3 ELSE 0 END + CASE WHEN trend IN ('Improving', 'Weakening') THEN 2 ELSE 0 END - CASE WHEN confidence = 'Low' THEN 1 ELSE 0 END AS attention FROM (SELECT *, CASE WHEN price IS NULL THEN 'Insufficient Data' WHEN cats >= 3 AND unk <= 2 THEN 'High' WHEN cats >= 2 AND unk <= 4 THEN 'Medium' ELSE 'Low' END AS confidence,
 CASE WHEN imp THEN 'Improving' WHEN weak THEN 'Weakening' WHEN unk > 0 AND np = 0 AND nn = 0 THEN 'Unavailable' ELSE 'Stable' END AS trend FROM (SELECT *, (s1 OR s2)::INT + vol::INT + tr::INT AS cats, (p1 OR n1) AS sx, p1::INT + p2::INT + (vol AND d >= 0)::INT + imp::INT AS np, n1::INT + n2::INT + (vol AND d < 0)::INT + weak::INT AS nn FROM (
 SELECT s.*, daily_change_pct AS d, daily_change_pct >= 0.03 AS p1, daily_change_pct <= -0.03 AS n1, five_day_change_pct >= 0.04 AS p2, five_day_change_pct <= -0.04 AS n2, abs(daily_change_pct) >= 0.03 AS s1, abs(five_day_change_pct) >= 0.04 AS s2, volume_ratio >= 1.8 AS vol, price > m20 AND m20 > m50 AS imp, price < m20 AND m20 < m50 AS weak, (price > m20 AND m20 > m50) OR (price < m20 AND m20 < m50) AS tr,
 (revenue_growth IS NULL)::INT + (earnings_growth IS NULL)::INT + (net_margin IS NULL)::INT + (forward_pe IS NULL)::INT AS unk, CASE WHEN volume_ratio >= 1.8 THEN 'Unusual volume' ELSE 'Normal volume' END AS volume_status FROM {snap} s JOIN fund USING (ticker) JOIN (SELECT ticker, avg(close) FILTER (rn <= 20) AS m20, avg(close) FILTER (rn <= 50) AS m50 FROM {src} GROUP BY 1) USING (ticker))))"""


view("evi", ev_sql("bx", "snap"), "bx", "snap", "fund")
query("stock_evidence", "ticker trend volume_status confidence overall_view attention:i positives:i negatives:i unknown_count:i", "SELECT *, np AS positives, nn AS negatives, unk AS unknown_count FROM evi", "evi")(
    lambda m: evidence.stock_evidence(m.bars, m.fundamentals).withColumn("positives", F.size("positive_evidence")).withColumn("negatives", F.size("negative_evidence")).withColumn("unknown_count", F.size("unknowns")))
query("attention_rank", "rank:i ticker attention:i overall_view",
      "SELECT row_number() OVER (ORDER BY attention DESC, ticker) AS rank, ticker, attention, overall_view FROM evi WHERE confidence IN ('Medium', 'High') AND overall_view IN ('Positive', 'Worth Watching', 'Cautious') QUALIFY rank <= 5", "evi")(
    lambda m: evidence.opportunities(evidence.stock_evidence(m.bars, m.fundamentals)))

# labels five rows ago against today's
view("bx5", "SELECT * EXCLUDE (rn, n_rows), rn - 5 AS rn, n_rows - 5 AS n_rows FROM bx WHERE rn > 5", "bx")
view("snap5", """SELECT ticker, as_of, price, price / p2 - 1 AS daily_change_pct, price / p6 - 1 AS five_day_change_pct, price / p21 - 1 AS twenty_day_change_pct, v / nullif(v20, 0) AS volume_ratio FROM (SELECT ticker, max(date) AS as_of, max(close) FILTER (rn = 1) AS price, max(close) FILTER (rn = 2) AS p2, max(close) FILTER (rn = 6) AS p6, max(close) FILTER (rn = 21) AS p21, max(volume) FILTER (rn = 1) AS v, avg(volume) FILTER (rn <= 20) AS v20 FROM bx5 GROUP BY 1)""", "bx5")
view("evi5", ev_sql("bx5", "snap5"), "bx5", "snap5", "fund")
FIELDS = ("overall_view", "trend", "volume_status", "confidence")
query("field_changes", "ticker field from_label to_label",
      "SELECT ticker, CASE " + " ".join(f"WHEN a.{f} <> b.{f} THEN '{f}'" for f in FIELDS) + " END AS field, CASE " + " ".join(f"WHEN a.{f} <> b.{f} THEN b.{f}" for f in FIELDS) + " END AS from_label, CASE " + " ".join(f"WHEN a.{f} <> b.{f} THEN a.{f}" for f in FIELDS) + " END AS to_label FROM evi a JOIN evi5 b USING (ticker) WHERE "
      + " OR ".join(f"a.{f} <> b.{f}" for f in FIELDS), "evi evi5")(
    lambda m: events.field_changes(evidence.stock_evidence(m.bars, m.fundamentals), evidence.stock_evidence(with_position(m.bars).filter("rn > 5").drop("i", "n_rows", "rn"), m.fundamentals)))

query("confidence_level", "ticker confidence",
      """SELECT ticker, CASE WHEN s >= 70 THEN 'High' WHEN s >= 40 THEN 'Medium' WHEN s >= 15 THEN 'Low' ELSE 'Insufficient Data' END AS confidence FROM (SELECT e.ticker, 20 + CASE WHEN unk <= 1 THEN 10 ELSE 0 END + least(cats, 4) * 10 - nn * 10 + CASE WHEN trend = 'Improving' THEN 10 WHEN trend = 'Stable' THEN 4 ELSE 0 END + 10 - CASE WHEN c.earnings_near THEN 15 ELSE 0 END - (c.earnings_near::INT + c.large_move::INT) * 12 AS s FROM evi e JOIN conf c USING (ticker))""", "evi conf")(
    lambda m: _confidence(m))


def _confounders(m):
    return events.confounders(m.bars, q_events.next_reports(m), m.bars.agg(F.max("date").alias("as_of")))


def _confidence(m):
    e = evidence.stock_evidence(m.bars, m.fundamentals).join(_confounders(m).select("ticker", "earnings_near", "confounders"), "ticker")
    cats = F.size(F.array_distinct(F.transform(F.concat("positive_evidence", "negative_evidence"), lambda x: x["category"])))
    no = F.lit(False)
    agree = F.when(F.col("trend") == "Improving", "High").when(F.col("trend") == "Stable", "Medium").otherwise("Unknown")
    return e.select("ticker", evidence.confidence_level(F.col("price").isNotNull(), no, F.size("unknowns") <= 1, no, cats, F.size("negative_evidence"), agree, F.lit(252), F.col("earnings_near"), F.size("confounders"), no).alias("confidence"))


view("fconf", """SELECT ticker, max(CASE WHEN transaction_type = 'Open-market purchase' THEN 78 ELSE 0 END) AS fc FROM (SELECT n_name AS ticker, transaction_type FROM f4 JOIN nation ON f4.ticker = 'N' || n_nationkey WHERE filing_date >= (SELECT max(filing_date) FROM f4) - 30) GROUP BY 1""", "f4")
view("wh0", """SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS pc, quantile_cont(CASE WHEN rn <= 60 THEN volume END, 0.5) OVER (PARTITION BY ticker) AS base, count(*) OVER (PARTITION BY ticker) AS valid FROM bx WHERE rn <= 80""", "bx")
view("wh1", """SELECT ticker, max(base) AS base, max(volume) FILTER (rn = 1) AS v, quantile_cont(abs(volume - base), 0.5) FILTER (rn <= 60) AS mad, max(close / pc - 1) FILTER (rn = 1) AS ret, stddev_samp(close / pc - 1) FILTER (rn < 20) AS sd, count(*) FILTER (rn < 10 AND close > pc AND volume > base * 1.2e0) AS uh, count(*) FILTER (rn < 10 AND close < pc AND volume > base * 1.2e0) AS dh,
 coalesce(sum(volume) FILTER (rn < 10 AND close > pc), 0) - coalesce(sum(volume) FILTER (rn < 10 AND close < pc), 0) AS obv, max(valid) AS valid FROM wh0 GROUP BY 1""", "wh0")
view("whale", """SELECT *, CASE WHEN va >= 65 AND pr <= 35 THEN 'Distribution Risk' WHEN rel < 30 THEN 'Insufficient Data' WHEN raw >= 72 AND ne >= 3 AND nc = 0 THEN 'High' WHEN raw >= 55 AND ne >= 2 THEN 'Elevated' ELSE 'Normal' END AS level, CASE WHEN s >= 70 THEN 'High' WHEN s >= 40 THEN 'Medium' WHEN s >= 15 THEN 'Low' ELSE 'Insufficient Data' END AS confidence FROM (
 SELECT *, 20 + CASE WHEN fc > 0 THEN 12 ELSE 0 END + ((va >= 70 OR pr >= 65 OR ac >= 65)::INT + (fc >= 65)::INT) * 10 - ((pr <= 35)::INT + (va >= 65 AND pr <= 35)::INT) * 10 + CASE WHEN raw > 55 THEN 4 ELSE 0 END - 5 - CASE WHEN earnings_near THEN 15 ELSE 0 END - nc * 12 AS s, (va >= 70)::INT + (pr >= 65)::INT + (ac >= 65)::INT + (fc >= 65)::INT AS ne FROM (
 SELECT *, CASE WHEN nc > 0 THEN greatest(0, (va + pr + ac + fc + rel) / 5 - 10 * least(nc, 3)) ELSE (va + pr + ac + fc + rel) / 5 END AS raw FROM (SELECT w.ticker, c.earnings_near, c.earnings_near::INT + c.large_move::INT AS nc, least(greatest(35 + v / base * 20 + (v - base) / (1.4826e0 * CASE WHEN mad = 0 THEN base ELSE mad END) * 10, 0), 100) AS va, least(greatest(50 + ret / greatest(coalesce(nullif(sd, 0), 0.02e0), 0.005e0) * 18, 0), 100) AS pr,
 least(greatest(45 + uh * 10 - dh * 12 + CASE WHEN obv > 0 THEN 15 ELSE -10 END, 0), 100) AS ac, CAST(coalesce(fc, 0) AS DOUBLE) AS fc, least(greatest(55 + least(valid, 80) * 0.3e0 - 10 - (c.earnings_near::INT + c.large_move::INT) * 15, 0), 100) AS rel FROM wh1 w JOIN conf c USING (ticker) LEFT JOIN fconf USING (ticker))))""", "wh1", "conf", "fconf")


def recent_filings(m):
    """Insider filings of the last 30 days, by nation name."""
    from marketloom.sources import files
    last = m.table("orders").agg(F.date_sub(F.max(F.to_date("o_orderdate")), 30).alias("_from"))  # one row
    names = m.places.select(F.concat(F.lit("N"), F.col("n_nationkey")).alias("code"), "n_name")
    # only the recent documents are parsed
    docs = q_sources.form4_docs(m).crossJoin(F.broadcast(last)).filter(F.col("filing_date") >= F.col("_from")).drop("_from")
    rows = files.form4_transactions(docs)
    return rows.join(names, F.col("ticker") == F.col("code")).drop("ticker", "code").withColumnRenamed("n_name", "ticker")


def whale(m):
    return evidence.whale_activity(m.bars, _confounders(m), evidence.filing_confirmation(recent_filings(m)))


query("whale_activity", "ticker volume_anomaly:5 price_response:5 accumulation:5 filing_confirmation:2 reliability:5 raw_score:5 level confidence", "SELECT *, va AS volume_anomaly, pr AS price_response, ac AS accumulation, fc AS filing_confirmation, rel AS reliability, raw AS raw_score FROM whale", "whale")(whale)

query("whale_intraday", "ticker closing_pressure:5 vwap_behavior:5",
      """SELECT ticker, CASE WHEN n >= 6 THEN least(greatest(45 + (c1 / c6 - 1) * 1000 + v6 / greatest(v, 1) * 80 + (c1 - lo) / greatest(hi - lo, 0.01e0) * 20, 0), 100) END AS closing_pressure, CASE WHEN v > 0 THEN least(greatest(35 + above * 40 + CASE WHEN c1 > vw THEN 25 ELSE 0 END, 0), 100) END AS vwap_behavior FROM (SELECT ticker, count(*) AS n, max(close) FILTER (rn = 1) AS c1, max(close) FILTER (rn = 6) AS c6, sum(volume) FILTER (rn <= 6) AS v6, sum(volume) AS v, min(low) AS lo, max(high) AS hi, max(vw) AS vw, avg(CASE WHEN close > vw THEN 1e0 ELSE 0e0 END) AS above FROM (
 SELECT *, sum(close * volume) OVER (PARTITION BY ticker) / nullif(sum(volume) OVER (PARTITION BY ticker), 0) AS vw, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) AS rn FROM intra JOIN (SELECT ticker, max(CAST(ts AS DATE)) AS d FROM intra GROUP BY 1) l USING (ticker) WHERE CAST(ts AS DATE) = l.d) GROUP BY 1)""", "intra")(lambda m: evidence.intraday_scores(m.intraday))


def evidence_rows(m):
    """Four model categories per ticker: trend, volume activity, volatility, factors."""
    e = evidence.stock_evidence(m.bars, m.fundamentals)
    w = whale(m).select("ticker", "level", F.coalesce("evidence", F.array().cast("array<string>")).alias("we"), F.coalesce("contradicting", F.array().cast("array<string>")).alias("wc"))
    v = ind.vol_forecast(ind.daily_returns(m.bars)).select("ticker", "expected")
    none = F.array().cast("array<string>")
    names = lambda c: F.transform(c, lambda x: x["signal"])
    rows = e.join(w, "ticker").join(v, "ticker")
    items = F.array(
        F.struct(F.lit(1).alias("place"), F.lit("price").alias("name"), F.col("overall_view").alias("conclusion"), names("positive_evidence").alias("supporting"), names("negative_evidence").alias("contradicting"), F.when(F.col("confidence") == "Low", "failed_validation").otherwise("tested").alias("validation_status")),
        F.struct(F.lit(2).alias("place"), F.lit("activity").alias("name"), F.col("level").alias("conclusion"), F.col("we").alias("supporting"), F.col("wc").alias("contradicting"), F.lit("tested").alias("validation_status")),
        F.struct(F.lit(3).alias("place"), F.lit("volatility").alias("name"), F.concat(F.lit("Volatility "), F.col("expected")).alias("conclusion"), F.when(F.col("expected") == "Lower", F.array(F.lit("Lower volatility"))).otherwise(none).alias("supporting"),
                 F.when(F.col("expected") == "Elevated", F.array(F.lit("Elevated volatility"))).otherwise(none).alias("contradicting"), F.lit("tested").alias("validation_status")),
    )
    return rows.select("ticker", F.inline(items))


query("evidence_agg", "ticker overall_view confidence supporting_categories:i contradicting_categories:i",
      """SELECT ticker, CASE WHEN p > 0 AND p >= n THEN 'Worth Watching' WHEN p > 0 THEN 'Mixed Evidence' ELSE 'Not Enough Evidence' END AS overall_view, CASE WHEN p >= 3 AND NOT earnings_near THEN 'Medium' ELSE 'Low' END AS confidence, p AS supporting_categories, n AS contradicting_categories FROM (SELECT e.ticker, c.earnings_near, CASE WHEN e.confidence <> 'Low' THEN (np > 0)::INT ELSE 0 END + (w.ne > 0)::INT + (v.expected = 'Lower')::INT AS p, CASE WHEN e.confidence <> 'Low' THEN (nn > 0)::INT ELSE 0 END + (w.pr <= 35)::INT + (v.expected = 'Elevated')::INT AS n
 FROM evi e JOIN whale w USING (ticker) JOIN vfc v USING (ticker) JOIN conf c USING (ticker))""", "evi whale vfc conf")(
    lambda m: evidence.aggregate_evidence(evidence_rows(m).join(_confounders(m).select("ticker", "earnings_near"), "ticker"), ("ticker",), "place", F.col("earnings_near"), F.lit(False)))

query("driver_ranking", "ticker positive_drivers negative_drivers",
      """SELECT ticker, coalesce(string_agg(k, '|' ORDER BY abs(v) DESC, k) FILTER (v > 0 AND rp <= 2), '') AS positive_drivers, coalesce(string_agg(k, '|' ORDER BY abs(v) DESC, k) FILTER (v < 0 AND rm <= 2), '') AS negative_drivers FROM (SELECT *, row_number() OVER (PARTITION BY ticker, v > 0 ORDER BY abs(v) DESC, k) AS rp, row_number() OVER (PARTITION BY ticker, v < 0 ORDER BY abs(v) DESC, k) AS rm FROM (
 SELECT ticker, unnest(['3m', '6m', '12m', '24m']) AS k, unnest([round(ret_63, 9), round(ret_126, 9), round(ret_252, 9), round(ret_504, 9)]) AS v FROM momh)) GROUP BY 1""", "momh")(
    lambda m: evidence.driver_ranking(risk.momentum_horizons(m.bars).withColumn("c", F.create_map(*[x for k, n in (("3m", 63), ("6m", 126), ("12m", 252), ("24m", 504)) for x in (F.lit(k), F.round(f"ret_{n}", 9))])), "c", 2)
    .withColumn("positive_drivers", F.array_join("positive_drivers", "|")).withColumn("negative_drivers", F.array_join("negative_drivers", "|")))


def records(m):
    """Signal records as maps; expensive orders lack the thesis, small ones the evidence text."""
    t = F.col("o_totalprice")
    pairs_ = [("signal", F.lit("order")), ("thesis", F.lit("x")), ("evidence", F.when(t > 50000, "text").otherwise("")), ("assumptions", F.lit("x")), ("failure_modes", F.lit("x")), ("regime_weaknesses", F.lit("x")), ("confidence", F.floor(t / 5000).cast("string")), ("uncertainty", F.lit("x"))]
    full = F.create_map(*[x for k, v in pairs_ for x in (F.lit(k), v)])
    return m.table("orders").select("o_orderkey", F.when(t > 400000, F.map_filter(full, lambda k, _: k != "thesis")).otherwise(full).alias("record"))


query("envelope_check", "o_orderkey:i missing valid uncertainty_label",
      """SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN 'thesis' ELSE '' END AS missing, o_totalprice <= 400000 AND o_totalprice > 50000 AS valid, CASE WHEN c >= 80 THEN 'Lower uncertainty' WHEN c >= 60 THEN 'Moderate uncertainty' WHEN c >= 40 THEN 'High uncertainty' ELSE 'Insufficient evidence' END AS uncertainty_label FROM (SELECT *, floor(o_totalprice / 5000) AS c FROM orders)""")(
    lambda m: evidence.envelope_check(records(m)).withColumn("missing", F.array_join("missing_fields", "|")))

query("model_gate", "ticker expected ewma_daily:8", "SELECT * FROM vfc WHERE expected <> 'Lower'", "vfc")(
    lambda m: evidence.model_gate(ind.vol_forecast(ind.daily_returns(m.bars)).withColumn("status", F.when(F.col("expected") == "Lower", "failed").otherwise("success")).withColumn("confidence", F.lit("Medium"))))


def leads(m):
    from marketloom.operators.filings import filing_insight
    insights = filing_insight(recent_filings(m)).filter("form_type = '4' AND transaction_type = 'Open-market purchase'").select("ticker", "headline", "confidence")
    scen = backtest.outcome_frequencies(m.bars, 30)
    return evidence.opportunity_union(pairs.relative_value(sector_pairs(m), m.bars), whale(m), insights, scen, 60)


view("ofreq", "SELECT ticker, count(t) AS n, 100e0 * count(*) FILTER (t > 0) / count(t) AS h, 100e0 * count(*) FILTER (t <= -0.1e0) / count(t) AS dn, CASE WHEN count(t) >= 180 THEN 'Medium' ELSE 'Low' END AS c FROM (SELECT ticker, round(lead(close, 30) OVER (PARTITION BY ticker ORDER BY date) / close - 1, 9) AS t FROM bars WHERE close > 0) GROUP BY 1 HAVING count(t) > 0", "bars")
query("outcome_frequencies", "ticker sample_size:i ending_higher_pct:7 down_10_pct:7 confidence", "SELECT ticker, n AS sample_size, h AS ending_higher_pct, dn AS down_10_pct, c AS confidence FROM ofreq", "ofreq")(
    lambda m: backtest.outcome_frequencies(m.bars, 30))

query("opportunity_union", "rank:i category subject title confidence",
      """SELECT row_number() OVER (ORDER BY kind, subject, title) AS rank, ['Relative-Value Watch', 'Observed market behavior', 'Confirmed filing', 'Model estimate'][kind + 1] AS category, subject, title, confidence FROM (
 SELECT 0 AS kind, a || '/' || b AS subject, relationship_status AS title, confidence FROM relv WHERE relationship_status IN ('Moderate Divergence', 'Unusual Divergence') AND confidence IN ('Medium', 'High') UNION ALL SELECT 1, ticker, 'Whale Activity: ' || level, confidence FROM whale WHERE level IN ('High', 'Elevated', 'Distribution Risk')
 UNION ALL SELECT 2, n_name, 'Confirmed insider filing', 'Medium' FROM f4 JOIN nation ON f4.ticker = 'N' || n_nationkey WHERE filing_date >= (SELECT max(filing_date) FROM f4) - 30 AND transaction_type = 'Open-market purchase'
 UNION ALL SELECT 3, ticker, CASE WHEN h >= 58 AND dn <= 18 THEN 'Favorable scenario balance' ELSE 'Meaningful downside frequency' END, c FROM ofreq WHERE (h >= 58 AND dn <= 18) OR dn >= 25) QUALIFY rank <= 60""", "relv whale f4 ofreq")(leads)

query("stock_bundle", "ticker trend level expected pair_count:i pair_list",
      """SELECT e.ticker, e.trend, w.level, v.expected, coalesce(p.n, 0) AS pair_count, coalesce(p.l, '') AS pair_list FROM evi e LEFT JOIN whale w USING (ticker) LEFT JOIN vfc v USING (ticker) LEFT JOIN (SELECT ticker, count(*) AS n, string_agg(a || '/' || b, '|' ORDER BY a, b) AS l FROM (SELECT a, b, unnest([a, b]) AS ticker FROM relv) GROUP BY 1) p USING (ticker)""", "evi whale vfc relv")(
    lambda m: evidence.stock_bundle({"analysis": evidence.stock_evidence(m.bars, m.fundamentals).select("ticker", "trend", "overall_view", "positive_evidence"), "activity": whale(m).select("ticker", "level", "raw_score"),
                                     "volatility": ind.vol_forecast(ind.daily_returns(m.bars)).select("ticker", "expected", "annualized")},
                                    pairs.relative_value(sector_pairs(m), m.bars).select("a", "b", "relationship_status", "spread_zscore"))
    .select("ticker", "analysis.trend", "activity.level", "volatility.expected", "pair_count", F.coalesce(F.array_join(F.transform("pairs", lambda p: F.concat_ws("/", p["a"], p["b"])), "|"), F.lit("")).alias("pair_list")))
