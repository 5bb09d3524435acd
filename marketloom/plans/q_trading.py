"""Queries: order book, execution, options, expected value, filings, news, alternative data, tables."""

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketloom.operators import altdata, ev, events, filings, micro, options, risk, tables
from marketloom.operators import indicators as ind
from marketloom.plans import q_scores, q_sources  # noqa: F401  (views)
from marketloom.plans.q_events import table
from marketloom.plans.q_portfolio import wts
from marketloom.plans.registry import query, view
from marketloom.plans.views import cdf
from marketloom.session import shared_dir
from marketloom.sources import files

# --- order book and execution ------------------------------------------------------------
K = "CAST(json_extract_string(props, '$.k') AS DOUBLE)"
view("book", f"""SELECT strftime(ts, '%Y%m%d%H') || '-' || (user_id % 5) AS snapshot_id, CASE WHEN event_type IN ('view', 'signup') THEN 'bid' ELSE 'ask' END AS side, CASE WHEN event_type IN ('view', 'signup') THEN 500 - value / 10e0 ELSE 501 + value / 10e0 END AS price, {K} AS size FROM events""")
view("lvl", "SELECT snapshot_id, side, price, sum(size) AS size FROM book GROUP BY 1, 2, 3", "book")
query("book_metrics", "snapshot_id available best_bid:4 best_ask:4 mid_price:6 spread:6 spread_bps:5 bid_depth:4 ask_depth:4 imbalance:9 microprice:8",
      """SELECT *, best_bid IS NOT NULL AND best_ask IS NOT NULL AS available, (best_bid + best_ask) / 2 AS mid_price, best_ask - best_bid AS spread, (best_ask - best_bid) / ((best_bid + best_ask) / 2) * 10000 AS spread_bps, coalesce((bid_depth - ask_depth) / nullif(bid_depth + ask_depth, 0), 0) AS imbalance,
 coalesce((best_ask * bs + best_bid * az) / nullif(bs + az, 0), (best_bid + best_ask) / 2) AS microprice FROM (SELECT snapshot_id, max(price) FILTER (side = 'bid') AS best_bid, min(price) FILTER (side = 'ask') AS best_ask, arg_max(size, price) FILTER (side = 'bid') AS bs, arg_min(size, price) FILTER (side = 'ask') AS az, coalesce(sum(size) FILTER (side = 'bid'), 0) AS bid_depth, coalesce(sum(size) FILTER (side = 'ask'), 0) AS ask_depth FROM lvl GROUP BY 1)""", "lvl")(
    lambda m: micro.book_metrics(m.book))

view("jt", f"""SELECT event_id AS trade_id, n_name AS ticker, CASE WHEN event_type IN ('view', 'signup') THEN 'buy' ELSE 'sell' END AS action, {K} AS shares, value AS price, CAST(ts AS DATE) AS date, ts FROM events JOIN nation ON user_id % 25 = n_nationkey""")
query("vwap", "ticker date:d vwap:7 volume:2", "SELECT ticker, date, sum(price * shares) / nullif(sum(shares), 0) AS vwap, sum(shares) AS volume FROM jt GROUP BY 1, 2", "jt")(lambda m: micro.vwap(m.trades, ("ticker", "date"), size="shares"))
query("twap_schedule", "o_orderkey:i slice:i shares:7", "SELECT o_orderkey, unnest(range(1, n + 1)) AS slice, o_totalprice / n AS shares FROM (SELECT *, 3 + o_custkey % 5 AS n FROM orders)")(
    lambda m: micro.twap_schedule(m.table("orders").withColumn("slices", 3 + F.col("o_custkey") % 5), "o_totalprice"))

view("pint", "SELECT ticker, ts, volume AS expected_volume, 150e0 + CAST(substr(ticker, 2) AS INTEGER) * 10 AS total FROM intra", "intra")
query("participation_schedule", "ticker slice:i shares:7 residual",
      """SELECT ticker, slice, shares, false AS residual FROM (SELECT *, row_number() OVER w AS slice, least(expected_volume * 0.1e0, greatest(total - (sum(expected_volume * 0.1e0) OVER w - expected_volume * 0.1e0), 0)) AS shares, sum(expected_volume * 0.1e0) OVER w - expected_volume * 0.1e0 AS before FROM pint WINDOW w AS (PARTITION BY ticker ORDER BY ts)) WHERE round(before, 9) < total OR slice = 1
 UNION ALL SELECT ticker, n + 1, total - s, true FROM (SELECT ticker, count(*) AS n, max(total) AS total, sum(expected_volume * 0.1e0) AS s FROM pint GROUP BY 1) WHERE round(total - s, 9) > 0""", "pint")(
    lambda m: micro.participation_schedule(m.intraday.select("ticker", "ts", F.to_date("ts").alias("day"), F.col("volume").alias("expected_volume"), (F.lit(150.0) + F.substring("ticker", 2, 4).cast("int") * 10).alias("total_shares")), ("ticker",), "day", ("ts",)))


def fills(m):
    """Fills of order lines: decided at the list price, executed at the line's unit price."""
    j = m.table("lineitem").join(m.table("part"), F.col("l_partkey") == F.col("p_partkey"))
    return j.select("l_orderkey", "l_linenumber", "l_suppkey", F.col("p_retailprice").alias("decision_price"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("execution_price"), F.col("l_quantity").alias("shares"),
                    F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"), (F.col("l_tax") * 10).alias("fees"))


query("impl_shortfall", "l_orderkey:i l_linenumber:i l_suppkey:i shortfall_dollars:5 shortfall_bps:5",
      """SELECT *, c AS shortfall_dollars, c / (p_retailprice * l_quantity) * 10000 AS shortfall_bps FROM (SELECT *, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * (l_extendedprice / l_quantity - p_retailprice) * l_quantity + l_tax * 10 AS c FROM lineitem JOIN part ON l_partkey = p_partkey)""")(
    lambda m: micro.implementation_shortfall(fills(m)))


def costs(m):
    r = ind.relative_volume(ind.realized_vol(ind.daily_returns(m.bars)))
    slip = micro.slippage_bps((F.col("high") - F.col("low")) / F.col("close") * 10000, F.col("realized_vol"), F.col("rv") * 0.1)
    out = r.withColumn("slippage_bps", slip)
    return out.withColumn("net_edge", micro.net_edge(F.abs("r"), F.lit(0.0005), F.col("slippage_bps") / 10000, F.lit(0.0001))).filter(F.col("slippage_bps").isNotNull())


query("slippage", "ticker date:d slippage_bps:5 net_edge:8",
      """SELECT ticker, date, slip AS slippage_bps, abs(r) - 0.0005e0 - slip / 10000 - 0.0001e0 AS net_edge FROM (SELECT *, 0.5e0 * (high - low) / close * 10000 + 10000 * realized_vol * sqrt(greatest(rv * 0.1e0, 0)) * 0.01e0 AS slip FROM (SELECT *, volume / CASE WHEN count(volume) OVER w >= 20 THEN avg(volume) OVER w END AS rv FROM rvol WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))) WHERE slip IS NOT NULL""", "rvol")(costs)

view("lot0", """SELECT *, sum(CASE WHEN action = 'buy' THEN shares ELSE 0 END) OVER w AS bought, sum(CASE WHEN action = 'buy' THEN 0 ELSE shares END) OVER w AS sold FROM jt WINDOW w AS (PARTITION BY ticker ORDER BY trade_id)""", "jt")
view("lot1", """SELECT *, sold - greatest(0, -min(bought - sold) OVER (PARTITION BY ticker ORDER BY trade_id)) AS matched FROM lot0""", "lot0")
view("lots", """SELECT b.ticker, least(b.bought, s.matched) - greatest(b.bought - b.shares, s.prev) AS shares, b.price AS entry_price, s.price AS exit_price FROM (SELECT * FROM lot1 WHERE action = 'buy') b JOIN (SELECT *, coalesce(lag(matched) OVER (PARTITION BY ticker ORDER BY trade_id), 0) AS prev FROM lot1 WHERE action = 'sell') s
 ON b.ticker = s.ticker AND least(b.bought, s.matched) > greatest(b.bought - b.shares, s.prev)""", "lot1")
query("fifo_lots", "ticker shares:2 entry_price:4 exit_price:4 pnl:6 return_pct:8", "SELECT *, (exit_price - entry_price) * shares AS pnl, exit_price / entry_price - 1 AS return_pct FROM lots", "lots")(lambda m: micro.fifo_lots(m.trades)[0])
query("fifo_summary", "ticker trade_count:i closed_trade_count:i open_shares:2 realized_pnl:4 win_rate:7 average_win:6 average_loss:7 expected_value:6",
      """SELECT *, win_rate * average_win + (1 - win_rate) * average_loss AS expected_value FROM (SELECT ticker, count(*) AS trade_count, max(bought) - max(matched) AS open_shares FROM lot1 GROUP BY 1) JOIN (SELECT ticker, count(*) AS closed_trade_count, sum((exit_price - entry_price) * shares) AS realized_pnl, avg(CASE WHEN exit_price > entry_price THEN 1e0 ELSE 0e0 END) AS win_rate,
 avg(exit_price / entry_price - 1) FILTER (exit_price > entry_price) AS average_win, avg(exit_price / entry_price - 1) FILTER (exit_price <= entry_price) AS average_loss FROM lots GROUP BY 1) USING (ticker)""", "lot1 lots")(lambda m: micro.lot_summary(*micro.fifo_lots(m.trades)))

# --- options -----------------------------------------------------------------------------
view("chain", """SELECT p_partkey AS contract_id, p_brand AS underlying, 30 + 5 * p_size AS expiration_days, round(p_retailprice * (0.8e0 + p_partkey % 41 / 100e0), 4) AS strike, p_retailprice AS spot, 0.03e0 AS rate, 0.1e0 + p_size / 100e0 + p_partkey % 7 / 100e0 AS iv, p_partkey % 2 = 0 AS is_call FROM part""")
view("bsd", "SELECT *, d1 - iv * sqrt(t) AS d2, exp(-d1 * d1 / 2e0) / sqrt(2 * pi()) AS p1, exp(-rate * t) AS df FROM (SELECT *, (ln(spot / strike) + (rate + 0.5e0 * iv * iv) * t) / (iv * sqrt(t)) AS d1 FROM (SELECT *, expiration_days / 365e0 AS t FROM chain))", "chain")
view("bsv", f"SELECT *, CASE WHEN is_call THEN spot * n1 - strike * df * n2 ELSE strike * df * (1 - n2) - spot * (1 - n1) END AS fair_value FROM (SELECT *, {cdf('d1')} AS n1, {cdf('d2')} AS n2 FROM bsd)", "bsd")
query("chain_value", "contract_id:i fair_value:6 delta:6 gamma:8 vega:6 theta:6 rho:6",
      """SELECT *, CASE WHEN is_call THEN n1 ELSE n1 - 1 END AS delta, p1 / (spot * iv * sqrt(t)) AS gamma, spot * p1 * sqrt(t) / 100 AS vega, (-(spot * p1 * iv) / (2 * sqrt(t)) - CASE WHEN is_call THEN 1 ELSE -1 END * rate * strike * df * CASE WHEN is_call THEN n2 ELSE 1 - n2 END) / 365 AS theta, CASE WHEN is_call THEN 1 ELSE -1 END * strike * t * df * CASE WHEN is_call THEN n2 ELSE 1 - n2 END / 100 AS rho FROM bsv""", "bsv")(
    lambda m: options.chain_value(m.option_chain))


def priced(m):
    """Market price: the model value moved by up to 2.5 %, to the cent fraction."""
    return options.chain_value(m.option_chain).withColumn("market_price", F.round(F.col("fair_value") * (1 + (F.col("contract_id") % 5 - 2.5) / 100.0), 4))


view("mkt", "SELECT *, round(fair_value * (1 + (contract_id % 5 - 2.5e0) / 100e0), 4) AS market_price FROM bsv", "bsv")


def iv_sql():
    d1 = "(ln(spot / strike) + (rate + 0.5e0 * mid * mid) * t) / (mid * sqrt(t))"
    v = f"CASE WHEN is_call THEN spot * n1 - strike * df * n2 ELSE strike * df * (1 - n2) - spot * (1 - n1) END"
    step = f"""SELECT contract_id, spot, strike, rate, t, df, is_call, market_price, CASE WHEN {v} < market_price THEN mid ELSE lo END AS lo, CASE WHEN {v} < market_price THEN hi ELSE mid END AS hi, k + 1 AS k FROM (SELECT *, {cdf('d1')} AS n1, {cdf('d2')} AS n2 FROM (SELECT *, d1 - mid * sqrt(t) AS d2 FROM (SELECT *, {d1} AS d1 FROM (SELECT *, (lo + hi) / 2 AS mid FROM ivr WHERE k < 60))))"""
    return f"""SELECT contract_id, (lo + hi) / 2 AS solved_iv FROM (WITH RECURSIVE ivr AS (SELECT contract_id, spot, strike, rate, t, df, is_call, market_price, 1e-6 AS lo, 5e0 AS hi, 0 AS k FROM mkt UNION ALL {step}) SELECT * FROM ivr WHERE k = 60) x
 WHERE market_price >= CASE WHEN is_call THEN greatest(spot - strike * df, 0) ELSE greatest(strike * df - spot, 0) END"""


query("chain_iv", "contract_id:i solved_iv:5", f"SELECT m.contract_id, s.solved_iv FROM mkt m LEFT JOIN ({iv_sql()}) s USING (contract_id)", "mkt")(lambda m: options.chain_iv(priced(m)))
query("chain_breakeven", "contract_id:i break_even:4 required_move_pct:5 max_loss_per_share:4 edge:5 relative_value",
      """SELECT *, (CASE WHEN is_call THEN break_even / spot - 1 ELSE 1 - break_even / spot END) * 100 AS required_move_pct, market_price AS max_loss_per_share, fair_value - market_price AS edge, CASE WHEN round(market_price, 9) > round(fair_value, 9) THEN 'expensive' WHEN round(market_price, 9) < round(fair_value, 9) THEN 'cheap' ELSE 'fair' END AS relative_value FROM (SELECT *, CASE WHEN is_call THEN strike + market_price ELSE strike - market_price END AS break_even FROM mkt)""", "mkt")(
    lambda m: options.chain_breakeven(priced(m)))
query("iv_rank", "underlying current_iv:6 iv_rank:6 iv_percentile:6",
      """SELECT underlying, c AS current_iv, coalesce((c - lo) / nullif(hi - lo, 0), 0) * 100 AS iv_rank, s * 100 AS iv_percentile FROM (SELECT underlying, any_value(c) AS c, min(iv) AS lo, max(iv) AS hi, avg(CASE WHEN iv <= c THEN 1e0 ELSE 0e0 END) AS s FROM (SELECT *, arg_max(iv, contract_id) OVER (PARTITION BY underlying) AS c FROM chain) GROUP BY 1)""", "chain")(lambda m: options.iv_rank(m.option_chain, "underlying", "contract_id"))
query("vol_surface", "underlying expiration_days:i contracts:i min_iv:6 max_iv:6 mean_iv:7 skew:6",
      """SELECT underlying, expiration_days, count(*) AS contracts, min(iv) AS min_iv, max(iv) AS max_iv, avg(iv) AS mean_iv, CASE WHEN count(*) > 1 THEN arg_min(iv, struct_pack(s := strike, c := contract_id)) - arg_max(iv, struct_pack(s := strike, c := contract_id)) ELSE 0 END AS skew FROM chain GROUP BY 1, 2""", "chain")(
    lambda m: options.vol_surface(m.option_chain, ("underlying", "expiration_days"))[0])
view("lvls", f"SELECT underlying, (expiration_days // 60) * 60 AS maturity, strike, avg(spot * n1 - strike * df * n2) AS call_price FROM bsv GROUP BY 1, 2, 3", "bsv")
view("nearm", "SELECT underlying, arg_min(maturity, struct_pack(g := abs(maturity - 130), m := maturity)) AS maturity FROM (SELECT DISTINCT underlying, maturity FROM lvls) GROUP BY 1", "lvls")
query("strike_curvature", "underlying nearest_maturity:i nearest_strike:4 second_k:6 local_volatility:4",
      """SELECT underlying, maturity AS nearest_maturity, strike AS nearest_strike, second_k, sqrt(greatest(0, 2 * call_price / greatest(strike * strike * second_k, 1e-9))) AS local_volatility FROM (SELECT *, 2 * ((c2 - call_price) / (k2 - strike) - (call_price - c0) / (strike - k0)) / (k2 - k0) AS second_k FROM (SELECT l.*, lag(strike) OVER w AS k0, lead(strike) OVER w AS k2, lag(call_price) OVER w AS c0, lead(call_price) OVER w AS c2, row_number() OVER w - 1 AS idx, count(*) OVER (PARTITION BY underlying) AS n FROM lvls l JOIN nearm USING (underlying, maturity) WINDOW w AS (PARTITION BY underlying ORDER BY strike)) x
 JOIN (SELECT underlying AS u, least(greatest(arg_min(idx, struct_pack(g := abs(strike - 900), i := idx)), 1), max(n) - 2) AS bi FROM (SELECT l.*, row_number() OVER (PARTITION BY underlying ORDER BY strike) - 1 AS idx, count(*) OVER (PARTITION BY underlying) AS n FROM lvls l JOIN nearm USING (underlying, maturity)) WHERE n >= 3 GROUP BY 1) b ON x.underlying = b.u AND x.idx = b.bi WHERE n >= 3)""", "lvls nearm")(
    lambda m: options.strike_curvature(
        options.chain_value(m.option_chain.withColumn("kind", F.col("option_type")).withColumn("option_type", F.lit("call"))).select("underlying", (F.floor(F.col("expiration_days") / 60) * 60).cast("int").alias("maturity"), "strike", F.col("fair_value").alias("call_price")),
        m.table("part").select(F.col("p_brand").alias("underlying")).distinct().withColumn("strike_target", F.lit(900.0)).withColumn("maturity_target", F.lit(130))))

# --- expected value ----------------------------------------------------------------------
view("outs", "SELECT l_orderkey AS g, CASE WHEN o_orderpriority = '1-URGENT' THEN 1.1e0 ELSE 1e0 END * l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey) AS p, sqrt(l_extendedprice) * (l_discount - l_tax) AS x FROM lineitem JOIN orders ON l_orderkey = o_orderkey")


def outcomes(m):
    li = m.table("lineitem").join(m.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    total = F.sum("l_quantity").over(Window.partitionBy("l_orderkey"))  # the lines of one order
    p = F.when(F.col("o_orderpriority") == "1-URGENT", 1.1).otherwise(1.0) * F.col("l_quantity") / total
    return li.select("l_orderkey", p.alias("probability"), (F.sqrt("l_extendedprice") * (F.col("l_discount") - F.col("l_tax"))).alias("payoff"))


query("ev_weighted", "l_orderkey:i outcomes:i probability_sum:8 accepted expected_value:8",
      "SELECT g AS l_orderkey, count(*) AS outcomes, sum(p) AS probability_sum, abs(sum(p) - 1) <= 1e-6 AND min(p) >= 0 AND max(p) <= 1 AS accepted, CASE WHEN abs(sum(p) - 1) <= 1e-6 AND min(p) >= 0 AND max(p) <= 1 THEN sum(p * x) END AS expected_value FROM outs GROUP BY 1", "outs")(lambda m: ev.ev_weighted(outcomes(m), ("l_orderkey",)))
query("ev_trades", "ticker trade_count:i strategy_ev:8 win_rate:7 average_win:7 average_loss:7 simple_ev:8 trade_ev:8 ev_after_cost:8 ev_after_slippage:8",
      """SELECT *, win_rate * average_win + (1 - win_rate) * average_loss AS simple_ev, win_rate * average_win - (1 - win_rate) * abs(average_loss) - 0.0005e0 AS trade_ev, strategy_ev - 0.0005e0 AS ev_after_cost, strategy_ev - 0.0002e0 AS ev_after_slippage FROM (SELECT ticker, count(*) AS trade_count, avg(v) AS strategy_ev, avg(CASE WHEN v > 0 THEN 1e0 ELSE 0e0 END) AS win_rate, avg(v) FILTER (v > 0) AS average_win, avg(v) FILTER (v <= 0) AS average_loss FROM (SELECT ticker, r - 0.0001e0 AS v FROM rets) GROUP BY 1)""", "rets")(
    lambda m: ev.ev_trades(ind.daily_returns(m.bars), ("ticker",), "r", 0.0001, 0.0005, 0.0002))
query("ev_portfolio", "portfolio_id missing_count:i missing expected_value:8",
      """SELECT portfolio_id, count(*) FILTER (e IS NULL) AS missing_count, coalesce(string_agg(ticker, '|' ORDER BY ticker) FILTER (e IS NULL), '') AS missing, CASE WHEN count(*) FILTER (e IS NULL) = 0 THEN sum(weight * e) END AS expected_value FROM (SELECT portfolio_id, ticker, weight, CASE WHEN CAST(substr(ticker, 8) AS INT) <> 3 THEN annual END AS e FROM wts JOIN (SELECT ticker, annual, n FROM sa) s USING (ticker)) GROUP BY 1""", "wts sa")(
    lambda m: ev.ev_portfolio(wts(m), risk.stock_analysis(m.bars, m.benchmark).select("ticker", F.when(F.substring("ticker", 8, 9).cast("int") != 3, F.col("annual")).alias("expected_return"))).withColumn("missing", F.array_join("missing", "|")))
query("event_rate", "ticker trials:i successes:i event_probability:8 conditional_probability:8 bayes_posterior:8 probability_of_profit:8",
      """SELECT *, successes / trials::DOUBLE AS event_probability, least(1, j / c::DOUBLE) AS conditional_probability, (j / successes::DOUBLE * (successes / trials::DOUBLE)) / (j / successes::DOUBLE * (successes / trials::DOUBLE) + jf / (trials - successes)::DOUBLE * (1 - successes / trials::DOUBLE)) AS bayes_posterior, greatest(0, successes / trials::DOUBLE - c / trials::DOUBLE) AS probability_of_profit FROM (
 SELECT ticker, count(*) AS trials, count(*) FILTER (r > 0) AS successes, count(*) FILTER (rv >= 1.5) AS c, count(*) FILTER (r > 0 AND rv >= 1.5) AS j, count(*) FILTER (NOT r > 0 AND rv >= 1.5) AS jf FROM rvx WHERE r IS NOT NULL GROUP BY 1)""", "rvx")(
    lambda m: ev.event_rate(ind.daily_returns(ind.relative_volume(m.bars)), ("ticker",), F.col("r") > 0, F.col("rv") >= 1.5))


def assets(m):
    a = risk.stock_analysis(m.bars, m.benchmark)
    return a.select("ticker", ((F.col("quant_score") - 50) / 100.0).alias("expected_return"), F.col("annualized_volatility").alias("volatility"))


view("grid", "SELECT ticker, horizon, days, target, (quant_score - 50) / 100e0 AS er, annualized_volatility AS vol FROM sa, (VALUES ('1 week', 5), ('1 month', 21), ('3 months', 63)) AS h(horizon, days), (VALUES (0.05::DOUBLE), (0.1::DOUBLE)) AS t(target)", "sa")
query("join_cross_grid", "ticker horizon days:i target:2 expected_return:4 volatility:7", "SELECT *, er AS expected_return, vol AS volatility FROM grid", "grid")(lambda m: ev.cross_grid(assets(m)))
query("target_probs", "ticker horizon target:2 probability_above_target:7 probability_below_negative_target:7 logistic_up:6 logistic_down:6",
      f"""SELECT *, 1 - {cdf('((target - mu) / s)')} AS probability_above_target, {cdf('((-target - mu) / s)')} AS probability_below_negative_target, least(greatest(100 / (1 + pow(2.71828e0, -1.7e0 * (mu - target) / s)), 0), 100) AS logistic_up, least(greatest(100 / (1 + pow(2.71828e0, -1.7e0 * (-mu - target) / s)), 0), 100) AS logistic_down FROM (SELECT *, er * (days / 252e0) AS mu, vol * sqrt(days / 252e0) AS s FROM grid)""", "grid")(
    lambda m: ev.target_probabilities(ev.cross_grid(assets(m))))
query("conf_uncertainty", "ticker confidence:7 uncertainty:7",
      """SELECT ticker, 0.4e0 * least(n / 100e0, 1) + 0.35e0 * q + 0.25e0 * st AS confidence, least(greatest(0.35e0 * (1 - q) + 0.35e0 * sd * sqrt(252) + 0.3e0 * (1 - st), 0), 1) AS uncertainty FROM (SELECT ticker, count(*) AS n, count(*) / (SELECT count(*) FROM benchx)::DOUBLE AS q, avg(CASE WHEN r > 0 THEN 1e0 ELSE 0e0 END) AS st, stddev_samp(r) AS sd FROM rets GROUP BY 1)""", "rets benchx")(
    lambda m: _conf(m))


def _conf(m):
    r = ind.daily_returns(m.bars)
    days = m.benchmark.agg(F.count(F.lit(1)).alias("days"))  # one row
    g = r.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("r") > 0).cast("double")).alias("st"), F.stddev_samp("r").alias("sd")).crossJoin(F.broadcast(days)).withColumn("q", F.col("n") / F.col("days"))
    return g.select("ticker", ev.confidence_score(F.col("n"), F.col("q"), F.col("st")).alias("confidence"), ev.uncertainty_score(1 - F.col("q"), F.col("sd") * 252 ** 0.5, 1 - F.col("st")).alias("uncertainty"))


# --- filings, news, earnings -------------------------------------------------------------
def all_filings(m):
    """Insider and holder filings in one table."""
    cols = ("accession_number", "ticker", "form_type", "filing_date", "transaction_type", "reporting_owner")
    return files.form4_transactions(q_sources.form4_docs(m)).select(*cols).unionByName(files.schedule13(q_sources.schedule_docs(m)).select(*cols))


view("fall", "SELECT accession_number, ticker, form_type, filing_date, transaction_type, reporting_owner FROM f4 UNION ALL SELECT accession_number, ticker, form_type, filing_date, transaction_type, reporting_owner FROM s13", "f4", "s13")
query("filing_insight", "accession_number form_type headline insight_confidence context",
      """SELECT *, CASE WHEN form_type = '4' THEN CASE WHEN transaction_type = 'Open-market purchase' THEN 'Confirmed insider filing' WHEN transaction_type = 'Open-market sale' THEN 'Confirmed insider sale filing' ELSE 'Insider filing detected' END WHEN form_type LIKE 'SC 13D%' THEN 'Confirmed major-holder filing' ELSE 'Confirmed passive or qualifying holder filing' END AS headline,
 CASE WHEN form_type <> '4' OR transaction_type IN ('Open-market purchase', 'Open-market sale') THEN 'Medium' ELSE 'Low' END AS insight_confidence, CASE WHEN form_type = '4' AND coalesce(transaction_type, '') NOT IN ('Open-market purchase', 'Open-market sale', 'Option exercise', 'Grant or award', 'Gift', 'Tax withholding') THEN 'unknown' ELSE 'confirmed_filing' END AS context FROM fall""", "fall")(
    lambda m: filings.filing_insight(all_filings(m)))
query("filing_priority", "ticker rank:i accession_number form_type priority:i filing_date:d",
      "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY priority, filing_date, accession_number) AS rank FROM (SELECT DISTINCT ticker, accession_number, form_type, filing_date, CASE WHEN form_type LIKE 'SC 13D%' THEN 0 WHEN form_type LIKE 'SC 13G%' THEN 1 ELSE 2 END AS priority FROM fall)) WHERE rank <= 5", "fall")(
    lambda m: filings.filing_priority(all_filings(m).select("ticker", "accession_number", "form_type", "filing_date").distinct(), ("ticker",)))
query("news_tone", "doc_id:i ticker bullish_score:i bearish_score:i importance_score:i tone",
      "SELECT *, least(100, 30 + 15 * (bullish_score + bearish_score)) AS importance_score, CASE WHEN bullish_score > bearish_score THEN 'supportive' WHEN bearish_score > bullish_score THEN 'negative' ELSE 'unclear' END AS tone FROM newsx", "newsx")(lambda m: filings.news_tone(m.news))

view("rep", """SELECT ticker, date, eps_actual, lag(eps_actual) OVER (PARTITION BY ticker ORDER BY date) AS eps_estimate FROM (SELECT o_custkey AS ticker, CAST(o_orderdate AS DATE) AS date, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS eps_actual FROM orders GROUP BY 1, 2)""")
query("earnings_streak", "ticker:i reports:i beat_streak:i miss_streak:i average_surprise_pct:5 last_surprise_pct:5 last_surprise_direction",
      """SELECT *, CASE WHEN last_surprise_pct > 0 THEN 'beat' WHEN last_surprise_pct IS NOT NULL THEN 'miss' END AS last_surprise_direction FROM (SELECT ticker, count(*) AS reports, coalesce(min(rn) FILTER (NOT beat) - 1, count(*)) AS beat_streak, coalesce(min(rn) FILTER (beat) - 1, count(*)) AS miss_streak, avg(s) AS average_surprise_pct, arg_min(s, rn) FILTER (s IS NOT NULL) AS last_surprise_pct FROM (
 SELECT *, coalesce(s > 0, false) AS beat FROM (SELECT *, (eps_actual - eps_estimate) / abs(eps_estimate) * 100 AS s, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn FROM rep)) GROUP BY 1)""", "rep")(lambda m: filings.earnings_streak(m.earnings))


def report_dates(m):
    """Next report 60 to 119 days after a customer's last order."""
    last = m.table("orders").groupBy(F.col("o_custkey").alias("ticker")).agg(F.max(F.to_date("o_orderdate")).alias("d"))
    return last.select("ticker", F.date_add("d", (60 + F.col("ticker") % 60).cast("int")).alias("next_earnings_date"))


view("due2", "SELECT ticker, nd AS next_earnings_date, datediff('day', (SELECT CAST(max(o_orderdate) AS DATE) FROM orders), nd) AS days_until FROM (SELECT o_custkey AS ticker, CAST(max(o_orderdate) AS DATE) + CAST(60 + o_custkey % 60 AS INTEGER) AS nd FROM orders GROUP BY o_custkey)")
query("earnings_window", "list ticker:i next_earnings_date:d days_until:i",
      "SELECT 'due' AS list, * FROM due2 WHERE days_until BETWEEN 0 AND 20 UNION ALL SELECT * FROM (SELECT 'upcoming' AS list, * FROM due2 WHERE days_until >= 0 ORDER BY days_until, ticker LIMIT 20)", "due2")(lambda m: _window(m))


def _window(m):
    today = m.table("orders").agg(F.max(F.to_date("o_orderdate")).alias("as_of"))
    due, upcoming = filings.earnings_window(report_dates(m), today, 20)
    return due.withColumn("list", F.lit("due")).unionByName(upcoming.withColumn("list", F.lit("upcoming")))


def holdings(m, first, last):
    """Shares per nation (manager) and brand shipped in [first, last) days before the end."""
    li = m.table("lineitem").join(m.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(m.places, F.col("s_nationkey") == F.col("n_nationkey")).join(m.table("part"), F.col("l_partkey") == F.col("p_partkey"))
    end = m.table("lineitem").agg(F.max(F.to_date("l_shipdate")).alias("_end"))  # one row
    age = F.datediff("_end", F.to_date("l_shipdate"))
    return li.crossJoin(F.broadcast(end)).filter((age >= first) & (age < last)).groupBy(F.col("n_name").alias("manager"), F.col("p_brand").alias("ticker")).agg(F.sum("l_quantity").alias("shares"), F.max(F.when(F.col("r_name") == "ASIA", "Passive index").otherwise("Active")).alias("manager_type"))


view("hold", """SELECT manager, ticker, mt, coalesce(sum(q) FILTER (age >= 91 AND age < 182), 0) AS p, coalesce(sum(q) FILTER (age < 91), 0) AS c FROM (SELECT n_name AS manager, p_brand AS ticker, CASE WHEN r_name = 'ASIA' THEN 'Passive index' ELSE 'Active' END AS mt, l_quantity AS q, datediff('day', CAST(l_shipdate AS DATE), (SELECT CAST(max(l_shipdate) AS DATE) FROM lineitem)) AS age FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey) WHERE age < 182 GROUP BY 1, 2, 3""")
query("join_holdings_delta", "manager ticker previous_shares:2 current_shares:2 transaction_type position_change:7 warning_count:i",
      """SELECT manager, ticker, p AS previous_shares, c AS current_shares, CASE WHEN p = 0 THEN 'Delayed 13F new position' WHEN c = 0 THEN 'Delayed 13F exited position' WHEN c > p THEN 'Delayed 13F increase' ELSE 'Delayed 13F decrease' END AS transaction_type, CASE WHEN c = 0 THEN -1 WHEN p <> 0 THEN c / p - 1 END AS position_change, 1 + CASE WHEN mt = 'Passive index' AND c > 0 THEN 1 ELSE 0 END AS warning_count FROM hold WHERE p <> c""", "hold")(
    lambda m: filings.holdings_delta(holdings(m, 91, 182), holdings(m, 0, 91)).withColumn("warning_count", F.size("warnings")))

# --- alternative data --------------------------------------------------------------------
view("alt", "SELECT CAST(ts AS DATE) AS date, event_type AS source, n_name AS ticker, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 100 AS value FROM events JOIN nation ON user_id % 25 = n_nationkey GROUP BY 1, 2, 3")
view("altx", """SELECT *, CASE WHEN count(value) OVER f >= 20 THEN (value - avg(value) OVER f) / nullif(stddev_samp(value) OVER f, 0) END AS zscore_60d, value / nullif(last_value(value) OVER (PARTITION BY source, ticker ORDER BY slot RANGE BETWEEN UNBOUNDED PRECEDING AND 7 PRECEDING), 0) - 1 AS change_7d FROM alt JOIN (SELECT source, date, row_number() OVER (PARTITION BY source ORDER BY date) AS slot, max(date) OVER (PARTITION BY source) AS lastd, count(*) OVER (PARTITION BY source) AS nd FROM (SELECT DISTINCT source, date FROM alt)) USING (source, date)
 WINDOW f AS (PARTITION BY source, ticker ORDER BY slot RANGE BETWEEN 59 PRECEDING AND CURRENT ROW)""", "alt")
query("alt_features", "source ticker date:d value:2 zscore_60d:7 change_7d:7", "SELECT * FROM altx", "altx")(lambda m: altdata.engineer_features(m.alt_data))
query("alt_quality", "source coverage_pct:5 stale_tickers:i latest_date:d", "SELECT source, sum(n) / (count(*) * max(nd))::DOUBLE * 100 AS coverage_pct, count(*) FILTER (datediff('day', ld, lastd) > 14) AS stale_tickers, max(lastd) AS latest_date FROM (SELECT source, ticker, count(*) AS n, max(date) AS ld, max(nd) AS nd, max(lastd) AS lastd FROM altx GROUP BY 1, 2) GROUP BY 1", "altx")(lambda m: altdata.data_quality(m.alt_data))
query("alt_composite", "ticker composite_zscore:6 available_sources:i coverage_pct:4 label",
      """SELECT *, a / 5e0 * 100 AS coverage_pct, a AS available_sources, CASE WHEN composite_zscore >= 1 THEN 'Bullish' WHEN composite_zscore <= -1 THEN 'Bearish' ELSE 'Neutral' END AS label FROM (SELECT ticker, sum(w * zscore_60d) / sum(CASE WHEN zscore_60d IS NOT NULL THEN w END) AS composite_zscore, count(zscore_60d) AS a FROM (SELECT *, CASE WHEN source = 'purchase' THEN 2e0 ELSE 1e0 END AS w FROM altx WHERE date = lastd) GROUP BY 1) WHERE composite_zscore IS NOT NULL""", "altx")(
    lambda m: altdata.composite(altdata.engineer_features(m.alt_data), m.table("events").select(F.col("event_type").alias("source")).distinct().withColumn("weight", F.when(F.col("source") == "purchase", 2.0).otherwise(1.0))))

# --- persisted tables --------------------------------------------------------------------
query("tables_ddl", "ticker date:d open:4 high:4 low:4 close:4 volume:4", "SELECT ticker, date, open, high, low, close, volume FROM bars", "bars")(lambda m: _stored(m))


def _stored(m):
    """Bars written with the declared schema, partitioned by year, and read back."""
    path = f"{shared_dir(m.spark)}/price_history-{uuid.uuid4().hex}"
    rows = tables.conform(m.bars, "price_history")
    tables.replace_partitions(rows.withColumn("year", F.year("date")), path, ("year",))
    return m.spark.read.schema(rows.schema).parquet(path)


def batches(m):
    """Stored bars up to 2000, and a later batch that corrects 2000 and adds the rest; its rows
    arrive twice with a sequence."""
    b = m.bars.select("ticker", "date", "close", "volume")
    stored = b.filter(F.col("date") <= "2000-12-31")
    late = b.filter(F.col("date") >= "2000-01-01")
    return stored, late.withColumn("seq", F.lit(1)).unionByName(late.withColumn("close", F.col("close") + 1).withColumn("seq", F.lit(2)))


query("upsert_latest", "ticker date:d close:4 volume:2", "SELECT ticker, date, CASE WHEN date >= DATE '2000-01-01' THEN close + 1 ELSE close END AS close, volume FROM bars", "bars")(
    lambda m: tables.upsert_latest(*batches(m), ("ticker", "date"), "seq"))
query("insert_ignore", "ticker date:d close:4 volume:2", "SELECT ticker, date, close, volume FROM bars", "bars")(lambda m: tables.insert_ignore(*batches(m), ("ticker", "date"), "seq"))


def stock_rows(m):
    c = m.table("customer")
    old = c.filter("c_acctbal < 8000").select(F.col("c_name").alias("ticker"), F.col("c_mktsegment").alias("sector"), F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("company_name"), F.lit("old").alias("updated_at"))
    new = c.filter("c_acctbal > 1000").select(F.col("c_name").alias("ticker"), F.when(F.col("c_acctbal") > 5000, "RICH").alias("sector"), F.col("c_name").alias("company_name"), F.lit("new").alias("updated_at"))
    return old, new


query("upsert_coalesce", "ticker sector company_name updated_at",
      """SELECT c_name AS ticker, CASE WHEN c_acctbal > 5000 THEN 'RICH' WHEN c_acctbal < 8000 THEN c_mktsegment END AS sector, CASE WHEN c_acctbal > 0 THEN c_name END AS company_name, CASE WHEN c_acctbal > 1000 THEN 'new' ELSE 'old' END AS updated_at FROM customer""")(
    lambda m: tables.upsert_coalesce(*stock_rows(m), ("ticker",), ("updated_at",)))


def appended(m):
    path = f"{shared_dir(m.spark)}/news-{uuid.uuid4().hex}"
    tone = filings.news_tone(m.news).select("doc_id", "ticker", "bullish_score", "bearish_score", "importance_score")
    tables.append_rows(tone.filter("importance_score > 30"), path)
    tables.append_rows(tone.filter("importance_score <= 30"), path)
    return m.spark.read.schema(tone.schema).parquet(path)


query("append_rows", "doc_id:i ticker bullish_score:i bearish_score:i importance_score:i", "SELECT *, least(100, 30 + 15 * (bullish_score + bearish_score)) AS importance_score FROM newsx", "newsx")(appended)
query("top_n_recent", "ticker date:d recency:i close:4", "SELECT ticker, date, rn AS recency, close FROM bx WHERE rn <= 10", "bx")(lambda m: tables.top_n_recent(m.bars, ("ticker",), "date"))


def thesis_records(m):
    """Thesis records per supplier nation; some fields are still blank."""
    s = m.table("supplier").join(m.places, F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("ticker")).agg(F.avg("s_acctbal").alias("b"))
    b = F.col("b")
    return s.select("ticker", F.when(b > 5000, "own view").otherwise("Thesis not set yet.").alias("thesis"), F.when(b > 4800, 95.0).alias("stop_loss"), F.when(b > 4000, 101.0).alias("target_price"), F.when(b > 4500, "1 year").otherwise("Unspecified").alias("time_horizon"),
                    F.lit("watching").alias("status"), F.lit(None).cast("double").alias("risk_budget_pct"))


def report_rows(m):
    """Report rows; those of a seventh of the tickers are blank."""
    a = risk.stock_analysis(m.bars, m.benchmark)
    filled = F.substring("ticker", 8, 9).cast("int") % 7 != 3
    t = events.technical_screen(table(m), ind.support_resistance(m.bars)).select("ticker", "setup_type", "support", "resistance")
    return a.join(t, "ticker").join(q_sources.fundamentals(m).select("ticker", "classification"), "ticker").select(
        "ticker", F.col("quant_score").alias("score"), F.when(filled, F.col("quant_label")).alias("rating"), "setup_type", "classification", F.lit("Breakout").alias("reason"), (F.col("quant_score") >= 50).alias("send_alert"),
        F.when(F.col("annualized_volatility") > 0.45, "High").otherwise("Moderate").alias("risk_level"), F.when(filled, F.col("close")).alias("close"), "support", "resistance")


view("trec", "SELECT ticker, b, CASE WHEN b > 5000 THEN 'own view' ELSE 'Thesis not set yet.' END AS thesis, CASE WHEN b > 4800 THEN 95e0 END AS stop_loss, CASE WHEN b > 4000 THEN 101e0 END AS target_price, CASE WHEN b > 4500 THEN '1 year' ELSE 'Unspecified' END AS time_horizon FROM (SELECT n_name AS ticker, avg(s_acctbal) AS b FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)")
query("fill_blanks", "ticker thesis stop_loss:2 target_price:2 time_horizon status risk_budget_pct:2 skipped updated",
      """SELECT r.ticker, CASE WHEN k AND b <= 5000 THEN r.ticker || ' is tracked as a ' || quant_label || ' candidate. Setup: ' || setup_type || '. Fundamentals: ' || classification || '. Why now: Breakout.' ELSE thesis END AS thesis, CASE WHEN k AND stop_loss IS NULL THEN round(support * 0.97e0, 2) ELSE stop_loss END AS stop_loss, CASE WHEN k AND target_price IS NULL THEN round(resistance, 2) ELSE target_price END AS target_price,
 CASE WHEN k AND time_horizon = 'Unspecified' THEN CASE WHEN quant_score >= 50 THEN '1-3 months' ELSE '3-6 months' END ELSE time_horizon END AS time_horizon, 'watching' AS status, CASE WHEN k THEN CASE WHEN annualized_volatility > 0.45 THEN 1 ELSE 2 END END AS risk_budget_pct, NOT k AS skipped, k AS updated FROM trec r LEFT JOIN (SELECT sa.ticker, CASE WHEN CAST(substr(sa.ticker, 8) AS INT) % 7 <> 3 THEN quant_label END AS quant_label, quant_score, annualized_volatility, setup_type, support, resistance, classification FROM sa JOIN tech USING (ticker) JOIN cf USING (ticker)) s USING (ticker), LATERAL (SELECT s.quant_label IS NOT NULL AS k)""", "trec sa tech cf")(
    lambda m: tables.fill_blanks(thesis_records(m), report_rows(m)))

query("join_watchlist_meta", "ticker status active flags close:4 score:i",
      """SELECT coalesce(w.ticker, r.ticker) AS ticker, CASE WHEN w.ticker IS NULL THEN 'removed_from_active_watchlist' ELSE 'watching' END AS status, w.ticker IS NOT NULL AS active, CASE WHEN w.ticker IS NULL THEN '' ELSE concat_ws('|', CASE WHEN thesis = 'Thesis not set yet.' THEN 'missing thesis' END, CASE WHEN close <= stop_loss THEN 'stop level reached' END, CASE WHEN close >= target_price THEN 'target reached' END) END AS flags, close, quant_score AS score
 FROM wl w FULL JOIN trec r ON w.ticker = r.ticker LEFT JOIN (SELECT ticker, close, quant_score FROM sa) s ON s.ticker = coalesce(w.ticker, r.ticker)""", "wl trec sa")(
    lambda m: _meta(m))


def _meta(m):
    from marketloom.plans.q_factors import watchlist
    quant = risk.stock_analysis(m.bars, m.benchmark).select("ticker", "close", F.col("quant_score").alias("score"), F.col("quant_label").alias("rating"))
    return tables.watchlist_report(watchlist(m), thesis_records(m), quant).withColumn("flags", F.array_join("flags", "|"))


query("sector_proxy_lookup", "ticker proxy",
      """SELECT ticker, CASE WHEN sector = 'ASIA' THEN CASE WHEN hot THEN 'EUROPE' ELSE 'AFRICA' END WHEN sector = 'AMERICA' THEN 'AMERICA' ELSE 'AFRICA' END AS proxy FROM (SELECT DISTINCT ticker, sector FROM bars), (SELECT count(*) >= 500 AS hot FROM sect WHERE sector = 'EUROPE')""", "bars sect")(
    lambda m: _proxy(m))


def _proxy(m):
    """ASIA falls back over proxies that may be missing; regions outside the groups use AFRICA."""
    names = m.bars.select("ticker", "sector").distinct()
    arr = lambda *xs: F.array(*[F.lit(x) for x in xs])
    groups = names.filter(F.col("sector").isin("ASIA", "AMERICA")).select("ticker", F.when(F.col("sector") == "ASIA", arr("NONE", "EUROPE", "AFRICA")).otherwise(arr("AMERICA", "AFRICA")).alias("proxies"))
    have = m.sector_proxy.groupBy(F.col("sector").alias("proxy")).agg(F.count(F.lit(1)).alias("n")).filter("n >= 500")
    return tables.proxy_lookup(names, groups, have, "AFRICA")
