"""Queries: portfolio tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketloom.operators import indicators as ind
from marketloom.operators import portfolio as pf
from marketloom.operators import risk
from marketloom.plans import q_risk  # noqa: F401  (views)
from marketloom.plans.registry import query, view
from marketloom.plans.views import roll

QUALITY = "CASE WHEN {0} >= 85 THEN 'Excellent' WHEN {0} >= 70 THEN 'Good' WHEN {0} >= 50 THEN 'Moderate' WHEN {0} >= 30 THEN 'Weak' ELSE 'Poor' END"


def wts(m):
    return pf.weights(m.positions, m.bars)


def matrix(m):
    return pf.price_matrix(m.bars)


def held_pairs(m):
    return pf.holding_pairs(matrix(m), wts(m))


query("price_matrix_ffill", "ticker date:d close:4", "SELECT * FROM pm", "pm")(matrix)
query("weights", "portfolio_id ticker shares:2 value:6 weight:9", "SELECT * FROM wts", "wts")(wts)
query("sector_exposure_map", "portfolio_id sector weight:9", "SELECT portfolio_id, coalesce(sector, 'Unknown') AS sector, sum(weight) AS weight FROM wts GROUP BY 1, 2", "wts")(
    lambda m: pf.sector_exposure(wts(m)))
query("pf_returns", "portfolio_id date:d r:9", "SELECT * FROM pfr", "pfr")(lambda m: pf.portfolio_returns(matrix(m), wts(m)))
view("pfa", "SELECT portfolio_id, date, sum(weight * r) AS r FROM hpma GROUP BY 1, 2", "hpma")
view("pvar", """SELECT portfolio_id, dv AS daily_variance, dv * 21 AS monthly_variance, dv * 252 AS annual_variance, sqrt(dv) AS daily_volatility, sqrt(dv) * sqrt(21) AS monthly_volatility,
 sqrt(dv) * sqrt(252) AS annual_volatility, CASE WHEN sqrt(dv) * sqrt(252) < 0.08 THEN 'Very Low' WHEN sqrt(dv) * sqrt(252) < 0.15 THEN 'Low' WHEN sqrt(dv) * sqrt(252) < 0.25 THEN 'Moderate'
 WHEN sqrt(dv) * sqrt(252) < 0.4 THEN 'High' ELSE 'Very High' END AS risk_classification FROM (
 SELECT h.portfolio_id, sum(w1.weight * w2.weight * cov) AS dv FROM hcov h JOIN wts w1 ON h.a = w1.ticker AND w1.portfolio_id = h.portfolio_id JOIN wts w2 ON h.b = w2.ticker AND w2.portfolio_id = h.portfolio_id GROUP BY 1)""", "hcov", "wts")
query("cov_matrix", "portfolio_id daily_variance:10 monthly_variance:9 annual_variance:8 daily_volatility:8 monthly_volatility:8 annual_volatility:8 risk_classification", "SELECT * FROM pvar", "pvar")(
    lambda m: pf.variance_metrics(matrix(m), wts(m)))
query("cov_matrix_pairs", "a b n:i cov:10", "SELECT * FROM covp WHERE a <= b", "covp")(lambda m: pf.covariance_pairs(matrix(m)))

view("hp", "SELECT portfolio_id, a, b, round(corr, 4) AS correlation FROM hcov WHERE a < b", "hcov")
view("csum", """SELECT portfolio_id, round(avg(correlation), 4) AS average_correlation, max(correlation) AS highest, min(correlation) AS lowest, sum(CASE WHEN correlation >= 0.8 THEN 1 ELSE 0 END) AS redundant,
 sum(CASE WHEN correlation <= 0.3 THEN 1 ELSE 0 END) AS diversifiers FROM hp GROUP BY 1""", "hp")
query("corr_matrix", "portfolio_id a b correlation:4 high_rank:i low_rank:i redundant diversifier average_correlation:4",
      """SELECT hp.*, row_number() OVER (PARTITION BY portfolio_id ORDER BY correlation DESC, a, b) AS high_rank, row_number() OVER (PARTITION BY portfolio_id ORDER BY correlation, a, b) AS low_rank,
 correlation >= 0.8 AS redundant, correlation <= 0.3 AS diversifier, average_correlation FROM hp JOIN csum USING (portfolio_id)""", "hp csum")(
    lambda m: pf.correlation_rows(held_pairs(m)).join(pf.correlation_summary(held_pairs(m)).select("portfolio_id", "average_correlation"), "portfolio_id"))

view("rc", """SELECT portfolio_id, ticker, sector, weight, round(weight * m / sum(weight * m) OVER (PARTITION BY portfolio_id) * 100, 2) AS contribution_pct FROM (
 SELECT w1.portfolio_id, w1.ticker, w1.sector, any_value(w1.weight) AS weight, sum(w2.weight * cov) AS m FROM hcov h JOIN wts w1 ON h.a = w1.ticker AND w1.portfolio_id = h.portfolio_id JOIN wts w2 ON h.b = w2.ticker AND w2.portfolio_id = h.portfolio_id GROUP BY 1, 2, 3)""", "hcov", "wts")
query("risk_contrib", "portfolio_id ticker contribution_pct:2", "SELECT * FROM rc", "rc")(lambda m: pf.risk_contributions(matrix(m), wts(m)))
view("rcr", """SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY contribution_pct DESC, ticker) AS rank, round(weight * 100, 2) AS position_weight_pct,
 CASE WHEN contribution_pct >= 35 THEN 'High' WHEN contribution_pct >= 20 THEN 'Medium' ELSE 'Low' END AS concentration_risk FROM rc""", "rc")
query("risk_contrib_rank", "portfolio_id ticker rank:i contribution_pct:2 position_weight_pct:2 concentration_risk warning",
      "SELECT *, CASE WHEN rank = 1 AND contribution_pct >= 35 THEN printf('%s dominates portfolio risk at %.1f%%.', ticker, contribution_pct) END AS warning FROM rcr", "rcr")(
    lambda m: pf.risk_contribution_rows(pf.risk_contributions(matrix(m), wts(m))))

query("corr_network", "portfolio_id kind a b correlation:4 degree:i",
      """SELECT portfolio_id, 'edge' AS kind, a, b, correlation, NULL AS degree FROM hp WHERE correlation >= 0.02 UNION ALL
 SELECT portfolio_id, 'node', node, NULL, NULL, count(*) FROM (SELECT portfolio_id, unnest([a, b]) AS node FROM hp WHERE correlation >= 0.02) GROUP BY 1, 3""", "hp")(
    lambda m: _network(held_pairs(m), 0.02))


def _network(pairs, threshold):
    # the synthetic returns are close to independent, so the query lowers the 0.70 default
    edges, nodes = pf.network(pairs, threshold)
    e = edges.select("portfolio_id", F.lit("edge").alias("kind"), "a", "b", "correlation", F.lit(None).cast("long").alias("degree"))
    return e.unionByName(nodes.select("portfolio_id", F.lit("node").alias("kind"), F.col("node").alias("a"), F.lit(None).cast("string").alias("b"),
                                      F.lit(None).cast("double").alias("correlation"), "degree"))


view("dv", f"""SELECT *, {QUALITY.format('score')} AS classification FROM (SELECT h.portfolio_id, holdings, hhi, sector_max, average_correlation, lw, lt,
 round(least(greatest(least(holdings / 20e0, 1) * 25 + (1 - hhi) * 35 + greatest(0, 1 - coalesce(average_correlation, 0)) * 25 + greatest(0, 1 - sector_max) * 15, 0), 100), 2) AS score FROM (
 SELECT portfolio_id, count(*) AS holdings, sum(weight * weight) AS hhi, round(max(weight), 12) AS lw, arg_max(ticker, struct_pack(w := round(weight, 12), t := ticker)) AS lt FROM wts GROUP BY 1) h
 JOIN (SELECT portfolio_id, max(w) AS sector_max FROM (SELECT portfolio_id, sector, sum(weight) AS w FROM wts GROUP BY 1, 2) GROUP BY 1) s USING (portfolio_id) LEFT JOIN csum USING (portfolio_id))""", "wts", "csum")
query("diversification", "portfolio_id holdings:i score:2 classification position_concentration:2 largest_ticker largest_weight:2 largest_sector_weight:2",
      "SELECT *, round(hhi * 100, 2) AS position_concentration, lt AS largest_ticker, round(lw * 100, 2) AS largest_weight, round(sector_max * 100, 2) AS largest_sector_weight FROM dv", "dv")(
    lambda m: pf.diversification(wts(m), pf.correlation_summary(held_pairs(m)).select("portfolio_id", "average_correlation")))

view("pfaperf", q_risk.perf_sql("pfa", "portfolio_id"), "pfa")
query("pf_analytics", "portfolio_id annualized_volatility:8 sharpe_ratio:6 max_drawdown:8 diversification_score:2 concentration_risk:2 beta:7 alpha:7",
      """SELECT p.*, round((1 - hhi) * 100, 2) AS diversification_score, round(hhi * 100, 2) AS concentration_risk, beta, actual - beta * mkt AS alpha FROM pfaperf p JOIN (SELECT portfolio_id, sum(weight * weight) AS hhi FROM wts GROUP BY 1) USING (portfolio_id)
 JOIN (SELECT portfolio_id, covar_samp(x.r, b.r) / var_samp(b.r) AS beta, avg(x.r) * 252 AS actual, avg(b.r) * 252 AS mkt FROM pfa x JOIN benchx b USING (date) WHERE b.r IS NOT NULL GROUP BY 1) USING (portfolio_id)""", "pfaperf wts pfa benchx")(
    lambda m: pf.analytics(matrix(m), wts(m), m.benchmark))

view("drf", """SELECT *, (weight - target) * 100 AS drift FROM (SELECT *, 1e0 / count(*) OVER (PARTITION BY portfolio_id) AS target FROM wts)""", "wts")
query("drift", "portfolio_id ticker current_weight_pct:2 target_weight_pct:2 drift_pct:2 status",
      """SELECT *, round(weight * 100, 2) AS current_weight_pct, round(target * 100, 2) AS target_weight_pct, round(drift, 2) AS drift_pct, CASE WHEN abs(drift) >= 2 THEN 'rebalance_watch' ELSE 'in_band' END AS status FROM drf""", "drf")(
    lambda m: pf.drift(wts(m)))

query("turnover", "portfolio_id turnover_pct:4",
      """SELECT portfolio_id, sum(abs(coalesce(b, 0) - a)) / 2 AS turnover_pct FROM (SELECT portfolio_id, round(weight * 100, 2) AS a, CASE WHEN weight <= 1.5e0 * avg(weight) OVER (PARTITION BY portfolio_id) THEN round(100e0 / count(*) OVER (PARTITION BY portfolio_id), 2) END AS b FROM wts) GROUP BY 1""", "wts")(
    lambda m: pf.turnover(wts(m).withColumn("weight_pct", F.round(F.col("weight") * 100, 2)), targets(m)))


def targets(m):
    """Equal weights; a holding of one and a half times the mean weight or more has no target."""
    own = Window.partitionBy("portfolio_id")
    return wts(m).withColumn("weight_pct", F.when(F.col("weight") <= 1.5 * F.avg("weight").over(own), F.round(100 / F.count(F.lit(1)).over(own), 2)))

view("tsr", f"""SELECT *, {roll('stddev_samp', 'r', 21, None, 'portfolio_id')} * sqrt(252) AS rolling_vol, {roll('avg', 'r', 63, None, 'portfolio_id')} / nullif({roll('stddev_samp', 'r', 63, None, 'portfolio_id')}, 0) * sqrt(252) AS rolling_sharpe FROM pfr""", "pfr")
query("rolling_sharpe", "portfolio_id date:d rolling_vol:8 rolling_sharpe:6", "SELECT * FROM tsr", "tsr")(
    lambda m: pf.time_series_rows(pf.portfolio_returns(matrix(m), wts(m))))


def trend_sql(src, key, value, up="Rising", down="Falling"):
    return f"""SELECT {key}, nv, recent, prior, CASE WHEN nv < 10 THEN 'Unknown' WHEN recent > prior * 1.1e0 THEN '{up}' WHEN recent < prior * 0.9e0 THEN '{down}' ELSE 'Stable' END AS trend FROM (
 SELECT {key}, max(nn) AS nv, avg(CASE WHEN rn <= 5 THEN v END) AS recent, avg(CASE WHEN rn <= least(nn, 20) AND rn > least(nn, 20) - 10 THEN v END) AS prior FROM (
 SELECT {key}, {value} AS v, row_number() OVER (PARTITION BY {key} ORDER BY date DESC) AS rn, count(*) OVER (PARTITION BY {key}) AS nn FROM {src} WHERE {value} IS NOT NULL) GROUP BY {key})"""


view("vtr", trend_sql("tsr", "portfolio_id", "rolling_vol"), "tsr")
query("trend_label", "portfolio_id series recent:7 prior:7 trend",
      f"SELECT 'volatility' AS series, * FROM vtr UNION ALL SELECT 'sharpe' AS series, * FROM ({trend_sql('tsr', 'portfolio_id', 'rolling_sharpe', 'Improving', 'Deteriorating')})", "vtr tsr")(
    lambda m: pf.trend_label(_ts(m), "rolling_vol", ("portfolio_id",)).withColumn("series", F.lit("volatility")).unionByName(
        pf.trend_label(_ts(m), "rolling_sharpe", ("portfolio_id",), "Improving", "Deteriorating").withColumn("series", F.lit("sharpe"))))


def _ts(m):
    return pf.time_series_rows(pf.portfolio_returns(matrix(m), wts(m)))


def sector_pairs(m):
    """Candidate pairs: neighbours within a region."""
    n = m.table("nation")
    a = n.select(F.col("n_nationkey").alias("ka"), F.col("n_regionkey").alias("g"), F.col("n_name").alias("a"))
    b = n.select((F.col("n_nationkey") - 5).alias("ka"), F.col("n_regionkey").alias("g"), F.col("n_name").alias("b"))
    return a.join(b, ["ka", "g"]).join(m.table("region"), F.col("g") == F.col("r_regionkey")).select("a", "b", F.col("r_name").alias("sector"))


view("peers", """SELECT a.n_name AS a, b.n_name AS b, r_name AS sector FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 5 AND a.n_regionkey = b.n_regionkey JOIN region ON a.n_regionkey = r_regionkey""")
view("rcorr", f"""SELECT date, avg(c) AS average_correlation FROM (SELECT a, b, date, CASE WHEN count(*) OVER w >= 63 THEN corr(ra, rb) OVER w END AS c FROM (
 SELECT p.a, p.b, x.date, x.r AS ra, y.r AS rb FROM peers p JOIN pma x ON x.ticker = p.a JOIN pma y ON y.ticker = p.b AND x.date = y.date)
 WINDOW w AS (PARTITION BY a, b ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)) WHERE c IS NOT NULL GROUP BY date""", "peers", "pma")
query("rolling_pair_corr", "date:d average_correlation:7", "SELECT * FROM rcorr", "rcorr")(lambda m: pf.rolling_correlation(matrix(m), sector_pairs(m)))
query("rolling_pair_corr_trend", "latest:4 trend",
      """SELECT round(l, 4) AS latest, CASE WHEN n < 5 THEN 'Unknown' WHEN l > p * 1.1e0 THEN 'Rising' WHEN l < p * 0.9e0 THEN 'Falling' ELSE 'Stable' END AS trend FROM (
 SELECT count(*) AS n, avg(CASE WHEN rn <= 5 THEN average_correlation END) AS l, avg(CASE WHEN rn > k - 10 THEN average_correlation END) AS p FROM (
 SELECT *, row_number() OVER (ORDER BY date DESC) AS rn, least(count(*) OVER (), 20) AS k FROM rcorr) WHERE rn <= 20)""", "rcorr")(
    lambda m: pf.rolling_correlation_trend(pf.rolling_correlation(matrix(m), sector_pairs(m))))

view("pmx", """SELECT d.portfolio_id, annual_volatility, d.score AS diversification_score, d.average_correlation, lt AS largest_ticker, round(lw * 100, 2) AS largest_weight, round(sector_max * 100, 2) AS largest_sector_weight,
 top_risk, top_risk_ticker, cagr, sharpe_ratio, max_drawdown, value_at_risk, conditional_value_at_risk, v.trend AS volatility_trend, risk_direction
 FROM dv d JOIN pvar USING (portfolio_id) JOIN (SELECT portfolio_id, max(contribution_pct) AS top_risk, arg_max(ticker, struct_pack(c := contribution_pct, t := ticker)) AS top_risk_ticker FROM rc GROUP BY 1) USING (portfolio_id)
 JOIN pfperf USING (portfolio_id) JOIN pftail USING (portfolio_id) JOIN vtr v USING (portfolio_id) JOIN acx USING (portfolio_id)""", "dv", "pvar", "rc", "pfperf", "pftail", "vtr", "acx")


def metrics(m):
    return pf.metrics(m.positions, m.bars)


view("phealth", f"""SELECT *, {QUALITY.format('health_score')} AS health FROM (SELECT *, round(least(greatest(100 - least(annual_volatility / 0.5e0, 1) * 20 + least(greatest(sharpe_ratio, 0) / 2, 1) * 20 - least(abs(max_drawdown) / 0.4e0, 1) * 20
 - least(average_correlation / 0.9e0, 1) * 15 + diversification_score * 0.25e0 - CASE WHEN top_risk > 40 THEN 15 WHEN top_risk > 30 THEN 8 ELSE 0 END, 0), 100), 2) AS health_score,
 concat_ws('|', CASE WHEN sharpe_ratio >= 1 THEN 'Strong risk-adjusted return' END, CASE WHEN diversification_score >= 70 THEN 'Diversification profile is healthy' END, CASE WHEN abs(max_drawdown) <= 0.15 THEN 'Drawdown has been contained' END) AS strengths,
 concat_ws('|', CASE WHEN sharpe_ratio < 1 THEN 'Sharpe ratio is not yet strong' END, CASE WHEN diversification_score < 70 THEN 'Diversification can improve' END, CASE WHEN abs(max_drawdown) > 0.15 THEN 'Drawdown risk is meaningful' END,
  CASE WHEN top_risk > 35 THEN 'One position contributes too much portfolio risk' END) AS weaknesses FROM pmx)""", "pmx")
query("pf_health", "portfolio_id health_score:2 health strengths weaknesses", "SELECT * FROM phealth", "phealth")(
    lambda m: pf.health(metrics(m)).withColumn("strengths", F.array_join("strengths", "|")).withColumn("weaknesses", F.array_join("weaknesses", "|")))

view("pwarn", """SELECT *, concat_ws('|', CASE WHEN top_risk >= 35 THEN printf('%s contributes %.1f%% of portfolio variance.', top_risk_ticker, top_risk) END, CASE WHEN largest_weight >= 20 THEN printf('%s is %.1f%% of portfolio value.', largest_ticker, largest_weight) END,
 CASE WHEN largest_sector_weight >= 35 THEN printf('Largest sector exposure is %.1f%%.', largest_sector_weight) END, CASE WHEN average_correlation >= 0.65 THEN printf('Average holding correlation is elevated at %.2f.', average_correlation) END,
 CASE WHEN conditional_value_at_risk <= -0.03 THEN printf('Historical one-day CVaR is %.2f%%.', conditional_value_at_risk * 100) END) AS warnings,
 CASE WHEN top_risk >= 40 THEN 80 WHEN volatility_trend = 'Rising' THEN 75 WHEN risk_direction = 'Increasing' THEN 70 WHEN diversification_score < 50 THEN 65 ELSE 0 END AS strength FROM pmx""", "pmx")
query("pf_warnings", "portfolio_id warnings send_alert reason strength:i",
      """SELECT *, strength > 0 AS send_alert, CASE strength WHEN 80 THEN 'Risk concentration' WHEN 75 THEN 'Portfolio volatility spike' WHEN 70 THEN 'Forecasted volatility increase' WHEN 65 THEN 'Diversification weakness' ELSE 'No clear portfolio Why Now trigger' END AS reason FROM pwarn""", "pwarn")(
    lambda m: pf.warnings_and_trigger(metrics(m)).withColumn("warnings", F.array_join("warnings", "|")))
query("pf_report", "portfolio_id annual_volatility:8 cagr:7 sharpe_ratio:6 max_drawdown:8 value_at_risk:8 conditional_value_at_risk:8 average_correlation:4 diversification_score:2 largest_sector_weight:2 top_risk_ticker top_risk:2 volatility_trend risk_direction health_score:2 health warnings strength:i",
      "SELECT h.*, w.warnings, w.strength FROM phealth h JOIN pwarn w USING (portfolio_id)", "phealth pwarn")(
    lambda m: pf.warnings_and_trigger(pf.health(metrics(m))).withColumn("warnings", F.array_join("warnings", "|")))

view("b1m", "SELECT (max(CASE WHEN rn = 1 THEN close END) / max(CASE WHEN rn = 21 THEN close END) - 1) * 100 AS bpct FROM benchx", "benchx")


def bench_month(m):
    one = m.benchmark.orderBy(F.desc("date")).limit(21)
    return one.agg(((F.max_by("close", "date") / F.min_by("close", "date") - 1) * 100).alias("benchmark_return_pct"))


def tilt(m):
    """Momentum exposure per portfolio: weight-averaged positive-horizon share."""
    return wts(m).join(risk.momentum_horizons(m.bars), "ticker").groupBy("portfolio_id").agg(F.round(F.sum(F.col("weight") * F.col("momentum_score")), 2).alias("momentum"))


view("mtilt", "SELECT portfolio_id, round(sum(weight * momentum_score), 2) AS momentum FROM wts JOIN momh USING (ticker) GROUP BY 1", "wts", "momh")
query("attribution", "portfolio_id benchmark_return_pct:6 relative:6 sector_allocation_effect:2 factor_exposure_effect:2 alpha_unexplained_return:2",
      """SELECT *, round(relative - (momentum - 50) * 0.05e0 - greatest(largest_sector_weight - 25, 0) * 0.03e0, 2) AS alpha_unexplained_return FROM (SELECT *, bpct AS benchmark_return_pct, CASE WHEN abs(cagr) <= 1 THEN cagr * 100 ELSE cagr END - bpct AS relative,
 CASE WHEN largest_sector_weight > 25 THEN round((largest_sector_weight - 25) * 0.03e0, 2) ELSE 0 END AS sector_allocation_effect, round((momentum - 50) * 0.05e0, 2) AS factor_exposure_effect FROM pmx JOIN mtilt USING (portfolio_id), b1m)""", "pmx mtilt b1m")(
    lambda m: pf.attribution(metrics(m), bench_month(m), tilt(m)))

# a regime row for the checks: bear when the benchmark's last 21 rows fell more than 3 %
query("assumption_checks", "portfolio_id assumption status evidence",
      """SELECT portfolio_id, unnest(['volatility', 'correlation', 'regime']) AS assumption, unnest([CASE WHEN annual_volatility >= 0.35 THEN 'Breaking' WHEN annual_volatility >= 0.25 THEN 'Watch' ELSE 'OK' END,
 CASE WHEN average_correlation >= 0.75 THEN 'Breaking' WHEN average_correlation >= 0.6 THEN 'Watch' ELSE 'OK' END, CASE WHEN regime = 'Bear Trend' THEN 'Watch' ELSE 'OK' END]) AS status,
 unnest([printf('Portfolio annual volatility is %.1f%%.', annual_volatility * 100), printf('Average correlation is %.2f.', average_correlation), 'Current regime is ' || regime || '.']) AS evidence
 FROM pmx, (SELECT CASE WHEN bpct < -3 THEN 'Bear Trend' ELSE 'Sideways' END AS regime FROM b1m)""", "pmx b1m")(
    lambda m: pf.assumption_checks(metrics(m), bench_month(m).select(F.when(F.col("benchmark_return_pct") < -3, "Bear Trend").otherwise("Sideways").alias("regime"))))


def candidates(m):
    """Candidate vectors: each portfolio's weights, and its equal-weight and inverse twins."""
    w = wts(m)
    by = Window.partitionBy("portfolio_id")
    inv = (1 / F.col("weight")) / F.sum(1 / F.col("weight")).over(by)
    kinds = F.array(F.struct(F.lit("current").alias("kind"), F.col("weight").alias("weight")),
                    F.struct(F.lit("equal").alias("kind"), (1 / F.count(F.lit(1)).over(by)).alias("weight")),
                    F.struct(F.lit("inverse").alias("kind"), inv.alias("weight")))
    return w.withColumn("k", kinds).select("portfolio_id", "ticker", F.inline("k")).select(
        F.concat_ws(":", "portfolio_id", "kind").alias("set_id"), "ticker", "weight")


view("cnd", """SELECT *, (annual_return - 0.045e0) / annual_volatility AS sharpe, floor(round(annual_volatility, 9) / 0.01e0) AS vb FROM (
 SELECT set_id, avg(r) * 252 AS annual_return, sqrt(greatest(var_samp(r) * 252, 1e-12)) AS annual_volatility FROM (SELECT set_id, date, sum(w * r) AS r FROM (
  SELECT portfolio_id, portfolio_id || ':current' AS set_id, ticker, weight AS w FROM wts UNION ALL SELECT portfolio_id, portfolio_id || ':equal', ticker, 1e0 / count(*) OVER (PARTITION BY portfolio_id) FROM wts
  UNION ALL SELECT portfolio_id, portfolio_id || ':inverse', ticker, (1 / weight) / sum(1 / weight) OVER (PARTITION BY portfolio_id) FROM wts) JOIN hpma USING (portfolio_id, ticker) GROUP BY 1, 2) GROUP BY 1)""", "wts", "hpma")
query("weight_candidates", "set_id annual_return:8 annual_volatility:8 sharpe:6 is_best on_frontier",
      """SELECT *, set_id = (SELECT arg_max(set_id, struct_pack(s := round(sharpe, 9), t := set_id)) FROM cnd) AS is_best, set_id = arg_max(set_id, struct_pack(s := round(annual_return, 9), t := set_id)) OVER (PARTITION BY vb) AS on_frontier FROM cnd""", "cnd")(
    lambda m: pf.score_candidates(matrix(m), candidates(m)))

query("pf_fit", "portfolio_id ticker sector sector_weight:2 assessment",
      """SELECT u.portfolio_id, u.ticker, u.sector, coalesce(sw, 0) AS sector_weight, CASE WHEN h.ticker IS NOT NULL THEN 'Already held; monitor risk contribution and thesis quality.' WHEN coalesce(sw, 0) > 35 THEN 'May increase sector concentration risk.'
 ELSE 'Potential diversifier; evaluate correlation and volatility before adding.' END AS assessment FROM (SELECT portfolio_id, ticker, sector FROM pos) u LEFT JOIN (SELECT portfolio_id, ticker FROM wts WHERE CAST(substr(ticker, 8) AS INT) % 5 <> 4) h USING (portfolio_id, ticker)
 LEFT JOIN (SELECT portfolio_id, sector, round(sum(weight) * 100, 2) AS sw FROM (SELECT portfolio_id, sector, shares * price / sum(shares * price) OVER (PARTITION BY portfolio_id) AS weight FROM wts JOIN lastpx USING (ticker) WHERE CAST(substr(ticker, 8) AS INT) % 5 <> 4) GROUP BY 1, 2) sx ON sx.portfolio_id = u.portfolio_id AND sx.sector = u.sector""", "pos wts lastpx")(
    lambda m: pf.portfolio_fit(m.positions.select("portfolio_id", "ticker", "sector"), pf.weights(m.positions.withColumn("shares", F.when(F.substring("ticker", 8, 9).cast("int") % 5 != 4, F.col("shares"))), m.bars)))

query("pf_positions_pnl", "portfolio_id ticker shares:2 cost_basis:8 price:4 market_value:4 unrealized_pnl:4 unrealized_return_pct:7 data_quality",
      """SELECT *, shares * price AS market_value, (price - cost_basis) * shares AS unrealized_pnl, price / cost_basis - 1 AS unrealized_return_pct, 'actual_position' AS data_quality FROM pos LEFT JOIN lastpx USING (ticker)""", "pos lastpx")(
    lambda m: pf.positions_pnl(m.positions, m.bars))

view("top3", "SELECT portfolio_id, string_agg(ticker, '|' ORDER BY rank) AS top3 FROM rcr WHERE rank <= 3 GROUP BY 1", "rcr")


def scenario_input(m):
    rows = pf.risk_contribution_rows(pf.risk_contributions(matrix(m), wts(m))).filter(F.col("rank") <= 3)
    top = rows.groupBy("portfolio_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "ticker"))), lambda s: s["ticker"]), "|").alias("top3"))
    return pf.variance_metrics(matrix(m), wts(m)).join(top, "portfolio_id")


SC = ", ".join(f"('{n}', {'NULL' if s is None else repr(s) + '::DOUBLE'})" for n, s in risk.SCENARIOS)
view("scen", f"""SELECT portfolio_id, scenario, top3, round(s * 100, 2) AS estimated_return, round(least(s * 1.25e0, s) * 100, 2) AS estimated_drawdown, round(abs(s) * 100 + annual_volatility * 25, 2) AS estimated_vol_change FROM (
 SELECT *, coalesce(shock, -annual_volatility * 0.35e0) AS s FROM pvar JOIN top3 USING (portfolio_id), (VALUES {SC}) AS v(scenario, shock))""", "pvar", "top3")
query("scenario_table", "portfolio_id scenario estimated_return:2 estimated_drawdown:2 estimated_vol_change:2 top3", "SELECT * FROM scen", "scen")(
    lambda m: risk.scenario_table(scenario_input(m)))
EV = ", ".join(f"('{e}', '{s}')" for e, s in risk.STRESS_EVENTS)
query("stress_events", "portfolio_id event estimated_return:2 estimated_drawdown:2 top3", f"SELECT * FROM scen JOIN (VALUES {EV}) AS v(event, source) ON source = scenario", "scen")(
    lambda m: risk.stress_events(risk.scenario_table(scenario_input(m))))

view("base0", q_risk.perf_sql("pfr", "portfolio_id"), "pfr")
view("vt", """SELECT portfolio_id || ':' || CAST(t AS VARCHAR) AS k, date, r * coalesce(lag(CASE WHEN rolling_vol IS NOT NULL THEN least(t / nullif(rolling_vol, 0), 2) END) OVER (PARTITION BY portfolio_id, t ORDER BY date), 0) AS r FROM tsr, (VALUES (0.05::DOUBLE), (0.1::DOUBLE), (0.15::DOUBLE), (0.2::DOUBLE)) AS v(t)""", "tsr")
query("vol_target", "portfolio_id target:2 cagr:4 sharpe_ratio:4 sortino_ratio:4 max_drawdown:4 sharpe_improvement:4 drawdown_reduction:4",
      f"""SELECT *, round(sharpe_ratio, 4) - round(bs, 4) AS sharpe_improvement, abs(round(bd, 4)) - abs(round(max_drawdown, 4)) AS drawdown_reduction FROM (SELECT p.*, split_part(k, ':', 1) AS portfolio_id, CAST(split_part(k, ':', 2) AS DOUBLE) AS target FROM ({q_risk.perf_sql('vt', 'k')}) p)
 JOIN (SELECT portfolio_id, sharpe_ratio AS bs, max_drawdown AS bd FROM base0) USING (portfolio_id)""", "vt base0")(
    lambda m: vol_target_report(m))


def vol_target_report(m):
    series = pf.portfolio_returns(matrix(m), wts(m))
    key = ("portfolio_id",)
    base = risk.performance_report(series, key).select("portfolio_id", F.col("sharpe_ratio").alias("bs"), F.col("max_drawdown").alias("bd"))
    legs = ind.vol_target_returns(series, (0.05, 0.10, 0.15, 0.20), keys=key)
    out = risk.performance_report(legs, ("portfolio_id", "target")).join(base, "portfolio_id")
    return out.withColumn("sharpe_improvement", F.col("sharpe_ratio") - F.col("bs")).withColumn("drawdown_reduction", F.abs("bd") - F.abs("max_drawdown"))
