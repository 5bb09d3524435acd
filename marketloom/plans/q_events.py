"""Queries: events over ordered rows."""

from pyspark.sql import functions as F

from marketloom.functions.rolling import with_position
from marketloom.operators import events, risk
from marketloom.operators import indicators as ind
from marketloom.operators import portfolio as pf
from marketloom.plans import q_portfolio  # noqa: F401  (views)
from marketloom.plans.registry import query, view
from marketloom.plans.views import cdf, ema, roll, rsi
from marketloom.session import keep

T = "(PARTITION BY ticker ORDER BY date)"


def table(m):
    """One indicator table for all the reports of a session that read it."""
    return keep(ind.indicator_table(m.bars, m.benchmark))


query("golden_cross", "ticker date:d close:4 sma50:8 sma200:8",
      f"""SELECT * FROM (SELECT *, lag(sma50) OVER {T} AS p50, lag(sma200) OVER {T} AS p200 FROM (SELECT ticker, date, close, {roll('avg', 'close', 50)} AS sma50, {roll('avg', 'close', 200)} AS sma200 FROM bars))
 WHERE sma50 > sma200 AND p50 <= p200""", "bars")(lambda m: events.golden_cross(m.bars))

view("i0", """SELECT x.*, b.close AS bench_close, x.close / b.close AS rs_line, CASE WHEN x.close - prev > 0 THEN x.close - prev WHEN prev IS NOT NULL THEN 0 END AS up, CASE WHEN x.close - prev < 0 THEN prev - x.close WHEN prev IS NOT NULL THEN 0 END AS down,
 greatest(high - low, coalesce(abs(high - prev), 0), coalesce(abs(low - prev), 0)) AS tr FROM bx x JOIN bench b USING (date)""", "bx", "bench")
view("i1", f"""SELECT *, {', '.join(f"{roll('avg', 'close', n)} AS sma{n}" for n in (20, 50, 200))}, {', '.join(f"{ema('close', n)} AS ema{n}" for n in (20, 50, 200))}, {ema('close', 12)} - {ema('close', 26)} AS macd,
 {roll('avg', 'tr', 14)} AS atr, {roll('max', 'close', 252, 1)} AS high_52w, {roll('min', 'close', 252, 1)} AS low_52w, {roll('avg', 'volume', 20)} AS vol_avg, {roll('avg', 'rs_line', 50)} AS rs_sma50, {roll('avg', 'rs_line', 20)} AS rs_sma20,
 {rsi('up', 'down')} AS rsi, close / lag(close, 20) OVER {T} * 100 - 100 AS roc_20 FROM i0""", "i0")
view("i2", f"""SELECT *, {ema('macd', 9)} AS macd_signal, volume / nullif(vol_avg, 0) AS rv, (rs_line / rs_sma50 - 1) * 100 AS mrs, (close - sma20) / nullif(atr, 0) AS dist_sma20 FROM i1""", "i1")
view("i3", f"""SELECT *, {', '.join(f'lag({c}) OVER {T} AS p_{c}' for c in ('sma20', 'sma50', 'sma200', 'macd', 'macd_signal', 'mrs'))} FROM i2""", "i2")
view("ind", """SELECT i3.*, w.rsi AS rsi_weekly, mo.rsi AS rsi_monthly, coalesce(sma50 > sma200 AND p_sma50 <= p_sma200, false) AS golden_cross, coalesce(mrs > 0 AND p_mrs <= 0, false) AS rs_breakout
 FROM i3 ASOF LEFT JOIN weekly w ON i3.ticker = w.ticker AND i3.date >= w.label ASOF LEFT JOIN monthly mo ON i3.ticker = mo.ticker AND i3.date >= mo.label""", "i3", "weekly", "monthly")

query("join_asof_ffill", "ticker date:d rsi_weekly:7 rsi_monthly:7", "SELECT * FROM ind", "ind")(
    lambda m: ind.asof_ffill(ind.asof_ffill(m.bars, ind.period_rsi(m.bars, "W"), "rsi", "rsi_weekly"), ind.period_rsi(m.bars, "ME"), "rsi", "rsi_monthly"))
query("indicator_table", "ticker date:d sma20:8 sma200:8 ema50:7 macd:7 macd_signal:7 roc_20:7 rv:8 mrs:7 atr:8 dist_sma20:7 rsi:7 rsi_weekly:7 rsi_monthly:7 high_52w:4 low_52w:4 golden_cross rs_breakout",
      "SELECT * FROM ind", "ind")(table)

CROSS = (("price above SMA50", "close > sma50 AND prev <= p_sma50"), ("price below SMA50", "close < sma50 AND prev >= p_sma50"), ("price above SMA200", "close > sma200 AND prev <= p_sma200"),
         ("price below SMA200", "close < sma200 AND prev >= p_sma200"), ("golden cross", "sma50 > sma200 AND p_sma50 <= p_sma200"), ("MACD bullish", "macd > macd_signal AND p_macd <= p_macd_signal"),
         ("RS breakout", "mrs > 0 AND p_mrs <= 0"))
query("cross_events", "ticker date:d event", " UNION ALL ".join(f"SELECT ticker, date, '{t}' AS event FROM i3 WHERE {c}" for t, c in CROSS), "i3")(lambda m: events.cross_events(table(m)))

view("tech", """SELECT i.ticker, i.sector, i.date, i.rsi, i.rv, i.close, i.sma50, i.sma200, i.high_52w, coalesce(macd > macd_signal AND p_macd <= p_macd_signal, false) AS macd_cross, coalesce(i.close >= high_52w * 0.98e0, false) AS breakout,
 coalesce(i.close >= high_52w * 0.995e0, false) AS new_52w_high, coalesce(i.close > sma50, false) AS price_above_sma50, coalesce(i.close > sma200, false) AS price_above_sma200,
 coalesce(nullif(concat_ws(', ', CASE WHEN i.close >= high_52w * 0.98e0 THEN '52-week high pressure' END, CASE WHEN macd > macd_signal AND p_macd <= p_macd_signal THEN 'MACD bullish crossover' END,
  CASE WHEN i.close > sma50 AND sma50 > sma200 THEN 'trend continuation' END, CASE WHEN rv >= 1.5 THEN 'volume surge' END), ''), 'No clear setup') AS setup_type, sr.support, sr.resistance, sr.risk_reward
 FROM ind i JOIN sr USING (ticker) WHERE i.rn = 1""", "ind", "sr")
query("technical_screen", "ticker rsi:7 macd_cross breakout new_52w_high rv:7 price_above_sma50 price_above_sma200 setup_type support:4 resistance:4", "SELECT * FROM tech", "tech")(
    lambda m: events.technical_screen(table(m), ind.support_resistance(m.bars)))


def latest_benchmark(m):
    """One row: is the benchmark below its 200-row mean?"""
    last = m.benchmark.orderBy(F.desc("date")).limit(200)
    off = F.max_by("close", "date") < F.avg("close")
    return last.agg(F.when(off, "Risk-off").otherwise("Neutral").alias("risk_environment"))


view("renv", "SELECT CASE WHEN arg_max(close, date) < avg(close) THEN 'Risk-off' ELSE 'Neutral' END AS risk_environment FROM benchx WHERE rn <= 200", "benchx")
query("why_now", "ticker send_alert reason strength:i invalidates trigger_count:i signal_type",
      """SELECT ticker, strength >= 50 AS send_alert, CASE WHEN strength >= 50 THEN reason ELSE 'No clear Why Now trigger' END AS reason, CASE WHEN strength >= 50 THEN strength ELSE 0 END AS strength, CASE WHEN strength >= 50 THEN inv ELSE 'N/A' END AS invalidates, trigger_count,
 CASE WHEN strength < 50 THEN 'watchlist_change' ELSE CASE reason WHEN 'Breakout' THEN 'breakout' WHEN 'Relative strength acceleration' THEN 'relative_strength' WHEN 'Volume spike' THEN 'volume_spike' WHEN 'Rank improvement' THEN 'rank_improvement'
  WHEN 'Pullback to support' THEN 'pullback_to_support' ELSE 'watchlist_change' END END AS signal_type FROM (
 SELECT ticker, coalesce(b.s, 0) AS strength, coalesce(b.t, '') AS reason, coalesce(b.v, '') AS inv, len(l) AS trigger_count FROM (SELECT ticker, list_filter(l0, lambda x: x.s IS NOT NULL) AS l, list_sort(list_filter(l0, lambda x: x.s IS NOT NULL), 'DESC')[1] AS b FROM (
 SELECT i.ticker, [struct_pack(s := CASE WHEN (i.close > sma50 AND prev <= p_sma50) OR (i.close > sma200 AND prev <= p_sma200) THEN 75 - d END, p := 0, t := 'Breakout', v := 'Close back below the reclaimed moving average'),
  struct_pack(s := CASE WHEN mrs > 0 AND p_mrs <= 0 THEN 80 - d END, p := -1, t := 'Relative strength acceleration', v := 'Relative strength falls back below its signal line'), struct_pack(s := CASE WHEN i.rv >= 1.8 THEN 70 - d END, p := -2, t := 'Volume spike', v := 'Volume fades and price cannot hold the move'),
  struct_pack(s := CASE WHEN i.close >= high_52w * 0.995e0 THEN 65 - d END, p := -3, t := '52-week high', v := 'Failed breakout below prior range high'), struct_pack(s := CASE WHEN sr.risk_reward >= 2 AND i.close > coalesce(sma50, 0) THEN 55 - d END, p := -4, t := 'Pullback to support', v := 'Support breaks on heavy volume'),
  struct_pack(s := CASE WHEN sa.quant_score - sa.momentum_score * 0.8e0 >= 10 THEN 85 - d END, p := -5, t := 'Rank improvement', v := 'Score falls back below prior level')] AS l0
 FROM ind i JOIN sr USING (ticker) JOIN (SELECT ticker, quant_score, momentum_score FROM sa) sa USING (ticker), (SELECT CASE WHEN risk_environment = 'Risk-off' THEN 25 ELSE 0 END AS d FROM renv) WHERE i.rn = 1)))""", "ind sr sa renv")(
    lambda m: events.why_now(table(m), risk.stock_analysis(m.bars, m.benchmark).select("ticker", F.col("quant_score").alias("final_score"), (F.col("momentum_score") * 0.8).alias("previous_score")).join(
        ind.support_resistance(m.bars).select("ticker", "risk_reward"), "ticker"), latest_benchmark(m)))


def stored_state(m, back):
    """State stored `back` rows before the latest, for the tickers with volume above half normal."""
    t = with_position(table(m))
    return t.filter((F.col("rn") == back) & (F.col("rv") >= 0.5))


query("state_transitions", "ticker alerts",
      """SELECT c.ticker, CASE WHEN p.ticker IS NULL THEN 'Initial data recorded. Monitoring for transitions.' ELSE concat_ws('|', CASE WHEN c.st AND NOT p.st THEN 'Entered Stage # alignment' WHEN NOT c.st AND p.st THEN 'Exited Stage # alignment' END,
 CASE WHEN coalesce(c.mrs, 0) > 0 AND p.mrs <= 0 THEN 'RS breakout vs benchmark' WHEN coalesce(c.mrs, 0) < 0 AND p.mrs >= 0 THEN 'RS breakdown vs benchmark' END, CASE WHEN coalesce(c.rv, 1) >= 2 AND p.rv < 2 THEN 'Volume spike: #x normal' END,
 CASE WHEN c.close > c.sma200 AND p.close <= p.sma200 THEN 'Price crossed above SMA#' WHEN c.close < c.sma200 AND p.close >= p.sma200 THEN 'Price crossed below SMA#' END,
 CASE WHEN c.close > c.sma50 AND p.close <= p.sma50 THEN 'Price crossed above SMA#' WHEN c.close < c.sma50 AND p.close >= p.sma50 THEN 'Price crossed below SMA#' END,
 CASE WHEN c.rsi_monthly > 40 AND p.rsi_monthly <= 40 THEN 'Monthly RSI crossed above #' END, CASE WHEN c.rsi_weekly < 40 AND p.rsi_weekly >= 40 THEN 'Weekly RSI crossed below #' END,
 CASE WHEN c.close >= c.high_52w AND p.close < p.high_52w THEN 'New #-week high' END, CASE WHEN c.close <= c.low_52w AND p.close > p.low_52w THEN 'New #-week low' END) END AS alerts FROM
 (SELECT *, coalesce(close > sma50 AND sma50 > sma200, false) AS st FROM ind WHERE rn = 1) c LEFT JOIN (SELECT *, close > sma50 AND sma50 > sma200 AS st FROM (SELECT ticker, close, coalesce(sma50, 0) AS sma50, coalesce(sma200, 0) AS sma200,
 coalesce(rsi_weekly, 50) AS rsi_weekly, coalesce(rsi_monthly, 50) AS rsi_monthly, coalesce(mrs, 0) AS mrs, coalesce(rv, 1) AS rv, high_52w, low_52w FROM ind WHERE rn = 22 AND rv >= 0.5)) p USING (ticker)""", "ind")(
    lambda m: events.state_transitions(with_position(table(m)).filter(F.col("rn") == 1), events.state_row(stored_state(m, 22))).withColumn(
        "alerts", F.when(F.col("before").isNull(), F.col("alerts")[0]).otherwise(
            F.regexp_replace(F.array_join("alerts", "|"), "(?<![A-Za-z])-?[0-9][0-9.]*|(?<=SMA)[0-9]+", "#")).cast("string")))

view("hs", f"""SELECT ticker, sector, date, close AS entry_price, unnest(list_filter([CASE WHEN prev <= p50 AND close > sma50 AND close > sma200 THEN 'sma50_reclaim' END, CASE WHEN close >= h252 * 0.995e0 AND volume > vol_avg * 1.2e0 THEN 'high_volume_52w_breakout' END,
 CASE WHEN rs_60 > 0.05e0 AND close > sma50 AND sma50 > sma200 THEN 'relative_strength_leadership' END], lambda x: x IS NOT NULL)) AS signal_type FROM (
 SELECT *, lag(sma50) OVER {T} AS p50 FROM (SELECT i0.*, {roll('avg', 'close', 50)} AS sma50, {roll('avg', 'close', 200)} AS sma200, {roll('avg', 'volume', 20)} AS vol_avg,
 CASE WHEN i >= 252 THEN max(close) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING) END AS h252, (close / lag(close, 60) OVER {T} - 1) - (bench_close / lag(bench_close, 60) OVER {T} - 1) AS rs_60 FROM i0))
 WHERE n_rows >= 260 AND i >= 201 AND i < n_rows - 126 AND sma200 IS NOT NULL""", "i0")
view("sig", """SELECT *, CASE signal_type WHEN 'sma50_reclaim' THEN 62 WHEN 'high_volume_52w_breakout' THEN 72 ELSE 68 END AS score FROM hs""", "hs")
query("hist_signals", "ticker sector date:d entry_price:4 signal_type score:i", "SELECT * FROM sig", "sig")(lambda m: events.hist_signals(m.bars, m.benchmark))

view("zs", """SELECT *, CASE WHEN c >= 29 THEN (r - a) / nullif(s, 0) END AS z FROM (SELECT *, count(r) OVER w AS c, avg(r) OVER w AS a, stddev_samp(r) OVER w AS s FROM bx WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 251 PRECEDING AND 1 PRECEDING))""", "bx")
ABN = "CASE WHEN z IS NULL THEN 'Normal' WHEN abs(z) >= 3 THEN 'extremely unusual ' || CASE WHEN z > 0 THEN 'upside' ELSE 'downside' END || ' move' WHEN abs(z) >= 2 THEN 'unusual ' || CASE WHEN z > 0 THEN 'upside' ELSE 'downside' END || ' move' ELSE 'normal range' END"
query("return_zscore", "ticker date:d z_score:6 abnormality normal_percentile:5", f"SELECT ticker, date, z AS z_score, {ABN} AS abnormality, (2 * {cdf('abs(z)')} - 1) * 100 AS normal_percentile FROM zs", "zs")(lambda m: events.return_zscore(m.bars))

view("intra", """SELECT ticker, ts, arg_min(cents, event_id) / 1e2 AS open, max(cents) / 1e2 AS high, min(cents) / 1e2 AS low, arg_max(cents, event_id) / 1e2 AS close, sum(size) AS volume FROM (
 SELECT 'U' || CAST(user_id % 25 AS VARCHAR) AS ticker, time_bucket(INTERVAL 5 MINUTE, ts) AS ts, event_id, CAST(round(value * 100) AS BIGINT) AS cents, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS size FROM events) GROUP BY 1, 2""")


def fr(a, b):
    return f"(PARTITION BY ticker ORDER BY ts ROWS BETWEEN {a} PRECEDING AND {b})"


view("iv0", f"""SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts) - 1 AS i, lag(close) OVER (PARTITION BY ticker ORDER BY ts) AS p, close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY ts), 0) - 1 AS r,
 sum((high + low + close) / 3 * volume) OVER {fr(77, 'CURRENT ROW')} / nullif(sum(volume) OVER {fr(77, 'CURRENT ROW')}, 0) AS vwap, sum((high + low + close) / 3 * volume) OVER {fr(77, '1 PRECEDING')} / nullif(sum(volume) OVER {fr(77, '1 PRECEDING')}, 0) AS pvwap FROM intra""", "intra")
query("session_vwap", "ticker ts vwap:9", "SELECT ticker, strftime(ts, '%Y-%m-%d %H:%M') AS ts, vwap FROM iv0", "iv0")(
    lambda m: events.session_vwap(m.intraday).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm")))
view("iv1", f"""SELECT *, CASE WHEN c >= 29 AND NOT broken THEN (r - a) / nullif(s, 0) END AS z FROM (SELECT *, coalesce(max(CASE WHEN p = 0 THEN 1 ELSE 0 END) OVER {fr(251, 'CURRENT ROW')}, 0) = 1 AS broken, count(r) OVER {fr(251, '1 PRECEDING')} AS c, avg(r) OVER {fr(251, '1 PRECEDING')} AS a, stddev_samp(r) OVER {fr(251, '1 PRECEDING')} AS s,
 coalesce((close - p) / nullif(p, 0) * 100, 0) AS move_pct, coalesce(volume / nullif(avg(volume) OVER {fr(19, 'CURRENT ROW')}, 0), 0) AS volume_ratio, CASE WHEN i >= 20 THEN max(high) OVER {fr(20, '1 PRECEDING')} END AS ph, CASE WHEN i >= 20 THEN min(low) OVER {fr(20, '1 PRECEDING')} END AS pl,
 {roll('avg', 'close', 20, None, 'ticker', 'ts')} AS s20, {roll('avg', 'close', 50, None, 'ticker', 'ts')} AS s50 FROM iv0)""", "iv0")
view("ireason", f"""SELECT ticker, ts, move_pct, volume_ratio, z, {ABN} AS abnormality, list_sort(list_filter([CASE WHEN abs(z) >= 2 THEN 'abnormal move z-score # (' || {ABN} || '; larger than ~#% of normal bars)' END, CASE WHEN abs(move_pct) >= 2 THEN '#m price move #%' END,
 CASE WHEN volume_ratio >= 2 THEN 'volume spike #x' END, CASE WHEN close >= ph THEN 'intraday breakout above #' END, CASE WHEN close <= pl THEN 'intraday breakdown below #' END,
 CASE WHEN i >= 50 AND p <= p20 AND close > s20 THEN 'price reclaimed intraday SMA#' END, CASE WHEN i >= 50 AND p >= p20 AND close < s20 THEN 'price lost intraday SMA#' END, CASE WHEN i >= 50 AND p20 <= p50 AND s20 > s50 THEN 'intraday SMA# crossed above SMA#' END,
 CASE WHEN i >= 50 AND p20 >= p50 AND s20 < s50 THEN 'intraday SMA# crossed below SMA#' END, CASE WHEN i >= 2 AND p <= pvwap AND close > vwap THEN 'price reclaimed session VWAP' END, CASE WHEN i >= 2 AND p >= pvwap AND close < vwap THEN 'price lost session VWAP' END], lambda x: x IS NOT NULL)) AS reasons FROM (
 SELECT *, lag(s20) OVER (PARTITION BY ticker ORDER BY ts) AS p20, lag(s50) OVER (PARTITION BY ticker ORDER BY ts) AS p50 FROM iv1)""", "iv1")


def masked(col):
    """Reasons with their numbers replaced, so texts compare across number formats."""
    return F.array_sort(F.transform(col, lambda x: F.regexp_replace(x, r"[+-]?[0-9]+(\.[0-9]+)?", "#")))


query("intraday_reasons", "ticker ts move_pct:7 volume_ratio:7 z_score:6 abnormality reasons",
      "SELECT ticker, strftime(ts, '%Y-%m-%d %H:%M') AS ts, move_pct, volume_ratio, z AS z_score, abnormality, array_to_string(reasons, '|') AS reasons FROM ireason", "ireason")(
    lambda m: events.intraday_reasons(m.intraday).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm")).withColumn("reasons", F.array_join(masked("reasons"), "|")))

view("due", """SELECT 'U' || CAST(ticker % 25 AS VARCHAR) AS ticker, datediff('day', (SELECT max(CAST(o_orderdate AS DATE)) FROM orders), d) AS days_until FROM (SELECT o_custkey AS ticker, max(CAST(o_orderdate AS DATE)) + 90 AS d FROM orders GROUP BY 1)""")


def due_reports(m):
    """Next report 90 days after a customer's last order, mapped to its event ticker."""
    last = m.table("orders").groupBy("o_custkey").agg(F.max(F.to_date("o_orderdate")).alias("d"))
    today = m.table("orders").agg(F.max(F.to_date("o_orderdate")).alias("today"))
    return last.crossJoin(F.broadcast(today)).select(F.concat(F.lit("U"), F.col("o_custkey") % 25).alias("ticker"), F.datediff(F.date_add("d", 90), "today").alias("days_until"))


query("alert_union", "ticker reasons",
      """SELECT ticker, string_agg(reason, '|' ORDER BY reason) AS reasons FROM (SELECT DISTINCT ticker, reason FROM (SELECT ticker, unnest(reasons) AS reason FROM ireason UNION ALL
 SELECT ticker, 'earnings within ' || days_until || ' day(s)' FROM due WHERE days_until BETWEEN 0 AND 2 UNION ALL SELECT 'PORTFOLIO', 'portfolio risk trigger: ' || n || ' positions outside drift band' FROM (SELECT count(*) AS n FROM drf WHERE abs(drift) >= 2) WHERE n > 0)) GROUP BY ticker""", "ireason due drf")(
    lambda m: events.alert_union(
        events.intraday_reasons(m.intraday).select("ticker", F.explode(masked("reasons")).alias("reason")),
        due_reports(m).filter("days_until BETWEEN 0 AND 2").select("ticker", F.concat(F.lit("earnings within "), F.col("days_until"), F.lit(" day(s)")).alias("reason")),
        pf.drift(q_portfolio.wts(m)).filter("status = 'rebalance_watch'").agg(F.count(F.lit(1)).alias("n")).filter("n > 0").select(
            F.concat(F.lit("portfolio risk trigger: "), F.col("n"), F.lit(" positions outside drift band")).alias("reason"))
    ).withColumn("reasons", F.array_join("reasons", "|")))

view("conf", """SELECT *, datediff('day', as_of, next_earnings_date) AS days_to_earnings, coalesce(datediff('day', as_of, next_earnings_date) BETWEEN -2 AND 10, false) AS earnings_near, coalesce(nr >= 20 AND last_move > greatest(0.07e0, sd20 * 3), false) AS large_move FROM (
 SELECT ticker, max(n_rows) AS nr, max(CASE WHEN rn = 1 THEN abs(r) END) AS last_move, stddev_samp(r) AS sd20 FROM rx WHERE rn <= 20 GROUP BY ticker) LEFT JOIN (SELECT n_name AS ticker, CAST(max(o_orderdate) AS DATE) + 90 + n_nationkey AS next_earnings_date FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, n_nationkey) USING (ticker),
 (SELECT max(date) AS as_of FROM bars)""", "rx", "bars")


def next_reports(m):
    """Next report per nation: 90 days (plus its key) after its last order."""
    return (m.table("orders").join(m.table("customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.max(F.to_date("o_orderdate")).alias("d"))
            .join(m.places, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("ticker"), F.date_add("d", F.col("n_nationkey") + 90).alias("next_earnings_date")))


query("confounders", "ticker days_to_earnings:i earnings_near large_move last_move:8 sd20:8", "SELECT * FROM conf", "conf")(
    lambda m: events.confounders(m.bars, next_reports(m), m.bars.agg(F.max("date").alias("as_of"))))
