"""Queries: streaming jobs run to the end of the available input."""

from pyspark.sql import functions as F

from marketloom.plans import q_events  # noqa: F401  (views)
from marketloom.plans.registry import query, view
from marketloom.streaming import streams

view("last_ts", "SELECT max(ts) AS newest FROM events")
view("sb", "SELECT i.*, i.ts + INTERVAL 5 MINUTE AS until FROM intra i, last_ts WHERE i.ts + INTERVAL 5 MINUTE <= newest - INTERVAL 10 MINUTE", "intra", "last_ts")


def minutes(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.date_format(c, "yyyy-MM-dd HH:mm"))
    return df


def bars_folder(m):
    """Closed five-minute bars of the event stream, as a folder other streams read."""
    return streams.finish(streams.window_bars(streams.read_events(m.spark, m.folder)), "bars")


BARS = "ticker string, ts timestamp, until timestamp, open double, high double, low double, close double, volume double"
query("st_bars", "ticker ts until open:2 high:2 low:2 close:2 volume:2", "SELECT ticker, strftime(ts, '%Y-%m-%d %H:%M') AS ts, strftime(until, '%Y-%m-%d %H:%M') AS until, open, high, low, close, volume FROM sb", "sb")(
    lambda m: minutes(m.spark.read.schema(BARS).parquet(bars_folder(m)), "ts", "until"))

query("st_sliding", "ticker ts events:i mean_value:7 mean_size:7",
      """SELECT ticker, strftime(s, '%Y-%m-%d %H:%M') AS ts, count(*) AS events, CAST(sum(cents) AS DOUBLE) / count(*) / 100 AS mean_value, avg(size) AS mean_size FROM (SELECT ticker, cents, size, time_bucket(INTERVAL 5 MINUTE, ts) - k * INTERVAL 5 MINUTE AS s FROM (SELECT 'U' || CAST(user_id % 25 AS VARCHAR) AS ticker, ts, CAST(round(value * 100) AS BIGINT) AS cents, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS size FROM events), range(0, 20) AS r(k)), last_ts
 WHERE s + INTERVAL 100 MINUTE <= newest - INTERVAL 10 MINUTE GROUP BY 1, 2""", "last_ts")(
    lambda m: minutes(m.spark.read.parquet(streams.finish(streams.sliding_means(streams.read_events(m.spark, m.folder)), "sliding")), "ts"))


def alert_stream(m):
    """Alerts chained to the closed windows of the event stream, which arrive in time order."""
    return streams.bar_alerts(streams.window_bars(streams.read_events(m.spark, m.folder)))


def plain(df):
    """Times to minutes; reasons with their numbers masked, as one text."""
    return minutes(df, "ts").withColumn("reasons", F.array_join(q_events.masked(F.col("reasons")), "|"))


view("sal", "SELECT ticker, ts, move_pct, volume_ratio, z, array_to_string(reasons, '|') AS reasons FROM ireason JOIN (SELECT ticker, ts FROM sb) k USING (ticker, ts)", "ireason", "sb")
query("st_alerts", "ticker ts move_pct:6 volume_ratio:6 z_score:6 reasons", "SELECT ticker, strftime(ts, '%Y-%m-%d %H:%M') AS ts, move_pct, volume_ratio, z AS z_score, reasons FROM sal", "sal")(
    lambda m: plain(m.spark.read.schema(streams.ALERTS).parquet(streams.finish(alert_stream(m), "alerts"))))


def deduped(m):
    """Alerts sent twice by the job reach the sink once."""
    sent = streams.finish(alert_stream(m), "alerts")
    rows = m.spark.read.schema(streams.ALERTS).parquet(sent)
    rows.write.mode("append").parquet(sent + "-twice")
    rows.write.mode("append").parquet(sent + "-twice")
    again = m.spark.readStream.schema(streams.ALERTS).parquet(sent + "-twice")
    return m.spark.read.parquet(streams.finish(streams.dedupe_alerts(again), "deduped"))


query("st_alert_dedupe", "ticker ts reasons", "SELECT ticker, strftime(ts, '%Y-%m-%d %H:%M') AS ts, reasons FROM sal WHERE reasons <> ''", "sal")(
    lambda m: plain(deduped(m)))


def snapshot_stream(m):
    """Indicator snapshots written as a folder and read back as a stream."""
    path = streams.run_folder(m.spark, "snapshots")
    rows = q_events.table(m).select("ticker", "date", *streams.FIELDS)
    rows.write.parquet(path)
    return m.spark.readStream.schema(rows.schema).parquet(path)


view("trs", """SELECT ticker, date, n, concat_ws('|', CASE WHEN st AND NOT pst THEN 'Entered Stage # alignment' WHEN NOT st AND pst THEN 'Exited Stage # alignment' END, CASE WHEN coalesce(mrs, 0) > 0 AND pm <= 0 THEN 'RS breakout vs benchmark' WHEN coalesce(mrs, 0) < 0 AND pm >= 0 THEN 'RS breakdown vs benchmark' END, CASE WHEN coalesce(rv, 1) >= 2 AND pv < 2 THEN 'Volume spike: #x normal' END,
 CASE WHEN close > sma200 AND prev <= q200 THEN 'Price crossed above SMA#' WHEN close < sma200 AND prev >= q200 THEN 'Price crossed below SMA#' END, CASE WHEN close > sma50 AND prev <= q50 THEN 'Price crossed above SMA#' WHEN close < sma50 AND prev >= q50 THEN 'Price crossed below SMA#' END, CASE WHEN rsi_monthly > 40 AND qm <= 40 THEN 'Monthly RSI crossed above #' END, CASE WHEN rsi_weekly < 40 AND qw >= 40 THEN 'Weekly RSI crossed below #' END,
 CASE WHEN close >= high_52w AND prev < ph THEN 'New #-week high' END, CASE WHEN close <= low_52w AND prev > pl THEN 'New #-week low' END) AS alerts FROM (SELECT *, row_number() OVER w AS n, coalesce(close > sma50 AND sma50 > sma200, false) AS st, coalesce(lag(close) OVER w > coalesce(lag(sma50) OVER w, 0) AND coalesce(lag(sma50) OVER w, 0) > coalesce(lag(sma200) OVER w, 0), false) AS pst, coalesce(lag(mrs) OVER w, 0) AS pm, coalesce(lag(rv) OVER w, 1) AS pv,
 coalesce(lag(sma200) OVER w, 0) AS q200, coalesce(lag(sma50) OVER w, 0) AS q50, coalesce(lag(rsi_monthly) OVER w, 50) AS qm, coalesce(lag(rsi_weekly) OVER w, 50) AS qw, lag(high_52w) OVER w AS ph, lag(low_52w) OVER w AS pl FROM ind WINDOW w AS (PARTITION BY ticker ORDER BY date))""", "ind")
query("st_transitions", "ticker date:d alerts", "SELECT ticker, date, CASE WHEN n = 1 THEN 'Initial data recorded. Monitoring for transitions.' ELSE alerts END AS alerts FROM trs", "trs")(
    lambda m: m.spark.read.parquet(streams.finish(streams.transitions(snapshot_stream(m)), "transitions")).withColumn(
        "alerts", F.regexp_replace(F.array_join("alerts", "|"), "(?<![A-Za-z])-?[0-9][0-9.]*|(?<=SMA)[0-9]+", "#")))


def latest_prices(m):
    """Latest trade per ticker kept up to date by micro-batches of one file each; events lie in the files
    by their number modulo 5, so every batch after the first brings late rows, and compaction runs."""
    path = streams.run_folder(m.spark, "trades")
    events = m.table("events").select(
        F.concat(F.lit("U"), F.col("user_id") % 25).alias("ticker"), "event_id", F.round(F.col("value") * 100).cast("long").alias("cents"),
        F.get_json_object("props", "$.k").cast("double").alias("size"))
    events.repartition(5, F.pmod("event_id", F.lit(5))).write.parquet(path)
    trades = m.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    base = streams.upsert_stream(trades, ["ticker"], "event_id", compact_every=3)
    return streams.read_upserted(m.spark, base, ["ticker"], "event_id")


query("st_sink", "ticker event_id:i cents:i size:2", "SELECT 'U' || CAST(user_id % 25 AS VARCHAR) AS ticker, max(event_id) AS event_id, arg_max(CAST(round(value * 100) AS BIGINT), event_id) AS cents, arg_max(CAST(json_extract_string(props, '$.k') AS DOUBLE), event_id) AS size FROM events GROUP BY 1")(latest_prices)
