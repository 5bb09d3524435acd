"""Stateful streams against their batch twins: files out of order, an input limit, small slots of state, forgotten keys."""

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.operators import events
from marketloom.streaming import streams

START = dt.datetime(2024, 3, 4)
BAR = "ticker string, ts timestamp, high double, low double, close double, volume double"


def walk(ticker, n, seed):
    r = np.random.default_rng(seed)
    close = np.round(50 + np.cumsum(r.normal(0, 0.4, n)), 2)
    volume = np.where(r.random(n) < 0.05, 900.0, 100.0) + np.arange(n) % 7
    return [(ticker, START + dt.timedelta(minutes=5 * i), float(c) + 0.3, float(c) - 0.3, float(c), float(v)) for i, (c, v) in enumerate(zip(close, volume, strict=True))]


def out_of_order(spark, rows, schema, path, group, seed=3):
    """Files of about `group` neighbouring rows, each swapped with its neighbour file, rows shuffled within."""
    r = np.random.default_rng(seed)
    rows = sorted(rows, key=lambda x: str(x[1]))
    files = [rows[i : i + group] for i in range(0, len(rows), group)]
    for i in range(0, len(files) - 1, 2):
        files[i], files[i + 1] = files[i + 1], files[i]
    for k, part in enumerate(files):
        part = [part[i] for i in r.permutation(len(part))]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        newest = max((f for f in os.listdir(path) if f.endswith(".parquet")), key=lambda f: os.path.getmtime(f"{path}/{f}"))
        os.utime(f"{path}/{newest}", (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.mark.parametrize("slot", [3_600_000, streams.DAY])
def test_alerts_of_files_out_of_order_equal_the_batch(spark, tmp_path, slot):
    rows = walk("A", 330, 1) + walk("B", 120, 2)
    batch = {(x.ticker, x.ts): x for x in events.intraday_reasons(spark.createDataFrame(rows, BAR)).collect()}
    bars = out_of_order(spark, rows, BAR, f"{tmp_path}/in", 75).withWatermark("ts", "12 hours")
    sent = streams.bar_alerts(bars, "ts", slot=slot)
    got = spark.read.schema(streams.ALERTS).parquet(streams.finish(sent, "alerts-test")).collect()
    newest = max(x[1] for x in rows)
    wanted = {k for k in batch if k[1] <= newest - dt.timedelta(hours=12)}
    assert len(got) == len(wanted) and {(x.ticker, x.ts) for x in got} == wanted
    for x in got:
        want = batch[x.ticker, x.ts]
        assert x.reasons == want.reasons and x.abnormality == want.abnormality
        for name in ("move_pct", "volume_ratio", "z_score"):
            assert (x[name] is None and want[name] is None) or x[name] == pytest.approx(want[name], abs=1e-9), (name, x.ts)


def test_windows_feed_alerts_within_one_query(spark, tmp_path):
    """Trades, windows and alerts in one stream: a bar is sent as soon as its window closes."""
    schema = "ticker string, ts timestamp, event_id long, cents long, size double"
    trades = [("A", START + dt.timedelta(minutes=i), i, 5000 + (i * 37) % 90, 10.0) for i in range(400)]
    stream = out_of_order(spark, trades, schema, f"{tmp_path}/in", 100)
    bars = streams.window_bars(stream, late="4 hours")
    got = spark.read.schema(streams.ALERTS).parquet(streams.finish(streams.bar_alerts(bars), "chained")).collect()
    closed = START + dt.timedelta(minutes=399) - dt.timedelta(hours=4)
    assert sorted(x.ts for x in got) == [START + dt.timedelta(minutes=5 * i) for i in range(80) if START + dt.timedelta(minutes=5 * (i + 1)) <= closed]
    assert [x.close for x in sorted(got, key=lambda x: x.ts)][:3] == [(5000 + (i * 37) % 90) / 100 for i in (4, 9, 14)]


SNAPSHOT = "ticker string, date date, " + ", ".join(f"{f} double" for f in streams.FIELDS)


def snapshot(ticker, day, close):
    return (ticker, dt.date(2020, 1, 1) + dt.timedelta(days=day), close, 100.0, 90.0, 45.0, 45.0, close - 100, 1.0, 130.0, 70.0)


def test_transitions_out_of_order_with_nulls_and_repeats(spark, tmp_path):
    r = np.random.default_rng(5)
    closes = np.round(100 + np.cumsum(r.normal(0, 2, 60)), 2)
    rows = [snapshot("A", i, float(c)) for i, c in enumerate(closes)]
    rows[7] = rows[7][:3] + (None,) * 8
    again = [("A", rows[20][1], *snapshot("A", 0, 999.0)[2:]), ("A", None, *rows[0][2:])]
    whole = streams.transitions(out_of_order(spark, rows + [snapshot("B", 59, 1.0)], SNAPSHOT, f"{tmp_path}/whole", 10), "30 days", slot=7 * streams.DAY)
    got = {(x.ticker, x.date): x.alerts for x in spark.read.parquet(streams.finish(whole, "transitions-test")).collect()}
    assert set(got) == {("A", x[1]) for x in rows[:30]} and got["A", rows[0][1]] == [events.FIRST_RUN]

    frame = spark.createDataFrame(rows, SNAPSHOT)
    later = frame.withColumn("ticker", F.concat(F.lit("A"), F.datediff("date", F.lit(dt.date(2020, 1, 1)))))
    before = later.withColumn("ticker", F.concat(F.lit("A"), F.datediff("date", F.lit(dt.date(2020, 1, 1))) + 1))
    want = {x.ticker: x.alerts for x in events.state_transitions(later, events.state_row(before)).collect()}
    for i in range(1, 30):
        assert (got["A", rows[i][1]] or []) == (want[f"A{i}"] or []), i

    # one micro-batch of everything: the first of equal days stays or the other, never both; undated rows are left out
    frame.unionByName(spark.createDataFrame(again, SNAPSHOT)).coalesce(1).write.parquet(f"{tmp_path}/once")
    once = streams.transitions(spark.readStream.schema(SNAPSHOT).parquet(f"{tmp_path}/once"))
    days = [x.date for x in spark.read.parquet(streams.finish(once, "transitions-once")).collect()]
    assert sorted(days) == [x[1] for x in rows]


def test_an_idle_ticker_is_forgotten(spark, tmp_path):
    rows = [snapshot("A", d, 100.0 + d) for d in (0, 1, 40, 41)] + [snapshot("B", d, 50.0) for d in range(0, 60, 2)]
    for low, high in ((0, 20), (20, 35), (35, 50), (50, 60)):
        part = [x for x in rows if low <= (x[1] - dt.date(2020, 1, 1)).days < high]
        spark.createDataFrame(part, SNAPSHOT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def first_runs(name, idle, files=1):
        stream = spark.readStream.schema(SNAPSHOT).option("maxFilesPerTrigger", files).parquet(f"{tmp_path}/in")
        made = spark.read.parquet(streams.finish(streams.transitions(stream, "2 days", idle=idle), name))
        return sorted((x.ticker, x.date.isoformat()) for x in made.collect() if x.alerts == [events.FIRST_RUN])

    assert first_runs("kept", None) == [("A", "2020-01-01"), ("B", "2020-01-01")]
    for files in (1, 9):  # a gap counts alike within a micro-batch
        assert first_runs("forgotten", 20 * streams.DAY, files) == [("A", "2020-01-01"), ("A", "2020-02-10"), ("B", "2020-01-01")]
