"""Structured Streaming jobs: bars, sliding means, stateful alerts, de-duplication, upserts.

Every job runs to the end of the available input and keeps its state in the checkpoint folder,
so a restart (or a lost executor) continues where it stopped.
"""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from marketloom.operators import events
from marketloom.operators.tables import last_per_key
from marketloom.session import shared_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """The event table as a file stream; event times become zoned so they can carry a watermark."""
    path = f"{folder}/events*.parquet"
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    raw = spark.readStream.schema(schema).parquet(path)
    return raw.select(
        F.concat(F.lit("U"), F.col("user_id") % 25).alias("ticker"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
        F.round(F.col("value") * 100).cast("long").alias("cents"),
        F.get_json_object("props", "$.k").cast("double").alias("size"),
    )


def window_bars(trades: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Tumbling OHLCV bars; rows later than the watermark are dropped, and in append mode the windows that the
    last watermark has not passed are not sent."""
    return (
        trades.withWatermark("ts", late)
        .groupBy(F.window("ts", width).alias("w"), "ticker")
        .agg(
            (F.min_by("cents", "event_id") / 100.0).alias("open"),
            (F.max("cents") / 100.0).alias("high"),
            (F.min("cents") / 100.0).alias("low"),
            (F.max_by("cents", "event_id") / 100.0).alias("close"),
            F.sum("size").alias("volume"),
        )
        # `closed` keeps the watermark for a stateful operator behind
        .select("ticker", F.col("w.start").alias("ts"), F.col("w.end").alias("until"), "open", "high", "low", "close", "volume", F.window_time("w").alias("closed"))
    )


def sliding_means(trades: DataFrame, width: str = "100 minutes", step: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Sliding mean price and volume, the time form of a 20-bar mean."""
    return (
        trades.withWatermark("ts", late)
        .groupBy(F.window("ts", width, step).alias("w"), "ticker")
        .agg(F.count(F.lit(1)).alias("events"), (F.avg("cents") / 100.0).alias("mean_value"), F.avg("size").alias("mean_size"))
        .select("ticker", F.col("w.start").alias("ts"), F.col("w.end").alias("until"), "events", "mean_value", "mean_size")
    )


def finish(stream: DataFrame, name: str, mode: str = "append") -> str:
    """Run a stream over all available input into a Parquet folder and return the folder."""
    spark = stream.sparkSession
    out = run_folder(spark, name)
    q = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", out)
        .option("checkpointLocation", out + "-checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return out


FEATURES = (
    "i prev high low close move_pct volume_ratio z_score prior_high prior_low sma20 sma50 prev20 prev50 vwap prev_vwap"
).split()
BAR_FEATURES = "ticker string, at long, " + ", ".join(f"{f} double" for f in FEATURES)
ALERTS = "ticker string, ts timestamp, close double, move_pct double, volume_ratio double, z_score double, abnormality string, reasons array<string>"
KEEP = 253  # bars of state: 252 returns for the z-score
DAY = 86_400_000


class InTimeOrder(StatefulProcessor):
    """Rows of a key, held back until the watermark has passed them and then handed on in time order.

    Rows come as (`due`, `at`, fields): the millisecond at which the watermark has passed the row, its time in
    microseconds, and numbers. They wait in state by slots of `slot` milliseconds; a slot's timer stands at its
    first waiting row and, once fired, at the first that still waits. So a task holds one Arrow batch or one slot
    at a time, however long a ticker's history in a micro-batch is, and rows may come in any order that
    the watermark allows. Later ones are dropped by the engine; of equal times the first row to arrive stays.

    With `idle`, a key starts anew after a gap of that many milliseconds, and its state is removed by then."""

    def __init__(self, fields: list[str], slot: int, idle: int | None = None) -> None:
        self.fields, self.slot, self.idle = fields, slot, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "slot long", "due array<long>, at array<long>, cells array<double>")
        self.last = handle.getValueState("last", "at long, due long, seen long")
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        """State of the subclass."""
        raise NotImplementedError

    def ordered(self, key: tuple, seen: int, at: np.ndarray, cells: np.ndarray) -> pd.DataFrame:
        """What the rows give; `seen` rows of the key were handed on before."""
        raise NotImplementedError

    def forget(self) -> None:
        """Clear the subclass's state."""
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            due, at = part["due"].to_numpy("int64"), part["at"].to_numpy("int64")
            cells = part[self.fields].to_numpy(float, na_value=np.nan)
            slots = due // self.slot
            for slot in np.unique(slots):
                here = slots == slot
                self._wait(int(slot), due[here], at[here], cells[here])
                self.handle.registerTimer(int(due[here].min()))
        yield from ()

    def _wait(self, slot: int, due: np.ndarray, at: np.ndarray, cells: np.ndarray) -> None:
        lists = due.tolist(), at.tolist(), cells.ravel().tolist()
        if self.waiting.containsKey((slot,)):
            lists = tuple([*old, *new] for old, new in zip(self.waiting.getValue((slot,)), lists, strict=True))
        self.waiting.updateValue((slot,), lists)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        fired, mark = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        slot = (fired // self.slot,)
        if self.waiting.containsKey(slot):
            lists = self.waiting.getValue(slot)
            due, at = (np.array(x, "int64") for x in lists[:2])
            cells = np.array(lists[2], dtype=float).reshape(len(due), len(self.fields))
            self.waiting.removeKey(slot)
            later = due > mark
            if later.any():
                self._wait(slot[0], due[later], at[later], cells[later])
                self.handle.registerTimer(int(due[later].min()))
            yield from self._release(key, due[~later], at[~later], cells[~later])
        if self.idle and self.last.exists() and self.last.get()[1] + self.idle <= fired:
            self._forget()

    def _forget(self) -> None:
        self.last.clear()
        self.forget()

    def _release(self, key, due: np.ndarray, at: np.ndarray, cells: np.ndarray) -> Iterator[pd.DataFrame]:
        at, first = np.unique(at, return_index=True)
        due, cells = due[first], cells[first]
        gaps = np.flatnonzero(np.diff(due) >= self.idle) + 1 if self.idle else []
        for run in zip(*(np.split(x, gaps) for x in (due, at, cells)), strict=True):
            due, at, cells = run
            before, until, seen = self.last.get() if self.last.exists() else (None, None, 0)
            if seen and self.idle and len(due) and due[0] - until >= self.idle:
                self._forget()
                seen = 0
            elif seen:
                new = at > before
                due, at, cells = due[new], at[new], cells[new]
            if not len(at):
                continue
            self.last.update((int(at[-1]), int(due[-1]), seen + len(at)))
            if self.idle:
                self.handle.registerTimer(int(due[-1]) + self.idle)
            yield self.ordered(key, seen, at, cells)

    def close(self) -> None:
        pass


class BarFeatures(InTimeOrder):
    """Features of each bar from the ticker's last `KEEP` bars, a list of rows."""

    def __init__(self, slot: int = 30 * DAY, idle: int | None = None) -> None:
        super().__init__(["high", "low", "close", "volume"], slot, idle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", "high double, low double, close double, volume double")

    def forget(self) -> None:
        self.recent.clear()

    def ordered(self, key: tuple, seen: int, at: np.ndarray, cells: np.ndarray) -> pd.DataFrame:
        old = np.array(list(self.recent.get()) if seen else [], dtype=float).reshape(-1, 4)
        bars = np.concatenate([old, cells])
        self.recent.put([tuple(b) for b in bars[-KEEP:].tolist()])
        made = pd.DataFrame(bar_features(bars, seen - len(old))[len(old) :], columns=FEATURES)
        made.insert(0, "at", at)
        made.insert(0, "ticker", key[0])
        return made


def _frames(x: np.ndarray, n: int) -> np.ndarray:
    """Row k: the last n values up to x[k], filled with NaN before the first."""
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(n - 1, np.nan), x]), n)


def bar_features(bars: np.ndarray, before: int, look: int = 20, step: int = 4096) -> np.ndarray:
    """FEATURES of every bar; rows are (high, low, close, volume), `before` bars of the ticker lie before them.
    The frames are laid out for `step` bars at a time."""
    reach = 260
    parts = []
    for at in range(0, len(bars), step):
        low = max(0, at - reach)
        parts.append(_some_features(bars[low : at + step], before + low, look)[at - low :])
    return np.concatenate(parts)


def _some_features(bars: np.ndarray, before: int, look: int) -> np.ndarray:
    high, low, close, vol = bars.T
    n, none = len(close), np.nan
    i = before + np.arange(n)
    with np.errstate(all="ignore"), warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)  # means of frames that are still empty
        prev = np.concatenate([[none], close[:-1]])
        r = close / prev - 1
        pct = np.nan_to_num(np.where(prev == 0, 0.0, (close - prev) / prev * 100))
        mean_vol = np.nanmean(_frames(vol, 20), axis=1)
        ratio = np.nan_to_num(np.where(mean_vol == 0, 0.0, vol / mean_vol))
        past = _frames(np.concatenate([[none], r[:-1]]), 251)
        seen = np.sum(~np.isnan(past), axis=1)
        sd = np.nanstd(past, axis=1, ddof=1)
        broken = np.isinf(past).any(axis=1) | ~np.isfinite(r) | np.isnan(sd) | (sd == 0) | (seen < 29)
        # a zero price makes the return after it infinite, or undefined after another zero
        broken |= (_frames(np.where(prev == 0, 1.0, 0.0), 252) == 1).any(axis=1)
        z = np.where(broken, none, (r - np.nanmean(past, axis=1)) / np.where(sd == 0, none, sd))
        shift = lambda x: np.concatenate([[none], x[:-1]])
        top, bottom = _frames(shift(high), look).max(axis=1), _frames(shift(low), look).min(axis=1)
        s20, s50 = _frames(close, 20).mean(axis=1), _frames(close, 50).mean(axis=1)
        flow, size = np.nan_to_num((high + low + close) / 3 * vol), np.nan_to_num(vol)

        def ratio_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            total = np.nansum(b, axis=1)
            return np.where(total == 0, none, np.nansum(a, axis=1) / total)

        vwap = ratio_of(_frames(flow, 78), _frames(size, 78))
        earlier = ratio_of(_frames(shift(flow), 77), _frames(shift(size), 77))
        out = [i, prev, high, low, close, pct, ratio, z, top, bottom, s20, s50, shift(s20), shift(s50), vwap, earlier]
    return np.column_stack(out)


def stateful(rows: DataFrame, processor: InTimeOrder, schema: str, time: str, event_time: str) -> DataFrame:
    """`processor` over the rows of each ticker by `time`, released as the watermark on `event_time` passes."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # unix_micros() of the event time, rounded up: a row is due when none before it can come any more
    due = F.expr(f"(unix_micros(`{event_time}`) + 999) div 1000").alias("due")
    taken = rows.filter(F.col(event_time).isNotNull() & F.col(time).isNotNull())
    taken = taken.select("ticker", F.col(event_time).alias("_event"), due, F.unix_micros(F.col(time).cast("timestamp")).alias("at"), *processor.fields)
    return taken.groupBy("ticker").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode="eventTime"
    )


def bar_alerts(bars: DataFrame, event_time: str = "closed", slot: int = 30 * DAY, idle: int | None = None) -> DataFrame:
    """Reasons of each bar of a stream of bars with a watermark on `event_time`, by the rules of `events.bar_rules`.
    Bars behind the watermark are sent, in time order whatever order they came in."""
    made = stateful(bars, BarFeatures(slot, idle), BAR_FEATURES, "ts", event_time)
    # what a frame lacks is null, as in the batch
    made = made.select("ticker", F.timestamp_micros("at").alias("ts"), *[F.when(~F.isnan(f), F.col(f)).alias(f) for f in FEATURES])
    ruled = events.bar_rules(events.with_abnormality(made))
    return ruled.select("ticker", "ts", "close", "move_pct", "volume_ratio", "z_score", "abnormality", "reasons")


def dedupe_alerts(alerts: DataFrame, late: str = "1 day") -> DataFrame:
    """Alerts whose key (ticker, bar, sorted reasons) was not sent before."""
    key = F.concat_ws(":", "ticker", F.date_format("ts", "yyyy-MM-dd HH:mm"), F.array_join(F.array_sort(F.array_distinct("reasons")), "|"))
    return alerts.filter(F.size("reasons") > 0).withColumn("alert_key", key).withWatermark("ts", late).dropDuplicatesWithinWatermark(["alert_key"])


FIELDS = ("close", "sma50", "sma200", "rsi_weekly", "rsi_monthly", "mrs", "rv", "high_52w", "low_52w")
PAIRS = "ticker string, at long, first boolean, " + ", ".join(f"{side}_{f} double" for side in ("now", "before") for f in FIELDS)


class Snapshots(InTimeOrder):
    """Consecutive snapshots of a ticker side by side; the last snapshot is the state."""

    def __init__(self, slot: int = 4096 * DAY, idle: int | None = None) -> None:
        super().__init__(list(FIELDS), slot, idle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.stored = handle.getValueState("stored", ", ".join(f"{f} double" for f in FIELDS))

    def forget(self) -> None:
        self.stored.clear()

    def ordered(self, key: tuple, seen: int, at: np.ndarray, cells: np.ndarray) -> pd.DataFrame:
        first = np.array(self.stored.get() if seen else [np.nan] * len(FIELDS), dtype=float)
        self.stored.update(tuple(cells[-1].tolist()))
        before = np.concatenate([first[None, :], cells[:-1]])
        made = pd.DataFrame(np.column_stack([cells, before]), columns=[f"{side}_{f}" for side in ("now", "before") for f in FIELDS])
        made.insert(0, "first", seen + np.arange(len(at)) == 0)
        made.insert(0, "at", at)
        made.insert(0, "ticker", key[0])
        return made


def transitions(snapshots: DataFrame, late: str = "0 seconds", slot: int = 4096 * DAY, idle: int | None = None) -> DataFrame:
    """Alerts between consecutive snapshots of a ticker, by the rules of `events.transition_alerts`. Snapshots may
    come in any order, up to `late` behind the newest; those not yet that far behind are not sent."""
    dated = snapshots.withColumn("_day", F.col("date").cast("timestamp")).withWatermark("_day", late)
    pairs = stateful(dated, Snapshots(slot, idle), PAIRS, "_day", "_day").withColumn("date", F.timestamp_micros("at").cast("date"))
    value = lambda side, f: F.when(~F.isnan(f"{side}_{f}"), F.col(f"{side}_{f}")).alias(f)
    stored = events.state_row(pairs.select("ticker", "date", "first", F.struct(*[value("now", f) for f in FIELDS]).alias("now"), *[value("before", f) for f in FIELDS]), "date", "first", "now")
    sides = stored.select("ticker", "date", "first", "now", F.struct(*events.STATE_COLUMNS).alias("before"))
    return sides.select(
        "ticker", "date", F.when(F.col("first"), F.array(F.lit(events.FIRST_RUN))).otherwise(events.transition_alerts("now", "before")).alias("alerts")
    )


def newest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of the highest (order, version) per key: a late event never beats a newer one, and of
    equal ones the later micro-batch wins."""
    return last_per_key(rows.withColumn("_at", F.struct(order, "_version")), keys, "_at").drop("_at")


def upsert_stream(rows: DataFrame, keys: list[str], order: str, buckets: int = 16, compact_every: int = 8) -> str:
    """Keep the newest row per key, by `order`, in one table folder partitioned by version and key bucket.

    Each micro-batch writes its own newest rows as a version (a retried batch overwrites only itself). Every
    `compact_every` batches the version written holds the newest rows of all versions before it, which
    are then removed; a failure between the two leaves rows that readers already rank below."""
    spark = rows.sparkSession
    base = run_folder(spark, "upsert")
    place = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def apply(batch: DataFrame, batch_id: int) -> None:
        new = batch.withColumn("_version", F.lit(batch_id).cast("long"))
        old = _versions(spark, base) if (batch_id + 1) % compact_every == 0 else []
        if old:
            before = spark.read.option("basePath", base).parquet(*[f"{base}/_version={v}" for v in old if v < batch_id])
            new = new.unionByName(before.drop("_bucket").withColumn("_version", F.col("_version").cast("long")))
        out = newest(new, keys, order).withColumn("_bucket", place).drop("_version")
        out.write.mode("overwrite").partitionBy("_bucket").parquet(f"{base}/_version={batch_id}")
        for v in old:
            if v < batch_id:
                path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/_version={v}")
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    q = (
        rows.writeStream.foreachBatch(apply).option("checkpointLocation", base + "-checkpoint").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return base


def _versions(spark: SparkSession, base: str) -> list[int]:
    """Numbers of the versions in an upsert folder; at most `compact_every` of them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(path):
        return []
    names = [f.getPath().getName() for f in store.listStatus(path)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("_version="))


def read_upserted(spark: SparkSession, base: str, keys: list[str], order: str) -> DataFrame:
    """Current rows of an upsert folder: the newest row of each key over all versions."""
    rows = spark.read.option("basePath", base).parquet(*[f"{base}/_version={v}" for v in _versions(spark, base)])
    return newest(rows.drop("_bucket"), keys, order).drop("_version")
