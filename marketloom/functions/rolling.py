"""Row-frame window helpers.

A frame is null until it holds `n` values, as in the statistics the reports use.
All helpers take the partition keys explicitly; daily bars bound a partition by the
number of trading days, so one ticker never outgrows a task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

KEY = ("ticker",)
ORDER = "date"


def over(keys: Sequence[str] = KEY, order: str = ORDER) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def trailing(n: int, keys: Sequence[str] = KEY, order: str = ORDER) -> WindowSpec:
    return over(keys, order).rowsBetween(-(n - 1), 0)


def full_frame(agg: Column, x: Column, n: int, frame: WindowSpec, min_periods: int | None = None) -> Column:
    """`agg` over the frame, null while fewer than `min_periods` (default n) values are present."""
    return F.when(F.count(x).over(frame) >= F.lit(min_periods or n), agg.over(frame))


def rolling_mean(x: Column, n: int, keys: Sequence[str] = KEY, order: str = ORDER, min_periods: int | None = None) -> Column:
    return full_frame(F.avg(x), x, n, trailing(n, keys, order), min_periods)


def rolling_std(x: Column, n: int, keys: Sequence[str] = KEY, order: str = ORDER, min_periods: int | None = None) -> Column:
    return full_frame(F.stddev_samp(x), x, n, trailing(n, keys, order), min_periods)


def lagged(x: str | Column, n: int = 1, keys: Sequence[str] = KEY, order: str = ORDER) -> Column:
    return F.lag(x, n).over(over(keys, order))


def pct_change(x: str, n: int = 1, keys: Sequence[str] = KEY, order: str = ORDER) -> Column:
    return F.try_divide(F.col(x), lagged(x, n, keys, order)) - 1


def with_position(df: DataFrame, keys: Sequence[str] = KEY, order: str = ORDER) -> DataFrame:
    """`i`: 0-based position in the group; `n_rows`: rows in the group; `rn`: 1 on the latest row."""
    whole = Window.partitionBy(*keys)
    return (
        df.withColumn("i", F.row_number().over(over(keys, order)) - 1)
        .withColumn("n_rows", F.count(F.lit(1)).over(whole))
        .withColumn("rn", F.col("n_rows") - F.col("i"))
    )


def with_emas(df: DataFrame, specs: Sequence[tuple[str, str, float]], keys: Sequence[str] = KEY, order: str = ORDER) -> DataFrame:
    """Exponential means (source, out, span) seeded with the first value, for series of any length.

    The recursion unrolls to a weighted running sum. To keep its weights finite the series is
    cut into blocks: inside a block the running sum is direct, and the ends of the previous
    blocks are carried over as far back as double precision can see. All requested means share
    one block layout, so they cost one ordered pass and one pass over block ends together.
    """
    decays = {out: 1.0 - 2.0 / (span + 1.0) for _, out, span in specs}
    m = max(8, min(1024, int(600.0 / -math.log(min(decays.values())))))
    inside = Window.partitionBy(*keys, "_block").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    ends = Window.partitionBy(*keys).orderBy("_block")
    pos, i = F.col("_pos"), F.col("i")
    cols = df.columns
    if "i" not in cols:
        df = df.withColumn("i", F.row_number().over(over(keys, order)) - 1)
    df = df.withColumn("_block", F.floor(i / m)).withColumn("_pos", i % m)
    local = []
    for source, out, _ in specs:
        d = decays[out]
        weight = F.when(i == 0, F.lit(1.0)).otherwise(F.lit(1.0 - d))
        term = weight * F.col(source) * F.pow(F.lit(d), -pos)
        local.append((F.sum(term).over(inside) * F.pow(F.lit(d), pos)).alias(f"_l_{out}"))
    df = df.select("*", *local)
    result = []
    for _, out, _ in specs:
        d = decays[out]
        end = F.when(pos == m - 1, F.col(f"_l_{out}"))
        value = F.col(f"_l_{out}")
        for k in range(1, math.ceil(40.0 / (-m * math.log(d))) + 1):
            carried = F.max(end).over(ends.rangeBetween(-k, -k))
            value = value + F.coalesce(carried, F.lit(0.0)) * F.pow(F.lit(d), pos + 1 + m * (k - 1))
        result.append(value.alias(out))
    kept = [c for c in df.columns if not c.startswith("_l_")]
    out = df.select(*kept, *result).drop("_block", "_pos")
    return out if "i" in cols else out.drop("i")


def with_ema(df: DataFrame, source: str, out: str, span: float, keys: Sequence[str] = KEY, order: str = ORDER) -> DataFrame:
    return with_emas(df, [(source, out, span)], keys, order)


def with_rsi(df: DataFrame, source: str, out: str, n: int = 14, keys: Sequence[str] = KEY, order: str = ORDER) -> DataFrame:
    """RSI from plain rolling means of gains and losses; null while the loss mean is 0."""
    change = F.col("_chg")
    gain = F.when(change > 0, change).when(change.isNotNull(), F.lit(0.0))
    loss = F.when(change < 0, -change).when(change.isNotNull(), F.lit(0.0))
    up = rolling_mean(gain, n, keys, order)
    down = rolling_mean(loss, n, keys, order)
    return (
        df.withColumn("_chg", F.col(source) - lagged(source, 1, keys, order))
        .withColumn("_up", up)
        .withColumn("_down", down)
        .withColumn(out, 100 - 100 / (1 + F.col("_up") / F.nullif(F.col("_down"), F.lit(0.0))))
        .drop("_chg", "_up", "_down")
    )
