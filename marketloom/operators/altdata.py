"""Alternative data in long form: (source, ticker, date, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.expr import safe_div

# fixed values: sign of each known source; others count as +1
DIRECTIONS = (
    ("google_trends", 1), ("reddit_sentiment", 1), ("news_sentiment", 1), ("transcript_sentiment", 1), ("app_download_growth", 1), ("website_traffic_growth", 1),
)


def with_slot(rows: DataFrame) -> DataFrame:
    """`slot`: place of the date in its source's own calendar (one row per source and date)."""
    days = rows.select("source", "date").distinct()
    slot = F.row_number().over(Window.partitionBy("source").orderBy("date"))
    last = F.max("date").over(Window.partitionBy("source"))
    count = F.count(F.lit(1)).over(Window.partitionBy("source"))
    return rows.join(days.select("source", "date", slot.alias("slot"), last.alias("source_last"), count.alias("source_days")), ["source", "date"])


def engineer_features(rows: DataFrame, n: int = 60, least: int = 20, change: int = 7) -> DataFrame:
    """60-date z-score and 7-date change per series. Frames run over date slots, so missing dates
    need no filler rows; a missing earlier value falls back to the one before it."""
    by = Window.partitionBy("source", "ticker").orderBy("slot")
    f = by.rangeBetween(-(n - 1), 0)
    past = by.rangeBetween(Window.unboundedPreceding, -change)
    v = F.col("value")
    sd = F.stddev_samp("value").over(f)
    out = with_slot(rows.filter(v.isNotNull()))
    z = F.when(F.count("value").over(f) >= least, safe_div(v - F.avg("value").over(f), sd))
    return out.withColumn("zscore_60d", z).withColumn("change_7d", safe_div(v, F.last("value").over(past)) - 1)


def data_quality(rows: DataFrame, max_age: int = 14) -> DataFrame:
    """Filled share of the date x ticker grid per source, and the tickers without recent data."""
    s = with_slot(rows.filter(F.col("value").isNotNull()))
    per = s.groupBy("source", "ticker").agg(F.count(F.lit(1)).alias("n"), F.max("date").alias("last"), F.max("source_days").alias("days"), F.max("source_last").alias("latest"))
    stale = F.datediff("latest", "last") > max_age
    return per.groupBy("source").agg(
        (F.sum("n") / (F.count(F.lit(1)) * F.max("days")) * 100).alias("coverage_pct"),
        F.sum(stale.cast("int")).alias("stale_tickers"),
        F.max("latest").alias("latest_date"),
    )


def composite(features: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Signed, weighted mean of each ticker's z-scores on its sources' latest dates.
    `weights`: source, weight (default 1)."""
    table = F.create_map(*[x for k, d in DIRECTIONS for x in (F.lit(k), F.lit(float(d)))])
    sources = features.select("source").distinct().agg(F.count(F.lit(1)).alias("sources"))  # one row
    now = features.filter(F.col("date") == F.col("source_last")).withColumn("signal", F.col("zscore_60d") * F.coalesce(F.try_element_at(table, F.col("source")), F.lit(1.0)))
    if weights is not None:
        now = now.join(weights, "source", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    else:
        now = now.withColumn("weight", F.lit(1.0))
    has = F.col("signal").isNotNull()
    out = (
        now.groupBy("ticker")
        .agg(
            safe_div(F.sum(F.col("weight") * F.col("signal")), F.sum(F.when(has, F.col("weight")))).alias("composite_zscore"),
            F.sum(has.cast("int")).alias("available_sources"),
        )
        .crossJoin(F.broadcast(sources))
        .filter(F.col("composite_zscore").isNotNull())
    )
    z = F.col("composite_zscore")
    return out.withColumn("coverage_pct", F.col("available_sources") / F.col("sources") * 100).withColumn(
        "label", F.when(z >= 1, "Bullish").when(z <= -1, "Bearish").otherwise("Neutral")
    )
