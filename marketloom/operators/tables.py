"""Keyed tables on plain files: conform, upsert, insert-ignore, append, latest rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.schemas import TABLES


def conform(df: DataFrame, table: str) -> DataFrame:
    """Columns and types of a declared table; missing columns are null, rows without a full key
    are dropped."""
    keys, schema = TABLES[table]
    cols = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
    return df.select(*cols).dropna(subset=list(keys)) if keys else df.select(*cols)


def create_table(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table][1])


def last_per_key(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Newest row per key by a map-side combined aggregate (no window over the whole table)."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def upsert_latest(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Insert or replace: the newest incoming row per key wins. The stored table is only filtered
    by an anti join against the (small) batch; it is never sorted or regrouped."""
    new = last_per_key(incoming, keys, order).select(*existing.columns)
    kept = existing.join(new.select(*keys), list(keys), "left_anti")
    return kept.unionByName(new)


def upsert_coalesce(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], always: Sequence[str] = ()) -> DataFrame:
    """Upsert that keeps the stored value where the new one is null; `always` columns are
    replaced whenever a new row arrives."""
    values = [c for c in existing.columns if c not in keys]
    old = existing.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in values])
    new = incoming.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in values], F.lit(True).alias("_new"))
    both = old.join(new, list(keys), "full_outer")

    def pick(c: str) -> Column:
        if c in always:
            return F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(f"_o_{c}")).alias(c)
        return F.coalesce(f"_n_{c}", f"_o_{c}").alias(c)

    return both.select(*keys, *[pick(c) for c in values])


def insert_ignore(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Rows whose key is not stored yet; the first incoming row per key counts."""
    rest = [c for c in incoming.columns if c not in keys]
    first = incoming.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")
    fresh = first.join(existing.select(*keys), list(keys), "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))


def append_rows(df: DataFrame, path: str, partition: Sequence[str] = ()) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def replace_partitions(df: DataFrame, path: str, partition: Sequence[str]) -> None:
    """Rewrite only the partitions the rows fall in; the rest of the table is not touched."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)


def top_n_recent(rows: DataFrame, keys: Sequence[str], order: str, n: int = 10) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return rows.withColumn("recency", rn).filter(F.col("recency") <= n)


# fixed values: texts that count as "not filled in yet"
BLANKS = ("", "Thesis not set yet.", "Unspecified", "Define invalidation criteria.")


def fill_blanks(records: DataFrame, reports: DataFrame, overwrite_blank_only: bool = True) -> DataFrame:
    """Fill blank thesis fields from the latest report row.

    `records`: ticker, thesis, stop_loss, target_price, time_horizon, status, risk_budget_pct.
    `reports`: ticker, score, rating, setup_type, classification, reason, send_alert, risk_level,
    close, support, resistance. Tickers without a report stay as they are (`skipped`).
    """
    r = records.join(reports, "ticker", "left")
    known = F.col("close").isNotNull() | F.col("rating").isNotNull()
    stop = F.when(F.col("support").isNotNull(), F.col("support") * 0.97).otherwise(F.col("close") * 0.92)
    target = F.coalesce(F.col("resistance"), F.col("close") * 1.12)
    thesis = F.concat(
        F.col("ticker"), F.lit(" is tracked as a "), F.coalesce("rating", F.lit("research")), F.lit(" candidate. Setup: "), F.coalesce("setup_type", F.lit("N/A")),
        F.lit(". Fundamentals: "), F.coalesce("classification", F.lit("N/A")), F.lit(". Why now: "), F.coalesce("reason", F.lit("No active Why Now trigger")), F.lit("."),
    )
    fresh = {
        "thesis": thesis,
        "stop_loss": F.round(stop, 2),
        "target_price": F.round(target, 2),
        "time_horizon": F.when(F.col("send_alert"), "1-3 months").otherwise("3-6 months"),
        "status": F.when(F.col("send_alert"), "active_watch").otherwise("watching"),
        "risk_budget_pct": F.when(F.lower("risk_level") == "high", 1.0).otherwise(2.0),
    }
    out = r.withColumn("skipped", ~known)
    changed = F.lit(False)
    final = []
    for name, value in fresh.items():
        old = F.col(name)
        blank = old.isNull() | old.cast("string").isin(*BLANKS)
        use = known & value.isNotNull() & (blank if overwrite_blank_only else F.lit(True))
        changed = changed | use
        final.append(F.when(use, value).otherwise(old).alias(name))
    return out.select("ticker", *final, "skipped", changed.alias("updated"))


def watchlist_report(watchlist: DataFrame, records: DataFrame, quant: DataFrame) -> DataFrame:
    """Thesis records with the latest quant row, flags, and the status of names no longer
    watched. `quant`: ticker, close, score, rating."""
    active = watchlist.select("ticker", F.lit(True).alias("_active"))
    rows = active.join(records, "ticker", "full_outer").join(quant, "ticker", "left")
    stale = F.col("_active").isNull()
    missing = F.coalesce("thesis", F.lit("")).isin("", "Thesis not set yet.")
    flag = lambda c, t: F.when(F.coalesce(c, F.lit(False)), F.lit(t))
    stop, target, c = F.nullif("stop_loss", F.lit(0.0)), F.nullif("target_price", F.lit(0.0)), F.nullif("close", F.lit(0.0))
    return (
        rows.withColumn("status", F.when(stale, "removed_from_active_watchlist").otherwise(F.coalesce("status", F.lit("watching"))))
        .withColumn("flags", F.array_compact(F.array(flag(~stale & missing, "missing thesis"), flag(~stale & (c <= stop), "stop level reached"), flag(~stale & (c >= target), "target reached"))))
        .withColumn("active", ~stale)
        .drop("_active")
    )


# fixed values: proxy candidates per ticker group, in order of preference
PROXY_GROUPS = (
    (("NVDA", "AMD", "TSM"), ("SMH", "XLK", "QQQ")),
    (("AAPL", "MSFT", "GOOGL", "V", "MA"), ("XLK", "QQQ")),
    (("HD", "LOW", "KO", "PEP"), ("XLY", "XLP")),
    (("XOM", "CVX"), ("XLE",)),
)


def proxy_lookup(tickers: DataFrame, groups: DataFrame, available: DataFrame, default: str) -> DataFrame:
    """First available proxy of each ticker. `groups`: ticker, proxies (ordered array);
    `available`: proxy. The default serves tickers outside every group."""
    wanted = tickers.select("ticker").join(groups, "ticker", "left").withColumn("proxies", F.coalesce("proxies", F.array(F.lit(default))))
    listed = wanted.select("ticker", F.posexplode("proxies").alias("place", "proxy"))
    found = listed.join(available.select("proxy"), "proxy", "left_semi").groupBy("ticker").agg(F.min_by("proxy", "place").alias("proxy"))
    return tickers.select("ticker").join(found, "ticker", "left")
