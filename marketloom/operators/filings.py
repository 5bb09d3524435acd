"""Filing insights and priorities, news tone, earnings history and windows, holdings changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.expr import notes, safe_div

# fixed values: news words
BULLISH = ("beat", "raise", "growth", "upgrade", "record", "profit", "strong")
BEARISH = ("miss", "cut", "downgrade", "probe", "lawsuit", "weak", "risk")
# fixed values: place of a form in the list of filings to read first
PRIORITY = (("SC 13D", 0), ("SC 13G", 1), ("4", 2), ("13F-HR", 3))


def filing_insight(rows: DataFrame) -> DataFrame:
    """Headline, context and confidence of each filing from its form and transaction."""
    form = F.upper("form_type")
    t = F.coalesce("transaction_type", F.lit("Unknown transaction"))
    is4 = form == "4"
    routine = t.isin("Option exercise", "Grant or award", "Gift", "Tax withholding")
    buy, sell = t == "Open-market purchase", t == "Open-market sale"
    d, g, f13 = form.startswith("SC 13D"), form.startswith("SC 13G"), form.startswith("13F")
    return (
        rows.withColumn(
            "headline",
            F.when(is4 & buy, "Confirmed insider filing")
            .when(is4 & sell, "Confirmed insider sale filing")
            .when(is4, "Insider filing detected")
            .when(d, "Confirmed major-holder filing")
            .when(g, "Confirmed passive or qualifying holder filing")
            .when(f13, "Delayed ownership update")
            .otherwise("SEC filing detected"),
        )
        .withColumn("insight_confidence", F.when((is4 & (buy | sell)) | d | g, "Medium").otherwise("Low"))
        .withColumn(
            "context",
            F.when(is4 & (buy | sell | routine), "confirmed_filing").when(is4, "unknown").when(d | g, "confirmed_filing").when(f13, "delayed_ownership").otherwise("unknown"),
        )
        .withColumn("confidence", F.col("insight_confidence"))
    )


def filing_priority(rows: DataFrame, keys: Sequence[str], n: int = 5) -> DataFrame:
    """First n filings per key by form priority, then date. Only n rows per key and task reach
    the shuffle."""
    base = F.split(F.upper("form_type"), "/")[0]
    table = F.create_map(*[F.lit(x) for pair in PRIORITY for x in pair])
    place = F.coalesce(F.try_element_at(table, base), F.lit(9))
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy("priority", "filing_date", "accession_number"))
    return rows.withColumn("priority", place).withColumn("rank", rn).filter(F.col("rank") <= n)


def news_tone(news: DataFrame, bullish: Sequence[str] = BULLISH, bearish: Sequence[str] = BEARISH) -> DataFrame:
    """Keyword presence over the whole text of every item; one pass, nothing exploded."""
    text = F.lower(F.coalesce("text", F.lit("")))
    hits = lambda words: sum((F.contains(F.col("_t"), F.lit(w))).cast("int") for w in words)
    out = news.withColumn("_t", text).withColumn("bullish_score", hits(bullish)).withColumn("bearish_score", hits(bearish)).drop("_t")
    b, r = F.col("bullish_score"), F.col("bearish_score")
    return out.withColumn("importance_score", F.least(F.lit(100), 30 + 15 * (b + r))).withColumn(
        "tone", F.when(b > r, "supportive").when(r > b, "negative").otherwise("unclear")
    )


def surprise(actual: Column, estimate: Column) -> Column:
    ok = (estimate != 0) & (actual != 0)
    return F.when(ok, safe_div(actual - estimate, F.abs(estimate)) * 100)


def earnings_streak(reports: DataFrame, last: int | None = None) -> DataFrame:
    """Beat or miss streak from the latest report, mean and last surprise, over all reports or the `last` ones."""
    rn = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date")))
    rows = reports.withColumn("surprise_pct", surprise(F.col("eps_actual"), F.col("eps_estimate"))).withColumn("rn", rn)
    if last is not None:
        rows = rows.filter(F.col("rn") <= last)
    beat = F.coalesce(F.col("surprise_pct") > 0, F.lit(False))
    out = rows.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("reports"),
        F.min(F.when(~beat, F.col("rn"))).alias("_first_miss"),
        F.min(F.when(beat, F.col("rn"))).alias("_first_beat"),
        F.avg("surprise_pct").alias("average_surprise_pct"),
        F.min_by("surprise_pct", F.when(F.col("surprise_pct").isNotNull(), F.col("rn"))).alias("last_surprise_pct"),
    )
    n = F.col("reports")
    return (
        out.withColumn("beat_streak", F.coalesce(F.col("_first_miss") - 1, n))
        .withColumn("miss_streak", F.coalesce(F.col("_first_beat") - 1, n))
        .withColumn("last_surprise_direction", F.when(F.col("last_surprise_pct") > 0, "beat").when(F.col("last_surprise_pct").isNotNull(), "miss"))
        .drop("_first_miss", "_first_beat")
    )


def earnings_window(dates: DataFrame, as_of: DataFrame, days_ahead: int = 2, n: int = 20) -> tuple[DataFrame, DataFrame]:
    """Reports due within the window, and the next n to come. `as_of` is one row."""
    days = F.datediff(F.col("next_earnings_date"), F.col("as_of"))
    rows = dates.crossJoin(F.broadcast(as_of)).withColumn("days_until", days).filter(F.col("days_until") >= 0)
    return rows.filter(F.col("days_until") <= days_ahead), rows.orderBy("days_until", "ticker").limit(n)


def holdings_delta(previous: DataFrame, current: DataFrame, keys: Sequence[str] = ("manager", "ticker")) -> DataFrame:
    """Change of delayed holdings between two quarters; unchanged positions are dropped.
    `manager_type` may come with the current side."""
    p = previous.select(*keys, F.col("shares").alias("previous_shares"))
    extra = ["manager_type"] if "manager_type" in current.columns else []
    c = current.select(*keys, F.col("shares").alias("current_shares"), *extra)
    both = p.join(c, list(keys), "full_outer")
    a, b = F.coalesce("previous_shares", F.lit(0.0)), F.coalesce("current_shares", F.lit(0.0))
    out = both.withColumn("previous_shares", a).withColumn("current_shares", b).filter(F.col("previous_shares") != F.col("current_shares"))
    a, b = F.col("previous_shares"), F.col("current_shares")
    passive = F.lower(F.col("manager_type")).startswith("passive") if extra else F.lit(False)
    return (
        out.withColumn("transaction_type", F.when((a == 0) & (b > 0), "Delayed 13F new position").when((b == 0) & (a > 0), "Delayed 13F exited position").when(b > a, "Delayed 13F increase").otherwise("Delayed 13F decrease"))
        .withColumn("position_change", F.when((b == 0) & (a > 0), -1.0).when(a != 0, safe_div(b, a) - 1))
        .withColumn(
            "warnings",
            notes(
                (F.lit(True), "13F filings are delayed and do not confirm what the manager owns today."),
                (passive, "Passive index-manager changes should not be interpreted like concentrated active-manager purchases."),
            ),
        )
    )
