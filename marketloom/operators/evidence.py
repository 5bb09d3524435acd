"""Evidence structs, conclusions, confidence, and nested report rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.expr import clip, mean_of, notes, safe_div, truth
from marketloom.functions.rolling import with_position
from marketloom.operators.indicators import snapshot

# fixed values: weight of an evidence importance
IMPORTANCE = (("low", 1), ("medium", 2), ("high", 3))


def item(signal: str, category: str, value: Column, text: Column | str, direction: str | Column, importance: str, kind: str) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        F.lit(signal).alias("signal"),
        F.lit(category).alias("category"),
        value.cast("string").alias("observed_value"),
        lit(text).alias("interpretation"),
        lit(direction).alias("direction"),
        F.lit(importance).alias("importance"),
        F.lit(kind).alias("kind"),
    )


def collect(*rules: tuple[Column, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(truth(c), s) for c, s in rules]))


def moving_averages(bars: DataFrame) -> DataFrame:
    recent = with_position(bars).filter(F.col("rn") <= 50)
    return recent.groupBy("ticker").agg(
        F.max("n_rows").alias("rows"),
        F.avg(F.when(F.col("rn") <= 20, F.col("close"))).alias("mean20"),
        F.avg("close").alias("mean50"),
    )


def stock_evidence(bars: DataFrame, fundamentals: DataFrame) -> DataFrame:
    """Snapshot and history to evidence lists, trend, volume status, confidence and view."""
    rows = snapshot(bars, fundamentals).join(moving_averages(bars), "ticker", "left")
    d, five, vr, price = (F.col(c) for c in ("daily_change_pct", "five_day_change_pct", "volume_ratio", "price"))
    known = d.isNotNull()
    short = F.col("rows") < 50
    m20, m50 = F.col("mean20"), F.col("mean50")
    up = ~short & (price > m20) & (m20 > m50)
    down = ~short & (price < m20) & (m20 < m50)
    heavy = vr >= 1.8
    good = F.coalesce(d, F.lit(0.0)) >= 0
    vol_text = F.concat(F.lit("Trading volume was about "), F.format_string("%.1f", vr), F.lit("x its normal level."))
    positives = collect(
        (d >= 0.03, item("Strong daily gain", "price", d, "The stock rose meaningfully today.", "positive", "medium", "fact")),
        (known & (five >= 0.04), item("Five-day improvement", "price", five, "The stock has been improving over the past week.", "positive", "medium", "calculation")),
        (heavy & good, item("Unusual volume", "volume", vr, vol_text, "positive", "high", "fact")),
        (up, item("Improving trend", "trend", price, "Price is above recent trend levels, which supports an improving read.", "positive", "high", "calculation")),
    )
    negatives = collect(
        (d <= -0.03, item("Sharp daily decline", "price", d, "The stock fell meaningfully today.", "negative", "medium", "fact")),
        (known & (five <= -0.04), item("Five-day weakness", "price", five, "The stock has weakened over the past week.", "negative", "medium", "calculation")),
        (heavy & ~good, item("Unusual volume", "volume", vr, vol_text, "negative", "high", "fact")),
        (down, item("Weakening trend", "trend", price, "Price is below recent trend levels, so the trend remains weak.", "negative", "high", "calculation")),
    )
    neutrals = collect(
        (~known, item("Daily move unavailable", "price", d, "Daily price movement could not be calculated.", "unknown", "medium", "calculation")),
        (known & (F.abs(d) < 0.03), item("Normal daily move", "price", d, "The daily move was not large enough to matter by itself.", "neutral", "low", "fact")),
        (vr.isNull(), item("Volume unavailable", "volume", vr, "Volume behavior could not be evaluated.", "unknown", "medium", "unknown")),
        (vr < 1.8, item("Normal volume", "volume", vr, "Volume was not unusual.", "neutral", "low", "fact")),
        (short, item("Short history", "trend", F.col("rows"), "There is not enough history for a reliable trend read.", "unknown", "medium", "unknown")),
        (~short & ~truth(up) & ~truth(down), item("Mixed trend", "trend", price, "Trend evidence is mixed rather than clearly improving or weakening.", "neutral", "medium", "calculation")),
    )
    unknowns = notes(
        (F.col("error").isNotNull(), F.col("error")),
        (F.col("rows").isNull(), "Not enough price history to evaluate moving-average trend."),
        (F.col("revenue_growth").isNull(), "Revenue growth is unavailable."),
        (F.col("earnings_growth").isNull(), "Earnings growth is unavailable."),
        (F.col("net_margin").isNull(), "Profit margin is unavailable."),
        (F.col("forward_pe").isNull(), "Forward P/E is unavailable."),
    )
    out = (
        rows.withColumn("positive_evidence", positives)
        .withColumn("negative_evidence", negatives)
        .withColumn("neutral_evidence", neutrals)
        .withColumn("unknowns", unknowns)
    )
    pos, neg, unk = F.size("positive_evidence"), F.size("negative_evidence"), F.size("unknowns")
    cats = F.size(F.array_distinct(F.transform(F.concat("positive_evidence", "negative_evidence"), lambda e: e["category"])))
    out = (
        out.withColumn(
            "trend",
            F.when(F.exists("positive_evidence", lambda e: e["signal"] == "Improving trend"), "Improving")
            .when(F.exists("negative_evidence", lambda e: e["signal"] == "Weakening trend"), "Weakening")
            .when((unk > 0) & (pos == 0) & (neg == 0), "Unavailable")
            .otherwise("Stable"),
        )
        .withColumn("volume_status", F.when(vr.isNull(), "Unavailable").when(heavy, "Unusual volume").otherwise("Normal volume"))
        .withColumn(
            "confidence",
            F.when(price.isNull(), "Insufficient Data").when((cats >= 3) & (unk <= 2), "High").when((cats >= 2) & (unk <= 4), "Medium").otherwise("Low"),
        )
    )
    t = F.col("trend")
    return out.withColumn(
        "overall_view",
        F.when(F.col("confidence") == "Insufficient Data", "Not Enough Evidence")
        .when(neg >= 3, "High Risk")
        .when((t == "Improving") & (pos >= 2), "Positive")
        .when(t == "Weakening", "Cautious")
        .when(pos + neg > 0, "Worth Watching")
        .otherwise("Mixed"),
    ).withColumn("attention", attention())


def attention() -> Column:
    weight = F.create_map(*[F.lit(x) for pair in IMPORTANCE for x in pair])
    total = F.aggregate(F.concat("positive_evidence", "negative_evidence"), F.lit(0), lambda a, e: a + weight[e["importance"]])
    return (
        total
        + F.when(F.col("volume_status") == "Unusual volume", 3).otherwise(0)
        + F.when(F.col("trend").isin("Improving", "Weakening"), 2).otherwise(0)
        - F.when(F.col("confidence") == "Low", 1).otherwise(0)
    )


def opportunities(analyses: DataFrame, n: int = 5) -> DataFrame:
    """The most attention-worthy stocks with enough confidence and a telling view."""
    from marketloom.operators.scores import top_k

    fit = analyses.filter(F.col("confidence").isin("Medium", "High") & F.col("overall_view").isin("Positive", "Worth Watching", "Cautious"))
    return top_k(fit, (F.desc("attention"), F.asc("ticker")), n)


CATEGORY = "name string, conclusion string, supporting array<string>, contradicting array<string>, confidence string, freshness string, validation_status string"


def aggregate_evidence(categories: DataFrame, keys: Sequence[str], order: str, event_risk: Column, structural_break: Column, risks_each: int | None = None, reasons: int | None = None) -> DataFrame:
    """Categories of a subject to one conclusion. Failed ones are dropped first. A subject has a
    handful of categories; `order` gives their place. `risks_each` cuts the counter-arguments taken from a
    category, `reasons` the list of conclusions."""
    from marketloom.operators.scores import first_of

    usable = categories.filter(~F.col("validation_status").isin("failed_validation", "error"))
    rows = usable.withColumn("_event", event_risk).withColumn("_break", structural_break)
    entry = F.struct(F.col(order).alias("o"), "conclusion", "supporting", "contradicting")
    g = rows.groupBy(*keys).agg(
        F.sort_array(F.collect_list(entry)).alias("_l"), F.coalesce(F.bool_or("_event"), F.lit(False)).alias("_event"), F.coalesce(F.bool_or("_break"), F.lit(False)).alias("_break")
    )
    pos = F.filter("_l", lambda e: F.size(e["supporting"]) > 0)
    neg = F.filter("_l", lambda e: F.size(e["contradicting"]) > 0)
    found = F.flatten(F.transform(neg, lambda e: first_of(e["contradicting"], risks_each)))
    lead = notes(
        (F.col("_event"), "Upcoming event risk caps confidence."), (F.col("_break"), "A structural break may invalidate relative-value evidence.")
    )
    why = first_of(F.transform(pos, lambda e: e["conclusion"]), reasons)
    risks = F.concat(lead, found)
    np_, nn = F.size(pos), F.size(neg)
    one = lambda text: F.array(F.lit(text))
    return g.select(
        *keys,
        F.when((np_ > 0) & (np_ >= nn), "Worth Watching").when(np_ > 0, "Mixed Evidence").otherwise("Not Enough Evidence").alias("overall_view"),
        F.when((np_ >= 3) & ~F.col("_event") & ~F.col("_break"), "Medium").otherwise("Low").alias("confidence"),
        F.when(F.size(why) > 0, why).otherwise(one("No validated model evidence is strong enough yet.")).alias("why"),
        F.when(F.size(risks) > 0, risks).otherwise(one("Evidence could weaken if price breaks support on heavy volume.")).alias("main_risks"),
        np_.alias("supporting_categories"),
        nn.alias("contradicting_categories"),
    )


def confidence_level(
    price: Column, intraday: Column, fundamentals: Column, filings: Column, categories: Column, contradicting: Column,
    agreement: Column, sample: Column, earnings: Column, confounders: Column, change: Column,
) -> Column:
    """Additive confidence with abstention."""
    yes = lambda c, a, b=0: F.when(truth(c), a).otherwise(b)
    s = (
        yes(price, 20, -20)
        + yes(intraday, 10)
        + yes(fundamentals, 10)
        + yes(filings, 12)
        + F.least(categories, F.lit(4)) * 10
        - contradicting * 10
        + F.when(agreement == "High", 10).when(agreement == "Medium", 4).otherwise(0)
        + F.when(sample >= 60, 10).when(sample >= 20, 4).otherwise(-5)
        - yes(earnings, 15)
        - confounders * 12
        - yes(change, 20)
    )
    return (
        F.when(~truth(price) & (categories == 0), "Insufficient Data").when(s >= 70, "High").when(s >= 40, "Medium").when(s >= 15, "Low").otherwise("Insufficient Data")
    )


def intraday_scores(bars: DataFrame) -> DataFrame:
    """Closing pressure and VWAP behaviour of each ticker's latest session of intraday bars
    (a session is bounded by its five-minute slots)."""
    day = F.to_date("ts")
    session = bars.withColumn("day", day)
    last = session.groupBy("ticker").agg(F.max("day").alias("day"))
    rows = with_position(session.join(last, ["ticker", "day"]), ("ticker",), "ts")
    tail = F.col("rn") <= 6
    vwap = F.sum(F.col("close") * F.col("volume")).over(Window.partitionBy("ticker")) / F.nullif(F.sum("volume").over(Window.partitionBy("ticker")), F.lit(0.0))
    g = rows.withColumn("_vwap", vwap).groupBy("ticker").agg(
        F.max("n_rows").alias("n"),
        F.max(F.when(F.col("rn") == 1, F.col("close"))).alias("c1"),
        F.max(F.when(F.col("rn") == 6, F.col("close"))).alias("c6"),
        F.sum(F.when(tail, F.col("volume"))).alias("v6"),
        F.sum("volume").alias("v"),
        F.min("low").alias("lo"),
        F.max("high").alias("hi"),
        F.max("_vwap").alias("vwap"),
        F.avg((F.col("close") > F.col("_vwap")).cast("double")).alias("above"),
    )
    place = (F.col("c1") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(0.01))
    closing = 45 + (safe_div(F.col("c1"), F.col("c6")) - 1) * 1000 + F.col("v6") / F.greatest(F.col("v"), F.lit(1.0)) * 80 + place * 20
    behave = 35 + F.col("above") * 40 + F.when(F.col("c1") > F.col("vwap"), 25).otherwise(0)
    return g.select(
        "ticker",
        F.when(F.col("n") >= 6, clip(closing, 0.0, 100.0)).alias("closing_pressure"),
        F.when(F.col("v") > 0, clip(behave, 0.0, 100.0)).alias("vwap_behavior"),
    )


def filing_confirmation(filings: DataFrame) -> DataFrame:
    """Strongest filing evidence per ticker."""
    form, t = F.upper("form_type"), F.coalesce("transaction_type", F.lit(""))
    s = (
        F.when(form.startswith("SC 13D"), 85.0).when(form.startswith("SC 13G"), 72.0).when(t == "Open-market purchase", 78.0).when(t.startswith("Delayed 13F"), 55.0).otherwise(0.0)
    )
    return filings.groupBy("ticker").agg(F.max(s).alias("filing_confirmation"))


def whale_activity(bars: DataFrame, confounders: DataFrame, filings: DataFrame, intraday: DataFrame | None = None) -> DataFrame:
    """Is trading consistent with larger buyers or sellers? Mean of the available components,
    less confounders, mapped to a level. `filings`: ticker, filing_confirmation; `confounders`:
    ticker, confounders, earnings_near; `intraday`: output of intraday_scores."""
    last80 = with_position(bars.select("ticker", "date", "close", "volume")).filter(F.col("rn") <= 80)
    by = Window.partitionBy("ticker").orderBy("date")
    per = Window.partitionBy("ticker")
    rows = last80.withColumn("ret", safe_div(F.col("close"), F.lag("close").over(by)) - 1).withColumn("valid", F.count(F.lit(1)).over(per))
    rows = rows.withColumn("base", F.percentile(F.when(F.col("rn") <= 60, F.col("volume")), F.lit(0.5)).over(per))
    in20, in10 = F.col("rn") <= 20, F.col("rn") <= 10
    r10 = F.when(in10 & (F.col("rn") < 10), F.col("ret"))  # the first of ten rows has no return
    heavy = F.col("volume") > F.col("base") * 1.2
    g = rows.groupBy("ticker").agg(
        F.max("valid").alias("valid"),
        F.max("base").alias("base"),
        F.max(F.when(F.col("rn") == 1, F.col("volume"))).alias("v"),
        F.percentile(F.when(F.col("rn") <= 60, F.abs(F.col("volume") - F.col("base"))), F.lit(0.5)).alias("mad"),
        F.max(F.when(F.col("rn") == 1, F.col("ret"))).alias("ret"),
        F.stddev_samp(F.when(in20 & (F.col("rn") < 20), F.col("ret"))).alias("sd"),
        F.sum(F.when((r10 > 0) & heavy, 1).otherwise(0)).alias("up_heavy"),
        F.sum(F.when((r10 < 0) & heavy, 1).otherwise(0)).alias("down_heavy"),
        F.sum(F.when(r10 > 0, F.col("volume")).when(r10 < 0, -F.col("volume")).otherwise(0.0)).alias("obv"),
    )
    out = g.join(confounders.select("ticker", "confounders", "earnings_near"), "ticker", "left").join(filings, "ticker", "left")
    if intraday is None:
        out = out.withColumn("closing_pressure", F.lit(None).cast("double")).withColumn("vwap_behavior", F.lit(None).cast("double"))
    else:
        out = out.join(intraday, "ticker", "left")
    base, v = F.col("base"), F.col("v")
    mad = F.when(F.col("mad") == 0, base).otherwise(F.col("mad"))
    nc = F.coalesce(F.size("confounders"), F.lit(0))
    has_intraday = F.col("vwap_behavior").isNotNull() | F.col("closing_pressure").isNotNull()
    sd = F.coalesce(F.nullif("sd", F.lit(0.0)), F.lit(0.02))
    out = (
        out.withColumn("n_confounders", nc)
        .withColumn("volume_anomaly", F.when(base <= 0, 0.0).otherwise(clip(35 + v / base * 20 + (v - base) / (1.4826 * mad) * 10, 0.0, 100.0)))
        .withColumn("price_response", clip(50 + F.col("ret") / F.greatest(sd, F.lit(0.005)) * 18, 0.0, 100.0))
        .withColumn("accumulation", clip(45 + F.col("up_heavy") * 10 - F.col("down_heavy") * 12 + F.when(F.col("obv") > 0, 15).otherwise(-10), 0.0, 100.0))
        .withColumn("filing_confirmation", F.coalesce("filing_confirmation", F.lit(0.0)))
        .withColumn("reliability", clip(55 + F.least(F.col("valid"), F.lit(80)) * 0.3 - F.when(has_intraday, 0).otherwise(10) - nc * 15, 0.0, 100.0))
    )
    va, pr, ac, cp, vb, fc, rel = (
        F.col(c) for c in ("volume_anomaly", "price_response", "accumulation", "closing_pressure", "vwap_behavior", "filing_confirmation", "reliability")
    )
    distribution = (va >= 65) & (pr <= 35)
    ready = F.col("valid") >= 25
    raw = mean_of(va, pr, cp, vb, ac, fc, rel)
    raw = F.when(F.col("n_confounders") > 0, F.greatest(F.lit(0.0), raw - 10 * F.least(F.col("n_confounders"), F.lit(3)))).otherwise(raw)
    ev = notes(
        (va >= 70, "Volume anomaly"), (pr >= 65, "Positive price response"), (ac >= 65, "Multi-day accumulation pattern"),
        (cp >= 65, "Late-day strength"), (vb >= 65, "VWAP behavior"), (fc >= 65, "Filing confirmation"),
    )
    against = notes((~truth(pr >= 65) & (pr <= 35), "Weak price response"), (distribution, "Distribution risk"))
    out = out.withColumn("raw_score", F.when(ready, raw)).withColumn("evidence", F.when(ready, ev)).withColumn("contradicting", F.when(ready, against))
    s, ne = F.col("raw_score"), F.size("evidence")
    level = (
        F.when(~ready, "Insufficient Data")
        .when(distribution, "Distribution Risk")
        .when(s.isNull() | (rel < 30), "Insufficient Data")
        .when((s >= 72) & (ne >= 3) & (F.col("n_confounders") == 0), "High")
        .when((s >= 55) & (ne >= 2), "Elevated")
        .otherwise("Normal")
    )
    cats = F.when(F.exists("evidence", lambda e: e != "Filing confirmation"), 1).otherwise(0) + F.when(fc >= 65, 1).otherwise(0)
    no = F.lit(False)
    conf = confidence_level(
        F.lit(True), has_intraday, no, fc > 0, cats, F.size("contradicting"), F.when(s > 55, "Medium").otherwise("Unknown"), F.lit(0), F.col("earnings_near"), F.col("n_confounders"), no
    )
    return out.withColumn("level", level).withColumn("confidence", F.when(ready, conf).otherwise("Insufficient Data"))


def driver_ranking(rows: DataFrame, contributions: str, n: int = 5) -> DataFrame:
    """Largest positive and negative contributions of a map column, by size."""
    entries = F.map_entries(F.col(contributions))
    ranked = F.array_sort(
        F.transform(entries, lambda e: F.struct((-F.abs(e["value"])).alias("size"), e["key"].alias("name"), e["value"].alias("value")))
    )
    up = F.slice(F.filter(ranked, lambda e: e["value"] > 0), 1, n)
    down = F.slice(F.filter(ranked, lambda e: e["value"] < 0), 1, n)
    name = lambda a: F.transform(a, lambda e: e["name"])
    return rows.withColumn("positive_drivers", name(up)).withColumn("negative_drivers", name(down))


# fixed values: fields every signal record must carry
REQUIRED = ("signal", "thesis", "evidence", "assumptions", "failure_modes", "regime_weaknesses", "confidence", "uncertainty")


def envelope_check(rows: DataFrame, column: str = "record") -> DataFrame:
    """Validate signal records held as string maps: missing fields, non-empty evidence and
    failure modes, and a label for the confidence."""
    need = F.array(*[F.lit(x) for x in REQUIRED])
    missing = F.array_sort(F.array_except(need, F.map_keys(column)))
    full = lambda k: F.length(F.coalesce(F.try_element_at(F.col(column), F.lit(k)), F.lit(""))) > 0
    c = F.try_element_at(F.col(column), F.lit("confidence")).try_cast("double")
    return (
        rows.withColumn("missing_fields", missing)
        .withColumn("valid", (F.size(missing) == 0) & full("evidence") & full("failure_modes"))
        .withColumn(
            "uncertainty_label",
            F.when(c >= 80, "Lower uncertainty").when(c >= 60, "Moderate uncertainty").when(c >= 40, "High uncertainty").otherwise("Insufficient evidence"),
        )
    )


def model_gate(results: DataFrame) -> DataFrame:
    """Only finished models with enough confidence contribute."""
    return results.filter((F.col("status") == "success") & (F.col("confidence") != "Insufficient Data"))


# fixed values: order of the lead categories
LEADS = ("Relative-Value Watch", "Observed market behavior", "Confirmed filing", "Model estimate")


def opportunity_union(pairs: DataFrame, activity: DataFrame, insights: DataFrame, scenarios: DataFrame, n: int = 6) -> DataFrame:
    """Leads of four kinds, each with its own filter, first n in kind order."""
    from marketloom.operators.scores import top_k

    up, down = F.col("ending_higher_pct"), F.col("down_10_pct")
    parts = (
        pairs.filter(F.col("relationship_status").isin("Moderate Divergence", "Unusual Divergence") & F.col("confidence").isin("Medium", "High")).select(
            F.lit(0).alias("kind"), F.concat_ws("/", "a", "b").alias("subject"), F.col("relationship_status").alias("title"), "confidence"
        ),
        activity.filter(F.col("level").isin("High", "Elevated", "Distribution Risk")).select(
            F.lit(1).alias("kind"), F.col("ticker").alias("subject"), F.concat(F.lit("Whale Activity: "), F.col("level")).alias("title"), "confidence"
        ),
        insights.select(F.lit(2).alias("kind"), F.col("ticker").alias("subject"), F.col("headline").alias("title"), "confidence"),
        scenarios.filter(((up >= 58) & (down <= 18)) | (down >= 25)).select(
            F.lit(3).alias("kind"),
            F.col("ticker").alias("subject"),
            F.when((up >= 58) & (down <= 18), "Favorable scenario balance").otherwise("Meaningful downside frequency").alias("title"),
            "confidence",
        ),
    )
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    names = F.array(*[F.lit(x) for x in LEADS])
    return top_k(rows, (F.asc("kind"), F.asc("subject"), F.asc("title")), n).withColumn("category", F.get(names, F.col("kind")))


def stock_bundle(parts: dict[str, DataFrame], pairs: DataFrame) -> DataFrame:
    """One nested row per ticker: a struct per analysis, and the pairs either leg takes part in.
    All parts are keyed by ticker; the pair list of a ticker is its curated peers."""
    out = None
    for name, df in parts.items():
        fields = [c for c in df.columns if c != "ticker"]
        part = df.select("ticker", F.struct(*fields).alias(name))
        out = part if out is None else out.join(part, "ticker", "left")
    legs = pairs.withColumn("ticker", F.explode(F.array("a", "b")))
    listed = legs.groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct(*pairs.columns))).alias("pairs"))
    return out.join(listed, "ticker", "left").withColumn("pair_count", F.coalesce(F.size("pairs"), F.lit(0)))
