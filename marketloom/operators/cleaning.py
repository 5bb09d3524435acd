"""Projections, coercions, symbol and date cleaning, screens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.expr import clip, safe_div, truth

PRICE_COLUMNS = ("adj_close", "Adj Close", "Close", "close")
SYMBOL = r"^[A-Z][A-Z0-9.-]{0,9}$"  # fixed value
WATCHLIST_LIMIT = 25  # fixed value

# fixed values: fund symbols without company fundamentals
ETF_SYMBOLS = (
    "SPY", "QQQ", "IWM", "DIA", "VTI", "VOO", "VGT", "XLK", "XLF", "XLV", "XLY", "XLP", "XLE", "XLI",
    "XLB", "XLU", "XLRE", "XLC", "SMH", "SOXX", "TLT", "IWD", "MTUM", "SPLV",
)

# fixed values: screener thresholds
SCREENERS: dict[str, dict[str, float | bool]] = {
    "quality_momentum": {
        "min_final_score": 60, "min_revenue_growth": 0.05, "min_gross_margin": 0.25, "max_forward_pe": 80,
        "min_rsi": 45, "max_rsi": 78, "require_price_above_sma200": True,
    },
    "technical_breakout": {"min_final_score": 55, "min_relative_volume": 1.2, "require_52w_pressure": True, "require_price_above_sma50": True},
    "value_watch": {"max_forward_pe": 25, "max_price_to_book": 5, "min_final_score": 45},
}


def number(x: Column) -> Column:
    """Text or number to a double; NaN and unreadable text are null."""
    v = x.cast("string").try_cast("double")
    return F.when(~F.isnan(v), v)


def clean_price_series(frame: DataFrame) -> DataFrame:
    """`price` from the first price column the frame has (a choice of column, not of row)."""
    found = [c for c in PRICE_COLUMNS if c in frame.columns]
    if not found:
        raise KeyError("no close or adjusted close column")
    return frame.withColumn("price", number(F.col(f"`{found[0]}`"))).filter(F.col("price").isNotNull())


def safe_numeric(x: Column, default: float | None = None) -> Column:
    v = number(x)
    return v if default is None else F.coalesce(v, F.lit(float(default)))


def clip_score(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.coalesce(clip(number(x), low, high), F.lit(0.0))


def normalize_symbol(x: Column) -> Column:
    return F.replace(F.upper(F.trim(x)), F.lit("/"), F.lit("-"))


def split_symbols(raw: Column) -> Column:
    """Comma list, else blank-separated list; other punctuation makes the text one symbol."""
    text = F.trim(raw)
    pieces = F.when(text.contains(","), F.split(text, ",")).when(text.rlike(r"[^A-Za-z0-9.\-/\s]"), F.array(text)).otherwise(F.split(text, r"\s+"))
    return F.filter(F.transform(pieces, lambda p: F.trim(p)), lambda p: p != "")


def clean_symbols(lists: DataFrame, key: str = "list_id", raw: str = "raw", limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Accepted symbols (first occurrences) and rejected raw values. With a `limit` (a watch list
    takes WATCHLIST_LIMIT) reading stops at the symbol that fills the list, so later rejects are not
    reported. Each list is one row and is handled inside it."""
    items = F.transform(split_symbols(F.col(raw)), lambda p, i: F.struct(i.alias("pos"), p.alias("raw"), normalize_symbol(p).alias("ticker")))
    parsed = lists.select(key, items.alias("_i")).withColumn("_ok", F.filter("_i", lambda s: s["ticker"].rlike(SYMBOL)))
    firsts = F.filter("_ok", lambda s: F.array_position(F.transform("_ok", lambda o: o["ticker"]), s["ticker"]) == F.array_position(F.transform("_ok", lambda o: o["pos"]), s["pos"]))
    parsed = parsed.withColumn("_firsts", firsts).withColumn("_kept", F.col("_firsts") if limit is None else F.slice("_firsts", 1, limit))
    last = F.lit(None).cast("int") if limit is None else F.when(F.size("_firsts") >= limit, F.try_element_at("_kept", F.lit(limit))["pos"])
    accepted = parsed.select(key, F.posexplode("_kept").alias("position", "_s")).select(key, "position", F.col("_s.ticker").alias("ticker"))
    bad = F.filter("_i", lambda s: ~s["ticker"].rlike(SYMBOL))
    rejected = parsed.withColumn("_last", last).withColumn("_bad", bad).select(
        key, "_last", F.explode("_bad").alias("_s")
    ).filter(F.col("_last").isNull() | (F.col("_s.pos") < F.col("_last")))
    return accepted, rejected.select(key, F.col("_s.pos").alias("position"), F.col("_s.raw").alias("raw"))


def valid_symbol_strict(x: Column) -> Column:
    t = F.trim(F.upper(x))
    return truth(t.rlike(r"^[\p{L}\p{N}][\p{L}\p{N}.-]{0,4}$") & ~t.contains("..") & ~t.contains("--"))


def parse_date(x: Column) -> Column:
    """Date from epoch seconds, ISO (with or without zone), m/d/Y, "Mon d, Y", or a JSON list or
    object holding one of these. Unreadable text is null."""
    text = F.trim(x)
    listed = F.from_json(text, "array<string>")
    first = F.try_element_at(F.filter(F.transform(listed, _plain_date), lambda d: d.isNotNull()), F.lit(1))
    obj = F.from_json(text, "map<string,string>")
    keyed = F.coalesce(*[_plain_date(F.try_element_at(obj, F.lit(k))) for k in ("date", "fmt", "raw", "earningsDate")])
    return F.when(text.startswith("["), first).when(text.startswith("{"), keyed).otherwise(_plain_date(text))


def _plain_date(x: Column) -> Column:
    t = F.trim(x)
    seconds = t.try_cast("double")
    epoch = F.when(seconds > 1_000_000_000, F.to_date(F.timestamp_seconds(seconds)))
    iso = F.substring(t, 1, 10)
    return F.coalesce(
        epoch,
        F.when(iso.rlike(r"^\d{4}-\d{2}-\d{2}$"), iso.try_cast("date")),
        _by_format(t, r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
        _by_format(t, r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
        _by_format(t, r"^[A-Za-z]{4,9} \d{1,2}, \d{4}$", "MMMM d, yyyy"),
    )


def _by_format(t: Column, shape: str, fmt: str) -> Column:
    return F.to_date(F.try_to_timestamp(F.when(t.rlike(shape), t), F.lit(fmt)))


def pct_or_fraction(x: Column, default: float = 0.0) -> Column:
    v = safe_numeric(x, default)
    return F.when(F.abs(v) <= 1, v * 100).otherwise(v)


def fundamental_score_columns(f: DataFrame) -> DataFrame:
    """Fundamental points and class of every row; missing inputs score nothing."""
    growth = [F.when(F.col(c) > 0.10, 8).when(F.col(c) < 0, -8).otherwise(0) for c in ("revenue_growth", "eps_growth", "fcf_growth")]
    quality = [F.when(F.col(c) > 0.15, 5).otherwise(0) for c in ("gross_margin", "operating_margin", "net_margin", "roe", "roic")]
    debt = F.when(F.col("debt_to_equity") > 2, -10).otherwise(0)
    rich = F.when((F.col("forward_pe") > 40) & (F.col("eps_growth") < 0.15), -10).otherwise(0)
    total = F.lit(50) + sum(growth) + sum(quality) + debt + rich
    s, rev, pe = F.col("_raw"), F.coalesce("revenue_growth", F.lit(0.0)), F.coalesce("forward_pe", F.lit(0.0))
    label = (
        F.when((s >= 75) & (rev > 0.15), "Quality Compounder")
        .when(s >= 70, "Fundamentally Strong")
        .when(s >= 50, "Fundamentally Average")
        .when((pe != 0) & (pe < 12) & (s < 45), "Cheap but Weak")
        .when((rev > 0.25) & (pe > 50), "High Growth but Expensive")
        .when(s < 35, "Fundamentally Deteriorating")
        .otherwise("Fundamentally Weak")
    )
    return f.withColumn("_raw", total.cast("double")).withColumn("classification", label).withColumn(
        "fundamental_score", F.round(clip(F.col("_raw"), 0.0, 100.0), 2)
    ).drop("_raw")


def clean_fundamentals(raw: DataFrame, funds: Sequence[str] = ETF_SYMBOLS) -> DataFrame:
    """Provider fields to the report's names. A debt ratio above 10 is a percentage; funds carry
    no company fundamentals."""
    fund = F.upper("ticker").isin(*funds)
    dte = number(F.col("debt_to_equity"))
    names = {
        "revenue_growth": "revenue_growth", "eps_growth": "earnings_growth", "fcf_growth": "free_cashflow_growth",
        "gross_margin": "gross_margin", "operating_margin": "operating_margin", "net_margin": "net_margin",
        "roe": "return_on_equity", "roic": "return_on_invested_capital", "forward_pe": "forward_pe",
        "price_to_book": "price_to_book", "enterprise_to_ebitda": "ev_to_ebitda", "market_cap": "market_cap",
    }
    cols = [number(F.col(src)).alias(out) if src in raw.columns else F.lit(None).cast("double").alias(out) for out, src in names.items()]
    fcf, cap = number(F.col("free_cash_flow")), number(F.col("market_cap"))
    out = raw.select(
        F.upper("ticker").alias("ticker"),
        "sector",
        *cols,
        F.when(dte > 10, dte / 100).otherwise(dte).alias("debt_to_equity"),
        F.when((fcf != 0) & (cap > 0), safe_div(fcf, cap)).alias("fcf_yield"),
        (~fund).alias("available"),
        F.when(fund, "ETF").otherwise("Equity").alias("asset_type"),
    )
    out = fundamental_score_columns(out)
    keep = ("ticker", "available", "asset_type")
    blank = [F.when(F.col("available"), F.col(c)).alias(c) for c in out.columns if c not in (*keep, "classification")]
    return out.select(*keep, *blank, F.when(F.col("available"), F.col("classification")).otherwise("ETF / Fund").alias("classification"))


def screen_stock(rows: DataFrame, screeners: dict[str, dict[str, float | bool]] = SCREENERS) -> DataFrame:
    """Every (screener, row) that passes: a missing threshold passes, a missing value fails.
    The screeners are a short literal list expanded in place."""
    out = []
    for name, f in screeners.items():
        checks = [truth(F.coalesce("final_score", F.lit(0.0)) >= f.get("min_final_score", 0))]
        bounds = (
            ("revenue_growth", "min_revenue_growth", None), ("gross_margin", "min_gross_margin", None), ("forward_pe", None, "max_forward_pe"),
            ("price_to_book", None, "max_price_to_book"), ("rsi", "min_rsi", "max_rsi"), ("relative_volume", "min_relative_volume", None),
        )
        for col, low, high in bounds:
            if low in f:
                checks.append(truth(F.col(col) >= f[low]))
            if high in f:
                checks.append(truth(F.col(col) <= f[high]))
        for flag, col in (("require_price_above_sma200", "price_above_sma200"), ("require_price_above_sma50", "price_above_sma50"), ("require_52w_pressure", "breakout")):
            if f.get(flag):
                checks.append(truth(F.col(col)))
        passed = checks[0]
        for c in checks[1:]:
            passed = passed & c
        out.append(F.when(passed, F.lit(name)))
    return rows.withColumn("_hits", F.array_compact(F.array(*out))).withColumn("screener", F.explode("_hits")).drop("_hits")


def first_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rn", rn).filter("_rn = 1").drop("_rn")
