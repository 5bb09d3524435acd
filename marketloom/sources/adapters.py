"""Market views over the star-schema tables.

Every view is a lazy DataFrame. Only `nation` and `region` are broadcast by hand: they are
fixed reference lists (25 and 5 rows at any scale). All other joins are left to the
planner, which broadcasts on measured size and shuffles otherwise.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from marketloom.session import keep


class Market:
    """The tables of one data folder and the views derived from them."""

    def __init__(self, spark: SparkSession, folder: str, level: str = "nation", keep_bars: bool = True):
        self.spark = spark
        self.folder = folder
        self.level = level
        self.keep_bars = keep_bars

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def places(self) -> DataFrame:
        return F.broadcast(
            self.table("nation")
            .join(F.broadcast(self.table("region")), F.col("n_regionkey") == F.col("r_regionkey"))
            .select("n_nationkey", F.col("n_name"), F.col("r_name"))
        )

    @cached_property
    def fills(self) -> DataFrame:
        """One row per trade: ticker, sector, date, sequence, price in cents, size."""
        cents = F.round(F.col("l_extendedprice") / F.col("l_quantity") * 100).cast("long")
        ticker = F.col("n_name") if self.level == "nation" else F.concat(F.lit("S"), F.col("l_suppkey"))
        sequence = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1024 + F.col("cents") % 1024
        return (
            self.table("lineitem")
            .join(self.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
            .join(self.places, F.col("s_nationkey") == F.col("n_nationkey"))
            .select(
                ticker.alias("ticker"),
                F.col("r_name").alias("sector"),
                F.to_date("l_shipdate").alias("date"),
                "l_orderkey",
                "l_linenumber",
                cents.alias("cents"),
                F.col("l_quantity").alias("size"),
            )
            .withColumn("sequence", sequence)
        )

    @cached_property
    def bars(self) -> DataFrame:
        """Daily OHLCV, kept for the plans of a session that share it: most reports read bars
        several times, and bars are the small daily digest of the trades.

        Trades collapse map-side to one buffer per (ticker, day) before any
        shuffle, so a ticker holding a third of all trades costs no more than another; all
        buffers are fixed width, which keeps the aggregate hash-based. The price is damped
        around the ticker's mean trade price so compounded returns stay finite."""
        daily = self.fills.groupBy("ticker", "sector", "date").agg(
            F.min_by("cents", "sequence").alias("o"),
            F.max("cents").alias("h"),
            F.min("cents").alias("l"),
            F.max_by("cents", "sequence").alias("c"),
            F.sum("size").alias("volume"),
            F.sum("cents").alias("total"),
            F.count(F.lit(1)).alias("trades"),
        )
        whole = Window.partitionBy("ticker")
        base = F.sum("total").over(whole).cast("double") / F.sum("trades").over(whole) / 100

        def price(name: str) -> Column:
            return F.round(100 * F.pow(F.col(name) / 100.0 / F.col("base"), F.lit(0.02)), 4)

        out = daily.withColumn("base", base).select(
            "ticker",
            "sector",
            "date",
            price("o").alias("open"),
            price("h").alias("high"),
            price("l").alias("low"),
            price("c").alias("close"),
            "volume",
        )
        return keep(out) if self.keep_bars else out

    @cached_property
    def benchmark(self) -> DataFrame:
        """Equal-weight market close by date (exact integer sums, so it is order-free)."""
        return self._proxy("date")

    @cached_property
    def sector_proxy(self) -> DataFrame:
        return self._proxy("sector", "date")

    def _proxy(self, *keys: str) -> DataFrame:
        points = F.round(F.col("close") * 10000).cast("long")
        return self.bars.groupBy(*keys).agg(
            (F.sum(points).cast("double") / F.count(F.lit(1)) / 10000).alias("close")
        )

    @cached_property
    def positions(self) -> DataFrame:
        """Portfolio = market segment; a holding's shares = customers of that nation. Each segment holds
        another three quarters of the nations."""
        return (
            self.table("customer")
            .filter((F.col("c_nationkey") + F.length("c_mktsegment")) % 4 != 0)
            .join(self.places, F.col("c_nationkey") == F.col("n_nationkey"))
            .groupBy(
                F.col("c_mktsegment").alias("portfolio_id"),
                F.col("n_name").alias("ticker"),
                F.col("r_name").alias("sector"),
            )
            .agg(
                F.count(F.lit(1)).cast("double").alias("shares"),
                (F.sum(F.round(F.col("c_acctbal") * 100).cast("long")).cast("double") / F.count(F.lit(1)) / 5000).alias("cost_basis"),
            )
        )

    @cached_property
    def fundamentals(self) -> DataFrame:
        """Per-ticker accounting ratios from order lines; growth is the last against the
        previous 365 days. A few entries are null so that coverage rules are exercised."""
        lines = (
            self.table("lineitem")
            .join(self.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
            .join(self.places, F.col("s_nationkey") == F.col("n_nationkey"))
            .select(
                F.col("n_name").alias("ticker"),
                F.col("r_name").alias("sector"),
                F.col("n_nationkey").alias("k"),
                F.to_date("l_shipdate").alias("date"),
                F.col("l_extendedprice").alias("ext"),
                F.col("l_quantity").alias("qty"),
                F.col("l_discount").alias("disc"),
                F.col("l_tax").alias("tax"),
                (F.col("l_returnflag") == "R").cast("double").alias("returned"),
            )
        )
        daily = lines.groupBy("ticker", "sector", "k", "date").agg(
            F.sum("ext").alias("ext"),
            F.sum("qty").alias("qty"),
            F.sum(F.col("ext") * F.col("disc")).alias("disc"),
            F.sum(F.col("ext") * F.col("tax")).alias("tax"),
            F.sum("returned").alias("returned"),
            F.count(F.lit(1)).alias("n"),
        )
        age = F.datediff(F.max("date").over(Window.partitionBy("ticker")), F.col("date"))
        recent, prior = F.col("age") < 365, (F.col("age") >= 365) & (F.col("age") < 730)

        def growth(name: str) -> Column:
            return F.sum(F.when(recent, F.col(name))) / F.sum(F.when(prior, F.col(name))) - 1

        grown = daily.withColumn("age", age).groupBy("ticker", "sector", "k").agg(
            growth("ext").alias("revenue_growth"),
            growth("qty").alias("earnings_growth"),
            growth("disc").alias("free_cashflow_growth"),
            growth("tax").alias("analyst_revision"),
            (1 - (F.sum("disc") + F.sum("tax")) * 6 / F.sum("ext")).alias("gross_margin"),
            (1 - F.sum("disc") * 15 / F.sum("ext")).alias("operating_margin"),
            (1 - F.sum("tax") * 21 / F.sum("ext")).alias("net_margin"),
            (F.sum("returned") / F.sum("n")).alias("return_on_equity"),
            (F.sum("returned") / F.sum("n") - 0.1).alias("return_on_invested_capital"),
            (F.sum("ext") / F.sum("qty") / 100).alias("forward_pe"),
            (F.sum("qty") / F.sum("n") / 8).alias("price_to_book"),
            (F.sum("ext") / F.sum("n") / 4000).alias("ev_to_ebitda"),
            (F.sum("disc") / F.sum("ext") / 2).alias("fcf_yield"),
            (F.sum("tax") * 30 / F.sum("ext")).alias("debt_to_equity"),
            F.sum("ext").alias("market_cap"),
        )
        rounded = [
            F.round(F.col(c), 6).alias(c) for c in grown.columns if c not in ("ticker", "sector", "k", "market_cap")
        ]
        out = grown.select("ticker", "sector", "k", *rounded, F.round("market_cap", 2).alias("market_cap"))
        return (
            out.withColumn("forward_pe", F.when(F.col("k") % 7 != 3, F.col("forward_pe")))
            .withColumn("gross_margin", F.when(F.col("k") % 11 != 5, F.col("gross_margin")))
            .withColumn("analyst_revision", F.when(F.col("k") % 5 != 1, F.col("analyst_revision")))
            .withColumn("debt_to_equity", F.when(F.col("k") % 4 == 2, F.col("debt_to_equity") * 100).otherwise(F.col("debt_to_equity")))
        )

    @cached_property
    def option_chain(self) -> DataFrame:
        spot = F.col("p_retailprice")
        return self.table("part").select(
            F.col("p_partkey").alias("contract_id"),
            F.col("p_brand").alias("underlying"),
            (30 + 5 * F.col("p_size")).cast("int").alias("expiration_days"),
            F.round(spot * (0.8 + F.col("p_partkey") % 41 / 100.0), 4).alias("strike"),
            spot.alias("spot"),
            F.lit(0.03).alias("rate"),
            (0.1 + F.col("p_size") / 100.0 + F.col("p_partkey") % 7 / 100.0).alias("implied_volatility"),
            F.when(F.col("p_partkey") % 2 == 0, "call").otherwise("put").alias("option_type"),
        )

    @cached_property
    def news(self) -> DataFrame:
        return (
            self.table("documents")
            .withColumn("k", (F.col("doc_id") % 25).cast("int"))
            .join(self.places, F.col("k") == F.col("n_nationkey"))
            .select("doc_id", F.col("n_name").alias("ticker"), "text", "source")
        )

    @cached_property
    def book(self) -> DataFrame:
        """Levels of a book snapshot: one snapshot per hour and venue (user_id mod 5)."""
        return (
            self.table("events")
            .select(
                F.concat_ws("-", F.date_format("ts", "yyyyMMddHH"), (F.col("user_id") % 5).cast("string")).alias("snapshot_id"),
                F.when(F.col("event_type").isin("view", "signup"), "bid").otherwise("ask").alias("side"),
                F.when(F.col("event_type").isin("view", "signup"), 500 - F.col("value") / 10).otherwise(501 + F.col("value") / 10).alias("price"),
                F.get_json_object("props", "$.k").cast("double").alias("size"),
                "event_id",
            )
        )

    @cached_property
    def trades(self) -> DataFrame:
        """Journal entries: view and signup buy, the other events sell, per ticker in event order."""
        return (
            self.table("events")
            .withColumn("k", (F.col("user_id") % 25).cast("int"))
            .join(self.places, F.col("k") == F.col("n_nationkey"))
            .select(
                F.col("event_id").alias("trade_id"),
                F.col("n_name").alias("ticker"),
                F.when(F.col("event_type").isin("view", "signup"), "buy").otherwise("sell").alias("action"),
                F.get_json_object("props", "$.k").cast("double").alias("shares"),
                F.col("value").alias("price"),
                F.to_date("ts").alias("date"),
                F.col("ts"),
            )
        )

    @cached_property
    def alt_data(self) -> DataFrame:
        """Daily level per source (event type) and ticker; the value is an exact count of cents."""
        return (
            self.table("events")
            .withColumn("k", (F.col("user_id") % 25).cast("int"))
            .join(self.places, F.col("k") == F.col("n_nationkey"))
            .groupBy(F.to_date("ts").alias("date"), F.col("event_type").alias("source"), F.col("n_name").alias("ticker"))
            .agg((F.sum(F.round(F.col("value") * 100).cast("long")).cast("double") / 100).alias("value"))
        )

    @cached_property
    def earnings(self) -> DataFrame:
        """One report per customer and day (a customer's history is bounded by its dates); the
        estimate is the previous report."""
        daily = self.table("orders").groupBy(F.col("o_custkey").alias("ticker"), F.to_date("o_orderdate").alias("date")).agg(
            (F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).cast("double") / 100).alias("eps_actual")
        )
        w = Window.partitionBy("ticker").orderBy("date")
        return daily.withColumn("eps_estimate", F.lag("eps_actual").over(w))

    @cached_property
    def intraday(self) -> DataFrame:
        """Five-minute bars of the event stream, ticker = user_id mod 25."""
        cents = F.round(F.col("value") * 100).cast("long")
        return (
            self.table("events")
            .select(
                F.concat(F.lit("U"), F.col("user_id") % 25).alias("ticker"),
                F.col("ts").cast("timestamp").alias("ts"),
                "event_id",
                cents.alias("cents"),
                F.get_json_object("props", "$.k").cast("double").alias("size"),
            )
            .groupBy("ticker", F.window("ts", "5 minutes").start.alias("ts"))
            .agg(
                (F.min_by("cents", "event_id") / 100.0).alias("open"),
                (F.max("cents") / 100.0).alias("high"),
                (F.min("cents") / 100.0).alias("low"),
                (F.max_by("cents", "event_id") / 100.0).alias("close"),
                F.sum("size").alias("volume"),
            )
        )
