"""Fixed schemas of the persisted tables and of the nested document types."""

from __future__ import annotations

from pyspark.sql import types as T


def _table(keys: str, doubles: str = "", texts: str = "", longs: str = "") -> T.StructType:
    fields = []
    for k in keys.split():
        kind = T.DateType() if k in ("date", "expiration") else T.LongType() if k in ("id", "signal_id") else T.DoubleType() if k == "strike" else T.StringType()
        fields.append(T.StructField(k, kind, True))
    fields += [T.StructField(c, T.DoubleType()) for c in doubles.split()]
    fields += [T.StructField(c, T.StringType()) for c in texts.split()]
    fields += [T.StructField(c, T.LongType()) for c in longs.split()]
    return T.StructType(fields)


# table: (key columns, schema); `news_events` is append-only and has no key
TABLES: dict[str, tuple[tuple[str, ...], T.StructType]] = {
    "stocks": (("ticker",), _table("ticker", "", "company_name sector industry updated_at")),
    "price_history": (("ticker", "date"), _table("ticker date", "open high low close volume")),
    "technical_metrics": (("ticker", "date"), _table("ticker date", "sma20 sma50 sma200 ema20 ema50 rsi macd atr")),
    "fundamental_metrics": (
        ("ticker", "date"),
        _table("ticker date", "revenue_growth eps_growth fcf_growth margins roe roic debt_to_equity forward_pe peg", "payload_json"),
    ),
    "stock_scores": (
        ("ticker", "date"),
        _table(
            "ticker date",
            "technical_score momentum_score volume_score fundamental_score risk_score catalyst_score final_score confidence",
            "rating risk_level explanation payload_json",
        ),
    ),
    "market_regimes": (("date",), _table("date", "health_score", "regime risk_environment buy_environment payload_json")),
    "signals": (
        ("ticker", "date", "signal_type"),
        _table("ticker date signal_type", "entry_price score confidence", "market_regime sector why_now payload_json", "id"),
    ),
    "signal_outcomes": (
        ("signal_id",),
        _table("signal_id", "return_1w return_1m return_3m return_6m max_drawdown sp500_relative_return", "updated_at"),
    ),
    "options_data": (
        ("ticker", "date", "expiration", "strike", "option_type"),
        _table("ticker date expiration strike option_type", "bid ask last_price volume open_interest implied_volatility"),
    ),
    "options_metrics": (
        ("ticker", "date", "expiration", "strike", "option_type"),
        _table(
            "ticker date expiration strike option_type",
            "black_scholes_price delta gamma vega theta rho breakeven required_move liquidity_score",
        ),
    ),
    "news_events": ((), _table("ticker date", "bullish_score bearish_score importance_score", "headline source summary why_it_matters")),
    "portfolio_positions": (("ticker",), _table("ticker", "shares cost_basis current_value gain_loss", "entry_date")),
    "portfolio_risk_snapshots": (
        ("date",),
        _table("date", "health_score annual_volatility sharpe_ratio max_drawdown average_correlation diversification_score", "why_now payload_json"),
    ),
    "stock_intelligence_reports": (
        ("ticker", "date"),
        _table("ticker date", "final_score confidence", "rating why_now fundamental_classification technical_setup portfolio_fit payload_json"),
    ),
    "discovery_runs": (("date",), _table("date", "", "screener summary payload_json", "match_count")),
    "filings": (("identity_key",), _table("identity_key", "", "ticker accession_number payload")),
    "whale_results": (("cache_key",), _table("cache_key", "", "ticker payload created_at")),
    "simulation_results": (("cache_key",), _table("cache_key", "", "ticker payload created_at")),
    "calibration_results": (("cache_key",), _table("cache_key", "", "ticker payload created_at")),
    "alert_dedupe": (("dedupe_key",), _table("dedupe_key", "", "sent_at")),
}

BARS = T.StructType(
    [T.StructField("ticker", T.StringType()), T.StructField("date", T.DateType())]
    + [T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")]
)

PORTFOLIO_DOC = "portfolio_id string, positions array<struct<ticker:string,shares:double,cost_basis:double,sector:string,weight:double>>"

PEER_DOC = (
    "version string, relationships array<struct<ticker_a:string,ticker_b:string,industry:string,"
    "business_model:string,sector_proxy:string,reasons:array<string>>>"
)

CIK_DOC = "map<string, struct<cik_str:bigint, ticker:string, title:string>>"

SUBMISSIONS_DOC = (
    "struct<filings:struct<recent:struct<form:array<string>,accessionNumber:array<string>,filingDate:array<string>,"
    "reportDate:array<string>,primaryDocument:array<string>>>>"
)

_VALUE = "struct<value:string>"
FORM4_DOC = (
    "reportingOwner struct<reportingOwnerId:struct<rptOwnerName:string>,reportingOwnerRelationship:struct<isDirector:string,"
    "isOfficer:string,isTenPercentOwner:string,officerTitle:string>>, "
    "nonDerivativeTable struct<nonDerivativeTransaction:array<struct<"
    f"transactionDate:{_VALUE},transactionCoding:struct<transactionCode:string>,"
    f"transactionAmounts:struct<transactionShares:{_VALUE},transactionPricePerShare:{_VALUE}>,"
    f"ownershipNature:struct<directOrIndirectOwnership:{_VALUE}>>>>, "
    "_corrupt_record string"
)
