"""Small exact cases of the operators' rules."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketloom.operators import altdata, backtest, cleaning, ev, evidence, events, factors, filings, micro, options, pairs, portfolio, regime, regress, risk, signals, tables
from marketloom.operators import indicators as ind
from marketloom.plans import q_sources
from marketloom.schemas import TABLES
from marketloom.sources import files


def bars(spark, closes, ticker="AAA", volumes=None, start="2020-01-01"):
    n = len(closes)
    days = pd.bdate_range(start, periods=n).date
    c = np.asarray(closes, float)
    v = np.full(n, 100.0) if volumes is None else np.asarray(volumes, float)
    pdf = pd.DataFrame({"ticker": ticker, "sector": "S", "date": days, "open": c, "high": c * 1.01, "low": c * 0.99, "close": c, "volume": v})
    return spark.createDataFrame(pdf)


def fundamentals(spark, *tickers):
    return spark.createDataFrame([(t, 0.1, 0.1, 0.2, 20.0) for t in tickers], "ticker string, revenue_growth double, earnings_growth double, net_margin double, forward_pe double")


def test_rising_and_falling_history(spark):
    rising = bars(spark, range(100, 170), "UP", [100.0] * 69 + [220.0])
    falling = bars(spark, range(170, 100, -1), "DOWN")
    got = {r["ticker"]: r for r in evidence.stock_evidence(rising.unionByName(falling), fundamentals(spark, "UP", "DOWN", "NONE")).collect()}
    assert got["UP"]["trend"] == "Improving" and got["UP"]["volume_status"] == "Unusual volume"
    assert got["DOWN"]["trend"] == "Weakening" and got["DOWN"]["negative_evidence"]
    assert got["NONE"]["confidence"] == "Insufficient Data" and got["NONE"]["error"]


def test_large_activity_levels(spark):
    up = [100 * 1.002**i for i in range(159)]
    heavy = [100.0] * 157 + [180.0, 200.0, 500.0]
    frame = bars(spark, up + [up[-1] * 1.04], "BUY", heavy).unionByName(bars(spark, up + [up[-1] * 0.95], "SELL", heavy)).unionByName(bars(spark, up[:20], "NEW"))
    none = spark.createDataFrame([(t, []) for t in ("BUY", "SELL", "NEW")], "ticker string, confounders array<string>").withColumn("earnings_near", F.lit(False))
    filed = spark.createDataFrame([], "ticker string, filing_confirmation double")
    got = {r["ticker"]: r["level"] for r in evidence.whale_activity(frame, none, filed).collect()}
    assert got == {"BUY": got["BUY"], "SELL": "Distribution Risk", "NEW": "Insufficient Data"} and got["BUY"] in ("Elevated", "High")


def test_first_changed_label(spark):
    cols = "ticker string, overall_view string, trend string, volume_status string, confidence string"
    now = spark.createDataFrame([("A", "Mixed", "Improving", "Normal volume", "Low"), ("B", "Mixed", "Stable", "Normal volume", "Low"), ("C", "Mixed", "Stable", "x", "Low")], cols)
    old = spark.createDataFrame([("A", "Mixed", "Stable", "Other", "Low"), ("B", "Mixed", "Stable", "Normal volume", "Low")], cols)
    assert [tuple(r) for r in events.field_changes(now, old).collect()] == [("A", "trend", "Stable", "Improving")]


def test_transitions_between_snapshots(spark):
    cols = "ticker string, close double, sma50 double, sma200 double, rsi_weekly double, rsi_monthly double, mrs double, rv double, high_52w double, low_52w double"
    now = spark.createDataFrame([("A", 110.0, 105.0, 100.0, 35.0, 45.0, 1.0, 2.5, 110.0, 80.0), ("N", 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)], cols)
    old = spark.createDataFrame([("A", 95.0, 100.0, 98.0, 45.0, 38.0, -1.0, 1.0, 109.0, 80.0, False)], cols + ", is_stage_2 boolean")
    got = {r["ticker"]: r["alerts"] for r in events.state_transitions(now, old).collect()}
    assert got["N"] == [events.FIRST_RUN]
    for text in ("Entered Stage 2 alignment", "RS breakout vs benchmark", "Volume spike: 2.5x normal", "Price crossed above SMA200", "Monthly RSI crossed above 40", "Weekly RSI crossed below 40", "New 52-week high"):
        assert text in got["A"]


XML = """<ownershipDocument><reportingOwner><reportingOwnerId><rptOwnerName>Jane Roe</rptOwnerName></reportingOwnerId><reportingOwnerRelationship><isDirector>1</isDirector><officerTitle>CEO</officerTitle></reportingOwnerRelationship></reportingOwner>
<nonDerivativeTable><nonDerivativeTransaction><transactionDate><value>2024-05-01</value></transactionDate><transactionCoding><transactionCode>{code}</transactionCode></transactionCoding><transactionAmounts><transactionShares><value>1000</value></transactionShares><transactionPricePerShare>{price}</transactionPricePerShare></transactionAmounts>
<ownershipNature><directOrIndirectOwnership><value>D</value></directOrIndirectOwnership></ownershipNature></nonDerivativeTransaction></nonDerivativeTable></ownershipDocument>"""


def test_form4_documents(spark):
    docs = [(f"A{i}", XML.format(code=c, price="<value>420</value>")) for i, (c, _) in enumerate(files.FORM4_CODES)]
    docs += [("NOPRICE", XML.format(code="P", price="")), ("BAD", "<ownershipDocument><broken"), ("ODD", XML.format(code="Q", price="<value>1</value>"))]
    got = {r["accession_number"]: r for r in files.form4_transactions(spark.createDataFrame(docs, "accession_number string, xml string")).collect()}
    assert [got[f"A{i}"]["transaction_type"] for i in range(7)] == [t for _, t in files.FORM4_CODES]
    assert got["A0"]["transaction_value"] == 420000.0 and got["A0"]["reporting_owner_type"] == "Director, CEO" and got["A0"]["event_date"] == dt.date(2024, 5, 1)
    assert got["NOPRICE"]["price"] is None and got["NOPRICE"]["transaction_value"] is None
    assert got["BAD"]["parser_status"] == "failed" and got["ODD"]["warnings"]
    row = files.form4_transactions(spark.createDataFrame(docs[:1], "accession_number string, xml string")).withColumn("seq", F.lit(1))
    assert files.dedupe_filings(row.unionByName(row.withColumn("seq", F.lit(2))), "seq").count() == 1


def test_form4_documents_are_parsed_once(spark):
    """Filters on parsed columns must not bring the parser into the plan again."""
    docs = spark.createDataFrame([("A", XML.format(code="P", price="<value>1</value>"))], "accession_number string, xml string")
    rows = q_sources.twice(files.form4_transactions(docs).filter("parser_status = 'parsed'"))
    plan = files.dedupe_filings(rows, "seq")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_xml") + plan.count("xmltostructs") == 1
    assert sorted(r["seq"] for r in rows.collect()) == [1, 2]


def test_schedule_texts(spark):
    long_lead = "x " * 50000
    rows = [("SC 13D", f"{long_lead}\nName of Reporting Person: Big Fund LP\nowns 1,234,567 shares, 7.5 % of the class"), ("SC 13G/A", "Amendment No. 1 holds 10 shares")]
    got = files.schedule13(spark.createDataFrame(rows, "form_type string, text string")).collect()
    assert got[0]["reporting_owner"] == "Big Fund LP" and got[0]["ownership_percent"] == 7.5 and got[0]["shares"] == 1234567.0
    assert "control" in got[0]["purpose"] and got[1]["transaction_type"] == "Amendment" and "passive" in got[1]["purpose"]


def test_holdings_change(spark):
    ddl = "manager string, ticker string, shares double"
    prev = spark.createDataFrame([("M", "A", 100.0), ("M", "B", 5.0), ("M", "C", 7.0)], ddl)
    cur = spark.createDataFrame([("M", "A", 150.0, "Passive index"), ("M", "C", 7.0, "Active"), ("M", "D", 1.0, "Active")], ddl + ", manager_type string")
    got = {r["ticker"]: r for r in filings.holdings_delta(prev, cur).collect()}
    assert got["A"]["transaction_type"] == "Delayed 13F increase" and got["A"]["position_change"] == pytest.approx(0.5) and len(got["A"]["warnings"]) == 2
    assert got["B"]["position_change"] == -1.0 and got["D"]["transaction_type"] == "Delayed 13F new position" and "C" not in got


def test_expected_values(spark):
    o = spark.createDataFrame([("ok", 0.6, 2.0), ("ok", 0.4, -1.0), ("bad", 0.6, 1.0), ("bad", 0.5, 1.0)], "g string, probability double, payoff double")
    got = {r["g"]: r for r in ev.ev_weighted(o, ("g",)).collect()}
    assert got["ok"]["expected_value"] == pytest.approx(0.8) and got["bad"]["expected_value"] is None and not got["bad"]["accepted"]
    w = spark.createDataFrame([("p", "A", 0.6), ("p", "B", 0.4), ("q", "A", 0.5), ("q", "Z", 0.5)], "portfolio_id string, ticker string, weight double")
    e = spark.createDataFrame([("A", 0.1), ("B", 0.05)], "ticker string, expected_return double")
    got = {r["portfolio_id"]: r for r in ev.ev_portfolio(w, e).collect()}
    assert got["p"]["expected_value"] == pytest.approx(0.08) and got["q"]["missing"] == ["Z"] and got["q"]["expected_value"] is None


def test_counted_bayes(spark):
    rows = [(True, True)] * 40 + [(True, False)] * 10 + [(False, True)] * 10 + [(False, False)] * 40
    df = spark.createDataFrame([("k", *r) for r in rows], "k string, e boolean, c boolean")
    got = ev.event_rate(df, ("k",), F.col("e"), F.col("c")).first()
    assert got["event_probability"] == 0.5 and got["conditional_probability"] == pytest.approx(0.8) and got["bayes_posterior"] == pytest.approx(0.8)


def test_option_columns(spark):
    ddl = "contract_id long, underlying string, expiration_days int, strike double, spot double, rate double, implied_volatility double, option_type string"
    chain = spark.createDataFrame([(1, "U", 90, 100.0, 100.0, 0.03, 0.25, "call"), (2, "U", 90, 100.0, 100.0, 0.03, 0.40, "put")], ddl)
    v = options.chain_value(chain).withColumn("market_price", F.col("fair_value"))
    got = {r["contract_id"]: r for r in options.chain_iv(v).collect()}
    assert got[1]["solved_iv"] == pytest.approx(0.25, abs=1e-9) and got[2]["solved_iv"] == pytest.approx(0.40, abs=1e-9)
    out = options.chain_iv(v.withColumn("market_price", F.lit(1000.0))).collect()
    assert all(r["solved_iv"] is None for r in out)
    be = options.chain_breakeven(options.chain_value(chain).withColumn("market_price", F.lit(5.0))).collect()
    assert [r["break_even"] for r in be] == [105.0, 95.0]


def test_symbols(spark):
    lists = spark.createDataFrame([(1, " aapl,msft,AAPL,bad ticker!,BRK-B "), (2, "spy qqq brk/b"), (3, ",".join(f"T{i}" for i in range(30)) + ",bad one!"), (4, "a&b")], "list_id long, raw string")
    ok, bad = cleaning.clean_symbols(lists, limit=25)
    got = {}
    for r in sorted(ok.collect(), key=lambda r: r["position"]):
        got.setdefault(r["list_id"], []).append(r["ticker"])
    assert got[1] == ["AAPL", "MSFT", "BRK-B"] and got[2] == ["SPY", "QQQ", "BRK-B"] and len(got[3]) == 25 and 4 not in got
    assert sorted((r["list_id"], r["raw"]) for r in bad.collect()) == [(1, "bad ticker!"), (4, "a&b")]


def test_screen_thresholds(spark):
    ddl = "ticker string, final_score double, revenue_growth double, gross_margin double, forward_pe double, price_to_book double, rsi double, relative_volume double, price_above_sma200 boolean, price_above_sma50 boolean, breakout boolean"
    rows = spark.createDataFrame([("A", 70.0, 0.1, 0.5, 20.0, 2.0, 60.0, 1.0, True, True, False), ("B", 70.0, None, 0.5, 20.0, None, 60.0, 1.0, True, True, False)], ddl)
    got = sorted((r["screener"], r["ticker"]) for r in cleaning.screen_stock(rows).collect())
    assert got == [("quality_momentum", "A"), ("value_watch", "A")]


def test_cointegrated_pair_beats_an_independent_one(spark):
    def leg(seed, other=None):
        r = np.random.default_rng(seed)
        walk = r.normal(0, 0.01, 420).cumsum()
        return walk if other is None else 1.2 * other + r.normal(0, 0.01, 420)

    x = leg(7)
    frame = bars(spark, 100 * np.exp(x), "X").unionByName(bars(spark, 100 * np.exp(leg(8, x)), "Y")).unionByName(bars(spark, 100 * np.exp(leg(11)), "Z"))
    cand = spark.createDataFrame([("Y", "X"), ("Z", "X")], "a string, b string")
    got = {r["a"]: r for r in pairs.coint_stats(pairs.pair_frame(frame, cand)).collect()}
    assert got["Y"]["raw_pvalue"] < 0.15 and got["Y"]["raw_pvalue"] <= got["Z"]["raw_pvalue"]
    broken = bars(spark, 100 * np.exp(x), "X").unionByName(bars(spark, np.where(np.arange(420) < 210, 1.0, 1.8) * 100 * np.exp(1.2 * x), "Y"))
    got = pairs.coint_stats(pairs.pair_frame(broken, cand)).first()
    assert got["structural_break_status"] in ("Possible structural break", "No obvious break")
    short = pairs.coint_stats(pairs.pair_frame(frame.filter("date < '2020-06-01'"), cand)).collect()
    assert all(r["raw_pvalue"] is None and r["structural_break_status"] == "Insufficient data" for r in short)


def test_pair_scan_blocks_agree_with_curated_stats(spark):
    rng = np.random.default_rng(12)
    base = rng.normal(0, 0.02, 300).cumsum()
    frame = None
    for i in range(5):
        one = bars(spark, 100 * np.exp(base * (1 + i / 10) + rng.normal(0, 0.01, 300)), f"T{i}")
        frame = one if frame is None else frame.unionByName(one)
    scan = {(r["a"], r["b"]): r for r in pairs.pairs_scan(frame, z_limit=0.0, block=2).collect()}
    cand = spark.createDataFrame(list(scan), "a string, b string")
    want = {(r["a"], r["b"]): r for r in pairs.spread_stats(pairs.with_spread(pairs.pair_frame(frame, cand))).collect()}
    assert scan
    for k, r in scan.items():
        assert r["test_statistic"] == pytest.approx(want[k]["test_statistic"], rel=1e-6) and r["z_recent"] == pytest.approx(want[k]["z_recent"], rel=1e-6)


def test_pair_scan_with_gaps_equals_each_pair_alone(spark):
    """Series with different gaps, a copy, a flat series and a short one, in blocks of two and of many."""
    rng = np.random.default_rng(5)
    base = rng.normal(0, 0.02, 260).cumsum()
    made = {f"T{i}": 100 * np.exp(base * (1 + i / 10) + rng.normal(0, 0.02, 260)) for i in range(6)}
    made["COPY"], made["FLAT"] = made["T0"] * 2, np.full(260, 5.0)
    frame = None
    for name, values in made.items():
        one = bars(spark, values, name)
        frame = one if frame is None else frame.unionByName(one)
    gap = (F.col("ticker").isin("T1", "T2") & (F.dayofmonth("date") == 7)) | ((F.col("ticker") == "T3") & (F.month("date") == 2))
    short = bars(spark, made["T4"][:59], "SHORT")
    frame = frame.filter(~gap).unionByName(short).persist()
    everything = pairs.all_pairs(frame.withColumn("r", F.log("close"))).select("a", "b")
    want = {(r["a"], r["b"]): r for r in pairs.spread_stats(pairs.with_spread(pairs.pair_frame(frame, everything))).collect()}
    for block in (2, 64):
        got = {(r["a"], r["b"]): r for r in pairs.pairs_scan(frame, z_limit=0.5, block=block).collect()}
        sure = lambda r: "COPY" not in (r["a"], r["b"]) and "FLAT" not in (r["a"], r["b"])
        passing = {k for k, r in want.items() if sure(r) and r["cointegrated"] and abs(r["z_recent"]) >= 0.5}
        assert passing and {k for k, r in got.items() if sure(r)} == passing and not any("SHORT" in k for k in got)
        for k in passing:
            for c in ("test_statistic", "z_recent", "hedge_ratio", "half_life_days", "sample_size"):
                assert got[k][c] == pytest.approx(want[k][c], rel=1e-6)
    frame.unpersist()
    assert pairs.pairs_scan(frame.limit(0)).count() == 0


def test_screen_of_pairs_loses_none():
    """The screen by matrix products keeps every pair that the spreads themselves let pass."""
    rng = np.random.default_rng(8)
    base = rng.normal(0, 0.02, (400, 1)).cumsum(axis=0)
    u = base * rng.uniform(0.5, 1.5, 40) + rng.normal(0, 0.03, (400, 40))
    v = base * rng.uniform(0.5, 1.5, 30) + rng.normal(0, 0.03, (400, 30)).cumsum(axis=0) * rng.uniform(0, 0.3, 30)
    forward = rng.random((40, 30)) < 0.5
    screened = pairs._candidates(u, v, forward, -3.34, 1.5)
    k, m = np.indices((40, 30)).reshape(2, -1)
    ahead = forward[k, m]
    stats = pairs._spread_columns(np.where(ahead, u[:, k], v[:, m]), np.where(ahead, v[:, m], u[:, k]))
    passing = ((stats["test_statistic"] < -3.34) & (abs(stats["z_recent"]) >= 1.5)).reshape(40, 30)
    assert passing.any() and not (passing & ~screened).any() and screened.sum() < 1.3 * passing.sum() + 5


def test_outcome_frequencies(spark):
    got = backtest.outcome_frequencies(bars(spark, [100, 110, 90, 95, 0, 120]).unionByName(bars(spark, [1, 2], "NEW")), 2).collect()
    assert [r["ticker"] for r in got] == ["AAA"] and got[0]["sample_size"] == 3
    assert got[0]["ending_higher_pct"] == pytest.approx(100 / 3) and got[0]["down_10_pct"] == pytest.approx(200 / 3) and got[0]["confidence"] == "Low"


def test_risk_contribution_and_tail(spark):
    rng = np.random.default_rng(3)
    frame = bars(spark, 100 * np.exp(rng.normal(0, 0.02, 300).cumsum()), "AAA").unionByName(bars(spark, 50 * np.exp(rng.normal(0, 0.01, 300).cumsum()), "BBB"))
    pos = spark.createDataFrame([("p", "AAA", "S", None, 0.6), ("p", "BBB", "S", None, 0.4)], "portfolio_id string, ticker string, sector string, shares double, weight double")
    m, w = portfolio.price_matrix(frame), portfolio.weights(pos, frame)
    assert sorted(r["weight"] for r in w.collect()) == pytest.approx([0.4, 0.6])
    rc = portfolio.risk_contributions(m, w).collect()
    assert sum(r["contribution_pct"] for r in rc) == pytest.approx(100, abs=0.02) and max(rc, key=lambda r: r["contribution_pct"])["ticker"] == "AAA"
    t = risk.var_cvar(portfolio.portfolio_returns(m, w), ("portfolio_id",)).first()
    assert t["expected_shortfall"] <= t["value_at_risk"]


def test_short_history_is_a_value(spark):
    r = ind.daily_returns(bars(spark, range(100, 140)))
    assert ind.vol_forecast(r).first()["expected"] == "Insufficient Data"
    assert risk.risk_windows(r).count() == 0
    e = bars(spark, 100 * np.exp(np.random.default_rng(5).normal(0.001, 0.01, 260).cumsum()))
    assert ind.ewma_vol(ind.daily_returns(e)).first()["ewma_daily"] > 0
    assert risk.risk_windows(ind.daily_returns(e)).count() >= 3


def test_regime_names_and_transitions(spark):
    close = 100 * np.exp(np.random.default_rng(11).normal(0.0004, 0.012, 600).cumsum())
    out = regime.regime_cluster(ind.regime_features(bars(spark, close))).collect()
    names = {s[0] for s in regime.STRATEGIES}
    assert out and {r["state_name"] for r in out} <= names
    assert sum(r["probability_pct"] for r in out) == pytest.approx(100, abs=0.1) and sum(r["is_current"] for r in out) == 1


def test_principal_components(spark):
    rng = np.random.default_rng(2)
    common = rng.normal(0, 1, 120)
    rows = [(f"T{j}", str(d), float(common[d] + rng.normal(0, 0.3))) for j in range(4) for d in range(120)]
    got = regress.pca(spark.createDataFrame(rows, "ticker string, date string, r double")).toPandas()
    share = got.drop_duplicates("component")["explained_variance_pct"]
    assert share.iloc[0] > 80 and share.sum() == pytest.approx(100, abs=1e-6)


def test_leading_components_of_a_larger_universe(spark):
    """More series than columns of the subspace, with a gap here and there: iteration against a full decomposition."""
    rng = np.random.default_rng(4)
    days, n = 150, 60
    drivers = rng.normal(0, 1, (days, 6)) * np.array([3, 2, 1.5, 1.2, 1, 0.8])
    r = drivers @ rng.normal(0, 1, (6, n)) + rng.normal(0, 1, (days, n))
    rows = [(f"T{j:02}", f"{d:03}", float(r[d, j])) for j in range(n) for d in range(days) if (d * 7 + j) % 31]
    rows += [("flat", f"{d:03}", 1.0) for d in range(days)]
    got = regress.pca(spark.createDataFrame(rows, "ticker string, date string, r double"), 4).toPandas()
    wide = pd.DataFrame(rows, columns=["ticker", "date", "r"]).pivot(index="date", columns="ticker", values="r")
    corr = wide.corr().fillna(0.0).to_numpy(copy=True)
    np.fill_diagonal(corr, 1.0)
    values, vectors = np.linalg.eigh(corr)
    for c in range(4):
        part = got[got["component"] == c + 1].sort_values("ticker")
        assert part["explained_variance_pct"].iloc[0] == pytest.approx(values[-1 - c] / (n + 1) * 100, rel=1e-8)
        v = vectors[:, -1 - c] * np.sign(vectors[np.abs(vectors[:, -1 - c]).argmax(), -1 - c])
        order = np.argsort(list(wide.columns))
        assert np.allclose(part["loading"].to_numpy(), v[order], atol=1e-6)
    assert regress.pca(spark.createDataFrame([], "ticker string, date string, r double")).count() == 0


def test_logistic_groups_at_once(spark):
    """Newton's rounds against a plain fit of each group; a separable group stays finite, a short one has no model."""
    rng = np.random.default_rng(8)
    rows = []
    for g, (w, b) in {"a": (1.5, 0.2), "b": (-0.7, -1.0)}.items():
        x = rng.normal(3, 2, (400, 2))
        y = rng.random(400) < 1 / (1 + np.exp(-(b + w * (x[:, 0] - 3))))
        rows += [(g, i, float(x[i, 0]), float(x[i, 1]), float(y[i]), i < 300) for i in range(400)]
    rows += [("apart", i, float(i), 0.0, float(i > 20), i < 30) for i in range(40)] + [("short", i, float(i), 1.0, 1.0, True) for i in range(11)]
    rows += [("a", -1, None, 1.0, 1.0, True)]
    df = spark.createDataFrame(rows, "ticker string, i int, x1 double, x2 double, y double, is_train boolean")
    got = signals.logistic_model(df, ("x1", "x2"), "y").toPandas()
    assert set(got["ticker"]) == {"a", "b", "apart"} and np.isfinite(got["coefficient"]).all()
    for g in "ab":
        d = pd.DataFrame([r for r in rows if r[0] == g and r[2] is not None], columns=["g", "i", "x1", "x2", "y", "t"])
        train = d[d["t"]]
        z = np.column_stack([np.ones(len(train)), ((train[["x1", "x2"]] - train[["x1", "x2"]].mean()) / train[["x1", "x2"]].std()).to_numpy()])
        w = np.zeros(3)
        for _ in range(4000):
            w -= 0.5 * z.T @ (1 / (1 + np.exp(-z @ w)) - train["y"].to_numpy()) / len(z)
        mine = got[got["ticker"] == g].set_index("term")["coefficient"]
        assert np.allclose(mine[["intercept", "x1", "x2"]], w, atol=1e-5)
        assert set(got[got["ticker"] == g]["train_size"]) == {300} and set(got[got["ticker"] == g]["test_size"]) == {100}


def test_factor_board(spark):
    ddl = "ticker string, return_12m_ex_1m double, return_6m double, relative_strength double, forward_pe double, price_to_book double, return_on_equity double, revenue_growth double, annualized_volatility double, maximum_drawdown double"
    df = spark.createDataFrame([("A", 0.3, 0.2, 1.0, 15.0, 2.0, 0.3, 0.2, 0.2, -0.1), ("B", 0.1, 0.1, 0.5, 25.0, 4.0, 0.2, 0.1, 0.3, -0.2), ("C", -0.1, None, -1.0, 40.0, 8.0, 0.1, 0.0, 0.5, -0.4)], ddl)
    got = factors.factor_scores(df).orderBy(F.desc("composite")).collect()
    assert [r["ticker"] for r in got] == ["A", "B", "C"] and got[0]["momentum"] == pytest.approx(100.0)
    w = spark.createDataFrame([("p", "A", 0.5), ("p", "C", 0.5), ("p", "Z", 1.0)], "portfolio_id string, ticker string, weight double")
    rows = {r["factor"]: r for r in factors.portfolio_exposure(factors.factor_scores(df), w).collect()}
    assert len(rows) == 5 and rows["momentum"]["exposure"] == pytest.approx((100 + 33.3) / 2, abs=0.2)


def test_alternative_data(spark):
    rng = np.random.default_rng(9)
    days = pd.date_range("2022-01-01", periods=120).date
    rows = [("google_trends", t, d, float(rng.normal(10, 1))) for t in ("A", "B") for d in days]
    df = spark.createDataFrame(rows, "source string, ticker string, date date, value double").filter("NOT (ticker = 'B' AND date > '2022-04-01')")
    got = altdata.composite(altdata.engineer_features(df)).collect()
    assert [r["ticker"] for r in got] == ["A"]
    assert altdata.data_quality(df).first()["stale_tickers"] == 1


def test_upserts(spark):
    old = spark.createDataFrame([("A", 1.0, "x"), ("B", 2.0, "y")], "k string, v double, n string")
    new = spark.createDataFrame([("B", 3.0, "z", 1), ("B", 4.0, "w", 2), ("C", 5.0, "q", 1)], "k string, v double, n string, seq int")
    up = {r["k"]: (r["v"], r["n"]) for r in tables.upsert_latest(old, new, ("k",), "seq").collect()}
    assert up == {"A": (1.0, "x"), "B": (4.0, "w"), "C": (5.0, "q")}
    ig = {r["k"]: r["v"] for r in tables.insert_ignore(old, new, ("k",), "seq").collect()}
    assert ig == {"A": 1.0, "B": 2.0, "C": 5.0}
    co = {r["k"]: (r["v"], r["n"]) for r in tables.upsert_coalesce(old, spark.createDataFrame([("A", None, "n")], "k string, v double, n string"), ("k",)).collect()}
    assert co["A"] == (1.0, "n") and co["B"] == (2.0, "y")
    assert len(TABLES) == 20 and all(tables.create_table(spark, t).count() == 0 for t in ("signals", "alert_dedupe"))


def test_evidence_rules(spark):
    ddl = "subject string, place int, name string, conclusion string, supporting array<string>, contradicting array<string>, validation_status string"
    rows = [("a", 1, "n", "c1", ["s"], [], "tested"), ("a", 2, "n", "c2", ["s"], ["x", "y", "z"], "failed_validation")]
    got = evidence.aggregate_evidence(spark.createDataFrame(rows, ddl), ("subject",), "place", F.lit(True), F.lit(False)).first()
    assert got["why"] == ["c1"] and got["confidence"] == "Low" and got["main_risks"] == ["Upcoming event risk caps confidence."]
    many = spark.createDataFrame([("a", k, "n", f"c{k}", ["s"], ["x", "y", "z"], "tested") for k in range(7)], ddl)
    got = evidence.aggregate_evidence(many, ("subject",), "place", F.lit(False), F.lit(False)).first()
    assert got["why"] == [f"c{k}" for k in range(7)] and len(got["main_risks"]) == 21
    got = evidence.aggregate_evidence(many, ("subject",), "place", F.lit(False), F.lit(False), risks_each=2, reasons=5).first()
    assert len(got["why"]) == 5 and len(got["main_risks"]) == 14


def test_book_and_signals(spark):
    lv = spark.createDataFrame([("s", "bid", 99.0, 10.0), ("s", "bid", 98.0, 5.0), ("s", "ask", 101.0, 30.0), ("t", "bid", 1.0, 1.0)], "snapshot_id string, side string, price double, size double")
    got = {r["snapshot_id"]: r for r in micro.book_metrics(lv).collect()}
    assert got["s"]["mid_price"] == 100.0 and got["s"]["microprice"] == pytest.approx((101 * 10 + 99 * 30) / 40) and not got["t"]["available"]
    frame = bars(spark, range(100, 300))
    sig = spark.createDataFrame([("AAA", dt.date(2020, 2, 1), 0.0)], "ticker string, date date, entry_price double")  # a Saturday
    out = signals.signal_outcome(sig, frame, frame.select("date", "close")).first()
    assert out["return_1w"] == pytest.approx(128 / 123 - 1) and out["sp500_relative_return"] == pytest.approx(0.0)


def test_month_without_trades_stays_in_the_calendar(spark):
    b = bars(spark, range(100, 160)).filter("NOT (date BETWEEN '2020-02-01' AND '2020-02-29')")
    got = {str(r["label"]): r["close"] for r in ind.resample_ohlcv(b, "ME").collect()}
    assert got["2020-02-29"] is None and "2020-03-31" in got
