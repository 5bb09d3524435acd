"""Queries: sources, documents, cleaning."""

import uuid

from pyspark.sql import functions as F

from marketloom import schemas
from marketloom.operators import cleaning
from marketloom.operators import indicators as ind
from marketloom.operators import events, risk
from marketloom.plans import q_events  # noqa: F401  (views)
from marketloom.plans.registry import query, view
from marketloom.session import shared_dir
from marketloom.sources import files

FIELDS = ("open", "high", "low", "close", "volume")
query("src_bars", "ticker sector date:d open:4 high:4 low:4 close:4 volume:4", "SELECT * FROM bars", "bars")(lambda m: m.bars)


def bars_from_files(m):
    """Bars written as CSV and as JSON lines and read back, one copy of each."""
    base = f"{shared_dir(m.spark)}/bars-{uuid.uuid4().hex}"
    rows = m.bars.select(*schemas.BARS.fieldNames())
    rows.write.option("header", "true").csv(f"{base}/csv")
    rows.write.json(f"{base}/json")
    read = lambda fmt: files.read_bars(m.spark, f"{base}/{fmt}", fmt).withColumn("format", F.lit(fmt))
    return read("csv").unionByName(read("json"))


query("src_bars_files", "format ticker date:d open:4 high:4 low:4 close:4 volume:4", "SELECT unnest(['csv', 'json']) AS format, * FROM bars", "bars")(bars_from_files)


def wide_bars(m):
    names = [r[0] for r in m.table("nation").select("n_name").collect()]  # 25 column names
    wide = m.bars.groupBy("date").pivot("ticker", names).agg(*[F.first(f).alias(f) for f in FIELDS])
    for n in names:
        for f in FIELDS:
            wide = wide.withColumnRenamed(f"{n}_{f}", f"{n}|{f}")
    return files.reshape_wide(wide, "date", names, FIELDS)


query("src_reshape_wide", "ticker date:d open:4 high:4 low:4 close:4 volume:4", "SELECT * FROM bars", "bars")(wide_bars)


def portfolio_docs(m):
    """One JSON document per portfolio (at most one entry per nation)."""
    p = m.positions
    one = F.struct(F.concat(F.lit(" "), F.lower("ticker")).alias("ticker"), "shares", F.when(F.substring("ticker", 8, 9).cast("int") % 5 != 4, F.col("sector")).alias("sector"))
    return p.groupBy("portfolio_id").agg(F.collect_list(one).alias("positions")).select(F.to_json(F.struct("portfolio_id", "positions")).alias("doc"))


query("src_json_state", "portfolio_id ticker shares:2 sector", "SELECT portfolio_id, ticker, shares, CASE WHEN CAST(substr(ticker, 8) AS INT) % 5 <> 4 THEN sector ELSE 'Unknown' END AS sector FROM pos", "pos")(
    lambda m: files.portfolio_positions(portfolio_docs(m)))


def peer_docs(m):
    """One peer-universe document per region: nations five apart are peers, in both listing orders by parity."""
    n = m.places
    a = n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("x"), "r_name")
    b = n.select((F.col("n_nationkey") - 5).alias("k"), F.col("n_name").alias("y"), F.col("r_name").alias("r"))
    pairs = a.join(b, (a["k"] == b["k"]) & (F.col("r_name") == F.col("r"))).drop(b["k"])
    odd = F.col("k") % 2 == 1
    one = F.struct(F.when(odd, F.col("y")).otherwise(F.col("x")).alias("ticker_a"), F.when(odd, F.col("x")).otherwise(F.col("y")).alias("ticker_b"), F.lower("r_name").alias("industry"),
                   F.col("r_name").alias("sector_proxy"), F.when(odd, F.array(F.lit("Same industry"), F.concat(F.lit("Region "), "r_name"))).otherwise(F.array(F.lit("Same industry"))).alias("reasons"))
    return pairs.groupBy("r_name").agg(F.collect_list(one).alias("relationships")).select(F.to_json(F.struct(F.lit("v1").alias("version"), "relationships")).alias("doc"))


query("src_peer_json", "ticker_a ticker_b industry sector_proxy reasons",
      """SELECT CASE WHEN odd THEN y ELSE x END AS ticker_a, CASE WHEN odd THEN x ELSE y END AS ticker_b, lower(r_name) AS industry, r_name AS sector_proxy, CASE WHEN odd THEN 'Same industry|Region ' || r_name ELSE 'Same industry' END AS reasons FROM (
 SELECT a.n_name AS x, b.n_name AS y, r_name, a.n_nationkey % 2 = 1 AS odd FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 5 AND a.n_regionkey = b.n_regionkey JOIN region ON a.n_regionkey = r_regionkey)""")(
    lambda m: files.peer_relationships(peer_docs(m)).withColumn("reasons", F.array_join("reasons", "|")))


def state_round_trip(m):
    rows = ind.vol_forecast(ind.daily_returns(m.bars)).select("ticker", F.col("expected").alias("confidence"), F.round("ewma_daily", 9).alias("ewma_daily"))
    path = f"{shared_dir(m.spark)}/state-{uuid.uuid4().hex}"
    files.write_json_state(rows, path)
    return files.read_json_state(m.spark, path, "ticker string, confidence string, ewma_daily double")


query("sink_json_state", "ticker confidence ewma_daily:8", "SELECT ticker, expected AS confidence, round(ewma_daily, 9) AS ewma_daily FROM vfc WHERE expected <> 'Insufficient Data'", "vfc")(state_round_trip)

# form 4: one document per order; open orders report a second, indirect transaction
CODES = "CASE o_orderpriority WHEN '1-URGENT' THEN 'P' WHEN '2-HIGH' THEN 'S' WHEN '3-MEDIUM' THEN 'M' WHEN '5-LOW' THEN 'x' ELSE 'A' END"


def form4_docs(m):
    o = m.table("orders").join(m.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
    price = F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("<value>"), F.round(F.col("o_totalprice") / 1000, 5).cast("string"), F.lit("</value>"))).otherwise(F.lit(""))

    def txn(shares, own):
        return F.concat(
            F.lit("<nonDerivativeTransaction><transactionDate><value>"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("</value></transactionDate><transactionCoding><transactionCode>"), F.expr(CODES),
            F.lit("</transactionCode></transactionCoding><transactionAmounts><transactionShares><value>"), shares.cast("string"), F.lit("</value></transactionShares><transactionPricePerShare>"), price,
            F.lit(f"</transactionPricePerShare></transactionAmounts><ownershipNature><directOrIndirectOwnership><value>{own}</value></directOrIndirectOwnership></ownershipNature></nonDerivativeTransaction>"))

    second = F.when(F.col("o_orderstatus") == "O", txn(F.col("o_custkey") % 500 + 2, "I")).otherwise(F.lit(""))
    close = F.when(F.col("o_totalprice") > 480000, F.lit("</nonDerivativeTable")).otherwise(F.lit("</nonDerivativeTable></ownershipDocument>"))
    xml = F.concat(
        F.lit("<ownershipDocument><reportingOwner><reportingOwnerId><rptOwnerName>"), F.col("c_name"), F.lit("</rptOwnerName></reportingOwnerId><reportingOwnerRelationship><isDirector>"),
        F.when(F.col("c_acctbal") > 5000, "1").otherwise("0"), F.lit("</isDirector><officerTitle>"), F.when(F.col("c_acctbal") < 0, "CFO").otherwise(""), F.lit("</officerTitle></reportingOwnerRelationship></reportingOwner><remarks>"),
        F.when(F.col("o_orderpriority") == "5-LOW", "Made under a Rule 10b5-1 plan").otherwise("none"), F.lit("</remarks><nonDerivativeTable>"), txn(F.col("o_custkey") % 500 + 1, "D"), second, close)
    return o.select(F.concat(F.lit("A-"), F.col("o_orderkey")).alias("accession_number"), F.concat(F.lit("N"), F.col("c_nationkey")).alias("ticker"), F.to_date("o_orderdate").alias("filing_date"), xml.alias("xml"))


view("f4", f"""SELECT 'A-' || o_orderkey AS accession_number, 'N' || c_nationkey AS ticker, CAST(o_orderdate AS DATE) AS filing_date, CASE WHEN bad THEN 'failed' ELSE 'parsed' END AS parser_status, CASE WHEN NOT bad THEN c_name END AS reporting_owner,
 CASE WHEN NOT bad THEN nullif(concat_ws(', ', CASE WHEN c_acctbal > 5000 THEN 'Director' END, CASE WHEN c_acctbal < 0 THEN 'CFO' END), '') END AS reporting_owner_type,
 CASE WHEN NOT bad THEN CASE code WHEN 'P' THEN 'Open-market purchase' WHEN 'S' THEN 'Open-market sale' WHEN 'M' THEN 'Option exercise' WHEN 'A' THEN 'Grant or award' ELSE 'Unknown or unsupported transaction code' END END AS transaction_type,
 CASE WHEN NOT bad THEN CAST(o_custkey % 500 + t AS DOUBLE) END AS shares, CASE WHEN NOT bad AND o_orderstatus <> 'P' THEN round(o_totalprice / 1000, 5) END AS price, CASE WHEN NOT bad THEN CAST(o_orderdate AS DATE) END AS event_date,
 CASE WHEN bad THEN 'Form 4 parser could not read XML.' ELSE concat_ws('|', CASE WHEN code = 'x' THEN 'Unsupported Form 4 transaction code: X.' END, CASE WHEN t = 2 THEN 'Transaction was reported as indirect ownership.' END) END AS warnings,
 CASE WHEN NOT bad AND code = 'x' THEN 'Automatic trading plan may apply if disclosed in the source filing.' END AS purpose, t AS n, '4' AS form_type
 FROM (SELECT *, {CODES} AS code, o_totalprice > 480000 AS bad FROM orders JOIN customer ON o_custkey = c_custkey), (VALUES (1), (2)) AS v(t) WHERE t = 1 OR (o_orderstatus = 'O' AND NOT bad)""")
query("src_filings_xml", "accession_number ticker filing_date:d parser_status reporting_owner reporting_owner_type transaction_type shares:2 price:5 transaction_value:5 event_date:d warnings purpose",
      "SELECT *, shares * price AS transaction_value FROM f4", "f4")(
    lambda m: files.form4_transactions(form4_docs(m)).withColumn("warnings", F.array_join("warnings", "|")))
query("form4_class", "transaction_type warnings filings:i value:2",
      "SELECT transaction_type, warnings, count(*) AS filings, coalesce(sum(shares * price), 0) AS value FROM f4 GROUP BY 1, 2", "f4")(
    lambda m: files.form4_transactions(form4_docs(m)).groupBy("transaction_type", F.array_join("warnings", "|").alias("warnings")).agg(
        F.count(F.lit(1)).alias("filings"), F.coalesce(F.sum("transaction_value"), F.lit(0.0)).alias("value")))


def schedule_docs(m):
    o = m.table("orders").join(m.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
    form = F.concat(F.when(F.col("o_orderstatus") == "F", "SC 13D").otherwise("SC 13G"), F.when(F.col("o_orderpriority") == "1-URGENT", "/A").otherwise(""))
    owner = F.when(F.col("o_orderpriority") != "2-HIGH", F.concat(F.lit("\nName of Reporting Person: "), F.col("c_name"), F.lit("\n"))).otherwise("\n")
    text = F.concat(F.lit("Schedule 13"), owner, F.lit("holds "), F.format_number(F.col("o_orderkey") + 1000, 0), F.lit(" shares, or "), (F.col("o_custkey") % 90 / 10 + 5).cast("string"), F.lit(" % of the class."),
                    F.when(F.col("o_orderpriority") == "3-MEDIUM", " This Amendment No. 2 updates item 4.").otherwise(""))
    return o.select(F.concat(F.lit("S-"), F.col("o_orderkey")).alias("accession_number"), F.concat(F.lit("N"), F.col("c_nationkey")).alias("ticker"), form.alias("form_type"), F.to_date("o_orderdate").alias("filing_date"), text.alias("text"))


view("s13", """SELECT 'S-' || o_orderkey AS accession_number, 'N' || c_nationkey AS ticker, CASE WHEN o_orderstatus = 'F' THEN 'SC 13D' ELSE 'SC 13G' END || CASE WHEN o_orderpriority = '1-URGENT' THEN '/A' ELSE '' END AS form_type, CAST(o_orderdate AS DATE) AS filing_date,
 CASE WHEN o_orderpriority <> '2-HIGH' THEN c_name END AS reporting_owner, o_custkey % 90 / 10e0 + 5 AS ownership_percent, CAST(o_orderkey + 1000 AS DOUBLE) AS shares, CASE WHEN o_orderpriority IN ('1-URGENT', '3-MEDIUM') THEN 'Amendment' ELSE 'Initial filing' END AS transaction_type,
 CASE WHEN o_orderstatus = 'F' THEN 'Potential control-related filing; read the filing for exact purpose.' ELSE 'Generally passive or qualifying ownership context; not an activist claim.' END AS purpose FROM orders JOIN customer ON o_custkey = c_custkey""")
query("src_filings_text", "accession_number ticker form_type filing_date:d reporting_owner ownership_percent:4 shares:2 transaction_type purpose", "SELECT * FROM s13", "s13")(
    lambda m: files.schedule13(schedule_docs(m)))

FORMS = ("4", "SC 13D", "13F-HR")
FORM_OF = "CASE o_orderpriority WHEN '1-URGENT' THEN '4' WHEN '2-HIGH' THEN 'SC 13D' WHEN '3-MEDIUM' THEN '13F-HR' ELSE '10-K' END"


def submission_docs(m):
    """Submissions JSON per customer and year; one filing per day and form bounds the arrays."""
    one = m.table("orders").withColumn("form", F.expr(FORM_OF)).groupBy("o_custkey", F.year("o_orderdate").alias("yr"), F.to_date("o_orderdate").alias("d"), "form").agg(F.max("o_orderkey").alias("k"))
    rows = one.groupBy("o_custkey", "yr").agg(F.sort_array(F.collect_list(F.struct("d", "form", "k")), asc=False).alias("l"))
    pick = lambda fn: F.transform("l", fn)
    recent = F.struct(
        pick(lambda x: x["form"]).alias("form"), pick(lambda x: F.concat(F.lit("0001-24-"), x["k"])).alias("accessionNumber"), pick(lambda x: x["d"].cast("string")).alias("filingDate"),
        pick(lambda x: F.date_add(x["d"], -1).cast("string")).alias("reportDate"), pick(lambda x: F.when(F.month(x["d"]) != 1, F.lit("doc.xml")).otherwise(F.lit(""))).alias("primaryDocument"))
    doc = F.to_json(F.struct(F.struct(recent.alias("recent")).alias("filings")))
    return rows.select(F.concat(F.lit("C"), F.col("o_custkey")).alias("ticker"), F.lpad(F.col("o_custkey").cast("string"), 10, "0").alias("cik"), "yr", doc.alias("doc"))


query("src_filing_meta", "ticker cik form accession_number filing_date report_date source_url",
      f"""SELECT *, 'https://www.sec.gov/Archives/edgar/data/' || ltrim(cik, '0') || '/' || replace(accession_number, '-', '') || '/doc.xml' AS source_url FROM (
 SELECT 'C' || o_custkey AS ticker, lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, form, '0001-24-' || k AS accession_number, CAST(d AS VARCHAR) AS filing_date, CAST(d - 1 AS VARCHAR) AS report_date, row_number() OVER (PARTITION BY o_custkey, yr ORDER BY d DESC, form DESC, k DESC) AS rn FROM (
 SELECT o_custkey, year(o_orderdate) AS yr, CAST(o_orderdate AS DATE) AS d, {FORM_OF} AS form, max(o_orderkey) AS k FROM orders GROUP BY 1, 2, 3, 4) WHERE form IN ('4', 'SC 13D', '13F-HR') AND month(d) <> 1)""")(
    lambda m: files.filing_metadata(submission_docs(m), FORMS))


def cik_docs(m):
    """Documents of 100 companies each."""
    c = m.table("customer")
    entry = F.struct(F.col("c_custkey").cast("string"), F.struct(F.col("c_custkey").alias("cik_str"), F.lower(F.concat(F.lit("c"), F.col("c_custkey"))).alias("ticker"), F.col("c_name").alias("title")))
    return c.groupBy(F.floor(F.col("c_custkey") / 100).alias("part")).agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("doc"))


query("src_cik_map", "ticker cik title", "SELECT 'C' || c_custkey AS ticker, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik, c_name AS title FROM customer")(lambda m: files.cik_map(cik_docs(m)))

# --- cleaning ----------------------------------------------------------------------------
query("clean_price_series", "ticker date:d price:4", "SELECT ticker, date, close AS price FROM bars WHERE volume >= 20", "bars")(
    lambda m: cleaning.clean_price_series(m.bars.withColumn("adj_close", F.when(F.col("volume") < 20, "n/a").otherwise(F.col("close").cast("string")))))

NUM = "CASE WHEN p_size % 5 = 0 THEN p_name WHEN p_size % 7 = 0 THEN 'NaN' ELSE CAST(p_retailprice AS {}) END"
query("safe_numeric", "p_partkey:i value:4 filled:4 score:4",
      "SELECT p_partkey, v AS value, coalesce(v, -1) AS filled, coalesce(least(greatest(v, 0), 100), 0) * CASE WHEN v IS NULL THEN 0 ELSE 1 END AS score FROM (SELECT p_partkey, CASE WHEN p_size % 5 <> 0 AND p_size % 7 <> 0 THEN p_retailprice END AS v FROM part)")(
    lambda m: m.table("part").withColumn("t", F.expr(NUM.format("STRING"))).select("p_partkey", cleaning.safe_numeric(F.col("t")).alias("value"), cleaning.safe_numeric(F.col("t"), -1).alias("filled"), cleaning.clip_score(F.col("t")).alias("score")))

RAW = "CASE WHEN c_acctbal < 0 THEN 'bad ticker!' ELSE ' ' || lower(substr(c_mktsegment, 1, 3)) || '/' || c_nationkey END"


def symbol_lists(m):
    """Lists of 60 raw symbols each."""
    one = F.struct("c_custkey", F.expr(RAW).alias("raw"))
    return m.table("customer").groupBy(F.floor(F.col("c_custkey") / 60).alias("list_id")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(one)), lambda s: s["raw"]), ",").alias("raw"))


view("sym", f"""SELECT *, CASE WHEN ok AND first THEN sum(CASE WHEN ok AND first THEN 1 ELSE 0 END) OVER (PARTITION BY list_id ORDER BY p) END AS nth FROM (
 SELECT *, row_number() OVER (PARTITION BY list_id, t ORDER BY p) = 1 AS first, regexp_matches(t, '^[A-Z][A-Z0-9.-]{{0,9}}$') AS ok FROM (SELECT CAST(floor(c_custkey / 60) AS BIGINT) AS list_id, row_number() OVER (PARTITION BY floor(c_custkey / 60) ORDER BY c_custkey) - 1 AS p, trim({RAW}) AS raw, replace(upper(trim({RAW})), '/', '-') AS t FROM customer))""")
query("clean_symbols", "list_id:i kind position:i value",
      """SELECT list_id, 'accepted' AS kind, nth - 1 AS position, t AS value FROM sym WHERE nth IS NOT NULL UNION ALL SELECT list_id, 'rejected', p, raw FROM sym WHERE NOT ok""", "sym")(
    lambda m: _symbols(symbol_lists(m)))


def _symbols(lists):
    ok, bad = cleaning.clean_symbols(lists)
    return ok.select("list_id", F.lit("accepted").alias("kind"), "position", F.col("ticker").alias("value")).unionByName(
        bad.select("list_id", F.lit("rejected").alias("kind"), "position", F.col("raw").alias("value")))


STRICT = "CASE WHEN c_custkey % 6 = 0 THEN substr(c_mktsegment, 1, 6) WHEN c_custkey % 6 = 1 THEN 'A..' || c_nationkey WHEN c_custkey % 6 = 2 THEN '-AB' ELSE lower(substr(c_mktsegment, 1, 2)) || '.' || c_nationkey END"
query("validate_symbol_strict", "symbol valid n:i",
      f"SELECT symbol, coalesce(regexp_matches(upper(symbol), '^[A-Z0-9][A-Z0-9.-]{{0,4}}$') AND NOT contains(symbol, '..') AND NOT contains(symbol, '--'), false) AS valid, count(*) AS n FROM (SELECT {STRICT} AS symbol FROM customer) GROUP BY 1")(
    lambda m: m.table("customer").select(F.expr(STRICT).alias("symbol")).groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).withColumn("valid", cleaning.valid_symbol_strict(F.col("symbol"))))


def date_texts(m):
    d = F.to_date("o_orderdate")
    k = F.col("o_orderkey") % 9
    texts = [
        F.unix_timestamp(F.to_timestamp(F.date_add(d, 4000))).cast("string"), F.date_format(d, "yyyy-MM-dd"), F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T10:30:00Z")), F.date_format(d, "M/d/yyyy"), F.date_format(d, "MMM d, yyyy"),
        F.date_format(d, "MMMM d, yyyy"), F.concat(F.lit('["bad", "'), F.date_format(d, "yyyy-MM-dd"), F.lit('"]')), F.concat(F.lit('{"fmt": "'), F.date_format(d, "yyyy-MM-dd"), F.lit('"}')), F.lit("soon")]
    pick = F.element_at(F.array(*texts), (k + 1).cast("int"))
    return m.table("orders").select("o_orderkey", pick.alias("text"))


query("multi_format_date", "o_orderkey:i parsed:d", "SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN CAST(o_orderdate AS DATE) + 4000 WHEN o_orderkey % 9 < 8 THEN CAST(o_orderdate AS DATE) END AS parsed FROM orders")(
    lambda m: date_texts(m).withColumn("parsed", cleaning.parse_date(F.col("text"))))


def twice(rows):
    """Rows with a price a second time, from one pass over them."""
    return rows.withColumn("seq", F.explode(F.when(F.col("price").isNotNull(), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))


def filings_twice(m):
    return twice(files.form4_transactions(form4_docs(m)).filter("parser_status = 'parsed'"))


query("dedupe_filings", "accession_number transaction_type shares:2 price:5 seq:i", "SELECT DISTINCT accession_number, transaction_type, shares, price, 1 AS seq FROM f4 WHERE parser_status = 'parsed'", "f4")(
    lambda m: files.dedupe_filings(filings_twice(m), "seq"))

query("pct_or_fraction", "c_custkey:i pct:6", "SELECT c_custkey, CASE WHEN abs(x) <= 1 THEN x * 100 ELSE x END AS pct FROM (SELECT c_custkey, c_acctbal / 1000 AS x FROM customer)")(
    lambda m: m.table("customer").select("c_custkey", cleaning.pct_or_fraction(F.col("c_acctbal") / 1000).alias("pct")))

FUNDS = ("NATION_24",)


def raw_fundamentals(m):
    return m.fundamentals.withColumn("free_cash_flow", F.col("market_cap") * F.col("fcf_yield"))


def fundamentals(m):
    return cleaning.clean_fundamentals(raw_fundamentals(m), FUNDS)


view("cf", """SELECT *, CASE WHEN NOT available THEN 'ETF / Fund' WHEN s >= 75 AND coalesce(revenue_growth, 0) > 0.15 THEN 'Quality Compounder' WHEN s >= 70 THEN 'Fundamentally Strong' WHEN s >= 50 THEN 'Fundamentally Average' WHEN coalesce(forward_pe, 0) <> 0 AND forward_pe < 12 AND s < 45 THEN 'Cheap but Weak'
 WHEN coalesce(revenue_growth, 0) > 0.25 AND coalesce(forward_pe, 0) > 50 THEN 'High Growth but Expensive' WHEN s < 35 THEN 'Fundamentally Deteriorating' ELSE 'Fundamentally Weak' END AS classification, CASE WHEN s IS NOT NULL THEN least(greatest(s, 0), 100) END AS fundamental_score FROM (
 SELECT *, CASE WHEN available THEN 50 + CASE WHEN revenue_growth > 0.1 THEN 8 WHEN revenue_growth < 0 THEN -8 ELSE 0 END + CASE WHEN eps_growth > 0.1 THEN 8 WHEN eps_growth < 0 THEN -8 ELSE 0 END + CASE WHEN fcf_growth > 0.1 THEN 8 WHEN fcf_growth < 0 THEN -8 ELSE 0 END
 + CASE WHEN gross_margin > 0.15 THEN 5 ELSE 0 END + CASE WHEN operating_margin > 0.15 THEN 5 ELSE 0 END + CASE WHEN net_margin > 0.15 THEN 5 ELSE 0 END + CASE WHEN roe > 0.15 THEN 5 ELSE 0 END + CASE WHEN roic > 0.15 THEN 5 ELSE 0 END
 - CASE WHEN debt_to_equity > 2 THEN 10 ELSE 0 END - CASE WHEN forward_pe > 40 AND eps_growth < 0.15 THEN 10 ELSE 0 END END AS s FROM (
 SELECT ticker, ticker <> 'NATION_24' AS available, CASE WHEN a THEN sector END AS sector, CASE WHEN a THEN revenue_growth END AS revenue_growth, CASE WHEN a THEN earnings_growth END AS eps_growth, CASE WHEN a THEN free_cashflow_growth END AS fcf_growth, CASE WHEN a THEN gross_margin END AS gross_margin,
 CASE WHEN a THEN operating_margin END AS operating_margin, CASE WHEN a THEN net_margin END AS net_margin, CASE WHEN a THEN return_on_equity END AS roe, CASE WHEN a THEN return_on_invested_capital END AS roic, CASE WHEN a THEN CASE WHEN debt_to_equity > 10 THEN debt_to_equity / 100 ELSE debt_to_equity END END AS debt_to_equity,
 CASE WHEN a THEN forward_pe END AS forward_pe, CASE WHEN a THEN price_to_book END AS price_to_book, CASE WHEN a THEN market_cap * fcf_yield / market_cap END AS fcf_yield FROM (SELECT *, ticker <> 'NATION_24' AS a FROM fund)))""", "fund")
query("clean_fundamentals", "ticker available sector revenue_growth:6 gross_margin:6 debt_to_equity:7 forward_pe:6 fcf_yield:7 fundamental_score:2 classification", "SELECT * FROM cf", "cf")(fundamentals)

view("inp", """SELECT t.*, f.revenue_growth, f.gross_margin, f.forward_pe, f.price_to_book, t.rv AS relative_volume, CAST(sa.quant_score AS DOUBLE) AS final_score FROM tech t JOIN cf f USING (ticker) JOIN (SELECT ticker, quant_score FROM sa) sa USING (ticker)""", "tech", "cf", "sa")
view("scr", """SELECT 'quality_momentum' AS screener, * FROM inp WHERE final_score >= 60 AND revenue_growth >= 0.05 AND gross_margin >= 0.25 AND forward_pe <= 80 AND rsi >= 45 AND rsi <= 78 AND price_above_sma200
 UNION ALL SELECT 'technical_breakout', * FROM inp WHERE final_score >= 55 AND relative_volume >= 1.2 AND breakout AND price_above_sma50 UNION ALL SELECT 'value_watch', * FROM inp WHERE forward_pe <= 25 AND price_to_book <= 5 AND final_score >= 45""", "inp")


def screen_input(m):
    tech = events.technical_screen(q_events.table(m), ind.support_resistance(m.bars)).withColumn("relative_volume", F.col("rv")).drop("sector")
    score = risk.stock_analysis(m.bars, m.benchmark).select("ticker", F.col("quant_score").cast("double").alias("final_score"))
    return tech.join(fundamentals(m), "ticker").join(score, "ticker")


query("screen_stock", "screener ticker final_score:2 rsi:7", "SELECT * FROM scr", "scr")(lambda m: cleaning.screen_stock(screen_input(m)))
