"""Readers and writers of bars, JSON documents and filings. Documents are columns of a table;
parsing is a column expression, so a folder of any number of documents is one scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom import schemas
from marketloom.functions.expr import notes, truth

ALLOWED_HOSTS = ("www.sec.gov", "data.sec.gov")  # fixed values
ARCHIVES = "https://www.sec.gov/Archives"  # fixed value


def read_bars(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Bars with the fixed schema; no inference pass over the files."""
    reader = spark.read.schema(schemas.BARS)
    if fmt == "csv":
        reader = reader.option("header", "true")
    return reader.format(fmt).load(path)


def reshape_wide(wide: DataFrame, at: str, tickers: Sequence[str], fields: Sequence[str], sep: str = "|") -> DataFrame:
    """Columns `<ticker><sep><field>` to one row per (ticker, at); all-null rows dropped. Every
    input row expands in place, so no shuffle is needed to regroup what sat in one row."""
    have = set(wide.columns)
    rows = [
        F.struct(
            F.lit(t).alias("ticker"),
            *[(F.col(f"`{t}{sep}{f}`") if f"{t}{sep}{f}" in have else F.lit(None)).cast("double").alias(f) for f in fields],
        )
        for t in tickers
    ]
    return wide.select(at, F.inline(F.array(*rows))).dropna(how="all", subset=list(fields))


def portfolio_positions(docs: DataFrame, column: str = "doc") -> DataFrame:
    """Portfolio JSON documents to position rows: symbols trimmed and upper-cased, blank ones
    dropped, a missing sector reads as Unknown."""
    parsed = docs.withColumn("_d", F.from_json(column, schemas.PORTFOLIO_DOC))
    rows = parsed.select(F.col("_d.portfolio_id").alias("portfolio_id"), F.inline("_d.positions"))
    return rows.withColumn("ticker", F.upper(F.trim("ticker"))).filter(F.length("ticker") > 0).withColumn("sector", F.coalesce("sector", F.lit("Unknown")))


def peer_relationships(docs: DataFrame, column: str = "doc") -> DataFrame:
    return docs.withColumn("_d", F.from_json(column, schemas.PEER_DOC)).select(F.inline("_d.relationships"))


def write_json_state(rows: DataFrame, path: str) -> None:
    """Snapshot of the rows with enough data, one JSON object per line."""
    rows.filter(~truth(F.col("confidence") == "Insufficient Data")).write.mode("overwrite").json(path)


def read_json_state(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    return spark.read.schema(ddl).json(path)


# fixed values: form 4 transaction codes
FORM4_CODES = (
    ("P", "Open-market purchase"),
    ("S", "Open-market sale"),
    ("M", "Option exercise"),
    ("A", "Grant or award"),
    ("G", "Gift"),
    ("F", "Tax withholding"),
    ("D", "Sale or transfer back to issuer"),
)
UNKNOWN_CODE = "Unknown or unsupported transaction code"


def form4_class(code: Column, ownership: Column) -> tuple[Column, Column]:
    """Transaction category and warnings of a Form 4 code."""
    clean = F.upper(F.coalesce(code, F.lit("")))
    table = F.create_map(*[F.lit(x) for pair in FORM4_CODES for x in pair])
    kind = F.coalesce(F.try_element_at(table, clean), F.lit(UNKNOWN_CODE))
    missing = F.when(clean == "", "missing").otherwise(clean)
    warnings = notes(
        (kind == UNKNOWN_CODE, F.concat(F.lit("Unsupported Form 4 transaction code: "), missing, F.lit("."))),
        (F.upper(ownership) == "I", "Transaction was reported as indirect ownership."),
    )
    return kind, warnings


def form4_transactions(docs: DataFrame, column: str = "xml") -> DataFrame:
    """Form 4 documents to one row per non-derivative transaction. Unreadable XML keeps one row
    with parser_status = failed; a document without transactions yields no row."""
    text = F.regexp_replace(column, "(?i)<!DOCTYPE[^>]*>", "")
    opts = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record", "rowTag": "ownershipDocument"}
    # a row of its own for each document: a filter on what was parsed is not pushed below and parses nothing again
    doc = docs.withColumn("_d", F.explode(F.array(F.from_xml(text, schemas.FORM4_DOC, opts))))
    failed = F.col("_d").isNull() | F.col("_d._corrupt_record").isNotNull() | ~F.trim(F.col(column)).endswith("</ownershipDocument>")
    doc = doc.withColumn("parser_status", F.when(failed, "failed").otherwise("parsed"))
    blank = F.array(F.lit(None).cast("struct<transactionDate:struct<value:string>,transactionCoding:struct<transactionCode:string>,transactionAmounts:struct<transactionShares:struct<value:string>,transactionPricePerShare:struct<value:string>>,ownershipNature:struct<directOrIndirectOwnership:struct<value:string>>>"))
    rel = F.col("_d.reportingOwner.reportingOwnerRelationship")

    def on(tag: str) -> Column:
        v = F.trim(rel[tag])
        return v.isNotNull() & (v != "") & ~v.isin("0", "false", "False")

    labels = notes((on("isDirector"), "Director"), (on("isOfficer"), "Officer"), (on("isTenPercentOwner"), "TenPercent Owner"), (on("officerTitle"), F.trim(rel["officerTitle"])))
    rows = doc.withColumn("_t", F.explode(F.when(failed, blank).otherwise(F.col("_d.nonDerivativeTable.nonDerivativeTransaction"))))
    t = F.col("_t")
    rows = (
        rows.withColumn("transaction_code", F.trim(t["transactionCoding"]["transactionCode"]))
        .withColumn("ownership", F.trim(t["ownershipNature"]["directOrIndirectOwnership"]["value"]))
        .withColumn("shares", F.trim(t["transactionAmounts"]["transactionShares"]["value"]).try_cast("double"))
        .withColumn("price", F.trim(t["transactionAmounts"]["transactionPricePerShare"]["value"]).try_cast("double"))
        .withColumn("event_date", F.trim(t["transactionDate"]["value"]).try_cast("date"))
        .withColumn("reporting_owner", F.trim(F.col("_d.reportingOwner.reportingOwnerId.rptOwnerName")))
        .withColumn("reporting_owner_type", F.when(F.size(labels) > 0, F.array_join(labels, ", ")))
    )
    bad = F.col("parser_status") == "failed"
    kind, warnings = form4_class(F.col("transaction_code"), F.col("ownership"))
    plan = F.lower(F.regexp_replace(column, "<[^>]*>", " ")).rlike("10b5-1|trading plan")
    out = (
        rows.withColumn("transaction_type", F.when(~bad, kind))
        .withColumn("warnings", F.when(bad, F.array(F.lit("Form 4 parser could not read XML."))).otherwise(warnings))
        .withColumn("transaction_value", F.col("shares") * F.col("price"))
        .withColumn("purpose", F.when(plan & ~bad, "Automatic trading plan may apply if disclosed in the source filing."))
        .withColumn("form_type", F.lit("4"))
    )
    return out.drop("_d", "_t", column)


def schedule13(docs: DataFrame, column: str = "text") -> DataFrame:
    """Schedule 13D/13G texts to owner, percent, shares, purpose and amendment flag. The whole
    text is searched, whatever its length."""
    text = F.col(column)
    form = F.upper("form_type")
    owner = F.regexp_extract(text, r"(?i)(?:NAME OF REPORTING PERSON|Reporting Person)\s*[:\n]\s*([^\n<]+)", 1)
    percent = F.regexp_extract(text, r"(?i)(\d+(?:\.\d+)?)\s*%", 1)
    shares = F.regexp_replace(F.regexp_extract(text, r"(?i)([\d,]+)\s+shares", 1), ",", "")
    return (
        docs.withColumn("reporting_owner", F.trim(F.nullif(owner, F.lit(""))))
        .withColumn("ownership_percent", percent.try_cast("double"))
        .withColumn("shares", shares.try_cast("double"))
        .withColumn("transaction_type", F.when(form.contains("/A") | F.upper(text).contains("AMENDMENT"), "Amendment").otherwise("Initial filing"))
        .withColumn(
            "purpose",
            F.when(form.startswith("SC 13D"), "Potential control-related filing; read the filing for exact purpose.").when(
                form.startswith("SC 13G"), "Generally passive or qualifying ownership context; not an activist claim."
            ),
        )
    )


def filing_url(cik: Column, accession: Column, document: Column) -> Column:
    return F.concat_ws("/", F.lit(ARCHIVES), F.lit("edgar/data"), F.ltrim(cik, F.lit("0")), F.replace(accession, F.lit("-"), F.lit("")), document)


def allowed_url(url: Column) -> Column:
    return truth((F.parse_url(url, F.lit("PROTOCOL")) == "https") & F.parse_url(url, F.lit("HOST")).isin(*ALLOWED_HOSTS))


def filing_metadata(docs: DataFrame, forms: Sequence[str], limit: int | None = None, column: str = "doc") -> DataFrame:
    """Columnar submissions JSON to rows: the filings of the wanted forms per document, in document
    order, with their source address; `limit` keeps the first so many. All happens inside the
    document's own arrays, so no ranking shuffle is needed."""
    recent = F.from_json(column, schemas.SUBMISSIONS_DOC)["filings"]["recent"]
    d = docs.withColumn("_r", recent)
    zipped = F.arrays_zip("_r.form", "_r.accessionNumber", "_r.filingDate", "_r.reportDate", "_r.primaryDocument")
    good = F.filter(
        zipped,
        lambda x: x["form"].isin(*forms) & (F.coalesce(x["accessionNumber"], F.lit("")) != "") & (F.coalesce(x["primaryDocument"], F.lit("")) != ""),
    )
    rows = d.select("ticker", "cik", F.posexplode(good if limit is None else F.slice(good, 1, limit)).alias("position", "_x"))
    return rows.select(
        "ticker",
        "cik",
        "position",
        F.col("_x.form").alias("form"),
        F.col("_x.accessionNumber").alias("accession_number"),
        F.col("_x.filingDate").alias("filing_date"),
        F.col("_x.reportDate").alias("report_date"),
        filing_url(F.col("cik"), F.col("_x.accessionNumber"), F.col("_x.primaryDocument")).alias("source_url"),
    ).filter(allowed_url(F.col("source_url")))


def cik_map(docs: DataFrame, column: str = "doc") -> DataFrame:
    """Ticker to zero-padded CIK from map-of-objects JSON."""
    entries = F.explode(F.map_values(F.from_json(column, schemas.CIK_DOC)))
    return docs.select(entries.alias("e")).select(
        F.upper("e.ticker").alias("ticker"), F.lpad(F.col("e.cik_str").cast("string"), 10, "0").alias("cik"), F.col("e.title").alias("title")
    )


IDENTITY = ("accession_number", "form_type", "reporting_owner", "transaction_type", "event_date", "shares", "price")


def identity_key(columns: Sequence[str] = IDENTITY) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def dedupe_filings(rows: DataFrame, order: str) -> DataFrame:
    """First row per identity key. `order` names the parse order; the survivor is chosen by a
    map-side combined minimum, so a key repeated without end costs one row per task."""
    others = [c for c in rows.columns if c != "identity_key"]
    keyed = rows.withColumn("identity_key", identity_key())
    return keyed.groupBy("identity_key").agg(F.min_by(F.struct(*others), order).alias("_r")).select("identity_key", "_r.*")


def top_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First n rows per key; Spark prunes each task to n rows per key before the shuffle."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("rank", rn).filter(F.col("rank") <= n)
