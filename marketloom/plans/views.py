"""SQL views behind the oracle texts: the same market views, written for DuckDB."""

from marketloom.plans.registry import view


def frame(n, part="ticker", order="date"):
    return f"(PARTITION BY {part} ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def roll(agg, x, n, least=None, part="ticker", order="date"):
    f = frame(n, part, order)
    return f"CASE WHEN count({x}) OVER {f} >= {least or n} THEN {agg}({x}) OVER {f} END"


def ema(x, span, part="ticker", order="date"):
    a = 2.0 / (span + 1.0)
    w = f"(PARTITION BY {part} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    d = f"CAST({1 - a!r} AS DOUBLE)"
    return f"(sum((CASE WHEN i = 0 THEN 1e0 ELSE {a!r}::DOUBLE END) * {x} * pow({d}, -i)) OVER {w} * pow({d}, i))"


def rsi(up, down, n=14, part="ticker", order="date"):
    u, d = roll("avg", up, n, None, part, order), roll("avg", down, n, None, part, order)
    return f"(100 - 100 / (1 + ({u}) / nullif(({d}), 0)))"


def clip(x, lo, hi):
    return f"(CASE WHEN ({x}) IS NOT NULL THEN least(greatest(({x}), {lo}), {hi}) END)"


def prod(x):
    """Product of positive growth factors."""
    return f"exp(sum(ln({x})))"


def cdf(x):
    from marketloom.functions.expr import TAIL_BOTTOM, TAIL_LIMIT, TAIL_SCALE, TAIL_TOP

    z = f"abs({x})"

    def horner(cs):
        out = f"{cs[0]!r}::DOUBLE"
        for c in cs[1:]:
            out = f"({out} * {z} + {c!r}::DOUBLE)"
        return out

    far = f"({z} + 0.65e0)"
    for k in (4, 3, 2, 1):
        far = f"({z} + {k}e0 / {far})"
    e = f"exp(-{z} * {z} / 2e0)"
    tail = f"(CASE WHEN {z} > 37 THEN 0e0 WHEN {z} < {TAIL_LIMIT!r}::DOUBLE THEN {e} * {horner(TAIL_TOP)} / {horner(TAIL_BOTTOM)} ELSE {e} / {far} / {TAIL_SCALE!r}::DOUBLE END)"
    return f"(CASE WHEN ({x}) > 0 THEN 1e0 - {tail} ELSE {tail} END)"


view(
    "fills",
    """SELECT n_name AS ticker, r_name AS sector, CAST(l_shipdate AS DATE) AS date, l_quantity AS size,
       CAST(round(l_extendedprice / l_quantity * 100) AS BIGINT) AS cents,
       (l_orderkey * 8 + l_linenumber) * 1024 + CAST(round(l_extendedprice / l_quantity * 100) AS BIGINT) % 1024 AS sequence
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey""",
)
view(
    "bars",
    """SELECT ticker, sector, date, round(100 * pow(o / 1e2 / base, 2e-2), 4) AS open, round(100 * pow(h / 1e2 / base, 2e-2), 4) AS high,
       round(100 * pow(l / 1e2 / base, 2e-2), 4) AS low, round(100 * pow(c / 1e2 / base, 2e-2), 4) AS close, volume
FROM (SELECT *, CAST(sum(total) OVER (PARTITION BY ticker) AS DOUBLE) / CAST(sum(trades) OVER (PARTITION BY ticker) AS DOUBLE) / 1e2 AS base
      FROM (SELECT ticker, sector, date, arg_min(cents, sequence) AS o, max(cents) AS h, min(cents) AS l, arg_max(cents, sequence) AS c,
                   sum(size) AS volume, sum(cents) AS total, count(*) AS trades FROM fills GROUP BY ticker, sector, date))""",
    "fills",
)
view(
    "bx",
    """SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY ticker) AS n_rows,
       count(*) OVER (PARTITION BY ticker) - row_number() OVER w + 1 AS rn,
       close / lag(close) OVER w - 1 AS r, lag(close) OVER w AS prev
FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)""",
    "bars",
)
view(
    "bench",
    "SELECT date, CAST(sum(CAST(round(close * 10000) AS BIGINT)) AS DOUBLE) / count(*) / 10000 AS close FROM bars GROUP BY date",
    "bars",
)
view(
    "benchx",
    """SELECT *, row_number() OVER w - 1 AS i, count(*) OVER () AS n_rows, count(*) OVER () - row_number() OVER w + 1 AS rn,
       close / lag(close) OVER w - 1 AS r FROM bench WINDOW w AS (ORDER BY date)""",
    "bench",
)
view(
    "sect",
    "SELECT sector, date, CAST(sum(CAST(round(close * 10000) AS BIGINT)) AS DOUBLE) / count(*) / 10000 AS close FROM bars GROUP BY sector, date",
    "bars",
)
view(
    "sectx",
    """SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY sector) AS n_rows,
       count(*) OVER (PARTITION BY sector) - row_number() OVER w + 1 AS rn,
       close / lag(close) OVER w - 1 AS r FROM sect WINDOW w AS (PARTITION BY sector ORDER BY date)""",
    "sect",
)
view("rets", "SELECT * FROM bx WHERE r IS NOT NULL", "bx")
view("pos", """SELECT c_mktsegment AS portfolio_id, n_name AS ticker, r_name AS sector, CAST(count(*) AS DOUBLE) AS shares,
       CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS DOUBLE) / count(*) / 5000 AS cost_basis
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE (n_nationkey + length(c_mktsegment)) % 4 <> 0 GROUP BY 1, 2, 3""")
view(
    "pm",
    """SELECT g.ticker, cal.date, g.close FROM
 (SELECT ticker, date, close, coalesce(lead(date) OVER (PARTITION BY ticker ORDER BY date) - 1, (SELECT max(date) FROM bars)) AS upto FROM bars) g
 JOIN (SELECT DISTINCT date FROM bars) cal ON cal.date BETWEEN g.date AND g.upto""",
    "bars",
)
view(
    "pmr",
    """SELECT ticker, date, close, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS r FROM pm""",
    "pm",
)
view(
    "pma",
    """SELECT ticker, date, r FROM pmr WHERE r IS NOT NULL AND date > (SELECT max(f) FROM (SELECT min(date) AS f FROM bars GROUP BY ticker))""",
    "pmr",
    "bars",
)
view("lastpx", "SELECT ticker, arg_max(close, date) AS price FROM bars GROUP BY ticker", "bars")
view(
    "wts",
    """SELECT portfolio_id, ticker, sector, shares, cost_basis, shares * price AS value,
       shares * price / sum(shares * price) OVER (PARTITION BY portfolio_id) AS weight
FROM pos JOIN lastpx USING (ticker)""",
    "pos",
    "lastpx",
)
view(
    "pfr",
    """SELECT portfolio_id, date, sum(weight * coalesce(r, 0)) AS r FROM wts JOIN pmr USING (ticker)
 GROUP BY portfolio_id, date HAVING count(r) > 0""",
    "wts",
    "pmr",
)
view(
    "hpma",
    """SELECT w.portfolio_id, w.ticker, w.sector, w.weight, m.date, m.r FROM wts w JOIN (
 SELECT portfolio_id, max(f) AS start FROM wts JOIN (SELECT ticker, min(date) AS f FROM bars GROUP BY 1) USING (ticker) GROUP BY 1) s USING (portfolio_id)
 JOIN pmr m USING (ticker) WHERE m.r IS NOT NULL AND m.date > s.start""",
    "wts",
    "bars",
    "pmr",
)
view(
    "hcov",
    """SELECT portfolio_id, a.ticker AS a, b.ticker AS b, covar_samp(a.r, b.r) AS cov, corr(a.r, b.r) AS corr, count(*) AS n
 FROM hpma a JOIN hpma b USING (portfolio_id, date) GROUP BY 1, 2, 3""",
    "hpma",
)
view(
    "covp",
    """SELECT a.ticker AS a, b.ticker AS b, covar_samp(a.r, b.r) AS cov, corr(a.r, b.r) AS corr, count(*) AS n
 FROM pma a JOIN pma b USING (date) GROUP BY 1, 2""",
    "pma",
)
view(
    "fund",
    """SELECT ticker, sector, k, revenue_growth, earnings_growth, free_cashflow_growth, CASE WHEN k % 5 <> 1 THEN analyst_revision END AS analyst_revision,
 CASE WHEN k % 11 <> 5 THEN gross_margin END AS gross_margin, operating_margin, net_margin, return_on_equity, return_on_invested_capital,
 CASE WHEN k % 7 <> 3 THEN forward_pe END AS forward_pe, price_to_book, ev_to_ebitda, fcf_yield,
 CASE WHEN k % 4 = 2 THEN debt_to_equity * 100 ELSE debt_to_equity END AS debt_to_equity, round(market_cap, 2) AS market_cap FROM (
 SELECT ticker, sector, k,
  round(sum(ext) FILTER (age < 365) / sum(ext) FILTER (age >= 365 AND age < 730) - 1, 6) AS revenue_growth,
  round(sum(qty) FILTER (age < 365) / sum(qty) FILTER (age >= 365 AND age < 730) - 1, 6) AS earnings_growth,
  round(sum(disc) FILTER (age < 365) / sum(disc) FILTER (age >= 365 AND age < 730) - 1, 6) AS free_cashflow_growth,
  round(sum(tax) FILTER (age < 365) / sum(tax) FILTER (age >= 365 AND age < 730) - 1, 6) AS analyst_revision,
  round(1 - (sum(disc) + sum(tax)) * 6 / sum(ext), 6) AS gross_margin, round(1 - sum(disc) * 15 / sum(ext), 6) AS operating_margin,
  round(1 - sum(tax) * 21 / sum(ext), 6) AS net_margin, round(sum(ret) / count(*), 6) AS return_on_equity,
  round(sum(ret) / count(*) - 1e-1, 6) AS return_on_invested_capital, round(sum(ext) / sum(qty) / 100, 6) AS forward_pe,
  round(sum(qty) / count(*) / 8, 6) AS price_to_book, round(sum(ext) / count(*) / 4000, 6) AS ev_to_ebitda,
  round(sum(disc) / sum(ext) / 2, 6) AS fcf_yield, round(sum(tax) * 30 / sum(ext), 6) AS debt_to_equity, sum(ext) AS market_cap
 FROM (SELECT n_name AS ticker, r_name AS sector, n_nationkey AS k, l_extendedprice AS ext, l_quantity AS qty, l_extendedprice * l_discount AS disc,
   l_extendedprice * l_tax AS tax, CASE WHEN l_returnflag = 'R' THEN 1e0 ELSE 0e0 END AS ret,
   datediff('day', CAST(l_shipdate AS DATE), CAST(max(l_shipdate) OVER (PARTITION BY n_name) AS DATE)) AS age
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
 GROUP BY ticker, sector, k)""",
)
