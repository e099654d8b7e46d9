"""Independent ANSI-SQL oracles (DuckDB dialect) for every SQL-expressible registry query.

Each oracle re-derives its input from the pre-registered test-table views, so it shares no
code path with the Spark side. Types are cast explicitly so both engines return the same
values (DuckDB sums integers to HUGEINT and divides decimals in double).
"""

from __future__ import annotations

# --- the retail batch (same derivation rules as tillroll.sources.retail) --------------------
_RETAIL_BASE = """
retail_base AS (
    SELECT l.l_orderkey, l.l_partkey, l.l_linenumber, l.l_quantity, l.l_extendedprice,
           l.l_returnflag, o.o_orderkey, o.o_custkey, o.o_orderdate, p.p_name, n.n_name
    FROM lineitem l
    JOIN orders o ON l.l_orderkey = o.o_orderkey
    JOIN customer c ON o.o_custkey = c.c_custkey
    JOIN nation n ON c.c_nationkey = n.n_nationkey
    JOIN part p ON l.l_partkey = p.p_partkey
),
retail_shaped AS (
    SELECT
        CASE WHEN o_orderkey % 10 = 0 AND l_returnflag = 'R' THEN 'C' || CAST(o_orderkey AS VARCHAR)
             WHEN o_orderkey % 101 = 0 THEN 'A' || CAST(o_orderkey AS VARCHAR)
             ELSE CAST(o_orderkey AS VARCHAR) END AS InvoiceNo,
        CAST(l_partkey AS VARCHAR) AS StockCode,
        CASE WHEN l_partkey % 97 = 0 THEN NULL
             WHEN l_partkey % 89 = 0 THEN '   '
             WHEN l_linenumber = 7 THEN ' ' || upper(p_name) || ' '
             ELSE '  ' || p_name || ' ' END AS Description,
        CASE WHEN o_orderkey % 10 = 0 AND l_returnflag = 'R' THEN -CAST(l_quantity AS INTEGER)
             WHEN o_orderkey % 53 = 0 THEN 0
             ELSE CAST(l_quantity AS INTEGER) END AS Quantity,
        {invoice_date} AS InvoiceDate,
        CAST(CASE WHEN o_orderkey % 59 = 0 THEN 0
                  ELSE CAST(l_extendedprice AS DECIMAL(12,2)) * 0.01 END AS DECIMAL(12,4)) AS UnitPrice,
        CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS CustomerID,
        n_name AS Country,
        l_orderkey AS _k
    FROM retail_base
),
retail_raw AS (
    SELECT InvoiceNo, StockCode, Description, Quantity, InvoiceDate, UnitPrice, CustomerID, Country
    FROM retail_shaped
    UNION ALL
    SELECT InvoiceNo, StockCode, Description, Quantity, InvoiceDate, UnitPrice, CustomerID, Country
    FROM retail_shaped WHERE _k % 50 = 0
)"""

_DATE_ONLY = "CAST(o_orderdate AS TIMESTAMP)"
_TIME_OF_DAY = "CAST(o_orderdate AS TIMESTAMP) + to_minutes(CAST(o_orderkey % 1440 AS BIGINT))"


def retail_ctes(time_of_day: bool = False) -> str:
    return _RETAIL_BASE.format(invoice_date=_TIME_OF_DAY if time_of_day else _DATE_ONLY)


def with_ctes(*ctes: str, time_of_day: bool = False) -> str:
    """``WITH`` clause: the retail batch followed by further named CTE bodies."""
    parts = [retail_ctes(time_of_day)] + [c.strip() for c in ctes]
    return "WITH " + ",\n".join(parts) + "\n"


# --- reusable CTE bodies ----------------------------------------------------------------------
STRIP = "regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def strip(c: str) -> str:
    return STRIP.format(c=c)


STANDARDIZED = f"""
std AS (
    SELECT {strip('InvoiceNo')} AS InvoiceNo, {strip('StockCode')} AS StockCode,
           {strip('Description')} AS Description, Quantity, InvoiceDate, UnitPrice,
           CAST(CustomerID AS BIGINT) AS CustomerID, {strip('Country')} AS Country
    FROM retail_raw
)"""

CLEAN = """
clean_filtered AS (
    SELECT *, CustomerID IS NULL AS is_guest FROM std
    WHERE Description IS NOT NULL AND length(Description) > 0
      AND NOT coalesce(starts_with(InvoiceNo, 'C'), false)
      AND Quantity > 0 AND UnitPrice > 0
),
clean_ranked AS (
    SELECT *, row_number() OVER (
        PARTITION BY InvoiceNo, StockCode, Quantity, InvoiceDate, UnitPrice, CustomerID
        ORDER BY Description NULLS FIRST, Country NULLS FIRST, is_guest NULLS FIRST) AS _rn
    FROM clean_filtered
),
clean AS (
    SELECT InvoiceNo, StockCode, Description, Quantity, InvoiceDate, UnitPrice, CustomerID, Country,
           is_guest, CAST(round(Quantity * UnitPrice, 2) AS DECIMAL(14,2)) AS TotalPrice
    FROM clean_ranked WHERE _rn = 1
)"""

SILVER = """
silver_typed AS (
    SELECT InvoiceNo AS invoice_no, StockCode AS product_key,
           nullif(trim(Description), '') AS product_description, Quantity AS quantity,
           InvoiceDate AS invoiced_at, UnitPrice AS unit_price,
           coalesce(CustomerID, 'UNKNOWN') AS customer_key, Country AS country
    FROM retail_raw
    WHERE NOT starts_with(InvoiceNo, 'C') AND NOT starts_with(InvoiceNo, 'A')
      AND Quantity > 0 AND UnitPrice > 0
),
silver_ranked AS (
    SELECT *, row_number() OVER (
        PARTITION BY invoice_no, product_key, invoiced_at, quantity, unit_price
        ORDER BY product_description NULLS FIRST, customer_key NULLS FIRST, country NULLS FIRST) AS _rn
    FROM silver_typed
),
silver AS (
    SELECT invoice_no, product_key, product_description, quantity, invoiced_at, unit_price,
           customer_key, country, CAST(invoiced_at AS DATE) AS date_key,
           CAST(year(invoiced_at) AS INTEGER) AS invoice_year,
           CAST(month(invoiced_at) AS INTEGER) AS invoice_month,
           CAST(quantity * unit_price AS DECIMAL(14,4)) AS line_revenue
    FROM silver_ranked WHERE _rn = 1
)"""

# landing (P17) over the cleaned lines, then staging (P14): ledger rows are dropped here
LOADED_AT_SQL = "TIMESTAMP '2026-01-01 00:00:00'"

LANDING = f"""
landing AS (
    SELECT InvoiceNo AS invoice_no, StockCode AS stock_code, Description AS description,
           Quantity AS quantity, InvoiceDate AS invoice_date, UnitPrice AS unit_price,
           CAST(CustomerID AS VARCHAR) AS customer_id, Country AS country,
           {LOADED_AT_SQL} AS loaded_at
    FROM clean
)"""

STG = """
stg AS (
    SELECT invoice_no, stock_code AS product_key, nullif(trim(description), '') AS product_description,
           CAST(quantity AS INTEGER) AS quantity, invoice_date AS invoiced_at,
           CAST(unit_price AS DECIMAL(12,4)) AS unit_price,
           coalesce(customer_id, 'UNKNOWN') AS customer_key, country,
           CAST(invoice_date AS DATE) AS date_key,
           CAST(quantity * unit_price AS DECIMAL(14,4)) AS line_revenue, loaded_at
    FROM landing
    WHERE quantity > 0 AND unit_price > 0
      AND invoice_no NOT LIKE 'A%' AND invoice_no NOT LIKE 'C%'
)"""


def clean_chain(time_of_day: bool = False) -> str:
    return with_ctes(STANDARDIZED, CLEAN, time_of_day=time_of_day)


def stg_chain(*extra: str) -> str:
    return with_ctes(STANDARDIZED, CLEAN, LANDING, STG, *extra)


def silver_chain(*extra: str) -> str:
    return with_ctes(SILVER, *extra)
