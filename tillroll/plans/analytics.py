"""Registry: business analytics over the operational star (time-of-day invoice dates)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillroll.operators import analytics as A
from tillroll.operators import clean as C
from tillroll.operators import star as S
from tillroll.plans import oracle as O
from tillroll.plans.catalog import query, raw

STAR_CTES = [
    """tx AS (SELECT InvoiceNo AS invoice_no, StockCode AS stock_code, CustomerID AS customer_id, Quantity AS quantity,
    UnitPrice AS unit_price, TotalPrice AS total_price, InvoiceDate AS invoice_date, Country AS country, is_guest
    FROM clean)""",
    """products AS (SELECT stock_code, description FROM (
    SELECT StockCode AS stock_code, Description AS description, row_number() OVER (
        PARTITION BY StockCode ORDER BY Description IS NULL, count(*) DESC, Description) AS _r
    FROM clean GROUP BY StockCode, Description) WHERE _r = 1)""",
]


def star_sql(*extra: str) -> str:
    return O.with_ctes(O.STANDARDIZED, O.CLEAN, *STAR_CTES, *extra, time_of_day=True)


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact for a query that reads it once: nothing is stored in between."""
    return S.fact_transactions(C.clean_data(raw(spark, sf_dir, time_of_day=True)))


def _star(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Fact and products, both from one stored cleaned batch."""
    from tillroll.plans.ingest import clean_table

    cleaned = clean_table(spark, sf_dir, time_of_day=True)
    return S.fact_transactions(cleaned), S.star_dim_products(cleaned)


MONTHLY_CTE = """mon AS (SELECT CAST(date_trunc('month', invoice_date) AS DATE) AS month_start, sum(total_price) AS revenue
    FROM tx GROUP BY 1),
mon_filled AS (
    SELECT s.month_start, CAST(coalesce(m.revenue, 0) AS DECIMAL(24,2)) AS revenue
    FROM (SELECT CAST(unnest(generate_series(min(month_start), max(month_start), INTERVAL 1 MONTH)) AS DATE) AS month_start
          FROM mon) s LEFT JOIN mon m ON s.month_start = m.month_start
)"""


@query("monthly_revenue", star_sql(MONTHLY_CTE) + "SELECT month_start, revenue FROM mon_filled", "A15")
def monthly_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.monthly_revenue(_facts(spark, sf_dir))


WEEKLY_SQL = star_sql(
    """wk AS (SELECT CAST(date_trunc('week', invoice_date) AS DATE) + 6 AS week_end, sum(total_price) AS revenue
    FROM tx GROUP BY 1)"""
) + """SELECT s.week_end, CAST(coalesce(w.revenue, 0) AS DECIMAL(24,2)) AS revenue
FROM (SELECT CAST(unnest(generate_series(min(week_end), max(week_end), INTERVAL 7 DAY)) AS DATE) AS week_end FROM wk) s
LEFT JOIN wk w ON s.week_end = w.week_end"""


@query("weekly_revenue", WEEKLY_SQL, "A15")
def weekly_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.weekly_revenue(_facts(spark, sf_dir))


BEST_WORST_SQL = star_sql(MONTHLY_CTE) + """SELECT b.month_start AS best_month, b.revenue AS best_revenue,
       w.month_start AS worst_month, w.revenue AS worst_revenue,
       CASE WHEN w.revenue <> 0 THEN round(CAST(b.revenue AS DOUBLE) / CAST(w.revenue AS DOUBLE), 6) END
           AS best_to_worst_ratio
FROM (SELECT * FROM mon_filled ORDER BY revenue DESC, month_start LIMIT 1) b,
     (SELECT * FROM mon_filled ORDER BY revenue, month_start LIMIT 1) w"""


@query("best_worst_month", BEST_WORST_SQL, "A21")
def best_worst_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.best_worst_month(A.monthly_revenue(_facts(spark, sf_dir)))


TOP_PRODUCTS_SQL = star_sql() + """SELECT description, revenue, rank FROM (
    SELECT description, revenue, row_number() OVER (ORDER BY revenue DESC, description) AS rank FROM (
        SELECT p.description, CAST(sum(t.total_price) AS DECIMAL(24,2)) AS revenue
        FROM tx t LEFT JOIN products p ON t.stock_code = p.stock_code
        WHERE p.description IS NOT NULL GROUP BY p.description)) WHERE rank <= 10"""


@query("top_products", TOP_PRODUCTS_SQL, "T1,J10")
def top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx, products = _star(spark, sf_dir)
    return A.top_products(tx, products)


TOP_COUNTRIES_SQL = star_sql() + """SELECT country, revenue, rank FROM (
    SELECT country, revenue, row_number() OVER (ORDER BY revenue DESC, country) AS rank FROM (
        SELECT country, CAST(sum(total_price) AS DECIMAL(24,2)) AS revenue FROM tx GROUP BY country)) WHERE rank <= 10"""


@query("top_countries", TOP_COUNTRIES_SQL, "T2")
def top_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.top_countries(_facts(spark, sf_dir))


SHARE_SQL = star_sql() + """SELECT country, revenue,
       round(100.0 * CAST(revenue AS DOUBLE) / CAST(sum(revenue) OVER () AS DOUBLE), 6) AS share_pct
FROM (SELECT country, CAST(sum(total_price) AS DECIMAL(24,2)) AS revenue FROM tx GROUP BY country)"""


@query("country_share", SHARE_SQL, "A16")
def country_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.country_share(_facts(spark, sf_dir))


def _edges(name: str, col: str) -> str:
    # quartile edges x4 (exact): 4*v_lo + (v_hi - v_lo) * ((n-1)k mod 4), position 1 + (n-1)k div 4
    return f"""
{name}_pos AS (SELECT {col} AS v, row_number() OVER (ORDER BY {col}) AS rn, count(*) OVER () AS n FROM rfm_base),
{name}_k AS (
    SELECT k, max(CASE WHEN rn = (n - 1) * k // 4 + 1 THEN v END) AS lo_v,
              max(CASE WHEN rn = (n - 1) * k // 4 + 2 THEN v END) AS hi_v,
              max((n - 1) * k % 4) AS m
    FROM {name}_pos, (VALUES (1), (2), (3)) ks(k) GROUP BY k
),
{name}_e AS (
    SELECT max(CASE WHEN k = 1 THEN e4 END) AS e1, max(CASE WHEN k = 2 THEN e4 END) AS e2,
           max(CASE WHEN k = 3 THEN e4 END) AS e3
    FROM (SELECT k, 4 * lo_v + (coalesce(hi_v, lo_v) - lo_v) * m AS e4 FROM {name}_k)
)"""


RFM_CTES = [
    """rfm_base AS (
    SELECT customer_id,
           CAST((epoch_us(max(s.snap)) - epoch_us(max(invoice_date))) // 86400000000 AS INTEGER) AS Recency,
           count(DISTINCT invoice_no) AS Frequency, CAST(sum(total_price) AS DECIMAL(24,2)) AS Monetary
    FROM tx, (SELECT max(invoice_date) + INTERVAL 1 DAY AS snap FROM tx WHERE customer_id IS NOT NULL) s
    WHERE customer_id IS NOT NULL GROUP BY customer_id
)""",
    _edges("re", "Recency"),
    _edges("me", "Monetary"),
    """f_pos AS (SELECT customer_id, row_number() OVER (ORDER BY Frequency, customer_id) AS rn,
                     count(*) OVER () AS n FROM rfm_base)""",
    """rfm_scored AS (
    SELECT b.customer_id, b.Recency, b.Frequency, b.Monetary,
           CAST(5 - CASE WHEN 4 * b.Recency <= r.e1 THEN 1 WHEN 4 * b.Recency <= r.e2 THEN 2
                         WHEN 4 * b.Recency <= r.e3 THEN 3 ELSE 4 END AS INTEGER) AS R,
           CAST(CASE WHEN 4 * (f.rn - 1) <= 1 * (f.n - 1) THEN 1 WHEN 4 * (f.rn - 1) <= 2 * (f.n - 1) THEN 2
                     WHEN 4 * (f.rn - 1) <= 3 * (f.n - 1) THEN 3 ELSE 4 END AS INTEGER) AS F,
           CAST(CASE WHEN 4 * b.Monetary <= m.e1 THEN 1 WHEN 4 * b.Monetary <= m.e2 THEN 2
                     WHEN 4 * b.Monetary <= m.e3 THEN 3 ELSE 4 END AS INTEGER) AS M
    FROM rfm_base b JOIN f_pos f ON b.customer_id = f.customer_id, re_e r, me_e m
)""",
    """rfm AS (
    SELECT *, CAST(R + F + M AS INTEGER) AS RFM_Score,
           CASE WHEN R + F + M >= 10 THEN 'Champions' WHEN R + F + M >= 8 THEN 'Loyal Customers'
                WHEN R + F + M >= 6 THEN 'Potential Loyalists' WHEN R + F + M >= 4 THEN 'At Risk'
                ELSE 'Lost' END AS Segment
    FROM rfm_scored
)""",
]


@query("rfm_quartiles", star_sql(*RFM_CTES) + "SELECT * FROM rfm", "D4,W4,W5,F6")
def rfm_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.rfm_quartiles(_facts(spark, sf_dir))


SEGMENT_SQL = star_sql(*RFM_CTES) + """SELECT o.segment_order, o.Segment,
       CAST(coalesce(s.customers, 0) AS BIGINT) AS customers,
       round(100.0 * CAST(coalesce(s.customers, 0) AS DOUBLE) / CAST(t.tc AS DOUBLE), 6) AS pct_customers,
       CAST(coalesce(s.revenue, 0) AS DECIMAL(24,2)) AS revenue,
       round(100.0 * CAST(CAST(coalesce(s.revenue, 0) AS DECIMAL(24,2)) AS DOUBLE) / CAST(t.tr AS DOUBLE), 6) AS pct_revenue
FROM (VALUES (1, 'Champions'), (2, 'Loyal Customers'), (3, 'Potential Loyalists'), (4, 'At Risk'), (5, 'Lost'))
     o(segment_order, Segment)
LEFT JOIN (SELECT Segment, count(*) AS customers, sum(Monetary) AS revenue FROM rfm GROUP BY Segment) s
     ON o.Segment = s.Segment,
     (SELECT count(*) AS tc, sum(Monetary) AS tr FROM rfm) t"""


@query("rfm_segment_summary", SEGMENT_SQL, "A16,A17")
def rfm_segment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.rfm_segment_summary(A.rfm_quartiles(_facts(spark, sf_dir)))


DESCRIBE_SQL = star_sql(*RFM_CTES) + "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS column_name, count({c}) AS count, round(avg(CAST({c} AS DOUBLE)), 4) AS mean,
       round(stddev_samp(CAST({c} AS DOUBLE)), 4) AS std, round(min(CAST({c} AS DOUBLE)), 4) AS min,
       round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 4) AS q25, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4) AS q50,
       round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 4) AS q75, round(max(CAST({c} AS DOUBLE)), 4) AS max FROM rfm"""
    for c in A.DESCRIBE_COLUMNS
)


@query("rfm_describe", DESCRIBE_SQL, "A18")
def rfm_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.describe(A.rfm_quartiles(_facts(spark, sf_dir)), A.DESCRIBE_COLUMNS)


ORDER_VALUE_SQL = star_sql(
    "ov AS (SELECT invoice_no, sum(total_price) AS order_value FROM tx GROUP BY invoice_no)"
) + """SELECT count(*) AS orders, CAST(sum(order_value) AS DECIMAL(24,2)) AS total_revenue,
       round(avg(CAST(order_value AS DOUBLE)), 4) AS mean_order_value,
       round(quantile_cont(CAST(order_value AS DOUBLE), 0.5), 4) AS median_order_value
FROM ov"""


@query("order_value_stats", ORDER_VALUE_SQL, "A19")
def order_value_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.order_value_stats(_facts(spark, sf_dir))


TOP_CUSTOMERS_SQL = star_sql() + """SELECT customer_id, revenue, orders, rank FROM (
    SELECT customer_id, revenue, orders, row_number() OVER (ORDER BY revenue DESC, customer_id) AS rank FROM (
        SELECT customer_id, CAST(sum(total_price) AS DECIMAL(24,2)) AS revenue, count(DISTINCT invoice_no) AS orders
        FROM tx WHERE customer_id IS NOT NULL GROUP BY customer_id)) WHERE rank <= 10"""


@query("top_customers", TOP_CUSTOMERS_SQL, "A20")
def top_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.top_customers(_facts(spark, sf_dir))
