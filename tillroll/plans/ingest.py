"""Registry: sources, cleaning, layers, landing and fact builds."""

from __future__ import annotations

import datetime as dt
import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.operators import clean as C
from tillroll.operators import layers as L
from tillroll.operators import marts as M
from tillroll.operators import star as S
from tillroll.plans import oracle as O
from tillroll.plans.catalog import LOADED_AT, materialize, query, raw, sql_ts, ts_lit
from tillroll.session import BRONZE, scratch_path
from tillroll.sources.raw import (
    align_raw_types,
    declared_read,
    file_columns,
    lacking_columns,
    read_layer,
    read_layer_between,
    read_star_tables,
)
from tillroll.schema import RAW_COLUMNS, RAW_SCHEMA
from pyspark.sql import types as T

RAW_SELECT = "SELECT InvoiceNo, StockCode, Description, Quantity, InvoiceDate, UnitPrice, CustomerID, Country"

#: how an upstream extract delivers the batch before alignment: float ids and prices
EXTRACT_SCHEMA = T.StructType(
    [
        T.StructField("InvoiceNo", T.StringType()),
        T.StructField("StockCode", T.StringType()),
        T.StructField("Description", T.StringType()),
        T.StructField("Quantity", T.LongType()),
        T.StructField("InvoiceDate", T.TimestampType()),
        T.StructField("UnitPrice", T.DoubleType()),
        T.StructField("CustomerID", T.DoubleType()),
        T.StructField("Country", T.StringType()),
    ]
)


@query("raw_declared_read", O.with_ctes() + RAW_SELECT + " FROM retail_raw", "S1,S2")
def raw_declared_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land the batch as an extract would deliver it (float ids/prices), read it back under a
    declared schema and align types to ``RAW_SCHEMA``."""
    src = raw(spark, sf_dir).select(
        *[
            F.col(c).cast(EXTRACT_SCHEMA[c].dataType).alias(c) if c in ("Quantity", "UnitPrice", "CustomerID") else c
            for c in RAW_COLUMNS
        ]
    )
    path = scratch_path(spark, "raw-extract")
    src.write.parquet(path)
    return align_raw_types(declared_read(spark, path, "parquet", EXTRACT_SCHEMA))


@query(
    "bronze_rows",
    O.with_ctes()
    + RAW_SELECT
    + ", CAST(year(InvoiceDate) AS INTEGER) AS invoice_year, CAST(month(InvoiceDate) AS INTEGER) AS invoice_month"
    + " FROM retail_raw",
    "P9,F11",
)
def bronze_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    # ingested_at is wall-clock provenance: excluded from the compared output
    return L.to_bronze(raw(spark, sf_dir)).drop("ingested_at")


@query(
    "bronze_roundtrip_prune",
    O.with_ctes()
    + """SELECT CAST(year(InvoiceDate) AS INTEGER) AS invoice_year, CAST(month(InvoiceDate) AS INTEGER) AS invoice_month,
       count(*) AS rows, CAST(sum(Quantity) AS BIGINT) AS units, CAST(sum(UnitPrice) AS DECIMAL(22,4)) AS price_sum
FROM retail_raw GROUP BY 1, 2""",
    "S3,K1,K2",
)
def bronze_roundtrip_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write bronze partitioned by event year/month, read it back (partition columns come
    back as int columns) and aggregate per partition."""
    root = scratch_path(spark, "lake")
    path = L.write_layer(L.to_bronze(raw(spark, sf_dir)), BRONZE, "transactions", partition_by=["invoice_year", "invoice_month"], root=root)
    back = read_layer(spark, path)
    return back.groupBy("invoice_year", "invoice_month").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("Quantity").alias("units"),
        F.sum("UnitPrice").cast("decimal(22,4)").alias("price_sum"),
    )


RANGE = (dt.date(1996, 3, 17), dt.date(1997, 2, 9))


@query(
    "bronze_date_range",
    O.with_ctes()
    + f"""SELECT CAST(InvoiceDate AS DATE) AS day, count(*) AS rows, CAST(sum(Quantity) AS BIGINT) AS units
FROM retail_raw WHERE CAST(InvoiceDate AS DATE) BETWEEN DATE '{RANGE[0]}' AND DATE '{RANGE[1]}' GROUP BY 1""",
    "S3,K1 (partition pruning)",
)
def bronze_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze written by event month and read back for a date range: only its months are read."""
    path = L.write_layer(
        L.to_bronze(raw(spark, sf_dir)),
        BRONZE,
        "transactions",
        partition_by=["invoice_year", "invoice_month"],
        root=scratch_path(spark, "lake"),
    )
    rows = read_layer_between(spark, path, "InvoiceDate", *RANGE)
    return rows.groupBy(F.to_date("InvoiceDate").alias("day")).agg(F.count(F.lit(1)).alias("rows"), F.sum("Quantity").alias("units"))


@query(
    "raw_file_faults",
    O.with_ctes()
    + """SELECT 'Country' AS "column", 'lacking' AS fault, count(*) AS rows FROM retail_raw WHERE InvoiceNo LIKE 'C%'
UNION ALL SELECT 'Quantity', 'bigint', count(*) FROM retail_raw WHERE InvoiceNo LIKE 'C%'""",
    "S1,C2",
)
def raw_file_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder in which the cancellations' files lack a column and have another type for one: each
    fault by column, with the rows of the files that show it."""
    path = scratch_path(spark, "mixed-files")
    batch = raw(spark, sf_dir)
    cancelled = F.col("InvoiceNo").startswith("C")
    batch.filter(~cancelled).write.parquet(path)
    batch.filter(cancelled).withColumn("Quantity", F.col("Quantity").cast("bigint")).drop("Country").write.mode("append").parquet(path)
    declared = {f.name: f.dataType.simpleString() for f in RAW_SCHEMA}
    told = file_columns(spark, path)
    lacking = lacking_columns(spark, path, list(declared)).select("file", F.explode("lacking").alias("column"), F.lit("lacking").alias("fault"))
    kind = F.create_map(*[F.lit(x) for item in declared.items() for x in item])[F.col("column")]
    retyped = told.filter(F.col("type") != kind).select("file", "column", F.col("type").alias("fault"))
    rows = spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("at")).agg(F.count(F.lit(1)).alias("n"))
    faults = lacking.unionByName(retyped).withColumn("name", F.element_at(F.split("file", "/"), -1))
    held = rows.select(F.element_at(F.split("at", "/"), -1).alias("name"), "n")
    return faults.join(held, "name").groupBy("column", "fault").agg(F.sum("n").alias("rows"))


@query("raw_csv_read", O.with_ctes() + RAW_SELECT + " FROM retail_raw", "S1")
def raw_csv_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land the batch as CSV and read it back under the declared schema, header checked."""
    path = scratch_path(spark, "raw-csv")
    keep = dict(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    raw(spark, sf_dir).select(*RAW_COLUMNS).write.options(**keep).csv(path)
    return declared_read(spark, path, "csv")


STD_SELECT = "SELECT InvoiceNo, StockCode, Description, Quantity, InvoiceDate, UnitPrice, CustomerID, Country"


@query("standardize_columns", O.with_ctes(O.STANDARDIZED) + STD_SELECT + " FROM std", "P1,F1,F7")
def standardize_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.standardize_columns(raw(spark, sf_dir))


@query("standardize_text", O.with_ctes(O.STANDARDIZED) + STD_SELECT + " FROM std", "P1,F7")
def standardize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch as an extract of nothing but text delivers it: month/day dates, quantities and
    customer ids with a fraction."""
    whole = lambda c: F.concat(F.col(c).cast("string"), F.lit(".0"))
    text = raw(spark, sf_dir).withColumns(
        {
            "InvoiceDate": F.date_format("InvoiceDate", "M/d/yyyy H:mm"),
            "Quantity": whole("Quantity"),
            "CustomerID": whole("CustomerID"),
            "UnitPrice": F.col("UnitPrice").cast("string"),
        }
    )
    return C.standardize_columns(text.select(*RAW_COLUMNS))


@query(
    "drop_missing_description",
    O.with_ctes(O.STANDARDIZED) + STD_SELECT + " FROM std WHERE Description IS NOT NULL AND length(Description) > 0",
    "P2",
)
def drop_missing_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.drop_missing_description(C.standardize_columns(raw(spark, sf_dir)))


@query(
    "remove_cancelled",
    O.with_ctes(O.STANDARDIZED) + STD_SELECT + " FROM std WHERE NOT coalesce(starts_with(InvoiceNo, 'C'), false)",
    "P3,F2",
)
def remove_cancelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.remove_cancelled_orders(C.standardize_columns(raw(spark, sf_dir)))


@query(
    "remove_invalid_qty_price",
    O.with_ctes(O.STANDARDIZED) + STD_SELECT + " FROM std WHERE Quantity > 0 AND UnitPrice > 0",
    "P4",
)
def remove_invalid_qty_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.remove_invalid_quantity_price(C.standardize_columns(raw(spark, sf_dir)))


@query("flag_guest", O.with_ctes(O.STANDARDIZED) + STD_SELECT + ", CustomerID IS NULL AS is_guest FROM std", "P5")
def flag_guest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.flag_guest_customers(C.standardize_columns(raw(spark, sf_dir)))


@query(
    "dedupe_first",
    O.with_ctes(O.STANDARDIZED)
    + STD_SELECT
    + """, is_guest FROM (
    SELECT *, row_number() OVER (
        PARTITION BY InvoiceNo, StockCode, Quantity, InvoiceDate, UnitPrice, CustomerID
        ORDER BY Description NULLS FIRST, Country NULLS FIRST) AS _rn
    FROM (SELECT *, CustomerID IS NULL AS is_guest FROM std)) WHERE _rn = 1""",
    "P6,U4",
)
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.deduplicate_rows(C.flag_guest_customers(C.standardize_columns(raw(spark, sf_dir))))


@query(
    "total_price",
    O.with_ctes(O.STANDARDIZED)
    + STD_SELECT
    + ", CAST(round(Quantity * UnitPrice, 2) AS DECIMAL(14,2)) AS TotalPrice FROM std",
    "P7,F8",
)
def total_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.add_total_price(C.standardize_columns(raw(spark, sf_dir)))


CLEAN_SELECT = (
    "SELECT InvoiceNo, StockCode, Description, Quantity, InvoiceDate, UnitPrice, CustomerID, Country, "
    "is_guest, TotalPrice FROM clean"
)


@query("clean_data", O.clean_chain() + CLEAN_SELECT, "P8,K3,S4")
def clean_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transform stage: clean, write the interim Parquet artifact, read it back."""
    from tillroll.streaming.events import clean_into

    path = scratch_path(spark, "interim")
    clean_into(raw(spark, sf_dir), path)
    return read_layer(spark, path)


SILVER_COLUMNS = (
    "invoice_no, product_key, product_description, quantity, invoiced_at, unit_price, customer_key, country, "
    "date_key, invoice_year, invoice_month, line_revenue"
)


@query("silver_sales", O.silver_chain() + f"SELECT {SILVER_COLUMNS} FROM silver", "P10,P11,P12,P13")
def silver_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.to_silver(L.to_bronze(raw(spark, sf_dir)))


def landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.to_landing_frame(C.clean_data(raw(spark, sf_dir)), ts_lit(LOADED_AT))


def landing_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landing written once and read back, for queries with several consumers of it."""
    return materialize(landing(spark, sf_dir), "landing")


def staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.stg_transactions(landing(spark, sf_dir))


def silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.to_silver(L.to_bronze(raw(spark, sf_dir)))


def silver_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silver written once and read back, for queries with several consumers of it."""
    return materialize(silver(spark, sf_dir), "silver")


def staging_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staging written once and read back, for queries with several consumers of it."""
    return materialize(staging(spark, sf_dir), "staging")


def clean_table(spark: SparkSession, sf_dir: str, *, time_of_day: bool = False) -> DataFrame:
    """The cleaned batch written once (the interim artifact) and read back."""
    return materialize(C.clean_data(raw(spark, sf_dir, time_of_day=time_of_day)), "interim")


@query(
    "stg_transactions",
    O.stg_chain()
    + "SELECT invoice_no, product_key, product_description, quantity, invoiced_at, unit_price, customer_key, "
    "country, date_key, line_revenue, loaded_at FROM stg",
    "P14,F3",
)
def stg_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging(spark, sf_dir)


@query(
    "landing_load",
    O.with_ctes(O.STANDARDIZED, O.CLEAN, O.LANDING)
    + "SELECT invoice_no, stock_code, description, quantity, invoice_date, unit_price, customer_id, country, "
    "loaded_at FROM landing",
    "P17,K4",
)
def landing_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land the cleaned batch (full refresh) and read the landing table back."""
    path = scratch_path(spark, "landing")
    S.load_to_landing(C.clean_data(raw(spark, sf_dir)), path, truncate=True, loaded_at=ts_lit(LOADED_AT))
    return read_layer(spark, path)


@query(
    "fct_sales",
    O.stg_chain()
    + """SELECT md5(concat_ws('-', coalesce(CAST(invoice_no AS VARCHAR), '<null>'),
                coalesce(CAST(product_key AS VARCHAR), '<null>'),
                coalesce(strftime(invoiced_at, '%Y-%m-%d %H:%M:%S.%f'), '<null>'),
                coalesce(CAST(unit_price AS VARCHAR), '<null>'),
                coalesce(CAST(quantity AS VARCHAR), '<null>'))) AS sales_key,
       invoice_no, date_key, customer_key, product_key, country, quantity, unit_price, line_revenue, invoiced_at
FROM stg""",
    "P15,F10",
)
def fct_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.fct_sales(staging(spark, sf_dir))


@query(
    "fact_transactions",
    O.clean_chain()
    + "SELECT InvoiceNo AS invoice_no, StockCode AS stock_code, CustomerID AS customer_id, Quantity AS quantity, "
    "UnitPrice AS unit_price, TotalPrice AS total_price, InvoiceDate AS invoice_date, Country AS country, "
    "is_guest FROM clean",
    "P16",
)
def fact_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.fact_transactions(C.clean_data(raw(spark, sf_dir)))


LATER = LOADED_AT + dt.timedelta(days=1)


@query(
    "landing_append",
    O.with_ctes(O.STANDARDIZED, O.CLEAN, O.LANDING)
    + f"""SELECT {sql_ts(LOADED_AT)} AS loaded_at, count(*) AS rows, count(*) AS rows_written, count(*) AS rows_in_table,
       CAST(sum(quantity) AS BIGINT) AS units FROM landing
UNION ALL SELECT {sql_ts(LATER)}, count(*), count(*), 2 * count(*), CAST(sum(quantity) AS BIGINT) FROM landing""",
    "K4,P17 (append)",
)
def landing_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two loads appended to one landing table, with what each load reported."""
    path = scratch_path(spark, "landing")
    cleaned = clean_table(spark, sf_dir)
    reports = []
    for stamp in (LOADED_AT, LATER):
        done = S.load_to_landing(cleaned, path, truncate=False, loaded_at=ts_lit(stamp))
        reports.append((stamp, done["rows_written"], done["rows_in_table"]))
    told = spark.createDataFrame(reports, "loaded_at timestamp, rows_written long, rows_in_table long")
    rows = read_layer(spark, path).groupBy("loaded_at").agg(F.count(F.lit(1)).alias("rows"), F.sum("quantity").alias("units"))
    return rows.join(F.broadcast(told), "loaded_at")  # a row per load


def appended_star(spark: SparkSession, sf_dir: str) -> str:
    """A star of three appends: half of the lines, the rest with a fifth of the first half (which the
    batch should not have held), and the second batch again, as it should have been."""
    root = scratch_path(spark, "star")
    cleaned = clean_table(spark, sf_dir)
    part = F.pmod(F.xxhash64("InvoiceNo", "StockCode", "Quantity", "InvoiceDate", "UnitPrice"), F.lit(10))
    for name, lines in (("1", part < 5), ("2", part >= 4), ("2", part >= 5)):
        S.load_star(cleaned.filter(lines), root, mode="append", batch=name)
    return root


@query(
    "star_append",
    O.clean_chain()
    + """SELECT 'transactions' AS star_table, count(*) AS rows, count(DISTINCT StockCode) AS keys FROM clean
UNION ALL SELECT 'products', count(DISTINCT StockCode), count(DISTINCT StockCode) FROM clean
UNION ALL SELECT 'customers', count(DISTINCT CustomerID), count(DISTINCT CustomerID) FROM clean""",
    "K5 (append)",
)
def star_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A star of appended batches, one of them loaded twice: rows and keys of each table."""
    tables = zip(
        ("transactions", "customers", "products"),
        read_star_tables(spark, appended_star(spark, sf_dir)),
        ("stock_code", "customer_id", "stock_code"),
    )
    counted = [
        t.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(key).alias("keys")).select(F.lit(name).alias("star_table"), "*")
        for name, t, key in tables
    ]
    return functools.reduce(DataFrame.unionByName, counted)


@query(
    "staging_view",
    O.stg_chain() + "SELECT date_key, country, count(*) AS lines, CAST(sum(line_revenue) AS DECIMAL(24,4)) AS revenue FROM stg GROUP BY ALL",
    "K6",
)
def staging_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staging as a session view over the landing table, queried with SQL."""
    view = M.staging_view(landing_table(spark, sf_dir))
    return spark.sql(
        f"SELECT date_key, country, count(*) AS lines, CAST(sum(line_revenue) AS DECIMAL(24,4)) AS revenue FROM {view} GROUP BY date_key, country"
    )
