"""Warehouse models: staging view, sales fact, customer / product / date dimensions, and
the star join every dashboard metric resolves to.

Staging is a temp-view-like function (no dedupe, no business logic beyond dropping junk);
marts are DataFrames a job writes as tables (``write_layer(..., MARTS, name)``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions import KEY_TIMESTAMP_FORMAT, calendar_columns, exact_avg_price, nullif_blank, surrogate_key
from tillroll.operators.layers import (
    UNKNOWN_CUSTOMER,
    customer_facts,
    product_totals,
    resolve_descriptions,
    sales_filter,
    score_rfm,
)
from tillroll.schema import PRICE_TYPE, REVENUE_TYPE
from tillroll.session import store
from tillroll.sources.tables import write_table

# --- fixed values: dimension fallbacks and the volatility rule ------------------------------
UNKNOWN_PRODUCT = "UNKNOWN PRODUCT"
VOLATILE_PRICE_FACTOR = 3
#: A key is hot if it has more than one in so many rows, and items that the search for them tracks.
HOT_PARTS = 128
TRACKED_ITEMS = 16_384
#: Rows of two narrow columns up to which a dimension is broadcast.
BROADCAST_ROWS = 200_000
SALES_KEY_COLUMNS = ["invoice_no", "product_key", "invoiced_at", "unit_price", "quantity"]


def stg_transactions(landing: DataFrame) -> DataFrame:
    """Rename, cast, blank description -> null, guests -> ``UNKNOWN``, date key, revenue;
    sales rows only (positive quantity/price, no ledger ``A`` or cancellation ``C`` invoices)."""
    typed = landing.select(
        F.col("invoice_no").cast("string").alias("invoice_no"),
        F.col("stock_code").cast("string").alias("product_key"),
        nullif_blank("description").alias("product_description"),
        F.col("quantity").cast("int").alias("quantity"),
        F.col("invoice_date").cast("timestamp").alias("invoiced_at"),
        F.col("unit_price").cast(PRICE_TYPE).alias("unit_price"),
        F.coalesce(F.col("customer_id").cast("string"), F.lit(UNKNOWN_CUSTOMER)).alias("customer_key"),
        F.col("country").cast("string").alias("country"),
        F.to_date("invoice_date").alias("date_key"),
        (F.col("quantity") * F.col("unit_price")).cast(REVENUE_TYPE).alias("line_revenue"),
        F.col("loaded_at").cast("timestamp").alias("loaded_at"),
    )
    return typed.filter(sales_filter(F.col("invoice_no"), F.col("quantity"), F.col("unit_price")))


def fct_sales(stg: DataFrame) -> DataFrame:
    """P15 + F10: invoice-line grain with a surrogate key over the natural composite."""
    return stg.select(
        surrogate_key(*SALES_KEY_COLUMNS, formats={"invoiced_at": KEY_TIMESTAMP_FORMAT}).alias("sales_key"),
        "invoice_no",
        "date_key",
        "customer_key",
        "product_key",
        "country",
        "quantity",
        "unit_price",
        "line_revenue",
        "invoiced_at",
    )


def dim_customer(stg: DataFrame, num_partitions: int | None = None) -> DataFrame:
    """Customer facts + primary country (mode) + RFM quintiles and segment."""
    scored = score_rfm(customer_facts(stg, with_primary_country=True), num_partitions=num_partitions)
    return scored.select(
        "customer_key",
        "primary_country",
        "first_purchase_date",
        "last_purchase_date",
        "recency_days",
        "invoice_count",
        "total_units",
        "lifetime_revenue",
        "recency_score",
        "frequency_score",
        "monetary_score",
        "rfm_segment",
    )


def dim_product(stg: DataFrame) -> DataFrame:
    """Product facts, resolved description (fallback ``UNKNOWN PRODUCT``), weighted
    average price, volatile-pricing flag (max > 3 x min)."""
    return (
        product_totals(stg)
        .join(resolve_descriptions(stg), "product_key", "left")
        .select(
            "product_key",
            F.coalesce(F.col("product_description"), F.lit(UNKNOWN_PRODUCT)).alias("product_description"),
            "invoice_count",
            "total_units_sold",
            "total_revenue",
            "min_unit_price",
            "max_unit_price",
            exact_avg_price(F.col("total_revenue"), F.col("total_units_sold")).alias("avg_selling_price"),
            (F.col("max_unit_price") > F.col("min_unit_price") * VOLATILE_PRICE_FACTOR).alias("has_volatile_pricing"),
        )
    )


def dim_date(stg: DataFrame) -> DataFrame:
    """D3: an unbroken day spine from the first to the last sales date, gaps included.

    The bounds are one aggregate row; the spine's size is bounded by the calendar span (not by
    the data volume), so exploding it in one task is harmless.
    """
    bounds = stg.agg(F.min("date_key").alias("lo"), F.max("date_key").alias("hi"))
    spine = bounds.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("date_key"))
    return spine.select(*calendar_columns("date_key"))


def hot_keys(fact: DataFrame, keys: list[str], parts: int = HOT_PARTS) -> dict[str, DataFrame]:
    """For each key column the values that more than one in ``parts`` rows has: (hot_key, salts), with
    as many salts as the value has parts of the rows.

    One pass with a mergeable sketch of frequent items finds them; a value over that share can't be
    missed, as the sketch tracks many times more items. There are fewer than ``parts`` of them
    whatever the data, so they may be broadcast."""
    tops = [F.expr(f"approx_top_k(`{key}`, {parts}, {TRACKED_ITEMS})").alias(f"top{i}") for i, key in enumerate(keys)]
    seen = store(fact.agg(F.count(F.lit(1)).alias("n"), *tops), "hot-keys")
    out = {}
    for i, key in enumerate(keys):
        found = seen.select("n", F.inline(f"top{i}")).filter(F.col("item").isNotNull())
        salts = F.ceil(F.col("count") * parts / F.col("n")).cast("int")
        out[key] = found.select(F.col("item").alias("hot_key"), salts.alias("salts")).filter("salts > 1")
    return out


def join_hot_keys(fact: DataFrame, dim: DataFrame, key: str, hot: DataFrame, spread: list[str]) -> DataFrame:
    """Equi-join ``fact`` to ``dim`` on ``key`` in one scan, with the keys in ``hot`` salted.

    A hot key's fact rows get a salt from the columns ``spread``, and its dimension row is repeated
    for each of its salts; all other rows have salt 0. So no task holds much more than one part of
    the fact, whichever keys are hot."""
    few = F.broadcast(hot)  # bounded by the parts, not by the data
    with_salts = fact.join(few, F.col(key) == F.col("hot_key"), "left")
    salt = F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64(*spread), F.col("salts").cast("long"))).otherwise(0)
    salted = with_salts.withColumn("_salt", salt.cast("int")).drop("hot_key", "salts")
    repeated = dim.join(few, F.col(key) == F.col("hot_key"), "left")
    repeated = repeated.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("hot_key", "salts")
    return salted.join(repeated, [key, "_salt"]).drop("_salt")


def star_join_revenue(fct: DataFrame, d_date: DataFrame, d_customer: DataFrame, d_product: DataFrame) -> DataFrame:
    """Revenue by month, RFM segment and pricing volatility from the fact joined to the
    three dimensions.

    ``dim_date`` is bounded by the calendar span, so it is broadcast explicitly. Customers and
    products grow with the data: they are counted, and broadcast up to BROADCAST_ROWS; a larger
    one is joined by shuffle, and the keys that many rows share (the guest bucket, a best-selling
    product) are found in the fact and salted. The dimensions should be stored tables.
    """
    large = [k for k, dim in (("customer_key", d_customer), ("product_key", d_product)) if dim.count() > BROADCAST_ROWS]
    hot = hot_keys(fct, large) if large else {}

    def joined_to(rows: DataFrame, dim: DataFrame, key: str, spread: list[str]) -> DataFrame:
        return join_hot_keys(rows, dim, key, hot[key], spread) if key in hot else rows.join(F.broadcast(dim), key)

    with_date = fct.join(F.broadcast(d_date.select("date_key", "year_month")), "date_key")
    customers = d_customer.select("customer_key", "rfm_segment")
    with_customer = joined_to(with_date, customers, "customer_key", ["invoice_no", "product_key"])
    products = d_product.select("product_key", "has_volatile_pricing")
    joined = joined_to(with_customer, products, "product_key", ["invoice_no"])
    return joined.groupBy("year_month", "rfm_segment", "has_volatile_pricing").agg(
        F.count(F.lit(1)).alias("sales_lines"),
        F.countDistinct("invoice_no").alias("invoice_count"),
        F.sum("quantity").alias("units_sold"),
        F.sum("line_revenue").alias("revenue"),
    )


MART_TABLES = ("fct_sales", "dim_customer", "dim_product", "dim_date")


def build_warehouse(stg: DataFrame, root: str, *, num_partitions: int | None = None) -> dict[str, str]:
    """K6: materialise the marts as tables; staging stays a view over the landing table, which
    should be a stored one, as each mart reads it once with its own columns. The four
    independent writes are submitted concurrently. Returns ``{mart: path}``.
    """
    from concurrent.futures import ThreadPoolExecutor

    builders = {
        "fct_sales": lambda: fct_sales(stg),
        "dim_customer": lambda: dim_customer(stg, num_partitions=num_partitions),
        "dim_product": lambda: dim_product(stg),
        "dim_date": lambda: dim_date(stg),
    }

    def write(name: str) -> tuple[str, str]:
        path = f"{root}/{name}"
        write_table(builders[name](), path)
        return name, path

    with ThreadPoolExecutor(max_workers=len(builders)) as pool:
        return dict(pool.map(write, MART_TABLES))


def staging_view(landing: DataFrame, name: str = "stg_transactions") -> str:
    """K6: staging as a session view over the landing table; returns the view's name."""
    stg_transactions(landing).createOrReplaceTempView(name)
    return name
