"""Operational star (transactions, customers, products) and the landing-zone load.

Loads are DataFrame writes (overwrite = full refresh, append = incremental); row counts come
from an ``Observation`` on the write itself instead of a second pass over the data.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.operators.clean import require_columns
from tillroll.operators.layers import mode_of_counts, mode_per_key, value_counts
from tillroll.schema import LANDING_COLUMNS, PRICE_TYPE
from tillroll.session import store
from tillroll.sources.tables import SUCCESS, exists, newest, numbered, publish, remove, write_table

# --- fixed values: cleaned-frame -> landing / star column names -----------------------------
LANDING_RENAMES = {
    "InvoiceNo": "invoice_no",
    "StockCode": "stock_code",
    "Description": "description",
    "Quantity": "quantity",
    "InvoiceDate": "invoice_date",
    "UnitPrice": "unit_price",
    "CustomerID": "customer_id",
    "Country": "country",
}
FACT_RENAMES = {
    "InvoiceNo": "invoice_no",
    "StockCode": "stock_code",
    "CustomerID": "customer_id",
    "Quantity": "quantity",
    "UnitPrice": "unit_price",
    "TotalPrice": "total_price",
    "InvoiceDate": "invoice_date",
    "Country": "country",
    "is_guest": "is_guest",
}


def to_landing_frame(clean: DataFrame, loaded_at: Column | None = None) -> DataFrame:
    """Rename to the landing contract; a missing column fails naming it; extra columns
    are dropped. Customer ids become text without a float artefact; one ``loaded_at`` per batch."""
    renamed = clean.select([F.col(c).alias(LANDING_RENAMES.get(c, c)) for c in clean.columns])
    missing = [c for c in LANDING_COLUMNS if c not in renamed.columns]
    if missing:
        raise ValueError(f"no landing column {missing[0]} in the cleaned batch")
    stamp = loaded_at if loaded_at is not None else F.current_timestamp()
    return renamed.select(
        F.col("invoice_no").cast("string"),
        F.col("stock_code").cast("string"),
        F.col("description").cast("string"),
        F.col("quantity").cast("int"),
        F.col("invoice_date").cast("timestamp"),
        F.col("unit_price").cast(PRICE_TYPE),
        F.col("customer_id").cast("bigint").cast("string").alias("customer_id"),
        F.col("country").cast("string"),
        stamp.cast("timestamp").alias("loaded_at"),
    )


def load_to_landing(clean: DataFrame, path: str, *, truncate: bool = True, loaded_at: Column | None = None) -> dict:
    """K4: write the landing table (overwrite when ``truncate``, else append) and report rows
    written vs rows now in the table."""
    landing = to_landing_frame(clean, loaded_at)
    written = write_table(landing, path, mode="overwrite" if truncate else "append", count=True)
    in_table = landing.sparkSession.read.parquet(path).count()
    return {"path": path, "rows_written": written, "rows_in_table": int(in_table)}


def fact_transactions(clean: DataFrame) -> DataFrame:
    """The operational fact: renamed column pick; customer id stays a nullable integer."""
    require_columns(clean, list(FACT_RENAMES))
    return clean.select([F.col(src).alias(dst) for src, dst in FACT_RENAMES.items()])


def _product_lines(clean: DataFrame) -> DataFrame:
    return clean.select(F.col("StockCode").alias("stock_code"), F.col("Description").alias("description"))


def _customer_lines(clean: DataFrame) -> DataFrame:
    known = clean.filter(F.col("CustomerID").isNotNull())
    return known.select(F.col("CustomerID").cast("bigint").alias("customer_id"), F.col("Country").alias("country"))


class Dimension(NamedTuple):
    """A table of a key's most frequent value, from lines of (key, value)."""

    name: str
    key: str
    value: str
    lines: Callable[[DataFrame], DataFrame]


DIMENSIONS = (
    Dimension("products", "stock_code", "description", _product_lines),
    Dimension("customers", "customer_id", "country", _customer_lines),
)


def star_dim_products(clean: DataFrame) -> DataFrame:
    """One row per stock code with its most frequent description (null if it has none)."""
    return mode_per_key(_product_lines(clean), "stock_code", "description", "description")


def star_dim_customers(clean: DataFrame) -> DataFrame:
    """One row per known customer with the country they order from most often."""
    return mode_per_key(_customer_lines(clean), "customer_id", "country", "country")


def _with_key(rows: DataFrame, keys: DataFrame, key: str, how: str) -> DataFrame:
    """Rows whose key (null included) is among ``keys``, or is not, by ``how``."""
    named = keys.select(F.col(key).alias("_key"))
    return rows.join(named, F.col(key).eqNullSafe(F.col("_key")), how)


def _merge_dimension(clean: DataFrame, root: str, dim: Dimension, batch: str, replace: bool) -> int:
    """Store the batch's counts per (key, value) and publish the dimension's next version.

    The most frequent value is no sum of batches, but its counts are: those of every batch are kept
    under its name, so a batch that is loaded again replaces what it counted before. Only keys that
    the batch has (or had) are judged anew, from the counts of all batches; the other rows are
    taken over from the version before."""
    spark = clean.sparkSession
    counts, table = f"{root}/_counts/{dim.name}", f"{root}/{dim.name}"
    own = f"{counts}/batch={batch}"
    if replace:
        remove(spark, counts)
        write_table(value_counts(dim.lines(clean), dim.key, dim.value), own)
        return publish(mode_of_counts(spark.read.parquet(own), dim.key, dim.value, dim.value), table)
    before = [spark.read.parquet(own).select(dim.key)] if exists(spark, f"{own}/{SUCCESS}") else []
    fresh = store(value_counts(dim.lines(clean), dim.key, dim.value), f"counts-{dim.name}")
    touched = store(functools.reduce(DataFrame.unionByName, before, fresh.select(dim.key)).distinct(), f"touched-{dim.name}")
    write_table(fresh, own)
    known = spark.read.parquet(counts).select(dim.key, dim.value, "times")
    judged = mode_of_counts(_with_key(known, touched, dim.key, "left_semi"), dim.key, dim.value, dim.value)
    if numbered(spark, table, "v="):
        others = spark.read.parquet(newest(spark, table))
        judged = judged.unionByName(_with_key(others, touched, dim.key, "left_anti"))
    return publish(judged, table)


def load_star(clean: DataFrame, root: str, *, mode: str = "overwrite", batch: str | None = None) -> dict:
    """K5: write the three star tables and return the rows of each load: those of the batch's
    transactions, and those that the dimensions hold now.

    ``overwrite`` starts the star anew, ``append`` adds a batch: its transactions in a folder of
    their own, its keys merged into the dimensions, which hold one row per key. A batch is known
    by its name (a new one by default); loading it again replaces it. One load runs at a time.
    The three tables are independent jobs, submitted concurrently."""
    if mode not in ("overwrite", "append"):
        raise ValueError(f"no such mode: {mode}")
    spark, replace = clean.sparkSession, mode == "overwrite"
    batch = batch or uuid.uuid4().hex[:12]

    def transactions() -> int:
        if replace:
            remove(spark, f"{root}/transactions")
        return write_table(fact_transactions(clean), f"{root}/transactions/batch={batch}", count=True)

    loads = {"transactions": transactions}
    loads |= {d.name: functools.partial(_merge_dimension, clean, root, d, batch, replace) for d in DIMENSIONS}
    with ThreadPoolExecutor(max_workers=len(loads)) as pool:
        running = {name: pool.submit(load) for name, load in loads.items()}
        return {name: load.result() for name, load in running.items()}
