"""Cleaning flow P1-P8: raw invoice lines -> analysis-ready lines.

Each rule is a ``DataFrame -> DataFrame`` function; ``clean_data`` composes them in a fixed
order with ``DataFrame.transform``. This flow keeps ``A`` (ledger adjustment) invoices and
drops rows with no description; the silver and staging flows do the opposite (see README).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.functions import min_by_order, strip
from tillroll.schema import PRICE_TYPE, RAW_COLUMNS, TOTAL_PRICE_TYPE
from tillroll.sources.raw import parse_mixed_timestamp

# --- fixed values: cleaning rules -----------------------------------------------------------
CANCELLED_PREFIX = "C"
DEDUPE_KEY = ["InvoiceNo", "StockCode", "Quantity", "InvoiceDate", "UnitPrice", "CustomerID"]


class MissingColumnsError(ValueError):
    """The input lacks columns the flow needs; the message names them."""


def require_columns(df: DataFrame, expected: list[str]) -> None:
    missing = [c for c in expected if c not in df.columns]
    if missing:
        raise MissingColumnsError(f"the batch lacks {', '.join(sorted(missing))}")


def _coerce(df: DataFrame, name: str, target: str) -> F.Column:
    """Numeric coercion: text that is no number becomes null instead of failing (ANSI). Whole
    numbers may be written with a fraction of zeros (``6.0``); another fraction is cut off."""
    c = F.col(f"`{name}`")
    if not isinstance(df.schema[name].dataType, T.StringType):
        return c.cast(target)
    number = F.trim(c).try_cast("decimal(38,10)")
    return number.try_cast(target)


def _moment(df: DataFrame, name: str) -> F.Column:
    """The invoice date: text in any known layout; text in none fails the job, as a date that
    cannot be read means a broken extract."""
    c = F.col(f"`{name}`")
    if not isinstance(df.schema[name].dataType, T.StringType):
        return c.cast("timestamp")
    parsed = parse_mixed_timestamp(F.trim(c))
    unreadable = F.concat(F.lit("unreadable invoice date: "), c)
    return F.when(c.isNotNull() & parsed.isNull(), F.raise_error(unreadable).cast("timestamp")).otherwise(parsed)


def standardize_columns(df: DataFrame) -> DataFrame:
    """Presence check, then consistent types and stripped text.

    Ids and text are stripped of surrounding whitespace (nulls stay null); the date is parsed
    (an unparseable date fails the job, as a bad date here means a broken extract); quantity
    and price are coerced (unparseable -> null); the customer id becomes a nullable bigint.
    Extra columns pass through unchanged.
    """
    require_columns(df, RAW_COLUMNS)
    if isinstance(df.schema["CustomerID"].dataType, T.StringType):
        customer = F.expr("try_cast(try_cast(trim(CustomerID) as double) as bigint)")
    else:
        customer = F.col("CustomerID").cast("bigint")
    replacements = {
        "InvoiceNo": strip(F.col("InvoiceNo").cast("string")),
        "StockCode": strip(F.col("StockCode").cast("string")),
        "Description": strip(F.col("Description").cast("string")),
        "Country": strip(F.col("Country").cast("string")),
        "InvoiceDate": _moment(df, "InvoiceDate"),
        "Quantity": _coerce(df, "Quantity", "int"),
        "UnitPrice": _coerce(df, "UnitPrice", "decimal(12,4)").cast(PRICE_TYPE),
        "CustomerID": customer,
    }
    return df.withColumns(replacements)


def drop_missing_description(df: DataFrame) -> DataFrame:
    """Drop null or empty descriptions (expects stripped text)."""
    return df.filter(F.col("Description").isNotNull() & (F.length("Description") > 0))


def remove_cancelled_orders(df: DataFrame) -> DataFrame:
    """Drop cancellations, marked by a leading ``C`` on the invoice number."""
    return df.filter(~F.coalesce(F.col("InvoiceNo").startswith(CANCELLED_PREFIX), F.lit(False)))


def remove_invalid_quantity_price(df: DataFrame) -> DataFrame:
    """Keep lines with quantity > 0 and price > 0 (null fails both)."""
    return df.filter((F.col("Quantity") > 0) & (F.col("UnitPrice") > 0))


def flag_guest_customers(df: DataFrame) -> DataFrame:
    """P5: ``is_guest`` marks lines without a customer; they are kept."""
    return df.withColumn("is_guest", F.col("CustomerID").isNull())


def deduplicate_rows(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """One row per key (only key columns present are used).

    The survivor is the first row in the order of the remaining columns, so the result is the
    same on every run. Implemented as an aggregate rather than a window. Rows meet by the key's
    first column, the invoice (by the whole key where that is null), so an invoice's lines stay
    side by side: shuffles compress them well, one sort serves the aggregate, and later sums per
    order find them together. Null keys group together.
    """
    key = [c for c in (subset or DEDUPE_KEY) if c in df.columns]
    rest = [c for c in df.columns if c not in key]
    if not rest:
        return df.dropDuplicates(key)
    at = F.when(F.col(key[0]).isNotNull(), F.xxhash64(key[0])).otherwise(F.xxhash64(*key))
    gathered = df.withColumn("_at", at).repartition("_at")
    picked = gathered.groupBy("_at", *key).agg(min_by_order(*[(c, F.col(c)) for c in rest]).alias("_keep"))
    return picked.select(*[F.col(c) if c in key else F.col(f"_keep.{c}").alias(c) for c in df.columns])


def add_total_price(df: DataFrame) -> DataFrame:
    """``TotalPrice = round(Quantity * UnitPrice, 2)``, exact decimal, half-up."""
    return df.withColumn(
        "TotalPrice", F.round(F.col("Quantity") * F.col("UnitPrice"), 2).cast(TOTAL_PRICE_TYPE)
    )


def clean_data(raw: DataFrame) -> DataFrame:
    """The cleaning rules in their fixed order."""
    return (
        raw.transform(standardize_columns)
        .transform(drop_missing_description)
        .transform(remove_cancelled_orders)
        .transform(remove_invalid_quantity_price)
        .transform(flag_guest_customers)
        .transform(deduplicate_rows)
        .transform(add_total_price)
    )
