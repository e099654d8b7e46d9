"""Raw and layer reads.

Raw data is read under a declared schema: no inference pass, and a batch whose shape changed
fails visibly (CSV header and records; Parquet columns and types).
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.schema import PRICE_TYPE, RAW_SCHEMA
from tillroll.sources.tables import newest
from tillroll.streaming.tail import ship, storage


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """One test table; naming the columns keeps the Parquet ReadSchema minimal."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


#: Files that a refusal names.
NAMED_FILES = 5


class DeclaredSchemaError(ValueError):
    """A file does not have the columns that were declared for it."""


def file_columns(spark: SparkSession, path: str) -> DataFrame:
    """(file, column, type): what every Parquet file of a folder says of itself in its footer.

    Spark takes one file's footer for all of a folder. Here tasks read each one's (footers only, no
    data); folders named ``column=value`` count as columns of the files in them, of type
    ``folder``. Types are Spark's names."""
    ship()

    def footers(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import from_arrow_type

        def named(kind) -> str:
            try:
                return from_arrow_type(kind).simpleString()
            except Exception:  # noqa: BLE001 - a type Spark has no name for
                return str(kind)

        for batch in batches:
            rows = []
            for file in batch.column(0).to_pylist():
                system, at = storage(file)
                for f in pq.read_schema(at, filesystem=system):
                    rows.append((file, f.name, named(f.type)))
                rows += [(file, part.split("=", 1)[0], "folder") for part in at.split("/")[:-1] if "=" in part]
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["file", "column", "type"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    return files.mapInArrow(footers, "file string, column string, type string")


def lacking_columns(spark: SparkSession, path: str, declared: list[str]) -> DataFrame:
    """(file, lacking): the Parquet files of a folder that lack declared columns, and which."""
    found = file_columns(spark, path).groupBy("file").agg(F.collect_set("column").alias("columns"))
    lacking = F.array_except(F.array(*map(F.lit, declared)), "columns")
    return found.select("file", lacking.alias("lacking")).filter(F.size("lacking") > 0)


def declared_read(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType = RAW_SCHEMA, *, check_files: bool = True
) -> DataFrame:
    """Read raw invoice lines under the declared schema (never inferred).

    A batch of another shape fails visibly: a CSV header must have the declared names in their
    order, and a malformed CSV record aborts the read; a folder with Parquet files that lack
    declared columns is refused, naming files and columns (a read would give nulls for them).
    ``check_files=False`` is for files that the caller has checked or written itself.
    """
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.options(header=True, mode="FAILFAST", enforceSchema=False)
    elif fmt == "parquet" and check_files:
        faults = lacking_columns(spark, path, schema.fieldNames()).orderBy("file").limit(NAMED_FILES + 1).collect()
        if faults:
            told = [f"{f['file'].rsplit('/', 1)[1]} lacks {', '.join(f['lacking'])}" for f in faults[:NAMED_FILES]]
            more = " and others" if len(faults) > NAMED_FILES else ""
            raise DeclaredSchemaError(f"{path} lacks declared columns: {'; '.join(told)}{more}")
    return reader.format(fmt).load(path)


def align_raw_types(df: DataFrame) -> DataFrame:
    """Type alignment at ingest.

    Customer ids that arrived as floats (``17850.0``) become ``'17850'`` with nulls kept; ids
    become text; prices are quantized to 4 places; quantity is a 32-bit int. Values that do not
    parse become null here (``try_cast``) and are then reported by the contract check.
    """
    def as_string_id(c: str) -> F.Column:
        col = F.col(c)
        dtype = df.schema[c].dataType
        if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
            return col.cast("bigint").cast("string")
        if isinstance(dtype, T.StringType):
            # '17850.0' -> '17850'; non-numeric ids (e.g. 'C536379') stay as text
            numeric = F.expr(f"try_cast(`{c}` as double)")
            return F.when(
                numeric.isNotNull() & (numeric == F.floor(numeric)) & F.col(c).contains("."),
                numeric.cast("bigint").cast("string"),
            ).otherwise(F.trim(col))
        return col.cast("string")

    return df.select(
        F.col("InvoiceNo").cast("string").alias("InvoiceNo"),
        F.col("StockCode").cast("string").alias("StockCode"),
        F.col("Description").cast("string").alias("Description"),
        F.expr("try_cast(Quantity as int)").alias("Quantity"),
        F.col("InvoiceDate").cast("timestamp").alias("InvoiceDate"),
        F.round(F.expr("try_cast(UnitPrice as decimal(20,8))"), 4).cast(PRICE_TYPE).alias("UnitPrice"),
        as_string_id("CustomerID").alias("CustomerID"),
        F.col("Country").cast("string").alias("Country"),
    )


def read_layer(spark: SparkSession, path: str) -> DataFrame:
    """Read a layer back; Hive-style partition columns come back as columns.

    A missing path raises ``AnalysisException`` rather than returning an empty frame.
    """
    return spark.read.parquet(path)


def read_layer_between(spark: SparkSession, path: str, date_column: str, first: dt.date, last: dt.date) -> DataFrame:
    """S3: the rows of a layer partitioned by invoice_year and invoice_month whose date lies in
    [first, last]. The range also becomes a predicate on the partition columns, so months outside
    it are never listed or read; the dates of the months at its ends are compared row by row."""
    year, number = F.col("invoice_year"), F.col("invoice_month")
    after = (year > first.year) | ((year == first.year) & (number >= first.month))
    before = (year < last.year) | ((year == last.year) & (number <= last.month))
    day = F.to_date(F.col(date_column))
    return read_layer(spark, path).filter(after & before & day.between(F.lit(first), F.lit(last)))


def read_star_tables(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three operational star tables, of the dimensions the newest finished version.

    ``invoice_date`` may have been stored as text by another writer; mixed formats are parsed
    with a format ladder and anything unparseable becomes null (kept, so the date-window check
    can count it) rather than being dropped.
    """
    transactions = spark.read.parquet(f"{root}/transactions").drop("batch")
    if isinstance(transactions.schema["invoice_date"].dataType, T.StringType):
        transactions = transactions.withColumn("invoice_date", parse_mixed_timestamp(F.col("invoice_date")))
    customers = spark.read.parquet(newest(spark, f"{root}/customers"))
    products = spark.read.parquet(newest(spark, f"{root}/products"))
    return transactions, customers, products


# --- fixed values: accepted text timestamp formats, most specific first -------------------
MIXED_TIMESTAMP_FORMATS = [
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
    "M/d/yyyy H:mm:ss",
    "M/d/yyyy H:mm",
    "M/d/yyyy",
    "d/M/yyyy H:mm",
]


def _marks(fmt: str) -> list[str]:
    """What a text of this format has between its digits, without and with a year's minus sign."""
    bare = fmt.replace("'T'", "\0")
    return [re.sub("[a-zA-Z]", "", f).replace("\0", "T") for f in (bare, bare.replace("yyyy", "-"))]


def parse_mixed_timestamp(col: F.Column) -> F.Column:
    """First format that parses wins, month before day where both could; null when none does.

    A format is tried only on texts that have its marks between their digits, as no others can be
    read by it: a try that fails costs many times one that reads."""
    marks = F.translate(F.upper(col), "0123456789+", "")
    tries = [F.when(marks.isin(_marks(fmt)), F.try_to_timestamp(col, F.lit(fmt))) for fmt in MIXED_TIMESTAMP_FORMATS]
    return F.coalesce(*tries)
