"""Declared schemas and the coarse type families used by schema contracts."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: raw invoice-line layout (must equal the source's column names) ---------
RAW_COLUMNS = [
    "InvoiceNo",
    "StockCode",
    "Description",
    "Quantity",
    "InvoiceDate",
    "UnitPrice",
    "CustomerID",
    "Country",
]

#: Money is exact: decimal(12,4) per unit, decimal(14,4) per line.
PRICE_TYPE = T.DecimalType(12, 4)
REVENUE_TYPE = T.DecimalType(14, 4)
TOTAL_PRICE_TYPE = T.DecimalType(14, 2)

RAW_SCHEMA = T.StructType(
    [
        T.StructField("InvoiceNo", T.StringType(), nullable=False),
        T.StructField("StockCode", T.StringType(), nullable=False),
        T.StructField("Description", T.StringType(), nullable=True),
        T.StructField("Quantity", T.IntegerType(), nullable=False),
        T.StructField("InvoiceDate", T.TimestampType(), nullable=False),
        T.StructField("UnitPrice", PRICE_TYPE, nullable=False),
        T.StructField("CustomerID", T.StringType(), nullable=True),
        T.StructField("Country", T.StringType(), nullable=False),
    ]
)

#: Landing-zone layout (warehouse vocabulary), in declared order.
LANDING_COLUMNS = [
    "invoice_no",
    "stock_code",
    "description",
    "quantity",
    "invoice_date",
    "unit_price",
    "customer_id",
    "country",
]

LANDING_SCHEMA = T.StructType(
    [
        T.StructField("invoice_no", T.StringType(), False),
        T.StructField("stock_code", T.StringType(), False),
        T.StructField("description", T.StringType(), True),
        T.StructField("quantity", T.IntegerType(), False),
        T.StructField("invoice_date", T.TimestampType(), False),
        T.StructField("unit_price", PRICE_TYPE, False),
        T.StructField("customer_id", T.StringType(), True),
        T.StructField("country", T.StringType(), False),
        T.StructField("loaded_at", T.TimestampType(), False),
    ]
)


# --- run-event record: nested structs with a strict field list ----------------------------
def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields.items()])


EVENT_SCHEMA = T.StructType(
    [
        T.StructField("@timestamp", T.StringType(), True),
        T.StructField("event", _struct(dataset=T.StringType(), module=T.StringType(), kind=T.StringType())),
        T.StructField("service", _struct(name=T.StringType(), environment=T.StringType())),
        T.StructField("host", _struct(name=T.StringType())),
        T.StructField("run", _struct(id=T.StringType())),
        T.StructField("stage", T.StringType()),
        T.StructField("outcome", T.StringType()),
        T.StructField("duration_ms", T.DoubleType()),
        T.StructField(
            "metrics",
            _struct(
                rows=T.LongType(),
                rows_in=T.LongType(),
                rows_out=T.LongType(),
                rows_dropped=T.LongType(),
                pct_dropped=T.DoubleType(),
                rows_written=T.LongType(),
                breaking_drift=T.LongType(),
                additive_drift=T.LongType(),
                expectations_run=T.LongType(),
                expectations_failed=T.LongType(),
            ),
        ),
        T.StructField(
            "finding",
            _struct(
                category=T.StringType(),
                kind=T.StringType(),
                severity=T.StringType(),
                column=T.StringType(),
                detail=T.StringType(),
            ),
        ),
        T.StructField("error", _struct(type=T.StringType(), message=T.StringType())),
        T.StructField(
            "log",
            _struct(level=T.StringType(), logger=T.StringType(), message=T.StringType(), source=T.StringType()),
        ),
        T.StructField(
            "database", _struct(duration_ms=T.DoubleType(), statement=T.StringType(), pid=T.LongType())
        ),
        T.StructField("pipeline", _struct(ingested_at=T.StringType(), source=T.StringType())),
        T.StructField("tags", T.ArrayType(T.StringType())),
    ]
)


def allowed_keys(schema: T.StructType) -> dict[str, list[str]]:
    """Allowed JSON keys per object path ('' = top level) for strict-mapping checks."""
    out: dict[str, list[str]] = {"": [f.name for f in schema.fields]}
    for field in schema.fields:
        if isinstance(field.dataType, T.StructType):
            out[field.name] = [f.name for f in field.dataType.fields]
    return out


# --- type families ------------------------------------------------------------------------
INTEGER = "integer"
FLOAT = "float"
STRING = "string"
DATETIME = "datetime"
BOOLEAN = "boolean"
UNKNOWN = "unknown"

TYPE_FAMILIES = (INTEGER, FLOAT, STRING, DATETIME, BOOLEAN, UNKNOWN)


def type_family(dtype: T.DataType) -> str:
    """Coarse family of a Spark type: width changes are not drift, family changes are.

    Decimals count as float (money arriving as decimal is the same family as a float price);
    intervals count as datetime.
    """
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return INTEGER
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return FLOAT
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return STRING
    if isinstance(
        dtype,
        (T.TimestampType, T.TimestampNTZType, T.DateType, T.DayTimeIntervalType, T.YearMonthIntervalType),
    ):
        return DATETIME
    if isinstance(dtype, T.BooleanType):
        return BOOLEAN
    return UNKNOWN


def is_benign_widening(expected: str, observed: str) -> bool:
    """An integer where a float is expected loses nothing; the reverse is breaking."""
    return expected == FLOAT and observed == INTEGER
