"""Post-load data-quality checks Q1-Q9 over the operational star.

Every check is a row ``(check_order, name, passed, actual, expected, detail)``. Q1-Q3 and Q6-Q8
are made of aggregates over the transactions alone: a check names the columns it needs, its
aggregates and how they become a row, and all checks asked for share one pass. The two
foreign-key checks aggregate the fact keys once and join them to the dimension's. A check whose
columns the table lacks is a failed row, so a report always lists every check.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: check names, required columns, tolerance, expected dates ----------------
CHECK_NAMES = [
    "row_count_in_range",
    "no_nulls_in_required_columns",
    "no_non_positive_quantity_or_price",
    "fk_transactions_customer_id",
    "fk_transactions_stock_code",
    "revenue_finite_and_positive",
    "total_price_matches_quantity_times_price",
    "invoice_date_within_expected_window",
]
NON_NULL_COLUMNS = ["invoice_no", "stock_code", "quantity", "unit_price", "total_price"]
TOTAL_PRICE_TOLERANCE = "0.01"
EXPECTED_MIN_DATE = dt.datetime(2010, 12, 1)
EXPECTED_MAX_DATE = dt.datetime(2011, 12, 31)
ORPHAN_SAMPLE = 5
TS_FORMAT = "yyyy-MM-dd HH:mm:ss"

SCANNED = tuple(CHECK_NAMES[i] for i in (0, 1, 2, 5, 6, 7))


class DataQualityError(AssertionError):
    """A quality report with failures was to be raised."""


@dataclass
class ScanCheck:
    """A check on aggregates over the transactions."""

    name: str
    needs: list[str]
    aggregates: dict[str, Column]
    passed: Column
    actual: Column
    expected: str
    detail: Column | None = None


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _row(name: str, passed: Column, actual: Column, expected: str, detail: Column | None = None) -> Column:
    return F.struct(
        F.lit(CHECK_NAMES.index(name) + 1).alias("check_order"),
        F.lit(name).alias("name"),
        F.coalesce(passed, F.lit(False)).alias("passed"),
        actual.alias("actual"),
        F.lit(expected).alias("expected"),
        (F.lit("") if detail is None else detail).alias("detail"),
    )


def _lacking(name: str, columns: list[str], expected: str) -> Column:
    return _row(name, F.lit(False), F.lit("not checked"), expected, F.lit("the table lacks " + ", ".join(columns)))


def _at(value: dt.datetime) -> Column:
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")


def _row_count(tx: DataFrame, o: dict) -> ScanCheck:
    n, low, high = F.col("n_rows"), o["min_rows"], o["max_rows"]
    return ScanCheck(
        CHECK_NAMES[0],
        [],
        {"n_rows": F.count(F.lit(1))},
        (n >= low) & (F.lit(True) if high is None else n <= high),
        _text(n),
        f"{low} rows or more" if high is None else f"{low} to {high} rows",
    )


def _required(tx: DataFrame, o: dict) -> ScanCheck:
    wanted = o["columns"]
    have = [c for c in wanted if c in tx.columns]
    lacking = [c for c in wanted if c not in have]
    nulls = {c: F.col(f"null_{c}") for c in have}
    total = sum(nulls.values(), F.lit(0))
    named = F.concat_ws(", ", *[F.when(n > 0, _text(f"{c}=", n)) for c, n in nulls.items()])
    return ScanCheck(
        CHECK_NAMES[1],
        [],
        {f"null_{c}": F.count_if(F.col(c).isNull()) for c in have},
        (total == 0) & F.lit(not lacking),
        _text(total, f" nulls in {len(have)} columns"),
        "no nulls in " + ", ".join(wanted),
        F.lit("the table lacks " + ", ".join(lacking)) if lacking else F.when(total > 0, named).otherwise(F.lit("")),
    )


def _positive(tx: DataFrame, o: dict) -> ScanCheck:
    quantity, price = F.col("bad_quantity"), F.col("bad_price")
    return ScanCheck(
        CHECK_NAMES[2],
        ["quantity", "unit_price"],
        {"bad_quantity": F.count_if(F.col("quantity") <= 0), "bad_price": F.count_if(F.col("unit_price") <= 0)},
        (quantity == 0) & (price == 0),
        _text("quantity: ", quantity, ", unit_price: ", price),
        "no row with quantity or unit_price at or under 0",
    )


def _is_float(tx: DataFrame, column: str) -> bool:
    return column in tx.columns and isinstance(tx.schema[column].dataType, (T.FloatType, T.DoubleType))


def _revenue(tx: DataFrame, o: dict) -> ScanCheck:
    price = F.col("total_price")
    bad = price.isNull()
    if _is_float(tx, "total_price"):
        bad = bad | F.isnan(price) | (F.abs(price) == F.lit(float("inf")))
    bad_rows, total = F.col("bad_revenue_rows"), F.col("revenue")
    return ScanCheck(
        CHECK_NAMES[5],
        ["total_price"],
        {"bad_revenue_rows": F.count_if(bad), "revenue": F.sum(price)},
        (bad_rows == 0) & (F.coalesce(total, F.lit(0)) > 0),
        F.when(bad_rows > 0, _text(bad_rows, " rows without a finite total_price")).otherwise(
            F.coalesce(total.cast("string"), F.lit("no rows"))
        ),
        "a total above 0, of finite lines",
    )


def _total_price(tx: DataFrame, o: dict) -> ScanCheck:
    off = F.abs(F.col("total_price") - F.col("quantity") * F.col("unit_price"))
    exact = not _is_float(tx, "total_price")
    limit = F.lit(o["tolerance"]).cast("decimal(10,4)") if exact else F.lit(float(o["tolerance"]))
    count, most = F.col("mismatches"), F.col("max_off")
    return ScanCheck(
        CHECK_NAMES[6],
        ["total_price", "quantity", "unit_price"],
        {"mismatches": F.count_if(off > limit), "max_off": F.coalesce(F.max(off), F.lit(0)).cast("decimal(20,4)")},
        count == 0,
        _text(count, " rows off, the worst by ", most),
        f"total_price within {o['tolerance']} of quantity * unit_price",
    )


def _dates(tx: DataFrame, o: dict) -> ScanCheck:
    d = F.col("invoice_date")
    counts = {
        "too_early": F.count_if(d < _at(o["min_date"])),
        "too_late": F.count_if(d > _at(o["max_date"])),
        "in_future": F.count_if(d > _at(o["now"])),
        "without_date": F.count_if(d.isNull()),
    }
    shown = lambda c: F.coalesce(F.date_format(c, TS_FORMAT), F.lit("none"))
    listed = [part for name in counts for part in (f", {name.replace('_', ' ')}: ", F.col(name))]
    return ScanCheck(
        CHECK_NAMES[7],
        ["invoice_date"],
        {**counts, "first_date": F.min(d), "last_date": F.max(d)},
        sum((F.col(c) for c in counts), F.lit(0)) == 0,
        _text(shown("first_date"), " to ", shown("last_date"), *listed),
        f"dates from {o['min_date'].date()} to {o['max_date'].date()}, none later than now",
    )


SCAN_CHECKS = dict(zip(SCANNED, (_row_count, _required, _positive, _revenue, _total_price, _dates)))


def scan_checks(
    transactions: DataFrame,
    *,
    only: Iterable[str] = SCANNED,
    columns: Iterable[str] = tuple(NON_NULL_COLUMNS),
    min_rows: int = 1,
    max_rows: int | None = None,
    min_date: dt.datetime = EXPECTED_MIN_DATE,
    max_date: dt.datetime = EXPECTED_MAX_DATE,
    now: dt.datetime | None = None,
    tolerance: str = TOTAL_PRICE_TOLERANCE,
) -> DataFrame:
    """The scanned checks asked for (Q1, Q2, Q3, Q6, Q7, Q8), in one aggregation pass.

    ``columns`` are those that may have no nulls (Q2), ``tolerance`` is that of Q7. The row
    window has no upper end unless one is given."""
    options = {
        "columns": list(columns),
        "min_rows": min_rows,
        "max_rows": max_rows,
        "min_date": min_date,
        "max_date": max_date,
        "now": now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None),
        "tolerance": tolerance,
    }
    aggregates: dict[str, Column] = {"n_rows": F.count(F.lit(1))}
    rows = []
    for name in only:
        check = SCAN_CHECKS[name](transactions, options)
        lacking = [c for c in check.needs if c not in transactions.columns]
        if lacking:
            rows.append(_lacking(name, lacking, check.expected))
        else:
            aggregates |= check.aggregates
            rows.append(_row(name, check.passed, check.actual, check.expected, check.detail))
    one = transactions.agg(*[a.alias(n) for n, a in aggregates.items()])
    return one.select(F.inline(F.array(*rows)))


def check_row_count(transactions: DataFrame, min_rows: int = 1, max_rows: int | None = None) -> DataFrame:
    """Q1 alone."""
    return scan_checks(transactions, only=SCANNED[:1], min_rows=min_rows, max_rows=max_rows)


def check_required(transactions: DataFrame, columns: Iterable[str] = tuple(NON_NULL_COLUMNS)) -> DataFrame:
    """Q2 alone, for any columns."""
    return scan_checks(transactions, only=SCANNED[1:2], columns=columns)


def check_positive(transactions: DataFrame) -> DataFrame:
    """Q3 alone."""
    return scan_checks(transactions, only=SCANNED[2:3])


def check_revenue(transactions: DataFrame) -> DataFrame:
    """Q6 alone."""
    return scan_checks(transactions, only=SCANNED[3:4])


def check_total_price(transactions: DataFrame, tolerance: str = TOTAL_PRICE_TOLERANCE) -> DataFrame:
    """Q7 alone."""
    return scan_checks(transactions, only=SCANNED[4:5], tolerance=tolerance)


def check_dates(transactions: DataFrame, min_date: dt.datetime, max_date: dt.datetime, now: dt.datetime | None = None) -> DataFrame:
    """Q8 alone."""
    return scan_checks(transactions, only=SCANNED[5:], min_date=min_date, max_date=max_date, now=now)


#: Whole-number keys go as bitmaps if there are many, and if they fill one place in so many between
#: the least and the greatest; few keys are exchanged as they are.
MANY_KEYS = 100_000
SPARSEST = 64


def _orphans_by_key(facts: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts (one row) and the orphans (k, rows), by a row per key."""
    per_key = facts.groupBy("k").agg(F.count(F.lit(1)).alias("rows"))
    matched = per_key.join(known.distinct().withColumn("hit", F.lit(True)), "k", "full_outer")
    # the count is part of the condition, so that both branches keep the same aggregate
    orphan = (F.col("rows") > 0) & F.col("hit").isNull()
    counts = matched.agg(
        F.count("rows").alias("checked"),
        F.count("hit").alias("known"),
        F.count_if(orphan).alias("orphans"),
        F.coalesce(F.sum(F.when(orphan, F.col("rows"))), F.lit(0)).alias("orphan_rows"),
    )
    return counts, matched.filter(orphan)


def _dense_bounds(known: DataFrame) -> tuple[int, int] | None:
    """Least and greatest key of a dimension with many whole-number keys that lie densely, else None."""
    if not isinstance(known.schema["k"].dataType, T.IntegralType):
        return None
    low, high, n = known.agg(F.min("k"), F.max("k"), F.count("k")).first()
    return (low, high) if n >= max(1, MANY_KEYS) and high - low < SPARSEST * n else None


def _orphans_by_bitmap(facts: DataFrame, known: DataFrame, low: int, high: int) -> tuple[DataFrame, DataFrame]:
    """The same with the key sets as bitmaps, 32,768 keys in 4 KB, which is all that is exchanged for
    keys within the dimension's bounds.

    The dimension's bits taken from the union's leave the orphans. Only fact rows in parts of the
    range that have any are read by key, and those outside of the bounds, which all are orphans."""
    inside = F.col("k").between(low, high)

    def bits(keys: DataFrame, side: str) -> DataFrame:
        part = F.bitmap_bucket_number("k").alias("part")
        return keys.groupBy(part).agg(F.bitmap_construct_agg(F.bitmap_bit_position("k")).alias("bits")).withColumn("side", F.lit(side))

    count = F.bitmap_count("bits")
    parts = (
        bits(facts.filter(inside), "facts")
        .unionByName(bits(known, "known"))
        .groupBy("part")
        .agg(
            F.sum(F.when(F.col("side") == "facts", count).otherwise(0)).alias("checked"),
            F.sum(F.when(F.col("side") == "known", count).otherwise(0)).alias("known"),
            F.bitmap_count(F.bitmap_or_agg("bits")).alias("either"),
        )
    )
    lacking = parts.filter(F.col("either") > F.col("known")).select(F.col("part").alias("lacking_part"))
    suspects = facts.filter(inside).join(lacking, F.bitmap_bucket_number("k") == F.col("lacking_part"), "left_semi")
    orphans = suspects.join(known, "k", "left_anti").unionByName(facts.filter(~inside)).groupBy("k").agg(F.count(F.lit(1)).alias("rows"))
    outside = facts.filter(~inside).agg(F.countDistinct("k").alias("outside"))
    whole = parts.agg(
        F.coalesce(F.sum("checked"), F.lit(0)).alias("checked"),
        F.coalesce(F.sum("known"), F.lit(0)).alias("known"),
        F.coalesce(F.sum(F.col("either") - F.col("known")), F.lit(0)).alias("orphans"),
    )
    carried = orphans.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("orphan_rows"))
    counts = whole.crossJoin(outside).crossJoin(carried).select(  # one-row frames
        (F.col("checked") + F.col("outside")).alias("checked"),
        "known",
        (F.col("orphans") + F.col("outside")).alias("orphans"),
        "orphan_rows",
    )
    return counts, orphans


def fk_check(transactions: DataFrame, dimension: DataFrame, *, name: str, key: str, as_text: bool = False) -> DataFrame:
    """Q4/Q5: fact keys that the dimension lacks, the rows that carry them, the first few.

    Rows are counted per fact key (combined map-side) and joined to the dimension's distinct
    keys. The counting and the listing branch read the same aggregate, whose exchange Spark
    computes once. Whole-number keys that lie densely go as bitmaps (``_orphans_by_bitmap``). Null
    keys are allowed."""
    expected = f"every {key} of the facts in the dimension"
    lacking = [where for where, df in (("the facts", transactions), ("the dimension", dimension)) if key not in df.columns]
    if lacking:
        spark = transactions.sparkSession
        return spark.range(1).select(F.inline(F.array(_lacking(name, [f"{key} in {w}" for w in lacking], expected))))
    as_key = (lambda df: F.col(key).cast("string")) if as_text else (lambda df: F.col(key))
    fact_keys = transactions.select(as_key(transactions).alias("k")).filter("k is not null")
    known = dimension.select(as_key(dimension).alias("k")).filter("k is not null")
    bounds = None if as_text else _dense_bounds(known)
    counts, orphans = _orphans_by_bitmap(fact_keys, known, *bounds) if bounds else _orphans_by_key(fact_keys, known)
    first = (
        orphans.select("k")
        .orderBy("k")
        .limit(ORPHAN_SAMPLE)
        .agg(F.array_join(F.array_sort(F.collect_list("k")).cast("array<string>"), ", ").alias("first"))
    )
    found = F.col("orphans") > 0
    row = _row(
        name,
        ~found,
        _text(F.col("orphans"), " unknown of ", F.col("checked"), " keys, on ", F.col("orphan_rows"), " rows; the dimension has ", F.col("known")),
        expected,
        F.when(found, _text("unknown: ", F.col("first"))).otherwise(F.lit("")),
    )
    return counts.crossJoin(first).select(F.inline(F.array(row)))  # one-row frames


def check_customers(transactions: DataFrame, customers: DataFrame) -> DataFrame:
    """Q4 alone."""
    return fk_check(transactions, customers, name=CHECK_NAMES[3], key="customer_id")


def check_products(transactions: DataFrame, products: DataFrame) -> DataFrame:
    """Q5 alone."""
    return fk_check(transactions, products, name=CHECK_NAMES[4], key="stock_code", as_text=True)


def run_all_checks(transactions: DataFrame, customers: DataFrame, products: DataFrame, **options) -> DataFrame:
    """Q9: every check as one frame; options are those of ``scan_checks``."""
    return (
        scan_checks(transactions, **options)
        .unionByName(check_customers(transactions, customers))
        .unionByName(check_products(transactions, products))
    )


@dataclass
class QualityReport:
    """The eight rows of a report on the driver."""

    rows: list[dict] = field(default_factory=list)

    @classmethod
    def from_frame(cls, checks: DataFrame) -> "QualityReport":
        return cls([r.asDict() for r in checks.orderBy("check_order").collect()])

    @property
    def failures(self) -> list[dict]:
        return [r for r in self.rows if not r["passed"]]

    @property
    def ok(self) -> bool:
        return not self.failures

    def render(self) -> str:
        lines = [
            " | ".join(filter(None, ("ok  " if r["passed"] else "FAIL", r["name"], f"{r['actual']} (expected: {r['expected']})", r["detail"])))
            for r in self.rows
        ]
        return "\n".join([*lines, f"{len(self.failures)} of {len(self.rows)} checks failed"])

    def to_dict(self) -> dict:
        return {"ok": self.ok, "checks": self.rows}

    def raise_if_failed(self) -> None:
        if self.failures:
            raise DataQualityError("; ".join(f"{r['name']}: {r['actual']}" for r in self.failures))


def validate_tables(
    transactions: DataFrame, customers: DataFrame, products: DataFrame, *, raise_on_failure: bool = True, **options
) -> QualityReport:
    """Run the suite and collect its eight rows; a failure raises unless told not to."""
    report = QualityReport.from_frame(run_all_checks(transactions, customers, products, **options))
    if raise_on_failure:
        report.raise_if_failed()
    return report
