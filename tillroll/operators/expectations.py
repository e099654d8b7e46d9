"""Ingestion expectation suite E1-E14, evaluated in one aggregation pass.

Each expectation becomes one outcome row ``(expectation_order, expectation, column, success,
observed)``. A missing column makes its expectations fail instead of crashing the run. Null
handling (our definition): range expectations ignore nulls and an empty set passes them;
``mostly`` is a fraction of non-null values (of all rows for not-null expectations).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.schema import RAW_COLUMNS

# --- fixed values: the raw-batch suite ---------------------------------------------------
SUITE_NAME = "retail_raw"
NOT_NULL_COLUMNS = ["InvoiceNo", "StockCode", "Quantity", "InvoiceDate", "UnitPrice", "Country"]
CUSTOMER_ID_MIN_COMPLETENESS = 0.60
QUANTITY_RANGE = (-100_000, 100_000)
PRICE_RANGE = (-20_000, 50_000)
NON_NEGATIVE_PRICE_MOSTLY = 0.99
COUNTRY_CARDINALITY = (1, 80)


@dataclass(frozen=True)
class Expectation:
    kind: str
    column: str | None = None
    min_value: float | None = None
    max_value: float | None = None
    mostly: float | None = None
    column_set: tuple[str, ...] = ()
    approx: bool = False  # distinct counts: HyperLogLog++ instead of an exact count


def build_suite(*, approx_distinct: bool = False) -> list[Expectation]:
    """E1-E13. ``approx_distinct`` evaluates the cardinality bound with HyperLogLog++ (a fixed
    few-KB sketch per partition) instead of an exact distinct count."""
    suite = [
        Expectation("expect_table_columns_to_match_set", column_set=tuple(RAW_COLUMNS)),
        Expectation("expect_table_row_count_to_be_between", min_value=1),
    ]
    suite += [Expectation("expect_column_values_to_not_be_null", c) for c in NOT_NULL_COLUMNS]
    suite += [
        Expectation("expect_column_values_to_not_be_null", "CustomerID", mostly=CUSTOMER_ID_MIN_COMPLETENESS),
        Expectation("expect_column_values_to_be_between", "Quantity", *QUANTITY_RANGE),
        Expectation("expect_column_values_to_be_between", "UnitPrice", *PRICE_RANGE),
        Expectation("expect_column_values_to_be_between", "UnitPrice", min_value=0, mostly=NON_NEGATIVE_PRICE_MOSTLY),
        Expectation(
            "expect_column_unique_value_count_to_be_between", "Country", *COUNTRY_CARDINALITY, approx=approx_distinct
        ),
    ]
    return suite


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, F.round(num.cast("double") / den.cast("double"), 6))


def _outcome(i: int, e: Expectation, success: Column, observed: Column) -> Column:
    return F.struct(
        F.lit(i).alias("expectation_order"),
        F.lit(e.kind).alias("expectation"),
        F.lit(e.column).cast("string").alias("column"),
        F.coalesce(success, F.lit(False)).alias("success"),
        observed.cast("double").alias("observed"),
    )


def suite_plan(df: DataFrame, suite: list[Expectation] | None = None) -> tuple[list[Column], list[Column]]:
    """The aggregates the suite needs and one outcome struct per expectation computed from
    them, so callers can fuse the suite with other one-pass checks."""
    suite = suite or build_suite()
    cols = set(df.columns)
    aggs: list[Column] = [F.count(F.lit(1)).alias("_rows")]
    plans = []
    for i, e in enumerate(suite):
        if e.column is not None and e.column not in cols:
            plans.append((i, e, None))
            continue
        c = F.col(f"`{e.column}`") if e.column else None
        if e.kind == "expect_column_values_to_not_be_null":
            aggs.append(F.count_if(c.isNotNull()).alias(f"_a{i}"))
        elif e.kind == "expect_column_values_to_be_between":
            cond = F.lit(True)
            if e.min_value is not None:
                cond = cond & (c >= F.lit(e.min_value))
            if e.max_value is not None:
                cond = cond & (c <= F.lit(e.max_value))
            aggs.append(F.count_if(c.isNotNull() & ~cond).alias(f"_a{i}"))
            aggs.append(F.count_if(c.isNotNull()).alias(f"_b{i}"))
        elif e.kind == "expect_column_unique_value_count_to_be_between":
            aggs.append((F.approx_count_distinct(c) if e.approx else F.countDistinct(c)).alias(f"_a{i}"))
        plans.append((i, e, c))

    rows = []
    n = F.col("_rows")
    for i, e, c in plans:
        if c is None and e.column is not None:
            rows.append(_outcome(i, e, F.lit(False), F.lit(None)))
            continue
        if e.kind == "expect_table_columns_to_match_set":
            missing = [x for x in e.column_set if x not in cols]
            rows.append(_outcome(i, e, F.lit(not missing), F.lit(len(missing))))
        elif e.kind == "expect_table_row_count_to_be_between":
            ok = F.lit(True)
            if e.min_value is not None:
                ok = ok & (n >= F.lit(e.min_value))
            if e.max_value is not None:
                ok = ok & (n <= F.lit(e.max_value))
            rows.append(_outcome(i, e, ok, n))
        elif e.kind == "expect_column_values_to_not_be_null":
            present = F.col(f"_a{i}")
            if e.mostly is None:
                rows.append(_outcome(i, e, present == n, n - present))
            else:
                frac = _ratio(present, n)
                rows.append(_outcome(i, e, (n == 0) | (frac >= F.lit(e.mostly)), frac))
        elif e.kind == "expect_column_values_to_be_between":
            bad, nonnull = F.col(f"_a{i}"), F.col(f"_b{i}")
            if e.mostly is None:
                rows.append(_outcome(i, e, bad == 0, bad))
            else:
                frac = _ratio(nonnull - bad, nonnull)
                rows.append(_outcome(i, e, (nonnull == 0) | (frac >= F.lit(e.mostly)), frac))
        elif e.kind == "expect_column_unique_value_count_to_be_between":
            k = F.col(f"_a{i}")
            ok = F.lit(True)
            if e.min_value is not None:
                ok = ok & (k >= F.lit(e.min_value))
            if e.max_value is not None:
                ok = ok & (k <= F.lit(e.max_value))
            rows.append(_outcome(i, e, ok, k))
        else:
            raise ValueError(f"unsupported expectation {e.kind}")
    return aggs, rows


def evaluate_suite(df: DataFrame, suite: list[Expectation] | None = None) -> DataFrame:
    """Outcome rows for every expectation, from one aggregation pass over ``df``."""
    aggs, rows = suite_plan(df, suite)
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("o")).select("o.*")


class DataValidationError(RuntimeError):
    """Expectations failed; ``outcome`` holds all of them."""

    def __init__(self, outcome: "ValidationOutcome", facts: dict | None = None):
        self.outcome = outcome
        self.facts = facts or {}
        failed = [f"{f['expectation']} of {f['column'] or 'the batch'}" for f in outcome.failures]
        super().__init__("the batch fails " + ", ".join(failed))


@dataclass
class ValidationOutcome:
    results: list[dict] = field(default_factory=list)

    @property
    def success(self) -> bool:
        return all(r["success"] for r in self.results)

    @property
    def failures(self) -> list[dict]:
        return [r for r in self.results if not r["success"]]

    def to_dict(self) -> dict:
        return {"success": self.success, "checks_run": len(self.results), "failures": self.failures}

    def summary(self) -> str:
        return f"{len(self.results) - len(self.failures)}/{len(self.results)} expectations passed"


def validate_batch(df: DataFrame, *, enforce: bool = True, suite: list[Expectation] | None = None) -> ValidationOutcome:
    """Run the suite (one pass), collect its handful of outcome rows, raise when enforcing."""
    rows = evaluate_suite(df, suite).orderBy("expectation_order").collect()
    outcome = ValidationOutcome([r.asDict() for r in rows])
    if enforce and not outcome.success:
        raise DataValidationError(outcome)
    return outcome
