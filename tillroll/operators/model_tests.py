"""Declarative model tests (M1, M3-M8, J9) and source freshness (M2).

Tests are data: ``(model, column, kind, args)``. Per model, every row-level test
(not_null, accepted_range, accepted_values, expression) is a ``count_if`` in **one**
aggregation pass; ``unique`` is an aggregate over the key; ``relationships`` is a left-anti
join. Each test yields its failing-row count; zero means pass.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.operators.layers import RFM_SEGMENTS


@dataclass(frozen=True)
class ModelTest:
    model: str
    column: str | None
    kind: str
    args: tuple = ()

    @property
    def name(self) -> str:
        parts = [self.kind, self.model] + ([self.column] if self.column else [])
        if self.kind == "expression_is_true":
            parts.append(str(self.args[0]))
        return "__".join(parts)


# --- fixed values: the model tests ----------------------------------------------------------
LANDING_NOT_NULL = ["invoice_no", "stock_code", "quantity", "invoice_date", "unit_price", "country", "loaded_at"]
MODEL_TESTS: list[ModelTest] = (
    [ModelTest("landing", c, "not_null") for c in LANDING_NOT_NULL]
    + [
        ModelTest("fct_sales", None, "expression_is_true", ("line_revenue_positive",)),
        ModelTest("fct_sales", None, "expression_is_true", ("revenue_matches_quantity_times_price",)),
        ModelTest("fct_sales", "sales_key", "unique"),
        ModelTest("fct_sales", "sales_key", "not_null"),
        ModelTest("fct_sales", "date_key", "not_null"),
        ModelTest("fct_sales", "date_key", "relationships", ("dim_date", "date_key")),
        ModelTest("fct_sales", "customer_key", "not_null"),
        ModelTest("fct_sales", "customer_key", "relationships", ("dim_customer", "customer_key")),
        ModelTest("fct_sales", "product_key", "not_null"),
        ModelTest("fct_sales", "product_key", "relationships", ("dim_product", "product_key")),
        ModelTest("fct_sales", "quantity", "not_null"),
        ModelTest("fct_sales", "quantity", "accepted_range", (1, None, True)),
        ModelTest("fct_sales", "unit_price", "not_null"),
        ModelTest("fct_sales", "unit_price", "accepted_range", (0, None, False)),
        ModelTest("dim_customer", "customer_key", "unique"),
        ModelTest("dim_customer", "customer_key", "not_null"),
        ModelTest("dim_customer", "rfm_segment", "not_null"),
        ModelTest("dim_customer", "rfm_segment", "accepted_values", tuple(RFM_SEGMENTS)),
        ModelTest("dim_customer", "recency_score", "accepted_range", (1, 5, True)),
        ModelTest("dim_customer", "frequency_score", "accepted_range", (1, 5, True)),
        ModelTest("dim_customer", "monetary_score", "accepted_range", (1, 5, True)),
        ModelTest("dim_customer", "lifetime_revenue", "not_null"),
        ModelTest("dim_product", "product_key", "unique"),
        ModelTest("dim_product", "product_key", "not_null"),
        ModelTest("dim_product", "product_description", "not_null"),
        ModelTest("dim_product", "avg_selling_price", "not_null"),
        ModelTest("dim_date", "date_key", "unique"),
        ModelTest("dim_date", "date_key", "not_null"),
        ModelTest("dim_date", "day_of_week", "accepted_range", (1, 7, True)),
    ]
)

#: fixed expressions of the fact's expression tests
EXPRESSIONS = {
    "line_revenue_positive": lambda: F.col("line_revenue") > 0,
    "revenue_matches_quantity_times_price": lambda: F.abs(
        F.col("line_revenue") - F.col("quantity") * F.col("unit_price")
    )
    < F.lit("0.01").cast("decimal(10,4)"),
}


def _failing(t: ModelTest) -> Column:
    """Row-level failure predicate (null-safe: a null never counts as passing a check that
    requires a value, and range / value tests ignore nulls like their SQL counterparts)."""
    c = F.col(t.column) if t.column else None
    if t.kind == "not_null":
        return c.isNull()
    if t.kind == "accepted_range":
        lo, hi, inclusive = t.args
        ok = F.lit(True)
        if lo is not None:
            ok = ok & ((c >= lo) if inclusive else (c > lo))
        if hi is not None:
            ok = ok & ((c <= hi) if inclusive else (c < hi))
        return c.isNotNull() & ~ok
    if t.kind == "accepted_values":
        return c.isNotNull() & ~c.isin(list(t.args))
    if t.kind == "expression_is_true":
        return ~F.coalesce(EXPRESSIONS[t.args[0]](), F.lit(False))
    raise ValueError(t.kind)


def run_model_tests(models: dict[str, DataFrame], tests: list[ModelTest] | None = None) -> DataFrame:
    """Results frame ``(test_order, test_name, model, column_name, kind, failures, passed)``."""
    tests = tests or MODEL_TESTS
    spark = next(iter(models.values())).sparkSession
    parts: list[DataFrame] = []
    by_model: dict[str, list[tuple[int, ModelTest]]] = {}
    for i, t in enumerate(tests):
        by_model.setdefault(t.model, []).append((i, t))

    def row(i: int, t: ModelTest, failures: Column) -> Column:
        return F.struct(
            F.lit(i).alias("test_order"),
            F.lit(t.name).alias("test_name"),
            F.lit(t.model).alias("model"),
            F.lit(t.column).cast("string").alias("column_name"),
            F.lit(t.kind).alias("kind"),
            failures.cast("long").alias("failures"),
        )

    for model, items in by_model.items():
        df = models[model]
        scans = [(i, t) for i, t in items if t.kind not in ("unique", "relationships")]
        if scans:
            agg = df.agg(*[F.count_if(_failing(t)).alias(f"_f{i}") for i, t in scans])
            parts.append(agg.select(F.explode(F.array(*[row(i, t, F.col(f"_f{i}")) for i, t in scans])).alias("r")).select("r.*"))
        for i, t in items:
            if t.kind == "unique":
                dup = (
                    df.filter(F.col(t.column).isNotNull())
                    .groupBy(t.column)
                    .agg(F.count(F.lit(1)).alias("_c"))
                    .agg(F.coalesce(F.sum(F.when(F.col("_c") > 1, F.col("_c"))), F.lit(0)).alias("_f"))
                )
                parts.append(dup.select(row(i, t, F.col("_f")).alias("r")).select("r.*"))
            elif t.kind == "relationships":
                target, field = t.args
                parent = models[target].select(F.col(field).alias("_k")).distinct()
                # rows per key first (combined map-side): a hot key is one row before the join
                keys = (
                    df.select(F.col(t.column).alias("_k"))
                    .filter(F.col("_k").isNotNull())
                    .groupBy("_k")
                    .agg(F.count(F.lit(1)).alias("_rows"))
                )
                orphans = keys.join(parent, "_k", "left_anti")
                failures = orphans.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("_f"))
                parts.append(failures.select(row(i, t, F.col("_f")).alias("r")).select("r.*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("passed", F.col("failures") == 0)


# --- fixed values: source freshness thresholds ---------------------------------------------
FRESHNESS_WARN_HOURS = 12
FRESHNESS_ERROR_HOURS = 36


def source_freshness(landing: DataFrame, now: dt.datetime, loaded_at: str = "loaded_at") -> DataFrame:
    """M2: age of the newest landed row against a passed-in ``now``: pass / warn / error."""
    now_lit = F.lit(now.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")
    newest = landing.agg(F.max(loaded_at).alias("max_loaded_at"))
    age = (F.unix_micros(now_lit) - F.unix_micros(F.col("max_loaded_at"))) / F.lit(3_600_000_000)
    return newest.select(
        "max_loaded_at",
        now_lit.alias("checked_at"),
        F.round(age, 6).alias("age_hours"),
        F.when(F.col("max_loaded_at").isNull(), F.lit("error"))
        .when(age > FRESHNESS_ERROR_HOURS, F.lit("error"))
        .when(age > FRESHNESS_WARN_HOURS, F.lit("warn"))
        .otherwise(F.lit("pass"))
        .alias("status"),
    )
