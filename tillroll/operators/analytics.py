"""Business analysis over the operational star.

Calendar resamples are zero-filled against a generated spine (bounded by the calendar span,
not the data); top-k uses ``orderBy().limit(k)`` (a distributed take-ordered: each task keeps
k rows); quantiles are exact, from global positions (``operators.rank``), so no group is ever
collected into one task.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions import elapsed_days
from tillroll.operators.rank import METRIC, Wanted, exact_quantiles, metric_quantiles, rank_bounds, tile_by_bounds
from tillroll.session import store

# --- fixed values: notebook RFM segments and thresholds -----------------------------------
RFM_SEGMENT_ORDER = ["Champions", "Loyal Customers", "Potential Loyalists", "At Risk", "Lost"]
SEGMENT_THRESHOLDS = [(10, "Champions"), (8, "Loyal Customers"), (6, "Potential Loyalists"), (4, "At Risk")]
QUARTILES = [Fraction(1, 4), Fraction(1, 2), Fraction(3, 4)]
TOP_K = 10
DESCRIBE_COLUMNS = ["Recency", "Frequency", "Monetary", "R", "F", "M", "RFM_Score"]


def _revenue_by(tx: DataFrame, label: Column, name: str) -> DataFrame:
    return tx.groupBy(label.alias(name)).agg(F.sum("total_price").alias("revenue"))


def _resample(tx: DataFrame, label: Column, name: str, step: str) -> DataFrame:
    """Revenue per calendar step, empty steps as 0, from one aggregate over ``tx``.

    The sums are one per step, so the calendar bounds them; they are gathered into one map from
    which the spine between their first and last step takes its values."""
    sums = _revenue_by(tx.filter(F.col("invoice_date").isNotNull()), label, name)
    one = sums.agg(
        F.map_from_entries(F.collect_list(F.struct(name, "revenue"))).alias("by"), F.min(name).alias("lo"), F.max(name).alias("hi")
    )
    spine = one.filter("lo is not null").select("by", F.explode(F.sequence("lo", "hi", F.expr(f"interval {step}"))).alias(name))
    revenue = F.coalesce(F.try_element_at("by", F.col(name)), F.lit(0).cast("decimal(24,2)"))
    return spine.select(name, revenue.cast("decimal(24,2)").alias("revenue"))


def monthly_revenue(tx: DataFrame) -> DataFrame:
    """Revenue per calendar month (month start), empty months as 0."""
    return _resample(tx, F.trunc(F.to_date("invoice_date"), "month"), "month_start", "1 month")


def weekly_revenue(tx: DataFrame) -> DataFrame:
    """Revenue per week ending Sunday (label = the Sunday), empty weeks as 0."""
    return _resample(tx, F.date_add(F.trunc(F.to_date("invoice_date"), "week"), 6), "week_end", "7 days")


def best_worst_month(monthly: DataFrame) -> DataFrame:
    """Best and worst month (ties -> earliest) and their ratio; one row."""
    best = F.min(F.struct((-F.col("revenue")).alias("r"), F.col("month_start").alias("m")))
    worst = F.min(F.struct(F.col("revenue").alias("r"), F.col("month_start").alias("m")))
    one = monthly.agg(best.alias("b"), worst.alias("w"))
    return one.select(
        F.col("b.m").alias("best_month"),
        (-F.col("b.r")).cast("decimal(24,2)").alias("best_revenue"),
        F.col("w.m").alias("worst_month"),
        F.col("w.r").cast("decimal(24,2)").alias("worst_revenue"),
        F.when(F.col("w.r") != 0, F.round((-F.col("b.r")).cast("double") / F.col("w.r").cast("double"), 6)).alias(
            "best_to_worst_ratio"
        ),
    )


def _top(sums: DataFrame, key: str, k: int) -> DataFrame:
    top = sums.orderBy(F.col("revenue").desc(), F.col(key).asc()).limit(k)
    # at most k rows reach this window
    rank = Window.orderBy(F.col("revenue").desc(), F.col(key).asc())
    return top.withColumn("rank", F.row_number().over(rank))


def top_products(tx: DataFrame, products: DataFrame, k: int = TOP_K) -> DataFrame:
    """T1 + J10: top products by revenue, grouped by *description* (codes sharing a name
    merge; lines whose product has no name are left out). Lines are summed per code before the
    join, so a hot code is one row there."""
    per_code = tx.groupBy("stock_code").agg(F.sum("total_price").alias("revenue"))
    named = per_code.join(products.filter(F.col("description").isNotNull()), "stock_code")
    sums = named.groupBy("description").agg(F.sum("revenue").cast("decimal(24,2)").alias("revenue"))
    return _top(sums, "description", k)


def top_countries(tx: DataFrame, k: int = TOP_K) -> DataFrame:
    """Top countries by revenue."""
    return _top(tx.groupBy("country").agg(F.sum("total_price").alias("revenue")), "country", k)


def country_share(tx: DataFrame) -> DataFrame:
    """Every country's revenue and share of the total (all countries, not only a top
    list). The total is a one-row aggregate joined back as a broadcast."""
    sums = tx.groupBy("country").agg(F.sum("total_price").alias("revenue"))
    total = sums.agg(F.sum("revenue").alias("_total"))
    return sums.crossJoin(F.broadcast(total)).select(
        "country",
        "revenue",
        F.round(F.lit(100.0) * F.col("revenue").cast("double") / F.col("_total").cast("double"), 6).alias("share_pct"),
    )


def _bin(x: Column, edges: list[Column]) -> Column:
    """qcut bin (1-based) for right-closed bins; equal edges merge (first matching bin)."""
    out = F.lit(len(edges) + 1)
    for i in reversed(range(len(edges))):
        out = F.when(x <= edges[i], F.lit(i + 1)).otherwise(out)
    return out.cast("int")


class DuplicateBinEdgesError(ValueError):
    """Raised in strict mode when quartile edges coincide (pandas ``qcut`` raises too)."""


def _check_unique_edges(per: DataFrame, metrics: list[str]) -> None:
    """Strict ``qcut``: min, quartiles and max of each metric must be strictly increasing.
    Collects one row per metric (bounded)."""
    full = metric_quantiles(per, [(m, F.col(m)) for m in metrics], [Fraction(0), *QUARTILES, Fraction(1)], "e")
    for row in full.collect():
        edges = [row[f"e{i}"] for i in range(5)]
        if any(a >= b for a, b in zip(edges, edges[1:])):
            raise DuplicateBinEdgesError(f"{row[METRIC]} has equal bin edges: {edges}")


#: Last first-occurrence rank within each quartile: rank <= 1 + (n - 1) * i / 4.
QUARTILE_RANKS = [Wanted(f"t{i}", f"({i} * (n - 1)) div 4 + 1", i / 4) for i in (1, 2, 3)]


def rfm_quartiles(tx: DataFrame, num_partitions: int | None = None, *, strict_edges: bool = False) -> DataFrame:
    """D4 + W4 + W5 + F6: notebook RFM on identified customers.

    Recency = whole days from (last invoice overall + 1 day) to the customer's last invoice
    (floor of the exact difference); Frequency = distinct invoices; Monetary = revenue.
    R = quartile of Recency with labels reversed; F = quartile of the first-occurrence rank of
    Frequency (ties by customer id); M = quartile of Monetary. Quartile edges are exact
    linear-interpolation quantiles. Equal edges merge (first matching bin) unless
    ``strict_edges``, which raises like pandas does.
    """
    known = tx.filter(F.col("customer_id").isNotNull())
    snapshot = known.agg((F.max("invoice_date") + F.expr("interval 1 day")).alias("_snap"))
    per = (
        known.groupBy("customer_id")
        .agg(
            F.max("invoice_date").alias("_last"),
            F.countDistinct("invoice_no").alias("Frequency"),
            F.sum("total_price").alias("Monetary"),
        )
        .crossJoin(F.broadcast(snapshot))
        .select("customer_id", elapsed_days(F.col("_snap"), F.col("_last")).alias("Recency"), "Frequency", "Monetary")
    )
    per = store(per, "rfm-customers")  # a row per customer, read for the edges, the bounds and the scores
    if strict_edges:
        _check_unique_edges(per, ["Recency", "Monetary"])
    edges = metric_quantiles(per, [(m, F.col(m)) for m in ("Recency", "Monetary")], QUARTILES, "e").agg(
        *[F.max(F.when(F.col(METRIC) == m, F.col(f"e{i}"))).alias(f"{p}{i}") for m, p in (("Recency", "r"), ("Monetary", "m")) for i in range(3)]
    )
    bounds = rank_bounds(per, "customer_id", [("Frequency", F.col("Frequency"))], QUARTILE_RANKS, num_partitions)
    f_bounds = [F.col(f"Frequency_{w.name}") for w in QUARTILE_RANKS]
    scored = (
        per.crossJoin(F.broadcast(edges))  # one-row frames
        .crossJoin(F.broadcast(bounds))
        .select(
            "customer_id",
            "Recency",
            "Frequency",
            "Monetary",
            (F.lit(5) - _bin(F.col("Recency"), [F.col("r0"), F.col("r1"), F.col("r2")])).cast("int").alias("R"),
            tile_by_bounds(F.col("Frequency"), "customer_id", f_bounds).alias("F"),
            _bin(F.col("Monetary"), [F.col("m0"), F.col("m1"), F.col("m2")]).alias("M"),
        )
    )
    score = F.col("R") + F.col("F") + F.col("M")
    segment = F.lit("Lost")
    for threshold, label in reversed(SEGMENT_THRESHOLDS):
        segment = F.when(score >= threshold, F.lit(label)).otherwise(segment)
    return scored.withColumn("RFM_Score", score.cast("int")).withColumn("Segment", segment)


def rfm_segment_summary(rfm: DataFrame) -> DataFrame:
    """A16 + A17: customers and revenue per segment in fixed order, with shares; a segment
    nobody falls into reports 0 (not null)."""
    spark = rfm.sparkSession
    order = spark.createDataFrame(list(enumerate(RFM_SEGMENT_ORDER, start=1)), "segment_order int, Segment string")
    sums = rfm.groupBy("Segment").agg(F.count(F.lit(1)).alias("customers"), F.sum("Monetary").alias("revenue"))
    totals = sums.agg(F.sum("customers").alias("_tc"), F.sum("revenue").alias("_tr"))
    joined = F.broadcast(order).join(sums, "Segment", "left").crossJoin(F.broadcast(totals))
    customers = F.coalesce(F.col("customers"), F.lit(0)).cast("long")
    revenue = F.coalesce(F.col("revenue"), F.lit(0)).cast("decimal(24,2)")
    return joined.select(
        "segment_order",
        "Segment",
        customers.alias("customers"),
        F.round(F.lit(100.0) * customers.cast("double") / F.col("_tc").cast("double"), 6).alias("pct_customers"),
        revenue.alias("revenue"),
        F.round(F.lit(100.0) * revenue.cast("double") / F.col("_tr").cast("double"), 6).alias("pct_revenue"),
    )


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, sample std, min, quartiles (linear interpolation), max per column;
    long format, doubles rounded to 4 places. Nulls are left out column by column."""
    df = store(df.select(*columns), "described")  # read for the moments and for the quartiles
    moments = df.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias(METRIC), F.col(c).cast("double").alias("x")) for c in columns]))
    ).groupBy(METRIC).agg(
        F.count("x").alias("count"),
        F.round(F.avg("x"), 4).alias("mean"),
        F.round(F.stddev_samp("x"), 4).alias("std"),
        F.round(F.min("x"), 4).alias("min"),
        F.round(F.max("x"), 4).alias("max"),
    )
    quartiles = metric_quantiles(df, [(c, F.col(c)) for c in columns], QUARTILES, "q", as_double=True)
    # both sides hold one row per described column; a column of nulls alone has no quartiles
    return moments.join(F.broadcast(quartiles), METRIC, "left").select(
        F.col(METRIC).alias("column_name"),
        "count",
        "mean",
        "std",
        "min",
        F.round("q0", 4).alias("q25"),
        F.round("q1", 4).alias("q50"),
        F.round("q2", 4).alias("q75"),
        "max",
    )


def order_value_stats(tx: DataFrame) -> DataFrame:
    """Invoices, total, mean and median invoice value (exact median)."""
    per_invoice = store(tx.groupBy("invoice_no").agg(F.sum("total_price").alias("order_value")), "order-values")
    stats = per_invoice.agg(
        F.count(F.lit(1)).alias("orders"),
        F.sum("order_value").cast("decimal(24,2)").alias("total_revenue"),
        F.round(F.avg(F.col("order_value").cast("double")), 4).alias("mean_order_value"),
    )
    median = exact_quantiles(per_invoice, "order_value", [Fraction(1, 2)], prefix="med", as_double=True)
    return stats.crossJoin(median).select(  # one-row frames
        "orders", "total_revenue", "mean_order_value", F.round("med0", 4).alias("median_order_value")
    )


def top_customers(tx: DataFrame, k: int = TOP_K) -> DataFrame:
    """Top identified customers by revenue with their number of orders."""
    sums = (
        tx.filter(F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(F.sum("total_price").alias("revenue"), F.countDistinct("invoice_no").alias("orders"))
    )
    return _top(sums, "customer_id", k)
