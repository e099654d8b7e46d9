"""The retail-shaped raw batch, derived from the test tables by Spark.

The test tables have no nulls, cancellations or duplicates, so the invoice-line batch is
derived with fixed rules that plant each case the operators must handle: cancellations,
ledger adjustments, guests, blank and conflicting descriptions, zero quantities and prices,
and exact re-delivered duplicates.

Join order is chosen for scale: ``orders`` is enriched with customer and nation first (an
orders-sized shuffle; ``nation`` has 25 rows at every scale, so broadcasting it is bounded),
then joined to ``lineitem``, which has its parts by then, once with a sort-merge join. ``customer`` and ``part`` are left to
the planner (broadcast only when their measured size is under the threshold). Duplicates are produced with an ``explode`` in the
same pass instead of a second scan + union.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.schema import PRICE_TYPE
from tillroll.sources.raw import read_table

# --- fixed values: derivation rules of the retail batch -----------------------------------
CANCEL_ORDER_MOD = 10          # with l_returnflag = 'R' -> 'C' invoice
CANCEL_RETURN_FLAG = "R"
ADJUST_ORDER_MOD = 101         # -> 'A' invoice
NULL_DESC_PART_MOD = 97
BLANK_DESC_PART_MOD = 89
BLANK_DESC = "   "
UPPER_DESC_LINE = 7
ZERO_QTY_ORDER_MOD = 53
ZERO_PRICE_ORDER_MOD = 59
GUEST_CUST_MOD = 4
DUPLICATE_ORDER_MOD = 50
MINUTES_PER_DAY = 1440


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = read_table(
        spark,
        sf_dir,
        "lineitem",
        ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag"],
    )
    orders = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate"])
    customer = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey"])
    nation = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name"])
    part = read_table(spark, sf_dir, "part", ["p_partkey", "p_name"])

    orders_enriched = (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .join(F.broadcast(nation), customer.c_nationkey == nation.n_nationkey)
        .select("o_orderkey", "o_custkey", "o_orderdate", "n_name")
    )
    # fact-to-fact join: always a shuffle (sort-merge) join on the order key. A file-size
    # estimate can make a compressed lineitem look small enough to broadcast, which would
    # build the fact table into one hash relation and run the rest of the plan in as many
    # tasks as the scan has splits.
    # Parts come first, so that an order's lines lie side by side afterwards, as an extract of
    # invoices has them.
    described = lineitem.join(part, lineitem.l_partkey == part.p_partkey)
    return described.join(orders_enriched.hint("merge"), lineitem.l_orderkey == orders_enriched.o_orderkey)


def retail_raw(spark: SparkSession, sf_dir: str, *, time_of_day: bool = False) -> DataFrame:
    """Raw invoice lines (``RAW_SCHEMA`` columns) over the whole test tables.

    ``time_of_day=True`` adds ``o_orderkey % 1440`` minutes to the invoice date, for operators
    whose semantics depend on times within a day (tie-breaks, elapsed-day recency).
    """
    b = _base(spark, sf_dir)
    okey = F.col("o_orderkey")
    pkey = F.col("l_partkey")
    okey_txt = okey.cast("string")
    cancelled = ((okey % CANCEL_ORDER_MOD) == 0) & (F.col("l_returnflag") == CANCEL_RETURN_FLAG)
    qty = F.col("l_quantity").cast("int")

    invoice_date = F.col("o_orderdate").cast("timestamp")
    if time_of_day:
        invoice_date = invoice_date + F.make_interval(
            F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(0), (okey % MINUTES_PER_DAY).cast("int"), F.lit(0)
        )

    copies = F.when((F.col("l_orderkey") % DUPLICATE_ORDER_MOD) == 0, F.array(F.lit(1), F.lit(2))).otherwise(
        F.array(F.lit(1))
    )
    return b.select(
        F.when(cancelled, F.concat(F.lit("C"), okey_txt))
        .when((okey % ADJUST_ORDER_MOD) == 0, F.concat(F.lit("A"), okey_txt))
        .otherwise(okey_txt)
        .alias("InvoiceNo"),
        pkey.cast("string").alias("StockCode"),
        F.when((pkey % NULL_DESC_PART_MOD) == 0, F.lit(None).cast("string"))
        .when((pkey % BLANK_DESC_PART_MOD) == 0, F.lit(BLANK_DESC))
        .when(F.col("l_linenumber") == UPPER_DESC_LINE, F.concat(F.lit(" "), F.upper("p_name"), F.lit(" ")))
        .otherwise(F.concat(F.lit("  "), F.col("p_name"), F.lit(" ")))
        .alias("Description"),
        F.when(cancelled, -qty).when((okey % ZERO_QTY_ORDER_MOD) == 0, F.lit(0)).otherwise(qty).alias("Quantity"),
        invoice_date.alias("InvoiceDate"),
        F.when((okey % ZERO_PRICE_ORDER_MOD) == 0, F.lit(0).cast(PRICE_TYPE))
        .otherwise(F.col("l_extendedprice").cast("decimal(12,2)") * F.lit(0.01).cast("decimal(2,2)"))
        .cast(PRICE_TYPE)
        .alias("UnitPrice"),
        F.when((F.col("o_custkey") % GUEST_CUST_MOD) == 0, F.lit(None).cast("string"))
        .otherwise(F.col("o_custkey").cast("string"))
        .alias("CustomerID"),
        F.col("n_name").alias("Country"),
        F.explode(copies).alias("_copy"),
    ).drop("_copy")
