"""Silver and daily gold kept up batch by batch.

A batch changes the days that its sales lie on and no others: the natural key of a sale holds its
time, so a duplicate lies on the same day, and a day's figures come from that day's sales. Silver
and gold lie in a folder per period (a day, or a month where days are small), and a batch reads
and rewrites the folders of its periods only, whatever the age of the lake. A survivor among
duplicates is a minimum over them, hence merging into what was deduplicated before equals one
deduplication of all rows; a batch that is applied again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.operators.layers import SILVER_KEY, conformed_sales, dated, deduplicated_sales, gold_daily_sales, to_bronze
from tillroll.session import store
from tillroll.sources.tables import folders

SILVER, GOLD = "silver_sales", "gold_daily_sales"
#: A period's folder, by its length.
PERIODS = {"day": "yyyy-MM-dd", "month": "yyyy-MM"}
_SALE = [*SILVER_KEY, "product_description", "customer_key", "country"]


def stored_periods(spark: SparkSession, table: str) -> list[str]:
    """The periods that a table has folders for, rising."""
    return [n.removeprefix("period=") for n in folders(spark, table) if n.startswith("period=")]


def read_periods(spark: SparkSession, table: str, periods: list[str]) -> DataFrame:
    """Some periods of a table: their folders are read, others not even listed."""
    return spark.read.parquet(*[f"{table}/period={p}" for p in periods])


def _replace(rows: DataFrame, table: str) -> None:
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("period").parquet(table)


def apply_batch(raw: DataFrame, root: str, *, length: str = "day") -> list[str]:
    """Merge a raw batch into the silver and gold tables under ``root``; returns the periods rewritten.

    The batch's sales are stored once; one shuffle gathers them and the sales of their periods by
    period, merges them and leaves them as silver's new folders, from which gold follows. Folders
    are replaced when the whole write has ended, so it may read what it replaces. The periods of a
    batch are bounded by the calendar. Silver is written before gold: a run that dies between them
    is made good by applying the batch again. All batches of a lake have one ``length``."""
    spark = raw.sparkSession
    silver, gold = f"{root}/{SILVER}", f"{root}/{GOLD}"
    fresh = store(conformed_sales(to_bronze(raw)), "batch-silver")
    period = F.date_format(F.to_date("invoiced_at"), PERIODS[length])
    found = fresh.groupBy(period.alias("period")).agg(F.count(F.lit(1)).alias("rows")).collect()
    periods = sorted(r["period"] for r in found)
    if not periods:
        return []
    known = set(stored_periods(spark, silver))
    before = [p for p in periods if p in known]
    sales, rows = fresh.select(*_SALE), sum(r["rows"] for r in found)
    if before:
        there = read_periods(spark, silver, before).select(*_SALE)
        sales, rows = sales.unionByName(there), rows + there.count()
    _replace(dated(deduplicated_sales(sales, {"period": period}, rows)), silver)
    days = gold_daily_sales(read_periods(spark, silver, periods))
    _replace(days.withColumn("period", F.date_format("date_key", PERIODS[length])).hint("rebalance", "period"), gold)
    return periods


def read_gold(spark: SparkSession, root: str, periods: list[str] | None = None) -> DataFrame:
    """The daily gold of some periods (all: None)."""
    gold = f"{root}/{GOLD}"
    return read_periods(spark, gold, stored_periods(spark, gold) if periods is None else periods)
