"""Silver and gold by increments: equal to the full build, and only a batch's days are rewritten."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillroll.operators import increments as I
from tillroll.operators import layers as L
from tillroll.sources.retail import retail_raw

SF = "/root/testdata/sf0.001"


def rows(df, columns):
    return sorted(map(str, df.select(*columns).collect()))


def files(root):
    return {str(p): p.stat().st_mtime_ns for p in root.rglob("period=*/*.parquet")}


def test_increments_equal_the_full_build(spark, tmp_path):
    raw = retail_raw(spark, SF)
    root = str(tmp_path / "lake")
    part = F.pmod(F.xxhash64("InvoiceNo", "Quantity"), F.lit(6))
    for lines in (part < 3, part >= 2, part == 5):
        assert I.apply_batch(raw.filter(lines), root, length="month")
    silver = L.to_silver(L.to_bronze(raw))
    full = L.gold_daily_sales(silver)
    assert rows(I.read_gold(spark, root), full.columns) == rows(full, full.columns)
    periods = I.stored_periods(spark, f"{root}/{I.SILVER}")
    assert rows(I.read_periods(spark, f"{root}/{I.SILVER}", periods), silver.columns) == rows(silver, silver.columns)


def test_a_batch_of_one_day_rewrites_that_day_only(spark, tmp_path):
    raw = retail_raw(spark, SF).filter((F.year("InvoiceDate") == 1996) & (F.month("InvoiceDate") == 5)).cache()
    root = tmp_path / "lake"
    I.apply_batch(raw, str(root))
    before = files(root)
    day = raw.filter("Quantity > 0").agg(F.min(F.to_date("InvoiceDate"))).first()[0].isoformat()
    one = raw.filter(F.to_date("InvoiceDate") == F.lit(day).cast("date"))
    more = one.withColumn("InvoiceNo", F.concat(F.lit("9"), "InvoiceNo"))
    assert one.count() > 0 and I.apply_batch(more, str(root)) == [day]
    after = files(root)
    changed = {p for p in before.keys() | after.keys() if before.get(p) != after.get(p)}
    assert changed and all(f"period={day}" in p for p in changed)
    full = L.gold_daily_sales(L.to_silver(L.to_bronze(raw.unionByName(more))))
    assert rows(I.read_gold(spark, str(root)), full.columns) == rows(full, full.columns)
    read = I.read_gold(spark, str(root), [day])
    assert all(f"period={day}" in f for f in read.inputFiles())
    assert rows(read, full.columns) == rows(full.filter(F.col("date_key") == F.lit(day).cast("date")), full.columns)


def test_a_batch_without_sales_changes_nothing(spark, tmp_path):
    raw = retail_raw(spark, SF)
    assert I.apply_batch(raw.filter("Quantity < 0"), str(tmp_path / "lake")) == []
    assert I.stored_periods(spark, str(tmp_path / "lake" / I.GOLD)) == []


def test_a_batch_is_shuffled_once_and_its_days_stay_few_files(spark, tmp_path):
    raw = retail_raw(spark, SF)
    sales = L.conformed_sales(L.to_bronze(raw))
    merged = L.dated(L.deduplicated_sales(sales, {"period": F.date_format("invoiced_at", "yyyy-MM")}, 10**7))
    merged.write.partitionBy("period").parquet(str(tmp_path / "table"))
    plan = merged._jdf.queryExecution().executedPlan().toString()
    whole = sales._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == whole.count("Exchange hashpartitioning") + 1
    shares = -(-(10**7) // (L.SHARE_ROWS * L.FOLDERS))
    assert all(len(list(p.glob("*.parquet"))) <= shares for p in (tmp_path / "table").glob("period=*"))
    silver = L.to_silver(L.to_bronze(raw))
    assert rows(spark.read.parquet(str(tmp_path / "table")), silver.columns) == rows(silver, silver.columns)


def test_daily_sales_count_orders_of_several_or_no_customers(spark):
    lines = [
        ("2012-03-05", "Norway", "1", "a", 2, "1.5000"),
        ("2012-03-05", "Norway", "1", "b", 1, "1.0000"),
        ("2012-03-05", "Norway", "1", None, 1, "0.5000"),
        ("2012-03-05", "Norway", "2", "a", 4, "2.0000"),
        ("2012-03-05", "Norway", None, "c", 8, "4.0000"),
        ("2012-03-05", "Chile", "3", None, 16, "8.0000"),
        ("2012-03-06", "Chile", None, None, 32, "9.0000"),
    ]
    names = "date_key string, country string, invoice_no string, customer_key string, quantity int, line_revenue string"
    sales = spark.createDataFrame(lines, names).withColumn("date_key", F.to_date("date_key"))
    sales = sales.withColumn("line_revenue", F.col("line_revenue").cast("decimal(14,4)"))
    direct = sales.groupBy("date_key", "country").agg(
        F.countDistinct("customer_key").alias("active_customers"),
        F.countDistinct("invoice_no").alias("invoice_count"),
        F.sum("line_revenue").cast("decimal(24,4)").alias("revenue"),
        F.sum("quantity").alias("units_sold"),
    )
    found = L.gold_daily_sales(sales)
    assert rows(found, direct.columns) == rows(direct, direct.columns)
    assert "Expand" not in found._jdf.queryExecution().executedPlan().toString()
