"""Cleaning flow P1-P8: one class per rule plus the composed flow."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tillroll.operators import clean as C


def _strs(spark, rows, cols="InvoiceNo string, StockCode string, Description string, Quantity string, "
          "InvoiceDate string, UnitPrice string, CustomerID string, Country string"):
    return spark.createDataFrame(rows, cols)


class TestStandardize:
    def test_missing_column_is_named(self, spark, batch):
        with pytest.raises(C.MissingColumnsError, match="Country"):
            C.standardize_columns(batch.drop("Country"))

    def test_strips_text_and_keeps_nulls(self, spark):
        df = _strs(spark, [(" 1 ", " A1\t", "  MUG \n", "2", "2012-01-01 10:00:00", "1.5", "17.0", " Peru "),
                           ("2", "B2", None, "1", "2012-01-01 10:00:00", "2", None, "Peru")])
        out = {r["InvoiceNo"]: r for r in C.standardize_columns(df).collect()}
        assert out["1"]["Description"] == "MUG" and out["1"]["StockCode"] == "A1" and out["1"]["Country"] == "Peru"
        assert out["2"]["Description"] is None

    def test_coerces_bad_numbers_to_null(self, spark):
        df = _strs(spark, [("1", "A", "X", "abc", "2012-01-01 10:00:00", "n/a", "17850.0", "Peru")])
        r = C.standardize_columns(df).first()
        assert r["Quantity"] is None and r["UnitPrice"] is None
        assert r["CustomerID"] == 17850

    def test_types(self, spark, batch):
        s = dict(C.standardize_columns(batch).dtypes)
        assert s["Quantity"] == "int" and s["UnitPrice"] == "decimal(12,4)" and s["CustomerID"] == "bigint"
        assert s["InvoiceDate"] == "timestamp"


class TestRules:
    def test_drop_missing_description(self, spark):
        df = _strs(spark, [("1", "A", None, "1", "2012-01-01", "1", None, "P"), ("2", "A", "   ", "1", "2012-01-01", "1", None, "P"),
                           ("3", "A", "OK", "1", "2012-01-01", "1", None, "P")])
        out = C.drop_missing_description(C.standardize_columns(df))
        assert [r["InvoiceNo"] for r in out.collect()] == ["3"]

    def test_remove_cancelled(self, spark, batch):
        out = C.remove_cancelled_orders(C.standardize_columns(batch))
        assert not [r for r in out.collect() if r["InvoiceNo"].startswith("C")]
        assert out.count() == batch.count() - 1

    def test_remove_invalid_quantity_price(self, spark, batch):
        out = C.remove_invalid_quantity_price(C.standardize_columns(batch))
        assert all(r["Quantity"] > 0 and r["UnitPrice"] > 0 for r in out.collect())
        assert {"700005", "700006", "C700003"}.isdisjoint({r["InvoiceNo"] for r in out.collect()})

    def test_flag_guest_keeps_rows(self, spark, batch):
        out = C.flag_guest_customers(C.standardize_columns(batch))
        assert out.count() == batch.count()
        assert out.filter("is_guest").count() == 2

    def test_dedupe_keeps_one_deterministic_row(self, spark):
        rows = [("9", "Z", "B NAME", "1", "2012-01-01", "1", "5", "P"), ("9", "Z", "A NAME", "1", "2012-01-01", "1", "5", "P"),
                ("9", "Z", "C NAME", "1", "2012-01-01", "1", "6", "P")]
        out = C.deduplicate_rows(C.standardize_columns(_strs(spark, rows))).orderBy("CustomerID").collect()
        assert [(r["CustomerID"], r["Description"]) for r in out] == [(5, "A NAME"), (6, "C NAME")]

    def test_dedupe_groups_null_customers(self, spark):
        rows = [("9", "Z", "X", "1", "2012-01-01", "1", None, "P"), ("9", "Z", "X", "1", "2012-01-01", "1", None, "P")]
        assert C.deduplicate_rows(C.standardize_columns(_strs(spark, rows))).count() == 1

    def test_total_price_half_up(self, spark):
        df = spark.createDataFrame([(3, Decimal("0.0050"))], "Quantity int, UnitPrice decimal(12,4)")
        r = C.add_total_price(df).first()
        assert r["TotalPrice"] == Decimal("0.02")  # 0.015 rounds half up


class TestCleanData:
    def test_integration(self, spark, batch):
        out = C.clean_data(batch)
        got = sorted((r["InvoiceNo"], r["StockCode"]) for r in out.collect())
        # kept: two lines of 700001 (deduplicated), the guest line, and the ledger line (this flow keeps A)
        assert got == [("700001", "K100"), ("700001", "K200"), ("700002", "K300"), ("A700004", "ADJ")]
        assert out.filter("is_guest").count() == 2
        kite = out.filter(F.col("StockCode") == "K100").first()
        assert kite["Description"] == "PAPER KITE" and kite["TotalPrice"] == Decimal("12.80")

    def test_observed_counts_of_transform_stage(self, spark, batch, tmp_path):
        from tillroll.streaming.events import clean_into

        s = clean_into(batch, str(tmp_path / "interim"))
        assert (s["rows_in"], s["rows_out"], s["rows_dropped"]) == (8, 4, 4)
        assert s["pct_dropped"] == 50.0
        assert spark.read.parquet(s["path"]).count() == 4

    def test_missing_interim_is_an_error(self, spark, tmp_path):
        from pyspark.errors import AnalysisException

        with pytest.raises(AnalysisException):
            spark.read.parquet(str(tmp_path / "nope")).count()


def test_declared_csv_read_fails_fast(spark, tmp_path):
    from tillroll.sources.raw import declared_read

    p = tmp_path / "raw.csv"
    p.write_text(
        "InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country\n"
        "1,A,X,notanumber,2012-01-01 10:00:00,1.0,5,P\n"
    )
    with pytest.raises(Exception):
        declared_read(spark, str(p), "csv").collect()


def test_align_raw_types(spark):
    from tillroll.sources.raw import align_raw_types

    df = spark.createDataFrame(
        [("1", "A", "X", 2, datetime(2012, 1, 1), 1.23456, 17850.0, "P"), ("2", "B", None, 1, datetime(2012, 1, 1), 2.0, None, "P")],
        "InvoiceNo string, StockCode string, Description string, Quantity long, InvoiceDate timestamp, "
        "UnitPrice double, CustomerID double, Country string",
    )
    out = {r["InvoiceNo"]: r for r in align_raw_types(df).collect()}
    assert out["1"]["CustomerID"] == "17850" and out["2"]["CustomerID"] is None
    assert out["1"]["UnitPrice"] == Decimal("1.2346")


def test_a_csv_header_in_another_order_is_refused(spark, tmp_path):
    from tillroll.sources.raw import declared_read

    p = tmp_path / "raw.csv"
    names = "StockCode,InvoiceNo,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country"
    p.write_text(f"{names}\nK1,700001,KITE,1,2012-03-05 09:15:00,1.5,40001,Norway\n")
    with pytest.raises(Exception, match="header"):
        declared_read(spark, str(p), "csv").collect()


def test_a_parquet_file_without_declared_columns_is_refused(spark, batch, tmp_path):
    from tillroll.sources.raw import DeclaredSchemaError, declared_read

    batch.drop("Country", "UnitPrice").write.parquet(str(tmp_path / "raw"))
    with pytest.raises(DeclaredSchemaError, match="UnitPrice, Country"):
        declared_read(spark, str(tmp_path / "raw"))


def test_text_dates_and_quantities(spark):
    names = ["InvoiceNo", "StockCode", "Description", "Quantity", "InvoiceDate", "UnitPrice", "CustomerID", "Country"]
    rows = [
        ("1", "A", "x", "6.0", "12/1/2010 8:26", "2.55", "17850.0", "UK"),
        ("2", "A", "x", " 7 ", "2010-12-01 08:26:00", "2.55", None, "UK"),
        ("3", "A", "x", "six", "2010-12-01", "n/a", "none", "UK"),
    ]
    out = C.standardize_columns(spark.createDataFrame(rows, names)).orderBy("InvoiceNo").collect()
    assert [r["Quantity"] for r in out] == [6, 7, None]
    assert [r["InvoiceDate"] for r in out] == [datetime(2010, 12, 1, 8, 26), datetime(2010, 12, 1, 8, 26), datetime(2010, 12, 1)]
    assert [r["CustomerID"] for r in out] == [17850, None, None] and out[2]["UnitPrice"] is None
    bad = spark.createDataFrame([("1", "A", "x", "1", "soon", "1", None, "UK")], ", ".join(f"{n} string" for n in names))
    with pytest.raises(Exception, match="unreadable invoice date: soon"):
        C.standardize_columns(bad).collect()


def test_every_file_of_a_folder_is_checked(spark, tmp_path):
    from tillroll.sources.raw import DeclaredSchemaError, declared_read, file_columns
    from tillroll.sources.retail import retail_raw

    path = str(tmp_path / "raw")
    batch = retail_raw(spark, "/root/testdata/sf0.001")
    batch.coalesce(2).write.parquet(path)
    n = declared_read(spark, path).count()
    assert n == batch.count()
    # one more file, without a column: which footer Spark would take is left to chance
    batch.limit(10).drop("Country").coalesce(1).write.mode("append").parquet(path)
    with pytest.raises(DeclaredSchemaError, match=r"part-\S+ lacks Country$"):
        declared_read(spark, path)
    assert declared_read(spark, path, check_files=False).count() == n + 10
    told = file_columns(spark, path)
    assert told.filter("column = 'Country'").count() == told.filter("column = 'Quantity' AND type = 'int'").count() - 1
    # columns that folders name are there
    by = str(tmp_path / "by")
    batch.write.partitionBy("Country").parquet(by)
    assert declared_read(spark, by).select("Country").distinct().count() == 25


def test_a_time_format_is_tried_only_where_it_can_fit(spark):
    from tillroll.sources.raw import MIXED_TIMESTAMP_FORMATS, parse_mixed_timestamp

    texts = [
        "2012-03-05 09:15:00.123456", "2012-03-05 09:15:00.5", "2012-03-05 09:15:00", "2012-03-05T09:15:00", "2012-03-05t09:15:00",
        "2012-03-05 09:15", "2012-03-05", "3/5/2012 9:15:01", "3/5/2012 9:15", "3/5/2012", "25/12/2012 9:15", "+12012-03-05", "3/5/+12012",
        "-2012-03-05", "3/5/-2012 9:15", "2012-13-05", "3/5/2012 9:15:61", "5.3.2012", "2012-03-05  09:15", "x", "", None,
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    ladder = F.coalesce(*[F.try_to_timestamp("t", F.lit(fmt)) for fmt in MIXED_TIMESTAMP_FORMATS])
    both = df.select("t", ladder.cast("string").alias("all"), parse_mixed_timestamp(F.col("t")).cast("string").alias("some"))
    rows = both.collect()
    assert [r["some"] for r in rows] == [r["all"] for r in rows] and sum(r["some"] is not None for r in rows) >= 13
    # a text that no format's marks fit is not handed to any
    plan = both._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("CASE WHEN translate(") == len(MIXED_TIMESTAMP_FORMATS)


def test_lines_of_an_invoice_are_deduplicated_side_by_side(spark):
    rows = [(str(i // 4) if i % 9 else None, f"p{i % 7}", f"d{i % 2}", 1, "3/5/2012 9:15", "1.0", "5", "X") for i in range(600)]
    names = "InvoiceNo string, StockCode string, Description string, Quantity int, InvoiceDate string, UnitPrice string, CustomerID string, Country string"
    lines = C.standardize_columns(spark.createDataFrame(rows, names))
    out = C.deduplicate_rows(lines)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(_at" in plan
    keys = {r[:2] for r in rows}
    assert out.columns == lines.columns and out.count() == len(keys)
    # an invoice lies in one task, lines without one are spread
    placed = out.withColumn("task", F.spark_partition_id()).groupBy("InvoiceNo").agg(F.countDistinct("task").alias("n"))
    assert placed.filter("InvoiceNo is not null").agg(F.max("n")).first()[0] == 1

