"""Warehouse models on invented seed rows (S11): staging, fact, dimensions, star join."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tillroll.operators import marts as M
from tillroll.schema import LANDING_SCHEMA

LOADED = datetime(2026, 1, 1)


def seed(code, desc, qty, when, price, customer, country, invoice):
    return (invoice, code, desc, qty, when, Decimal(price), customer, country, LOADED)


@pytest.fixture
def landing(spark):
    rows = [
        seed("Q1", "RED MUG", 6, datetime(2013, 5, 6, 8, 0), "2.1000", "501", "Ireland", "800001"),
        seed("Q2", "BLUE MUG", 6, datetime(2013, 5, 6, 8, 0), "2.4000", "501", "Ireland", "800001"),
        seed("Q1", "RED MUG", 12, datetime(2013, 5, 11, 9, 0), "2.1000", "501", "Ireland", "800002"),
        # same code, different name: the more frequent name wins
        seed("Q1", "CRIMSON MUG", 2, datetime(2013, 5, 12, 10, 0), "2.1000", "502", "Ireland", "800003"),
        # guest
        seed("Q3", "TEA TOWEL", 8, datetime(2013, 5, 13, 11, 0), "1.9000", None, "Spain", "800004"),
        # noise dropped by staging: zero price, zero quantity, ledger and cancellation rows
        seed("Q4", "LAMP", 1, datetime(2013, 5, 13, 11, 30), "0.0000", "502", "Ireland", "800005"),
        seed("Q4", "LAMP", 0, datetime(2013, 5, 13, 11, 35), "12.0000", "502", "Ireland", "800006"),
        seed("ADJ", "Ledger", 1, datetime(2013, 5, 13, 12, 0), "500.0000", None, "Ireland", "A800007"),
        # a big spender
        seed("Q4", "LAMP", 40, datetime(2013, 6, 20, 14, 0), "12.0000", "503", "Spain", "800008"),
        # calendar gap, then a wide price spread on one product
        seed("Q5", "VASE", 10, datetime(2013, 8, 1, 16, 0), "1.5000", "504", "France", "800009"),
        seed("Q5", "VASE", 5, datetime(2013, 8, 2, 9, 0), "9.9000", "504", "France", "800010"),
    ]
    return spark.createDataFrame(rows, LANDING_SCHEMA)


@pytest.fixture
def stg(landing):
    return M.stg_transactions(landing)


def test_staging_filters_noise_only(stg):
    invoices = sorted(r["invoice_no"] for r in stg.collect())
    assert "A800007" not in invoices and "800005" not in invoices and "800006" not in invoices
    assert len(invoices) == 8
    guest = stg.filter(F.col("invoice_no") == "800004").first()
    assert guest["customer_key"] == "UNKNOWN" and guest["line_revenue"] == Decimal("15.2000")


def test_fact_key_unique_and_stable(stg):
    a = M.fct_sales(stg)
    assert a.select("sales_key").distinct().count() == a.count()
    b = M.fct_sales(stg)
    assert sorted(r[0] for r in a.select("sales_key").collect()) == sorted(r[0] for r in b.select("sales_key").collect())


def test_surrogate_key_null_sentinel(spark):
    from tillroll.functions import surrogate_key

    df = spark.createDataFrame([("a", None, "b"), ("a", "b", None)], "x string, y string, z string")
    keys = [r[0] for r in df.select(surrogate_key("x", "y", "z")).collect()]
    assert keys[0] != keys[1]


def test_dim_product(stg):
    prod = {r["product_key"]: r for r in M.dim_product(stg).collect()}
    assert prod["Q1"]["product_description"] == "RED MUG"
    assert prod["Q5"]["has_volatile_pricing"] is True and prod["Q1"]["has_volatile_pricing"] is False
    # (10*1.50 + 5*9.90) / 15 = 4.30
    assert prod["Q5"]["avg_selling_price"] == Decimal("4.3000")


def test_dim_date_spine_has_no_gaps(stg):
    d = M.dim_date(stg).orderBy("date_key").collect()
    assert d[0]["date_key"] == date(2013, 5, 6) and d[-1]["date_key"] == date(2013, 8, 2)
    assert len(d) == (date(2013, 8, 2) - date(2013, 5, 6)).days + 1
    first = d[0]
    assert (first["day_of_week"], first["day_name"], first["is_weekend"]) == (1, "Monday", False)
    assert (first["year_month"], first["month_name"], first["calendar_quarter"]) == ("2013-05", "May", 2)
    assert first["month_end_date"] == date(2013, 5, 31) and first["week_start_date"] == date(2013, 5, 6)
    sunday = [r for r in d if r["date_key"] == date(2013, 5, 12)][0]
    assert sunday["day_of_week"] == 7 and sunday["is_weekend"] is True


def test_dim_customer(stg):
    cust = {r["customer_key"]: r for r in M.dim_customer(stg).collect()}
    assert cust["UNKNOWN"]["rfm_segment"] == "Unattributed"
    assert cust["501"]["primary_country"] == "Ireland"
    assert cust["504"]["recency_days"] == 0
    assert set(r["rfm_segment"] for r in cust.values()) <= set(
        ["Champion", "Loyal", "Recent", "At Risk", "Churned", "Regular", "Unattributed"]
    )


def test_star_join_of_large_dimensions_is_the_same(stg, monkeypatch):
    tables = M.fct_sales(stg), M.dim_date(stg), M.dim_customer(stg), M.dim_product(stg)
    small = sorted(map(str, M.star_join_revenue(*tables).collect()))
    monkeypatch.setattr(M, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(M, "HOT_PARTS", 2)
    large = M.star_join_revenue(*tables)
    assert "_salt" in large._jdf.queryExecution().analyzed().toString()
    assert sorted(map(str, large.collect())) == small


def test_star_join_totals_reconcile(stg):
    star = M.star_join_revenue(M.fct_sales(stg), M.dim_date(stg), M.dim_customer(stg), M.dim_product(stg))
    assert star.agg(F.sum("revenue")).first()[0] == stg.agg(F.sum("line_revenue")).first()[0]


def test_model_tests_pass_and_fail(spark, landing, stg):
    from tillroll.operators.model_tests import MODEL_TESTS, run_model_tests

    models = {
        "landing": landing,
        "fct_sales": M.fct_sales(stg),
        "dim_customer": M.dim_customer(stg),
        "dim_product": M.dim_product(stg),
        "dim_date": M.dim_date(stg),
    }
    res = run_model_tests(models)
    assert res.count() == len(MODEL_TESTS) == 36
    assert res.filter(~F.col("passed")).count() == 0
    # a fact row pointing at a missing date and duplicated keys must fail
    bad_fct = models["fct_sales"].union(models["fct_sales"].limit(1).withColumn("date_key", F.lit(date(1999, 1, 1))))
    res2 = {r["test_name"]: r for r in run_model_tests({**models, "fct_sales": bad_fct}).collect()}
    assert res2["unique__fct_sales__sales_key"]["failures"] == 2
    assert res2["relationships__fct_sales__date_key"]["failures"] == 1


def test_source_freshness(landing):
    from tillroll.operators.model_tests import source_freshness

    assert source_freshness(landing, datetime(2026, 1, 1, 6)).first()["status"] == "pass"
    assert source_freshness(landing, datetime(2026, 1, 1, 13)).first()["status"] == "warn"
    assert source_freshness(landing, datetime(2026, 1, 3)).first()["status"] == "error"


def test_landing_truncate_or_append(spark, tmp_path):
    from tillroll.operators.clean import clean_data
    from tillroll.operators.star import load_star, load_to_landing
    from tillroll.sources.retail import retail_raw

    clean = clean_data(retail_raw(spark, "/root/testdata/sf0.001"))
    path = str(tmp_path / "landing")
    first = load_to_landing(clean, path, truncate=True)
    again = load_to_landing(clean, path, truncate=False)
    assert again["rows_in_table"] == 2 * first["rows_written"] == 2 * first["rows_in_table"]
    assert load_to_landing(clean, path, truncate=True)["rows_in_table"] == first["rows_written"]
    root = str(tmp_path / "star")
    counts = load_star(clean, root)
    load_star(clean, root, mode="append")
    assert spark.read.parquet(f"{root}/transactions").count() == 2 * counts["transactions"]
