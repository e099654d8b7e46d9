"""Quality checks Q1-Q9: each with a passing and a failing input; the report."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

import pytest

from tillroll.operators import quality as Q

TX_SCHEMA = (
    "invoice_no string, stock_code string, customer_id bigint, quantity int, unit_price decimal(12,4), "
    "total_price decimal(14,2), invoice_date timestamp, country string, is_guest boolean"
)
WIN = dict(min_rows=1, max_rows=100, min_date=datetime(2012, 1, 1), max_date=datetime(2012, 12, 31), now=datetime(2013, 1, 1))


def tx_row(inv="1", code="A", cust=7, q=2, p="1.5000", total="3.00", when=datetime(2012, 5, 1), country="P"):
    return (inv, code, cust, q, Decimal(p), Decimal(total) if total is not None else None, when, country, cust is None)


@pytest.fixture
def good(spark):
    tx = spark.createDataFrame([tx_row(), tx_row(inv="2", code="B", cust=None, q=1, p="2.0000", total="2.00")], TX_SCHEMA)
    cust = spark.createDataFrame([(7, "P")], "customer_id bigint, country string")
    prod = spark.createDataFrame([("A", "X"), ("B", "Y")], "stock_code string, description string")
    return tx, cust, prod


def report(tx, cust, prod, **kw):
    return {r["name"]: r for r in Q.run_all_checks(tx, cust, prod, **{**WIN, **kw}).collect()}


def test_all_pass(good):
    r = report(*good)
    assert len(r) == 8 and all(x["passed"] for x in r.values())


def test_row_count_window(good):
    assert not report(*good, min_rows=5)["row_count_in_range"]["passed"]
    assert not report(*good, max_rows=1)["row_count_in_range"]["passed"]
    r = report(*good, max_rows=None)["row_count_in_range"]
    assert r["passed"] and r["expected"] == "1 rows or more"  # no ceiling unless one is given


def test_nulls_and_absent_column(spark, good):
    tx, cust, prod = good
    bad = tx.union(spark.createDataFrame([tx_row(inv="3", total=None)], TX_SCHEMA))
    r = report(bad, cust, prod)
    assert not r["no_nulls_in_required_columns"]["passed"]
    assert "total_price=1" in r["no_nulls_in_required_columns"]["detail"]
    assert not r["revenue_finite_and_positive"]["passed"]
    r2 = report(tx.drop("invoice_no"), cust, prod)
    assert not r2["no_nulls_in_required_columns"]["passed"] and "lacks invoice_no" in r2["no_nulls_in_required_columns"]["detail"]


def test_checks_of_absent_columns_fail_and_none_is_missing(good):
    tx, cust, prod = good
    r = report(tx.drop("total_price", "quantity", "invoice_date", "stock_code"), cust.drop("customer_id"), prod)
    assert len(r) == 8
    assert [n for n, x in r.items() if x["passed"]] == ["row_count_in_range"]
    assert r["total_price_matches_quantity_times_price"]["detail"] == "the table lacks total_price, quantity"
    assert r["fk_transactions_customer_id"]["detail"] == "the table lacks customer_id in the dimension"


def test_single_checks(spark, good):
    tx, cust, prod = good
    only = lambda df: [(x["name"], x["passed"]) for x in df.collect()]
    assert only(Q.check_row_count(tx, 3)) == [("row_count_in_range", False)]
    assert only(Q.check_required(tx, ["customer_id"])) == [("no_nulls_in_required_columns", False)]
    assert only(Q.check_required(tx)) == [("no_nulls_in_required_columns", True)]
    assert only(Q.check_positive(tx)) == [("no_non_positive_quantity_or_price", True)]
    assert only(Q.check_revenue(tx)) == [("revenue_finite_and_positive", True)]
    off = tx.union(spark.createDataFrame([tx_row(inv="6", q=2, p="1.5000", total="3.05")], TX_SCHEMA))
    assert only(Q.check_total_price(off)) == [("total_price_matches_quantity_times_price", False)]
    assert only(Q.check_total_price(off, tolerance="0.10")) == [("total_price_matches_quantity_times_price", True)]
    assert only(Q.check_dates(tx, WIN["min_date"], WIN["max_date"])) == [("invoice_date_within_expected_window", True)]
    assert only(Q.check_customers(tx, cust)) == [("fk_transactions_customer_id", True)]
    assert only(Q.check_products(tx, prod)) == [("fk_transactions_stock_code", True)]


def test_non_positive(spark, good):
    tx, cust, prod = good
    bad = tx.union(spark.createDataFrame([tx_row(inv="4", q=0, total="0.00"), tx_row(inv="5", p="0.0000", total="0.00")], TX_SCHEMA))
    r = report(bad, cust, prod)
    assert not r["no_non_positive_quantity_or_price"]["passed"]
    assert r["no_non_positive_quantity_or_price"]["actual"] == "quantity: 1, unit_price: 1"


def test_foreign_keys(spark, good):
    tx, cust, prod = good
    bad = tx.union(spark.createDataFrame([tx_row(inv=str(10 + i), code=f"Z{i}", cust=90 + i) for i in range(7)], TX_SCHEMA))
    r = report(bad, cust, prod)
    fk = r["fk_transactions_customer_id"]
    assert not fk["passed"] and fk["actual"] == "7 unknown of 8 keys, on 7 rows; the dimension has 1"
    assert fk["detail"] == "unknown: 90, 91, 92, 93, 94"
    assert not r["fk_transactions_stock_code"]["passed"]


def test_revenue_nan_and_inf_fail(spark):
    schema = TX_SCHEMA.replace("total_price decimal(14,2)", "total_price double")
    tx = spark.createDataFrame(
        [("1", "A", 7, 2, Decimal("1.5000"), 3.0, datetime(2012, 5, 1), "P", False),
         ("2", "A", 7, 2, Decimal("1.5000"), float("nan"), datetime(2012, 5, 1), "P", False)], schema)
    cust = spark.createDataFrame([(7, "P")], "customer_id bigint, country string")
    prod = spark.createDataFrame([("A", "X")], "stock_code string, description string")
    assert not report(tx, cust, prod)["revenue_finite_and_positive"]["passed"]


def test_total_price_tolerance(spark, good):
    tx, cust, prod = good
    bad = tx.union(spark.createDataFrame([tx_row(inv="6", q=2, p="1.5000", total="3.50")], TX_SCHEMA))
    r = report(bad, cust, prod)
    assert not r["total_price_matches_quantity_times_price"]["passed"]
    assert "the worst by 0.5000" in r["total_price_matches_quantity_times_price"]["actual"]


def test_date_window(spark, good):
    tx, cust, prod = good
    rows = [tx_row(inv="7", when=datetime(2011, 6, 1)), tx_row(inv="8", when=datetime(2013, 6, 1)), tx_row(inv="9", when=None)]
    r = report(tx.union(spark.createDataFrame(rows, TX_SCHEMA)), cust, prod)
    a = r["invoice_date_within_expected_window"]
    assert not a["passed"]
    assert "too early: 1, too late: 1, in future: 1, without date: 1" in a["actual"]


def test_report_render_and_raise(good):
    tx, cust, prod = good
    rep = Q.validate_tables(tx, cust, prod, raise_on_failure=False, **{**WIN, "min_rows": 50})
    assert not rep.ok and len(rep.failures) == 1
    assert "1 of 8 checks failed" in rep.render()
    with pytest.raises(Q.DataQualityError):
        rep.raise_if_failed()
    assert len(rep.to_dict()["checks"]) == 8


def test_mixed_format_dates_parse_or_null(spark):
    from tillroll.sources.raw import parse_mixed_timestamp
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("2012-05-01 10:00:00",), ("2012-05-01",), ("garbage",)], "d string")
    got = [r[0] for r in df.select(parse_mixed_timestamp(F.col("d"))).collect()]
    assert got[0] == datetime(2012, 5, 1, 10) and got[1] == datetime(2012, 5, 1) and got[2] is None


def test_star_tables_with_text_dates_keep_unparseable_rows(spark, tmp_path):
    from tillroll.sources.raw import read_star_tables

    root = str(tmp_path / "star")
    tx = spark.createDataFrame(
        [("1", "A", 7, 2, Decimal("1.5000"), Decimal("3.00"), "2012-05-01 10:00:00", "P", False),
         ("2", "A", 7, 1, Decimal("1.5000"), Decimal("1.50"), "2012-05-02", "P", False),
         ("3", "A", 7, 1, Decimal("1.5000"), Decimal("1.50"), "not a date", "P", False)],
        TX_SCHEMA.replace("invoice_date timestamp", "invoice_date string"),
    )
    tx.write.parquet(f"{root}/transactions")
    spark.createDataFrame([(7, "P")], "customer_id bigint, country string").write.parquet(f"{root}/customers")
    spark.createDataFrame([("A", "X")], "stock_code string, description string").write.parquet(f"{root}/products")
    t, c, p = read_star_tables(spark, root)
    assert t.count() == 3 and t.filter("invoice_date IS NULL").count() == 1
    a = report(t, c, p)["invoice_date_within_expected_window"]
    assert not a["passed"] and a["actual"].endswith("without date: 1")


def test_bitmaps_and_keys_find_the_same_orphans(spark, monkeypatch):
    import random

    monkeypatch.setattr(Q, "MANY_KEYS", 1000)
    rng = random.Random(2)
    known = [k for k in range(-50_000, 150_000, 7) if rng.random() < 0.9]
    facts = [rng.choice(known) for _ in range(3000)] + [None] * 50
    for extra in ([], [3, 3, 4, 99_999], [10**17, 10**17, -(10**17), 160_000, 5, 6]):
        f = spark.createDataFrame([(k,) for k in facts + extra], "k bigint").filter("k is not null").repartition(4)
        d = spark.createDataFrame([(k,) for k in known + known[:9]], "k bigint")
        bounds = Q._dense_bounds(d)
        assert bounds == (min(known), max(known))
        plain, by_key = Q._orphans_by_key(f, d)
        counts, by_bitmap = Q._orphans_by_bitmap(f, d, *bounds)
        assert counts.first().asDict() == plain.first().asDict()
        assert sorted(map(tuple, by_bitmap.collect())) == sorted(map(tuple, by_key.select("k", "rows").collect()))
        assert counts.first()["orphans"] == len(set(extra) - set(known))
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "bitmap_construct_agg" in plan


def test_few_sparse_empty_and_text_keys_go_by_key(spark, monkeypatch):
    few = spark.range(1000).selectExpr("id AS k")
    assert Q._dense_bounds(few) is None
    monkeypatch.setattr(Q, "MANY_KEYS", 1)
    assert Q._dense_bounds(few) == (0, 999)
    frame = lambda ks, kind: spark.createDataFrame([(k,) for k in ks], f"k {kind}")
    assert Q._dense_bounds(frame([1, 10**12], "bigint")) is None
    assert Q._dense_bounds(frame([], "bigint")) is None and Q._dense_bounds(frame(["1"], "string")) is None
    assert Q._dense_bounds(frame([5], "int")) == (5, 5)
