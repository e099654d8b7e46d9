"""Schema contracts, drift severities and the expectation suite."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.operators import contracts as K
from tillroll.operators import expectations as E
from tillroll.schema import type_family


def findings(df, contract=None):
    return {(r["column"], r["kind"]): r for r in K.detect_drift(df, contract).collect()}


def test_conforming_batch_has_no_drift(batch):
    assert findings(batch) == {}
    assert K.enforce_contract(batch) == []


def test_missing_new_and_retyped(batch):
    drifted = batch.drop("Country").withColumn("Extra", F.lit(1)).withColumn("Quantity", F.col("Quantity").cast("string"))
    f = findings(drifted)
    assert f[("Country", "missing_column")]["severity"] == "breaking"
    assert f[("Extra", "new_column")]["severity"] == "additive"
    assert f[("Quantity", "type_change")]["detail"] == "integer declared, string found"


def test_int_where_float_expected_is_benign(batch):
    assert findings(batch.withColumn("UnitPrice", F.col("UnitPrice").cast("int"))) == {}


def test_all_null_column_carries_no_type_evidence(batch):
    assert ("CustomerID", "type_change") not in findings(batch.withColumn("CustomerID", F.lit(None).cast("int")))


def test_empty_batch_gets_no_all_null_exemption(spark, batch):
    empty = batch.limit(0).withColumn("CustomerID", F.lit(None).cast("int"))
    assert ("CustomerID", "type_change") in findings(empty)


def test_unexpected_nulls_counted(batch):
    f = findings(batch.withColumn("StockCode", F.when(F.col("Quantity") <= 0, None).otherwise(F.col("StockCode"))))
    assert f[("StockCode", "unexpected_nulls")]["detail"] == "2 nulls in a required column"


def test_enforce_raises_only_on_breaking(batch):
    assert len(K.enforce_contract(batch.withColumn("Extra", F.lit(1)))) == 1  # additive: passes
    with pytest.raises(K.SchemaDriftError, match="Country") as raised:
        K.enforce_contract(batch.drop("Country"))
    assert [f["kind"] for f in raised.value.findings] == ["missing_column"]
    found = K.enforce_contract(batch.drop("Country"), enforce=False)
    assert [(f["column"], f["severity"]) for f in found] == [("Country", "breaking")]


def test_contract_roundtrip_and_frame(spark, tmp_path):
    c = K.read_contract()
    path = K.write_contract(c, tmp_path / "c.json")
    assert K.read_contract(path) == c
    frame = K.contract_frame(spark, str(path))
    assert [r["column"] for r in frame.orderBy("ordinal").collect()] == c.columns.fieldNames()
    assert K.declared_columns(c, only=["Country", "InvoiceNo"]) == ["InvoiceNo", "Country"]
    with pytest.raises(ValueError):
        K.declare("x", "complex")


def test_infer(batch):
    c = K.infer_contract(batch, "x")
    kinds = {f.name: (type_family(f.dataType), f.nullable) for f in c.columns}
    assert kinds["CustomerID"] == ("string", True) and kinds["Quantity"] == ("integer", False)
    assert kinds["UnitPrice"] == ("float", False) and kinds["InvoiceDate"] == ("datetime", False)


def test_type_families():
    assert type_family(T.DecimalType(12, 4)) == "float" and type_family(T.ShortType()) == "integer"
    assert type_family(T.TimestampNTZType()) == "datetime" and type_family(T.BinaryType()) == "unknown"


class TestExpectations:
    def test_good_batch_passes(self, batch):
        out = E.validate_batch(batch)
        assert out.success and len(out.results) == 13

    def test_missing_column_fails_without_crashing(self, batch):
        out = E.validate_batch(batch.drop("Country"), enforce=False)
        failed = {(f["expectation"], f["column"]) for f in out.failures}
        assert ("expect_table_columns_to_match_set", None) in failed
        assert ("expect_column_values_to_not_be_null", "Country") in failed
        with pytest.raises(E.DataValidationError):
            E.validate_batch(batch.drop("Country"))

    def test_empty_batch(self, batch):
        out = E.validate_batch(batch.limit(0), enforce=False)
        assert {f["expectation"] for f in out.failures} == {
            "expect_table_row_count_to_be_between",
            "expect_column_unique_value_count_to_be_between",
        }

    def test_no_customers_at_all(self, batch):
        out = E.validate_batch(batch.withColumn("CustomerID", F.lit(None).cast("string")), enforce=False)
        assert [(f["column"], f["observed"]) for f in out.failures] == [("CustomerID", 0.0)]

    def test_country_cardinality(self, spark, batch):
        one = batch.filter((F.col("InvoiceNo") == "700001") & (F.col("StockCode") == "K200"))
        many = one.unionByName(one).unionByName(one).limit(1)
        wide = spark.range(100).select(F.concat(F.lit("Land"), F.col("id").cast("string")).alias("Country"))
        many = many.drop("Country").crossJoin(wide).select(*batch.columns)
        out = E.validate_batch(many, enforce=False)
        assert [f["expectation"] for f in out.failures] == ["expect_column_unique_value_count_to_be_between"]

    def test_negative_prices_mostly(self, spark, batch):
        neg = batch.withColumn("UnitPrice", -F.col("UnitPrice") - F.lit(1))
        out = E.validate_batch(neg, enforce=False)
        assert ("expect_column_values_to_be_between", "UnitPrice") in {(f["expectation"], f["column"]) for f in out.failures}


def test_approx_distinct_option(batch):
    out = E.validate_batch(batch, suite=E.build_suite(approx_distinct=True))
    assert out.success and out.results[-1]["observed"] == 2.0
