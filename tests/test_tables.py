"""Stored tables: versions, the shared writer, and the star's keyed append."""

from __future__ import annotations

import datetime as dt
from collections import Counter
from decimal import Decimal

import pytest

from tillroll.operators.star import load_star
from tillroll.sources import tables as T
from tillroll.sources.raw import read_star_tables

CLEAN = (
    "InvoiceNo string, StockCode string, Description string, Quantity int, InvoiceDate timestamp, UnitPrice decimal(12,4), "
    "CustomerID string, Country string, is_guest boolean, TotalPrice decimal(14,2)"
)


def lines(spark, rows):
    """(StockCode, Description, CustomerID, Country) as cleaned lines."""
    at = dt.datetime(2020, 1, 1)
    one = Decimal(1)
    return spark.createDataFrame([(str(i), s, d, 1, at, one, c, n, c is None, one) for i, (s, d, c, n) in enumerate(rows)], CLEAN)


def expected(rows, key, value):
    """Most frequent value per key, ties to the smallest, nulls last."""
    out = {}
    for k in {r[key] for r in rows}:
        counts = Counter(r[value] for r in rows if r[key] == k)
        out[k] = min(counts, key=lambda v: (v is None, -counts[v], v or ""))
    return out


def stored(spark, root):
    _, customers, products = read_star_tables(spark, root)
    p = [(r.stock_code, r.description) for r in products.collect()]
    c = [(str(r.customer_id), r.country) for r in customers.collect()]
    assert len(dict(p)) == len(p) and len(dict(c)) == len(c)  # one row per key
    return dict(p), dict(c)


FIRST = [("A", "x", "1", "F"), ("A", "x", "1", "F"), ("A", "y", "2", "G"), ("B", None, None, "F"), (None, "n", "3", "G")]
SECOND = [("A", "y", "1", "G"), ("A", "y", "1", "G"), ("C", "c", "4", "F"), ("B", "b", "2", "H"), (None, "m", "3", "G")]


def check(spark, root, rows):
    products, customers = stored(spark, root)
    assert products == expected(rows, 0, 1)
    assert customers == expected([r for r in rows if r[2] is not None], 2, 3)


def test_appended_batches_merge_by_key_and_replace_themselves(spark, tmp_path):
    root = str(tmp_path / "star")
    assert load_star(lines(spark, FIRST), root, batch="1") == {"transactions": 5, "products": 3, "customers": 3}
    check(spark, root, FIRST)
    load_star(lines(spark, SECOND), root, mode="append", batch="2")
    check(spark, root, FIRST + SECOND)
    # the same batch again changes nothing, a corrected one takes back what it no longer holds
    load_star(lines(spark, SECOND), root, mode="append", batch="2")
    check(spark, root, FIRST + SECOND)
    load_star(lines(spark, SECOND[:1]), root, mode="append", batch="2")
    check(spark, root, FIRST + SECOND[:1])
    assert read_star_tables(spark, root)[0].count() == 6
    # an empty batch, and a first append without a load before it
    load_star(lines(spark, []), root, mode="append")
    check(spark, root, FIRST + SECOND[:1])
    load_star(lines(spark, SECOND), str(tmp_path / "other"), mode="append")
    check(spark, str(tmp_path / "other"), SECOND)
    load_star(lines(spark, SECOND), root)
    check(spark, root, SECOND)
    with pytest.raises(ValueError, match="upsert"):
        load_star(lines(spark, SECOND), root, mode="upsert")


def test_only_keys_of_the_batch_are_judged_anew(spark, tmp_path):
    root = str(tmp_path / "star")
    load_star(lines(spark, FIRST), root, batch="1")
    # spoil a stored value of a key that the next batch does not have: it is taken over as it is
    _, _, products = read_star_tables(spark, root)
    T.publish(products.replace("n", "kept"), f"{root}/products")
    load_star(lines(spark, [("A", "y", "1", "G")]), root, mode="append")
    assert stored(spark, root)[0][None] == "kept"


def test_versions_count_once_they_are_finished(spark, tmp_path):
    path = str(tmp_path / "t")
    one, two = (spark.createDataFrame([(i,) for i in range(n)], "i int") for n in (1, 2))
    assert T.newest(spark, path) == path
    assert T.publish(one, path) == 1 and T.publish(two, path) == 2
    assert T.newest(spark, path).endswith("v=2") and T.numbered(spark, path, "v=") == [1, 2]
    two.write.parquet(f"{path}/v=3")
    (tmp_path / "t" / "v=3" / "_SUCCESS").unlink()  # died midway
    assert T.newest(spark, path).endswith("v=2")
    assert T.publish(one, path) == 1
    assert T.newest(spark, path).endswith("v=4") and T.numbered(spark, path, "v=", finished=False) == [2, 3, 4]


def test_a_partitioned_write_leaves_few_files(spark, tmp_path):
    rows = spark.range(0, 1000, numPartitions=8).selectExpr("id", "id % 3 AS k")
    assert T.write_table(rows, str(tmp_path / "t"), by=["k"], count=True) == 1000
    assert len(list((tmp_path / "t").glob("k=*/*.parquet"))) <= 6
