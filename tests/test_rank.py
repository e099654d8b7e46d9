"""Distributed ranking against the built-in single-partition window and pandas."""

from __future__ import annotations

import functools
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from tillroll.operators import rank
from tillroll.operators.rank import RN, distributed_ntile, exact_quantiles, global_rank, grouped_quantile, metric_quantiles, multi_ntile


@pytest.mark.parametrize("n,k", [(1, 5), (3, 5), (5, 5), (6, 4), (7, 4), (10, 4), (23, 5), (1000, 5)])
def test_ntile_matches_builtin(spark, n, k):
    df = spark.createDataFrame([(i, (i * 7919) % 13) for i in range(n)], "key int, v int")
    ours = distributed_ntile(df, k, [F.col("v").asc(), F.col("key").asc()], "t", num_partitions=4)
    ref = df.withColumn("t", F.ntile(k).over(Window.orderBy(F.col("v").asc(), F.col("key").asc())))
    assert sorted(map(tuple, ours.select("key", "t").collect())) == sorted(map(tuple, ref.select("key", "t").collect()))


def test_hot_value_is_split_across_partitions(spark):
    # a third of all rows share one value: the range partitioner must still spread them
    rows = [(i, 0 if i % 3 == 0 else i) for i in range(3000)]
    df = spark.createDataFrame(rows, "key int, v int")
    ranked = global_rank(df, [F.col("v").asc(), F.col("key").asc()], num_partitions=6)
    per_part = ranked.filter("v = 0").withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert len(per_part) > 1
    got = sorted((r["key"], r[RN]) for r in ranked.collect())
    expected = sorted(zip(pd.DataFrame(rows, columns=["key", "v"]).sort_values(["v", "key"])["key"], range(1, 3001)))
    assert got == expected


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=60))
def test_quantiles_match_pandas(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x int")
    qs = [Fraction(1, 4), Fraction(1, 2), Fraction(3, 4)]
    row = exact_quantiles(df, "x", qs, as_double=True).first()
    expected = pd.Series(values).quantile([0.25, 0.5, 0.75]).tolist()
    assert np.allclose([row["q0"], row["q1"], row["q2"]], expected)


def test_grouped_quantile_matches_pandas(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"g": rng.integers(0, 4, 500), "v": rng.normal(size=500).round(3)})
    pdf.loc[:200, "g"] = 0  # a hot group
    df = spark.createDataFrame(pdf)
    got = {r["g"]: r["p"] for r in grouped_quantile(df, ["g"], "v", Fraction(95, 100), "p").collect()}
    expected = pdf.groupby("g")["v"].quantile(0.95).to_dict()
    assert set(got) == set(expected)
    assert all(abs(got[g] - expected[g]) < 1e-9 for g in expected)


def test_result_stays_distributed(spark):
    # the rows are never funnelled through one task: the ranked frame keeps the range partitions
    df = spark.range(1000).withColumn("v", F.col("id") % 7)
    ours = distributed_ntile(df, 5, [F.col("v").asc(), F.col("id").asc()], "t", num_partitions=6)
    assert ours.rdd.getNumPartitions() == 6
    sizes = ours.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert max(r["count"] for r in sizes) < 1000


@pytest.mark.parametrize("whole", [10_000, 5])
@pytest.mark.parametrize("n,k", [(1, 5), (4, 5), (7, 4), (60, 5), (3000, 5)])
def test_multi_ntile_matches_builtin(spark, monkeypatch, n, k, whole):
    monkeypatch.setattr(rank, "WHOLE_GROUP", whole)
    monkeypatch.setattr(rank, "DIRECT", whole if whole < 10 else rank.DIRECT)
    rows = [(f"c{i * 37 % n:05d}", 1 if i % 3 == 0 else i % 50, (i * 7919) % 1013, i / 7) for i in range(n)]
    df = spark.createDataFrame(rows, "key string, hot int, spread long, x double")
    for metrics in ([("a", F.col("hot"), True), ("b", F.col("spread"), False)], [("c", F.col("x"), True), ("d", F.col("hot"), False)]):
        got = multi_ntile(df, "key", k, metrics, num_partitions=3)
        for name, value, ascending in metrics:
            order = Window.orderBy(value.asc() if ascending else value.desc(), F.col("key").asc())
            ref = {r["key"]: r["t"] for r in df.withColumn("t", F.ntile(k).over(order)).collect()}
            assert {r["key"]: r[name] for r in got.collect()} == ref


def test_brackets_hold_the_exact_positions(spark, monkeypatch):
    monkeypatch.setattr(rank, "WHOLE_GROUP", 10)
    monkeypatch.setattr(rank, "DIRECT", 10)
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(size=30_000), np.zeros(15_000), rng.integers(0, 5, 15_000)])
    df = spark.createDataFrame(pd.DataFrame({"x": values})).repartition(7)
    qs = [Fraction(1, 100), Fraction(1, 4), Fraction(1, 2), Fraction(95, 100), Fraction(1)]
    row = exact_quantiles(df, "x", qs, as_double=True).first()
    assert np.allclose(list(row), np.quantile(values, [float(q) for q in qs]), atol=1e-12)


def test_a_bracket_that_misses_is_found_out(spark, monkeypatch):
    # brackets of no width around a wrong place: every position is missed, and found by widening
    monkeypatch.setattr(rank, "WHOLE_GROUP", 10)
    monkeypatch.setattr(rank, "DIRECT", 10)
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 6_000), "v": rng.normal(size=6_000)})
    df = spark.createDataFrame(pdf).repartition(5)
    wrong = rank.value_sketches(df.withColumn("v", F.col("v") * 0 + 100 + F.col("g")), ["g"])
    for sketches in (wrong, rank.value_sketches(df, ["g"], 8)):
        got = {r["g"]: r["p"] for r in grouped_quantile(df, ["g"], "v", Fraction(95, 100), "p", sketches).collect()}
        assert got == pytest.approx(pdf.groupby("g")["v"].quantile(0.95).to_dict(), abs=1e-12)
    whole = df.select(F.lit(1).alias("k"), "v")
    wrong = rank.value_sketches(whole.withColumn("v", F.lit(0.0)), [])
    found = rank.order_statistics(whole.select("v"), [], rank.tile_ends(4), wrong).collect()
    assert sorted(r["v"] for r in found) == [np.sort(pdf["v"])[n] for n in (1499, 2999, 4499)]


def test_wide_brackets_are_narrowed_by_histograms(spark, monkeypatch):
    monkeypatch.setattr(rank, "INSIDE", 40)
    monkeypatch.setattr(rank, "DIRECT", 10)
    monkeypatch.setattr(rank, "BINS", 16)
    rng = np.random.default_rng(6)
    values = np.concatenate([rng.lognormal(0, 4, 4_000), np.full(2_000, 7.0), [1e-300, 1e300]])
    df = spark.createDataFrame(pd.DataFrame({"g": np.arange(len(values)) % 2, "x": values})).repartition(4)
    qs = [Fraction(1, 100), Fraction(1, 2), Fraction(99, 100)]
    row = exact_quantiles(df, "x", qs, as_double=True).first()
    assert np.allclose(list(row), np.quantile(values, [float(q) for q in qs]), rtol=1e-12)
    monkeypatch.setattr(rank, "BROADCAST_GROUPS", 0)
    got = {r["g"]: r["p"] for r in grouped_quantile(df, ["g"], "x", Fraction(3, 4), "p").collect()}
    assert got == pytest.approx({g: np.quantile(values[g::2], 0.75) for g in (0, 1)}, rel=1e-12)


def test_sketches_of_batches_answer_together(spark, monkeypatch):
    monkeypatch.setattr(rank, "DIRECT", 10)
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"g": rng.integers(0, 4, 50_000), "v": rng.normal(size=50_000)})
    df = spark.createDataFrame(pdf)
    parts = [rank.value_sketches(df.filter(F.pmod(F.xxhash64("v"), F.lit(3)) == i), ["g"]) for i in range(3)]
    together = rank.merge_sketches(functools.reduce(lambda a, b: a.unionByName(b), parts), ["g"])
    assert {r["g"]: r["n"] for r in together.collect()} == pdf.groupby("g").size().to_dict()
    got = {r["g"]: r["p"] for r in grouped_quantile(df, ["g"], "v", Fraction(95, 100), "p", together).collect()}
    assert got == pytest.approx(pdf.groupby("g")["v"].quantile(0.95).to_dict(), abs=1e-12)


def test_nulls_have_no_position(spark):
    df = spark.createDataFrame([(1, None), (None, None), (3, 1.5), (5, 2.5)], "a int, b double")
    qs = [Fraction(1, 4), Fraction(1, 2)]
    got = {r["m"]: (r["q0"], r["q1"]) for r in metric_quantiles(df, [("a", F.col("a")), ("b", F.col("b"))], qs, "q", as_double=True).collect()}
    assert got == {"a": (2.0, 3.0), "b": (1.75, 2.0)}


def test_values_are_ranked_in_their_own_type(spark):
    df = spark.createDataFrame([("a", 0.12345671), ("b", 0.12345672), ("c", 0.12345673)], "key string, x double")
    assert exact_quantiles(df, "x", [Fraction(1, 2)], as_double=True).first()["q0"] == 0.12345672
    got = {r["key"]: r["t"] for r in multi_ntile(df, "key", 3, [("t", F.col("x"), False)]).collect()}
    assert got == {"a": 3, "b": 2, "c": 1}


def test_tiles_store_and_shuffle_no_payload(spark):
    df = spark.range(2000).select(F.col("id").alias("key"), (F.col("id") % 7).alias("v"), F.lit("x" * 50).alias("payload"))
    plan = multi_ntile(df, "key", 5, [("t", F.col("v"), True)])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and not any("payload" in x for x in plan.splitlines() if "Exchange" in x)
