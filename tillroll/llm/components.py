"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import drop_stash, stash


def _neighbours(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.select(F.col("a").alias("u"), F.col("b").alias("v"))


def _star(pairs: DataFrame, keep) -> DataFrame:
    """Pairs (u, v) re-hung on the smallest of u and its neighbours."""
    least = pairs.groupBy("u").agg(F.min("v").alias("least")).select(
        F.col("u").alias("center"), F.least("least", "u").alias("least")
    )
    return pairs.join(least, F.col("u") == F.col("center")).select(*keep).filter("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its smallest node.

    Each round hangs every node's larger neighbours, then its smaller ones and itself, on the
    smallest neighbour. Rounds are written to the shared folder, only the last one kept, and end
    when none changes an edge, after about log(nodes) of them. A round keeps at most two rows per
    edge."""
    edges = stash(edges.filter("a <> b").distinct(), "cc-edges")
    before = None
    while True:
        pairs = _neighbours(edges)
        large = _star(
            pairs, (F.when(F.col("v") > F.col("u"), F.col("v")).otherwise(F.col("u")).alias("a"), F.col("least").alias("b"))
        )
        downward = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = downward.groupBy("u").agg(F.min("v").alias("least"))
        small = (
            downward.join(least.select(F.col("u").alias("center"), "least"), F.col("u") == F.col("center"))
            .select(F.explode(F.array("u", "v")).alias("a"), F.col("least").alias("b"))
            .filter("a <> b")
            .distinct()
        )
        last, edges = edges, stash(small, "cc-edges")
        drop_stash(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if before is not None and tuple(now) == before:
            break
        before = tuple(now)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
