"""Vector bin packing of documents into shards.

Every document demands a vector (bytes, words, rows). Documents of equal text form a group, and
a group is placed whole unless it exceeds a shard's capacity (an equal share of any total): only
then is it split, by document id, into pieces of about ``PIECE`` of a shard. A group above a lot
(``1 / (shards * lots_per_shard)`` of any total) is an item of its own; all smaller groups are
dealt into lots by the hash of their text. The items, whose number the parameters bound whatever
the input, are placed one after the other, largest first, each on the shard where the dot product
of its demand with the residual capacity is highest. An item's rows are numbered in chunks of
about a lot, so no task holds a large group. Rows never pass through the driver: it sees only
the chunks' totals.

Defined results: a null text has no bytes and no words and forms a group of its own; an empty
table gives an empty result; repeated rows are separate rows of one group; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillroll.llm.common import stash, table, word_count

SHARDS = 40
LOTS_PER_SHARD = 256
ROW_OVERHEAD = 16
#: About so much of a shard is a piece of a group that no shard holds.
PIECE = 0.5
#: Weight of each dimension in the dot product: bytes decide, words and rows break near ties.
WEIGHTS = (1.0, 0.1, 0.02)


def place(demands: np.ndarray, shards: int, weights=WEIGHTS) -> np.ndarray:
    """The shard of each demand vector (rows of ``demands``), largest demand first.

    Each vector goes where its dot product with the residual capacity (an equal share of every
    total, less what is there) is highest; on ties to the lowest shard number."""
    totals = demands.sum(axis=0)
    scaled = demands / np.where(totals > 0, totals, 1.0) * np.sqrt(np.asarray(weights))
    residual = np.tile(scaled.sum(axis=0) / shards, (shards, 1))
    placed = np.zeros(len(demands), dtype=np.int64)
    for i in np.argsort(-scaled[:, 0], kind="stable"):
        placed[i] = s = int(np.argmax(residual @ scaled[i]))
        residual[s] -= scaled[i]
    return placed


def shard_documents(
    docs: DataFrame, *, shards: int = SHARDS, lots_per_shard: int = LOTS_PER_SHARD, weights=WEIGHTS
) -> DataFrame:
    """One row per document: its demand, its shard and its slot (gapless from 0) in the shard."""
    spark = docs.sparkSession
    lots = shards * lots_per_shard
    text = F.col("text")
    rows = stash(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_OVERHEAD).cast("long").alias("size"),
            word_count(text).alias("words"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("text_key"),
        ),
        "shard-rows",
    )
    group = ["text_key", "text_crc32", "size"]
    total = rows.agg(
        F.sum("size").alias("size"), F.sum("words").alias("words"), F.count("*").alias("n")
    ).first()

    # groups above a lot in some dimension: at most three times the lots, so safe to broadcast
    share = F.greatest(
        F.col("n") * F.col("size") / F.lit(max(total["size"] or 0, 1)),
        F.col("n") * F.col("words") / F.lit(max(total["words"] or 0, 1)),
        F.col("n") / F.lit(max(total["n"], 1)),
    )
    large = (
        rows.groupBy(*group)
        .agg(F.count("*").alias("n"), F.max("words").alias("words"))
        .select(
            *group,
            F.ceil(share * lots).cast("int").alias("chunks"),
            F.when(share * shards > 1, F.ceil(share * shards / F.lit(PIECE))).otherwise(1).cast("int").alias("pieces"),
        )
        .filter(F.col("chunks") > 1)
    )
    dealt = rows.join(F.broadcast(large), group, "left").select(
        "*",
        F.when(F.col("chunks").isNull(), F.pmod("text_key", F.lit(lots)))
        .otherwise(F.col("text_key"))
        .alias("lot_key"),
        F.when(F.col("chunks").isNull(), F.lit(-1).cast("long"))
        .otherwise(F.pmod(F.xxhash64("doc_id"), F.coalesce("chunks", F.lit(1)).cast("long")))
        .alias("lot_chunk"),
    ).withColumn(
        "piece",
        F.when(F.col("chunks").isNull(), -1).otherwise(F.floor(F.col("lot_chunk") * F.col("pieces") / F.col("chunks"))).cast("int"),
    )
    sums = (
        dealt.groupBy("lot_key", "piece", "lot_chunk")
        .agg(F.sum("size").alias("size"), F.sum("words").alias("words"), F.count("*").alias("n"))
        .orderBy("lot_key", "piece", "lot_chunk")
        .toPandas()  # bounded by the parameters: the lots and the chunks of large groups
    )
    item = sums.groupby(["lot_key", "piece"], sort=True).ngroup().to_numpy()
    demands = np.zeros((item.max(initial=-1) + 1, 3))
    np.add.at(demands, item, sums[["size", "words", "n"]].to_numpy(dtype=float).reshape(-1, 3))
    sums["shard"] = place(demands, shards, weights)[item]
    sums["first_slot"] = sums.groupby("shard")["n"].cumsum() - sums["n"]
    placed = spark.createDataFrame(
        list(sums[["lot_key", "lot_chunk", "shard", "first_slot"]].itertuples(index=False, name=None)),
        "lot_key long, lot_chunk long, shard int, first_slot long",
    )
    in_lot = Window.partitionBy("lot_key", "lot_chunk").orderBy("text_key", "text_crc32", "size", "doc_id")
    return (
        dealt.withColumn("in_lot", F.row_number().over(in_lot) - 1)
        .join(F.broadcast(placed), ["lot_key", "lot_chunk"])
        .select(
            "doc_id",
            "size",
            "words",
            "text_crc32",
            "shard",
            (F.col("first_slot") + F.col("in_lot")).cast("long").alias("slot"),
        )
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes."""
    return as_contract(shard_documents(table(spark, sf_dir, "documents")))


def as_contract(sharded: DataFrame) -> DataFrame:
    return sharded.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {"op7_sharding": op7_sharding}
ORACLES: dict[str, str] = {}
