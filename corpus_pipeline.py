"""A corpus pipeline of five stages over the documents table.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet
and read back as the next stage's ``docs``. All but the last return the columns of ``docs``.

Defined results of every stage: nulls in any column, empty texts, repeated rows and an empty table
give what the stage's operator defines for them; other columns travel along. Decisions about a
text reach its rows by doc_id and text together, so a doc_id that stands for several texts, or is
null, does no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm.common import stash, table
from tillroll.llm.decontaminate import contained_items
from tillroll.llm.mixing import mixed_documents
from tillroll.llm.ngram_join import label_documents
from tillroll.llm.repetition import kept_documents
from tillroll.llm.sharding import as_contract, shard_documents

#: Decisions about documents that are broadcast; more go through a shuffle.
BROADCAST_IDS = 2_000_000


def among(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """The rows of ``docs`` whose doc_id and text are among ``rows`` (doc_id, text_hash), or are not."""
    named = rows.select(F.col("doc_id").alias("named_id"), F.col("text_hash").alias("named_hash")).distinct()
    named = stash(named, "named")
    if named.count() <= BROADCAST_IDS:
        named = F.broadcast(named)
    same = docs["doc_id"].eqNullSafe(F.col("named_id")) & (F.xxhash64(docs["text"]) == F.col("named_hash"))
    return docs.join(named, same, how)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules reject go."""
    return kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one of the smallest doc_id (a null
    one last), of several texts with that id the one of the smallest hash.

    Documents without words are no duplicates of each other. Of rows that repeat id and text of
    the one that stays, one stays."""
    pairs = label_documents(docs).filter("n_shingles > 0").groupBy("component", "doc_id", "text_hash")
    pairs = stash(pairs.agg(F.count("*").alias("rows")), "near-pairs")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "rows"))
    kept = stash(pairs.groupBy("component").agg(first.alias("first")).select("first.*"), "near-kept")
    one = kept.select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("text_hash") == F.col("kept_hash"))
    rest = among(docs, pairs.join(one, same, "left_anti"), "left_anti")
    twins = kept.filter("rows > 1")
    if twins.isEmpty():
        return rest
    copies = among(docs, twins, "left_semi").withColumn("near_hash", F.xxhash64("text"))
    return among(rest, twins, "left_anti").unionByName(copies.dropDuplicates(["doc_id", "near_hash"]).drop("near_hash"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    keyed = docs.select(F.struct("doc_id", F.xxhash64("text").alias("text_hash")).alias("doc_id"), "text")
    found = contained_items(keyed, table(spark, sf_dir, "benchmark"))
    return among(docs, found.select("doc_id.doc_id", "doc_id.text_hash"), "left_anti")


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: a row per copy, none for those not taken."""
    return mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's shard and slot."""
    return as_contract(shard_documents(docs))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", mixing_sources),
    ("sharding", sharding),
]

#: SQL can express neither the shards' packing nor the near-duplicate groups: tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if (name, stage) != STAGES[-1]:
            docs = stash(docs, "stage")
    return docs
