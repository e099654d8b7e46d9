"""Benchmark decontamination: MinHash containment search, verified by exact shingle containment.

DataFrame operations only. A benchmark item is a short set of five-word shingles, a document a
long one, so their Jaccard similarity says little; what counts is containment, the share of the
item's shingles that the document has. Items are partitioned by the size of their sets, and the
partition sets the sketch: an item of n shingles that is contained to at least ``containment``
lacks at most n - ceil(containment * n) of them, so that number plus one of its smallest shingle
hashes (its bottom-k MinHash) must hold one that the document has; k is that of the largest item
of the partition. Documents with a sketch hash of an item are its candidates; no item is missed.
Candidates are verified on the shingles themselves, as texts, and pairs that reach
``containment`` remain.

Sketches and items' shingles are broadcast while their counted rows stay under a bound; beyond it
they are joined by shuffle. Candidates are found without moving texts; only candidate documents
are read again.

Defined results: words are runs of anything but the six ASCII white space characters, A-Z lower-
cased; an item or document under five words (null, empty) has no shingle and is in no pair; items
of equal text are separate items; rows that repeat a doc_id count as one document with the
shingles of all of them; rows without doc_id or item_id are left out; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillroll.llm.common import ascii_lower, stash, table

SHINGLE = 5
CONTAINMENT = 0.6
#: Largest number of rows (of about 100 bytes) that is broadcast.
BROADCAST_ROWS = 500_000

_BLANKS = " \t\n\v\f\r"


def words_of(text: Column) -> Column:
    """The lower-cased words of a text as an array; null for a null text."""
    return F.split(F.btrim(ascii_lower(text), F.lit(_BLANKS)), r"[\x20\x09-\x0D]+")


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint, if the counted rows allow one."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def hashed_shingles(rows: DataFrame, id_col: str) -> DataFrame:
    """(id, words, place, hash): one row per shingle, hashed from the hashes of its words."""
    placed = rows.select(id_col, words_of(F.col("text")).alias("words")).filter(F.size("words") >= SHINGLE).select(
        id_col, "words", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes")
    )
    exploded = placed.select(
        id_col, "words", "hashes", F.explode(F.sequence(F.lit(0), F.size("words") - SHINGLE)).alias("place")
    )
    parts = [F.get("hashes", F.col("place") + i) for i in range(SHINGLE)]
    return exploded.select(id_col, "words", "place", F.xxhash64(*parts).alias("hash"))


def shingle_text() -> Column:
    return F.array_join(F.slice("words", F.col("place") + 1, SHINGLE), " ")


def item_shingles(benchmark: DataFrame) -> DataFrame:
    """(item_id, hash, shingle, n): the distinct shingles of every item and their number."""
    rows = (
        hashed_shingles(benchmark.filter("item_id is not null"), "item_id")
        .select("item_id", "hash", shingle_text().alias("shingle"))
        .distinct()
    )
    return rows.withColumn("n", F.count("*").over(Window.partitionBy("item_id")))


def sketches(items: DataFrame, containment: float) -> DataFrame:
    """(item_id, hash): the smallest hashes of every item, as many as its size partition asks for.

    Partitions are powers of two of the set size; the largest size in one sets k for all of it."""
    sized = items.withColumn("partition", F.ceil(F.log2("n"))).withColumn(
        "lacking", F.col("n") - F.ceil(F.lit(containment) * F.col("n"))
    )
    depth = sized.groupBy(F.col("partition").alias("p")).agg((F.max("lacking") + 1).alias("k"))
    smallest = Window.partitionBy("item_id").orderBy("hash", "shingle")
    return (
        sized.withColumn("order", F.row_number().over(smallest))
        .join(depth, F.col("partition") == F.col("p"))
        .filter(F.col("order") <= F.col("k"))
        .select("item_id", "hash")
        .distinct()
    )


def contained_items(docs: DataFrame, benchmark: DataFrame, *, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, item_id, shared, item_shingles, containment) of all pairs that reach ``containment``."""
    items = stash(item_shingles(benchmark), "items")
    n_items = items.count()
    docs = docs.select("doc_id", "text").filter("doc_id is not null")
    sketch = _bounded(sketches(items, containment).withColumnRenamed("hash", "sketch_hash"), n_items)
    candidates = stash(
        hashed_shingles(docs, "doc_id")
        .select("doc_id", "hash")
        .join(sketch, F.col("hash") == F.col("sketch_hash"))
        .select("doc_id", "item_id")
        .distinct(),
        "leak-candidates",
    )
    found = candidates.select(F.col("doc_id").alias("found_doc")).distinct()
    again = docs.join(_bounded(found, candidates.count()), F.col("doc_id") == F.col("found_doc"), "left_semi")
    wanted = _bounded(items.withColumnRenamed("hash", "item_hash"), n_items)
    shared = (
        hashed_shingles(again, "doc_id")
        .join(wanted, F.col("hash") == F.col("item_hash"))
        .filter(shingle_text() == F.col("shingle"))
        .select("doc_id", "item_id", "shingle", "n")
        .distinct()
        .groupBy("doc_id", "item_id", "n")
        .agg(F.count("*").alias("shared"))
    )
    # ids are unique per side in the candidates: a semi join keeps the searched pairs
    return (
        shared.join(candidates, ["doc_id", "item_id"], "left_semi")
        .filter(F.col("shared") >= F.ceil(F.lit(containment) * F.col("n")))
        .select(
            "doc_id",
            "item_id",
            "shared",
            F.col("n").alias("item_shingles"),
            (F.col("shared") / F.col("n")).alias("containment"),
        )
    )


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it contains."""
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = rf"""
WITH words AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') FROM benchmark),
places AS (SELECT kind, id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM words),
shingles AS (
  SELECT DISTINCT kind, id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] AS s FROM places),
items AS (SELECT id AS item_id, s, count(*) OVER (PARTITION BY id) AS n FROM shingles WHERE kind = 'b')
SELECT d.id AS doc_id, item_id, count(*)::BIGINT AS shared, n::BIGINT AS item_shingles, count(*)::DOUBLE / n AS containment
FROM items JOIN shingles d ON d.kind = 'd' AND d.s = items.s
GROUP BY d.id, item_id, n
HAVING count(*) >= ceil({CONTAINMENT}::DOUBLE * n)
"""

QUERIES = {"op1_decontaminate": op1_decontaminate}
ORACLES = {"op1_decontaminate": ORACLE}
