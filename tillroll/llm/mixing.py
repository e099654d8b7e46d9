"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame operations only.

Sources take weights 1, 2, 3, 1, ... by code point order (null last). The words of the whole
table are shared out by weight; a source's target stops at ``cap`` times its words and the excess
goes to the others by weight. A target of 2.3 times a source's words means two complete epochs
and a fractional selection: every document draws an exponential key whose rate is its quality
weight, keys are sorted within the source, and documents are taken in that order until their
prefix sum reaches the remaining words (the document at the edge if that comes closer).

The prefix sum is cut by key ranges: word sums per (source, range) locate the one range that
holds the edge; only that range is sorted, so a source with a third of all rows costs one
range's sort (``1 / ranges`` of it), never a sort of the whole source in one task.

Defined results: a null or empty text has size 0 and is never an obstacle (taken 0); a null
source is a source; an empty table gives an empty result; rows that repeat a doc_id draw the same
key, rows without one draw by their text; of rows that draw alike and have one text, as many are
taken as the target needs (which of them is left open); other columns are ignored (or, in the
mix itself, carried along). Reruns agree, as keys come from md5.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillroll.llm.common import stash, table, word_count

WEIGHTS = (1, 2, 3)
CAP = 3
RANGES = 4096
#: Sources whose plan is broadcast; more are joined by shuffle.
BROADCAST_SOURCES = 100_000
SEED = "mix-1"
#: The order in which rows are taken: by key; then what tells rows apart that draw the same key.
DRAW = ("mix_key", "mix_id", "mix_size", "mix_tie")
#: Slices in which rows that draw alike are numbered.
SLICES = 1024
SYMBOLS = "#*$%&|<>!{}"
#: Lowest quality weight: the share of characters that are no symbols, never under this.
LEAST_QUALITY = 0.25


def quality_weight(text: Column) -> Column:
    """Share of the text's characters that are not symbols, at least LEAST_QUALITY."""
    chars = F.length(text)
    plain = F.length(F.translate(text, SYMBOLS, ""))
    share = F.coalesce(plain / F.nullif(chars, F.lit(0)), F.lit(1.0))
    return F.greatest(share, F.lit(LEAST_QUALITY))


def exponential_key(doc_id: Column, text: Column, weight: Column, seed: str) -> Column:
    """-ln(u) / weight, with u in (0, 1) from the first 52 bits of an md5 of the id (or the text)."""
    without_id = F.concat(F.lit("null|"), F.coalesce(F.md5(text.cast("binary")), F.lit("")))
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), without_id)))
    bits = F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")
    return -F.ln((bits + F.lit(0.5)) / F.lit(float(1 << 52))) / weight


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """``sizes`` (source, source_size) with each source's target, in words.

    Sorted by words per weight, the sources at their cap are a prefix; a source belongs to it if
    its cap is at most its share of what the sources before it leave over. One row per source:
    the global windows see the sources, never the documents."""
    choice = F.array(*[F.lit(w) for w in weights])
    weighted = sizes.withColumn(
        "rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    ).withColumn("weight", F.element_at(choice, ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("long"))
    limit = F.col("source_size") * cap
    by_need = Window.orderBy((limit / F.col("weight")).asc(), "rank")
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.orderBy("one").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    stepped = (
        weighted.withColumn("one", F.lit(1))
        .withColumn("left_over", F.sum("source_size").over(whole) - F.coalesce(F.sum(limit).over(before), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(rest))
        .withColumn("capped", limit * F.col("weight_left") <= F.col("weight") * F.col("left_over"))
    )
    free_words = F.max(F.when(~F.col("capped"), F.col("left_over"))).over(whole)
    free_weight = F.max(F.when(~F.col("capped"), F.col("weight_left"))).over(whole)
    return stepped.select(
        "source",
        "source_size",
        F.when(F.col("capped"), limit.cast("double"))
        .otherwise((F.col("weight") * free_words).cast("double") / free_weight)
        .alias("target"),
    )


def drawn(docs: DataFrame, seed: str = SEED, ranges: int = RANGES) -> DataFrame:
    """``docs`` with what the draw needs: words, key, key range and id, under ``mix_`` names."""
    text = F.col("text")
    return docs.withColumns(
        {
            "mix_size": word_count(text),
            "mix_key": exponential_key(F.col("doc_id"), text, quality_weight(text), seed),
            "mix_id": F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))),
            "mix_tie": F.xxhash64(text),
        }
    ).withColumn(
        "mix_range", F.least(F.floor((1 - F.exp(-F.col("mix_key"))) * ranges), F.lit(ranges - 1)).cast("int")
    )


def mix_plan(rows: DataFrame, *, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """What the mix does with each source, from drawn rows.

    One row per source: its words, target and complete epochs, the key range in which the prefix
    sum reaches the rest, the last draw that is taken in that range, how many rows drew it, and how
    many of them are taken."""
    by_range = stash(rows.groupBy("source", "mix_range").agg(F.sum("mix_size").alias("range_size")), "mix-ranges")
    targets = (
        source_targets(by_range.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, cap)
        .withColumn(
            "epochs",
            F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0),
        )
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    )
    # the range that holds the edge is the first whose running sum is not below the rest
    running = Window.partitionBy("source").orderBy("mix_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = (
        by_range.withColumn("upto", F.sum("range_size").over(running))
        .withColumnRenamed("source", "range_source")
        .join(
            targets.select(F.col("source").alias("target_source"), "rest"),
            F.col("range_source").eqNullSafe(F.col("target_source")),
        )
        .filter(F.col("upto") >= F.col("rest"))
        .groupBy("target_source")
        .agg(
            F.min("mix_range").alias("edge_range"),
            F.min_by(F.col("upto") - F.col("range_size"), "mix_range").alias("edge_before"),
        )
    )
    plan = stash(
        targets.join(edge, targets["source"].eqNullSafe(F.col("target_source")), "left")
        .withColumnRenamed("source", "plan_source")
        .drop("target_source"),
        "mix-edges",
    )
    # rows that draw alike are one row here, however many they are
    in_order = Window.partitionBy("source").orderBy(*DRAW).rowsBetween(Window.unboundedPreceding, -1)
    alike = (
        rows.select("source", "mix_range", *DRAW)
        .join(
            bounded(plan),
            F.col("source").eqNullSafe(F.col("plan_source")) & (F.col("mix_range") == F.col("edge_range")),
        )
        .groupBy("source", "edge_before", "rest", *DRAW)
        .agg(F.count("*").alias("rows"))
        .withColumn("ahead", F.col("edge_before") + F.coalesce(F.sum(F.col("rows") * F.col("mix_size")).over(in_order), F.lit(0)))
    )
    # a row is taken if that brings the words nearer to the rest
    nearer = F.col("ahead") * 2 + F.col("mix_size") < F.col("rest") * 2
    fitting = F.ceil((2 * (F.col("rest") - F.col("ahead")) - F.col("mix_size")) / (2 * F.nullif(F.col("mix_size"), F.lit(0))))
    last = (
        alike.filter(nearer)
        .withColumn("taken", F.least("rows", F.greatest(F.coalesce(fitting, F.col("rows")), F.lit(1))))
        .groupBy(F.col("source").alias("last_source"))
        .agg(F.max(F.struct(*DRAW, "rows", "taken")).alias("last"))
    )
    return stash(
        plan.join(last, F.col("plan_source").eqNullSafe(F.col("last_source")), "left").select(
            "plan_source",
            "source_size",
            "target",
            "epochs",
            "rest",
            "edge_range",
            F.when(F.col("last").isNotNull(), F.struct(*[F.col(f"last.{c}").alias(c) for c in DRAW])).alias("last"),
            (F.col("last.rows") > F.col("last.taken")).alias("last_parted"),
            F.col("last.taken").alias("last_taken"),
        ),
        "mix-plan",
    )


def bounded(plan: DataFrame) -> DataFrame:
    """A plan has a row per source: broadcast as long as sources are few."""
    return F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan


def some_of(tied: DataFrame) -> DataFrame:
    """``mix_selected`` for rows that drew the last draw of their source: true for ``last_taken`` of them.

    The rows are numbered in slices of a stored copy, so that a draw which a third of all rows share
    is no single task's."""
    tied = stash(tied.withColumn("mix_number", F.monotonically_increasing_id()), "mix-tied")
    tied = tied.withColumn("mix_slice", F.pmod("mix_number", F.lit(SLICES)))
    upto = Window.partitionBy("sliced_source").orderBy("sliced").rowsBetween(Window.unboundedPreceding, -1)
    slices = (
        tied.groupBy(F.col("source").alias("sliced_source"), F.col("mix_slice").alias("sliced"))
        .agg(F.count("*").alias("mix_rows"))
        .withColumn("mix_before", F.coalesce(F.sum("mix_rows").over(upto), F.lit(0)))
    )
    same = F.col("source").eqNullSafe(F.col("sliced_source")) & (F.col("mix_slice") == F.col("sliced"))
    number = F.row_number().over(Window.partitionBy("source", "mix_slice").orderBy("mix_number"))
    return tied.join(slices, same).withColumn("mix_selected", F.col("mix_before") + number <= F.col("last_taken"))


def with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Drawn rows with ``mix_copies``, how often the mix takes them, and their source's plan."""
    joined = rows.join(bounded(plan), F.col("source").eqNullSafe(F.col("plan_source")))
    draw = F.struct(*DRAW)
    taken = (F.col("mix_range") < F.col("edge_range")) | (
        (F.col("mix_range") == F.col("edge_range")) & F.coalesce(draw <= F.col("last"), F.lit(False))
    )
    judged = joined.withColumn("mix_selected", F.coalesce(taken, F.lit(True)))
    if not plan.filter("last_parted").isEmpty():
        parted = F.coalesce(F.col("last_parted") & (draw == F.col("last")), F.lit(False))
        columns = [c for c in judged.columns if c != "mix_selected"]
        some = some_of(judged.filter(parted).drop("mix_selected")).select(*columns, "mix_selected")
        judged = judged.filter(~parted).unionByName(some)
    selected = (F.col("rest") > 0) & F.col("mix_selected")
    return judged.withColumn("mix_copies", (F.col("epochs") + selected.cast("long")).cast("int"))


def mix_sources(docs: DataFrame, *, weights=WEIGHTS, cap: int = CAP, ranges: int = RANGES, seed: str = SEED) -> DataFrame:
    """Per document: size, source_size, target, the words taken, and the copies they make."""
    rows = stash(
        drawn(docs.select("doc_id", "source", "text"), seed, ranges).drop("text"),
        "mix-rows",
    )
    return with_copies(rows, mix_plan(rows, weights=weights, cap=cap)).select(
        "doc_id",
        "source",
        F.col("mix_size").alias("size"),
        "source_size",
        "target",
        (F.col("mix_copies") * F.col("mix_size")).cast("long").alias("taken"),
        F.col("mix_copies").alias("copies"),
    )


def mixed_documents(docs: DataFrame, *, weights=WEIGHTS, cap: int = CAP, ranges: int = RANGES, seed: str = SEED) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken."""
    needed = docs.select("doc_id", "source", "text", F.struct(*[docs[c] for c in docs.columns]).alias("mix_row"))
    rows = stash(drawn(docs.select("doc_id", "source", "text"), seed, ranges).drop("text"), "mix-rows")
    taken = with_copies(drawn(needed, seed, ranges), mix_plan(rows, weights=weights, cap=cap)).filter("mix_copies > 0")
    return taken.select(
        "mix_row", F.explode(F.sequence(F.lit(1), F.col("mix_copies"))).alias("mix_copy")
    ).select("mix_row.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents: one row per document with the words the mix takes of it."""
    return mix_sources(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         -ln((('0x' || substr(md5('{SEED}|' || doc_id), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)
           / greatest(coalesce(length(translate(text, '{SYMBOLS}', ''))::DOUBLE / nullif(length(text), 0), 1.0),
                      {LEAST_QUALITY}) AS key
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS w
  FROM d GROUP BY source),
trial AS (  -- a level per number of capped sources; the right one caps nobody else
  SELECT a.source AS edge, a.source_size * 3.0 / a.w AS ratio,
         (SELECT sum(source_size) FROM s) -
           coalesce((SELECT sum(3 * b.source_size) FROM s b WHERE b.source_size * 3.0 / b.w < a.source_size * 3.0 / a.w), 0) AS words,
         (SELECT sum(b.w) FROM s b WHERE b.source_size * 3.0 / b.w >= a.source_size * 3.0 / a.w) AS weight
  FROM s a),
level AS (SELECT words, weight FROM trial WHERE ratio * weight > words ORDER BY ratio LIMIT 1),
t AS (
  SELECT s.source, s.source_size,
         CASE WHEN 3 * s.source_size * level.weight <= s.w * level.words THEN 3.0 * s.source_size
              ELSE (s.w * level.words)::DOUBLE / level.weight END::DOUBLE AS target
  FROM s, level),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target / t.source_size)::BIGINT AS epochs,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN 2 * ahead + size < 2 * (target - epochs * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""

QUERIES = {"op6_mixing": op6_mixing}
ORACLES = {"op6_mixing": ORACLE}
