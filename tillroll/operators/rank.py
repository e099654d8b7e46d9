"""Distributed ranking: global row numbers, ntile and exact quantiles without a single task.

``ntile(5) OVER (ORDER BY x)`` with no PARTITION BY plans an ``Exchange SinglePartition``: the
whole table is sorted by one task. Here the order is established by range partitioning
instead, so every task sorts one balanced slice:

1. ``repartitionByRange(P, keys)`` + ``sortWithinPartitions(keys)``; tag each row with its
   partition id and ``monotonically_increasing_id`` (consecutive within a partition, in sorted
   order).
2. ``checkpoint()`` to the reliable checkpoint directory. Range bounds come from sampling, so
   a recomputation (e.g. after an executor loss) could draw different bounds; the checkpoint
   freezes one consistent assignment. Never ``localCheckpoint``: its blocks die with executors.
3. Per (partition, group): row count and first id - at most P x groups rows, combined
   map-side. A running sum over partitions gives each slice its offset.
4. ``rn = id - first_id + offset + 1``.

The sort keys must be a total order (callers append a unique key), which also makes results
reproducible: ties in a score are broken by the key, in the oracle too.

Because the range partitioner splits on the full composite key, a single value shared by a
third of all rows is spread over many tasks instead of landing in one.

Quantiles and tiles need far less than positions for all rows: ``order_statistics`` finds single
positions by bracketing them, and ``multi_ntile`` compares rows with the few bounds between tiles.
"""

from __future__ import annotations

import functools
import operator
from fractions import Fraction
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.session import checkpoint_dir, store

RN = "_rn"
N = "_n"


#: Rows that one range slice holds, about.
SLICE_ROWS = 2_000_000


def _partitions(df: DataFrame, num_partitions: int | None) -> int:
    """Slices by the rows to rank, and no fewer than an ordinary shuffle has."""
    if num_partitions:
        return num_partitions
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(1, usual, -(-df.count() // SLICE_ROWS))


def global_rank(
    df: DataFrame,
    order: list[Column],
    *,
    group_by: list[str] | None = None,
    num_partitions: int | None = None,
    bounded_groups: bool = False,
) -> DataFrame:
    """Add ``_rn`` (1-based position in ``order`` within the group) and ``_n`` (group size).

    ``bounded_groups``: the caller guarantees a fixed, small number of groups (e.g. one per
    ranked metric), so the per-(partition, group) offsets table may be broadcast.
    """
    group_by = list(group_by or [])
    checkpoint_dir(df.sparkSession)
    keys = [F.col(g).asc_nulls_first() for g in group_by] + list(order)
    staged = (
        df.repartitionByRange(_partitions(df, num_partitions), *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_mid", F.monotonically_increasing_id())
        .checkpoint(eager=True)
    )
    slices = staged.groupBy("_pid", *group_by).agg(
        F.count(F.lit(1)).alias("_cnt"), F.min("_mid").alias("_first")
    )
    running = Window.partitionBy(*group_by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group_by)
    slices = slices.withColumn("_off", F.coalesce(F.sum("_cnt").over(running), F.lit(0))).withColumn(
        N, F.sum("_cnt").over(whole)
    )
    if group_by and bounded_groups:
        # at most P x (number of groups) rows, both bounded: safe to broadcast
        joined = staged.join(F.broadcast(slices), ["_pid", *group_by])
    elif group_by:
        # one row per (partition, group): grows with the number of groups, so no hint here;
        # AQE broadcasts it only when its runtime size is under the threshold.
        cond = [staged["_pid"] == slices["_pid"]] + [staged[g].eqNullSafe(slices[g]) for g in group_by]
        joined = staged.join(slices, cond).drop(slices["_pid"])
        for g in group_by:
            joined = joined.drop(slices[g])
    else:
        # at most one row per range partition: bounded by P, safe to broadcast
        joined = staged.join(F.broadcast(slices), "_pid")
    return joined.withColumn(RN, F.col("_mid") - F.col("_first") + F.col("_off") + F.lit(1)).drop(
        "_pid", "_mid", "_first", "_cnt", "_off"
    )


def tile_of(rn: str, n: str, k: int) -> Column:
    """ntile(k) from a 1-based position: the first ``n mod k`` tiles hold one extra row.

    Integer ``div`` throughout (exact at any size). ``n div k`` is 0 only when n < k, and then
    every position is <= the cut, so the second branch never divides by zero.
    """
    base = f"({n} div {k})"
    rem = f"({n} % {k})"
    cut = f"({rem} * ({base} + 1))"
    return F.expr(
        f"cast(CASE WHEN {rn} <= {cut} THEN ({rn} - 1) div ({base} + 1) + 1 "
        f"ELSE {rem} + ({rn} - 1 - {cut}) div greatest({base}, 1) + 1 END AS int)"
    )


def distributed_ntile(
    df: DataFrame,
    k: int,
    order: list[Column],
    out: str,
    *,
    num_partitions: int | None = None,
) -> DataFrame:
    """Equivalent of ``ntile(k) OVER (ORDER BY order)`` computed by range partitions."""
    ranked = global_rank(df, order, num_partitions=num_partitions)
    return ranked.withColumn(out, tile_of(RN, N, k)).drop(RN, N)


# --- order statistics without ranking everything -------------------------------------------
#: Size of the quantile sketches that bracket a wanted position, of all rows and of a group, and the
#: rank error of a sketch of size 1 (it falls with about the 0.9th power of the size).
SKETCH, GROUP_SKETCH = 4096, 1024
SKETCH_ERROR = 2.3
#: Where no group has more rows than DIRECT, values are counted and summed up without brackets;
#: beside larger groups, those of at most WHOLE_GROUP rows are bracketed whole.
DIRECT = 200_000
WHOLE_GROUP = 10_000
#: Group sizes and brackets of so many groups are broadcast; beyond it rows meet them by shuffle,
#: those of one group spread over SALTS tasks.
BROADCAST_GROUPS = 100_000
SALTS = 32
#: Distinct values that the last step sorts for one position, and histogram bins that narrow a
#: bracket which holds more.
INSIDE = 200_000
BINS = 4096


class Wanted(NamedTuple):
    """A 1-based position in sorted order: an expression of the group size ``n``, and the share of
    the rows that lie before it, about."""

    name: str
    position: str
    share: float


def quantile_positions(qs: list[Fraction]) -> list[Wanted]:
    """The two positions that a linearly interpolated quantile lies between, for each quantile."""
    wanted = []
    for i, q in enumerate(qs):
        low = f"((n - 1) * {q.numerator}) div {q.denominator} + 1"
        step = f"if(((n - 1) * {q.numerator}) % {q.denominator} > 0, 1, 0)"
        wanted += [Wanted(f"lo{i}", low, float(q)), Wanted(f"hi{i}", f"{low} + {step}", float(q))]
    return wanted


def tile_ends(k: int) -> list[Wanted]:
    """The last position of each of the first k - 1 tiles of ``ntile(k)``."""
    return [Wanted(f"t{i}", f"{i} * (n div {k}) + least({i}, n % {k})", i / k) for i in range(1, k)]


def _same(left: list[str], right: list[str]) -> Column:
    """Null-safe equality, column by column (true without columns)."""
    return functools.reduce(operator.and_, (F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right)), F.lit(True))


def _few(rows: DataFrame, groups: int) -> DataFrame:
    """A frame with a few rows per group: broadcast while groups are few."""
    return F.broadcast(rows) if groups <= BROADCAST_GROUPS else rows


def _beside(rows: DataFrame, groups: list[str], few: DataFrame, few_groups: list[str], count: int) -> DataFrame:
    """Rows with what ``few``, a row per group, says about their group."""
    if not groups:
        return rows.crossJoin(F.broadcast(few))  # one row
    if count <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(few), _same(groups, few_groups))
    salted = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("_deal", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, _same(groups, few_groups) & (F.col("_deal") == F.col("_salt"))).drop("_deal", "_salt")


def value_sketches(rows: DataFrame, groups: list[str], size: int | None = None) -> DataFrame:
    """(groups, n, sketch) of the values ``v``: mergeable, of bounded size whatever the rows.

    Kept with each batch of a growing table, they answer for all of it without reading old
    batches again (``merge_sketches``)."""
    size = size or (GROUP_SKETCH if groups else SKETCH)
    value = F.col("v").cast("double")
    return rows.filter("v is not null").groupBy(*groups).agg(
        F.count("v").alias("n"), F.kll_sketch_agg_double(value, F.lit(size)).alias("sketch")
    )


def merge_sketches(parts: DataFrame, groups: list[str], size: int | None = None) -> DataFrame:
    """(groups, n, sketch) of the rows that several sketches have seen together."""
    size = size or (GROUP_SKETCH if groups else SKETCH)
    return parts.groupBy(*groups).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(size)).alias("sketch"))


def _bracketed(sketches: DataFrame, groups: list[str], names: list[str], wanted: list[Wanted], margin: float) -> DataFrame:
    """(groups as ``names``, n, spans, wants): per wanted position the values that should hold it."""
    shares = [x for w in wanted for x in (max(0.0, w.share - margin), min(1.0, w.share + margin))]
    cuts = F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.array(*map(F.lit, shares))))
    whole = (F.col("n") <= WHOLE_GROUP) | F.lit(margin >= 1)
    spans = F.transform(
        F.array(*[F.lit(i) for i in range(len(wanted))]),
        lambda i: F.struct(
            F.when(whole, float("-inf")).otherwise(F.get("cuts", 2 * i)).alias("low"),
            F.when(whole, float("inf")).otherwise(F.get("cuts", 2 * i + 1)).alias("high"),
        ),
    )
    wants = F.array(*[F.struct(F.lit(w.name).alias("w"), F.expr(w.position).cast("long").alias("p")) for w in wanted])
    kept = [F.col(g).alias(a) for g, a in zip(groups, names)]
    sized = sketches.select("*", cuts.alias("cuts"))
    return sized.select(*kept, "n", F.array_distinct(spans).alias("spans"), wants.alias("wants"))


def _spots(rows: DataFrame, sized: DataFrame, groups: list[str], names: list[str], count: int) -> tuple[DataFrame, DataFrame]:
    """One pass over the rows. Entries (groups, seg, v, c): the line of values cut at the spans' ends
    into segments, rows outside of every span counted by segment alone, rows inside by value; and
    for each wanted position the segment that holds it: (groups as names, w, p, n, seg, before, inside, values)."""
    value = F.col("v").cast("double")
    begun = F.size(F.filter("spans", lambda s: s["low"] <= value))
    ended = F.size(F.filter("spans", lambda s: s["high"] < value))
    placed = _beside(rows.select(*groups, "v"), groups, sized.select(*names, "spans"), names, count)
    placed = placed.select(*groups, (begun + ended).alias("seg"), F.when(begun > ended, F.col("v")).alias("v"))
    entries = store(placed.groupBy(*groups, "seg", "v").agg(F.count("*").alias("c")), "rank-entries")
    segments = entries.groupBy(*groups, "seg").agg(F.sum("c").alias("rows"), F.count("v").alias("values"))
    running = Window.partitionBy(*groups).orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    segments = segments.withColumn("before", F.coalesce(F.sum("rows").over(running), F.lit(0)))
    wants = sized.select(*names, "n", F.inline("wants"))
    # a few segments per group meet a few positions
    met = segments.join(_few(wants, count), _same(names, groups))
    held = met.filter((F.col("before") < F.col("p")) & (F.col("p") <= F.col("before") + F.col("rows")))
    return entries, store(held.select(*names, "w", "p", "n", "seg", "before", (F.col("values") > 0).alias("inside"), "values"), "rank-spots")


def _narrowed(live: DataFrame, by: list[str], count: int) -> DataFrame:
    """Values that still may be the wanted ones, by one histogram per position: the bin that holds
    the position stays, what lies under it joins ``before``."""
    value = F.col("v").cast("double")
    named = [F.col(c).alias(f"_e{i}") for i, c in enumerate(by)]
    other = [f"_e{i}" for i in range(len(by))]
    ends = live.groupBy(*by).agg(F.min(value).alias("least"), F.max(value).alias("most")).select(*named, "least", "most")
    width = F.col("most") - F.col("least")
    at = F.when(width > 0, F.least(F.floor((value - F.col("least")) / width * BINS), F.lit(BINS - 1))).otherwise(F.lit(0))
    binned = store(live.join(_few(ends, count), _same(by, other)).drop(*other).withColumn("bin", at.cast("long")), "rank-bins")
    bins = binned.groupBy(*by, "bin", "p", "before").agg(F.sum("c").alias("rows"))
    running = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("upto", F.col("before") + F.coalesce(F.sum("rows").over(running), F.lit(0)))
    held = bins.filter((F.col("upto") < F.col("p")) & (F.col("p") <= F.col("upto") + F.col("rows")))
    held = held.select(*named, F.col("bin").alias("held_bin"), "upto")
    kept = binned.join(_few(held, count), _same(by, other) & (F.col("bin") == F.col("held_bin")))
    return store(kept.drop("before").withColumnRenamed("upto", "before").select(*live.columns), "rank-live")


def _direct(rows: DataFrame, groups: list[str], wanted: list[Wanted]) -> DataFrame:
    """Order statistics of groups that a task can hold: one sort of each group's distinct values."""
    counted = rows.groupBy(*groups, "v").agg(F.count("*").alias("c"))
    whole = Window.partitionBy(*groups)
    upto = whole.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = counted.withColumn("n", F.sum("c").over(whole)).withColumn("upto", F.sum("c").over(upto))
    wants = F.array(*[F.struct(F.lit(w.name).alias("w"), F.expr(w.position).cast("long").alias("p")) for w in wanted])
    here = F.filter(wants, lambda w: (w["p"] <= F.col("upto")) & (w["p"] > F.col("upto") - F.col("c")))
    return summed.select(*groups, "v", "n", "upto", "c", F.inline(here)).select(
        *groups, "w", "v", "p", (F.col("upto") - F.col("c")).alias("before"), "n"
    )


def order_statistics(
    rows: DataFrame, groups: list[str], wanted: list[Wanted], sketches: DataFrame | None = None, margin: float | None = None
) -> DataFrame:
    """The values ``v`` at wanted positions of each group, exact: (groups, w, v, p, before, n),
    where ``before`` counts the rows under the value. Null values have no position.

    1. Quantile sketches (``value_sketches``, or given ones) bracket each position with a margin of
       twice their error.
    2. One pass counts rows under, between and inside the brackets, inside per distinct value (all
       combined map-side, so a value that a third of the rows share is one row per task).
    3. The counts tell exactly which part holds a position. If that is not its bracket, the sketch
       was wrong there: the groups concerned are bracketed anew, wider, until nothing is missed.
    4. Brackets that hold more than INSIDE values are narrowed by histograms over those values,
       a running sum over the rest finds the one that covers the position.

    Nothing is sorted, shuffled or stored but the insides of the brackets, some thousandths of the
    rows. Groups that a task can hold (DIRECT) need no brackets. ``rows`` is read three times, with
    given sketches once: pass a stored table or a cheap projection."""
    rows = rows.filter("v is not null")
    sizes = rows.groupBy(*groups).agg(F.count("v").alias("n")) if sketches is None else sketches
    if margin is None and (sizes.agg(F.max("n")).first()[0] or 0) <= DIRECT:
        return _direct(rows, groups, wanted)
    if sketches is None:
        sketches = value_sketches(rows, groups)
    size = GROUP_SKETCH if groups else SKETCH
    margin = margin or 2 * SKETCH_ERROR / size**0.9
    names = [f"_g{i}" for i in range(len(groups))]
    sized = store(_bracketed(sketches, groups, names, wanted, margin), "rank-brackets")
    count = sized.count() if groups else 1
    entries, spots = _spots(rows, sized, groups, names, count)
    missed, most = spots.agg(F.coalesce(F.max(~F.col("inside")), F.lit(False)), F.max("values")).first()
    spare = [f"_a{i}" for i in range(len(groups))]
    missing = spots.filter("not inside").select(*[F.col(n).alias(a) for n, a in zip(names, spare)]).distinct()
    placed = spots.join(missing, _same(names, spare), "left_anti") if missed else spots
    placed = placed.select(*names, "w", "p", "n", F.col("seg").alias("at_seg"), "before")
    here = (F.col("seg") == F.col("at_seg")) & F.col("v").isNotNull()
    live = entries.join(_few(placed, count), _same(groups, names) & here).select(*groups, "w", "p", "n", "before", "v", "c")
    by = [*groups, "w"]
    while most and most > INSIDE:
        live = _narrowed(live, by, count)
        left = live.groupBy(*by).agg(F.count("*").alias("values"), F.min(F.col("v").cast("double")).alias("least"), F.max(F.col("v").cast("double")).alias("most"))
        most = left.filter("least < most").agg(F.max("values")).first()[0]
    upto = Window.partitionBy(*by).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = live.withColumn("upto", F.col("before") + F.sum("c").over(upto))
    found = summed.filter((F.col("upto") >= F.col("p")) & (F.col("upto") - F.col("c") < F.col("p"))).select(
        *groups, "w", "v", "p", (F.col("upto") - F.col("c")).alias("before"), "n"
    )
    if not missed:
        return found
    if groups:
        rows, sketches = (df.join(missing, _same(groups, spare), "left_semi") for df in (rows, sketches))
    return found.unionByName(order_statistics(rows, groups, wanted, sketches, min(1.0, 16 * margin)))


def _interpolated(i: int, q: Fraction, as_double: bool) -> Column:
    """Quantile ``i`` from the values at its two positions, pivoted to columns lo and hi."""
    low, high = F.col(f"lo{i}"), F.col(f"hi{i}")
    rest = F.expr(f"((n - 1) * {q.numerator}) % {q.denominator}")
    if as_double:
        part = rest.cast("double") / F.lit(float(q.denominator))
        return low.cast("double") + (high.cast("double") - low.cast("double")) * part
    part = (rest.cast("decimal(20,0)") / F.lit(q.denominator)).cast("decimal(20,10)")
    return low + (high - low) * part


def grouped_quantiles(
    rows: DataFrame, groups: list[str], qs: list[Fraction], prefix: str, as_double: bool = False, sketches: DataFrame | None = None
) -> DataFrame:
    """Linear-interpolation quantiles (pandas ``quantile``, SQL ``quantile_cont``) of ``v`` per
    group: (groups, {prefix}0, {prefix}1, ...)."""
    found = order_statistics(rows, groups, quantile_positions(qs), sketches)
    names = [n for i in range(len(qs)) for n in (f"lo{i}", f"hi{i}")]
    wide = found.groupBy(*groups).agg(*[F.max(F.when(F.col("w") == n, F.col("v"))).alias(n) for n in names], F.max("n").alias("n"))
    return wide.select(*groups, *[_interpolated(i, q, as_double).alias(f"{prefix}{i}") for i, q in enumerate(qs)])


def exact_quantiles(df: DataFrame, value: str, qs: list[Fraction], *, prefix: str = "q", as_double: bool = False) -> DataFrame:
    """One-row frame of the quantiles of a column; nulls are ignored."""
    return grouped_quantiles(df.select(F.col(value).alias("v")), [], qs, prefix, as_double)


def grouped_quantile(
    df: DataFrame, group_by: list[str], value: str, q: Fraction, out: str, sketches: DataFrame | None = None
) -> DataFrame:
    """The quantile of a column per group, as doubles; groups without values are absent. ``sketches``
    of the same groups and values spare a pass over the rows."""
    rows = df.select(*group_by, F.col(value).cast("double").alias("v"))
    return grouped_quantiles(rows, group_by, [q], out, True, sketches).withColumnRenamed(f"{out}0", out)


# --- several metrics of the same rows ------------------------------------------------------
METRIC = "m"


def metric_rows(df: DataFrame, metrics: list[tuple[str, Column]], *keep: str) -> DataFrame:
    """One row (m, v, kept columns) per row and metric. Whole and decimal metrics take their common
    exact type; if any is a float, all are compared as doubles."""
    typed = df.select(*[c.alias(f"_{i}") for i, (_, c) in enumerate(metrics)]).schema
    floats = any(isinstance(f.dataType, (T.FloatType, T.DoubleType)) for f in typed)
    as_one = (lambda c: c.cast("double")) if floats else (lambda c: c)
    values = F.map_from_arrays(
        F.array(*[F.lit(name) for name, _ in metrics]), F.array(*[as_one(c) for _, c in metrics])
    )
    return df.select(*keep, F.explode(values).alias(METRIC, "v"))


def metric_quantiles(
    df: DataFrame, metrics: list[tuple[str, Column]], qs: list[Fraction], prefix: str, as_double: bool = False
) -> DataFrame:
    """(m, {prefix}0, ...): quantiles of each metric, nulls left out metric by metric."""
    return grouped_quantiles(metric_rows(df, metrics), [METRIC], qs, prefix, as_double)


def rank_bounds(
    df: DataFrame, key: str, metrics: list[tuple[str, Column]], wanted: list[Wanted], num_partitions: int | None = None
) -> DataFrame:
    """One-row frame: per metric and wanted position, the (value, key) pair there in the order of
    value, then key; columns ``{metric}_{name}``, structs of v and k.

    The value comes from ``order_statistics``. Only the keys of the rows that share that value are
    ranked to find the pair, in range slices, without any other column."""
    rows = metric_rows(df, metrics, key)
    found = order_statistics(rows.select(METRIC, "v"), [METRIC], wanted)
    spots = found.select(F.col(METRIC).alias("at_m"), F.col("v").alias("at_v"), "w", (F.col("p") - F.col("before")).alias("nth"))
    tied = rows.join(F.broadcast(spots), (F.col(METRIC) == F.col("at_m")) & (F.col("v") == F.col("at_v")))  # a row per bound
    ranked = global_rank(
        tied.select(METRIC, "w", "nth", "v", key), [F.col(key).asc()], group_by=[METRIC, "w"], num_partitions=num_partitions, bounded_groups=True
    )
    bounds = ranked.filter(F.col(RN) == F.col("nth"))
    return bounds.agg(
        *[
            F.max(F.when((F.col(METRIC) == m) & (F.col("w") == w.name), F.struct("v", F.col(key).alias("k")))).alias(f"{m}_{w.name}")
            for m, _ in metrics
            for w in wanted
        ]
    )


def tile_by_bounds(value: Column, key: str, bounds: list[Column]) -> Column:
    """1 + the number of bounds that the row's (value, key) lies beyond."""
    beyond = [F.when((value > b["v"]) | ((value == b["v"]) & (F.col(key) > b["k"])), 1).otherwise(0) for b in bounds]
    return (F.lit(1) + functools.reduce(operator.add, beyond)).cast("int")


def multi_ntile(
    df: DataFrame, key: str, k: int, metrics: list[tuple[str, Column, bool]], *, num_partitions: int | None = None
) -> DataFrame:
    """``ntile(k) OVER (ORDER BY metric, key)`` for several metrics (descending where the third item
    is false), added to the rows of ``df`` as columns named after the metrics.

    Only the k - 1 bounds of each metric are looked for; they come back as one broadcast row, and
    every row finds its tiles by comparison: no payload is shuffled, nothing is joined on the key.
    ``df`` is read several times: pass a stored table."""
    signed = [(name, value if ascending else -value) for name, value, ascending in metrics]
    ends = tile_ends(k)
    bounds = rank_bounds(df, key, signed, ends, num_partitions)
    scored = df.crossJoin(F.broadcast(bounds))  # one row
    tiles = {name: tile_by_bounds(value, key, [F.col(f"{name}_{w.name}") for w in ends]) for name, value in signed}
    return scored.select(*[F.col(f"`{c}`") for c in df.columns], *[t.alias(n) for n, t in tiles.items()])
