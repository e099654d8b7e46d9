"""Whitening of embeddings on their main components, by blockwise QR and a bidiagonal qd solver.

Vectors are taken in whole steps of 1/256. The fit list holds every distinct vector once; its size
and sums are exact integers. Every task reduces its centred rows, block by block, to a triangular
factor; the factors of the tasks are reduced in groups of bounded size until one is left. That
factor, of order dimensions squared, is all that the driver sees of the rows. ``bidiagonal`` finds
its singular values and the right singular vectors: the components, falling by variance. Then
every row is centred, projected and scaled to unit variance.

Defined results: a row is left out if its vector is null or holds null or non-finite entries, or
if its length is not the table's most frequent one (of equally frequent ones the greatest; empty
vectors have no components). Repeated rows give repeated results and count once in the fit. There
are at most as many components as dimensions. A component without variance (below rounding) has a
null ``whitened``. Entries beyond the range of a long saturate; a ``deviation`` of more than 38
digits is null (in the query: one beyond a long). A null vec_id stays null. An empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import bidiagonal
from tillroll.llm.common import ship_by_value, stash, table

STEPS = 256
COMPONENTS = 4
#: Rows reduced at once in a task.
BLOCK = 4096
#: Bytes of triangular factors that one task may stack.
STACK_BYTES = 32 << 20
#: Whole numbers of up to so many digits fit a decimal.
MOST = 10**38 - 1

FACTOR = "part long, factor array<double>"
PROJECTED = "vec_id long, deviation decimal(38,0), whitened array<double>"


@dataclass(frozen=True)
class Whitening:
    """What a fit leaves: bounded by the number of dimensions."""

    n: int
    sums: list[int]
    #: One column per component with variance: its direction over the square root of the variance.
    scaled: np.ndarray
    explained: list[float | None]
    identity_error: float | None

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums], dtype=np.float64)


def in_steps(rows: DataFrame, vector: str, steps: int = STEPS) -> DataFrame:
    """(vec_id, x): the usable vectors, in whole steps."""
    entry = F.col(vector)
    finite = F.forall(entry, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    return rows.filter(entry.isNotNull() & finite).select(
        F.col("vec_id").cast("long"), F.transform(entry, lambda c: F.floor(c.cast("double") * steps)).alias("x")
    )


def matrix(column, d: int) -> np.ndarray:
    """The vectors of an Arrow column as rows."""
    return np.asarray(column.flatten()).reshape(-1, d)


def _summing(d: int):
    """mapInArrow: rows and exact sums of a task's vectors."""

    def summed(batches):
        from decimal import Decimal

        import pyarrow as pa

        n, sums = 0, [0] * d
        for batch in batches:
            x = matrix(batch.column(0), d)
            n += len(x)
            # two halves, so that no sum of a batch leaves a long
            high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
            sums = [s + (int(h) << 32) + int(w) for s, h, w in zip(sums, high, low)]
        places = pa.array([*range(d), d], pa.int32())
        yield pa.RecordBatch.from_arrays(
            [places, pa.array([Decimal(s) for s in [*sums, n]], pa.decimal128(38, 0))], names=["place", "total"]
        )

    return summed


def reduced(rows: np.ndarray, d: int) -> np.ndarray:
    """The triangular factor of a block of rows, d by d."""
    factor = np.linalg.qr(rows, mode="r")
    return np.vstack([factor, np.zeros((d - len(factor), d))]) if len(factor) < d else factor


def _factoring(mean: np.ndarray):
    """mapInArrow: the triangular factor of a task's centred vectors."""
    d = len(mean)

    def factored(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        factor = None
        for batch in batches:
            x = matrix(batch.column(0), d)
            for at in range(0, len(x), BLOCK):
                block = x[at : at + BLOCK] - mean
                factor = reduced(block if factor is None else np.vstack([factor, block]), d)
        if factor is not None:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict({"part": [part], "factor": [factor.ravel()]})

    return factored


def _stacking(d: int, fan: int):
    """applyInPandas: one factor for the factors of a group."""

    def stacked(group):
        import pandas as pd

        rows = np.vstack([np.asarray(f).reshape(d, d) for f in group["factor"]])
        return pd.DataFrame({"part": [int(group["part"].iloc[0]) // fan], "factor": [reduced(rows, d).ravel()]})

    return stacked


def triangular_factor(fit: DataFrame, mean: np.ndarray, fan: int | None = None) -> np.ndarray:
    """R of the centred rows of ``fit`` (x): R'R is their scatter.

    At most ``fan`` factors meet in a task, so its memory follows the dimensions alone."""
    d = len(mean)
    fan = fan or max(2, min(64, STACK_BYTES // (8 * d * d)))
    factors = stash(fit.mapInArrow(_factoring(mean), FACTOR), "whitening-factors")
    last = factors.agg(F.max("part")).first()[0]
    while last > 0:
        factors = factors.groupBy(F.floor(F.col("part") / fan).alias("of")).applyInPandas(_stacking(d, fan), FACTOR)
        last //= fan
    return np.asarray(factors.first()["factor"]).reshape(d, d)


def _projecting(mean: np.ndarray, scaled: np.ndarray):
    """mapInArrow: a task's sums of products of the whitened vectors."""
    d, k = scaled.shape

    def multiplied(batches):
        import pyarrow as pa

        products = np.zeros((k, k))
        for batch in batches:
            white = (matrix(batch.column(0), d) - mean) @ scaled
            products += white.T @ white
        yield pa.RecordBatch.from_pydict({"place": pa.array(range(k * k), pa.int32()), "total": products.ravel()})

    return multiplied


def fit_whitening(vectors: DataFrame, *, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of vectors (x) in whole steps, each distinct one counted once; None without any.

    All vectors have one length above 0."""
    ship_by_value(__name__)
    fit = stash(vectors.select("x").distinct(), "whitening-fit")
    first = fit.select(F.size("x")).first()
    if first is None:
        return None
    d = first[0]
    totals = fit.mapInArrow(_summing(d), "place int, total decimal(38,0)").groupBy("place").agg(F.sum("total").alias("total"))
    sums = [int(r["total"]) for r in totals.orderBy("place").collect()]
    n = sums.pop()
    mean = np.array([s / n for s in sums], dtype=np.float64)
    values, directions = bidiagonal.singular_pairs(triangular_factor(fit, mean))
    k = min(components, d)
    trace = float(values @ values)
    whole = values[:k] > d * bidiagonal.EPS * values[0]
    shares = [float(v * v / trace) if trace else None for v in values[:k]]
    directions = directions[:, :k] * np.sign(directions[np.abs(directions[:, :k]).argmax(axis=0), range(k)])
    scaled = directions[:, whole] * (np.sqrt(n) / values[:k][whole])
    error = None
    m = int(whole.sum())
    if m:
        products = fit.mapInArrow(_projecting(mean, scaled), "place int, total double").groupBy("place").agg(F.sum("total"))
        covariance = np.array([r[1] for r in products.orderBy("place").collect()]).reshape(m, m) / n
        error = float(np.abs(covariance - np.eye(m)).max())
    return Whitening(n, sums, scaled, shares, error)


def _applying(n: int, sums: list[int], mean: np.ndarray, scaled: np.ndarray, k: int):
    """mapInArrow: exact deviation and whitened components of every row."""
    d = len(sums)
    own = sum(s * s for s in sums)
    largest = max(map(abs, sums), default=0)

    def applied(batches):
        from decimal import Decimal

        import pyarrow as pa

        for batch in batches:
            x = matrix(batch.column(1), d)
            white = np.full((len(x), k), np.nan)
            white[:, : scaled.shape[1]] = (x - mean) @ scaled
            most = max(-int(x.min()), int(x.max()), 1) if x.size else 0
            exact = x if d * most * max(most, largest) < 2**62 else x.astype(object)
            squares = (exact * exact).sum(axis=1).tolist()
            crossed = (exact * np.array(sums, dtype=exact.dtype)).sum(axis=1).tolist()
            deviations = [n * n * a - 2 * n * b + d_own for a, b, d_own in zip(squares, crossed, [own] * len(x))]
            whitened = pa.array(white.ravel(), pa.float64(), from_pandas=True)  # NaN: no variance
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([Decimal(v) if v <= MOST else None for v in deviations], pa.decimal128(38, 0)),
                    pa.ListArray.from_arrays(offsets, whitened),
                ],
                names=["vec_id", "deviation", "whitened"],
            )

    return applied


def whiten(rows: DataFrame, *, vector: str = "embedding", components: int = COMPONENTS, steps: int = STEPS) -> DataFrame:
    """For each usable row and component: vec_id, component, n, deviation (decimal), whitened,
    explained, identity_error. The fit runs when the frame is built."""
    spark = rows.sparkSession
    ship_by_value(__name__)
    usable = in_steps(rows, vector, steps)
    length = usable.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    schema = (
        "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    )
    usable = usable.filter(F.size("x") == (length["d"] if length else 0))
    model = fit_whitening(usable, components=components) if length and length["d"] else None
    if model is None:
        return spark.createDataFrame([], schema)
    k = len(model.explained)
    applied = usable.mapInArrow(_applying(model.n, model.sums, model.mean, model.scaled, k), PROJECTED)
    shares = F.array(*(F.lit(share).cast("double") for share in model.explained))
    return applied.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("at")).alias("explained"),
        F.lit(model.identity_error).cast("double").alias("identity_error"),
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable embedding on its first four whitened components."""
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))


QUERIES = {"op13_whitening": op13_whitening}
ORACLES: dict[str, str] = {}
