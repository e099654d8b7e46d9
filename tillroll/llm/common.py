"""Shared helpers of the training-data operators: table access, word rules, stored intermediates."""

from __future__ import annotations

import atexit
import sys
import uuid
from collections.abc import Callable, Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.session import checkpoint_dir

QueryFn = Callable[[SparkSession, str], DataFrame]

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows in one Arrow batch handed to Python: bounds a worker's memory when texts are long.
ARROW_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, every other character untouched."""
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of words as a long; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ship_by_value(module_name: str) -> None:
    """Pickle a module's functions, and these helpers, by value: executors need no copy of the
    package."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound the rows per Arrow batch: whole texts travel in them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


_RUN = f"llm-{uuid.uuid4().hex[:12]}"
_cleaned: set[str] = set()


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001 - the session is already gone at interpreter exit
        return


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    The folder is the one the session names in ``spark.checkpoint.dir``: the files outlive any
    executor, and lineage is cut there. The run's folder is removed when the driver ends."""
    spark = df.sparkSession
    run = f"{checkpoint_dir(spark).rstrip('/')}/{_RUN}"
    if run not in _cleaned:
        _cleaned.add(run)
        atexit.register(_remove, spark, run)
    path = f"{run}/{name}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._stash_path = path
    return stored


def drop_stash(stored: DataFrame) -> None:
    """Remove the files of a stash that nothing will read any more, as those of a past iteration."""
    _remove(stored.sparkSession, stored._stash_path)


def texts_of(batch) -> Iterator[str]:
    """The texts of a column; null counts as empty."""
    return ("" if t is None or t != t else t for t in batch)


def arrow_types(schema: str) -> dict:
    """Arrow types by name of a schema string of long, int, string, boolean and binary columns."""
    import pyarrow as pa

    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    return {name: kinds[kind] for name, kind in (column.split() for column in schema.split(", "))}


def beside_ids(judge: Callable, schema: str, kept: int = 1) -> Callable:
    """A mapInArrow function: ``judge`` turns the texts of a batch (its last column) into rows, and
    the ``kept`` columns before pass as Arrow has them.

    Ids never go through pandas: a null among them would make them doubles, which hold no
    integer beyond 2**53 exactly. ``judge`` is made anew for each task."""
    types = arrow_types(schema)

    def judged(batches):
        import pyarrow as pa

        rows_of = judge()
        own = list(types.items())[kept:]
        for batch in batches:
            rows = rows_of(list(texts_of(batch.column(kept).to_pylist())))
            columns = list(zip(*rows)) or [()] * len(own)
            arrays = [pa.array(values, type=kind) for values, (_, kind) in zip(columns, own)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], *arrays], names=list(types))

    return judged
