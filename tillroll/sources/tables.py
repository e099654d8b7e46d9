"""Stored tables: one writer for all loads, and versions that count once they are finished.

A folder that a job wrote to its end holds a mark of success. A table with versions is a folder of
such folders (``v=<n>``): a reader takes the newest finished one, so a load that is under way or
died midway is never seen, and nothing is replaced under a reader's feet. The version before the
newest is kept for those who are still reading it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SUCCESS = "_SUCCESS"


def _at(spark: SparkSession, path: str):
    """A path's file system and the path, as Hadoop has them."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    system, place = _at(spark, path)
    return system.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    system, place = _at(spark, path)
    system.delete(place, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders right under a path; none if it isn't there."""
    system, place = _at(spark, path)
    if not system.exists(place):
        return []
    return sorted(s.getPath().getName() for s in system.listStatus(place) if s.isDirectory())


def numbered(spark: SparkSession, path: str, prefix: str, *, finished: bool = True) -> list[int]:
    """The numbers of the folders ``<prefix><n>`` under a path, rising; only finished ones, or all."""
    found = [n for n in folders(spark, path) if n.startswith(prefix) and n[len(prefix) :].isdigit()]
    kept = [n for n in found if not finished or exists(spark, f"{path}/{n}/{SUCCESS}")]
    return sorted(int(n[len(prefix) :]) for n in kept)


def write_table(
    df: DataFrame,
    path: str,
    *,
    by: list[str] | None = None,
    mode: str = "overwrite",
    count: bool = False,
    gathered: bool = False,
) -> int | None:
    """Write a table as Parquet; with ``count``, the rows written, observed during the write.

    With ``by``, rows are gathered by those columns before they go to a folder per value: AQE then
    sizes the tasks by what it measured, many small values to a task and a large one to several.
    Without it every task would leave a file in every folder; ``gathered`` rows need none of it."""
    seen = Observation("rows written") if count else None
    if seen:
        df = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    if by:
        (df if gathered else df.hint("rebalance", *by)).write.partitionBy(*by).mode(mode).parquet(path)
    else:
        df.write.mode(mode).parquet(path)
    return int(seen.get["rows"]) if seen else None


def newest(spark: SparkSession, path: str) -> str:
    """The folder of the newest finished version; the path itself for a table without versions."""
    versions = numbered(spark, path, "v=")
    return f"{path}/v={versions[-1]}" if versions else path


def publish(df: DataFrame, path: str) -> int:
    """Write the next version of a table and drop those before the last one; returns its rows."""
    spark = df.sparkSession
    done = numbered(spark, path, "v=")
    number = 1 + max(numbered(spark, path, "v=", finished=False), default=0)
    rows = write_table(df, f"{path}/v={number}", count=True)
    for old in numbered(spark, path, "v=", finished=False):
        if old < (done[-1] if done else number):
            remove(spark, f"{path}/v={old}")
    return rows
