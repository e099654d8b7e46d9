"""Session construction and shared-storage locations.

The session is configured once, identically for jobs, tests and the bench: UTC, ANSI on,
adaptive execution with skew-join handling, and a reliable checkpoint directory.

Shared storage: jobs that cut lineage (``checkpoint()``) or write lake tables use the folder
the cluster names in ``spark.checkpoint.dir``; a cluster without it is refused. Only where it is
unset *and* the master is one local JVM (tests, the bench) is a folder of our own made, which
goes when the driver ends.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import shutil
import sys
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BRONZE = "bronze"
SILVER = "silver"
GOLD = "gold"
INTERIM = "interim"
LANDING = "landing"
MARTS = "marts"
STAR = "star"
EVENTS = "events"

_LAKE_ROOT_CONF = "spark.tillroll.lake.root"


def build_session(
    app_name: str = "tillroll",
    *,
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """A session with the settings every job in this package relies on.

    ``shuffle_partitions`` is a starting value for joins and aggregates: AQE coalesces small
    post-shuffle partitions and splits skewed ones. Ranked slices take their number from the
    rows to rank (``operators.rank``), as AQE leaves an explicit number alone.
    """
    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    os.environ.setdefault("PYSPARK_DRIVER_PYTHON", sys.executable)
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.parquet.datetimeRebaseModeInWrite": "CORRECTED",
        "spark.sql.parquet.datetimeRebaseModeInRead": "CORRECTED",
        "spark.sql.ansi.enabled": "true",
        "spark.ui.enabled": os.environ.get("SPARK_UI", "false"),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # arg-min aggregates over text (deterministic dedupe / mode) plan as SortAggregate
        "spark.sql.codegen.aggregate.sortAggregate.enabled": "true",
        # remove reliable-checkpoint files once the checkpointed frame is garbage collected
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ensure_session_defaults(spark)
    return spark


def ensure_session_defaults(spark: SparkSession) -> None:
    """Settings the operators' semantics depend on, applied to any session handed to us.

    Dates are bucketed in UTC (``to_date`` of a timestamp depends on the session zone), and a
    reliable checkpoint directory must exist before any ``checkpoint()``.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.parquet.datetimeRebaseModeInWrite", "CORRECTED")
    checkpoint_dir(spark)


def _is_local(spark: SparkSession) -> bool:
    """One JVM on one machine (``local``, ``local[n]``): not a cluster of any kind."""
    return re.match(r"local(\[|$)", spark.sparkContext.master) is not None


def _remove_at_exit(spark: SparkSession, folder: str) -> None:
    """Remove a folder of this run when the driver ends, wherever its file system is."""

    def remove() -> None:
        with contextlib.suppress(Exception):  # the session may be gone already
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    atexit.register(remove)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared, reliable folder for checkpoints and written intermediate tables.

    Read from the session (``spark.checkpoint.dir`` or a directory already set on the
    context). A local scratch folder is created only for local masters where nothing is set.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not _is_local(spark):
        raise RuntimeError(
            "spark.checkpoint.dir is not set: a shared, reliable folder is required on a cluster"
        )
    scratch = tempfile.mkdtemp(prefix="tillroll-ckpt-")
    atexit.register(shutil.rmtree, scratch, ignore_errors=True)
    sc.setCheckpointDir(scratch)
    return sc.getCheckpointDir() or scratch


def lake_root(spark: SparkSession, root: str | None = None) -> str:
    """Lake location: explicit argument > session conf > ``LAKE_ROOT`` env > shared folder."""
    if root:
        return root.rstrip("/")
    configured = spark.conf.get(_LAKE_ROOT_CONF, None) or os.environ.get("LAKE_ROOT")
    if configured:
        return configured.rstrip("/")
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/lake"


def lake_path(spark: SparkSession, layer: str, table: str, root: str | None = None) -> str:
    """Location of a table within the lake."""
    return f"{lake_root(spark, root)}/{layer}/{table}"


_RUN = uuid.uuid4().hex[:12]
_runs: set[str] = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never-reused location in shared storage for one run of one job.

    Everything this driver writes there (materialised layers, stream inboxes and checkpoints of
    one-off runs) lies in one folder of its own, which is removed when the driver ends; no later
    run reads it. A driver that is killed leaves its folder to the storage's lifecycle rule."""
    run = f"{lake_root(spark)}/runs/{_RUN}"
    if run not in _runs:
        _runs.add(run)
        _remove_at_exit(spark, run)
    return f"{run}/{name}-{uuid.uuid4().hex[:12]}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write a derived table once to shared storage and read it back, where several parts of a job
    read it with different columns."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
