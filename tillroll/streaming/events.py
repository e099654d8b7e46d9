"""Pipeline stages and their run events.

Stages are data: a name, a function of the run's context, and the facts that its event reports.
One runner times them, records exactly one event per stage and stops at the first failure. Only
small facts (paths, counts) pass from stage to stage; rows pass through files. Counts are observed
during a stage's own write, never by a second pass.

Events are rows of one schema: ``as_events`` turns any frame of facts (a stage's outcome, the
findings of a screening, a source table) into events. They are appended as JSON Lines to the
shared event folder in one write per flush; writing telemetry never fails a run.
"""

from __future__ import annotations

import datetime as dt
import functools
import logging
import os
import socket
import time
import uuid
from collections.abc import Callable, Sequence
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.operators.clean import clean_data
from tillroll.operators.contracts import Contract, SchemaDriftError, compare, declared_frame, profile_plan, read_contract
from tillroll.operators.expectations import DataValidationError, ValidationOutcome, suite_plan
from tillroll.operators.quality import validate_tables
from tillroll.operators.star import load_star
from tillroll.schema import EVENT_SCHEMA, RAW_COLUMNS
from tillroll.sources.raw import declared_read, read_star_tables

logger = logging.getLogger(__name__)

# --- fixed values: event identity ---------------------------------------------------------
EVENT_DATASET = "retail.pipeline"
EVENT_MODULE = "etl"
EVENT_KIND = "event"
SERVICE_NAME = "tillroll"

IDENTITY = ("@timestamp", "event", "service", "host", "run")
FACT_SCHEMA = T.StructType([f for f in EVENT_SCHEMA if f.name not in IDENTITY])


def new_run_id() -> str:
    """F16: one id per pipeline run, on every event of it."""
    return os.environ.get("PIPELINE_RUN_ID") or uuid.uuid4().hex[:12]


def utc_now() -> str:
    return dt.datetime.now(dt.timezone.utc).isoformat(timespec="microseconds")


def as_events(
    facts: DataFrame, *, run_id: Column, at: Column, environment: str | None = None, host: str | None = None
) -> DataFrame:
    """V1: facts as events. Fields of the schema that the facts have are taken over by name, the
    identity (UTC time with offset, dataset, service, host, run) is added, the rest is null."""
    environment = environment or os.environ.get("PIPELINE_ENV", "local")
    identity = {
        "@timestamp": [at],
        "event": [F.lit(EVENT_DATASET), F.lit(EVENT_MODULE), F.lit(EVENT_KIND)],
        "service": [F.lit(SERVICE_NAME), F.lit(environment)],
        "host": [F.lit(host or socket.gethostname())],
        "run": [run_id],
    }

    def field(f: T.StructField) -> Column:
        if f.name in identity:
            values = identity[f.name]
        elif f.name not in facts.columns:
            return F.lit(None).cast(f.dataType).alias(f.name)
        elif isinstance(f.dataType, T.StructType):
            have = facts.schema[f.name].dataType.fieldNames()
            values = [F.col(f"`{f.name}`.`{n}`") if n in have else F.lit(None) for n in f.dataType.fieldNames()]
        else:
            values = [F.col(f"`{f.name}`")]
        if not isinstance(f.dataType, T.StructType):
            return values[0].cast(f.dataType).alias(f.name)
        filled = F.struct(*[v.cast(s.dataType).alias(s.name) for v, s in zip(values, f.dataType)])
        given = F.lit(True) if f.name in identity else F.col(f"`{f.name}`").isNotNull()
        return F.when(given, filled).alias(f.name)

    return facts.select(*map(field, EVENT_SCHEMA))


def to_json_lines(events: DataFrame) -> DataFrame:
    """One JSON line per event; null fields are left out."""
    return events.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in events.columns])).alias("value"))


class RunLog:
    """K8: the events of one run. ``flush`` appends what is new to ``path`` and never raises."""

    def __init__(self, spark: SparkSession, path: str | None = None, run_id: str | None = None):
        self.spark = spark
        self.path = path
        self.run_id = run_id or new_run_id()
        self._all: list[DataFrame] = []
        self._written = 0

    def add(self, facts: DataFrame) -> None:
        self._all.append(as_events(facts, run_id=F.lit(self.run_id), at=F.lit(utc_now())))

    def record(self, stage: str, outcome: str, **facts: Any) -> None:
        self.add(self.spark.createDataFrame([{"stage": stage, "outcome": outcome, **facts}], FACT_SCHEMA))

    def _union(self, frames: list[DataFrame]) -> DataFrame:
        empty = self.spark.createDataFrame([], EVENT_SCHEMA)
        return functools.reduce(DataFrame.unionByName, frames, empty)

    def frame(self) -> DataFrame:
        """All events so far, written or not."""
        return self._union(self._all)

    def flush(self) -> bool:
        new = self._all[self._written :]
        if not new or self.path is None:
            return False
        try:
            to_json_lines(self._union(new)).coalesce(1).write.mode("append").text(self.path)
        except Exception:  # noqa: BLE001 - telemetry must never fail the pipeline
            logger.warning("run events could not be written to %s", self.path, exc_info=True)
            return False
        self._written = len(self._all)
        return True

    def read(self) -> DataFrame:
        """The events as the written log has them."""
        return self.spark.read.schema(EVENT_SCHEMA).json(self.path)


class Stage(NamedTuple):
    name: str
    work: Callable[[dict[str, Any]], dict[str, Any]]
    reported: Sequence[str]


def run_stages(stages: Sequence[Stage], context: dict[str, Any], log: RunLog) -> dict[str, Any]:
    """V3 + V10: the stages in turn; ``context`` collects each one's facts under its name.

    Every stage that began has one event with its duration and reported facts, also the one that
    failed (its error is raised again); the log is flushed once, in either case."""
    context["log"] = log
    try:
        for stage in stages:
            began, error, facts = time.perf_counter(), None, {}
            try:
                facts = stage.work(context)
            except Exception as e:
                error, facts = e, getattr(e, "facts", {})
                raise
            finally:
                log.record(
                    stage.name,
                    "failure" if error else "success",
                    duration_ms=round(1000 * (time.perf_counter() - began), 2),
                    metrics={k: facts[k] for k in stage.reported if k in facts},
                    error={"type": type(error).__name__, "message": str(error)} if error else None,
                )
            context[stage.name] = facts
    finally:
        log.flush()
    return context


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``df`` with an observation of its rows, to be read after the write that runs it."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


# --- the stages ----------------------------------------------------------------------------
def extract(context: dict[str, Any]) -> dict[str, Any]:
    """The raw batch landed once, so that later stages read a file."""
    path = f"{context['work']}/raw"
    batch, seen = counted(context["raw"].select(*RAW_COLUMNS), "extract")
    batch.write.mode("overwrite").parquet(path)
    return {"path": path, "rows_written": int(seen.get["rows"])}


def screening(df: DataFrame, contract: Contract | None = None) -> tuple[DataFrame, DataFrame]:
    """Contract findings and expectation outcomes as frames, from one pass over ``df``: its one
    aggregate row is all that leaves the cluster."""
    spark = df.sparkSession
    aggregates, profiles = profile_plan(df)
    more, outcomes = suite_plan(df)
    one = df.agg(*aggregates, *more).select(profiles.alias("profiles"), F.array(*outcomes).alias("outcomes"))
    one = spark.createDataFrame(one.collect(), one.schema)
    findings = compare(one.select(F.inline("profiles")), declared_frame(spark, contract or read_contract()))
    return findings, one.select(F.inline("outcomes"))


def finding_facts(stage: str, findings: DataFrame, outcomes: DataFrame) -> DataFrame:
    """V2: a fact per contract finding and per failed expectation."""
    drift = findings.select(
        F.struct(F.lit("schema_drift").alias("category"), "kind", "severity", "column", "detail").alias("finding")
    )
    seen = F.coalesce(F.col("observed").cast("decimal(20,6)").cast("string"), F.lit("nothing"))
    failed = outcomes.filter(~F.col("success")).select(
        F.struct(
            F.lit("expectation").alias("category"),
            F.col("expectation").alias("kind"),
            F.lit("breaking").alias("severity"),
            "column",
            F.concat(F.lit("saw "), seen).alias("detail"),
        ).alias("finding")
    )
    return drift.unionByName(failed).select(F.lit(stage).alias("stage"), F.lit("finding").alias("outcome"), "finding")


def screen(context: dict[str, Any]) -> dict[str, Any]:
    """G1: contract and expectations, both always judged and logged; drift is raised first."""
    spark, landed = context["raw"].sparkSession, context.get("extract")
    batch = declared_read(spark, landed["path"], check_files=False) if landed else context["raw"]
    findings, outcomes = screening(batch, context.get("contract"))
    context["log"].add(finding_facts("screen", findings, outcomes))
    found = findings.orderBy("place", "kind").collect()  # a few rows per column
    judged = ValidationOutcome([r.asDict() for r in outcomes.orderBy("expectation_order").collect()])
    breaking = sum(f["severity"] == "breaking" for f in found)
    rows = next(o["observed"] for o in judged.results if o["expectation"] == "expect_table_row_count_to_be_between")
    facts = {
        "rows": int(rows),
        "breaking_drift": breaking,
        "additive_drift": len(found) - breaking,
        "expectations_run": len(judged.results),
        "expectations_failed": len(judged.failures),
    }
    if context.get("enforce", True) and breaking:
        raise SchemaDriftError(found, facts)
    if context.get("enforce", True) and judged.failures:
        raise DataValidationError(judged, facts)
    return facts


def clean_into(raw: DataFrame, path: str) -> dict[str, Any]:
    """K3: the cleaned batch written to ``path``, with the rows before and after."""
    given, seen = counted(raw, "raw rows")
    cleaned, kept = counted(clean_data(given), "clean rows")
    cleaned.write.mode("overwrite").parquet(path)
    before, after = int(seen.get["rows"]), int(kept.get["rows"])
    return {
        "path": path,
        "rows_in": before,
        "rows_out": after,
        "rows_dropped": before - after,
        "pct_dropped": round(100 * (before - after) / before, 1) if before else 0.0,
    }


def transform(context: dict[str, Any]) -> dict[str, Any]:
    spark = context["raw"].sparkSession
    return clean_into(declared_read(spark, context["extract"]["path"], check_files=False), f"{context['work']}/interim")


def load(context: dict[str, Any]) -> dict[str, Any]:
    """The star from the interim file; a missing file is an error."""
    root = f"{context['work']}/star"
    counts = load_star(context["raw"].sparkSession.read.parquet(context["transform"]["path"]), root)
    return {**counts, "path": root, "rows_written": counts["transactions"]}


def validate(context: dict[str, Any]) -> dict[str, Any]:
    """The quality suite over the loaded star; the rows it must hold are those transform kept."""
    expected = context["transform"]["rows_out"]
    tables = read_star_tables(context["raw"].sparkSession, context["load"]["path"])
    report = validate_tables(*tables, **{"min_rows": expected, "max_rows": expected, **context.get("window", {})})
    return {"rows": context["load"]["transactions"], "report": report}


PIPELINE = (
    Stage("extract", extract, ("rows_written",)),
    Stage("screen", screen, ("rows", "breaking_drift", "additive_drift", "expectations_run", "expectations_failed")),
    Stage("transform", transform, ("rows_in", "rows_out", "rows_dropped", "pct_dropped")),
    Stage("load", load, ("rows_written",)),
    Stage("validate", validate, ("rows",)),
)


def run_pipeline(raw: DataFrame, work: str, log: RunLog, **options: Any) -> dict[str, Any]:
    """All stages over a raw batch. Options: ``window`` (of the quality suite), ``contract``."""
    return run_stages(PIPELINE, {"raw": raw, "work": work, **options}, log)
