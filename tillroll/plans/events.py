"""Registry: run events, event analyses, streaming ingest of events and database logs."""

from __future__ import annotations

import functools
import json
import uuid
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.operators.rank import grouped_quantile
from tillroll.plans import oracle as O
from tillroll.plans.catalog import query, raw
from tillroll.plans.checks import WINDOW, drifted_batch
from tillroll.schema import EVENT_SCHEMA
from tillroll.session import ensure_session_defaults, scratch_path
from tillroll.sources.raw import read_table
from tillroll.streaming import ingest as I
from tillroll.streaming.batches import BatchLog
from tillroll.streaming.events import PIPELINE, RunLog, finding_facts, run_pipeline, screening, to_json_lines
from tillroll.streaming.tail import ship, storage

EVENT_COLS = ["event_id", "ts", "user_id", "event_type", "value"]

# --- fixed values: malformed inputs planted next to the derived ones ----------------------
BAD_EVENT_LINES = [
    '{"@timestamp": "2024-01-01T00:00:00.000000+00:00", "stage": "load", "outcome": "success"',
    '{"@timestamp": "2024-01-01T00:00:00.000000+00:00", "stage": "load", "outcome": "success", "shipper": "x"}',
    '{"@timestamp": "2024-13-45T99:00:00.000000+00:00", "stage": "load", "outcome": "success"}',
    '{"@timestamp": "2024-01-01T00:00:00.000000+00:00", "stage": "load", "outcome": "success", "duration_ms": "abc"}',
    '{"@timestamp": "2024-01-01T00:00:00.000000+00:00", "stage": "load", "metrics": {"rows": "many"}}',
    '{"stage": "load", "outcome": "success"}',
]
REJECT_REASONS = [
    "malformed_json",
    "undeclared_field: shipper",
    "bad_timestamp",
    "wrong_type: duration_ms",
    "wrong_type: metrics.rows",
    "bad_timestamp",
]
#: A record with every declared field, to show that the sink keeps all of them.
FULL_EVENT = {
    "@timestamp": "2024-01-01T00:00:00.000000+00:00",
    "event": {"dataset": "d", "module": "m", "kind": "k"},
    "service": {"name": "n", "environment": "e"},
    "host": {"name": "h"},
    "run": {"id": "full"},
    "stage": "screen",
    "outcome": "finding",
    "duration_ms": 1.5,
    "metrics": {f.name: i if f.name != "pct_dropped" else 0.5 for i, f in enumerate(EVENT_SCHEMA["metrics"].dataType)},
    "finding": {"category": "c", "kind": "k", "severity": "s", "column": "Country", "detail": "d"},
    "error": {"type": "t", "message": "m"},
    "log": {"level": "l", "logger": "g", "message": "m", "source": "s"},
    "database": {"duration_ms": 2.5, "statement": "select 1", "pid": 7},
}
BAD_DB_LINES = [
    "FATAL something went wrong without a prefix",
    "2024-01-01 00:00:00.000 UTC [17] LOG:  connection received: host=10.0.0.1",
    "2024-01-01 00:00:00.000 UTC [17] LOG:  duration: n/a ms  select 1",
    "2024-01-01T02:00:00,250+02:00 [17] LOG:  checkpoint starting",
    "2024-01-01T00:00:00Z [17] LOG:  checkpoint complete",
    "2023-12-31 19:00:00.5-05 [17] WARNING:  x",
    "2024-99-01 00:00:00 UTC [17] LOG:  y",
]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_session_defaults(spark)  # hours and dates are bucketed in UTC
    return read_table(spark, sf_dir, "events", EVENT_COLS)


def _records_sql() -> str:
    return """SELECT CAST(ts AS TIMESTAMP) AS event_ts, event_type AS stage,
       CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS outcome,
       CAST(value AS DOUBLE) AS duration_ms, CAST(user_id AS VARCHAR) AS run_id,
       'retail.pipeline' AS dataset, 'tillroll' AS service"""


STAGE_EVENTS_SQL = O.with_ctes(O.STANDARDIZED, O.CLEAN) + """SELECT * FROM (
    SELECT 0 AS stage_order, 'extract' AS stage, 'success' AS outcome, CAST(NULL AS BIGINT) AS rows,
           CAST(NULL AS BIGINT) AS rows_in, CAST(NULL AS BIGINT) AS rows_out, CAST(NULL AS BIGINT) AS rows_dropped,
           CAST(NULL AS DOUBLE) AS pct_dropped, count(*) AS rows_written,
           NULL AS breaking_drift, NULL AS additive_drift, NULL AS expectations_run, NULL AS expectations_failed
    FROM retail_raw
    UNION ALL
    SELECT 1 AS stage_order, 'screen' AS stage, 'success' AS outcome, count(*) AS rows,
           CAST(NULL AS BIGINT) AS rows_in, CAST(NULL AS BIGINT) AS rows_out, CAST(NULL AS BIGINT) AS rows_dropped,
           CAST(NULL AS DOUBLE) AS pct_dropped, CAST(NULL AS BIGINT) AS rows_written,
           0 AS breaking_drift, 0 AS additive_drift, 13 AS expectations_run, 0 AS expectations_failed
    FROM retail_raw
    UNION ALL
    SELECT 2, 'transform', 'success', NULL, r.n, c.n, r.n - c.n, round(100.0 * (r.n - c.n) / r.n, 1), NULL,
           NULL, NULL, NULL, NULL
    FROM (SELECT count(*) AS n FROM retail_raw) r, (SELECT count(*) AS n FROM clean) c
    UNION ALL
    SELECT 3, 'load', 'success', NULL, NULL, NULL, NULL, NULL, count(*), NULL, NULL, NULL, NULL FROM clean
    UNION ALL
    SELECT 4, 'validate', 'success', count(*), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM clean
)"""


@query("stage_events", STAGE_EVENTS_SQL, "V1,V3,V10,F16,K8")
def stage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run extract -> screen -> transform -> load -> validate over the whole batch and read the
    run's log back; one event per stage (clock times and host are left out of the result)."""
    work = scratch_path(spark, "pipeline")
    log = RunLog(spark, f"{work}/events")
    run_pipeline(raw(spark, sf_dir), work, log, window=WINDOW)
    order = F.array_position(F.array(*[F.lit(s.name) for s in PIPELINE]), F.col("stage")) - 1
    metrics = (
        "rows rows_in rows_out rows_dropped pct_dropped rows_written breaking_drift additive_drift "
        "expectations_run expectations_failed"
    ).split()
    return (
        log.read()
        .filter(F.col("outcome") != "finding")
        .select(order.cast("int").alias("stage_order"), "stage", "outcome", *[F.col(f"metrics.{m}").alias(m) for m in metrics])
    )


FINDING_SQL = O.with_ctes() + """, n AS (SELECT count_if(Quantity = 0) AS zero FROM retail_raw)
SELECT 'screen' AS stage, 'finding' AS outcome, category, kind, severity, "column", detail
FROM (
    SELECT 'schema_drift' AS category, 'type_change' AS kind, 'breaking' AS severity, 'Quantity' AS "column",
           'integer declared, string found' AS detail
    UNION ALL SELECT 'schema_drift', 'unexpected_nulls', 'breaking', 'UnitPrice', zero || ' nulls in a required column'
           FROM n WHERE zero > 0
    UNION ALL SELECT 'schema_drift', 'missing_column', 'breaking', 'Country', 'the batch lacks it'
    UNION ALL SELECT 'schema_drift', 'new_column', 'additive', 'SalesChannel', 'the contract does not know it'
    UNION ALL SELECT 'expectation', 'expect_table_columns_to_match_set', 'breaking', NULL, 'saw 1.000000'
    UNION ALL SELECT 'expectation', 'expect_column_values_to_not_be_null', 'breaking', 'UnitPrice',
           'saw ' || CAST(zero AS DECIMAL(20,6)) FROM n WHERE zero > 0
    UNION ALL SELECT 'expectation', 'expect_column_values_to_not_be_null', 'breaking', 'Country', 'saw nothing'
    UNION ALL SELECT 'expectation', 'expect_column_values_to_not_be_null', 'breaking', 'CustomerID', 'saw 0.000000'
    UNION ALL SELECT 'expectation', 'expect_column_unique_value_count_to_be_between', 'breaking', 'Country', 'saw nothing'
)"""


@query("finding_events", FINDING_SQL, "V2,A22")
def finding_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Screen the drifted batch without enforcing: one event per contract finding and per failed
    expectation, written to the run's log and read back."""
    log = RunLog(spark, scratch_path(spark, "events"))
    log.add(finding_facts("screen", *screening(drifted_batch(raw(spark, sf_dir)))))
    if not log.flush():
        raise RuntimeError("the findings could not be written")
    names = ("category", "kind", "severity", "column", "detail")
    return log.read().select("stage", "outcome", *[F.col(f"finding.{n}").alias(n) for n in names])


P95_SQL = """SELECT date_trunc('hour', ts) AS hour, count(*) AS events,
       count_if(event_type = 'error') AS failures,
       round(quantile_cont(value, 0.95), 6) AS p95_duration_ms
FROM events GROUP BY 1"""


@query("events_by_hour_p95", P95_SQL, "A22")
def events_by_hour_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events, failures and exact p95 duration per hour (no group is held by one task)."""
    rec = I.event_records(_events(spark, sf_dir)).select(
        F.date_trunc("hour", F.col("`@timestamp`").cast("timestamp")).alias("hour"), "outcome", "duration_ms"
    )
    counts = rec.groupBy("hour").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("outcome") == "failure").alias("failures")
    )
    p95 = grouped_quantile(rec, ["hour"], "duration_ms", Fraction(95, 100), "p95")
    return counts.join(p95, "hour", "left").select("hour", "events", "failures", F.round("p95", 6).alias("p95_duration_ms"))


KEPT_P95_SQL = """SELECT hour, count(*) AS events, count_if(failed) AS failures, round(quantile_cont(value, 0.95), 6) AS p95_duration_ms
FROM (SELECT date_trunc('hour', ts) AS hour, event_type = 'error' AS failed, value FROM events
      UNION ALL SELECT TIMESTAMP '2024-01-01 00:00:00', false, 1.5) GROUP BY hour"""


@query("events_by_hour_kept", KEPT_P95_SQL, "A22,V4")
def events_by_hour_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from an ingest in two batches, whose hourly states are kept and merged: counts and
    brackets need no event again."""
    base = _ingested(spark, sf_dir, twice=True, hours=True)
    p95 = I.exact_p95(I.hours_so_far(spark, f"{base}/hours"), I.read_events(spark, f"{base}/sink"))
    return p95.select("hour", "events", "failures", F.round("p95", 6).alias("p95_duration_ms"))


RUN_SQL = """SELECT CAST(user_id AS VARCHAR) AS run_id, min(ts) AS first_event, max(ts) AS last_event,
       count(*) AS events, count_if(event_type = 'error') AS failures, count(DISTINCT event_type) AS stages,
       (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000 AS span_ms
FROM events GROUP BY user_id"""


@query("run_timeline", RUN_SQL, "A22")
def run_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per run: first and last event, events, failures, stages seen, span."""
    rec = I.event_records(_events(spark, sf_dir)).select(
        F.col("run.id").alias("run_id"), F.col("`@timestamp`").cast("timestamp").alias("ts"), "stage", "outcome"
    )
    return rec.groupBy("run_id").agg(
        F.min("ts").alias("first_event"),
        F.max("ts").alias("last_event"),
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("outcome") == "failure").alias("failures"),
        F.countDistinct("stage").alias("stages"),
        F.expr("(unix_micros(max(ts)) - unix_micros(min(ts))) div 1000").alias("span_ms"),
    )


#: every declared field but the clock's, objects as JSON text
_RECORD_JSON = {
    "event": """'{"dataset":"retail.pipeline","module":"etl","kind":"event"}'""",
    "service": """'{"name":"tillroll","environment":"local"}'""",
    "host": """'{"name":"ingest"}'""",
}
_OBJECTS = [f.name for f in EVENT_SCHEMA if f.name not in ("@timestamp", "stage", "outcome", "duration_ms", "tags")]


def _ingest_sql() -> str:
    given = ", ".join(f"{_RECORD_JSON.get(n, 'NULL')} AS {n}" for n in _OBJECTS if n != "run")
    full = ", ".join(
        "NULL AS " + n if n not in FULL_EVENT else f"'{json.dumps(FULL_EVENT[n], separators=(',', ':'))}' AS {n}" for n in _OBJECTS
    )
    return f"""SELECT CAST(ts AS TIMESTAMP) AS event_ts, event_type AS stage,
       CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS outcome, CAST(value AS DOUBLE) AS duration_ms,
       '{{"id":"' || user_id || '"}}' AS run, {given}, CAST(ts AS DATE) AS event_date, 'etl_events' AS source FROM events
UNION ALL BY NAME
SELECT TIMESTAMP '2024-01-01 00:00:00' AS event_ts, '{FULL_EVENT["stage"]}' AS stage, '{FULL_EVENT["outcome"]}' AS outcome,
       1.5::DOUBLE AS duration_ms, {full}, DATE '2024-01-01' AS event_date, 'etl_events' AS source"""


INGEST_SQL = _ingest_sql()


def _ingested(
    spark: SparkSession, sf_dir: str, *, twice: bool = False, hours: bool = False, log: RunLog | None = None
) -> str:
    """Stream the event records (as JSON Lines, with one full record and the bad lines) into sink
    and dead letters under the returned folder; ``twice``: one part, then the rest after a restart;
    ``hours``: the hourly states as well; ``log``: run events of the batches."""
    base = scratch_path(spark, "event-ingest")
    records = I.event_records(_events(spark, sf_dir))
    late = F.pmod(F.xxhash64("run.id", "@timestamp"), F.lit(2)) == 1
    extra = [json.dumps(FULL_EVENT), *BAD_EVENT_LINES]
    spark.createDataFrame([(x,) for x in extra], "value string").coalesce(1).write.mode("append").text(f"{base}/inbox")
    for part in (records.filter(~late), records.filter(late)) if twice else (records,):
        I.append_json_lines(part, f"{base}/inbox")
        batches = BatchLog(log, f"ingest-{uuid.uuid4().hex[:8]}") if log else None
        start = functools.partial(
            I.start_event_ingest,
            spark,
            f"{base}/inbox",
            f"{base}/sink",
            f"{base}/rejects",
            f"{base}/_checkpoint",
            max_files=50,
            hours=f"{base}/hours" if hours else None,
            log=batches,
        )
        if batches:
            batches.follow(spark, start)
        else:
            I.await_all(start())
    return base


def _stored_events(spark: SparkSession, base: str) -> DataFrame:
    objects = [F.to_json(n).alias(n) for n in _OBJECTS]
    return I.read_events(spark, f"{base}/sink").select("event_ts", "stage", "outcome", "duration_ms", *objects, "event_date", "source")


@query("event_stream_ingest", INGEST_SQL, "S9,P18,V4,V5,V8,V9,K9")
def event_stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily-partitioned sink of an ingest, every declared field of every record."""
    return _stored_events(spark, _ingested(spark, sf_dir))


@query("event_stream_resume", INGEST_SQL, "V4")
def event_stream_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sink when the ingest is stopped midway and started again."""
    return _stored_events(spark, _ingested(spark, sf_dir, twice=True))


def _grow(spark: SparkSession, given: str, inbox: str, share: float) -> None:
    """Stands for the writers of log files: every given file has one of its name in the inbox,
    which is appended to until it holds that share of the given one's bytes."""
    ship()

    def append(batches):
        for batch in batches:
            for path, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, at = storage(path)
                target = f"{storage(inbox)[1]}/{at.rsplit('/', 1)[1]}"
                system.create_dir(storage(inbox)[1])
                held = system.get_file_info(target)
                have = held.size if held.is_file else 0
                with system.open_input_file(at) as source, system.open_append_stream(target) as sink:
                    source.seek(have)
                    left = int(length * share) - have
                    while left > 0:
                        data = source.read(min(left, 1 << 20))
                        sink.write(data)
                        left -= len(data)
            yield batch

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(given).select("path", "length")
    files.mapInArrow(append, "path string, length long").write.format("noop").mode("overwrite").save()


@query("log_append_resume", INGEST_SQL, "S9,V4,K9,V9")
def log_append_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sink of an ingest that follows growing files: each file of event lines is cut at half its
    lines (and a half line more), taken in, completed, and taken in by a second run; then every
    day is compacted, and the stored days are read."""
    base = scratch_path(spark, "log-append")
    lines = to_json_lines(I.event_records(_events(spark, sf_dir)))
    full = spark.createDataFrame([(x,) for x in (json.dumps(FULL_EVENT), *BAD_EVENT_LINES)], "value string")
    lines.unionByName(full).write.text(f"{base}/given")
    for share in (0.5, 1.0):
        _grow(spark, f"{base}/given", f"{base}/inbox", share)
        I.await_all(I.start_event_ingest(spark, f"{base}/inbox", f"{base}/sink", f"{base}/rejects", f"{base}/_checkpoint"))
    I.compact_days(spark, f"{base}/sink", I.last_batch(spark, f"{base}/_checkpoint"))
    return _stored_events(spark, base)


INGEST_BATCHES_SQL = """SELECT 'ingest' AS stage, 'success' AS outcome, count(*) + 7 AS rows, count(*) + 1 AS rows_written,
       6 AS rows_dropped, true AS timed FROM events"""


@query("ingest_batches", INGEST_BATCHES_SQL, "V3,V10,K10")
def ingest_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run events that an ingest's batches leave, read back from the run's log and summed."""
    log = RunLog(spark, scratch_path(spark, "batch-events"))
    _ingested(spark, sf_dir, twice=True, log=log)
    done = log.read().filter(F.col("run.id") == log.run_id)
    return done.groupBy("stage", "outcome").agg(
        *[F.sum(f"metrics.{m}").alias(m) for m in ("rows", "rows_written", "rows_dropped")],
        (F.min("duration_ms") > 0).alias("timed"),
    )


REJECTS_SQL = "\nUNION ALL ".join(
    f"SELECT '{line}' AS raw_line, '{reason}' AS reject_reason" for line, reason in zip(BAD_EVENT_LINES, REJECT_REASONS)
)


@query("event_rejects", REJECTS_SQL, "K10,V5")
def event_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dead letters of the same ingest, with their reasons."""
    return spark.read.parquet(f"{_ingested(spark, sf_dir)}/rejects").select("raw_line", "reject_reason")


DB_SQL = """SELECT CAST(date_trunc('millisecond', ts) AS TIMESTAMP) AS event_ts, CAST(user_id AS BIGINT) AS pid,
       'LOG' AS level,
       'duration: ' || CAST(CAST(value AS DECIMAL(12,3)) AS VARCHAR) || ' ms  ' || event_type AS message,
       CAST(CAST(value AS DECIMAL(12,3)) AS DOUBLE) AS duration_ms, event_type AS statement,
       'postgres_log' AS tags, CAST(NULL AS VARCHAR) AS raw_line
FROM events
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, 'postgres_log,_grokparsefailure_postgres',
       'FATAL something went wrong without a prefix'
UNION ALL SELECT TIMESTAMP '2024-01-01 00:00:00', 17, 'LOG', 'connection received: host=10.0.0.1', NULL, NULL,
       'postgres_log', NULL
UNION ALL SELECT TIMESTAMP '2024-01-01 00:00:00', 17, 'LOG', 'duration: n/a ms  select 1', NULL, NULL,
       'postgres_log,_grokparsefailure_duration', NULL
UNION ALL SELECT TIMESTAMP '2024-01-01 00:00:00.25', 17, 'LOG', 'checkpoint starting', NULL, NULL, 'postgres_log', NULL
UNION ALL SELECT TIMESTAMP '2024-01-01 00:00:00', 17, 'LOG', 'checkpoint complete', NULL, NULL, 'postgres_log', NULL
UNION ALL SELECT TIMESTAMP '2024-01-01 00:00:00.5', 17, 'WARNING', 'x', NULL, NULL, 'postgres_log', NULL
UNION ALL SELECT NULL, 17, 'LOG', 'y', NULL, NULL, 'postgres_log,_dateparsefailure_postgres', NULL"""


def _logged(spark: SparkSession, sf_dir: str) -> str:
    """Stream database log lines made of the events (with the bad lines) into sink and dead
    letters under the returned folder."""
    base = scratch_path(spark, "db-logs")
    I.db_log_lines(_events(spark, sf_dir)).write.mode("append").text(f"{base}/inbox")
    spark.createDataFrame([(x,) for x in BAD_DB_LINES], "value string").coalesce(1).write.mode("append").text(f"{base}/inbox")
    I.await_all(I.start_db_log_ingest(spark, f"{base}/inbox", f"{base}/sink", f"{base}/unparsed", f"{base}/_checkpoint"))
    return base


@query("db_log_parse", DB_SQL, "S10,V6,V7,F14")
def db_log_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored rows of an ingest of database log lines."""
    return spark.read.parquet(f"{_logged(spark, sf_dir)}/sink").select(
        "event_ts", "pid", "level", "message", "duration_ms", "statement", F.array_join("tags", ",").alias("tags"), "raw_line"
    )


@query("db_log_unparsed", f"SELECT '{BAD_DB_LINES[0]}' AS raw_line", "K10,S10")
def db_log_unparsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dead letters of the same ingest."""
    return spark.read.parquet(f"{_logged(spark, sf_dir)}/unparsed").select("raw_line")


LAG_SQL = """SELECT event_type AS stage, count(*) AS events, CAST(max(3600 * (1 + date_part('hour', ts))) AS DOUBLE) AS max_lag_s,
       CAST(sum(3600 * (1 + date_part('hour', ts))) AS DOUBLE) AS sum_lag_s
FROM events GROUP BY event_type"""


@query("shipping_lag", LAG_SQL, "A22")
def shipping_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingest time minus event time per stage, for events ingested one hour and their hour of the
    day late (a stamp that both engines can derive)."""
    at = F.col("ts").cast("timestamp")
    late = _events(spark, sf_dir).select(
        F.col("event_type").alias("stage"),
        at.alias("event_ts"),
        F.timestamp_micros(F.unix_micros(at) + F.lit(3_600_000_000) * (1 + F.hour(at))).alias("ingested_at"),
    )
    lag = I.shipping_lag_seconds(late)
    return late.groupBy("stage").agg(
        F.count(F.lit(1)).alias("events"), F.round(F.max(lag), 3).alias("max_lag_s"), F.round(F.sum(lag), 3).alias("sum_lag_s")
    )


APPEND_SQL = _records_sql() + " FROM events"


@query("event_append", APPEND_SQL, "K8,F15")
def event_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append the event records as JSON Lines and read them back under the event schema."""
    path = scratch_path(spark, "event-log")
    I.append_json_lines(I.event_records(_events(spark, sf_dir)), path)
    return I.read_event_lines(spark, path).select(
        F.try_to_timestamp(F.col("`@timestamp`")).alias("event_ts"),
        "stage",
        "outcome",
        "duration_ms",
        F.col("run.id").alias("run_id"),
        F.col("event.dataset").alias("dataset"),
        F.col("service.name").alias("service"),
    )


DB_P95_SQL = """SELECT date_trunc('hour', ts) AS hour, count(*) AS statements,
       round(quantile_cont(CAST(CAST(value AS DECIMAL(12,3)) AS DOUBLE), 0.95), 6) AS p95_statement_ms,
       max(CAST(CAST(value AS DECIMAL(12,3)) AS DOUBLE)) AS max_statement_ms
FROM events GROUP BY 1"""


@query("db_statement_p95_by_hour", DB_P95_SQL, "A22,V7,F14")
def db_statement_p95_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p95 statement time per hour from the parsed database log lines (exact; no hour's
    durations are buffered in one task)."""
    parsed = I.parse_db_log(I.db_log_lines(_events(spark, sf_dir))).filter(F.col("duration_ms").isNotNull())
    timed = parsed.select(F.date_trunc("hour", "event_ts").alias("hour"), "duration_ms")
    counts = timed.groupBy("hour").agg(F.count(F.lit(1)).alias("statements"), F.max("duration_ms").alias("max_statement_ms"))
    p95 = grouped_quantile(timed, ["hour"], "duration_ms", Fraction(95, 100), "p95")
    return counts.join(p95, "hour", "left").select(
        "hour", "statements", F.round("p95", 6).alias("p95_statement_ms"), "max_statement_ms"
    )


FINDINGS_BY_COLUMN_SQL = f"""SELECT "column", count(*) AS findings, count_if(severity = 'breaking') AS breaking,
       count(DISTINCT category) AS categories
FROM ({FINDING_SQL}) GROUP BY "column\""""


@query("findings_by_column", FINDINGS_BY_COLUMN_SQL, "A22,V2")
def findings_by_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which column breaks most often: finding events of the drifted batch per column."""
    return finding_events(spark, sf_dir).groupBy("column").agg(
        F.count(F.lit(1)).alias("findings"),
        F.count_if(F.col("severity") == "breaking").alias("breaking"),
        F.countDistinct("category").alias("categories"),
    )
