"""Continuous ingest of run events and database logs with Structured Streaming
(S9, S10, P18, V4-V9, K9, K10, F14).

* Sources are streams of text lines: the raw line is kept, so a line can be judged key by key and
  value by value against the declared record, and refused lines can be surfaced. Files may grow:
  the stream's position is a byte position per file (``streaming.tail``). An inbox of files that
  are complete when they appear can be read by the file source instead, ``max_files`` a batch.
* Each kind of line is one stream: a micro-batch is read and parsed once, and ``foreachBatch``
  writes both its accepted and its refused rows. Every row is stored under its batch's number,
  so a batch that runs again after a failure replaces what it wrote before: nothing is lost or
  doubled, and a restart resumes at the stored position.
* Accepted events keep the whole record. A day has its folder, the batches theirs within it
  (``event_date=<day>/batch=<n>``), rebalanced by day so that a batch writes few files per day:
  a day's read lists that day only. ``compact_day`` turns a day's finished batches into one folder
  ``upto=<n>`` of few files, which then stands for them.
* A value that does not fit its declared type, or a time that cannot be read, refuses the line
  with its reason; no line can fail the stream.
* ``trigger(availableNow=True)`` processes everything present and stops: the same code serves a
  scheduled catch-up job and, with a processing-time trigger, a continuous one.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from fractions import Fraction

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tillroll.operators.rank import GROUP_SKETCH, grouped_quantile
from tillroll.schema import EVENT_SCHEMA, allowed_keys
from tillroll.sources.tables import folders, numbered, remove, write_table
from tillroll.streaming.batches import BatchLog
from tillroll.streaming.events import as_events, to_json_lines
from tillroll.streaming.tail import growing_lines

# --- fixed values: sources, tags and the database-log line layout -------------------------
EVENTS_SOURCE = "etl_events"
DB_SOURCE = "postgres"
DB_SERVICE = "retail-warehouse"
DB_DATASET = "retail.database"
TAG_PIPELINE_EVENT = "pipeline_event"
TAG_DB_LOG = "postgres_log"
TAG_UNPARSED = "_grokparsefailure_postgres"
TAG_BAD_DURATION = "_grokparsefailure_duration"
TAG_BAD_DATE = "_dateparsefailure_postgres"
ISO_OFFSET_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"
DB_TS_FORMAT = "yyyy-MM-dd HH:mm:ss.SSS"
# '<timestamp>[ zone] [<pid>] <LEVEL>:  <message>'
DB_LINE = r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:?\d{2}(?::?\d{2}(?:[.,]\d+)?)?(?:Z|[+-]\d{2}(?::?\d{2})?| [A-Z]{2,5})?) \[(\d+)\] (\w+):  (.*)$"
DB_DURATION = r"^duration: ([0-9]+(?:\.[0-9]+)?) ms\s+(.*)$"
#: shipper bookkeeping keys that are removed on ingest, not rejected (object path -> keys)
BOOKKEEPING_KEYS = {"": ["@version"], "event": ["original"], "log": ["file"]}
#: Readable times after their form is made uniform: a blank for T, a point for a comma, no blank
#: before the zone.
DB_TS_PATTERNS = [
    "yyyy-MM-dd HH:mm:ss[.SSSSSS]XXX",
    "yyyy-MM-dd HH:mm:ss[.SSSSSS]z",
    "yyyy-MM-dd HH:mm:ss[.SSSSSS]",
    "yyyy-MM-dd HH:mmXXX",
    "yyyy-MM-dd HH:mm",
]
#: Rows of a day's folder that one file holds after compaction.
COMPACT_ROWS = 5_000_000
#: Days that are compacted at the same time.
JOBS = 8


# --- event records from the events table ---------------------------------------------------
def event_records(events: DataFrame, environment: str = "local", host: str = "ingest") -> DataFrame:
    """V1 records of the ``events`` table: stage = event_type, outcome = failure for errors,
    duration = value, run = user."""
    facts = events.select(
        "ts",
        "user_id",
        F.col("event_type").alias("stage"),
        F.when(F.col("event_type") == "error", F.lit("failure")).otherwise(F.lit("success")).alias("outcome"),
        F.col("value").cast("double").alias("duration_ms"),
    )
    at = F.date_format(F.col("ts").cast("timestamp"), ISO_OFFSET_FORMAT)
    return as_events(facts, run_id=F.col("user_id").cast("string"), at=at, environment=environment, host=host)


def append_json_lines(records: DataFrame, path: str) -> None:
    """K8 + F15 for events made of data: append JSON Lines. They are what a job works on, so a failure
    is raised; a run's own telemetry, which must never fail it, goes through ``RunLog``."""
    to_json_lines(records).write.mode("append").text(path)


def read_event_lines(spark: SparkSession, path: str) -> DataFrame:
    """Batch read of JSON-Lines events under the declared schema."""
    return spark.read.schema(EVENT_SCHEMA).json(path)


def event_columns(e: str | None = "e") -> list[Column]:
    """Every declared field of an event record, ``@timestamp`` as a timestamp ``event_ts``; ``e``
    names the struct column that holds the record, or ``None`` when its fields are columns."""
    at = f"{e}." if e else ""
    return [
        F.try_to_timestamp(F.col(f"{at}`@timestamp`")).alias("event_ts"),
        *[F.col(f"{at}`{f.name}`").alias(f.name) for f in EVENT_SCHEMA if f.name not in ("@timestamp", "tags")],
    ]


# --- strict-schema validation of JSON lines ------------------------------------------------
def _prefixer(obj: str):
    # a one-argument lambda: ``transform`` passes (element, index) to two-argument lambdas
    return lambda k: F.concat(F.lit(f"{obj}."), k)


def undeclared_keys(value: Column) -> Column:
    """V5: keys of the raw JSON line not declared by the event schema, top level and inside
    each declared object (Spark's JSON reader would otherwise silently drop them). Shipper
    bookkeeping keys are not findings: the declared schema simply drops them (P18)."""
    allowed = {obj: keys + BOOKKEEPING_KEYS.get(obj, []) for obj, keys in allowed_keys(EVENT_SCHEMA).items()}
    parts = [F.array_except(F.coalesce(F.json_object_keys(value), F.array()), F.array(*[F.lit(k) for k in allowed[""]]))]
    for obj, keys in allowed.items():
        if not obj:
            continue
        nested = F.get_json_object(value, f"$.{obj}")
        extra = F.array_except(F.coalesce(F.json_object_keys(nested), F.array()), F.array(*[F.lit(k) for k in keys]))
        parts.append(F.transform(extra, _prefixer(obj)))
    return F.flatten(F.array(*parts))


def wrong_types(value: Column) -> Column:
    """V5: declared fields whose raw JSON value is there but did not parse as declared.

    The raw value comes from the line itself, the parsed one from the declared schema; a number
    or text that the reader turned into null shows as the difference."""

    def judged(path: str, parsed: Column, kind: T.DataType) -> Column:
        raw = F.get_json_object(value, f"$.{path}")
        wrong = raw.isNotNull() & parsed.isNull()
        if isinstance(kind, T.StringType):  # the reader takes any value for text: only text will do
            wrong = wrong | F.coalesce(F.get(F.json_object_keys(raw), 0).isNotNull(), F.lit(False))
        return F.when(wrong, F.lit(path.replace("['", "").replace("']", "")))

    checks = []
    for f in EVENT_SCHEMA:
        name = f"['{f.name}']" if f.name.startswith("@") else f.name
        parsed = F.col(f"e.`{f.name}`")
        checks.append(judged(name, parsed, f.dataType))
        if isinstance(f.dataType, T.StructType):
            checks += [judged(f"{name}.{s.name}", parsed[s.name], s.dataType) for s in f.dataType]
    return F.array_compact(F.array(*checks))


#: A bookkeeping key's value: it is dropped, so only its end has to be found.
_ANY_SHAPE = r"(?:[A-Z]+(?:\(\d+,\d+\))?|(?:OBJECT|ARRAY)<[^<>`]*>)"


def _shape(kind: T.DataType, bookkeeping: list[str] | None = None) -> str:
    """A pattern of the shapes (as ``schema_of_variant`` names them) that are sure to be read as
    ``kind`` without loss. Objects list their keys sorted; any key may lack, any value be null."""
    if isinstance(kind, T.StructType):
        fields = {f.name: _shape(f.dataType, BOOKKEEPING_KEYS.get(f.name)) for f in kind}
        fields |= {key: _ANY_SHAPE for key in bookkeeping or []}
        named = {n: n if re.fullmatch(r"[A-Za-z_]\w*", n) else f"`{n}`" for n in fields}
        parts = [f"(?:{re.escape(named[n])}: {fields[n]}(?:, |(?=>)))?" for n in sorted(fields)]
        return f"(?:VOID|OBJECT<{''.join(parts)}>)"
    if isinstance(kind, T.ArrayType):
        return f"(?:VOID|ARRAY<{_shape(kind.elementType)}>)"
    known = {"string": "STRING", "bigint": "BIGINT", "double": r"BIGINT|DOUBLE|DECIMAL\(\d+,\d+\)"}
    return f"(?:VOID|{known[kind.simpleString()]})"


#: The shape of a line whose keys are all declared and whose values all have their declared type.
FITTING_LINE = rf"^(?=OBJECT){_shape(EVENT_SCHEMA, BOOKKEEPING_KEYS[''])}\z"
#: Text that may itself be the text of an object (it starts with a brace or an escape).
_OBJECT_AS_TEXT = r'"[\s\x{FEFF}]*[{\\]'


def fits_schema(value: Column) -> Column:
    """V5: whether a line is sure to hold declared keys and values of declared types only, told by
    the shape of the whole line, parsed once. What is not sure (text that strict JSON does not know,
    a key given twice, a number where text is declared) is false here and judged key by key."""
    whole = F.schema_of_variant(F.try_parse_json(value)).rlike(FITTING_LINE)
    return F.coalesce(whole & ~value.rlike(_OBJECT_AS_TEXT), F.lit(False))


def classify_event_lines(lines: DataFrame) -> DataFrame:
    """Parse each line and attach ``reject_reason`` (null when accepted). Judging key by key and value
    by value reads a line once per declared field, so it is left to lines that do not fit as a whole."""
    value = F.col("value")
    parsed = lines.select("value", F.from_json("value", EVENT_SCHEMA).alias("e"), fits_schema(value).alias("_fits"))
    keys, extra, wrong = F.json_object_keys(value), undeclared_keys(value), wrong_types(value)
    fault = (
        F.when(F.col("_fits"), F.lit(None).cast("string"))
        .when(keys.isNull(), F.lit("malformed_json"))
        .when(F.size(extra) > 0, F.concat(F.lit("undeclared_field: "), F.array_join(extra, ",")))
        .when(F.size(wrong) > 0, F.concat(F.lit("wrong_type: "), F.array_join(wrong, ",")))
    )
    reason = (
        F.when(F.col("e").isNull(), F.lit("malformed_json"))
        .when(F.col("_fault").isNotNull(), F.col("_fault"))
        .when(F.try_to_timestamp(F.col("e.`@timestamp`")).isNull(), F.lit("bad_timestamp"))
    )
    judged = parsed.withColumn("_fault", fault)
    return judged.select("value", "e", reason.alias("reject_reason"))


def enrich_events(classified: DataFrame) -> DataFrame:
    """P18 + V8 + V9: accepted events whole, with source, ingest time and the daily partition key."""
    return classified.filter(F.col("reject_reason").isNull()).select(
        *event_columns("e"),
        F.lit(EVENTS_SOURCE).alias("source"),
        F.array(F.lit(TAG_PIPELINE_EVENT)).alias("tags"),
        F.current_timestamp().alias("ingested_at"),
        F.to_date(F.try_to_timestamp(F.col("e.`@timestamp`"))).alias("event_date"),
    )


#: A row of the event sink: every declared field, how it came in, and its day.
STORED_EVENTS = T.StructType(
    [
        T.StructField("event_ts", T.TimestampType()),
        *[f for f in EVENT_SCHEMA if f.name not in ("@timestamp", "tags")],
        T.StructField("source", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("ingested_at", T.TimestampType()),
        T.StructField("event_date", T.DateType()),
    ]
)

#: What the files of a day's folder hold.
_IN_A_DAY = T.StructType([f for f in STORED_EVENTS if f.name != "event_date"])


def rejected_lines(classified: DataFrame) -> DataFrame:
    """Refused lines keep their raw text and the reason."""
    return classified.filter(F.col("reject_reason").isNotNull()).select(
        F.col("value").alias("raw_line"), "reject_reason", F.current_timestamp().alias("ingested_at")
    )


def _store(rows: DataFrame, path: str, batch: int, by: str | None = None) -> int:
    """The rows of one micro-batch, replacing whatever an earlier run of that batch stored; ``by``
    names the day, whose folder holds a folder per batch. Returns how many."""
    if by is None:
        return write_table(rows, f"{path}/batch={batch}", count=True)
    seen = Observation("rows stored")
    rows = rows.observe(seen, F.count(F.lit(1)).alias("rows"))
    rows = rows.hint("rebalance", by).withColumn("batch", F.lit(batch).cast("long"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by, "batch").parquet(path)
    return int(seen.get["rows"])


def _day_folders(spark: SparkSession, sink: str, day: str) -> tuple[int, list[str]]:
    """The last batch that a finished compaction covers (-1: none), and the folders that hold the
    day: that compaction's and those of later batches. Only this day's folder is listed.

    A compaction counts from the moment it is finished; what it stands for is passed over then,
    deleted or not, so readers see every row once at any time."""
    at = f"{sink}/event_date={day}"
    last = max(numbered(spark, at, "upto="), default=-1)
    later = [f"{at}/batch={n}" for n in numbered(spark, at, "batch=", finished=False) if n > last]
    return last, ([f"{at}/upto={last}"] if last >= 0 else []) + later


def stored_days(spark: SparkSession, sink: str) -> list[str]:
    """The days that the sink has folders for."""
    return [n.removeprefix("event_date=") for n in folders(spark, sink) if n.startswith("event_date=")]


def read_events(spark: SparkSession, sink: str, days: list[str] | None = None) -> DataFrame:
    """The stored events of some days (all: None), each row once."""
    found = [f for day in (stored_days(spark, sink) if days is None else days) for f in _day_folders(spark, sink, day)[1]]
    if not found:
        return spark.createDataFrame([], STORED_EVENTS)
    day = F.regexp_extract(F.col("_metadata.file_path"), r"event_date=([0-9-]+)/", 1).cast("date")
    stored = spark.read.schema(_IN_A_DAY).parquet(*found)
    return stored.select("*", day.alias("event_date")).select(*STORED_EVENTS.fieldNames())


def compact_day(spark: SparkSession, sink: str, day: str, upto: int, rows_per_file: int = COMPACT_ROWS) -> int:
    """Turn what a day's batches up to ``upto`` hold into one folder of few files; returns the rows.

    ``upto`` is a batch that the stream has committed, so no batch up to it can run again. A
    compaction that fails midway leaves a folder without its mark of success: readers pass it
    over, and the next compaction replaces it."""
    at = f"{sink}/event_date={day}"
    last, folders = _day_folders(spark, sink, day)
    taken = [f for f in folders if "/upto=" in f or int(f.rsplit("=", 1)[1]) <= upto]
    upto = max([last, *(int(f.rsplit("=", 1)[1]) for f in taken)])
    if len(taken) < 2 or upto == last:
        return 0
    whole = spark.read.schema(_IN_A_DAY).parquet(*taken)
    n = whole.count()
    whole.repartition(max(1, -(-n // rows_per_file))).write.mode("overwrite").parquet(f"{at}/upto={upto}")
    for prefix, below in (("batch=", upto + 1), ("upto=", upto)):
        for old in numbered(spark, at, prefix, finished=False):
            if old < below:
                remove(spark, f"{at}/{prefix}{old}")
    return n


def compact_days(spark: SparkSession, sink: str, upto: int, days: list[str] | None = None) -> int:
    """``compact_day`` for some days (all: None), several jobs at a time; returns the rows."""
    days = stored_days(spark, sink) if days is None else days
    with ThreadPoolExecutor(JOBS) as pool:
        return sum(pool.map(lambda day: compact_day(spark, sink, day, upto), days))


def last_batch(spark: SparkSession, checkpoint: str) -> int:
    """The last batch that a stream has committed; -1 before its first one."""
    try:
        commits = spark.read.text(f"{checkpoint.rstrip('/')}/commits").select(F.col("_metadata.file_name").try_cast("long").alias("n"))
        found = commits.agg(F.max("n")).first()[0]
    except AnalysisException:
        return -1
    return -1 if found is None else found


def _start(
    spark: SparkSession,
    inbox: str,
    checkpoint: str,
    write: Callable[[DataFrame, int], None],
    available_now: bool,
    max_files: int | None,
    name: str | None = None,
) -> StreamingQuery:
    if max_files is None:
        lines = growing_lines(spark, inbox, checkpoint)
    else:
        lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(inbox)
    writer = lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.queryName(name) if name else writer
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()


def start_event_ingest(
    spark: SparkSession,
    inbox: str,
    sink: str,
    dead_letter: str,
    checkpoint: str,
    *,
    available_now: bool = True,
    max_files: int | None = None,
    hours: str | None = None,
    log: BatchLog | None = None,
) -> list[StreamingQuery]:
    """S9 + V4: tail the JSON-Lines inbox into the daily-partitioned sink (K9) and the dead-letter
    set (K10): one stream, one parse of every line. ``max_files``: the inbox holds complete files,
    and a batch takes so many of them at most. ``hours``: where each batch's ``hour_state`` is kept
    (A22). ``log``: what follows the batches as run events, by its name."""

    def write(lines: DataFrame, batch: int) -> None:
        classified = classify_event_lines(lines)
        # what is kept for the writes: records of accepted lines, text of refused ones
        refused = F.col("reject_reason").isNotNull()
        record, text = F.when(~refused, F.col("e")), F.when(refused, F.col("value"))
        classified = classified.select(text.alias("value"), record.alias("e"), "reject_reason").persist()
        accepted = _store(enrich_events(classified), sink, batch, by="event_date")
        if hours:
            _store(hour_state(enrich_events(classified)), hours, batch)
        rejected = _store(rejected_lines(classified), dead_letter, batch)
        classified.unpersist()
        if log:
            log.stored(batch, accepted, rejected)

    return [_start(spark, inbox, checkpoint, write, available_now, max_files, log.name if log else None)]


def hour_state(events: DataFrame) -> DataFrame:
    """What a batch says about its hours: events, failures, and a mergeable sketch of the
    durations. A row per hour, of bounded size however many events it has."""
    rows = events.select(F.date_trunc("hour", "event_ts").alias("hour"), "outcome", F.col("duration_ms").alias("v"))
    counted = rows.groupBy("hour").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("outcome") == "failure").alias("failures"),
        F.count("v").alias("n"),
        F.kll_sketch_agg_double("v", F.lit(GROUP_SKETCH)).alias("sketch"),
    )
    return counted.filter("hour is not null")


def hours_so_far(spark: SparkSession, hours: str) -> DataFrame:
    """(hour, events, failures, n, sketch) of all batches together, from their kept states alone."""
    kept = spark.read.parquet(hours)
    return kept.groupBy("hour").agg(
        F.sum("events").alias("events"),
        F.sum("failures").alias("failures"),
        F.sum("n").alias("n"),
        F.kll_merge_agg_double("sketch", F.lit(GROUP_SKETCH)).alias("sketch"),
    )


def exact_p95(state: DataFrame, events: DataFrame) -> DataFrame:
    """(hour, events, failures, p95): counts and bracket from the kept states, the exact value from
    the one pass over the events that counts what lies inside the bracket."""
    timed = events.select(F.date_trunc("hour", "event_ts").alias("hour"), "duration_ms")
    sketches = state.filter("n > 0").select("hour", "n", "sketch")
    p95 = grouped_quantile(timed, ["hour"], "duration_ms", Fraction(95, 100), "p95", sketches)
    return state.select("hour", "events", "failures").join(p95, "hour", "left")


def await_all(queries: list[StreamingQuery]) -> None:
    for q in queries:
        q.awaitTermination()
        if q.exception() is not None:
            raise q.exception()


# --- database logs -------------------------------------------------------------------------
def db_log_lines(events: DataFrame) -> DataFrame:
    """Database log text built from the events table: ts, pid = user, duration = value (ms,
    3 places), statement = event type."""
    return events.select(
        F.concat(
            F.date_format(F.col("ts").cast("timestamp"), DB_TS_FORMAT),
            F.lit(" UTC ["),
            F.col("user_id").cast("string"),
            F.lit("] LOG:  duration: "),
            F.col("value").cast("decimal(12,3)").cast("string"),
            F.lit(" ms  "),
            F.col("event_type"),
        ).alias("value")
    )


def parse_db_log(lines: DataFrame) -> DataFrame:
    """V6 + V7 + F14: prefix, pid, level and message by one regex; the time made uniform and read
    by a ladder of forms; the duration as a number when the message is a duration line.
    Unmatched lines are tagged and keep their raw text; parsed lines drop it."""
    # one match per line gives all four parts: joined by a mark that no line of text holds
    parts = F.split(F.regexp_replace("value", DB_LINE, "$1\u0001$2\u0001$3\u0001$4"), "\u0001", 4)
    split = lines.select("value", parts.alias("p")).select(
        "value",
        (F.size("p") == 4).alias("matched"),
        *[F.get("p", F.lit(i)).alias(n) for i, n in enumerate(("at", "pid", "level", "message"))],
    )
    matched = F.col("matched")
    uniform = F.regexp_replace("at", r"^(\d{4}-\d{2}-\d{2})T", "$1 ")
    uniform = F.regexp_replace(F.translate(uniform, ",", "."), r" (?=[A-Z])", "")
    uniform = F.regexp_replace(uniform, r"Z$", "+00:00")
    uniform = F.regexp_replace(uniform, r"(:\d{2}(?:\.\d+)?[+-]\d{2})(\d{2})$", "$1:$2")
    uniform = F.regexp_replace(uniform, r"(:\d{2}(?:\.\d+)?[+-]\d{2})$", "$1:00")
    uniform = F.regexp_replace(uniform, r"(\.\d{6})\d+", "$1")
    timed = split.withColumn("uniform", F.when(matched, uniform))
    ts = F.coalesce(*[F.try_to_timestamp("uniform", F.lit(p)) for p in DB_TS_PATTERNS])
    is_duration = matched & F.col("message").startswith("duration:")
    took = F.regexp_extract("message", DB_DURATION, 1)
    tags = F.array_compact(
        F.array(
            F.lit(TAG_DB_LOG),
            F.when(~matched, F.lit(TAG_UNPARSED)),
            F.when(matched & F.col("event_ts").isNull(), F.lit(TAG_BAD_DATE)),
            F.when(is_duration & (took == ""), F.lit(TAG_BAD_DURATION)),
        )
    )
    return timed.withColumn("event_ts", ts).select(
        "event_ts",
        F.when(matched, F.col("pid").try_cast("bigint")).alias("pid"),
        F.when(matched, F.col("level")).alias("level"),
        F.when(matched, F.col("message")).alias("message"),
        F.when(is_duration & (took != ""), took.try_cast("double")).alias("duration_ms"),
        F.when(is_duration & (took != ""), F.regexp_extract("message", DB_DURATION, 2)).alias("statement"),
        F.lit(DB_SERVICE).alias("service"),
        F.lit(DB_DATASET).alias("dataset"),
        F.lit(DB_SOURCE).alias("source"),
        tags.alias("tags"),
        F.when(~matched, F.col("value")).alias("raw_line"),
        F.current_timestamp().alias("ingested_at"),
    )


def start_db_log_ingest(
    spark: SparkSession,
    inbox: str,
    sink: str,
    dead_letter: str,
    checkpoint: str,
    *,
    available_now: bool = True,
    max_files: int | None = None,
) -> list[StreamingQuery]:
    """Tail plain-text database logs; every line lands in the sink (unparsed ones tagged),
    and unparsed lines are also surfaced in a dead-letter set. One stream, one parse."""

    def write(lines: DataFrame, batch: int) -> None:
        parsed = parse_db_log(lines).persist()
        _store(parsed, sink, batch)
        _store(parsed.filter(F.array_contains("tags", TAG_UNPARSED)).select("raw_line", "ingested_at"), dead_letter, batch)
        parsed.unpersist()

    return [_start(spark, inbox, checkpoint, write, available_now, max_files)]


def shipping_lag_seconds(df: DataFrame) -> Column:
    """Ingest time minus event time, in seconds."""
    return (F.unix_micros("ingested_at") - F.unix_micros("event_ts")) / F.lit(1_000_000.0)
