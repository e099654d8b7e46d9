"""Structured Streaming ingest: strict schema, dead letters, daily partitions, exactly-once
restart, database-log parsing."""

from __future__ import annotations

import json
from datetime import datetime
from pathlib import Path

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException, StreamingQueryException
from pyspark.sql import functions as F

import __spark_entry__ as E
from tillroll.streaming import ingest as I
from tillroll.streaming.events import to_json_lines


def _write_lines(spark, path, lines):
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(path)


FULL = {
    "event": {"dataset": "d", "module": "m", "kind": "k"},
    "stage": "load",
    "outcome": "success",
    "metrics": {"rows": 5, "pct_dropped": 0.5},
    "finding": {"column": "Country"},
    "error": {"type": "t", "message": "m"},
    "log": {"level": "l"},
    "database": {"pid": 7},
    "host": {"name": "h"},
    "run": {"id": "r1"},
}


def line(day, **changes):
    return json.dumps({"@timestamp": f"2024-02-0{day}T10:00:00+00:00", **FULL, **changes})


def _ingest(spark, tmp_path, **options):
    inbox, sink, dead, ck = (str(tmp_path / p) for p in ("inbox", "sink", "dead", "ck"))
    I.await_all(I.start_event_ingest(spark, inbox, sink, dead, ck, **options))
    return I.read_events(spark, sink), spark.read.parquet(dead)


def test_event_ingest_keeps_all_refuses_what_does_not_fit_and_resumes(spark, tmp_path):
    inbox = str(tmp_path / "inbox")
    good = [line(1), line(2)]
    refused = {
        "{not json": "malformed_json",
        line(1, shipper="x"): "undeclared_field: shipper",
        line(1, event={"dataset": "d", "extra": 1}): "undeclared_field: event.extra",
        line(1, duration_ms="abc"): "wrong_type: duration_ms",
        line(1, metrics={"rows": "many"}): "wrong_type: metrics.rows",
        line(1, metrics={"rows": 1.5}): "wrong_type: metrics.rows",
        line(1, stage={"a": 1}): "wrong_type: stage",
        line(1).replace("2024-02-01T10", "2024-99-01T77"): "bad_timestamp",
        json.dumps(FULL): "bad_timestamp",
    }
    bookkeeping = line(1, **{"@version": "1"})
    _write_lines(spark, inbox, [*good, *refused, bookkeeping])
    accepted, dead = _ingest(spark, tmp_path)
    assert accepted.count() == 3  # the bookkeeping field is dropped, the event kept
    assert sorted(r["event_date"].isoformat() for r in accepted.select("event_date").collect()) == ["2024-02-01", "2024-02-01", "2024-02-02"]
    assert {r["raw_line"]: r["reject_reason"] for r in dead.collect()} == refused
    row = accepted.filter("event_date = '2024-02-02'").first()
    assert row["metrics"]["rows"] == 5 and row["finding"]["column"] == "Country" and row["error"]["type"] == "t"
    assert row["log"]["level"] == "l" and row["database"]["pid"] == 7 and row["host"]["name"] == "h" and row["event"]["kind"] == "k"

    # restart with one new line: only the new line is read
    _write_lines(spark, inbox, [line(3)])
    accepted, dead = _ingest(spark, tmp_path)
    assert accepted.count() == 4 and dead.count() == len(refused)


def test_a_batch_that_runs_again_replaces_what_it_stored(spark, tmp_path):
    lines = spark.createDataFrame([(line(1),), (line(2),)], "value string")
    events = I.enrich_events(I.classify_event_lines(lines))
    for _ in range(2):
        I._store(events, str(tmp_path / "sink"), 0, by="event_date")
    sink = str(tmp_path / "sink")
    assert spark.read.parquet(sink).count() == I.read_events(spark, sink).count() == 2
    assert sorted(p.name for p in (tmp_path / "sink").glob("*/*")) == ["batch=0", "batch=0"]


def test_a_backlog_is_taken_in_bounded_batches(spark, tmp_path):
    for day in (1, 2, 3):
        _write_lines(spark, str(tmp_path / "inbox"), [line(day)])
    accepted, _ = _ingest(spark, tmp_path, max_files=1)
    assert accepted.count() == 3 and len({p.name for p in (tmp_path / "sink").glob("*/batch=*")}) == 3


def test_a_day_is_read_from_its_own_folder_and_compacted(spark, tmp_path):
    sink, ck = str(tmp_path / "sink"), str(tmp_path / "ck")
    for hour in range(3):
        _write_lines(spark, str(tmp_path / "inbox"), [line(1), line(2), line(2, stage=f"s{hour}")])
        _ingest(spark, tmp_path)
    day = "2024-02-02"
    before = sorted(map(str, I.read_events(spark, sink, [day]).collect()))
    assert len(before) == 6 and I.last_batch(spark, ck) == 2
    assert all(f"event_date={day}/" in f for f in I.read_events(spark, sink, [day]).inputFiles())
    # a compaction that did not finish is passed over
    I.read_events(spark, sink, [day]).drop("event_date").write.parquet(f"{sink}/event_date={day}/upto=1")
    (tmp_path / "sink" / f"event_date={day}" / "upto=1" / "_SUCCESS").unlink()
    assert sorted(map(str, I.read_events(spark, sink, [day]).collect())) == before
    assert I.compact_day(spark, sink, day, I.last_batch(spark, ck)) == 6
    assert [p.name for p in (tmp_path / "sink" / f"event_date={day}").iterdir()] == ["upto=2"]
    assert sorted(map(str, I.read_events(spark, sink, [day]).collect())) == before
    assert I.compact_day(spark, sink, day, 2) == 0
    # a folder that a finished compaction covers is passed over, a later batch is added
    I.read_events(spark, sink, [day]).drop("event_date").write.parquet(f"{sink}/event_date={day}/batch=1")
    _write_lines(spark, str(tmp_path / "inbox"), [line(2, stage="late")])
    _ingest(spark, tmp_path)
    assert I.read_events(spark, sink, [day]).count() == 7 and I.read_events(spark, sink).count() == 10
    assert I.read_events(spark, sink, ["2020-01-01"]).count() == 0


def test_appended_lines_and_half_lines(spark, tmp_path):
    (tmp_path / "inbox").mkdir()
    log = tmp_path / "inbox" / "events.log"
    log.write_text(line(1) + "\n" + line(2)[:30])
    accepted, dead = _ingest(spark, tmp_path)
    assert accepted.count() == 1 and dead.count() == 0
    with log.open("a") as file:
        file.write(line(2)[30:] + "\n{broken\n")
    accepted, dead = _ingest(spark, tmp_path)
    assert accepted.count() == 2 and dead.count() == 1


def test_db_log_parse(spark):
    lines = spark.createDataFrame(
        [
            ("2024-01-01 10:00:00.123 UTC [42] LOG:  duration: 12.500 ms  select 1",),
            ("2024-01-01 10:00:01.000 UTC [42] LOG:  connection authorized",),
            ("2024-01-01 10:00:02.000 UTC [42] LOG:  duration: fast ms  select 2",),
            ("garbage",),
        ],
        "value string",
    )
    out = I.parse_db_log(lines).collect()
    d = out[0]
    assert d["event_ts"] == datetime(2024, 1, 1, 10, 0, 0, 123000) and d["pid"] == 42 and d["level"] == "LOG"
    assert d["duration_ms"] == 12.5 and d["statement"] == "select 1" and d["raw_line"] is None
    assert out[1]["duration_ms"] is None and out[1]["tags"] == ["postgres_log"]
    assert out[2]["tags"] == ["postgres_log", "_grokparsefailure_duration"]
    assert out[3]["tags"] == ["postgres_log", "_grokparsefailure_postgres"] and out[3]["raw_line"] == "garbage"


@pytest.mark.parametrize(
    "written, read",
    [
        ("2024-01-01T10:00:00Z", datetime(2024, 1, 1, 10)),
        ("2024-01-01T10:00:00.250+02:00", datetime(2024, 1, 1, 8, 0, 0, 250000)),
        ("2024-01-01 10:00:00,5", datetime(2024, 1, 1, 10, 0, 0, 500000)),
        ("2024-01-01 10:00:00.123456789-0530", datetime(2024, 1, 1, 15, 30, 0, 123456)),
        ("2024-01-01 10:00:00+02", datetime(2024, 1, 1, 8)),
        ("2024-01-01 10:00:00 EST", datetime(2024, 1, 1, 15)),
        ("2024-01-01 10:00", datetime(2024, 1, 1, 10)),
        ("2024-13-01 10:00:00 UTC", None),
    ],
)
def test_db_log_times(spark, written, read):
    row = I.parse_db_log(spark.createDataFrame([(f"{written} [1] LOG:  m",)], "value string")).first()
    assert row["event_ts"] == read and row["message"] == "m" and row["raw_line"] is None
    assert ("_dateparsefailure_postgres" in row["tags"]) == (read is None)


def test_db_log_stream_surfaces_unparsed(spark, tmp_path):
    inbox, sink, dead, ck = (str(tmp_path / p) for p in ("inbox", "sink", "dead", "ck"))
    _write_lines(spark, inbox, ["2024-01-01 10:00:00.000 UTC [1] LOG:  duration: 1.000 ms  x", "nope"])
    I.await_all(I.start_db_log_ingest(spark, inbox, sink, dead, ck))
    assert spark.read.parquet(sink).count() == 2
    assert [r["raw_line"] for r in spark.read.parquet(dead).collect()] == ["nope"]


def test_event_records_from_events_table(spark):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    rec = I.event_records(ev)
    row = rec.filter(F.col("stage") == "error").first()
    assert row["outcome"] == "failure" and row["@timestamp"].endswith("+00:00")
    assert rec.count() == ev.count()


def test_shipping_lag(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 10, 0, 0), datetime(2024, 1, 1, 10, 0, 2, 500000))], "event_ts timestamp, ingested_at timestamp")
    assert df.select(I.shipping_lag_seconds(df).alias("lag")).first()["lag"] == 2.5


def test_batches_leave_run_events(spark, tmp_path):
    from tillroll.streaming.batches import BatchLog
    from tillroll.streaming.events import RunLog

    inbox, sink, dead, ck = (str(tmp_path / p) for p in ("inbox", "sink", "dead", "ck"))
    log = RunLog(spark, str(tmp_path / "log"))
    for number, lines in enumerate(([line(1), line(2), "{broken"], [line(3)])):
        _write_lines(spark, inbox, lines)
        batches = BatchLog(log, f"ingest-{number}")
        batches.follow(spark, lambda: I.start_event_ingest(spark, inbox, sink, dead, ck, log=batches))  # noqa: B023
    done = sorted((r["metrics"]["rows"], r["metrics"]["rows_written"], r["metrics"]["rows_dropped"]) for r in log.read().collect())
    assert done == [(1, 1, 0), (3, 2, 1)]
    assert {(r["stage"], r["outcome"], r["run"]["id"]) for r in log.read().collect()} == {("ingest", "success", log.run_id)}
    assert all(r["duration_ms"] > 0 for r in log.read().collect())


def test_a_failed_batch_leaves_a_failure(spark, tmp_path):
    from tillroll.streaming.batches import BatchLog
    from tillroll.streaming.events import RunLog

    inbox, dead, ck = (str(tmp_path / p) for p in ("inbox", "dead", "ck"))
    (tmp_path / "sink").write_text("a file where the folder should be")
    _write_lines(spark, inbox, [line(1)])
    log = RunLog(spark, str(tmp_path / "log"))
    batches = BatchLog(log, "ingest-failing")
    with pytest.raises(StreamingQueryException):
        batches.follow(spark, lambda: I.start_event_ingest(spark, inbox, str(tmp_path / "sink"), dead, ck, log=batches))
    (row,) = log.read().collect()
    assert (row["stage"], row["outcome"]) == ("ingest", "failure") and row["error"]["message"]


def test_lines_that_fit_are_told_by_one_parse_and_as_the_checks_by_key_do(spark):
    whole = json.dumps({"@timestamp": "2024-02-01T10:00:00+00:00", **{f.name: None for f in I.EVENT_SCHEMA[1:]}})
    fitting = [
        line(1),
        line(2, **{"@version": "1"}, tags=["a", None], duration_ms=3),
        line(1, event={"kind": "k", "original": "x"}, log={"level": "l", "file": {"path": "p"}}),
        line(1, duration_ms=1e300, metrics={"rows": 2**63 - 1, "pct_dropped": 7}),
        whole,
        "{}",
    ]
    unsure = [
        "{not json",
        "",
        "[]",
        line(1, shipper="x"),
        line(1, **{"stage: STRING, x": "y"}),
        line(1, event={"dataset": "d", "extra": 1}),
        line(1, duration_ms="abc"),
        line(1, metrics={"rows": 1.5}),
        line(1, metrics={"rows": 2**63}),
        line(1, metrics=[1]),
        line(1, stage={"a": 1}),
        line(1, stage=' {"a": 1}'),
        line(1, stage=5),
        line(1).replace("{", '{"run": 1, ', 1),
    ]
    lines = spark.createDataFrame([(x,) for x in fitting + unsure], "value string")
    assert [r["value"] for r in lines.filter(I.fits_schema(F.col("value"))).collect()] == fitting
    parsed = lines.withColumn("e", F.from_json("value", I.EVENT_SCHEMA)).filter(I.fits_schema(F.col("value")))
    assert parsed.filter((F.size(I.undeclared_keys(F.col("value"))) > 0) | (F.size(I.wrong_types(F.col("value"))) > 0)).count() == 0
    reasons = {r["value"]: r["reject_reason"] for r in I.classify_event_lines(lines).collect()}
    assert {reasons[x] for x in fitting} == {None, "bad_timestamp"} and reasons["{}"] == "bad_timestamp"
    assert reasons[line(1, stage=5)] is None and reasons[line(1, metrics={"rows": 2**63})] == "wrong_type: metrics.rows"


@pytest.fixture
def cut_off_events(tmp_path):
    """A folder of test tables whose events can't be read whole: the second of two files is cut off."""
    events = tmp_path / "tables" / "events.parquet"
    events.mkdir(parents=True)
    whole = Path("/root/testdata/sf0.001/events.parquet").read_bytes()
    (events / "part-0.parquet").write_bytes(whole)
    (events / "part-1.parquet").write_bytes(whole[: len(whole) // 2])
    return str(tmp_path / "tables")


@pytest.mark.parametrize("name", ["event_rejects", "event_stream_ingest", "event_stream_resume", "events_by_hour_kept"])
def test_events_that_cannot_be_read_whole_are_no_result(spark, cut_off_events, name):
    with pytest.raises(Py4JJavaError):
        E.queries()[name](spark, cut_off_events).collect()


def test_lines_that_cannot_be_appended_are_told(spark, tmp_path):
    (tmp_path / "blocker").write_text("a file where the folder should be")
    records = I.event_records(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    with pytest.raises(Py4JJavaError):
        I.append_json_lines(records, str(tmp_path / "blocker" / "inbox"))


@pytest.mark.parametrize("name", ["event_stream_resume", "events_by_hour_kept"])
def test_a_second_part_that_cannot_be_appended_is_told(spark, monkeypatch, name):
    parts = []

    def failing(records):
        parts.append(to_json_lines(records))
        broken = F.raise_error(F.lit("second part")).cast("string").alias("value")
        return parts[-1] if len(parts) == 1 else parts[-1].select(broken)

    monkeypatch.setattr(I, "to_json_lines", failing)
    with pytest.raises(PySparkException, match="second part"):
        E.queries()[name](spark, "/root/testdata/sf0.001").collect()
    assert len(parts) == 2
