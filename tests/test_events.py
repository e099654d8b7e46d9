"""Run events: record shape, the stage runner, findings, screening order, never-raising log."""

from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tillroll.operators.contracts import SchemaDriftError
from tillroll.operators.expectations import DataValidationError
from tillroll.operators.quality import DataQualityError
from tillroll.schema import EVENT_SCHEMA
from tillroll.streaming import events as EV

WINDOW = dict(min_date=datetime(1990, 1, 1), max_date=datetime(2005, 1, 1), now=datetime(2026, 1, 1))


def stage(name, work, *reported):
    return EV.Stage(name, work, reported)


def screened(spark, batch, **options):
    log = EV.RunLog(spark)
    EV.run_stages([s for s in EV.PIPELINE if s.name == "screen"], {"raw": batch, **options}, log)
    return log


def test_events_are_utc_with_offset_and_have_every_field(spark):
    log = EV.RunLog(spark, run_id="r1")
    log.record("load", "success", metrics={"rows": 3})
    e = log.frame().first()
    assert log.frame().schema.fieldNames() == EVENT_SCHEMA.fieldNames()
    assert e["@timestamp"].endswith("+00:00") and e["run"]["id"] == "r1"
    assert (e["event"]["dataset"], e["service"]["name"]) == ("retail.pipeline", "tillroll")
    assert e["metrics"]["rows"] == 3 and e["finding"] is None and e["error"] is None


def test_runner_records_one_event_per_stage_and_stops_at_a_failure(spark):
    def boom(context):
        raise ValueError("boom")

    log = EV.RunLog(spark)
    with pytest.raises(ValueError):
        EV.run_stages([stage("transform", lambda c: {"rows_in": 10, "path": "x"}, "rows_in"), stage("load", boom), stage("never", boom)], {}, log)
    ok, bad = log.frame().collect()
    assert (ok["stage"], ok["outcome"], ok["metrics"]["rows_in"], ok["error"]) == ("transform", "success", 10, None)
    assert (bad["outcome"], bad["error"]["type"], bad["error"]["message"]) == ("failure", "ValueError", "boom")
    assert ok["duration_ms"] is not None and bad["duration_ms"] is not None


def test_flush_appends_json_lines_and_never_raises(spark, tmp_path):
    log = EV.RunLog(spark, str(tmp_path / "events"))
    log.record("load", "success", metrics={"rows": 3})
    assert log.flush() and not log.flush()
    log.record("validate", "success")
    assert log.flush()
    lines = spark.read.text(str(tmp_path / "events")).collect()
    assert len(lines) == 2 and {json.loads(r[0])["stage"] for r in lines} == {"load", "validate"}
    assert {r["stage"] for r in log.read().collect()} == {"load", "validate"}
    (tmp_path / "blocker").write_text("x")
    broken = EV.RunLog(spark, str(tmp_path / "blocker" / "sub"))
    broken.record("load", "success")
    assert broken.flush() is False  # a telemetry failure is swallowed


def test_screen_logs_findings_and_its_event_before_drift_is_raised_first(spark, batch):
    log = EV.RunLog(spark)
    bad = batch.drop("Country").withColumn("CustomerID", F.lit(None).cast("string"))
    with pytest.raises(SchemaDriftError):
        EV.run_stages([s for s in EV.PIPELINE if s.name == "screen"], {"raw": bad}, log)
    events = log.frame().collect()
    assert {e["finding"]["category"] for e in events if e["outcome"] == "finding"} == {"schema_drift", "expectation"}
    last = events[-1]
    assert (last["stage"], last["outcome"], last["metrics"]["breaking_drift"]) == ("screen", "failure", 1)
    with pytest.raises(DataValidationError):  # only expectations fail
        screened(spark, batch.withColumn("CustomerID", F.lit(None).cast("string")))
    assert screened(spark, bad, enforce=False).frame().collect()[-1]["outcome"] == "success"


def test_screen_of_a_good_batch(spark, batch):
    m = screened(spark, batch).frame().first()["metrics"]
    assert (m["rows"], m["breaking_drift"], m["expectations_failed"], m["expectations_run"]) == (8, 0, 0, 13)


def test_pipeline_row_window_follows_the_batch(spark, tmp_path):
    from tillroll.sources.retail import retail_raw

    whole = retail_raw(spark, "/root/testdata/sf0.001")
    for name, batch in (("all", whole), ("half", whole.filter(F.pmod(F.xxhash64("InvoiceNo"), F.lit(2)) == 0)), ("few", whole.limit(50))):
        log = EV.RunLog(spark, str(tmp_path / name / "events"))
        done = EV.run_pipeline(batch, str(tmp_path / name), log, window=WINDOW)
        events = {e["stage"]: e for e in log.read().collect() if e["outcome"] != "finding"}
        assert list(events) and all(e["outcome"] == "success" for e in events.values()) and len(events) == 5
        report = done["validate"]["report"]
        kept = done["transform"]["rows_out"]
        assert report.ok and report.rows[0]["expected"] == f"{kept} to {kept} rows"
        if name == "all":
            assert done["transform"]["rows_in"] == 6116
            assert done["transform"]["pct_dropped"] == round(100 * (6116 - kept) / 6116, 1)


def test_pipeline_fails_when_the_star_has_other_rows(spark, tmp_path, monkeypatch):
    from tillroll.sources.retail import retail_raw

    def lossy(clean, root):
        return EV_LOAD(clean.filter("Quantity > 1"), root)

    EV_LOAD = EV.load_star
    monkeypatch.setattr(EV, "load_star", lossy)
    with pytest.raises(DataQualityError, match="row_count_in_range"):
        EV.run_pipeline(retail_raw(spark, "/root/testdata/sf0.001"), str(tmp_path), EV.RunLog(spark), window=WINDOW)
