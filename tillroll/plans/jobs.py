"""Job entry points.

    python -m tillroll.plans.jobs lakehouse --sf-dir /root/testdata/sf0.01 [--lake-root DIR]
    python -m tillroll.plans.jobs pipeline  --sf-dir /root/testdata/sf0.01 [--work-dir DIR]

``lakehouse``: bronze (written partitioned by invoice year/month and read back, so a broken
write cannot go unnoticed) -> silver (written and read back) -> the three gold tables ->
revenue reconciliation. ``pipeline``: extract -> screen -> transform -> load -> validate with
one run event per stage.
"""

from __future__ import annotations

import argparse
import datetime
import json
import logging
import sys
import time

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tillroll.operators import layers as L
from tillroll.session import BRONZE, GOLD, SILVER

logger = logging.getLogger("tillroll.jobs")

LAYER_PARTITIONS = ["invoice_year", "invoice_month"]


def _write_counted(
    df: DataFrame, layer: str, table: str, root: str, partition_by: list[str] | None = None, gathered: bool = False
) -> tuple[str, int]:
    obs = Observation(f"{layer}_{table}")
    seen = df.observe(obs, F.count(F.lit(1)).alias("rows"))
    path = L.write_layer(seen, layer, table, partition_by=partition_by, root=root, gathered=gathered)
    return path, int(obs.get["rows"])


def build_lakehouse(raw_df: DataFrame, root: str, num_partitions: int | None = None) -> dict:
    """The medallion build. Row counts are observed during the writes (no recount pass)."""
    spark = raw_df.sparkSession
    started = time.perf_counter()
    summary: dict = {"root": root}

    bronze_path, summary["bronze_rows"] = _write_counted(L.to_bronze(raw_df), BRONZE, "transactions", root, LAYER_PARTITIONS)
    folders = {"invoice_year": F.year("invoiced_at"), "invoice_month": F.month("invoiced_at")}
    silver_path, summary["silver_rows"] = _write_counted(
        L.to_silver(spark.read.parquet(bronze_path), folders, summary["bronze_rows"]), SILVER, "sales", root, LAYER_PARTITIONS, True
    )
    silver = spark.read.parquet(silver_path)
    for name, frame, parts in (
        ("daily_sales", L.gold_daily_sales(silver), LAYER_PARTITIONS),
        ("customer_rfm", L.gold_customer_rfm(silver, num_partitions=num_partitions), None),
        ("product_performance", L.gold_product_performance(silver), None),
    ):
        _, summary[f"gold_{name}_rows"] = _write_counted(frame, GOLD, name, root, parts)
    revenue = silver.agg(F.sum("line_revenue").alias("r")).first()["r"]  # one scalar
    summary["silver_revenue"] = str(revenue)
    summary["duration_sec"] = round(time.perf_counter() - started, 2)
    return summary


def main(argv: list[str] | None = None) -> int:
    from tillroll.session import build_session, scratch_path
    from tillroll.sources.retail import retail_raw
    from tillroll.streaming.events import PIPELINE, RunLog, run_pipeline

    ap = argparse.ArgumentParser(prog="tillroll.plans.jobs")
    ap.add_argument("job", choices=["lakehouse", "pipeline"])
    ap.add_argument("--sf-dir", required=True)
    ap.add_argument("--lake-root", default=None)
    ap.add_argument("--work-dir", default=None)
    ap.add_argument("--min-rows", type=int, default=None, help="rows the star must hold; else those that transform kept (pipeline)")
    ap.add_argument("--max-rows", type=int, default=None)
    ap.add_argument("--min-date", default=None, help="quality date window, YYYY-MM-DD (pipeline)")
    ap.add_argument("--max-date", default=None)
    args = ap.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s | %(levelname)-7s | %(message)s")

    spark = build_session(f"tillroll-{args.job}")
    spark.sparkContext.setLogLevel("ERROR")
    try:
        raw_df = retail_raw(spark, args.sf_dir)
        if args.job == "lakehouse":
            out = build_lakehouse(raw_df, args.lake_root or scratch_path(spark, "lakehouse"))
        else:
            work = args.work_dir or scratch_path(spark, "pipeline")
            log = RunLog(spark, f"{work}/events")
            window = {k: v for k, v in (("min_rows", args.min_rows), ("max_rows", args.max_rows)) if v is not None}
            for k, v in (("min_date", args.min_date), ("max_date", args.max_date)):
                if v:
                    window[k] = datetime.datetime.fromisoformat(v)
            done = run_pipeline(raw_df, work, log, window=window)
            out = {"run": log.run_id, **{s.name: done[s.name] for s in PIPELINE}}
            out["validate"] = {**out["validate"], "report": out["validate"]["report"].to_dict()}
        print(json.dumps(out, default=str))
        return 0
    finally:
        spark.stop()


if __name__ == "__main__":
    sys.exit(main())
