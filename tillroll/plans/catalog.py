"""Query registry: every registered query is a ``(spark, sf_dir) -> DataFrame`` callable,
paired (when SQL can express it) with an independent DuckDB oracle string.

Queries read the whole test tables (or data Spark derives from them); nothing is capped,
sampled or filtered to a subset to make the comparison cheaper.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.session import ensure_session_defaults, store
from tillroll.sources.retail import retail_raw

QueryFn = Callable[[SparkSession, str], DataFrame]

# --- fixed parameters shared by the Spark queries and their oracles -----------------------
#: one ``loaded_at`` stamp per landed batch; a parameter so both engines agree
LOADED_AT = dt.datetime(2026, 1, 1, 0, 0, 0)
#: "now" for freshness and future-date checks
NOW = dt.datetime(2026, 1, 1, 18, 0, 0)
#: expected invoice-date window of the test data
DATE_WINDOW = (dt.date(1995, 1, 1), dt.date(2001, 12, 31))


@dataclass
class Entry:
    fn: QueryFn
    oracle: str | None
    ids: str


REGISTRY: dict[str, Entry] = {}


def query(name: str, oracle: str | None, ids: str = "") -> Callable[[QueryFn], QueryFn]:
    def register(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(fn, oracle, ids)
        return fn

    return register


def raw(spark: SparkSession, sf_dir: str, *, time_of_day: bool = False) -> DataFrame:
    ensure_session_defaults(spark)
    return retail_raw(spark, sf_dir, time_of_day=time_of_day)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """A derived layer written once to shared storage, where it feeds several branches of a query:
    branches prune different columns, so their subtrees differ and Spark cannot reuse the shuffle;
    without this the whole derivation (scans, joins, dedupe) would run once per branch."""
    return store(df, name)


def ts_lit(value: dt.datetime) -> F.Column:
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")


def sql_ts(value: dt.datetime) -> str:
    return f"TIMESTAMP '{value.strftime('%Y-%m-%d %H:%M:%S')}'"
