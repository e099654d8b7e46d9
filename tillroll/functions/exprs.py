"""Scalar functions F1-F16 as Spark Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: surrogate-key text conventions ------------------------------------------
KEY_SEPARATOR = "-"
KEY_NULL_SENTINEL = "<null>"
KEY_TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"

MICROS_PER_DAY = 86_400_000_000

#: every character Python's ``str.strip()`` treats as whitespace (derived by rule, not listed)
WHITESPACE = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())


def strip(col: Column | str) -> Column:
    """strip leading/trailing whitespace of any kind (``trim`` only removes spaces).

    ``btrim`` with an explicit character set stays a codegen'd string scan; a regex here
    would run java.util.regex per row (and again wherever the optimizer inlines it)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.btrim(c, F.lit(WHITESPACE))


def nullif_blank(col: Column | str) -> Column:
    """``nullif(trim(x), '')``: blank text becomes null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.nullif(F.trim(c), F.lit(""))


def elapsed_days(later: Column, earlier: Column) -> Column:
    """whole days elapsed between two timestamps (floor of the exact difference).

    Differs from ``datediff`` (F5), which counts calendar-date boundaries.
    """
    diff = F.unix_micros(later) - F.unix_micros(earlier)
    return F.floor(diff / F.lit(MICROS_PER_DAY)).cast("int")


def surrogate_key(*cols: str, formats: dict[str, str] | None = None) -> Column:
    """md5 over the natural key with a null sentinel.

    Each part is rendered as explicit text (timestamps with a fixed pattern, decimals at their
    declared scale) so the key is reproducible; the sentinel stops ``concat_ws`` from skipping
    nulls, which would make ``(a, null, b)`` and ``(a, b, null)`` collide.
    """
    formats = formats or {}
    parts = []
    for name in cols:
        c = F.col(name)
        if name in formats:
            c = F.date_format(c, formats[name])
        parts.append(F.coalesce(c.cast("string"), F.lit(KEY_NULL_SENTINEL)))
    return F.md5(F.concat_ws(KEY_SEPARATOR, *parts))


def min_by_order(*fields: tuple[str, Column]) -> Column:
    """Deterministic arg-min as an aggregate: ``min(struct(...))`` over named fields.

    A struct compares field by field (nulls first), so the minimum is the row that sorts
    first by the given order. Used instead of ``row_number() == 1`` because an aggregate is
    combined map-side before the shuffle: a key holding a third of all rows is reduced to
    one row per map task instead of being sorted whole in one task.
    """
    return F.min(F.struct(*[c.alias(name) for name, c in fields]))


def exact_avg_price(total: Column, units: Column) -> Column:
    """Revenue-weighted average price as decimal(12,4); null when there are no units."""
    return F.try_divide(total, units).cast("decimal(12,4)")


# --- fixed values: calendar attribute patterns ---------------------------------------------
YEAR_MONTH_PATTERN = "yyyy-MM"
MONTH_NAME_PATTERN = "MMMM"
DAY_NAME_PATTERN = "EEEE"


def calendar_columns(date_col: str = "date_key") -> list[Column]:
    """calendar attributes of a date (ISO weekday: Monday = 1 ... Sunday = 7)."""
    d = F.col(date_col)
    iso_dow = (F.weekday(d) + 1).cast("int")
    return [
        d.alias(date_col),
        F.year(d).alias("calendar_year"),
        F.quarter(d).alias("calendar_quarter"),
        F.month(d).alias("calendar_month"),
        F.date_format(d, YEAR_MONTH_PATTERN).alias("year_month"),
        F.date_format(d, MONTH_NAME_PATTERN).alias("month_name"),
        F.dayofmonth(d).alias("day_of_month"),
        iso_dow.alias("day_of_week"),
        F.date_format(d, DAY_NAME_PATTERN).alias("day_name"),
        (iso_dow >= 6).alias("is_weekend"),
        F.trunc(d, "week").alias("week_start_date"),
        F.trunc(d, "month").alias("month_start_date"),
        F.last_day(d).alias("month_end_date"),
    ]
