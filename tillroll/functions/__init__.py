"""Column-expression helpers (all JVM-side built-ins; no Python UDFs)."""

from tillroll.functions.exprs import (
    KEY_TIMESTAMP_FORMAT,
    calendar_columns,
    elapsed_days,
    exact_avg_price,
    min_by_order,
    nullif_blank,
    strip,
    surrogate_key,
)

__all__ = [
    "KEY_TIMESTAMP_FORMAT",
    "calendar_columns",
    "elapsed_days",
    "exact_avg_price",
    "min_by_order",
    "nullif_blank",
    "strip",
    "surrogate_key",
]
