"""Size-checked broadcast for derived lookup tables.

A table derived from the data (per-group means, per-stratum counts, ...) is
broadcast only after ``take(limit + 1)`` proves it has at most ``limit`` rows;
those rows are then re-created as a local relation, so the broadcast side is
exactly what was measured. Beyond the limit the lazy frame is returned and
the caller's join shuffles normally (AQE may still convert it).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_BROADCAST_ROWS = 100_000


def bounded(df: DataFrame, limit: int = DEFAULT_BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """(frame, is_broadcast): a broadcast local copy when rows <= limit."""
    rows = df.take(limit + 1)
    if len(rows) <= limit:
        local = df.sparkSession.createDataFrame(rows, schema=df.schema)
        return F.broadcast(local), True
    return df, False


def bounded_rows(df: DataFrame, limit: int, what: str) -> list:
    """Collect a derived table known to be small; fail loudly if it is not."""
    rows = df.take(limit + 1)
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows; refusing to collect")
    return rows
