"""Join helpers: broadcast only behind a proven size bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Largest relation we broadcast on a *declared* bound (rows x bytes per row).
BROADCAST_LIMIT_BYTES = 256 * 1024 * 1024


def bounded_broadcast(df: DataFrame, max_rows: int | None, row_bytes: int) -> DataFrame:
    """Broadcast ``df`` when its declared row bound keeps it under the limit.

    With no bound the relation is left to the planner: AQE measures the real
    size after the producing stage and converts to a broadcast join only if it
    is under ``spark.sql.adaptive.autoBroadcastJoinThreshold``; otherwise it
    stays a shuffled join (with skew-join splitting enabled).
    """
    if max_rows is not None and max_rows * row_bytes <= BROADCAST_LIMIT_BYTES:
        return F.broadcast(df)
    return df


def vector_row_bytes(dim: int, key_bytes: int = 32) -> int:
    return key_bytes + 8 * dim + 24
