"""Broadcast only behind a checked size bound.

A dimension is broadcast when its rows and its bytes are proven below their bounds;
otherwise the join stays a shuffle join (and AQE may still turn it into a broadcast at
runtime from measured stage sizes).  One aggregate over the small side checks both.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: far below the driver's and an executor's memory, whatever the number of rows
MAX_BROADCAST_BYTES = 64 << 20


def checked_broadcast(df: DataFrame, max_rows: int, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``broadcast(df)`` if ``df`` has at most ``max_rows`` rows and ``max_bytes`` bytes
    (values as text), else ``df`` unchanged."""
    width = reduce(add, [F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in df.columns])
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(df) if rows <= max_rows and size <= max_bytes else df
