"""Size checks that guard the broadcasts of the library.

A side is broadcast only when its row count is proven below a bound (counting stops at
the bound, so the check itself is cheap on a large side) and its row width is bounded by
its schema.  Beyond the bound the caller gets a plain join, which Spark plans as a
sort-merge join with adaptive skew splitting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Default byte budget for one broadcast side (Spark's own hard limit is 8 GB; we stay far below).
DEFAULT_BROADCAST_BYTES = 256 * 1024 * 1024


def count_at_most(df: DataFrame, bound: int) -> int:
    """Row count of ``df``, but stops counting once it exceeds ``bound`` (returns bound+1)."""
    return df.limit(bound + 1).count()


def rows_fit(df: DataFrame, max_rows: int) -> bool:
    return count_at_most(df, max_rows) <= max_rows


def maybe_broadcast(df: DataFrame, row_bytes: int, max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """``broadcast(df)`` if rows * row_bytes fits the budget, else ``df`` unchanged."""
    max_rows = max(1, max_bytes // max(1, row_bytes))
    return F.broadcast(df) if rows_fit(df, max_rows) else df
