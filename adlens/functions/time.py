"""Date-bucket column expressions, the same in any session time zone.

A bucket is a whole number of hours or days since 1970: of the instant in UTC for a
``timestamp``, of the wall clock for a ``timestamp_ntz``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
HOURS = {"hour": 1, "day": 24}


def period_unit(period: str | None) -> str:
    """DT1: ``day`` (any case) means days; anything else, also None, means hours."""
    return "day" if (period or "").lower() == "day" else "hour"


def bucket(ts: str, unit: str, zoned: bool) -> Column:
    """Number of the hour/day containing ``ts`` (``zoned``: a ``timestamp``, not an NTZ)."""
    micros = F.unix_micros(ts) if zoned else F.expr(f"timestampdiff(MICROSECOND, {_EPOCH}, `{ts}`)")
    size = F.lit(HOURS[unit] * 3_600_000_000)
    return ((micros - F.pmod(micros, size)) / size).cast("long")


def bucket_key(number: str, unit: str) -> Column:
    """DT2: the bucket's start as an ISO-8601 string in UTC."""
    start = F.expr(f"CAST(timestampadd({unit.upper()}, CAST(`{number}` AS INT), {_EPOCH}) AS STRING)")
    return F.concat(F.replace(start, F.lit(" "), F.lit("T")), F.lit(".000Z"))
