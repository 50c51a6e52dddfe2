"""Page tables laid out for per-page work without a shuffle.

A page table written bucketed by its key (one file per bucket, sorted by key) scans as
hash-partitioned on the key.  Exploding a page's tokens and joining a broadcast side
keep that partitioning, so the per-page aggregation of the classifier (and any join
back on the key) needs no exchange.  Suited to a unique page key: rows sharing one key
share one bucket.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def save_bucketed(df: DataFrame, key: str, buckets: int, path: str, table: str | None = None) -> DataFrame:
    """Write ``df`` as an external table bucketed and sorted by ``key`` at ``path`` (shared
    storage), register it in the session catalog, and return it."""
    name = table or f"adlens_pages_{uuid.uuid4().hex[:12]}"
    (df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
     .option("path", path).mode("overwrite").saveAsTable(name))
    return df.sparkSession.table(name)
