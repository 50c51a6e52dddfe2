"""An inverted index over the stored keywords (FI2, FI4, AR1).

The index is a Parquet table of postings ``(keyword, category, key)``, one for every keyword of every
page, range-partitioned and sorted by keyword, then category and key.  A search for some keywords is a
pushed-down ``IN`` filter: min/max statistics leave the few row groups that can hold them, and a
keyword of a third of all pages is spread over as many ranges as its postings fill.  The
postings found are joined back to the collection by ``(category, key)``: few of them are broadcast, so
that the collection is read only in their categories (dynamic partition pruning) and, up to
``PUSHED_KEYS`` keys, only in row groups that can hold the keys; many take a plain join.

A page is found if its stored keywords hold a searched one, as ``search.by_keywords`` decides: the
join only narrows what is read.  Pages without key, repeated keys, the empty and the null category
are found too.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlens.operators.search import by_keywords
from adlens.operators.sizing import DEFAULT_BROADCAST_BYTES, count_at_most
from adlens.sources import collection

# Postings are small: short row groups prune better.
ROW_GROUP_BYTES = 4 * 1024 * 1024
# So many keys at most are collected and pushed to the collection's scan.
PUSHED_KEYS = 1000
# A posting's bytes in a broadcast: category and key are short strings or numbers.
_POSTING_BYTES = 256


def postings(pages: DataFrame, key: str) -> DataFrame:
    """``(keyword, category, key)`` of every distinct keyword of every page."""
    # explode_outer: see keywords.keyword_counts (no inferred pre-filter).
    return (pages.select(F.explode_outer(F.array_distinct("keywords")).alias("keyword"), "category", key)
            .filter(F.col("keyword").isNotNull()))


def build(pages: DataFrame, path: str, key: str, mode: str = "overwrite") -> None:
    """Write the index of ``pages`` (``append``: add the postings of further pages; every write is
    sorted by itself, so each adds files that prune alike)."""
    order = ["keyword", "category", key]
    (postings(pages, key).repartitionByRange(*order).sortWithinPartitions(*order)
     .write.mode(mode).option("parquet.block.size", str(ROW_GROUP_BYTES)).parquet(path))


def lookup(spark: SparkSession, path: str, keywords: Sequence[str], category: str | None = None) -> DataFrame:
    """Distinct ``(category, key)`` of pages that hold any of ``keywords`` (in ``category``, if given
    and not empty)."""
    found = spark.read.parquet(path).filter(F.col("keyword").isin(sorted(set(keywords))))
    if category:
        found = found.filter(F.col("category") == category)
    return found.drop("keyword").distinct()


def search(pages: DataFrame, path: str, key: str, keywords: Sequence[str], category: str | None = None) -> DataFrame:
    """FI2-FI4 on the collection ``pages`` (as ``collection.read`` gives it) through the index at
    ``path``: the same rows as ``search.search``."""
    found = lookup(pages.sparkSession, path, keywords, category)
    fits = DEFAULT_BROADCAST_BYTES // _POSTING_BYTES
    n = count_at_most(found, fits)
    hits = found.select(F.col("category").alias("_category"), F.col(key).alias("_key"))
    if category:
        pages = pages.filter(F.col("category") == category)
    if n <= PUSHED_KEYS:
        rows = hits.collect()
        pages = pages.filter(_any(F.col(key), {r["_key"] for r in rows}) & _any(F.col("category"), {r["_category"] for r in rows}))
    same = F.col("category").eqNullSafe(F.col("_category")) & F.col(key).eqNullSafe(F.col("_key"))
    held = pages.join(F.broadcast(hits) if n <= fits else hits, same, "left_semi")
    return by_keywords(held, keywords)


def _any(c, values: set):
    """``c`` is one of ``values``, which may hold null."""
    tests = [c.isin([v for v in values if v is not None])] + [c.isNull()] * (None in values)
    return functools.reduce(lambda a, b: a | b, tests)


def read(spark: SparkSession, path: str, index: str, key, keywords: Sequence[str], category: str | None = None) -> DataFrame:
    """``search`` on the stored collection at ``path``; ``key`` is the key's ``StructField``."""
    return search(collection.read(spark, path, schema=collection.collection_schema(key)), index, key.name, keywords, category)
