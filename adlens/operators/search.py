"""Search over the keyworded page collection (FI1-FI4, PR6, AG8).

All searches are lazy Column predicates, so on a collection stored partitioned by
``category`` the category test becomes a partition filter and the keyword test a
pushed-down row filter; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlens.functions.arrays import any_of
from adlens.schemas import SEARCH_HIT_FIELDS


def by_category(pages: DataFrame, category: str) -> DataFrame:
    """FI1: pages whose category equals ``category`` exactly (case-sensitive)."""
    return pages.filter(F.col("category") == F.lit(category))


def by_keywords(pages: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """FI2: pages whose stored keywords contain at least one of ``keywords`` (exact match)."""
    return pages.filter(any_of("keywords", list(keywords)))


def search(pages: DataFrame, keywords: Sequence[str], category: str | None = None) -> DataFrame:
    """FI3/FI4: keyword search, restricted to ``category`` when it is given and not empty."""
    if category:
        return by_keywords(by_category(pages, category), keywords)
    return by_keywords(pages, keywords)


def hits(results: DataFrame, key: str | None = None) -> DataFrame:
    """PR6: the search-hit projection (drops ``content``); keeps ``key`` first if given."""
    cols = ([key] if key and key not in SEARCH_HIT_FIELDS else []) + SEARCH_HIT_FIELDS
    return results.select(*cols)


def total(results: DataFrame) -> DataFrame:
    """AG8: one row with the number of hits."""
    return results.agg(F.count(F.lit(1)).alias("total"))
