"""Collection analytics: pages per category, top keywords per category, pages per period.

Skew: every aggregate here is hash-aggregated with a map-side partial step, so a
category holding a third of all pages sends one partial row per map task, not its rows.
The per-category top-k runs as a ``rank <= k`` window, which Spark plans with a
partial group limit before the exchange; only ``k`` rows per category per task move.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adlens.functions.time import bucket, bucket_key, period_unit
from adlens.schemas import KEYWORDS_PER_CATEGORY


def pages_per_category(pages: DataFrame, size: int | None = None) -> DataFrame:
    """AG2: pages of every category; NULL category ignored.  TK2: with ``size`` only the
    largest ones (count desc, name asc)."""
    counts = (pages.filter(F.col("category").isNotNull())
              .groupBy("category").agg(F.count(F.lit(1)).alias("count")))
    return counts if size is None else counts.orderBy(F.desc("count"), F.asc("category")).limit(size)


def top_keywords_per_category(pages: DataFrame, k: int = KEYWORDS_PER_CATEGORY,
                              as_rows: bool = False) -> DataFrame:
    """AG3: the ``k`` keywords stored on most pages of each category.

    Rank is (pages desc, keyword asc).  Returns ``(category, keywords array)`` or, with
    ``as_rows``, ``(category, rank, keyword, pages)``.
    """
    return ranked_keywords(pages_per_keyword(pages), k, as_rows)


def pages_per_keyword(pages: DataFrame) -> DataFrame:
    """``(category, keyword, pages)``: on how many pages of a category each keyword is stored."""
    return (pages.filter(F.col("category").isNotNull())
            # explode_outer: see keywords.keyword_counts (no inferred pre-filter).
            .select("category", F.explode_outer(F.array_distinct("keywords")).alias("keyword"))
            .filter(F.col("keyword").isNotNull())
            .groupBy("category", "keyword").agg(F.count(F.lit(1)).alias("pages")))


def ranked_keywords(per_kw: DataFrame, k: int = KEYWORDS_PER_CATEGORY, as_rows: bool = False) -> DataFrame:
    """The first ``k`` keywords of each category of ``(category, keyword, pages)``."""
    w = Window.partitionBy("category").orderBy(F.desc("pages"), F.asc("keyword"))
    ranked = per_kw.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    if as_rows:
        return ranked.select("category", "rank", "keyword", "pages")
    # At most k rows per category reach this collect.
    return (ranked.groupBy("category")
            .agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "keyword"))),
                             lambda r: r["keyword"]).alias("keywords")))


def pages_per_period(pages: DataFrame, period: str | None = "hour", ts: str = "timestamp") -> DataFrame:
    """AG4: pages per calendar hour (default) or day, with empty periods between the
    first and the last filled with 0.  Rows without a timestamp are ignored.

    Output ``(period, count)`` where ``period`` is the bucket start as an ISO string in UTC.
    Rows are counted per period (partial aggregation); see ``filled_periods``.
    """
    unit = period_unit(period)
    zoned = dict(pages.dtypes)[ts] != "timestamp_ntz"
    counts = (pages.filter(F.col(ts).isNotNull())
              .groupBy(bucket(ts, unit, zoned).alias("bucket"))
              .agg(F.count(F.lit(1)).alias("count")))
    return filled_periods(counts, unit)


# Periods that one row of the span stands for before it is laid out.
_STRETCH = 4096


def filled_periods(counts: DataFrame, unit: str) -> DataFrame:
    """``(period, count)`` of ``(bucket, count)`` with 0 for empty periods between the first and the last.
    The span is cut into stretches of bounded length, which are dealt to tasks and laid out there
    (one odd year makes a span of millions of hours), and the counts are joined to it."""
    span = counts.agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi")).filter("lo IS NOT NULL")
    stretch = F.sequence(F.floor(F.col("lo") / _STRETCH), F.floor(F.col("hi") / _STRETCH))
    first = F.col("stretch") * _STRETCH
    all_ = (span.select("lo", "hi", F.explode(stretch).alias("stretch")).repartition("stretch")
            .select("lo", "hi", F.explode(F.sequence(first, first + (_STRETCH - 1))).alias("bucket"))
            .filter("bucket BETWEEN lo AND hi").select("bucket"))
    return (all_.join(counts, "bucket", "left")
            .select(bucket_key("bucket", unit).alias("period"),
                    F.coalesce("count", F.lit(0)).cast("bigint").alias("count")))
