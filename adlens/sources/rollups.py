"""Reports on a growing collection (AG2, AG3, AG4): counts kept for each write, merged when read.

A committed write of the collection never changes, so its counts need to be taken once: pages per
category, pages per category and keyword, pages per hour.  They are written under the write's id as
a committed write of their own (``sources/commits``) below ``<collection>/_rollups``, and a report adds up
those of the writes that count now: it reads counts, not pages.  ``update`` takes the counts of
writes that have none yet; a job that died between its save and its counts, or saves by others,
are caught up by the next update or report.  After a compaction only the new write's counts are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adlens.functions.time import HOURS, bucket
from adlens.operators import analytics
from adlens.schemas import KEYWORDS_PER_CATEGORY
from adlens.sources import collection, commits

_SCHEMA = T.StructType([
    T.StructField("category", T.StringType()), T.StructField("keyword", T.StringType()), T.StructField("hour", T.LongType()),
    T.StructField("n", T.LongType()), T.StructField("kind", T.StringType())])


def _root(path: str) -> str:
    return f"{path.rstrip('/')}/_rollups"


def counts(pages: DataFrame) -> DataFrame:
    """``(kind, category, keyword, hour, n)``: the three counts of some pages, each with map-side partials."""
    none = F.lit(None)
    shape = lambda df, kind: df.select(
        *[F.col(c) if c in df.columns else none.cast(_SCHEMA[c].dataType).alias(c) for c in _SCHEMA.fieldNames()[:-1]],
        F.lit(kind).alias("kind"))
    categories = analytics.pages_per_category(pages).withColumnRenamed("count", "n")
    keywords = analytics.pages_per_keyword(pages).withColumnRenamed("pages", "n")
    hours = pages.filter(F.col("timestamp").isNotNull()).groupBy(bucket("timestamp", "hour", True).alias("hour")) \
        .agg(F.count(F.lit(1)).alias("n"))
    return shape(categories, "category").unionByName(shape(keywords, "keyword")).unionByName(shape(hours, "hour"))


def update(spark: SparkSession, path: str) -> list[str]:
    """Takes the counts of committed writes that have none; returns the ids of all that count now."""
    now, done = sorted(commits.current(spark, path)), commits.markers(spark, _root(path))
    for write_id in now:
        if write_id in done:
            continue

        def write(folder: str, write_id: str = write_id) -> dict:
            own = collection.read(spark, path, writes=[write_id])
            counts(own).write.mode("overwrite").partitionBy("kind").parquet(folder)
            return {}
        commits.write_once(spark, _root(path), write_id, write)
    return now


def save(df: DataFrame, path: str, write_id: str | None = None) -> DataFrame:
    """``collection.save`` that also keeps the counts."""
    saved = collection.save(df, path, write_id=write_id)
    update(df.sparkSession, path)
    return saved


def _kept(spark: SparkSession, path: str, kind: str) -> DataFrame:
    now, folders = update(spark, path), commits.current(spark, _root(path))
    if not now:
        return spark.createDataFrame([], _SCHEMA)
    return spark.read.schema(_SCHEMA).option("basePath", _root(path)).parquet(*[folders[i] for i in now]).where(F.col("kind") == kind)


def pages_per_category(spark: SparkSession, path: str, size: int | None = None) -> DataFrame:
    """AG2 (TK2 with ``size``), as ``analytics.pages_per_category``."""
    merged = _kept(spark, path, "category").groupBy("category").agg(F.sum("n").alias("count"))
    return merged if size is None else merged.orderBy(F.desc("count"), F.asc("category")).limit(size)


def top_keywords_per_category(spark: SparkSession, path: str, k: int = KEYWORDS_PER_CATEGORY, as_rows: bool = False) -> DataFrame:
    """AG3, as ``analytics.top_keywords_per_category``."""
    merged = _kept(spark, path, "keyword").groupBy("category", "keyword").agg(F.sum("n").alias("pages"))
    return analytics.ranked_keywords(merged, k, as_rows)


def pages_per_period(spark: SparkSession, path: str, period: str | None = "hour") -> DataFrame:
    """AG4, as ``analytics.pages_per_period`` of the timestamps."""
    unit = analytics.period_unit(period)
    merged = _kept(spark, path, "hour").groupBy(F.floor(F.col("hour") / HOURS[unit]).alias("bucket")) \
        .agg(F.sum("n").alias("count"))
    return analytics.filled_periods(merged, unit)
