"""Small helpers the operators share: table access, written intermediates, row ranks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from adlens.session import materialize

__all__ = ["materialize", "rank_within", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def crc_mod(id_col: str, m: int):
    """crc32 of the id as text, modulo ``m`` (the split into training and held-out rows)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % m


def rank_within(df: DataFrame, key: str, order: list[str], rows: int, rank: str) -> DataFrame:
    """Zero-based rank of every row among the rows with its ``key``.

    A key may hold most of the table, so its rows are first dealt into about sqrt(rows)
    salts; rows are numbered inside (key, salt) and shifted by the sizes of the salts
    before.  No window sees more than about sqrt(rows) rows of one key, if ``order`` tells
    rows apart (by a written position, for instance): rows equal in it share a salt.
    """
    salts = max(1, math.isqrt(max(rows, 1)))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    sizes = salted.groupBy(key, "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(key, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    within = Window.partitionBy(key, "_salt").orderBy(*order)
    numbered = salted.withColumn("_i", F.row_number().over(within))
    return (numbered.join(shifts, [key, "_salt"])
            .withColumn(rank, (F.col("_i") - 1 + F.col("_shift")).cast("long"))
            .drop("_salt", "_i", "_shift"))
