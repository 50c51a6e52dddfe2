"""Shared by the vector searches: usable rows, search grid, tree merge of top lists.

Candidates are dealt to shards by a hash of their id and vector, queries to tiles; a grid cell is one
shard and one tile.  A task holds a shard of bounded size and streams the tile's queries past it
in Arrow batches, so tiles may be large (``TILE_ROWS``): queries travel once to every shard,
candidates once per tile, which is far less.  Each cell keeps ``k`` rows per query; the lists are
merged in a tree of ``FAN`` shards a level.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TILE_ROWS = 1 << 20
SHARD_CELLS = 1 << 22  # components of a shard's vectors
FAN = 16


def usable(vectors: DataFrame) -> DataFrame:
    """``(vec_id, embedding array<double>, dim)`` of rows with an id and finite components."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding")) \
        .where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(F.coalesce(finite, F.lit(False))) \
        .withColumn("dim", F.size("embedding"))


def queries_of(vectors: DataFrame, every: int) -> DataFrame:
    """``(query_id, query, dim)``: one row per id divisible by ``every`` (of rows that repeat
    an id, the least vector)."""
    return vectors.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")) \
        .agg(F.min("embedding").alias("query")).withColumn("dim", F.size("query"))


def at_most(vectors: DataFrame, k: int) -> DataFrame:
    """Of equal rows (id and vector) the first ``k``: no top list of ``k`` can hold more."""
    return vectors.groupBy("vec_id", "embedding", "dim").count() \
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("count", F.lit(k)).cast("int")))).drop("count")


def measure(vectors: DataFrame) -> tuple[int, int]:
    """Rows, and those that hold ``SHARD_CELLS`` components at the largest length."""
    seen = vectors.agg(F.count("*").alias("n"), F.max("dim").alias("dim")).first()
    return seen["n"], max(1, SHARD_CELLS // max(1, seen["dim"] or 1))


def shard_count(rows: int, per_root: int, least: int, most: int) -> int:
    """Shards of about ``per_root`` * sqrt(rows) rows, within bounds."""
    return max(1, math.ceil(rows / min(most, max(least, per_root * math.isqrt(max(rows, 1))))))


def tile_count(rows: int) -> int:
    return max(1, math.ceil(rows / TILE_ROWS))


def sharded(vectors: DataFrame, shards: int) -> DataFrame:
    keys = [c for c in ("vec_id", "embedding", "copy") if c in vectors.columns]
    return vectors.withColumn("shard", F.pmod(F.xxhash64(*keys), F.lit(shards)).cast("int"))


def each(df: DataFrame, count: int, name: str) -> DataFrame:
    """Every row once for each of ``count`` shards or tiles."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(count - 1))))


def tiled(queries: DataFrame, tiles: int) -> DataFrame:
    return queries.withColumn("tile", F.pmod(F.xxhash64("query_id", F.lit("tile")), F.lit(tiles)).cast("int"))


_CELL = ["shard", "tile", "dim"]


def cells(candidates: DataFrame, asked: DataFrame, shards: int, hold, answer, schema: str) -> DataFrame:
    """Every query of ``asked(query_id, query, dim)`` against every row of ``candidates(shard, dim, ...)`` of
    its length: ``hold(batches)`` makes what a cell keeps of its shard, ``answer(held, batch)``
    gives the rows (``schema``) of a batch of queries."""
    tiles = tile_count(asked.count())
    left = each(candidates, tiles, "tile").withColumn("is_query", F.lit(False))
    right = each(tiled(asked, tiles), shards, "shard").withColumn("is_query", F.lit(True))
    both = left.unionByName(right, allowMissingColumns=True).repartition(shards * tiles, *_CELL) \
        .sortWithinPartitions(*_CELL, "is_query")

    def run(batches):
        key, kept, held = None, [], None
        for piece in _pieces(batches):
            at = tuple(piece.column(c)[0].as_py() for c in _CELL)
            if at != key:
                key, kept, held = at, [], None
            if not piece.column("is_query")[0].as_py():
                kept.append(piece)
            elif kept or held is not None:
                if held is None:
                    held, kept = hold(kept), []
                yield from answer(held, piece)
    return both.mapInArrow(run, schema)


def _pieces(batches):
    """The batches, cut where the cell or the kind of row changes."""
    for b in batches:
        marks = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (*_CELL, "is_query")])
        edges = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
        for a, z in zip(edges, edges[1:]):
            if z > a:
                yield b.slice(a, z - a)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A batch's vectors, all of length ``dim``, as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` highest scores, ties to the smaller id (``ids`` ascending)."""
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        kept = np.flatnonzero(scores >= kth)
    else:
        kept = np.arange(len(scores))
    return kept[np.argsort(-scores[kept], kind="stable")][:k]


def tree_merge(lists: DataFrame, shards: int, k: int, *finer: str) -> DataFrame:
    """``(query_id, shard, vec_id, score, *finer)`` -> ``(query_id, rank, vec_id, score)``; equal
    scores rank by the columns ``finer``, highest first, then by the smaller id."""
    order = [F.desc("score"), *map(F.desc, finer), F.asc("vec_id")]
    while shards > FAN:
        shards = math.ceil(shards / FAN)
        lists = lists.withColumn("shard", F.floor(F.col("shard") / FAN).cast("int"))
        nth = F.row_number().over(Window.partitionBy("query_id", "shard").orderBy(*order))
        lists = lists.withColumn("rank", nth).where(F.col("rank") <= k).drop("rank")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return lists.withColumn("rank", nth).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
