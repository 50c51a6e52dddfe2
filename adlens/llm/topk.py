"""Exact top-k by integer inner product (operator 6).

Components become floor(scale * x).  A grid cell (``vectors.cells``) multiplies its queries with its shard in
tiles of bounded size and selects each query's ``k`` highest (ties to the smaller id);
top lists merge in a tree over shards.  Products run in float64, which is exact while
dim * max * max stays under 2^53, and else in Python integers.  Sums beyond a long rank by their
exact value, which travels with the lists as ordered bytes; ``score`` shows them at a long's ends.

Vectors that are null or hold null or non-finite components (also once scaled), and rows without an id,
take no part; vectors meet those of their own length only; a query never meets rows of its id.
Rows that repeat an id are candidates each (equal rows at most ``k`` times, as no list holds more), and of
a query's the least vector asks; an empty table gives no rows.  Other columns than ``vec_id`` and
``embedding`` are not read, so none can clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlens.llm import vectors as V

SCALE = 256.0
_SCORES_AT_ONCE = 1 << 22
_LONG = (1 << 63) - 1


def _exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    reach = q.shape[1] * np.abs(q).max(initial=0) * np.abs(c).max(initial=0)
    if reach < 2.0 ** 53:
        return q @ c.T
    other = [[int(x) for x in row] for row in c]
    return np.array([[sum(int(a) * b for a, b in zip(row, o)) for o in other] for row in q], object).reshape(len(q), len(c))


def _held(score: int) -> int:
    return max(-_LONG, min(_LONG, score))


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.vectorize(lambda s: _held(int(s)), otypes=[object])(_exact(q, c))


def _wide(score: int) -> bytes:
    """Bytes in the order of scores that ``_held`` may have changed (products of doubles are below 2^2100)."""
    return (score + (1 << 2103)).to_bytes(264, "big") if abs(score) >= _LONG else b""


class Shard:
    """One cell's candidates."""

    def __init__(self, pieces: list[pa.RecordBatch], scale: float):
        dim = pieces[0].column("dim")[0].as_py()
        ids = np.concatenate([p.column("vec_id").to_numpy() for p in pieces])
        order = np.argsort(ids, kind="stable")
        self.ids, self.dim, self.scale = ids[order], dim, scale
        self.c = np.floor(scale * np.concatenate([V.matrix(p.column("embedding"), dim) for p in pieces]))[order]
        self.shard = pieces[0].column("shard")[0].as_py()

    def best(self, asked: pa.RecordBatch, k: int):
        step = max(1, _SCORES_AT_ONCE // len(self.ids))
        for at in range(0, asked.num_rows, step):
            part = asked.slice(at, step)
            queries, ids, scores = [], [], []
            rows = _exact(np.floor(self.scale * V.matrix(part.column("query"), self.dim)), self.c)
            for own, row in zip(part.column("query_id").to_pylist(), rows):
                other = self.ids != own
                pos = V.best(row[other], self.ids[other], k)
                queries += [own] * len(pos)
                ids.append(self.ids[other][pos])
                scores += [int(s) for s in row[other][pos]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(queries, pa.int64()), pa.array([self.shard] * len(queries), pa.int64()),
                 pa.array(np.concatenate(ids)), pa.array([_held(s) for s in scores], pa.int64()),
                 pa.array([_wide(s) for s in scores], pa.binary())], ["query_id", "shard", "vec_id", "score", "wide"])


def top_k(vectors: DataFrame, every: int, k: int, scale: float = SCALE) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for every row whose id is divisible by ``every``."""
    rows = V.usable(vectors).where(F.forall("embedding", lambda x: F.abs(x * scale) < float("inf")))
    n, room = V.measure(rows)
    shards = V.shard_count(n, 4, 512, room)
    lists = V.cells(V.sharded(V.at_most(rows, k), shards), V.queries_of(rows, every), shards,
                    lambda pieces: Shard(pieces, scale), lambda shard, asked: shard.best(asked, k),
                    "query_id long, shard long, vec_id long, score long, wide binary")
    return V.tree_merge(lists, shards, k, "wide")
