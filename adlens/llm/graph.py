"""Approximate nearest neighbours on robust-pruned directed graphs (operator 4).

Every shard holds one graph over its distinct vectors (copies are listed with their node).
Nodes start with random neighbours; twice, in random order, batches of nodes search
greedily from the medoid for their nearest nodes, keep diverse edges by relaxed
distance pruning (a candidate goes if a kept neighbour is ``alpha`` times nearer to it than the
node is) and add the edges back.  The index is written as a table.  A query searches each shard
by beam search, with a beam that grows as the root of the shard's nodes, as recall would fall
with a fixed one; shards hold up to ``SHARD_ROWS`` rows, for which this is measured, and more
vectors make more shards; the shard's graph is held and queries stream past it
(``vectors.cells``); the nodes found are scored by cosine on the original vectors in double
precision, and top lists merge in a tree.

Vectors that are null, zero or hold null or non-finite components, and rows without an id,
take no part; vectors meet those of their own length only; a query never meets its own id.
Rows that repeat an id are candidates each (equal rows at most ``k`` times), and of a query's the least
vector asks; an empty table gives no rows.  Other columns than ``vec_id`` and ``embedding`` are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlens.llm import vectors as V
from adlens.llm.tables import materialize

DEGREE = 24
BUILD_BEAM = 48
SEARCH_BEAM = 96  # the least
BEAM_ROOT = 3  # times the root of a shard's nodes
SHARD_ROWS = 1 << 14
ALPHA = 1.2
WIDTH = 4
BATCH = 256
_FAR = np.float32(np.inf)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _distance(x: np.ndarray, ids: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of ``q``'s rows to the rows ``ids`` (row by row); -1 is far away."""
    d = np.maximum(2 - 2 * np.einsum("bmd,bd->bm", x[ids], q), 0)
    return np.where(ids >= 0, d, _FAR)


def beam_search(x: np.ndarray, graph: np.ndarray, start: int, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``q`` the ``beam`` nearest nodes met (ids, squared distances), nearest first."""
    n, rows = len(x), np.arange(len(q))[:, None]
    beam = min(beam, n)
    ids = np.full((len(q), beam), -1, np.int32)
    ids[:, 0] = start
    dist = _distance(x, ids, q)
    met = np.zeros((len(q), n + 1), bool)  # column n takes the padding
    met[:, start] = True
    done = ids < 0
    while not done.all():
        # Open the nearest nodes not yet opened, WIDTH of them per query.
        turn = np.where(done, _FAR, dist)
        pick = np.argsort(turn, axis=1, kind="stable")[:, :WIDTH]
        opened = np.where(np.take_along_axis(done, pick, 1), -1, np.take_along_axis(ids, pick, 1))
        np.put_along_axis(done, pick, True, 1)
        near = np.where((opened >= 0)[:, :, None], graph[opened], -1).reshape(len(q), -1)
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[met[rows, near]] = -1
        met[rows, np.where(near < 0, n, near)] = True
        all_ids = np.concatenate([ids, near], axis=1)
        all_dist = np.concatenate([dist, _distance(x, near, q)], axis=1)
        all_done = np.concatenate([done, near < 0], axis=1)
        order = np.argsort(all_dist, axis=1, kind="stable")[:, :beam]
        ids, dist, done = (np.take_along_axis(a, order, 1) for a in (all_ids, all_dist, all_done))
    return ids, dist


def robust_prune(x: np.ndarray, nodes: np.ndarray, cands: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """For each node its kept neighbours among its candidates (rows, -1 padded)."""
    cands = np.sort(np.where(cands == nodes[:, None], -1, cands), axis=1)
    cands[:, 1:][cands[:, 1:] == cands[:, :-1]] = -1
    own = _distance(x, cands, x[nodes])
    alive, vec = cands >= 0, x[cands]
    out = np.full((len(nodes), degree), -1, np.int32)
    rows = np.arange(len(nodes))
    for i in range(degree):
        near = np.where(alive, own, _FAR).argmin(axis=1)
        some = alive[rows, near]
        if not some.any():
            break
        out[some, i] = cands[rows, near][some]
        between = np.maximum(2 - 2 * np.einsum("bmd,bd->bm", vec, vec[rows, near]), 0)
        alive &= ~((alpha * alpha * between <= own) & some[:, None])
        alive[rows, near] = False
    return out


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 7):
    """``(graph, start)`` over unit vectors ``x``."""
    n, rng = len(x), np.random.default_rng(seed)
    start = int((x @ x.mean(axis=0)).argmax())
    graph = np.full((n, degree), -1, np.int32)
    if n > 1:
        first = rng.integers(0, n - 1, (n, min(degree // 2, n - 1)))
        graph[:, :first.shape[1]] = first + (first >= np.arange(n)[:, None])
    for relaxed in (1.0, alpha):
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            nodes = order[at:at + BATCH]
            found, _ = beam_search(x, graph, start, x[nodes], beam)
            graph[nodes] = robust_prune(x, nodes, np.concatenate([found, graph[nodes]], axis=1), relaxed, degree)
            _add_back(x, graph, nodes, relaxed)
    return graph, start


def _add_back(x: np.ndarray, graph: np.ndarray, nodes: np.ndarray, alpha: float) -> None:
    degree = graph.shape[1]
    heads, tails = graph[nodes].ravel(), np.repeat(nodes, degree).astype(np.int32)
    tails, heads = tails[heads >= 0], heads[heads >= 0]
    new = ~(graph[heads] == tails[:, None]).any(axis=1)
    order = np.argsort(heads[new], kind="stable")
    heads, tails = heads[new][order], tails[new][order]
    if not len(heads):
        return
    at, first, many = np.unique(heads, return_index=True, return_counts=True)
    wide = np.full((len(at), many.max()), -1, np.int32)
    wide[np.repeat(np.arange(len(at)), many), np.arange(len(heads)) - np.repeat(first, many)] = tails
    joined = np.concatenate([graph[at], wide], axis=1)
    room = (joined >= 0).sum(axis=1) <= degree
    packed = np.take_along_axis(joined, np.argsort(joined < 0, axis=1, kind="stable"), 1)[:, :degree]
    graph[at[room]] = packed[room]
    if not room.all():
        graph[at[~room]] = robust_prune(x, at[~room], joined[~room], alpha, degree)


def _index_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows of one shard -> one row per distinct vector: its ids and its neighbours."""
    ids = pdf["vec_id"].to_numpy()
    vectors, inverse = np.unique(np.stack(pdf["embedding"].to_list()), axis=0, return_inverse=True)
    by_node = np.lexsort((ids, inverse.ravel()))
    copies = np.split(ids[by_node], np.cumsum(np.bincount(inverse.ravel()))[:-1])
    graph, start = build(_unit(vectors).astype(np.float32))
    return pd.DataFrame({
        "shard": pdf["shard"].iloc[0], "dim": pdf["dim"].iloc[0], "node": np.arange(len(vectors)),
        "is_start": np.arange(len(vectors)) == start, "ids": copies,
        "embedding": list(vectors), "neighbours": [row[row >= 0] for row in graph]})


def shards_for(rows: int, room: int = SHARD_ROWS) -> int:
    return V.shard_count(rows, 16, 1024, min(room, SHARD_ROWS))


def beam_for(nodes: int, least: int = SEARCH_BEAM) -> int:
    return max(least, math.ceil(BEAM_ROOT * math.sqrt(nodes)))


def index(vectors: DataFrame, copies: int = DEGREE) -> tuple[DataFrame, int]:
    """The written index, one row per distinct vector of a shard, and the number of shards.
    Rows equal in id and vector are listed ``copies`` times at most, enough for as many neighbours."""
    rows = V.usable(vectors).where(F.exists("embedding", lambda x: x != 0))
    shards = shards_for(*V.measure(rows))
    built = V.sharded(V.at_most(rows, copies), shards).groupBy("shard", "dim").applyInPandas(
        _index_shard, "shard int, dim int, node int, is_start boolean, ids array<long>, "
                      "embedding array<double>, neighbours array<int>")
    return materialize(built, "graph-index"), shards


def _even(vectors: np.ndarray) -> np.ndarray:
    """Vectors scaled by powers of two, so that no square overflows; cosines keep every bit."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


class Shard:
    """One shard's graph, ready to be searched."""

    def __init__(self, nodes: pd.DataFrame):
        nodes = nodes.sort_values("node")
        self.vectors = _even(np.stack(nodes["embedding"].to_list()))
        self.x = _unit(self.vectors).astype(np.float32)
        self.graph = np.full((len(nodes), DEGREE), -1, np.int32)
        for i, near in enumerate(nodes["neighbours"]):
            self.graph[i, :len(near)] = near
        self.start, self.copies = int(nodes["is_start"].to_numpy().argmax()), nodes["ids"].to_list()
        self.shard = int(nodes["shard"].iloc[0])

    def nearest(self, asked: pd.DataFrame, k: int, beam: int) -> pd.DataFrame:
        out, most = {"query_id": [], "shard": [], "vec_id": [], "score": []}, max(k, DEGREE)
        for at in range(0, len(asked), BATCH):
            part = asked.iloc[at:at + BATCH]
            q = _even(np.stack(part["query"].to_list()))
            found, _ = beam_search(self.x, self.graph, self.start, _unit(q).astype(np.float32), beam_for(len(self.x), beam))
            for own, vec, near in zip(part["query_id"], q, found):
                near = near[near >= 0]
                scores = self.vectors[near] @ vec / (np.sqrt((self.vectors[near] ** 2).sum(axis=1)) * np.sqrt(vec @ vec))
                # Of a node's copies the k smallest ids but the query's own (listed ``most`` times at most) are enough.
                ids = [self.copies[i][:k + most] for i in near]
                score = np.repeat(scores, [len(i) for i in ids])
                ids = np.concatenate(ids)
                score, ids = score[ids != own], ids[ids != own]
                top = np.lexsort((ids, -score))[:k]
                out["query_id"] += [own] * len(top)
                out["vec_id"] += ids[top].tolist()
                out["score"] += score[top].tolist()
        out["shard"] = [self.shard] * len(out["score"])
        return pd.DataFrame(out).astype({"query_id": "int64", "shard": "int64", "vec_id": "int64", "score": "float64"})


def _search_cell(nodes: pd.DataFrame, asked: pd.DataFrame, k: int, beam: int) -> pd.DataFrame:
    return Shard(nodes).nearest(asked, k, beam)


_NODE = ["shard", "node", "is_start", "ids", "embedding", "neighbours"]


def search(index_rows: DataFrame, shards: int, asked: DataFrame, k: int, beam: int = SEARCH_BEAM) -> DataFrame:
    """``asked(query_id, query, dim)`` -> ``(query_id, rank, vec_id, score)``."""
    def hold(pieces):
        return Shard(pa.Table.from_batches([p.select(_NODE) for p in pieces]).to_pandas())

    def answer(shard, piece):
        found = shard.nearest(piece.select(["query_id", "query"]).to_pandas(), k, beam)
        yield pa.RecordBatch.from_pandas(found, preserve_index=False)
    lists = V.cells(index_rows, asked, shards, hold, answer, "query_id long, shard long, vec_id long, score double")
    return V.tree_merge(lists, shards, k)


def nearest(vectors: DataFrame, every: int, k: int) -> DataFrame:
    """The ``k`` nearest found of every row whose id is divisible by ``every``."""
    rows = V.usable(vectors).where(F.exists("embedding", lambda x: x != 0))
    index_rows, shards = index(vectors, k)
    return search(index_rows, shards, V.queries_of(rows, every), k)
