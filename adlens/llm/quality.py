"""Quality classifier: a factorisation machine (operator 8).

Features of a text: its words hashed to ``BUCKETS`` (weighted by 1 + log count, scaled to unit
length), structure statistics (shares of capitals, digits, signs, white space; word and line
lengths; repeated words and lines) and the length of the text as metadata, in bins of one
feature each.  The machine adds to a linear score the interactions of all pairs of features,
<v_i, v_j> x_i x_j, computed in linear time as half of (sum v x)^2 - sum (v x)^2.

It is fitted on a bounded sample of labelled training documents (``SAMPLE`` = 20,000 on
average): their features are written once, every round each partition improves the model on its rows by
mini-batch AdaGrad, and the partitions' models are averaged.

Null and empty texts score by the empty features.  Without labelled rows of both kinds scores are 0.5.
Texts are scored whole, every row for itself, rows without an id or with a repeated one too; equal texts
score the same; an empty table gives no rows.  Other columns than ``doc_id`` and ``text`` are not read,
so none can clash.  In training, of rows that share an id the least text counts, and of its labels the larger.
"""

from __future__ import annotations

import collections
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlens.llm.samples import labelled_sample
from adlens.llm.tables import materialize

SAMPLE = 20_000
BUCKETS = 1 << 14
STATS = 12
BINS = 10
SIZE = BUCKETS + STATS * BINS
RANK = 8
ROUNDS = 8
PARTS = 6
RATE = 0.1
DECAY = 1e-4
_BATCH = 64


def _stats(text: bytes, words: list[bytes]) -> list[float]:
    """Numbers in 0 to 1."""
    n, kinds = max(len(text), 1), np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    letters = kinds[65:91].sum() + kinds[97:123].sum() + kinds[128:].sum()
    signs = kinds[33:48].sum() + kinds[58:65].sum() + kinds[91:97].sum() + kinds[123:127].sum()
    lines = text.split(b"\n")
    w, distinct = max(len(words), 1), len(set(words))
    ends = sum(x[-1] in b".!?" for x in words)
    return [letters / n, min(1.0, 2 * signs / n), min(1.0, 5 * kinds[48:58].sum() / n),
            kinds[65:91].sum() / max(letters, 1), kinds[9:33].sum() / n, min(1.0, math.log1p(len(words)) / 12),
            min(1.0, len(text) / w / 20), distinct / w, len(set(lines)) / len(lines),
            min(1.0, math.log1p(n / len(lines)) / 10), min(1.0, 4 * ends / w), min(1.0, math.log1p(n) / 14)]


def features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values."""
    words = text.lower().split() if text else []
    bag = collections.Counter(words)
    ids = [zlib.crc32(w) % BUCKETS for w in bag]
    values = 1 + np.log(np.fromiter(bag.values(), float, len(bag)))
    if len(bag):
        values /= np.sqrt((values ** 2).sum())
    stats = [BUCKETS + BINS * i + min(BINS - 1, int(s * BINS)) for i, s in enumerate(_stats(text or b"", words))]
    return np.array(ids + stats, np.int32), np.concatenate([values, np.full(STATS, 0.3)])


class Machine:
    """Parameters as one array: row i holds w_i and v_i; the last row's first entry is the bias."""

    @staticmethod
    def start(seed: int = 5) -> np.ndarray:
        table = np.random.default_rng(seed).normal(0, 0.05, (SIZE + 1, RANK + 1))
        table[:, 0] = 0
        table[-1] = 0
        return table

    @staticmethod
    def raw(table, ids, values, starts):
        """Scores of the documents whose features begin at ``starts``, and their factor sums."""
        part = table[ids] * values[:, None]
        total = np.add.reduceat(part, starts, axis=0)
        squares = np.add.reduceat((part[:, 1:] ** 2).sum(axis=1), starts)
        return table[-1, 0] + total[:, 0] + 0.5 * ((total[:, 1:] ** 2).sum(axis=1) - squares), total[:, 1:]

    @staticmethod
    def improve(table, grads, ids, values, starts, y):
        """One AdaGrad step on a mini-batch."""
        score, total = Machine.raw(table, ids, values, starts)
        error = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - y
        owner = np.repeat(np.arange(len(y)), np.diff(np.append(starts, len(ids))))
        step = np.empty((len(ids), RANK + 1))
        step[:, 0] = values
        step[:, 1:] = values[:, None] * (total[owner] - table[ids, 1:] * values[:, None])
        step *= error[owner, None]
        at, inverse = np.unique(ids, return_inverse=True)
        g = np.zeros((len(at), RANK + 1))
        np.add.at(g, inverse, step)
        g = g / len(y) + DECAY * table[at]
        grads[at] += g * g
        table[at] -= RATE * g / np.sqrt(grads[at] + 1e-8)
        bias = error.mean()
        grads[-1, 0] += bias * bias
        table[-1, 0] -= RATE * bias / math.sqrt(grads[-1, 0] + 1e-8)


def _featured(docs: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            rows = [features(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.float64())),
                 b.column(1)], ["ids", "values", "y"])
    return docs.select(F.col("text").cast("binary").alias("text"), F.col("y").cast("double").alias("y")) \
        .mapInArrow(run, "ids array<int>, values array<double>, y double")


def train(docs: DataFrame, labels: DataFrame, training, rows: int = SAMPLE, rounds: int = ROUNDS) -> np.ndarray | None:
    """Parameters fitted to ``labels(doc_id, quality)`` rows for which ``training`` holds."""
    sc = docs.sparkSession.sparkContext
    sample = labelled_sample(docs, labels, "quality", training, rows)
    points = materialize(_featured(sample).repartition(PARTS), "quality-features")
    if points.select("y").distinct().count() < 2:
        return None
    table = Machine.start()
    for turn in range(rounds):
        shared = sc.broadcast(table)

        def improved(batches, shared=shared, turn=turn):
            rows = [r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist())]
            if rows:
                own, grads = shared.value.copy(), np.zeros((SIZE + 1, RANK + 1))
                order = np.random.default_rng(turn).permutation(len(rows))
                for at in range(0, len(rows), _BATCH):
                    part = [rows[i] for i in order[at:at + _BATCH]]
                    sizes = [len(r[0]) for r in part]
                    Machine.improve(own, grads, np.concatenate([r[0] for r in part]).astype(int),
                                    np.concatenate([r[1] for r in part]),
                                    np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.array([r[2] for r in part]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([own.astype(np.float32).tobytes()]), pa.array([len(rows)], pa.int64())], ["model", "n"])
        # At most one model per partition of the bounded sample comes back.
        models = points.mapInArrow(improved, "model binary, n long").collect()
        weight = sum(r["n"] for r in models)
        table = sum(np.frombuffer(r["model"], np.float32).reshape(SIZE + 1, RANK + 1).astype(float) * (r["n"] / weight)
                    for r in models)
    return table.astype(np.float32)


def score(docs: DataFrame, table: np.ndarray | None) -> DataFrame:
    """``(doc_id, score)`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        table = shared.value
        for b in batches:
            scores = []
            for text in b.column(1).to_pylist():
                if table is None:
                    scores.append(0.5)
                    continue
                ids, values = features(text)
                raw = float(Machine.raw(table, ids, values, np.array([0]))[0][0])
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, raw)))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")) \
        .mapInArrow(run, "doc_id long, score double")
