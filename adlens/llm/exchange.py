"""Exact duplicates by exchange of Golomb-coded fingerprints (operator 11).

1. Rows are laid out in *blocks* (a task's rows in reading order, bounded in rows and bytes),
   written once, bucketed by block, so that later steps meet a block's texts without a shuffle.
   Each row carries its fingerprint (the top ``bits`` bits of a hash of the text, ``bits`` being
   log2 of the row count plus 10) and its rank among the block's distinct fingerprints.
2. Every block sends each *owner* (a range of the fingerprints) its sorted distinct fingerprints
   there as Golomb-coded gaps: about log2(owner's range / fingerprints) bits each, not 64.
3. Owners decode, find fingerprints that two blocks or more sent, and answer each block with a
   bitmap, one bit for each fingerprint sent.
4. A row whose bit is set, or whose fingerprint repeats in its own block, is a suspect.  Only
   suspects' texts are shuffled: grouped by their bytes with partial aggregates, so that a text
   that a third of all rows share is one row a task.  Other texts occur once.

Texts are equal when their bytes are; null counts as empty.  Of equal texts the row with the
largest ``doc_id`` stays (rows without one come last; of rows that also repeat the id, the one read
last).  A fingerprint that two texts share only makes a suspect.  Texts of any length pass as they
are; an empty table gives no rows.  Other columns than ``doc_id`` and ``text`` are not read, so none
can clash.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlens.llm.tables import materialize
from adlens.session import scratch_dir

# A block ends at whichever comes first.
BLOCK_ROWS = 1 << 16
BLOCK_BYTES = 32 << 20
# Rows a bucket of the layout should hold, and the most buckets (Spark allows 100,000).
BUCKET_ROWS = 4096
MOST_BUCKETS = 50_000
# A text's group is hot beyond this share of all rows; there are at most as many hot groups.
HOT_SHARE = 4096


def golomb_encode(values: np.ndarray) -> tuple[int, bytes]:
    """``(k, code)`` of ascending distinct integers >= 0: gaps in a Golomb code of parameter
    2^k, chosen by the mean gap; all quotients (unary) first, then all remainders of k bits."""
    gaps = np.diff(values, prepend=-1) - 1
    k = int(max(0, math.floor(math.log2(max(1.0, float(gaps.mean()) * math.log(2))))))
    ends = np.cumsum((gaps >> k) + 1) - 1
    unary = np.ones(ends[-1] + 1, np.uint8)
    unary[ends] = 0
    rest = ((gaps[:, None] >> np.arange(k - 1, -1, -1)) & 1).astype(np.uint8).ravel()
    return k, np.packbits(np.concatenate([unary, rest])).tobytes()


def golomb_decode(n: int, k: int, code: bytes) -> np.ndarray:
    """The ``n`` integers of a code of parameter 2^k."""
    bits = np.unpackbits(np.frombuffer(code, np.uint8))
    ends = np.flatnonzero(bits == 0)[:n]
    quotients = np.diff(ends, prepend=-1) - 1
    start = ends[-1] + 1
    rest = bits[start:start + n * k].reshape(n, k).astype(np.int64) @ (1 << np.arange(k - 1, -1, -1, dtype=np.int64))
    return np.cumsum((quotients << k) + rest + 1) - 1


def _blocks(batches):
    """Adds ``_block``, ``_row`` (its place in the task), ``_rank`` and ``_again``."""
    task = TaskContext.get().partitionId() << 32
    block, row, held, size = 0, 0, [], 0

    def emit():
        fps = np.concatenate([b.column("_fp").to_numpy() for b in held])
        _, rank, times = np.unique(fps, return_inverse=True, return_counts=True)
        at = 0
        for b in held:
            n = b.num_rows
            ranks = rank[at:at + n]
            more = [pa.array(np.full(n, task + block)), pa.array(task + row + at + np.arange(n)),
                    pa.array(ranks.astype(np.int32)), pa.array(times[ranks] > 1)]
            yield pa.RecordBatch.from_arrays(b.columns + more, [*b.schema.names, "_block", "_row", "_rank", "_again"])
            at += n

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.nbytes
        if size >= BLOCK_BYTES or sum(x.num_rows for x in held) >= BLOCK_ROWS:
            yield from emit()
            row += sum(x.num_rows for x in held)
            block, held, size = block + 1, [], 0
    if held:
        yield from emit()


def _laid_out(docs: DataFrame, bits: int, rows: int) -> DataFrame:
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"),
                        F.sha2(text, 256).alias("text_sha256"),
                        F.shiftrightunsigned(F.xxhash64(text), 64 - bits).alias("_fp"))
    ddl = "doc_id long, text string, text_sha256 string, _fp long, _block long, _row long, _rank int, _again boolean"
    name = f"adlens_blocks_{uuid.uuid4().hex[:12]}"
    (plain.mapInArrow(_blocks, ddl).write
     .bucketBy(min(MOST_BUCKETS, rows // BUCKET_ROWS + 1), "_block")
     .option("path", scratch_dir(spark, "blocks")).saveAsTable(name))
    return spark.table(name)


def _sent(laid: DataFrame, shift: int) -> DataFrame:
    """``(_block, owner, start, n, k, code)``: a block's code for each owner; ``start`` is the
    rank of its first fingerprint."""
    lists = laid.groupBy("_block", F.expr(f"shiftright(_fp, {shift})").alias("owner")) \
        .agg(F.min("_rank").alias("start"), F.sort_array(F.collect_set("_fp")).alias("fps"))

    def encode(batches):
        for b in batches:
            owners = b.column("owner").to_pylist()
            codes = [golomb_encode(fps.values.to_numpy() - (owner << shift))
                     for fps, owner in zip(b.column("fps"), owners)]
            yield pa.RecordBatch.from_arrays(
                [b.column("_block"), b.column("owner"), b.column("start"),
                 pa.array([len(f) for f in b.column("fps")], pa.int32()),
                 pa.array([k for k, _ in codes], pa.int32()), pa.array([c for _, c in codes], pa.binary())],
                ["_block", "owner", "start", "n", "k", "code"])
    return lists.mapInArrow(encode, "_block long, owner long, start int, n int, k int, code binary")


def _answer(codes: pa.Table) -> pa.Table:
    """One owner: a bitmap for each list, set where another list holds the fingerprint too."""
    ns = codes.column("n").to_pylist()
    values = np.concatenate([golomb_decode(n, k, c) for n, k, c in
                             zip(ns, codes.column("k").to_pylist(), codes.column("code").to_pylist())])
    _, place, times = np.unique(values, return_inverse=True, return_counts=True)
    shared = times[place] > 1
    maps = [np.packbits(part).tobytes() for part in np.split(shared, np.cumsum(ns)[:-1])]
    return pa.table({"_block": codes.column("_block"), "start": codes.column("start"),
                     "n": codes.column("n"), "bitmap": pa.array(maps, pa.binary())})


def _flags(batches):
    """A block's bitmaps in order of rank, as one byte for each rank."""
    for b in batches:
        out = [b"".join(np.unpackbits(np.frombuffer(p["bitmap"], np.uint8))[:p["n"]].tobytes() for p in parts)
               for parts in b.column("parts").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("_block"), pa.array(out, pa.binary())], ["_block", "flags"])


def suspects(docs: DataFrame, rows: int) -> DataFrame:
    """All ``rows`` rows as ``(doc_id, text, text_sha256, _row, suspect)``; ``suspect`` is true
    wherever another row has the same text (and for about one other row in 1,000)."""
    bits = min(60, max(16, rows.bit_length() + 10))
    owner_bits = max(0, round(math.log2(max(1.0, math.sqrt(rows) / 32))))
    laid = _laid_out(docs, bits, rows)
    answers = _sent(laid, bits - owner_bits).groupBy("owner") \
        .applyInArrow(_answer, "_block long, start int, n int, bitmap binary")
    marks = answers.groupBy("_block").agg(F.sort_array(F.collect_list(F.struct("start", "n", "bitmap"))).alias("parts")) \
        .mapInArrow(_flags, "_block long, flags binary")
    marked = laid.join(materialize(marks, "marks").hint("shuffle_hash"), "_block")
    flag = F.substring("flags", F.col("_rank") + 1, F.lit(1)) == F.lit(b"\x01")
    return marked.select("doc_id", "text", "text_sha256", "_row", (F.col("_again") | flag).alias("suspect"))


def classes(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, keep_id, group_size, kept, text_sha256)`` of every row of
    ``docs(doc_id, text)``: the row of its text that stays, and whether it is this one."""
    rows = docs.count()
    marked = suspects(docs, rows)
    again = marked.where("suspect")
    # Grouped by the text's bytes.  Rows then find their group by the text's SHA-256, which is
    # proven to name one text only: two texts under it stop the job.
    groups = again.groupBy("text_sha256", "text").agg(F.count("*").alias("group_size"),
                                                      F.max(F.struct("doc_id", "_row")).alias("keep"))
    one = F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts share a SHA-256"))).otherwise(F.col("_sha"))
    verified = groups.groupBy(F.col("text_sha256").alias("_sha")).agg(
        F.count("*").alias("texts"), F.first("group_size").alias("group_size"), F.first("keep").alias("keep"))
    verified = materialize(verified.select(one.alias("_sha"), "group_size", F.col("keep.doc_id").alias("keep_id"),
                                           F.col("keep._row").alias("keep_row")), "groups")
    least = F.lit(max(1, rows // HOT_SHARE))
    hot = F.broadcast(verified.where(F.col("group_size") > least))
    hot_texts = F.broadcast(verified.where(F.col("group_size") > least).select("_sha"))
    rest = verified.where(F.col("group_size") <= least)
    same = F.col("text_sha256") == F.col("_sha")
    found = again.join(hot, same).unionByName(
        again.join(hot_texts, same, "left_anti").join(rest, same))
    once = marked.where(~F.col("suspect")).select(
        "doc_id", "text", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256")
    return once.unionByName(found.select("doc_id", "text", "keep_id", "group_size",
                                         (F.col("_row") == F.col("keep_row")).alias("kept"), "text_sha256"))
