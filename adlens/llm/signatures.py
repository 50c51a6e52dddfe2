"""Ranked lexical search by bit-sliced Bloom signatures (operator 12).

*Index.*  A task gathers the term counts of its rows until they hold about a million terms, sorts them
by size and cuts them into *groups* of 64 rows.  A group has one Bloom signature a row, all of the same
length, stored by bit: slice ``p`` is a 64-bit word whose bit ``i`` is bit ``p`` of row ``i``'s
signature.  A row enters each term once for every *level* (1, 2, 3, 5, 9, ...) that its count
reaches, so a signature overestimates presence and counts, and never misses.

*Bounds.*  The AND of a term's slices is the bitmap of rows that may hold it so often.  A row's score
is at most the sum over the item's terms of weight times the contribution of the largest count of
the highest level found (its length, and so ``m``, is known exactly): weighted sums of bitmaps.

*Search.*  Every task keeps each item's 32 rows of the highest bounds (by group, then by task, then
by a window with a group limit); these are scored exactly, and an item's 20th best exact score is its bar.
All rows whose bound reaches the bar (1, if fewer rows score) are then scored exactly; every other
row is proven to be below it.  Items are taken in blocks of up to 4,096; a block's terms are all that is broadcast.

Terms, weights and scores are those of ``score`` below.  Null texts and texts without terms have
no term and are found by nothing.  Rows are found one by one: rows that repeat a ``doc_id`` or have
none are ranked like others (ids ascending, null last).  Items that repeat an ``item_id`` have a list
each; an item without terms has none.  Long texts are read in pieces; only their distinct terms
are held.  Other columns than ``doc_id`` and ``text`` (``item_id`` and ``text``) are not read, so none
can clash; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from adlens.llm.tables import materialize
from adlens.operators.sizing import DEFAULT_BROADCAST_BYTES

# Ranking: contribution of a term that comes tf times in a row of n terms.
SCALE, DAMPING, SLOPE = 1_000_000_000, 12, 25
# Bits for each entry of a group's largest row, and hashes: 0.5 % of absent entries seem present.
BITS_AN_ENTRY, HASHES = 12, 5
GROUP = 64
TERMS_AT_ONCE = 1 << 20
PIECE = 1 << 20
ITEMS_AT_ONCE = 4096
FIRST_LOOK = 32
LEVELS = np.array([1, 2] + [(1 << i) + 1 for i in range(1, 62)], np.int64)

# Bytes that are in terms: digits, letters, all beyond ASCII; A-Z become a-z, others a space.
_FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32
              for b in range(256))


def terms(text: bytes | None) -> Iterator[list[bytes]]:
    """A text's terms in order, a list for about every megabyte."""
    at, end = 0, len(text or b"")
    while at < end:
        stop = min(end, at + PIECE)
        while stop < end and _FOLD[text[stop]] != 32:
            stop += 1
        yield text[at:stop].translate(_FOLD).split()
        at = stop


def counts(text: bytes | None) -> Counter:
    found: Counter = Counter()
    for piece in terms(text):
        found.update(piece)
    return found


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def share(tf, m):
    """What a term gives for one unit of weight (integers or integer arrays)."""
    return (SCALE * tf) // (1000 * tf + DAMPING * m)


def score(item: Counter, found: Counter, weights: dict[bytes, int], n_docs: int, n_terms: int) -> int:
    """Exact score of a row's term counts for an item's."""
    m = 100 - SLOPE + SLOPE * found.total() * n_docs // n_terms
    return sum(times * weights[t] * share(found[t], m) for t, times in item.items() if t in found)


def _positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Slices of every entry hash: (entries, HASHES)."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return ((hashes[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]) % np.uint64(bits)).astype(np.int64)


def _entries(hashes: np.ndarray, level: int) -> np.ndarray:
    """Entry hashes of terms at a level."""
    mixed = hashes + np.uint64((0x9E3779B97F4A7C15 * level) & (2 ** 64 - 1))
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(29))


def term_hash(term: bytes) -> int:
    return xxhash.xxh64_intdigest(term)


def signature(rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Slices of up to 64 rows ``(term hashes, counts)``."""
    entries = []
    for hashes, tf in rows:
        reached = [(level, hashes[tf >= least]) for level, least in enumerate(LEVELS[:int(tf.max()).bit_length() + 2])]
        entries.append(np.concatenate([_entries(h, level) for level, h in reached if len(h)]))
    bits = 64 * math.ceil(max(len(e) for e in entries) * BITS_AN_ENTRY / 64)
    slices = np.zeros(bits, np.uint64)
    for i, e in enumerate(entries):
        slices[_positions(e, bits).ravel()] |= np.uint64(1 << i)
    return slices


# --- index --------------------------------------------------------------------------------------

_INDEX_DDL = "ids array<long>, marks array<long>, lengths array<long>, slices binary"


def _index(batches):
    """``(doc_id, mark, text)`` to groups of 64 rows of like size."""
    held, size = [], 0

    def groups():
        held.sort(key=lambda r: len(r[2]))
        for at in range(0, len(held), GROUP):
            part = held[at:at + GROUP]
            yield pa.RecordBatch.from_arrays([
                pa.array([[r[0] for r in part]], pa.list_(pa.int64())), pa.array([[r[1] for r in part]], pa.list_(pa.int64())),
                pa.array([[int(r[3].sum()) for r in part]], pa.list_(pa.int64())),
                pa.array([signature([r[2:] for r in part]).tobytes()], pa.binary())],
                ["ids", "marks", "lengths", "slices"])

    for b in batches:
        for doc_id, mark, text in zip(b.column("doc_id").to_pylist(), b.column("mark").to_pylist(), b.column("text")):
            found = counts(text.as_buffer().to_pybytes() if text.is_valid else None)
            if found:
                hashes = np.fromiter(map(term_hash, found), np.uint64, len(found))
                held.append((doc_id, mark, hashes, np.fromiter(found.values(), np.int64, len(found))))
                size += len(found)
                if size >= TERMS_AT_ONCE:
                    yield from groups()
                    held, size = [], 0
    if held:
        yield from groups()


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"),
                       F.col("text").cast("binary").alias("text")).where("text is not null")


def index(docs: DataFrame) -> DataFrame:
    """Groups ``(ids, marks, lengths, slices)``; ``marks`` are hashes of the texts."""
    return _plain(docs).mapInArrow(_index, _INDEX_DDL)


def frequencies(docs: DataFrame, wanted: set[bytes]) -> dict[bytes, int]:
    """Rows that hold each of the wanted terms (at most as many as were asked for come back)."""
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(wanted))

    def run(batches):
        found: Counter = Counter()
        for b in batches:
            for text in b.column("text"):
                if text.is_valid:
                    found.update({t for piece in terms(text.as_buffer().to_pybytes()) for t in set(piece) & shared.value})
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())],
                                         ["term", "df"])
    rows = _plain(docs).mapInArrow(run, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    return {bytes(r["term"]): r["df"] for r in rows}


# --- bounds -------------------------------------------------------------------------------------

class Queries:
    """A block of items, as the tasks need it: their terms, weights and repeats."""

    def __init__(self, items: list[Counter], df: dict[bytes, int], n_docs: int, n_terms: int):
        known = sorted({t for item in items for t in item if df.get(t)})
        at = {t: i for i, t in enumerate(known)}
        self.items, self.n_docs, self.n_terms = items, n_docs, n_terms
        self.weights = {t: weight(n_docs, df.get(t, 0)) for item in items for t in item}
        self.hashes = np.fromiter(map(term_hash, known), np.uint64, len(known))
        pairs = [(q, at[t], times * self.weights[t]) for q, item in enumerate(items) for t, times in item.items() if t in at]
        self.which = np.array([t for _, t, _ in pairs], np.int64)
        self.weight = np.array([w for _, _, w in pairs], np.int64)
        self.starts = np.array([i for i, (q, _, _) in enumerate(pairs) if not i or pairs[i - 1][0] != q], np.int64)
        self.present = np.array(list(dict.fromkeys(q for q, _, _ in pairs)), np.int64)

    def bounds(self, lengths: np.ndarray, slices: np.ndarray) -> np.ndarray:
        """Upper bounds of the scores: a row for every item with known terms, a column for every row of the group."""
        m = 100 - SLOPE + SLOPE * lengths * self.n_docs // self.n_terms
        longest = int(lengths.max())
        most = np.zeros((len(self.hashes), len(lengths)), np.int64)
        alive, before = np.arange(len(self.hashes)), np.uint64(2 ** 64 - 1)
        for level, least in enumerate(LEVELS):
            if least > longest or not len(alive):
                break
            masks = before & np.bitwise_and.reduce(
                slices[_positions(_entries(self.hashes[alive], level), len(slices))], axis=1)
            alive, before = alive[masks != 0], masks[masks != 0]
            held = np.unpackbits(before.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :len(lengths)]
            highest = np.minimum(LEVELS[level + 1] - 1, lengths)
            most[alive] = np.where(held, share(highest, m), most[alive])
        return np.add.reduceat(most[self.which] * self.weight[:, None], self.starts, axis=0)


def _groups(batches):
    for b in batches:
        for ids, marks, lengths, slices in zip(*(b.column(c) for c in ("ids", "marks", "lengths", "slices"))):
            yield ids.values, marks.values, lengths.values.to_numpy(), np.frombuffer(slices.as_buffer(), "<u8")


def _hits(item, ids, marks, bound):
    return pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), ids, marks, pa.array(bound, pa.int64())],
                                      ["item", "doc_id", "mark", "bound"])


_HITS_DDL = "item int, doc_id long, mark long, bound long"


def _highest(groups: DataFrame, shared, k: int) -> DataFrame:
    """Every item's ``k`` rows of the highest bounds."""
    def run(batches):
        queries: Queries = shared.value
        n = len(queries.present)
        if not n:
            return
        bounds, places, ids, marks, rows, columns = [], [], [], [], 0, 0

        def cut():
            """Keeps k rows of every item, and the names of rows that are still kept."""
            nonlocal bounds, places, ids, marks, rows, columns
            bound, place = np.concatenate(bounds, axis=1), np.concatenate(places, axis=1)
            if bound.shape[1] > k:
                best = np.argpartition(-bound, k - 1, axis=1)[:, :k]
                bound, place = np.take_along_axis(bound, best, 1), np.take_along_axis(place, best, 1)
            kept = np.unique(place)
            ids = [pa.concat_arrays(ids).take(pa.array(kept))]
            marks = [pa.concat_arrays(marks).take(pa.array(kept))]
            bounds, places, rows, columns = [bound], [np.searchsorted(kept, place)], len(kept), bound.shape[1]

        for i, m, lengths, slices in _groups(batches):
            new = queries.bounds(lengths, slices)
            bounds.append(new)
            places.append(np.broadcast_to(rows + np.arange(len(lengths)), new.shape))
            ids.append(i)
            marks.append(m)
            rows, columns = rows + len(lengths), columns + len(lengths)
            if columns >= k + 16 * GROUP:
                cut()
        if rows:
            cut()
            for q, name in enumerate(queries.present):
                best = np.flatnonzero(bounds[0][q] > 0)
                where = pa.array(places[0][q][best])
                yield _hits(np.full(len(best), name, np.int32), ids[0].take(where), marks[0].take(where), bounds[0][q][best])
    nth = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "doc_id", "mark"))
    return groups.mapInArrow(run, _HITS_DDL).withColumn("_n", nth).where(F.col("_n") <= k).drop("_n")


def _reaching(groups: DataFrame, shared, bars: list[int]) -> DataFrame:
    """Rows whose bound reaches their item's bar."""
    def run(batches):
        queries: Queries = shared.value
        if not len(queries.present):
            return
        bar = np.array(bars, np.int64)[queries.present]
        for ids, marks, lengths, slices in _groups(batches):
            bound = queries.bounds(lengths, slices)
            q, row = np.nonzero(bound >= bar[:, None])
            if len(q):
                yield _hits(queries.present[q].astype(np.int32), ids.take(pa.array(row)), marks.take(pa.array(row)), bound[q, row])
    return groups.mapInArrow(run, _HITS_DDL)


def _scored(docs: DataFrame, hits: DataFrame, shared, limit: int) -> DataFrame:
    """``(item, rank, doc_id, score)``: the hit rows' exact scores above 0, ``limit`` an item.  A row is
    known by id and text hash; rows that share both are scored each."""
    wanted = materialize(hits.groupBy(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"))
                         .agg(F.collect_set("item").alias("items")), "hits")
    size = wanted.agg(F.sum(64 + 4 * F.size("items"))).first()[0] or 0
    wanted = F.broadcast(wanted) if size <= DEFAULT_BROADCAST_BYTES else wanted
    rows = _plain(docs).join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))) \
        .select("doc_id", "text", "items")

    def run(batches):
        queries: Queries = shared.value
        for b in batches:
            out = []
            for doc_id, text, items in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("items").to_pylist()):
                found = counts(text.as_buffer().to_pybytes())
                scores = [(q, doc_id, score(queries.items[q], found, queries.weights, queries.n_docs, queries.n_terms))
                          for q in items]
                out += [s for s in scores if s[2] > 0]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in
                                              enumerate((pa.int32(), pa.int64(), pa.int64()))], ["item", "doc_id", "score"])
    nth = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return rows.mapInArrow(run, "item int, doc_id long, score long").withColumn("rank", nth) \
        .where(F.col("rank") <= limit).select("item", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, limit: int = 20, at_once: int = ITEMS_AT_ONCE) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: for every row of ``items(item_id, text)`` the ``limit`` rows
    of ``docs(doc_id, text)`` of the highest scores above 0."""
    spark = docs.sparkSession
    groups = materialize(index(docs), "signatures")
    n_docs, n_terms = groups.agg(F.coalesce(F.sum(F.size("lengths")), F.lit(0)), F.coalesce(F.sum(
        F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()
    asked = items.select("item_id", F.col("text").cast("binary").alias("text"))
    blocks = max(1, math.ceil(items.count() / at_once))
    asked = materialize(asked.withColumn("_block", F.monotonically_increasing_id() % blocks), "items")
    found = []
    for block in range(blocks):
        part = asked.where(F.col("_block") == block).collect()
        wanted = [counts(bytes(r["text"]) if r["text"] is not None else None) for r in part]
        df = frequencies(docs, {t for item in wanted for t in item}) if n_docs else {}
        shared = spark.sparkContext.broadcast(Queries(wanted, df, n_docs, max(1, n_terms)))
        first = _scored(docs, _highest(groups, shared, max(FIRST_LOOK, limit)), shared, limit)
        bars = [1] * len(part)
        for r in first.where(F.col("rank") == limit).select("item", "score").collect():
            bars[r["item"]] = r["score"]
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(part)],
                                      items.select(F.lit(0).alias("_item"), "item_id").schema)
        best = materialize(_scored(docs, _reaching(groups, shared, bars), shared, limit), "best")
        found.append(best.join(F.broadcast(names), F.col("item") == F.col("_item")).select("item_id", "rank", "doc_id", "score"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
