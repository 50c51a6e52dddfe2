"""Substring deduplication over runs of sentences (operator 1).

A text is cut, without loss, into sentences: after a word that ends in ``.``, ``!`` or ``?``,
at line breaks, before a word with a capital A-Z or Latin-1 capital (a passage pasted into the
middle of a sentence starts one), and, where ``MAX_WORDS`` words in a row have no such border,
before the one of them with the least hash (the last of equal ones): a piece of a sentence
begins there.  So a border follows from the words around it, never from where the border before
lies, and no piece is longer than ``MAX_WORDS``.  Words are split by ASCII white space; in scripts
written without spaces every character, with the marks after it, is a word.  From every piece
forwards, and from every piece backwards, the shortest run is hashed (96 bits of XXH3 over its pieces'
XXH64, A-Z lower-cased, so that texts of 10^13 runs have no chance repeats) that touches at least ``sentences`` sentences and has ``words`` words, or has half
as many words again.

The borders of two copies of a passage agree from the first one in its words 2 to
``MAX_WORDS`` + 1 to the last one in its last ``MAX_WORDS`` words.  So any repeated passage of
1.5 ``words`` + 2 ``MAX_WORDS`` words (50) is found, wherever it is pasted and whatever it holds,
but for at most ``MAX_WORDS`` words at either end where it starts or ends inside a sentence; chance
repeats of short phrases are not.

The first place of a run is the one in the smallest document, and in it the first.  Later
places in the same document are known in the row; for the others every document writes a
run once to a global table of runs, of which an aggregate keeps the smallest document (a partial aggregate, so a
passage shared by a third of all documents is one row per task) and is joined back (a
sort-merge join whose hot keys AQE splits).  Pieces covered by a non-first run are removed.

A document is known by its doc_id and a mark, in this order: a hash of the text, so different
texts under one doc_id are documents of their own, while rows equal in both count as one
(a run they share is not a repeat among them).  Rows with a null ``doc_id`` come after all
others, each a document of its own: they are written once with a number as mark.

Null texts stay null, blank ones as they are.  Shorter texts than a run never repeat.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adlens.llm.tables import materialize

SENTENCES = 2
WORDS = 20
MAX_WORDS = 10
_LAST = (1 << 63) - 1
_EMPTY = np.zeros(0, np.int64)
# Thai to Tibetan, Myanmar, Khmer, New Tai Lue and Tai Tham, CJK with kana and Yi, compatibility and full-width forms.
_UNSPACED = ((0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19FF), (0x1A20, 0x1AAF), (0x2E80, 0x312F),
             (0x3190, 0xA4CF), (0xA9E0, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF), (0xFE30, 0xFE4F), (0xFF00, 0xFF9F))


def _kinds() -> np.ndarray:
    """Per code point of the basic plane: 1 a character that is a word, 2 a mark on one, 0 others."""
    kinds = np.zeros(1 << 16, np.int8)
    for low, high in _UNSPACED:
        kinds[low:high + 1] = [2 if unicodedata.category(chr(c))[0] == "M" else 1 for c in range(low, high + 1)]
    return kinds


_KINDS = _kinds()
_FACTOR = 0x9E3779B97F4A7C15
_BLOCK = 1 << 16  # bytes of a text whose words are found and hashed at a time


def _heads(a: np.ndarray, space: np.ndarray) -> np.ndarray:
    """True at the first byte of every word."""
    heads = ~space
    heads[1:] &= space[:-1]
    for low in range(0, len(a), _BLOCK):
        if (a[low:low + _BLOCK] >= 0xE0).any() or (a[max(0, low - 4):low] >= 0xE0).any():
            at = _unspaced(a, low)
            heads[at[~space[at]]] = True
    return heads


def _unspaced(a: np.ndarray, low: int) -> np.ndarray:
    """Where words begin in the block from ``low`` on, by scripts without spaces."""
    start = max(0, low - 4)  # a code point before the block's first is in it
    at = np.flatnonzero((a[start:low + _BLOCK] & 0xC0) != 0x80)
    wide = np.append(a[start:low + _BLOCK + 3], np.zeros(3, np.uint8)).astype(np.int32)
    b = wide[at]
    point = (b & 15) << 12 | (wide[at + 1] & 63) << 6 | (wide[at + 2] & 63)
    kind = np.where((b >= 0xE0) & (b < 0xF0), _KINDS[point & 0xFFFF], 0)
    # Planes 2 and 3: further CJK ideographs.
    kind[(b == 0xF0) & ((wide[at + 1] & 0x30) >= 0x20)] = 1
    first = kind == 1
    first[1:] |= (kind[1:] == 0) & (kind[:-1] > 0)  # a word of letters right after such characters
    found = at[first] + start
    return found[found >= low]


def _powers_of(factor: int) -> np.ndarray:
    """The powers 0 to ``_BLOCK`` of a factor."""
    powers = np.full(_BLOCK + 1, factor, np.uint64)
    powers[0] = 1
    return np.multiply.accumulate(powers)


_POWERS, _INVERSES = _powers_of(_FACTOR), _powers_of(pow(_FACTOR, -1, 1 << 64))


def _sums(lower: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of at most ``_BLOCK`` bytes: every word's bytes weighed by their distance from its end."""
    n = len(lower)
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum((lower.astype(np.uint64) + np.uint64(1)) * _POWERS[n:0:-1])])
    # A byte at j weighs factor ** (n - j); a word is brought to the weights of the block's last bytes.
    return (upto[ends] - upto[starts]) * _INVERSES[n - ends]


def _long_sum(lower: np.ndarray) -> int:
    """``_sums`` of one word of any length."""
    h = 0
    for low in range(0, len(lower), _BLOCK):
        part = lower[low:low + _BLOCK]
        h = h * int(_POWERS[len(part)]) + int(_sums(part, np.zeros(1, int), np.array([len(part)]))[0])
    return h & (1 << 64) - 1


def _word_hashes(lower: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash, never 0, of every word's bytes, wherever the word is; in blocks of whole words."""
    h, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        low = starts[at]
        after = int(np.searchsorted(ends, low + _BLOCK, "right"))
        if after > at:
            h[at:after] = _sums(lower[low:ends[after - 1]], starts[at:after] - low, ends[at:after] - low)
        else:
            after = at + 1
            h[at] = _long_sum(lower[low:ends[at]])
        at = after
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ h >> np.uint64(32)) | np.uint64(1)


class Sentences:
    """A UTF-8 text's sentences, long ones in pieces: ``begin`` (byte offset of each one's first
    word), ``end`` (after its last word), ``words`` (their number) and ``new`` (false for a
    piece that goes on with a sentence)."""

    def __init__(self, text: bytes):
        a = np.frombuffer(text, np.uint8)
        space = (a == 32) | ((a >= 9) & (a <= 13))
        heads = _heads(a, space)
        starts = np.flatnonzero(heads)  # of words
        if not len(starts):
            self.begin = self.end = self.words = self.new = _EMPTY
            return
        ends = np.flatnonzero(np.append(space | heads, True)[1:] & ~space) + 1
        first, last = a[starts], a[ends - 1]
        second = a[np.minimum(starts + 1, len(a) - 1)]
        new = ((first >= 65) & (first <= 90)) | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97))
        new[1:] |= (last[:-1] == 46) | (last[:-1] == 33) | (last[:-1] == 63)
        lines = np.searchsorted(np.flatnonzero(a == 10), starts)
        new[1:] |= lines[1:] > lines[:-1]
        new[0] = True
        if len(starts) >= MAX_WORDS:
            value = np.where(new, np.uint64(0), _word_hashes(np.frombuffer(text.lower(), np.uint8), starts, ends))
            windows = np.lib.stride_tricks.sliding_window_view(value, MAX_WORDS)
            cut = new.copy()
            for low in range(0, len(windows), _BLOCK):
                part = windows[low:low + _BLOCK]
                cut[low + np.arange(len(part)) + MAX_WORDS - 1 - part[:, ::-1].argmin(axis=1)] = True
        else:
            cut = new
        heads = np.flatnonzero(cut)
        after = np.append(heads[1:], len(starts))
        self.begin, self.end, self.words, self.new = starts[heads], ends[after - 1], after - heads, new[heads]

    def runs(self, text: bytes, least: int, words: int):
        """``(hashes, checks, first pieces, pieces after the last)`` of the shortest runs
        that start or end at any piece, in text order: 64 and 32 bits of one hash."""
        n = len(self.words)
        total = np.concatenate([[0], np.cumsum(self.words)])
        if total[-1] < words:
            return _EMPTY, _EMPTY.astype(np.int32), _EMPTY, _EMPTY
        at, many = np.arange(n), words * 3 // 2
        of = np.cumsum(self.new) - 1  # sentence of every piece
        ends = np.maximum(np.searchsorted(total, total[:-1] + words, "left"), np.searchsorted(of, of + least - 1, "left") + 1)
        ends = np.minimum(ends, np.searchsorted(total, total[:-1] + many, "left"))
        starts = np.minimum(np.searchsorted(total, total[1:] - words, "right"), np.searchsorted(of, of + 1 - least, "right")) - 1
        starts = np.maximum(starts, np.searchsorted(total, total[1:] - many, "right") - 1)
        forward, backward = ends <= n, starts >= 0
        places = np.unique(np.concatenate([at[forward] << 32 | ends[forward], starts[backward] << 32 | at[backward] + 1]))
        first, after = places >> 32, places & 0xFFFFFFFF
        lower = text.lower()
        digest = xxhash.xxh64_digest
        digests = b"".join([digest(lower[x:y]) for x, y in zip(self.begin.tolist(), self.end.tolist())])
        whole = xxhash.xxh3_128_digest
        both = b"".join([whole(digests[x:y]) for x, y in zip((8 * first).tolist(), (8 * after).tolist())])
        return np.frombuffer(both, np.int64)[::2].copy(), np.frombuffer(both, np.int32)[2::4].copy(), first, after

    def without(self, text: bytes, gone: np.ndarray) -> bytes:
        """The text without the marked sentences, each with the white space after it."""
        begin = self.begin.tolist()
        edges = [0, *begin[1:], len(text)]
        return b"".join([text[edges[i]:edges[i + 1]] for i in np.flatnonzero(~gone).tolist()])


def _first_places(hashes: np.ndarray) -> np.ndarray:
    """True where a hash occurs for the first time."""
    first = np.zeros(len(hashes), bool)
    first[np.unique(hashes, return_index=True)[1]] = True
    return first


def _marked(docs: DataFrame, doc: str, mark: str) -> DataFrame:
    """``docs`` with two columns that tell documents apart, and order them."""
    named = docs.where("doc_id is not null") \
        .withColumns({doc: F.col("doc_id").cast("long"), mark: F.xxhash64("text")})
    # Equal rows without an id have only their place; written, it is the same for every reader.
    nameless = materialize(docs.where("doc_id is null")
                           .withColumns({doc: F.lit(_LAST), mark: F.monotonically_increasing_id()}), "nameless")
    return named.unionByName(nameless)


def _run_table(docs: DataFrame, least: int, words: int) -> DataFrame:
    """``docs(doc, mark, text)`` -> ``(hash, check, doc, mark, place)``: every run once per row,
    ``place`` = start and end in one long.  Rows without a hash tell of a row itself: places of runs
    it had before, and the number of its pieces as ``-1 - pieces``."""
    def run(batches):
        for b in batches:
            found, empty = [], []
            for doc, mark, text in zip(*(c.to_pylist() for c in b.columns)):
                if text:
                    cut = Sentences(text)
                    hashes, checks, first, after = cut.runs(text, least, words)
                    new = _first_places(hashes)
                    place = first << 32 | after
                    again = np.append(place[~new], -1 - len(cut.words))
                    n = len(place) - len(again) + 1
                    found.append((np.append(hashes[new], np.zeros(len(again), np.int64)),
                                  np.append(checks[new], np.zeros(len(again), np.int32)),
                                  np.full(n + len(again), doc, np.int64), np.full(n + len(again), mark, np.int64),
                                  np.append(place[new], again)))
                    empty.append(np.arange(n + len(again)) >= n)
            if found:
                hashes, *others = (np.concatenate(c) for c in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(hashes, mask=np.concatenate(empty)), *map(pa.array, others)],
                                                 ["hash", "check", "doc", "mark", "place"])
    return docs.mapInArrow(run, "hash long, check int, doc long, mark long, place long")


def _first_documents(table: DataFrame, several: bool) -> DataFrame:
    """``(hash, check, first)`` of the runs that more than one row has; where a doc can have
    ``several`` marks, ``first_mark``, its least, too."""
    runs = table.where("hash is not null")
    if not several:
        return runs.groupBy("hash", "check").agg(F.min("doc").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # One mark a doc is left here, so the least doc's is certain; all of it aggregates by hash.
    each = runs.groupBy("hash", "check", "doc").agg(F.min("mark").alias("mark"), F.count("*").alias("n"))
    return each.groupBy("hash", "check").agg(F.min("doc").alias("first"), F.min_by("mark", "doc").alias("first_mark"),
                                             F.sum("n").alias("n")).where("n > 1").drop("n")


def dedup(docs: DataFrame, least: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """The documents with ``text`` rewritten and two columns more, the last: ``n_sentences`` and
    ``n_removed`` (pieces), lengthened by ``_`` where a column has the name.  Other columns stay as
    they are; every row stays."""
    names = _free(docs.columns, "_doc", "_mark", "_places")
    keyed = _marked(docs, names[0], names[1])
    table = materialize(_run_table(keyed.select(F.col(names[0]).alias("doc"), F.col(names[1]).alias("mark"),
                                                F.col("text").cast("binary").alias("text")), least, words), "runs")
    several = bool(keyed.groupBy(names[0]).count().where("count > 1").take(1))
    first = materialize(_first_documents(table, several), "repeated-runs")
    # Rows equal in doc and mark send equal places: a set.
    # Where every doc is one row its mark needs not travel.
    known, later = (["doc", "mark"], "doc > first or doc = first and mark > first_mark") if several else (["doc"], "doc > first")
    repeats = table.select("hash", "check", *known, "place").join(first, ["hash", "check"]).where(later) \
        .select(*known, "place").unionByName(table.where("hash is null").select(*known, "place")) \
        .groupBy(*known).agg(F.collect_set("place").alias("places"))
    of = names[:len(known)]
    joined = keyed.join(materialize(repeats.toDF(*of, names[2]), "repeated-places"), of, "left") \
        .select(*docs.columns, names[2])
    at = docs.columns.index("text")
    counted = _free(docs.columns, "n_sentences", "n_removed")
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T.IntegerType()) for n in counted)])

    def cut(batches):
        for b in batches:
            texts, counts, removed = [], [], []
            for text, places in zip(b.column(at).cast(pa.binary()).to_pylist(), b.column(b.num_columns - 1)):
                text, n, gone = _clean(text, places.values)
                texts.append(text)
                counts.append(n)
                removed.append(gone)
            cols = b.columns[:-1]
            cols[at] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(counts, pa.int32()), pa.array(removed, pa.int32())], schema.names)
    return joined.mapInArrow(cut, schema)


def _clean(text: bytes | None, places):
    """The text without the pieces in ``places``, its pieces and those that went."""
    if not text or places is None:
        return text, 0, 0
    marked = places.to_numpy(zero_copy_only=False)
    pieces, marked = -1 - int(marked.min()), marked[marked >= 0]
    if not len(marked):
        return text, pieces, 0
    gone = np.zeros(pieces + 1, np.int64)
    np.add.at(gone, marked >> 32, 1)
    np.add.at(gone, marked & 0xFFFFFFFF, -1)
    gone = np.cumsum(gone)[:-1] > 0
    return Sentences(text).without(text, gone), pieces, int(gone.sum())


def _free(taken: list[str], *names: str) -> list[str]:
    """The names, lengthened until no column has them."""
    lower = {c.lower() for c in taken}
    out = []
    for n in names:
        while n in lower:
            n += "_"
        out.append(n)
    return out
