"""Sequence packing by shortest-pack-first over the length histogram (operator 3).

1. Every document is tokenized whole, ended by ``END_ID``, and cut into pieces of at most
   ``capacity`` ids: full ones and a rest.  A piece's offset and checksum are fixed here,
   so ids never leave the task unless asked for.  The piece table is written once.
2. The histogram of piece lengths (at most ``capacity`` rows, whatever the input) is packed on
   the driver: lengths go longest first, each into the shortest open pack that has room,
   many at once, as packs are counted by pattern.  A length that no open pack can hold opens
   new ones.
3. Patterns are joined back by rank: a slot of a pattern owns a range of ranks among the
   pieces of its length.  Ranks come from salted windows, so a length that most pieces
   have is spread; a slot is found by binary search in a table bounded by the histogram.

A sequence is padded to ``capacity`` unless its length is a power of two.  Null texts are
empty (the end id alone); null or repeated doc_ids are packed like others (a piece goes with
its row); an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlens.llm.tables import materialize, rank_within

CAPACITY = 2048
END_ID = 1
_CACHED_WORDS = 250_000
_RANK_BITS = 40


class WordTokenizer:
    """Ids of a vocabulary file of `tokenizers`, by words remembered from earlier texts.

    White space ends a token in this vocabulary, so a text's ids are its words' ids in a row.
    Words of ASCII and Latin letters (the same before and after composition) are split
    by the file's own pattern and put through its BPE model; any other word, or one
    that may hold a special token, goes through the whole tokenizer.
    """

    _PLAIN = re.compile(r"[\x21-\x7e\xc0-\xff]*\Z")

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        spec = json.loads(self.whole.to_str())
        splits = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if len(splits) != 1 or kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"{path}: not a lower-casing word vocabulary")
        self.split = regex.compile(splits[0])
        # Byte-level alphabet: printable Latin-1 bytes stand for themselves, others for 256, 257, ...
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        if self._PLAIN.match(word) and "<|" not in word:
            parts = []
            for p in self.split.findall(word.lower()):
                known = self.pieces.get(p)
                if known is None:
                    text = p.encode().decode("latin-1").translate(self.letters)
                    known = self.pieces[p] = np.array([t.id for t in self.model.tokenize(text)], "<u4").tobytes()
                parts.append(known)
            ids = b"".join(parts)
        else:
            ids = np.array(self.whole.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        if len(word) < 64:
            self.words[word] = ids
        return ids

    def __call__(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        # Words are many forms of fewer pieces: pieces outlive the words that are forgotten.
        if len(self.words) > _CACHED_WORDS:
            self.words.clear()
        if len(self.pieces) > _CACHED_WORDS:
            self.pieces.clear()
        words = text.replace("\n", " ").split(" ")
        found = list(map(self.words.get, words))
        if None in found:
            found = [self._word(w) if ids is None else ids for w, ids in zip(words, found)]
        return b"".join(found)


_LOADED: dict[str, WordTokenizer] = {}  # one per Python worker, kept between its tasks


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID,
           with_ids: bool = False) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens)``, and ``ids`` if asked for."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"

    def run(batches):
        encode, end = _tokenizer(vocabulary), np.array([end_id], "<u4").tobytes()
        for b in batches:
            rows, parts = [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = encode(text.as_py()) + end
                for start in range(0, len(ids), 4 * capacity):
                    cut = ids[start:start + 4 * capacity]
                    rows.append((doc, start // 4, len(cut) // 4, zlib.crc32(cut), len(ids) // 4))
                    if with_ids:
                        parts.append(np.frombuffer(cut, "<i4"))
            cols = [pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * 5
            if with_ids:
                cols.append(pa.array(parts, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(
                cols, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][:len(cols)])
    return docs.select(F.col("doc_id").cast("long"), "text") \
        .mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))


def shortest_pack_first(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """``length -> pieces`` to ``[(lengths of a pack, packs)]``.

    ``open_packs`` holds, by room left, the patterns with their counts; the largest room
    is the shortest pack.  Taking part of a pattern's packs splits its count in two.
    """
    import heapq
    open_packs: dict[int, list] = {}
    rooms: list[int] = []

    def put(pattern, count, room):
        if room not in open_packs:
            open_packs[room] = []
            heapq.heappush(rooms, -room)
        open_packs[room].append((pattern, count))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not rooms or -rooms[0] < length:
                # Only packs opened now can take this length: fill them one after another.
                fit = capacity // length
                full, rest = divmod(left, fit)
                if full:
                    put((length,) * fit, full, capacity - fit * length)
                if rest:
                    put((length,) * rest, 1, capacity - rest * length)
                break
            room = -rooms[0]
            pattern, count = open_packs[room].pop()
            used = min(count, left)
            if count > used:
                open_packs[room].append((pattern, count - used))
            elif not open_packs[room]:
                del open_packs[room]
                heapq.heappop(rooms)
            put((*pattern, length), used, room - length)
            left -= used
    return [p for group in open_packs.values() for p in group]


def slots(packs: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: rank r of a length from
    the slot's first rank on is in sequence first + (r - first rank)."""
    rows, used, sequence = [], {}, 0
    for pattern, count in packs:
        offset = 0
        for length in pattern:
            rank = used.get(length, 0)
            rows.append((length, rank, sequence, offset))
            used[length] = rank + count
            offset += length
        sequence += count
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``sequence_id`` and ``offset`` of the written pieces; ``_position``, a number of its own for each
    piece, deals even equal pieces (empty documents, repeated rows) to different windows."""
    lengths = cut.groupBy("length").count().collect()  # at most `capacity` rows
    histogram = {r["length"]: r["count"] for r in lengths}
    table = cut.sparkSession.sparkContext.broadcast(slots(shortest_pack_first(histogram, capacity)))
    ranked = rank_within(cut, "length", ["_position"], sum(histogram.values()), "rank")
    names = [c for c in cut.columns if c != "_position"]

    def run(batches):
        slot = table.value
        keys = slot[:, 0] << _RANK_BITS | slot[:, 1]
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(keys, length << _RANK_BITS | rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in names), pa.array(slot[at, 2] + rank - slot[at, 1]), pa.array(slot[at, 3])],
                [*names, "sequence_id", "offset"])
    schema = ", ".join(f"{n} {cut.schema[n].dataType.simpleString()}" for n in names)
    return ranked.select(*names, "rank").mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID,
         with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its place: ``(doc_id, start, length, ids_crc32,
    doc_tokens[, ids], sequence_id, offset)``."""
    cut = pieces(docs, vocabulary, capacity, end_id, with_ids).withColumn("_position", F.monotonically_increasing_id())
    return place(materialize(cut, "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, ids, doc_ids, starts)`` from pieces packed ``with_ids``: a sequence's
    pieces joined in order (a group holds at most ``capacity`` ids)."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(
        F.struct("offset", "doc_id", "start", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten("parts.ids").alias("ids"),
                        F.col("parts.doc_id").alias("doc_ids"), F.col("parts.start").alias("starts"))
