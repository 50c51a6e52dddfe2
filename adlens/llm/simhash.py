"""SimHash near-duplicates (operator 7).

A fingerprint is 64 bits; a bit is 1 if it is set in over half of the XXH64 hashes of the
text's word shingles.  Documents link when their fingerprints differ in at most
``max_bits`` = 2 bits; classes are the connected components of these links.

Links are found among distinct fingerprints, so exact copies (in any number) are one row:

* a fingerprint is cut into four blocks of 16 bits; two fingerprints with at most two
  different bits agree on at least two blocks (pigeonhole), so every pair of blocks is a
  join key of 32 bits.  Keys held by up to ``hot_block`` fingerprints are joined with
  themselves and each pair is verified by its Hamming distance;
* a key held by more goes another exact way that makes no pairs: each of its fingerprints
  emits itself and its 64 one-bit variants; fingerprints that share a variant are within
  two bits, and two within two bits share one.  Each variant links its fingerprints to
  the smallest, verified likewise.

Null and blank texts have fingerprint 0 and link like any other.  A null ``doc_id`` gets
its class's id.  Rows that repeat a ``doc_id`` are kept; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlens.llm.components import components
from adlens.llm.spans import _free
from adlens.llm.tables import materialize

SEED = 42
SHINGLE_WORDS = 3
HOT_BLOCK = 64
_HASHES_AT_ONCE = 1 << 15


def fingerprint(text: bytes | None, words: int = SHINGLE_WORDS) -> int:
    """Signed 64-bit fingerprint of one UTF-8 text (A-Z lower-cased, split on ASCII space)."""
    tokens = text.lower().split() if text else []
    if not tokens:
        return 0
    n = max(1, len(tokens) - words + 1)
    shingles = map(b" ".join, zip(*(tokens[i:i + n] for i in range(min(words, len(tokens))))))
    ones = np.zeros(64, np.int64)
    for start in range(0, n, _HASHES_AT_ONCE):
        size = min(_HASHES_AT_ONCE, n - start)
        hashes = np.fromiter((xxhash.xxh64_intdigest(next(shingles), SEED) for _ in range(size)), "<u8", size)
        bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(size, 64)
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, marks: bool = False) -> DataFrame:
    """``(doc_id, fp long)`` of every row; ``marks``: and ``mark``, a hash of the text."""
    def run(batches):
        for b in batches:
            fps = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else None, words) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64()), *b.columns[2:]],
                                             ["doc_id", "fp", *b.schema.names[2:]])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"),
                       *([F.xxhash64("text").alias("mark")] if marks else [])) \
        .mapInArrow(run, "doc_id long, fp long" + (", mark long" if marks else ""))


def _distance(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(fps: DataFrame, max_bits: int = 2, hot_block: int = HOT_BLOCK) -> DataFrame:
    """``fps(fp)``, distinct -> ``(a, b)``: links whose components are those of all pairs
    within ``max_bits`` (0 to 2) bits.  A pair may repeat."""
    if not 0 <= max_bits <= 2:
        raise ValueError("the four blocks and the one-bit variants serve at most two differing bits")
    block = [F.shiftrightunsigned("fp", 16 * i).bitwiseAND(0xFFFF) for i in range(4)]
    pairs = [(i, j) for i in range(4) for j in range(i)]
    keys = F.array(*[F.lit(n).cast("long") * (1 << 32) + block[i] * (1 << 16) + block[j]
                     for n, (i, j) in enumerate(pairs)])
    keyed = materialize(fps.select("fp", F.explode(keys).alias("key")), "blocks")
    sizes = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "block-sizes")
    shared = keyed.join(sizes, "key")
    cool = shared.where(F.col("n") <= hot_block)
    near = cool.select("key", F.col("fp").alias("a")).join(cool.select("key", F.col("fp").alias("b")), "key") \
        .where((F.col("a") < F.col("b")) & (_distance("a", "b") <= max_bits)).select("a", "b")
    hot = shared.where(F.col("n") > hot_block).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1).cast("long") if i == 0 else F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")
                                             for i in range(64)])
    variants = materialize(hot.select("fp", F.explode(flips).alias("flip"))
                           .select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("variant")), "variants")
    hubs = variants.groupBy("variant").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    stars = variants.join(materialize(hubs, "hubs"), "variant") \
        .where((F.col("fp") != F.col("a")) & (_distance("fp", "a") <= max_bits)) \
        .select("a", F.col("fp").alias("b"))
    return near.unionByName(stars) if max_bits == 2 else near.unionByName(_narrow(variants, max_bits))


def _narrow(variants: DataFrame, max_bits: int) -> DataFrame:
    """Links of hot fingerprints within fewer than two bits: a variant that is itself a
    fingerprint names the neighbour, so no star is needed."""
    own = variants.select("fp").distinct().select(F.col("fp").alias("a"))
    return own.join(variants, F.col("a") == F.col("variant")) \
        .where((F.col("fp") != F.col("a")) & (_distance("fp", "a") <= max_bits)) \
        .select("a", F.col("fp").alias("b"))


def _members(marked: DataFrame, max_bits: int, hot_block: int) -> DataFrame:
    """``(fp, first_id, root)`` of every distinct fingerprint: its smallest doc_id and its class."""
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    roots = components(links(distinct.select("fp"), max_bits, hot_block))
    return materialize(distinct.join(roots, distinct["fp"] == roots["node"], "left")
                       .select("fp", "first_id", F.coalesce("root", "fp").alias("root")), "members")


def classes(docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = 2,
            hot_block: int = HOT_BLOCK) -> DataFrame:
    """``(doc_id, fp, component_id)`` of every row: ``component_id`` is the smallest doc_id
    that links reach from the document, itself included."""
    marked = materialize(fingerprints(docs, words), "fingerprints")
    member = _members(marked, max_bits, hot_block)
    smallest = materialize(member.groupBy("root").agg(F.min("first_id").alias("component_id")), "class-ids")
    named = materialize(member.join(smallest, "root").select("fp", "component_id"), "classes")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = 2) -> DataFrame:
    """The documents with one document of each class left, the least by ``doc_id`` and then a
    hash of the text; columns as given.  A row without a doc_id gives way to any that has one; of
    a class of such rows one stays.  Of rows equal in doc_id and text any one stays.  Only ids, classes and hashes are shuffled to decide; of rows to choose among,
    each task sends one of every kind."""
    mark = _free(docs.columns, "_mark")[0]
    marked = materialize(fingerprints(docs, words, True), "marked-fingerprints")
    least = marked.groupBy("fp").agg(
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "mark"))).alias("named"),
        F.min(F.when(F.col("doc_id").isNull(), F.col("mark"))).alias("nameless"))
    first = materialize(least.join(_members(marked, max_bits, HOT_BLOCK).select("fp", "root"), "fp")
                        .groupBy("root").agg(F.min("named").alias("named"), F.min("nameless").alias("nameless")),
                        "first-of-class")
    key = ["doc_id", mark]
    chosen = first.where("named is not null").select("named.doc_id", F.col("named.mark").alias(mark))
    rows = docs.withColumn(mark, F.xxhash64("text"))
    named = rows.join(chosen, key, "left_semi").select(rows.columns)
    repeats = materialize(marked.where("doc_id is not null").groupBy("doc_id", F.col("mark").alias(mark)).count()
                          .where("count > 1").select(key).join(chosen, key, "left_semi"), "repeated-rows")
    if repeats.take(1):
        one = named.join(repeats, key, "left_semi").select(rows.columns).dropDuplicates(key)
        named = named.join(repeats, key, "left_anti").select(rows.columns).unionByName(one)
    alone = first.where("nameless is not null and named is null").select(F.col("nameless").alias(mark))
    nameless = rows.where("doc_id is null").join(alone, mark, "left_semi").select(rows.columns).dropDuplicates([mark])
    return named.select(docs.columns).unionByName(nameless.select(docs.columns))
