"""Hierarchical Pitman-Yor language model (operator 9).

Words (A-Z lower-cased, split on ASCII space) and an end token are drawn from the
restaurant of their context, the word before; every word has a restaurant of its own, known by the
word's 64-bit hash.  All of them share one
parent restaurant over words, whose base is uniform over the known words and one unknown.

The data are dealt by word.  A task tokenizes a block of documents and sends each bucket of
words its (word, context, document, count) entries as arrays; a bucket merges what all blocks sent
into one row of a table bucketed by it, so that nothing but totals moves afterwards:

* Gibbs sweeps: every dish's tables are redrawn by seating its customers again, given the
  tables of all others in its restaurant as of the sweep before (one by one, and in a crowd by
  groups of a sixteenth of those seated).  A word's seating in all its restaurants and in the
  parent is local to its bucket.  Table totals per restaurant are exchanged between sweeps: a bucket
  sends its restaurants' tables to their owners (by hash of the context), which add them up and return
  to every bucket the totals of the restaurants it has.
* Scores: a pair's predictive probability, averaged over the sweeps after ``BURN``, is
  logged and summed per document, with the base score on the way.

A word with a large share of all tokens is dealt by word and context instead, and its totals travel
with the sweeps'.  Which words these are is taken from a sample; it sets the layout, not the result.
No count is cut off: all training tokens are seated and all tokens of all texts are scored.

Null and blank texts are the end token alone.  Rows are told apart by their place, so null
and repeated doc_ids are scored each, and equal texts get equal scores; with no training row every known
count is 0; an empty table gives no rows.  Other columns than ``doc_id`` and ``text`` (and those of
``training``) are not read, so none can clash.
"""

from __future__ import annotations

import collections
import contextlib
import math
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlens.llm.samples import draw
from adlens.llm.tables import materialize
from adlens.session import scratch_dir

STRENGTH = 1.0
SWEEPS = 3
BURN = 1
BLOCK_TOKENS = 450_000
BLOCK_DOCS = 1 << 15
BUCKET_TOKENS = 600_000
HOT_SAMPLE_DOCS = 2_000
COMMON_WORDS = 1 << 16  # of a sample, sent by number; any other by its hash
OWNER_BUCKETS = 8  # buckets' worth of contexts an owner adds up
MAX_FILES = 50_000
HELD_DOCS = 1 << 20
_END, _START = b"\n", b"\r"  # no word holds these
_SEED = 11


def _hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def _tokens(text: bytes | None) -> list[bytes]:
    return [*(text.lower().split() if text else ()), _END]


@contextlib.contextmanager
def _batches_of(spark, rows: int):
    """Arrow batches of so many rows meanwhile (a bucket's row has megabytes)."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


# --- dealing -------------------------------------------------------------------------------

_PARTS = ("words", "words_", "contexts", "contexts_", "pairs_of", "context_of", "entries_of", "docs_of", "counts", "docs", "own", "own_tokens", "own_ids", "own_unnamed")
_SENT = "bucket int, first long, sent binary"


def _small(x: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 in the least width that holds them."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _packed(parts: list[np.ndarray]) -> bytes:
    """Arrays of whole numbers from 0 as one compressed value."""
    parts = [_small(x) for x in parts]
    head = np.array([(len(x), x.itemsize) for x in parts], np.int64).tobytes()
    # Bytes of equal weight side by side compress best.
    return zstandard.compress(head + b"".join(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes() for x in parts), 1)


def _unpacked(value: bytes, parts: int) -> list[np.ndarray]:
    data, out, at = zstandard.decompress(value), [], 16 * parts
    for size, width in np.frombuffer(data, np.int64, 2 * parts).reshape(-1, 2).tolist():
        planes = np.frombuffer(data, np.uint8, size * width, at).reshape(width, size)
        out.append(np.ascontiguousarray(planes.T).view(f"u{width}").reshape(size))
        at += size * width
    return out


def _column(value: bytes) -> np.ndarray:
    return _unpacked(value, 1)[0].astype(np.int64)


def _coded(hashes: np.ndarray, common: np.ndarray) -> list[np.ndarray]:
    """Ascending distinct hashes: steps between the numbers of common ones and between the others."""
    at = np.searchsorted(common, hashes)
    known = common[np.minimum(at, len(common) - 1)] == hashes if len(common) else np.zeros(len(hashes), bool)
    return [np.diff(at[known], prepend=0), np.diff(hashes[~known], prepend=np.uint64(0))]


def _decoded(steps: np.ndarray, others: np.ndarray, common: np.ndarray) -> np.ndarray:
    return np.sort(np.concatenate([common[np.cumsum(steps, dtype=np.int64)], np.cumsum(others, dtype=np.uint64)]))


def _block(rows, ids, trains, texts, buckets: int, hot: np.ndarray, common: np.ndarray):
    """The block's entries, one output row per bucket."""
    words, sizes = [], []
    for t in texts:
        w = _tokens(t)
        words += w
        sizes.append(len(w))
    coded = pa.array(words, pa.binary()).dictionary_encode()
    words.clear()
    code, kinds = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    hashes = np.fromiter(map(_hash, kinds), np.uint64, len(kinds))
    doc = np.repeat(np.arange(len(sizes)), sizes)
    word = hashes[code]
    before = np.append(np.uint64(0), word[:-1])
    before[np.cumsum([0, *sizes[:-1]])] = _hash(_START)
    spread = np.where(np.isin(hashes, hot)[code], before * np.uint64(0x9E3779B97F4A7C15), np.uint64(0))
    bucket = (((word ^ spread) >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((doc, before, word, bucket))
    word, before, doc, bucket = word[order], before[order], doc[order], bucket[order]

    new_word = np.append(True, (word[1:] != word[:-1]) | (bucket[1:] != bucket[:-1]))
    new_pair = new_word | np.append(True, before[1:] != before[:-1])
    new_entry = new_pair | np.append(True, doc[1:] != doc[:-1])
    at = np.flatnonzero(new_entry)
    counts = np.diff(np.append(at, len(doc)))
    entry_bucket, entry_doc, entry_word, entry_pair = bucket[at], doc[at], new_word[at], new_pair[at]
    owner = rows % buckets
    by_owner, sizes = np.argsort(owner, kind="stable"), np.array(sizes, np.int64)
    unnamed = np.array([x is None for x in ids])
    named = np.array([x or 0 for x in ids], np.int64).view(np.uint64)
    present = np.unique(np.append(entry_bucket, owner))
    edges = np.searchsorted(entry_bucket, [present, present + 1])
    owned = np.searchsorted(owner[by_owner], [present, present + 1])
    for b, first, last, own_first, own_last in zip(present.tolist(), *edges.tolist(), *owned.tolist()):
        cut, mine = slice(first, last), by_owner[own_first:own_last]
        begins_pair, begins_word = np.flatnonzero(entry_pair[cut]), np.flatnonzero(entry_word[cut])
        pair_at = np.flatnonzero(entry_word[cut][begins_pair])
        seen, local = np.unique(entry_doc[cut], return_inverse=True)
        contexts, context_of = np.unique(before[at[cut]][begins_pair], return_inverse=True)
        yield b, _packed([*_coded(word[at[cut]][begins_word], common), *_coded(contexts, common),
                          np.diff(np.append(pair_at, len(begins_pair))), context_of,
                          np.diff(np.append(begins_pair, last - first)), local, counts[cut], seen << 1 | trains[seen],
                          rows[mine], sizes[mine], named[mine], unnamed[mine]])


def _deal(docs: DataFrame, buckets: int, hot: np.ndarray, common: np.ndarray) -> DataFrame:
    """``docs(doc_id, text binary, train)`` -> entries by bucket."""
    def run(batches):
        first, held, tokens, n = TaskContext.get().partitionId() << 36, ([], [], []), 0, 0

        def flush():
            rows = np.arange(first + n - len(held[0]), first + n)
            out = list(_block(rows, held[0], np.array(held[1], bool), held[2], buckets, hot, common))
            for lst in held:
                lst.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.int32()), pa.array(np.full(len(out), rows[0])),
                 pa.array([o[1] for o in out], pa.binary())], ["bucket", "first", "sent"])
        for b in batches:
            for doc_id, text, train in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                held[0].append(doc_id)
                held[1].append(train)
                held[2].append(text)
                n += 1
                tokens += len(text) // 6 + 1 if text else 1
                if tokens >= BLOCK_TOKENS or len(held[0]) == BLOCK_DOCS:
                    yield flush()
                    tokens = 0
        if held[0]:
            yield flush()
    return docs.mapInArrow(run, _SENT)


_SEATS = "bucket int, word_hot binary, word_pairs binary, contexts binary, pair_context binary, pair_train binary, word_train binary"
_ROW = _SEATS + (", doc_rows binary, doc_entries binary, entry_pair binary, entry_count binary, "
                 "own binary, tokens long, words long")


def _merge(hot: np.ndarray, common: np.ndarray):
    """What all blocks sent to a bucket -> one row of merged arrays."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        blocks = [_unpacked(x, len(_PARTS)) for x in pdf["sent"]]
        sent = {p: [x[i] for x in blocks] for i, p in enumerate(_PARTS)}
        for p in ("words", "contexts"):
            sent[p] = [_decoded(a, b, common) for a, b in zip(sent[p], sent.pop(p + "_"))]
        for p in ("docs_of", "counts", "docs"):
            sent[p] = [x.astype(np.int32) for x in sent[p]]
        words, word_of = np.unique(np.concatenate([np.repeat(w, n) for w, n in zip(sent["words"], sent["pairs_of"])]),
                                   return_inverse=True)
        contexts = np.unique(np.concatenate(sent["contexts"]))
        context_of = np.concatenate([np.searchsorted(contexts, c)[i] if len(c) else np.zeros(0, np.int64) for c, i in zip(sent["contexts"], sent["context_of"])])
        many = max(1, len(contexts))
        keys, pair_of = np.unique(word_of.astype(np.int64) * many + context_of, return_inverse=True)
        shift = np.concatenate([[0], np.cumsum([len(d) for d in sent["docs"]])])
        doc = np.concatenate([d + s for d, s in zip(sent["docs_of"], shift)]).astype(np.int32)
        pair = np.repeat(pair_of.astype(np.int32), np.concatenate(sent["entries_of"]))
        count, coded = np.concatenate(sent["counts"]), np.concatenate(sent["docs"])
        rows = np.repeat(pdf["first"].to_numpy(), [len(d) for d in sent["docs"]]) + (coded >> 1)
        train = coded & 1
        pair_train = np.bincount(pair, weights=count * train[doc], minlength=len(keys)).astype(np.int64)
        pair_word = keys // many
        word_train = np.bincount(pair_word, weights=pair_train, minlength=len(words)).astype(np.int64)
        order = np.argsort(doc, kind="stable")
        at = np.searchsorted(hot, words) if len(hot) else np.zeros(len(words), np.int64)
        is_hot = (hot[np.minimum(at, len(hot) - 1)] == words) if len(hot) else np.zeros(len(words), bool)
        return pd.DataFrame([{
            "bucket": pdf["bucket"].iloc[0],
            "word_hot": _packed([np.where(is_hot, at + 1, 0)]),
            "word_pairs": _packed([np.bincount(pair_word, minlength=len(words))]),
            "contexts": _packed([np.diff(contexts, prepend=np.uint64(0))]),
            "pair_context": _packed([keys % many]), "pair_train": _packed([pair_train]),
            "word_train": _packed([word_train]), "doc_rows": _packed([rows]),
            "doc_entries": _packed([np.bincount(doc, minlength=len(rows))]),
            "entry_pair": _packed([pair[order]]), "entry_count": _packed([count[order]]),
            "own": _packed([np.concatenate(sent[p]) for p in ("own", "own_tokens", "own_ids", "own_unnamed")]),
            "tokens": int(word_train.sum()), "words": int(((word_train > 0) & ~is_hot).sum())}])
    return run


# --- seating -------------------------------------------------------------------------------

def seat(customers: np.ndarray, pull: np.ndarray, discount: float, rng) -> np.ndarray:
    """Tables drawn for dishes with ``customers``, where ``pull`` = (strength + discount *
    tables in the restaurant) * parent's probability of the dish."""
    tables = (customers > 0).astype(np.int64)
    open_ = np.flatnonzero(customers > 1)
    seated = np.ones(len(open_))
    while len(open_):
        group = np.minimum(np.maximum(1, seated // 16), customers[open_] - seated)
        p = pull[open_] / (pull[open_] + seated - discount * tables[open_])
        tables[open_] += rng.binomial(group.astype(np.int64), np.clip(p, 0, 1))
        seated += group
        left = seated < customers[open_]
        open_, seated = open_[left], seated[left]
    return tables


_REPLY = "bucket int, owner int, turn int, slots binary, tables binary, guests binary, sums_at array<int>, sums_a array<double>, sums_b array<double>"


class Bucket:
    """One bucket's words and pairs, seated sweep by sweep.

    ``replies`` are the totals of its restaurants after each sweep so far; seating is deterministic, so
    any task can redo a bucket's sweeps from them."""

    def __init__(self, row: dict, plan: dict, replies: pd.DataFrame):
        self.n, self.plan = int(row["bucket"]), plan
        self.hot = _column(row["word_hot"]) - 1
        self.of = np.repeat(np.arange(len(self.hot)), _column(row["word_pairs"]))
        self.contexts = np.cumsum(_unpacked(row["contexts"], 1)[0], dtype=np.uint64)
        self.context, self.customers = _column(row["pair_context"]), _column(row["pair_train"])
        self.tables = (self.customers > 0).astype(np.int64)
        self.owner = (self.contexts >> np.uint64(8)) % np.uint64(plan["owners"])
        self.by_owner = np.argsort(self.owner, kind="stable")
        nothing = np.zeros(len(self.contexts))  # stays where the bucket has no restaurant to ask about
        self.guests, self.totals = nothing, collections.defaultdict(lambda: nothing)  # turn -> tables of each restaurant
        for turn, part in replies.sort_values(["turn", "owner"]).groupby("turn"):
            self.totals[turn] = self._placed(part["tables"])
            if turn == 0:
                self.slots = part["slots"].tolist()
                if "guests" in part:
                    self.guests = self._placed(part["guests"])
        self._parent(None, 0)

    def _placed(self, parts) -> np.ndarray:
        out = np.zeros(len(self.contexts))
        out[self.by_owner] = np.concatenate([_unpacked(x, 1)[0] for x in parts])
        return out

    def messages(self, turn: int) -> dict:
        """What its restaurants' owners are sent: contexts (later their places with the owner), tables
        and at first customers."""
        tables = np.bincount(self.context, weights=self.tables, minlength=len(self.contexts)).astype(np.int64)
        guests = np.bincount(self.context, weights=self.customers, minlength=len(self.contexts)).astype(np.int64)
        owners, at = np.unique(self.owner[self.by_owner], return_index=True)
        out = {"owner": owners.astype(np.int32).tolist(), "contexts": [], "tables": [], "guests": []}
        for i, mine in enumerate(np.split(self.by_owner, at[1:]) if len(owners) else ()):
            out["contexts"].append(_packed([np.diff(self.contexts[mine], prepend=np.uint64(0))]) if turn == 0 else self.slots[i])
            out["tables"].append(_packed([tables[mine]]))
            out["guests"].append(_packed([guests[mine]]) if turn == 0 else None)
        return out

    def _parent(self, totals: dict | None, turn: int) -> None:
        """Seats the tables of all contexts in the parent restaurant."""
        self.served = np.bincount(self.of, weights=self.tables, minlength=len(self.hot)).astype(np.int64)
        if totals is None:
            self.root = (self.served > 0).astype(np.int64)
            return
        split = self.hot >= 0
        if split.any():
            self.served[split] = totals["hot"][self.hot[split]]
        self.root = seat(self.served, np.full(len(self.hot), totals["root_pull"]), self.plan["d0"],
                         np.random.default_rng([_SEED, turn, self.n, 0]))
        if split.any():  # the same draw in every bucket that holds a part of the word
            self.root[split] = totals["hot_root"][self.hot[split]]

    def base(self, totals: dict) -> np.ndarray:
        """Parent's probability of each word."""
        kept = np.maximum(self.served - self.plan["d0"] * self.root, 0.0)
        return (kept + totals["root_pull"]) / (self.plan["strength"] + totals["served"])

    def sweep(self, totals: dict, turn: int) -> None:
        self._parent(totals, turn)
        pull = (self.plan["strength"] + self.plan["d1"] * self.totals[turn][self.context]) * self.base(totals)[self.of]
        self.tables = seat(self.customers, pull, self.plan["d1"], np.random.default_rng([_SEED, turn, self.n, 1]))

    def probability(self, totals: dict, turn: int) -> np.ndarray:
        """Predictive probability of every pair given the seating and its totals."""
        self._parent(totals, turn)
        d, guests = self.plan["d1"], self.plan["strength"] + self.guests[self.context]
        own = np.maximum(self.customers - d * self.tables, 0.0)
        back = self.plan["strength"] + d * self.totals[turn][self.context]
        return (own + back * self.base(totals)[self.of]) / guests


_MESSAGE = ("owner int, bucket int, contexts binary, tables binary, guests binary, "
            "sums_at array<int>, sums_a array<double>, sums_b array<double>")
_FEW = 6  # sums beside those of hot words


def _swept(shared, turn: int):
    """A bucket after the sweeps so far: messages to the owners of its restaurants, and a row of sums."""
    def run(state: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        if not len(state):
            return pd.DataFrame(columns=["owner", "bucket", "contexts", "tables", "guests", "sums_at", "sums_a", "sums_b"])
        plan, history = shared.value
        row = state.iloc[0]
        bucket = Bucket(row, plan, replies)
        for t, totals in enumerate(history):
            bucket.sweep(totals, t)
        served = np.bincount(bucket.of, weights=bucket.tables, minlength=len(bucket.hot))
        split = bucket.hot >= 0
        few = [served.sum(), bucket.root[~split].sum(), (bucket.customers == 1).sum(), (bucket.customers == 2).sum(),
               (served[~split] == 1).sum(), (served[~split] == 2).sum()]
        out = bucket.messages(turn)
        n = len(out["owner"])
        train = _column(row["word_train"])[split]
        return pd.DataFrame({
            "owner": [*out["owner"], -1 - bucket.n], "bucket": bucket.n, "contexts": [*out["contexts"], None],
            "tables": [*out["tables"], None], "guests": [*out["guests"], None],
            "sums_at": [None] * n + [[*range(_FEW), *(bucket.hot[split] + _FEW).tolist()]],
            "sums_a": [None] * n + [[*map(float, few), *served[split].tolist()]],
            "sums_b": [None] * n + [[0.0] * _FEW + train.astype(float).tolist()]})
    return run


def _owned(turn: int):
    """An owner's restaurants: adds up what the buckets sent and answers each; sums pass through."""
    def run(sent: pd.DataFrame) -> pd.DataFrame:
        out = sent.rename(columns={"contexts": "slots"}).assign(turn=turn)
        if int(sent["owner"].iloc[0]) < 0:
            return out
        steps = [_unpacked(x, 1)[0] for x in sent["contexts"]]
        ends = np.cumsum([len(x) for x in steps])[:-1]
        at = np.concatenate([np.cumsum(x, dtype=np.uint64 if turn == 0 else np.int64) for x in steps])
        if turn == 0:
            at = np.unique(at, return_inverse=True)[1]
            out["slots"] = [_packed([np.diff(x, prepend=0)]) for x in np.split(at, ends)]
        else:
            out["slots"] = None
        for name in ("tables", "guests") if turn == 0 else ("tables",):
            parts = np.concatenate([_unpacked(x, 1)[0] for x in sent[name]])
            total = np.bincount(at, weights=parts).astype(np.int64)[at]
            out[name] = [_packed([x]) for x in np.split(total, ends)]
        return out
    return run


def _exchange(state: DataFrame, replies: DataFrame, sc, plan: dict, history: list[dict], hot: int) -> tuple[DataFrame, dict]:
    """The replies after the sweeps of ``history``, written, and the sums over all buckets: at most
    a row per hot word comes back."""
    turn = len(history)
    need = state.select(*[c.split()[0] for c in _SEATS.split(", ")])
    sent = need.groupBy("bucket").cogroup(replies.select("bucket", "owner", "turn", "slots", "tables").groupBy("bucket")).applyInPandas(_swept(sc.broadcast((plan, history)), turn), _MESSAGE)
    new = materialize(sent.groupBy("owner").applyInPandas(_owned(turn), _REPLY), "lm-totals")
    rows = new.where("owner < 0").select(F.explode(F.arrays_zip("sums_at", "sums_a", "sums_b")).alias("s")) \
        .groupBy("s.sums_at").agg(F.sum("s.sums_a").alias("a"), F.sum("s.sums_b").alias("b")).collect()
    a, b = np.zeros(_FEW + hot), np.zeros(_FEW + hot)
    for r in rows:
        a[r["sums_at"]], b[r["sums_at"]] = r["a"], r["b"]
    return new.where("owner >= 0"), {"hot": a[_FEW:].astype(np.int64), "hot_train": b[_FEW:].astype(np.int64),
                                     "served": a[0], "root": a[1], "few": a[:_FEW]}


def _discount(one: float, two: float) -> float:
    return float(np.clip(one / (one + 2 * two), 0.05, 0.95)) if one + two else 0.5


def _with_root(totals: dict, plan: dict, turn: int) -> dict:
    """Adds what the parent restaurant needs: hot words' tables in it, and the pull of its base."""
    start = np.full(len(totals["hot"]), plan["pull0"])
    totals["hot_root"] = seat(totals["hot"], start, plan["d0"], np.random.default_rng([_SEED, turn]))
    totals["root_pull"] = (plan["strength"] + plan["d0"] * (totals["root"] + totals["hot_root"].sum())) / (plan["words"] + 1)
    plan["pull0"] = totals["root_pull"]
    return totals


def _frequent(docs: DataFrame, rows: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """From a sample of documents: hashes of words that hold over an eighth of a bucket's share, and of the
    ``COMMON_WORDS`` most frequent.  They set layout and coding, not results."""
    share = min(1.0, HOT_SAMPLE_DOCS / max(1, rows))
    sample = docs.where(draw("hot") < share).select(F.explode(F.split(F.lower(F.col("text").cast("string")), r"[\x20\x09-\x0D]+")).alias("w"))
    counts = sample.where("w <> ''").groupBy("w").count()
    found = counts.orderBy(F.desc("count"), "w").limit(max(COMMON_WORDS, 8 * buckets)).toArrow()
    total = counts.agg(F.sum("count")).first()[0] or 0
    words, n = [_hash(w.encode()) for w in found.column("w").to_pylist()], found.column("count").to_pylist()
    hot = {h for h, m in zip(words, n) if m > total / (8 * buckets)} | {_hash(_END)}
    return np.array(sorted(hot), np.uint64), np.array(sorted({*words[:COMMON_WORDS], _hash(_END), _hash(_START)}), np.uint64)


def score(docs: DataFrame, training: Column, sweeps: int = SWEEPS, burn: int = BURN, strength: float = STRENGTH,
          discount: float | None = None) -> DataFrame:
    """``(doc_id, n_tokens, n_known, train_tokens, base_score, score)`` of every row;
    the model learns from rows for which ``training`` holds.  Scores are log10.  Without a
    ``discount`` each level's is estimated from the dishes with one and two customers."""
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"),
                       F.coalesce(training, F.lit(False)).alias("train"))
    size = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    buckets = max(12, (size["bytes"] or 0) // 6 // BUCKET_TOKENS)
    hot, common = _frequent(rows, size["n"], buckets)
    spark, name = docs.sparkSession, f"adlens_lm_{uuid.uuid4().hex[:12]}"
    merged = _deal(rows, buckets, hot, common).groupBy("bucket").applyInPandas(_merge(hot, common), _ROW)
    try:
        with _batches_of(spark, 500):
            merged.write.bucketBy(min(buckets, MAX_FILES), "bucket").sortBy("bucket").format("parquet") \
                .option("path", scratch_dir(spark, "lm-buckets")).option("compression", "zstd").saveAsTable(name)
        state = spark.table(name)
        plan = {"d0": 0.5, "d1": 0.5, "words": 0, "pull0": 1.0, "strength": strength, "discount": discount, "owners": max(12, buckets // OWNER_BUCKETS)}
        plan, history, replies = _sampled(state, sc, plan, len(hot), sweeps)
        with _batches_of(spark, 1):
            docs_ = materialize(_document_sums(state, replies, sc, plan, history, burn, buckets).groupBy("row").agg(
                F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"),
                F.sum("base_score").alias("base_score"), F.sum("score").alias("score")), "lm-scores")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return docs_.select("doc_id", "n_tokens", "n_known", F.lit(plan["tokens"]).cast("long").alias("train_tokens"),
                        "base_score", "score")


def _sampled(state: DataFrame, sc, plan: dict, hot: int, sweeps: int) -> tuple[dict, list[dict], DataFrame]:
    """The model's constants, the sums after each sweep, and the replies of all sweeps by bucket."""
    none = state.sparkSession.createDataFrame([], _REPLY)
    replies, first = _exchange(state, none, sc, plan, [], hot)
    known = state.agg(F.sum("tokens").alias("n"), F.sum("words").alias("v")).first()
    plan |= {"tokens": int(known["n"] or 0), "words": int(known["v"] or 0) + int((first["hot_train"] > 0).sum()),
             "d1": _discount(*first["few"][2:4]), "d0": _discount(*first["few"][4:6])}
    if plan["discount"] is not None:
        plan |= {"d0": plan["discount"], "d1": plan["discount"]}
    plan["pull0"] = plan["strength"] / (plan["words"] + 1)
    history = [_with_root(first, plan, 0)]
    for turn in range(1, sweeps + 1):
        new, totals = _exchange(state, replies, sc, plan, history, hot)
        replies = replies.unionByName(new)
        history.append(_with_root(totals, plan, turn))
    return plan, history, replies


def _document_sums(state: DataFrame, replies: DataFrame, sc, plan: dict, history: list[dict], burn: int, buckets: int) -> DataFrame:
    """Per task and document: sums over the words of the task's buckets; and every document
    once with its id.  Tasks take several buckets each, about the root of their number, so
    that a document comes back few times; beyond 300 tasks that is bounded by its distinct words."""
    shared = sc.broadcast((plan, history))

    def run(batches):
        """A task's buckets one after another, added up; given up whenever ``HELD_DOCS`` documents are held."""
        held = np.zeros(0, np.int64), np.zeros((0, 3))
        for b in batches:
            for row in b.to_pylist():
                held = _added(held, _bucket_sums(row, *shared.value, burn))
                rows, tokens, ids, unnamed = _unpacked(row["own"], 4)
                zero = np.zeros(len(rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows.astype(np.int64)), pa.array(ids.astype(np.uint64).view(np.int64), mask=unnamed > 0),
                     pa.array(tokens.astype(np.int64)), pa.array(zero.astype(np.int64)), pa.array(zero), pa.array(zero)], _SUMS)
                if len(held[0]) >= HELD_DOCS:
                    yield _given(held)
                    held = np.zeros(0, np.int64), np.zeros((0, 3))
        yield _given(held)
    tasks = max(12, math.isqrt(buckets), buckets // 300)
    # Dealt as the table's buckets are, so that only replies move.
    heard = replies.repartition(min(buckets, MAX_FILES), "bucket").groupBy("bucket").agg(
        F.collect_list(F.struct(*_HEARD)).alias("replies"))
    return state.join(heard.hint("merge"), "bucket", "left").coalesce(tasks) \
        .mapInArrow(run, "row long, doc_id long, n_tokens long, n_known long, base_score double, score double")


def _bucket_sums(row: dict, plan: dict, history: list[dict], burn: int) -> tuple[np.ndarray, np.ndarray]:
    """The documents a bucket's words occur in, and their known tokens, base score and score there."""
    bucket, kept = Bucket(row, plan, pd.DataFrame(row["replies"] or [], columns=_HEARD)), []
    for turn, totals in enumerate(history):
        if turn > burn or turn == len(history) - 1:
            kept.append(bucket.probability(totals, turn))
        if turn < len(history) - 1:
            bucket.sweep(totals, turn)
    logs = np.log10(np.mean(kept, axis=0))
    train = _column(row["word_train"])
    split = bucket.hot >= 0
    train[split] = history[0]["hot_train"][bucket.hot[split]]
    base = np.log10((train + 0.5) / (plan["tokens"] + 0.5 * (plan["words"] + 1)))
    sizes, count, pair = _column(row["doc_entries"]), _unpacked(row["entry_count"], 1)[0], _unpacked(row["entry_pair"], 1)[0]
    of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    by_pair = train[bucket.of] > 0, base[bucket.of], logs
    sums = [np.bincount(of, weights=count * x[pair], minlength=len(sizes)) for x in by_pair]
    return _column(row["doc_rows"]), np.stack(sums, axis=1)


def _added(a, b):
    """Sums by document of two lists of (documents, sums)."""
    docs, at = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    both = np.concatenate([a[1], b[1]])
    return docs, np.stack([np.bincount(at, weights=x, minlength=len(docs)) for x in both.T], axis=1).astype(float)


def _given(held) -> pa.RecordBatch:
    docs, sums = held
    none = pa.nulls(len(docs), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(docs), none, none, pa.array(sums[:, 0].astype(np.int64)),
                                       pa.array(sums[:, 1]), pa.array(sums[:, 2])], _SUMS)


_SUMS = ["row", "doc_id", "n_tokens", "n_known", "base_score", "score"]
_HEARD = ["owner", "turn", "slots", "tables", "guests"]


def perplexity(scored: DataFrame, *groups: str) -> DataFrame:
    """``(*groups, perplexity)`` over scored documents."""
    return scored.groupBy(*groups).agg(F.pow(F.lit(10.0), -F.sum("score") / F.sum("n_tokens")).alias("perplexity"))
