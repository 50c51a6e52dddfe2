"""Conversation structure repair by a run-length min-plus DP (operator 13).

A conversation's rows are taken by turn (nulls first), then role, then SHA-256 of the text; rows
equal in all of these are copies of one.  A row's first fault counts: ``blank`` (nothing but white
space), ``duplicate`` (role and text seen earlier in the conversation), ``truncated`` (last
character that is not white space is none of ``.!?``).  The cheapest edits that bring the roles'
initials to ``(s?(ua)+)?`` are found, of equal cost the ASCII-least audit:

* ``K`` keep (0), ``R`` give role user or assistant (3), ``D`` delete (4; the only edit of blank and
  duplicate rows), ``I`` insert an empty user or assistant row anywhere (3); truncated rows that
  stay add 3.  Only a kept system row gives ``s``, and only in front.

States are the last initial written: none, s, u, a.  A row's symbol is its initial (s, u, a, other)
and fault; its transition is a 4 x 4 min-plus matrix with the inserts before it.  Equal consecutive
symbols are one run, advanced through cached binary powers of its matrix; going back over the runs
gives every run's costs to go, and going forward the edits are unrolled: the least initial that
keeps to the optimum is taken next (an initial leads from a state to one state).

No conversation is gathered.  Rows are grouped (copies of one row are one row with a count; all
but the first are duplicates, or blank, and their ``D`` follow the first one's edit at once), then
sorted by ranges of (conversation, turn, role, text), and cut into *chunks* of at most 16,384 rows.
A chunk that is a whole conversation is solved where it is.  Of others each of the 16 ways from
state to state is unrolled; the costs and the audits' order are enough to choose among
them per conversation (two audits over the same rows end in a row's edit, so neither is the other's
beginning).  Last, texts are streamed in order beside the chunks' audits to build the repaired text;
SHA-256 can only be fed in order, so one task streams a conversation's texts, holding one row.

Null values are one space.  An empty role has no initial and can't be kept as it is.  A null
``conv_id`` is a conversation like any other.  Gaps beyond a long come out as the largest long.
Only conv_id, turn, role and text are read, so other columns can't clash; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlens.llm.tables import materialize

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
CHUNK_ROWS = 16_384
EMPTY = hashlib.sha256().digest()
SPACE = " \t\n\x0b\x0c\r"
LONGEST = (1 << 63) - 1
NEVER = 1 << 60
# States and initials: nothing or other, s, u, a.
NONE, S, U, A = range(4)
OTHER = 0
# Where an initial leads from a state; what may end.
STEPS = {(NONE, S): S, (NONE, U): U, (S, U): U, (A, U): U, (U, A): A}
NEXT = {NONE: U, S: U, U: A, A: U}
TAILS = {NONE: "", A: "", U: "I", S: "II"}
INITIALS = "?sua"
ROLES = {U: "user", A: "assistant"}
# Row faults; a symbol is 4 * fault + initial, and MUST_DELETE.
FINE, SHORT, MUST_DELETE = 0, 1, 8
INSERTED = {U: "user:", A: "assistant:"}


# --- the DP -------------------------------------------------------------------------------------

def moves(state: int, symbol: int) -> list[tuple[str, int, int, bool]]:
    """``(initial, cost, next state, row done)`` of the edits that a state allows before or at a row."""
    out = [("D", DELETE, state, True)]
    if symbol != MUST_DELETE:
        extra = TRUNCATED if symbol // 4 == SHORT else 0
        initial = symbol % 4
        if (state, initial) in STEPS:
            out.append(("K", KEEP + extra, STEPS[state, initial], True))
        out.append(("R", REROLE + extra, NEXT[state], True))
    out.append(("I", INSERT, NEXT[state], False))
    return out


def min_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), NEVER)


@functools.cache
def power(symbol: int, exponent: int) -> np.ndarray:
    """The transition of 2^exponent equal rows."""
    if exponent:
        half = power(symbol, exponent - 1)
        return min_plus(half, half)
    insert = np.full((4, 4), NEVER, np.int64)
    row = np.full((4, 4), NEVER, np.int64)
    np.fill_diagonal(insert, 0)
    for state in range(4):
        for _, cost, to, done in moves(state, symbol):
            matrix = row if done else insert
            matrix[state, to] = min(matrix[state, to], cost)
    inserts = min_plus(min_plus(insert, insert), min_plus(insert, insert))
    return min_plus(inserts, row)


def back(runs: list[tuple[int, int]], end: np.ndarray) -> list[np.ndarray]:
    """Costs to go (a column for each way to end) before every run, and ``end`` last."""
    to_go = [end]
    for symbol, n in reversed(runs):
        now, exponent = to_go[-1], 0
        while n:
            if n & 1:
                now = min_plus(power(symbol, exponent), now)
            n, exponent = n >> 1, exponent + 1
        to_go.append(now)
    return to_go[::-1]


def unroll(runs: list[tuple[int, int]], to_go: list[np.ndarray], column: int, start: int) -> tuple[str, int]:
    """The ASCII-least audit of the cheapest edits from state ``start``, and the state it reaches
    (every initial leads to one state)."""
    audit, state = [], start
    for at, (symbol, n) in enumerate(runs):
        # Costs to go inside the run, a row at a time from its end.
        inside = [to_go[at + 1][:, column]]
        for _ in range(n):
            inside.append(np.minimum((power(symbol, 0) + inside[-1]).min(axis=1), NEVER))
        while n:
            edit, state, done = min((initial, to, done) for initial, cost, to, done in moves(state, symbol)
                                    if cost + inside[n - done][to] == inside[n][state])
            audit.append(edit)
            n -= done
    return "".join(audit), state


def tail_costs() -> np.ndarray:
    return np.array([[INSERT * len(TAILS[s]) if s in TAILS else NEVER] for s in range(4)], np.int64)


@functools.lru_cache(maxsize=65_536)
def solve(runs: tuple[tuple[int, int], ...]) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    to_go = back(runs, tail_costs())
    audit, state = unroll(runs, to_go, 0, NONE)
    return int(to_go[0][NONE, 0]), audit + TAILS[state]


def ways(runs: tuple[tuple[int, int], ...]) -> tuple[list[int], list[str]]:
    """Costs and audits of all 16 ways through a chunk (4 * from + to; NEVER and "" if none)."""
    end = np.full((4, 4), NEVER, np.int64)
    np.fill_diagonal(end, 0)
    to_go = back(runs, end)
    costs = [int(c) for c in to_go[0].ravel()]
    return costs, [unroll(runs, to_go, w % 4, w // 4)[0] if c < NEVER else "" for w, c in enumerate(costs)]


def after(state: int, edit: str, initial: int) -> int:
    """The state after an edit of a row with this initial."""
    return state if edit == "D" else STEPS[state, initial] if edit == "K" else NEXT[state]


def choose(chunks: list[tuple[list[int], list[int]]]) -> tuple[int, list[int], int]:
    """``(cost, way of each chunk, last state)`` from the chunks' 16 costs and audit orders: a
    state's place among the four least audits so far, then the chunk's own audit, decide ties."""
    costs, places, links = [0, NEVER, NEVER, NEVER], [0, 0, 0, 0], []
    for step, order in chunks:
        best = []
        for to in range(4):
            found = [(costs[p] + step[4 * p + to], places[p], order[4 * p + to], p) for p in range(4)
                     if costs[p] < NEVER and step[4 * p + to] < NEVER]
            best.append(min(found, default=(NEVER, 0, 0, -1)))
        keys = sorted({b[1:3] for b in best if b[0] < NEVER})
        costs = [b[0] for b in best]
        places = [keys.index(b[1:3]) if b[0] < NEVER else 0 for b in best]
        links.append([4 * b[3] + to for to, b in enumerate(best)])
    cost, _, _, last = min((costs[s] + INSERT * len(TAILS[s]), places[s], TAILS[s], s)
                           for s in TAILS if costs[s] < NEVER)
    picked, state = [], last
    for link in reversed(links):
        picked.append(link[state])
        state = link[state] // 4
    return cost, picked[::-1], last


# --- rows and chunks ------------------------------------------------------------------------------

def _order():
    return [F.asc_nulls_first(c) for c in _PLACE]


def _or_space(c: str):
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damage(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` after damage by the row's hash: a twentieth each is dropped,
    emptied, loses its ``.!?``, comes twice, gets role user."""
    hit = F.crc32(F.encode(F.concat(_or_space("conv_id"), F.lit(":"), _or_space("turn")), "UTF-8")) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), _or_space("role").alias("role"),
                                _or_space("text").alias("text"), hit.alias("hit")).where("hit <> 0")
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("hit") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"),
                       text.alias("text"), copies.alias("_copy")).drop("_copy")


def marked(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, digest, n, fault)`` of distinct rows: ``n`` copies, ``fault`` of the
    first: blank, duplicate, truncated or null."""
    bare = F.rtrim("text", F.lit(SPACE))
    same = rows.select(
        "conv_id", "turn", "role", F.sha2("text", 256).alias("digest"), (bare == "").alias("blank"),
        (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("truncated")) \
        .groupBy("conv_id", "turn", "role", "digest", "blank", "truncated").agg(F.count("*").alias("n"))
    same = materialize(same, "rows")
    # The first place of a role and text: one key of its own for every row, however often a text comes.
    first = same.where("not blank").groupBy(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"),
                                            F.col("digest").alias("_digest")) \
        .agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("_place"))
    first = first.select("_conv", "_role", "_digest", F.col("_place.turn").alias("_turn"), F.lit(True).alias("_first"))
    joined = same.join(first, F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("turn").eqNullSafe(F.col("_turn"))
                       & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest")), "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("_first").isNull(), "duplicate") \
        .when(F.col("truncated"), "truncated")
    return joined.select("conv_id", "turn", "role", "digest", "n", fault.alias("fault"))


_PLACE = ["conv_id", "turn", "role", "digest"]
_FOUND = ("blank", "duplicate", "truncated", "illegal")


def _initial(role: str) -> int:
    return max(0, INITIALS.find(role[:1], 1)) if role else OTHER


def _pair(a: str, b: str) -> bool:
    """Two neighbours' initials are none of su, ua, au."""
    return a[:1] + b[:1] not in ("su", "ua", "au")


class _Chunk:
    """What is gathered of consecutive rows of one conversation."""

    def __init__(self, conv, turn, role, digest):
        self.first = (conv, turn, role, digest)
        self.last_turn = self.last_role = None
        self.low = self.high = None
        self.rows = self.turns = self.more = 0
        self.runs: list[list[int]] = []
        self.found = dict.fromkeys(_FOUND, 0)

    def add(self, turn, role, n, fault):
        again = "blank" if fault == "blank" else "duplicate"
        if fault:
            self.found[fault] += 1
        self.found[again] += n - 1
        self.found["illegal"] += (n - 1) * _pair(role, role) + (self.rows > 0 and _pair(self.last_role, role))
        if turn is not None:
            self.turns += self.rows == 0 or turn != self.last_turn
            self.low, self.high = turn if self.low is None else self.low, turn
        symbol = MUST_DELETE if fault in ("blank", "duplicate") else \
            4 * (SHORT if fault else FINE) + _initial(role)
        if self.runs and self.runs[-1][0] == symbol:
            self.runs[-1][1] += 1
        else:
            self.runs.append([symbol, 1])
        self.rows, self.more = self.rows + 1, self.more + n - 1
        self.last_turn, self.last_role = turn, role

    def row(self, whole: bool) -> dict:
        runs = tuple((s, n) for s, n in self.runs)
        if whole:
            cost, audit = solve(runs)
            costs, audits, order = [cost], [audit], [0]
        else:
            costs, audits = ways(runs)
            ranks = {a: i for i, a in enumerate(sorted(set(audits)))}
            order = [ranks[a] for a in audits]
        return dict(zip(_PLACE, self.first)) | self.found | {
            "costs": costs, "audits": audits, "order": order, "more": self.more, "turns": self.turns, "low": self.low,
            "high": self.high, "last_turn": self.last_turn, "last_role": self.last_role}


_CHUNK_FIELDS = [
    ("turn", pa.int64()), ("role", pa.string()), ("digest", pa.string()),
    *[(f, pa.int64()) for f in _FOUND], ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())),
    ("order", pa.list_(pa.int32())), ("more", pa.int64()), ("turns", pa.int64()), ("low", pa.int64()),
    ("high", pa.int64()), ("last_turn", pa.int64()), ("last_role", pa.string())]
_CHUNK_DDL = ("turn long, role string, digest string, blank long, duplicate long, truncated long, illegal long, "
              "costs array<long>, audits array<string>, order array<int>, more long, turns long, low long, high long, "
              "last_turn long, last_role string")


def _batches(rows, schema, most=4096):
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def chunks(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Rows by ranges of their order, a row for each chunk; a conversation with another one before
    and after it in its range, and not cut, is whole (one cost and audit, with the inserts at its end)."""
    ordered = rows.repartitionByRange(*_order()).sortWithinPartitions(*_order())
    conv = rows.schema["conv_id"].dataType.simpleString()

    def run(batches):
        kind = None

        def cut():
            nonlocal kind
            chunk, inner = None, False
            for b in batches:
                kind = b.schema.field("conv_id").type
                columns = [b.column(c).to_pylist() for c in [*_PLACE, "n", "fault"]]
                for conv_id, turn, role, digest, n, fault in zip(*columns):
                    if chunk is None or chunk.first[0] != conv_id:
                        if chunk is not None:
                            yield chunk.row(inner)
                            inner = True
                        chunk = _Chunk(conv_id, turn, role, digest)
                    elif chunk.rows >= chunk_rows:
                        yield chunk.row(False)
                        chunk, inner = _Chunk(conv_id, turn, role, digest), False
                    chunk.add(turn, role, n, fault)
            if chunk is not None:
                yield chunk.row(False)
        found = cut()
        head = next(found, None)
        if head is not None:
            schema = pa.schema([("conv_id", kind), *_CHUNK_FIELDS])
            yield from _batches((r for rs in ([head], found) for r in rs), schema, 1024)
    return ordered.mapInArrow(run, f"conv_id {conv}, {_CHUNK_DDL}")


def _joined(cut: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(chunks with their audit and the state before it, conversations with their figures)``."""
    conv = cut.schema["conv_id"].dataType.simpleString()
    whole = cut.where("size(costs) = 1")
    parts = cut.where("size(costs) > 1").drop("audits")

    def join(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("turn", "ascending"), ("role", "ascending"), ("digest", "ascending")]).to_pylist()
        rows.sort(key=lambda r: r["turn"] is not None)  # nulls first, order kept
        cost, picked, last = choose([(r["costs"], r["order"]) for r in rows])
        total = {f: sum(r[f] for r in rows) for f in (*_FOUND, "more", "turns")}
        for a, b in zip(rows, rows[1:]):
            total["illegal"] += _pair(a["last_role"], b["role"])
            total["turns"] -= b["turn"] is not None and a["last_turn"] == b["turn"]
        lows, highs = [r["low"] for r in rows if r["low"] is not None], [r["high"] for r in rows if r["high"] is not None]
        out = []
        for i, (r, way) in enumerate(zip(rows, picked)):
            end = i == len(rows) - 1
            out.append({c: r[c] for c in _PLACE} | {"way": way, "tail": TAILS[last] if end else ""} | (
                total | {"cost": cost, "low": min(lows, default=None), "high": max(highs, default=None)}
                if end else {}))
        return pa.Table.from_pylist(out, pa.schema([
            ("conv_id", table.schema.field("conv_id").type), ("turn", pa.int64()), ("role", pa.string()),
            ("digest", pa.string()), ("way", pa.int32()), ("tail", pa.string()),
            *[(f, pa.int64()) for f in (*_FOUND, "more", "turns", "cost", "low", "high")]]))

    figures = [*_FOUND, "more", "turns", "cost", "low", "high"]
    solved = parts.groupBy("conv_id").applyInArrow(
        join, f"conv_id {conv}, turn long, role string, digest string, way int, tail string, "
              + ", ".join(f"{f} long" for f in figures))
    solved = materialize(solved, "ways")
    w = solved.select(*[F.col(c).alias(f"_{c}") for c in _PLACE], "way", "tail")
    cutoff = cut.where("size(costs) > 1").select(*_PLACE, "audits").join(w, functools.reduce(
        lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in _PLACE]))
    audits = whole.select(*_PLACE, F.col("audits")[0].alias("audit"), F.lit(0).alias("state")).unionByName(
        cutoff.select(*_PLACE, F.concat(F.element_at("audits", F.col("way") + 1), F.col("tail")).alias("audit"),
                      F.shiftright("way", 2).alias("state")))
    totals = whole.withColumn("cost", F.col("costs")[0]).select("conv_id", *figures).unionByName(
        solved.where("cost is not null").select("conv_id", *figures))
    return audits, totals


# --- repaired texts -------------------------------------------------------------------------------

def _stream(batches):
    """Rows of one conversation after another, a chunk's audit before its rows: ``(conv_id, audit,
    repaired_sha256)``.  Holds a chunk's audit, a row, and the audit so far."""
    kind = None

    def conversations():
        nonlocal kind
        conv = sha = before = None
        audit, edits, at, state = [], "", 0, NONE

        def put(line):
            sha.update((line if sha.digest() == EMPTY else "\n" + line).encode("utf-8", "surrogatepass"))

        def inserts():
            nonlocal at, state
            while at < len(edits) and edits[at] == "I":
                state, at = NEXT[state], at + 1
                audit.append("I")
                put(INSERTED[state])

        def done():
            inserts()
            return {"conv_id": conv, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()}

        for b in batches:
            kind = b.schema.field("conv_id").type
            for conv_id, turn, role, digest, text, chunk, start in zip(
                    *(b.column(c).to_pylist() for c in [*_PLACE, "text", "audit", "state"])):
                if sha is None or conv_id != conv:
                    if sha is not None:
                        yield done()
                    conv, sha, before, audit = conv_id, hashlib.sha256(), None, []
                if chunk is not None:
                    edits, at, state = chunk, 0, start
                elif (turn, role, digest) == before:  # a further copy: deleted after the first one's edit
                    audit.append("D")
                else:
                    inserts()
                    before, edit, at = (turn, role, digest), edits[at], at + 1
                    audit.append(edit)
                    state = after(state, edit, _initial(role))
                    if edit != "D":
                        put((role if edit == "K" else ROLES[state]) + ":" + text)
        if sha is not None:
            yield done()
    found = conversations()
    head = next(found, None)
    if head is not None:
        schema = pa.schema([("conv_id", kind), ("audit", pa.string()), ("repaired_sha256", pa.string())])
        yield from _batches((r for rs in ([head], found) for r in rs), schema, 256)


def repair(conversations: DataFrame, rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Structure of ``rows(conv_id, turn, role, text)`` (no nulls but in conv_id and turn) and its
    cheapest repair, a row for every ``conv_id`` of ``conversations``."""
    conv = conversations.schema["conv_id"].dataType.simpleString()
    cut = materialize(chunks(marked(rows), chunk_rows), "chunks")
    audits, totals = _joined(cut)
    texts = rows.select(*_PLACE[:3], F.sha2("text", 256).alias("digest"), "text",
                        F.lit(None).cast("string").alias("audit"), F.lit(None).cast("int").alias("state"))
    audits = audits.select(*_PLACE, F.lit(None).cast("string").alias("text"), "audit", "state")
    # Hashed by text, a null conv_id is a key like any other; a chunk's audit comes before its rows.
    streamed = texts.unionByName(audits).repartition("conv_id") \
        .sortWithinPartitions(*_order(), F.asc(F.col("audit").isNull()))
    repaired = streamed.mapInArrow(_stream, f"conv_id {conv}, audit string, repaired_sha256 string")
    gaps = F.when(F.col("low").isNull(), F.lit(0).cast("decimal(38,0)")).otherwise(
        F.col("high").cast("decimal(38,0)") - F.col("low") + 1 - F.col("turns"))
    figures = totals.select(
        F.col("conv_id").alias("_c"), F.least(gaps, F.lit(LONGEST)).cast("long").alias("gaps"), *_FOUND,
        (F.col("cost") + DELETE * F.col("more")).alias("cost"))
    every = conversations.select("conv_id").distinct()
    out = every.join(figures, F.col("conv_id").eqNullSafe(F.col("_c")), "left").drop("_c") \
        .join(repaired.withColumnRenamed("conv_id", "_c"), F.col("conv_id").eqNullSafe(F.col("_c")), "left").drop("_c")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", *_FOUND, "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
