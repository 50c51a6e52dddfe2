"""Conversation repair against a brute-force DP over audits."""

import hashlib
import itertools
import random
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from adlens.llm import repair

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
DDL = "conv_id long, turn long, role string, text string, digest string, audit string, n long, fault string, cost long"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        hit = zlib.crc32(key.encode()) % 20
        if hit == 1:
            text = ""
        if hit == 2:
            text = re.sub("[.!?]", "", text)
        if hit == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else \
            "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        out.append(fault)
    return out


def cheapest(rows, found):
    """Least (cost, audit) for every string of initials' last letter, rows at a time."""
    best = {"": (0, "", [])}
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}

    def better(into, state, value):
        if state not in into or value[:2] < into[state][:2]:
            into[state] = value

    def inserted(states):
        out = dict(states)
        for _ in range(4):
            for state, (cost, audit, lines) in list(out.items()):
                n = follow[state]
                better(out, n, (cost + 3, audit + "I", lines + [names[n] + ":"]))
        return out

    for (_, _, role, text), fault in zip(rows, found):
        into = {}
        for state, (cost, audit, lines) in inserted(best).items():
            better(into, state, (cost + 4, audit + "D", lines))
            if fault in (None, "truncated"):
                more = 3 if fault else 0
                if state + role[:1] in ("s", "u", "su", "au", "ua") and role:
                    better(into, role[0], (cost + more, audit + "K", lines + [f"{role}:{text}"]))
                n = follow[state]
                better(into, n, (cost + more + 3, audit + "R", lines + [f"{names[n]}:{text}"]))
        best = into
    ends = [v for state, v in inserted(best).items() if state in ("", "a")]
    return min(ends, key=lambda v: v[:2])


def brute(rows):
    out = []
    ids = list(dict.fromkeys(r[0] for r in rows))
    after = damaged(rows)
    for conv in ids:
        own = sorted((r for r in after if r[0] == conv), key=lambda r: (
            r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).hexdigest()))
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        found = faults(own)
        cost, audit, lines = cheapest(own, found)
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        out.append((conv, min(gaps, (1 << 63) - 1), *(found.count(f) for f in ("blank", "duplicate", "truncated")),
                    illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, chunk_rows=repair.CHUNK_ROWS):
    df = spark.createDataFrame([(*r, "d", "a", 5, "f", 1) for r in rows], DDL)
    got = repair.repair(df, repair.damage(df), chunk_rows).select(*COLUMNS).collect()
    return sorted((tuple(r) for r in got), key=str)


def conversations(seed, convs, longest):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why", "ok then", "  ", "", "Sure? ", "Fine.\n", None, "x.y"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "unknown", "", None]
    return [(conv, None if rng.random() < .03 else turn, rng.choice(roles),
             f"{rng.choice(texts)}" if rng.random() < .5 else f"Text {rng.randrange(10 ** 6)}.")
            for conv in range(convs) for turn in range(rng.randrange(1, longest)) if rng.random() > .1]


def test_odd_rows_equal_brute_force(spark):
    rows = conversations(1, 60, 14)
    rows += [(None, 1, "user", "Hi."), (None, None, None, None), (900, None, "user", "A."), (900, None, "assistant", "B."),
             (901, 5, "user", "Same."), (901, 5, "user", "Same."), (901, 5, "user", "Same."), (901, 6, "assistant", "C."),
             (902, -(1 << 63), "user", "Low."), (902, (1 << 63) - 1, "assistant", "High."),
             (903, 1, "user", "long " * 100_000 + "."), (904, 1, "user", "Ends with separator. ")]
    assert run(spark, rows) == brute(rows)


def test_conversations_cut_into_chunks_equal_brute_force(spark):
    rows = conversations(2, 3, 400) + [(50, 7, "user", "Copy.")] * 40 + [(50, 8, "assistant", "Done.")]
    want = brute(rows)
    assert run(spark, rows, chunk_rows=9) == want
    assert run(spark, rows) == want


def test_empty_table(spark):
    assert run(spark, []) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(range(9)), max_size=40))
def test_cut_and_whole_solutions_agree(symbols):
    runs = tuple((s, len(list(g))) for s, g in itertools.groupby(symbols))
    if not symbols:
        return
    cost, audit = repair.solve(runs)
    parts = [symbols[i:i + 6] for i in range(0, len(symbols), 6)]
    solved = [repair.ways(tuple((s, len(list(g))) for s, g in itertools.groupby(p))) for p in parts]
    ordered = [(costs, [sorted(set(audits)).index(a) for a in audits]) for costs, audits in solved]
    total, picked, last = repair.choose(ordered)
    assert (total, "".join(audits[w] for (_, audits), w in zip(solved, picked)) + repair.TAILS[last]) == (cost, audit)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool"]),
                          st.sampled_from(["A.", "B.", "b", "", "c"])), max_size=10))
def test_runs_of_symbols_equal_brute_force(pairs):
    rows = [(1, n, role, text) for n, (role, text) in enumerate(pairs)]
    found = faults(rows)
    symbols = [repair.MUST_DELETE if f in ("blank", "duplicate") else 4 * (f == "truncated") + repair._initial(r[2])
               for r, f in zip(rows, found)]
    cost, audit, _ = cheapest(rows, found)
    if rows:
        assert repair.solve(tuple((s, len(list(g))) for s, g in itertools.groupby(symbols))) == (cost, audit)
