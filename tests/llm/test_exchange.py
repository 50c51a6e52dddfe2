"""Golomb-coded exact duplicates against brute force."""

import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from adlens.llm import exchange

DDL = "doc_id long, text string, keep_id string, _block long, _row long, suspect int, flags string"


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        done = False
        for i in ids:
            kept = i == keep and not done
            done |= kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, parts=3):
    df = spark.createDataFrame([(i, t, "x", 1, 2, 3, "f") for i, t in rows], DDL).repartition(parts)
    got = exchange.classes(df).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    return sorted((tuple(r) for r in got), key=str)


def test_groups_equal_brute_force_on_odd_rows(spark):
    rng = random.Random(5)
    rows = [(n, f"text {rng.randrange(300)}") for n in range(600)]
    rows += [(n, "hot copy") for n in range(1000, 1500)]
    rows += [(None, None), (7, ""), (None, ""), (None, "alone"), (9, "twice"), (9, "twice"), (3, " "), (4, "  "),
             (5, "é"), (6, "é"), (8, "long " * 200_000), (2, "long " * 200_000), (11, "long " * 199_999)]
    assert run(spark, rows) == brute(rows)


def test_empty_table_and_one_row(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, "a")]) == brute([(1, "a")])


def test_the_exchange_moves_no_text_but_of_suspects(spark):
    df = spark.range(5000).selectExpr("id doc_id", "concat('text ', id % 4999) text")
    marked = exchange.suspects(df, 5000)
    found = marked.where("suspect").count()
    assert 2 <= found < 60
    assert {r["doc_id"] for r in marked.where("suspect").collect()} >= {0, 4999}
    assert marked.count() == 5000


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 1 << 52), min_size=1, max_size=300))
def test_golomb_code_round_trip(values):
    ascending = np.array(sorted(values), np.int64)
    k, code = exchange.golomb_encode(ascending)
    assert exchange.golomb_decode(len(ascending), k, code).tolist() == ascending.tolist()


def test_the_code_is_near_the_information_bound():
    rng = np.random.default_rng(1)
    values = np.unique(rng.integers(0, 1 << 30, 1 << 14))
    _, code = exchange.golomb_encode(values)
    assert len(code) * 8 / len(values) < 16 + 2  # log2(2^30 / 2^14) bits and two more
