"""Ranked lexical search by bit-sliced signatures against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from adlens.llm import signatures as S

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, mark long, ids string, item int, score long, _id long, items string"
ITEMS = "item_id long, text string, _item int, rank int, doc_id long"


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, limit=20):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    held = [b for _, b in bags if b]
    n_docs, n_terms = len(held), sum(b.total() for b in held)
    df = Counter(t for b in held for t in b)
    out = []
    for item_id, text in items:
        scores = []
        for doc_id, bag in bags:
            m = 100 - 25 + 25 * bag.total() * n_docs // max(1, n_terms)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * (1_000_000_000 * bag[t] // (1000 * bag[t] + 12 * m)) for t in terms(text) if bag[t])
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, rank, doc_id, -s) for rank, (s, _, _, doc_id) in enumerate(sorted(scores, key=lambda x: x[:3])[:limit], 1)]
    return sorted(out, key=str)


def run(spark, docs, items, **more):
    d = spark.createDataFrame([(*r, 1, "i", 2, 3, 4, "x") for r in docs], DOCS).repartition(3)
    i = spark.createDataFrame([(*r, 1, 2, 3) for r in items], ITEMS)
    got = S.search(d, i, **more)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def corpus():
    rng = random.Random(7)
    word = lambda: f"w{int(rng.paretovariate(.6))}" if rng.random() < .9 else "the"
    docs = [(n, " ".join(word() for _ in range(rng.randrange(1, 120)))) for n in range(700)]
    docs += [(n, "exactly the same Text") for n in range(1000, 1060)]
    docs += [(2000, None), (2001, ""), (2002, "?!, \n"), (None, "the rare-pearl"), (None, "the rare-pearl"), (3, "the rare-pearl"),
             (2003, "É é ÉA Straße99 x_y"), (2004, "the " * 300_000 + "pearl"), (2005, "a" * 1_200_000 + " pearl w1")]
    return docs


def test_lists_equal_brute_force(spark):
    docs = corpus()
    items = [(n, docs[n * 9][1]) for n in range(40)]
    items += [(100, "rare pearl"), (101, "exactly"), (102, None), (103, "..."), (104, "nowhere to be found zzz"), (None, "pearl"),
              (105, "é straße99 X Y"), (106, "the the the"), (0, "same id w5"), (107, "EXACTLY the SAME text")]
    want = brute(docs, items)
    assert run(spark, docs, items) == want
    assert run(spark, docs, items, at_once=7) == want
    assert run(spark, docs, items, limit=3) == brute(docs, items, 3)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a")]) == []
    assert run(spark, [(1, "a"), (2, None)], []) == []
    assert run(spark, [(2, None)], [(1, "a")]) == []


@settings(max_examples=50, deadline=None)
@given(st.lists(st.dictionaries(st.sampled_from("abcdefghijkl"), st.integers(1, 40), min_size=1), min_size=1, max_size=64))
def test_bounds_are_never_below_the_scores(bags):
    held = [Counter({t.encode(): n for t, n in b.items()}) for b in bags]
    df = Counter(t for b in held for t in b)
    n_terms = sum(b.total() for b in held)
    items = [Counter({b"a": 1, b"b": 3, b"zz": 1}), Counter({b"c": 2}), Counter({b"none": 1})]
    queries = S.Queries(items, df, len(held), n_terms)
    rows = [(np.array([S.term_hash(t) for t in b], np.uint64), np.array(list(b.values()), np.int64)) for b in held]
    lengths = np.array([b.total() for b in held], np.int64)
    if len(queries.present):
        bounds = queries.bounds(lengths, S.signature(rows))
        for line, q in zip(bounds, queries.present):
            exact = [S.score(items[q], b, queries.weights, len(held), n_terms) for b in held]
            assert all(u >= e for u, e in zip(line, exact))


def test_few_rows_are_scored(spark):
    docs = spark.createDataFrame([(n, f"common word{n} word{n % 50} filler{n % 7}") for n in range(4000)], "doc_id long, text string")
    groups = S.index(docs)
    df = S.frequencies(docs, {b"common", b"word77", b"filler3"})
    assert df == {b"common": 4000, b"word77": 1, b"filler3": 571}
    queries = S.Queries([Counter([b"common", b"word77", b"filler3"])], df, 4000, 16000)
    shared = spark.sparkContext.broadcast(queries)
    best = S._scored(docs, S._highest(groups, shared, 32), shared, 20)
    bar = best.where("rank = 20").first()["score"]
    assert S._reaching(groups, shared, [bar]).count() < 800  # the rows that hold filler3, and few more
