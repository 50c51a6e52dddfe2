"""Exact top-k and graph search against brute force."""

import numpy as np
import pandas as pd

from adlens.llm import graph, topk
from adlens.llm import vectors as V

DDL = "vec_id long, embedding array<float>, label int, shard int, score string"


def rows_of(x, first=0):
    return [(first + i, [float(v) for v in row], 0, 3, "s") for i, row in enumerate(x.astype(np.float32))]


ODD = [(1000, None, 0, 0, ""), (1010, [], 0, 0, ""), (1020, [None] * 8, 0, 0, ""), (1030, [float("nan")] * 8, 0, 0, ""),
       (1040, [float("inf")] * 8, 0, 0, ""), (None, [1.0] * 8, 0, 0, ""), (1050, [0.0] * 8, 0, 0, ""),
       (1060, [1.0, 2.0], 0, 0, ""), (1061, [2.0, 1.0], 0, 0, "")]


def table(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(150, 8)), np.tile(rng.normal(size=(1, 8)), (60, 1))])
    return spark.createDataFrame(rows_of(x) + ODD, DDL).repartition(3)


def usable(rows, zero):
    out = [(r["vec_id"], np.array(r["embedding"], float)) for r in rows if r["vec_id"] is not None and r["embedding"] is not None
           and all(v is not None and np.isfinite(v) for v in r["embedding"])]
    return [v for v in out if zero or np.any(v[1])]


def brute(rows, measure, k, zero):
    out, all_ = [], usable(rows, zero)
    for q, a in all_:
        if q % 10 == 0:
            found = sorted((-measure(a, b), i) for i, b in all_ if i != q and len(b) == len(a))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def test_exact_topk(spark, monkeypatch):
    monkeypatch.setattr(V, "FAN", 2)
    monkeypatch.setattr(V, "shard_count", lambda rows, *_: 7)
    monkeypatch.setattr(V, "TILE_ROWS", 9)
    df = table(spark)
    want = brute(df.collect(), lambda a, b: int(np.floor(256 * a) @ np.floor(256 * b)), 5, True)
    assert sorted(map(tuple, topk.top_k(df, 10, 5).collect())) == want


def test_exact_topk_of_huge_components():
    q = np.array([[2.0 ** 60, 1.0]])
    assert topk._products(q, np.array([[4.0, 3.0], [0.0, 5.0]])).tolist() == [[2 ** 62 + 3, 5]]
    assert topk._products(q, np.array([[2.0 ** 60, 0.0]])).tolist() == [[(1 << 63) - 1]]


def cosine(a, b):
    return a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b))


def test_graph_search_with_copies_and_odd_rows(spark):
    df = table(spark)
    got = sorted(map(tuple, graph.nearest(df, 10, 5).collect()))
    want = brute(df.collect(), cosine, 5, False)
    by = {}
    for q, _, i, _ in want:
        by.setdefault(q, set()).add(i)
    vec = dict(usable(df.collect(), False))
    hits = 0
    for q, rank, i, s in got:
        assert abs(s - cosine(vec[q], vec[i])) < 1e-12 and i != q
        hits += i in by[q] or any(abs(s - w[3]) < 1e-12 for w in want if w[0] == q)
    assert {q for q, *_ in got} == set(by) and hits >= 0.97 * len(want)
    for q in by:
        mine = [(-s, i) for x, _, i, s in got if x == q]
        assert mine == sorted(mine) and len(mine) == len(by[q])


def test_recall_over_the_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    x = np.array([r["embedding"] for r in df.orderBy("vec_id").collect()], float)
    got = {}
    for r in graph.nearest(df, 50, 5).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    hits = 0
    for q, found in got.items():
        s = unit @ unit[q]
        s[q] = -9
        hits += len(found & set(np.argsort(-s)[:5].tolist()))
    assert len(got) == 40 and hits >= 0.9 * 200


def test_recall_in_the_largest_shard():
    rows = 1 << 14
    for n in (10 ** 6, 14 * 10 ** 6, 10 ** 9):
        assert n / graph.shards_for(n) <= rows
    rng = np.random.default_rng(2)
    x, q = rng.normal(size=(rows, 64)), rng.normal(size=(200, 64))  # random directions, the hard case
    built = graph._index_shard(pd.DataFrame({"vec_id": np.arange(rows), "embedding": list(x), "shard": 0, "dim": 64}))
    found = graph._search_cell(built, pd.DataFrame({"query_id": -1 - np.arange(200), "query": list(q)}), 5, graph.SEARCH_BEAM)
    best = np.argsort(-(q @ (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).T), axis=1)[:, :5]
    hits = sum(len(set(ids) & set(best[-1 - i].tolist())) for i, ids in found.groupby("query_id")["vec_id"])
    assert hits >= 0.99 * best.size


def test_empty(spark):
    empty = spark.createDataFrame([], DDL)
    assert topk.top_k(empty, 50, 5).count() == 0 and graph.nearest(empty, 50, 5).count() == 0


def test_components_near_the_ends_of_a_double(spark):
    from adlens.llm import graph, topk
    rows = [(0, [1e200, 2e200]), (1, [1e200, 1e200]), (2, [-3e-200, 1e-200]), (3, [1.0, 2.0]), (4, [1e306, 1.0]), (5, [0.5, 0.25])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    near = {r["vec_id"]: r["score"] for r in graph.nearest(df, every=50, k=5).collect()}
    assert abs(near[3] - 1) < 1e-12 and abs(near[1] - 3 / 10 ** .5) < 1e-12 and abs(near[2] - -1 / (5 ** .5 * 10 ** .5)) < 1e-12
    best = topk.top_k(df, every=50, k=5).collect()
    assert 4 not in {r["vec_id"] for r in best} and len(best) == 4  # 256 * 1e306 is not finite


def test_other_columns_do_not_clash(spark):
    from adlens.llm import graph, topk
    df = spark.createDataFrame([(i, [1.0, float(i)], 1, 2, "q", 3) for i in range(60)],
                               "vec_id long, embedding array<double>, shard int, tile int, query string, dim int")
    assert topk.top_k(df, every=50, k=5).count() == 10 and graph.nearest(df, every=50, k=5).count() == 10


def test_sums_beyond_a_long_rank_by_their_exact_value(spark):
    from adlens.llm import topk
    big = 2.0 ** 60
    rows = [(0, [big, 1.0]), (3, [big, 0.0]), (2, [2 * big, 0.0]), (1, [4 * big, 0.0]), (4, [-big, 0.0]), (5, [-2 * big, 0.0]), (6, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [r["vec_id"] for r in topk.top_k(df, every=50, k=6, scale=1.0).orderBy("rank").collect()]
    assert got == [1, 2, 3, 6, 4, 5]


def test_equal_rows_fill_a_list_and_no_more_than_that(spark):
    from adlens.llm import graph, topk
    rows = [(50, [1.0, 0.0])] + [(7, [1.0, 0.5])] * 400 + [(i, [0.5, float(i)]) for i in range(1, 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert V.at_most(V.usable(df), 5).count() == 11
    assert [r["vec_id"] for r in topk.top_k(df, every=50, k=5).collect()] == [7] * 5
    assert [r["vec_id"] for r in graph.nearest(df, every=50, k=5).collect()] == [7] * 5
    asked = spark.createDataFrame([(7, [1.0, 0.5])] * 9 + [(8, [1.0, 0.5])] * 9, "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in graph.nearest(asked, every=7, k=5).collect()] == [8] * 5


def test_candidates_travel_once_per_million_queries():
    assert [V.tile_count(n) for n in (0, 1000, 20_000_000)] == [1, 1, 20]
