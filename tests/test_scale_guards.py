"""Plan-shape and partitioning guarantees the library relies on at scale."""

from pyspark.sql import functions as F

from adlens.operators.classify import classify
from adlens.operators.keywords import extract_keywords
from adlens.operators.sizing import count_at_most
from adlens.operators.vectors import doc_vectors
from adlens.sources.stream import kafka_sink_options, kafka_source_options
from planutil import plan_text

import pytest


def test_count_at_most_stops_at_bound(spark):
    df = spark.range(1000)
    assert count_at_most(df, 10) == 11
    assert count_at_most(df, 5000) == 1000


def vocab(spark):
    return spark.createDataFrame([(f"w{i}", [float(i), 1.0]) for i in range(50)], "token string, vector array<float>")


def docs(spark):
    return spark.createDataFrame([(i, f"w{i % 50} w{(i * 7) % 50} zzz") for i in range(200)],
                                 "doc_id long, content string")


def test_vocabulary_broadcast_only_under_budget(spark):
    small = plan_text(doc_vectors(docs(spark), vocab(spark)), "simple")
    assert "BroadcastHashJoin" in small
    # A budget of 100 bytes fits no 50-row vocabulary: plain join, no broadcast hint.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        big = plan_text(doc_vectors(docs(spark), vocab(spark), max_broadcast_bytes=100), "simple")
        assert "BroadcastHashJoin" not in big and "SortMergeJoin" in big
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_broadcast_and_shuffle_paths_agree(spark):
    cats = spark.createDataFrame([("a", 0, "w1"), ("b", 1, "w40")], "category string, ord int, keyword string")
    a = {r["doc_id"]: r["category"] for r in classify(docs(spark), vocab(spark), cats).collect()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        b = {r["doc_id"]: r["category"]
             for r in classify(docs(spark), vocab(spark), cats, max_broadcast_bytes=100).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert a == b and len(a) == 200


def test_results_unchanged_under_repartitioning(spark):
    texts = spark.createDataFrame([(i, f"Bank bank art {i % 7} hotel{i % 3} the") for i in range(100)],
                                  "doc_id long, content string")
    one = {r["doc_id"]: r["keywords"] for r in extract_keywords(texts.coalesce(1)).collect()}
    many = {r["doc_id"]: r["keywords"] for r in extract_keywords(texts.repartition(7)).collect()}
    assert one == many


def test_only_scans_of_few_splits_are_dealt_out(spark):
    from adlens.plans.standins import dealt
    cores = spark.sparkContext.defaultParallelism
    assert dealt(spark.range(0, 100, 1, 1)).rdd.getNumPartitions() == cores
    many = spark.range(0, 100, 1, cores + 2)
    assert dealt(many) is many


def test_centroid_blocks_give_the_same_categories(spark):
    from adlens.operators.classify import CategoryModel
    cats = spark.createDataFrame([(f"c{i:02d}", i % 4, f"w{i}") for i in range(12)],
                                 "category string, ord int, keyword string")
    one, many = CategoryModel(vocab(spark), cats), CategoryModel(vocab(spark), cats, block_bytes=400)
    assert one.n_blocks == 1 and many.n_blocks > 1
    rows = [sorted((r["doc_id"], r["category"], [tuple(s) for s in r["similarities"]])
                   for r in m.transform(docs(spark), with_similarities=True).collect()) for m in (one, many)]
    assert rows[0] == rows[1] and len(rows[0]) == 200 and len(rows[0][0][2]) == 12
    plan = plan_text(one.transform(docs(spark)), "simple")
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_kafka_option_sets():
    src = kafka_source_options("broker:9092")
    assert src == {"kafka.bootstrap.servers": "broker:9092", "subscribe": "web-pages",
                   "startingOffsets": "latest"}
    assert kafka_sink_options("broker:9092")["topic"] == "classified-pages"


def test_bucketed_pages_classify_without_shuffle(spark):
    from adlens.session import scratch_dir
    from adlens.sources.pages import save_bucketed
    table = save_bucketed(docs(spark), "doc_id", 4, scratch_dir(spark, "t-bucketed"), "t_pages_bucketed")
    cats = spark.createDataFrame([("a", 0, "w1"), ("b", 1, "w40")], "category string, ord int, keyword string")
    res = classify(table, vocab(spark), cats)
    plan = plan_text(res, "simple")
    assert "Exchange hashpartitioning" not in plan and "BroadcastExchange" in plan
    plain = {r["doc_id"]: r["category"] for r in classify(docs(spark), vocab(spark), cats).collect()}
    assert {r["doc_id"]: r["category"] for r in res.collect()} == plain


def test_hot_category_results_and_partial_aggregation(spark):
    from collections import Counter
    from adlens.operators import analytics
    rows = [(i, "hot" if i % 3 == 0 else f"c{i % 7}", [f"k{i % 5}", f"k{(i * 3) % 11}"]) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, category string, keywords array<string>")
    got = {r["category"]: r["count"] for r in analytics.pages_per_category(df).collect()}
    want = Counter(c for _, c, _ in rows)
    assert got == dict(sorted(want.items(), key=lambda kv: (-kv[1], kv[0]))[:10])
    assert "partial_count" in plan_text(analytics.pages_per_category(df), "simple")
    top = {r["category"]: r["keywords"] for r in analytics.top_keywords_per_category(df, k=3).collect()}
    per = Counter((c, k) for _, c, ks in rows for k in set(ks))
    for cat, kws in top.items():
        ranked = sorted(((-n, k) for (c, k), n in per.items() if c == cat))[:3]
        assert kws == [k for _, k in ranked]


def test_lexicon_join_path_with_a_repeated_key(spark):
    lex = spark.createDataFrame([("art", "DT")], "token string, tag string")
    rows = [(1, "bank bank art hotel")] * 50 + [(2, "art gallery")]
    df = spark.createDataFrame(rows, "doc_id long, content string")
    out = extract_keywords(df, lexicon=lex)
    got = {(r["doc_id"], tuple(r["keywords"])) for r in out.collect()}
    assert got == {(1, ("bank", "hotel")), (2, ("gallery",))}
    assert out.count() == 51


def test_gap_fill_over_a_year_of_hours(spark):
    from adlens.operators import analytics
    df = spark.createDataFrame([("2023-01-01 00:30:00",), ("2024-01-01 00:10:00",)], "s string") \
        .select(F.col("s").cast("timestamp_ntz").alias("timestamp"))
    res = analytics.pages_per_period(df, "hour")
    assert res.count() == 8761
    assert res.agg(F.sum("count")).first()[0] == 2


def test_counting_lambdas_read_materialised_columns(spark):
    """Guard against Catalyst inlining the sorted array into the per-element lambdas
    (which would make counting quadratic)."""
    df = spark.createDataFrame([(1, "b a b c")], "doc_id long, content string")
    plan = plan_text(extract_keywords(df), "extended")
    optimized = plan.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert "element_at(___kw_counts_sorted" in optimized
    assert "element_at(sort_array(" not in optimized


def test_join_back_on_bucketed_pages_has_no_shuffle(spark):
    from adlens.session import scratch_dir
    from adlens.sources.pages import save_bucketed
    table = save_bucketed(docs(spark), "doc_id", 4, scratch_dir(spark, "t-bucketed2"), "t_pages_bucketed2")
    cats = spark.createDataFrame([("a", 0, "w1"), ("b", 1, "w40")], "category string, ord int, keyword string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        labelled = classify(table, vocab(spark), cats)
        joined = table.select("doc_id", "content").join(labelled, "doc_id")
        plan = plan_text(joined, "simple")
        assert "SortMergeJoin" in plan and "Exchange hashpartitioning" not in plan
        assert joined.count() == 200
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
