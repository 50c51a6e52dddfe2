"""The inverted keyword index against full scans."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adlens.operators import search
from adlens.sources import collection, keyword_index
from planutil import plan_text

KEY = T.StructField("page", T.LongType())
DDL = "page long, url string, title string, content string, category string, author string, keywords array<string>"


def pages(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = [(i, f"u{i}", None, "text", rng.choice(["a", "b", "", None, "007"]), None,
             [f"k{int(rng.paretovariate(.7))}" for _ in range(rng.randrange(8))]) for i in range(n)]
    rows += [(None, "none", None, None, "a", None, ["k1", "rare"]), (None, "other", None, None, "a", None, ["k2"]),
             (7, "again", None, None, "a", None, ["rare"]), (8, "nulls", None, None, None, None, None),
             (9, "inner", None, None, "b", None, ["k3", None, "k3"]), (10, "q", None, None, "it's", None, ["it's"])]
    return spark.createDataFrame(rows, DDL)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("kwindex"))
    collection.save(pages(spark), root + "/collection")
    held = collection.read(spark, root + "/collection", schema=collection.collection_schema(KEY))
    keyword_index.build(held, root + "/index", "page")
    return held, root


WANTED = [(["rare"], None), (["k1"], None), (["k2", "k5", "k1"], ""), (["k1", "k3"], "a"), (["k1"], "007"), (["none at all"], None),
          ([], None), (["it's"], "it's"), (["k1"], "no such category")]


@pytest.mark.parametrize("pushed", [1000, 0])
@pytest.mark.parametrize("fits", [keyword_index.DEFAULT_BROADCAST_BYTES, keyword_index._POSTING_BYTES])
def test_same_rows_as_the_full_scan(spark, stored, monkeypatch, pushed, fits):
    """With keys pushed, broadcast, and joined."""
    held, root = stored
    monkeypatch.setattr(keyword_index, "PUSHED_KEYS", pushed)
    monkeypatch.setattr(keyword_index, "DEFAULT_BROADCAST_BYTES", fits)
    for words, category in WANTED:
        want = sorted(map(str, search.search(held, words, category).collect()))
        got = keyword_index.search(held, root + "/index", "page", words, category)
        assert got.columns == held.columns
        assert sorted(map(str, got.collect())) == want, (words, category)


def test_appended_pages_are_found(spark, stored, tmp_path):
    held, root = stored
    more = held.where("category = 'b'").withColumn("page", F.col("page") + 10_000)
    path, index = str(tmp_path / "c"), str(tmp_path / "i")
    collection.save(held, path)
    keyword_index.build(held, index, "page")
    collection.save(more, path)
    keyword_index.build(more, index, "page", mode="append")
    both = collection.read(spark, path, schema=collection.collection_schema(KEY))
    assert sorted(map(str, keyword_index.search(both, index, "page", ["k1", "k3"]).collect())) == \
        sorted(map(str, search.by_keywords(both, ["k1", "k3"]).collect()))


def scanned(df):
    """Rows that the scan of a shuffle-free plan gave to its filter."""
    plan = df._jdf.queryExecution().executedPlan()
    plan.execute().count()
    return plan.collectLeaves().head().metrics().apply("numOutputRows").value()


def test_a_lookup_reads_few_row_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyword_index, "ROW_GROUP_BYTES", 16 * 1024)
    many = spark.range(60_000).select(
        F.col("id").alias("page"), F.lit("c").alias("category"),
        F.array(F.concat(F.lit("word"), (F.col("id") % 5000).cast("string")), F.lit("everywhere")).alias("keywords"))
    path = str(tmp_path / "i")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        keyword_index.build(many, path, "page")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    rare = spark.read.parquet(path).filter(F.col("keyword").isin("word77"))
    assert "PushedFilters: [IsNotNull(keyword), EqualTo(keyword,word77)]" in plan_text(rare)
    assert rare.count() == 12 and scanned(rare) < 120_000 / 4
    # A keyword of half the postings is spread over several files.
    files = spark.read.parquet(path).where("keyword = 'everywhere'").select(F.input_file_name()).distinct().count()
    assert files > 1
    assert keyword_index.lookup(spark, path, ["word77", "word78"]).count() == 24


def test_found_keys_and_categories_reach_the_collections_scan(spark, stored):
    held, root = stored
    text = plan_text(keyword_index.search(held, root + "/index", "page", ["rare"]))
    scan = text[text.index("PartitionFilters"):]
    assert "category" in scan.splitlines()[0] and "page" in text[text.index("PushedFilters"):].splitlines()[0]
