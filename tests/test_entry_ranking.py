import __spark_entry__ as E
from pyspark.sql import functions as F

from adlens.operators.ranking import global_rank


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["category", "keywords"]
    assert df.count() > 0


def test_every_query_has_an_oracle_or_is_listed():
    from adlens.plans import catalog, oracle
    assert set(catalog.QUERIES) == set(oracle.oracle_sql())
    assert set(catalog.QUERIES) <= set(E.queries()) and set(E.oracle_sql()) <= set(E.queries())


def test_global_rank_matches_sorted_order(spark):
    df = spark.range(0, 1000).selectExpr("id", "(id * 7919) % 1000 AS v")
    ranked = global_rank(df, [F.desc("v"), F.asc("id")], ranges=5)
    got = [r["id"] for r in ranked.orderBy("rank").collect()]
    want = [r["id"] for r in df.orderBy(F.desc("v"), F.asc("id")).collect()]
    assert got == want
    assert [r["rank"] for r in ranked.orderBy("rank").collect()] == list(range(1, 1001))
