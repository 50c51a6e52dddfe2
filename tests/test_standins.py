from pyspark.sql import functions as F

from adlens.functions.text import is_stop_word
from adlens.operators.vectors import doc_token_counts
from adlens.plans import standins


def test_token_frequencies_are_the_sums_of_the_pages_counts(spark):
    docs = spark.createDataFrame([(1, "b B the x9, b"), (2, "b  x"), (3, ""), (4, None), (5, "... 12"), (5, "the é b")],
                                 "doc_id long, content string")
    found = standins.token_frequencies(docs)
    pages = (doc_token_counts(docs).filter(F.col("token").isNotNull() & ~is_stop_word("token"))
             .groupBy("token").agg(F.sum("tf").alias("n")))
    assert found.dtypes == pages.dtypes == [("token", "string"), ("n", "bigint")]
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in pages.collect()} == {("b", 5), ("x", 2), ("é", 1)}
    # No page is counted by itself: the key is not even read.
    assert "doc_id" not in found._jdf.queryExecution().optimizedPlan().toString().split("LogicalRDD")[0]
