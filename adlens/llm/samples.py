"""A bounded sample of labelled documents to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlens.operators.sizing import maybe_broadcast


def draw(key: str):
    """A hash of the id in 0 to 1."""
    return F.pmod(F.xxhash64("doc_id", F.lit(key)), F.lit(1 << 30)) / float(1 << 30)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, training: Column, rows: int) -> DataFrame:
    """``(doc_id, text, y)`` of about ``rows`` labelled training documents (all, if fewer),
    chosen by a hash of the id, one row an id (the least text).  Only these documents' texts are kept
    from the scan.  Rows without an id, text or label are never chosen."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).where(training) \
        .groupBy("doc_id").agg(F.max(label).alias("y"))
    share = min(1.0, rows / max(1, known.count()))
    chosen = maybe_broadcast(known.where(draw("sample") < share), row_bytes=64)
    return docs.select("doc_id", "text").where("text is not null").join(chosen, "doc_id") \
        .groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
