"""Connected components of a link table by alternating large and small stars.

Every round is two joins and two aggregates; each round's links are written to the shared
checkpoint folder, so no lineage grows and a lost executor costs one stage.  Nothing is
gathered on the driver but a row count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlens.llm.tables import materialize


def _state(links: DataFrame):
    return tuple(links.agg(F.count("*"), F.expr("bit_xor(xxhash64(hi, lo))")).first())


def components(links: DataFrame) -> DataFrame:
    """``links(a long, b long)`` -> ``(node, root)``: one row per node that has a link to
    another one; ``root`` is the smallest node it can reach.  Self links and repeated
    links are allowed; an empty table gives an empty result."""
    first = links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    current = materialize(first.where("hi <> lo").distinct(), "links")
    before = _state(current)
    while before[0]:
        both = current.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            current.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("low")) \
            .select("u", F.least("low", "u").alias("low"))
        # Large star: larger neighbours of u are linked to the smallest node around u.
        large = materialize(both.where("v > u").join(least, "u")
                            .select(F.col("v").alias("hi"), F.col("low").alias("lo")).distinct(), "large-star")
        # Small star: u and its smaller neighbours are linked to the smallest of them.
        least = large.groupBy("hi").agg(F.min("lo").alias("low"))
        small = large.join(least, "hi").where("lo <> low") \
            .select(F.col("lo").alias("hi"), F.col("low").alias("lo")) \
            .unionByName(least.select("hi", F.col("low").alias("lo")))
        current = materialize(small.distinct(), "links")
        after = _state(current)
        if after == before:
            break
        before = after
    leaves = current.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return leaves.unionByName(leaves.select(F.col("root").alias("node"), "root").distinct())
