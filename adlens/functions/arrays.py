"""Array column expressions: token counting without a shuffle, ranked top-k, overlap.

An outer array *expression* referenced inside a lambda would be re-evaluated for every
element, which turns linear work quadratic; the multi-step counting below therefore
materialises each array as its own column and lambdas reference only those columns.
Keep each such column referenced at least twice by the projection that consumes it:
a column used only once is inlined there by Catalyst's project collapsing, lambda or
not (a once-referenced threshold column made a top-k variant 20x slower).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTS_TYPE = "array<struct<token:string,n:bigint>>"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def with_token_counts(df: DataFrame, tokens, out: str) -> DataFrame:
    """Add ``out``: equal tokens of one row's array counted, ``array<struct<token, n>>``.

    Sort (n log n), keep the 1-based positions where a run of equal tokens ends, and
    take differences of consecutive end positions.  Each row is handled on its own:
    counting the words of a page needs no shuffle, whatever the table size.  The sorted
    array and the end positions are columns of their own, so the lambdas below read
    them by reference (O(1) per element) instead of recomputing them.
    """
    s, e = f"__{out}_sorted", f"__{out}_ends"
    # sort_array compares natively; array_sort would call a comparator lambda per comparison.
    df = df.withColumn(s, F.sort_array(_col(tokens)))
    n = F.size(s)
    ends = F.filter(F.sequence(F.lit(1), n),
                    lambda i: (i == n) | (F.element_at(F.col(s), i) != F.try_element_at(F.col(s), i + 1)))
    df = df.withColumn(e, F.when(n > 0, ends).otherwise(F.array().cast("array<int>")))
    counts = F.transform(F.col(e), lambda x, j: F.struct(
        F.element_at(F.col(s), x).alias("token"),
        (x - F.when(j == 0, F.lit(0)).otherwise(F.element_at(F.col(e), j))).cast("bigint").alias("n")))
    return df.withColumn(out, counts.cast(COUNTS_TYPE)).drop(s, e)


def top_tokens(counts, k: int) -> Column:
    """The ``k`` most frequent tokens of a counts array: count desc, token asc."""
    ranked = F.sort_array(F.transform(
        _col(counts), lambda r: F.struct((-r["n"]).alias("neg_n"), r["token"].alias("token"))))
    return F.transform(F.slice(ranked, 1, k), lambda r: r["token"])


def any_of(array_col, values) -> Column:
    """AR1: True when the array holds any of ``values``; never NULL (NULL array -> False)."""
    wanted = F.array(*[F.lit(v) for v in values]).cast("array<string>")
    # arrays_overlap is NULL (not False) when there is no match and a NULL element.
    return F.coalesce(F.arrays_overlap(_col(array_col), wanted), F.lit(False))
