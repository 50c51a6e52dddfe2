"""Groups of rows of bounded size, for work that looks something up for each of a row's many tokens.

A row's tokens joined one by one make a row for each of them, with what was found beside it, in every shuffle
that follows.  Rows dealt into groups share what they look up: the distinct tokens of a group are
joined, what is found travels once a group, and ``cogroup`` brings it to the group's rows.  What
travels is bounded by the groups' tokens, so it grows as the table does.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from adlens.session import materialize

# Weight (about bytes) of a group; a row above it is a group of its own.
GROUP_BYTES = 24 * 1024 * 1024


def dealt(rows: DataFrame, weight: str, bound: int = GROUP_BYTES) -> DataFrame:
    """``rows`` without ``weight`` and with ``_group``: consecutive rows of a task, up to ``bound`` of
    ``weight`` (a long) in all.  Written once, so that all who read it see the same groups."""
    kept = [c for c in rows.columns if c != weight]
    out = T.StructType([T.StructField("_group", T.LongType()), *rows.select(*kept).schema.fields])
    at = rows.columns.index(weight)

    def run(batches):
        task, number, held = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            group = np.empty(b.num_rows, np.int64)
            for i, w in enumerate(b.column(at).to_pylist()):
                if held and held + w > bound:
                    number, held = number + 1, 0
                held += w
                group[i] = (task << 32) + number
            yield pa.RecordBatch.from_arrays([pa.array(group), *[c for i, c in enumerate(b.columns) if i != at]], ["_group", *kept])
    return materialize(rows.mapInArrow(run, out), "groups")
