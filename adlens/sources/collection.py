"""The page collection: a Parquet table partitioned by ``category`` (IO4-IO7, IO11, SO1).

Reading with an equality filter on ``category`` prunes partitions; keyword filters are
evaluated on the pruned files only.  Writes are appends, so three writers (keyworded
pages, classified documents, training documents) share one table, as in the reference
where all of them index into one collection.

* **Retries.**  Each append is a write of its own with an id (``sources/commits``): repeated under one
  id it leaves its rows once, and readers see it wholly or not at all.
* **Types.**  Fields come in as the collection has them, by the type they have (``conform``): whole
  numbers in ``timestamp`` are milliseconds since 1970, strings are parsed.  A row with a value that
  cannot be read as its field goes to the rejects of its write (``rejects``), not to the collection.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adlens.schemas import COLLECTION
from adlens.session import materialize
from adlens.sources import commits
from adlens.sources.paths import exists, make_dir


# Stands for the empty category in partition names, which cannot hold one (it reads back as NULL).
EMPTY_CATEGORY = "__empty__"


# Milliseconds of the first and last moment that a timestamp can be (years 1 to 9999).
FIRST_MILLIS, LAST_MILLIS = -62_135_596_800_000, 253_402_300_799_999


def initialize(spark: SparkSession, path: str) -> bool:
    """IO7/FI10: create an empty collection if ``path`` is absent.  Returns True when it was created."""
    if exists(spark, path):
        return False
    make_dir(spark, f"{path.rstrip('/')}/{commits.MARKERS}")
    return True


def collection_schema(*extra: T.StructField) -> T.StructType:
    """The fixed collection schema plus extra fields (a key, for instance), partition column last."""
    base = [f for f in COLLECTION.fields if f.name != "category"]
    return T.StructType(base + list(extra) + [COLLECTION["category"]])


def _typed(c: Column, have: T.DataType, want: T.DataType) -> tuple[Column, bool]:
    """``c`` of type ``have`` as ``want``, null where it cannot be read so; and whether that can happen."""
    if have == want or isinstance(have, T.NullType):
        return c.cast(want), False
    if isinstance(want, T.TimestampType):
        if isinstance(have, T.IntegralType):
            millis = c.cast("long")
            return F.when(millis.between(FIRST_MILLIS, LAST_MILLIS), F.timestamp_millis(millis)), True
        if isinstance(have, T.StringType):
            return F.try_to_timestamp(c), True
        if isinstance(have, (T.DateType, T.TimestampNTZType)):
            return c.cast(want), False
        return F.lit(None).cast(want), True  # fractions, booleans, bytes: no unit to read them by
    if isinstance(want, T.ArrayType):
        if isinstance(have, T.ArrayType) and not isinstance(have.elementType, (T.ArrayType, T.StructType, T.MapType)):
            return c.cast(want), False
        return F.lit(None).cast(want), True
    if isinstance(have, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(c), False
    return c.cast(want), False


def conform(df: DataFrame) -> DataFrame:
    """SO1: bring any of the three document shapes to the collection schema, by the types they have
    (missing -> NULL; what cannot be read as its field -> NULL, and ``_bad`` names the field).
    Extra columns (a key, for instance) are kept after the fixed ones; ``_bad`` is there only if
    some field's type makes it possible."""
    cols, bad = [], []
    for f in COLLECTION.fields:
        if f.name not in df.columns:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        value, unsure = _typed(F.col(f.name), df.schema[f.name].dataType, f.dataType)
        cols.append(value.alias(f.name))
        if unsure:
            bad.append(F.when(F.col(f.name).isNotNull() & value.isNull(), F.lit(f.name)))
    extra = [c for c in df.columns if c not in COLLECTION.fieldNames()]
    if not bad:
        return df.select(*cols, *extra)
    # Only a rejected row is kept as JSON: beside all others it would double what is written.
    row = F.when(F.coalesce(*bad).isNotNull(), F.to_json(F.struct(*df.columns)))
    return df.select(*cols, *extra, F.coalesce(*bad).alias("_bad"), row.alias("_row"))


def _observed_rows(obs: Observation, spark: SparkSession, folder: str) -> int:
    """The observed row count; an empty plan is optimised away with its observation, then the files tell."""
    try:
        return int(obs.get["rows"])
    except Py4JJavaError:
        return spark.read.schema("`_` string").parquet(folder).count()


def save(df: DataFrame, path: str, observe_name: str | None = None, write_id: str | None = None) -> DataFrame:
    """IO4/IO11: append ``df`` to the collection; returns the written row count (``rows``).

    With a ``write_id`` a repeated save (a job that is run again) is the same write: its rows are there
    once, and the count is that of the first.  The count comes from the write itself (``observe``), so
    the plan is not run a second time to count."""
    spark = df.sparkSession

    def write(folder: str) -> dict:
        rows, rejected = conform(df), 0
        if "_bad" in rows.columns:  # both outputs read what was computed once
            both = materialize(rows, "typed")
            rejected = _write_rejects(both.where("_bad IS NOT NULL"), path, write_id)
            rows = both.where("_bad IS NULL").drop("_bad", "_row")
        # Rebalance on the partition column: each output task writes few categories (no
        # tasks x categories small files) and adaptive execution splits a hot category
        # into several tasks by size.
        named = rows.withColumn(
            "category", F.when(F.col("category") == "", F.lit(EMPTY_CATEGORY)).otherwise(F.col("category")))
        obs = Observation(observe_name or "saved")
        (named.observe(obs, F.count(F.lit(1)).alias("rows"))
         .hint("rebalance", "category")
         .write.mode("overwrite").partitionBy("category").parquet(folder))
        return {"rows": _observed_rows(obs, spark, folder), "rejected": rejected}

    write_id = write_id or commits.new_id()
    report = commits.write_once(spark, path, write_id, write)
    return spark.createDataFrame([(report["rows"],)], "rows bigint")


def _write_rejects(bad: DataFrame, path: str, write_id: str) -> int:
    def write(folder: str) -> dict:
        obs = Observation("rejected")
        (bad.select(F.col("_bad").alias("field"), F.col("_row").alias("row"))
         .observe(obs, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(folder))
        return {"rows": _observed_rows(obs, bad.sparkSession, folder)}
    return commits.write_once(bad.sparkSession, f"{path.rstrip('/')}/_rejects", write_id, write)["rows"]


def rejects(spark: SparkSession, path: str) -> DataFrame:
    """``(field, row)``: rows that did not go into the collection, as JSON, and the first field that could
    not be read."""
    return _read_writes(spark, f"{path.rstrip('/')}/_rejects", T.StructType.fromDDL("field string, row string"))


def append_classified(docs: DataFrame, path: str, content: str = "content", category: str = "category",
                      timestamp=None, write_id: str | None = None) -> DataFrame:
    """IO6: append classified documents ``(content, category, timestamp)``; the timestamp is the
    current time unless a column is given (a timestamp, or milliseconds, or a string: see ``conform``)."""
    ts = F.current_timestamp() if timestamp is None else (F.col(timestamp) if isinstance(timestamp, str) else timestamp)
    extra = [c for c in docs.columns if c not in (content, category, "timestamp")]
    shaped = docs.select(*extra, F.col(content).alias("content"), F.col(category).alias("category"), ts.alias("timestamp"))
    return save(shaped, path, "classified", write_id)


def _read_writes(spark: SparkSession, path: str, schema: T.StructType, writes: list[str] | None = None) -> DataFrame:
    folders = sorted(f for i, f in commits.current(spark, path).items() if writes is None or i in writes)
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(*folders).select(*schema.fieldNames())


def read(spark: SparkSession, path: str, category: str | None = None,
         schema: T.StructType | None = None, writes: list[str] | None = None) -> DataFrame:
    """IO5: the committed rows of the collection (of some writes only, if their ids are given),
    optionally restricted to one category (partition pruning).

    The scan is planned from ``schema`` (default: the fixed fields; see
    ``collection_schema`` for extra ones), so no footer is read and a category such as
    ``007`` stays a string.
    """
    df = _read_writes(spark, path, schema or collection_schema(), writes)
    if category is not None:
        df = df.filter(F.col("category") == F.lit(category or EMPTY_CATEGORY))
    return df.withColumn(
        "category", F.when(F.col("category") == EMPTY_CATEGORY, F.lit("")).otherwise(F.col("category")))


def compact(spark: SparkSession, path: str, schema: T.StructType | None = None) -> None:
    """Rewrite all committed writes as one, which replaces them; a reader of before keeps its files."""
    old = commits.current(spark, path)
    if len(old) < 2:
        return
    rows = _read_writes(spark, path, schema or collection_schema())

    def write(folder: str) -> dict:
        obs = Observation("compacted")
        (rows.observe(obs, F.count(F.lit(1)).alias("rows")).hint("rebalance", "category")
         .write.mode("overwrite").partitionBy("category").parquet(folder))
        return {"rows": _observed_rows(obs, spark, folder), "rejected": 0}
    commits.write_once(spark, path, f"compact-{commits.new_id()}", write, replaces=old)
