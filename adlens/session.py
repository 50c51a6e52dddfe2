"""Session defaults and the shared scratch location.

Scratch output (intermediate tables, stream sinks, checkpoints) always goes under the
directory the cluster names in ``spark.checkpoint.dir`` so every executor sees it.
"""

from __future__ import annotations

import contextlib
import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job in this library is written against.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "adlens", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the library's defaults.

    ``master`` is only set when given, so a cluster submit keeps its own master.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The session's shared checkpoint directory (``spark.checkpoint.dir``, or
    ``setCheckpointDir``).  There is no machine-local fallback: executors on other
    machines could not read it."""
    root = spark.sparkContext.getCheckpointDir()
    if not root:
        raise RuntimeError("intermediate tables need a shared folder: set spark.checkpoint.dir")
    return root


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh, unique (not yet created) path under the shared checkpoint root."""
    root = checkpoint_root(spark)
    return root.rstrip("/") + f"/adlens-{name}-{uuid.uuid4().hex[:12]}"


def remove_scratch(spark: SparkSession) -> None:
    """Deletes the tables this application wrote under its checkpoint folder (call it last)."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(checkpoint_root(spark))
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(root):
        if status.getPath().getName().startswith("adlens-"):
            fs.delete(status.getPath(), True)


def materialize_path(df, name: str) -> str:
    """Write ``df`` once as Parquet under the shared checkpoint folder; return the path."""
    path = scratch_dir(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return path


def materialize(df, name: str):
    """Cut ``df``'s lineage by writing it once as Parquet under the shared checkpoint folder
    and reading it back (one computation; a reliable ``checkpoint()`` of an uncached
    frame computes it twice).  Survives executor loss like a checkpoint does."""
    return df.sparkSession.read.parquet(materialize_path(df, name))


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes tables that ``materialize`` made and nobody reads any more.  Shuffle files of frames that are gone go
    too: Spark deletes them once the driver's collector has met the frames, which may else be at the very end."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for df in tables for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        path.getFileSystem(conf).delete(path, True)
    gc.collect()
    jvm.System.gc()


@contextlib.contextmanager
def small_batches(spark: SparkSession, size: int):
    """Arrow batches of about ``size`` bytes at most meanwhile (for rows of megabytes)."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before)
