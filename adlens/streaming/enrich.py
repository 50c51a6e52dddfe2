"""Stateless page stream (ST1-ST3, PR1-PR4, U1).

source ``value`` -> cast to string -> ``from_json`` with a fixed schema -> flatten ->
user transform -> sink.  Two transform kinds:

* ``content_fn`` - a Column function applied to ``content`` (PR4), row-wise.
* ``batch_fn`` - a DataFrame function that needs joins or grouping (the classifier).
  It runs per micro-batch through ``foreachBatch``, on a static frame, so the stream
  keeps no state.

Both kinds run through ``foreachBatch`` so one query feeds the result and the rejects
sink.  Each batch's output goes to ``<sink>/run=<checkpoint>/batch=<id>`` with overwrite, so a
batch replayed after a failure replaces its own output instead of duplicating it, and a
stream started anew (another checkpoint, ids from 0) replaces nobody's.

Messages whose JSON does not parse (or has no ``content``) go to a rejects sink.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from adlens.schemas import STREAM_MESSAGE_DDL
from adlens.sources import message_log


def parse_messages(raw: DataFrame, schema_ddl: str = STREAM_MESSAGE_DDL) -> DataFrame:
    """PR1-PR3/JS1: ``value`` -> string -> ``from_json`` -> flattened fields, plus ``json``."""
    return (raw.select(F.col("value").cast("string").alias("json"))
            .select("json", F.from_json("json", schema_ddl).alias("data"))
            .select("data.*", "json"))


def to_messages(df: DataFrame) -> DataFrame:
    """JS1: every row as one JSON ``value`` (what a Kafka sink needs)."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("value"))


def apply_content_fn(parsed: DataFrame, content_fn: Callable[[Column], Column]) -> DataFrame:
    """PR4/U1: replace ``content`` by ``content_fn(content)``, keep every other field."""
    return parsed.withColumn("content", content_fn(F.col("content")))


def run_name(checkpoint: str) -> str:
    """A stream's name, told apart from others' by its checkpoint."""
    return hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:32]


def _write_batch(df: DataFrame, path: str, fmt: str, checkpoint: str, batch_id: int, options: dict) -> None:
    if fmt == "kafka":
        # At-least-once, as Kafka writes are; consumers dedupe on the message.
        to_messages(df).write.format("kafka").options(**options).save()
    elif fmt == message_log.FORMAT:
        # A batch is an epoch of its producer: replayed, it leaves each message once.
        to_messages(df).write.format(fmt).mode("append").options(**{"producer": run_name(checkpoint)} | options) \
            .option("path", path).option("epoch", str(batch_id)).save()
    else:
        df.write.mode("overwrite").format(fmt).options(**options) \
            .save(f"{path.rstrip('/')}/run={run_name(checkpoint)}/batch={batch_id}")


def start(raw: DataFrame, sink_path: str, checkpoint: str, rejects_path: str,
          content_fn: Callable[[Column], Column] | None = None,
          batch_fn: Callable[[DataFrame], DataFrame] | None = None,
          schema_ddl: str = STREAM_MESSAGE_DDL, sink_format: str = "parquet",
          sink_options: dict | None = None, trigger: dict | None = None,
          query_name: str | None = None) -> StreamingQuery:
    """ST1/ST2: start the enrich stream; errors at start propagate (ST3)."""
    parsed = parse_messages(raw, schema_ddl)
    sink_options = sink_options or {}
    trigger = trigger or {"availableNow": True}

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        # Two outputs read the batch: keep it for the duration of this call only.
        batch.persist()
        try:
            good = batch.filter(F.col("content").isNotNull())
            if content_fn is not None:
                good = apply_content_fn(good, content_fn)
            out = batch_fn(good.drop("json")) if batch_fn is not None else good.drop("json")
            _write_batch(out, sink_path, sink_format, checkpoint, batch_id, sink_options)
            bad = batch.filter(F.col("content").isNull()).select("json")
            _write_batch(bad, rejects_path, "parquet", checkpoint, batch_id, {})
        finally:
            batch.unpersist()

    writer = parsed.writeStream.option("checkpointLocation", checkpoint).trigger(**trigger)
    if query_name:
        writer = writer.queryName(query_name)
    return writer.foreachBatch(per_batch).start()


def start_stateless(raw: DataFrame, sink_path: str, checkpoint: str, rejects_path: str,
                    transform: Callable[[DataFrame], DataFrame],
                    schema_ddl: str = STREAM_MESSAGE_DDL, sink_format: str = "parquet",
                    sink_options: dict | None = None, trigger: dict | None = None,
                    query_name: str | None = None) -> tuple[StreamingQuery, StreamingQuery]:
    """ST1 for row-local transforms (keyword extraction, a content function): a plain
    streaming projection into a file sink (exactly-once through the sink's commit log), a message
    log (likewise, by epochs) or Kafka (``sink_options``); in these each row is one JSON message.  Messages without ``content`` go to
    ``rejects_path`` by a query of their own.  Returns both queries."""
    trigger = trigger or {"availableNow": True}
    parsed = parse_messages(raw, schema_ddl)
    out = transform(parsed.filter(F.col("content").isNotNull()).drop("json"))
    as_messages = sink_format in ("kafka", message_log.FORMAT)
    writer = (to_messages(out) if as_messages else out).writeStream.format(sink_format)
    if sink_format != "kafka":
        writer = writer.option("path", sink_path)
    if sink_format == message_log.FORMAT:
        writer = writer.option("producer", run_name(checkpoint))
    writer = writer.options(**(sink_options or {})).option("checkpointLocation", f"{checkpoint.rstrip('/')}/results") \
        .outputMode("append").trigger(**trigger)
    if query_name:
        writer = writer.queryName(query_name)
    bad = parsed.filter(F.col("content").isNull()).select("json").writeStream.format("parquet") \
        .option("path", rejects_path).option("checkpointLocation", f"{checkpoint.rstrip('/')}/rejects") \
        .outputMode("append").trigger(**trigger)
    return writer.start(), bad.start()


def stop(query: StreamingQuery | None) -> None:
    """IO3: stop a running stream (no-op for None)."""
    if query is not None:
        query.stop()
