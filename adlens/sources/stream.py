"""Stream source and sink (IO1-IO3, IO13).

The reference reads page messages from a Kafka topic and writes results to another.
Format and options are arguments so the same query runs on Kafka in production and on
a shared folder (``message_log``: see there; or the file source ``text``, one JSON message
per line, also a ``value`` column).  The Kafka connector is not on this image's classpath; the
Kafka path is option plumbing only and is untested here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from adlens.sources import message_log

PAGE_TOPIC = "web-pages"
RESULT_TOPIC = "classified-pages"


def kafka_source_options(bootstrap: str, topic: str = PAGE_TOPIC,
                         starting_offsets: str = "latest") -> dict:
    return {"kafka.bootstrap.servers": bootstrap, "subscribe": topic,
            "startingOffsets": starting_offsets}


def kafka_sink_options(bootstrap: str, topic: str = RESULT_TOPIC) -> dict:
    return {"kafka.bootstrap.servers": bootstrap, "topic": topic}


def message_log_options(path: str, starting_offsets: str = "latest", group: str | None = None) -> dict:
    return {"path": path, "startingOffsets": starting_offsets} | ({"group": group} if group else {})


def read_stream(spark: SparkSession, fmt: str = "kafka", options: dict | None = None,
                path: str | None = None) -> DataFrame:
    """IO1: a streaming DataFrame with a ``value`` column (binary for Kafka, string for text)."""
    if fmt == message_log.FORMAT:
        message_log.register(spark)
    reader = spark.readStream.format(fmt)
    for k, v in (options or {}).items():
        reader = reader.option(k, v)
    return reader.load(path) if path else reader.load()
