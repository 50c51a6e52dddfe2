"""A message topic in a shared folder, as a Spark data source (IO1, IO2, ST1, ST2).

``spark.readStream.format("message_log")`` and ``df.writeStream.format("message_log")`` (and ``read`` /
``write``) stand where the reference has a topic of its broker: messages come in at the latest
offset or the earliest, a stopped query goes on where it was, and a batch replayed after a failure leaves
each message once.

*Topic.*  Every producer (a streaming query, a batch write) numbers its epochs.  Tasks write segments
(Parquet files of ``value``); when all of an epoch's tasks are done, a manifest
``<topic>/<producer>/epochs/<number>`` that names them appears whole.  Readers follow manifests only, so
what a failed attempt left is never read.  A committed epoch is not written again: the
segments of a replay are deleted.

*Offsets.*  For each producer the number of the next epoch to read, so producers need no order among
each other.  A trigger reads an epoch's segments in parallel, a task each.

Options: ``path``; ``startingOffsets`` ``latest`` (default) or ``earliest``; ``group``, a name under
which the offset a query started at is kept, so that a query stopped before its first message
still goes on from there; ``producer`` (required to write a stream; the same for every run
of a query, another for each query) and ``epoch`` (a batch write of a numbered epoch).

Paths are those pyarrow opens from every executor: a shared mount, ``hdfs://``, ``s3://``, ``gs://``.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter,
                                    DataSourceStreamReader, InputPartition, WriterCommitMessage)

FORMAT = "message_log"
SCHEMA = "value binary, producer string, epoch long"
# About so many bytes of messages are read at once, and are a row group of a segment.
_BATCH_BYTES = 8 * 1024 * 1024
_SEGMENT = pa.schema([("value", pa.binary())])
_ROWS = pa.schema([("value", pa.binary()), ("producer", pa.string()), ("epoch", pa.int64())])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MessageLog)


class _Topic:
    """A topic's files."""

    def __init__(self, path: str):
        if re.match(r"[a-z0-9]+://", path) and not path.startswith("file:"):
            self.fs, self.root = pafs.FileSystem.from_uri(path)
        else:
            self.fs, self.root = pafs.LocalFileSystem(), re.sub(r"^file:/*", "/", path)
        self.root = self.root.rstrip("/")

    def _names(self, folder: str) -> list[str]:
        found = self.fs.get_file_info(pafs.FileSelector(f"{self.root}/{folder}".rstrip("/"), allow_not_found=True))
        return sorted(f.base_name for f in found if f.base_name[0] not in "._")

    def read_json(self, name: str):
        if self.fs.get_file_info(f"{self.root}/{name}").type == pafs.FileType.NotFound:
            return None
        with self.fs.open_input_stream(f"{self.root}/{name}") as f:
            return json.loads(f.read())

    def publish_json(self, name: str, what) -> None:
        """Written aside and renamed: there whole or not at all."""
        folder, base = f"{self.root}/{name}".rsplit("/", 1)
        aside = f"{folder}/.{uuid.uuid4().hex}"
        self.fs.create_dir(folder)
        with self.fs.open_output_stream(aside) as f:
            f.write(json.dumps(what).encode())
        self.fs.move(aside, f"{folder}/{base}")

    def epochs(self, producer: str) -> list[int]:
        return [int(n) for n in self._names(f"{producer}/epochs")]

    def end(self) -> dict[str, int]:
        """For every producer the number after its last epoch."""
        return {p: max(found) + 1 for p in self._names("") if (found := self.epochs(p))}

    def manifest(self, producer: str, epoch: int) -> str:
        return f"{producer}/epochs/{epoch:012d}"

    def segments(self, start: dict[str, int], end: dict[str, int]) -> list[Segment]:
        return [Segment(p, e, name) for p, stop in sorted(end.items()) for e in self.epochs(p) if start.get(p, 0) <= e < stop
                for name in self.read_json(self.manifest(p, e))["segments"]]

    def read_segment(self, s: Segment) -> Iterator[pa.RecordBatch]:
        with self.fs.open_input_file(f"{self.root}/{s.producer}/segments/{s.name}") as f:
            file = pq.ParquetFile(f)
            stored = [file.metadata.row_group(i) for i in range(file.metadata.num_row_groups)]
            rows = min((g.num_rows * _BATCH_BYTES // max(1, g.total_byte_size) for g in stored), default=1)
            for b in file.iter_batches(batch_size=min(max(1, rows), 1 << 16), columns=["value"]):
                n = b.num_rows
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.binary()), pa.array([s.producer] * n, pa.string()),
                                                  pa.array([s.epoch] * n, pa.int64())], schema=_ROWS)

    def write_segment(self, producer: str, batches: Iterator[pa.RecordBatch]) -> str | None:
        """A file of the batches' values; none for no message."""
        name, writer = f"{uuid.uuid4().hex}.parquet", None
        for b in batches:
            if not b.num_rows:
                continue
            if writer is None:
                self.fs.create_dir(f"{self.root}/{producer}/segments")
                writer = pq.ParquetWriter(self.fs.open_output_stream(f"{self.root}/{producer}/segments/{name}"), _SEGMENT, use_dictionary=False)
            value = b.column(b.schema.get_field_index("value")).cast(pa.binary())
            rows = max(1, b.num_rows * _BATCH_BYTES // max(1, value.nbytes))
            for at in range(0, b.num_rows, rows):
                writer.write_batch(pa.RecordBatch.from_arrays([value.slice(at, rows)], schema=_SEGMENT))
        if writer is None:
            return None
        writer.close()
        return name

    def commit(self, producer: str, epoch: int, names: list[str]) -> None:
        manifest = self.manifest(producer, epoch)
        if self.read_json(manifest) is None:
            self.publish_json(manifest, {"segments": names})
        else:  # a replay: the epoch's messages are there
            self.remove(producer, set(names) - set(self.read_json(manifest)["segments"]))

    def remove(self, producer: str, names) -> None:
        for name in names:
            self.fs.delete_file(f"{self.root}/{producer}/segments/{name}")


@dataclass
class Segment(InputPartition):
    producer: str
    epoch: int
    name: str


@dataclass
class Written(WriterCommitMessage):
    name: str | None


def _written(messages) -> list[str]:
    return [m.name for m in messages if m is not None and m.name]


class MessageLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LogReader:
        return LogReader(self.options)

    def streamReader(self, schema) -> LogStreamReader:
        return LogStreamReader(self.options)

    def writer(self, schema, overwrite: bool) -> LogWriter:
        if overwrite:
            raise ValueError("a topic is only appended to: use mode append")
        return LogWriter(self.options, schema)

    def streamWriter(self, schema, overwrite: bool) -> LogStreamWriter:
        if not self.options.get("producer"):
            raise ValueError("a stream that writes a topic needs the option producer")
        return LogStreamWriter(self.options, schema)


class LogReader(DataSourceReader):
    """All committed messages."""

    def __init__(self, options):
        self.path = options["path"]

    def partitions(self):
        topic = _Topic(self.path)
        return topic.segments({}, topic.end()) or [Segment("", 0, "")]

    def read(self, partition: Segment):
        if partition.name:
            yield from _Topic(self.path).read_segment(partition)


class LogStreamReader(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.group = options["path"], options.get("group")
        self.start_at = options.get("startingoffsets", options.get("startingOffsets", "latest"))
        if self.start_at not in ("latest", "earliest"):
            raise ValueError(f"startingOffsets is latest or earliest, not {self.start_at}")

    def initialOffset(self) -> dict:
        topic = _Topic(self.path)
        kept = topic.read_json(f"_groups/{self.group}") if self.group else None
        if kept is None:
            kept = topic.end() if self.start_at == "latest" else {}
            if self.group:
                topic.publish_json(f"_groups/{self.group}", kept)
        return kept

    def latestOffset(self) -> dict:
        return _Topic(self.path).end()

    def partitions(self, start: dict, end: dict):
        return _Topic(self.path).segments(start, end)

    def read(self, partition: Segment):
        yield from _Topic(self.path).read_segment(partition)


class _Writing:
    def __init__(self, options, schema):
        if "value" not in schema.fieldNames():
            raise ValueError("messages are written from a column value")
        self.path, self.producer = options["path"], options.get("producer") or f"batch-{uuid.uuid4().hex}"
        self.epoch = int(options.get("epoch") or 0)
        if not re.fullmatch(r"[A-Za-z0-9-][A-Za-z0-9_-]*", self.producer):
            raise ValueError(f"a producer's name is letters, digits, - and _: {self.producer!r}")

    def write(self, iterator) -> Written:
        return Written(_Topic(self.path).write_segment(self.producer, iterator))


class LogWriter(_Writing, DataSourceArrowWriter):
    def commit(self, messages) -> None:
        _Topic(self.path).commit(self.producer, self.epoch, _written(messages))

    def abort(self, messages) -> None:
        _Topic(self.path).remove(self.producer, _written(messages))


class LogStreamWriter(_Writing, DataSourceStreamArrowWriter):
    def commit(self, messages, batchId: int) -> None:
        _Topic(self.path).commit(self.producer, batchId, _written(messages))

    def abort(self, messages, batchId: int) -> None:
        _Topic(self.path).remove(self.producer, _written(messages))
