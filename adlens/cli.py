"""Command-line jobs (run with ``spark-submit adlens/cli.py ...`` or ``python -m adlens.cli``).

Each sub-command is one Spark job over tables on shared storage; results are written,
never collected (``search`` also prints its one-row total).

  index        pages -> keywords -> collection (partitioned by category)
  search       collection -> pages having any keyword [in a category]
  by-category  collection -> pages of one category
  report       collection -> per-category counts | top keywords | pages per hour/day
  classify     pages + word vectors [+ categories] -> (key, category)
  train        labelled corpus text -> Word2Vec model (loaded if present)
  corpus       labelled examples (label, text) -> labelled text lines
  stream       page messages -> classified messages (Kafka or a file source)
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

if __package__ in (None, ""):  # run as a file by spark-submit: make the package importable
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from adlens.operators import corpus, keywords, search, word2vec
from adlens.operators.classify import CategoryModel
from adlens.schemas import COLLECTION
from adlens.session import build_session
from adlens.sources import collection, keyword_index, rollups, text as textio
from adlens.sources.stream import kafka_sink_options, kafka_source_options, read_stream
from adlens.streaming import enrich


def _write(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.write.mode("overwrite").format(fmt).save(path)


def cmd_index(spark: SparkSession, a) -> None:
    pages = spark.read.parquet(a.pages)
    collection.initialize(spark, a.collection)
    saved_pages = keywords.pages_with_keywords(pages, key=a.key)
    saved = collection.save(saved_pages, a.collection, write_id=a.write_id)
    if a.keyword_index:
        # From the collection as it stands: an index of all committed pages, however often this job runs.
        key = [] if a.key in COLLECTION.fieldNames() else [saved_pages.schema[a.key]]
        held = collection.read(spark, a.collection, schema=collection.collection_schema(*key))
        keyword_index.build(held, a.keyword_index, a.key)
    saved.show()


def _collection(spark: SparkSession, a) -> DataFrame:
    """The collection with the key column, if it has one of its own (``--key-type``)."""
    if not a.key or a.key in COLLECTION.fieldNames():
        return collection.read(spark, a.collection)
    key = StructType.fromDDL(f"`{a.key}` {a.key_type}").fields[0]
    return collection.read(spark, a.collection, schema=collection.collection_schema(key))


def cmd_search(spark: SparkSession, a) -> None:
    words = a.keywords.split(",")
    if a.keyword_index:
        res = keyword_index.search(_collection(spark, a), a.keyword_index, a.key or "url", words, a.category)
    else:
        res = search.search(_collection(spark, a), words, a.category)
    search.total(res).show()
    _write(search.hits(res, a.key), a.output)


def cmd_by_category(spark: SparkSession, a) -> None:
    _write(search.hits(search.by_category(_collection(spark, a), a.category), a.key), a.output)


def cmd_report(spark: SparkSession, a) -> None:
    if a.kind == "per-category":
        out = rollups.pages_per_category(spark, a.collection)
    elif a.kind == "top-keywords":
        out = rollups.top_keywords_per_category(spark, a.collection)
    else:
        out = rollups.pages_per_period(spark, a.collection, a.period)
    _write(out, a.output)


def cmd_classify(spark: SparkSession, a) -> None:
    vocab = spark.read.parquet(a.vectors)
    cats = spark.read.parquet(a.categories) if a.categories else None
    model = CategoryModel(vocab, cats)
    _write(model.transform(spark.read.parquet(a.pages), key=a.key, text=a.text), a.output)


def cmd_train(spark: SparkSession, a) -> None:
    lines = textio.read_lines(spark, a.corpus)
    model = word2vec.load_or_train(spark, a.model, lambda: word2vec.sentences(lines),
                                   num_partitions=a.partitions)
    if a.vectors:
        _write(word2vec.vocabulary(model), a.vectors)


def cmd_corpus(spark: SparkSession, a) -> None:
    ex = spark.read.parquet(a.examples)
    textio.write_lines(corpus.label_lines(ex, label=a.label, text=a.text), a.output)


def cmd_stream(spark: SparkSession, a) -> None:
    model = CategoryModel(spark.read.parquet(a.vectors))
    if a.format == "kafka":
        raw = read_stream(spark, "kafka", kafka_source_options(a.bootstrap))
        sink_fmt, sink_opts = "kafka", kafka_sink_options(a.bootstrap)
    else:
        raw = read_stream(spark, a.format, path=a.source)
        sink_fmt, sink_opts = "parquet", {}
    trigger = {"availableNow": True} if a.once else {"processingTime": a.interval}
    q = enrich.start(raw, a.output, a.checkpoint, a.rejects,
                     batch_fn=lambda b: model.transform(b, key="url", carry=["timestamp"]),
                     sink_format=sink_fmt, sink_options=sink_opts, trigger=trigger)
    q.awaitTermination()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="adlens")
    sub = p.add_subparsers(dest="cmd", required=True)

    s = sub.add_parser("index")
    s.add_argument("--pages", required=True)
    s.add_argument("--collection", required=True)
    s.add_argument("--key", default="url")
    s.add_argument("--write-id", help="names this write: a job run again under it adds nothing")
    s.add_argument("--keyword-index", help="also index the keywords here, by the key")
    s.set_defaults(fn=cmd_index)

    s = sub.add_parser("search")
    s.add_argument("--collection", required=True)
    s.add_argument("--keywords", required=True, help="comma-separated")
    s.add_argument("--keyword-index", help="search through this index (needs --key)")
    s.add_argument("--category")
    s.add_argument("--key")
    s.add_argument("--key-type", default="string")
    s.add_argument("--output", required=True)
    s.set_defaults(fn=cmd_search)

    s = sub.add_parser("by-category")
    s.add_argument("--collection", required=True)
    s.add_argument("--category", required=True)
    s.add_argument("--key")
    s.add_argument("--key-type", default="string")
    s.add_argument("--output", required=True)
    s.set_defaults(fn=cmd_by_category)

    s = sub.add_parser("report")
    s.add_argument("--collection", required=True)
    s.add_argument("--kind", choices=["per-category", "top-keywords", "per-period"], required=True)
    s.add_argument("--period", default="hour")
    s.add_argument("--output", required=True)
    s.set_defaults(fn=cmd_report)

    s = sub.add_parser("classify")
    s.add_argument("--pages", required=True)
    s.add_argument("--vectors", required=True, help="(token, vector) table")
    s.add_argument("--categories", help="(category, ord, keyword) table; default built-in")
    s.add_argument("--key", default="url")
    s.add_argument("--text", default="content")
    s.add_argument("--output", required=True)
    s.set_defaults(fn=cmd_classify)

    s = sub.add_parser("train")
    s.add_argument("--corpus", required=True, help="labelled text lines")
    s.add_argument("--model", required=True)
    s.add_argument("--vectors", help="also write the (token, vector) table here")
    s.add_argument("--partitions", type=int, default=1)
    s.set_defaults(fn=cmd_train)

    s = sub.add_parser("corpus")
    s.add_argument("--examples", required=True, help="(label, text) table")
    s.add_argument("--label", default="label")
    s.add_argument("--text", default="text")
    s.add_argument("--output", required=True)
    s.set_defaults(fn=cmd_corpus)

    s = sub.add_parser("stream")
    s.add_argument("--vectors", required=True)
    s.add_argument("--format", default="kafka", help="kafka, or a file source format (text)")
    s.add_argument("--bootstrap", default="localhost:9092")
    s.add_argument("--source", help="directory for a file source")
    s.add_argument("--output", required=True, help="sink directory (file sink) or unused for kafka")
    s.add_argument("--rejects", required=True, help="directory for messages that do not parse")
    s.add_argument("--checkpoint", required=True)
    s.add_argument("--interval", default="10 seconds")
    s.add_argument("--once", action="store_true", help="process what is available, then stop")
    s.set_defaults(fn=cmd_stream)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or build_session()
    args.fn(spark, args)


if __name__ == "__main__":
    main(sys.argv[1:])
