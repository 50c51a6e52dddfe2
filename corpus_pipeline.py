"""A training-data pipeline over ``documents``: five stages, each one operator.

Every stage takes what the one before kept, written as Parquet and read again; all but the
last return the columns of ``documents``.

Texts cross to Python in batches of at most ``BATCH_BYTES``: an executor holds a batch once in the JVM
and some times in each Python worker, and keeps that memory through all stages.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlens.llm import langid, mixing, packing, simhash, spans
from adlens.llm.queries import vocabulary
from adlens.llm.tables import crc_mod, materialize, table


BATCH_BYTES = 4 * 1024 * 1024


def _small_batches(stage):
    """Runs ``stage`` with the session's batches bounded; they stay so, since its frame runs later."""
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)
    return run


@_small_batches
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which language ID finds a language; ``und`` goes."""
    return langid.keep_known(docs, langid.train(docs.where(crc_mod("doc_id", 5) != 0)))


@_small_batches
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash class."""
    return simhash.keep_first(docs)


@_small_batches
def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated spans; a document of which nothing is left goes."""
    cut = spans.dedup(docs)
    pieces, gone = (F.col(c) for c in cut.columns[-2:])
    return cut.where(gone.isNull() | (gone < pieces) | (pieces == 0)).select(docs.columns)


@_small_batches
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


@_small_batches
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in training sequences."""
    return packing.pack(docs, vocabulary())


STAGES = [
    ("language_id", language),
    ("simhash_near_dedup", near_duplicates),
    ("substring_dedup", repeated_spans),
    ("source_mix", source_mix),
    ("packing", pack),
]

# Fingerprints, expectation maximisation and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
