import json
import os

from pyspark.sql import functions as F

from adlens.operators.classify import CategoryModel
from adlens.session import scratch_dir
from adlens.sources.stream import read_stream
from adlens.streaming import enrich


def write_messages(path, name, lines):
    path = path.replace("file:", "", 1)
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w") as f:
        f.write("\n".join(lines) + "\n")


def test_content_fn_stream_and_rejects(spark):
    src, sink, rej, ck = (scratch_dir(spark, n) for n in ("s-src", "s-out", "s-rej", "s-ck"))
    write_messages(src, "a.json", [
        json.dumps({"url": "u1", "content": "Hello", "timestamp": "2024-01-01T00:00:00Z"}),
        "nope",
        json.dumps({"url": "u2"}),
    ])
    raw = read_stream(spark, "text", path=src)
    q = enrich.start(raw, sink, ck, rej, content_fn=F.upper)
    q.awaitTermination()
    out = spark.read.parquet(sink).collect()
    assert [(r["url"], r["content"]) for r in out] == [("u1", "HELLO")]
    assert sorted(r["json"] for r in spark.read.parquet(rej).collect()) == sorted(['nope', '{"url": "u2"}'])


def test_classify_stream_equals_batch_and_restart_is_idempotent(spark):
    vocab = spark.createDataFrame([("bank", [1.0, 0.1]), ("money", [0.9, 0.0]), ("hotel", [0.0, 1.0])],
                                  "token string, vector array<float>")
    model = CategoryModel(vocab)
    docs = [(i, t) for i, t in enumerate(["bank money", "hotel hotel", "nothing", "money hotel bank"])]
    src, sink, rej, ck = (scratch_dir(spark, n) for n in ("c-src", "c-out", "c-rej", "c-ck"))
    write_messages(src, "a.json", [json.dumps({"doc_id": i, "content": t}) for i, t in docs[:2]])
    ddl = "doc_id bigint, url string, content string, timestamp timestamp"

    def run():
        raw = read_stream(spark, "text", {"maxFilesPerTrigger": "1"}, path=src)
        q = enrich.start(raw, sink, ck, rej, batch_fn=lambda b: model.transform(b, carry=["url"]),
                         schema_ddl=ddl)
        q.awaitTermination()

    run()
    first = spark.read.parquet(sink).count()
    run()  # restart: nothing new, nothing written twice
    assert spark.read.parquet(sink).count() == first == 2
    write_messages(src, "b.json", [json.dumps({"doc_id": i, "content": t}) for i, t in docs[2:]])
    run()
    streamed = {r["doc_id"]: r["category"] for r in spark.read.parquet(sink).collect()}
    batch = {r["doc_id"]: r["category"]
             for r in model.transform(spark.createDataFrame(docs, "doc_id long, content string")).collect()}
    assert streamed == batch
    assert streamed[2] == "unknown"


def test_stateless_keyword_stream_and_pandas_content_fn(spark):
    import pandas as pd
    from adlens.operators.keywords import extract_keywords

    @F.pandas_udf("string")
    def shout(s: pd.Series) -> pd.Series:
        return s.str.upper() + " bank"

    src, sink, rej, ck = (scratch_dir(spark, n) for n in ("k-src", "k-out", "k-rej", "k-ck"))
    write_messages(src, "a.json", [json.dumps({"url": "u1", "content": "Bank bank art"}), "nope"])
    raw = read_stream(spark, "text", path=src)
    for q in enrich.start_stateless(raw, sink, ck, rej, lambda d: extract_keywords(
            enrich.apply_content_fn(d, shout), "url")):
        q.awaitTermination()
    assert [r["json"] for r in spark.read.parquet(rej).collect()] == ["nope"]
    rows = spark.read.parquet(sink).collect()
    assert [(r["url"], r["content"], r["keywords"]) for r in rows] == [("u1", "BANK BANK ART bank", ["bank", "art"])]


def test_two_messages_of_one_url_and_a_new_checkpoint(spark):
    vocab = spark.createDataFrame([("bank", [1.0, 0.1]), ("hotel", [0.0, 1.0])], "token string, vector array<float>")
    model = CategoryModel(vocab)
    src, sink, rej = (scratch_dir(spark, n) for n in ("u-src", "u-out", "u-rej"))
    write_messages(src, "a.json", [json.dumps({"url": u, "content": c, "timestamp": t}) for u, c, t in [
        ("u1", "bank", "2024-01-01T00:00:00Z"), ("u1", "hotel", "2024-01-02T00:00:00Z"), (None, "bank", None),
        (None, "bank", None)]])
    for ck in (scratch_dir(spark, "u-ck1"), scratch_dir(spark, "u-ck2")):
        q = enrich.start(read_stream(spark, "text", path=src), sink, ck, rej,
                         batch_fn=lambda b: model.transform(b, key="url", carry=["timestamp"]))
        q.awaitTermination()
    # Both runs' outputs stand, each with every message.
    assert spark.read.parquet(sink).count() == 8


def test_stop(spark):
    src, sink, rej, ck = (scratch_dir(spark, n) for n in ("x-src", "x-out", "x-rej", "x-ck"))
    write_messages(src, "a.json", [json.dumps({"url": "u", "content": "c"})])
    q = enrich.start(read_stream(spark, "text", path=src), sink, ck, rej, trigger={"processingTime": "1 hour"})
    enrich.stop(q)
    enrich.stop(None)
    assert not q.isActive


def test_kafka_messages(spark):
    df = spark.createDataFrame([("u", 1)], "url string, n int")
    assert [r["value"] for r in enrich.to_messages(df).collect()] == ['{"url":"u","n":1}']
