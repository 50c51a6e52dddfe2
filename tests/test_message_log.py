"""The message topic as a source and a sink of streams."""

import json

import pytest
from pyspark.sql import functions as F

from adlens.operators.keywords import extract_keywords
from adlens.session import scratch_dir
from adlens.sources import message_log, paths
from adlens.sources.stream import message_log_options, read_stream
from adlens.streaming import enrich


def publish(spark, topic, texts, **options):
    message_log.register(spark)
    df = spark.createDataFrame([(json.dumps({"url": u, "content": c}),) for u, c in texts], "value string")
    df.repartition(2).write.format("message_log").mode("append").options(path=topic, **options).save()


def messages(spark, topic):
    message_log.register(spark)
    return sorted(r["v"] for r in spark.read.format("message_log").option("path", topic).load().selectExpr("CAST(value AS STRING) v").collect())


def urls(spark, topic):
    return sorted(json.loads(m)["url"] for m in messages(spark, topic))


def run(spark, topic, sink, ckpt, rejects, **options):
    raw = read_stream(spark, "message_log", message_log_options(topic, **options))
    enrich.start(raw, sink, ckpt, rejects, content_fn=F.upper).awaitTermination()
    return sorted(r["url"] for r in spark.read.schema("url string").parquet(sink).collect()) if paths.exists(spark, sink) else []


def test_starts_at_the_latest_and_resumes_after_a_stop(spark):
    topic, sink, ckpt, rej = (scratch_dir(spark, n) for n in ("m-topic", "m-out", "m-ckpt", "m-rej"))
    publish(spark, topic, [("old1", "a"), ("old2", "b")])
    assert run(spark, topic, sink, ckpt, rej, group="g") == []  # nothing yet, but the place is kept
    publish(spark, topic, [("new1", "a"), ("new2", "b"), ("new3", "c")])
    assert run(spark, topic, sink, ckpt, rej, group="g") == ["new1", "new2", "new3"]
    assert run(spark, topic, sink, ckpt, rej, group="g") == ["new1", "new2", "new3"]
    publish(spark, topic, [("late", "a")])
    publish(spark, topic, [])
    assert run(spark, topic, sink, ckpt, rej, group="g") == ["late", "new1", "new2", "new3"]


def test_earliest_reads_all_and_a_running_query_sees_new_messages(spark):
    topic, sink, ckpt, rej = (scratch_dir(spark, n) for n in ("e-topic", "e-out", "e-ckpt", "e-rej"))
    publish(spark, topic, [("a", "x")])
    raw = read_stream(spark, "message_log", message_log_options(topic, "earliest"))
    q = enrich.start(raw, sink, ckpt, rej, content_fn=F.upper, trigger={"processingTime": "100 milliseconds"})
    q.processAllAvailable()
    publish(spark, topic, [("b", "x")])
    publish(spark, topic, [("c", "x")])
    q.processAllAvailable()
    enrich.stop(q)
    assert sorted(r["url"] for r in spark.read.parquet(sink).collect()) == ["a", "b", "c"]


def replay_last_batch(spark, ckpt):
    """What a failure after the sink's commit and before the checkpoint's leaves behind."""
    last = max(int(n) for n in paths.names(spark, f"{ckpt}/commits") if n.isdigit())
    paths.delete(spark, f"{ckpt}/commits/{last}")


def test_a_replayed_batch_leaves_each_message_once(spark):
    topic, results, ckpt, rej = (scratch_dir(spark, n) for n in ("r-topic", "r-results", "r-ckpt", "r-rej"))
    publish(spark, topic, [("u1", "bank bank"), ("u2", "hotel"), (None, None)])

    def go():
        raw = read_stream(spark, "message_log", message_log_options(topic, "earliest"))
        for q in enrich.start_stateless(raw, results, ckpt, rej, lambda d: extract_keywords(d, "url"), sink_format="message_log"):
            q.awaitTermination()
    go()
    assert [json.loads(m)["keywords"] for m in messages(spark, results)] == [["bank"], ["hotel"]]
    replay_last_batch(spark, f"{ckpt}/results")
    go()
    assert urls(spark, results) == ["u1", "u2"]
    publish(spark, topic, [("u3", "sun")])
    go()
    assert urls(spark, results) == ["u1", "u2", "u3"]


def test_a_batch_function_that_fails_after_its_write_is_replayed_once(spark):
    topic, results, ckpt, rej = (scratch_dir(spark, n) for n in ("f-topic", "f-results", "f-ckpt", "f-rej"))
    publish(spark, topic, [("u1", "a"), ("u2", "b")])
    calls = []

    def fails_once(batch):
        calls.append(1)
        return batch

    def go(rejects):
        raw = read_stream(spark, "message_log", message_log_options(topic, "earliest"))
        enrich.start(raw, results, ckpt, rejects, batch_fn=fails_once, sink_format="message_log").awaitTermination()
    with pytest.raises(Exception, match="(?i)mkdirs|directory|exists|create"):
        go("/proc/nowhere")  # the rejects can't be written, after the results were
    assert urls(spark, results) == ["u1", "u2"]
    go(rej)
    assert urls(spark, results) == ["u1", "u2"] and len(calls) == 2


def test_a_failed_attempt_is_never_read(spark):
    topic = scratch_dir(spark, "x-topic")
    publish(spark, topic, [("u1", "a")], producer="p", epoch="0")
    log = message_log._Topic(topic)
    import pyarrow as pa
    log.write_segment("p", iter([pa.record_batch({"value": pa.array([b"half"])})]))  # no manifest names it
    assert urls(spark, topic) == ["u1"]
    publish(spark, topic, [("other", "a")], producer="p", epoch="0")  # the epoch is there
    publish(spark, topic, [("u2", "a")], producer="p", epoch="1")
    assert urls(spark, topic) == ["u1", "u2"]

    bad = spark.createDataFrame([(1,), (0,)], "n int").selectExpr("CAST(1 DIV n AS STRING) value")
    with pytest.raises(Exception):
        bad.write.format("message_log").mode("append").option("path", topic).save()
    assert urls(spark, topic) == ["u1", "u2"]


def test_values_of_any_bytes_and_an_empty_topic(spark):
    topic = scratch_dir(spark, "b-topic")
    assert messages(spark, topic) == []
    rows = [(b"line\nbreak",), (b"\x00\xff",), (b"",), (None,)]
    spark.createDataFrame(rows, "value binary").write.format("message_log").mode("append").option("path", topic).save()
    got = [None if r["value"] is None else bytes(r["value"]) for r in spark.read.format("message_log").option("path", topic).load().collect()]
    assert sorted(map(str, got)) == sorted(str(v) for v, in rows)


def test_options_that_make_no_sense(spark):
    topic = scratch_dir(spark, "o-topic")
    message_log.register(spark)
    df = spark.createDataFrame([("a",)], "value string")
    with pytest.raises(Exception, match="only appended"):
        df.write.format("message_log").mode("overwrite").option("path", topic).save()
    with pytest.raises(Exception, match="column value"):
        df.selectExpr("value v").write.format("message_log").mode("append").option("path", topic).save()
    with pytest.raises(Exception, match="producer"):
        df.write.format("message_log").mode("append").options(path=topic, producer="../x").save()
    with pytest.raises(Exception, match="latest or earliest"):
        run(spark, topic, *(scratch_dir(spark, n) for n in ("o1", "o2", "o3")), starting_offsets="soon")


def test_long_messages_are_read_in_small_batches(tmp_path):
    import pyarrow as pa
    from adlens.sources import message_log as M
    topic = M._Topic(str(tmp_path))
    values = [b"x" * (1 << 20)] * 40
    name = topic.write_segment("p", iter([pa.record_batch({"value": values})]))
    read = list(topic.read_segment(M.Segment("p", 0, name)))
    assert max(b.nbytes for b in read) < 3 * M._BATCH_BYTES
    assert [v for b in read for v in b.column(0).to_pylist()] == values
