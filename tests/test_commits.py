"""Committed writes, typed ingestion and rejects."""

import datetime
import json

import pytest

from adlens.session import scratch_dir
from adlens.sources import collection, commits, paths


def frame(spark, rows):
    return spark.createDataFrame(rows, "url string, category string")


def urls(spark, path):
    return sorted(r["url"] for r in collection.read(spark, path).collect())


def test_the_same_write_twice_leaves_its_rows_once(spark):
    path = scratch_dir(spark, "t-once")
    first = frame(spark, [("u1", "a"), ("u2", "b")])
    assert collection.save(first, path, write_id="w1").first()["rows"] == 2
    assert collection.save(first, path, write_id="w1").first()["rows"] == 2
    assert collection.save(frame(spark, [("other", "a")] * 5), path, write_id="w1").first()["rows"] == 2
    assert urls(spark, path) == ["u1", "u2"]
    collection.save(first, path)  # without an id every save is a write of its own
    assert urls(spark, path) == ["u1", "u1", "u2", "u2"]


def test_half_a_write_is_never_read_and_a_retry_replaces_it(spark):
    path = scratch_dir(spark, "t-half")
    collection.save(frame(spark, [("u0", "a")]), path, write_id="w0")

    def dies(folder):
        frame(spark, [("half", "a")]).write.partitionBy("category").parquet(folder)
        raise RuntimeError("executor lost")
    with pytest.raises(RuntimeError):
        commits.write_once(spark, path, "w1", dies)
    assert urls(spark, path) == ["u0"] and len(paths.names(spark, path)) == 3
    collection.save(frame(spark, [("u1", "a")]), path, write_id="w1")
    assert urls(spark, path) == ["u0", "u1"]
    assert len([n for n in paths.names(spark, path) if n.startswith("write=w1.")]) == 1


def test_a_reader_keeps_what_was_committed_when_it_was_planned(spark):
    path = scratch_dir(spark, "t-snapshot")
    collection.save(frame(spark, [("u0", "a")]), path)
    before = collection.read(spark, path)
    collection.save(frame(spark, [("u1", "a")]), path)
    collection.compact(spark, path)
    assert [r["url"] for r in before.collect()] == ["u0"]
    assert urls(spark, path) == ["u0", "u1"] and len(commits.current(spark, path)) == 1
    collection.save(frame(spark, [("u2", "")]), path, write_id="late")
    assert urls(spark, path) == ["u0", "u1", "u2"]


def test_empty_collections_and_empty_writes(spark):
    path = scratch_dir(spark, "t-empty")
    assert collection.initialize(spark, path) and collection.read(spark, path).count() == 0
    assert collection.read(spark, path).columns == collection.collection_schema().fieldNames()
    assert collection.save(frame(spark, []), path).first()["rows"] == 0
    assert collection.read(spark, path).count() == 0 and collection.rejects(spark, path).count() == 0


@pytest.mark.parametrize("bad", ["", "a/b", "../x", "a.b", "a b"])
def test_a_write_id_is_a_plain_name(spark, bad):
    with pytest.raises(ValueError):
        commits.write_once(spark, "/nowhere", bad, lambda folder: {})


def utc(*parts):
    return datetime.datetime(*parts)


def stamps(spark, path):
    rows = collection.read(spark, path).selectExpr("url", "unix_millis(timestamp) t").collect()
    return {r["url"]: r["t"] for r in rows}


def test_whole_numbers_are_milliseconds(spark):
    for kind, value in (("long", 1704067200000), ("int", 86_400_000)):
        path = scratch_dir(spark, "t-millis")
        df = spark.createDataFrame([("x", "a", value), ("none", "a", None)], f"content string, category string, timestamp {kind}")
        collection.append_classified(df, path, timestamp="timestamp")
        rows = collection.read(spark, path).selectExpr("content", "unix_millis(timestamp) t").collect()
        assert {r["content"]: r["t"] for r in rows} == {"x": value, "none": None}


def test_values_that_cannot_be_read_are_rejected(spark):
    path = scratch_dir(spark, "t-rejects")
    far = spark.createDataFrame([("ok", 0), ("far", 1 << 62), ("early", -(1 << 62))], "url string, timestamp long")
    assert collection.save(far, path, write_id="w").first()["rows"] == 1
    assert collection.save(far, path, write_id="w").first()["rows"] == 1
    text = spark.createDataFrame([("t1", "2024-01-01T00:00:00Z"), ("t2", "2024-01-01 01:00:00"), ("t3", "soon"), ("t4", None)],
                                 "url string, timestamp string")
    collection.save(text, path)
    collection.save(spark.createDataFrame([("d1", datetime.date(2024, 1, 2))], "url string, timestamp date"), path)
    collection.save(spark.createDataFrame([("f1", 1.5)], "url string, timestamp double"), path)
    assert stamps(spark, path) == {"ok": 0, "t1": 1704067200000, "t2": 1704070800000, "t4": None, "d1": 1704153600000}
    got = [(r["field"], json.loads(r["row"])) for r in collection.rejects(spark, path).collect()]
    assert sorted(r["url"] for _, r in got) == ["early", "f1", "far", "t3"] and {f for f, _ in got} == {"timestamp"}
    assert {r["url"]: r["timestamp"] for _, r in got}["t3"] == "soon"


def test_other_fields_by_their_types(spark):
    path = scratch_dir(spark, "t-types")
    df = spark.createDataFrame([(1, {"k": "v"}, [1, 2], True)], "url int, content map<string,string>, keywords array<int>, category boolean")
    collection.save(df, path)
    r = collection.read(spark, path).first()
    assert (r["url"], r["content"], r["keywords"], r["category"]) == ("1", '{"k":"v"}', ["1", "2"], "true")
    collection.save(spark.createDataFrame([("u", "no list")], "url string, keywords string"), path)
    assert collection.rejects(spark, path).first()["field"] == "keywords"
