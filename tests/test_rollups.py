"""Counts kept at each write against full scans."""

import datetime
import random

import pytest

from adlens.operators import analytics
from adlens.session import scratch_dir
from adlens.sources import collection, commits, paths, rollups
from planutil import plan_text


def pages(spark, seed, n=120):
    rng = random.Random(seed)
    day = datetime.datetime(2024, 1, 1)
    rows = [(f"u{seed}-{i}", rng.choice(["a", "b", "", None, "it's"]), [f"k{rng.randrange(6)}" for _ in range(rng.randrange(4))],
             None if rng.random() < .1 else day + datetime.timedelta(minutes=rng.randrange(9000))) for i in range(n)]
    return spark.createDataFrame(rows, "url string, category string, keywords array<string>, timestamp timestamp")


def rows(df):
    return sorted(map(str, df.collect()))


def same_as_scans(spark, path):
    held = collection.read(spark, path)
    assert rows(rollups.pages_per_category(spark, path)) == rows(analytics.pages_per_category(held))
    assert rollups.pages_per_category(spark, path, 2).collect() == analytics.pages_per_category(held, 2).collect()
    for k in (1, 5):
        assert rows(rollups.top_keywords_per_category(spark, path, k)) == rows(analytics.top_keywords_per_category(held, k))
    assert rows(rollups.top_keywords_per_category(spark, path, as_rows=True)) == rows(analytics.top_keywords_per_category(held, as_rows=True))
    for period in ("hour", "DAY", None):
        assert rows(rollups.pages_per_period(spark, path, period)) == rows(analytics.pages_per_period(held, period))


def test_reports_equal_full_scans_as_the_collection_grows(spark):
    path = scratch_dir(spark, "t-rollups")
    collection.initialize(spark, path)
    assert rollups.pages_per_category(spark, path).count() == 0 and rollups.pages_per_period(spark, path).count() == 0
    rollups.save(pages(spark, 1), path, "one")
    same_as_scans(spark, path)
    rollups.save(pages(spark, 2), path, "two")
    rollups.save(pages(spark, 2), path, "two")  # again: nothing is counted twice
    same_as_scans(spark, path)
    collection.save(pages(spark, 3), path)  # by a writer that keeps no counts
    same_as_scans(spark, path)
    collection.compact(spark, path)
    same_as_scans(spark, path)
    rollups.save(pages(spark, 4, 0), path)
    rollups.save(pages(spark, 5), path)
    same_as_scans(spark, path)


def test_a_job_that_died_before_its_counts_is_caught_up(spark, monkeypatch):
    path = scratch_dir(spark, "t-died")

    def dies(df):
        raise RuntimeError("lost")
    monkeypatch.setattr(rollups, "counts", dies)
    with pytest.raises(RuntimeError):
        rollups.save(pages(spark, 1), path, "one")
    monkeypatch.undo()
    assert list(commits.current(spark, path)) == ["one"] and not commits.markers(spark, path + "/_rollups")
    same_as_scans(spark, path)


def test_a_report_reads_counts_and_no_pages(spark):
    path = scratch_dir(spark, "t-counts")
    rollups.save(pages(spark, 1), path, "one")
    for name in paths.names(spark, path):
        if name.startswith("write="):
            paths.delete(spark, f"{path}/{name}")
    assert rollups.pages_per_category(spark, path).count() == 4
    plan = plan_text(rollups.top_keywords_per_category(spark, path))
    assert "PartitionFilters: [isnotnull(kind" in plan and "content" not in plan


def test_a_span_of_many_years_is_laid_out_in_parallel(spark):
    odd = spark.createDataFrame([(datetime.datetime(1990, 1, 1),), (datetime.datetime(2024, 1, 1, 5),)], "timestamp timestamp")
    df = analytics.pages_per_period(odd, "hour")
    got = df.selectExpr("count(*) n", "sum(count) s", "min(period) lo", "max(period) hi").first()
    assert (got["n"], got["s"]) == (12_418 * 24 + 6, 2)
    assert (got["lo"], got["hi"]) == ("1990-01-01T00:00:00.000Z", "2024-01-01T05:00:00.000Z")
    assert "hashpartitioning(stretch" in plan_text(df)
