from pyspark.sql import functions as F

from adlens.operators import analytics, search
from planutil import plan_text

HIT_DDL = ("doc_id long, url string, title string, category string, author string, "
           "publishedAt string, keywords array<string>")


def pages(spark):
    rows = [
        (1, "u1", "t1", "tech", "a", None, ["bank", "art"]),
        (2, "u2", "t2", "tech", "a", None, None),
        (3, "u3", "t3", "travel", "b", None, []),
        (4, "u4", "t4", "travel", "b", None, ["hotel", None]),
        (5, "u5", "t5", None, "c", None, ["bank"]),
    ]
    return spark.createDataFrame(rows, HIT_DDL)


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


def test_by_category_exact(spark):
    assert ids(search.by_category(pages(spark), "tech")) == [1, 2]
    assert ids(search.by_category(pages(spark), "Tech")) == []


def test_by_keywords_null_safe(spark):
    assert ids(search.by_keywords(pages(spark), ["bank"])) == [1, 5]
    assert ids(search.by_keywords(pages(spark), ["hotel"])) == [4]
    assert ids(search.by_keywords(pages(spark), ["BANK"])) == []      # no case folding
    assert ids(search.by_keywords(pages(spark), ["zzz"])) == []


def test_search_branches(spark):
    p = pages(spark)
    assert ids(search.search(p, ["bank"], "tech")) == [1]
    assert ids(search.search(p, ["bank"], None)) == [1, 5]
    assert ids(search.search(p, ["bank"], "")) == [1, 5]


def test_hits_and_total(spark):
    res = search.search(pages(spark), ["bank", "hotel"])
    assert search.hits(res, "doc_id").columns == ["doc_id", "url", "title", "category", "author",
                                                  "publishedAt", "keywords"]
    assert search.total(res).first()["total"] == 3


def test_pages_per_category_nulls_and_limit(spark):
    rows = [(i, f"c{n:02d}") for n in range(11) for i in range(3)] + [(99, None)] * 5
    df = spark.createDataFrame(rows, "doc_id long, category string")
    out = analytics.pages_per_category(df, 10).collect()
    assert [r["category"] for r in out] == [f"c{n:02d}" for n in range(10)]
    assert all(r["count"] == 3 for r in out)
    assert analytics.pages_per_category(df).count() == 11


def test_top_keywords_per_category(spark):
    rows = [(1, "x", ["a", "b"]), (2, "x", ["b", "c"]), (3, "x", ["b", "a"]), (4, "y", []),
            (5, "y", ["z"]), (6, None, ["q"])]
    df = spark.createDataFrame(rows, "doc_id long, category string, keywords array<string>")
    got = {r["category"]: r["keywords"] for r in analytics.top_keywords_per_category(df, k=2).collect()}
    assert got == {"x": ["b", "a"], "y": ["z"]}


def test_top_keywords_plan_limits_before_shuffle(spark):
    df = spark.createDataFrame([(1, "x", ["a"])], "doc_id long, category string, keywords array<string>")
    assert "WindowGroupLimit" in plan_text(analytics.top_keywords_per_category(df), "simple")


def ts_rows(spark, values):
    return spark.createDataFrame([(v,) for v in values], "s string").select(
        F.col("s").cast("timestamp").alias("timestamp"))


def test_pages_per_period_gap_fill(spark):
    df = ts_rows(spark, ["2024-01-01 01:10:00", "2024-01-01 04:59:00", None])
    got = [(r["period"], r["count"]) for r in analytics.pages_per_period(df, "hour").orderBy("period").collect()]
    assert got == [("2024-01-01T01:00:00.000Z", 1), ("2024-01-01T02:00:00.000Z", 0),
                   ("2024-01-01T03:00:00.000Z", 0), ("2024-01-01T04:00:00.000Z", 1)]


def test_pages_per_period_units(spark):
    df = ts_rows(spark, ["2024-01-01 01:10:00", "2024-01-03 04:59:00"])
    days = analytics.pages_per_period(df, "DAY").orderBy("period").collect()
    assert [r["count"] for r in days] == [1, 0, 1]
    for p in ("week", None):
        assert analytics.pages_per_period(df, p).count() == 52


from datetime import datetime, timedelta  # noqa: E402

from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=12, deadline=None)
@given(st.lists(st.integers(0, 24 * 60 * 20), min_size=1, max_size=40), st.sampled_from(["hour", "day"]))
def test_pages_per_period_equals_python_model(spark, minutes, unit):
    base = datetime(2024, 3, 1)
    stamps = [base + timedelta(minutes=m) for m in minutes]
    df = spark.createDataFrame([(t,) for t in stamps], "timestamp timestamp_ntz")
    got = [(r["period"], r["count"]) for r in analytics.pages_per_period(df, unit).orderBy("period").collect()]
    step = timedelta(hours=1) if unit == "hour" else timedelta(days=1)
    trunc = (lambda t: t.replace(minute=0, second=0, microsecond=0)) if unit == "hour" else \
        (lambda t: t.replace(hour=0, minute=0, second=0, microsecond=0))
    buckets = [trunc(t) for t in stamps]
    want, b = [], min(buckets)
    while b <= max(buckets):
        want.append((b.strftime("%Y-%m-%dT%H:%M:%S.000Z"), buckets.count(b)))
        b += step
    assert got == want


def test_period_keys_are_utc_in_any_session_zone(spark):
    df = spark.sql("SELECT timestamp'2024-01-10 01:30:00Z' AS timestamp UNION ALL SELECT timestamp'2024-01-10 03:30:00Z'")
    ntz = spark.sql("SELECT timestamp_ntz'2024-03-10 01:30:00' AS timestamp UNION ALL "
                    "SELECT timestamp_ntz'2024-03-10 03:30:00'")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = [[r["period"][:13] for r in analytics.pages_per_period(d, "hour").orderBy("period").collect()] for d in (df, ntz)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [["2024-01-10T01", "2024-01-10T02", "2024-01-10T03"], ["2024-03-10T01", "2024-03-10T02", "2024-03-10T03"]]
