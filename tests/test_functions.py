from pyspark.sql import functions as F

from adlens.functions import (any_of, keyword_tokens, label_line, label_name, parse_label, rule_tag,
                              strip_ws, top_tokens, vector_tokens, with_token_counts)
from adlens.functions.time import bucket, bucket_key, period_unit
from adlens.functions.vector import cosine


def one(spark, expr, value, ddl="x string"):
    return spark.createDataFrame([(value,)], ddl).select(expr.alias("r")).first()["r"]


def test_keyword_tokenizer_classes(spark):
    toks = one(spark, keyword_tokens("x"), "It's 42--go!! a_b café")
    assert " ".join(toks) == "It ' s 42 -- go !! a _ b café"


def test_keyword_tokenizer_null_is_empty(spark):
    assert one(spark, keyword_tokens("x"), None) == []


def test_vector_tokenizer(spark):
    toks = one(spark, vector_tokens("x"), 'Hello, World! "Quoted" (x) 3.14 a/b  tab\there\nline')
    assert toks == ["hello", "world", "quoted", "x", "ab", "tab", "here", "line"]
    assert one(spark, vector_tokens("x"), None) == []
    assert one(spark, vector_tokens("x"), "  ...  ") == []


def test_rule_tags(spark):
    df = spark.createDataFrame([(t,) for t in ["!!", "42", "running", "jumped", "quickly", "Paris", "house"]],
                               "x string")
    tags = [r["t"] for r in df.select(rule_tag("x").alias("t")).collect()]
    assert tags == [".", "CD", "VBG", "VBD", "RB", "NNP", "NN"]


def test_strip_python_whitespace(spark):
    assert one(spark, strip_ws("x"), " \t hi there 　\n\x1c") == "hi there"


def test_label_name_out_of_range_is_null(spark):
    df = spark.createDataFrame([(0,), (3,), (4,), (None,)], "x int")
    names = [r["n"] for r in df.select(label_name("x").alias("n")).collect()]
    assert names == ["World", "Sci/Tech", None, None]


def test_label_line_and_parse(spark):
    line = one(spark, label_line(F.lit("World"), F.col("x")), "  some text \n")
    assert line == "__label__World  some text"
    df = spark.createDataFrame([(line,), ("__label__Sci/Tech  t",), ("no label",)], "x string")
    cat, content = parse_label("x")
    got = [(r["c"], r["t"]) for r in df.select(cat.alias("c"), content.alias("t")).collect()]
    assert got == [("World", "some text"), ("", ""), ("", "")]


def test_token_counts_and_top(spark):
    df = spark.createDataFrame([(["b", "a", "b", "c", "b", "a"],), ([],)], "x array<string>")
    out = with_token_counts(df, "x", "c").select("c", top_tokens("c", 2).alias("t")).collect()
    assert [(r["token"], r["n"]) for r in out[0]["c"]] == [("a", 2), ("b", 3), ("c", 1)]
    assert out[0]["t"] == ["b", "a"]
    assert out[1]["c"] == [] and out[1]["t"] == []


def test_any_of_null_safe(spark):
    df = spark.createDataFrame([(None,), ([],), (["a", None],), (["x", None],), (["X"],)], "k array<string>")
    got = [r["m"] for r in df.select(any_of("k", ["x"]).alias("m")).collect()]
    assert got == [False, False, False, True, False]


def test_cosine_zero_vector_is_null(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0])], "a array<double>, b array<double>")
    got = [r["c"] for r in df.select(cosine("a", "b").alias("c")).collect()]
    assert got[0] is None and got[1] == -1.0


def test_period_units_and_key(spark):
    assert period_unit("DAY") == "day" and period_unit("day") == "day"
    assert period_unit("week") == "hour" and period_unit(None) == "hour"
    df = spark.sql("SELECT timestamp_ntz'2024-01-01 05:59:59' AS a, timestamp'2024-01-01 05:00:00Z' AS b, "
                   "timestamp_ntz'1969-12-31 23:10:00' AS c")
    for col, zoned, hour in (("a", False, "2024-01-01T05"), ("b", True, "2024-01-01T05"), ("c", False, "1969-12-31T23")):
        k = df.select(bucket(col, "hour", zoned).alias("n")).select(bucket_key("n", "hour").alias("k")).first()["k"]
        assert k == hour + ":00:00.000Z"


def test_letter_rule_equals_full_tagger_on_letter_tokens(spark):
    from adlens.functions.text import letter_tokens, rule_keeps_letters
    from adlens.schemas import RELEVANT_TAGS
    text = "It's 42--go!! a_b café Quickly quickly RUNNING jumped fly Only ÉLAN 3x4 naïve"
    df = spark.createDataFrame([(text,)], "x string")
    full = one(spark, F.filter(keyword_tokens("x"), lambda t: rule_tag(t).isin(list(RELEVANT_TAGS))), text)
    fast = one(spark, F.filter(letter_tokens("x"), lambda t: rule_keeps_letters(t)), text)
    assert full == fast
