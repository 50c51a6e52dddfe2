"""The corpus steps follow Python semantics (str.strip, re.match with Unicode \\w and \\s);
compare the Spark expressions with Python itself on random lines."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from adlens.functions.text import label_line, label_name, strip_ws
from adlens.operators import corpus

WS = " \t\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0      　"
WORD = "abcXYZé_9٣"
OTHER = "/-.,'\"!?"
ALPHABET = WS + WORD + OTHER
PY_LABEL = re.compile(r"^__label__(\w+)\s+(.*)$")


def py_parse(line):
    line = line.strip()
    if not line:
        return None
    m = PY_LABEL.match(line)
    return (m.group(1), m.group(2)) if m else None


lines = st.one_of(
    st.text(alphabet=ALPHABET, max_size=25),
    st.builds(lambda pre, name, sep, body: pre + "__label__" + name + sep + body,
              st.text(alphabet=WS, max_size=3), st.text(alphabet=WORD + "/", min_size=0, max_size=8),
              st.text(alphabet=WS, max_size=3), st.text(alphabet=ALPHABET, max_size=20)),
)


@settings(max_examples=25, deadline=None)
@given(st.lists(lines, min_size=1, max_size=20))
def test_parse_lines_equals_python(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "value string")
    got = sorted((r["category"], r["content"]) for r in corpus.parse_lines(df).collect())
    want = sorted(p for p in (py_parse(v) for v in values) if p is not None)
    assert got == want


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=20), min_size=1, max_size=20))
def test_strip_equals_python(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    got = [r["s"] for r in df.select(strip_ws("x").alias("s")).collect()]
    assert got == [v.strip() for v in values]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.text(alphabet=ALPHABET, max_size=20)), min_size=1, max_size=10))
def test_label_line_equals_python(spark, rows):
    names = ["World", "Sports", "Business", "Sci/Tech"]
    df = spark.createDataFrame(rows, "label int, text string")
    got = [r["v"] for r in df.select(label_line(label_name("label"), "text").alias("v")).collect()]
    assert got == [f"__label__{names[l]}  {t.strip()}" for l, t in rows]


TEXT = st.text(alphabet=" \t\n\r\f" + "aBcÉé42.:,\"'()[]|/?!;-_xyz" + "\x0b", max_size=40)


@settings(max_examples=25, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=15))
def test_vector_tokens_equal_python_model(spark, values):
    from adlens.functions.text import vector_tokens
    strip = re.compile(r"""[\d\.:,"'\(\)\[\]|/?!;]+""")

    def model(s):  # lower, delete the class, split on " \t\n\r\f", drop empties
        return [t for t in re.split(r"[ \t\n\r\f]+", strip.sub("", s.lower())) if t]

    df = spark.createDataFrame([(v,) for v in values], "x string")
    got = [r["t"] for r in df.select(vector_tokens("x").alias("t")).collect()]
    assert got == [model(v) for v in values]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet=" \t\nabÉé42٣'--!!!?._ ", max_size=40), min_size=1, max_size=15))
def test_keyword_tokens_equal_python_regex(spark, values):
    import regex
    from adlens.functions.text import KEYWORD_TOKEN_PATTERN, keyword_tokens
    pat = regex.compile(KEYWORD_TOKEN_PATTERN)
    df = spark.createDataFrame([(v,) for v in values], "x string")
    got = [r["t"] for r in df.select(keyword_tokens("x").alias("t")).collect()]
    assert got == [[m.group(0) for m in pat.finditer(v)] for v in values]
