from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from adlens.operators.keywords import extract_keywords, keyword_counts, pages_with_keywords
from adlens.schemas import STOP_WORDS
from planutil import plan_text


def kws(spark, texts, **kw):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string")
    rows = extract_keywords(df, **kw).orderBy("doc_id").collect()
    return [r["keywords"] for r in rows]


def test_empty_inputs_give_empty_list(spark):
    assert kws(spark, [None, "", "the and of"]) == [[], [], []]


def test_eleven_distinct_words_first_ten_alphabetically(spark):
    words = ["kiwi", "juniper", "iris", "hazel", "grape", "fig", "elm", "date", "cedar", "birch", "apple"]
    assert kws(spark, [" ".join(words)]) == [sorted(words)[:10]]


def test_frequency_then_alphabetical(spark):
    assert kws(spark, ["Bank bank art"]) == [["bank", "art"]]


def test_tags_drop_adverbs_digits_punctuation(spark):
    assert kws(spark, ["running quickly Paris jumped 12 !!"]) == [["jumped", "paris", "running"]]


def test_lexicon_path_matches_rules_without_entries(spark):
    texts = ["Bank bank art", "It's 42--go!! a_b café", None, "Only only ONLY daily"]
    lex = spark.createDataFrame([], "token string, tag string")
    assert kws(spark, texts) == kws(spark, texts, lexicon=lex)


def test_lexicon_overrides_rules(spark):
    lex = spark.createDataFrame([("bank", "PRP"), ("quickly", "JJ")], "token string, tag string")
    # lookup is by original case: "Bank" is not in the lexicon, "bank" is.
    assert kws(spark, ["Bank bank bank quickly art"], lexicon=lex) == [["art", "bank", "quickly"]]


def test_lexicon_keeping_non_letter_tokens(spark):
    lex = spark.createDataFrame([("42", "NN"), ("!!", "JJ"), ("it's", "NN")], "token string, tag string")
    texts = ["42 42 go !! !! !! art"]
    assert kws(spark, texts, lexicon=lex) == [["!!", "42", "art", "go"]]


def test_lexicon_entries_null_and_repeated(spark):
    lex = spark.createDataFrame([("bank", None), (None, "NN"), ("art", "DT"), ("art", "NN"), ("zoo", "DT")],
                                "token string, tag string")
    texts = ["bank hotel zoo art", None, "bank hotel zoo art"]
    # No tag: the rules decide; several tags: the least (DT) counts.
    assert kws(spark, texts, lexicon=lex) == [["bank", "hotel"], [], ["bank", "hotel"]]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.sampled_from(["bank", "zoo", "art", "quickly", "42", "!!"]), max_size=6), st.integers(0, 300))
def test_lexicon_of_any_size_is_one_rule(spark, dropped, others):
    lex = spark.createDataFrame([(t, "DT") for t in dropped] + [(f"w{i}", "NN") for i in range(others)],
                                "token string, tag string")
    text = "bank zoo art hotel zoo"
    kept = [w for w in text.split() if w not in dropped]
    want = sorted(set(kept), key=lambda w: (-kept.count(w), w))
    assert kws(spark, [text, text], lexicon=lex) == [want, want]


def test_keyword_counts(spark):
    df = spark.createDataFrame([(1, "Bank bank art"), (2, "")], "doc_id long, content string")
    got = sorted((r["doc_id"], r["keyword"], r["n"]) for r in keyword_counts(df).collect())
    assert got == [(1, "art", 1), (1, "bank", 2)]


def test_page_schema_order(spark):
    df = spark.createDataFrame([(1, "u", "t", "a b", "c", "au", "p")],
                               "doc_id long, url string, title string, content string, category string, "
                               "author string, publishedAt string")
    out = pages_with_keywords(df)
    assert out.columns == ["doc_id", "url", "title", "content", "category", "author", "publishedAt", "keywords"]


def test_url_as_key_is_not_duplicated(spark):
    df = spark.createDataFrame([("u1", "Bank bank art")], "url string, content string")
    out = pages_with_keywords(df, key="url")
    assert out.columns == ["url", "title", "content", "category", "author", "publishedAt", "keywords"]
    assert out.first()["keywords"] == ["bank", "art"]


def test_rule_path_has_no_exchange(spark):
    df = spark.range(100).selectExpr("id AS doc_id", "concat('word ', id) AS content").repartition(8)
    plan = plan_text(extract_keywords(df), "simple")
    assert plan.count("Exchange") == 1  # only the test's own repartition


WORDS = st.sampled_from(["alpha", "beta", "gamma", "the", "and", "Delta", "quickly", "42", "of", "x"])


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(WORDS, max_size=30), min_size=1, max_size=6))
def test_properties_against_python(spark, docs):
    texts = [" ".join(d) for d in docs]
    got = kws(spark, texts)
    for words, k in zip(docs, got):
        cands = [w.lower() for w in words if not w.isdigit() and not w.endswith("ly")
                 and w.lower() not in STOP_WORDS]
        c = Counter(cands)
        want = [w for w, _ in sorted(c.items(), key=lambda kv: (-kv[1], kv[0]))][:10]
        assert k == want
        assert len(k) <= 10 and not set(k) & set(STOP_WORDS)


def test_a_joined_lexicon_in_many_groups(spark, monkeypatch):
    from adlens.operators import groups
    from adlens.operators.keywords import joined_keywords, keyword_counts
    rows = [(i, " ".join(f"{'Art' if j % 3 else 'art'} w{'abcdef'[(i * j) % 6]} quickly 42 !! the Été" for j in range(1 + i % 9))) for i in range(60)]
    rows += [(100, None), (101, ""), (None, "art art"), (None, "art art"), (102, "the of")]
    pages = spark.createDataFrame(rows, "doc_id long, content string")
    lexicon = spark.createDataFrame([("art", "DT"), ("wa", "RB"), ("quickly", "NN"), ("42", "NN"), ("x", None)], "token string, tag string")
    pick = lambda df: sorted(((r["doc_id"], tuple(r["keywords"])) for r in df.collect()), key=str)
    want = pick(extract_keywords(pages, lexicon=lexicon))
    assert pick(joined_keywords(pages, lexicon)) == want
    monkeypatch.setattr(groups.dealt, "__defaults__", (500,))
    found = joined_keywords(pages, lexicon)
    assert pick(found) == want
    plan = plan_text(found, "simple")
    assert "FlatMapCoGroupsInArrow" in plan and "Window" not in plan  # tokens are not shuffled beside their text's hash
    few = [tuple(r) for r in keyword_counts(pages, lexicon=lexicon).collect()]
    monkeypatch.setattr("adlens.operators.keywords.MAX_ENTRIES", 1)
    assert sorted(few, key=str) == sorted([tuple(r) for r in keyword_counts(pages, lexicon=lexicon).collect()], key=str)
