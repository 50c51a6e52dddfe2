"""Tags in context against a Python Viterbi search."""

import itertools
import random
import re

import pytest

from adlens.operators import tagger as T
from adlens.schemas import RELEVANT_TAGS, STOP_WORDS
from planutil import plan_text

LEXICON = [("la", "DT", 100), ("la", "PRP", 400), ("run", "NN", 300), ("run", "VB", 300), ("run", "VB", 900), ("fast", "JJ", 200),
           ("fast", "RB", 100), ("fast", "VB", 500), ("the", "DT", 0), ("to", "IN", 0), (None, "NN", 1), ("x", None, 1), ("y", "NN", None)]
MOVES = [("^", "DT", 10), ("^", "PRP", 500), ("DT", "NN", 50), ("DT", "VB", 2000), ("PRP", "VB", 20), ("IN", "VB", 30), ("IN", "NN", 700),
         ("NN", "VB", 300), ("VB", "RB", 100), ("NN", "JJ", 100), ("VB", "$", 0), ("NN", "$", 0), ("RB", "$", 0), ("RB", ".", 5),
         (".", "DT", 0), ("NN", "VB", 9000)]
TEXTS = ["la run", "the run fast. La la la run run fast", "to run fast", "run", "", None, "run run run run run run", "stop2go the-run!! fast",
         "Running quickly la Run", "la " * 40]


def rule(token):
    if not re.search(r"[^\W_]", token):
        return "."
    if token.isdecimal():
        return "CD"
    for end, tag in (("ing", "VBG"), ("ed", "VBD"), ("ly", "RB")):
        if token.endswith(end):
            return tag
    return "NNP" if token[0].isupper() else "NN"


def brute(text, lexicon, moves):
    tokens = [m[0] for m in re.finditer(r"[^\W\d_]+|\d+|([^\w\s]|_)\1*", text or "")]
    lex, cost = {}, {}
    for token, tag, c in lexicon:
        if None not in (token, tag, c):
            kinds = lex.setdefault(token, {})
            kinds[tag] = min(c, kinds.get(tag, c))
    for a, b, c in moves:
        cost[a, b] = min(c, cost.get((a, b), c))
    best = {"^": (0, ())}
    for token in tokens:
        best = {tag: min((c + cost.get((b, tag), T.UNSEEN) + own, path + (tag,)) for b, (c, path) in best.items())
                for tag, own in lex.get(token, {rule(token): 0}).items()}
    _, path = min((c + cost.get((b, "$"), T.UNSEEN), path) for b, (c, path) in best.items())
    return tokens, list(path)


def brute_keywords(text, lexicon, moves, k=10):
    counts = {}
    for token, tag in zip(*brute(text, lexicon, moves)):
        if tag in RELEVANT_TAGS and token.lower() not in STOP_WORDS:
            counts[token.lower()] = counts.get(token.lower(), 0) + 1
    return sorted(counts, key=lambda t: (-counts[t], t))[:k]


def frames(spark, lexicon=LEXICON, moves=MOVES):
    return (spark.createDataFrame(lexicon, "token string, tag string, cost int"),
            spark.createDataFrame(moves, "before string, tag string, cost int"))


def tagged(spark, t, texts):
    pages = spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string")
    rows = T.with_context_tags(pages, t).select("doc_id", "_tok", "_tag").collect()
    return {r["doc_id"]: (r["_tok"], [t.tags[i] for i in r["_tag"]]) for r in rows}


@pytest.mark.parametrize("most", [T.MAX_ENTRIES, 2])
def test_tags_equal_a_whole_search(spark, most):
    t = T.tagger(*frames(spark), max_entries=most)
    assert (t.lexicon is None) == (most > 2)
    got = tagged(spark, t, TEXTS)
    assert got == {n: brute(text, LEXICON, MOVES) for n, text in enumerate(TEXTS)}
    assert got[0][1] == ["DT", "NN"] and got[2][1] == ["IN", "VB", "RB"]  # the same word, by its neighbours


@pytest.mark.parametrize("seed", range(3))
def test_random_lexicons(spark, seed):
    rng = random.Random(seed)
    words, tags = [f"w{c}" for c in "abcdefgh"], ["NN", "VB", "JJ", "DT", "RB"]
    words = [w.replace("w", "word") for w in words]
    lexicon = [(w, t, rng.randrange(3)) for w in words for t in rng.sample(tags, rng.randrange(1, 4))]
    moves = [(a, b, rng.randrange(4)) for a, b in itertools.product(["^", *tags, "NNP", "."], [*tags, "$"]) if rng.random() < .8]
    texts = [" ".join(rng.choice([*words, "Other", "!"]) for _ in range(rng.randrange(60))) for _ in range(30)]
    assert tagged(spark, T.tagger(*frames(spark, lexicon, moves)), texts) == {n: brute(x, lexicon, moves) for n, x in enumerate(texts)}


def test_keywords_in_context_keep_the_other_columns_and_take_no_shuffle(spark):
    t = T.tagger(*frames(spark))
    pages = spark.createDataFrame([(n, x, "k", "p") for n, x in enumerate(TEXTS)], "doc_id long, content string, keywords string, _path_ string")
    found = T.extract_keywords(pages, t)
    assert found.columns == ["doc_id", "content", "_path_", "keywords"]
    assert {r["doc_id"]: r["keywords"] for r in found.collect()} == {n: brute_keywords(x, LEXICON, MOVES) for n, x in enumerate(TEXTS)}
    assert "Exchange" not in plan_text(found)


def test_learned_transitions_count_neighbours_of_one_tag(spark):
    t = T.tagger(spark.createDataFrame([("the", "DT", 0), ("run", "NN", 0), ("run", "VB", 0)], "token string, tag string, cost int"))
    pages = spark.createDataFrame([(1, "the dog the cat the run"), (2, "the Dog"), (3, None), (4, "")], "doc_id long, content string")
    learned = {(r["before"], r["tag"]): r["cost"] for r in T.learn_transitions(pages, t).collect()}
    # after DT: NN twice, NNP once (the pair with the ambiguous token is not counted); 9 tags or the end may follow
    follow = len(t.tags) + 1
    assert set(learned) == {("^", "DT"), ("DT", "NN"), ("DT", "NNP"), ("NN", "DT"), ("NNP", "$")}
    import math
    assert learned["DT", "NN"] == round(-1000 * math.log(3 / (3 + follow)))
    assert learned["^", "DT"] == round(-1000 * math.log(3 / (2 + follow)))


def test_a_lexicon_without_ambiguous_tokens_and_an_empty_one(spark):
    t = T.tagger(spark.createDataFrame([("la", "DT", 5)], "token string, tag string, cost int"))
    assert tagged(spark, t, ["la casa"])[0] == (["la", "casa"], ["DT", "NN"])
    t = T.tagger(spark.createDataFrame([], "token string, tag string, cost int"))
    assert tagged(spark, t, ["la Casa 9"])[0] == (["la", "Casa", "9"], ["NN", "NNP", "CD"])


def test_the_rules_are_tried_once_a_token(spark):
    t = T.tagger(*frames(spark))
    plan = plan_text(T.with_context_tags(spark.createDataFrame([(1, "la run")], "doc_id long, content string"), t), "extended")
    optimized = plan.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert 1 <= optimized.count(r"^\p{Nd}+$") <= 2
