"""TX3 in context: a part-of-speech tag for every token of a text, chosen with its neighbours.

A lexicon ``(token, tag, cost)`` gives a token one tag or several, each with a cost (an integer, less
is likelier); tokens it lacks get their one rule tag.  ``(before, tag, cost)`` transitions say how
well a tag follows another.  A text's tags are those of least total cost (Viterbi), of equal
cost the first in the order of the tags' names; ``^`` and ``$`` stand before and after a text.

A token with one tag separates what is before it from what is after it, so only *runs* of
consecutive ambiguous tokens need the search: one ``aggregate`` over each run carries, for every
tag of the last token, the least cost and the tags chosen, a character each.  All of it is array
expressions on the text's own row: no shuffle.

Tokens with the same tags and costs form an *ambiguity class*; a token's class is found by hashed
``IN`` tests, one a class, so the lexicon takes no join.  That holds for up to ``MAX_ENTRIES``
tokens, which are then literals of the plan; a larger lexicon is joined to the distinct tokens of each text.

Transitions can be learned from the texts themselves (``learn_transitions``): pairs of neighbours
that both have one tag are counted over the whole table.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlens.functions.arrays import top_tokens, with_token_counts
from adlens.functions.text import is_stop_word, keyword_tokens, rule_tag
from adlens.schemas import KEYWORDS_PER_PAGE, RELEVANT_TAGS

BEGIN, END = "^", "$"
RULE_TAGS = (".", "CD", "NN", "NNP", "RB", "VBD", "VBG")
# Cost of a transition that the table lacks.
UNSEEN = 20_000
# So many lexicon tokens at most are literals of the plan.
MAX_ENTRIES = 20_000
# A tag is one character of a chosen path, in the order of the tags.
_FIRST_CHAR = 0x100


class Tagger(NamedTuple):
    """``tags`` in order; ``classes``: (tag number, cost) pairs of every class; ``tokens`` of every
    class, or ``lexicon`` (token, class number) where they are too many; ``costs[before][tag]``."""
    tags: list[str]
    classes: list[list[tuple[int, int]]]
    tokens: list[list[str]] | None
    lexicon: DataFrame | None
    costs: list[list[int]]


def tagger(lexicon: DataFrame, transitions: DataFrame | None = None, max_entries: int = MAX_ENTRIES) -> Tagger:
    """Prepares ``lexicon(token, tag, cost)`` and ``transitions(before, tag, cost)``.  Entries with a
    null are ignored; of several costs of one token and tag the least counts."""
    entries = lexicon.dropna(subset=["token", "tag", "cost"]).groupBy("token", "tag").agg(F.min("cost").cast("int").alias("cost"))
    by_token = entries.groupBy("token").agg(F.sort_array(F.collect_list(F.struct("tag", "cost"))).alias("tags"))
    # Classes are combinations of a few tags and costs; tokens come back only if they are few.
    kinds = [r["tags"] for r in by_token.select("tags").distinct().collect()]
    moves = transitions.dropna().groupBy("before", "tag").agg(F.min("cost").alias("cost")).collect() if transitions is not None else []
    names = sorted({t for kind in kinds for t, _ in kind} | set(RULE_TAGS) | ({r["before"] for r in moves} | {r["tag"] for r in moves}) - {BEGIN, END})
    number = {t: i for i, t in enumerate([*names, BEGIN, END])}
    costs = [[UNSEEN if transitions is not None else 0] * len(number) for _ in number]
    for r in moves:
        costs[number[r["before"]]][number[r["tag"]]] = int(r["cost"])
    kinds.sort()
    classes = [[(number[t], int(c)) for t, c in kind] for kind in kinds]
    few = by_token.limit(max_entries + 1).collect()
    if len(few) <= max_entries:
        tokens: list[list[str]] = [[] for _ in kinds]
        place = {tuple(map(tuple, kind)): i for i, kind in enumerate(kinds)}
        for r in few:
            tokens[place[tuple(map(tuple, r["tags"]))]].append(r["token"])
        return Tagger(names, classes, tokens, None, costs)
    known = F.array(*[F.array(*[F.struct(F.lit(t).alias("tag"), F.lit(int(c)).alias("cost")) for t, c in kind]) for kind in kinds])
    joined = by_token.select("token", (F.array_position(known, F.col("tags")) - 1).cast("int").alias("class"))
    return Tagger(names, classes, None, joined, costs)


def _ints(values) -> Column:
    return F.array(*[F.lit(int(v)) for v in values])


def _rule_number(t: Tagger, token: Column) -> Column:
    # The rules are tried once a token: a comparison with each tag's name would try them for each name.
    return rule_tag(token, lambda name: F.lit(t.tags.index(name)))


def _with_classes(texts: DataFrame, t: Tagger, text: str) -> DataFrame:
    """Adds ``_tok`` (the text's tokens) and ``_class`` (class number of each, -1 for those the lexicon lacks)."""
    texts = texts.withColumn("_tok", keyword_tokens(text))
    if t.lexicon is None:
        def class_of(token):
            found = F.lit(-1)
            for n, tokens in enumerate(t.tokens):
                found = F.when(token.isin(tokens), F.lit(n)).otherwise(found)
            # Most tokens are in no class: one test finds that out.
            every = [x for tokens in t.tokens for x in tokens]
            return F.when(token.isin(every), found).otherwise(F.lit(-1)) if every else found
        return texts.withColumn("_class", F.transform("_tok", class_of))
    # The lexicon's join moves (hash, token) pairs; the classes found come back to the texts by hash.
    texts = texts.withColumn("_hash", F.sha2(F.col(text), 256))
    seen = texts.select("_hash", F.explode(F.array_distinct("_tok")).alias("token")).distinct()
    known = seen.join(t.lexicon, "token").groupBy("_hash") \
        .agg(F.map_from_entries(F.collect_list(F.struct("token", "class"))).alias("_known"))
    classed = texts.join(known, "_hash", "left")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>"))
    return classed.withColumn("_known", F.coalesce("_known", none)).withColumn(
        "_class", F.transform("_tok", lambda x: F.coalesce(F.try_element_at("_known", x), F.lit(-1)))) \
        .drop("_known", "_hash")


def _with_single(texts: DataFrame, t: Tagger, text: str) -> DataFrame:
    """Adds ``_tag``: the tag number of each token that has one tag, null for ambiguous ones."""
    texts = _with_classes(texts, t, text)
    single = _ints(c[0][0] if len(c) == 1 else -1 for c in t.classes) if t.classes else F.array().cast("array<int>")
    return texts.withColumn("_tag", F.zip_with("_tok", "_class", lambda token, cls: F.when(cls < 0, _rule_number(t, token))
                                               .otherwise(F.nullif(F.get(single, cls), F.lit(-1)))))


def learn_transitions(texts: DataFrame, t: Tagger, text: str = "content") -> DataFrame:
    """``(before, tag, cost)`` with cost = 1000 * -ln(share of ``tag`` among what follows ``before``),
    one added to every count, from neighbours that both have one tag (begin and end count as such)."""
    names = F.array(*[F.lit(n) for n in [*t.tags, BEGIN, END]])
    line = F.concat(_ints([len(t.tags)]), "_tag", _ints([len(t.tags) + 1]))
    # A filter on the tokens would be pushed to the scan and tokenize every text twice.
    lined = _with_single(texts, t, text).select(F.when(F.size("_tok") > 0, line).alias("_line"))
    pairs = lined.select(F.explode_outer(F.zip_with(
        F.slice("_line", 1, F.size("_line") - 1), F.slice("_line", 2, F.size("_line") - 1),
        lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("_pair")).where("_pair.a IS NOT NULL AND _pair.b IS NOT NULL")
    counts = pairs.groupBy("_pair.a", "_pair.b").agg(F.count("*").alias("n"))
    follow = len(t.tags) + 1  # a tag or the end
    totals = counts.groupBy(F.col("a").alias("_a")).agg(F.sum("n").alias("total"))
    share = (F.col("n") + 1) / (F.col("total") + follow)
    return counts.join(F.broadcast(totals), F.col("a") == F.col("_a")).select(
        F.get(names, F.col("a")).alias("before"), F.get(names, F.col("b")).alias("tag"),
        F.round(-1000 * F.ln(share)).cast("int").alias("cost"))


def with_context_tags(texts: DataFrame, t: Tagger, text: str = "content") -> DataFrame:
    """Adds ``_tok`` and ``_tag``, the tag number (an index of ``t.tags``) chosen for each token."""
    texts = _with_single(texts, t, text)
    if all(len(c) == 1 for c in t.classes):
        return texts.drop("_class")
    n = F.size("_tok")
    texts = texts.withColumn("_at", F.filter(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")),
                                             lambda i: F.element_at(F.col("_tag"), i).isNull()))
    known = lambda i: F.try_element_at(F.col("_tag"), i).isNotNull()
    texts = texts.withColumn("_from", F.filter("_at", lambda i: (i == 1) | F.when(i > 1, known(i - 1)))) \
        .withColumn("_to", F.filter("_at", lambda i: (i == F.size("_tok")) | known(i + 1)))
    costs = F.array(*[_ints(row) for row in t.costs])
    kinds = F.array(*[F.array(*[F.struct(F.lit(tag).alias("tag"), F.lit(cost).alias("cost"),
                                         F.lit(chr(_FIRST_CHAR + tag)).alias("char")) for tag, cost in kind]) for kind in t.classes])
    begin, end = F.lit(len(t.tags)), F.lit(len(t.tags) + 1)

    def step(state, cls):
        return F.transform(F.get(kinds, cls), lambda c: F.array_min(F.transform(state, lambda s: F.struct(
            (s["cost"] + F.get(F.get(costs, s["tag"]), c["tag"]) + c["cost"]).alias("cost"),
            F.concat(s["path"], c["char"]).alias("path"), c["tag"].alias("tag")))))

    def run(start, j):
        stop = F.element_at(F.col("_to"), j + 1)
        before = F.when(start > 1, F.element_at(F.col("_tag"), F.greatest(start - 1, F.lit(1)))).otherwise(begin)
        after = F.coalesce(F.try_element_at(F.col("_tag"), stop + 1), end)
        first = F.array(F.struct(F.lit(0).cast("long").alias("cost"), F.lit("").alias("path"), before.alias("tag")))
        return F.aggregate(
            F.slice(F.col("_class"), start, stop - start + 1), first, step,
            lambda state: F.array_min(F.transform(state, lambda s: F.struct(
                (s["cost"] + F.get(F.get(costs, s["tag"]), after)).alias("cost"), s["path"].alias("path"))))["path"])

    # The characters of all runs, one for each ambiguous token in order.
    texts = texts.withColumn("_path", F.split(F.array_join(F.transform("_from", run), ""), ""))
    # The ambiguous positions ascend, so the k-th of them takes the k-th character.
    chosen = F.transform(F.arrays_zip(F.col("_at").alias("at"), F.slice("_path", F.lit(1), F.size("_at")).alias("char")),
                         lambda z: F.struct(z["at"].alias("at"), (F.ascii(z["char"]) - _FIRST_CHAR).alias("tag")))
    single = F.filter(F.transform("_tag", lambda x, i: F.struct((i + 1).alias("at"), x.alias("tag"))), lambda z: z["tag"].isNotNull())
    merged = F.transform(F.sort_array(F.concat(single, chosen)), lambda z: z["tag"])
    return texts.withColumn("_tag", merged).drop("_class", "_at", "_from", "_to", "_path")


def extract_keywords(pages: DataFrame, t: Tagger, text: str = "content", k: int = KEYWORDS_PER_PAGE,
                     out: str = "keywords") -> DataFrame:
    """TK1 with tags in context: adds ``out``, the ``k`` most frequent tokens tagged noun, adjective or
    verb, lower-cased, without stop words (count desc, token asc)."""
    own = pages.columns
    relevant = [i for i, name in enumerate(t.tags) if name in RELEVANT_TAGS]
    tagged = with_context_tags(pages, t, text)
    kept = F.filter(F.zip_with("_tok", "_tag", lambda token, tag: F.when(tag.isin(relevant), F.lower(token))),
                    lambda token: token.isNotNull() & ~is_stop_word(token))
    counted = with_token_counts(tagged, kept, "_kw_counts")
    return counted.withColumn(out, top_tokens("_kw_counts", k)).select(*[c for c in own if c != out], out)
