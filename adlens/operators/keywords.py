"""Keyword extraction: tokenize, tag, drop stop words, count, keep the most frequent.

* **Rules only** - every step is an array expression on the page's own row (tokenize, tag,
  filter, lower, sort, run-length count, top-k).  The plan is scan -> project: no exchange,
  so it scales linearly with the table, and a long page or a repeated key costs only its
  own rows.
* **With a lexicon** (``(token, tag)``) of up to ``MAX_ENTRIES`` tokens - two hashed ``IN`` tests, of the
  tokens it keeps and of those it drops, before the rules: row by row likewise.
* **With a larger one** - keywords depend on the text alone, so a text is known by its hash.  Texts'
  counted tokens are dealt into groups of bounded size (``groups``); the distinct tokens of a group are
  joined to the lexicon (a plain join; Spark broadcasts a small side), and the tags found come to the
  group's texts, which are counted and cut to the top k there.  Keywords join back to all pages by
  the hash.  Pages that share a key, or have none, stay rows of their own.

A lexicon entry overrides the rules for its token (original case).  Entries without a token
or a tag are ignored; of several tags of a token the least counts.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlens.functions.arrays import top_tokens, with_token_counts
from adlens.functions.text import (is_stop_word, keyword_tokens, letter_tokens,
                                   rule_keeps_letters)
from adlens.operators import groups
from adlens.schemas import KEYWORDS_PER_PAGE, PAGE_FIELDS, RELEVANT_TAGS


# So many lexicon tokens at most are literals of the plan.
MAX_ENTRIES = 20_000


def _relevant(tag):
    return tag.isin(list(RELEVANT_TAGS))


def _candidates(text_col: str):
    """TX1 -> TX3 rules -> FI6 -> TX4 -> FI5 as one array expression.

    The rules keep letter tokens only, so the tokenizer's letter runs (its maximal
    runs of letters) are the only tokens that can survive: extract just those and test
    the one rule that can drop them, instead of tagging every token.
    """
    tagged = F.filter(letter_tokens(text_col), lambda t: rule_keeps_letters(t))
    return _lower_unstopped(tagged)


def _lower_unstopped(tokens):
    return F.filter(F.transform(tokens, lambda t: F.lower(t)), lambda t: ~is_stop_word(t))


class _Sets(NamedTuple):
    """A lexicon's tokens by whether their tag can make a keyword."""
    keep: list[str]
    drop: list[str]


def _resolved(lexicon: DataFrame) -> DataFrame:
    return (lexicon.filter(F.col("token").isNotNull() & F.col("tag").isNotNull())
            .groupBy(F.col("token").alias("_tok")).agg(F.min("tag").alias("_lex_tag")))


def _sets(lexicon: DataFrame) -> _Sets | None:
    """The lexicon as literals; None if it has over ``MAX_ENTRIES`` tokens."""
    rows = _resolved(lexicon).limit(MAX_ENTRIES + 1).collect()
    if len(rows) > MAX_ENTRIES:
        return None
    kept = {r["_tok"] for r in rows if r["_lex_tag"] in RELEVANT_TAGS}
    return _Sets(sorted(kept), sorted({r["_tok"] for r in rows} - kept))


def _candidates_by(sets: _Sets, text_col: str):
    """As ``_candidates``, a lexicon's tags before the rules."""
    letters = all(t.isalpha() for t in sets.keep)  # then only letter runs can be kept
    tokens = letter_tokens(text_col) if letters else keyword_tokens(text_col)

    def kept(t):
        by_rule = rule_keeps_letters(t) if letters else t.rlike(r"^\p{L}") & rule_keeps_letters(t)
        return t.isin(sets.keep) | (by_rule & ~t.isin(sets.drop))
    return _lower_unstopped(F.filter(tokens, kept))


def with_keyword_counts(pages: DataFrame, text: str = "content", out: str = "_kw_counts",
                        sets: _Sets | None = None) -> DataFrame:
    """AG1 as a column: ``out`` = ``array<struct<token, n>>`` of the page's keyword candidates."""
    return with_token_counts(pages, _candidates(text) if sets is None else _candidates_by(sets, text), out)


def extract_keywords(pages: DataFrame, key: str = "doc_id", text: str = "content",
                     k: int = KEYWORDS_PER_PAGE, lexicon: DataFrame | None = None,
                     out: str = "keywords") -> DataFrame:
    """TK1: add ``out`` = the ``k`` most frequent keywords (count desc, token asc).

    Pages without any keyword get ``[]``.  ``lexicon`` is an optional ``(token, tag)``
    table looked up by the token's original case; tokens it lacks fall back to the rules.
    """
    sets = None if lexicon is None else _sets(lexicon)
    if lexicon is None or sets is not None:
        counted = with_keyword_counts(pages, text, "_kw_counts", sets)
        return counted.withColumn(out, top_tokens("_kw_counts", k)).drop("_kw_counts")
    return joined_keywords(pages, lexicon, text, k, out)


def joined_keywords(pages: DataFrame, lexicon: DataFrame, text: str = "content", k: int = KEYWORDS_PER_PAGE,
                    out: str = "keywords") -> DataFrame:
    """``extract_keywords`` with a lexicon of any size: joined, not a literal of the plan."""
    top = _counts_by_text(pages, text, lexicon, k).select("_text_hash", F.col("_counts.token").alias(out))
    return (pages.withColumn("_text_hash", _hash(text)).join(top, "_text_hash", "left")
            .drop("_text_hash")
            .withColumn(out, F.coalesce(F.col(out), F.array().cast("array<string>"))))


def keyword_counts(pages: DataFrame, key: str = "doc_id", text: str = "content",
                   lexicon: DataFrame | None = None) -> DataFrame:
    """AG1: one row per (page, keyword) with its count ``n`` in that page."""
    sets = None if lexicon is None else _sets(lexicon)
    if lexicon is not None and sets is None:
        counts = _counts_by_text(pages, text, lexicon)
        return (pages.select(key, _hash(text).alias("_text_hash"))
                .join(counts, "_text_hash").select(key, F.inline("_counts")).withColumnRenamed("token", "keyword"))
    counted = with_keyword_counts(pages.select(key, text), text, "_kw_counts", sets)
    # inline_outer: a plain inline makes the optimizer infer `size(array) > 0` and
    # push it to the scan, evaluating the whole extraction twice.
    return (counted.select(key, F.inline_outer("_kw_counts"))
            .filter(F.col("token").isNotNull())
            .select(key, F.col("token").alias("keyword"), "n"))


def _hash(text: str):
    return F.unhex(F.sha2(F.col(text), 256))


def _counts_by_text(pages: DataFrame, text: str, lexicon: DataFrame, k: int | None = None) -> DataFrame:
    """``(_text_hash, _counts array<struct<token, n>>)`` of every distinct text: its keywords, or the ``k`` most
    frequent, by count, then token."""
    lex = _resolved(lexicon).select("_tok", _relevant(F.col("_lex_tag")).alias("_keep"))
    hashed = pages.filter(F.col(text).isNotNull()).select(_hash(text).alias("_text_hash"), F.col(text).alias("_text"))
    counted = with_token_counts(hashed, keyword_tokens("_text"), "_tc")

    # Stop words go at once.  A word is null where it is the token itself; n is negative where the rules drop the token.
    ruled = lambda r: r["token"].rlike(r"^\p{L}") & rule_keeps_letters(r["token"])
    left = counted.select("_text_hash", F.filter("_tc", lambda r: ~is_stop_word(F.lower(r["token"]))).alias("_tc"))
    texts = groups.dealt(left.select(
        "_text_hash", F.col("_tc.token").alias("_tokens"),
        F.transform("_tc", lambda r: F.nullif(F.lower(r["token"]), r["token"])).alias("_words"),
        F.transform("_tc", lambda r: F.when(ruled(r), r["n"]).otherwise(-r["n"]).cast("int")).alias("_n"),
        (F.size("_tc").cast("long") * 40 + 64).alias("_weight")), "_weight")
    needed = texts.select("_group", F.explode("_tokens").alias("_token")).distinct()
    found = needed.join(lex, F.col("_token") == F.col("_tok")).select(F.col("_group").alias("_of"), "_tok", "_keep")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        n = left.num_rows
        if not n:
            return left.select(["_text_hash"]).append_column("_counts", pa.array([], kind))
        lists = left.column("_tokens").chunk(0)
        tokens, times = lists.flatten(), left.column("_n").chunk(0).flatten().to_numpy(zero_copy_only=False)
        keep = times > 0
        if right.num_rows:  # the lexicon's tag before the rules'
            place = pc.fill_null(pc.index_in(tokens, value_set=right.column("_tok").chunk(0)), -1).to_numpy(zero_copy_only=False)
            keep = np.where(place >= 0, right.column("_keep").chunk(0).to_numpy(zero_copy_only=False).astype(bool)[place], keep)
        page = np.repeat(np.arange(n), lists.value_lengths().to_numpy(zero_copy_only=False))
        words = pa.table({"page": page, "token": pc.coalesce(left.column("_words").chunk(0).flatten(), tokens),
                          "n": np.abs(times).astype(np.int64)}).filter(pa.array(keep))
        words = words.group_by(["page", "token"]).aggregate([("n", "sum")]) \
            .sort_by([("page", "ascending"), ("n_sum", "descending"), ("token", "ascending")]).combine_chunks()
        page = words.column("page").to_numpy()
        if k is not None:
            first = np.flatnonzero(np.diff(page, prepend=-1))
            rank = np.arange(len(page)) - np.repeat(first, np.diff(np.append(first, len(page))))
            words, page = words.filter(pa.array(rank < k)).combine_chunks(), page[rank < k]
        offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(page, minlength=n))]).astype(np.int32))
        pairs = pa.StructArray.from_arrays([pa.concat_arrays([pa.array([], pa.string()), *words.column("token").chunks]),
                                            pa.concat_arrays([pa.array([], pa.int64()), *words.column("n_sum").chunks])], ["token", "n"])
        return pa.table([left.column("_text_hash"), pa.ListArray.from_arrays(offsets, pairs)], names=["_text_hash", "_counts"])

    kind = pa.list_(pa.struct([("token", pa.string()), ("n", pa.int64())]))
    done = texts.groupBy("_group").cogroup(found.groupBy("_of")).applyInArrow(run, "_text_hash binary, _counts array<struct<token:string,n:bigint>>")
    # Equal texts have equal keywords.
    return done.groupBy("_text_hash").agg(F.first("_counts").alias("_counts"))


def pages_with_keywords(pages: DataFrame, key: str = "doc_id", k: int = KEYWORDS_PER_PAGE,
                        lexicon: DataFrame | None = None) -> DataFrame:
    """PR5: S2 page -> S3 page (key, url, title, content, category, author, publishedAt, keywords).

    S2 fields the input lacks come out as NULL strings."""
    missing = [f for f in PAGE_FIELDS if f not in pages.columns]
    if missing:
        pages = pages.select("*", *[F.lit(None).cast("string").alias(f) for f in missing])
    kw = extract_keywords(pages, key=key, text="content", k=k, lexicon=lexicon)
    return kw.select(*([key] if key not in PAGE_FIELDS else []), *PAGE_FIELDS, "keywords")
