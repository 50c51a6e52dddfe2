"""Text column expressions: tokenizers, tagging rules, label-line format.

Everything here returns a ``Column`` built from Spark SQL functions, so it runs inside the
JVM (whole-stage codegen where Spark supports it; higher-order functions interpreted).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from adlens.schemas import NEWS_LABELS, STOP_WORDS

# Fixed patterns (Java regex syntax).
# Class tokenizer: runs of letters, runs of digits, runs of one repeated other character.
KEYWORD_TOKEN_PATTERN = r"\p{L}+|\p{Nd}+|([^\p{L}\p{Nd}\s])\1*"
# Characters the vector tokenizer deletes from lower-cased text before splitting.
VECTOR_STRIP_PATTERN = r"""[\d\.:,"'\(\)\[\]|/?!;]+"""
# Separators of the vector tokenizer (a string tokenizer's default delimiters).
VECTOR_SPLIT_PATTERN = r"[ \t\n\r\f]+"
# White space as Python's str.strip / re's \s see it (the corpus scripts are Python).
PY_WHITESPACE = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
STRIP_PATTERN = rf"^{PY_WHITESPACE}+|{PY_WHITESPACE}+$"
# Labelled line: ``__label__<name><white space><text>``; the name is Python's Unicode
# ``\w+`` (letters, numbers, underscore) and ``(?s)`` lets the dot take any character
# of the line, as Python's does once lines are split.
LABEL_LINE_PATTERN = rf"(?s)^__label__([\p{{L}}\p{{N}}_]+){PY_WHITESPACE}+(.*)$"
# The same for a label of any non-space characters (``Sci/Tech``).
ANY_LABEL_PATTERN = rf"(?s)^__label__(\S+?){PY_WHITESPACE}+(.*)$"
LABEL_PREFIX = "__label__"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def keyword_tokens(text) -> Column:
    """TX1: class-based tokens of ``text`` (original case); null text gives ``[]``."""
    t = _col(text)
    return F.coalesce(F.regexp_extract_all(t, F.lit(KEYWORD_TOKEN_PATTERN), 0),
                      F.array().cast("array<string>"))


def letter_tokens(text) -> Column:
    """Letter runs only (the letter part of TX1)."""
    return F.coalesce(F.regexp_extract_all(_col(text), F.lit(r"\p{L}+"), 0),
                      F.array().cast("array<string>"))


def vector_tokens(text) -> Column:
    """TX2: lower-case, delete the punctuation/digit class, split on white space, drop empties."""
    cleaned = F.regexp_replace(F.lower(_col(text)), VECTOR_STRIP_PATTERN, "")
    parts = F.split(cleaned, VECTOR_SPLIT_PATTERN)
    return F.coalesce(F.filter(parts, lambda x: x != ""), F.array().cast("array<string>"))


def rule_tag(token, named=F.lit) -> Column:
    """TX3 default tagger: a part-of-speech tag from the token's own shape.

    Punctuation runs get ``.``, digit runs ``CD``; then ``-ing`` VBG, ``-ed`` VBD,
    ``-ly`` RB, capitalised NNP, anything else NN.  Used for tokens a lexicon lacks.
    ``named`` makes the column of a tag's name (another value for it, for instance).
    """
    t = _col(token)
    return (F.when(~t.rlike(r"[\p{L}\p{Nd}]"), named("."))
            .when(t.rlike(r"^\p{Nd}+$"), named("CD"))
            .when(t.endswith("ing"), named("VBG"))
            .when(t.endswith("ed"), named("VBD"))
            .when(t.endswith("ly"), named("RB"))
            .when(t.rlike(r"^\p{Lu}"), named("NNP"))
            .otherwise(named("NN")))


def rule_keeps_letters(token) -> Column:
    """``rule_tag(token)`` is a noun/verb/adjective tag, for a token made of letters only.

    Of the rules, only ``-ly`` (RB) drops a letter token: ``-ing``/``-ed`` give verbs,
    capitalised NNP, anything else NN.  (Digit and punctuation tokens are never kept.)
    """
    return ~_col(token).endswith("ly")


def is_stop_word(lower_token) -> Column:
    """FI5: stop-word test on an already lower-cased token."""
    return _col(lower_token).isin(list(dict.fromkeys(STOP_WORDS)))


def strip_ws(c) -> Column:
    """TX6: remove leading and trailing Unicode white space."""
    return F.regexp_replace(_col(c), STRIP_PATTERN, "")


def label_name(label) -> Column:
    """TX8: label integer (0-based) to its news class name; out of range gives NULL."""
    names = F.array(*[F.lit(n) for n in NEWS_LABELS])
    return F.try_element_at(names, _col(label).cast("int") + F.lit(1))


def label_line(name, text) -> Column:
    """TX5: ``__label__<name>`` two spaces, then the stripped text on one line (line breaks
    become spaces: one example is one line of the corpus file)."""
    one_line = F.regexp_replace(strip_ws(text), r"\r\n|\r|\n", " ")
    return F.concat(F.lit(LABEL_PREFIX), _col(name), F.lit("  "), one_line)


def parse_label(line, pattern: str = LABEL_LINE_PATTERN) -> tuple[Column, Column]:
    """TX7: (category, content) groups of a labelled line; '' where it does not match."""
    c = _col(line)
    return F.regexp_extract(c, pattern, 1), F.regexp_extract(c, pattern, 2)
