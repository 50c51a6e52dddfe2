"""Toxicity by a weighted lexicon and Aho-Corasick (operator 5).

Texts are folded: compatibility forms (full-width, mathematical, ligatures) to plain letters, marks on
Latin, Greek and Cyrillic letters dropped, lower case, homoglyphs and digit or sign substitutions to Latin letters
(signs only before a letter or digit, so trailing decoration stays punctuation), then words
joined by single spaces.  The lexicon has whole words and word beginnings of 4 to 6
letters; both are patterns of one automaton (`` word `` and `` begi``).  A word counts once, with the
heaviest entry that starts at it, unless an exception phrase covers it.

Entries, weights and exceptions are learned from a bounded sample of labelled training documents
(``SAMPLE`` = 20,000, two thirds of them; an entry needs ``LEAST`` toxic documents and a
log odds of ``MIN_WEIGHT``): the weight is the log odds of the entry's document frequencies, and a pair of words
that holds an entry but occurs in clean documents only (three at least) is an exception.  All that
pass are kept; the sample bounds their number.  On the other
third a logistic curve is fitted to the hit weight, the weight per word (normalised by
length) and their presence; it gives the score.

Null and empty texts have no hits and score by that; without labelled rows of both kinds every score
is 0.5.  Texts are scored whole, every row for itself, rows without an id or with a repeated one too;
equal texts score the same; an empty table gives no rows.  Other columns than ``doc_id`` and ``text``
are not read, so none can clash.  In training, of rows that share an id the least text counts, and of
its labels the larger.
"""

from __future__ import annotations

import collections
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlens.llm.samples import draw, labelled_sample
from adlens.llm.tables import materialize

SAMPLE = 20_000
LEAST = 6
MIN_WEIGHT = 1.5
PREFIXES = (4, 5, 6)

# Letters that look like Latin ones, and digits and signs put for letters.
HOMOGLYPHS = dict(zip("аеорсухкмтнвіјѕԁɡһӏαοερντκιυχβıøłđ", "aeopcyxkmthbijsdghlaoepvtkiuxbiold"))
SUBSTITUTIONS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i"}
# Harmless phrases that hold a word often listed as an insult.
EXCEPTIONS = ("clown fish", "trash can", "trash bin", "killer whale", "stupid simple")

_FOLD = tuple((HOMOGLYPHS | SUBSTITUTIONS).items())
_MARKS = re.compile("[\u0300-\u036f]+")
_SIGN = re.compile(r"[@$!](?=\w)")
_WORD = re.compile(r"[^\W_]+")


def fold(text: str | None) -> list[str]:
    if not text:
        return []
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text.lower()))
    low = _SIGN.sub(lambda m: SIGNS[m.group()], text.lower())
    # No letter put in is one replaced, so the order is free; on texts beyond ASCII this is faster than translate.
    for mark, letter in _FOLD:
        low = low.replace(mark, letter)
    return _WORD.findall(low)


def units_of(words) -> set[str]:
    """Lexicon entries the words could match: `` word `` and `` begi``."""
    kinds = set(words)
    found = {f" {w} " for w in kinds}
    for n in PREFIXES:
        found |= {f" {w[:n]}" for w in kinds if len(w) >= n}
    return found


class Lexicon:
    def __init__(self, weights: dict[str, float], exceptions: list[str]):
        import ahocorasick
        self.found = ahocorasick.Automaton()
        for entry, weight in weights.items():
            self.found.add_word(entry, (len(entry), weight))
        for phrase in exceptions:
            self.found.add_word(f" {phrase} ", (len(phrase) + 2, None))
        self.any = bool(weights)
        if self.any:
            self.found.make_automaton()

    def hits(self, words: list[str]) -> dict[int, float]:
        """Start of each matched word in the joined text -> weight."""
        if not self.any or not words:
            return {}
        heaviest, spared = {}, []
        for end, (size, weight) in self.found.iter(f" {' '.join(words)} "):
            start = end - size + 1
            if weight is None:
                spared.append((start, end))
            elif weight > heaviest.get(start, 0.0):
                heaviest[start] = weight
        for a, b in spared:
            for s in [s for s in heaviest if a <= s < b]:
                del heaviest[s]
        return heaviest

    def features(self, text: str | None) -> list[float]:
        words = fold(text)
        weight = sum(self.hits(words).values())
        return [1.0, float(weight > 0), np.log1p(weight), np.log1p(1000.0 * weight / (len(words) + 20))]


def _counts(sample: DataFrame, units):
    """``(unit, toxic, clean)``: documents of each label that hold a unit of ``units(text)``."""
    def run(batches):
        bags = [collections.Counter(), collections.Counter()]
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                bags[y].update(units(text))
        kinds = list(bags[0].keys() | bags[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(kinds, pa.string()), pa.array([bags[1][u] for u in kinds], pa.int64()),
             pa.array([bags[0][u] for u in kinds], pa.int64())], ["unit", "toxic", "clean"])
    return sample.select("text", F.col("y").cast("int").alias("y")).mapInArrow(run, "unit string, toxic long, clean long") \
        .groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def train(docs: DataFrame, labels: DataFrame, training, rows: int = SAMPLE) -> dict:
    """Model from ``labels(doc_id, toxic)`` rows for which ``training`` holds."""
    sc = docs.sparkSession.sparkContext
    sample = materialize(labelled_sample(docs, labels, "toxic", training, rows), "toxicity-sample")
    learn, fit = sample.where(draw("part") < 2 / 3), sample.where(draw("part") >= 2 / 3)
    totals = {r["y"]: r["n"] for r in learn.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return {"weights": {}, "exceptions": [], "curve": [0.0] * 4}
    odds = F.log((F.col("toxic") + 0.5) / (totals[1] + 1.0)) - F.log((F.col("clean") + 0.5) / (totals[0] + 1.0))
    entries = _counts(learn, lambda t: units_of(fold(t))).where(F.col("toxic") >= LEAST) \
        .withColumn("weight", odds).where(F.col("weight") >= MIN_WEIGHT).collect()
    weights = {r["unit"]: float(r["weight"]) for r in entries}
    plain = sc.broadcast(weights)

    def pairs(text):
        lexicon = _cached(plain.value, [])
        words = fold(text)
        starts = lexicon.hits(words)
        if not starts:
            return ()
        at, found = 0, set()
        for i, w in enumerate(words):
            if at in starts:
                found.update(" ".join(words[j:j + 2]) for j in (i - 1, i) if j >= 0 and j + 2 <= len(words))
            at += len(w) + 1
        return found
    clean = _counts(learn, pairs).where("toxic = 0 and clean >= 3").collect()
    model = {"weights": weights, "exceptions": sorted({*EXCEPTIONS, *(r["unit"] for r in clean)})}
    shared = sc.broadcast(model)

    def featured(batches):
        lexicon = Lexicon(**shared.value)
        for b in batches:
            rows = [lexicon.features(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), b.column(1)], ["x", "y"])
    points = fit.select("text", F.col("y").cast("int").alias("y")).mapInArrow(featured, "x array<double>, y int").collect()
    return model | {"curve": _logistic(np.array([r["x"] for r in points]), np.array([r["y"] for r in points], float))}


_LEXICON: list = []  # the worker's last automaton


def _cached(weights, exceptions):
    if not _LEXICON or _LEXICON[0] is not weights:
        _LEXICON[:] = [weights, Lexicon(weights, exceptions)]
    return _LEXICON[1]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> list[float]:
    """Newton's method."""
    if not len(y):
        return [0.0] * 4
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (y - p) - ridge * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(curve, gradient)
    return w.tolist()


def score(docs: DataFrame, model: dict) -> DataFrame:
    """``(doc_id, score)`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        lexicon = Lexicon(shared.value["weights"], shared.value["exceptions"])
        curve = np.array(shared.value["curve"])
        for b in batches:
            x = np.array([lexicon.features(t) for t in b.column(1).to_pylist()]).reshape(-1, len(curve))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(1 / (1 + np.exp(-np.clip(x @ curve, -30, 30))))], ["doc_id", "score"])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
