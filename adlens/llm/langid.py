"""Language identification as a mixture of languages (operator 10).

Training counts character trigrams of words (with word borders) per language over a
bounded sample of labelled documents: ``per_language`` documents of each language on
average, dealt by a hash of the id.  A word's likelihood under a language is the product
of its trigrams' smoothed probabilities.  Every language and every trigram of the sample is learned, so
the model's size follows from the sample: (trigram, language) pairs that occur, without zeros.

A document is a bag of words, each drawn from one of its languages: expectation
maximisation estimates the languages' proportions.  This is done for the best language
alone and for the 2, 3, ... most proportionate ones; the set with the largest likelihood
less ``penalty`` * log(words) per further language is selected.  The prediction is the
selected set's largest proportion; ``score`` is that proportion, drawn towards 1 /
languages in short texts.  All documents of a batch are solved together in numpy.

Null texts and texts without a letter are ``und`` with score 0, as is every text when no
labelled document with a letter was given.  Texts are used whole; every row has its own result, rows
without an id or with a repeated one too, and equal texts get equal results; of languages that are
equally likely the first by code point is predicted.  An empty table gives no rows.
``predict`` reads ``doc_id`` and ``text`` alone and ``keep_known`` passes all columns on, so none can
clash.  In training, rows without text or language are left out, and rows that share an id are drawn together.
"""

from __future__ import annotations

import collections
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlens.operators.sizing import maybe_broadcast

PER_LANGUAGE = 4000
PENALTY = 3.0
ROUNDS = 8
SMOOTHING = 0.5
_WORD = re.compile(r"[^\W\d_]+")
_CACHE_WORDS = 120_000
_CACHE_CELLS = 1 << 24  # words times languages
_BATCH_CHARS, _BATCH_CELLS = 1_000_000, 50_000_000


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased; signs that only count as numbers are no letters."""
    found = _WORD.findall(text.lower()) if text else []
    return found if "".join(found).isalpha() else [w for w in found if w.isalpha()]


def grams_of(word: str) -> list[str]:
    padded = f" {word} "
    return [padded[i:i + 3] for i in range(len(padded) - 2)]


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> dict:
    """Model from ``labelled(doc_id, text, lang)``; rows without text or language are left out."""
    known = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    shares = known.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(per_language)) / F.count("*")).alias("share"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 20)) / float(1 << 20)
    sample = known.join(maybe_broadcast(shares, row_bytes=32), "lang").where(draw < F.col("share")).select("lang", "text")

    def count(batches):
        words = collections.defaultdict(collections.Counter)
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words[lang].update(words_of(text))
        for lang, bag in words.items():
            grams = collections.Counter()
            for w, n in bag.items():
                for g in grams_of(w):
                    grams[g] += n
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(grams), pa.string()), pa.array(list(grams), pa.string()),
                 pa.array(list(grams.values()), pa.int64())], ["lang", "gram", "n"])

    found = sample.mapInArrow(count, "lang string, gram string, n long") \
        .groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(found.column("lang").to_pylist()))
    grams = {g: i for i, g in enumerate(sorted(set(found.column("gram").to_pylist())))}
    place = {x: i for i, x in enumerate(langs)}
    lang = np.array([place[x] for x in found.column("lang").to_pylist()], np.int32)
    gram = np.array([grams[g] for g in found.column("gram").to_pylist()], np.int64)
    n = found.column("n").to_numpy().astype(float)
    order = np.lexsort((lang, gram))
    total = np.bincount(lang, weights=n, minlength=len(langs)) + SMOOTHING * (len(grams) + 1)  # one trigram never seen
    return {"langs": langs, "grams": grams, "floor": np.log(SMOOTHING / total), "lang": lang[order],
            "gain": np.log((n[order] + SMOOTHING) / SMOOTHING),
            "ends": np.cumsum(np.bincount(gram, minlength=len(grams) + 1))}


def sparse(logp: np.ndarray) -> dict:
    """A dense table of log probabilities (trigrams by languages, the last row for one never seen) in the
    model's form: ``floor`` of a language, and what a trigram adds to it where it occurs."""
    gain = logp - logp[-1]
    row, lang = np.nonzero(gain)
    return {"floor": logp[-1], "lang": lang, "gain": gain[row, lang], "ends": np.cumsum(np.bincount(row, minlength=len(logp)))}


class Scorer:
    """Scores batches of texts; remembers the likelihoods of words it has met."""

    def __init__(self, model: dict):
        self.langs, self.grams = model["langs"], model["grams"]
        table = sparse(model["logp"]) if "logp" in model else model
        self.floor, self.lang, self.gain, self.ends = (table[x] for x in ("floor", "lang", "gain", "ends"))
        self.sizes = np.diff(self.ends, prepend=0)
        self._forget()

    def _forget(self):
        self.rows: dict[str, int] = {}
        self.likelihoods = np.empty((1024, len(self.langs)))

    def _learn(self, words: list[str]) -> None:
        """Likelihoods of words not met before."""
        first, kinds, unseen = len(self.rows), len(self.langs), len(self.grams)
        self.rows.update(zip(words, range(first, first + len(words))))
        if len(self.rows) > len(self.likelihoods):
            self.likelihoods = np.concatenate([self.likelihoods, np.empty((len(self.rows), kinds))])
        parts = [grams_of(w) for w in words]
        each = np.array([len(p) for p in parts])
        gram = np.array([self.grams.get(g, unseen) for p in parts for g in p])
        n = self.sizes[gram]
        at = np.repeat(self.ends[gram] - np.cumsum(n), n) + np.arange(n.sum())
        cell = np.repeat(np.repeat(np.arange(len(words)), each), n) * kinds + self.lang[at]
        gains = np.bincount(cell, weights=self.gain[at], minlength=len(words) * kinds)
        self.likelihoods[first:len(self.rows)] = gains.reshape(-1, kinds) + each[:, None] * self.floor

    def _mix(self, lik, top, n, starts, sizes, allowed):
        """Proportions and log likelihood of each document over its ``allowed`` languages."""
        total = np.add.reduceat(n, starts)
        share = allowed / allowed.sum(axis=1, keepdims=True)
        for _ in range(ROUNDS):
            joint = lik * np.repeat(share, sizes, axis=0)
            mass = joint.sum(axis=1) + 1e-300
            share = np.add.reduceat(joint * (n / mass)[:, None], starts, axis=0) / total[:, None]
        mass = (lik * np.repeat(share, sizes, axis=0)).sum(axis=1) + 1e-300
        return share, np.add.reduceat(n * (np.log(mass) + top), starts)

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if len(self.rows) > min(_CACHE_WORDS, _CACHE_CELLS // max(1, len(self.langs))):
            self._forget()
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        if not self.langs:
            return langs, scores
        which, words, n, sizes = [], [], [], []
        for d, text in enumerate(texts):
            bag = collections.Counter(words_of(text))
            if bag:
                which.append(d)
                sizes.append(len(bag))
                words += bag
                n += bag.values()
        if not which:
            return langs, scores
        ids = list(map(self.rows.get, words))
        if None in ids:
            self._learn(list(dict.fromkeys(w for w, i in zip(words, ids) if i is None)))
            ids = list(map(self.rows.get, words))
        sizes, n = np.array(sizes), np.array(n, float)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        logs = self.likelihoods[np.array(ids)]
        top = logs.max(axis=1)
        lik = np.exp(logs - top[:, None])
        total, kinds = np.add.reduceat(n, starts), len(self.langs)
        share, _ = self._mix(lik, top, n, starts, sizes, np.ones((len(which), kinds)))
        full = share
        alone = np.add.reduceat(logs * n[:, None], starts, axis=0)
        # Order of entry: the best single language, then the others by proportion.
        best = alone.argmax(axis=1)
        rank = share.copy()
        rank[np.arange(len(which)), best] = 2.0
        order = np.argsort(-rank, axis=1, kind="stable")
        value, chosen = alone.max(axis=1), best.copy()
        live = np.arange(len(which))
        for k in range(2, kinds + 1):
            live = live[share[live, order[live, k - 1]] > 0.005]  # a set grows only by a language with some words
            if not len(live):
                break
            picks = np.concatenate([np.arange(starts[d], starts[d] + sizes[d]) for d in live])
            allowed = np.zeros((len(live), kinds))
            np.put_along_axis(allowed, order[live, :k], 1.0, axis=1)
            s = sizes[live]
            part, ll = self._mix(lik[picks], top[picks], n[picks], np.concatenate([[0], np.cumsum(s)[:-1]]), s, allowed)
            ll -= PENALTY * (k - 1) * np.log(total[live] + 1)
            better = ll > value[live]
            value[live[better]], chosen[live[better]] = ll[better], part[better].argmax(axis=1)
        for j, d in enumerate(which):
            langs[d] = self.langs[chosen[j]]
            scores[d] = float((full[j, chosen[j]] * total[j] + 1 / kinds) / (total[j] + 1))
        return langs, scores


def _scored(docs: DataFrame, model: dict, emit, schema):
    """``emit(batch, langs, scores)`` over Arrow batches of ``docs``, whose column ``text`` is read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        score = Scorer(shared.value)
        room = min(_BATCH_CHARS, _BATCH_CELLS // max(1, len(score.langs)))
        for b in batches:
            texts, at = b.column("text").to_pylist(), 0
            while at < len(texts):  # about a million characters at once, fewer with many languages
                end, chars = at, 0
                while end < len(texts) and (end == at or chars < room):
                    chars += len(texts[end] or "")
                    end += 1
                yield emit(b.slice(at, end - at), *score(texts[at:end]))
                at = end
    return docs.mapInArrow(run, schema)


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """``(doc_id, lang_pred, score)`` of every row."""
    def emit(b, langs, scores):
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(langs, pa.string()),
                                           pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])
    return _scored(docs.select(F.col("doc_id").cast("long"), "text"), model, emit,
                   "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, model: dict) -> DataFrame:
    """The rows whose text has a language (not ``und``), columns as given."""
    return _scored(docs, model, lambda b, langs, scores: b.filter(pa.array([x != "und" for x in langs])), docs.schema)
