"""Language ID, toxicity, quality and the language model."""

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from adlens.llm import langid, lm, quality, toxicity
from adlens.llm.queries import QUERIES
from adlens.llm.tables import crc_mod

SF = "/root/testdata/sf0.01"
DDL = "doc_id long, text string, lang string, source string, n_chars long, score string, row int"


def odd(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "12 %% 34"), (5, "the and of"), (5, "the and of"), (None, "der die das"),
            (6, "x " * 60_000)]
    return spark.createDataFrame([(i, t, "en", "s", 1, "x", 1) for i, t in rows], DDL)


def held_out(spark, name, label):
    out = QUERIES[name](spark, SF)
    truth = spark.read.parquet(f"{SF}/{'documents' if label == 'lang' else 'labels'}.parquet").select("doc_id", label)
    return out, out.where("held_out").join(truth, "doc_id").collect()


def test_language_id(spark):
    out, rows = held_out(spark, "op10_langid", "lang")
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"] and out.count() == 1000
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.98 * len(rows)
    model = langid.train(spark.read.parquet(f"{SF}/documents.parquet"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(odd(spark), model).collect()}
    assert all(got[i] == ("und", 0.0) for i in (1, 2, 3, 4)) and got[5][0] == "en" and got[None][0] == "de"
    kept = langid.keep_known(odd(spark), model)
    assert kept.count() == 4 and kept.columns == odd(spark).columns
    assert {r["lang_pred"] for r in langid.predict(odd(spark), langid.train(odd(spark).limit(0))).collect()} == {"und"}
    assert langid.predict(odd(spark).limit(0), model).count() == 0


def test_mixture_proportions():
    grams = {"aaa": 0, "bbb": 1}
    model = {"langs": ["A", "B"], "grams": grams, "logp": np.log(np.array([[.9, .05], [.05, .9], [.05, .05]]))}
    langs, scores = langid.Scorer(model)(["aaaa " * 30 + "bbbb " * 10, "bbbb bbbb", "..."])
    assert langs == ["A", "B", "und"] and abs(scores[0] - 0.75) < 0.05 and scores[2] == 0.0


def auc(rows, label):
    pairs = sorted((r["score"], r[label]) for r in rows)
    pos = [s for s, y in pairs if y]
    neg = [s for s, y in pairs if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_toxicity(spark):
    out, rows = held_out(spark, "op5_toxicity", "toxic")
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == 1000
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert toxicity.score(odd(spark), toxicity.train(spark.read.parquet(f"{SF}/documents.parquet"), labels, F.lit(True))).count() == 8
    none = toxicity.train(odd(spark), labels.limit(0), F.lit(True))
    assert {r["score"] for r in toxicity.score(odd(spark), none).collect()} == {0.5}


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    truth = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = QUERIES["op5_toxicity"](spark, sf).where("held_out").join(truth, "doc_id").collect()
    assert auc(rows, "toxic") >= 0.93
    assert sum(r["predicted"] == r["toxic"] for r in rows) >= 0.97 * len(rows)


def test_folding_prefixes_and_exceptions():
    assert toxicity.fold("1d10t! Сlоwn $cum clown***") == ["idiot", "clown", "scum", "clown"]
    lexicon = toxicity.Lexicon({" clown ": 2.0, " clow": 3.0, " scum ": 1.0}, ["clown fish"])
    assert sum(lexicon.hits("a clown and clowns".split()).values()) == 6.0
    assert lexicon.hits("the clown fish".split()) == {}
    assert lexicon.features(None)[1:] == [0.0, 0.0, 0.0]
    assert lexicon.features("clown a")[3] > lexicon.features("clown " + "a " * 500)[3]


def test_quality(spark):
    out, rows = held_out(spark, "op8_quality", "quality")
    assert out.count() == 1000 and auc(rows, "quality") >= 0.95
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert {r["score"] for r in quality.score(odd(spark), quality.train(odd(spark), labels.limit(0), F.lit(True))).collect()} == {0.5}


def test_linear_time_identity_and_gradient():
    rng = np.random.default_rng(0)
    table = rng.normal(size=(quality.SIZE + 1, quality.RANK + 1)) * 0.1
    ids, values = np.array([3, 8, 20, 5, 8]), rng.normal(size=5)
    starts = np.array([0, 3])
    raw, _ = quality.Machine.raw(table, ids, values, starts)
    for d, (a, b) in enumerate(((0, 3), (3, 5))):
        pairs = sum(table[ids[i], 1:] @ table[ids[j], 1:] * values[i] * values[j] for i in range(a, b) for j in range(a, i))
        assert abs(raw[d] - (table[-1, 0] + table[ids[a:b], 0] @ values[a:b] + pairs)) < 1e-9
    y = np.array([1.0, 0.0])
    loss = lambda: sum(math.log1p(math.exp(-s if t else s)) for s, t in zip(quality.Machine.raw(table, ids, values, starts)[0], y))
    before, grads = loss(), np.zeros_like(table)
    for _ in range(20):
        quality.Machine.improve(table, grads, ids, values, starts, y)
    assert loss() < before


def test_language_model_base_score_and_counts(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_TOKENS", 20_000)
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(odd(spark).select("doc_id", "text", "lang", "source", "n_chars"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    train = {r["doc_id"]: r["t"] for r in docs.select("doc_id", (crc_mod("doc_id", 5) != 1).alias("t")).collect()}
    tokens = [[*((t or "").encode().lower().split()), None] for _, t in rows]
    counts = Counter(w for (i, _), ws in zip(rows, tokens) if train[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), len(ws), sum(counts[w] > 0 for w in ws), n,
                   round(sum(math.log10((counts[w] + .5) / (n + .5 * (v + 1))) for w in ws), 6)) for (i, _), ws in zip(rows, tokens))
    scored = lm.score(docs, crc_mod("doc_id", 5) != 1).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in scored) == want
    assert all(r["score"] < 0 for r in scored)
    out = [r for r in scored if r["doc_id"] is not None and not train[r["doc_id"]]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)  # better than the base on held-out text


def test_language_model_without_training_rows_or_rows(spark):
    rows = lm.score(odd(spark), F.lit(False)).collect()
    assert len(rows) == 8 and all(r["train_tokens"] == 0 and r["n_known"] == 0 and abs(r["score"]) < 1e-9 for r in rows)
    assert lm.score(odd(spark).limit(0), F.lit(True)).count() == 0


def test_seating():
    rng = np.random.default_rng(0)
    customers = np.array([0, 1, 2, 5, 4000, 10 ** 6])
    few = lm.seat(customers, np.full(6, 1e-9), 0.5, rng)
    many = lm.seat(customers, np.full(6, 1e9), 0.5, rng)
    assert few.tolist() == [0, 1, 1, 1, 1, 1] and many[:4].tolist() == [0, 1, 2, 5] and (many[4:] > 0.99 * customers[4:]).all()
    # Expected tables of one dish, one by one: pull 1, discount 0.
    mean = np.mean([lm.seat(np.full(1000, 16), np.ones(1000), 0.0, rng)])
    assert abs(mean - sum(1 / (i + 1) for i in range(16))) < 0.15


def slow_language(train_rows, text):
    """The method of operator 10 in plain Python: ``(language, score)``."""
    counts = {}
    for t, lang in train_rows:
        for w in langid.words_of(t):
            for i in range(len(w)):
                counts.setdefault(lang, Counter())[f" {w} "[i:i + 3]] += 1
    langs, grams = sorted(counts), {g for c in counts.values() for g in c}
    total = {x: sum(counts[x].values()) + 0.5 * (len(grams) + 1) for x in langs}
    bag = Counter(langid.words_of(text))
    log = {w: {x: sum(math.log((counts[x][f" {w} "[i:i + 3]] + 0.5) / total[x]) for i in range(len(w))) for x in langs} for w in bag}
    n = sum(bag.values())

    def fit(some):
        share = {x: 1 / len(some) for x in some}
        for _ in range(langid.ROUNDS):
            new = dict.fromkeys(some, 0.0)
            for w, m in bag.items():
                top = max(log[w].values())
                joint = {x: share[x] * math.exp(log[w][x] - top) for x in some}
                for x in some:
                    new[x] += m * joint[x] / (sum(joint.values()) + 1e-300) / n
            share = new
        return share, sum(m * (max(log[w].values()) + math.log(sum(share[x] * math.exp(log[w][x] - max(log[w].values())) for x in some) + 1e-300))
                          for w, m in bag.items())
    full, _ = fit(langs)
    alone = {x: sum(m * log[w][x] for w, m in bag.items()) for x in langs}
    first = max(langs, key=lambda x: alone[x])
    order = [first] + sorted((x for x in langs if x != first), key=lambda x: -full[x])
    value, chosen = alone[first], first
    for k in range(2, len(langs) + 1):
        if full[order[k - 1]] <= 0.005:
            break
        share, ll = fit(order[:k])
        if ll - langid.PENALTY * (k - 1) * math.log(n + 1) > value:
            value, chosen = ll - langid.PENALTY * (k - 1) * math.log(n + 1), max(order[:k], key=lambda x: share[x])
    return chosen, (full[chosen] * n + 1 / len(langs)) / (n + 1)


def test_language_id_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 3000").orderBy("doc_id").limit(90)
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    learn = [(t, x) for i, t, x in rows if i % 2 and t is not None and x is not None]
    mixed = [(i, t) for i, t, _ in rows if i % 2 == 0] + [(9000 + n, " ".join(t[:400] for t, _ in learn[n:n + 3])) for n in range(12)]
    model = langid.train(docs.where("doc_id % 2 = 1"))
    got = {r["doc_id"]: r for r in langid.predict(spark.createDataFrame(mixed, "doc_id long, text string"), model).collect()}
    for i, text in mixed:
        if langid.words_of(text):
            lang, score = slow_language(learn, text)
            assert got[i]["lang_pred"] == lang and abs(got[i]["score"] - score) < 1e-6
        else:
            assert got[i]["lang_pred"] == "und" and got[i]["score"] == 0


def test_a_small_language_beside_a_million_foreign_trigrams(spark):
    rng = np.random.default_rng(3)
    signs = np.array([chr(c) for c in range(0x4E00, 0x4E00 + 400)])
    large = [(i, "".join(rng.choice(signs, 1200)), "zz") for i in range(1000)]
    small = [(5000 + i, "".join(chr(0x10D0 + c) if c < 33 else " " for c in rng.integers(0, 38, 400)), "ka") for i in range(40)]
    rows = spark.createDataFrame(large + small, "doc_id long, text string, lang string")
    model = langid.train(rows.where("doc_id < 5020"))
    assert len(model["grams"]) > 10 ** 6
    got = {r["lang_pred"] for r in langid.predict(rows.where("doc_id >= 5020"), model).collect()}
    assert got == {"ka"}


def test_many_languages_are_learned(spark):
    rows = spark.createDataFrame([(i, chr(0x4E00 + i) * 3 + " " + chr(0x4E00 + i) * 2, f"l{i:04d}") for i in range(1500)],
                                 "doc_id long, text string, lang string")
    model = langid.train(rows)
    assert len(model["langs"]) == 1500
    got = langid.predict(rows.where("doc_id % 50 = 7").union(rows.limit(1)), model).collect()
    assert all(r["lang_pred"] == f"l{r['doc_id']:04d}" for r in got)


CLASH = "doc_id long, text string, lang string, source string, n_chars long, score double, y int, share double, held_out string, unit string"


def odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (5, "the and of"), (5, "the and of"), (5, "something else"), (None, "the and of"),
            (None, None), (6, "word and word. " * 40_000), (7, "́\u0000 ퟿ \U0001d400")]
    return spark.createDataFrame([(i, t, None, None, None, 2.0, 3, 4.0, "x", "u") for i, t in rows], CLASH)


def check_odd_rows(spark, score):
    out = score(odd_rows(spark))
    assert out.columns == ["doc_id", "score"] and out.count() == 10
    got = out.collect()
    assert all(0 <= r["score"] <= 1 for r in got)
    scores = {}
    for r in got:
        scores.setdefault(r["doc_id"], []).append(r["score"])
    assert len(set(scores[5])) <= 2 and scores[1] == scores[2]  # null as empty; equal texts score the same
    assert set(scores[5]) & set(scores[None]) and set(scores[None]) & set(scores[1])
    assert score(odd_rows(spark).limit(0)).count() == 0


def test_odd_rows_with_trained_models(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    odd_labels = labels.select("doc_id", "toxic", "quality").unionByName(
        spark.createDataFrame([(None, 1, 1), (5, None, None), (5, 7, -1), (1, 1, 1)], "doc_id long, toxic int, quality int")
        .select("doc_id", F.col("toxic").cast(labels.schema["toxic"].dataType).alias("toxic"),
                F.col("quality").cast(labels.schema["quality"].dataType).alias("quality")))
    extra = docs.select("doc_id", "text").unionByName(odd_rows(spark).select("doc_id", "text"))
    model = toxicity.train(extra, odd_labels, F.lit(True))
    assert model["weights"]
    check_odd_rows(spark, lambda d: toxicity.score(d, model))
    table = quality.train(extra, odd_labels, F.lit(True), rounds=2)
    assert table is not None
    check_odd_rows(spark, lambda d: quality.score(d, table))


def test_sample_holds_one_row_of_an_id(spark):
    from adlens.llm.samples import labelled_sample
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (2, None), (None, "d"), (3, "e")] + [(4, "x")] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (None, 1), (3, None), (4, 1)], "doc_id long, toxic int")
    got = sorted(map(tuple, labelled_sample(docs, labels, "toxic", F.lit(True), 10).collect()))
    assert got == [(1, "a", 1), (2, "c", 0), (4, "x", 1)]


def slow_hits(words, weights, exceptions):
    """Weights that count, by trying every entry at every word."""
    line, total, at = f" {' '.join(words)} ", 0.0, 0
    spared = [(m, m + len(p) + 2) for p in exceptions for m in range(len(line)) if line.startswith(f" {p} ", m)]
    for w in words:
        best = max((x for e, x in weights.items() if line.startswith(e, at)), default=0.0)
        if not any(a <= at < b - 0 for a, b in spared):
            total += best
        at += len(w) + 1
    return total


def test_toxicity_against_plain_python(spark):
    from adlens.llm.samples import draw
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(docs, labels, F.lit(True))
    rows = docs.join(labels, "doc_id").select("doc_id", "text", "toxic", (draw("part") < 2 / 3).alias("learn")).collect()
    n, seen = Counter(), {0: Counter(), 1: Counter()}
    for r in rows:
        if r["learn"] and r["text"] is not None and r["toxic"] in (0, 1):
            n[r["toxic"]] += 1
            words = toxicity.fold(r["text"])
            seen[r["toxic"]].update({f" {w} " for w in words} | {" " + w[:k] for w in words for k in (4, 5, 6) if len(w) >= k})
    want = {}
    for e, c in seen[1].items():
        odds = math.log((c + .5) / (n[1] + 1)) - math.log((seen[0][e] + .5) / (n[0] + 1))
        if c >= toxicity.LEAST and odds >= toxicity.MIN_WEIGHT:
            want[e] = odds
    assert model["weights"].keys() == want.keys() and all(abs(model["weights"][e] - x) < 1e-9 for e, x in want.items())
    curve = np.array(model["curve"])
    few = [r for r in rows if r["text"] and len(r["text"]) < 1500][:80]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    for r in few:
        words = toxicity.fold(r["text"])
        w = slow_hits(words, model["weights"], model["exceptions"])
        x = np.array([1, w > 0, math.log1p(w), math.log1p(1000 * w / (len(words) + 20))], float)
        assert abs(got[r["doc_id"]] - 1 / (1 + math.exp(-(x @ curve)))) < 1e-9


def test_folding_of_disguised_letters():
    assert toxicity.fold("ｉｄｉｏｔ 𝐢𝐝𝐢𝐨𝐭 ìdíöt ıdıot ĬDĬOT 1d1oт") == ["idiot"] * 6
    assert toxicity.fold("wi66le u9ly") == ["wiggle", "ugly"]


def restaurants(rows, train):
    """Customers of every (word before, word), learned and scored, in plain Python."""
    pairs = {i: [] for i, _ in rows}
    learned = Counter()
    for i, t in rows:
        before = "\r"
        for w in [*(t or "").lower().split(), "\n"]:
            pairs[i].append((before, w))
            learned[before, w] += train[i]
            before = w
    return pairs, {k: n for k, n in learned.items() if n}


def test_language_model_score_against_plain_python(spark):
    """With next to no pull each dish keeps one table a restaurant, so scores follow from counts alone."""
    rows = [(i, f"a b a{i % 3} c{i % 5} a b") for i in range(40)] + [(100, "a b zz"), (101, ""), (102, "b a a b")]
    train = {i: i < 40 and i % 4 != 1 for i, _ in rows}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    weak = 1e-12
    got = {r["doc_id"]: r["score"] for r in lm.score(docs, F.expr("doc_id < 40 and doc_id % 4 <> 1"), strength=weak, discount=0.0).collect()}
    pairs, learned = restaurants(rows, train)
    guests, served = Counter(), Counter()
    for (before, w), n in learned.items():
        guests[before] += n
        served[w] += 1
    total = sum(served.values())

    def probability(before, w):
        base = (served[w] + weak / (len(served) + 1)) / (weak + total)
        return (learned.get((before, w), 0) + weak * base) / (weak + guests[before])
    for i, _ in rows:
        assert abs(got[i] - sum(math.log10(probability(*p)) for p in pairs[i])) < 1e-9


def test_every_context_has_a_restaurant_of_its_own(spark):
    # 30,000 contexts, each always followed by the same word: known pairs stay sure at any number of contexts.
    rows = [(i, " ".join(f"w{j} x{j} w{j} x{j}" for j in range(100 * i, 100 * i + 100))) for i in range(300)]
    docs = spark.createDataFrame(rows + [(1000, "w5 x5"), (1001, "w5 x6"), (-(2 ** 62) - 1, "w7 x7"), (None, "w8 x8")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lm.score(docs, F.expr("doc_id < 1000")).collect()}
    assert got[1000] > got[1001] + 2 and -(2 ** 62) - 1 in got and None in got
