"""SimHash classes, components and substring dedup against brute force."""

import random

import xxhash
from pyspark.sql import functions as F

from adlens.llm import simhash, spans
from adlens.llm.components import components

DDL = "doc_id long, text string, lang string, source string, n_chars long, fp string, _doc int, key string"


def docs(spark, rows):
    """With extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", "s", 1, "x", 7, "k") for i, t in rows], DDL)


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(rows):
    fps = [(i, brute_fingerprint(t)) for i, t in rows]
    parent = list(range(len(fps)))
    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= 2:
                parent[find(parent, a)] = find(parent, b)
    best = {}
    for n, (i, _) in enumerate(fps):
        if i is not None:
            r = find(parent, n)
            best[r] = min(best.get(r, i), i)
    return sorted((str(i), f"{f:016x}", best.get(find(parent, n))) for n, (i, f) in enumerate(fps))


def corpus():
    rng = random.Random(3)
    long = [f"w{rng.randrange(400)}" for _ in range(600)]
    rows = [(n, " ".join(rng.choice("abcdefgh") * 3 for _ in range(rng.randrange(1, 9)))) for n in range(80)]
    for n in range(80, 130):  # near copies of a long text
        copy = list(long)
        copy[rng.randrange(600)] = "other"
        rows.append((n, " ".join(copy)))
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "One"), (204, "ONE"), (205, "one two"), (None, "one two"),
             (206, "é É"), (203, "One"), (207, "x " * 30_000)]
    return rows


def test_classes_equal_brute_force_on_both_ways(spark):
    rows = corpus()
    for hot in (64, 2):  # 2: nearly every shared block goes the way without pairs
        got = sorted((str(r["doc_id"]), f"{r['fp'] & (1 << 64) - 1:016x}", r["component_id"])
                     for r in simhash.classes(docs(spark, rows), hot_block=hot).collect())
        assert got == brute_classes(rows)


def test_fewer_bits(spark):
    fps = spark.createDataFrame([(0,), (1,), (3,), (7,), (1 << 40,), (-1,)], "fp long")
    for bits in (0, 1):
        want = {(a, b) for a in (0, 1, 3, 7, 1 << 40) for b in (0, 1, 3, 7, 1 << 40) if a < b and (a ^ b).bit_count() <= bits}
        for hot in (64, 1):
            assert {tuple(sorted(r)) for r in simhash.links(fps, bits, hot).collect()} == want


def test_keep_first(spark):
    rows = [(5, "a b c d"), (3, "a b c d"), (3, "a b c d"), (9, "other words entirely here"), (None, "a b c d")]
    kept = simhash.keep_first(docs(spark, rows))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "9"]  # the row without an id gives way
    assert kept.columns == docs(spark, rows).columns


def test_keep_first_decides_by_row(spark):
    near = [f"w{n}" for n in range(400)]
    two = " ".join(["other", *near[1:]])
    assert 0 < (brute_fingerprint(" ".join(near)) ^ brute_fingerprint(two)).bit_count() <= 2
    rows = [(None, "x y z")] * 5 + [(None, "quite another text")] + \
        [(4, "one clean document of its own"), (4, "and one more under that id"), (4, "and one more under that id")] + \
        [(6, "a first text alone in its class"), (2, " ".join(near)), (6, two)]
    kept = sorted((str(r["doc_id"]), r["text"]) for r in simhash.keep_first(docs(spark, rows)).collect())
    assert kept == sorted([("None", "x y z"), ("None", "quite another text"), ("4", rows[6][1]), ("4", rows[7][1]),
                           ("6", rows[9][1]), ("2", rows[10][1])])


def test_empty_tables(spark):
    empty = docs(spark, [])
    assert simhash.classes(empty).count() == 0 and simhash.keep_first(empty).count() == 0
    assert spans.dedup(empty).count() == 0


def test_columns_named_as_the_counts(spark):
    rows = spark.createDataFrame([(1, f"{PASSAGE}", 7, 8), (2, f"{words(1, 40)}. {PASSAGE}", 5, 6)],
                                 "doc_id long, text string, n_removed int, N_sentences int")
    got = spans.dedup(rows)
    assert got.columns == [*rows.columns, "n_sentences_", "n_removed_"]
    assert {(r["doc_id"], r["n_removed"]) for r in got.collect()} == {(1, 7), (2, 5)}
    import corpus_pipeline
    kept = corpus_pipeline.repeated_spans(spark, rows, "")
    assert kept.columns == rows.columns and kept.where("doc_id = 2").first()["n_removed"] == 5


def test_components_of_chains_stars_and_rings(spark):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 30)] + [(300, 301), (301, 302), (302, 300), (7, 7)]
    rng.shuffle(pairs)
    got = dict(components(spark.createDataFrame(pairs, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(30)}, 300: 300, 301: 300, 302: 300}


PASSAGE = ("Every river runs down to the sea at last. Some of them are slow and wide, others quick and narrow. "
           "The old mill turned for two hundred years beside this one. Nobody remembers who built it or why. "
           "In spring the water rises above the lower steps of the garden.")


def words(seed, n):
    rng = random.Random(seed)
    return " ".join(f"q{rng.randrange(10**6)}" for _ in range(n))


def test_a_passage_pasted_anywhere_stays_once(spark):
    rows = [(n, f"{words(n, 30)} {PASSAGE} {words(-n, 25)}.\nEnd {n}.") for n in (4, 2, 9)] + [(1, words(99, 80))]
    got = {r["doc_id"]: r for r in spans.dedup(docs(spark, rows)).collect()}
    assert PASSAGE in got[2]["text"] and got[2]["n_removed"] == 0
    for n in (4, 9):
        assert "river" not in got[n]["text"] and "garden" not in got[n]["text"]
        assert got[n]["text"].startswith(words(n, 30)) and got[n]["text"].endswith(f"{words(-n, 25)}.\nEnd {n}.")
    assert got[1]["text"] == words(99, 80)


def test_borders_follow_from_the_words_around_them():
    rng = random.Random(8)
    han = [chr(0x4E00 + n) for n in range(3000)]
    for trial in range(200):
        sep, some = (" ", [f"q{n}" for n in range(5 if trial % 3 else 9999)]) if trial % 2 else ("", han)
        passage = rng.choices(some, k=rng.randrange(50, 80))
        runs = []
        for _ in range(2):
            text = sep.join(rng.choices(some, k=rng.randrange(40)) + passage + rng.choices(some, k=rng.randrange(40))).encode()
            s = spans.Sentences(text)
            assert s.without(text, s.words < 0) == text and max(s.words) <= spans.MAX_WORDS
            runs.append(set(s.runs(text, spans.SENTENCES, spans.WORDS)[0].tolist()))
        assert runs[0] & runs[1], (trial, len(passage))


def test_unpunctuated_windows_of_51_words_are_found(spark):
    rng = random.Random(4)
    source = words(1, 400).split()
    rows = [(0, " ".join(source))]
    for n in range(1, 30):
        at = rng.randrange(340)
        rows.append((n, " ".join([words(100 + n, rng.randrange(1, 40)), *source[at:at + 51], words(200 + n, rng.randrange(1, 40))])))
    got = {r["doc_id"]: r["text"] for r in spans.dedup(docs(spark, rows)).collect()}
    assert got[0] == rows[0][1]
    known = set(source)
    for n, text in rows[1:]:
        left = got[n].split()
        assert [w for w in left if w not in known] == [w for w in text.split() if w not in known]
        assert len([w for w in left if w in known]) <= 2 * spans.MAX_WORDS


def brute_removed(rows, least, need):
    """Sentence numbers removed, from the definition: every shortest run forwards and backwards."""
    seen, out = {}, {}
    for i, text in sorted(rows):
        raw = text.encode()
        s = spans.Sentences(raw)
        say = [raw[a:b].lower() for a, b in zip(s.begin, s.end)]
        n, found = len(say), set()
        for a in range(n):
            for b in range(a + 1, n + 1):
                size = sum(s.words[a:b])
                if b - a >= least and size >= need:
                    forward = all(x - a < least or sum(s.words[a:x]) < need for x in range(a + 1, b))
                    backward = all(b - x < least or sum(s.words[x:b]) < need for x in range(a + 1, b))
                    if forward or backward:
                        found.add((a, b))
        gone = set()
        for a, b in sorted(found):
            key = tuple(say[a:b])
            if key in seen and seen[key] != (i, a):
                gone |= set(range(a, b))
            seen.setdefault(key, (i, a))
        out[i] = len(gone)
    return out


def test_removed_sentences_equal_brute_force(spark):
    rng = random.Random(1)
    lines = [f"{words(n, rng.randrange(1, 9))}." for n in range(12)]
    rows = [(i, " ".join(rng.choice(lines) for _ in range(rng.randrange(1, 14)))) for i in range(40)]
    got = {r["doc_id"]: r["n_removed"] for r in spans.dedup(docs(spark, rows), 2, 10).collect()}
    assert got == brute_removed(rows, 2, 10)


def test_sentences_are_lossless_and_odd_rows_stay(spark):
    for text in (PASSAGE, "  lead", "No end", "ÉTÉ à Nice! Où?\n\nlast", "x " * 100, "A B C"):
        raw = text.encode()
        s = spans.Sentences(raw)
        assert s.without(raw, s.words < 0) == raw
        assert max(s.words) <= spans.MAX_WORDS
    rows = [(1, None), (2, ""), (3, "  \n"), (None, PASSAGE), (None, PASSAGE), (8, PASSAGE), (8, PASSAGE)]
    out = spans.dedup(docs(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in out if r["doc_id"] is None or r["doc_id"] < 8) == \
        [("1", None), ("2", ""), ("3", "  \n"), ("None", ""), ("None", "")]
    assert [r["text"] for r in out if r["doc_id"] == 8] == [PASSAGE] * 2
    assert out[0]["key"] == "k" and out[0]["_doc"] == 7


def test_rows_without_or_with_a_repeated_id_are_documents_of_their_own(spark):
    other = PASSAGE.replace("e", "o")
    rows = [(None, f"{words(1, 40)}. {PASSAGE}"), (None, "Short one."), (None, f"{words(2, 30)}. {PASSAGE} {words(3, 30)}"),
            (None, words(4, 90)), (None, words(4, 90)), (None, words(4, 90)),
            (7, f"{words(5, 25)}. {other}"), (7, f"{other} {words(6, 35)}"), (7, words(7, 60)), (7, words(7, 60))]
    got = [r["text"] for r in spans.dedup(docs(spark, rows)).collect()]
    assert len(got) == len(rows)
    for passage in (PASSAGE, other):
        assert sum(passage in t for t in got) == 1
    for seed, n in ((1, 40), (2, 30), (3, 30), (5, 25), (6, 35)):
        assert sum(words(seed, n) in t for t in got) == 1
    assert "Short one." in got
    assert got.count(words(4, 90)) == 1 and got.count("") == 2  # copies without an id are repeats
    assert got.count(words(7, 60)) == 2  # equal rows under one id are one document


def test_queries_return_their_contract(spark):
    from adlens.llm.queries import QUERIES
    r = QUERIES["op7_simhash"](spark, "/root/testdata/sf0.001")
    assert r.columns == ["doc_id", "fingerprint", "component_id"] and r.filter(F.length("fingerprint") == 16).count() == 200
    assert QUERIES["op1_substring_dedup"](spark, "/root/testdata/sf0.001").count() == 200


def plain_pieces(text):
    """Pieces of an ASCII text by the stated rules, word by word: (words, begins a sentence)."""
    def value(w):
        h = 0
        for b in w.lower().encode():
            h = h * 0x9E3779B97F4A7C15 + (b + 1) * 0x9E3779B97F4A7C15
        h &= (1 << 64) - 1
        h ^= h >> 29
        h = h * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
        return (h ^ h >> 32) | 1
    said, new = [], []
    for line in text.split("\n"):
        for i, w in enumerate(line.split()):
            new.append(i == 0 or w[0].isupper() or said[-1][-1] in ".!?")
            said.append(w)
    values, cut = [0 if n else value(w) for w, n in zip(said, new)], list(new)
    for a in range(len(said) - spans.MAX_WORDS + 1):
        window = values[a:a + spans.MAX_WORDS]
        cut[a + max(i for i, v in enumerate(window) if v == min(window))] = True
    heads = [i for i, c in enumerate(cut) if c]
    return [(said[a:b], new[a]) for a, b in zip(heads, [*heads[1:], len(said)])]


def plain_removed(rows, least, need):
    """Pieces removed from every text, by comparing the words of runs themselves."""
    places, removed = {}, {}
    for i, text in sorted(rows):
        pieces = plain_pieces(text)
        removed[i] = (len(pieces), set())

        def enough(a, b):
            size = sum(len(p) for p, _ in pieces[a:b])
            touched = 1 + sum(new for _, new in pieces[a + 1:b])
            return size >= need and touched >= least or size >= need * 3 // 2
        ends = range(1, len(pieces) + 1)
        runs = {(a, next(b for b in ends if b > a and enough(a, b))) for a in range(len(pieces)) if enough(a, len(pieces))}
        runs |= {(max(a for a in range(b) if enough(a, b)), b) for b in ends if enough(0, b)}
        for a, b in sorted(runs):
            places.setdefault(tuple(" ".join(p).lower() for p, _ in pieces[a:b]), []).append((i, a, b))
    for found in places.values():
        for i, a, b in found[1:]:
            removed[i][1].update(range(a, b))
    return {i: (n, len(gone)) for i, (n, gone) in removed.items()}


def test_removed_pieces_equal_plain_python(spark):
    rng = random.Random(12)
    shared = [words(n, rng.randrange(5, 70)) for n in range(8)] + [PASSAGE]
    rows = []
    for i in range(40):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            parts += [words(1000 * i + len(parts), rng.randrange(0, 20)), rng.choice(shared), rng.choice(["", ".", "!\n", " Then", "\n"])]
        rows.append((i, " ".join(parts)))
    got = {r["doc_id"]: (r["n_sentences"], r["n_removed"]) for r in spans.dedup(docs(spark, rows)).collect()}
    assert got == plain_removed(rows, spans.SENTENCES, spans.WORDS)
    assert sum(gone for _, gone in got.values()) > 100


def test_blocks_of_a_text_change_nothing(monkeypatch):
    rng = random.Random(6)
    text = " ".join(rng.choice(["ab", "x" * 500, "Été", "日本語のab文", "\n", "க்க", "end.", "𠀀𠀁z"]) for _ in range(400)).encode()
    whole = spans.Sentences(text)
    for block in (64, 65, 67, 1000):
        monkeypatch.setattr(spans, "_BLOCK", block)
        cut = spans.Sentences(text)
        for name in ("begin", "end", "words", "new"):
            assert (getattr(cut, name) == getattr(whole, name)).all()


def test_memory_of_a_very_long_text():
    import tracemalloc
    text = b" ".join(b"w%d" % (n % 1000) for n in range(2_000_000))
    tracemalloc.start()
    spans.Sentences(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 15 * len(text), peak / len(text)
