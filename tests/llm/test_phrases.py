"""Phrase mining against plain Python, with samples that miss phrases."""

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lotline.llm import phrases


def counts(rows):
    f = defaultdict(Counter)
    n = Counter()
    for _, text, lang in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, 5):
                f[lang or "und"].update(" ".join(w[i: i + k]) for i in range(len(w) - k + 1))
    return f, n


def plain(rows, least, top):
    f, n = counts(rows)
    out = []
    for lang, table in f.items():
        c = {p: a for p, a in table.items() if a >= least and " " in p}
        made = []
        for p, a in c.items():
            w = p.split(" ")
            longer = [b for q, b in c.items() if len(q.split(" ")) > len(w) and f" {p} " in f" {q} "]
            if any(100 * b >= 80 * a for b in longer):
                continue
            cuts = []
            for k in range(1, len(w)):
                left, right = table[" ".join(w[:k])], table[" ".join(w[k:])]
                cuts.append((2_000_000 * a // (left + right), k, left, right))
            score, _, left, right = min(cuts)
            made.append((-score, -a, p.encode(), left, right))
        out += [(lang, r + 1, p.decode(), -a, left, right, n[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(made)[:top])]
    return sorted(out)


def drawn(seed, docs=160):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "été", "x-y", "🙂", "c3", "dd", "e", "F", "gg"]
    rows = []
    for i in range(docs):
        words = rng.choices(vocabulary, weights=range(10, 0, -1), k=rng.randint(0, 60))
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r", " "]) for w in words)
        rows.append((i, text if i % 40 else None, rng.choice(["en", "de", None, "und"])))
    # a passage that only one stretch of the ids holds: a sample hardly sees it
    return [*rows, *((1000 + i, "rare pair of words, rare pair", "en") for i in range(12))]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("n", F.lit(1)).withColumn("phrase", F.lit("p")).withColumn("h", F.lit(1))


def test_equals_plain_python(spark):
    for seed in (1, 2):
        rows = drawn(seed)
        got = sorted(tuple(r) for r in phrases.collocations(frame(spark, rows).repartition(5), least=6, top=25).collect())
        assert got == plain(rows, 6, 25) and len(got) > 50


def test_counts_are_whole_however_little_is_proposed(spark):
    rows = drawn(3)
    f, n = counts(rows)
    truth = {(lang, p): a for lang, t in f.items() for p, a in t.items() if a >= 6}
    passes = []
    for sample, propose in ((1, 6), (8, 2), (1, 10**9), (10**6, 1)):  # all; some; nothing proposed; nothing sampled
        found, words, number = phrases.frequent_phrases(frame(spark, rows), 6, sample, propose)
        assert {(r.lang, r.phrase): r.n for r in found.collect()} == truth and all(r.words == len(r.phrase.split(" ")) for r in found.collect())
        assert {r.lang: r.n for r in words.collect()} == {lang: a for lang, a in n.items() if a}
        passes.append(number)
    assert passes[0] == 1 and passes[2] == passes[3] == 2


def test_phrases_that_share_a_hash_are_told_apart(spark):
    rows = [(i, "one two. one two. three one", "en") for i in range(4)]
    df = phrases._rows(frame(spark, rows))
    words = phrases.Words([(0, b"one two three")], ["en"])
    one, two, three = words.hashes(1).view("int64").tolist()
    counts = spark.createDataFrame([(one, 12), (two, 8), (three, 4)], "h long, n long")
    # as if "one" and "two" had one hash
    names = spark.createDataFrame([(one, "en", "one", None), (one, "en", "two", None), (two, "en", "two", None), (three, "en", "three", None), (None, "en", None, 24)], "h long, lang string, phrase string, n long")
    got = phrases.settled(counts, names, df, 5, phrases.Stored(spark, "phrases")).collect()
    assert sorted((r.phrase, r.words, r.n) for r in got) == [("one", 1, 12), ("three", 1, 4), ("two", 1, 8)]


def test_counts_merge_within_a_task(monkeypatch):
    monkeypatch.setattr(phrases, "HELD", 3)
    tally, total, given = phrases.Tally(), Counter(), 0
    for _ in range(4):
        for b in tally.add(phrases.np.array([5, 7, 5, 9], dtype="uint64")):
            total.update({r["h"]: r["n"] for r in b.to_pylist()})
            given += 1
    for b in tally.flush():
        total.update({r["h"]: r["n"] for r in b.to_pylist()})
    assert total == {5: 8, 7: 4, 9: 4} and given


def test_long_texts_are_cut_between_pieces(monkeypatch):
    text = b"".join(b"w%d x y%s" % (i, b". " if i % 3 else b" ") for i in range(500))
    whole = phrases.Words([(0, text)], ["en"])
    monkeypatch.setattr(phrases, "CHUNK_BYTES", 200)
    parts = phrases.Words([(0, p) for p in phrases._pieces(text)], ["en"])
    assert len(list(phrases._pieces(text))) > 10
    for n in range(1, 5):
        one, two = (Counter(w.text(n, phrases.np.flatnonzero(w.together(n))).to_pylist()) for w in (whole, parts))
        assert one == two
        one, two = (Counter(w.hashes(n)[w.together(n)].tolist()) for w in (whole, parts))
        assert one == two
    assert list(phrases._pieces(b"no break " * 100)) == [b"no break " * 100]


def test_empty_tables_and_texts(spark):
    assert phrases.collocations(frame(spark, [])).count() == 0
    assert phrases.collocations(frame(spark, [(1, None, None), (2, "", "en"), (None, " . ", "en")])).count() == 0
