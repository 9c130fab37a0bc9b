"""Importance resampling against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from lotline.llm import queries, resampling


def buckets(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(w), [crc32(" ".join(w[i: i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain(docs, target):
    s, t = Counter(), Counter()
    for text in docs.values():
        s.update(buckets(text)[1])
    for text in target:
        t.update(buckets(text)[1])
    s_all, t_all = float(sum(s.values()) + 10000), float(sum(t.values()) + 10000)
    gain = [math.floor(1000 * math.log((t[b] + 1) * s_all / ((s[b] + 1) * t_all))) for b in range(10000)]
    out, may = {}, []
    for i, text in docs.items():
        n, f = buckets(text)
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out[i] = [len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
        if n >= 20:
            may.append(i)
    for k, i in enumerate(sorted(may, key=lambda i: (-out[i][2], i))[: 5 * len(may) // 100]):
        out[i][3] = k + 1
    return out


def test_query_equals_plain_python(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    target = [r.text for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    rows = queries.op11_resampling(spark, SF_SMALL).collect()
    assert {r.doc_id: [r.n_features, r.weight, r.score, r["rank"]] for r in rows} == plain(docs, target) and len(rows) == len(docs)


def test_ranks_over_many_ranges(spark):
    """Small ranges and many runs: every rank is that of a full sort, ties by id."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(50)]
    docs = {i: " ".join(rng.choices(vocabulary, k=rng.choice([5, 25, 40]))) for i in range(-500, 2500)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(7)
    target = spark.createDataFrame([("w1 w2 w3",), (None,)], "text string")
    got = resampling.importance_resample(df, target, range_rows=40, samples=200).collect()
    assert {r.doc_id: [r.n_features, r.weight, r.score, r["rank"]] for r in got} == plain(docs, ["w1 w2 w3"])
    every = resampling.importance_resample(df, target, percent=100, range_rows=40, samples=200)
    ranked = [r for r in every.collect() if r["rank"]]
    assert sorted(r["rank"] for r in ranked) == list(range(1, len(ranked) + 1))
    assert [r.doc_id for r in sorted(ranked, key=lambda r: r["rank"])] == [r.doc_id for r in sorted(ranked, key=lambda r: (-r.score, r.doc_id))]


def test_equal_rows_are_split_over_ranges(spark):
    """A third of all rows with one id and text: ranks stay 1, 2, 3 ... and no range holds them all."""
    text = " ".join(f"x{i}" for i in range(30))
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit(text).alias("text"),
                                  F.lit(1).alias("score"), F.lit(2).alias("run"), F.lit(3).alias("part")).repartition(6)
    scored = resampling._runs(resampling._scored(df, resampling.bucket_gains(*[resampling.np.zeros(10000, dtype=int)] * 2), 20, 42)).cache()
    keys = resampling._splitters(scored, 3000, 64, 1000)
    assert len(keys) > 30 and len(set(keys)) == len(keys)
    got = resampling.importance_resample(df, df, percent=100, range_rows=64, samples=1000).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 3001))


def test_nulls_empty_texts_and_tables(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "--- ... !"), (4, "É é E e1")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in resampling.importance_resample(df, df.where("doc_id = 4")).collect()}
    assert [got[i].n_features for i in (1, 2, None, 3, 4)] == [0, 0, 3, 0, 9] and all(r["rank"] is None for r in got.values())
    assert got[1].weight == 0 and got[4].weight > got[None].weight
    none = df.where("false")
    assert resampling.importance_resample(none, df).count() == 0 and resampling.importance_resample(df, none).count() == 5


@pytest.mark.parametrize("piece", [1, 2, 3, 7])
def test_features_of_a_text_read_in_pieces(monkeypatch, piece):
    rng = random.Random(piece)
    text = " ".join(rng.choice(["aa", "b", "Ünï", "z9"]) for _ in range(40)) + "  end"
    whole = Counter(buckets(text)[1])
    monkeypatch.setattr(resampling, "PIECE_WORDS", piece)
    made = list(resampling.features(text.encode()))
    assert Counter(int(b) for _, f in made for b in f) == whole and sum(n for n, _ in made) == 41


def test_words_across_read_limits():
    long = ("x" * (1 << 20) + "Y") + " " + "ab " * 400_000
    assert list(resampling.words(long.encode())) == ["x" * (1 << 20) + "y", *["ab"] * 400_000].__class__([w.encode() for w in ["x" * (1 << 20) + "y", *["ab"] * 400_000]])


def test_batches_that_hold_several_runs(spark):
    """Many small runs are read several to a batch: each row still gets its own range."""
    rng = random.Random(5)
    docs = {i: " ".join(rng.choices([f"w{k}" for k in range(50)], k=rng.choice([5, 25, 40]))) for i in range(2000)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(60)
    target = spark.createDataFrame([("w1 w2 w3",)], "text string")
    got = resampling.importance_resample(df, target, range_rows=40, samples=200).collect()
    assert {r.doc_id: [r.n_features, r.weight, r.score, r["rank"]] for r in got} == plain(docs, ["w1 w2 w3"])
