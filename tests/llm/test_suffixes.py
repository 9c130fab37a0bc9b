"""Removed bytes against a plain scan of every string; factors against all pairs."""

import hashlib
import random

import numpy as np

from conftest import SF_SMALL
from lotline.llm import queries, suffixes


def plain(docs, length=100):
    """For texts in order: covered bytes by a dictionary of all strings."""
    seen, out = set(), []
    for t in docs:
        raw = t.encode()
        gone = np.zeros(len(raw), dtype=bool)
        for p in range(len(raw) - length + 1):
            s = raw[p: p + length]
            if s in seen:
                gone[p: p + length] = True
            seen.add(s)
        out.append((raw, gone))
    return out


def digest(raw, gone):
    kept = bytes(np.frombuffer(raw, dtype=np.uint8)[~gone])
    runs = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
    return len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()


def test_query_over_the_given_table(spark):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect())
    want = {d: digest(*x) for (d, _), x in zip(docs, plain([t for _, t in docs]))}
    rows = queries.QUERIES["op10_suffixes"](spark, SF_SMALL).collect()
    assert len(rows) == len(docs)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == want
    assert sum(r.n_removed for r in rows) > 0


def test_planted_repeats_both_ways(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 8)))
    passage = [" ".join(word() for _ in range(n)) for n in (30, 60, 90)]
    docs = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(0, 30))) for _ in range(3)]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passage)
            parts.insert(rng.randint(0, 3), p[rng.randint(0, 40): len(p) - rng.randint(0, 40)])
        docs.append(" ".join(parts))
    docs += ["ab" * 400, "a" * 350, "", docs[3], docs[5][:150] + "x" + docs[5][151:], "ab" * 49, ("0123456789" * 30)]
    want = {i: digest(*x) for i, x in enumerate(plain(docs))}
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(5)
    for hot in (512, 1):  # by suffix order, and by digests as for hot anchors
        got = suffixes.drop_repeated(df, hot=hot).collect()
        for r in got:
            n = sum(x.end - x.start for x in r.gone)
            assert (r.n_bytes, n, len(r.gone), hashlib.sha256(bytes(r.kept)).hexdigest()) == want[r.doc_id], (r.doc_id, hot)


def test_factors_equal_all_pairs():
    rng = np.random.default_rng(4)
    s = rng.integers(97, 99, (60, 12)).astype(np.uint8)
    rank = rng.permutation(60)
    got = suffixes.longest_previous_factors(s, rank)
    for i in range(60):
        best = 0
        for j in range(60):
            if rank[j] < rank[i]:
                d = np.flatnonzero(s[i] != s[j])
                best = max(best, int(d[0]) if len(d) else 12)
        assert got[i] == best


def test_nulls_repeats_extra_columns_and_no_rows(spark):
    t = "".join(chr(97 + i * i % 26) for i in range(150)) + "tail"
    df = spark.createDataFrame([(1, t, "a"), (1, t, "b"), (2, "x" + t, "c"), (3, None, "d"), (4, "", "e"), (None, t, "f")], "doc_id long, text string, key string")
    by = {r.key: r for r in suffixes.drop_repeated(df).collect()}
    assert len(by) == 6
    assert bytes(by["f"].kept) == t.encode() or len(by["f"].gone) <= 1
    assert by["a"].kept == by["b"].kept == b"" and by["c"].kept == b"x" and by["d"].n_bytes == by["e"].n_bytes == 0
    assert suffixes.drop_repeated(df.limit(0)).count() == 0
