"""Sketches against exact shingle sets; pairing with the next document against a plain loop."""

import hashlib

import numpy as np

from conftest import SF_SMALL
from lotline.llm import fingerprint as fp
from lotline.llm import queries


def _true(a: str, b: str) -> float:
    x, y = ({t.encode()[i:i + fp.SHINGLE] for i in range(max(1, len(t.encode()) - fp.SHINGLE + 1))} for t in (a, b))
    return len(x & y) / len(x | y)


def test_sketch_estimates_jaccard_and_containment():
    rng = np.random.default_rng(3)
    base = " ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(4000))
    part, edited = base[:3000], base[:20_000] + base[:8000][::-1]
    a, e, p = fp.sketch(base), fp.sketch(edited), fp.sketch(part)
    assert abs(fp.resemblance(a, e) - _true(base, edited)) < 0.06
    assert fp.containment(p, a) > 0.98
    assert (fp.merge(p, a) == a).mean() > 0.99
    assert (fp.of_string(fp.as_string(a)) == a).all()
    # all hashes below the threshold, and none above it
    assert (fp.sketch(base, 1.0) < fp.FRACTION * 2**32).sum() == len(a)


def _expected(docs):
    docs = sorted(docs, key=lambda d: (d[0], d[1]))
    for i, (d, t) in enumerate(docs):
        after = docs[(i + 1) % len(docs)][1]
        k = len(t) // 4
        yield d, len(t), hashlib.sha256((t[: len(t) - k] + after[:k]).encode()).hexdigest(), after, t


def test_query_over_the_given_table(spark):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    got = {r.doc_id: r for r in queries.QUERIES["op5_fingerprint"](spark, SF_SMALL).collect()}
    assert len(got) == len(docs)
    for d, n, sha, after, t in _expected(docs):
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (n, sha)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.near_next == 1.0) >= (after == t)
    assert np.mean([r.near_edited for r in got.values()]) > 0.5 > 0.2 > np.mean([r.near_next for r in got.values()])


def test_ranges_meet_at_their_edges(spark):
    docs = [(int(i * 3 % 101), f"text {i} " * (i % 7)) for i in range(101)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.next_text for r in fp.with_next(df, range_rows=10).collect()}
    assert got == {d: after for d, _, _, after, _ in _expected(docs)}


def test_nulls_repeats_extra_columns_and_no_rows(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 6), (3, "b", 7), (3, "a", 8), (None, "z", 9)], "doc_id long, text string, part int")
    rows = fp.fingerprint_documents(fp.with_next(df)).collect()
    assert len(rows) == 5
    assert {(r.doc_id, r.n_chars) for r in rows} == {(1, 0), (2, 0), (3, 1), (None, 1)}
    assert all(r.near_edited == 1.0 for r in rows)
    assert fp.fingerprint_documents(fp.with_next(df.limit(0))).count() == 0
    one = fp.with_next(df.limit(1)).collect()
    assert len(one) == 1 and one[0].next_text == ""


def test_short_parts_of_a_long_text():
    """No estimate of a part is wrong because its only hash lies above the threshold."""
    import numpy as np

    rng = np.random.default_rng(4)
    whole = "".join(chr(97 + x) for x in rng.integers(0, 26, 20_000))
    big, told = fp.sketch(whole), []
    for width in (12, 40, 200, 2000):
        for at in range(0, 15_000, 500):
            part = whole[at: at + width]
            c = fp.containment(fp.sketch(part), big)
            assert c == 1.0 or (np.isnan(c) and not len(fp.below(fp.sketch(part))))
            told.append(not np.isnan(c))
            merged = fp.merge(fp.sketch(part), fp.sketch(whole[:5000]))
            assert (merged < fp._limit(fp.FRACTION)).all()
    assert sum(told[-60:]) >= 58
    a, b = fp.sketch("short one"), fp.sketch("short two")
    assert len(fp.merge(a, b)) >= 1 and fp.containment(a, a) == 1.0
