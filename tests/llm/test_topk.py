"""Neighbours against brute force over all codes."""

import numpy as np
import pytest

from conftest import SF_SMALL
from lotline.llm import queries, topk

SF = SF_SMALL.replace("sf0.001", "sf0.1")


def brute(codes, asking, k=topk.K):
    ids = np.array(sorted(codes))
    c = np.array([codes[i] for i in ids], dtype=np.int64).view(np.uint64)
    out = {}
    for q in asking:
        d = np.bitwise_count(c ^ np.uint64(np.int64(codes[q]).view(np.uint64))).astype(int)
        order = [j for j in np.lexsort((ids, d)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), int(d[j])) for j in order]
    return out


def collected(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.distance))
    return out


def test_query_over_the_given_table(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    codes = {r.id: r.code for r in topk.encode(vectors).collect()}
    assert len(codes) == vectors.count()
    assert collected(queries.QUERIES["op8_topk"](spark, SF)) == brute(codes, [i for i in codes if i % 50 == 0])


@pytest.mark.parametrize("kind", ["even", "clustered", "equal", "few"])
def test_incremental_search_is_exact(kind):
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 2**63, 3 if kind == "few" else 6000, dtype=np.uint64)
    if kind == "clustered":
        codes = codes[:20][rng.integers(0, 20, 6000)] ^ (np.uint64(1) << rng.integers(0, 64, 6000).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 6000).astype(np.uint64))
    if kind == "equal":
        codes[:] = codes[0]
    least, q = rng.permutation(len(codes)), codes[:: max(1, len(codes) // 40)] ^ np.uint64(3)
    got = {}
    a, e, d, _ = topk.nearest_codes(codes, least, q, 7)
    for i, j, x in zip(a.tolist(), e.tolist(), d.tolist()):
        got.setdefault(i, []).append((x, int(least[j])))
    for i in range(len(q)):
        dist = np.bitwise_count(codes ^ q[i]).astype(int)
        assert sorted(got[i]) == sorted(zip(dist.tolist(), least.tolist()))[:7]


def test_near_queries_end_at_small_radii():
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 2**63, 50_000, dtype=np.uint64)
    codes[:100] = codes[100] ^ np.uint64(1)
    assert topk.nearest_codes(codes, np.arange(len(codes)), codes[100:101], 20)[3] == 0


def test_blocks_nulls_repeats_extra_columns_and_no_rows(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.normal(size=8)], i) for i in range(120)]
    rows += [(200 + i, rows[3][1], 0) for i in range(40)] + [(300, None, 1), (301, [1.0], 1), (302, [float("nan")] * 8, 1), (303, [None] * 8, 1), (None, [1.0] * 8, 1), (7, rows[7][1], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, code long")
    codes = {r.id: r.code for r in topk.encode(df).collect()}
    assert set(codes) == {*range(120), *range(200, 240)}
    for block, chunk in ((topk.BLOCK, topk.CHUNK), (30, 50)):
        assert collected(topk.search(df, block=block, chunk=chunk)) == brute(codes, codes)
    assert topk.search(df.limit(0)).count() == 0
