"""Exact nearest binary codes by incremental multi-index hashing.

Vectors become 64-bit codes: signs of fixed random projections of the vector
minus the corpus mean. For every query the ``k`` rows of smallest Hamming
distance (of equal distance, of smallest id) are found exactly:

* Rows of equal code are one entry with its k + 1 smallest ids (more can never
  be needed), so a vector that a third of all rows share is one entry.
* Entries are dealt into blocks of some ``BLOCK`` codes, distinct query codes
  into chunks of ``CHUNK``; one task searches a block for a chunk, so no task
  holds more than that. Each block keeps a table per 16-bit segment.
* A query looks up, in every segment, the values at radius 0, then 1, and so
  on. An unseen code differs by more than r in each of the ``SEGMENTS``
  segments once all radii to r are done, hence has distance of at least
  SEGMENTS * (r + 1): the search ends when the k-th verified distance is
  below that. A query for which a radius would look at more entries than the
  block has verifies the whole block at once.
* Results of blocks are merged by a window that keeps k + 1 rows a query.

Queries meet every block once: the number of (block, chunk) cells grows with
rows times queries, as it must where a query may lie far from all rows.

Null vectors, those with null, infinite or not-a-number entries, and those
whose length isn't that of most vectors have no code: they neither ask nor
answer. A row is never its own neighbour; other rows of equal vectors are.
Rows of one id count once (the smallest code). No rows: an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotline.llm.common import Stored, ship, slices

K = 10
SEGMENTS, WIDTH = 4, 16
BLOCK = 200_000
CHUNK = 4_096
SEED = 17
PAIRS = 1_000_000  # candidates verified at once


def _matrix(column, dims: int | None = None):
    """Rows with finite entries of one length as a matrix, and which rows those are."""
    rows = column.to_pylist()
    good = [i for i, r in enumerate(rows) if r and (dims is None or len(r) == dims) and None not in r]
    if dims is None:
        return rows, good
    x = np.array([rows[i] for i in good], dtype=np.float64).reshape(len(good), dims)
    fine = np.isfinite(x).all(axis=1)
    return x[fine], [i for i, f in zip(good, fine.tolist(), strict=True) if f]


def encode(vectors: DataFrame) -> DataFrame:
    """id, code of every row with a usable vector."""
    ship(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v")).where("id is not null and v is not null")
    common = rows.where(F.size("v") > 0).groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    if common is None:
        return rows.select("id", F.lit(0).cast("long").alias("code")).limit(0)
    dims = common.dims

    def sums(batches):
        total, n = np.zeros(dims), 0
        for b in slices(batches, 1024):
            x, _ = _matrix(b.column(0), dims)
            total, n = total + x.sum(axis=0), n + len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims), pa.int32()), pa.array(total, pa.float64()), pa.array(np.full(dims, n), pa.int64())], names=["d", "s", "n"])

    got = rows.select("v").mapInArrow(sums, "d int, s double, n long").groupBy("d").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("d").collect()
    mean = np.array([r.s / max(r.n, 1) for r in got])
    project = np.random.default_rng(SEED).normal(size=(dims, SEGMENTS * WIDTH))

    def codes(batches):
        for b in slices(batches, 1024):
            x, good = _matrix(b.column(1), dims)
            bits = (x - mean) @ project > 0
            code = np.packbits(bits, axis=1, bitorder="little").view(np.int64).ravel() if len(x) else np.empty(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(good, pa.int64())), pa.array(code, pa.int64())], names=["id", "code"])

    return rows.mapInArrow(codes, "id long, code long").groupBy("id").agg(F.min("code").alias("code"))


def nearest_codes(codes: np.ndarray, least: np.ndarray, queries: np.ndarray, k: int):
    """(query number, entry number, distance) of the k entries nearest to each
    query, by (distance, least id), and the largest radius that was needed."""
    n, nq = len(codes), len(queries)
    cut = lambda c, s: (c >> np.uint64(WIDTH * s) & np.uint64((1 << WIDTH) - 1)).astype(np.int64)
    order, start = [], []
    for s in range(SEGMENTS):
        seg = cut(codes, s)
        order.append(np.argsort(seg, kind="stable"))
        start.append(np.concatenate([[0], np.cumsum(np.bincount(seg, minlength=1 << WIDTH))]))
    best = [np.empty(0, dtype=np.int64) for _ in range(3)]  # query, distance, entry
    open_, radius = np.arange(nq), 0
    while len(open_):
        masks = np.array([sum(1 << b for b in c) for c in combinations(range(WIDTH), radius)], dtype=np.int64)
        found = [best]
        looked = np.zeros(nq, dtype=np.int64)
        for s in range(SEGMENTS):
            for qs in np.array_split(open_, max(1, len(open_) * len(masks) // PAIRS)):
                probe = cut(queries[qs], s)[:, None] ^ masks
                looked[qs] += (start[s][probe + 1] - start[s][probe]).sum(axis=1)
        whole = open_[looked[open_] >= n]  # cheaper to verify every entry
        part = np.setdiff1d(open_, whole, assume_unique=True)
        for qs in np.array_split(whole, max(1, len(whole) * n // PAIRS)):
            dist = np.bitwise_count(queries[qs][:, None] ^ codes).astype(np.int64)
            top = np.lexsort((np.broadcast_to(least, dist.shape), dist), axis=1)[:, :k]
            found.append([np.repeat(qs, top.shape[1]), np.take_along_axis(dist, top, 1).ravel(), top.ravel()])
        if len(whole):
            gone = np.isin(best[0], whole)
            found[0] = [x[~gone] for x in best]
        for s in range(SEGMENTS):
            share = np.cumsum(looked[part]) // PAIRS
            for g in np.unique(share):
                qs = part[share == g]
                probe = cut(queries[qs], s)[:, None] ^ masks
                low = start[s][probe]
                size = (start[s][probe + 1] - low).ravel()
                q = np.repeat(np.repeat(qs, len(masks)), size)
                at = np.arange(len(q)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low.ravel(), size)
                entry = order[s][at]
                x = queries[q] ^ codes[entry]
                new = np.ones(len(q), dtype=bool)  # seen in no other segment before
                for o in range(SEGMENTS):
                    if o != s:
                        d = np.bitwise_count(cut(x, o))
                        new &= d > radius if o < s else d >= radius
                found.append([q[new], np.bitwise_count(x[new]).astype(np.int64), entry[new]])
        q, d, e = (np.concatenate(x) for x in zip(*found, strict=True))
        sort = np.lexsort((least[e], d, q))
        q, d, e = q[sort], d[sort], e[sort]
        first = np.searchsorted(q, q, side="left")
        kept = np.arange(len(q)) - first < k
        best = [q[kept], d[kept], e[kept]]
        # the k-th verified distance of each query that has k
        have = np.bincount(best[0], minlength=nq)
        last = np.full(nq, SEGMENTS * WIDTH + 1)
        ends = np.cumsum(have) - 1
        full = have >= min(k, n)
        last[full & (have > 0)] = best[1][ends[full & (have > 0)]]
        covered = last < SEGMENTS * (radius + 1)
        open_ = part[~covered[part]] if radius < WIDTH else part[:0]
        radius += 1
    return best[0], best[2], best[1], radius - 1


def search(vectors: DataFrame, queries=None, k: int = K, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """query_id, rank, vec_id, distance: the k nearest rows of each query.
    ``queries``: a condition on ``id`` that says which rows ask (default: all)."""
    keep = Stored(vectors.sparkSession, "topk")
    coded = keep.put(encode(vectors), "codes")
    asking = coded if queries is None else coded.where(queries)
    by_id = Window.partitionBy("code").orderBy("id")
    entries = keep.put(coded.withColumn("r", F.row_number().over(by_id)).where(F.col("r") <= k + 1).groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")), "entries")
    blocks, chunks = (max(1, -(-d.count() // size)) for d, size in ((entries, block), (asking.select("code").distinct(), chunk)))
    part = lambda n: F.pmod(F.xxhash64("code"), F.lit(n)).cast("int")
    index = entries.select(part(blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), "code", "ids")
    asked = asking.select("code").distinct().select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), part(chunks).alias("chunk"), "code")

    def visit(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["code", "distance", "id"]
        if not len(left) or not len(right):
            return pd.DataFrame({n: np.empty(0, dtype=np.int64) for n in names})
        ids = left["ids"].tolist()
        least = np.array([i[0] for i in ids], dtype=np.int64)
        codes, wanted = left["code"].to_numpy().view(np.uint64), right["code"].to_numpy().view(np.uint64)
        q, e, d, _ = nearest_codes(codes, least, wanted, k + 1)
        count = np.array([len(ids[i]) for i in e.tolist()], dtype=np.int64)
        each = np.concatenate([ids[i] for i in e.tolist()]).astype(np.int64)
        q, d = np.repeat(q, count), np.repeat(d, count)
        sort = np.lexsort((each, d, q))
        q, d, each = q[sort], d[sort], each[sort]
        kept = np.arange(len(q)) - np.searchsorted(q, q, side="left") < k + 1
        return pd.DataFrame(dict(zip(names, (wanted.view(np.int64)[q[kept]], d[kept], each[kept]), strict=True)))

    cell = ["block", "chunk"]
    near = index.groupBy(*cell).cogroup(asked.groupBy(*cell)).applyInPandas(visit, "code long, distance long, id long")
    best = Window.partitionBy("code").orderBy("distance", "id")
    near = near.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    lists = near.groupBy("code").agg(F.array_sort(F.collect_list(F.struct("distance", "id"))).alias("near"))
    own = asking.withColumnRenamed("id", "query_id").join(lists, "code")
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)
    return (own.select("query_id", F.posexplode(others).alias("rank", "x"))
            .select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.distance").cast("int").alias("distance")))
