"""Importance resampling towards a target's n-gram distribution.

Texts become hashed features: all runs of 1 to 3 words. The logarithmic ratio
of a bucket's share in the target to its share in the corpus is its gain; a
document's weight is the sum of its features' gains, and weight plus Gumbel
noise ranks it (drawing without replacement).

1. One map counts buckets into an array a task; Spark adds the arrays up
   (``BUCKETS`` rows). The gains are an array of that size, which is broadcast.
2. A second map scores every document by looking its buckets up in that array.
3. Ranks by regular sampling: every task sorts its documents and stores them as
   a run, each row with its run and place. Every ``stride``-th row of each run is a
   sample; at most 2 * ``SAMPLES`` + runs of them give the splitters. A range
   between two splitters holds at most ``RANGE_ROWS`` + runs * stride rows, however
   the scores are distributed: ties are split too, as run and place are part of the order.
   Segments of the runs are exchanged by range and merged there, counts of the
   ranges before add up to the exact rank. Only ranges that reach into the share
   to be drawn are exchanged.

Null texts count as none: no words, no features, weight 0, never drawn. A null id
is hashed as nothing and ordered first. Rows with equal id and score are
ordered as their run has them; repeated rows are rows of their own. An empty table
gives an empty table, an empty target a weight for every bucket all the same.
Other columns of the tables take no part, whatever their names. A text is read in
pieces, so memory does not grow with its length.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lotline.llm.common import Stored, ship, slices, texts

BUCKETS = 10_000
RUN_WORDS = 3
LEAST_WORDS = 20
PIECE_WORDS = 1 << 16
RANGE_ROWS = 200_000
SAMPLES = 1 << 16

_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(data: bytes):
    """The words of UTF-8 bytes, A-Z lower-cased, one after the other in pieces."""
    at, step = 0, 1 << 20
    while at < len(data):
        end = min(at + step, len(data))
        part = data[at:end].translate(_WORDS)
        if end < len(data):  # a piece ends between two words, if there is a place
            cut = part.rfind(b" ")
            if cut < 0:
                step *= 2
                continue
            part, end = part[:cut], at + cut + 1
        at, step = end, 1 << 20
        yield from part.split()


def features(data: bytes):
    """Bucket numbers of the word runs of a text, as arrays, each with the words
    it adds."""
    stream, tail = words(data), []
    while True:
        piece = list(islice(stream, PIECE_WORDS))
        if not piece:
            return
        run = tail + piece
        spaced = [b" " + w for w in run]
        codes, made = list(map(crc32, run)), []
        for n in range(RUN_WORDS):
            if n:
                codes = list(map(crc32, spaced[n:], codes))  # a checksum goes on where the shorter run's ended
            made.append(codes[max(len(tail) - n, 0):])  # runs inside the last piece's tail were given with it
        yield len(piece), np.fromiter((c for part in made for c in part), dtype=np.uint32) % np.uint32(BUCKETS)
        tail = run[-(RUN_WORDS - 1):]


def _bytes(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def bucket_counts(table: DataFrame) -> np.ndarray:
    """How often each bucket occurs in the texts of a table."""

    def count(batches):
        total = np.zeros(BUCKETS, dtype=np.int64)
        for b in slices(batches):
            for t in _bytes(b.column(0)):
                for _, f in features(t):
                    total += np.bincount(f, minlength=BUCKETS)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there], pa.int64())], names=["bucket", "n"])

    text = table.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = text.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # BUCKETS rows at most
    out = np.zeros(BUCKETS, dtype=np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the logarithm of the smoothed ratio of shares, rounded down."""
    s_all, t_all = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1) * s_all / ((s + 1) * t_all))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def noise(doc_id: int | None, seed: int = 42) -> int:
    """Gumbel noise of a document, times 1000, rounded down."""
    name = "" if doc_id is None else str(doc_id)
    h = int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scored(docs: DataFrame, gains: np.ndarray, least_words: int, seed: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(gains)

    def score(batches):
        for b in slices(batches):
            ids, out = b.column(0).to_pylist(), []
            for i, t in zip(ids, _bytes(b.column(1)), strict=True):
                n_words = n = weight = 0
                for k, f in features(t):
                    n_words, n, weight = n_words + k, n + len(f), weight + int(shared.value[f].sum())
                out.append((n, weight, weight + noise(i, seed), n_words >= least_words))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            made = [pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *made], names=["doc_id", "n_features", "weight", "score", "may"])

    return texts(docs).mapInArrow(score, "doc_id long, n_features long, weight long, score long, may boolean")


def _runs(scored: DataFrame) -> DataFrame:
    """Every task's rows sorted, with the task's number and their place in it."""

    def number(batches):
        run, at = TaskContext.get().partitionId(), 0
        for b in batches:
            place = np.arange(at, at + b.num_rows, dtype=np.int64)
            at += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, run), pa.int32()), pa.array(place)], names=[*b.schema.names, "run", "place"])

    ordered = scored.sortWithinPartitions(F.desc("may"), F.desc("score"), F.asc_nulls_first("doc_id"))
    return ordered.mapInArrow(number, "doc_id long, n_features long, weight long, score long, may boolean, run int, place long")


def _key(score, doc_id, run, place) -> tuple:
    return -score, (doc_id is not None, doc_id or 0), run, place


def _splitters(runs: DataFrame, n: int, range_rows: int, samples: int) -> list[tuple]:
    """Keys that cut the runs' rows into ranges of about ``range_rows``."""
    stride = max(1, n // samples, range_rows // 16)
    taken = runs.where(F.col("may") & (F.col("place") % stride == 0)).select("score", "doc_id", "run", "place")
    keys = sorted(_key(*r) for r in taken.collect())  # <= 2 * samples + one a run
    each = max(1, range_rows // stride)
    return keys[each::each]


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = LEAST_WORDS, seed: int = 42,
                        range_rows: int = RANGE_ROWS, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document: of those
    with ``least_words`` words, ``percent`` in a hundred (rounded down) are drawn, the highest
    scores first, ties to the smaller id; the others' rank is null."""
    spark = docs.sparkSession
    ship(spark)
    keep = Stored(spark, "resampling")
    gains = bucket_gains(bucket_counts(docs), bucket_counts(target))
    runs = keep.put(_runs(_scored(docs, gains, least_words, seed)), "runs")
    n = runs.where("may").count()
    quota = n * percent // 100
    range_rows = min(range_rows, max(quota // 64, 64))  # so that the drawn rows are merged in many tasks
    shared = spark.sparkContext.broadcast(_splitters(runs, n, range_rows, samples))

    def segments(batches):
        """Rows with the range they belong to: how many splitters are not above them. A batch
        may hold rows of several runs, as Spark reads small files together."""
        for b in batches:
            cols = [b.column(b.schema.get_field_index(c)).to_pylist() for c in ("score", "doc_id", "run", "place")]
            keys = [_key(*r) for r in zip(*cols, strict=True)]
            part = np.array([bisect_right(shared.value, k) for k in keys], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part)], names=[*b.schema.names, "part"])

    schema = "doc_id long, n_features long, weight long, score long, run int, place long, part int"
    parts = runs.where("may").drop("may").mapInArrow(segments, schema)
    counts = sorted(parts.groupBy("part").count().collect())  # a row a range, at most one more than splitters
    before, offsets = 0, []
    for r in counts:
        if before < quota:
            offsets.append((r.part, before))
        before += r["count"]
    last = offsets[-1][0] if offsets else -1
    starts = spark.createDataFrame(offsets, "part int, before long")
    order = Window.partitionBy("part").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"), "run", "place")
    near = parts.where(F.col("part") <= last).withColumn("at", F.row_number().over(order)).join(F.broadcast(starts), "part")
    rank = F.col("at").cast("long") + F.col("before")
    none = F.lit(None).cast("long")
    out = ["doc_id", "n_features", "weight", "score"]
    drawn = near.select(*out, F.when(rank <= quota, rank).alias("rank"))
    beyond = parts.where(F.col("part") > last).select(*out, none.alias("rank"))
    return drawn.unionByName(beyond).unionByName(runs.where("not may").select(*out, none.alias("rank")))
