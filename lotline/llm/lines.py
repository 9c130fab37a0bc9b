"""Removal of repeated passages of lines by content-defined chunks.

A rolling hash over the hashes of two neighbouring lines that are not blank
decides where a chunk ends, so that a passage is cut alike wherever it stands and
whatever surrounds it. A chunk has at least ``LEAST_LINES`` such lines, with the
blank lines between. As a passage may begin inside a chunk, its rest from any line on counts as
a chunk too; as a passage may end inside one, texts are cut ``CHUNKINGS`` times, each
time by another bit of the rolling hash. A line goes when any of its chunks does. Of the
chunks with equal bytes, over all documents, the first (smallest doc_id, then
place) stays. Every line that goes has an equal one further up or in an earlier document.

Lines at the end of a passage, behind the last boundary inside it, can stay: a few in a hundred of all
lines in runs of two or more that occur earlier (bounded in the tests, measured in the README).

1. Chunk hashes are counted. The repeated ones become a bitmap of fixed size
   (``common.FILTER_BITS``), which is broadcast; it only saves shuffling chunks that
   cannot repeat: a chunk let through by chance is sorted out in step 3.
2. The byte comparison: the bytes of all lines of chunks that may repeat are grouped by line
   hash and bytes, and the chunks by hash and the sequence of their lines' hashes (told once a
   batch, and counts are pre-aggregated, so a passage that a third of all documents share is no hot
   group). Where a line hash has one sort of bytes and a chunk hash one sequence, equal
   hashes are equal bytes, and the hash alone is enough from here on.
3. Places of chunks that may repeat are joined with the first place of their hash. Chunks of a
   hash that several texts share, if there are any, are read again and joined by their bytes.
4. Documents are joined with their lists of removed line ranges; those that lose nothing
   (a bitmap again) pass by without a shuffle.

Null texts stay null, empty ones empty; neither has chunks. Rows with equal id
and text count as one document: they lose the same chunks. Rows of one id and
different texts are ordered by a hash of the text. Rows without an id come
first. All columns of the table are kept whatever their names, ``text`` is replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotline.llm.common import _K1, Stored, free_name, mix, passes, prefix_sums, repeated_filter, row_id, ship, slices, span_hashes, text_slices

LEAST_LINES = 2
CHUNKINGS = 2


class Lines:
    """The lines of some texts that are not blank, one text after the other: bytes and
    their hash sums, and arrays of each line's text, number in it, start and end."""

    def __init__(self, texts: list[str]):
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
        breaks = np.flatnonzero(data == 10)
        starts = np.concatenate([[0], breaks[:-1] + 1])
        first = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])[:-1]  # byte where each text starts
        of = np.searchsorted(first, starts, side="right") - 1
        number = np.arange(len(starts)) - np.searchsorted(starts, first)[of]
        full = np.flatnonzero(breaks > starts)
        self.data, self.sums = data, prefix_sums(data)
        self.of, self.number, self.starts, self.ends = of[full], number[full], starts[full], breaks[full]
        self.hash = h = span_hashes(data, self.starts, self.ends, self.sums)
        self.rolled = mix(h[:-1] * _K1 + h[1:])  # of lines i and i + 1
        self.last = np.searchsorted(self.of, self.of, side="right")  # line after the last of a line's text

    def stops(self, chunking: int) -> np.ndarray:
        """The lines before which a chunk ends: by one bit of the rolling hash, and where a text does."""
        cut = self.rolled >> np.uint64(chunking) & np.uint64(1)
        inside = np.flatnonzero(cut.astype(bool) & (self.of[1:] == self.of[:-1])) + LEAST_LINES
        return np.union1d(inside, self.last)

    def chunks(self) -> tuple[np.ndarray, np.ndarray]:
        """First line, and line after the last, of every chunk and chunk's rest."""
        n = len(self.of)
        at = np.flatnonzero(np.arange(n) + LEAST_LINES <= self.last)
        first, end = [], []
        for k in range(CHUNKINGS):
            stops = self.stops(k)
            to = stops[np.searchsorted(stops, at + LEAST_LINES)] if len(at) else at
            new = np.ones(len(at), dtype=bool)
            for other in end:  # a chunk that several chunkings have is one
                new &= other != to
            first.append(at[new])
            end.append(to[new] if k == 0 else np.where(new, to, -1))
        firsts = np.concatenate([at, *first[1:]])
        ends = np.concatenate([end[0], *(e[e >= 0] for e in end[1:])])
        return firsts, ends

    def spans(self, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, first byte and byte after the last of chunks."""
        s, e = self.starts[first], self.ends[end - 1]
        return span_hashes(self.data, s, e, self.sums).view(np.int64), s, e


def spans(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes, and arrays of one row a chunk (and a chunk's rest): hash, first
    line, line after the last, first byte, byte after the last."""
    x = Lines([text])
    first, end = x.chunks()
    h, s, e = x.spans(first, end)
    return x.data, h, x.number[first], x.number[end - 1] + 1, s, e


def chunks(text: str, chunking: int = 0) -> tuple[np.ndarray, list[tuple[int, int, int, int, int]]]:
    """The bytes, and (hash, first line, line after the last, first byte, byte
    after the last) of the chunks of one chunking, one behind the other."""
    x, at = Lines([text]), [0]
    for stop in x.stops(chunking).tolist():
        if stop - at[-1] >= LEAST_LINES:
            at.append(stop)
    first, end = np.array(at[:-1], dtype=np.int64), np.array(at[1:], dtype=np.int64)
    h, s, e = x.spans(first, end)
    return x.data, list(zip(*(c.tolist() for c in (h, x.number[first], x.number[end - 1] + 1, s, e)), strict=True))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(row_id().alias("id"), F.xxhash64("text").alias("key"), F.col("text").cast("string").alias("text")).where("text is not null")


def later(seen: DataFrame, keep: Stored) -> DataFrame:
    """id, key, first and end of every chunk (h, id, key, first, end, chunk) but
    the first of those with equal bytes."""
    place = F.struct("id", "key", "first")  # equal bytes from one place are one chunk
    firsts = keep.put(seen.groupBy("h", "chunk").agg(F.min(place).alias("kept"), F.max(place).alias("last")), "firsts")
    # one row a hash: its first place, or null where different texts share it
    alone = firsts.groupBy("h").agg(F.count("*").alias("n"), F.min("kept").alias("kept"), F.max("last").alias("last")).where("n > 1 or kept < last")
    alone = keep.put(alone.select("h", F.when(F.col("n") == 1, F.col("kept")).alias("kept")), "alone")  # read again, both sides of the join are shuffled for it, so a hot passage can be split
    clash = seen.join(alone.where("kept is null").select("h"), "h", "left_semi").join(firsts, ["h", "chunk"])
    gone = seen.drop("chunk").join(alone.where("kept is not null"), "h").unionByName(clash.select("h", "id", "key", "first", "end", "kept"))
    return gone.where(F.struct("id", "key", "first") > F.col("kept"))


def repeated_ranges(docs: DataFrame, keep: Stored) -> DataFrame:
    """id, key (a hash of the text) and gone: the line ranges to remove, of
    every document that loses some."""
    ship(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    rows = _keyed(docs)

    def hashes(batches):
        for b in text_slices(batches, 0):
            x = Lines(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(x.spans(*x.chunks())[0], pa.int64())], names=["h"])

    shared = sc.broadcast(repeated_filter(rows.select("text").mapInArrow(hashes, "h long")))

    def found(x: Lines):
        """First line, line after the last, hash, first byte and byte after the last of chunks that may repeat."""
        first, end = x.chunks()
        cols = (first, end, *x.spans(first, end))
        may = passes(shared.value, cols[2])
        return [c[may] for c in cols]

    def lines_once(batches):
        for b in text_slices(batches, 0):
            x = Lines(b.column(0).to_pylist())
            first, end = found(x)[:2]
            edge = np.bincount(first, minlength=len(x.of) + 1) - np.bincount(end, minlength=len(x.of) + 1)
            inside = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
            h, at = np.unique(x.hash[inside], return_index=True)
            raw, at = x.data.tobytes(), inside[at]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array([raw[i:j] for i, j in zip(x.starts[at].tolist(), x.ends[at].tolist(), strict=True)], pa.binary())], names=["line", "bytes"])

    def sequences(batches):
        for b in text_slices(batches, 0):
            x = Lines(b.column(0).to_pylist())
            first, end, h, _, _ = found(x)
            h, at = np.unique(h, return_index=True)
            # each line's hash, then how many lines further the next one stands
            gap = np.diff(x.number, append=0).astype(np.uint64)
            raw = np.stack([x.hash, gap], axis=1).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array([raw[16 * i: 16 * j - 8] for i, j in zip(first[at].tolist(), end[at].tolist(), strict=True)], pa.binary())], names=["h", "lines"])

    def places(batches):
        for b in text_slices(batches, 2):
            x = Lines(b.column(2).to_pylist())
            first, end, h, _, _ = found(x)
            at = pa.array(x.of[first])
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), b.column(0).take(at), b.column(1).take(at), pa.array(x.number[first], pa.int32()),
                                               pa.array(x.number[end - 1] + 1, pa.int32())], names=["h", "id", "key", "first", "end"])

    text = rows.select("text")
    of_line = text.mapInArrow(lines_once, "line long, bytes binary").groupBy("line", "bytes").agg(F.count(F.lit(1)).alias("n"))
    odd = [r.line for r in of_line.groupBy("line").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("line").collect()]  # none, but for a chance of n * n / 2**65
    of_chunk = text.mapInArrow(sequences, "h long, lines binary").groupBy("h", "lines").agg(F.count(F.lit(1)).alias("n"))
    doubtful = F.lit(False)
    for line in odd:
        doubtful = doubtful | F.contains("lines", F.lit(np.int64(line).tobytes()))
    kinds = of_chunk.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"), F.max(doubtful).alias("doubtful"))
    clash = [r.h for r in kinds.where("kinds > 1 or doubtful").select("h").collect()]
    where = keep.put(rows.mapInArrow(places, "h long, id long, key long, first int, end int"), "places")
    if clash:
        where = where.where(~F.col("h").isin(clash))
    place = F.struct("id", "key", "first")
    kept = keep.put(where.groupBy("h").agg(F.min(place).alias("kept"), F.max(place).alias("last")).where("kept < last").drop("last"), "firsts")  # read again, both sides of the join are shuffled for it, so a hot passage can be split
    gone = where.join(kept, "h").where(place > F.col("kept")).select("id", "key", "first", "end")
    if clash:
        gone = gone.unionByName(later(keep.put(_clashing(rows, clash), "clashing"), keep).select("id", "key", "first", "end"))
    return keep.put(gone.groupBy("id", "key").agg(F.collect_set(F.struct("first", "end")).alias("gone")), "gone")


def _clashing(rows: DataFrame, hashes: list[int]) -> DataFrame:
    """h, id, key, first, end and bytes of the chunks with one of these hashes."""
    wanted = np.array(hashes, dtype=np.int64)
    names = ["h", "id", "key", "first", "end", "chunk"]

    def run(batches):
        for b in text_slices(batches, 2):
            x = Lines(b.column(2).to_pylist())
            first, end = x.chunks()
            h, s, e = x.spans(first, end)
            may = np.isin(h, wanted)
            first, end, h, s, e = (c[may] for c in (first, end, h, s, e))
            raw, at = x.data.tobytes(), pa.array(x.of[first])
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), b.column(0).take(at), b.column(1).take(at), pa.array(x.number[first], pa.int32()), pa.array(x.number[end - 1] + 1, pa.int32()),
                                               pa.array([raw[i:j] for i, j in zip(s.tolist(), e.tolist(), strict=True)], pa.binary())], names=names)

    return rows.mapInArrow(run, "h long, id long, key long, first int, end int, chunk binary")


NUMBERS = ("__lines", "__gone_lines", "__gone_chunks")


def number_names(docs: DataFrame) -> list[str]:
    """The names of the numbers that ``drop_repeated`` adds: ``NUMBERS``, or free
    ones where the table has such columns."""
    return [free_name(docs.columns, c) for c in NUMBERS]


def drop_repeated(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated chunks taken out of ``text``, and the numbers
    (``number_names``) of lines there were, lines and chunks that went (chunks that
    touch or overlap go, and count, as one)."""
    keep = Stored(docs.sparkSession, "lines")
    i, k, g, t = (free_name(docs.columns, c) for c in ("__id", "__key", "__gone", "__text"))
    gone = repeated_ranges(docs, keep).select(F.col("id").alias(i), F.col("key").alias(k), F.col("gone").alias(g))
    # documents that lose nothing need not be shuffled: a bitmap of fixed size says which those may be
    m = free_name(docs.columns, "__mark")
    marks = gone.select(F.xxhash64(i, k).alias("m"))
    losing = docs.sparkSession.sparkContext.broadcast(repeated_filter(marks.unionAll(marks)))
    may_lose = F.pandas_udf(lambda x: pd.Series(passes(losing.value, x.to_numpy())), "boolean")
    marked = docs.withColumn(m, F.xxhash64(row_id(), F.xxhash64("text")))
    may = may_lose(F.col(m))
    joined = marked.where(may).join(gone, (row_id() == F.col(i)) & (F.xxhash64("text") == F.col(k)), "left").drop(i, k)
    joined = joined.unionByName(marked.where(~may).withColumn(g, F.lit(None).cast("array<struct<first:int,end:int>>")))
    others, numbers = [c for c in docs.columns if c != "text"], number_names(docs)
    names = [*others, "text", *numbers]

    def rebuild(batches):
        for b in slices(batches):
            out = []
            for text, ranges in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if text is None:
                    out.append((None, 0, 0, 0))
                    continue
                n = text.count("\n") + 1 if text else 0
                if not ranges:
                    out.append((text, n, 0, 0))
                    continue
                lines, at, left, runs = text.split("\n"), 0, [], 0
                for r in sorted(ranges, key=lambda r: r["first"]):
                    runs += r["first"] > at or not runs
                    left += lines[at: r["first"]]
                    at = max(at, r["end"])
                left += lines[at:]
                out.append(("\n".join(left), n, n - len(left), runs))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            made = [pa.array(c, kind) for c, kind in zip(cols, [pa.string(), pa.int64(), pa.int64(), pa.int64()], strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(j) for j in range(2, b.num_columns)), *made], names=names)

    kept = [F.col(f"`{c}`") for c in others]
    schema = docs.select(*kept, F.lit(None).cast("string").alias("text"), *[F.lit(0).cast("long").alias(c) for c in numbers]).schema
    return joined.select(F.col("text").cast("string").alias(t), F.col(g), *kept).mapInArrow(rebuild, schema)
