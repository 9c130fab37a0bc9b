"""Removal of earlier-seen byte strings by longest previous factors.

A byte goes when it lies in a string of ``LENGTH`` bytes that also starts
earlier: in a document with a smaller id, or further up in the same document.

One suffix array over a corpus is out of reach, but a string of ``LENGTH``
bytes holds an anchor: the smallest hash (leftmost) of the ``GRAM``-byte grams
in it. Equal strings have equal anchors at equal offsets, so only strings of one
anchor need comparing. The starts that share an anchor occurrence are
consecutive; with the bytes that their strings cover they form a segment.

1. Anchors that occur once in the corpus have nothing to compare: anchors are
   counted, the repeated ones become a bitmap of fixed size (``common.FILTER_BITS``).
2. Segments of repeated anchors are grouped by (anchor, hash of the segment);
   all occurrences but the first go whole. Counts and firsts are
   pre-aggregated, so passages in a third of all documents are no hot group.
3. Where an anchor has several different segments, one of each (the first)
   enters a suffix array: the strings are sorted, and longest previous factors
   are read off previous and next smaller positions with the common prefixes
   of neighbours. A start whose factor has ``LENGTH`` bytes is a repeat.
   (Strings that start at different distances from their anchor are unequal,
   so a large group is sorted distance by distance.) Anchors of more than
   ``HOT`` different segments are not brought into one task: their strings
   are grouped by a 128-bit digest instead.
4. Documents are joined with their removed ranges.

Every string of every whole document is judged on the input as it stands.
Null texts count as empty. Documents of one id are ordered by a hash of the
text; rows equal in id and text count as one document and lose the same bytes.
Rows without an id come first. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotline.llm.common import Stored, free_name, mix, passes, powers, prefix_sums, repeated_filter, row_id, ship, slices, span_hashes, whole_groups

LENGTH = 100
GRAM = 32
HOT = 20_000
PIECE = 1 << 22  # window starts handled at once
BATCH_ROWS = 3_000  # segments that are looked at together; a segment has some 35 strings
SORTED = 100_000  # strings that are sorted together, if they are not all at one distance from their anchors


def segments(data: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Arrays of one row a segment: anchor hash, segment hash, first start,
    number of starts, offset of the anchor from the first start."""
    empty = tuple(np.empty(0, dtype=np.int64) for _ in range(5))
    if len(data) < length:
        return empty
    sums, inverse = prefix_sums(data), powers(len(data) - gram + 1, inverse=True)
    grams = mix((sums[gram:] - sums[:-gram]) * inverse)
    width, found = length - gram + 1, []
    for base in range(0, len(data) - length + 1, PIECE):
        h = grams[base: base + PIECE + width - 1]
        low = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)  # leftmost of equal hashes
        span = 1
        while span * 2 <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < width:
            low = np.minimum(low[: len(low) - (width - span)], low[width - span:])
        at = (low & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        count = np.diff(np.append(first, len(at)))
        found.append((h[at[first]].view(np.int64), first + base, count, at[first] - first))
    anchor, first, count, offset = (np.concatenate(x) for x in zip(*found, strict=True))
    whole = span_hashes(data, first, first + count - 1 + length, sums)
    return anchor, mix(whole ^ (offset.astype(np.uint64) << np.uint64(48))).view(np.int64), first, count, offset


def longest_previous_factors(strings: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each of some strings of one length (a matrix of bytes): the longest
    prefix that it shares with one of smaller rank. The strings are sorted;
    the nearest strings of smaller rank before and after bound the answer."""
    n, length = strings.shape
    order = np.argsort(np.ascontiguousarray(strings).view(f"S{length}").ravel(), kind="stable")
    differ = strings[order[1:]] != strings[order[:-1]]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
    out = np.zeros(n, dtype=np.int64)
    # common prefixes with the previous smaller ranks, kept on a stack; an
    # element leaves the stack when its next smaller rank arrives
    ranks, places, lows = [], [], []
    for place, low in zip(order.tolist(), [0, *common.tolist()], strict=True):
        r = rank[place]
        while ranks and ranks[-1] > r:
            ranks.pop()
            other = places.pop()
            if low > out[other]:
                out[other] = low
            low = min(low, lows.pop())
        # ``low`` is now the prefix shared with the previous smaller rank, if there is one
        if ranks and low > out[place]:
            out[place] = low
        ranks.append(r)
        places.append(place)
        lows.append(low)
    return out


def _ranges(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Byte ranges covered by the strings at ascending starts."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length) + 1
    return [(int(s[0]), int(s[-1]) + length) for s in np.split(starts, cut)]


def repeated_ranges(docs: DataFrame, keep: Stored, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """id, key (a hash of the text) and gone: byte ranges (start, end) to
    remove, of every document that loses some."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(row_id().alias("id"), F.xxhash64("text").alias("key"), F.col("text").cast("string").alias("text")).where("text is not null")

    def anchors(batches):
        for b in slices(batches):
            found = [segments(np.frombuffer(t.encode("utf-8", "surrogatepass"), dtype=np.uint8), length, gram)[0] for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found) if found else [], pa.int64())], names=["anchor"])

    repeated = spark.sparkContext.broadcast(repeated_filter(rows.select("text").mapInArrow(anchors, "anchor long")))

    def occurrences(bitmap, with_bytes):
        names = ["anchor", "segment", "id", "key", "first", "n", *(["offset", "bytes"] if with_bytes else [])]

        def run(batches):
            for b in slices(batches):
                parts, raw = [], []
                for i, key, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    data = np.frombuffer(t.encode("utf-8", "surrogatepass"), dtype=np.uint8)
                    found = segments(data, length, gram)
                    may = passes(bitmap.value, found[0])
                    anchor, segment, first, n, offset = (x[may] for x in found)
                    parts.append((anchor, segment, np.full(len(n), i), np.full(len(n), key), first, n, offset))
                    if with_bytes:
                        raw += [data[s: s + c - 1 + length].tobytes() for s, c in zip(first.tolist(), n.tolist(), strict=True)]
                cols = [np.concatenate(x) for x in zip(*parts, strict=True)]
                kinds = [pa.int64()] * 4 + [pa.int32()] * 3
                out = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*out, pa.array(raw, pa.binary())] if with_bytes else out[:6], names=names)

        kinds = "anchor long, segment long, id long, key long, first int, n int" + (", offset int, bytes binary" if with_bytes else "")
        return rows.mapInArrow(run, kinds)

    place = F.struct("id", "key", "first")
    seen = keep.put(occurrences(repeated, False), "segments")
    firsts = keep.put(seen.groupBy("anchor", "segment").agg(F.min(place).alias("kept"), F.count(F.lit(1)).alias("times")), "firsts")
    copies = seen.join(firsts.where("times > 1").select("anchor", "segment", "kept"), ["anchor", "segment"]).where(place > F.col("kept"))
    gone = copies.select("id", "key", F.col("first").alias("start"), (F.col("first") + F.col("n") - 1 + length).alias("end"))

    # anchors of several different segments
    kinds = firsts.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    several = spark.sparkContext.broadcast(repeated_filter(firsts.select("anchor")))
    one = occurrences(several, True).groupBy("anchor", "offset", "bytes").agg(F.min(F.struct("id", "key", "first", "n")).alias("f"))
    one = keep.put(one.join(kinds, "anchor").select("anchor", "kinds", "offset", "bytes", "f.*"), "different")

    def factors(batches):
        def told(group):
            i, key, first, n, offset = (group.column(c).to_numpy() for c in ("id", "key", "first", "n", "offset"))
            lengths = n + length - 1
            data = np.frombuffer(b"".join(group.column("bytes").to_pylist()), dtype=np.uint8)
            begins = np.cumsum(lengths) - lengths
            row = np.repeat(np.arange(len(n)), n)
            step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start, distance = first[row] + step, offset[row] - step
            rank = np.empty(len(row), dtype=np.int64)
            rank[np.lexsort((start, key[row], i[row]))] = np.arange(len(row))
            hit = np.zeros(len(row), dtype=bool)
            by_distance = np.argsort(distance, kind="stable")
            ends = np.cumsum(np.bincount(distance, minlength=length))
            low = 0
            while low < len(row):  # as many distances as fit, one at least
                high = max(int(ends[ends <= low + SORTED].max(initial=0)), int(ends[ends > low].min()))
                at = by_distance[low:high]
                strings = data[(begins[row[at]] + step[at])[:, None] + np.arange(length)]
                hit[at] = longest_previous_factors(strings, rank[at]) >= length
                low = high
            out = []
            at = np.flatnonzero(hit)
            for s in np.split(at, np.flatnonzero(np.diff(row[at])) + 1):
                if len(s):
                    out += [(int(i[row[s[0]]]), int(key[row[s[0]]]), a, e) for a, e in _ranges(start[s], length)]
            cols = list(zip(*out, strict=True)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64(), pa.int64(), pa.int32(), pa.int32()], strict=True)], names=["id", "key", "start", "end"])

        for t in whole_groups(batches, "anchor", BATCH_ROWS):
            yield told(t)

    small = one.where(F.col("kinds") <= hot).select("anchor", "id", "key", "first", "n", "offset", "bytes")
    parted = small.repartition("anchor").sortWithinPartitions("anchor")
    found = parted.mapInArrow(factors, "id long, key long, start int, end int")

    step = F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("step")
    large = one.where(F.col("kinds") > hot).select("id", "key", "first", "bytes", step)
    text = F.expr(f"substring(bytes, step + 1, {length})")
    large = large.select("id", "key", (F.col("first") + F.col("step")).alias("start"), F.xxhash64(text).alias("h"), F.md5(text).substr(1, 16).alias("m"))
    spot = F.struct("id", "key", "start")
    early = large.groupBy("h", "m").agg(F.min(spot).alias("kept"), F.max(spot).alias("last")).where("kept < last").drop("last")
    late = large.join(early, ["h", "m"]).where(spot > F.col("kept")).select("id", "key", "start", (F.col("start") + length).alias("end"))
    every = gone.unionByName(found).unionByName(late)
    made = keep.put(every.groupBy("id", "key").agg(F.collect_list(F.struct("start", "end")).alias("gone")), "gone")
    for name in ("segments", "firsts", "different"):
        keep.drop(name)
    return made


def merged(ranges) -> list[tuple[int, int]]:
    """Maximal runs of the bytes in some (start, end) ranges."""
    out: list[list[int]] = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def drop_repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """``docs`` without text, with kept (the remaining bytes; cuts may fall
    inside a character), n_bytes (before) and gone (maximal removed runs)."""
    keep = Stored(docs.sparkSession, "suffixes")
    i, k, di, dk, g, text = (free_name(docs.columns, c) for c in ("__i", "__k", "__id", "__key", "__gone", "__text"))
    ranges = repeated_ranges(docs, keep, length, gram, hot).select(F.col("id").alias(di), F.col("key").alias(dk), F.col("gone").alias(g))
    # documents that lose nothing need not be shuffled: a bitmap of fixed size says which those may be
    mark = F.xxhash64(di, dk)
    losing = docs.sparkSession.sparkContext.broadcast(repeated_filter(ranges.select(mark.alias("m")).unionAll(ranges.select(mark.alias("m")))))
    may_lose = F.pandas_udf(lambda m: pd.Series(passes(losing.value, m.to_numpy())), "boolean")
    marked = docs.withColumns({i: row_id(), k: F.coalesce(F.xxhash64("text"), F.lit(0))})
    may = may_lose(F.xxhash64(i, k))
    whole = marked.where(~may).withColumn(g, F.lit(None).cast("array<struct<start:int,end:int>>"))
    joined = marked.where(may).join(ranges, (F.col(i) == F.col(di)) & (F.col(k) == F.col(dk)), "left").drop(di, dk).unionByName(whole)
    others = [c for c in docs.columns if c not in ("text", "kept", "n_bytes", "gone")]
    names = [*others, "kept", "n_bytes", "gone"]
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def cut(batches):
        for b in slices(batches):
            kept, size, gone = [], [], []
            for t, ranges in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = (t or "").encode("utf-8", "surrogatepass")
                runs = merged((r["start"], r["end"]) for r in ranges or [])
                at, left = 0, []
                for s, e in runs:
                    left.append(raw[at:s])
                    at = e
                left.append(raw[at:])
                kept.append(b"".join(left))
                size.append(len(raw))
                gone.append([{"start": s, "end": e} for s, e in runs])
            made = [pa.array(kept, pa.binary()), pa.array(size, pa.int64()), pa.array(gone, span)]
            yield pa.RecordBatch.from_arrays([*(b.column(j) for j in range(2, b.num_columns)), *made], names=names)

    columns = [F.col(f"`{c}`") for c in others]
    schema = docs.select(*columns, F.lit(b"").cast("binary").alias("kept"), F.lit(0).cast("long").alias("n_bytes"),
                         F.lit(None).cast("array<struct<start:int,end:int>>").alias("gone")).schema
    return joined.select(F.col("text").cast("string").alias(text), g, *columns).mapInArrow(cut, schema)
