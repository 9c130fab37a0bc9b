"""Threshold-scaled document sketches.

A text's sketch holds every shingle hash below a fixed fraction of the hash
range. Since the threshold doesn't depend on the text, sketches of parts merge
by union, and the share of a small document's sketch that a large one holds
estimates containment however unequal the two are; ``resemblance`` estimates
the Jaccard similarity.

Shingles are runs of ``SHINGLE`` bytes of the UTF-8 text (a shorter text is one
shingle), so that edits of any kind change only the shingles around them. A
text of which no hash lies below the threshold keeps its smallest one, only to tell it from
others: it takes part in no union and no estimate of containment. The
empty text has the empty sketch. Equal texts have equal sketches.

``with_next`` pairs every document with the one that follows in id order. The
order is cut into ranges at approximate quantiles of the id; each range
receives a copy of the first document of the next range, so each range is
sorted on its own, and texts are shuffled once.

Null texts count as empty. Documents of one id are ordered by text. Rows
without an id come first. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotline.llm.common import mix, powers, prefix_sums, ship, slices, texts

SHINGLE = 9
FRACTION = 1 / 16
RANGE_ROWS = 4_000
MOST_RANGES = 4_096


def _limit(fraction: float) -> np.uint32:
    return np.uint32(min(2**32 - 1, int(fraction * 2**32)))


def sketch(text: str, fraction: float = FRACTION, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 32-bit shingle hashes below ``fraction`` of their range."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    n = len(data)
    if not n:
        return np.empty(0, dtype=np.uint32)
    k = min(width, n)
    sums = prefix_sums(data)
    h = (sums[k:] - sums[: n - k + 1]) * powers(n - k + 1, inverse=True)
    h = (mix(h) >> np.uint64(32)).astype(np.uint32)
    kept = h[h < _limit(fraction)]
    return np.unique(kept if len(kept) else h.min(keepdims=True))


def as_string(s: np.ndarray) -> str:
    """Eight hex digits a hash, ascending."""
    return s.astype(">u4").tobytes().hex()


def of_string(s: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(s), dtype=">u4").astype(np.uint32)


def resemblance(a: np.ndarray, b: np.ndarray) -> float:
    """Estimate of the Jaccard similarity of two texts' shingles; of two empty texts 1."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    either = len(a) + len(b) - both
    return both / either if either else 1.0


def below(s: np.ndarray, fraction: float = FRACTION) -> np.ndarray:
    """The hashes of a sketch that lie below the threshold: a fair sample of the text's."""
    return s[s < _limit(fraction)]


def containment(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION) -> float:
    """Estimate of the share of a's shingles that b has; of an empty text and of an equal
    sketch 1. NaN where a has no hash below the threshold: nothing is known of it then."""
    if not len(a) or np.array_equal(a, b):
        return 1.0
    sample = below(a, fraction)
    return len(np.intersect1d(sample, b, assume_unique=True)) / len(sample) if len(sample) else float("nan")


def merge(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION) -> np.ndarray:
    """The sketch of two texts' shingles together."""
    both = np.union1d(a, b)
    sample = below(both, fraction)
    return sample if len(sample) else both[:1]


def with_next(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, text, next_text: of the next document by id; after the last, of the first."""
    rows = texts(docs)
    known = rows.select(F.count(F.lit(1)).alias("n")).first().n
    cuts = min(MOST_RANGES, max(1, known // range_rows))
    marks = rows.select(F.percentile_approx("doc_id", [i / cuts for i in range(1, cuts)], 20 * cuts).alias("m")).first().m if cuts > 1 else []
    marks = sorted({m for m in marks or [] if m is not None})
    part = F.lit(0)
    if marks:  # how many marks are at or below the id
        found = F.array_size(F.filter(F.lit(marks).cast("array<long>"), lambda m: m <= F.col("doc_id")))
        part = F.coalesce(found, F.lit(0))
    rows = rows.withColumn("part", part.cast("int"))
    # the first document of each range (a few thousand rows at most), told to the range before
    firsts = rows.groupBy("part").agg(F.min(F.struct("doc_id", "text")).alias("f"))
    order = Window.orderBy("part")
    heads = firsts.select(F.coalesce(F.lag("part").over(order), F.max("part").over(Window.partitionBy())).alias("part"),
                          F.col("f.doc_id").alias("doc_id"), F.col("f.text").alias("text"), F.lit(True).alias("head"))
    both = rows.withColumn("head", F.lit(False)).unionByName(heads)
    within = Window.partitionBy("part").orderBy("head", F.col("doc_id").asc_nulls_first(), "text")
    return (both.withColumn("next_text", F.lead("text").over(within)).where(~F.col("head")).select("doc_id", "text", "next_text"))


def fingerprint_documents(pairs: DataFrame, fraction: float = FRACTION, width: int = SHINGLE) -> DataFrame:
    """For rows (doc_id, text, next_text): the sketch of the text, of the text
    with its last quarter replaced by as much of the next text's start, and
    how alike the text's is to that and to the next text's."""
    ship(pairs.sparkSession)
    schema = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    fields = ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches):
        for b in slices(batches):
            out = []
            for t, after in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                part = len(t) // 4
                edited = t[: len(t) - part] + after[:part]
                a, e, x = (sketch(s, fraction, width) for s in (t, edited, after))
                out.append((len(t), edited, as_string(a), as_string(e), resemblance(a, e), resemblance(a, x)))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=fields)

    return pairs.select("doc_id", "text", F.coalesce("next_text", F.lit("")).alias("next_text")).mapInArrow(run, schema)
