"""Helpers shared by the corpus operators: shipping the package to the
executors, tables in the shared folder, byte-level word scanning."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotline.session import ensure_checkpoint_dir

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that the
    functions of Arrow stages can be imported there whatever their path is."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    out = Path(tempfile.mkdtemp(prefix="lotline-ship-")) / "lotline_package.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    sc.addPyFile(str(out))
    _SHIPPED.add(sc.applicationId)


class Stored:
    """Tables written under ``spark.checkpoint.dir`` (a folder that all
    machines share): one computation, flat lineage, safe when executors go."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/lotline-{name}-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a table that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def whole_groups(batches, key: str, least: int):
    """Arrow batches of a partition sorted by ``key`` as tables of at least
    ``least`` rows (but for the last) that hold each of their groups whole."""
    held: list[pa.Table] = []
    rows = 0
    for b in batches:
        held.append(pa.Table.from_batches([b]))
        rows += b.num_rows
        if rows < least:
            continue
        t = pa.concat_tables(held)
        k = t.column(key).to_numpy()
        cut = len(k) - int(np.argmax(k[::-1] != k[-1])) if k[0] != k[-1] else 0
        if cut:
            yield t.slice(0, cut).combine_chunks()
        held, rows = [t.slice(cut)], len(k) - cut
    if rows:
        yield pa.concat_tables(held).combine_chunks()


FILTER_BITS = 1 << 26


def repeated_filter(hashes: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bitmap of fixed size with the bit (value modulo ``bits``) of every
    value of the one long column that occurs more than once. It only saves
    shuffling values that cannot repeat: some that don't pass too."""
    name = f"`{hashes.columns[0]}`"
    place = F.pmod(F.col(name), F.lit(bits)) + 1  # Spark numbers bits from 1 on
    twice = hashes.groupBy(F.col(name)).count().where("count > 1")
    maps = (twice.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit"))
            .groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")))
    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in maps.collect():  # bits / 8 bytes at most in all
        at = (r.bucket - 1) * len(r.bits)
        out[at: at + len(r.bits)] = np.frombuffer(bytes(r.bits), dtype=np.uint8)
    return out


def passes(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which 64-bit values have their bit in a bitmap."""
    at = values.view(np.uint64) % np.uint64(len(bitmap) * 8)
    return (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def free_name(taken, name: str) -> str:
    """``name``, with underscores behind it until no column of a table is called so."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def first_by_hash(df: DataFrame, n: int, *key: str) -> DataFrame:
    """The ``n`` rows of least hash of their key (ties: by the key). A cutoff that leaves about
    2 n rows goes first, so that no task is sent n rows by every other one."""
    h = F.xxhash64(*key)
    total = df.count()
    some = df
    if total > 2 * n:
        cut = df.where(h < F.lit(int(-(1 << 63) + (2 * n / total) * (1 << 64))))
        some = cut if cut.count() >= n else df
    return some.orderBy(h, *key).limit(n)


def row_id():
    """The id as a number that is never null: rows without an id come first."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))


def slices(batches, rows: int = 256):
    """Arrow batches in pieces of a few rows (no copy): what a stage holds at
    once as Python objects stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def text_slices(batches, column: int, most: int = 1 << 20):
    """Arrow batches in pieces (no copy) of about ``most`` bytes of a text
    column, or one row."""
    for b in batches:
        if not b.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size, dtype=np.int64) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
        for at, to in zip(cuts[:-1], cuts[1:], strict=True):
            yield b.slice(at, to - at)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts(docs: DataFrame, *extra: str) -> DataFrame:
    """doc_id and text (null: empty) alone, whatever else the table holds."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *extra)


# ---------------------------------------------------------------- byte scans

_WORD_BYTE = np.ones(256, dtype=bool)
_WORD_BYTE[[0x20, 9, 10, 11, 12, 13]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_BASE, _MASK = 0x5851F42D4C957F2D, (1 << 64) - 1
_TABLE = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64)
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS = {_BASE: np.ones(1, dtype=np.uint64), _INVERSE: np.ones(1, dtype=np.uint64)}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """_BASE (or its inverse) ** (0 .. n-1) modulo 2**64, extended by doubling when needed."""
    base = _INVERSE if inverse else _BASE
    while len(_POWERS[base]) < n:
        k = np.uint64(pow(base, len(_POWERS[base]), 1 << 64))
        _POWERS[base] = np.concatenate([_POWERS[base], _POWERS[base] * k])
    return _POWERS[base][:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of byte value * _BASE ** position: the hash of bytes i to j is
    (sums[j] - sums[i]) * _BASE ** -i, wherever in a text they stand."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_TABLE[data] * powers(len(data)), out=sums[1:])
    return sums


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = (h ^ (h >> np.uint64(30))) * _K2
    h = (h ^ (h >> np.uint64(27))) * _K1
    return h ^ (h >> np.uint64(31))


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes other than white space."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = _WORD_BYTE[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    """64-bit hash of each span of bytes (a polynomial over random byte
    values, compared at equal length, then mixed with the length)."""
    sums = prefix_sums(data) if sums is None else sums
    h = (sums[ends] - sums[starts]) * powers(len(data) + 1, inverse=True)[starts]
    return mix(h + (ends - starts).astype(np.uint64) * _K1)


def lowered(text: str) -> np.ndarray:
    """UTF-8 bytes with A-Z (alone) lower-cased."""
    return _LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)]


def shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of a text; with
    fewer words the whole sequence is one; without words, empty."""
    data = lowered(text)
    s, e = word_bounds(data)
    if not len(s):
        return np.empty(0, dtype=np.uint64)
    h = span_hashes(data, s, e)
    k = min(words, len(h))
    out = h[: len(h) - k + 1] * _K1 + np.uint64(k)
    for j in range(1, k):
        out = out * _K2 + h[j: len(h) - k + 1 + j]
    out = np.sort(mix(out))
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def hex_sha256(data: bytes) -> str:
    import hashlib

    return hashlib.sha256(data).hexdigest()
