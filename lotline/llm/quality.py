"""Quality scores from random-indexing word vectors and a small network.

* Words (runs of letters, of digits, of other signs) hash into ``BUCKETS``
  rows. Each row has a fixed sparse random index vector; a word's context
  vector is the sum of the index vectors of the words within ``WINDOW`` places
  of it, over ALL documents: each task sums its own, Spark adds the sums up by
  row, and the table (``BUCKETS`` x ``DIMS`` floats, 2 MB whatever the corpus)
  is broadcast.
* A document is the mean and the spread of its words' unit context vectors.
* A two-layer network learns the labels of at most ``TRAIN_ROWS`` labelled
  documents (the smallest by a hash of the id; documented bound), none of them
  held out; a tenth of those sets the temperature that calibrates its
  probabilities. Training takes a second or two on the driver.

A label counts only where its document's crc32(id) mod 3 is not 1. Neither
labels, language, source nor id is an input of a score. Null and empty texts
have the zero vector and get the score of that. Rows with a null label are not
learnt from; of several labels of an id the smallest counts. Repeated rows get
equal scores. With labels of one class only, or none, the score is that
class's share (0.5 without labels).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotline.llm.common import first_by_hash, free_name, mix, powers, prefix_sums, ship, text_slices, texts

BUCKETS = 16_384
DIMS = 32
NONZERO = 4
WINDOW = 2
HIDDEN = 24
TRAIN_ROWS = 20_000
SEED = 7
PIECE_BYTES = 1 << 16  # of text that a task works on at once: a worker keeps tables of that size

_CLASS = np.full(256, 3, dtype=np.int8)  # other signs
_CLASS[[0x20, 9, 10, 11, 12, 13]] = 0
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[48:58] = 2


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero entries of each row's index vector."""
    rng = np.random.default_rng(SEED)
    places = rng.random((BUCKETS, DIMS)).argsort(axis=1)[:, :NONZERO]
    return places, rng.choice([-1.0, 1.0], size=(BUCKETS, NONZERO))


def words_of(batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Row and document number of each word of a few texts, in order."""
    raw = [t.encode("utf-8", "surrogatepass") for t in batch]
    data = np.frombuffer(b"\n".join(raw), dtype=np.uint8)
    if not len(data):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    kind = _CLASS[data]
    change = np.flatnonzero(np.diff(kind)) + 1
    starts = np.concatenate([[0], change])
    ends = np.concatenate([change, [len(data)]])
    inside = kind[starts] > 0
    starts, ends = starts[inside], ends[inside]
    sums = prefix_sums(data)
    h = mix((sums[ends] - sums[starts]) * powers(len(data) + 1, inverse=True)[starts])
    limits = np.cumsum([len(r) + 1 for r in raw])
    return (h % np.uint64(BUCKETS)).astype(np.int64), np.searchsorted(limits, starts, side="right")


def context_vectors(docs: DataFrame) -> np.ndarray:
    """The context table over all documents, rows of unit length (or zero)."""
    ship(docs.sparkSession)

    def run(batches):
        places, signs = index_vectors()
        total = np.zeros(BUCKETS * DIMS)
        for b in text_slices(batches, 0, 8 * PIECE_BYTES):
            w, doc = words_of(b.column(0).to_pylist())
            for step in range(1, WINDOW + 1):
                near = doc[step:] == doc[:-step]
                x, y = w[:-step][near], w[step:][near]
                for a, c in ((x, y), (y, x)):
                    keys = (a[:, None] * DIMS + places[c]).ravel()
                    total += np.bincount(keys, signs[c].ravel(), minlength=BUCKETS * DIMS)
        table = total.reshape(BUCKETS, DIMS)
        used = np.flatnonzero(table.any(axis=1))
        vectors = pa.FixedSizeListArray.from_arrays(pa.array(table[used].ravel()), DIMS).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), vectors], names=["row", "v"])

    parts = texts(docs).select("text").mapInArrow(run, "row int, v array<double>")
    sums = parts.groupBy("row").agg(*[F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(DIMS)])
    out = np.zeros((BUCKETS, DIMS), dtype=np.float64)
    got = sums.toPandas().to_numpy(dtype=np.float64)  # BUCKETS rows at most
    if len(got):
        out[got[:, 0].astype(int)] = got[:, 1:]
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm > 0, norm, 1)).astype(np.float32)


def pooled(batch: list[str], table: np.ndarray) -> np.ndarray:
    """Mean and spread of each text's word vectors; zeros for a text without words."""
    w, doc = words_of(batch)
    out = np.zeros((len(batch), 2 * DIMS), dtype=np.float64)
    if len(w):
        v = table[w]
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        n = np.diff(np.append(first, len(doc)))[:, None]
        mean = np.add.reduceat(v, first, axis=0, dtype=np.float64) / n
        square = np.add.reduceat(v * v, first, axis=0, dtype=np.float64) / n
        out[doc[first]] = np.concatenate([mean, np.sqrt(np.maximum(square - mean**2, 0))], axis=1)
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Network:
    """Two layers: tanh units, then one logit divided by the temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, epochs: int = 60, batch: int = 128):
        rng = np.random.default_rng(SEED)
        self.share = float(y.mean()) if len(y) else 0.5
        self.mean, self.scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (0.0, 1.0)
        self.layers = None
        if len(set(y.tolist())) < 2 or len(y) < 20:
            return
        order = rng.permutation(len(y))
        check, fit = order[: len(y) // 10], order[len(y) // 10:]
        z = (x - self.mean) / self.scale
        p = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, v, t = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
        for epoch in range(epochs):
            rate = 0.01 * 0.5 * (1 + np.cos(np.pi * epoch / epochs)) + 1e-5
            for rows in np.array_split(rng.permutation(fit), max(1, len(fit) // batch)):
                h = np.tanh(z[rows] @ p[0] + p[1])
                err = (_sigmoid(h @ p[2] + p[3]) - y[rows]) / len(rows)
                back = np.outer(err, p[2]) * (1 - h * h)
                t += 1
                for i, g in enumerate([z[rows].T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ err + 1e-4 * p[2], err.sum(keepdims=True)]):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    p[i] -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        self.layers = p
        logit = self._logit(x[check])
        losses = {c: -np.mean(np.log(np.where(y[check] == 1, q := _sigmoid(logit / c), 1 - q) + 1e-12)) for c in np.geomspace(0.25, 8, 60)}
        self.temperature = min(losses, key=losses.get)

    def _logit(self, x: np.ndarray) -> np.ndarray:
        p = self.layers
        return np.tanh((x - self.mean) / self.scale @ p[0] + p[1]) @ p[2] + p[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(x), self.share)
        return _sigmoid(self._logit(x) / self.temperature)


def held_out(doc_id):
    """Whether a document's label is never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[np.ndarray, Network]:
    """Context vectors over all documents, and a network over a bounded set of labelled ones."""
    table = context_vectors(docs)
    shared = docs.sparkSession.sparkContext.broadcast(table)
    usable = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
              .where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
              .groupBy("doc_id").agg(F.min("quality").alias("quality")))
    usable = first_by_hash(usable, train_rows, "doc_id")

    def run(batches):
        for b in text_slices(batches, 1, PIECE_BYTES):
            x = pooled(b.column(1).to_pylist(), shared.value)
            v = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 2 * DIMS).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), v, b.column(2)], names=["doc_id", "v", "quality"])

    rows = texts(docs).join(F.broadcast(usable), "doc_id").select("doc_id", "text", "quality")  # train_rows ids at most
    got = (rows.mapInArrow(run, "doc_id long, v array<double>, quality int")
           .groupBy("doc_id").agg(F.min_by("v", "v").alias("v"), F.min("quality").alias("quality")).orderBy("doc_id").collect())
    x = np.array([r.v for r in got], dtype=np.float64).reshape(len(got), 2 * DIMS)
    return table, Network(x, np.array([r.quality for r in got], dtype=np.float64))


def score(df: DataFrame, model: tuple[np.ndarray, Network], text: str = "text", out: str = "score") -> DataFrame:
    """``df`` with the probability of a high-quality text in column ``out``."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    others = [c for c in df.columns if c != out]

    def run(batches):
        table, network = shared.value
        for b in text_slices(batches, 0, PIECE_BYTES):
            s = network.score(pooled([t or "" for t in b.column(0).to_pylist()], table))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(1, b.num_columns)), pa.array(s, pa.float64())], names=[*others, out])

    kept = [F.col(f"`{c}`") for c in others]
    schema = df.select(*kept).withColumn(out, F.lit(0.0).cast("double")).schema
    return df.select(F.col(f"`{text}`").cast("string").alias(free_name(df.columns, "__text")), *kept).mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents (all their columns) whose score is at least ``least``."""
    name = free_name(docs.columns, "__quality_score")
    return score(docs, fit(docs, labels), out=name).where(F.col(name) >= least).drop(name)
