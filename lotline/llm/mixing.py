"""Mixing a corpus to target domain weights with soft domain membership.

1. A classifier learns domains from labelled rows (doc_id, domain): byte
   3-grams hashed to ``FEATURES`` shares, softmax regression in numpy over at
   most ``TRAIN_ROWS`` labelled documents (the smallest by a hash of the id) and,
   of each domain, the first ``DOMAIN_ROWS`` by that hash. The domains are those
   of all labelled documents; a weight for any other is an error.
2. Every document gets its token count t and domain posteriors p. This small
   table is written once.
3. Projected gradient descent finds document rates r >= ``least`` for which the
   expected totals sum(r t p) match the targets in the least-squares sense,
   from equal rates. The gradient step is scaled by M = sum(t p p') over the
   rows not held at the bound: r <- max(least, r - p.g), g = M^-1 (totals -
   targets). An iteration is one aggregation over the whole table; a rate is a
   function of (p, the list of g so far), so only domain vectors travel. The
   steps up to the smallest error count; the search ends when six more bring
   none smaller (targets out of reach) or the error is below the tolerance.
4. ``copies``: the rate rounded up or down by a hash of the row, so that the
   expected number of copies is the rate.

Null and empty texts have no tokens; they get the classifier's bias as
posteriors and a rate like any other row. Repeated rows share one rate and one
number of copies. Labelled rows without a domain are not learnt from; of
several domains of an id the smallest counts. Without labelled rows there is
one domain, ``unknown``, and every rate is the total target over the tokens.
An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotline.llm.common import Stored, first_by_hash, ship, slices, texts, word_bounds

FEATURES = 512
TRAIN_ROWS = 8_000
DOMAIN_ROWS = 100
TEMPER = 0.7  # default targets: the domains' shares to this power, normalised
ITERATIONS = 40
TOLERANCE = 1e-6


def features(batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Square roots of each text's 3-gram shares, and its number of words."""
    raw = [t.encode("utf-8", "surrogatepass") for t in batch]
    data = np.frombuffer(b"".join(r + b"\n" for r in raw), dtype=np.uint8)
    doc = np.repeat(np.arange(len(raw)), [len(r) + 1 for r in raw])
    b = data.astype(np.uint32)
    h = ((b[:-2] * 961 + b[1:-1] * 31 + b[2:]) * np.uint32(2654435761) >> np.uint32(23)).astype(np.int64)  # the top 9 bits
    whole = doc[:-2] == doc[2:]
    counts = np.bincount(doc[:-2][whole] * FEATURES + h[whole], minlength=len(raw) * FEATURES).reshape(len(raw), FEATURES)
    starts, _ = word_bounds(data)
    tokens = np.bincount(doc[starts], minlength=len(raw))
    return np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)).astype(np.float32), tokens


@dataclass
class Domains:
    """The classifier: names, and softmax weights (the last row is the bias)."""

    names: list[str]
    weights: np.ndarray

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights[:-1] + self.weights[-1]
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return (e / e.sum(axis=1, keepdims=True)).astype(np.float64)


def _softmax_regression(x: np.ndarray, y: np.ndarray, classes: int, epochs: int = 40) -> np.ndarray:
    rng = np.random.default_rng(11)
    x = np.concatenate([x, np.ones((len(x), 1), dtype=np.float32)], axis=1).astype(np.float64)
    w = np.zeros((x.shape[1], classes))
    m, v, t = np.zeros_like(w), np.zeros_like(w), 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 128)):
            z = x[rows] @ w
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            g = x[rows].T @ p / len(rows) + 1e-5 * w
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w.astype(np.float32)


def fit_domains(docs: DataFrame, labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> Domains:
    """Learn domains from ``labelled`` (doc_id, domain) and those documents' texts."""
    ship(docs.sparkSession)
    every = (labelled.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("domain").cast("string").alias("domain"))
             .where("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
             .join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi").withColumn("h", F.xxhash64("doc_id")))
    every = Stored(docs.sparkSession, "mixing").put(every, "labelled")
    names = sorted(r.domain for r in every.select("domain").distinct().collect()) or ["unknown"]
    some = first_by_hash(every, train_rows, "doc_id")
    each = every.withColumn("part", F.pmod("h", F.lit(64)))
    for key in (["domain", "part"], ["domain"]):  # the first of each part, then of these: no task meets a whole domain
        rank = F.row_number().over(Window.partitionBy(*key).orderBy("h", "doc_id"))
        each = each.withColumn("rank", rank).where(F.col("rank") <= DOMAIN_ROWS).drop("rank")
    each = each.drop("part")
    usable = some.unionByName(each).select("doc_id", "domain").distinct()

    def run(batches):
        for b in slices(batches):
            x, _ = features(b.column(1).to_pylist())
            v = pa.array([r.tobytes() for r in x], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), v], names=["doc_id", "domain", "v"])

    rows = texts(docs).join(F.broadcast(usable), "doc_id").select("doc_id", "text", "domain")  # train_rows ids at most, and DOMAIN_ROWS a domain
    got = (rows.mapInArrow(run, "doc_id long, domain string, v binary").groupBy("doc_id", "domain").agg(F.min("v").alias("v"))
           .orderBy("doc_id").collect())
    if len(names) == 1:
        return Domains(names, np.zeros((FEATURES + 1, 1), dtype=np.float32))
    x = np.stack([np.frombuffer(bytes(r.v), dtype=np.float32) for r in got])
    return Domains(names, _softmax_regression(x, np.array([names.index(r.domain) for r in got]), len(names)))


def memberships(df: DataFrame, domains: Domains, text: str = "text") -> DataFrame:
    """``df`` with __tokens (long) and __p (array of posteriors)."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(domains)
    names = [*df.columns, "__tokens", "__p"]

    def run(batches):
        for b in slices(batches):
            d = shared.value
            x, tokens = features([t or "" for t in b.column(0).to_pylist()])
            p = pa.FixedSizeListArray.from_arrays(pa.array(d.posteriors(x).ravel()), len(d.names)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(1, b.num_columns)), pa.array(tokens, pa.int64()), p], names=names)

    kept = [F.col(f"`{c}`") for c in df.columns]
    schema = df.select(*kept, F.lit(0).cast("long").alias("__tokens"), F.array(F.lit(0.0)).alias("__p")).schema
    return df.select(F.col(f"`{text}`").cast("string").alias("__text"), *kept).mapInArrow(run, schema)


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


@dataclass
class Rates:
    """A fitted mixture: rates are a function of a document's posteriors."""

    domains: Domains
    least: float
    start: float = 1.0
    steps: list[list[float]] = field(default_factory=list)
    targets: list[float] = field(default_factory=list)
    available: list[float] = field(default_factory=list)
    totals: list[float] = field(default_factory=list)

    def column(self, p="__p"):
        """The rate of a row with posteriors ``p``: the gradient steps, replayed."""
        r = F.lit(float(self.start))
        if not self.steps:
            return r
        steps = F.array(*[F.array(*[F.lit(float(x)) for x in g]) for g in self.steps])
        return F.aggregate(steps, r, lambda at, g: F.greatest(F.lit(float(self.least)), at - _dot(F.col(p), g)))


def fit_rates(table: DataFrame, domains: Domains, weights: dict[str, float] | None = None, budget: float | None = None,
              least: float = 0.0, tolerance: float = TOLERANCE, iterations: int = ITERATIONS) -> Rates:
    """Rates for a table with __tokens and __p.

    ``weights``: target share of each domain (default: tempered shares).
    ``budget``: target total of tokens; None: as many as there are, or, where
    ``least`` is positive, the smallest total whose targets need no rate below it."""
    if unknown := sorted(set(weights or {}) - set(domains.names)):
        raise ValueError(f"weights for domains without labelled documents: {unknown}")
    k = len(domains.names)
    t = F.col("__tokens").cast("double")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def sums(rate):
        """Expected totals at these rates, and the Gram matrix of the rows not held at the bound."""
        free = t * F.when(rate > least, 1.0).otherwise(0.0) if least < fitted.start else t
        row = table.withColumn("__rate", rate).select(*[F.sum(F.col("__rate") * t * F.col("__p")[i]) for i in range(k)],
                                                      *[F.sum(free * F.col("__p")[i] * F.col("__p")[j]) for i, j in pairs]).first()
        gram = np.zeros((k, k))
        for (i, j), x in zip(pairs, row[k:], strict=True):
            gram[i, j] = gram[j, i] = x or 0.0
        return np.array([x or 0.0 for x in row[:k]]), gram

    fitted = Rates(domains, least)
    available, gram = sums(F.lit(1.0))
    all_tokens = available.sum()
    if not all_tokens:
        return fitted
    share = np.array([weights.get(n, 0.0) for n in domains.names]) if weights is not None else (available / all_tokens) ** TEMPER
    share = share / share.sum() if share.sum() else np.full(k, 1 / k)
    if budget is None:
        budget = max((least * a / s for a, s in zip(available, share, strict=True) if s), default=all_tokens) if least else all_tokens
    target = share * budget
    fitted.start = max(least, budget / all_tokens)
    fitted.targets, fitted.available = target.tolist(), available.tolist()
    best, kept = np.inf, []
    for _ in range(iterations):
        total, gram = sums(fitted.column())
        error = target - total
        if (size := float(np.abs(error).max())) < best:
            best, kept, fitted.totals = size, list(fitted.steps), total.tolist()
        if size <= tolerance * budget or len(fitted.steps) - len(kept) >= 6:
            break
        fitted.steps.append((np.linalg.pinv(gram, rcond=1e-9, hermitian=True) @ -error).tolist())
    fitted.steps = kept
    return fitted


def copies(rate, *key):
    """Whole number of copies whose expectation is the rate: the fraction is
    compared with a hash of the row."""
    u = F.pmod(F.xxhash64(*key), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + F.when(u < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float] | None = None, budget: float | None = None, least: float = 0.0):
    """doc_id, n_tokens, domain (the likeliest), posteriors, rate and copies of
    every document, and the fitted rates."""
    domains = fit_domains(docs, labelled)
    table = Stored(docs.sparkSession, "mixing").put(memberships(texts(docs), domains).select("doc_id", F.xxhash64("text").alias("key"), "__tokens", "__p"), "memberships")
    fitted = fit_rates(table, domains, weights, budget, least)
    names = F.array(*[F.lit(n) for n in domains.names])
    rated = table.withColumn("rate", fitted.column())
    return rated.select("doc_id", F.col("__tokens").alias("n_tokens"), F.element_at(names, F.array_position("__p", F.array_max("__p")).cast("int")).alias("domain"),
                        F.col("__p").alias("posteriors"), "rate", copies(F.col("rate"), F.col("doc_id"), F.col("key")).alias("copies")), fitted


def resample(docs: DataFrame, labelled: DataFrame, weights: dict[str, float] | None = None, budget: float | None = None, least: float = 0.0) -> DataFrame:
    """The documents (all their columns), each as often as its copies say."""
    domains = fit_domains(docs, labelled)
    table = Stored(docs.sparkSession, "mixing").put(memberships(docs.select("text"), domains).select("__tokens", "__p"), "memberships")
    fitted = fit_rates(table, domains, weights, budget, least)
    others = [c for c in docs.columns if c != "text"]  # as one struct: no name can clash
    held = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"))
    rated = memberships(held, domains).withColumn("copies", copies(fitted.column(), F.col("doc_id"), F.xxhash64("text")))
    every = rated.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return every.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
