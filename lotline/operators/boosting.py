"""Gradient-boosted regression trees on histograms, many models at once.

Squared error, second-order gains with L1 and L2 terms, a least gain (gamma), a
least number of rows a child, rows and columns drawn for each tree: the usual
parameters of an extreme gradient booster.

1. ``layouts``: one aggregation gives the quantile cuts, medians and categories of
   every data set (a data set is a segment, a fold, ...). A categorical feature
   stands for its one-hot columns: each category is a column that can be drawn
   and split on; categories unknown in training are none of them.
2. ``blocks``: rows become cell numbers before they are shuffled, packed into blocks of at
   most ``BLOCK_ROWS`` rows of one data set (a count decides how many, a hash of the id which).
3. ``fit``: a data set of at most ``TASK_ROWS`` rows (cell numbers of one or two bytes) is learned
   from in one task a model, so that all models of all seeds, folds and trials run side by
   side in one job (``kernel``; ``grow`` is the same in numpy); the task adds gradients up for
   the smaller of two children and subtracts. If that would copy more than ``COPY_ROWS`` rows, models of a
   data set share tasks. Of a larger data set, all models grow level by level together: every block adds its
   gradients up by (model, node, cell), Spark adds up the blocks, and the driver
   picks the splits from at most nodes * cells sums. Gradients are integers
   (multiples of 2**-20), so sums are exact and both ways give the same trees.
4. ``score``: forests meet the blocks of their data set; no model passes the driver.

Every draw is a function of (seed, tree, row id), so a lost task is repeated
with the same result. NULL numbers become the training median, NULL categories the
most frequent one (ties: the smallest); a column without values never splits.
"""

from __future__ import annotations

import io
import json
import struct
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotline.operators import kernel
from lotline.operators.quantiles import exact_quantiles
from lotline.session import discard, materialize, ship_package

BLOCK_ROWS = 250_000
TASK_ROWS = 12_000_000  # of a data set that one task a model learns from: about 65 bytes a row with 25 features
TASK_CELLS = 1_000_000_000  # of those rows
NUMPY_ROWS = 2_000_000  # the same without the kernel
COPY_ROWS = 20_000_000  # rows of all models; beyond, models of a data set share tasks
CUT_ROWS = 50_000  # that become cells at once
SKETCHES = 200  # of quantiles that a task holds at once
CHUNK_ROWS = 16_384  # whose cells are added up or walked through at once
CELLS = 64  # of a numeric feature
MAX_CATEGORIES = 100_000  # of all features and data sets together; more is an error
SCALE = float(1 << 20)
STORE_TREES = 20  # margins of large data sets are stored after so many trees
LEAST_GAIN = 1e-6
SCORE_PARTS = 32  # that the models of a block are dealt out to at most


@dataclass(frozen=True)
class Trees:
    """Parameters of one model."""

    n_estimators: int = 400
    learning_rate: float = 0.05
    max_depth: int = 5
    min_child_weight: float = 1.0
    subsample: float = 0.8
    colsample_bytree: float = 0.8
    gamma: float = 0.0
    reg_alpha: float = 0.0
    reg_lambda: float = 1.0
    seed: int = 42

    def seeded(self, seed: int) -> Trees:
        return replace(self, seed=seed)


@dataclass(frozen=True)
class Model:
    """A model to fit: its name, the data set it learns from, and its features (none: all)."""

    name: str
    dataset: str
    trees: Trees
    features: tuple[str, ...] | None = None


# ------------------------------------------------------------------ layouts

def layouts(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], cells: int = CELLS) -> dict[str, dict]:
    """What each data set's features are cut into, from its training rows
    (dataset, numeric..., categorical...): a few numbers a feature."""
    probs = [i / cells for i in range(cells)]
    sums = [x for i, c in enumerate(numeric) for x in (F.percentile_approx(F.col(c).cast("double"), probs, 10_000).alias(f"q{i}"), F.count(c).alias(f"n{i}"))]
    there, some = sorted(r["dataset"] for r in train.select("dataset").distinct().collect()), max(1, SKETCHES // max(len(numeric), 1))
    rows = {r["dataset"]: r for i in range(0, len(there), some)
            for r in train.where(F.col("dataset").isin(*there[i: i + some])).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), *sums).collect()}
    out = {d: {"rows": r["n"], "names": [*numeric, *categorical], "cuts": [], "fill": [], "values": [], "mode": []} for d, r in rows.items()}
    medians: dict = {}
    holes = [c for i, c in enumerate(numeric) if any(r[f"n{i}"] < r["n"] for r in rows.values())]
    if holes:  # where training rows lack none, the sketch's median does for rows to be scored
        long = train.select("dataset", *[F.col(c).cast("double").alias(c) for c in holes]).unpivot("dataset", holes, "feature", "x")
        medians = {(r["dataset"], r["feature"]): r["m"] for r in exact_quantiles(long, ["dataset", "feature"], "x", {"m": 0.5}, thin=True).collect()}
    for d, r in rows.items():
        for i, c in enumerate(numeric):
            q = [x for x in (r[f"q{i}"] or []) if x is not None]
            out[d]["cuts"].append(sorted({x for x in q if x > q[0]}))
            out[d]["fill"].append(medians.get((d, c), q[len(q) // 2] if q else 0.0))
    found: dict = {}
    if categorical:
        long = train.select("dataset", *[F.col(c).cast("string").alias(c) for c in categorical]).unpivot("dataset", list(categorical), "feature", "value")
        listed = long.where("value is not null").groupBy("dataset", "feature", "value").count().limit(MAX_CATEGORIES + 1).collect()
        if len(listed) > MAX_CATEGORIES:
            raise ValueError(f"more than {MAX_CATEGORIES} categories: one-hot columns need features with fewer")
        for r in listed:
            found.setdefault((r["dataset"], r["feature"]), []).append((-r["count"], r["value"]))
    for d in rows:
        for c in categorical:
            there = found.get((d, c), [])
            out[d]["values"].append(sorted(v for _, v in there))
            out[d]["mode"].append(min(there)[1] if there else None)
    return out


class Layout:
    """Cells of the features of one data set: offsets into one range, what is
    left of a cut, what can be drawn."""

    def __init__(self, sizes: Sequence[int], is_cat: Sequence[bool]):
        self.sizes, self.cat = np.asarray(sizes, dtype=np.int64), np.asarray(is_cat, dtype=bool)
        self.start = np.concatenate([[0], np.cumsum(self.sizes)])
        self.cells = int(self.start[-1])
        self.feature = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.of_cat = self.cat[self.feature]
        last = np.zeros(self.cells, dtype=bool)
        last[self.start[1:] - 1] = True
        self.may = ~last  # a numeric feature's last cell cuts nothing off; a category's last one is "unknown"
        columns = np.zeros(self.cells, dtype=np.int64)  # the drawn column that each cell belongs to
        k = 0
        for f, n in enumerate(self.sizes):
            columns[self.start[f]: self.start[f] + n] = k + (np.arange(n) if self.cat[f] else 0)
            k += int(n) - 1 if self.cat[f] else 1
        self.column, self.columns = columns, k

    def drawn(self, p: Trees, tree: int) -> np.ndarray:
        """The cells that a tree may split on."""
        return self.may & np.append(self.drawn_columns(p, tree), False)[np.minimum(self.column, self.columns)] if self.draws(p) < self.columns else self.may

    def draws(self, p: Trees) -> int:
        return max(1, int(p.colsample_bytree * self.columns))

    def drawn_columns(self, p: Trees, tree: int) -> np.ndarray:
        chosen = np.full(self.columns, self.draws(p) >= self.columns)
        if self.draws(p) < self.columns:
            chosen[np.random.default_rng([p.seed, tree]).choice(self.columns, self.draws(p), replace=False)] = True
        return chosen


def layout_of(spec: Mapping, names: Sequence[str] | None) -> tuple[Layout, list[int]]:
    """Layout of a model's features, and which of the block's columns they are."""
    at = [i for i, c in enumerate(spec["names"]) if names is None or c in names]
    k = len(spec["cuts"])
    sizes = [len(spec["cuts"][i]) + 1 if i < k else len(spec["values"][i - k]) + 1 for i in at]
    return Layout(sizes, [i >= k for i in at]), at


def to_cells(spec: Mapping, pdf: pd.DataFrame) -> np.ndarray:
    """Cell numbers (from 0 in each feature) of rows."""
    k = len(spec["cuts"])
    out = np.zeros((len(pdf), len(spec["names"])), dtype=np.int32)
    for i, c in enumerate(spec["names"]):
        if i < k:
            x = pdf[c].to_numpy(dtype=np.float64, na_value=np.nan)
            out[:, i] = np.searchsorted(np.array(spec["cuts"][i]), np.where(np.isnan(x), spec["fill"][i], x), side="right")
        else:
            codes = {v: j for j, v in enumerate(spec["values"][i - k])}
            none = len(codes)
            out[:, i] = [codes.get(spec["mode"][i - k] if v is None else v, none) for v in pdf[c].astype(object).where(pdf[c].notna(), None)]
    return out


# ------------------------------------------------------------------ blocks

def blocks(rows: DataFrame, specs: Mapping[str, dict], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows (dataset, role, id, label, features...) of known data sets as blocks:
    dataset, role, block, n, ids, y (labels), bins (the bytes of a cell number, then
    the cell numbers feature by feature)."""
    ship_package(rows.sparkSession)
    rows = rows.where(F.col("dataset").isin(*specs)) if specs else rows.where("false")
    count = {(r["dataset"], r["role"]): -(-r["count"] // block_rows) for r in rows.groupBy("dataset", "role").count().collect()}
    number = F.coalesce(F.create_map(*[x for (d, role), n in count.items() for x in (F.lit(f"{d}\0{role}"), F.lit(n))])[F.concat_ws("\0", "dataset", "role")],
                        F.lit(1)) if count else F.lit(1)
    names = next(iter(specs.values()))["names"] if specs else []
    keyed = rows.select("dataset", "role", F.pmod(F.xxhash64("id"), number).cast("int").alias("block"), "id", F.col("label").cast("double").alias("label"), *names)
    shared = rows.sparkSession.sparkContext.broadcast(dict(specs))
    columns = ["dataset", "role", "block", "n", "ids", "y", "bins"]

    def pieces(pdf):
        """The rows of each block, as the block will hold them."""
        for dataset, part in pdf.groupby("dataset", sort=False):
            cells = to_cells(shared.value[dataset], part).astype(_kind(shared.value[dataset]))
            ids, y = part["id"].to_numpy(np.int64), part["label"].to_numpy(np.float64, na_value=np.nan)
            roles, role = pd.factorize(part["role"])
            key = (roles.astype(np.int64) << 32) + part["block"].to_numpy(np.int64)
            order = np.argsort(key, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
                yield (dataset, role[roles[at[0]]] if roles[at[0]] >= 0 else None, int(part["block"].iloc[at[0]]), len(at), ids[at].tobytes(), y[at].tobytes(), _packed(cells[at].T))

    def cut(batches):
        held, n = [], 0
        for pdf in batches:
            held.append(pdf)
            n += len(pdf)
            if n >= CUT_ROWS:
                yield pd.DataFrame(list(pieces(pd.concat(held, ignore_index=True))), columns=columns)
                held, n = [], 0
        if n:
            yield pd.DataFrame(list(pieces(pd.concat(held, ignore_index=True))), columns=columns)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.frombuffer(b"".join(pdf["ids"]), dtype=np.int64)
        order = np.argsort(ids, kind="stable")
        y, cells = np.frombuffer(b"".join(pdf["y"])), np.concatenate([_unpacked(b, n) for b, n in zip(pdf["bins"], pdf["n"], strict=True)], 1)
        first = pdf.iloc[0]
        return pd.DataFrame([(first["dataset"], first["role"], first["block"], len(ids), ids[order].tobytes(), y[order].tobytes(), _packed(cells[:, order]))], columns=columns)

    schema = "dataset string, role string, block int, n int, ids binary, y binary, bins binary"
    return keyed.mapInPandas(cut, schema).groupBy("dataset", "role", "block").applyInPandas(pack, schema)


def _kind(spec: Mapping) -> type:
    """One byte where every feature has cells for no more."""
    return np.uint8 if max([0, *(len(x) + 1 for x in (*spec["cuts"], *spec["values"]))]) <= 256 else np.uint16


def _packed(cells: np.ndarray) -> bytes:
    return bytes([cells.itemsize]) + cells.tobytes()


def _unpacked(bins: bytes, n: int) -> np.ndarray:
    """Cells (from 0 in each feature) by feature and row."""
    return np.frombuffer(bins, dtype=np.uint8 if bins[0] == 1 else np.uint16, offset=1).reshape(-1, n)


def _cells_of(bins: bytes, n: int, at: list[int], layout: Layout) -> np.ndarray:
    return _unpacked(bins, n)[at].T.astype(np.int32) + layout.start[:-1].astype(np.int32)


# ------------------------------------------------------------------ trees

def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def row_draw(ids: np.ndarray, p: Trees, tree: int, mixed: np.ndarray | None = None) -> np.ndarray | None:
    """Which rows a tree is grown on (None: all). ``mixed``: the ids' bits, spread before."""
    if p.subsample >= 1.0:
        return None
    salt = _mixed(np.array([(p.seed << 32) + tree], dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    mixed = _mixed(ids.view(np.uint64)) if mixed is None else mixed
    return _mixed(mixed ^ salt).astype(np.float64) < p.subsample * 2.0**64


def columns_of(m: np.ndarray, layout: Layout) -> np.ndarray:
    """Cells (from 0 in each feature) by feature, from rows of cells of the whole layout."""
    kind = np.uint16 if len(layout.sizes) and layout.sizes.max() <= 1 << 16 else np.int32
    out = np.empty((m.shape[1], len(m)), dtype=kind)
    for f, column in enumerate(out):
        column[:] = m[:, f] - layout.start[f]
    return out


def cell_sums(columns: np.ndarray, layout: Layout, rows: np.ndarray, slot: np.ndarray, slots: int, g: np.ndarray, features: Sequence[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Gradients (whole numbers) and rows by (slot, cell) of the ``rows`` and the slot of each; cells of features
    left out stay 0. Both come from one sum, of gradient + unit, over pieces so short that neither spills into the other."""
    gs, ns = np.zeros((slots, layout.cells)), np.zeros((slots, layout.cells))
    most = float(np.abs(g).max()) + 1.0 if len(g) else 1.0
    piece = max(1, min(CHUNK_ROWS, int((2.0**50 / most) ** 0.5)))
    unit = 2.0 ** np.ceil(np.log2(2.0 * piece * most))
    features = range(len(columns)) if features is None else features
    wide = [f for f in features if slots * layout.sizes[f] > 4 * piece]
    narrow = [(f, int(layout.sizes[f]), int(layout.start[f])) for f in features if f not in wide]
    for f in wide:
        at, size = layout.start[f], int(layout.sizes[f])
        key = columns[f].take(rows) + slot * size
        gs[:, at: at + size] = np.bincount(key, weights=g[rows], minlength=slots * size).reshape(slots, size)
        ns[:, at: at + size] = np.bincount(key, minlength=slots * size).reshape(slots, size)
    for first in range(0, len(rows), piece):
        part = rows[first: first + piece]
        weights, offsets = g[part] + unit, {}
        for f, size, at in narrow:
            key = columns[f].take(part).astype(np.int64)
            if slots > 1:
                if size not in offsets:
                    offsets[size] = slot[first: first + piece] * size
                key += offsets[size]
            s = np.bincount(key, weights=weights, minlength=slots * size).reshape(slots, size)
            n = np.rint(s / unit)
            gs[:, at: at + size] += s - n * unit
            ns[:, at: at + size] += n
    return gs, ns


class Tree:
    """A tree in heap order: node k has the children 2k (left) and 2k + 1."""

    def __init__(self, depth: int):
        size = 2 << depth
        self.feature, self.cell = np.full(size, -1, dtype=np.int16), np.zeros(size, dtype=np.int32)
        self.value, self.gain = np.zeros(size), np.zeros(size)
        self.active, self.depth = [1], 0

    def decide(self, g: np.ndarray, n: np.ndarray, layout: Layout, may: np.ndarray, p: Trees) -> None:
        """Split or close the active nodes, by the sums of gradients and rows of their cells."""
        g = g / SCALE
        first = layout.sizes[0]
        tg, tn = g[:, :first].sum(1), n[:, :first].sum(1)
        then = []
        if self.depth < p.max_depth:
            before = lambda a: np.concatenate([np.zeros((len(a), 1)), np.cumsum(a, 1)], 1)
            cg, cn = before(g), before(n)
            open_ = layout.start[layout.feature]
            lg = np.where(layout.of_cat, tg[:, None] - g, cg[:, 1:] - cg[:, open_])
            ln = np.where(layout.of_cat, tn[:, None] - n, cn[:, 1:] - cn[:, open_])
            rg, rn = tg[:, None] - lg, tn[:, None] - ln
            gain = _quality(lg, ln, p) + _quality(rg, rn, p) - _quality(tg, tn, p)[:, None]
            gain[~(may & (ln >= p.min_child_weight) & (rn >= p.min_child_weight))] = -np.inf
            gain = np.rint(gain * 2.0**24) / 2.0**24  # ties stay ties, whatever the order of sums: the first cell wins
            best = gain.argmax(1)
            top = gain[np.arange(len(best)), best]
        for k, node in enumerate(self.active):
            if self.depth < p.max_depth and top[k] > LEAST_GAIN and top[k] >= p.gamma:
                self.feature[node], self.cell[node], self.gain[node] = layout.feature[best[k]], best[k], top[k]
                then += [2 * node, 2 * node + 1]
            else:
                self.value[node] = -_shrunk(tg[k], p) / (tn[k] + p.reg_lambda) * p.learning_rate if tn[k] else 0.0
        self.active, self.depth = then, self.depth + 1

    def route(self, m: np.ndarray, node: np.ndarray, layout: Layout) -> np.ndarray:
        """One step down, for rows at nodes that have been split."""
        f = self.feature[node]
        x = m[np.arange(len(m)), np.maximum(f, 0)]
        right = np.where(layout.cat[np.maximum(f, 0)], x == self.cell[node], x > self.cell[node])
        return np.where(f >= 0, 2 * node + right, node)

    def leaves(self, m: np.ndarray, layout: Layout, steps: int) -> np.ndarray:
        node = np.ones(len(m), dtype=np.int64)
        for _ in range(steps):
            node = self.route(m, node, layout)
        return node

    def sums(self, m: np.ndarray, node: np.ndarray, g: np.ndarray, layout: Layout) -> tuple[np.ndarray, np.ndarray]:
        """Gradients and rows by (active node, cell)."""
        slot = np.full(len(self.feature), -1, dtype=np.int64)
        slot[self.active] = np.arange(len(self.active))
        at = slot[node]
        rows = np.flatnonzero(at >= 0)
        return cell_sums(columns_of(m, layout), layout, rows, at[rows], len(self.active), g)


def _shrunk(g, p: Trees):
    return np.sign(g) * np.maximum(np.abs(g) - p.reg_alpha, 0.0)


def _quality(g, n, p: Trees):
    return (np.maximum(np.abs(g) - p.reg_alpha, 0.0) if p.reg_alpha else g) ** 2 / np.maximum(n + p.reg_lambda, 1e-12)


def grow(m: np.ndarray, y: np.ndarray, ids: np.ndarray, layout: Layout, p: Trees) -> tuple[float, list[Tree]]:
    """All trees of one model, from the rows of one block."""
    base = float(np.rint(y * SCALE).sum() / SCALE / max(len(y), 1))
    margin, trees = np.full(len(y), base), []
    columns, mixed = columns_of(m, layout), _mixed(ids.view(np.uint64))
    for t in range(p.n_estimators):
        g = np.rint((margin - y) * SCALE)
        tree, may = Tree(p.max_depth), layout.drawn(p, t)
        keep = row_draw(ids, p, t, mixed)
        keep = np.ones(len(y), dtype=bool) if keep is None else keep
        rows = [(np.flatnonzero(keep), np.flatnonzero(~keep))]  # of each active node: those it learns from, the others
        features = sorted({0, *layout.feature[may].tolist()})  # the drawn ones, and one that gives the totals
        sums = cell_sums(columns, layout, rows[0][0], np.zeros(len(rows[0][0]), dtype=np.int64), 1, g, features)
        while tree.active:
            nodes_, held, rows = tree.active, rows, []
            tree.decide(*sums, layout, may, p)
            for node, both in zip(nodes_, held, strict=True):
                if tree.feature[node] < 0:
                    for r in both:
                        margin[r] += tree.value[node]
                    continue
                f = int(tree.feature[node])
                cell = int(tree.cell[node] - layout.start[f])
                right = [columns[f].take(r) == cell if layout.cat[f] else columns[f].take(r) > cell for r in both]
                rows += [tuple(r[~x] for r, x in zip(both, right, strict=True)), tuple(r[x] for r, x in zip(both, right, strict=True))]
            if tree.active:
                split = [k for k, node in enumerate(nodes_) if tree.feature[node] >= 0]
                sums = _child_sums(columns, layout, [r for r, _ in rows], g, features, [a[split] for a in sums], tree.depth == p.max_depth)
        trees.append(tree)
    return base, trees


def _child_sums(columns: np.ndarray, layout: Layout, rows: list[np.ndarray], g: np.ndarray, features: Sequence[int], parents: list[np.ndarray], last: bool) -> list[np.ndarray]:
    """Sums of the children (left and right of each parent): the smaller one's, and what is left of
    the parent's. Gradients are whole numbers, so nothing is lost. The last level needs totals alone."""
    if last:
        return [np.array([[g[r].sum()] for r in rows]), np.array([[float(len(r))] for r in rows])]
    size = np.array([len(r) for r in rows])
    pairs = np.arange(len(rows) // 2)
    small = 2 * pairs + (size[1::2] < size[::2])
    out = []
    part_sums = cell_sums(columns, layout, np.concatenate([rows[i] for i in small]), np.repeat(pairs, size[small]), len(pairs), g, features)
    for parent, part in zip(parents, part_sums, strict=True):
        both = np.empty((len(rows), layout.cells))
        both[small], both[small ^ 1] = part, parent - part
        out.append(both)
    return out


def pack_forest(base: float, trees: Sequence[Tree]) -> bytes:
    return _forest_bytes(base, {k: np.stack([getattr(t, k) for t in trees]) if trees else np.zeros((0, 2)) for k in ("feature", "cell", "value", "gain")})


def _forest_bytes(base: float, made: Mapping[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, base=base, **made)
    return out.getvalue()


def walkable(forest: Mapping, layout: Layout) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Depth, and of every node its feature, low, span and value: right are the cells above
    ``low``, up to ``low + span``; a leaf above the last level hands its value to the left."""
    depth = int(np.log2(forest["feature"].shape[1])) - 1
    feature, value = forest["feature"].astype(np.int64), forest["value"].copy()
    of_cat = layout.cat[np.maximum(feature, 0)]
    low = np.where(feature < 0, layout.cells, forest["cell"] - of_cat).astype(np.int32)
    span = np.where(of_cat, 1, layout.cells).astype(np.int32)
    for node in range(1, 1 << depth):
        value[:, 2 * node] = np.where(feature[:, node] < 0, value[:, node], value[:, 2 * node])
    return depth, np.maximum(feature, 0), low, span, value


def margins(forest: Mapping, m: np.ndarray, layout: Layout) -> np.ndarray:
    """Predictions (on the scale of the labels) of rows."""
    out = np.full(len(m), float(forest["base"]))
    if not forest["feature"].size or not len(m):
        return out
    depth, feature, low, span, value = walkable(forest, layout)
    width = m.shape[1]
    for at in range(0, len(m), CHUNK_ROWS):
        flat = np.ascontiguousarray(m[at: at + CHUNK_ROWS]).ravel()
        first = np.arange(0, len(flat), width)
        total = out[at: at + CHUNK_ROWS]
        for f, lo, sp, v in zip(feature, low, span, value, strict=True):
            node = np.ones(len(first), dtype=np.int64)
            for _ in range(depth):
                above = flat[first + f[node]] - lo[node]
                node = 2 * node + ((above > 0) & (above <= sp[node]))
            total += v[node]
    return out


# ------------------------------------------------------------------ fit and score

FOREST = "model string, dataset string, spec string, n_trees int, forest binary"


_FOREST_COLUMNS = ["model", "dataset", "spec", "n_trees", "forest"]


def _together(models: Sequence[Model], rows: Mapping[str, int], tasks: int) -> list[list[Model]]:
    """Models that share a task, the longest task first: each has its own, unless more than ``COPY_ROWS``
    rows were copied; then those of a data set are dealt out to fewer tasks, but no fewer than ``tasks`` in all."""
    work = lambda m: rows[m.dataset] * m.trees.n_estimators * max(m.trees.max_depth, 1)
    copied, of = sum(rows[m.dataset] for m in models), {}
    for m in sorted(models, key=work, reverse=True):
        of.setdefault(m.dataset, []).append(m)
    share = 1.0 if copied <= COPY_ROWS else min(1.0, max(COPY_ROWS / copied, tasks / len(models)))
    out = []
    for mine in of.values():
        groups: list[list[Model]] = [[] for _ in range(max(1, -int(-share * len(mine) // 1)))]
        for m in mine:
            min(groups, key=lambda g: sum(map(work, g))).append(m)
        out += groups
    return sorted(out, key=lambda g: -sum(map(work, g)))


def _plan(p: Trees, layout: Layout, at: Sequence[int]) -> tuple[bytes, bytes]:
    """A model for the kernel: its parameters and features, and the columns drawn for every tree."""
    share, low, high = p.subsample * 2.0**64, 0, 2**64 - 1
    while low < high:  # the least hash that is not below the share, both as doubles
        mid = (low + high) // 2
        low, high = (low, mid) if float(mid) >= share else (mid + 1, high)
    numbers = struct.pack("<5i6d2Q", len(at), p.max_depth, p.n_estimators, layout.columns, p.subsample >= 1.0, p.min_child_weight, p.gamma, p.reg_alpha, p.reg_lambda,
                          p.learning_rate, LEAST_GAIN, p.seed & (2**64 - 1), low)
    features = np.stack([np.asarray(at), layout.sizes, layout.cat], 1).astype("<i4").tobytes()
    drawn = [layout.drawn_columns(p, t) for t in range(p.n_estimators)]
    return numbers + features, np.packbits(np.concatenate(drawn)).tobytes() if drawn else b""


def _spec_json(m: Model) -> str:
    return json.dumps({"trees": asdict(m.trees), "features": m.features})


def fit(made: DataFrame, specs: Mapping[str, dict], models: Sequence[Model]) -> DataFrame:
    """Forests (model, dataset, spec, n_trees, forest) of the models whose data
    set has training blocks (role ``train``), stored once."""
    spark = made.sparkSession
    train = made.where("role = 'train'")
    rows = {r["dataset"]: r["n"] for r in train.groupBy("dataset").agg(F.sum("n").alias("n")).collect()}
    shared = spark.sparkContext.broadcast(dict(specs))
    native = kernel.functions(spark)
    width = max([1, *(len(spec["names"]) for spec in specs.values())])
    most = min(TASK_ROWS, TASK_CELLS // width if native else NUMPY_ROWS)
    small = [m for m in models if 0 < rows.get(m.dataset, 0) <= most]
    large = [m for m in models if rows.get(m.dataset, 0) > most]
    together = _together(small, rows, 4 * spark.sparkContext.defaultParallelism)
    wanted = spark.createDataFrame([(i, g[0].dataset, rows[g[0].dataset], [(m.name, _spec_json(m)) for m in g]) for i, g in enumerate(together)],
                                   "place int, dataset string, rows long, models array<struct<model string, spec string>>")
    blocks_ = train.select("dataset", "n", "ids", "y", "bins")
    place = lambda df: df.join(blocks_, "dataset").repartitionById(max(len(together), 1), F.col("place"))  # noqa: E731  one row of ``wanted`` a partition

    def plan(batches):
        """What the kernel needs to know of each model."""
        for batch in batches:
            made = []
            for r in batch.to_pylist():
                for m in r["models"]:
                    spec = json.loads(m["spec"])
                    m["plan"], m["drawn"] = _plan(Trees(**spec["trees"]), *layout_of(shared.value[r["dataset"]], spec["features"]))
                made.append(r)
            yield pa.RecordBatch.from_pylist(made, pa.schema([("place", pa.int32()), ("dataset", pa.string()), ("rows", pa.int64()), ("models", pa.list_(pa.struct([
                ("model", pa.string()), ("spec", pa.string()), ("plan", pa.binary()), ("drawn", pa.binary())])))]))

    def pack(batches):
        kinds = {"feature": "<i2", "cell": "<i4", "value": "<f8", "gain": "<f8"}
        for pdf in batches:
            for r in pdf.itertuples():
                made = {k: np.frombuffer(getattr(r, k), dtype=v).reshape(r.trees, -1) if r.trees else np.zeros((0, 2)) for k, v in kinds.items()}
                yield pd.DataFrame([(r.model, r.dataset, r.spec, r.trees, _forest_bytes(r.base, made))], columns=_FOREST_COLUMNS)

    def learn(batches):
        pdf = pd.concat([b for b in batches if len(b)] or [pd.DataFrame()])
        if pdf.empty:
            return
        dataset = pdf["dataset"].iloc[0]
        y, ids = np.frombuffer(b"".join(pdf["y"])), np.frombuffer(b"".join(pdf["ids"]), dtype=np.int64)
        for asked in pdf["models"].iloc[0]:
            spec = json.loads(asked["spec"])
            layout, at = layout_of(shared.value[dataset], spec["features"])
            m = np.concatenate([_cells_of(b, n, at, layout) for b, n in zip(pdf["bins"], pdf["n"], strict=True)])
            base, trees = grow(m, y, ids, layout, Trees(**spec["trees"]))
            yield pd.DataFrame([(asked["model"], dataset, asked["spec"], len(trees), pack_forest(base, trees))], columns=_FOREST_COLUMNS)

    if native:
        planned = wanted.mapInArrow(plan, "place int, dataset string, rows long, models array<struct<model string, spec string, plan binary, drawn binary>>")
        met = place(planned).select("dataset", "rows", "models", "n", "ids", "y", "bins")
        out = kernel.mapped(met, native["Grow"], "model string, dataset string, spec string, trees int, depth int, base double, feature binary, cell binary, value binary, gain binary")
        out = out.mapInPandas(pack, FOREST)
    else:
        out = place(wanted).mapInPandas(learn, FOREST)
    if large:
        out = out.unionByName(_grow_by_levels(train, specs, large))
    return materialize(out, "forests")


def _grow_by_levels(train: DataFrame, specs: Mapping[str, dict], models: Sequence[Model]) -> DataFrame:
    """Models of data sets with many blocks: all trees grow together, level by level."""
    spark = train.sparkSession
    sc = spark.sparkContext
    shape = {m.name: layout_of(specs[m.dataset], m.features) for m in models}
    of = sc.broadcast({m.name: (m.trees, *shape[m.name]) for m in models})
    listed = spark.createDataFrame([(m.name, m.dataset) for m in models], "model string, dataset string")
    y = train.select("dataset", "n", "y").mapInPandas(
        lambda batches: (pd.DataFrame({"dataset": b["dataset"], "n": b["n"].astype("int64"), "total": [int(np.rint(np.frombuffer(v) * SCALE).sum()) for v in b["y"]]}) for b in batches),
        "dataset string, n long, total long").groupBy("dataset").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    base = {r["dataset"]: float(r["total"] / SCALE / r["n"]) for r in y.collect()}
    forests: dict[str, list[Tree]] = {m.name: [] for m in models}
    start = {m.name: base[m.dataset] for m in models}
    stored = None  # margins of all rows after the trees of the last store
    since: dict[str, list[Tree]] = {m.name: [] for m in models}

    def rows_of(r, trees):
        """Cells, ids, labels and margins of a (model, block) row, after the trees since the last store."""
        p, layout, at = of.value[r.model]
        m = _cells_of(r.bins, r.n, at, layout)
        margin = np.full(r.n, start[r.model]) if r.margin is None else np.frombuffer(r.margin).copy()
        for t in trees.get(r.model, ()):
            margin = margin + t.value[t.leaves(m, layout, p.max_depth)]
        return p, layout, m, np.frombuffer(r.ids, dtype=np.int64), np.frombuffer(r.y), margin

    def met(names):
        pairs = listed.where(F.col("model").isin(*names)).join(train.select("dataset", "block", "n", "ids", "y", "bins"), "dataset")
        return pairs.withColumn("margin", F.lit(None).cast("binary")) if stored is None else pairs.join(stored, ["model", "block"])

    for t in range(max(m.trees.n_estimators for m in models)):
        growing = {m.name: Tree(m.trees.max_depth) for m in models if t < m.trees.n_estimators}
        may = {k: shape[k][0].drawn(of.value[k][0], t) for k in growing}
        while any(x.active for x in growing.values()):
            state = sc.broadcast((since, {k: x for k, x in growing.items() if x.active}))

            def add(batches, state=state, t=t):
                for pdf in batches:
                    for r in pdf.itertuples():
                        trees, now = state.value
                        p, layout, m, ids, y, margin = rows_of(r, trees)
                        tree, g = now[r.model], np.rint((margin - y) * SCALE)
                        node = tree.leaves(m, layout, tree.depth)
                        keep = row_draw(ids, p, t)
                        if keep is not None:
                            m, node, g = m[keep], node[keep], g[keep]
                        gs, ns = tree.sums(m, node, g, layout)
                        there = np.flatnonzero(ns.ravel())
                        yield pd.DataFrame({"model": r.model, "at": there, "g": gs.ravel()[there].astype(np.int64), "n": ns.ravel()[there].astype(np.int64)})

            sums = met(list(state.value[1])).mapInPandas(add, "model string, at long, g long, n long").groupBy("model", "at").agg(F.sum("g").alias("g"), F.sum("n").alias("n")).toPandas()
            by = dict(list(sums.groupby("model")))
            for k in state.value[1]:  # nodes * cells sums a model at most
                tree, layout = growing[k], shape[k][0]
                g, n = (np.zeros(len(tree.active) * layout.cells) for _ in range(2))
                if k in by:
                    g[by[k]["at"]], n[by[k]["at"]] = by[k]["g"], by[k]["n"]
                tree.decide(g.reshape(-1, layout.cells), n.reshape(-1, layout.cells), layout, may[k], of.value[k][0])
            state.unpersist()
        for k, tree in growing.items():
            forests[k].append(tree)
            since[k].append(tree)
        if (t + 1) % STORE_TREES == 0:
            state = sc.broadcast(since)

            def later(batches, state=state):
                for pdf in batches:
                    for r in pdf.itertuples():
                        yield pd.DataFrame([(r.model, r.block, rows_of(r, state.value)[-1].tobytes())], columns=["model", "block", "margin"])

            after = materialize(met(list(forests)).mapInPandas(later, "model string, block int, margin binary"), "margins")
            if stored is not None:
                discard(stored)
            stored, since = after, {m.name: [] for m in models}
    return spark.createDataFrame([(m.name, m.dataset, _spec_json(m), len(forests[m.name]), bytearray(pack_forest(start[m.name], forests[m.name]))) for m in models], FOREST)


def score(made: DataFrame, specs: Mapping[str, dict], forests: DataFrame) -> DataFrame:
    """model, dataset, role, id, label and log_pred of every row of every block
    under every model of its data set."""
    spark = made.sparkSession
    sc = spark.sparkContext
    shared = sc.broadcast(dict(specs))
    found = [tuple(r) for r in made.select("dataset", "role", "block", "n").collect()]
    there = [tuple(r) for r in forests.select("model", "dataset", "n_trees").collect()]
    shares = _shares(found, there, 6 * sc.defaultParallelism)
    asked = spark.createDataFrame([(i, *b[:3]) for i, (b, _) in enumerate(shares)], "place int, dataset string, role string, block int")
    of = spark.createDataFrame([(i, m) for i, (_, models) in enumerate(shares) for m in models], "place int, model string")
    native = kernel.functions(made.sparkSession)

    def walks(batches):
        """Forests as the kernel walks through them, in cells from 0 in each feature."""
        for pdf in batches:
            for r in pdf.itertuples():
                layout, at = layout_of(shared.value[r.dataset], json.loads(r.spec)["features"])
                forest = np.load(io.BytesIO(r.forest))
                depth, feature, low, span, value = walkable(forest, layout)
                low = np.where(low < layout.cells, low - layout.start[feature], layout.cells)
                made_ = [np.ascontiguousarray(x, dtype=k).tobytes() for x, k in ((np.asarray(at, dtype=np.int64)[feature], "<i4"), (low, "<i4"), (low + span, "<i4"), (value, "<f8"))]
                yield pd.DataFrame([(r.model, r.dataset, float(forest["base"]), depth, *made_)], columns=["model", "dataset", "base", "depth", "column", "low", "high", "value"])

    def predict(batches):
        pdf = pd.concat([b for b in batches if len(b)] or [pd.DataFrame(columns=["model"])])
        for b in pdf[pdf["model"].isna()].itertuples():
            for r in pdf[pdf["model"].notna()].itertuples():
                layout, at = layout_of(shared.value[b.dataset], json.loads(r.spec)["features"])
                values = margins(np.load(io.BytesIO(r.forest)), _cells_of(b.bins, int(b.n), at, layout), layout)
                yield pd.DataFrame({"model": r.model, "dataset": b.dataset, "role": b.role, "id": np.frombuffer(b.ids, dtype=np.int64), "label": np.frombuffer(b.y), "log_pred": values})

    if native:
        forests = forests.mapInPandas(walks, "model string, dataset string, base double, depth int, column binary, low binary, high binary, value binary")
    # a partition holds one block and the forests that it meets there; no forest passes the driver
    blocks_ = made.join(F.broadcast(asked), [made["dataset"] == asked["dataset"], made["role"].eqNullSafe(asked["role"]), made["block"] == asked["block"]]).select(
        "place", made["dataset"], made["role"], "n", "ids", "y", "bins")
    met = blocks_.unionByName(forests.join(F.broadcast(of), "model"), allowMissingColumns=True).repartitionById(max(len(shares), 1), F.col("place"))
    schema = "model string, dataset string, role string, id long, label double, log_pred double"
    if native:
        return kernel.mapped(met.select("model", "dataset", "role", "n", "ids", "y", "bins", "base", "depth", "column", "low", "high", "value"), native["Walk"], schema)
    return met.select("model", "dataset", "role", "spec", "n", "ids", "y", "bins", "forest").mapInPandas(predict, schema)


def _shares(blocks_: Sequence[tuple], forests: Sequence[tuple], tasks: int) -> list[tuple[tuple, list[str]]]:
    """Each block (dataset, role, block, n) with the models (model, dataset, trees) that it meets in one
    task, the longest task first. Blocks of more than a ``tasks``-th of the work go to several tasks, in copies."""
    of: dict = {}
    for model, dataset, trees in sorted(forests, key=lambda x: (-x[2], x[0])):
        of.setdefault(dataset, []).append((model, trees))
    work = {b: b[3] * sum(t for _, t in of.get(b[0], ())) for b in blocks_}
    least, out = max(1.0, sum(work.values()) / max(tasks, 1)), []
    for b, w in work.items():
        models = of.get(b[0], ())
        parts: list[list] = [[0, []] for _ in range(min(len(models), SCORE_PARTS, max(1, -int(-w // least))))]
        for model, trees in models:
            p = min(parts, key=lambda x: x[0])
            p[0] += b[3] * trees
            p[1].append(model)
        out += [(n, b, names) for n, names in parts]
    return [(b, names) for _, b, names in sorted(out, key=lambda x: -x[0])]


def nodes(forests: DataFrame, specs: Mapping[str, dict]) -> DataFrame:
    """Forests as a table: model, tree, node, feature, and ``below`` (numbers
    less than it go left) or ``category`` (that goes right); leaves have a value."""
    shared = forests.sparkSession.sparkContext.broadcast(dict(specs))

    def unpack(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                spec = shared.value[r.dataset]
                layout, at = layout_of(spec, json.loads(r.spec)["features"])
                f, k, rows = np.load(io.BytesIO(r.forest)), len(spec["cuts"]), []
                for t in range(r.n_trees):
                    todo = [1]
                    while todo:
                        node = todo.pop()
                        j = int(f["feature"][t, node])
                        if j < 0:
                            rows.append((r.model, t, node, None, None, None, float(f["value"][t, node]), None))
                            continue
                        cell = int(f["cell"][t, node] - layout.start[j])
                        below = float(spec["cuts"][at[j]][cell]) if at[j] < k else None
                        category = spec["values"][at[j] - k][cell] if at[j] >= k else None
                        rows.append((r.model, t, node, spec["names"][at[j]], below, category, None, float(f["gain"][t, node])))
                        todo += [2 * node, 2 * node + 1]
                yield pd.DataFrame(rows, columns=["model", "tree", "node", "feature", "below", "category", "value", "gain"])

    return forests.mapInPandas(unpack, "model string, tree int, node int, feature string, below double, category string, value double, gain double")


def importance(forests: DataFrame, specs: Mapping[str, dict]) -> DataFrame:
    """Mean gain of the splits on each feature column (a category is a column of its
    own), as a share of the model's sum: model, feature, importance."""
    split = nodes(forests, specs).where("feature is not null")
    name = F.concat_ws("_", "feature", "category")
    mean = split.groupBy("model", name.alias("feature")).agg(F.avg("gain").alias("gain"))
    total = mean.groupBy("model").agg(F.sum("gain").alias("total"))
    return mean.join(total, "model").select("model", "feature", (F.col("gain") / F.col("total")).alias("importance"))

