"""Spatial operators: nearest point, k nearest, counts within radius, nearest
within a distance, nearest with a preferred partition, comparable sales.

No operator pairs every target with every point.

k-nearest searches cut space into leaves at the medians of a bounded sample of the points
(in coordinates whose Euclidean distance orders as the metric does). The k-th nearest sampled
point of its leaf bounds a target's search; the target goes to the leaves whose box of
points lies within that bound, mostly one or two, and meets their points in Arrow batches. The few
nearest of each leaf are ranked by Spark's own distances. Points at one place are cut
to the first k before, and a leaf that many targets ask meets them in several groups.

Counts, and comparable sales where cells hold few, are grid-cell equi-joins: cells are at least as wide
as the search radius, so every point within it lies in the 3x3 cells around the target's.
Other comparable sales meet in tiles of several radii, in Arrow groups.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StructField, StructType

from lotline.functions.geo import EARTH_RADIUS_KM, cell_sizes_for_radius, haversine_km, planar_deg_distance
from lotline.session import materialize, ship_package

KM_PER_DEG = math.pi * EARTH_RADIUS_KM / 180.0
_NEIGHBOURS = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]


def _metric(kind: str):
    if kind == "haversine":
        return haversine_km
    if kind == "planar":
        return planar_deg_distance
    raise ValueError(kind)


def _cell_sizes(kind: str, radius: float, max_abs_lat: float) -> tuple[float, float]:
    if kind == "haversine":
        return cell_sizes_for_radius(radius, max_abs_lat)
    return radius * 1.001, radius * 1.001


def _bbox(dfs_cols: Sequence[tuple[DataFrame, str, str]]):
    """(min lat, max lat, min lon, max lon) over several inputs (one small
    aggregate job each; None without any located row), and each input's number
    of located rows."""
    ends, counts = [], []
    for df, la, lo in dfs_cols:
        located = df.where(F.col(la).isNotNull() & F.col(lo).isNotNull())
        r = located.agg(F.min(la), F.max(la), F.min(lo), F.max(lo), F.count(F.lit(1))).first()
        counts.append(int(r[4]))
        if r[4]:
            ends.append(r)
    if not ends:
        return None, counts
    return (min(r[0] for r in ends), max(r[1] for r in ends), min(r[2] for r in ends), max(r[3] for r in ends)), counts


def _explode_cells(points: DataFrame, lat: str, lon: str, dlat: float, dlon: float) -> DataFrame:
    cy = F.floor(F.col(lat) / F.lit(dlat)).cast("bigint")
    cx = F.floor(F.col(lon) / F.lit(dlon)).cast("bigint")
    offs = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in _NEIGHBOURS]))
    return (
        points.withColumn("__cy0", cy).withColumn("__cx0", cx).withColumn("__o", offs)
        .withColumn("__cy", F.col("__cy0") + F.col("__o.dy")).withColumn("__cx", F.col("__cx0") + F.col("__o.dx"))
        .drop("__cy0", "__cx0", "__o")
    )


def _own_cell(targets: DataFrame, lat: str, lon: str, dlat: float, dlon: float) -> DataFrame:
    return targets.withColumn("__cy", F.floor(F.col(lat) / F.lit(dlat)).cast("bigint")).withColumn(
        "__cx", F.floor(F.col(lon) / F.lit(dlon)).cast("bigint")
    )


TREE_SAMPLE = 1 << 18  # points the tree of leaves is made from
LEAF_SAMPLE = 64  # of them in a leaf
GROUP_TARGETS = 50_000  # targets that meet a leaf's points in one group
_AXES = ["__x", "__y", "__z", "__m"]
_MATCH_STEP = 8.0  # groups that must not meet lie farther apart than any two points of one


def _embedded(metric: str, lat: Column, lon: Column, box, match: Sequence[Column]) -> list[Column]:
    """Coordinates whose Euclidean distance orders points as the metric does (at most 2
    within a group of equal ``match`` values, beyond between groups)."""
    if metric == "haversine":
        p, q = F.radians(lat), F.radians(lon)
        at = [F.cos(p) * F.cos(q), F.cos(p) * F.sin(q), F.sin(p)]
    else:
        size = math.hypot(box[1] - box[0], box[3] - box[2]) or 1.0
        at = [(lat - box[0]) / size, (lon - box[2]) / size, F.lit(0.0)]
    group = F.pmod(F.xxhash64(*match), F.lit(1 << 50)).cast("double") * _MATCH_STEP if match else F.lit(0.0)
    return [c.cast("double").alias(n) for n, c in zip(_AXES, [*at, group], strict=True)]


class _Tree:
    """Space cut into leaves at medians of a sample of the points."""

    def __init__(self, sample: np.ndarray, k: int):
        least = max(LEAF_SAMPLE, 2 * k)
        self.axis, self.cut, self.low, self.high, self.leaf, held = [], [], [], [], [], []
        todo = [(sample, None, None)]
        while todo:
            rows, parent, side = todo.pop()
            here = len(self.axis)
            if parent is not None:
                side[parent] = here
            axis, cut = -1, 0.0
            if len(rows) >= 2 * least:
                axis = int(np.argmax(rows.max(0) - rows.min(0)))
                values = np.sort(rows[:, axis])
                cut = values[len(values) // 2]
                if cut == values[0]:  # more than half at the least value: cut behind it
                    more = np.searchsorted(values, cut, side="right")
                    axis, cut = (axis, values[more]) if more < len(values) else (-1, 0.0)
            self.axis.append(axis)
            self.cut.append(float(cut))
            self.low.append(-1)
            self.high.append(-1)
            self.leaf.append(-1 if axis >= 0 else len(held))
            if axis < 0:
                held.append(rows[:LEAF_SAMPLE + 2 * k])
            else:
                left = rows[:, axis] < cut
                todo += [(rows[left], here, self.low), (rows[~left], here, self.high)]
        self.axis, self.cut, self.low, self.high, self.leaf = (np.array(x) for x in (self.axis, self.cut, self.low, self.high, self.leaf))
        self.known = np.full((len(held), max([len(r) for r in held] + [1]), len(_AXES)), np.inf)
        for i, r in enumerate(held):
            self.known[i, :len(r)] = r
        self.box = None

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each place lies in."""
        node, rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        while (self.axis[node] >= 0).any():
            inner = self.axis[node] >= 0
            right = x[rows, np.maximum(self.axis[node], 0)] >= self.cut[node]
            node = np.where(inner, np.where(right, self.high[node], self.low[node]), node)
        return self.leaf[node]

    def enclose(self, found) -> None:
        """Boxes of the leaves' points (leaf, lows, highs), and of the nodes above them."""
        n = len(self.axis)
        self.box = np.full((n, 2, len(_AXES)), np.inf)
        self.box[:, 1] = -np.inf
        of = {int(r[0]): r for r in found}
        for node in range(n - 1, -1, -1):  # children stand behind their parents
            if self.axis[node] < 0:
                if self.leaf[node] in of:
                    r = of[self.leaf[node]]
                    self.box[node] = [r[1:5], r[5:9]]
            else:
                below = self.box[[self.low[node], self.high[node]]]
                self.box[node] = [below[:, 0].min(0), below[:, 1].max(0)]

    def bound(self, x: np.ndarray, k: int, most: float) -> np.ndarray:
        """No less than the distance of the k-th nearest point, from the sample of the own leaf."""
        out = np.full(len(x), most)
        if self.known.shape[1] >= k:
            leaf, step = self.leaves(x), max(1, 500_000 // self.known.shape[1])
            for at in range(0, len(x), step):
                d = self.known[leaf[at:at + step]] - x[at:at + step, None, :]
                out[at:at + step] = np.minimum(most, np.sqrt(np.partition((d * d).sum(2), k - 1, axis=1)[:, k - 1]))
        return _slack(out)

    def reached(self, x: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of all leaves whose points may lie within the rows' bounds."""
        rows, leaves, todo = [], [], [(0, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            low, high = self.box[node]
            if not len(at) or low[0] > high[0]:
                continue
            d = np.maximum(np.maximum(low - x[at], x[at] - high), 0.0)
            at = at[(d * d).sum(1) <= bound[at] ** 2]
            if self.axis[node] >= 0:
                todo += [(self.low[node], at), (self.high[node], at)]
            elif len(at):
                rows.append(at)
                leaves.append(np.full(len(at), self.leaf[node], dtype=np.int32))
        none = np.zeros(0, dtype=np.int64)
        return np.concatenate([none, *rows]), np.concatenate([none.astype(np.int32), *leaves])


def _slack(d):
    """Distances widened beyond any rounding: what lies within is ranked exactly later."""
    return d * (1 + 1e-9) + 1e-12


def _axes_of(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    return np.stack([table.column(c).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table.column(c).to_numpy() for c in _AXES], axis=1)


def _add_leaf(tree):
    """Points with their leaf."""

    def add(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tree.value.leaves(_axes_of(b)).astype(np.int32))], names=[*b.schema.names, "__leaf"])

    return add


def _ask(tree, k: int, most: float):
    """Targets once for every leaf that may hold one of their k nearest points."""

    def ask(batches):
        for b in batches:
            x = _axes_of(b)
            bound = tree.value.bound(x, k, most)
            at, leaf = tree.value.reached(x, bound)
            taken = pa.Table.from_batches([b]).take(pa.array(at)).combine_chunks()
            cols = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in taken.columns]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(bound[at]), pa.array(leaf)], names=[*b.schema.names, "__bound", "__leaf"])

    return ask


def _meet(k: int, t_names: Sequence[str], p_names: Sequence[str]):
    """Pairs of the targets and points of a leaf: each target's k nearest, with ties."""

    def meet(key, points, asked):
        x, p, bound = _axes_of(asked), _axes_of(points), asked.column("__bound").to_numpy()
        left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        step = max(1, 1_000_000 // max(len(p), 1))
        for at in range(0, len(x) if len(p) else 0, step):
            d = sum((x[at:at + step, None, i] - p[None, :, i]) ** 2 for i in range(len(_AXES)))
            near = bound[at:at + step]
            if len(p) > k:
                near = np.minimum(near, _slack(np.sqrt(np.partition(d, k - 1, axis=1)[:, k - 1])))
            t, q = np.nonzero(d <= (near ** 2)[:, None])
            left.append(t + at)
            right.append(q)
        t, q = pa.array(np.concatenate(left)), pa.array(np.concatenate(right))
        out = asked.select(t_names).take(t)
        for c in p_names:
            out = out.append_column(c, points.column(c).take(q))
        return out

    return meet


def knn_search(
    targets: DataFrame,
    points: DataFrame,
    t_key: Sequence[str],
    t_lat: str,
    t_lon: str,
    p_lat: str,
    p_lon: str,
    p_order: Sequence[str],
    p_carry: Sequence[str] = (),
    k: int = 1,
    match: Sequence[tuple[str, str]] = (),
    metric: str = "haversine",
    within: float | None = None,
    unique_targets: bool = False,
) -> DataFrame:
    """Exact k nearest points per target (see module docstring).

    Output: ``t_key`` columns + ``nn``: array of up to k structs
    ``(d, <p_order...>, <p_carry...>)`` sorted by distance then ``p_order``.
    ``match``: (target col, point col) pairs that must be equal (e.g. same
    segment / borough). Targets without any eligible point get ``nn = NULL``.
    ``within``: points farther than this many km are not eligible.
    ``unique_targets``: the caller's keys are unique and every row is answered;
    else a key that comes several times gets one row.
    """
    t_key, spark = list(t_key), targets.sparkSession
    ship_package(spark)
    distance = _metric(metric)
    p_all = list(dict.fromkeys([*p_order, *p_carry]))
    on = [f"__m{i}" for i in range(len(match))]
    tk = targets.select(*t_key, F.col(t_lat).cast("double").alias("__tlat"), F.col(t_lon).cast("double").alias("__tlon"),
                        *[F.col(t).alias(m) for m, (t, _) in zip(on, match, strict=True)]).where("__tlat is not null and __tlon is not null")
    tk = tk.groupBy(*t_key).agg(F.min(F.struct("__tlat", "__tlon", *on)).alias("__t")).select(*t_key, "__t.*")
    box = _bbox([(targets, t_lat, t_lon), (points, p_lat, p_lon)])[0] or (0.0, 1.0, 0.0, 1.0) if metric == "planar" else None
    matched = lambda df: df.where(" and ".join(f"{m} is not null" for m in on)) if on else df
    axes = lambda lat, lon: _embedded(metric, F.col(lat), F.col(lon), box, [F.col(m) for m in on])

    # at one place, the first k alone can be among the nearest
    pts = matched(points.where(F.col(p_lat).isNotNull() & F.col(p_lon).isNotNull()).select(
        F.col(p_lat).cast("double").alias("__plat"), F.col(p_lon).cast("double").alias("__plon"),
        *[F.col(p).alias(m) for m, (_, p) in zip(on, match, strict=True)], *[F.col(c).alias(f"__p_{c}") for c in p_all]))
    place = Window.partitionBy(*on, "__plat", "__plon").orderBy(*[f"__p_{c}" for c in p_order])
    pts = pts.withColumn("__r", F.row_number().over(place)).where(F.col("__r") <= k).drop("__r")
    pts = materialize(pts.select("*", *axes("__plat", "__plon")).drop(*on), "knn-points")
    n = pts.count()
    some = pts if n <= TREE_SAMPLE else pts.where(F.xxhash64("__plat", "__plon", *[f"__p_{c}" for c in p_order]) < F.lit(int(-(1 << 63) + TREE_SAMPLE / n * (1 << 64))))
    sample = some.select(*_AXES).toPandas().to_numpy(dtype=np.float64)  # about TREE_SAMPLE rows at most
    tree = _Tree(sample, k)
    leaved = pts.mapInArrow(_add_leaf(spark.sparkContext.broadcast(tree)), StructType([*pts.schema.fields, StructField("__leaf", IntegerType())]))
    tree.enclose(leaved.groupBy("__leaf").agg(*[F.min(c).alias(f"low{c}") for c in _AXES], *[F.max(c).alias(f"high{c}") for c in _AXES]).collect())  # a row a leaf

    most = 2.0 if within is None else 2 * math.sin(min(within / (2 * EARTH_RADIUS_KM), math.pi / 2)) if metric == "haversine" else within / (math.hypot(box[1] - box[0], box[3] - box[2]) or 1.0)
    asking = matched(tk).select(*t_key, "__tlat", "__tlon", *axes("__tlat", "__tlon"))
    asked = asking.mapInArrow(_ask(spark.sparkContext.broadcast(tree), k, most), StructType([*asking.schema.fields, StructField("__bound", DoubleType()), StructField("__leaf", IntegerType())]))
    asked = materialize(asked, "knn-asked")

    # a leaf that many targets ask meets them in several groups
    salts = {r["__leaf"]: -(-r["count"] // GROUP_TARGETS) for r in asked.groupBy("__leaf").count().collect()}  # a row a leaf
    many = {leaf: s for leaf, s in salts.items() if s > 1}
    parts = F.coalesce(F.create_map(*[F.lit(x) for p in many.items() for x in p])[F.col("__leaf")], F.lit(1)) if many else F.lit(1)
    asked = asked.withColumn("__salt", F.pmod(F.xxhash64(*t_key), parts).cast("int"))
    leaved = leaved.withColumn("__salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    t_names, p_names = [*t_key, "__tlat", "__tlon"], ["__plat", "__plon", *[f"__p_{c}" for c in p_all]]
    schema = StructType([*asked.select(*t_names).schema.fields, *pts.select(*p_names).schema.fields])
    j = leaved.groupBy("__leaf", "__salt").cogroup(asked.groupBy("__leaf", "__salt")).applyInArrow(_meet(k, t_names, p_names), schema)

    j = j.withColumn("__d", distance(F.col("__tlat"), F.col("__tlon"), F.col("__plat"), F.col("__plon")))
    if within is not None:
        j = j.where(F.col("__d") <= within)
    rank = Window.partitionBy(*t_key).orderBy("__d", *[f"__p_{c}" for c in p_order])
    j = j.withColumn("__r", F.row_number().over(rank)).where(F.col("__r") <= k)
    one = F.struct(F.col("__d").alias("d"), *[F.col(f"__p_{c}").alias(c) for c in p_all])
    out = j.groupBy(*t_key).agg(F.array_sort(F.collect_list(one)).alias("nn"))  # k structs at most
    # targets without any eligible point anywhere
    known = targets.where(F.col(t_lat).isNotNull() & F.col(t_lon).isNotNull()).select(*t_key) if unique_targets else tk.select(*t_key)
    return known.join(out, t_key, "left")


def count_within_radius(
    targets: DataFrame, points: DataFrame, t_key: Sequence[str], t_lat: str, t_lon: str,
    p_lat: str, p_lon: str, radii: Sequence[float], metric: str = "haversine",
    names: Sequence[str] | None = None, unique_targets: bool = False, bbox=None,
) -> DataFrame:
    """Number of points within each radius (inclusive), one grid pass sized
    for the largest radius. Targets with none get 0. ``unique_targets`` /
    ``bbox`` as in ``knn_search``."""
    t_key = list(t_key)
    rmax = max(radii)
    if bbox is None:
        bbox, _ = _bbox([(targets, t_lat, t_lon), (points, p_lat, p_lon)])
    tk = targets.select(*t_key, t_lat, t_lon).where(F.col(t_lat).isNotNull() & F.col(t_lon).isNotNull())
    if not unique_targets:
        tk = tk.dropDuplicates(t_key)
    names = list(names or [f"n_within_{r:g}" for r in radii])
    if bbox is None:
        return tk.select(*t_key, *[F.lit(0).cast("bigint").alias(n) for n in names])
    max_abs_lat = min(89.0, max(abs(bbox[0]), abs(bbox[1])))
    dlat, dlon = _cell_sizes(metric, rmax, max_abs_lat)
    t = _own_cell(tk, t_lat, t_lon, dlat, dlon)
    pts = points.where(F.col(p_lat).isNotNull() & F.col(p_lon).isNotNull()).groupBy(
        F.col(p_lat).alias("__plat"), F.col(p_lon).alias("__plon")).agg(F.count(F.lit(1)).alias("__n"))
    p = _explode_cells(pts, "__plat", "__plon", dlat, dlon)
    j = t.join(p, ["__cy", "__cx"], "inner").withColumn(
        "__d", _metric(metric)(F.col(t_lat), F.col(t_lon), F.col("__plat"), F.col("__plon")))
    agg = j.groupBy(*t_key).agg(*[F.sum(F.when(F.col("__d") <= F.lit(r), F.col("__n"))).alias(n) for r, n in zip(radii, names)])
    out = tk.select(*t_key).join(agg, t_key, "left")
    return out.select(*t_key, *[F.coalesce(F.col(n), F.lit(0)).cast("bigint").alias(n) for n in names])


def transit_features(
    parcels: DataFrame, stations: DataFrame, key: str = "bbl", lat: str = "latitude", lon: str = "longitude",
    s_lat: str = "lat", s_lon: str = "lon", s_id: str = "station_id", s_routes: str = "route_count",
    s_cbd: str = "is_cbd", k: int = 3,
) -> DataFrame:
    """Nearest-station distance, hub flag of the nearest station, counts
    within 0.5 / 1 km, mean distance to the k nearest (fewer if fewer
    stations exist) and distance to the nearest CBD station (NULL if none)."""
    nn = knn_search(parcels, stations, [key], lat, lon, s_lat, s_lon, [s_id], [s_routes], k=k, unique_targets=True)
    cbd = knn_search(parcels, stations.where(F.col(s_cbd)), [key], lat, lon, s_lat, s_lon, [s_id], k=1, unique_targets=True)
    cnt = count_within_radius(parcels, stations, [key], lat, lon, s_lat, s_lon, [0.5, 1.0],
                              names=["subway_n_500m", "subway_n_1km"], unique_targets=True)
    first = F.col("nn")[0]
    feats = nn.select(
        key,
        first["d"].alias("subway_dist_km"),
        F.when(first.isNotNull(), (first[s_routes] >= 2).cast("int")).alias("subway_hub_flag"),
        (F.aggregate("nn", F.lit(0.0), lambda acc, x: acc + x["d"]) / F.size("nn")).alias("subway_k3_mean_dist_km"),
    )
    cbd_d = cbd.select(key, F.col("nn")[0]["d"].alias("subway_cbd_dist_km"))
    return feats.join(cnt, key, "left").join(cbd_d, key, "left")


def nearest_within(
    targets: DataFrame, candidates: DataFrame, t_key: Sequence[str], t_lat: str, t_lon: str,
    c_lat: str, c_lon: str, c_order: Sequence[str], carry: Sequence[str], max_km: float = 0.15,
) -> DataFrame:
    """Columns of the nearest candidate within ``max_km`` (else NULL)."""
    t_key = list(t_key)
    tk = materialize(targets.select(*t_key, t_lat, t_lon).dropDuplicates(t_key), "within-targets")
    nn = knn_search(tk, candidates, t_key, t_lat, t_lon, c_lat, c_lon, c_order, carry, k=1, within=max_km, unique_targets=True)
    first = F.col("nn")[0]
    out = tk.select(*t_key).join(nn, t_key, "left")
    return out.select(*t_key, first["d"].alias("match_dist_km"), *[first[c].alias(c) for c in carry])


def nearest_with_preference(
    requests: DataFrame, candidates: DataFrame, r_key: Sequence[str], r_lat: str, r_lon: str, r_pref: str,
    c_lat: str, c_lon: str, c_pref: str, c_order: Sequence[str], carry: Sequence[str],
) -> DataFrame:
    """Nearest candidate by planar degree distance, preferring candidates
    whose ``c_pref`` equals the request's ``r_pref`` (case-insensitive);
    requests whose preferred partition has no candidate fall back to the
    nearest candidate overall."""
    r_key = list(r_key)
    req = requests.withColumn("__pref", F.lower(F.col(r_pref).cast("string")))
    cand = candidates.withColumn("__cpref", F.lower(F.col(c_pref).cast("string")))
    same = knn_search(req, cand, r_key, r_lat, r_lon, c_lat, c_lon, c_order, carry, k=1,
                      match=[("__pref", "__cpref")], metric="planar")
    hit = same.where(F.col("nn").isNotNull())
    miss = req.join(hit.select(*r_key), r_key, "left_anti")
    anyb = knn_search(miss, cand, r_key, r_lat, r_lon, c_lat, c_lon, c_order, carry, k=1,
                      metric="planar")
    both = hit.withColumn("same_partition", F.lit(True)).unionByName(anyb.withColumn("same_partition", F.lit(False)))
    first = F.col("nn")[0]
    return both.select(*r_key, "same_partition", first["d"].alias("match_dist"),
                       *[first[c].alias(c) for c in list(c_order) + list(carry)])


# --------------------------------------------------------------------------- comps

def array_percentile(sorted_arr: Column, q: float) -> Column:
    """Linear-interpolated quantile of an ascending-sorted numeric array."""
    n = F.size(sorted_arr)
    pos = (n - 1).cast("double") * F.lit(q)
    lo = F.floor(pos).cast("int")
    hi = F.ceil(pos).cast("int")
    a_lo = F.element_at(sorted_arr, lo + 1)
    a_hi = F.element_at(sorted_arr, hi + 1)
    return F.when(n > 0, a_lo + (pos - lo) * (a_hi - a_lo))


def _comps_by_radii(sales: DataFrame, key: Sequence[str], lat: str, lon: str, sale_id: str, sale_date: str, as_of: str, price: str, sqft: str, segment: str, k: int,
        lookback_days: int, min_price: float, max_km: float, radii: Sequence[float]) -> DataFrame:
    """key, __tday and ``sel`` (the comps of a target, nearest first): an equi-join on (segment,
    time bucket, grid cell), with the comps replicated into the <= 2 yearly buckets a sale can serve
    and the 3x3 cells around it. Radii run smallest first; targets with k comps inside a radius are
    final, only the others are joined again at the next one. The ranking keeps k rows a target before its shuffle."""
    radii = sorted(r for r in radii if r <= max_km) or [max_km]
    if radii[-1] < max_km:
        radii.append(max_km)
    tday = F.unix_date(F.col(as_of))
    targets = (
        sales.where(F.col(segment).isNotNull() & F.col(lat).isNotNull() & F.col(lon).isNotNull() & F.col(as_of).isNotNull())
        .select(*key, lat, lon, tday.alias("__tday")).dropDuplicates(key)
        .withColumn("__tb", F.floor(F.col("__tday") / F.lit(lookback_days)).cast("bigint"))
    )
    sday = F.unix_date(F.col(sale_date))
    comps = sales.where(
        (F.col(price) >= min_price) & F.col(segment).isNotNull() & F.col(lat).isNotNull() & F.col(lon).isNotNull()
        & F.col(sale_date).isNotNull()
    ).select(
        F.col(segment).alias("__cseg"), F.col(lat).alias("__clat"), F.col(lon).alias("__clon"),
        F.col(sale_id).alias("__cid"), sday.alias("__cday"), F.col(price).alias("__cprice"),
        F.col(sqft).alias("__csqft"),
    )
    # a sale on day s serves targets with as_of day in [s+1, s+lookback]
    first_b = F.floor((F.col("__cday") + 1) / F.lit(lookback_days)).cast("bigint")
    last_b = F.floor((F.col("__cday") + lookback_days) / F.lit(lookback_days)).cast("bigint")
    comps = comps.withColumn("__tb", F.explode(F.sequence(first_b, last_b)))

    bbox, _ = _bbox([(sales, lat, lon)])
    max_abs_lat = 60.0 if bbox is None else min(89.0, max(abs(bbox[0]), abs(bbox[1])))
    results = []
    remaining = targets
    for i, r in enumerate(radii):
        dlat, dlon = cell_sizes_for_radius(r, max_abs_lat)
        t = _own_cell(remaining, lat, lon, dlat, dlon)
        p = _explode_cells(comps, "__clat", "__clon", dlat, dlon).withColumnRenamed("__tb", "__ctb")
        j = t.join(p, (t[segment] == p["__cseg"]) & (t["__tb"] == p["__ctb"]) & (t["__cy"] == p["__cy"]) & (t["__cx"] == p["__cx"]))
        j = j.where((F.col("__cday") < F.col("__tday")) & (F.col("__cday") >= F.col("__tday") - lookback_days))
        j = j.withColumn("__d", haversine_km(F.col(lat), F.col(lon), F.col("__clat"), F.col("__clon"))).where(
            F.col("__d") <= F.lit(r))
        # k rows a target: pruned before the shuffle, so a dense cell sends k rows a target and task
        rank = Window.partitionBy(*key).orderBy("__d", "__cid")
        j = j.select(*[t[c] for c in key], "__tday", "__d", "__cid", "__cday", "__cprice", "__csqft")
        j = j.withColumn("__r", F.row_number().over(rank)).where(F.col("__r") <= k)
        cand = F.struct(F.col("__d").alias("d"), F.col("__cid").alias("id"), F.col("__cday").alias("day"),
                        F.col("__cprice").alias("price"), F.col("__csqft").alias("sqft"))
        agg = j.groupBy(*key, "__tday").agg(F.array_sort(F.collect_list(cand)).alias("sel"))
        if i == len(radii) - 1:
            results.append(agg)
            break
        level = materialize(agg, "comps-level")
        done = level.where(F.size("sel") >= k)
        results.append(done)
        remaining = remaining.join(done.select(*key), key, "left_anti")
    sel = results[0]
    for r_ in results[1:]:
        sel = sel.unionByName(r_)

    return sel


TILE = 8  # side of a tile, in search radii
TILE_YEARS = 3  # lookback periods of targets that meet in a tile
TILE_ROWS = 200_000  # targets and sales of the fullest tile at the first radius
TILE_STEP = 4  # by which the radius grows from pass to pass
PAIR_ROWS = 2_000_000  # target-place pairs held at once in a task
CELL_PLACES = 4  # places in the fullest cell that a tile's search starts from


def _km(lat1, lon1, lat2, lon2):
    """Haversine distances (Spark's own rank what lies within a slack of them)."""
    p, q = np.radians(lat1), np.radians(lat2)
    a = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin((np.radians(lon2) - np.radians(lon1)) / 2) ** 2
    return 2 * EARTH_RADIUS_KM * np.arcsin(np.sqrt(np.minimum(a, 1.0)))


def _spread(count: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, first[row], first[row] + 1, ...) for ``count`` places of each row."""
    row = np.repeat(np.arange(len(count)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[row]


class _Ranges:
    """The smallest ranks of ranges of places, by minima over powers of two."""

    def __init__(self, rank: np.ndarray, at: np.ndarray):
        self.at, self.minima = at, [rank]  # at: the place of a rank

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        out = np.full(len(low), len(self.at))
        size = high - low
        some = np.flatnonzero(size > 0)
        if len(some):
            step = np.frexp(size[some].astype(np.float64))[1] - 1
            while len(self.minima) <= step.max():
                half, t = 1 << (len(self.minima) - 1), self.minima[-1]
                self.minima.append(np.minimum(t[:-half], t[half:]))
            for j in np.unique(step):
                i, t = some[step == j], self.minima[j]
                out[i] = np.minimum(t[low[i]], t[high[i] - (1 << int(j))])
        return out

    def first(self, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(range, place) of the k smallest ranks of each range."""
        size = high - low
        few = np.flatnonzero(size <= k)
        row, place = _spread(size[few], low[few])
        rows, places = [few[row]], [place]
        many = np.flatnonzero(size > k)
        if len(many):  # the least splits its range in two, k times
            n = np.arange(len(many))
            lows, highs = np.zeros((2, k + 1, len(many)), dtype=np.int64)
            best = np.full((k + 1, len(many)), len(self.at))
            lows[0], highs[0] = low[many], high[many]
            best[0] = self.least(lows[0], highs[0])
            for turn in range(1, k + 1):
                which = best.argmin(0)
                p = self.at[best[which, n]]
                rows.append(many)
                places.append(p)
                lows[turn], highs[turn] = p + 1, highs[which, n]
                highs[which, n] = p
                if turn < k:
                    best[turn] = self.least(lows[turn], highs[turn])
                    best[which, n] = self.least(lows[which, n], p)
        return np.concatenate(rows), np.concatenate(places)


def _tile_search(k: int, lookback: int, radius: float, max_abs_lat: float, last: bool):
    """Answers the targets of a tile: those with k sales within the radius (at the last
    radius: any) get all sales that can be among their k nearest, the others none and ``done`` false.

    Sales of a place stand in order of their days, so a window is a range, of which the k smallest ids are
    taken without looking at the others. Cells of places are doubled until a target has k sales in reach."""

    def search(key, asked, sales):
        lat, lon, day = (asked.column(c).to_numpy() for c in ("__lat", "__lon", "__tday"))
        sales = sales.take(pa.array(np.lexsort([sales.column(c).to_numpy() for c in ("__cday", "__clon", "__clat")])))
        y, x, sold = (sales.column(c).to_numpy() for c in ("__clat", "__clon", "__cday"))
        hits, found = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        done = np.zeros(len(lat), dtype=bool)
        if len(y) and len(lat):
            start = np.flatnonzero(np.concatenate([[True], (y[1:] != y[:-1]) | (x[1:] != x[:-1])]))
            number = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(y))))
            py, px, day0 = y[start], x[start], int(sold.min())
            span = int(sold.max()) - day0 + 1
            when = number * span + (sold - day0)
            at = pc.sort_indices(sales, sort_keys=[("__cid", "ascending")], null_placement="at_start").to_numpy().astype(np.int64)
            rank = np.empty(len(at), dtype=np.int64)
            rank[at] = np.arange(len(at))
            ranges = _Ranges(rank, at)

            def cells(reach):
                dy, dx = cell_sizes_for_radius(reach + 1e-6, max_abs_lat)
                cy, cx = np.floor(py / dy).astype(np.int64), np.floor(px / dx).astype(np.int64)
                west, width = cx.min(), cx.max() - cx.min() + 1
                code = cy * width + (cx - west)
                order = np.argsort(code, kind="stable")
                return dy, dx, west, width, code[order], order

            reach = radius
            made = cells(reach)
            for _ in range(14):  # places that lie closer together than that are met at once
                if np.diff(np.flatnonzero(np.concatenate([[True], made[4][1:] != made[4][:-1], [True]]))).max() <= CELL_PLACES:
                    break
                reach /= 2
                made = cells(reach)
            todo = np.arange(len(lat))
            while True:
                dy, dx, west, width, code, order = made
                whole = reach >= radius
                cy, cx = np.floor(lat[todo] / dy).astype(np.int64), np.floor(lon[todo] / dx).astype(np.int64)
                left, right = (np.clip(cx - west + o, 0, width) for o in (-1, 2))
                rows3 = [(np.searchsorted(code, (cy + o) * width + left), np.searchsorted(code, (cy + o) * width + right)) for o in (-1, 0, 1)]
                sizes = np.stack([b - a for a, b in rows3])
                total = sizes.sum(0).cumsum()
                cuts = np.unique(np.concatenate([[0], np.searchsorted(total, np.arange(PAIR_ROWS, total[-1], PAIR_ROWS)), [len(todo)]])) if len(todo) else np.zeros(1, dtype=np.int64)
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    few = todo[a:b]
                    pairs = [_spread(n[a:b], lo[a:b]) for n, (lo, _) in zip(sizes, rows3, strict=True)]
                    t, place = (np.concatenate([q[i] for q in pairs]) for i in (0, 1))
                    place = order[place]
                    d = _km(lat[few[t]], lon[few[t]], py[place], px[place])
                    near = d <= reach * (1 + 1e-9) + 1e-9
                    t, place, d = t[near], place[near], d[near]
                    low = np.searchsorted(when, place * span + np.clip(day[few[t]] - lookback - day0, 0, span))
                    high = np.searchsorted(when, place * span + np.clip(day[few[t]] - day0, 0, span))
                    there = high > low
                    t, d, low, high = t[there], d[there], low[there], high[there]
                    n = high - low
                    enough = np.bincount(t, weights=n * (d <= reach), minlength=len(few)) >= k
                    done[few] = enough | (last and whole)
                    mine = done[few[t]]
                    t, d, low, high, n = t[mine], d[mine], low[mine], high[mine], n[mine]
                    by = np.lexsort((d, t))
                    t, d, low, high, n = t[by], d[by], low[by], high[by], n[by]
                    seen = np.cumsum(n)
                    head = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.zeros(0, dtype=np.int64)
                    seen = seen - np.repeat((seen - n)[head], np.diff(np.append(head, len(t))))
                    full, at_k = np.unique(t[seen >= k], return_index=True)
                    bound = np.full(len(few), np.inf)
                    bound[full] = d[seen >= k][at_k]  # the distance of the k-th
                    mine = d <= bound[t] * (1 + 1e-9) + 1e-9
                    row, place = ranges.first(low[mine], high[mine], k)
                    hits.append(few[t[mine][row]])
                    found.append(place)
                if whole:
                    break
                todo = todo[~done[todo]]
                reach = min(radius, reach * 2)
                made = cells(reach)
        t, place = np.concatenate(hits), np.concatenate(found)
        by = np.argsort(t, kind="stable")
        taken = sales.select(_COMP).take(pa.array(place[by])).combine_chunks()
        structs = pa.StructArray.from_arrays([taken.column(c).combine_chunks() if isinstance(taken.column(c), pa.ChunkedArray) else taken.column(c) for c in _COMP], names=_COMP)
        offsets = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=len(lat)))])
        out = asked.select(_ASKED).append_column("done", pa.array(done)).append_column("near", pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs, type=pa.list_(pa.field("element", structs.type))))
        return out.filter(pa.array(np.diff(offsets) > 0)) if last else out

    return search


_ASKED = ["__seg", "__lat", "__lon", "__tday"]
_COMP = ["__clat", "__clon", "__cid", "__cday", "__cprice", "__csqft"]


def _comps_by_tiles(sales: DataFrame, key: Sequence[str], lat: str, lon: str, sale_id: str, sale_date: str, as_of: str, price: str, sqft: str, segment: str, k: int,
        lookback_days: int, min_price: float, max_km: float, levels: int, min_sqft: float) -> DataFrame:
    """The features of every key. Distinct (segment, place, day) are asked once and meet
    the sales in tiles: a segment, some years and a square of ``TILE`` search radii, to which sales within a radius
    of it come too, so a row is sent about twice and no pair is ever shuffled. The first radius
    is the largest at which no tile holds more than ``TILE_ROWS`` rows; targets that have
    fewer than k sales within it ask again at a radius ``TILE_STEP`` times as large, up to ``max_km``,
    and meet the sales around them alone. A place and day keep their first k sales."""
    ship_package(sales.sparkSession)
    located = F.col(segment).isNotNull() & F.col(lat).isNotNull() & F.col(lon).isNotNull()
    place = [F.col(segment).alias("__seg"), F.col(lat).cast("double").alias("__lat"), F.col(lon).cast("double").alias("__lon")]
    keys = materialize(sales.where(located & F.col(as_of).isNotNull()).select(*key, *place, F.unix_date(F.col(as_of)).alias("__tday")).dropDuplicates(key), "comp-targets")
    sold = sales.where(located & (F.col(price) >= min_price) & F.col(sale_date).isNotNull()).select(
        *place, F.col(sale_id).alias("__cid"), F.unix_date(F.col(sale_date)).alias("__cday"), F.col(price).alias("__cprice"), F.col(sqft).alias("__csqft"))
    first = Window.partitionBy("__seg", "__lat", "__lon", "__cday").orderBy("__cid")
    sold = sold.withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= k).drop("__r")
    sold = materialize(sold.withColumnsRenamed({"__lat": "__clat", "__lon": "__clon"}), "comp-sales")
    asked = materialize(keys.select(*_ASKED).distinct(), "comp-asked")
    bbox, _ = _bbox([(asked, "__lat", "__lon"), (sold, "__clat", "__clon")])
    max_abs_lat = 60.0 if bbox is None else min(89.0, max(abs(bbox[0]), abs(bbox[1])))
    radii = [max_km / TILE_STEP**i for i in range(max(1, levels // 2 + 1))]
    years = TILE_YEARS * lookback_days
    index = lambda c, d: F.floor(c / F.lit(d)).cast("bigint")

    def side(r: float) -> tuple[float, float]:
        return tuple(TILE * d for d in cell_sizes_for_radius(r, max_abs_lat))

    both = asked.unionByName(sold.select("__seg", F.col("__clat").alias("__lat"), F.col("__clon").alias("__lon"), F.col("__cday").alias("__tday")))
    at = 0
    while at < len(radii) - 1:
        dy, dx = side(radii[at])
        tiles = both.groupBy("__seg", index(F.col("__tday"), years), index(F.col("__lat"), dy), index(F.col("__lon"), dx)).count()
        if (tiles.agg(F.max("count")).first()[0] or 0) <= TILE_ROWS:
            break
        at += 1

    tile = ["__seg", "__ty", "__tx", "__tt"]
    compared = [F.col(f.name) for f in sold.schema.fields]
    near_type = ArrayType(StructType(sold.select(*_COMP).schema.fields))
    parts, todo = [], asked
    for i in range(at, -1, -1):
        r = radii[i]
        dy, dx = side(r)
        cy, cx = cell_sizes_for_radius(r, max_abs_lat)
        some = sold
        if i < at:  # the sales that targets still open can reach
            open_ = todo.groupBy("__seg", index(F.col("__lat"), cy).alias("__cy"), index(F.col("__lon"), cx).alias("__cx")).agg(F.min("__tday").alias("__from"), F.max("__tday").alias("__to"))
            offsets = F.explode(F.array(*[F.struct(F.lit(a).alias("y"), F.lit(b).alias("x")) for a, b in _NEIGHBOURS]))
            open_ = open_.withColumn("__o", offsets).groupBy("__seg", (F.col("__cy") + F.col("__o.y")).alias("__cy"), (F.col("__cx") + F.col("__o.x")).alias("__cx")).agg(
                F.min("__from").alias("__from"), F.max("__to").alias("__to"))
            some = sold.withColumn("__cy", index(F.col("__clat"), cy)).withColumn("__cx", index(F.col("__clon"), cx)).join(open_, ["__seg", "__cy", "__cx"])
            some = some.where((F.col("__cday") < F.col("__to")) & (F.col("__cday") >= F.col("__from") - lookback_days)).select(*compared)
        around = lambda c, d, w: F.explode(F.sequence(index(F.col(c) - d, w), index(F.col(c) + d, w)))
        some = some.withColumn("__ty", around("__clat", cy, dy)).withColumn("__tx", around("__clon", cx, dx)).withColumn(
            "__tt", F.explode(F.sequence(index(F.col("__cday") + 1, years), index(F.col("__cday") + lookback_days, years))))
        t = todo.withColumn("__ty", index(F.col("__lat"), dy)).withColumn("__tx", index(F.col("__lon"), dx)).withColumn("__tt", index(F.col("__tday"), years))
        schema = StructType([*asked.select(*_ASKED).schema.fields, StructField("done", BooleanType()), StructField("near", near_type)])
        got = t.groupBy(*tile).cogroup(some.groupBy(*tile)).applyInArrow(_tile_search(k, lookback_days, r, max_abs_lat, i == 0), schema)
        comp = lambda x: F.struct(haversine_km(F.col("__lat"), F.col("__lon"), x["__clat"], x["__clon"]).alias("d"), x["__cid"].alias("id"), x["__cday"].alias("day"),
                                  x["__cprice"].alias("price"), x["__csqft"].alias("sqft"))
        sel = F.slice(F.sort_array(F.filter(F.transform("near", comp), lambda x: x["d"] <= max_km)), 1, k)
        level = materialize(_comp_features(got.select(*_ASKED, "done", sel.alias("sel")), [*_ASKED, "done"], min_sqft), "comp-level")
        parts.append(level.where("done").drop("done"))
        if i and (todo := level.where("not done").select(*_ASKED)).isEmpty():
            break
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return keys.join(found.where("comp_count > 0"), _ASKED).drop(*_ASKED)


def _comp_features(df: DataFrame, key: Sequence[str], min_sqft: float) -> DataFrame:
    """Key and features of ``sel``, the comps nearest first."""
    prices = F.sort_array(F.transform("sel", lambda x: x["price"]))
    ppsf = F.sort_array(F.transform(F.filter("sel", lambda x: x["sqft"] > min_sqft), lambda x: x["price"] / x["sqft"]))
    df = df.withColumns({"__prices": prices, "__ppsf": ppsf})  # sorted once, not for every quantile
    return df.select(
        *key,
        F.size("sel").alias("comp_count"),
        array_percentile(F.col("__prices"), 0.5).alias("comp_median_price"),
        array_percentile(F.col("__ppsf"), 0.5).alias("comp_median_ppsqft"),
        F.try_element_at("sel", F.lit(-1))["d"].alias("comp_search_dist_km"),
        (F.col("__tday") - F.array_max(F.transform("sel", lambda x: x["day"]))).alias("comp_recency_days"),
        array_percentile(F.col("__prices"), 0.25).alias("comp_p25_price"),
        array_percentile(F.col("__prices"), 0.75).alias("comp_p75_price"),
    )


def knn_temporal_comps(
    sales: DataFrame,
    key: Sequence[str] = ("bbl", "as_of_date", "comp_segment"),
    lat: str = "latitude",
    lon: str = "longitude",
    sale_id: str = "sale_id",
    sale_date: str = "sale_date",
    as_of: str = "as_of_date",
    price: str = "sales_price",
    sqft: str = "gross_sqft",
    segment: str = "comp_segment",
    k: int = 5,
    lookback_days: int = 365,
    min_price: float = 100_000,
    max_km: float = 5.0,
    radii: Sequence[float] = (1.25, 5.0),
    levels: int = 13,
    dense: int = 20,
    min_sqft: float = 100.0,
) -> DataFrame:
    """Comparable-sales features per target (key): the k nearest prior sales of
    the same segment with ``as_of - lookback <= sale_date < as_of``, price >=
    ``min_price`` and distance <= ``max_km`` (ties by sale id); count, median /
    p25 / p75 price, median price per sqft (sqft > ``min_sqft``), distance to
    the last selected comp, days since the newest selected comp.

    Two plans with the same results, chosen by a count of the sales of the fullest
    cell: below ``dense`` sales a cell of the first radius and year, ``_comps_by_radii``
    (few joins); beyond, ``_comps_by_tiles``, where no pair of a target and a sale is shuffled or sorted.
    """
    key = list(key)
    columns = (key, lat, lon, sale_id, sale_date, as_of, price, sqft, segment, k, lookback_days, min_price, max_km)
    known = sales.where((F.col(price) >= min_price) & F.col(segment).isNotNull() & F.col(lat).isNotNull() & F.col(lon).isNotNull() & F.col(sale_date).isNotNull())
    side = min(radii) / KM_PER_DEG
    cells = known.groupBy(segment, F.floor(F.unix_date(sale_date) / lookback_days), F.floor(F.col(lat) / side), F.floor(F.col(lon) / side)).agg(F.count(F.lit(1)).alias("n"))
    most = cells.agg(F.max("n")).first()[0] or 0
    if most < dense:
        return _comp_features(_comps_by_radii(sales, *columns, radii), key, min_sqft)
    return _comps_by_tiles(sales, *columns, levels, min_sqft)
