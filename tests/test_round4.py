"""Searches by leaves against plain Python: every pair compared."""

import random

import pytest
from pyspark.sql import functions as F

from lotline.operators import spatial
from test_round3 import joined_rows

POINT = "id long, plat double, plon double, grp string"
TARGET = "key long, tlat double, tlon double, want string"


def far(a, b, c, d):
    from math import asin, cos, radians, sin, sqrt

    x = sin((radians(c) - radians(a)) / 2) ** 2 + cos(radians(a)) * cos(radians(c)) * sin((radians(d) - radians(b)) / 2) ** 2
    return 12742.0 * asin(sqrt(x))


def plane(a, b, c, d):
    return ((a - c) ** 2 + (b - d) ** 2) ** 0.5


@pytest.mark.parametrize("metric, matched, k, within", [("haversine", False, 3, None), ("haversine", True, 5, None), ("planar", True, 1, None), ("haversine", False, 1, 0.4), ("haversine", False, 100, None)])
def test_nearest_equals_all_pairs(spark, monkeypatch, metric, matched, k, within):
    """A crowded block, crowded places, the country around and a few points far away, with a sample
    much smaller than the points and targets of a leaf in several groups."""
    rng = random.Random(k)
    place = lambda: rng.choice([(40.7 + rng.random() * 1e-3, -73.9 + rng.random() * 1e-3), (40.7, -73.9), (rng.uniform(40, 41), rng.uniform(-74, -73)), (rng.uniform(-80, 80), rng.uniform(-180, 180))])
    points = [(i, *place(), rng.choice(["a", "b", "c"])) for i in range(1500)] + [(9000, None, 1.0, "a"), (9001, 40.7, -73.9, None)]
    targets = [(i, *place(), rng.choice(["a", "b", "z"])) for i in range(250)] + [(900, None, 1.0, "a"), (901, 40.7, -73.9, None)]
    monkeypatch.setattr(spatial, "TREE_SAMPLE", 600)
    monkeypatch.setattr(spatial, "LEAF_SAMPLE", 8)
    monkeypatch.setattr(spatial, "GROUP_TARGETS", 20)
    made = spatial.knn_search(spark.createDataFrame(targets, TARGET), spark.createDataFrame(points, POINT), ["key"], "tlat", "tlon", "plat", "plon", ["id"], ["grp"], k=k,
                              match=[("want", "grp")] if matched else [], metric=metric, within=within)
    got = {r["key"]: r.nn for r in made.collect()}
    d = far if metric == "haversine" else plane
    assert set(got) == {t[0] for t in targets if t[1] is not None}
    for key, la, lo, want in targets:
        if la is None:
            continue
        near = sorted((d(la, lo, b, c), i, g) for i, b, c, g in points if b is not None and (not matched or (g == want and g is not None)))
        near = [x for x in near if within is None or x[0] <= within][:k]
        assert [(x.id, x.grp) for x in got[key] or []] == [x[1:] for x in near]
        assert all(abs(x.d - y[0]) < 1e-6 for x, y in zip(got[key] or [], near, strict=True))


def test_nearest_across_the_date_line(spark):
    points = spark.createDataFrame([(1, 0.0, -179.9, "a"), (2, 0.0, 179.0, "a")], POINT)
    made = spatial.knn_search(spark.createDataFrame([(1, 0.0, 179.9, "a")], TARGET), points, ["key"], "tlat", "tlon", "plat", "plon", ["id"])
    assert made.first().nn[0].id == 1


def test_search_joins_no_pairs(spark):
    """20 000 targets among 20 000 points: no join yields more rows than there are targets."""
    at = lambda i, m: F.lit(40.0) + F.rand(i) * m
    points = spark.range(20_000).select(F.col("id"), at(1, 0.5).alias("plat"), at(2, 0.5).alias("plon"))
    targets = spark.range(20_000).select(F.col("id").alias("key"), at(3, 0.5).alias("tlat"), at(4, 0.5).alias("tlon"))
    made = spatial.knn_search(targets, points, ["key"], "tlat", "tlon", "plat", "plon", ["id"], k=3)
    assert made.where("size(nn) = 3").count() == 20_000
    made.collect()
    assert max(joined_rows(made)) <= 20_000


def test_empty_sides(spark):
    points, targets = spark.createDataFrame([(1, 0.0, 0.0, "a")], POINT), spark.createDataFrame([(1, 0.0, 0.0, "a"), (2, None, None, "a")], TARGET)
    look = lambda t, p: [(r["key"], r.nn) for r in spatial.knn_search(t, p, ["key"], "tlat", "tlon", "plat", "plon", ["id"]).collect()]
    assert look(targets, points.where("false")) == [(1, None)] and look(targets.where("false"), points) == []


def test_counts_of_crowded_places(spark):
    points = spark.createDataFrame([(i, 40.7, -73.9, "a") for i in range(50)] + [(99, 40.706, -73.9, "a")], POINT)
    made = spatial.count_within_radius(spark.createDataFrame([(1, 40.7, -73.9, "a"), (2, 50.0, 0.0, "a")], TARGET), points, ["key"], "tlat", "tlon", "plat", "plon", [0.5, 1.0], names=["a", "b"])
    assert {r["key"]: (r.a, r.b) for r in made.collect()} == {1: (50, 51), 2: (0, 0)}


def test_admissions_of_many_users_equal_one_by_one():
    """One call a batch for all users of a group: the same as a counter for each user."""
    import numpy as np
    import pandas as pd

    from lotline.streaming import counters

    class State:
        hasTimedOut = exists = False

        def update(self, x):
            self.exists, self.get = True, x

        def setTimeoutTimestamp(self, at):
            self.at = at

        def getCurrentWatermarkMs(self):
            return 0

    rng, t = np.random.default_rng(4), pd.Timestamp("2024-01-01")
    n = 3000
    rows = pd.DataFrame({"user_id": rng.integers(-(1 << 60), 1 << 60, 40)[rng.integers(0, 40, n)], "event_id": rng.permutation(n), "ts": t + pd.to_timedelta(rng.integers(0, 500, n), unit="min"),
                         "period_date": t.date(), "role": rng.choice(["user", "paid"], n, p=[0.95, 0.05])})
    rows.loc[rows["user_id"] % 2 == 0, "role"] = "user"
    rows.loc[5, "role"] = None
    many, calls, ok, want = State(), 0, {}, {}
    single = {u: State() for u in rows["user_id"].unique()}
    for batch in (rows.iloc[:1000], rows.iloc[1000:1100], rows.iloc[1100:]):
        for out in counters._admissions()((7, t.date()), iter([batch.iloc[::2], batch.iloc[1::2]]), many):
            calls += 1
            ok.update(zip(out["event_id"], out["admitted"], strict=True))
        for u, part in batch.groupby("user_id"):
            out = next(counters._admission()((u, t.date()), iter([part]), single[u]))
            want.update(zip(out["event_id"], out["admitted"], strict=True))
    assert ok == want and calls == 3 and len(ok) == n and 0 < sum(ok.values()) < n
    assert many.at == single[rows["user_id"][0]].at
    none = State()
    lost = pd.DataFrame({"user_id": [None] * 12, "event_id": range(12), "ts": t, "period_date": t.date(), "role": None})
    for _ in range(2):
        out = next(counters._admissions()((None, t.date()), iter([lost]), none))
    assert not out["admitted"].any()


def test_keys_that_come_twice(spark):
    """One row a key, unless the caller answers for the keys: then a row each."""
    points = spark.createDataFrame([(1, 0.0, 0.0, "a")], POINT)
    twice = spark.createDataFrame([(1, 0.5, 0.0, "a"), (1, 0.5, 0.0, "a"), (2, 0.1, 0.0, "a")], TARGET)
    look = lambda unique: sorted((r["key"], len(r.nn)) for r in spatial.knn_search(twice, points, ["key"], "tlat", "tlon", "plat", "plon", ["id"], k=3, unique_targets=unique).collect())
    assert look(False) == [(1, 1), (2, 1)] and look(True) == [(1, 1), (1, 1), (2, 1)]
