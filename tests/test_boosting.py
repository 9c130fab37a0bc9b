"""Boosted trees against a plain booster on raw values, in one block and in many."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lotline.operators import boosting
from lotline.operators.boosting import Model, Trees

NUMERIC, CATEGORICAL = ["a", "b", "c"], ["k", "z"]


def made_rows(n=500, seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, k, z = rng.uniform(0, 10), rng.randint(0, 6), rng.choice("pqrstu"), rng.choice(["u", "v", None])
        c = None if rng.random() < 0.1 else rng.gauss(0, 1)
        y = np.sin(a) * 2 + (b > 3) + {"p": 2.0, "q": -1.0}.get(k, 0.0) + (c or 0) * 0.3 + rng.gauss(0, 0.2)
        rows.append((rng.choice("xy") if i > 200 else "x", "train" if i % 5 else "test", i * 7919, float(y), a, float(b), c, k, z))
    return pd.DataFrame(rows, columns=["dataset", "role", "id", "label", *NUMERIC, *CATEGORICAL])


@pytest.fixture(scope="module")
def data(spark):
    pdf = made_rows()
    schema = "dataset string, role string, id long, label double, a double, b double, c double, k string, z string"
    return pdf, spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(), schema).cache()


def filled(pdf, train, spec):
    out = pdf.copy()
    for c, v in zip(NUMERIC, spec["fill"], strict=True):
        out[c] = out[c].fillna(v)
        if train[c].isna().any():
            assert v == train[c].median()
    for c in CATEGORICAL:
        n = train[c].value_counts()
        out[c] = out[c].fillna(sorted(n.index[n == n.max()])[0])
    return out


def plain(train, both, spec, p, features):
    """A booster over raw values: every cut and category is tried on every node."""
    cuts = [(f, "<", x) for f, c in zip(NUMERIC, spec["cuts"], strict=True) if f in features for x in c]
    cuts += [(f, "!=", x) for f in CATEGORICAL if f in features for x in sorted(train[f].unique())]
    columns = [f for f in NUMERIC if f in features] + [(f, x) for f in CATEGORICAL if f in features for x in sorted(train[f].unique())]
    left = lambda d, s: (d[s[0]] < s[2] if s[1] == "<" else d[s[0]] != s[2]).to_numpy()
    on_train, on_both = [left(train, s) for s in cuts], [left(both, s) for s in cuts]
    y = train["label"].to_numpy()
    base = np.rint(y * 2**20).sum() / 2**20 / len(y)
    at_train, at_both = np.full(len(train), base), np.full(len(both), base)
    soft = lambda g: np.sign(g) * max(abs(g) - p.reg_alpha, 0)
    quality = lambda g, n: soft(g) ** 2 / (n + p.reg_lambda)
    for t in range(p.n_estimators):
        g = np.rint((at_train - y) * 2**20) / 2**20
        keep = boosting.row_draw(train["id"].to_numpy(np.int64), p, t)
        keep = np.ones(len(y), bool) if keep is None else keep
        k = max(1, int(p.colsample_bytree * len(columns)))
        chosen = range(len(columns)) if k >= len(columns) else set(np.random.default_rng([p.seed, t]).choice(len(columns), k, replace=False).tolist())
        drawn = {columns[i] for i in chosen}

        def split(rows, rows_both, depth):
            mine = rows & keep
            tg, tn = g[mine].sum(), mine.sum()
            best = (1e-6, None)
            for i, s in enumerate(cuts if depth < p.max_depth else []):
                if (s[0] if s[1] == "<" else (s[0], s[2])) not in drawn:
                    continue
                lo, hi = mine & on_train[i], mine & ~on_train[i]
                if min(lo.sum(), hi.sum()) < p.min_child_weight:
                    continue
                gain = quality(g[lo].sum(), lo.sum()) + quality(g[hi].sum(), hi.sum()) - quality(tg, tn)
                if gain > best[0] + 1e-9:
                    best = (gain, i)
            if best[1] is None or best[0] < p.gamma:
                v = -soft(tg) / (tn + p.reg_lambda) * p.learning_rate if tn else 0.0
                at_train[rows] += v
                at_both[rows_both] += v
                return
            i = best[1]
            split(rows & on_train[i], rows_both & on_both[i], depth + 1)
            split(rows & ~on_train[i], rows_both & ~on_both[i], depth + 1)

        split(np.ones(len(y), bool), np.ones(len(both), bool), 0)
    return at_both


MODELS = [Model("x1", "x", Trees(12, 0.3, 3, 3, 0.8, 0.7, 0.05, 0.1, 1.0, 1)), Model("x2", "x", Trees(5, 0.5, 2, 10, 1.0, 1.0, 0.0, 0.0, 3.0, 2), ("a", "k")),
          Model("y1", "y", Trees(8, 0.2, 4, 2, 0.7, 0.5, 0.3, 1.0, 2.0, 0))]


@pytest.fixture(scope="module")
def specs(data):
    return boosting.layouts(data[1].where("role = 'train'"), NUMERIC, CATEGORICAL, cells=16)


def predictions(data, specs, block_rows, models=MODELS):
    made = boosting.blocks(data[1], specs, block_rows)
    forests = boosting.fit(made, specs, models)
    return made, forests, {(r.model, r.id): r.log_pred for r in boosting.score(made, specs, forests).collect()}


def test_equals_a_plain_booster(data, specs):
    pdf, _ = data
    _, _, got = predictions(data, specs, 10_000)
    for m in MODELS:
        mine = pdf[pdf["dataset"] == m.dataset]
        train = mine[mine["role"] == "train"]
        both, train = filled(mine, train, specs[m.dataset]), filled(train, train, specs[m.dataset])
        want = plain(train.sort_values("id"), both, specs[m.dataset], m.trees, m.features or (*NUMERIC, *CATEGORICAL))
        assert [got[m.name, i] for i in both["id"]] == pytest.approx(want.tolist(), abs=1e-9)
        held = (both["role"] == "test").to_numpy()
        truth = both["label"].to_numpy()[held]
        if m.name == "x1":
            assert 1 - ((want[held] - truth) ** 2).sum() / ((truth - truth.mean()) ** 2).sum() > 0.7


def test_many_blocks_grow_the_same_trees(data, specs, monkeypatch):
    monkeypatch.setattr(boosting, "STORE_TREES", 3)
    few = [m.__class__(m.name, m.dataset, Trees(**{**vars(m.trees), "n_estimators": n, "max_depth": 2}), m.features) for m, n in zip(MODELS, (4, 2, 5), strict=True)]
    _, one, got_one = predictions(data, specs, 10_000, few)
    made, many, got_many = predictions(data, specs, 60, few)
    assert made.where("role = 'train'").groupBy("dataset").count().where("count > 1").count() == 2
    assert got_one == got_many
    a, b = ({(r.model, r.tree, r.node): (r.feature, r.below, r.category, r.value, r.gain) for r in boosting.nodes(f, specs).collect()} for f in (one, many))
    assert a == b and len(a) > 30


def test_the_forest_table_walks_to_the_predictions(data, specs):
    pdf, _ = data
    _, forests, got = predictions(data, specs, 10_000, MODELS[:1])
    table = {(r.tree, r.node): r for r in boosting.nodes(forests, specs).collect()}
    base = float(np.load(boosting.io.BytesIO(forests.first().forest))["base"])
    mine = pdf[pdf["dataset"] == "x"]
    for _, row in filled(mine, mine[mine["role"] == "train"], specs["x"]).head(60).iterrows():
        total = base
        for t in range(12):
            node = table[t, 1]
            while node.feature is not None:
                right = row[node.feature] == node.category if node.below is None else row[node.feature] >= node.below
                node = table[t, 2 * node.node + int(right)]
            total += node.value
        assert total == pytest.approx(got["x1", row["id"]], abs=1e-9)
    shares = boosting.importance(forests, specs).collect()
    assert sum(r.importance for r in shares) == pytest.approx(1.0) and {"a", "k_p"} <= {r.feature for r in shares}


def test_unknown_categories_missing_values_and_empty_columns(spark, specs, data):
    rows = data[1].withColumn("c", F.lit(None).cast("double"))
    spec = boosting.layouts(rows.where("role = 'train'"), NUMERIC, CATEGORICAL)
    assert spec["x"]["cuts"][2] == [] and spec["x"]["fill"][2] == 0.0
    odd = spark.createDataFrame([("x", "test", 1, None, None, None, None, "never seen", None), ("nowhere", "test", 2, 1.0, 1.0, 1.0, 1.0, "p", "u")], rows.schema)
    made = boosting.blocks(rows.unionByName(odd), spec)
    got = boosting.score(made, spec, boosting.fit(made, spec, MODELS)).where("role = 'test'").collect()
    assert [r.model for r in got if r.id == 1] == ["x1", "x2"] or sorted(r.model for r in got if r.id == 1) == ["x1", "x2"]
    assert not [r for r in got if r.id == 2] and all(np.isfinite(r.log_pred) for r in got)


def test_no_rows_and_too_many_categories(data, monkeypatch):
    none = data[1].where("false")
    spec = boosting.layouts(none, NUMERIC, CATEGORICAL)
    made = boosting.blocks(none, spec)
    assert spec == {} and made.count() == 0 and boosting.fit(made, spec, MODELS).count() == 0
    monkeypatch.setattr(boosting, "MAX_CATEGORIES", 3)
    with pytest.raises(ValueError):
        boosting.layouts(data[1], NUMERIC, CATEGORICAL)
