"""The JVM kernel against numpy, models that share tasks, blocks, and quantiles of which little is stored."""

import math
import random
from dataclasses import replace

import numpy as np
import pytest

from lotline.operators import boosting, kernel, model
from lotline.operators.boosting import Model, Trees
from lotline.operators.quantiles import exact_quantiles

NUMERIC, CATEGORICAL = ["a", "b", "c"], ["k", "many"]
TREES = Trees(7, 0.3, 4, 3, 0.8, 0.6, 0.05, 0.2, 1.5, 3)
MODELS = [Model("x#0", "x", TREES), Model("x#1", "x", replace(TREES, subsample=1.0, colsample_bytree=1.0, reg_alpha=0.0, seed=9)), Model("x#2", "x", replace(TREES, max_depth=1, gamma=2.0), ("b", "k")),
          Model("x#3", "x", replace(TREES, max_depth=6, min_child_weight=1.0, n_estimators=3)), Model("y#0", "y", replace(TREES, min_child_weight=40)), Model("y#1", "y", replace(TREES, n_estimators=0))]


@pytest.fixture(scope="module")
def rows(spark):
    rng, out = random.Random(8), []
    for i in range(1500):
        a, b, c = rng.uniform(-3, 9), float(rng.randint(0, 4)), None if rng.random() < 0.2 else rng.gauss(0, 2)
        k, many = rng.choice(["p", "q", "r", None]), f"m{rng.randint(0, 400)}"
        role = "train" if i % 4 else "request" if i % 8 else None
        out.append(("x" if i % 3 else "y", role, (i - 700) * 104_729, None if role == "request" else a * 0.3 + (b > 2) + (k == "q") + rng.gauss(0, 0.3), a, b, c, k, many))
    return spark.createDataFrame(out, "dataset string, role string, id long, label double, a double, b double, c double, k string, many string").cache()


def forests_and_scores(made, specs):
    forests = boosting.fit(made, specs, MODELS)
    scores = {(r.model, r.role, r.id): (r.label, r.log_pred) for r in boosting.score(made, specs, forests).collect()}
    return {r.model: (r.n_trees, bytes(r.forest)) for r in forests.collect()}, scores


@pytest.mark.parametrize("categorical, size", [(CATEGORICAL, 2), (["k"], 1)])
def test_kernel_and_numpy_give_the_same_bits(rows, monkeypatch, categorical, size):
    specs = boosting.layouts(rows.where("role = 'train'"), NUMERIC, categorical, cells=32)
    made = boosting.blocks(rows, specs, 300).cache()
    assert max(r.bins[0] for r in made.collect()) == size and made.where("role = 'train' and dataset = 'x'").count() > 1
    forests, scores = forests_and_scores(made, specs)
    monkeypatch.setattr(kernel, "functions", lambda spark: None)
    plain, plain_scores = forests_and_scores(made, specs)
    assert forests == plain and set(forests) == {m.name for m in MODELS}
    assert scores == plain_scores and len(scores) == 4 * 1000 + 2 * 500
    assert {label for (_, role, _), (label, _) in scores.items() if role == "request"} == {None}


def test_blocks_hold_every_row_once_in_order(rows):
    specs = boosting.layouts(rows.where("role = 'train'"), NUMERIC, CATEGORICAL, cells=32)
    seen = []
    for b in boosting.blocks(rows, specs, 100).collect():
        ids = np.frombuffer(b.ids, dtype=np.int64)
        assert len(ids) == b.n and (np.diff(ids) > 0).all() and boosting._unpacked(bytes(b.bins), b.n).shape == (5, b.n)
        seen += [(b.dataset, b.role, i) for i in ids.tolist()]
    assert sorted(map(str, seen)) == sorted(str((r.dataset, r.role, r.id)) for r in rows.collect())


def test_models_share_tasks_when_copies_would_be_many(rows, monkeypatch):
    specs = boosting.layouts(rows.where("role = 'train'"), NUMERIC, CATEGORICAL, cells=32)
    made = boosting.blocks(rows, specs).cache()
    models = [Model(f"{d}#{i}", d, replace(TREES, n_estimators=1 + i, seed=i)) for d in "xy" for i in range(20)]
    alone = {r.model: bytes(r.forest) for r in boosting.fit(made, specs, models).collect()}
    monkeypatch.setattr(boosting, "COPY_ROWS", 1000)
    together = boosting._together(models, {"x": 750, "y": 375}, 8)
    assert len(together) == 8 and sorted(m.name for g in together for m in g) == sorted(alone) and all(len({m.dataset for m in g}) == 1 for g in together)
    assert {r.model: bytes(r.forest) for r in boosting.fit(made, specs, models).collect()} == alone


def test_shares_of_blocks_are_even_and_whole():
    blocks = [("a", "test", 0, 1000), ("a", "test", 1, 1000), ("b", "test", 0, 10), ("none", "test", 0, 5)]
    forests = [(f"a#{i}", "a", 100) for i in range(12)] + [("b#0", "b", 100)]
    shares = boosting._shares(blocks, forests, 8)
    assert sorted((b, m) for b, names in shares for m in names) == sorted((b, m) for b in blocks for m, d, _ in forests if d == b[0])
    assert max(len(names) for _, names in shares) <= 3 and shares[-1][0] == blocks[2]
    assert boosting._shares([], [], 8) == []


def test_thin_quantiles_are_the_same(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.choice([0.0, -0.5, 3.0, float("inf"), float("-inf"), float("nan"), None, rng.gauss(0, 1e6), rng.uniform(1000, 1001)])) for _ in range(3000)]
    rows += [("one", 7.0), ("none", None)]
    df, qs = spark.createDataFrame(rows, "g string, v double"), {"lo": 0.0, "q": 0.21, "mid": 0.5, "hi": 1.0}
    got, want = ({r.g: str(r) for r in exact_quantiles(df, ["g"], "v", qs, thin=t).collect()} for t in (True, False))
    assert got == want and set(got) == {"a", "b", None, "one"}
    assert exact_quantiles(df.where("g = 'none'"), ["g"], "v", qs, thin=True).count() == 0


def test_rows_of_many_data_sets_are_not_stored(spark, monkeypatch):
    kept, store = [], model.materialize
    monkeypatch.setattr(model, "materialize", lambda df, name: kept.append((name, df.count())) or store(df, name))
    df = spark.range(400).selectExpr("id", "concat('d', id % 4) dataset", "if(id % 5 = 0, 'test', 'train') role", "concat('n', id % 3) neighborhood", "'Bronx' borough_name", "double(id % 37) + 1 target")
    got = model.with_training_stats(df)
    assert max(n for _, n in kept) < 20 and got.count() == 400
    train = {}
    for r in df.where("role = 'train'").collect():
        train.setdefault((r["dataset"], r.neighborhood), []).append(r.target)
    assert all(math.isclose(r.neighborhood_median_price, float(np.median(train[r["dataset"], r.neighborhood]))) for r in got.collect())
