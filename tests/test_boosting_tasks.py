"""Boosted trees: sums of the smaller child alone, several blocks in one task."""

import random

import numpy as np
import pytest

from lotline.operators import boosting
from lotline.operators.boosting import Layout, Model, Trees

NUMERIC, CATEGORICAL = ["a", "b"], ["k"]
MODELS = [Model("one", "x", Trees(4, 0.3, 3, 3, 0.8, 0.7, 0.0, 0.1, 1.0, 1)), Model("two", "x", Trees(3, 0.2, 2, 2, 1.0, 1.0, 0.0, 0.0, 2.0, 2), ("b", "k"))]


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(3)
    rows = []
    for i in range(240):
        a, b, k = rng.uniform(0, 9), float(rng.randint(0, 5)), rng.choice("pqr")
        rows.append(("x", "train" if i % 6 else "test", i * 101, a * 0.2 + (b > 2) + (k == "q") + rng.gauss(0, 0.1), a, b, k))
    df = spark.createDataFrame(rows, "dataset string, role string, id long, label double, a double, b double, k string")
    specs = boosting.layouts(df.where("role = 'train'"), NUMERIC, CATEGORICAL, cells=8)
    return boosting.blocks(df, specs, 50).cache(), specs


def trees_of(forests, specs):
    return {(r.model, r.tree, r.node): (r.feature, r.below, r.category, r.value, r.gain) for r in boosting.nodes(forests, specs).collect()}


def test_blocks_that_fit_into_a_task_are_grown_in_one_job(made, monkeypatch):
    blocks, specs = made
    assert blocks.where("role = 'train'").count() > 2
    monkeypatch.setattr(boosting, "TASK_ROWS", 100)
    by_levels = trees_of(boosting.fit(blocks, specs, MODELS), specs)
    monkeypatch.undo()

    def never(*_):
        raise AssertionError("a job for every level of every tree")

    monkeypatch.setattr(boosting, "_grow_by_levels", never)
    assert trees_of(boosting.fit(blocks, specs, MODELS), specs) == by_levels


@pytest.mark.parametrize("scale", [1.0, 2.0**36])
def test_sums_by_cell_equal_plain_ones(scale):
    rng = np.random.default_rng(5)
    sizes, n, slots = [9, 4, 30_000], 3000, 3
    layout = Layout(sizes, [False, True, True])
    m = np.stack([rng.integers(0, k, n) for k in sizes], 1) + layout.start[:-1]
    g, rows = np.rint(rng.normal(0, 1e6, n)) * scale, np.flatnonzero(rng.random(n) < 0.6)
    slot = rng.integers(0, slots, len(rows))
    gs, ns = boosting.cell_sums(boosting.columns_of(m, layout), layout, rows, slot, slots, g)
    key = (slot[:, None] * layout.cells + m[rows]).ravel()
    assert np.array_equal(ns.ravel(), np.bincount(key, minlength=slots * layout.cells))
    assert np.array_equal(gs.ravel(), np.bincount(key, weights=np.repeat(g[rows], 3), minlength=slots * layout.cells))
    _, some = boosting.cell_sums(boosting.columns_of(m, layout), layout, rows, slot, slots, g, [0, 1])
    assert np.array_equal(some[:, :13], ns[:, :13]) and not some[:, 13:].any()
