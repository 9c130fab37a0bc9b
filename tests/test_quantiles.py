"""Exact quantiles by counting: ties, hot groups, odd values, small steps."""

import numpy as np
import pytest

from lotline.operators.quantiles import exact_quantiles, exact_quantiles_with_global


def _check(rows, df, qs, **kw):
    got = {r.g: r for r in exact_quantiles(df, ["g"], "v", qs, **kw).collect()}
    by = {}
    for g, v in rows:
        if v is not None:
            by.setdefault(g, []).append(v)
    assert set(got) == set(by)
    for g, vs in by.items():
        for name, q in qs.items():
            assert got[g][name] == pytest.approx(np.quantile(np.array(vs), q), rel=1e-12), (g, name)


QS = {"p0": 0.0, "p02": 0.02, "p50": 0.5, "p99": 0.99, "p100": 1.0}


@pytest.mark.parametrize("kw", [{}, {"max_band": 3, "cells": 4}])
def test_quantiles_of_uneven_groups(spark, kw):
    rng = np.random.default_rng(1)
    rows = [("hot", float(x)) for x in np.exp(rng.normal(10, 4, 900))] + [("ties", float(x)) for x in rng.integers(0, 4, 300)]
    rows += [("one", 5.0), ("two", 1.0), ("two", 2.0), ("gone", None), (None, 7.5), (None, 8.5), ("wide", -1e308), ("wide", 1e308), ("wide", 0.0), ("wide", 1e-300)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    _check(rows, df, QS, **kw)


def test_endless_values(spark):
    rows = [("a", float("-inf")), ("a", 1.0), ("a", 2.0), ("a", float("inf")), ("a", 3.0)]
    got = exact_quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"lo": 0.0, "mid": 0.5, "hi": 1.0}, max_band=1, cells=2).first()
    assert (got.lo, got.mid, got.hi) == (float("-inf"), 2.0, float("inf"))


def test_two_million_equal_values_and_a_hot_group(spark):
    from pyspark.sql import functions as F

    df = spark.range(2_000_000).select(F.lit("same").alias("g"), F.lit(7.25).alias("v"))
    df = df.unionByName(spark.range(600_000).select(F.lit("hot").alias("g"), (F.col("id") * 0.5).alias("v")))
    df = df.unionByName(spark.range(1_000).select(F.concat(F.lit("g"), (F.col("id") % 5).cast("string")).alias("g"), (F.col("id") % 50).cast("double").alias("v")))
    got = {(r["__scope"], r.g): r.m for r in exact_quantiles_with_global(df, ["g"], "v", {"m": 0.5}).collect()}
    assert got["group", "same"] == 7.25 and got["group", "hot"] == 149999.75
    assert got["group", "g0"] == 22.5 and got["all", None] == 7.25


def test_plans_build_no_lists(spark):
    import inspect

    from lotline.operators import quantiles
    assert "collect_list" not in inspect.getsource(quantiles) and "collect_set" not in inspect.getsource(quantiles)
