"""Totals of the fitted rates against targets; posteriors against languages."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from lotline.llm import mixing, queries

SF = SF_SMALL.replace("sf0.001", "sf0.01")


def _table(spark, n=400, k=3, seed=2):
    rng = np.random.default_rng(seed)
    p = rng.dirichlet([0.3] * k, n)
    t = rng.integers(0, 500, n)
    df = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(t, p)], "__tokens long, __p array<double>").repartition(4)
    return df, t, p


def test_totals_match_reachable_targets(spark):
    df, t, p = _table(spark)
    d = mixing.Domains(["a", "b", "c"], np.zeros((1, 3)))
    fitted = mixing.fit_rates(df, d, {"a": 0.5, "b": 0.3, "c": 0.2}, budget=float(t.sum()))
    assert np.allclose(fitted.totals, np.array([0.5, 0.3, 0.2]) * t.sum(), rtol=1e-4)
    got = df.select("__tokens", "__p", fitted.column().alias("r")).collect()
    assert min(r.r for r in got) >= 0
    assert np.allclose(sum(r.r * r["__tokens"] * np.array(r["__p"]) for r in got), fitted.totals)


def test_totals_match_when_the_bound_holds_many(spark):
    df, t, p = _table(spark, seed=4)
    d = mixing.Domains(["a", "b", "c"], np.zeros((1, 3)))
    weights = {"a": 0.9, "b": 0.06, "c": 0.04}
    fitted = mixing.fit_rates(df, d, weights, budget=float(t.sum()))
    rates = np.array([r.r for r in df.select(fitted.column().alias("r")).collect()])
    assert rates.min() == 0 and (rates == 0).sum() > 20
    assert np.allclose(fitted.totals, np.array(list(weights.values())) * t.sum(), rtol=1e-3)


def test_unreachable_targets_end(spark):
    df = spark.createDataFrame([(10, [0.5, 0.5]), (20, [0.6, 0.4])], "__tokens long, __p array<double>")
    d = mixing.Domains(["a", "b"], np.zeros((1, 2)))
    fitted = mixing.fit_rates(df, d, {"a": 1.0, "b": 0.0}, budget=30.0)
    assert 0 < fitted.totals[1] < fitted.totals[0]


def test_least_rate_never_drops_a_document(spark):
    df, t, p = _table(spark, seed=6)
    d = mixing.Domains(["a", "b", "c"], np.zeros((1, 3)))
    fitted = mixing.fit_rates(df, d, least=1.0)
    assert df.select(F.min(mixing.copies(fitted.column(), F.col("__tokens"))).alias("c")).first().c >= 1
    assert np.allclose(fitted.totals, fitted.targets, rtol=0.02)


def test_query_over_the_given_table(spark):
    rows = queries.QUERIES["op1_mixing"](spark, SF).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id for r in rows} == set(docs) and len(rows) == len(docs)
    assert all(r.n_tokens == len((docs[r.doc_id].text or "").split()) for r in rows)
    assert np.mean([r.domain == docs[r.doc_id].lang for r in rows]) > 0.97
    total = sum(r.n_tokens * np.array(r.posteriors) for r in rows)
    mixed = sum(r.n_tokens * r.rate * np.array(r.posteriors) for r in rows)
    want = (total / total.sum()) ** mixing.TEMPER
    assert np.allclose(mixed / mixed.sum(), want / want.sum(), atol=1e-3)
    drawn = sum(r.n_tokens * r.copies * np.array(r.posteriors) for r in rows)
    assert np.allclose(drawn, mixed, rtol=0.25)
    assert all(abs(r.copies - r.rate) < 1 for r in rows)


def test_nulls_repeats_extra_columns_and_no_rows(spark):
    df = spark.createDataFrame([(1, "der die das und", 1), (2, "the of and to", 2), (2, "the of and to", 2), (3, None, 3), (None, "", 4)], "doc_id long, text string, __x int")
    labelled = spark.createDataFrame([(1, "de"), (2, "en"), (3, None), (None, "en")], "doc_id long, domain string")
    rows = mixing.mix(df, labelled)[0].collect()
    assert len(rows) == 5
    assert len({(r.rate, r.copies) for r in rows if r.doc_id == 2}) == 1
    assert mixing.resample(df, labelled, least=1.0).columns == df.columns
    assert mixing.resample(df, labelled, least=1.0).select("doc_id").distinct().count() == 4
    assert mixing.mix(df.limit(0), labelled)[0].count() == 0
    assert {r.rate for r in mixing.mix(df, labelled.limit(0), budget=24.0)[0].collect()} == {2.0}


def test_rare_domains_count_and_unknown_ones_are_errors(spark):
    docs = spark.createDataFrame([(i, "the usual words of it" if i else "zyx qvw kjh") for i in range(300)], "doc_id long, text string")
    labelled = docs.selectExpr("doc_id", "if(doc_id = 0, 'rare', if(doc_id % 2 = 0, 'a', 'b')) domain").unionByName(
        spark.createDataFrame([(10**6, "nowhere")], "doc_id long, domain string"))
    domains = mixing.fit_domains(docs, labelled, train_rows=5)
    assert domains.names == ["a", "b", "rare"]
    table = mixing.memberships(docs, domains)
    with pytest.raises(ValueError, match="nowhere"):
        mixing.fit_rates(table, domains, {"a": 1.0, "nowhere": 1.0})
