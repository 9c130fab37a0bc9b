"""Training, evaluation and scoring tables on small data with few trees."""

import datetime as dt
import math
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from lotline.operators import model
from lotline.operators.boosting import Model, Trees
from lotline.operators.stats import regression_metrics

FEW = Trees(n_estimators=3, learning_rate=0.3, max_depth=2, gamma=0.0)
NUMERIC, CATEGORICAL = ["sqft", "units", "neighborhood_median_price"], ["segment"]


@pytest.fixture(scope="module")
def sales(spark):
    rng = random.Random(4)
    rows = []
    for i in range(360):
        sqft, year = rng.uniform(500, 4000), 1994 + i % 6
        rows.append((i, "a" if i % 3 else "b", sqft, float(rng.randint(1, 9)), 100.0 * sqft * rng.uniform(0.9, 1.1), dt.date(year, 1 + i % 12, 5)))
    df = spark.createDataFrame(rows, "id long, segment string, sqft double, units double, target double, sale_date date")
    df = df.withColumn("dataset", F.lit("all")).withColumn("role", F.lit("train")).withColumn("neighborhood", F.lit("n")).withColumn("borough_name", F.lit("Bronx"))
    return model.with_training_stats(df).cache()


def trained(rows, models):
    return model.Trained(rows, models, NUMERIC, CATEGORICAL)


def test_predictions_are_dollars_and_follow_the_size(sales):
    t = trained(sales, [Model("m", "all", Trees(25, 0.3, 3))])
    p = t.predictions().select(F.expm1("label").alias("price"), model.dollars(F.col("log_pred")).alias("prediction"))
    assert p.count() == 360 and regression_metrics(p, "price", "prediction").first().r2 > 0.8
    clipped = sales.sparkSession.range(1).select(model.dollars(F.lit(-3.0)).alias("a"), model.dollars(F.lit(99.0)).alias("b")).first()
    assert clipped.a == 0.0 and clipped.b == pytest.approx(math.expm1(20.7))


def test_ensemble_averages_its_members(sales):
    t = trained(sales, model.members("k", FEW, "all", ["sqft"], (0, 1)))
    each = {}
    for r in t.predictions().collect():
        each.setdefault(r.id, {})[r.model] = math.expm1(r.log_pred)
    assert len(each) == 360 and any(abs(v["k#0"] - v["k#1"]) > 1 for v in each.values())
    for r in model.ensemble_mean(t.predictions()).collect():
        a, b = each[r.id]["k#0"], each[r.id]["k#1"]
        assert r.key == "k" and r.prediction == pytest.approx(((1 + a) * (1 + b)) ** 0.5 - 1, rel=1e-9)
    for r in model.ensemble_mean(t.predictions(), log_space=False).take(20):
        assert r.prediction == pytest.approx(sum(each[r.id].values()) / 2, rel=1e-9)


FOLDS = [{"fold": 1, "train_start": dt.date(1994, 1, 1), "train_end": dt.date(1996, 12, 31), "test_start": dt.date(1997, 1, 31), "test_end": dt.date(1997, 12, 31)},
         {"fold": 2, "train_start": dt.date(1994, 1, 1), "train_end": dt.date(1994, 1, 31), "test_start": dt.date(1998, 1, 31), "test_end": dt.date(1998, 12, 31)}]


def test_folds_and_their_verdicts(sales):
    rows = model.fold_rows(sales, FOLDS, "sale_date")
    counts = {r["dataset"]: (r.train_rows, r.test_rows, r.skipped) for r in model.enough_rows(rows, {"": (0, 0)}, (50, 20)).collect()}
    assert counts["all@1"][2] is None and counts["all@2"][2] == "fewer than 50 training or 20 test rows"
    t = trained(rows, [Model("all@1|base", "all@1", FEW, ("sqft",))])
    met = model.fold_metrics(t.predictions("test")).collect()
    assert [r.model for r in met] == ["all@1|base"] and met[0].n == counts["all@1"][1]
    assert model.fold_rows(sales, [], "sale_date").count() == 0


def test_every_request_is_scored_or_the_call_fails(sales):
    keyed = sales.withColumn("dataset", F.explode(F.array(F.col("segment"), F.lit("global"))))
    req = sales.withColumn("model_key", F.when(F.col("id") % 4 == 0, None).when(F.col("id") % 4 == 1, "none such").otherwise(F.col("segment"))).withColumn("role", F.lit("request"))
    req = model.routed(req, ["a", "global"])
    t = trained(keyed.unionByName(req.drop("model_key")), [Model(k, k, FEW) for k in ("a", "global")])
    out = model.batch_predict(t, req.select("id", F.col("dataset").alias("model_key"), "units"), F.col("units"))
    assert out.count() == 360 and out.where("predicted_price is null").count() == 0 and {r.model_key for r in out.collect()} == {"a", "global"}
    with pytest.raises(ValueError):
        model.routed(req, ["a"])


def test_per_unit_prices_times_units(sales):
    keyed = sales.withColumn("dataset", F.lit("rentals_all"))
    req = keyed.withColumn("role", F.lit("request"))
    t = trained(keyed.unionByName(req), [Model("rentals_all", "rentals_all", FEW)])
    each = {r.id: r.prediction for r in model.ensemble_mean(t.predictions("request")).collect()}
    asked = req.select("id", F.col("dataset").alias("model_key"), F.when(F.col("id") % 2 == 0, F.col("units")).alias("units"))
    units = {r.id: r.units for r in asked.collect()}
    for r in model.batch_predict(t, asked, F.col("units")).collect():
        assert r.predicted_price == pytest.approx(each[r.id] * max(units[r.id] or 1.0, 1.0))


def test_training_rows_of_every_key(spark):
    rows = [(1, "multi_family", "02 TWO FAMILY DWELLINGS", 500_000.0, 2.0, 1000.0), (2, "multi_family", "02 TWO FAMILY DWELLINGS", 50_000.0, 2.0, 1000.0),
            (3, "multi_family", "02 TWO FAMILY DWELLINGS", 200_000.0, 2.0, 9000.0), (4, "multi_family", "02 TWO FAMILY DWELLINGS", 200_000.0, 2.0, None),
            (5, "multi_family", "03 THREE FAMILY DWELLINGS", 10.0, 3.0, 1.0), (6, "rental_walkup", None, 900.0, 3.0, 1.0), (7, "rental_elevator", "08", 900.0, None, 1.0),
            (8, "condo_coop", "x", 5.0, 1.0, 1.0), (9, "one_family", "x", -1.0, 1.0, 1.0), (10, None, "x", 7.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "sale_id long, segment string, building_class string, sales_price double, total_units double, gross_sqft double")
    got = {}
    for r in model.training_rows(df).collect():
        got.setdefault(r["dataset"], {})[r.sale_id] = (r.target, r.is_elevator)
    assert {k: sorted(v) for k, v in got.items()} == {"two_family": [1, 4], "three_family": [5], "multi_family": [1, 2, 3, 4, 5], "rentals_all": [6], "rental_walkup": [6],
                                                    "condo_coop": [8], "global": [1, 2, 3, 4, 5, 6, 7, 8, 10]}
    assert got["rentals_all"][6] == (300.0, 0.0) and got["global"][6][0] == 900.0


def test_scorecard_orders_by_risk(spark):
    tt = spark.createDataFrame([("a", 0.9, 0.5), ("b", 0.8, 0.78)], "segment string, train_r2 double, test_r2 double")
    folds = spark.createDataFrame([("a", 0.5), ("a", 0.3), ("b", 0.7), ("b", 0.6)], "segment string, r2 double")
    rows = model.overfit_scorecard(tt, folds, "segment").collect()
    assert [(r.segment, r.gate) for r in rows] == [("a", "fail"), ("b", "pass")] and rows[0].fold_r2_worst == 0.3


def test_search_covers_the_ranges_on_later_rows(spark, sales):
    rng = random.Random(1)
    drawn = [model.draw_trial(rng) for _ in range(400)]
    assert {d.n_estimators for d in drawn} == set(range(100, 1001, 50)) and {d.max_depth for d in drawn} == set(range(3, 8))
    assert {d.min_child_weight for d in drawn} == set(range(3, 21)) and min(d.learning_rate for d in drawn) < 0.011 and max(d.learning_rate for d in drawn) > 0.14
    for name, lo, hi in (("subsample", 0.6, 1.0), ("colsample_bytree", 0.5, 1.0), ("gamma", 0.0, 1.0), ("reg_alpha", 0.0, 5.0), ("reg_lambda", 0.5, 10.0)):
        values = [getattr(d, name) for d in drawn]
        assert lo <= min(values) < lo + 0.1 * (hi - lo) and hi - 0.1 * (hi - lo) < max(values) <= hi
    rows = sales.withColumn("role", F.when(F.col("sale_date") <= "1998-12-31", "train").otherwise("test"))
    models = model.search_models(["all"], {"all": ["sqft", "segment"]}, 3, draw=lambda r: replace(model.draw_trial(r), n_estimators=4))
    t = trained(rows, models)
    table = {r.trial: r for r in model.trial_table(t, models).collect()}
    assert sorted(table) == [0, 1, 2] and [table[i].gamma for i in range(3)] == [m.trees.gamma for m in models]
    for i, m in enumerate(models):
        p = t.predictions("test").where(F.col("model") == m.name)
        assert regression_metrics(p, "label", "log_pred").first().r2 == pytest.approx(table[i].test_r2_log, abs=1e-9)


def test_registered_training_queries_see_every_key(spark):
    from conftest import SF_SMALL
    from lotline.plans import model_queries as Q

    few = dict.fromkeys(model.MODEL_KEYS, FEW)
    low = dict.fromkeys(model.MODEL_KEYS, (20, 5))
    trees = {s: model.SEGMENT_TREES[s].n_estimators for s in model.MODEL_KEYS}
    assert trees == {"one_family": 500, "two_family": 600, "three_family": 400, "multi_family": 700, "condo_coop": 800, "rentals_all": 350, "rental_walkup": 500,
                     "rental_elevator": 150, "global": 400}
    late = {(r.model_key, r.sale_id) for r in Q.q_training_targets(spark, SF_SMALL).where("role = 'test'").collect()}
    for query in (Q.q_train_segment_model, Q.q_seed_ensemble):
        rows = query(spark, SF_SMALL, trees=few, least=low).collect()
        assert len(rows) == len(late) and {(r.model_key, r.sale_id) for r in rows} == late and {r.model_key for r in rows} == set(model.MODEL_KEYS)
        assert all(r.prediction > 0 and r.target > 0 for r in rows)
    skipped = Q.q_train_segment_model(spark, SF_SMALL, trees=few, least={**low, "one_family": (10**6, 1)}).where("skipped is not null").collect()
    assert [(r.model_key, r.sale_id) for r in skipped] == [("one_family", None)]
    assert {r.model_key for r in Q.q_feature_importance(spark, SF_SMALL, trees=few, least=low).collect()} == set(model.MODEL_KEYS)
    found = Q.q_hyperparameter_search(spark, SF_SMALL, trials=1, draw=lambda r: replace(model.draw_trial(r), n_estimators=2, max_depth=2), least=low).collect()
    assert sorted(r.model_key for r in found) == sorted(model.TUNED)
    assert {r.model_key for r in Q.q_overfit_scorecard(spark, SF_SMALL, trees=few, least=low).collect()} == set(model.MODEL_KEYS)
    priced = Q.q_batch_predict(spark, SF_SMALL, trees=few, least=low)
    assert priced.count() == Q.frame(spark, SF_SMALL).count() and priced.where("predicted_price is null").count() == 0
    assert list(Q.FEATURE_SETS) == ["baseline", "+dof", "+acris", "+j51", "all"]
    got = Q.q_rolling_origin_eval(spark, SF_SMALL, trees=FEW).collect()
    assert {r.feature_set for r in got} == set(Q.FEATURE_SETS) and {r.segment for r in got} == set(Q.SEGMENTS)
    assert all((r.r2 is None) != (r.skipped is None) for r in got)
