"""Registered model-side queries (survey 2.10). Predictions are checked
rows-only (SQL grows no trees); the exact table transforms (imputation, rare
categories, pooling, training rows and folds of every model key) have SQL oracles.

Every training query fits all its models together, with the reference's trees,
seeds, folds and trials as defaults."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lotline.functions.features import borough_name, positive_ratio, property_age_eval
from lotline.operators import boosting, columns, joins, model, ranking, stats
from lotline.operators.boosting import Model
from lotline.operators.score import usable_model
from lotline.plans import bindings as B
from lotline.plans import join_queries as JQ
from lotline.plans.registry import register

TRAIN_END = "1998-12-31"
TEST_START = "1999-01-31"  # 30 days of reporting lag lie between
LEAST_FOLD_ROWS = (50, 20)  # training and test rows below which a fold is skipped (and says so)
SEGMENTS = ["one_family", "multi_family", "condo_coop", "rental_walkup", "rental_elevator", "global"]  # of the feature-set evaluation


def frame(spark, sf):
    return B.spine(spark, sf, with_geo=True).where(F.col("sales_price") > 0)


def _split(spark, sf):
    f = frame(spark, sf)
    d = F.col("sale_date")
    return f, f.where(d <= F.lit(TRAIN_END).cast("date")), f.where(d > F.lit(TRAIN_END).cast("date"))


_NULLED = """nulled AS (
  SELECT sale_id, sale_date, CASE WHEN sale_id % 5 = 0 THEN NULL ELSE gross_sqft END AS gross_sqft,
         CASE WHEN sale_id % 7 = 0 THEN NULL ELSE neighborhood END AS neighborhood FROM spine),
train AS (SELECT * FROM nulled WHERE sale_date <= DATE '1998-12-31')"""


@register(
    "impute_median_mode",
    B.with_ctes(B.SPINE_SQL, _NULLED) + """, mode AS (
  SELECT neighborhood FROM train WHERE neighborhood IS NOT NULL GROUP BY neighborhood ORDER BY count(*) DESC, neighborhood LIMIT 1)
SELECT sale_id, COALESCE(gross_sqft, (SELECT quantile_cont(gross_sqft, 0.5) FROM train)) AS gross_sqft,
       COALESCE(neighborhood, (SELECT neighborhood FROM mode)) AS neighborhood FROM nulled""",
)
def q_impute_median_mode(spark, sf):
    sp = B.spine(spark, sf)
    k = F.col("sale_id")
    nulled = sp.select("sale_id", "sale_date",
                       F.when(k % 5 == 0, F.lit(None)).otherwise(F.col("gross_sqft")).alias("gross_sqft"),
                       F.when(k % 7 == 0, F.lit(None)).otherwise(F.col("neighborhood")).alias("neighborhood"))
    train = nulled.where(F.col("sale_date") <= F.lit(TRAIN_END).cast("date"))
    return model.impute_median_mode(train, nulled, ["gross_sqft"], ["neighborhood"]).select(
        "sale_id", "gross_sqft", "neighborhood")


_BNAME_SQL = ("CASE borough WHEN 1 THEN 'Manhattan' WHEN 2 THEN 'Bronx' WHEN 3 THEN 'Brooklyn' "
              "WHEN 4 THEN 'Queens' WHEN 5 THEN 'Staten Island' ELSE 'Unknown' END")


@register(
    "collapse_rare",
    B.with_ctes(B.SPINE_SQL) + f""", x AS (SELECT sale_id, sale_date, neighborhood || '/' || building_class AS nc, {_BNAME_SQL} AS bname FROM spine),
rare AS (SELECT nc FROM x WHERE sale_date <= DATE '1998-12-31' AND nc IS NOT NULL GROUP BY nc HAVING count(*) < 30)
SELECT sale_id, CASE WHEN nc IN (SELECT nc FROM rare) THEN 'Other_' || COALESCE(bname, 'Unknown') ELSE nc END AS nbhd_class FROM x""",
)
def q_collapse_rare(spark, sf):
    sp = B.spine(spark, sf).select("sale_id", "sale_date", F.concat_ws("/", "neighborhood", "building_class").alias("nc"),
                                    borough_name("borough").alias("bname"))
    train = sp.where(F.col("sale_date") <= F.lit(TRAIN_END).cast("date"))
    return model.collapse_rare(train, sp, "nc", "bname", out="nbhd_class").select("sale_id", "nbhd_class")


@register(
    "pooled_segments",
    B.with_ctes(B.SPINE_SQL) + """SELECT sale_id, segment, CAST(segment = 'rental_elevator' AS INTEGER) AS is_elevator
FROM spine WHERE segment IN ('rental_walkup', 'rental_elevator')""",
)
def q_pooled_segments(spark, sf):
    p = model.pooled_segments(B.spine(spark, sf), "segment", ["rental_walkup", "rental_elevator"], "is_elevator",
                              "rental_elevator")
    return p.select("sale_id", "segment", "is_elevator")


@register(
    "one_hot",
    B.with_ctes(B.SPINE_SQL) + """, f AS (SELECT * FROM spine WHERE sales_price > 0),
seen AS (SELECT neighborhood, row_number() OVER (ORDER BY count(*) DESC, neighborhood) - 1 AS idx FROM f
         WHERE sale_date <= DATE '1998-12-31' AND neighborhood IS NOT NULL GROUP BY neighborhood),
n AS (SELECT count(*) AS n FROM seen)
SELECT sale_id, CAST(COALESCE(seen.idx, n.n) AS DOUBLE) AS neighborhood_idx, CAST(n.n AS INTEGER) AS ohe_size,
       CASE WHEN seen.idx IS NULL THEN 0.0 ELSE 1.0 END AS ohe_hot
FROM f CROSS JOIN n LEFT JOIN seen USING (neighborhood)""",
)
def q_one_hot(spark, sf):
    f, tr, _ = _split(spark, sf)
    o = model.one_hot(tr, f, ["neighborhood"])
    return o.select("sale_id", "neighborhood_idx", F.size(vector_to_array("neighborhood_ohe")).alias("ohe_size"),
                    F.array_max(vector_to_array("neighborhood_ohe")).alias("ohe_hot"))


# The reference's feature sets, over what the bindings derive.
_DOF = ["roll_curacttot", "roll_curmkttot", "roll_units", "roll_per_unit"]
_ACRIS = ["deed_cnt", "deed_last_document_amt", "deed_days_since_last", "mtge_cnt", "mtge_last_document_amt"]
_J51 = ["j51_active_flag", "j51_last_abatement", "j51_total_abatement", "j51_last_expiry_year"]
_PARCEL = ["latitude", "longitude", "numfloors", "lotarea", "bldgarea"]
_PLACE = ["latitude", "longitude"]
_BASELINE = ["year_built", "property_age", "gross_sqft", "land_sqft", "total_units", "residential_units", "sqft_per_unit", "land_per_unit", "neighborhood", "borough"]
FEATURE_SETS = {"baseline": _BASELINE, "+dof": _BASELINE + _DOF, "+acris": _BASELINE + _ACRIS, "+j51": _BASELINE + _J51, "all": _BASELINE + _DOF + _ACRIS + _J51}
CATEGORICAL = ["borough_name", "neighborhood", "building_class"]
_COMMON = ["neighborhood_median_price", "property_age", *_DOF, *_ACRIS, *_J51[:3]]
_RENTAL = [*_COMMON, "total_units", "residential_units", *[c for c in _PARCEL if c not in _PLACE], *CATEGORICAL]
FEATURES = {k: _RENTAL if k in model.PER_UNIT_KEYS else [*_COMMON, *_PARCEL, *CATEGORICAL] for k in model.MODEL_KEYS}
FEATURES["rentals_all"] = [*_RENTAL, "is_elevator"]
NUMERIC = ["neighborhood_median_price", "is_elevator", *_PARCEL, *_DOF, *_ACRIS, *_J51, *[c for c in _BASELINE if c not in ("neighborhood", "borough")]]


_KEPT = ["sale_id", "sale_date", "segment", "building_class", "sales_price", "borough", "borough_name", "neighborhood"]


def evaluated(spark, sf):
    """Sales with the columns of all feature sets, stored once: what is made from them has many rows for each."""
    base = frame(spark, sf)
    sides = [(JQ.known(base, JQ.gold_sides(spark, sf)), ["bbl", "as_of_date"]), (B.parcels(spark, sf).select("bbl", "numfloors", "lotarea", "bldgarea"), ["bbl"])]
    out = joins.enrich_spine(base, sides, unique=True)
    out = (out.withColumn("property_age", property_age_eval("year_built")).withColumn("borough_name", borough_name("borough"))
           .withColumn("roll_per_unit", positive_ratio("roll_curacttot", "roll_units"))
           .withColumn("sqft_per_unit", positive_ratio("gross_sqft", "total_units")).withColumn("land_per_unit", positive_ratio("land_sqft", "total_units")))
    made = {"neighborhood_median_price", "is_elevator", *_KEPT}
    return model.materialize(out.select(*_KEPT, *[c for c in NUMERIC if c not in made]), "sales")


def _role():
    d = F.col("sale_date")
    return F.when(d <= F.lit(TRAIN_END).cast("date"), "train").when(d >= F.lit(TEST_START).cast("date"), "test")


def key_rows(sales, keys=model.MODEL_KEYS):
    """Training and test rows of the model keys, with their statistics of training."""
    rows = model.training_rows(sales.withColumn("role", _role()).where("role is not null"), keys)
    return model.with_training_stats(rows.withColumnRenamed("sale_id", "id"))


def _verdicts(rows, least):
    """Model keys with enough rows, and the reason of the others."""
    found = {r["dataset"]: r["skipped"] for r in model.enough_rows(rows, least).collect()}  # a row a key
    return [k for k in found if found[k] is None], {k: why for k, why in found.items() if why}


def _trained(rows, models):
    return model.Trained(rows, models, NUMERIC, CATEGORICAL)


def _skipped(spark, why, columns):
    """A row for each key that has no model, with its reason."""
    return spark.createDataFrame([(k, w) for k, w in sorted(why.items())], "model_key string, skipped string").select(
        *[F.col(c) if c in ("model_key", "skipped") else F.lit(None).alias(c) for c in columns])


_KEY_SQL = """keyed AS (
  SELECT s.*, unnest(list_filter([
    CASE WHEN segment = 'one_family' THEN 'one_family' END,
    CASE WHEN segment = 'multi_family' AND starts_with(trim(building_class), '02') AND sales_price BETWEEN 100000 AND 9500000
          AND NOT COALESCE(gross_sqft > 0 AND sales_price / gross_sqft < 50, FALSE) THEN 'two_family' END,
    CASE WHEN segment = 'multi_family' AND starts_with(trim(building_class), '03') THEN 'three_family' END,
    CASE WHEN segment = 'multi_family' THEN 'multi_family' END,
    CASE WHEN segment = 'condo_coop' THEN 'condo_coop' END,
    CASE WHEN segment IN ('rental_walkup', 'rental_elevator') THEN 'rentals_all' END,
    CASE WHEN segment = 'rental_walkup' THEN 'rental_walkup' END,
    CASE WHEN segment = 'rental_elevator' THEN 'rental_elevator' END, 'global'], lambda x: x IS NOT NULL)) AS model_key
  FROM spine s WHERE sales_price > 0),
targets AS (SELECT *, CASE WHEN model_key NOT IN ('rentals_all', 'rental_walkup', 'rental_elevator') THEN sales_price
                           WHEN total_units > 0 THEN sales_price / total_units END AS target,
                   CASE WHEN sale_date <= DATE '1998-12-31' THEN 'train' WHEN sale_date >= DATE '1999-01-31' THEN 'test' END AS role FROM keyed)"""


@register(
    "training_targets",
    B.with_ctes(B.SPINE_SQL, _KEY_SQL) + "SELECT model_key, sale_id, role, target FROM targets WHERE target > 0 AND role IS NOT NULL",
)
def q_training_targets(spark, sf):
    """Row set, split and target of every model key."""
    rows = model.training_rows(frame(spark, sf).withColumn("role", _role()).where("role is not null"))
    return rows.select(F.col("dataset").alias("model_key"), "sale_id", "role", "target")


@register(
    "training_row_counts",
    B.with_ctes(B.SPINE_SQL, _KEY_SQL) + """, least AS (SELECT * FROM (VALUES ('one_family', 500, 100), ('two_family', 500, 100), ('three_family', 300, 60), ('multi_family', 500, 100),
  ('condo_coop', 500, 100), ('rentals_all', 300, 60), ('rental_walkup', 200, 50), ('rental_elevator', 100, 20), ('global', 500, 100)) t(model_key, a, b)),
n AS (SELECT model_key, count(*) FILTER (role = 'train') AS train_rows, count(*) FILTER (role = 'test') AS test_rows FROM targets WHERE target > 0 AND role IS NOT NULL GROUP BY 1)
SELECT model_key, train_rows, test_rows, CASE WHEN train_rows < a OR test_rows < b THEN 'fewer than ' || a || ' training or ' || b || ' test rows' END AS skipped FROM n JOIN least USING (model_key)""",
)
def q_training_row_counts(spark, sf):
    """Rows of every model key and which keys are skipped."""
    rows = model.training_rows(frame(spark, sf).withColumn("role", _role()).where("role is not null"))
    return model.enough_rows(rows).withColumnRenamed("dataset", "model_key")


@register(
    "neighborhood_training_medians",
    B.with_ctes(B.SPINE_SQL, _KEY_SQL) + f""", t AS (SELECT *, {_BNAME_SQL} AS bname FROM targets WHERE target > 0 AND role IS NOT NULL),
rare AS (SELECT model_key, neighborhood FROM t WHERE role = 'train' AND neighborhood IS NOT NULL AND model_key IN ('two_family', 'three_family', 'multi_family')
         GROUP BY 1, 2 HAVING count(*) < 30),
c AS (SELECT t.* REPLACE (CASE WHEN r.neighborhood IS NOT NULL THEN 'Other_' || t.bname ELSE t.neighborhood END AS neighborhood)
      FROM t LEFT JOIN rare r ON r.model_key = t.model_key AND r.neighborhood = t.neighborhood),
near AS (SELECT model_key, neighborhood, quantile_cont(target, 0.5) AS m FROM c WHERE role = 'train' GROUP BY 1, 2),
whole AS (SELECT model_key, quantile_cont(target, 0.5) AS m FROM c WHERE role = 'train' GROUP BY 1)
SELECT c.model_key, c.sale_id, c.neighborhood, round(COALESCE(near.m, whole.m), 6) AS neighborhood_median_price
FROM c LEFT JOIN near ON near.model_key = c.model_key AND near.neighborhood = c.neighborhood LEFT JOIN whole ON whole.model_key = c.model_key""",
)
def q_neighborhood_training_medians(spark, sf):
    """Collapsed neighbourhoods and their median target of training, for every model key."""
    base = frame(spark, sf).withColumn("role", _role()).where("role is not null").withColumn("borough_name", borough_name("borough"))
    rows = model.with_training_stats(model.training_rows(base))
    return rows.select(F.col("dataset").alias("model_key"), "sale_id", "neighborhood", F.round("neighborhood_median_price", 6).alias("neighborhood_median_price"))


def _members(keys, trees, ensembles=model.ENSEMBLES):
    return [m for k in keys for m in model.members(k, trees[k], k, FEATURES[k], model.SEEDS if k in ensembles else (model.SINGLE_SEED,))]


_PREDICTED = ["model_key", "sale_id", "target", "prediction", "skipped"]


def _predicted(spark, sf, trees, least, ensembles):
    rows = key_rows(evaluated(spark, sf))
    keys, why = _verdicts(rows, least)
    t = _trained(rows, _members(keys, trees, ensembles))
    made = model.ensemble_mean(t.predictions("test")).select(F.col("key").alias("model_key"), F.col("id").alias("sale_id"), "target", "prediction", F.lit(None).cast("string").alias("skipped"))
    return made.unionByName(_skipped(spark, why, _PREDICTED))


@register("train_segment_model")
def q_train_segment_model(spark, sf, trees=model.SEGMENT_TREES, least=model.LEAST_ROWS):
    """Predictions of all test rows by the production models of the nine keys
    (five seeds for the keys of ``ENSEMBLES``, one for the others)."""
    return _predicted(spark, sf, trees, least, model.ENSEMBLES)


@register("seed_ensemble")
def q_seed_ensemble(spark, sf, trees=model.SEGMENT_TREES, least=model.LEAST_ROWS):
    """Mean predictions of five seeds of every key."""
    return _predicted(spark, sf, trees, least, model.MODEL_KEYS)


@register("feature_importance")
def q_feature_importance(spark, sf, trees=model.SEGMENT_TREES, least=model.LEAST_ROWS):
    """Importance of every feature column, averaged over five seeds."""
    rows = key_rows(evaluated(spark, sf))
    keys, why = _verdicts(rows, least)
    t = _trained(rows, _members(keys, trees, model.MODEL_KEYS))
    each = boosting.importance(t.forests, t.specs)
    key = F.regexp_replace("model", "#[^#]*$", "").alias("model_key")
    mean = each.groupBy(key, "feature").agg((F.sum("importance") / len(model.SEEDS)).alias("importance"), F.lit(None).cast("string").alias("skipped"))
    return mean.unionByName(_skipped(spark, why, mean.columns))


@register("hyperparameter_search")
def q_hyperparameter_search(spark, sf, trials=model.TRIALS, draw=model.draw_trial, least=model.LEAST_ROWS):
    """All trials of the tuned keys, fitted on the earlier and judged on the later rows."""
    rows = key_rows(evaluated(spark, sf), model.TUNED)
    keys, why = _verdicts(rows, least)
    models = model.search_models(keys, FEATURES, trials, draw=draw)
    made = model.trial_table(_trained(rows, models), models).withColumn("skipped", F.lit(None).cast("string"))
    return made.unionByName(_skipped(spark, why, made.columns))


def _global_folds(spark, sf):
    folds = ranking.build_folds(frame(spark, sf), "sale_date").collect()  # <= 3 rows: the fold definitions
    return [r.asDict() for r in folds]


_FOLD_METRICS = ["n", "mae", "rmse", "r2", "hit_10", "hit_25", "median_ape", "p90_ape"]


@register("rolling_origin_eval")
def q_rolling_origin_eval(spark, sf, trees=model.SEGMENT_TREES["global"]):
    """Metrics of the five feature sets in every fold of every segment."""
    f = evaluated(spark, sf).withColumn("borough", F.col("borough").cast("string")).withColumnRenamed("sale_id", "id").withColumn("target", F.col("sales_price"))
    rows = f.withColumn("dataset", F.explode(F.array_distinct(F.array(F.col("segment"), F.lit("global"))))).where(F.col("dataset").isin(*SEGMENTS))
    rows = model.fold_rows(rows, _global_folds(spark, sf), "sale_date")
    good, why = _verdicts_of_folds(rows)
    models = [Model(f"{d}|{name}", d, trees, tuple(feats)) for d in good for name, feats in FEATURE_SETS.items()]
    t = model.Trained(rows, models, sorted({c for feats in FEATURE_SETS.values() for c in feats} - {"neighborhood", "borough"}), ["neighborhood", "borough"])
    met = model.fold_metrics(model.materialize(t.predictions("test").select("model", "role", "label", "log_pred"), "predictions"))
    part = F.split("model", "[@|]")
    made = met.select(part[0].alias("segment"), part[2].alias("feature_set"), part[1].cast("int").alias("fold"), *_FOLD_METRICS, F.lit(None).cast("string").alias("skipped"))
    missed = spark.createDataFrame([(d.split("@")[0], name, int(d.split("@")[1]), w) for d, w in why.items() for name in FEATURE_SETS], "segment string, feature_set string, fold int, skipped string")
    return made.unionByName(missed, allowMissingColumns=True)


def _verdicts_of_folds(rows):
    found = {r["dataset"]: r["skipped"] for r in model.enough_rows(rows, {"": (0, 0)}, LEAST_FOLD_ROWS).collect()}  # a row a segment and fold
    return [d for d in found if found[d] is None], {d: w for d, w in found.items() if w}


@register("overfit_scorecard")
def q_overfit_scorecard(spark, sf, trees=model.SEGMENT_TREES, least=model.LEAST_ROWS):
    """Train and test R^2 of every key's model, with the R^2 of its folds."""
    sales = evaluated(spark, sf)
    rows = key_rows(sales)
    keys, why = _verdicts(rows, least)
    split = model.training_rows(sales.withColumn("role", F.lit("")))
    folds = model.with_training_stats(model.fold_rows(split.withColumnRenamed("sale_id", "id"), _global_folds(spark, sf), "sale_date"))
    good, _ = _verdicts_of_folds(folds)
    good = [d for d in good if d.split("@")[0] in keys]
    models = [Model(k, k, trees[k], tuple(FEATURES[k])) for k in keys] + [Model(d, d, trees[d.split("@")[0]], tuple(FEATURES[d.split("@")[0]])) for d in good]
    t = _trained(rows.unionByName(folds), models)
    p = t.predictions().select("model", "role", F.expm1("label").alias("target"), model.dollars(F.col("log_pred")).alias("prediction"))
    p = model.materialize(p.where("not contains(model, '@') or role = 'test'"), "predictions")
    met = stats.regression_metrics(p, "target", "prediction", group=["model", "role"], with_global=False)
    both = met.where("not contains(model, '@')").groupBy(F.col("model").alias("model_key")).pivot("role", ["train", "test"]).agg(F.first("r2"))
    both = both.select("model_key", F.col("train").alias("train_r2"), F.col("test").alias("test_r2")).unionByName(
        spark.createDataFrame([(k, None, None) for k in sorted(why)], "model_key string, train_r2 double, test_r2 double"))
    stable = met.where("contains(model, '@')").select(F.split("model", "@")[0].alias("model_key"), F.split("model", "@")[1].cast("int").alias("fold"), "r2")
    return model.overfit_scorecard(both, stable, "model_key")


@register("batch_predict")
def q_batch_predict(spark, sf, trees=model.SEGMENT_TREES, least=model.LEAST_ROWS):
    """Every sale as a request: routed to one of the nine keys, priced by its
    model in one pass; per-unit prices times units."""
    everything = evaluated(spark, sf)
    rows = model.training_rows(everything.withColumn("role", _role()).where("role is not null"))
    keys, _ = _verdicts(rows, least)
    available = spark.createDataFrame([(k,) for k in keys], "model_key string")
    req = columns.route_model(everything, available).withColumn("model_key", usable_model(F.col("model_key"), F.col("total_units")))
    req = model.routed(req, keys).withColumn("role", F.lit("request")).withColumn("target", F.lit(None).cast("double"))
    req = req.withColumn("is_elevator", (F.col("segment") == "rental_elevator").cast("double"))
    both = rows.unionByName(req.select(*rows.columns)).withColumnRenamed("sale_id", "id")
    t = _trained(model.with_training_stats(both), _members(keys, trees))
    asked = req.select(F.col("sale_id").alias("id"), F.col("dataset").alias("model_key"), "total_units")
    return model.batch_predict(t, asked, F.col("total_units")).withColumnRenamed("id", "sale_id")
