"""Model-side table operators (survey 2.10): preprocessing, training rows of every
model key, and training, search, evaluation and scoring of all models at once
(``operators/boosting.py``). Model parity is about the protocol and the
evaluation, not about predicted prices.
"""

from __future__ import annotations

import math
import random
from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotline.functions.features import LOG_TARGET_CLIP
from lotline.operators import boosting
from lotline.operators.boosting import Model, Trees
from lotline.operators.clean import quantile_value
from lotline.operators.quantiles import exact_quantiles
from lotline.operators.stats import regression_metrics
from lotline.session import materialize

# Fixed values of the training protocol.
RARE_MIN_ROWS = 30
SEEDS = (0, 1, 2, 3, 4)
TRIALS = 60
SINGLE_SEED = 42
SEGMENT_TREES = {
    "one_family": Trees(500, 0.05, 6, 3, 0.8, 0.8, 0.1, 0.1, 1.0),
    "two_family": Trees(600, 0.035, 5, 10, 0.75, 0.65, 0.25, 1.0, 3.5),
    "three_family": Trees(400, 0.025, 3, 35, 0.60, 0.45, 0.40, 4.0, 10.0),
    "multi_family": Trees(700, 0.035, 5, 7, 0.75, 0.65, 0.2, 0.8, 3.0),
    "condo_coop": Trees(800, 0.05, 5, 4, 0.8, 0.8, 0.1, 0.3, 1.0),
    "rentals_all": Trees(350, 0.03, 3, 15, 0.65, 0.50, 0.30, 2.5, 6.0),
    "rental_walkup": Trees(500, 0.04, 3, 6, 0.75, 0.6, 0.2, 1.0, 3.0),
    "rental_elevator": Trees(150, 0.04, 3, 10, 0.7, 0.6, 0.3, 2.0, 5.0),
    "global": Trees(),
}
MODEL_KEYS = tuple(SEGMENT_TREES)
TUNED = ("multi_family", "condo_coop", "rental_walkup", "rental_elevator")
ENSEMBLES = ("two_family", "three_family", "multi_family", "rentals_all")
RARE_KEYS = ("two_family", "three_family", "multi_family")
PER_UNIT_KEYS = ("rentals_all", "rental_walkup", "rental_elevator")
LEAST_ROWS = {"one_family": (500, 100), "two_family": (500, 100), "three_family": (300, 60), "multi_family": (500, 100), "condo_coop": (500, 100),
              "rentals_all": (300, 60), "rental_walkup": (200, 50), "rental_elevator": (100, 20), "global": (500, 100)}
TWO_FAMILY_PRICES, TWO_FAMILY_LEAST_PPSQFT = (100_000, 9_500_000), 50.0


def impute_median_mode(train: DataFrame, df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Fill numeric NULLs with the exact train median, categorical NULLs with
    the most frequent train value (ties: smallest value). Statistics are one
    aggregation each on the training rows (scalar subqueries), applied with
    ``coalesce`` -- no join."""
    out = df
    for c in numeric:
        med = quantile_value(train, c, 0.5)
        out = out.withColumn(c, F.coalesce(F.col(c).cast("double"), med))
    for c in categorical:
        counts = train.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("__n"))
        mode = counts.select(F.min(F.struct((-F.col("__n")).alias("k"), F.col(c).alias("v")))["v"]).scalar()
        out = out.withColumn(c, F.coalesce(F.col(c), mode))
    return out


def collapse_rare(train: DataFrame, df: DataFrame, col: str, group_col: str, min_rows: int = RARE_MIN_ROWS,
                  out: str | None = None) -> DataFrame:
    """Categories that have training rows, but fewer than ``min_rows``, become
    ``Other_<group>`` (e.g. Other_Brooklyn; Other_Unknown without a group).
    Categories without training rows and NULL stay as they are."""
    out = out or col
    rare = train.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") < min_rows).select(
        F.col(col).alias("__rare"))
    j = df.join(rare, df[col] == F.col("__rare"), "left")
    other = F.concat(F.lit("Other_"), F.coalesce(F.col(group_col).cast("string"), F.lit("Unknown")))
    return j.withColumn(out, F.when(F.col("__rare").isNotNull(), other).otherwise(F.col(col))).drop("__rare")


def pooled_segments(df: DataFrame, segment_col: str, segments: Sequence[str], flag_col: str, flag_segment: str) -> DataFrame:
    """Rows of several segments trained as one pool, with a membership flag."""
    return df.where(F.col(segment_col).isin(list(segments))).withColumn(
        flag_col, (F.col(segment_col) == flag_segment).cast("int"))


def one_hot(train: DataFrame, df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One-hot vectors fitted on train; unseen categories -> all-zero vector
    (``handleInvalid='keep'`` puts them in the extra last slot, which
    ``dropLast`` removes)."""
    stages = []
    for c in cols:
        stages.append(StringIndexer(inputCol=c, outputCol=f"{c}_idx", handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCol=f"{c}_idx", outputCol=f"{c}_ohe", dropLast=True))
    return Pipeline(stages=stages).fit(train).transform(df)


# ------------------------------------------------------------------ training rows

def training_rows(df: DataFrame, keys: Sequence[str] = MODEL_KEYS) -> DataFrame:
    """``df`` once for every model key that learns from the row: ``dataset`` (the
    key) and ``target`` (price, or price per unit where units are known). The
    split and pooled keys take parts of a segment or several; the two-family key
    leaves out sales that are no market prices; ``global`` takes all."""
    seg, cls = F.col("segment"), F.trim(F.coalesce("building_class", F.lit("")))
    price, units = F.col("sales_price"), F.col("total_units")
    ppsqft = F.when(F.col("gross_sqft") > 0, price / F.col("gross_sqft"))
    market = price.between(*TWO_FAMILY_PRICES) & (ppsqft.isNull() | (ppsqft >= TWO_FAMILY_LEAST_PPSQFT))
    of = {
        "two_family": (seg == "multi_family") & cls.startswith("02") & market,
        "three_family": (seg == "multi_family") & cls.startswith("03"),
        "rentals_all": seg.isin("rental_walkup", "rental_elevator"),
        "global": F.lit(True),
    }
    rows = df.withColumn("dataset", F.explode(F.array_compact(F.array(*[F.when(of.get(k, seg == k), F.lit(k)) for k in keys]))))
    target = F.when(~F.col("dataset").isin(*PER_UNIT_KEYS), price).when(units > 0, price / units)
    return rows.withColumn("target", target).where(F.col("target") > 0).withColumn("is_elevator", (seg == "rental_elevator").cast("double"))


def with_training_stats(rows: DataFrame, neighborhood: str = "neighborhood", borough: str = "borough_name") -> DataFrame:
    """Rows (dataset, role, target, ...) with rare neighbourhoods of ``RARE_KEYS``
    collapsed and ``neighborhood_median_price``: the median target of the
    neighbourhood's training rows, else of all the data set's. ``rows`` are read
    several times and not stored: there are many for every row they were made from."""
    train = rows.where("role = 'train'")
    least = F.when(F.col("dataset").isin(*RARE_KEYS), RARE_MIN_ROWS).otherwise(0)
    rare = train.where(F.col(neighborhood).isNotNull()).groupBy("dataset", neighborhood).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") < least).drop("__n")
    other = F.concat(F.lit("Other_"), F.coalesce(F.col(borough).cast("string"), F.lit("Unknown")))
    rare = materialize(rare.withColumn("__rare", F.lit(True)), "rare")
    rows = rows.join(rare, ["dataset", neighborhood], "left")
    rows = rows.withColumn(neighborhood, F.when(F.col("__rare"), other).otherwise(F.col(neighborhood))).drop("__rare")
    train = rows.where("role = 'train'").select("dataset", neighborhood, "target")
    scopes = F.explode(F.array(F.col(neighborhood), F.lit(None).cast("string"))).alias("__nb")  # the NULL scope is the whole data set
    medians = materialize(exact_quantiles(train.select("dataset", scopes, "target"), ["dataset", "__nb"], "target", {"m": 0.5}, thin=True), "medians")
    near = medians.where("__nb is not null").select("dataset", F.col("__nb").alias(neighborhood), F.col("m").alias("__near"))
    whole = medians.where("__nb is null").select("dataset", F.col("m").alias("__whole"))
    out = rows.join(near, ["dataset", neighborhood], "left").join(whole, "dataset", "left")
    return out.withColumn("neighborhood_median_price", F.coalesce("__near", "__whole")).drop("__near", "__whole")


def enough_rows(rows: DataFrame, least: Mapping[str, tuple[int, int]] = LEAST_ROWS, default: tuple[int, int] = (1, 0)) -> DataFrame:
    """dataset, train_rows, test_rows, and ``skipped``: why no model is trained, or NULL."""
    n = rows.groupBy("dataset").agg(F.count_if(F.col("role") == "train").alias("train_rows"), F.count_if(F.col("role") == "test").alias("test_rows"))
    bound = lambda i: F.coalesce(F.create_map(*[x for k, v in least.items() for x in (F.lit(k), F.lit(v[i]))])[F.col("dataset")], F.lit(default[i]))
    short = (F.col("train_rows") < bound(0)) | (F.col("test_rows") < bound(1))
    why = F.format_string("fewer than %d training or %d test rows", bound(0), bound(1))
    return n.withColumn("skipped", F.when(short, why))


# ------------------------------------------------------------------ training

class Trained:
    """Blocks, layouts and forests of a table of rows and a list of models."""

    def __init__(self, rows: DataFrame, models: Sequence[Model], numeric: Sequence[str], categorical: Sequence[str], block_rows: int = boosting.BLOCK_ROWS):
        rows = rows.withColumn("label", F.log1p("target"))
        wanted = sorted({m.dataset for m in models})
        rows = rows.where(F.col("dataset").isin(*wanted)) if wanted else rows.where("false")
        if models and all(m.features is not None for m in models):  # nothing else is cut and stored
            used = {c for m in models for c in m.features}
            numeric, categorical = [c for c in numeric if c in used], [c for c in categorical if c in used]
        self.specs = boosting.layouts(rows.where("role = 'train'"), numeric, categorical)
        self.blocks = boosting.blocks(rows, self.specs, block_rows)
        self.blocks = materialize(self.blocks, "blocks")
        self.forests = boosting.fit(self.blocks, self.specs, models)

    def predictions(self, role: str | None = None) -> DataFrame:
        """model, dataset, role, id, label and log_pred."""
        rows = self.blocks if role is None else self.blocks.where(F.col("role") == role)
        return boosting.score(rows, self.specs, self.forests)


def dollars(log_pred: Column) -> Column:
    """expm1 of the clipped log prediction."""
    lo, hi = LOG_TARGET_CLIP
    return F.expm1(F.least(F.greatest(log_pred, F.lit(lo)), F.lit(hi)))


def members(key: str, trees: Trees, dataset: str, features: Sequence[str], seeds: Sequence[int]) -> list[Model]:
    """One model a seed: the members of an ensemble, named key#seed."""
    return [Model(f"{key}#{s}", dataset, trees.seeded(s), tuple(features)) for s in seeds]


def ensemble_mean(predictions: DataFrame, log_space: bool = True) -> DataFrame:
    """Mean prediction of the members of each key (model = key#seed): key, dataset,
    role, id, target, prediction; averaged in log space (production) or in
    dollars (experiment)."""
    key = F.regexp_replace("model", "#[^#]*$", "").alias("key")
    mean = dollars(F.avg("log_pred")) if log_space else F.avg(dollars(F.col("log_pred")))
    return predictions.groupBy(key, "dataset", "role", "id").agg(F.expm1(F.max("label")).alias("target"), mean.alias("prediction"))


def draw_trial(rng: random.Random) -> Trees:
    """One draw from the reference's nine ranges."""
    return Trees(rng.randrange(100, 1001, 50), math.exp(rng.uniform(math.log(0.01), math.log(0.15))), rng.randint(3, 7), rng.randint(3, 20),
                 rng.uniform(0.6, 1.0), rng.uniform(0.5, 1.0), rng.uniform(0.0, 1.0), rng.uniform(0.0, 5.0), rng.uniform(0.5, 10.0), SINGLE_SEED)


def search_models(datasets: Sequence[str], features: Mapping[str, Sequence[str]], trials: int = TRIALS, seed: int = SINGLE_SEED, draw=draw_trial) -> list[Model]:
    """The trials of each data set: seeded random draws, the same for each."""
    rng = random.Random(seed)
    drawn = [draw(rng) for _ in range(trials)]
    return [Model(f"{d}#{i}", d, t, tuple(features[d])) for d in datasets for i, t in enumerate(drawn)]


def trial_table(trained: Trained, models: Sequence[Model]) -> DataFrame:
    """model_key, trial, its parameters and R^2 of the log target on the later rows (role ``test``)."""
    test = trained.predictions("test")
    e = F.col("log_pred") - F.col("label")
    r2 = F.lit(1.0) - F.try_divide(F.sum(e * e), F.var_pop("label") * F.count(F.lit(1)))
    listed = trained.forests.sparkSession.createDataFrame(
        [(m.name, m.dataset, int(m.name.rsplit("#", 1)[1]), t.n_estimators, t.learning_rate, t.max_depth, int(t.min_child_weight), t.subsample, t.colsample_bytree, t.gamma,
          t.reg_alpha, t.reg_lambda) for m in models for t in (m.trees,)],
        "model string, model_key string, trial int, n_estimators int, learning_rate double, max_depth int, min_child_weight int, subsample double, "
        "colsample_bytree double, gamma double, reg_alpha double, reg_lambda double")
    return listed.join(test.groupBy("model").agg(r2.alias("test_r2_log")), "model", "left").drop("model")


def fold_rows(rows: DataFrame, folds: Sequence[Mapping], date_col: str) -> DataFrame:
    """Rows once for every fold whose training or test window holds them: dataset
    becomes dataset@fold, role train or test. Rows outside both are left out."""
    d = F.col(date_col)
    roles = [F.struct(F.lit(int(f["fold"])).alias("fold"), F.when(d.between(F.lit(f["train_start"]), F.lit(f["train_end"])), "train")
                      .when(d.between(F.lit(f["test_start"]), F.lit(f["test_end"])), "test").alias("role")) for f in folds]
    if not roles:
        return rows.withColumn("role", F.lit("")).where("false")
    out = rows.drop("role").withColumn("__f", F.explode(F.array(*roles))).where("__f.role is not null")
    return out.withColumn("dataset", F.concat_ws("@", "dataset", F.col("__f.fold").cast("string"))).withColumn("role", F.col("__f.role")).drop("__f")


def fold_metrics(predictions: DataFrame) -> DataFrame:
    """Metrics of the test rows of each model key/feature set@fold."""
    p = predictions.where("role = 'test'").select("model", F.expm1("label").alias("target"), dollars(F.col("log_pred")).alias("prediction"))
    return regression_metrics(p, "target", "prediction", group="model", with_global=False).drop("scope")


def overfit_scorecard(train_test: DataFrame, fold_metrics: DataFrame, group: str) -> DataFrame:
    """Train/test R^2 gap and fold stability per group, sorted by risk
    (largest gap, then worst fold)."""
    fs = fold_metrics.groupBy(group).agg(F.avg("r2").alias("fold_r2_mean"), F.stddev_pop("r2").alias("fold_r2_std"),
                                         F.min("r2").alias("fold_r2_worst"))
    j = train_test.join(fs, group, "left").withColumn("r2_gap", F.col("train_r2") - F.col("test_r2"))
    gate = F.when((F.col("r2_gap") <= 0.15) & (F.col("fold_r2_worst") >= 0.40), "pass").otherwise("fail")
    return j.withColumn("gate", gate).orderBy(F.desc("r2_gap"), F.asc("fold_r2_worst"))


def batch_predict(trained: Trained, requests: DataFrame, units: Column, fallback: str = "global") -> DataFrame:
    """id, model_key and predicted_price of the rows of role ``request`` (their
    data set is the model they were routed to), all models in one pass; per-unit
    models multiply by units. ``requests``: id, model_key and what ``units`` needs."""
    mean = ensemble_mean(trained.predictions("request")).select("id", "prediction")
    times = F.when(F.col("model_key").isin(*PER_UNIT_KEYS), F.greatest(F.coalesce(units, F.lit(1.0)), F.lit(1.0))).otherwise(F.lit(1.0))
    return requests.join(mean, "id").select("id", "model_key", (F.col("prediction") * times).alias("predicted_price"))


def routed(requests: DataFrame, keys: Sequence[str], route_col: str = "model_key", fallback: str = "global") -> DataFrame:
    """Requests with ``dataset``: their key where it has a model, else the fallback."""
    if fallback not in keys:
        raise ValueError(f"no model for the fallback key {fallback!r}")
    return requests.withColumn("dataset", F.when(F.col(route_col).isin(*keys), F.col(route_col)).otherwise(F.lit(fallback)))
