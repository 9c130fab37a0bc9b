"""Registered aggregation / profile / evaluation-metric queries (survey 2.5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotline.operators import stats
from lotline.plans import bindings as B
from lotline.plans.join_queries import ENRICH_SQL, enriched_spine
from lotline.plans.registry import register

_SP = B.with_ctes(B.SPINE_SQL)

_PRED_SQL = """pred AS (
  SELECT l_orderkey, l_linenumber, p_type AS segment, CAST(year(l_shipdate) AS INTEGER) AS yr,
         l_extendedprice AS y, l_quantity * p_retailprice * 5.0 AS yhat
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def pred(spark, sf):
    li = B.table(spark, sf, "lineitem")
    p = B.table(spark, sf, "part")
    return li.join(p, li.l_partkey == p.p_partkey).select(
        "l_orderkey", "l_linenumber", F.col("p_type").alias("segment"), F.year("l_shipdate").alias("yr"),
        F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * F.col("p_retailprice") * 5.0).alias("yhat"))


def _r(c, d=6):
    return F.round(c, d).alias(c)


@register("count_distinct", _SP + "SELECT segment, count(DISTINCT bbl) AS n_parcels, count(*) AS n_sales FROM spine GROUP BY segment")
def q_count_distinct(spark, sf):
    return B.spine(spark, sf).groupBy("segment").agg(F.count_distinct("bbl").alias("n_parcels"),
                                                     F.count(F.lit(1)).alias("n_sales"))


_PARTIES_SQL = """parties AS (
  SELECT l_orderkey AS document_id, CASE WHEN l_linenumber % 2 = 1 THEN 1 ELSE 2 END AS party_type,
         CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE 'PARTY ' || CAST(l_suppkey AS VARCHAR) END AS name,
         l_linenumber * 1000 + l_partkey % 1000 AS seq
  FROM lineitem)"""


@register(
    "group_first_pivot",
    B.with_ctes(_PARTIES_SQL) + """, r AS (
  SELECT *, row_number() OVER (PARTITION BY document_id, party_type ORDER BY seq, name) AS rn
  FROM parties WHERE name IS NOT NULL)
SELECT d.document_id, b.name AS buyer_name, s.name AS seller_name
FROM (SELECT DISTINCT document_id FROM parties) d
LEFT JOIN r b ON b.document_id = d.document_id AND b.party_type = 1 AND b.rn = 1
LEFT JOIN r s ON s.document_id = d.document_id AND s.party_type = 2 AND s.rn = 1""",
)
def q_group_first_pivot(spark, sf):
    li = B.table(spark, sf, "lineitem")
    parties = li.select(
        F.col("l_orderkey").alias("document_id"),
        F.when(F.col("l_linenumber") % 2 == 1, 1).otherwise(2).alias("party_type"),
        F.when(F.col("l_partkey") % 7 == 0, F.lit(None)).otherwise(
            F.concat(F.lit("PARTY "), F.col("l_suppkey").cast("string"))).alias("name"),
        (F.col("l_linenumber") * 1000 + F.col("l_partkey") % 1000).alias("seq"),
    )
    return stats.first_by_order_pivot(parties, "document_id", "party_type", "name", "seq",
                                      {"buyer_name": 1, "seller_name": 2})


@register(
    "group_count_sum_min",
    B.with_ctes(B.ABATEMENTS_SQL) + """SELECT bbl, count(*) AS n_rows, round(sum(abatement), 4) AS total_abatement,
  min(init_year) AS earliest_init_year FROM abatements GROUP BY bbl""",
)
def q_group_count_sum_min(spark, sf):
    a = B.abatements(spark, sf)
    return a.groupBy("bbl").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("abatement"), 4).alias("total_abatement"),
                                F.min("init_year").alias("earliest_init_year"))


@register("group_median", _SP + "SELECT neighborhood, round(quantile_cont(sales_price, 0.5), 6) AS median_price FROM spine GROUP BY neighborhood")
def q_group_median(spark, sf):
    from lotline.operators.quantiles import exact_quantiles
    m = exact_quantiles(B.spine(spark, sf), ["neighborhood"], "sales_price", {"median_price": 0.5})
    return m.select("neighborhood", F.round("median_price", 6).alias("median_price"))


_MM_COLS = ["sales_price", "gross_sqft", "land_sqft", "year_built"]


@register(
    "group_median_multi",
    _SP + """, g AS (
  SELECT 'group' AS scope, neighborhood, """ + ", ".join(f"quantile_cont({c}, 0.5) AS {c}" for c in _MM_COLS) + """
  FROM spine GROUP BY neighborhood
  UNION ALL
  SELECT 'global', NULL, """ + ", ".join(f"quantile_cont({c}, 0.5)" for c in _MM_COLS) + """ FROM spine)
SELECT scope, neighborhood, feature, round(median, 6) AS median FROM (UNPIVOT g ON """ + ", ".join(_MM_COLS)
    + """ INTO NAME feature VALUE median)""",
)
def q_group_median_multi(spark, sf):
    m = stats.median_by(B.spine(spark, sf), ["neighborhood"], _MM_COLS)
    return m.withColumn("median", F.round("median", 6))


_TRAIN_END = "1998-12-31"


@register(
    "neighborhood_stats",
    B.with_ctes(B.SPINE_SQL, B.TAX_ROLLS_SQL) + f""", feat AS (
  SELECT s.*, CAST(t.curacttot AS DOUBLE) / (CASE WHEN t.units < 1 THEN 1 ELSE t.units END) AS assess_per_unit
  FROM spine s LEFT JOIN tax_rolls t ON t.bbl = s.bbl AND t.year = year(s.sale_date) - 1),
train AS (SELECT * FROM feat WHERE sale_date <= DATE '{_TRAIN_END}'),
nb AS (SELECT neighborhood, quantile_cont(sales_price, 0.5) AS m, quantile_cont(assess_per_unit, 0.5) AS a
       FROM train WHERE neighborhood IS NOT NULL GROUP BY neighborhood),
gl AS (SELECT quantile_cont(sales_price, 0.5) AS m, quantile_cont(assess_per_unit, 0.5) AS a FROM train)
SELECT f.sale_id, round(COALESCE(nb.m, gl.m), 6) AS neighborhood_median_price,
       round(COALESCE(f.assess_per_unit, nb.a, gl.a), 6) AS assess_per_unit_filled,
       round(f.sales_price / f.total_units, 6) AS price_per_unit
FROM feat f LEFT JOIN nb ON f.neighborhood = nb.neighborhood CROSS JOIN gl
WHERE f.total_units IS NOT NULL AND f.total_units > 0""",
)
def q_neighborhood_stats(spark, sf):
    sp = B.spine(spark, sf)
    tr = B.tax_rolls(spark, sf).select("bbl", F.col("year").alias("__ry"), "curacttot", "units")
    feat = sp.join(tr, (sp.bbl == tr.bbl) & (tr["__ry"] == F.year(sp.sale_date) - 1), "left").select(
        sp["*"], (tr.curacttot.cast("double") / F.when(tr.units < 1, F.lit(1)).otherwise(tr.units)).alias("assess_per_unit"))
    train = feat.where(F.col("sale_date") <= F.lit(_TRAIN_END).cast("date"))
    st = stats.fit_group_stats(train, "neighborhood", {"neighborhood_median_price": "sales_price", "nb_assess": "assess_per_unit"})
    out = stats.apply_group_stats(feat, st, "neighborhood", ["neighborhood_median_price", "nb_assess"])
    out = out.where(F.col("total_units").isNotNull() & (F.col("total_units") > 0))
    return out.select(
        "sale_id", _r("neighborhood_median_price"),
        F.round(F.coalesce("assess_per_unit", "nb_assess"), 6).alias("assess_per_unit_filled"),
        F.round(F.col("sales_price") / F.col("total_units"), 6).alias("price_per_unit"))


_QS = (0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


@register(
    "percentile_profile",
    _SP + "SELECT building_class, count(sales_price / NULLIF(total_units, 0)) AS n, "
    + ", ".join(f"round(quantile_cont(sales_price / NULLIF(total_units, 0), {q}), 6) AS p{int(round(q * 100))}" for q in _QS)
    + " FROM spine GROUP BY building_class",
)
def q_percentile_profile(spark, sf):
    sp = B.spine(spark, sf)
    ratio = F.col("sales_price") / F.nullif(F.col("total_units"), F.lit(0.0))
    p = stats.percentile_profile(sp, ["building_class"], ratio, _QS)
    return p.select("building_class", "n", *[_r(f"p{int(round(q * 100))}") for q in _QS])


@register(
    "conditional_agg",
    _SP + """SELECT borough, CAST(sum(CASE WHEN segment = 'condo_coop' THEN 1 ELSE 0 END) AS BIGINT) AS n_condo,
  round(avg(CASE WHEN total_units > 0 THEN sales_price / total_units END), 4) AS avg_ppu,
  min(CASE WHEN status = 'F' THEN sales_price END) AS min_f_price,
  max(CASE WHEN status = 'O' THEN sales_price END) AS max_o_price,
  count(*) FILTER (WHERE gross_sqft > 1000) AS n_large
FROM spine GROUP BY borough""",
)
def q_conditional_agg(spark, sf):
    sp = B.spine(spark, sf)
    return sp.groupBy("borough").agg(
        F.sum(F.when(F.col("segment") == "condo_coop", 1).otherwise(0)).alias("n_condo"),
        F.round(F.avg(F.when(F.col("total_units") > 0, F.col("sales_price") / F.col("total_units"))), 4).alias("avg_ppu"),
        F.min(F.when(F.col("status") == "F", F.col("sales_price"))).alias("min_f_price"),
        F.max(F.when(F.col("status") == "O", F.col("sales_price"))).alias("max_o_price"),
        F.count_if(F.col("gross_sqft") > 1000).alias("n_large"),
    )


@register("group_count_sorted", _SP + "SELECT borough, building_class, count(*) AS n FROM spine GROUP BY borough, building_class ORDER BY n DESC, borough, building_class")
def q_group_count_sorted(spark, sf):
    return B.spine(spark, sf).groupBy("borough", "building_class").agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.desc("n"), "borough", "building_class")


_PROF_COLS = ["sales_price", "gross_sqft", "total_units", "year_built"]


@register(
    "profile_table",
    _SP + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count({c}) AS count, count(*) FILTER (WHERE {c} IS NULL) AS nulls, round(avg({c}), 4) AS mean, "
        f"round(stddev_samp({c}), 4) AS std, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, "
        f"round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75 FROM spine"
        for c in _PROF_COLS),
)
def q_profile_table(spark, sf):
    p = stats.profile_table(B.spine(spark, sf), _PROF_COLS)
    return p.withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4), **{q: F.round(q, 6) for q in ("p25", "p50", "p75")}})


@register(
    "value_counts_top",
    _SP + "SELECT building_class, count(*) AS count FROM spine GROUP BY building_class ORDER BY count DESC, building_class LIMIT 5",
)
def q_value_counts_top(spark, sf):
    return stats.value_counts_top(B.spine(spark, sf), "building_class", 5)


_NR_COLS = ["deed_cnt", "deed_last_document_amt", "roll_year", "roll_curacttot", "j51_total_abatement", "j51_active_flag"]


_NR_SEL = ", ".join(f"round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 9) AS {c}" for c in _NR_COLS)


@register(
    "null_rates",
    f"SELECT feature, null_rate FROM (UNPIVOT (SELECT {_NR_SEL} FROM ({ENRICH_SQL})) ON "
    + ", ".join(_NR_COLS) + " INTO NAME feature VALUE null_rate)",
)
def q_null_rates(spark, sf):
    return stats.null_rates(enriched_spine(spark, sf), _NR_COLS).withColumn("null_rate", F.round("null_rate", 9))


@register(
    "stage_funnel",
    _SP + """SELECT stage, rows, step FROM (
  SELECT count(*) AS input,
    count(*) FILTER (WHERE COALESCE(sales_price > 1000, false)) AS price_gt_1k,
    count(*) FILTER (WHERE COALESCE(sales_price > 1000, false) AND COALESCE(year_built BETWEEN 1800 AND 2025, false)) AS year_built_ok,
    count(*) FILTER (WHERE COALESCE(sales_price > 1000, false) AND COALESCE(year_built BETWEEN 1800 AND 2025, false)
                     AND COALESCE(gross_sqft > 0, false)) AS sqft_ok,
    count(*) FILTER (WHERE COALESCE(sales_price > 1000, false) AND COALESCE(year_built BETWEEN 1800 AND 2025, false)
                     AND COALESCE(gross_sqft > 0, false) AND COALESCE(total_units > 0, false)) AS units_ok,
    count(*) FILTER (WHERE COALESCE(sales_price > 1000, false) AND COALESCE(year_built BETWEEN 1800 AND 2025, false)
                     AND COALESCE(gross_sqft > 0, false) AND COALESCE(total_units > 0, false)
                     AND COALESCE(sales_price / total_units >= 30000, false)) AS per_unit_floor
  FROM spine) UNPIVOT (rows FOR stage IN (input, price_gt_1k, year_built_ok, sqft_ok, units_ok, per_unit_floor))
  JOIN (VALUES ('input', 0), ('price_gt_1k', 1), ('year_built_ok', 2), ('sqft_ok', 3), ('units_ok', 4), ('per_unit_floor', 5)) v(stage, step)
  USING (stage)""",
)
def q_stage_funnel(spark, sf):
    c = F.col
    stages = [
        ("price_gt_1k", c("sales_price") > 1000),
        ("year_built_ok", c("year_built").between(1800, 2025)),
        ("sqft_ok", c("gross_sqft") > 0),
        ("units_ok", c("total_units") > 0),
        ("per_unit_floor", c("sales_price") / c("total_units") >= 30000),
    ]
    return stats.stage_funnel(B.spine(spark, sf), stages)


@register(
    "distribution_by_year",
    _SP + "SELECT CAST(year(sale_date) AS INTEGER) AS year, segment, count(*) AS n FROM spine GROUP BY ALL",
)
def q_distribution_by_year(spark, sf):
    return B.spine(spark, sf).groupBy(F.year("sale_date").alias("year"), "segment").agg(F.count(F.lit(1)).alias("n"))


def _metrics_sql(where: str = "", group_extra: str = "") -> str:
    return f"""
  count(*) AS n, round(avg(abs(yhat - y)), 6) AS mae, round(sqrt(avg((yhat - y) * (yhat - y))), 6) AS rmse,
  round(1 - sum((yhat - y) * (yhat - y)) / nullif(var_pop(y) * count(*), 0), 9) AS r2,
  round(quantile_cont(abs(yhat - y) / greatest(y, 1.0), 0.5), 9) AS median_ape,
  round(quantile_cont(abs(yhat - y) / greatest(y, 1.0), 0.9), 9) AS p90_ape,
  round(avg(CASE WHEN abs(yhat - y) / greatest(y, 1.0) <= 0.10 THEN 1.0 ELSE 0.0 END), 9) AS hit_10,
  round(avg(CASE WHEN abs(yhat - y) / greatest(y, 1.0) <= 0.25 THEN 1.0 ELSE 0.0 END), 9) AS hit_25"""


def _round_metrics(df):
    for c, d in (("mae", 6), ("rmse", 6), ("r2", 9), ("median_ape", 9), ("p90_ape", 9), ("hit_10", 9), ("hit_25", 9)):
        df = df.withColumn(c, F.round(c, d))
    return df


@register(
    "regression_metrics",
    B.with_ctes(_PRED_SQL) + f"""SELECT segment, CASE WHEN GROUPING(segment) = 0 THEN 'segment' ELSE 'global' END AS scope,
{_metrics_sql()} FROM pred GROUP BY ROLLUP (segment)""",
)
def q_regression_metrics(spark, sf):
    return _round_metrics(stats.regression_metrics(pred(spark, sf), "y", "yhat", group="segment"))


_FOLD_R2_SQL = B.with_ctes(_PRED_SQL) + """, fm AS (
  SELECT segment, yr AS fold, 1 - sum((yhat - y) * (yhat - y)) / nullif(var_pop(y) * count(*), 0) AS r2
  FROM pred GROUP BY segment, yr)"""


def _fold_r2(spark, sf):
    m = stats.regression_metrics(pred(spark, sf), "y", "yhat", group=["segment", "yr"], with_global=False)
    return m.select("segment", F.col("yr").alias("fold"), "r2")


@register(
    "fold_summary",
    _FOLD_R2_SQL + """SELECT segment, round(avg(r2), 9) AS r2_mean, round(stddev_pop(r2), 9) AS r2_std,
  round(min(r2), 9) AS r2_worst, count(*) AS n_folds FROM fm GROUP BY segment""",
)
def q_fold_summary(spark, sf):
    s = stats.fold_summary(_fold_r2(spark, sf), ["segment"], "r2")
    return s.select("segment", _r("r2_mean", 9), _r("r2_std", 9), _r("r2_worst", 9), "n_folds")


_SETS_SQL = B.with_ctes(_PRED_SQL) + """, sets AS (
  SELECT 'base' AS feature_set, segment, yr AS fold, y, yhat FROM pred
  UNION ALL SELECT 'comps', segment, yr, y, yhat * 0.9 FROM pred
  UNION ALL SELECT 'trends', segment, yr, y, (yhat + y) / 2 FROM pred),
sm AS (SELECT feature_set, segment, fold, quantile_cont(abs(yhat - y) / greatest(y, 1.0), 0.5) AS median_ape
       FROM sets GROUP BY feature_set, segment, fold)"""


def _set_metrics(spark, sf):
    p = pred(spark, sf)
    sets = (p.select(F.lit("base").alias("feature_set"), "segment", F.col("yr").alias("fold"), "y", "yhat")
            .unionByName(p.select(F.lit("comps").alias("feature_set"), "segment", F.col("yr").alias("fold"), "y",
                                  (F.col("yhat") * 0.9).alias("yhat")))
            .unionByName(p.select(F.lit("trends").alias("feature_set"), "segment", F.col("yr").alias("fold"), "y",
                                  ((F.col("yhat") + F.col("y")) / 2).alias("yhat"))))
    ape = F.abs(F.col("yhat") - F.col("y")) / F.greatest(F.col("y"), F.lit(1.0))
    from lotline.operators.quantiles import exact_quantiles
    return exact_quantiles(sets.withColumn("__ape", ape), ["feature_set", "segment", "fold"], "__ape", {"median_ape": 0.5})


@register(
    "lift_vs_baseline",
    _SETS_SQL + """, a AS (SELECT feature_set, segment, avg(median_ape) AS m FROM sm GROUP BY feature_set, segment)
SELECT a.feature_set, a.segment, round(a.m, 9) AS avg_median_ape, round((a.m - b.m) * 100.0, 6) AS lift_pp
FROM a LEFT JOIN a b ON b.segment = a.segment AND b.feature_set = 'base'""",
)
def q_lift_vs_baseline(spark, sf):
    lift = stats.lift_vs_baseline(_set_metrics(spark, sf), "feature_set", "segment", "median_ape", "base")
    return lift.select("feature_set", "segment", _r("avg_median_ape", 9), _r("lift_pp", 6))


@register(
    "overfit_gate",
    _FOLD_R2_SQL + """, tt AS (
  SELECT segment,
    1 - sum((yhat - y) * (yhat - y)) FILTER (WHERE yr <= 1998) / nullif(var_pop(y) FILTER (WHERE yr <= 1998) * count(*) FILTER (WHERE yr <= 1998), 0) AS train_r2,
    1 - sum((yhat - y) * (yhat - y)) FILTER (WHERE yr > 1998) / nullif(var_pop(y) FILTER (WHERE yr > 1998) * count(*) FILTER (WHERE yr > 1998), 0) AS test_r2
  FROM pred GROUP BY segment)
SELECT tt.segment, round(train_r2 - test_r2, 9) AS r2_gap, round(w.worst, 9) AS worst_fold_r2,
  CASE WHEN train_r2 - test_r2 <= 0.15 AND w.worst >= 0.40 THEN 'pass' ELSE 'fail' END AS gate
FROM tt JOIN (SELECT segment, min(r2) AS worst FROM fm GROUP BY segment) w USING (segment)""",
)
def q_overfit_gate(spark, sf):
    p = pred(spark, sf).withColumn("split", F.when(F.col("yr") <= 1998, "train").otherwise("test"))
    m = stats.regression_metrics(p, "y", "yhat", group=["segment", "split"], with_global=False)
    wide = m.groupBy("segment").pivot("split", ["train", "test"]).agg(F.first("r2"))
    worst = _fold_r2(spark, sf).groupBy("segment").agg(F.min("r2").alias("worst"))
    j = wide.join(worst, "segment")
    return j.select("segment", F.round(F.col("train") - F.col("test"), 9).alias("r2_gap"),
                    F.round("worst", 9).alias("worst_fold_r2"),
                    stats.overfit_gate(F.col("train"), F.col("test"), F.col("worst")).alias("gate"))


@register(
    "promotion_gate",
    _SETS_SQL + """, a AS (SELECT feature_set, segment, avg(median_ape) AS m FROM sm GROUP BY feature_set, segment),
l AS (SELECT a.feature_set, a.segment, (a.m - b.m) * 100.0 AS lift_pp FROM a JOIN a b ON b.segment = a.segment AND b.feature_set = 'base'),
w AS (SELECT segment, count(*) AS n FROM pred GROUP BY segment),
lw AS (SELECT l.*, w.n FROM l JOIN w USING (segment)),
dom AS (SELECT feature_set, arg_max(segment, (n, segment)) AS dominant, arg_max(lift_pp, (n, segment)) AS dl, max(lift_pp) AS wl
        FROM lw GROUP BY feature_set)
SELECT feature_set, dominant, round(dl, 6) AS dominant_lift_pp, round(wl, 6) AS worst_lift_pp,
  CASE WHEN dl <= -3.0 AND wl <= 5.0 THEN 'promote' ELSE 'keep' END AS decision FROM dom""",
)
def q_promotion_gate(spark, sf):
    lift = stats.lift_vs_baseline(_set_metrics(spark, sf), "feature_set", "segment", "median_ape", "base")
    w = pred(spark, sf).groupBy("segment").agg(F.count(F.lit(1)).alias("n"))
    lw = lift.join(w, "segment")
    out = stats.promotion_gate(lw, "segment", "lift_pp", "n", by=["feature_set"])
    return out.select("feature_set", "dominant", _r("dominant_lift_pp", 6), _r("worst_lift_pp", 6), "decision")
