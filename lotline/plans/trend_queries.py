"""Registered rolling-window / trend queries (survey 2.4 interval self join,
2.6 window functions)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotline.operators import clean, trends
from lotline.plans import bindings as B
from lotline.plans.registry import register
from lotline.plans.spatial_queries import _CS_SQL, comp_sales


def _grid_sql() -> str:
    def agg(name: str, keys: str, lo: int, hi_excl: int) -> str:
        return f"""{name} AS (
  SELECT d.comp_segment, d.as_of_date, {keys}, quantile_cont(s.sales_price, 0.5) AS med, count(*) AS n
  FROM d JOIN s ON s.comp_segment = d.comp_segment AND s.sale_date >= d.as_of_date - {lo}
   AND s.sale_date < d.as_of_date - {hi_excl}
  GROUP BY d.comp_segment, d.as_of_date, {keys})"""

    return B.with_ctes(B.SPINE_SQL, _CS_SQL) + f""",
s AS (SELECT comp_segment, borough, neighborhood, sale_date, sales_price FROM cs
      WHERE comp_segment IS NOT NULL AND sales_price >= 100000),
d AS (SELECT DISTINCT comp_segment, as_of_date FROM cs WHERE comp_segment IS NOT NULL),
{agg('cur', 's.borough, s.neighborhood', 365, 0)},
{agg('prv', 's.borough, s.neighborhood', 730, 365)},
{agg('bcur', 's.borough', 365, 0)},
{agg('bprv', 's.borough', 730, 365)},
grid AS (
SELECT c.comp_segment, c.as_of_date, c.borough, c.neighborhood, c.med AS nbhd_median, c.n AS nbhd_sale_count_l365,
  CASE WHEN COALESCE(p.n, 0) >= 5 AND p.med > 0 THEN c.med / p.med - 1 END AS nbhd_yoy,
  bc.med AS borough_median,
  CASE WHEN COALESCE(bp.n, 0) >= 5 AND bp.med > 0 THEN bc.med / bp.med - 1 END AS borough_yoy
FROM cur c
LEFT JOIN prv p ON p.comp_segment = c.comp_segment AND p.as_of_date = c.as_of_date AND p.borough = c.borough AND p.neighborhood = c.neighborhood
LEFT JOIN bcur bc ON bc.comp_segment = c.comp_segment AND bc.as_of_date = c.as_of_date AND bc.borough = c.borough
LEFT JOIN bprv bp ON bp.comp_segment = c.comp_segment AND bp.as_of_date = c.as_of_date AND bp.borough = c.borough)
"""


_GRID = _grid_sql()


def _grid(spark, sf):
    return trends.trend_grid(comp_sales(spark, sf))


@register(
    "trend_grid",
    _GRID + """SELECT comp_segment, as_of_date, borough, neighborhood, round(nbhd_median, 6) AS nbhd_median_l365,
  round(nbhd_yoy, 9) AS nbhd_yoy_growth, nbhd_sale_count_l365, round(borough_median, 6) AS borough_median_l365,
  round(borough_yoy, 9) AS borough_yoy_growth FROM grid""",
)
def q_trend_grid(spark, sf):
    g = _grid(spark, sf)
    return g.select(
        "comp_segment", "as_of_date", "borough", "neighborhood",
        F.round("nbhd_median_l365", 6).alias("nbhd_median_l365"),
        F.round("nbhd_yoy_growth", 9).alias("nbhd_yoy_growth"),
        "nbhd_sale_count_l365",
        F.round("borough_median_l365", 6).alias("borough_median_l365"),
        F.round("borough_yoy_growth", 9).alias("borough_yoy_growth"),
    )


@register(
    "rolling_median_365",
    _GRID + """SELECT comp_segment, as_of_date, borough, neighborhood, round(nbhd_median, 6) AS nbhd_median_l365,
  nbhd_sale_count_l365, round(borough_median, 6) AS borough_median_l365 FROM grid""",
)
def q_rolling_median_365(spark, sf):
    g = _grid(spark, sf)
    return g.select("comp_segment", "as_of_date", "borough", "neighborhood",
                    F.round("nbhd_median_l365", 6).alias("nbhd_median_l365"), "nbhd_sale_count_l365",
                    F.round("borough_median_l365", 6).alias("borough_median_l365"))


@register(
    "rolling_median_yoy",
    _GRID + """SELECT comp_segment, as_of_date, borough, neighborhood, round(nbhd_yoy, 9) AS nbhd_yoy_growth,
  round(borough_yoy, 9) AS borough_yoy_growth FROM grid""",
)
def q_rolling_median_yoy(spark, sf):
    g = _grid(spark, sf)
    return g.select("comp_segment", "as_of_date", "borough", "neighborhood",
                    F.round("nbhd_yoy_growth", 9).alias("nbhd_yoy_growth"),
                    F.round("borough_yoy_growth", 9).alias("borough_yoy_growth"))


@register(
    "interval_self_join",
    B.with_ctes(B.SPINE_SQL, _CS_SQL) + """,
s AS (SELECT comp_segment, sale_date, sales_price FROM cs WHERE comp_segment IS NOT NULL AND sales_price >= 100000),
d AS (SELECT DISTINCT comp_segment, as_of_date FROM cs WHERE comp_segment IS NOT NULL)
SELECT d.comp_segment, d.as_of_date,
  count(s.sales_price) FILTER (WHERE s.sale_date >= d.as_of_date - 365) AS cur_count,
  round(sum(s.sales_price) FILTER (WHERE s.sale_date >= d.as_of_date - 365), 2) AS cur_sum,
  count(s.sales_price) FILTER (WHERE s.sale_date < d.as_of_date - 365) AS prev_count,
  round(sum(s.sales_price) FILTER (WHERE s.sale_date < d.as_of_date - 365), 2) AS prev_sum
FROM d LEFT JOIN s ON s.comp_segment = d.comp_segment AND s.sale_date >= d.as_of_date - 730 AND s.sale_date < d.as_of_date
GROUP BY d.comp_segment, d.as_of_date""",
)
def q_interval_self_join(spark, sf):
    cs = comp_sales(spark, sf).where(F.col("comp_segment").isNotNull())
    sales = cs.where(F.col("sales_price") >= 100_000)
    dates = cs.select("comp_segment", "as_of_date")
    out = trends.window_sums(sales, dates, ["comp_segment"], "sale_date", "as_of_date", "sales_price",
                             {"cur": (-365, -1), "prev": (-730, -366)})
    return out.select("comp_segment", "as_of_date", "cur_count", F.round("cur_sum", 2).alias("cur_sum"),
                      "prev_count", F.round("prev_sum", 2).alias("prev_sum"))


@register(
    "partition_percentile",
    B.with_ctes(B.SPINE_SQL) + """, p AS (SELECT building_class, quantile_cont(sales_price, 0.95) AS p95 FROM spine GROUP BY building_class)
SELECT s.building_class, round(p.p95, 6) AS p95, count(*) FILTER (WHERE s.sales_price > p.p95) AS n_above, count(*) AS n_rows
FROM spine s JOIN p ON s.building_class = p.building_class GROUP BY s.building_class, p.p95""",
)
def q_partition_percentile(spark, sf):
    sp = B.spine(spark, sf)
    p = clean.group_quantiles(sp, ["building_class"], "sales_price", {"p95": 0.95})
    j = sp.join(p, "building_class")
    return j.groupBy("building_class", "p95").agg(
        F.count_if(F.col("sales_price") > F.col("p95")).alias("n_above"), F.count(F.lit(1)).alias("n_rows")
    ).withColumn("p95", F.round("p95", 6))
