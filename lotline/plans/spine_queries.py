"""Registered queries of the composed spine: raw sale files to the spine, and
the rows that each step leaves."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotline.functions.features import SEGMENT_MAP
from lotline.operators.spine import RENTAL_CLASSES, build_spine
from lotline.plans import bindings as B
from lotline.plans.registry import register

# Raw sale files: current ones from 1999 on, historical ones up to 1999 (so a
# year overlaps), with numbers as text, unparsable prices, missing and impossible years.
_RAW_SQL = """raw AS (
  SELECT borough, CAST(bbl // 100 AS VARCHAR) AS block, CASE WHEN bbl % 100 = 7 THEN 'none' ELSE CAST(bbl % 100 AS VARCHAR) END AS lot, neighborhood,
    '  ' || lower(building_class) || ' ' AS building_class, CASE WHEN sale_id % 50 = 0 THEN NULL WHEN sale_id % 53 = 0 THEN 10.0 ELSE sales_price END AS sales_price,
    CASE WHEN sale_id % 41 = 0 THEN NULL WHEN sale_id % 43 = 0 THEN 0.0 ELSE year_built END AS year_built, gross_sqft, land_sqft,
    CASE WHEN total_units > 0 THEN total_units * 3 ELSE total_units END AS total_units, residential_units,
    CASE WHEN sale_id % 47 = 0 THEN NULL ELSE sale_date END AS sale_date, f.file_type
  FROM spine, (VALUES ('current'), ('historical')) f(file_type)
  WHERE (f.file_type = 'current' AND year(sale_date) >= 1999) OR (f.file_type = 'historical' AND year(sale_date) <= 1999))"""


def raw_sales(spark, sf):
    s = B.spine(spark, sf)
    k, y = F.col("sale_id"), F.year("sale_date")
    none = F.lit(None)
    base = s.select(
        "borough", F.floor(F.col("bbl") / 100).cast("string").alias("block"), F.when(F.col("bbl") % 100 == 7, "none").otherwise((F.col("bbl") % 100).cast("string")).alias("lot"),
        "neighborhood", F.concat(F.lit("  "), F.lower("building_class"), F.lit(" ")).alias("building_class"),
        F.when(k % 50 == 0, "n/a").when(k % 53 == 0, "10").otherwise(F.col("sales_price").cast("string")).alias("sales_price"),
        F.when(k % 41 == 0, none).when(k % 43 == 0, "0").otherwise(F.col("year_built").cast("string")).alias("year_built"),
        F.col("gross_sqft").cast("string").alias("gross_sqft"), F.col("land_sqft").cast("string").alias("land_sqft"),
        F.when(F.col("total_units") > 0, F.col("total_units") * 3).otherwise(F.col("total_units")).cast("string").alias("total_units"),
        F.col("residential_units").cast("string").alias("residential_units"), F.when(k % 47 == 0, "unknown").otherwise(F.col("sale_date").cast("string")).alias("sale_date"), y.alias("y"))
    files = base.where("y >= 1999").withColumn("file_type", F.lit("current")).unionByName(base.where("y <= 1999").withColumn("file_type", F.lit("historical")))
    return files.drop("y")


_IN = ", ".join(f"'{c}'" for c in SEGMENT_MAP)
_RENT = ", ".join(f"'{c}'" for c in RENTAL_CLASSES)
_STEPS_SQL = B.with_ctes(B.SPINE_SQL, _RAW_SQL) + f""", homes AS (SELECT * REPLACE (upper(trim(building_class)) AS building_class) FROM raw WHERE upper(trim(building_class)) IN ({_IN})),
valid AS (SELECT * FROM homes WHERE sales_price >= 1000 AND sale_date IS NOT NULL AND year_built BETWEEN 1800 AND 2026),
capped AS (SELECT * FROM valid WHERE sales_price <= (SELECT quantile_cont(sales_price, 0.99) FROM valid)),
floored AS (SELECT * FROM capped WHERE building_class NOT IN ({_RENT}) OR sales_price / greatest(total_units, 1) >= 30000),
caps AS (SELECT building_class, quantile_cont(sales_price, 0.95) AS cap FROM floored WHERE building_class IN ({_RENT}) GROUP BY 1),
rest AS (SELECT f.* FROM floored f LEFT JOIN caps USING (building_class) WHERE cap IS NULL OR sales_price <= cap),
keyed AS (SELECT CAST(borough AS VARCHAR) || lpad(block, 5, '0') || lpad(COALESCE(CAST(TRY_CAST(lot AS BIGINT) AS VARCHAR), '0'), 4, '0') AS bbl, sale_date, sale_date - 1 AS as_of_date, borough,
  CAST(block AS BIGINT) AS block, COALESCE(TRY_CAST(lot AS BIGINT), 0) AS lot, neighborhood, building_class, {B._segment_case_sql('building_class')} AS segment, year_built, sales_price,
  gross_sqft, land_sqft, total_units, residential_units, file_type FROM rest),
uniq AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY bbl, sale_date, sales_price ORDER BY file_type, as_of_date, borough, block, lot, neighborhood, building_class, segment,
  year_built, gross_sqft, land_sqft, total_units, residential_units) AS rn FROM keyed) WHERE rn = 1)
"""


@register("build_spine", _STEPS_SQL + "SELECT * FROM uniq")
def q_build_spine(spark, sf):
    """Raw sale files to the spine."""
    return build_spine(raw_sales(spark, sf))[0]


@register("build_spine_funnel", _STEPS_SQL + """SELECT * FROM (SELECT 0 AS step, 'raw' AS stage, count(*) AS rows FROM raw UNION ALL SELECT 1, 'residential', count(*) FROM homes
UNION ALL SELECT 2, 'valid', count(*) FROM valid UNION ALL SELECT 3, 'below_global_cap', count(*) FROM capped UNION ALL SELECT 4, 'above_rental_floor', count(*) FROM floored
UNION ALL SELECT 5, 'below_rental_cap', count(*) FROM rest UNION ALL SELECT 6, 'unique', count(*) FROM uniq)""")
def q_build_spine_funnel(spark, sf):
    """Rows that each step of the spine leaves, counted while it was built."""
    return build_spine(raw_sales(spark, sf))[1]
