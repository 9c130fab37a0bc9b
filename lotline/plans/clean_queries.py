"""Registered filter / row-quality / de-duplication queries (survey 2.3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotline.functions.features import RENTAL_CLASSES, SEGMENT_MAP
from lotline.operators import clean
from lotline.plans import bindings as B
from lotline.plans.registry import register

_RES = list(SEGMENT_MAP)
_RES_SQL = ", ".join(f"'{c}'" for c in _RES)
_RENT_SQL = ", ".join(f"'{c}'" for c in RENTAL_CLASSES)
_SP = B.with_ctes(B.SPINE_SQL)


@register("filter_in_set", _SP + f"SELECT sale_id, building_class FROM spine WHERE building_class IN ({_RES_SQL})")
def q_filter_in_set(spark, sf):
    return clean.filter_in_set(B.spine(spark, sf), "building_class", _RES).select("sale_id", "building_class")


@register(
    "filter_valid_sale",
    _SP + "SELECT sale_id FROM spine WHERE sales_price > 50000 AND sale_date IS NOT NULL "
    "AND year_built IS NOT NULL AND year_built BETWEEN 1800 AND 2026",
)
def q_filter_valid_sale(spark, sf):
    sp = B.spine(spark, sf)
    return clean.filter_valid_sale(sp, min_price=50_000, strict_min=True).select("sale_id")


@register(
    "cap_global_quantile",
    _SP + "SELECT sale_id, sales_price FROM spine "
    "WHERE sales_price <= (SELECT quantile_cont(sales_price, 0.99) FROM spine)",
)
def q_cap_global_quantile(spark, sf):
    return clean.cap_global_quantile(B.spine(spark, sf), "sales_price", 0.99).select("sale_id", "sales_price")


@register(
    "cap_group_quantile",
    _SP + """, caps AS (SELECT building_class, quantile_cont(sales_price, 0.95) AS cap FROM spine GROUP BY building_class)
SELECT s.sale_id, s.building_class FROM spine s JOIN caps c ON s.building_class IS NOT DISTINCT FROM c.building_class
WHERE s.sales_price <= c.cap""",
)
def q_cap_group_quantile(spark, sf):
    out = clean.cap_group_quantile(B.spine(spark, sf), ["building_class"], "sales_price", 0.95)
    return out.select("sale_id", "building_class")


@register(
    "cap_group_quantile_borough_class",
    _SP + """, caps AS (SELECT borough, building_class, quantile_cont(sales_price, 0.97) AS cap
              FROM spine GROUP BY borough, building_class)
SELECT s.sale_id FROM spine s JOIN caps c ON s.borough = c.borough AND s.building_class = c.building_class
WHERE s.sales_price <= c.cap""",
)
def q_cap_group_quantile_bc(spark, sf):
    out = clean.cap_group_quantile(B.spine(spark, sf), ["borough", "building_class"], "sales_price", 0.97)
    return out.select("sale_id")


@register(
    "floor_per_unit",
    _SP + f"""SELECT sale_id FROM spine
WHERE NOT COALESCE(building_class IN ({_RENT_SQL}), false)
   OR COALESCE(sales_price / (CASE WHEN total_units < 1 THEN 1.0 ELSE total_units END) >= 30000, false)""",
)
def q_floor_per_unit(spark, sf):
    return clean.floor_per_unit(B.spine(spark, sf), classes=RENTAL_CLASSES).select("sale_id")


@register(
    "band_group_quantile",
    _SP + """, ws AS (SELECT *, sales_price / gross_sqft AS ppsf FROM spine WHERE gross_sqft IS NOT NULL AND gross_sqft > 0),
g AS (SELECT quantile_cont(ppsf, 0.02) AS glo, quantile_cont(ppsf, 0.98) AS ghi, count(*) AS n FROM ws),
nb AS (SELECT neighborhood, quantile_cont(ppsf, 0.02) AS lo, quantile_cont(ppsf, 0.98) AS hi
       FROM ws WHERE neighborhood IS NOT NULL GROUP BY neighborhood)
SELECT ws.sale_id FROM ws LEFT JOIN nb ON ws.neighborhood = nb.neighborhood, g
WHERE g.n <= 100 OR (ws.ppsf >= COALESCE(nb.lo, g.glo) AND ws.ppsf <= COALESCE(nb.hi, g.ghi))
UNION ALL
SELECT sale_id FROM spine WHERE NOT COALESCE(gross_sqft IS NOT NULL AND gross_sqft > 0, false)""",
)
def q_band_group_quantile(spark, sf):
    return clean.band_group_quantile(B.spine(spark, sf)).select("sale_id")


@register(
    "band_fixed",
    _SP + "SELECT sale_id FROM spine WHERE total_units > 0 AND sales_price / total_units BETWEEN 75000 AND 925000",
)
def q_band_fixed(spark, sf):
    sp = B.spine(spark, sf).where(F.col("total_units") > 0)
    return clean.band_fixed(sp, F.col("sales_price") / F.col("total_units"), 75_000, 925_000).select("sale_id")


@register(
    "sales_hygiene",
    _SP + """SELECT sale_id FROM spine WHERE sales_price >= 100000 AND sales_price <= 9500000
AND (CASE WHEN gross_sqft > 100 THEN sales_price / gross_sqft END IS NULL
     OR CASE WHEN gross_sqft > 100 THEN sales_price / gross_sqft END >= 50.0)""",
)
def q_sales_hygiene(spark, sf):
    out = clean.sales_hygiene(B.spine(spark, sf), min_price=100_000, max_price=9_500_000, min_ppsqft=50.0)
    return out.select("sale_id")


@register(
    "filter_date_sanity",
    B.with_ctes(B.documents_sql("deeds", "F"))
    + "SELECT document_id FROM deeds WHERE document_date IS NOT NULL AND year(document_date) BETWEEN 1900 AND 2030",
)
def q_filter_date_sanity(spark, sf):
    return clean.filter_date_sanity(B.documents(spark, sf, "F"), "document_date").select("document_id")


@register(
    "filter_valid_coords",
    B.with_ctes(B.PARCELS_SQL)
    + "SELECT bbl FROM parcels WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND latitude <> 0 AND longitude <> 0",
)
def q_filter_valid_coords(spark, sf):
    return clean.filter_valid_coords(B.parcels(spark, sf)).select("bbl")


@register(
    "filter_required",
    _SP + """SELECT sale_id, 2024 - year_built AS property_age FROM spine
WHERE gross_sqft IS NOT NULL AND year_built IS NOT NULL AND total_units IS NOT NULL
  AND 2024 - year_built >= 0 AND 2024 - year_built < 300""",
)
def q_filter_required(spark, sf):
    sp = B.spine(spark, sf).withColumn("property_age", F.lit(2024.0) - F.col("year_built"))
    out = clean.filter_required(sp, ["gross_sqft", "year_built", "total_units"], age_col="property_age")
    return out.select("sale_id", "property_age")


_REQ = """requests AS (
  SELECT sale_id, year_built - 100 AS year_built, gross_sqft - 200 AS gross_sqft, land_sqft,
         total_units - 1 AS total_units, residential_units, latitude, longitude - 1.0 AS longitude,
         CAST(borough AS VARCHAR) AS borough, neighborhood, building_class
  FROM spine)"""

_RULE_NAMES = clean.REQUEST_RULE_NAMES


def _rules_sql() -> str:
    conds = [
        "NOT COALESCE(year_built BETWEEN 1800 AND 2026, false)",
        "NOT COALESCE(gross_sqft > 0, false)",
        "COALESCE(land_sqft < 0, false)",
        "COALESCE(total_units < 0, false)",
        "COALESCE(residential_units < 0, false)",
        "COALESCE(NOT (latitude BETWEEN 40.0 AND 41.5), false)",
        "COALESCE(NOT (longitude BETWEEN -75.0 AND -73.0), false)",
        "COALESCE(length(trim(borough)), 0) = 0",
        "COALESCE(length(trim(neighborhood)), 0) = 0",
        "COALESCE(length(trim(building_class)), 0) = 0",
    ]
    return "list_filter([" + ", ".join(
        f"CASE WHEN {c} THEN '{n}' END" for c, n in zip(conds, _RULE_NAMES)
    ) + "], lambda x: x IS NOT NULL)"


@register(
    "validate_rows",
    B.with_ctes(B.SPINE_SQL, _REQ)
    + f"""SELECT sale_id, array_to_string(e, ',') AS error_list, CAST(len(e) AS INTEGER) AS n_errors, len(e) = 0 AS is_valid
FROM (SELECT sale_id, {_rules_sql()} AS e FROM requests)""",
)
def q_validate_rows(spark, sf):
    sp = B.spine(spark, sf, with_geo=True)
    req = sp.select(
        "sale_id",
        (F.col("year_built") - 100).alias("year_built"),
        (F.col("gross_sqft") - 200).alias("gross_sqft"),
        "land_sqft",
        (F.col("total_units") - 1).alias("total_units"),
        "residential_units",
        "latitude",
        (F.col("longitude") - 1.0).alias("longitude"),
        F.col("borough").cast("string").alias("borough"),
        "neighborhood",
        "building_class",
    )
    v = clean.validate_rows(req, clean.request_rules())
    return v.select("sale_id", F.array_join("errors", ",").alias("error_list"),
                    F.size("errors").alias("n_errors"), "is_valid")


@register(
    "validate_explanations",
    """WITH x AS (
  SELECT o_orderkey AS id, repeat(o_orderpriority || ' ', CAST(o_orderkey % 80 AS INTEGER)) AS summary,
    CASE WHEN o_orderkey % 9 > 0 THEN o_orderpriority END AS opportunity, repeat('r', CAST(590 + o_orderkey % 20 AS INTEGER)) AS risks,
    CASE o_orderkey % 5 WHEN 0 THEN 'Buy' WHEN 1 THEN 'Hold' WHEN 2 THEN 'Avoid' WHEN 3 THEN 'buy' END AS recommendation,
    CASE o_orderstatus WHEN 'F' THEN 'High' WHEN 'O' THEN 'Low' ELSE 'Certain' END AS confidence FROM orders)
SELECT id, array_to_string(list_filter([CASE WHEN length(summary) > 600 THEN 'summary_length' END, CASE WHEN opportunity IS NULL THEN 'opportunity_required' END,
  CASE WHEN length(risks) > 600 THEN 'risks_length' END, CASE WHEN COALESCE(recommendation, '') NOT IN ('Buy', 'Hold', 'Avoid') THEN 'recommendation_label' END,
  CASE WHEN confidence NOT IN ('Low', 'Medium', 'High') THEN 'confidence_label' END], lambda v: v IS NOT NULL), ',') AS error_list FROM x""",
)
def q_validate_explanations(spark, sf):
    o = B.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    rec = F.when(k % 5 == 0, "Buy").when(k % 5 == 1, "Hold").when(k % 5 == 2, "Avoid").when(k % 5 == 3, "buy")
    x = o.select(k.alias("id"), F.repeat(F.concat("o_orderpriority", F.lit(" ")), (k % 80).cast("int")).alias("summary"),
                 F.when(k % 9 > 0, F.col("o_orderpriority")).alias("opportunity"), F.repeat(F.lit("r"), (k % 20 + 590).cast("int")).alias("risks"),
                 rec.alias("recommendation"),
                 F.when(F.col("o_orderstatus") == "F", "High").when(F.col("o_orderstatus") == "O", "Low").otherwise("Certain").alias("confidence"))
    return clean.validate_rows(x, clean.explanation_rules()).select("id", F.array_join("errors", ",").alias("error_list"))


@register(
    "filter_optional_params",
    _SP + "SELECT sale_id FROM spine WHERE neighborhood = 'NATION_7' AND sales_price >= 0 AND sales_price <= 300000",
)
def q_filter_optional_params(spark, sf):
    out = clean.filter_optional(B.spine(spark, sf), neighborhood="NATION_7", min_sales_price=0,
                                max_sales_price=300_000, segment=None)
    return out.select("sale_id")


@register(
    "filter_row_owner",
    B.with_ctes(B.USAGE_SQL)
    + """, callers AS (SELECT DISTINCT user_id AS caller_id FROM usage WHERE role <> 'admin')
SELECT u.event_id, c.caller_id FROM usage u JOIN callers c ON u.user_id = c.caller_id""",
)
def q_filter_row_owner(spark, sf):
    u = B.usage_events(spark, sf)
    callers = u.where(F.col("role") != "admin").select(F.col("user_id").alias("caller_id")).distinct()
    return clean.visible_rows(u, callers).select("event_id", "caller_id")


@register(
    "gate_min_rows",
    _SP + "SELECT segment, count(*) AS n_rows FROM spine GROUP BY segment HAVING count(*) >= 1000",
)
def q_gate_min_rows(spark, sf):
    return clean.gate_min_rows(B.spine(spark, sf), ["segment"], 1000)


@register(
    "suspicious_rows",
    _SP + """SELECT sale_id, CASE WHEN COALESCE(sales_price / 1000, 0) <= 100 THEN 'low_price' ELSE 'missing_sqft' END AS reason
FROM (SELECT sale_id, sales_price, CASE WHEN total_units > 0 THEN gross_sqft END AS gross_sqft FROM spine)
WHERE COALESCE(sales_price / 1000, 0) <= 100 OR gross_sqft IS NULL""",
)
def q_suspicious_rows(spark, sf):
    sp = B.spine(spark, sf).select(
        "sale_id",
        (F.col("sales_price") / 1000).alias("price_k"),
        F.when(F.col("total_units") > 0, F.col("gross_sqft")).alias("gross_sqft"),
    )
    return clean.suspicious_rows(sp, price="price_k").select("sale_id", "reason")


@register("dedup_full_row", "SELECT DISTINCT * FROM lineitem")
def q_dedup_full_row(spark, sf):
    return clean.dedup_full_row(B.table(spark, sf, "lineitem"))


@register(
    "dedup_full_row_excluding_id",
    """SELECT l_orderkey, l_linenumber, l_returnflag, min(l_partkey) AS l_partkey FROM lineitem
GROUP BY l_orderkey, l_linenumber, l_returnflag""",
)
def q_dedup_full_row_excl(spark, sf):
    li = B.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey")
    return clean.dedup_full_row(li, exclude=["l_partkey"])


@register(
    "dedup_subset",
    """SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                               ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity,
                                        l_discount, l_tax, l_returnflag, l_linestatus) AS rn
  FROM lineitem) WHERE rn = 1""",
)
def q_dedup_subset(spark, sf):
    li = B.table(spark, sf, "lineitem")
    order = [F.col(c) for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity",
                                      "l_discount", "l_tax", "l_returnflag", "l_linestatus")]
    return clean.dedup_subset(li, ["l_orderkey", "l_linenumber"], order)
