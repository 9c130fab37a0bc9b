"""Registered projection / column-derivation queries (survey 2.2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotline.functions import coerce, features as FT, keys
from lotline.operators import columns as C
from lotline.plans import bindings as B
from lotline.plans.registry import register

_SP = B.with_ctes(B.SPINE_SQL)
_PA = B.with_ctes(B.PARCELS_SQL)


def _zfill_sql(expr: str, width: int) -> str:
    return f"(CASE WHEN length({expr}) >= {width} THEN {expr} ELSE lpad({expr}, {width}, '0') END)"


@register(
    "coerce_numeric",
    """SELECT c_custkey,
       TRY_CAST(trim(regexp_extract(c_name, '#(.*)$', 1)) AS DOUBLE) AS name_number,
       TRY_CAST(trim(c_mktsegment) AS DOUBLE) AS segment_number
FROM customer""",
)
def q_coerce_numeric(spark, sf):
    c = B.table(spark, sf, "customer")
    return c.select(
        "c_custkey",
        coerce.to_double(F.regexp_extract("c_name", "#(.*)$", 1)).alias("name_number"),
        coerce.to_double("c_mktsegment").alias("segment_number"),
    )


@register(
    "coerce_int_rounded",
    "SELECT c_custkey, CAST(round_even(c_acctbal, 0) AS BIGINT) AS acctbal_int, "
    "CAST(round_even(c_acctbal / 10, 0) AS BIGINT) AS acctbal_tens FROM customer",
)
def q_coerce_int_rounded(spark, sf):
    c = B.table(spark, sf, "customer")
    return c.select(
        "c_custkey",
        coerce.to_bigint_half_even("c_acctbal").alias("acctbal_int"),
        coerce.to_bigint_half_even(F.col("c_acctbal") / 10).alias("acctbal_tens"),
    )


@register(
    "coerce_timestamp",
    """SELECT o_orderkey,
       TRY_CAST(CAST(o_orderdate AS VARCHAR) AS TIMESTAMP) AS ts_parsed,
       TRY_CAST(o_orderpriority AS TIMESTAMP) AS ts_bad
FROM orders""",
)
def q_coerce_timestamp(spark, sf):
    o = B.table(spark, sf, "orders")
    return o.select(
        "o_orderkey",
        coerce.to_timestamp_safe(F.col("o_orderdate").cast("string")).cast("timestamp_ntz").alias("ts_parsed"),
        coerce.to_timestamp_safe("o_orderpriority").cast("timestamp_ntz").alias("ts_bad"),
    )


@register(
    "strip_thousands",
    """SELECT c_custkey, TRY_CAST(replace(CAST(c_custkey AS VARCHAR) || ',' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0'), ',', '') AS DOUBLE) AS lotarea
FROM customer""",
)
def q_strip_thousands(spark, sf):
    c = B.table(spark, sf, "customer")
    txt = F.concat(F.col("c_custkey").cast("string"), F.lit(","), F.lpad((F.col("c_custkey") % 1000).cast("string"), 3, "0"))
    return c.select("c_custkey", coerce.strip_thousands(txt).alias("lotarea"))


@register(
    "norm_text",
    """SELECT c_custkey, NULLIF(upper(trim(CASE WHEN c_custkey % 10 = 0 THEN 'nan' ELSE ' ' || lower(c_mktsegment) || ' ' END)), 'NAN') AS segment_norm
FROM customer""",
)
def q_norm_text(spark, sf):
    c = B.table(spark, sf, "customer")
    raw = F.when(F.col("c_custkey") % 10 == 0, F.lit("nan")).otherwise(F.concat(F.lit(" "), F.lower("c_mktsegment"), F.lit(" ")))
    return c.select("c_custkey", coerce.norm_text(raw).alias("segment_norm"))


@register(
    "parcel_key_text",
    f"""SELECT c_custkey,
  {_zfill_sql("CAST(n_regionkey + 1 AS VARCHAR)", 1)} || {_zfill_sql("CAST(c_custkey AS VARCHAR)", 5)} ||
  {_zfill_sql("CAST(c_nationkey AS VARCHAR)", 4)} AS bbl_text
FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def q_parcel_key_text(spark, sf):
    c = B.table(spark, sf, "customer")
    n = B.table(spark, sf, "nation")
    j = c.join(n, c.c_nationkey == n.n_nationkey)
    return j.select("c_custkey", keys.parcel_key_text(F.col("n_regionkey") + 1, "c_custkey", "c_nationkey").alias("bbl_text"))


@register(
    "parcel_key_int",
    """SELECT * FROM (
  SELECT c_custkey, CAST(n_regionkey + 1 AS BIGINT) * 1000000000 + NULLIF(c_custkey % 50, 0) * 10000 + c_nationkey AS bbl_int
  FROM customer JOIN nation ON c_nationkey = n_nationkey) WHERE bbl_int IS NOT NULL""",
)
def q_parcel_key_int(spark, sf):
    c = B.table(spark, sf, "customer")
    n = B.table(spark, sf, "nation")
    j = c.join(n, c.c_nationkey == n.n_nationkey)
    block = F.nullif(F.col("c_custkey") % 50, F.lit(0))
    out = j.select("c_custkey", keys.parcel_key_int(F.col("n_regionkey") + 1, block, "c_nationkey").alias("bbl_int"))
    return out.dropna(subset=["bbl_int"])


_RAW_KEY_SQL = """CASE c_custkey % 4 WHEN 0 THEN CAST(c_custkey AS VARCHAR) || '.0'
                              WHEN 1 THEN '00' || CAST(c_custkey AS VARCHAR)
                              WHEN 2 THEN 'BBL-' || CAST(c_custkey AS VARCHAR) || '-X'
                              ELSE 'none' END"""


@register(
    "parcel_key_normalise",
    f"""SELECT c_custkey,
  CAST(TRY_CAST(NULLIF(regexp_replace(regexp_replace(trim({_RAW_KEY_SQL}), '\\.0+$', ''), '[^0-9]', '', 'g'), '') AS DECIMAL(38,0)) AS VARCHAR) AS bbl_norm
FROM customer""",
)
def q_parcel_key_normalise(spark, sf):
    c = B.table(spark, sf, "customer")
    k = F.col("c_custkey")
    raw = (
        F.when(k % 4 == 0, F.concat(k.cast("string"), F.lit(".0")))
        .when(k % 4 == 1, F.concat(F.lit("00"), k.cast("string")))
        .when(k % 4 == 2, F.concat(F.lit("BBL-"), k.cast("string"), F.lit("-X")))
        .otherwise(F.lit("none"))
    )
    return c.select("c_custkey", keys.normalise_parcel_key(raw).alias("bbl_norm"))


@register(
    "parent_lot_key",
    "SELECT c_custkey, CASE WHEN (c_custkey * 7) % 2000 >= 1000 THEN 1 ELSE (c_custkey * 7) % 2000 END AS parent_lot FROM customer",
)
def q_parent_lot_key(spark, sf):
    c = B.table(spark, sf, "customer")
    return c.select("c_custkey", keys.parent_lot((F.col("c_custkey") * 7) % 2000).alias("parent_lot"))


@register("as_of_date", _SP + "SELECT sale_id, sale_date, as_of_date FROM spine")
def q_as_of_date(spark, sf):
    return B.spine(spark, sf).select("sale_id", "sale_date", "as_of_date")


@register("segment_map", _SP + "SELECT sale_id, building_class, segment FROM spine")
def q_segment_map(spark, sf):
    return B.spine(spark, sf).select("sale_id", "building_class", "segment")


@register(
    "comp_segment",
    _SP + """SELECT sale_id, CASE WHEN segment = 'one_family' THEN 'one_family'
  WHEN segment = 'condo_coop' THEN 'condo_coop'
  WHEN segment = 'multi_family' AND starts_with(trim(COALESCE(building_class, '')), '02') THEN 'two_family'
  WHEN segment = 'multi_family' AND starts_with(trim(COALESCE(building_class, '')), '03') THEN 'three_family' END AS comp_segment
FROM spine""",
)
def q_comp_segment(spark, sf):
    sp = B.spine(spark, sf)
    return sp.select("sale_id", FT.comp_segment("segment", "building_class").alias("comp_segment"))


@register(
    "route_model",
    _SP + """, avail AS (
  SELECT model_key FROM (
    SELECT CASE WHEN building_class LIKE '02%' THEN 'two_family' WHEN building_class LIKE '03%' THEN 'three_family'
                WHEN building_class LIKE '07%' OR building_class LIKE '08%' THEN 'rentals_all' END AS model_key
    FROM spine WHERE year(sale_date) <= 1996)
  WHERE model_key IS NOT NULL GROUP BY model_key HAVING count(*) >= 650)
SELECT sale_id, CASE
  WHEN trim(building_class) = '01 ONE FAMILY DWELLINGS' THEN 'one_family'
  WHEN trim(building_class) = '02 TWO FAMILY DWELLINGS' AND 'two_family' IN (SELECT model_key FROM avail) THEN 'two_family'
  WHEN trim(building_class) = '03 THREE FAMILY DWELLINGS' AND 'three_family' IN (SELECT model_key FROM avail) THEN 'three_family'
  WHEN trim(building_class) IN ('02 TWO FAMILY DWELLINGS', '03 THREE FAMILY DWELLINGS') THEN 'multi_family'
  WHEN trim(building_class) IN ('09 COOPS - WALKUP APARTMENTS', '10 COOPS - ELEVATOR APARTMENTS', '12 CONDOS - WALKUP APARTMENTS',
       '13 CONDOS - ELEVATOR APARTMENTS', '15 CONDOS - 2-10 UNIT RESIDENTIAL', '17 CONDO COOPS') THEN 'condo_coop'
  WHEN trim(building_class) IN ('07 RENTALS - WALKUP APARTMENTS', '08 RENTALS - ELEVATOR APARTMENTS')
       AND 'rentals_all' IN (SELECT model_key FROM avail) THEN 'rentals_all'
  WHEN trim(building_class) = '07 RENTALS - WALKUP APARTMENTS' THEN 'rental_walkup'
  WHEN trim(building_class) = '08 RENTALS - ELEVATOR APARTMENTS' THEN 'rental_elevator'
  ELSE 'global' END AS model_key
FROM spine""",
)
def q_route_model(spark, sf):
    sp = B.spine(spark, sf)
    cand = (
        F.when(F.col("building_class").like("02%"), "two_family")
        .when(F.col("building_class").like("03%"), "three_family")
        .when(F.col("building_class").like("07%") | F.col("building_class").like("08%"), "rentals_all")
    )
    avail = (
        sp.where(F.year("sale_date") <= 1996)
        .select(cand.alias("model_key"))
        .where(F.col("model_key").isNotNull())
        .groupBy("model_key").count().where(F.col("count") >= 650).select("model_key")
    )
    return C.route_model(sp, avail, "building_class").select("sale_id", "model_key")


@register(
    "borough_names",
    _SP + """SELECT sale_id, CASE borough WHEN 1 THEN 'Manhattan' WHEN 2 THEN 'Bronx' WHEN 3 THEN 'Brooklyn'
  WHEN 4 THEN 'Queens' WHEN 5 THEN 'Staten Island' ELSE 'Unknown' END AS borough_name FROM spine""",
)
def q_borough_names(spark, sf):
    return B.spine(spark, sf).select("sale_id", FT.borough_name("borough").alias("borough_name"))


@register(
    "property_age",
    _SP + """SELECT sale_id,
  CASE WHEN 2024 - y < 0 THEN 0.0 WHEN 2024 - y > 200 THEN 200.0 ELSE 2024 - y END AS property_age_train,
  2024.0 - COALESCE(y, 2004.0) AS property_age_eval
FROM (SELECT sale_id, CASE WHEN sale_id % 9 = 0 THEN NULL ELSE year_built - (sale_id % 3) * 60 END AS y FROM spine)""",
)
def q_property_age(spark, sf):
    sp = B.spine(spark, sf)
    y = F.when(F.col("sale_id") % 9 == 0, F.lit(None)).otherwise(F.col("year_built") - (F.col("sale_id") % 3) * 60)
    sp = sp.withColumn("y", y)
    return sp.select(
        "sale_id",
        FT.property_age_train("y").alias("property_age_train"),
        FT.property_age_eval("y").alias("property_age_eval"),
    )


@register(
    "per_unit_ratios",
    _SP + """SELECT sale_id,
  gross_sqft / (CASE WHEN total_units < 1 THEN 1.0 ELSE total_units END) AS sqft_per_unit,
  COALESCE(land_sqft, 0.0) / COALESCE(CASE WHEN total_units < 1 THEN 1.0 ELSE total_units END, 1.0) AS land_per_unit,
  sales_price / (CASE WHEN total_units < 1 THEN 1.0 ELSE total_units END) AS price_per_unit,
  CASE WHEN residential_units > 0 AND total_units > 0 THEN residential_units / total_units END AS units_per_floor
FROM spine""",
)
def q_per_unit_ratios(spark, sf):
    sp = B.spine(spark, sf)
    return sp.select(
        "sale_id",
        FT.per_unit("gross_sqft", "total_units").alias("sqft_per_unit"),
        FT.per_unit("land_sqft", "total_units", fill_value_zero=True, fill_units_one=True).alias("land_per_unit"),
        FT.per_unit("sales_price", "total_units").alias("price_per_unit"),
        FT.positive_ratio("residential_units", "total_units").alias("units_per_floor"),
    )


@register(
    "lot_coverage_footprint",
    _PA + """SELECT bbl,
  CASE WHEN bldgarea > 0 AND lotarea IS NOT NULL THEN bldgarea / (CASE WHEN lotarea < 1 THEN 1.0 ELSE lotarea END) END AS lot_coverage,
  CASE WHEN bldgfront > 0 AND bldgdepth > 0 THEN bldgfront * bldgdepth END AS bldg_footprint
FROM parcels""",
)
def q_lot_coverage(spark, sf):
    p = B.parcels(spark, sf)
    return p.select(
        "bbl",
        FT.lot_coverage("bldgarea", "lotarea").alias("lot_coverage"),
        FT.footprint("bldgfront", "bldgdepth").alias("bldg_footprint"),
    )


@register(
    "stabilisation_ratio",
    _PA + """SELECT bbl, CASE WHEN r < 0 THEN 0.0 WHEN r > 1 THEN 1.0 ELSE r END AS stabilization_ratio FROM (
  SELECT bbl, COALESCE(CASE WHEN unitsres = 0 THEN NULL ELSE CAST(bbl % 5 AS DOUBLE) / unitsres END, 0.0) AS r FROM parcels)""",
)
def q_stabilisation_ratio(spark, sf):
    p = B.parcels(spark, sf)
    return p.select("bbl", FT.stabilisation_ratio(F.col("bbl") % 5, "unitsres").alias("stabilization_ratio"))


@register(
    "fill_units",
    B.with_ctes(B.SPINE_SQL, B.PARCELS_SQL)
    + """SELECT s.sale_id, CASE WHEN s.total_units > 0 THEN s.total_units ELSE p.unitsres END AS units_filled
FROM spine s LEFT JOIN parcels p ON s.bbl = p.bbl""",
)
def q_fill_units(spark, sf):
    sp = B.spine(spark, sf).select("sale_id", "bbl", "total_units")
    p = B.parcels(spark, sf).select("bbl", "unitsres")
    j = sp.join(p, "bbl", "left")
    return j.select("sale_id", FT.fill_units("total_units", "unitsres").alias("units_filled"))


@register(
    "is_elevator",
    _SP + "SELECT sale_id, CASE WHEN trim(building_class) = '08 RENTALS - ELEVATOR APARTMENTS' THEN 1 ELSE 0 END AS is_elevator FROM spine",
)
def q_is_elevator(spark, sf):
    return B.spine(spark, sf).select("sale_id", FT.is_elevator("building_class").alias("is_elevator"))


@register(
    "hub_route_count",
    B.with_ctes(B.STATIONS_SQL)
    + """SELECT station_id, n AS route_count, n >= 2 AS is_hub FROM (
  SELECT station_id, CAST(len(list_filter(string_split_regex(trim(COALESCE(routes, '')), '\\s+'), lambda x: x <> '')) AS INTEGER) AS n
  FROM stations)""",
)
def q_hub_route_count(spark, sf):
    s = B.stations(spark, sf)
    n = FT.route_count("routes")
    return s.select("station_id", n.alias("route_count"), (n >= 2).alias("is_hub"))


@register(
    "cbd_flag",
    B.with_ctes(B.STATIONS_SQL) + "SELECT station_id, lower(trim(cbd)) IN ('true', '1', 'yes') AS is_cbd FROM stations",
)
def q_cbd_flag(spark, sf):
    return B.stations(spark, sf).select("station_id", FT.cbd_flag("cbd").alias("is_cbd"))


@register(
    "log_target",
    _SP + """SELECT sale_id, round(ln(1 + sales_price), 9) AS log_price,
  round(exp(LEAST(GREATEST(ln(1 + sales_price) + (sale_id % 3) * 4.0, 0.0), 20.7)) - 1, 3) AS price_back
FROM spine""",
)
def q_log_target(spark, sf):
    sp = B.spine(spark, sf)
    lt = FT.log_target("sales_price")
    return sp.select(
        "sale_id",
        F.round(lt, 9).alias("log_price"),
        F.round(FT.inverse_log_target(lt + (F.col("sale_id") % 3) * 4.0), 3).alias("price_back"),
    )


@register(
    "expiry_year",
    B.with_ctes(B.ABATEMENTS_SQL) + "SELECT row_id, init_year + exempt_years AS expiry_year FROM abatements",
)
def q_expiry_year(spark, sf):
    a = B.abatements(spark, sf)
    return a.select("row_id", FT.expiry_year("init_year", "exempt_years").alias("expiry_year"))


@register(
    "payload_alias_map",
    _SP + """SELECT sale_id, COALESCE(gross_sqft_v2, sqft_v1) AS gross_sqft, COALESCE(units_v2, n_units_v1, 1.0) AS total_units
FROM (SELECT sale_id,
   CASE WHEN sale_id % 2 = 0 THEN gross_sqft END AS gross_sqft_v2,
   CASE WHEN sale_id % 2 = 1 THEN gross_sqft END AS sqft_v1,
   CASE WHEN sale_id % 3 = 0 THEN total_units END AS units_v2,
   CASE WHEN sale_id % 3 = 1 THEN total_units END AS n_units_v1 FROM spine)""",
)
def q_payload_alias_map(spark, sf):
    sp = B.spine(spark, sf)
    k = F.col("sale_id")
    payload = sp.select(
        "sale_id",
        F.when(k % 2 == 0, F.col("gross_sqft")).alias("gross_sqft_v2"),
        F.when(k % 2 == 1, F.col("gross_sqft")).alias("sqft_v1"),
        F.when(k % 3 == 0, F.col("total_units")).alias("units_v2"),
        F.when(k % 3 == 1, F.col("total_units")).alias("n_units_v1"),
    )
    aliases = {"gross_sqft": ["gross_sqft_v2", "sqft_v1"], "total_units": ["units_v2", "n_units_v1"]}
    return C.payload_alias_map(payload, aliases, defaults={"total_units": 1.0}, keep=["sale_id"])


@register(
    "public_request_features",
    B.with_ctes(B.SPINE_SQL, B.PARCELS_SQL) + """SELECT s.sale_id, s.gross_sqft, s.land_sqft, s.residential_units,
  CASE WHEN s.sale_id % 2 = 0 THEN 1 ELSE 0 END AS commercial_units, s.total_units, p.numfloors, s.residential_units AS unitsres, s.total_units AS unitstotal,
  s.land_sqft AS lotarea, s.gross_sqft AS bldgarea, p.latitude, p.longitude, CAST(s.year_built AS INTEGER) AS year_built, s.borough, s.building_class,
  s.neighborhood, 'Z' || CAST(s.bbl % 300 AS VARCHAR) AS zip_code, CASE WHEN s.year_built IS NOT NULL THEN greatest(0, 1995 - CAST(s.year_built AS INTEGER)) END AS property_age
FROM spine s LEFT JOIN parcels p ON p.bbl = s.bbl""",
)
def q_public_request_features(spark, sf):
    p = B.parcels(spark, sf).select("bbl", "numfloors", "latitude", "longitude")
    req = B.spine(spark, sf).join(p, "bbl", "left").select(
        "sale_id", F.col("gross_sqft").alias("gross_square_feet"), F.col("land_sqft").alias("land_square_feet"), "residential_units", "total_units",
        F.when(F.col("sale_id") % 2 == 0, 1).alias("commercial_units"), "numfloors", "latitude", "longitude", "year_built", "borough",
        F.col("building_class").alias("building_class_category"), "neighborhood", F.concat(F.lit("Z"), (F.col("bbl") % 300).cast("string")).alias("zip_code"))
    return C.public_request_features(req, F.lit(1995), keep=["sale_id"])


@register("select_prefix_columns", _SP + "SELECT sale_id, bbl, sale_date, sales_price, segment FROM spine")
def q_select_prefix_columns(spark, sf):
    sp = B.spine(spark, sf)
    return C.select_prefix_columns(sp, keys=["sale_id", "bbl"], prefixes=["sale", "seg"], missing_ok=["absent_col"])


@register(
    "standardise_schema",
    """SELECT o_orderkey AS sale_id, o_custkey AS bbl, o_totalprice AS sales_price, o_orderdate AS sale_ts FROM orders""",
)
def q_standardise_schema(spark, sf):
    o = B.table(spark, sf, "orders")
    mapping = {"o_orderkey": "sale_id", "o_custkey": "bbl", "o_totalprice": "sales_price", "o_orderdate": "sale_ts",
               "O_ABSENT": "ignored"}
    return C.standardise_schema(o, mapping, keep_only=True)


@register(
    "norm_headers",
    'SELECT p_partkey AS "p partkey", p_name AS "p name", p_brand AS "p_brand", p_size AS "p size" FROM part',
)
def q_norm_headers(spark, sf):
    p = B.table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    messy = p.toDF("  P PARTKEY ", "P\nNAME", "p_brand  ", "P  SIZE")
    return C.norm_headers(messy)


@register("resolve_column", "SELECT o_orderkey, o_totalprice AS sales_price FROM orders")
def q_resolve_column(spark, sf):
    o = B.table(spark, sf, "orders")
    price = C.resolve_column(o, "SALE_PRICE", "O_TOTALPRICE", "price")
    key = C.resolve_column(o, "O_ORDERKEY")
    return o.select(F.col(key).alias("o_orderkey"), F.col(price).alias("sales_price"))
