"""Bindings of the library's roles (sales spine, deeds, tax rolls, stations,
parcels, usage counters, ...) onto the driver's TPC-H-like tables.

Each role exists twice: as a Spark DataFrame builder (what the registered
queries run) and as a SQL CTE (what the DuckDB oracle runs). Both are written
from the same fixed rules below so the two sides see identical inputs.

Derivations are deterministic integer arithmetic on keys, so every role grows
with the tables it is derived from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotline.functions.features import SEGMENT_MAP, segment_of

# The building classes cycled over orders (o_orderkey % 12).
CLASS_CYCLE = list(SEGMENT_MAP.keys()) + ["21 OFFICE BUILDINGS"]
# Coordinate rule -> lat 40.5..41.0, lon -74.2..-73.7.
LAT0, LON0, COORD_MOD, COORD_DIV = 40.5, -74.2, 5001, 10000
CUST_LAT_MUL, CUST_LON_MUL = 7919, 6007
SUPP_LAT_MUL, SUPP_LON_MUL = 3001, 4001
# Usage roles by user_id % 3 and daily limits.
ROLE_CYCLE = ["user", "paid", "admin"]
QUOTA_LIMITS = {"user": 10, "paid": 200, "admin": None}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _coord(key, mul: int, base: float):
    return F.lit(base) + (key * F.lit(mul) % F.lit(COORD_MOD)).cast("double") / F.lit(float(COORD_DIV))


def _coord_sql(key: str, mul: int, base: float) -> str:
    return f"({base} + CAST(({key} * {mul}) % {COORD_MOD} AS DOUBLE) / {COORD_DIV}.0)"


def _class_case_sql(expr: str) -> str:
    arms = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CLASS_CYCLE))
    return f"(CASE {expr} {arms} END)"


def _segment_case_sql(expr: str) -> str:
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SEGMENT_MAP.items())
    return f"COALESCE((CASE {expr} {arms} END), 'global')"


# ---------------------------------------------------------------- parcels
def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parcel dimension (one row per parcel = customer) with coordinates."""
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    k = F.col("c_custkey")
    return (
        c.join(n, c.c_nationkey == n.n_nationkey, "inner")
        .select(
            k.alias("bbl"),
            (F.col("n_regionkey") + 1).alias("borough"),
            F.col("n_name").alias("neighborhood"),
            _coord(k, CUST_LAT_MUL, LAT0).alias("latitude"),
            _coord(k, CUST_LON_MUL, LON0).alias("longitude"),
            (k % 40 + 1).cast("double").alias("numfloors"),
            (F.col("c_acctbal") + 1000.0).alias("lotarea"),
            ((k % 97) * 25).cast("double").alias("bldgarea"),
            (k % 12).cast("double").alias("unitsres"),
            ((k % 50) + 10).cast("double").alias("bldgfront"),
            ((k % 70) + 20).cast("double").alias("bldgdepth"),
        )
    )


PARCELS_SQL = f"""parcels AS (
  SELECT c_custkey AS bbl, n_regionkey + 1 AS borough, n_name AS neighborhood,
         {_coord_sql('c_custkey', CUST_LAT_MUL, LAT0)} AS latitude,
         {_coord_sql('c_custkey', CUST_LON_MUL, LON0)} AS longitude,
         CAST(c_custkey % 40 + 1 AS DOUBLE) AS numfloors,
         c_acctbal + 1000.0 AS lotarea,
         CAST((c_custkey % 97) * 25 AS DOUBLE) AS bldgarea,
         CAST(c_custkey % 12 AS DOUBLE) AS unitsres,
         CAST(c_custkey % 50 + 10 AS DOUBLE) AS bldgfront,
         CAST(c_custkey % 70 + 20 AS DOUBLE) AS bldgdepth
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


# ---------------------------------------------------------------- spine
def spine(spark: SparkSession, sf_dir: str, with_geo: bool = False) -> DataFrame:
    """Sale-event spine: one row per order (sale), keyed by parcel = customer.

    Not unique on (bbl, as_of_date): a customer can order twice a day.
    """
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    cls = F.element_at(F.array(*[F.lit(x) for x in CLASS_CYCLE]), (F.col("o_orderkey") % len(CLASS_CYCLE) + 1).cast("int"))
    ok, ck = F.col("o_orderkey"), F.col("o_custkey")
    df = (
        o.join(c, o.o_custkey == c.c_custkey, "inner")
        .join(n, F.col("c_nationkey") == F.col("n_nationkey"), "inner")
        .select(
            ok.alias("sale_id"),
            ck.alias("bbl"),
            F.to_date("o_orderdate").alias("sale_date"),
            F.date_sub(F.to_date("o_orderdate"), 1).alias("as_of_date"),
            (F.col("n_regionkey") + 1).alias("borough"),
            F.col("n_name").alias("neighborhood"),
            cls.alias("building_class"),
            F.col("o_totalprice").alias("sales_price"),
            ((ok * 37 + ck) % 3000 + 60).cast("double").alias("gross_sqft"),
            ((ok * 11) % 5000 + 500).cast("double").alias("land_sqft"),
            (ok % 7).cast("double").alias("total_units"),
            (ok % 5).cast("double").alias("residential_units"),
            (ck % 130 + 1890).cast("double").alias("year_built"),
            F.col("o_orderstatus").alias("status"),
        )
        .withColumn("segment", segment_of("building_class"))
    )
    if with_geo:
        df = df.withColumn("latitude", _coord(F.col("bbl"), CUST_LAT_MUL, LAT0)).withColumn(
            "longitude", _coord(F.col("bbl"), CUST_LON_MUL, LON0)
        )
    return df


SPINE_SQL = f"""spine AS (
  SELECT o_orderkey AS sale_id, o_custkey AS bbl,
         CAST(o_orderdate AS DATE) AS sale_date,
         CAST(o_orderdate AS DATE) - 1 AS as_of_date,
         n_regionkey + 1 AS borough, n_name AS neighborhood,
         {_class_case_sql('o_orderkey % ' + str(len(CLASS_CYCLE)))} AS building_class,
         o_totalprice AS sales_price,
         CAST((o_orderkey * 37 + o_custkey) % 3000 + 60 AS DOUBLE) AS gross_sqft,
         CAST((o_orderkey * 11) % 5000 + 500 AS DOUBLE) AS land_sqft,
         CAST(o_orderkey % 7 AS DOUBLE) AS total_units,
         CAST(o_orderkey % 5 AS DOUBLE) AS residential_units,
         CAST(o_custkey % 130 + 1890 AS DOUBLE) AS year_built,
         o_orderstatus AS status,
         {_segment_case_sql(_class_case_sql('o_orderkey % ' + str(len(CLASS_CYCLE))))} AS segment,
         {_coord_sql('o_custkey', CUST_LAT_MUL, LAT0)} AS latitude,
         {_coord_sql('o_custkey', CUST_LON_MUL, LON0)} AS longitude
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


# ---------------------------------------------------------------- deeds / mortgages
def documents(spark: SparkSession, sf_dir: str, status: str) -> DataFrame:
    """Recorded documents: orders of one status; strictly-before lookups use doc_date."""
    o = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == status)
    return o.select(
        F.col("o_orderkey").alias("document_id"),
        F.col("o_custkey").alias("bbl"),
        F.col("o_orderdate").alias("document_date"),
        F.col("o_totalprice").alias("document_amt"),
        F.concat(F.lit("BUYER "), (F.col("o_orderkey") % 50).cast("string")).alias("buyer_name"),
        F.concat(F.lit("SELLER "), (F.col("o_orderkey") % 37).cast("string")).alias("seller_name"),
    )


def documents_sql(name: str, status: str) -> str:
    return f"""{name} AS (
  SELECT o_orderkey AS document_id, o_custkey AS bbl, o_orderdate AS document_date,
         o_totalprice AS document_amt,
         'BUYER ' || CAST(o_orderkey % 50 AS VARCHAR) AS buyer_name,
         'SELLER ' || CAST(o_orderkey % 37 AS VARCHAR) AS seller_name
  FROM orders WHERE o_orderstatus = '{status}')"""


# ---------------------------------------------------------------- tax rolls
def tax_rolls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly versions per parcel: unique on (bbl, year)."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_custkey").alias("bbl"), F.year("o_orderdate").alias("year")).agg(
        F.lit("FINAL").alias("period"),
        F.bround(F.sum(F.col("o_totalprice").cast("decimal(18,2)")), 0).cast("bigint").alias("curacttot"),
        F.bround(F.max("o_totalprice"), 0).cast("bigint").alias("curmkttot"),
        F.count(F.lit(1)).alias("units"),
    )


TAX_ROLLS_SQL = """tax_rolls AS (
  SELECT o_custkey AS bbl, CAST(year(o_orderdate) AS INTEGER) AS year, 'FINAL' AS period,
         CAST(round_even(sum(CAST(o_totalprice AS DECIMAL(18,2))), 0) AS BIGINT) AS curacttot,
         CAST(round_even(max(o_totalprice), 0) AS BIGINT) AS curmkttot,
         count(*) AS units
  FROM orders GROUP BY o_custkey, year(o_orderdate))"""


# ---------------------------------------------------------------- abatements
def abatements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abatement rows: orders with status P; several rows per (bbl, tax_year) possible."""
    o = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "P")
    ok = F.col("o_orderkey")
    return o.select(
        ok.alias("row_id"),
        F.col("o_custkey").alias("bbl"),
        F.year("o_orderdate").cast("bigint").alias("tax_year"),
        (F.year("o_orderdate") - ok % 5).cast("bigint").alias("init_year"),
        (ok % 15 + 10).alias("exempt_years"),
        (F.col("o_totalprice") / 100.0).alias("abatement"),
        (F.year("o_orderdate") - ok % 5 + ok % 15 + 10).cast("bigint").alias("expiry_year"),
    )


ABATEMENTS_SQL = """abatements AS (
  SELECT o_orderkey AS row_id, o_custkey AS bbl, CAST(year(o_orderdate) AS BIGINT) AS tax_year,
         CAST(year(o_orderdate) - o_orderkey % 5 AS BIGINT) AS init_year,
         o_orderkey % 15 + 10 AS exempt_years, o_totalprice / 100.0 AS abatement,
         CAST(year(o_orderdate) - o_orderkey % 5 + o_orderkey % 15 + 10 AS BIGINT) AS expiry_year
  FROM orders WHERE o_orderstatus = 'P')"""


# ---------------------------------------------------------------- stations
def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transit points: suppliers with coordinates, route list and CBD text."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return s.select(
        k.alias("station_id"),
        _coord(k, SUPP_LAT_MUL, LAT0).alias("lat"),
        _coord(k, SUPP_LON_MUL, LON0).alias("lon"),
        F.when(F.col("s_nationkey") % 2 == 1, F.lit(" A  C ")).otherwise(F.lit("A")).alias("routes"),
        F.when(F.col("s_nationkey") < 5, F.lit("TRUE")).otherwise(F.lit("FALSE")).alias("cbd"),
    )


STATIONS_SQL = f"""stations AS (
  SELECT s_suppkey AS station_id,
         {_coord_sql('s_suppkey', SUPP_LAT_MUL, LAT0)} AS lat,
         {_coord_sql('s_suppkey', SUPP_LON_MUL, LON0)} AS lon,
         CASE WHEN s_nationkey % 2 = 1 THEN ' A  C ' ELSE 'A' END AS routes,
         CASE WHEN s_nationkey < 5 THEN 'TRUE' ELSE 'FALSE' END AS cbd
  FROM supplier)"""


# ---------------------------------------------------------------- usage
def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    role = F.element_at(F.array(*[F.lit(r) for r in ROLE_CYCLE]), (F.col("user_id") % 3 + 1).cast("int"))
    return e.select("event_id", "ts", "user_id", "event_type", "value", role.alias("role"))


USAGE_SQL = """usage AS (
  SELECT event_id, ts, user_id, event_type, value,
         CASE user_id % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'paid' ELSE 'admin' END AS role
  FROM events)"""


# ---------------------------------------------------------------- predictions
def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted vs market price: line unit price vs the part's retail price."""
    li = table(spark, sf_dir, "lineitem")
    p = table(spark, sf_dir, "part")
    return li.join(p, li.l_partkey == p.p_partkey, "inner").select(
        F.col("l_orderkey").alias("request_id"),
        F.col("l_linenumber").alias("line"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("predicted_price"),
        F.col("p_retailprice").alias("market_price"),
        F.col("l_quantity").alias("units"),
    )


PREDICTIONS_SQL = """predictions AS (
  SELECT l_orderkey AS request_id, l_linenumber AS line,
         l_extendedprice / l_quantity AS predicted_price,
         p_retailprice AS market_price, l_quantity AS units
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# ---------------------------------------------------------------- saved properties
def properties_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved properties (one per order) with a model estimate to analyse."""
    o = table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(
        k.alias("id"),
        F.concat(F.lit("No "), k.cast("string"), F.lit(', Main St "Unit"')).alias("address"),
        (F.lit(10000) + c % 300).cast("string").alias("zipcode"),
        (k % 5 + 1).cast("int").alias("bedrooms"),
        (k % 3 + 1).cast("int").alias("bathrooms"),
        ((k * 37 + c) % 3000 + 300).cast("int").alias("sqft"),
        F.col("o_totalprice").alias("listing_price"),
        F.col("o_orderdate").alias("created_at"),
        (c % 50).alias("user_id"),
        (F.col("o_totalprice") * (F.lit(0.8) + (k % 41).cast("double") / F.lit(100.0))).alias("predicted_price"),
        F.col("o_totalprice").alias("market_price"),
    )


PROPERTIES_SQL = """props AS (
  SELECT o_orderkey AS id, 'No ' || CAST(o_orderkey AS VARCHAR) || ', Main St "Unit"' AS address,
         CAST(10000 + o_custkey % 300 AS VARCHAR) AS zipcode, CAST(o_orderkey % 5 + 1 AS INTEGER) AS bedrooms,
         CAST(o_orderkey % 3 + 1 AS INTEGER) AS bathrooms, CAST((o_orderkey * 37 + o_custkey) % 3000 + 300 AS INTEGER) AS sqft,
         o_totalprice AS listing_price, o_orderdate AS created_at, o_custkey % 50 AS user_id,
         o_totalprice * (0.8 + CAST(o_orderkey % 41 AS DOUBLE) / 100.0) AS predicted_price, o_totalprice AS market_price
  FROM orders)"""


def score_sql(p: str = "predicted_price", m: str = "market_price") -> str:
    """SQL twin of the investment score (same operation order as the Spark expression)."""
    roi = f"(CASE WHEN {m} > 0 THEN ({p} - {m}) / {m} * 100.0 ELSE 0.0 END)"
    gap = f"(CASE WHEN {m} > 0 THEN ({p} - {m}) / {m} ELSE 0.0 END)"
    roi_s = f"((greatest(-20.0, least({roi}, 20.0)) + 20.0) / 40.0 * 100.0)"
    val_s = f"((greatest(-0.3, least({gap}, 0.3)) + 0.3) / 0.6 * 100.0)"
    pen = f"least(abs({gap}) * 100.0, 30.0)"
    raw = f"({roi_s} * 0.6 + {val_s} * 0.3 - {pen} * 0.1)"
    return f"CAST(greatest(0.0, least(round_even({raw}, 0), 100.0)) AS INTEGER)"


def sale_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(bbl, as_of_date) of every sale, from orders alone: as-of lookups need
    no location columns, so the spine's dimension joins are not paid for
    (orders reference existing customers, so the key set is the spine's)."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("bbl"), F.date_sub(F.to_date("o_orderdate"), 1).alias("as_of_date"))
