"""Registered spatial queries (survey 2.4): station features, nearest
building within 150 m, nearest with preference, comparable sales."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotline.functions import features as FT
from lotline.operators import spatial
from lotline.plans import bindings as B
from lotline.plans.registry import register


def hav_sql(a_lat: str, a_lon: str, b_lat: str, b_lon: str) -> str:
    return (
        f"(12742.0 * asin(sqrt(pow(sin((radians({b_lat}) - radians({a_lat})) / 2), 2) + "
        f"cos(radians({a_lat})) * cos(radians({b_lat})) * pow(sin((radians({b_lon}) - radians({a_lon})) / 2), 2))))"
    )


def _stations(spark, sf):
    s = B.stations(spark, sf)
    return s.withColumn("route_count", FT.route_count("routes")).withColumn("is_cbd", FT.cbd_flag("cbd"))


_ST_SQL = B.STATIONS_SQL.replace(
    "FROM supplier)",
    "FROM supplier), st AS (SELECT *, CAST(len(list_filter(string_split_regex(trim(COALESCE(routes, '')), '\\s+'), lambda x: x <> '')) AS INTEGER) AS route_count, "
    "lower(trim(cbd)) IN ('true', '1', 'yes') AS is_cbd FROM stations)",
)
_PAIRS = B.with_ctes(B.PARCELS_SQL, _ST_SQL) + f""", pairs AS (
  SELECT p.bbl, s.station_id, s.route_count, s.is_cbd, {hav_sql('p.latitude', 'p.longitude', 's.lat', 's.lon')} AS d
  FROM parcels p CROSS JOIN st s),
ranked AS (SELECT *, row_number() OVER (PARTITION BY bbl ORDER BY d, station_id) AS rn FROM pairs)
"""


@register(
    "nearest_point",
    _PAIRS + """SELECT bbl, round(d, 6) AS subway_dist_km, station_id AS nearest_station_id,
  CAST(route_count >= 2 AS INTEGER) AS subway_hub_flag FROM ranked WHERE rn = 1""",
)
def q_nearest_point(spark, sf):
    nn = spatial.knn_search(B.parcels(spark, sf), _stations(spark, sf), ["bbl"], "latitude", "longitude",
                            "lat", "lon", ["station_id"], ["route_count"], k=1,
                            unique_targets=True)
    first = F.col("nn")[0]
    return nn.select("bbl", F.round(first["d"], 6).alias("subway_dist_km"), first["station_id"].alias("nearest_station_id"),
                     (first["route_count"] >= 2).cast("int").alias("subway_hub_flag"))


@register(
    "count_within_radius",
    _PAIRS + """SELECT bbl, CAST(count_if(d <= 0.5) AS BIGINT) AS subway_n_500m, CAST(count_if(d <= 1.0) AS BIGINT) AS subway_n_1km FROM pairs GROUP BY bbl""",
)
def q_count_within_radius(spark, sf):
    return spatial.count_within_radius(B.parcels(spark, sf), _stations(spark, sf), ["bbl"], "latitude", "longitude",
                                       "lat", "lon", [0.5, 1.0], names=["subway_n_500m", "subway_n_1km"],
                                       unique_targets=True)


@register(
    "knn_mean_distance",
    _PAIRS + "SELECT bbl, round(avg(d), 6) AS subway_k3_mean_dist_km FROM ranked WHERE rn <= 3 GROUP BY bbl",
)
def q_knn_mean_distance(spark, sf):
    nn = spatial.knn_search(B.parcels(spark, sf), _stations(spark, sf), ["bbl"], "latitude", "longitude",
                            "lat", "lon", ["station_id"], k=3, unique_targets=True)
    mean = F.aggregate("nn", F.lit(0.0), lambda acc, x: acc + x["d"]) / F.size("nn")
    return nn.select("bbl", F.round(mean, 6).alias("subway_k3_mean_dist_km"))


@register(
    "nearest_of_subset",
    _PAIRS + "SELECT p.bbl, round(min(d) FILTER (WHERE is_cbd), 6) AS subway_cbd_dist_km FROM pairs p GROUP BY p.bbl",
)
def q_nearest_of_subset(spark, sf):
    st = _stations(spark, sf)
    nn = spatial.knn_search(B.parcels(spark, sf), st.where(F.col("is_cbd")), ["bbl"], "latitude", "longitude",
                            "lat", "lon", ["station_id"], k=1, unique_targets=True)
    return nn.select("bbl", F.round(F.col("nn")[0]["d"], 6).alias("subway_cbd_dist_km"))


@register(
    "transit_features",
    _PAIRS + """, k3 AS (SELECT bbl, avg(d) AS m FROM ranked WHERE rn <= 3 GROUP BY bbl)
SELECT r.bbl, round(r.d, 6) AS subway_dist_km, CAST(r.route_count >= 2 AS INTEGER) AS subway_hub_flag,
  round(k3.m, 6) AS subway_k3_mean_dist_km, c.subway_n_500m, c.subway_n_1km, round(c.cbd, 6) AS subway_cbd_dist_km
FROM ranked r JOIN k3 ON k3.bbl = r.bbl
JOIN (SELECT bbl, CAST(count_if(d <= 0.5) AS BIGINT) AS subway_n_500m, CAST(count_if(d <= 1.0) AS BIGINT) AS subway_n_1km,
             min(d) FILTER (WHERE is_cbd) AS cbd FROM pairs GROUP BY bbl) c ON c.bbl = r.bbl
WHERE r.rn = 1""",
)
def q_transit_features(spark, sf):
    f = spatial.transit_features(B.parcels(spark, sf), _stations(spark, sf))
    return f.select("bbl", F.round("subway_dist_km", 6).alias("subway_dist_km"), "subway_hub_flag",
                    F.round("subway_k3_mean_dist_km", 6).alias("subway_k3_mean_dist_km"), "subway_n_500m",
                    "subway_n_1km", F.round("subway_cbd_dist_km", 6).alias("subway_cbd_dist_km"))


@register(
    "nearest_within",
    B.with_ctes(B.PARCELS_SQL)
    + f""", t AS (SELECT bbl, latitude + 0.0009 AS tlat, longitude - 0.0011 AS tlon FROM parcels),
pr AS (SELECT t.bbl, c.bbl AS cbbl, c.numfloors, c.bldgarea, c.lotarea, c.unitsres,
              {hav_sql('t.tlat', 't.tlon', 'c.latitude', 'c.longitude')} AS d
       FROM t CROSS JOIN parcels c),
r AS (SELECT *, row_number() OVER (PARTITION BY bbl ORDER BY d, cbbl) AS rn FROM pr WHERE d <= 0.15)
SELECT t.bbl, round(r.d, 6) AS match_dist_km, r.numfloors, r.bldgarea, r.lotarea, r.unitsres
FROM t LEFT JOIN r ON r.bbl = t.bbl AND r.rn = 1""",
)
def q_nearest_within(spark, sf):
    p = B.parcels(spark, sf)
    t = p.select("bbl", (F.col("latitude") + 0.0009).alias("tlat"), (F.col("longitude") - 0.0011).alias("tlon"))
    c = p.select(F.col("bbl").alias("cbbl"), "latitude", "longitude", "numfloors", "bldgarea", "lotarea", "unitsres")
    out = spatial.nearest_within(t, c, ["bbl"], "tlat", "tlon", "latitude", "longitude", ["cbbl"],
                                 ["numfloors", "bldgarea", "lotarea", "unitsres"], max_km=0.15)
    return out.withColumn("match_dist_km", F.round("match_dist_km", 6))


_REQ_PREF_SQL = f"""req AS (
  SELECT s_suppkey AS request_id, {B._coord_sql('s_suppkey', B.SUPP_LAT_MUL, B.LAT0)} AS rlat,
         {B._coord_sql('s_suppkey', B.SUPP_LON_MUL, B.LON0)} AS rlon,
         CASE WHEN s_suppkey % 10 = 0 THEN 'Borough 9' ELSE 'Borough ' || CAST(n_regionkey + 1 AS VARCHAR) END AS rborough
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


@register(
    "nearest_with_preference",
    B.with_ctes(B.PARCELS_SQL, _REQ_PREF_SQL)
    + """, cand AS (SELECT bbl, latitude, longitude, neighborhood, 'BOROUGH ' || CAST(borough AS VARCHAR) AS cborough FROM parcels),
pr AS (SELECT r.request_id, lower(r.rborough) = lower(c.cborough) AS same_partition, c.bbl, c.neighborhood,
              sqrt(pow(c.latitude - r.rlat, 2) + pow(c.longitude - r.rlon, 2)) AS d
       FROM req r CROSS JOIN cand c),
has AS (SELECT request_id, bool_or(same_partition) AS any_same FROM pr GROUP BY request_id),
rk AS (SELECT pr.*, row_number() OVER (PARTITION BY pr.request_id ORDER BY d, bbl) AS rn
       FROM pr JOIN has USING (request_id) WHERE pr.same_partition OR NOT has.any_same)
SELECT request_id, same_partition, round(d, 9) AS match_dist, bbl, neighborhood FROM rk WHERE rn = 1""",
)
def q_nearest_with_preference(spark, sf):
    s = B.table(spark, sf, "supplier")
    n = B.table(spark, sf, "nation")
    k = F.col("s_suppkey")
    req = s.join(n, s.s_nationkey == n.n_nationkey).select(
        k.alias("request_id"),
        B._coord(k, B.SUPP_LAT_MUL, B.LAT0).alias("rlat"),
        B._coord(k, B.SUPP_LON_MUL, B.LON0).alias("rlon"),
        F.when(k % 10 == 0, F.lit("Borough 9")).otherwise(
            F.concat(F.lit("Borough "), (F.col("n_regionkey") + 1).cast("string"))).alias("rborough"),
    )
    cand = B.parcels(spark, sf).select("bbl", "latitude", "longitude", "neighborhood",
                                       F.concat(F.lit("BOROUGH "), F.col("borough").cast("string")).alias("cborough"))
    out = spatial.nearest_with_preference(req, cand, ["request_id"], "rlat", "rlon", "rborough",
                                          "latitude", "longitude", "cborough", ["bbl"], ["neighborhood"])
    return out.select("request_id", "same_partition", F.round("match_dist", 9).alias("match_dist"), "bbl", "neighborhood")


def comp_sales(spark, sf):
    sp = B.spine(spark, sf, with_geo=True)
    return sp.withColumn("comp_segment", FT.comp_segment("segment", "building_class"))


_CS_SQL = """cs AS (
  SELECT *, CASE WHEN segment = 'one_family' THEN 'one_family' WHEN segment = 'condo_coop' THEN 'condo_coop'
    WHEN segment = 'multi_family' AND starts_with(trim(COALESCE(building_class, '')), '02') THEN 'two_family'
    WHEN segment = 'multi_family' AND starts_with(trim(COALESCE(building_class, '')), '03') THEN 'three_family' END AS comp_segment
  FROM spine)"""

COMPS_SQL = B.with_ctes(B.SPINE_SQL, _CS_SQL) + f""",
t AS (SELECT DISTINCT bbl, as_of_date, comp_segment, latitude, longitude FROM cs WHERE comp_segment IS NOT NULL),
c AS (SELECT sale_id, sale_date, sales_price, gross_sqft, latitude, longitude, comp_segment FROM cs
      WHERE sales_price >= 100000 AND comp_segment IS NOT NULL),
pairs AS (
  SELECT t.bbl, t.as_of_date, t.comp_segment, c.sale_id, c.sale_date, c.sales_price, c.gross_sqft,
         {hav_sql('t.latitude', 't.longitude', 'c.latitude', 'c.longitude')} AS d
  FROM t JOIN c ON c.comp_segment = t.comp_segment AND c.sale_date < t.as_of_date AND c.sale_date >= t.as_of_date - 365),
r AS (SELECT *, row_number() OVER (PARTITION BY bbl, as_of_date, comp_segment ORDER BY d, sale_id) AS rn
      FROM pairs WHERE d <= 5.0)
SELECT bbl, as_of_date, comp_segment, CAST(count(*) AS INTEGER) AS comp_count,
  round(quantile_cont(sales_price, 0.5), 6) AS comp_median_price,
  round(quantile_cont(CASE WHEN gross_sqft > 100 THEN sales_price / gross_sqft END, 0.5), 6) AS comp_median_ppsqft,
  round(max(d), 6) AS comp_search_dist_km,
  CAST(date_diff('day', max(sale_date), as_of_date) AS INTEGER) AS comp_recency_days,
  round(quantile_cont(sales_price, 0.25), 6) AS comp_p25_price,
  round(quantile_cont(sales_price, 0.75), 6) AS comp_p75_price
FROM r WHERE rn <= 5 GROUP BY bbl, as_of_date, comp_segment"""


@register("knn_temporal_comps", COMPS_SQL)
def q_knn_temporal_comps(spark, sf):
    out = spatial.knn_temporal_comps(comp_sales(spark, sf))
    for c in ("comp_median_price", "comp_median_ppsqft", "comp_search_dist_km", "comp_p25_price", "comp_p75_price"):
        out = out.withColumn(c, F.round(c, 6))
    return out


@register(
    "coverage_by_group",
    "WITH cmp AS (" + COMPS_SQL + """)
SELECT comp_segment, count(*) AS n_targets, round(avg(comp_median_price), 4) AS mean_comp_median_price,
  min(comp_count) AS min_comp_count, max(comp_search_dist_km) AS max_search_dist_km FROM cmp GROUP BY comp_segment""",
)
def q_coverage_by_group(spark, sf):
    c = q_knn_temporal_comps(spark, sf)
    return c.groupBy("comp_segment").agg(
        F.count(F.lit(1)).alias("n_targets"), F.round(F.avg("comp_median_price"), 4).alias("mean_comp_median_price"),
        F.min("comp_count").alias("min_comp_count"), F.max("comp_search_dist_km").alias("max_search_dist_km"))
