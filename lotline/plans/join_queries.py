"""Registered join queries (survey 2.4): inner / keep-matched / dimension /
semi / anti / full outer joins, map-with-fallback, spine enrichment and the
parcel feature bundle."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotline.operators import asof, joins
from lotline.plans import asof_queries as AQ
from lotline.plans import bindings as B
from lotline.plans.registry import ORACLE_SQL, register
from lotline.plans.spatial_queries import _CS_SQL, COMPS_SQL, comp_sales, q_knn_temporal_comps, q_transit_features
from lotline.plans.trend_queries import q_trend_grid

TREND_SQL, TRANSIT_SQL = ORACLE_SQL["trend_grid"], ORACLE_SQL["transit_features"]


@register(
    "join_inner",
    """SELECT o_orderkey, l_linenumber, l_partkey, o_custkey, l_extendedprice
FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'""",
)
def q_join_inner(spark, sf):
    o = B.table(spark, sf, "orders").where(F.col("o_orderstatus") == "F").select("o_orderkey", "o_custkey")
    li = B.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_extendedprice")
    return joins.join_inner(o, li, ["o_orderkey"]).select("o_orderkey", "l_linenumber", "l_partkey", "o_custkey", "l_extendedprice")


_MATCH_SQL = B.with_ctes(B.SPINE_SQL, B.PARCELS_SQL)


@register(
    "join_inner_keep_matched",
    _MATCH_SQL + """SELECT s.sale_id, p.latitude, p.longitude FROM spine s
JOIN (SELECT * FROM parcels WHERE lotarea > 1000) p ON s.bbl = p.bbl""",
)
def q_join_inner_keep_matched(spark, sf):
    sp = B.spine(spark, sf).select("sale_id", "bbl")
    p = B.parcels(spark, sf).where(F.col("lotarea") > 1000).select("bbl", "latitude", "longitude")
    matched, _ = joins.join_keep_matched(sp, p, ["bbl"])
    return matched.select("sale_id", "latitude", "longitude")


@register(
    "match_rate",
    _MATCH_SQL + """SELECT count(*) AS rows_in, count(p.bbl) AS rows_matched, avg(CASE WHEN p.bbl IS NOT NULL THEN 1.0 ELSE 0.0 END) AS match_rate
FROM spine s LEFT JOIN (SELECT DISTINCT bbl FROM parcels WHERE lotarea > 1000) p ON s.bbl = p.bbl""",
)
def q_match_rate(spark, sf):
    sp = B.spine(spark, sf).select("sale_id", "bbl")
    p = B.parcels(spark, sf).where(F.col("lotarea") > 1000).select("bbl")
    _, report = joins.join_keep_matched(sp, p, ["bbl"])
    return report


@register(
    "join_left_dim",
    B.with_ctes(B.SPINE_SQL, B.TAX_ROLLS_SQL)
    + """, dim AS (SELECT bbl, year, curacttot FROM (
   SELECT *, row_number() OVER (PARTITION BY bbl ORDER BY year DESC) AS rn FROM tax_rolls) WHERE rn = 1)
SELECT s.sale_id, d.year AS dim_year, d.curacttot FROM spine s LEFT JOIN dim d ON s.bbl = d.bbl""",
)
def q_join_left_dim(spark, sf):
    sp = B.spine(spark, sf).select("sale_id", "bbl")
    dim = B.tax_rolls(spark, sf).select("bbl", F.col("year").alias("dim_year"), "curacttot")
    # newest version first: min_by over the negated year
    return joins.join_left_dim(sp, dim, ["bbl"], [-F.col("dim_year")]).select(
        "sale_id", "dim_year", "curacttot"
    )


@register(
    "join_semi",
    B.with_ctes(B.SPINE_SQL, B.documents_sql("deeds", "F"))
    + "SELECT document_id FROM deeds WHERE bbl IN (SELECT bbl FROM spine WHERE segment = 'one_family')",
)
def q_join_semi(spark, sf):
    keys = B.spine(spark, sf).where(F.col("segment") == "one_family").select("bbl")
    return joins.join_semi(B.documents(spark, sf, "F"), keys, ["bbl"]).select("document_id")


_ANTI_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag"]


@register(
    "join_anti",
    """WITH base AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
                        CASE WHEN l_linenumber = 1 THEN NULL ELSE l_returnflag END AS l_returnflag
                 FROM lineitem WHERE year(l_shipdate) < 1998),
aug AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
               CASE WHEN l_linenumber = 1 THEN NULL ELSE l_returnflag END AS l_returnflag, l_quantity FROM lineitem)
SELECT * FROM aug a WHERE NOT EXISTS (
  SELECT 1 FROM base b WHERE a.l_orderkey IS NOT DISTINCT FROM b.l_orderkey AND a.l_partkey IS NOT DISTINCT FROM b.l_partkey
   AND a.l_suppkey IS NOT DISTINCT FROM b.l_suppkey AND a.l_linenumber IS NOT DISTINCT FROM b.l_linenumber
   AND a.l_returnflag IS NOT DISTINCT FROM b.l_returnflag)""",
)
def q_join_anti(spark, sf):
    li = B.table(spark, sf, "lineitem")
    rf = F.when(F.col("l_linenumber") == 1, F.lit(None)).otherwise(F.col("l_returnflag")).alias("l_returnflag")
    aug = li.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", rf, "l_quantity")
    base = li.where(F.year("l_shipdate") < 1998).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", rf)
    return joins.join_anti_null_safe(aug, base, _ANTI_KEY)


@register(
    "join_full_outer",
    """WITH d AS (SELECT o_custkey AS bbl, count(*) AS deed_cnt FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey),
m AS (SELECT o_custkey AS bbl, max(o_totalprice) AS last_mtge_amt FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey)
SELECT COALESCE(d.bbl, m.bbl) AS bbl, d.deed_cnt, m.last_mtge_amt FROM d FULL OUTER JOIN m ON d.bbl = m.bbl""",
)
def q_join_full_outer(spark, sf):
    o = B.table(spark, sf, "orders")
    d = (o.where(F.col("o_orderstatus") == "F")
         .groupBy(F.col("o_custkey").alias("bbl")).agg(F.count(F.lit(1)).alias("deed_cnt")))
    m = (o.where(F.col("o_orderstatus") == "O")
         .groupBy(F.col("o_custkey").alias("bbl")).agg(F.max("o_totalprice").alias("last_mtge_amt")))
    return joins.join_full_outer(d, m, ["bbl"])


def _body(sql: str) -> str:
    return "(" + sql + ")"


MORTGAGE_SQL = AQ.ASOF_EVENT_HISTORY_SQL.replace("deeds AS", "mtges AS").replace("JOIN deeds d", "JOIN mtges d").replace("o_orderstatus = 'F'", "o_orderstatus = 'O'").replace("deed_", "mtge_")
_J51_SQL = AQ.ASOF_CUMULATIVE_SQL
ENRICH_SQL = (
    B.with_ctes(B.SPINE_SQL, B.PARCELS_SQL, _CS_SQL)
    + f""", deedh AS {_body(AQ.ASOF_EVENT_HISTORY_SQL)},
mtgeh AS {_body(MORTGAGE_SQL)},
rollv AS {_body(AQ.ASOF_LATEST_VERSION_SQL)},
j51 AS {_body(_J51_SQL)},
comps AS {_body(COMPS_SQL)},
trends AS {_body(TREND_SQL)},
transit AS {_body(TRANSIT_SQL)}
SELECT s.sale_id, s.bbl, s.as_of_date, s.comp_segment, d.deed_cnt, d.deed_last_document_amt, d.deed_days_since_last,
       m.mtge_cnt, m.mtge_last_document_amt, r.roll_year, r.roll_curacttot, r.roll_curmkttot, r.roll_units,
       j.j51_last_abatement, j.j51_total_abatement, j.j51_active_flag, p.latitude, p.longitude, p.numfloors, p.lotarea, p.bldgarea,
       t.subway_dist_km, t.subway_hub_flag, t.subway_k3_mean_dist_km, t.subway_n_500m, t.subway_n_1km, t.subway_cbd_dist_km,
       c.comp_count, c.comp_median_price, c.comp_median_ppsqft, c.comp_search_dist_km, c.comp_recency_days,
       g.nbhd_median_l365, g.nbhd_yoy_growth, g.borough_yoy_growth
FROM cs s
LEFT JOIN deedh d ON d.bbl = s.bbl AND d.as_of_date = s.as_of_date
LEFT JOIN mtgeh m ON m.bbl = s.bbl AND m.as_of_date = s.as_of_date
LEFT JOIN rollv r ON r.bbl = s.bbl AND r.as_of_date = s.as_of_date
LEFT JOIN j51 j ON j.bbl = s.bbl AND j.as_of_date = s.as_of_date
LEFT JOIN parcels p ON p.bbl = s.bbl
LEFT JOIN transit t ON t.bbl = s.bbl
LEFT JOIN comps c ON c.bbl = s.bbl AND c.as_of_date = s.as_of_date AND c.comp_segment = s.comp_segment
LEFT JOIN trends g ON g.as_of_date = s.as_of_date AND g.borough = s.borough AND g.neighborhood = s.neighborhood AND g.comp_segment = s.comp_segment"""
)


def gold_sides(spark, sf):
    """Deeds, mortgages, tax rolls and abatements as typed facts with the day
    from which each is known: documents from the day after, a roll from the
    first of its year, an abatement from the first of the year after."""
    roll = B.tax_rolls(spark, sf)
    year = lambda c: F.make_date(c.cast("int"), F.lit(1), F.lit(1))
    day_after = F.date_add(F.to_date("document_date"), 1)
    document = {"ts": F.col("document_date"), "tb": F.col("document_id"), "amt": F.col("document_amt")}
    return [
        asof.Side("deed", B.documents(spark, sf, "F"), day_after, document),
        asof.Side("mtge", B.documents(spark, sf, "O"), day_after, document),
        asof.Side("roll", roll, year(F.col("year")), {"year": F.col("year"), "rank": AQ.period_rank("period"), "curacttot": F.col("curacttot"),
                                                      "curmkttot": F.col("curmkttot"), "units": F.col("units")}),
        asof.Side("j51", B.abatements(spark, sf), year(F.col("tax_year") + 1),
                  {"year": F.col("tax_year"), "tb": F.col("row_id"), "abatement": F.col("abatement"), "expiry": F.col("expiry_year")}, sums=("abatement",)),
    ]


def known(spine, sides):
    """(bbl, as_of_date) with the features of all sides, by one as-of merge."""
    m = asof.asof_many(spine, sides)
    expiry = F.col("j51.expiry")
    return m.select(
        "bbl", "as_of_date", "deed_cnt", F.col("deed.amt").alias("deed_last_document_amt"),
        F.timestamp_diff("DAY", F.col("deed.ts"), F.col("as_of_date").cast("timestamp_ntz")).alias("deed_days_since_last"),
        "mtge_cnt", F.col("mtge.amt").alias("mtge_last_document_amt"),
        F.col("roll.year").alias("roll_year"), F.col("roll.curacttot").alias("roll_curacttot"), F.col("roll.curmkttot").alias("roll_curmkttot"),
        F.col("roll.units").alias("roll_units"),
        F.col("j51.abatement").alias("j51_last_abatement"), F.round("j51_sum_abatement", 4).alias("j51_total_abatement"), expiry.alias("j51_last_expiry_year"),
        F.when(expiry.isNotNull(), (expiry >= F.year("as_of_date")).cast("int")).alias("j51_active_flag"))


def enriched_spine(spark, sf):
    """Every sale with what was known the day before: deeds, mortgages, rolls and
    abatements (one as-of merge), the parcel with its transit, comparable sales
    (parcel, day, segment) and market trends (day, borough, neighbourhood, segment)."""
    sp = comp_sales(spark, sf).drop("latitude", "longitude")
    parcels = B.parcels(spark, sf).select("bbl", "latitude", "longitude", "numfloors", "lotarea", "bldgarea")
    trends = q_trend_grid(spark, sf).select("comp_segment", "as_of_date", "borough", "neighborhood", "nbhd_median_l365", "nbhd_yoy_growth", "borough_yoy_growth")
    comps = q_knn_temporal_comps(spark, sf).drop("comp_p25_price", "comp_p75_price")
    return joins.enrich_spine(sp, [(known(sp, gold_sides(spark, sf)), ["bbl", "as_of_date"]), (parcels, ["bbl"]), (q_transit_features(spark, sf), ["bbl"]),
                                   (comps, ["bbl", "as_of_date", "comp_segment"]), (trends, ["as_of_date", "borough", "neighborhood", "comp_segment"])], unique=True)


@register("enrich_spine", ENRICH_SQL)
def q_enrich_spine(spark, sf):
    return enriched_spine(spark, sf).select(
        "sale_id", "bbl", "as_of_date", "comp_segment", "deed_cnt", "deed_last_document_amt", "deed_days_since_last", "mtge_cnt", "mtge_last_document_amt",
        "roll_year", "roll_curacttot", "roll_curmkttot", "roll_units", "j51_last_abatement", "j51_total_abatement", "j51_active_flag", "latitude", "longitude",
        "numfloors", "lotarea", "bldgarea", "subway_dist_km", "subway_hub_flag", "subway_k3_mean_dist_km", "subway_n_500m", "subway_n_1km", "subway_cbd_dist_km",
        "comp_count", "comp_median_price", "comp_median_ppsqft", "comp_search_dist_km", "comp_recency_days", "nbhd_median_l365", "nbhd_yoy_growth", "borough_yoy_growth")


@register("asof_many", B.with_ctes(B.SPINE_SQL) + f""", deedh AS {_body(AQ.ASOF_EVENT_HISTORY_SQL)},
mtgeh AS {_body(MORTGAGE_SQL)}, rollv AS {_body(AQ.ASOF_LATEST_VERSION_SQL)}, j51 AS {_body(_J51_SQL)}
SELECT d.bbl, d.as_of_date, d.deed_cnt, d.deed_last_document_amt, d.deed_days_since_last, m.mtge_cnt, m.mtge_last_document_amt, r.roll_year, r.roll_curacttot,
  r.roll_curmkttot, r.roll_units, j.j51_last_abatement, j.j51_total_abatement, j.j51_last_expiry_year, j.j51_active_flag
FROM deedh d JOIN mtgeh m USING (bbl, as_of_date) JOIN rollv r USING (bbl, as_of_date) JOIN j51 j USING (bbl, as_of_date)""")
def q_asof_many(spark, sf):
    """Four kinds of facts of every (parcel, as_of) of the spine in one merge."""
    return known(B.sale_keys(spark, sf), gold_sides(spark, sf))


_REQUESTS_SQL = """requests AS (
  SELECT DISTINCT CASE WHEN o_orderkey % 10 = 0 THEN bbl + 1000000 ELSE bbl END AS bbl, sale_date AS as_of_date, segment, building_class, borough, neighborhood
  FROM (SELECT *, sale_id AS o_orderkey FROM spine)),
rq AS (SELECT *, CASE WHEN segment = 'one_family' THEN 'one_family' WHEN segment = 'condo_coop' THEN 'condo_coop'
    WHEN segment = 'multi_family' AND starts_with(trim(COALESCE(building_class, '')), '02') THEN 'two_family'
    WHEN segment = 'multi_family' AND starts_with(trim(COALESCE(building_class, '')), '03') THEN 'three_family' END AS comp_segment FROM requests)"""


@register(
    "parcel_feature_bundle",
    B.with_ctes(B.SPINE_SQL, _REQUESTS_SQL, B.PARCELS_SQL, B.TAX_ROLLS_SQL, B.documents_sql("deeds", "F"), B.documents_sql("mtges", "O"), B.ABATEMENTS_SQL)
    + f""", k AS (SELECT DISTINCT bbl, as_of_date FROM rq),
roll AS (SELECT k.bbl, k.as_of_date, t.year, t.curacttot, t.curmkttot, t.units,
  row_number() OVER (PARTITION BY k.bbl, k.as_of_date ORDER BY t.year DESC) AS rn
  FROM k JOIN tax_rolls t ON t.bbl = k.bbl AND make_date(t.year, 1, 1) <= k.as_of_date),
dh AS (SELECT k.bbl, k.as_of_date, d.document_amt AS amt, date_sub('day', d.document_date, CAST(k.as_of_date AS TIMESTAMP)) AS since, count(*) OVER (PARTITION BY k.bbl, k.as_of_date) AS n,
  row_number() OVER (PARTITION BY k.bbl, k.as_of_date ORDER BY d.document_date DESC, d.document_id DESC) AS rn
  FROM k JOIN deeds d ON d.bbl = k.bbl AND CAST(d.document_date AS DATE) < k.as_of_date),
mh AS (SELECT k.bbl, k.as_of_date, d.document_amt AS amt, count(*) OVER (PARTITION BY k.bbl, k.as_of_date) AS n,
  row_number() OVER (PARTITION BY k.bbl, k.as_of_date ORDER BY d.document_date DESC, d.document_id DESC) AS rn
  FROM k JOIN mtges d ON d.bbl = k.bbl AND CAST(d.document_date AS DATE) < k.as_of_date),
ab AS (SELECT k.bbl, k.as_of_date, a.abatement, a.expiry_year, sum(a.abatement) OVER (PARTITION BY k.bbl, k.as_of_date) AS total,
  row_number() OVER (PARTITION BY k.bbl, k.as_of_date ORDER BY a.tax_year DESC, a.row_id DESC) AS rn
  FROM k JOIN abatements a ON a.bbl = k.bbl AND a.tax_year < year(k.as_of_date)),
comps AS {_body(COMPS_SQL)}, trends AS {_body(TREND_SQL)}, transit AS {_body(TRANSIT_SQL)},
ck AS (SELECT DISTINCT bbl, as_of_date, comp_segment FROM rq WHERE comp_segment IS NOT NULL),
cc AS (SELECT ck.bbl, ck.as_of_date, ck.comp_segment, c.comp_count, c.comp_median_price, c.comp_median_ppsqft, c.comp_search_dist_km, c.comp_recency_days,
  row_number() OVER (PARTITION BY ck.bbl, ck.as_of_date, ck.comp_segment ORDER BY c.as_of_date DESC) AS rn
  FROM ck JOIN comps c ON c.bbl = ck.bbl AND c.comp_segment = ck.comp_segment AND c.as_of_date <= ck.as_of_date AND c.as_of_date >= ck.as_of_date - 365),
tk AS (SELECT DISTINCT borough, neighborhood, comp_segment, as_of_date FROM rq WHERE comp_segment IS NOT NULL),
tt AS (SELECT tk.borough, tk.neighborhood, tk.comp_segment, tk.as_of_date, g.nbhd_median_l365, g.nbhd_yoy_growth, g.borough_yoy_growth,
  row_number() OVER (PARTITION BY tk.borough, tk.neighborhood, tk.comp_segment, tk.as_of_date ORDER BY g.as_of_date DESC) AS rn
  FROM tk JOIN trends g ON g.borough = tk.borough AND g.neighborhood = tk.neighborhood AND g.comp_segment = tk.comp_segment
   AND g.as_of_date <= tk.as_of_date AND g.as_of_date >= tk.as_of_date - 365)
SELECT r.bbl, r.as_of_date, r.segment, r.building_class, ro.year AS roll_year, ro.curacttot AS roll_curacttot, ro.curmkttot AS roll_curmkttot, ro.units AS roll_units,
  round(CASE WHEN ro.units > 0 THEN ro.curacttot / ro.units END, 6) AS roll_per_unit,
  COALESCE(dh.n, 0) AS deed_cnt, dh.amt AS deed_last_document_amt, dh.since AS deed_days_since_last, COALESCE(mh.n, 0) AS mtge_cnt, mh.amt AS mtge_last_document_amt,
  ab.abatement AS j51_last_abatement, round(ab.total, 4) AS j51_total_abatement, CAST(COALESCE(ab.expiry_year >= year(r.as_of_date), FALSE) AS INTEGER) AS j51_active_flag,
  p.latitude, p.longitude, p.numfloors, p.lotarea, p.bldgarea, t.subway_dist_km, t.subway_hub_flag, t.subway_k3_mean_dist_km, t.subway_n_500m, t.subway_n_1km, t.subway_cbd_dist_km,
  cc.comp_count, cc.comp_median_price, cc.comp_median_ppsqft, cc.comp_search_dist_km, cc.comp_recency_days, tt.nbhd_median_l365, tt.nbhd_yoy_growth, tt.borough_yoy_growth,
  CASE WHEN ro.year IS NOT NULL THEN 'ok' WHEN p.latitude IS NOT NULL OR COALESCE(dh.n, 0) > 0 THEN 'partial' ELSE 'no_data' END AS status
FROM rq r
LEFT JOIN roll ro ON ro.bbl = r.bbl AND ro.as_of_date = r.as_of_date AND ro.rn = 1
LEFT JOIN dh ON dh.bbl = r.bbl AND dh.as_of_date = r.as_of_date AND dh.rn = 1
LEFT JOIN mh ON mh.bbl = r.bbl AND mh.as_of_date = r.as_of_date AND mh.rn = 1
LEFT JOIN ab ON ab.bbl = r.bbl AND ab.as_of_date = r.as_of_date AND ab.rn = 1
LEFT JOIN parcels p ON p.bbl = r.bbl LEFT JOIN transit t ON t.bbl = r.bbl
LEFT JOIN cc ON cc.bbl = r.bbl AND cc.as_of_date = r.as_of_date AND cc.comp_segment = r.comp_segment AND cc.rn = 1
LEFT JOIN tt ON tt.borough = r.borough AND tt.neighborhood = r.neighborhood AND tt.comp_segment = r.comp_segment AND tt.as_of_date = r.as_of_date AND tt.rn = 1""",
)
def q_parcel_feature_bundle(spark, sf):
    """Requests for every sold parcel on its day of sale (a tenth of them for
    parcels that don't exist) with all features and a data status."""
    sp = comp_sales(spark, sf)
    unknown = F.col("sale_id") % 10 == 0
    req = sp.select(F.when(unknown, F.col("bbl") + 1_000_000).otherwise(F.col("bbl")).alias("bbl"), F.col("sale_date").alias("as_of_date"),
                    "segment", "building_class", "borough", "neighborhood", "comp_segment").distinct()
    return parcel_feature_bundle(req, gold_sides(spark, sf), B.parcels(spark, sf), q_transit_features(spark, sf), q_knn_temporal_comps(spark, sf), q_trend_grid(spark, sf))


_COMP = ("comp_count", "comp_median_price", "comp_median_ppsqft", "comp_search_dist_km", "comp_recency_days")
_TREND = ("nbhd_median_l365", "nbhd_yoy_growth", "borough_yoy_growth")
SNAPSHOT_DAYS = 365


def parcel_feature_bundle(requests, sides, parcels, transit, comps, trends):
    """All features of requested (bbl, as_of, segment, class, borough,
    neighbourhood, comp_segment) and a data status. Comparable sales and trends are
    the newest snapshots of the year up to as_of; they don't count for the status."""
    k = ["bbl", "as_of_date"]
    got = known(requests, sides)
    geo = parcels.select("bbl", "latitude", "longitude", "numfloors", "lotarea", "bldgarea")
    asked = requests.where(F.col("comp_segment").isNotNull())
    ck, tk = ["bbl", "comp_segment"], ["borough", "neighborhood", "comp_segment"]
    cc = asof.asof_latest_snapshot(asked, comps.withColumnRenamed("as_of_date", "snapshot_date"), ck, carry=_COMP, max_age_days=SNAPSHOT_DAYS)
    tt = asof.asof_latest_snapshot(asked, trends.withColumnRenamed("as_of_date", "snapshot_date"), tk, carry=_TREND, max_age_days=SNAPSHOT_DAYS)
    named = lambda df, keys, cols: df.select(*keys, "as_of_date", *[F.col(f"snap_{c}").alias(c) for c in cols])
    out = joins.enrich_spine(requests, [(got, k), (geo, ["bbl"]), (transit, ["bbl"]), (named(cc, ck, _COMP), [*ck, "as_of_date"]),
                                        (named(tt, tk, _TREND), [*tk, "as_of_date"])], unique=True)
    status = (F.when(F.col("roll_year").isNotNull(), "ok").when(F.col("latitude").isNotNull() | (F.col("deed_cnt") > 0), "partial").otherwise("no_data"))
    return out.select(
        *k, "segment", "building_class", "roll_year", "roll_curacttot", "roll_curmkttot", "roll_units",
        F.round(F.when(F.col("roll_units") > 0, F.col("roll_curacttot") / F.col("roll_units")), 6).alias("roll_per_unit"),
        F.coalesce("deed_cnt", F.lit(0)).cast("long").alias("deed_cnt"), "deed_last_document_amt", "deed_days_since_last",
        F.coalesce("mtge_cnt", F.lit(0)).cast("long").alias("mtge_cnt"), "mtge_last_document_amt",
        "j51_last_abatement", "j51_total_abatement", F.coalesce("j51_active_flag", F.lit(0)).alias("j51_active_flag"),
        "latitude", "longitude", "numfloors", "lotarea", "bldgarea", "subway_dist_km", "subway_hub_flag", "subway_k3_mean_dist_km", "subway_n_500m", "subway_n_1km",
        "subway_cbd_dist_km", *_COMP, *_TREND, status.alias("status"))


@register(
    "map_join_fallback",
    B.with_ctes(B.SPINE_SQL)
    + """, train AS (SELECT * FROM spine WHERE sale_date <= DATE '1998-12-31' AND neighborhood <> 'NATION_3'),
nb AS (SELECT neighborhood, quantile_cont(sales_price, 0.5) AS med FROM train GROUP BY neighborhood)
SELECT s.sale_id, round(COALESCE(nb.med, (SELECT quantile_cont(sales_price, 0.5) FROM train)), 6) AS neighborhood_median_price
FROM spine s LEFT JOIN nb ON s.neighborhood = nb.neighborhood""",
)
def q_map_join_fallback(spark, sf):
    sp = B.spine(spark, sf)
    train = sp.where((F.col("sale_date") <= F.lit("1998-12-31").cast("date")) & (F.col("neighborhood") != "NATION_3"))
    from lotline.operators.clean import group_quantiles, quantile_value
    stats = group_quantiles(train, ["neighborhood"], "sales_price", {"med": 0.5})
    glob = quantile_value(train, "sales_price", 0.5)
    out = joins.map_join_fallback(sp, stats, "neighborhood", "med", glob, "neighborhood_median_price")
    return out.select("sale_id", F.round("neighborhood_median_price", 6).alias("neighborhood_median_price"))
