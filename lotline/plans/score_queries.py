"""Registered scoring queries (survey 2.10, 2.11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotline.functions import scoring
from lotline.operators import score
from lotline.operators.columns import route_model
from lotline.plans import bindings as B
from lotline.plans.ranking_queries import _SCORED_SQL, scored_properties
from lotline.plans.registry import register
from lotline.plans.stats_queries import _PRED_SQL, pred

# per-segment MAE fitted on the training years, applied to every prediction
_MAE_SQL = B.with_ctes(_PRED_SQL) + """, mae AS (SELECT segment, avg(abs(yhat - y)) AS mae FROM pred WHERE yr <= 1998 GROUP BY segment)
"""


def _with_mae(spark, sf):
    p = pred(spark, sf)
    mae = p.where(F.col("yr") <= 1998).groupBy("segment").agg(F.avg(F.abs(F.col("yhat") - F.col("y"))).alias("mae"))
    return p.join(mae, "segment", "left")


@register(
    "valuation_interval",
    _MAE_SQL + """SELECT p.l_orderkey, p.l_linenumber,
  round(CASE WHEN m.mae IS NOT NULL AND m.mae > 0 AND p.yhat >= 0 THEN greatest(0.0, p.yhat - m.mae) END, 6) AS price_low,
  round(CASE WHEN m.mae IS NOT NULL AND m.mae > 0 AND p.yhat >= 0 THEN p.yhat + m.mae END, 6) AS price_high
FROM pred p LEFT JOIN mae m USING (segment)""",
)
def q_valuation_interval(spark, sf):
    p = _with_mae(spark, sf)
    lo, hi = scoring.valuation_interval(F.col("yhat"), F.col("mae"))
    return p.select("l_orderkey", "l_linenumber", F.round(lo, 6).alias("price_low"), F.round(hi, 6).alias("price_high"))


@register(
    "valuation_interval_per_unit",
    _MAE_SQL + """SELECT p.l_orderkey, p.l_linenumber,
  round(CASE WHEN m.mae > 0 AND p.yhat >= 0 THEN greatest(0.0, p.yhat - CASE WHEN p.segment = 'LARGE'
        THEN m.mae * greatest(COALESCE(q.l_quantity, 0.0), 1.0) * 1.0 ELSE m.mae * 1.0 END) END, 6) AS price_low,
  round(CASE WHEN m.mae > 0 AND p.yhat >= 0 THEN p.yhat + CASE WHEN p.segment = 'LARGE'
        THEN m.mae * greatest(COALESCE(q.l_quantity, 0.0), 1.0) * 1.0 ELSE m.mae * 1.0 END END, 6) AS price_high
FROM pred p LEFT JOIN mae m USING (segment)
JOIN (SELECT l_orderkey, l_linenumber, min(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL) q
  ON q.l_orderkey = p.l_orderkey AND q.l_linenumber = p.l_linenumber""",
)
def q_valuation_interval_per_unit(spark, sf):
    p = _with_mae(spark, sf)
    li = B.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("l_quantity"))
    p = p.join(li, ["l_orderkey", "l_linenumber"])
    lo, hi = scoring.valuation_interval(F.col("yhat"), F.col("mae"), F.col("l_quantity"), F.col("segment") == "LARGE")
    return p.select("l_orderkey", "l_linenumber", F.round(lo, 6).alias("price_low"), F.round(hi, 6).alias("price_high"))


@register(
    "investment_score",
    _SCORED_SQL + """SELECT id, investment_score, deal_label, round(roi_estimate, 9) AS roi_estimate,
  round(predicted_price - market_price, 6) AS price_difference,
  round(CASE WHEN market_price > 0 THEN (predicted_price - market_price) / market_price * 100.0 ELSE 0.0 END, 9) AS price_difference_pct FROM labelled""",
)
def q_investment_score(spark, sf):
    s = score.score_predictions(B.properties_raw(spark, sf))
    return s.select("id", "investment_score", "deal_label", F.round("roi_estimate", 9).alias("roi_estimate"),
                    F.round("price_difference", 6).alias("price_difference"),
                    F.round("price_difference_pct", 9).alias("price_difference_pct"))


@register(
    "investment_score_legacy",
    B.with_ctes(B.PROPERTIES_SQL) + """SELECT id, round(greatest(0.0, least(100.0, 50.0 + ((predicted_price - market_price) / market_price * 100.0) * 2.5)), 9) AS legacy_score
FROM props WHERE market_price > 0""",
)
def q_investment_score_legacy(spark, sf):
    p = B.properties_raw(spark, sf).where(F.col("market_price") > 0)
    return p.select("id", F.round(scoring.legacy_investment_score("predicted_price", "market_price"), 9).alias("legacy_score"))


@register(
    "prediction_warnings",
    B.with_ctes(B.SPINE_SQL, B.TAX_ROLLS_SQL) + """, st AS (
  SELECT s.sale_id, s.total_units, s.building_class,
    CASE WHEN EXISTS (SELECT 1 FROM tax_rolls t WHERE t.bbl = s.bbl AND make_date(t.year, 1, 1) <= s.as_of_date) THEN 'ok'
         ELSE 'no_data' END AS parcel_status,
    CASE WHEN trim(s.building_class) = '07 RENTALS - WALKUP APARTMENTS' THEN 'rental_walkup'
      WHEN trim(s.building_class) = '08 RENTALS - ELEVATOR APARTMENTS' THEN 'rental_elevator' WHEN trim(s.building_class) IN ('01 ONE FAMILY DWELLINGS', '02 TWO FAMILY DWELLINGS', '03 THREE FAMILY DWELLINGS',
      '07 RENTALS - WALKUP APARTMENTS', '08 RENTALS - ELEVATOR APARTMENTS', '09 COOPS - WALKUP APARTMENTS',
      '10 COOPS - ELEVATOR APARTMENTS', '12 CONDOS - WALKUP APARTMENTS', '13 CONDOS - ELEVATOR APARTMENTS',
      '15 CONDOS - 2-10 UNIT RESIDENTIAL', '17 CONDO COOPS') THEN 'seg' ELSE 'global' END AS model_key
  FROM spine s)
SELECT sale_id, array_to_string(list_filter([
   CASE WHEN model_key LIKE 'rental%' AND COALESCE(total_units, 0) <= 0 THEN 'missing_units' END,
   CASE WHEN parcel_status = 'no_data' THEN 'no_parcel_data' END,
   CASE WHEN model_key = 'global' AND parcel_status = 'ok' THEN 'global_model_fallback' END], lambda x: x IS NOT NULL), ',') AS warnings
FROM st""",
)
def q_prediction_warnings(spark, sf):
    from lotline.operators import asof
    sp = B.spine(spark, sf)
    roll = asof.asof_latest_version(sp, B.tax_rolls(spark, sf), prefix="roll").select("bbl", "as_of_date", "roll_year")
    j = sp.join(roll, ["bbl", "as_of_date"], "left")
    status = F.when(F.col("roll_year").isNotNull(), "ok").otherwise("no_data")
    avail = spark.createDataFrame([], "model_key string")
    routed = route_model(j, avail, "building_class")
    w = score.prediction_warnings(F.col("model_key"), F.col("total_units"), status)
    return routed.select("sale_id", F.array_join(w, ",").alias("warnings"))


_IMP_FEATURES = ["gross_sqft", "land_sqft", "total_units", "residential_units", "year_built", "borough"]


def _importance_sql() -> str:
    parts = " UNION ALL ".join(
        f"SELECT segment, '{c}' AS feature, abs(corr(CAST({c} AS DOUBLE), sales_price)) AS importance FROM spine GROUP BY segment"
        for c in _IMP_FEATURES)
    return f"imp AS ({parts})"


def _phrase_sql(expr: str) -> str:
    arms = []
    for needles, phrase in score.DRIVER_RULES:
        cond = " OR ".join(f"contains(lower({expr}), '{n}')" for n in needles)
        arms.append(f"WHEN {cond} THEN '{phrase}'")
    return f"(CASE {' '.join(arms)} ELSE '{score.DRIVER_DEFAULT}' END)"


@register(
    "driver_phrases",
    B.with_ctes(B.SPINE_SQL) + f""", {_importance_sql()},
top AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY importance DESC, feature) AS rn FROM imp),
ph AS (SELECT segment, rn, {_phrase_sql('feature')} AS phrase FROM top WHERE rn <= 3),
firsts AS (SELECT segment, phrase, min(rn) AS rn FROM ph GROUP BY segment, phrase)
SELECT segment, string_agg(phrase, ' | ' ORDER BY rn) AS top_drivers FROM firsts GROUP BY segment""",
)
def q_driver_phrases(spark, sf):
    sp = B.spine(spark, sf)
    imp = None
    for c in _IMP_FEATURES:
        one = sp.groupBy("segment").agg(F.lit(c).alias("feature"),
                                        F.abs(F.corr(F.col(c).cast("double"), "sales_price")).alias("importance"))
        imp = one if imp is None else imp.unionByName(one)
    d = score.top_driver_phrases(imp, ["segment"], "feature", "importance", 3)
    return d.select("segment", F.array_join("top_drivers", " | ").alias("top_drivers"))


def _legacy_importance_sql() -> str:
    parts = " UNION ALL ".join(f"SELECT '{n}' AS feature, abs(corr(CAST({c} AS DOUBLE), sales_price)) AS importance FROM spine JOIN parcels ON parcels.bbl = spine.bbl"
                               for n, c in _LEGACY_FEATURES.items())
    return f"imp AS ({parts}), strongest AS (SELECT list(feature) AS names FROM (SELECT feature FROM imp ORDER BY round(importance, 9) DESC, feature LIMIT 4))"


def _legacy_sql(rules, text: str) -> str:
    value = {"bldgarea": "CAST(CAST(bldgarea AS BIGINT) AS VARCHAR)", "gross_square_feet": "CAST(CAST(gross_sqft AS BIGINT) AS VARCHAR)", "neighborhood": "neighborhood",
             "borough": "CAST(borough AS VARCHAR)", "total_units": "CAST(CAST(total_units AS BIGINT) AS VARCHAR)"}
    return ", ".join(f"CASE WHEN len(list_filter(names, lambda f: contains(f, '{r[0]}'))) > 0 THEN {text.format(r[0], r[1], value.get(r[0]))} END" for r in rules)


# name in the strongest features -> column of spine or parcel
_LEGACY_FEATURES = {"bldgarea": "bldgarea", "gross_square_feet": "gross_sqft", "total_units_x": "total_units", "borough_name": "spine.borough", "neighborhood_code": "length(spine.neighborhood)",
                    "lotarea": "lotarea"}


@register(
    "legacy_drivers_summary",
    B.with_ctes(B.SPINE_SQL, B.PARCELS_SQL) + """, x AS (
  SELECT s.sale_id, p.bldgarea, s.gross_sqft, s.building_class, s.neighborhood, s.borough, s.total_units, s.sales_price AS market,
         s.sales_price * (0.85 + CAST(s.sale_id % 31 AS DOUBLE) / 100.0) AS predicted
  FROM spine s LEFT JOIN parcels p ON p.bbl = s.bbl),
y AS (SELECT *, (predicted - market) / market * 100.0 AS roi FROM x),
d AS (SELECT *, list_filter([
    CASE WHEN COALESCE(bldgarea, 0) > 1500 THEN 'Large building area' END,
    CASE WHEN COALESCE(gross_sqft, 0) >= 1400 THEN 'Above-average gross square footage' END,
    CASE WHEN contains(upper(COALESCE(building_class, '')), 'ONE FAMILY') THEN 'Favorable one-family residential class'
         WHEN contains(upper(COALESCE(building_class, '')), 'TWO FAMILY') THEN 'Two-family income potential'
         WHEN contains(upper(COALESCE(building_class, '')), 'RENTALS') THEN 'Rental building profile' END,
    CASE WHEN upper(COALESCE(neighborhood, '')) <> '' THEN 'Neighborhood signal: ' || upper(neighborhood) END,
    CASE WHEN roi > 10 THEN 'Strong model upside versus market price' WHEN roi > 0 THEN 'Positive valuation spread' END
  ], lambda v: v IS NOT NULL) AS drivers FROM y),
""" + _legacy_importance_sql() + """
SELECT sale_id, array_to_string(drivers, ', ') AS drivers, (SELECT array_to_string(list_filter([""" + _legacy_sql(score.LEGACY_CONTEXT, "'{1}'") + """], lambda v: v IS NOT NULL)[1:3], ' | ') FROM strongest) AS context,
  (SELECT array_to_string(list_filter([""" + _legacy_sql(score.LEGACY_FACTORS, "'{0}=' || COALESCE({2}, '{1}')") + """], lambda v: v IS NOT NULL)[1:4], ' | ') FROM strongest) AS factors,
  CASE WHEN roi >= 10 THEN 'appears moderately undervalued' WHEN roi > 0 THEN 'appears slightly undervalued'
       WHEN roi > -5 THEN 'appears close to fair value' ELSE 'appears overpriced relative to the model estimate' END AS outlook
FROM d""",
)
def q_legacy_drivers_summary(spark, sf):
    """Drivers, outlook, context and factors of the legacy endpoint; the strongest features are the four that
    correlate most with the price."""
    sp = B.spine(spark, sf)
    p = B.parcels(spark, sf).select("bbl", "bldgarea", "lotarea")
    x = sp.join(p, "bbl", "left").select(
        "sale_id", "bldgarea", "lotarea", "gross_sqft", "building_class", "neighborhood", "borough", "total_units", F.col("sales_price").alias("market"),
        (F.col("sales_price") * (F.lit(0.85) + (F.col("sale_id") % 31).cast("double") / 100.0)).alias("predicted"))
    x = x.withColumn("roi", (F.col("predicted") - F.col("market")) / F.col("market") * 100.0)
    column = {"borough_name": F.col("borough"), "neighborhood_code": F.length("neighborhood"), "total_units_x": F.col("total_units"), "gross_square_feet": F.col("gross_sqft")}
    by = F.array(*[F.struct((-F.round(F.abs(F.corr(column.get(n, F.col(n)).cast("double"), "market")), 9)).alias("k"), F.lit(n).alias("f")) for n in _LEGACY_FEATURES])
    names = x.where("bldgarea is not null").select(F.transform(F.slice(F.array_sort(by), 1, 4), lambda s: s["f"]).alias("names")).select("names").scalar()
    whole = lambda c: F.col(c).cast("bigint")
    values = {"bldgarea": whole("bldgarea"), "gross_square_feet": whole("gross_sqft"), "neighborhood": F.col("neighborhood"), "borough": F.col("borough"), "total_units": whole("total_units")}
    drivers = score.legacy_drivers("bldgarea", "gross_sqft", "building_class", "neighborhood", "roi")
    x = x.withColumn("names", names)
    factors = F.transform(score.legacy_factors(F.col("names"), values), lambda f: F.concat_ws("=", f["factor"], f["value"]))
    return x.select("sale_id", F.array_join(drivers, ", ").alias("drivers"), score.legacy_outlook("roi").alias("outlook"),
                    F.array_join(score.legacy_context(F.col("names")), " | ").alias("context"), F.array_join(factors, " | ").alias("factors"))


@register(
    "legacy_summary_text",
    B.with_ctes(B.SPINE_SQL) + """, x AS (SELECT *, sales_price AS market, sales_price * 1.07 AS predicted FROM spine),
y AS (SELECT *, (predicted - market) / market * 100.0 AS roi FROM x),
d AS (SELECT *, array_to_string(list_filter([
    CASE WHEN COALESCE(gross_sqft, 0) >= 1400 THEN 'Above-average gross square footage' END,
    CASE WHEN contains(upper(COALESCE(building_class, '')), 'ONE FAMILY') THEN 'Favorable one-family residential class'
         WHEN contains(upper(COALESCE(building_class, '')), 'TWO FAMILY') THEN 'Two-family income potential'
         WHEN contains(upper(COALESCE(building_class, '')), 'RENTALS') THEN 'Rental building profile' END,
    CASE WHEN upper(COALESCE(neighborhood, '')) <> '' THEN 'Neighborhood signal: ' || upper(neighborhood) END,
    CASE WHEN roi > 10 THEN 'Strong model upside versus market price' WHEN roi > 0 THEN 'Positive valuation spread' END
  ], lambda v: v IS NOT NULL), ', ') AS drivers FROM y)
SELECT sale_id, 'The property ' || CASE WHEN roi >= 10 THEN 'appears moderately undervalued' WHEN roi > 0 THEN 'appears slightly undervalued'
       WHEN roi > -5 THEN 'appears close to fair value' ELSE 'appears overpriced relative to the model estimate' END
  || '. The model estimate is $' || format('{:,}', CAST(round_even(predicted, 0) AS BIGINT)) || ' versus a market price of $'
  || format('{:,}', CAST(round_even(market, 0) AS BIGINT)) || '. Key drivers include: '
  || CASE WHEN drivers = '' THEN 'mixed property signals' ELSE drivers END || '.' AS summary FROM d""",
)
def q_legacy_summary_text(spark, sf):
    """Full narrative sentence."""
    sp = B.spine(spark, sf)
    x = sp.select("sale_id", "gross_sqft", "building_class", "neighborhood", F.col("sales_price").alias("market"),
                  (F.col("sales_price") * 1.07).alias("predicted"))
    x = x.withColumn("roi", (F.col("predicted") - F.col("market")) / F.col("market") * 100.0)
    drivers = score.legacy_drivers(F.lit(None).cast("double"), "gross_sqft", "building_class", "neighborhood", "roi")
    return x.select("sale_id", score.legacy_summary(F.col("predicted"), F.col("market"), F.col("roi"), drivers).alias("summary"))


@register(
    "analysis_document",
    _SCORED_SQL + """SELECT id, round(predicted_price, 6) AS predicted_price, round(market_price, 6) AS market_price,
  investment_score, deal_label, recommendation, confidence, analysis_summary, told AS explanation_summary, 'N/A' AS risks,
  CASE WHEN id % 3 = 0 THEN 'ok' ELSE 'unavailable' END AS explanation_status,
  'Model is trained on NYC residential sales data | Location, size, and building characteristics influence estimated value' AS global_context,
  'predicted_price: Derived from trained ML model using property features | market_price: User-provided listing price' AS factors,
  'spark-1' AS model_version FROM labelled""",
)
def q_analysis_document(spark, sf):
    d = scored_properties(spark, sf)
    inv = "analysis.investment_analysis"
    return d.select(
        "id",
        F.round("analysis.valuation.predicted_price", 6).alias("predicted_price"),
        F.round("analysis.valuation.market_price", 6).alias("market_price"),
        *[F.col(f"{inv}.{c}").alias(c) for c in ("investment_score", "deal_label", "recommendation", "confidence", "analysis_summary")],
        F.col("analysis.explanation.summary").alias("explanation_summary"), F.col("analysis.explanation.risks").alias("risks"),
        F.col("analysis.explanation_status").alias("explanation_status"),
        F.array_join("analysis.drivers.global_context", " | ").alias("global_context"),
        F.array_join(F.transform("analysis.drivers.explanation_factors", lambda x: F.concat(x["factor"], F.lit(": "), x["reason"])), " | ").alias("factors"),
        F.col("analysis.metadata.model_version").alias("model_version"),
    )


_DOC = """, docs AS (SELECT *, CASE id % 4 WHEN 0 THEN 'old' WHEN 1 THEN 'broken' ELSE 'new' END AS version FROM labelled)"""


def stored_documents(spark, sf):
    """Stored analyses as they come to lie about: three quarters as written
    today, some of an older version (score as text, no investment block), some that are no JSON."""
    d = scored_properties(spark, sf).select("id", score.store_document(F.col("analysis")).alias("doc"), F.round("analysis.valuation.predicted_price", 6).alias("p"))
    old = F.concat(F.lit('{"valuation": {"predicted_price": "'), F.col("p").cast("decimal(20,6)").cast("string"), F.lit('"}, "extra": [1, {"a": null}]}'))
    return d.select("id", F.when(F.col("id") % 4 == 0, old).when(F.col("id") % 4 == 1, F.lit("{not json")).otherwise(F.col("doc")).alias("doc"))


@register(
    "analysis_document_json",
    _SCORED_SQL + _DOC + """SELECT id, version <> 'broken' AS readable, round(CASE WHEN version <> 'broken' THEN predicted_price END, 6) AS predicted_price,
  CASE WHEN version = 'new' THEN investment_score ELSE -1 END AS investment_score, CASE WHEN version = 'new' THEN deal_label ELSE 'Unknown' END AS deal_label,
  CASE WHEN version = 'new' THEN recommendation ELSE 'Hold' END AS recommendation, CASE WHEN version = 'new' THEN 'market_price' END AS second_factor,
  CASE WHEN version = 'new' THEN 2 ELSE 0 END AS n_context FROM docs""",
)
def q_analysis_document_json(spark, sf):
    """Typed fields of stored JSON documents, read as VARIANT: several versions
    and broken texts side by side."""
    v = stored_documents(spark, sf).withColumn("v", F.try_parse_json("doc"))
    get = lambda path, kind, default=None: score.document_field(F.col("v"), path, kind, default)
    return v.select(
        "id", F.col("v").isNotNull().alias("readable"),
        F.round(get("$.valuation.predicted_price", "double"), 6).alias("predicted_price"),
        get("$.investment_analysis.investment_score", "int", -1).alias("investment_score"),
        get("$.investment_analysis.deal_label", "string", "Unknown").alias("deal_label"),
        get("$.investment_analysis.recommendation", "string", "Hold").alias("recommendation"),
        get("$.drivers.explanation_factors[1].factor", "string").alias("second_factor"),
        F.coalesce(F.size(get("$.drivers.global_context", "array<string>")), F.lit(0)).alias("n_context"))


@register(
    "event_props_variant",
    """SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS sum_k, min(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS min_k,
  count(*) FILTER (json_extract(props, '$.none') IS NOT NULL) AS n_none, count(DISTINCT json_extract_string(props, '$.k')) AS kinds FROM events GROUP BY event_type""",
)
def q_event_props_variant(spark, sf):
    """Typed fields of the JSON texts of all events, by event type."""
    e = B.table(spark, sf, "events").withColumn("v", F.try_parse_json("props"))
    k = score.document_field(F.col("v"), "$.k", "bigint")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("sum_k"), F.min(k).alias("min_k"),
                                       F.count(F.try_variant_get("v", "$.none", "string")).alias("n_none"), F.count_distinct(k).alias("kinds"))


@register(
    "distinct_in_order",
    B.with_ctes(B.SPINE_SQL) + f""", {_importance_sql()},
ranked AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY importance DESC, feature) AS rn FROM imp),
ph AS (SELECT segment, rn, {_phrase_sql('feature')} AS phrase FROM ranked),
firsts AS (SELECT segment, phrase, min(rn) AS rn FROM ph GROUP BY segment, phrase)
SELECT segment, string_agg(phrase, ' | ' ORDER BY rn) AS phrases, CAST(count(*) AS INTEGER) AS n_distinct FROM firsts GROUP BY segment""",
)
def q_distinct_in_order(spark, sf):
    """All feature phrases per segment in importance order, de-duplicated
    keeping the first occurrence (order-preserving distinct)."""
    from lotline.operators.ranking import distinct_in_order
    sp = B.spine(spark, sf)
    imp = None
    for c in _IMP_FEATURES:
        one = sp.groupBy("segment").agg(F.lit(c).alias("feature"),
                                        F.abs(F.corr(F.col(c).cast("double"), "sales_price")).alias("importance"))
        imp = one if imp is None else imp.unionByName(one)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("importance")).alias("k"), F.col("feature").alias("f"))))
    g = imp.groupBy("segment").agg(ordered.alias("__o"))
    phrases = distinct_in_order(F.transform("__o", lambda x: score.driver_phrase(x["f"])))
    return g.select("segment", F.array_join(phrases, " | ").alias("phrases"), F.size(phrases).alias("n_distinct"))
