"""Batch scoring: valuation intervals, investment scores and labels, warnings,
driver phrases, legacy narrative pieces and the nested analysis document
(survey 2.10, 2.11). All column expressions -- no Python UDF."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotline.functions import scoring
from lotline.functions.util import col_of

# Feature-name substring -> driver phrase, first match wins (in this order).
DRIVER_RULES = [
    (("bldgarea", "gross_sqft"), "Building size significantly impacts property value"),
    (("sqft_per_unit",), "Average unit size (sqft per unit) drives per-unit valuation"),
    (("assess_per_unit",), "City-assessed value per unit reflects building quality and income potential"),
    (("stabilization_ratio",), "Rent-stabilization rate affects cash-flow and resale dynamics significantly"),
    (("numfloors",), "Building height (floors) is a key driver of condo and rental pricing"),
    (("lot_coverage",), "Lot coverage (building density) reflects urban density and building type"),
    (("units_per_floor",), "Units per floor captures building layout and density premium"),
    (("bldg_footprint",), "Building footprint (front × depth) is a precise proxy for building area"),
    (("builtfar",), "Built floor-area ratio reflects how densely the parcel is developed"),
    (("lotdepth",), "Lot depth influences rear-yard potential and overall parcel value"),
    (("subway_dist",), "Proximity to subway transit is a primary driver of NYC rental pricing"),
    (("land_sqft",), "Land size contributes to overall property valuation"),
    (("neighborhood_median_ppsf",), "Neighborhood price per sqft encodes the location-size value interaction"),
    (("neighborhood_median_price",), "Neighborhood price level is a strong driver of property value"),
    (("curmkttot", "curmkt"), "DOF-estimated market value is a strong indicator of property worth"),
    (("curacttot", "curact"), "City-assessed value significantly influences estimated market price"),
    (("acris_last_deed",), "Prior sale price captures historical market appreciation"),
    (("acris_prior_sale",), "Number of prior sales reflects market activity for this parcel"),
    (("j51",), "J-51 tax abatement status influences property economics"),
    (("neighborhood",), "Neighborhood demand strongly influences pricing"),
    (("borough",), "Location (borough) plays a key role in valuation"),
    (("building_class", "bldg_class", "bldgclass"), "Building class is an important driver of estimated value"),
    (("year_built", "property_age", "yrbuilt"), "Property age and build year affect valuation"),
    (("total_units", "residential_units", "dof_units"), "Building unit count influences income potential and value"),
    (("latitude", "longitude"), "Geographic positioning influences estimated price"),
]
DRIVER_DEFAULT = "Model identified this feature as influential"

# Legacy narrative rules.
LEGACY_OUTLOOK = [
    (10.0, ">=", "appears moderately undervalued"),
    (0.0, ">", "appears slightly undervalued"),
    (-5.0, ">", "appears close to fair value"),
]
LEGACY_OUTLOOK_ELSE = "appears overpriced relative to the model estimate"


def driver_phrase(feature) -> Column:
    """Feature name -> phrase by the first matching substring rule."""
    f = F.lower(col_of(feature))
    out = None
    for needles, phrase in DRIVER_RULES:
        cond = None
        for n in needles:
            c = f.contains(n)
            cond = c if cond is None else cond | c
        out = F.when(cond, F.lit(phrase)) if out is None else out.when(cond, F.lit(phrase))
    return out.otherwise(F.lit(DRIVER_DEFAULT))


def top_driver_phrases(importances: DataFrame, group: Sequence[str], feature: str, importance: str,
                       n: int = 3) -> DataFrame:
    """Top-n features per group by importance (ties by name), mapped to
    phrases, de-duplicated keeping first occurrence."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col(importance)).alias("k"), F.col(feature).alias("f"))))
    g = importances.groupBy(*group).agg(F.slice(ordered, 1, n).alias("__top"))
    phrases = F.transform("__top", lambda x: driver_phrase(x["f"]))
    return g.select(*group, F.array_distinct(phrases).alias("top_drivers"))


def score_predictions(df: DataFrame, predicted: str = "predicted_price", market: str = "market_price",
                      mae: str | None = None, units: str | None = None, per_unit: str | None = None) -> DataFrame:
    """price difference, ROI %, investment score and deal label, interval."""
    p, m = F.col(predicted), F.col(market)
    out = df.withColumn("price_difference", p - m)
    out = out.withColumn("price_difference_pct", F.when(m > 0, (p - m) / m * 100.0).otherwise(0.0))
    out = out.withColumn("roi_estimate", scoring.roi_pct(p, m))
    out = out.withColumn("investment_score", scoring.investment_score(p, m))
    out = out.withColumn("deal_label", scoring.deal_label(F.col("investment_score")))
    if mae is not None:
        lo, hi = scoring.valuation_interval(p, F.col(mae), units and F.col(units), per_unit and F.col(per_unit))
        out = out.withColumn("price_low", lo).withColumn("price_high", hi)
    return out


# Models that predict a price per unit and so need a unit count.
PER_UNIT_MODELS = ("rental_walkup", "rental_elevator")


def usable_model(model_key: Column, units: Column) -> Column:
    """The routed model, or ``global`` where a per-unit model lacks units."""
    lacking = model_key.isin(*PER_UNIT_MODELS) & ~F.coalesce(units > 0, F.lit(False))
    return F.when(lacking, F.lit("global")).otherwise(model_key)


def prediction_warnings(routed_key: Column, units: Column, parcel_status: Column) -> Column:
    """Array of warning codes (empty when none): missing units for per-unit
    models only; the global model is a warning of its own only where nothing
    else is one."""
    lacking = routed_key.isin(*PER_UNIT_MODELS) & ~F.coalesce(units > 0, F.lit(False))
    found = F.array_compact(F.array(
        F.when(lacking, F.lit("missing_units")),
        F.when(parcel_status == "partial", F.lit("incomplete_parcel_data")),
        F.when(parcel_status == "invalid", F.lit("invalid_parcel_id")),
        F.when(parcel_status == "no_data", F.lit("no_parcel_data")),
    ))
    fallback = (F.size(found) == 0) & (usable_model(routed_key, units) == "global")
    return F.when(fallback, F.array(F.lit("global_model_fallback"))).otherwise(found)


def legacy_drivers(bldgarea, gross_sqft, building_class, neighborhood, roi) -> Column:
    """Rule-based driver list of the legacy endpoint."""
    bc = F.upper(F.coalesce(col_of(building_class).cast("string"), F.lit("")))
    nb = F.upper(F.coalesce(col_of(neighborhood).cast("string"), F.lit("")))
    r = col_of(roi)
    cls = (F.when(bc.contains("ONE FAMILY"), "Favorable one-family residential class")
           .when(bc.contains("TWO FAMILY"), "Two-family income potential")
           .when(bc.contains("RENTALS"), "Rental building profile"))
    return F.array_compact(F.array(
        F.when(F.coalesce(col_of(bldgarea), F.lit(0)) > 1500, F.lit("Large building area")),
        F.when(F.coalesce(col_of(gross_sqft), F.lit(0)) >= 1400, F.lit("Above-average gross square footage")),
        cls,
        F.when(nb != "", F.concat(F.lit("Neighborhood signal: "), nb)),
        F.when(r > 10, F.lit("Strong model upside versus market price")).when(r > 0, F.lit("Positive valuation spread")),
    ))


def legacy_outlook(roi) -> Column:
    r = col_of(roi)
    out = None
    for thr, op, text in LEGACY_OUTLOOK:
        cond = (r >= thr) if op == ">=" else (r > thr)
        out = F.when(cond, F.lit(text)) if out is None else out.when(cond, F.lit(text))
    return out.otherwise(F.lit(LEGACY_OUTLOOK_ELSE))


def money0(c) -> Column:
    """``$1,234,567`` -- whole dollars with thousands separators (half-even)."""
    return F.concat(F.lit("$"), F.format_number(F.bround(col_of(c), 0), 0))


def legacy_summary(predicted, market, roi, drivers) -> Column:
    txt = F.when(F.size(drivers) > 0, F.array_join(drivers, ", ")).otherwise(F.lit("mixed property signals"))
    return F.concat(
        F.lit("The property "), legacy_outlook(roi), F.lit(". The model estimate is "), money0(predicted),
        F.lit(" versus a market price of "), money0(market), F.lit(". Key drivers include: "), txt, F.lit("."))


# Texts of the analysis document.
GLOBAL_CONTEXT = ("Model is trained on NYC residential sales data", "Location, size, and building characteristics influence estimated value")
FACTOR_REASONS = {"predicted_price": "Derived from trained ML model using property features", "market_price": "User-provided listing price"}
NO_EXPLANATION = {"summary": "AI explanation unavailable", "opportunity": "N/A", "risks": "N/A", "recommendation": "Hold", "confidence": "Low"}
# Needle in the names of the strongest features -> context sentence, in order; at most three are given.
LEGACY_CONTEXT = (
    ("neighborhood", "Neighborhood is one of the strongest global pricing drivers in the current model."),
    ("bldgarea", "Building area is one of the strongest global pricing drivers in the current model."),
    ("borough", "Borough-level location signal is an important global pricing factor."),
    ("total_units", "Total unit count influences valuation in the current model."),
)
LEGACY_CONTEXT_MOST = 3
# Factor (and needle) -> what stands for a missing value, reason, in order; at most four are given.
LEGACY_FACTORS = (
    ("bldgarea", "0", "Building area is a strong global driver in the model."),
    ("gross_square_feet", "0", "Gross square footage contributes to valuation strength."),
    ("neighborhood", "", "Neighborhood-level signal is one of the strongest global pricing drivers."),
    ("borough", "", "Borough is an important location signal in the model."),
    ("total_units", "0", "Total unit count affects the valuation model."),
)
LEGACY_FACTORS_MOST = 4


def _names_hold(features: Column, needle: str) -> Column:
    return F.exists(features, lambda f: f.contains(needle))


def legacy_context(features: Column) -> Column:
    """At most three sentences for the strongest features (an array of names)."""
    told = F.array(*[F.when(_names_hold(features, n), F.lit(text)) for n, text in LEGACY_CONTEXT])
    return F.slice(F.array_compact(told), 1, LEGACY_CONTEXT_MOST)


def legacy_factors(features: Column, values: dict[str, Column]) -> Column:
    """At most four (factor, value as text, reason) for the strongest features."""
    made = F.array(*[F.when(_names_hold(features, n), F.struct(F.lit(n).alias("factor"), F.coalesce(values[n].cast("string"), F.lit(none)).alias("value"), F.lit(why).alias("reason")))
                     for n, none, why in LEGACY_FACTORS])
    return F.slice(F.array_compact(made), 1, LEGACY_FACTORS_MOST)


def analysis_summary(predicted, market) -> Column:
    """The sentence of the investment block."""
    gap = col_of(predicted) - col_of(market)
    return F.when(gap > 0, F.concat(F.lit("Property appears undervalued by approximately "), money0(gap), F.lit(" based on model analysis."))).otherwise(
        F.concat(F.lit("Property may be overpriced by approximately "), money0(F.abs(gap)), F.lit(" based on model analysis.")))


def analysis_document(df: DataFrame, model_version: str = "spark-1") -> DataFrame:
    """Nested analysis struct (valuation, investment, drivers with context and
    factors, explanation, metadata) from scored rows; ``to_json`` of it is the
    stored document. ``explanation`` is a struct column of the input with any of
    the fields of ``NO_EXPLANATION``; what it lacks has the value given there."""
    kind = df.schema["explanation"].dataType if "explanation" in df.columns else None
    said = {k: F.coalesce(F.col(f"explanation.{k}"), F.lit(v)) if kind is not None and k in kind.fieldNames() else F.lit(v) for k, v in NO_EXPLANATION.items()}
    status = F.when(F.col("explanation").isNotNull(), "ok").otherwise("unavailable") if kind is not None else F.lit("unavailable")
    factors = F.array(*[F.struct(F.lit(c).alias("factor"), F.col(c).alias("value"), F.lit(why).alias("reason")) for c, why in FACTOR_REASONS.items()])
    doc = F.struct(
        F.struct("predicted_price", "market_price", "price_difference", "price_difference_pct",
                 "price_low", "price_high").alias("valuation"),
        F.struct("roi_estimate", "investment_score", "deal_label", said["recommendation"].alias("recommendation"), said["confidence"].alias("confidence"),
                 analysis_summary("predicted_price", "market_price").alias("analysis_summary")).alias("investment_analysis"),
        F.struct(F.col("top_drivers"), F.array(*[F.lit(x) for x in GLOBAL_CONTEXT]).alias("global_context"), factors.alias("explanation_factors")).alias("drivers"),
        F.struct(*[c.alias(k) for k, c in said.items()]).alias("explanation"),
        status.alias("explanation_status"),
        F.struct(F.lit(model_version).alias("model_version")).alias("metadata"),
    )
    return df.withColumn("analysis", doc)


def store_document(analysis: Column) -> Column:
    """A document as the JSON text that is stored."""
    return F.to_json(analysis)


def document_field(doc: Column, path: str, kind: str, default=None) -> Column:
    """A typed field of a stored document (a VARIANT): where the path is absent, null or of
    another kind, the default. So documents of older and newer versions are read alike."""
    v = F.try_variant_get(doc, path, kind)
    return v if default is None else F.coalesce(v, F.lit(default).cast(kind))
