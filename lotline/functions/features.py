"""Row-level feature derivations (section 2.2 of the survey)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotline.functions.util import clip, col_of

# Fixed values used by the valuation features.
REFERENCE_YEAR = 2024
DEFAULT_AGE_YEARS = 20            # age used when year built is unknown (evaluation)
LOG_TARGET_CLIP = (0.0, 20.7)     # log-space clip before expm1
BOROUGH_NAMES = {1: "Manhattan", 2: "Bronx", 3: "Brooklyn", 4: "Queens", 5: "Staten Island"}

# Building class -> model segment ("global" otherwise).
SEGMENT_MAP = {
    "01 ONE FAMILY DWELLINGS": "one_family",
    "02 TWO FAMILY DWELLINGS": "multi_family",
    "03 THREE FAMILY DWELLINGS": "multi_family",
    "07 RENTALS - WALKUP APARTMENTS": "rental_walkup",
    "08 RENTALS - ELEVATOR APARTMENTS": "rental_elevator",
    "09 COOPS - WALKUP APARTMENTS": "condo_coop",
    "10 COOPS - ELEVATOR APARTMENTS": "condo_coop",
    "12 CONDOS - WALKUP APARTMENTS": "condo_coop",
    "13 CONDOS - ELEVATOR APARTMENTS": "condo_coop",
    "15 CONDOS - 2-10 UNIT RESIDENTIAL": "condo_coop",
    "17 CONDO COOPS": "condo_coop",
}
RENTAL_CLASSES = ("07 RENTALS - WALKUP APARTMENTS", "08 RENTALS - ELEVATOR APARTMENTS")
ELEVATOR_RENTAL_CLASS = "08 RENTALS - ELEVATOR APARTMENTS"


def map_with_default(c, mapping: dict, default) -> Column:
    """Dictionary lookup with a default, as a literal map (no join, no UDF)."""
    m = F.create_map(*[x for kv in mapping.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return F.coalesce(m[col_of(c)], F.lit(default))


def segment_of(building_class) -> Column:
    return map_with_default(F.trim(col_of(building_class)), SEGMENT_MAP, "global")


def comp_segment(segment, building_class) -> Column:
    """(segment, class) -> comparable-sales segment, NULL when not covered."""
    seg = col_of(segment)
    bc = F.trim(F.coalesce(col_of(building_class), F.lit("")))
    return (
        F.when(seg == "one_family", F.lit("one_family"))
        .when(seg == "condo_coop", F.lit("condo_coop"))
        .when((seg == "multi_family") & bc.startswith("02"), F.lit("two_family"))
        .when((seg == "multi_family") & bc.startswith("03"), F.lit("three_family"))
    )


def borough_name(code) -> Column:
    return map_with_default(col_of(code), BOROUGH_NAMES, "Unknown")


def property_age_train(year_built, fallback_year=None) -> Column:
    """REFERENCE_YEAR - year (per-row fallback to a second year column), clip 0..200."""
    yr = col_of(year_built)
    if fallback_year is not None:
        yr = F.coalesce(yr, col_of(fallback_year))
    return clip(F.lit(REFERENCE_YEAR) - yr.cast("double"), 0.0, 200.0)


def property_age_eval(year_built) -> Column:
    """Evaluation variant: unknown year -> DEFAULT_AGE_YEARS, no clip."""
    yr = F.coalesce(col_of(year_built).cast("double"), F.lit(float(REFERENCE_YEAR - DEFAULT_AGE_YEARS)))
    return F.lit(float(REFERENCE_YEAR)) - yr


def units_floor1(units) -> Column:
    """Denominator floored at 1 but NULL-preserving (pandas ``clip(lower=1)``)."""
    return clip(col_of(units).cast("double"), lo=1.0)


def per_unit(value, units, fill_value_zero: bool = False, fill_units_one: bool = False) -> Column:
    """value / max(units, 1). Options mirror the two reference variants:
    evaluation fills value NULL -> 0 and units NULL -> 1."""
    v = col_of(value).cast("double")
    if fill_value_zero:
        v = F.coalesce(v, F.lit(0.0))
    u = units_floor1(units)
    if fill_units_one:
        u = F.coalesce(u, F.lit(1.0))
    return v / u


def positive_ratio(num, den) -> Column:
    """num / den only when both are > 0, else NULL."""
    n, d = col_of(num).cast("double"), col_of(den).cast("double")
    return F.when((n > 0) & (d > 0), n / d)


def lot_coverage(bldg_area, lot_area) -> Column:
    """building area / max(lot area, 1) when building area > 0."""
    b, lt = col_of(bldg_area).cast("double"), col_of(lot_area).cast("double")
    return F.when((b > 0) & lt.isNotNull(), b / F.when(lt < 1, F.lit(1.0)).otherwise(lt))


def footprint(front, depth) -> Column:
    f, d = col_of(front).cast("double"), col_of(depth).cast("double")
    return F.when((f > 0) & (d > 0), f * d)


def stabilisation_ratio(stab_units, total_units) -> Column:
    """stabilised / total units; missing -> 0; clipped to [0, 1]."""
    r = F.try_divide(col_of(stab_units).cast("double"), col_of(total_units).cast("double"))
    return clip(F.coalesce(r, F.lit(0.0)), 0.0, 1.0)


def fill_units(own, fallback) -> Column:
    o = col_of(own).cast("double")
    return F.when(o > 0, o).otherwise(col_of(fallback).cast("double"))


def is_elevator(building_class) -> Column:
    return F.when(F.trim(col_of(building_class)) == ELEVATOR_RENTAL_CLASS, 1).otherwise(0)


def route_count(routes) -> Column:
    """Number of whitespace-separated route names."""
    parts = F.split(F.trim(F.coalesce(col_of(routes).cast("string"), F.lit(""))), r"\s+")
    return F.size(F.filter(parts, lambda x: x != ""))


def cbd_flag(text) -> Column:
    return F.lower(F.trim(col_of(text).cast("string"))).isin("true", "1", "yes")


def log_target(c) -> Column:
    return F.log1p(col_of(c))


def inverse_log_target(c) -> Column:
    lo, hi = LOG_TARGET_CLIP
    return F.expm1(F.least(F.greatest(col_of(c), F.lit(lo)), F.lit(hi)))


def expiry_year(init_year, exempt_years) -> Column:
    return col_of(init_year) + col_of(exempt_years)
