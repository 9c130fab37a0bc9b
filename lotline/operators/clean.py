"""Row-quality rules, quantile caps and bands, de-duplication (survey 2.3).

Quantile thresholds are exact linear-interpolated quantiles (like pandas
``quantile``) computed with bounded memory per group (``quantiles``) and applied by
a join on the group key (AQE broadcasts the per-group table when it is small)
or, for a single global threshold, by a scalar subquery. No operator here
windows over a whole group, so a hot group is never pulled into one task as
rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotline.functions.util import col_of
from lotline.operators.quantiles import exact_quantiles, exact_quantiles_with_global

# Fixed values of the cleaning rules.
PRICE_FLOOR = 1_000
YEAR_BUILT_RANGE = (1800, 2026)
RENTAL_FLOOR_PER_UNIT = 30_000
DATE_SANITY_YEARS = (1900, 2030)


def filter_in_set(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    return df.where(F.col(column).isin(list(values)))


def filter_valid_sale(
    df: DataFrame,
    price: str = "sales_price",
    date: str = "sale_date",
    year_built: str | None = "year_built",
    min_price: float = PRICE_FLOOR,
    strict_min: bool = False,
    year_range: tuple[int, int] = YEAR_BUILT_RANGE,
) -> DataFrame:
    """Price >= floor (or > floor), date present, year built in range."""
    p = F.col(price)
    cond = (p > min_price) if strict_min else (p >= min_price)
    cond = cond & F.col(date).isNotNull()
    if year_built is not None:
        y = F.col(year_built)
        cond = cond & y.isNotNull() & y.between(*year_range)
    return df.where(cond)


def quantile_value(df: DataFrame, column: str, q: float) -> Column:
    """Exact (linear-interpolated) quantile of a column as a scalar subquery
    (bounded-memory refinement, see ``quantiles``)."""
    one = df.select(F.lit(1).alias("__g"), F.col(column).alias("__x"))
    return exact_quantiles(one, ["__g"], "__x", {"__q": q}).select("__q").scalar()


def cap_global_quantile(df: DataFrame, column: str, q: float = 0.99) -> DataFrame:
    """Keep rows with ``column <= exact quantile q`` of the whole input."""
    return df.where(F.col(column) <= quantile_value(df, column, q))


def group_quantiles(df: DataFrame, group: Sequence[str], column: str, qs: dict[str, float],
                    drop_null_keys: bool = False) -> DataFrame:
    """One row per group with exact quantiles named by ``qs`` (name -> q)."""
    src = df
    if drop_null_keys:
        for g in group:
            src = src.where(F.col(g).isNotNull())
    return exact_quantiles(src, list(group), column, qs)


def cap_group_quantile(df: DataFrame, group: Sequence[str], column: str, q: float) -> DataFrame:
    """Keep rows with ``column <= quantile q of its group`` (NULL groups form a group)."""
    group = list(group)
    caps = group_quantiles(df, group, column, {"__cap": q})
    caps = caps.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], "__cap")
    cond = [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(group)]
    j = df.join(caps, cond, "inner")
    return j.where(F.col(column) <= F.col("__cap")).select(*df.columns)


def floor_per_unit(
    df: DataFrame,
    price: str = "sales_price",
    units: str = "total_units",
    class_col: str = "building_class",
    classes: Sequence[str] | None = None,
    min_per_unit: float = RENTAL_FLOOR_PER_UNIT,
) -> DataFrame:
    """price / max(units, 1) >= floor, applied to ``classes`` only (all if None).

    A NULL unit count gives a NULL ratio and the row fails the floor.
    """
    u = F.col(units)
    ppu = F.col(price) / F.when(u < 1, F.lit(1.0)).otherwise(u)
    ok = F.coalesce(ppu >= min_per_unit, F.lit(False))
    if classes is None:
        return df.where(ok)
    in_scope = F.coalesce(F.col(class_col).isin(list(classes)), F.lit(False))
    return df.where(~in_scope | ok)


def band_group_quantile(
    df: DataFrame,
    group: str = "neighborhood",
    price: str = "sales_price",
    sqft: str = "gross_sqft",
    lo: float = 0.02,
    hi: float = 0.98,
    min_rows: int = 100,
    inclusive_min: bool = False,
) -> DataFrame:
    """Keep price/sqft within the group's [p_lo, p_hi] (global fallback for
    groups without bounds). Applied only when more than ``min_rows`` rows
    (``>=`` with ``inclusive_min``) have sqft > 0; rows without sqft pass."""
    has = F.col(sqft).isNotNull() & (F.col(sqft) > 0)
    ppsf = F.col(price) / F.col(sqft)
    with_sqft = df.where(has).withColumn("__ppsf", ppsf)
    n_with = df.select(F.count_if(has)).scalar()
    enough = (n_with >= min_rows) if inclusive_min else (n_with > min_rows)
    # group bounds (NULL group keys get none -> global fallback) and global bounds in one pass
    qb = exact_quantiles_with_global(with_sqft, [group], "__ppsf", {"__lo": lo, "__hi": hi})
    bounds = qb.where((F.col("__scope") == "group") & F.col(group).isNotNull()).select(group, "__lo", "__hi")
    glob = qb.where(F.col("__scope") == "all").select(F.col("__lo").alias("__glo"), F.col("__hi").alias("__ghi"))
    j = with_sqft.join(bounds, group, "left")
    lo_c, hi_c = F.coalesce("__lo", glob.select("__glo").scalar()), F.coalesce("__hi", glob.select("__ghi").scalar())
    kept = j.where((F.col("__ppsf") >= lo_c) & (F.col("__ppsf") <= hi_c)).select(*df.columns)
    banded = kept.unionByName(df.where(~F.coalesce(has, F.lit(False))))
    # When too few rows have sqft, the band is not applied at all.
    return banded.where(enough).unionByName(df.where(~enough))


def band_fixed(df: DataFrame, value: Column | str, lo: float, hi: float) -> DataFrame:
    return df.where(col_of(value).between(lo, hi))


def sales_hygiene(
    df: DataFrame,
    price: str = "sales_price",
    sqft: str = "gross_sqft",
    min_price: float | None = None,
    max_price: float | None = None,
    min_ppsqft: float | None = None,
    min_sqft_for_ppsqft: float = 100.0,
) -> DataFrame:
    """Optional price bounds and a price/sqft floor that only applies where
    sqft > ``min_sqft_for_ppsqft`` (unknown or small sqft passes)."""
    out = df
    if min_price is not None:
        out = out.where(F.col(price) >= float(min_price))
    if max_price is not None:
        out = out.where(F.col(price) <= float(max_price))
    if min_ppsqft is not None:
        s = F.col(sqft)
        ppsqft = F.when(s > min_sqft_for_ppsqft, F.col(price) / s)
        out = out.where(ppsqft.isNull() | (ppsqft >= float(min_ppsqft)))
    return out


def filter_date_sanity(df: DataFrame, column: str, years: tuple[int, int] = DATE_SANITY_YEARS) -> DataFrame:
    y = F.year(F.col(column))
    return df.where(F.col(column).isNotNull() & y.between(*years))


def filter_valid_coords(df: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    la, lo = F.col(lat).try_cast("double"), F.col(lon).try_cast("double")
    return df.where(la.isNotNull() & lo.isNotNull() & (la != 0) & (lo != 0))


def filter_required(df: DataFrame, required: Sequence[str], age_col: str | None = None,
                    age_range: tuple[float, float] = (0, 300)) -> DataFrame:
    """Drop rows missing any required column; age in [lo, hi)."""
    out = df.dropna(subset=[c for c in required if c in df.columns])
    if age_col is not None and age_col in df.columns:
        out = out.where((F.col(age_col) >= age_range[0]) & (F.col(age_col) < age_range[1]))
    return out


def gate_min_rows(df: DataFrame, group: Sequence[str], min_rows: int) -> DataFrame:
    """Groups with at least ``min_rows`` rows (grouped count + having)."""
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") >= min_rows)


def suspicious_rows(df: DataFrame, price: str = "sales_price", sqft: str = "gross_sqft",
                    order_by: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """Rows with price <= 100 (NULL counts as 0) or without sqft, tagged by reason."""
    cheap = F.coalesce(F.col(price), F.lit(0.0)) <= 100
    nosqft = F.col(sqft).isNull()
    out = df.where(cheap | nosqft).withColumn(
        "reason", F.when(cheap, F.lit("low_price")).otherwise(F.lit("missing_sqft"))
    )
    if limit is not None:
        out = out.orderBy(*order_by).limit(limit)
    return out


def dedup_full_row(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Drop exact duplicates, ignoring surrogate columns such as a unique id."""
    cols = [c for c in df.columns if c not in set(exclude)]
    if not exclude:
        return df.distinct()
    w = Window.partitionBy(*cols).orderBy(*[F.col(c).asc_nulls_last() for c in exclude])
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def dedup_subset(df: DataFrame, subset: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Keep one row per ``subset`` key: the first under an explicit ``order``.

    Implemented as ``min_by`` over a struct of all columns in a grouped
    aggregation, so a duplicated key is reduced map-side, not windowed.
    """
    rest = [c for c in df.columns if c not in set(subset)]
    ordk = F.struct(*order)
    agg = df.groupBy(*subset).agg(F.min_by(F.struct(*rest), ordk).alias("__r"))
    return agg.select(*subset, *[F.col(f"__r.{c}").alias(c) for c in rest]).select(*df.columns)


def validate_rows(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """Attach ``errors`` (array of broken-rule names) and ``is_valid``.

    ``rules``: (name, Column that is TRUE when the rule is broken).
    """
    errs = F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(n)) for n, broken in rules]))
    return df.withColumn("errors", errs).withColumn("is_valid", F.size("errors") == 0)


REQUEST_RULE_NAMES = [
    "year_built_range", "gross_sqft_positive", "land_sqft_nonnegative", "total_units_nonnegative",
    "residential_units_nonnegative", "latitude_range", "longitude_range", "borough_required",
    "neighborhood_required", "building_class_required",
]


def request_rules(prefix: str = "") -> list[tuple[str, Column]]:
    """Range rules of a valuation request (fixed values of the request schema)."""
    c = lambda n: F.col(prefix + n)
    return [
        ("year_built_range", ~c("year_built").between(1800, 2026) | c("year_built").isNull()),
        ("gross_sqft_positive", ~(c("gross_sqft") > 0) | c("gross_sqft").isNull()),
        ("land_sqft_nonnegative", c("land_sqft") < 0),
        ("total_units_nonnegative", c("total_units") < 0),
        ("residential_units_nonnegative", c("residential_units") < 0),
        ("latitude_range", ~c("latitude").between(40.0, 41.5)),
        ("longitude_range", ~c("longitude").between(-75.0, -73.0)),
        ("borough_required", F.coalesce(F.length(F.trim(c("borough").cast("string"))), F.lit(0)) == 0),
        ("neighborhood_required", F.coalesce(F.length(F.trim(c("neighborhood"))), F.lit(0)) == 0),
        ("building_class_required", F.coalesce(F.length(F.trim(c("building_class"))), F.lit(0)) == 0),
    ]


# Fixed values of the explanation schema.
EXPLANATION_TEXTS = ("summary", "opportunity", "risks")
EXPLANATION_LENGTH = 600
EXPLANATION_LABELS = {"recommendation": ("Buy", "Hold", "Avoid"), "confidence": ("Low", "Medium", "High")}


def explanation_rules(prefix: str = "") -> list[tuple[str, Column]]:
    """Rules of a written explanation: texts present and not too long, labels
    exactly one of theirs."""
    rules = []
    for name in EXPLANATION_TEXTS:
        c = F.col(prefix + name)
        rules += [(f"{name}_required", c.isNull()), (f"{name}_length", F.char_length(c) > EXPLANATION_LENGTH)]
    for name, labels in EXPLANATION_LABELS.items():
        rules.append((f"{name}_label", ~F.coalesce(F.col(prefix + name).isin(list(labels)), F.lit(False))))
    return rules


def filter_optional(df: DataFrame, **conds) -> DataFrame:
    """Apply only the filters that are given (``None`` means not given).

    Keys: ``<col>`` (equality), ``min_<col>`` (>=), ``max_<col>`` (<=).
    A value of 0 is a real bound, not "not given".
    """
    out = df
    for k, v in conds.items():
        if v is None:
            continue
        if k.startswith("min_"):
            out = out.where(F.col(k[4:]) >= v)
        elif k.startswith("max_"):
            out = out.where(F.col(k[4:]) <= v)
        else:
            out = out.where(F.col(k) == v)
    return out


def filter_row_owner(df: DataFrame, caller_id, is_admin: bool, owner_col: str = "user_id") -> DataFrame:
    """Non-admin callers see only their own rows; admins see all rows."""
    return df if is_admin else df.where(F.col(owner_col) == caller_id)


def visible_rows(df: DataFrame, callers: DataFrame, owner_col: str = "user_id",
                 caller_col: str = "caller_id") -> DataFrame:
    """Batch form for many non-admin callers: an equi-join on ownership."""
    return df.join(callers, df[owner_col] == callers[caller_col], "inner")
