"""The sales spine from raw sale files in one plan: types, residential filter,
validity, caps and floors, keys, de-duplication, with the rows of every step counted
on the way (``DataFrame.observe``), not by passes of their own.

Two exact quantiles (all prices; prices of each rental class) need the rows that
come before them, so the rows are written once before each of them and once at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lotline.functions.coerce import norm_text, to_double
from lotline.functions.features import SEGMENT_MAP, segment_of
from lotline.functions.keys import parcel_key_text
from lotline.operators.clean import cap_global_quantile, cap_group_quantile, dedup_subset, filter_in_set, filter_valid_sale, floor_per_unit
from lotline.session import discard, materialize

RENTAL_CLASSES = tuple(c for c, s in SEGMENT_MAP.items() if s.startswith("rental_"))
GLOBAL_CAP, RENTAL_CAP = 0.99, 0.95
NUMBERS = ("sales_price", "year_built", "gross_sqft", "land_sqft", "total_units", "residential_units")
SPINE_COLUMNS = ("bbl", "sale_date", "as_of_date", "borough", "block", "lot", "neighborhood", "building_class", "segment", "year_built", "sales_price",
                 "gross_sqft", "land_sqft", "total_units", "residential_units", "file_type")
STEPS = ("raw", "residential", "valid", "below_global_cap", "above_rental_floor", "below_rental_cap", "unique")


def build_spine(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spine, funnel) of raw sales: texts as read, ``borough`` the number of the file's
    borough, ``file_type``. Of rows equal in (bbl, sale_date, sales_price) one
    stays: from a current file rather than a historical one, then by all its other
    columns. ``funnel``: step, stage, rows."""
    spark = raw.sparkSession
    seen: dict[str, Observation] = {}

    def counted(df: DataFrame, stage: str) -> DataFrame:
        seen[stage] = Observation(f"spine-{stage}")
        return df.observe(seen[stage], F.count(F.lit(1)).alias("rows"))

    day = F.to_date(F.try_to_timestamp(F.col("sale_date").cast("string"))).alias("sale_date")
    others = [c for c in raw.columns if c not in (*NUMBERS, "sale_date", "building_class")]
    typed = counted(raw, "raw").select(*others, norm_text("building_class").alias("building_class"), day, *[to_double(c).alias(c) for c in NUMBERS])
    homes = counted(filter_in_set(typed, "building_class", list(SEGMENT_MAP)), "residential")
    valid = materialize(counted(filter_valid_sale(homes), "valid"), "spine-valid")
    capped = counted(cap_global_quantile(valid, "sales_price", GLOBAL_CAP), "below_global_cap")
    floored = materialize(counted(floor_per_unit(capped, classes=RENTAL_CLASSES), "above_rental_floor"), "spine-floored")
    rental = F.col("building_class").isin(*RENTAL_CLASSES)
    rest = floored.where(~rental).unionByName(cap_group_quantile(floored.where(rental), ["building_class"], "sales_price", RENTAL_CAP))
    keyed = counted(rest, "below_rental_cap").withColumns({
        "bbl": parcel_key_text("borough", "block", "lot"), "segment": segment_of("building_class"), "as_of_date": F.date_sub("sale_date", 1),
        "block": F.coalesce(to_double("block").cast("bigint"), F.lit(0)), "lot": F.coalesce(to_double("lot").cast("bigint"), F.lit(0))})
    order = [F.col(c) for c in ("file_type", *[c for c in SPINE_COLUMNS if c not in ("bbl", "sale_date", "sales_price", "file_type")])]
    unique = counted(dedup_subset(keyed.select(*SPINE_COLUMNS), ["bbl", "sale_date", "sales_price"], order), "unique")
    spine = materialize(unique, "spine")
    for done in (valid, floored):
        discard(done)
    rows = [(i, s, int(seen[s].get["rows"])) for i, s in enumerate(STEPS)]
    return spine, spark.createDataFrame(rows, "step int, stage string, rows long")
