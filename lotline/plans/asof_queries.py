"""Registered as-of queries (survey 2.4) on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotline.operators import asof
from lotline.plans import bindings as B
from lotline.plans.registry import register

_DEEDS = B.documents_sql("deeds", "F")

ASOF_EVENT_HISTORY_SQL = B.with_ctes(B.SPINE_SQL, _DEEDS) + """,
keys AS (SELECT DISTINCT bbl, as_of_date FROM spine),
m AS (
  SELECT k.bbl, k.as_of_date, d.document_date, d.document_amt, d.buyer_name, d.seller_name,
         row_number() OVER (PARTITION BY k.bbl, k.as_of_date
                            ORDER BY d.document_date DESC, d.document_id DESC) AS rn,
         count(*) OVER (PARTITION BY k.bbl, k.as_of_date) AS n
  FROM keys k JOIN deeds d ON d.bbl = k.bbl AND CAST(d.document_date AS DATE) < k.as_of_date)
SELECT k.bbl, k.as_of_date, COALESCE(m.n, 0) AS deed_cnt,
       m.document_date AS deed_last_date, m.document_amt AS deed_last_document_amt,
       m.buyer_name AS deed_last_buyer_name, m.seller_name AS deed_last_seller_name,
       date_sub('day', m.document_date, CAST(k.as_of_date AS TIMESTAMP)) AS deed_days_since_last
FROM keys k LEFT JOIN m ON m.bbl = k.bbl AND m.as_of_date = k.as_of_date AND m.rn = 1
"""


@register("asof_event_history", ASOF_EVENT_HISTORY_SQL)
def q_asof_event_history(spark, sf):
    return asof.asof_event_history(
        B.sale_keys(spark, sf),
        B.documents(spark, sf, "F"),
        carry=("document_amt", "buyer_name", "seller_name"),
        prefix="deed",
    )


ASOF_LATEST_VERSION_SQL = B.with_ctes(B.SPINE_SQL, B.TAX_ROLLS_SQL) + """,
keys AS (SELECT DISTINCT bbl, as_of_date FROM spine),
m AS (
  SELECT k.bbl, k.as_of_date, t.year, t.curacttot, t.curmkttot, t.units,
         row_number() OVER (PARTITION BY k.bbl, k.as_of_date ORDER BY t.year DESC) AS rn
  FROM keys k JOIN tax_rolls t ON t.bbl = k.bbl AND make_date(t.year, 1, 1) <= k.as_of_date)
SELECT k.bbl, k.as_of_date, m.year AS roll_year, m.curacttot AS roll_curacttot,
       m.curmkttot AS roll_curmkttot, m.units AS roll_units
FROM keys k LEFT JOIN m ON m.bbl = k.bbl AND m.as_of_date = k.as_of_date AND m.rn = 1
"""

PERIOD_RANK = {"FINAL": 3, "ACTUAL": 2, "TENTATIVE": 1}


def period_rank(c):
    return (
        F.when(F.upper(F.col(c)) == "FINAL", 3)
        .when(F.upper(F.col(c)) == "ACTUAL", 2)
        .when(F.upper(F.col(c)) == "TENTATIVE", 1)
        .otherwise(0)
    )


@register("asof_latest_version", ASOF_LATEST_VERSION_SQL)
def q_asof_latest_version(spark, sf):
    return asof.asof_latest_version(
        B.sale_keys(spark, sf),
        B.tax_rolls(spark, sf),
        order=[period_rank("period"), F.col("curacttot"), F.col("curmkttot")],
        carry=("curacttot", "curmkttot", "units"),
        prefix="roll",
    )


ASOF_CUMULATIVE_SQL = B.with_ctes(B.SPINE_SQL, B.ABATEMENTS_SQL) + """,
keys AS (SELECT DISTINCT bbl, as_of_date FROM spine),
m AS (
  SELECT k.bbl, k.as_of_date, a.*,
         row_number() OVER (PARTITION BY k.bbl, k.as_of_date ORDER BY a.tax_year DESC, a.row_id DESC) AS rn,
         sum(a.abatement) OVER (PARTITION BY k.bbl, k.as_of_date) AS tot,
         min(a.init_year) OVER (PARTITION BY k.bbl, k.as_of_date) AS earliest
  FROM keys k JOIN abatements a ON a.bbl = k.bbl AND a.tax_year < year(k.as_of_date))
SELECT k.bbl, k.as_of_date, m.tax_year AS j51_last_tax_year, m.abatement AS j51_last_abatement,
       m.init_year AS j51_last_init_year, m.expiry_year AS j51_last_expiry_year,
       round(m.tot, 4) AS j51_total_abatement, m.earliest AS j51_earliest_init_year,
       CASE WHEN m.expiry_year IS NOT NULL THEN CAST(m.expiry_year >= year(k.as_of_date) AS INTEGER) END AS j51_active_flag
FROM keys k LEFT JOIN m ON m.bbl = k.bbl AND m.as_of_date = k.as_of_date AND m.rn = 1
"""


@register("asof_cumulative", ASOF_CUMULATIVE_SQL)
def q_asof_cumulative(spark, sf):
    out = asof.asof_cumulative(B.sale_keys(spark, sf), B.abatements(spark, sf))
    return out.withColumn("j51_total_abatement", F.round("j51_total_abatement", 4))


_SNAP_SQL = """snaps AS (
  SELECT borough, neighborhood, segment, sale_date AS snapshot_date,
         count(*) AS n_sales, max(sales_price) AS max_price
  FROM spine GROUP BY borough, neighborhood, segment, sale_date)"""


def _snapshot_sql(max_age: int | None) -> str:
    age = "" if max_age is None else f" AND s.snapshot_date >= r.as_of_date - {max_age}"
    return B.with_ctes(B.SPINE_SQL, _SNAP_SQL) + f""",
req AS (SELECT DISTINCT borough, neighborhood, segment, as_of_date FROM spine),
m AS (
  SELECT r.*, s.snapshot_date, s.n_sales, s.max_price,
         row_number() OVER (PARTITION BY r.borough, r.neighborhood, r.segment, r.as_of_date
                            ORDER BY s.snapshot_date DESC) AS rn
  FROM req r JOIN snaps s ON s.borough = r.borough AND s.neighborhood = r.neighborhood
   AND s.segment = r.segment AND s.snapshot_date <= r.as_of_date{age})
SELECT r.borough, r.neighborhood, r.segment, r.as_of_date, m.snapshot_date AS snap_date,
       m.n_sales AS snap_n_sales, m.max_price AS snap_max_price
FROM req r LEFT JOIN m ON m.borough = r.borough AND m.neighborhood = r.neighborhood
  AND m.segment = r.segment AND m.as_of_date = r.as_of_date AND m.rn = 1
"""


def _snapshots(spark, sf):
    sp = B.spine(spark, sf)
    snaps = sp.groupBy("borough", "neighborhood", "segment", F.col("sale_date").alias("snapshot_date")).agg(
        F.count(F.lit(1)).alias("n_sales"), F.max("sales_price").alias("max_price")
    )
    return sp, snaps


@register("asof_latest_snapshot", _snapshot_sql(None))
def q_asof_latest_snapshot(spark, sf):
    sp, snaps = _snapshots(spark, sf)
    return asof.asof_latest_snapshot(sp, snaps, ["borough", "neighborhood", "segment"],
                                     carry=("n_sales", "max_price"))


@register("asof_latest_snapshot_max_age", _snapshot_sql(30))
def q_asof_latest_snapshot_max_age(spark, sf):
    sp, snaps = _snapshots(spark, sf)
    return asof.asof_latest_snapshot(sp, snaps, ["borough", "neighborhood", "segment"],
                                     carry=("n_sales", "max_price"), max_age_days=30)
