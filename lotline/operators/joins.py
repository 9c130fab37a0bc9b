"""Equi-join operators: dimension joins, semi / anti / full outer joins,
map-with-fallback joins and the spine enrichment (survey 2.4).

Broadcasting is left to AQE (runtime sizes).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotline.operators.clean import dedup_subset


def join_inner(left: DataFrame, right: DataFrame, on: Sequence[str] | Column) -> DataFrame:
    return left.join(right, on, "inner")


def join_keep_matched(left: DataFrame, right: DataFrame, on: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Matched rows only, plus a one-row match-rate report computed in the
    same pass (left join + flag) instead of a second join."""
    flagged = right.select(*on).distinct().withColumn("__m", F.lit(True))
    j = left.join(flagged, list(on), "left")
    report = j.agg(
        F.count(F.lit(1)).alias("rows_in"),
        F.count_if(F.col("__m").isNotNull()).alias("rows_matched"),
        F.avg(F.col("__m").isNotNull().cast("double")).alias("match_rate"),
    )
    matched = left.join(right, list(on), "inner")
    return matched, report


def join_left_dim(fact: DataFrame, dim: DataFrame, on: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Left join to a dimension de-duplicated on the join key first (first
    row under ``order``), so the fact row count cannot grow."""
    d = dedup_subset(dim, list(on), order)
    return fact.join(d, list(on), "left")


def join_semi(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys.select(*on), list(on), "left_semi")


def join_anti_null_safe(df: DataFrame, base: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key is not in ``base``; NULL key parts match NULL
    (pandas merge semantics) via ``<=>``."""
    b = base.select(*[F.col(c).alias(f"__b_{c}") for c in on]).distinct()
    cond = None
    for c in on:
        e = F.col(c).eqNullSafe(F.col(f"__b_{c}"))
        cond = e if cond is None else cond & e
    return df.join(b, cond, "left_anti")


def join_full_outer(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Full outer join with coalesced keys (``USING`` semantics)."""
    return left.join(right, list(on), "full")


def map_join_fallback(df: DataFrame, stats: DataFrame, key: str, value: str, fallback: Column,
                      out: str) -> DataFrame:
    """Look up ``key -> value`` from a small stats table; unknown keys get the
    fallback (typically a global statistic as a scalar subquery)."""
    s = stats.select(F.col(key).alias("__k"), F.col(value).alias("__v"))
    j = df.join(s, df[key] == F.col("__k"), "left")
    return j.withColumn(out, F.coalesce(F.col("__v"), fallback)).drop("__k", "__v")


def enrich_spine(spine: DataFrame, sides: Sequence[tuple[DataFrame, Sequence[str]]], unique: bool = False) -> DataFrame:
    """Left-join feature tables onto the spine on their keys.

    Each side is made unique on its keys first (first row under an order of
    all its columns, deterministic), so the spine row count is preserved.
    ``unique``: the sides are unique by construction (as-of results are), and
    that shuffle is left out.
    """
    out = spine
    for side, on in sides:
        on = list(on)
        rest = [c for c in side.columns if c not in on]
        if not unique:
            side = dedup_subset(side, on, [F.col(c) for c in rest]) if rest else side.distinct()
        out = out.join(side, on, "left")
    return out
