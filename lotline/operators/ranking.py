"""Latest-per-key, time folds and splits, ordering, top-k, paging, the
portfolio view and per-metric winners (survey 2.6, 2.7)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the evaluation protocol.
MIN_TEST_ROWS = 50
N_TEST_YEARS = 3
GAP_DAYS = 30


def latest_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Newest row per key under ``order`` (descending recency first field).

    A grouped ``max_by`` over a struct of the remaining columns: partial
    aggregation keeps only the current best row per key on each map task, so
    duplicated hot keys are reduced before the shuffle (no window sort).
    """
    key = list(key)
    rest = [c for c in df.columns if c not in key]
    agg = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return agg.select(*key, *[F.col(f"__r.{c}").alias(c) for c in rest])


def build_folds(df: DataFrame, date_col: str, group: Sequence[str] = (), min_rows: int = MIN_TEST_ROWS,
                n_test: int = N_TEST_YEARS, gap_days: int = GAP_DAYS) -> DataFrame:
    """Rolling-origin folds per group: the last ``n_test`` calendar years with
    >= ``min_rows`` rows are test years; training runs from Jan 1 of the first
    such year to Dec 31 of the year before the test year; testing starts
    ``gap_days`` + 1 days later and ends Dec 31 of the test year. Folds whose
    training window would be empty are dropped.

    Works on the (group, year) count table only -- a few rows per group.
    """
    group = list(group)
    yc = df.groupBy(*group, F.year(F.col(date_col)).alias("test_year")).agg(F.count(F.lit(1)).alias("n"))
    valid = yc.where(F.col("n") >= min_rows)
    wg = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1))
    valid = valid.withColumn("__first", F.min("test_year").over(wg)).withColumn(
        "__rk", F.row_number().over(wg.orderBy(F.desc("test_year"))))
    sel = valid.where(F.col("__rk") <= n_test)
    sel = sel.withColumn("fold", F.row_number().over(wg.orderBy("test_year")))
    train_end = F.make_date(F.col("test_year") - 1, F.lit(12), F.lit(31))
    out = sel.select(
        *group, "fold", "test_year",
        F.make_date(F.col("__first"), F.lit(1), F.lit(1)).alias("train_start"),
        train_end.alias("train_end"),
        F.date_add(train_end, gap_days + 1).alias("test_start"),
        F.make_date(F.col("test_year"), F.lit(12), F.lit(31)).alias("test_end"),
    )
    return out.where(F.col("train_end") >= F.col("train_start"))


def assign_folds(df: DataFrame, folds: DataFrame, date_col: str, group: Sequence[str] = ()) -> DataFrame:
    """Rows x folds with a role (train / test); rows outside both windows of a
    fold (the gap, later years) are not emitted for that fold. Folds are
    spread over the calendar years that they cover and met by (group, year)."""
    group = list(group)
    years = F.sequence(F.year("train_start"), F.year("test_end"))
    by_year = folds.withColumn("__year", F.explode(years))
    d = F.col(date_col)
    j = df.withColumn("__year", F.year(d)).join(by_year, [*group, "__year"], "inner").drop("__year")
    role = (F.when(d.between(F.col("train_start"), F.col("train_end")), "train")
            .when(d.between(F.col("test_start"), F.col("test_end")), "test"))
    return j.withColumn("role", role).where(F.col("role").isNotNull())


def time_split(df: DataFrame, date_col: str, train_end: str, test_start: str, out: str = "split") -> DataFrame:
    d = F.col(date_col)
    return df.withColumn(out, F.when(d <= F.lit(train_end).cast("date"), "train")
                         .when(d >= F.lit(test_start).cast("date"), "test").otherwise("gap"))


def hash_split(df: DataFrame, id_col: str, train_pct: int = 80, seed: int = 42, out: str = "in_train") -> DataFrame:
    """Reproducible random split into hundredths by one step of a modular
    generator on the id (64-bit integer arithmetic that any engine repeats);
    ids that aren't whole numbers go by their hash."""
    kind = df.schema[id_col].dataType.typeName()
    c = F.col(id_col) if kind in ("byte", "short", "integer", "long") else F.xxhash64(id_col)
    mixed = F.pmod(F.pmod(c.cast("long"), F.lit(1 << 31)) * 48271 + seed * 69621, F.lit((1 << 31) - 1))
    return df.withColumn(out, F.pmod(F.floor(mixed / 100), F.lit(100)) < train_pct)


def sort_multi(df: DataFrame, cols: Sequence[str], descending: Sequence[str] = ()) -> DataFrame:
    """Stable multi-column sort with NULLs last in both directions."""
    desc = set(descending)
    return df.orderBy(*[F.col(c).desc_nulls_last() if c in desc else F.col(c).asc_nulls_last() for c in cols])


def topk(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """Top-n report (TakeOrderedAndProject: per-partition top-n, then merge)."""
    return df.orderBy(*order).limit(n)


def page(df: DataFrame, order: Sequence[str], offset: int = 0, limit: int = 100, max_limit: int = 100) -> DataFrame:
    """Offset/limit paging with an explicit order (limit capped at ``max_limit``)."""
    return df.orderBy(*order).offset(offset).limit(min(limit, max_limit))


def portfolio_view(df: DataFrame, label: str | None = None, sort: str = "saved_desc") -> DataFrame:
    """Saved analyses filtered by deal label and ordered like the portfolio
    page: saved date desc (fallback id desc), score desc/asc (NULL as -1 /
    101), ROI desc (NULL last), predicted price desc (NULL as 0)."""
    out = df
    if label:
        out = out.where(F.col("analysis.investment_analysis.deal_label") == label)
    score = F.col("analysis.investment_analysis.investment_score")
    orders = {
        "saved_desc": [F.col("created_at").desc_nulls_last(), F.col("id").desc()],
        "score_desc": [F.coalesce(score, F.lit(-1)).desc(), F.col("id").desc()],
        "score_asc": [F.coalesce(score, F.lit(101)).asc(), F.col("id").desc()],
        "roi_desc": [F.col("analysis.investment_analysis.roi_estimate").desc_nulls_last(), F.col("id").desc()],
        "predicted_desc": [F.coalesce(F.col("analysis.valuation.predicted_price"), F.lit(0.0)).desc(), F.col("id").desc()],
    }
    return out.orderBy(*orders[sort])


# How many saved analyses a role may compare.
COMPARE_LIMITS = {"paid": 10, "admin": 10}
COMPARE_LIMIT = 2


def limit_selection(df: DataFrame, user: str, order: Sequence[str], role: str) -> DataFrame:
    """The first rows of each user's selection, as many as the user's role may
    compare (a constant for each class of roles, so the rest is pruned before
    the shuffle)."""
    rank = F.row_number().over(Window.partitionBy(user).orderBy(*order))
    parts = None
    for n in sorted({COMPARE_LIMIT, *COMPARE_LIMITS.values()}):
        roles = [r for r, m in COMPARE_LIMITS.items() if m == n]
        mine = F.col(role).isin(roles)
        if n == COMPARE_LIMIT:
            mine = mine | ~F.coalesce(F.col(role).isin(list(COMPARE_LIMITS)), F.lit(False))
        part = df.where(mine).withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")
        parts = part if parts is None else parts.unionByName(part)
    return parts


def compare_best(df: DataFrame, group: str, id_col: str, pos_col: str, metrics: dict[str, str]) -> DataFrame:
    """Winner id per group and metric (``max`` or ``min``), NULLs ignored,
    first position wins ties. Long form: (group, metric, winner_id, value)."""
    long = df.unpivot([group, id_col, pos_col], list(metrics), "metric", "value").where(F.col("value").isNotNull())
    sign = F.create_map(*[x for m, how in metrics.items() for x in (F.lit(m), F.lit(1.0 if how == "max" else -1.0))])
    long = long.withColumn("__s", sign[F.col("metric")] * F.col("value"))
    best = long.groupBy(group, "metric").agg(
        F.max_by(F.struct(F.col(id_col), F.col("value")), F.struct(F.col("__s"), -F.col(pos_col), -F.col(id_col))).alias("__b"))
    return best.select(group, "metric", F.col(f"__b.{id_col}").alias("winner_id"), F.col("__b.value").alias("value"))


def distinct_in_order(arr: Column) -> Column:
    """Order-preserving de-duplication of an array column."""
    return F.array_distinct(arr)
