"""Grouped statistics, profiles and evaluation metrics (survey 2.5).

All are grouped aggregations (partial aggregation map-side, one shuffle on
the group key) or grouping sets; medians / percentiles are exact (``quantiles``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotline.operators.quantiles import exact_quantiles, exact_quantiles_with_global


def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str], var: str = "feature",
            val: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(values), var, val)


def first_by_order_pivot(df: DataFrame, key: str, type_col: str, value: str, order: str,
                         types: dict[str, object]) -> DataFrame:
    """Per key, the first non-NULL ``value`` under ``order`` for each type,
    as wide columns named by ``types`` (name -> type value)."""
    aggs = []
    for name, t in types.items():
        cond = (F.col(type_col) == F.lit(t)) & F.col(value).isNotNull()
        aggs.append(F.min(F.when(cond, F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))["v"].alias(name))
    return df.groupBy(key).agg(*aggs)


def median_by(df: DataFrame, group: Sequence[str], columns: Sequence[str], with_global: bool = True) -> DataFrame:
    """Medians of several columns per group plus a global row, in long form:
    (scope, group..., feature, median)."""
    group = list(group)
    long = df.unpivot(group, [F.col(c).cast("double").alias(c) for c in columns], "feature", "__x")  # all columns in one reading
    scopes = F.array(F.lit("group"), F.lit("global")) if with_global else F.array(F.lit("group"))
    kept = lambda c: F.when(F.col("scope") == "group", F.col(c)).alias(c)
    long = long.withColumn("scope", F.explode(scopes)).select("scope", *[kept(c) for c in group], "feature", "__x")
    return exact_quantiles(long, ["scope", *group, "feature"], "__x", {"median": 0.5})


def fit_group_stats(train: DataFrame, group: str, columns: dict[str, str]) -> DataFrame:
    """Stats fitted on training rows only: per group and a global row
    (``group`` NULL, ``is_global``) with medians named by ``columns``."""
    names = list(columns)
    long = train.select(F.col(group), F.explode(F.array(*[
        F.struct(F.lit(n).alias("__f"), F.col(src).cast("double").alias("__x")) for n, src in columns.items()
    ])).alias("__e")).select(group, "__e.__f", "__e.__x")
    per = exact_quantiles(long.where(F.col(group).isNotNull()), [group, "__f"], "__x", {"__m": 0.5})
    per = per.groupBy(group).pivot("__f", names).agg(F.first("__m")).withColumn("is_global", F.lit(False))
    glob = exact_quantiles(long, ["__f"], "__x", {"__m": 0.5}).groupBy().pivot("__f", names).agg(F.first("__m"))
    glob = glob.withColumn(group, F.lit(None).cast(train.schema[group].dataType)).withColumn("is_global", F.lit(True))
    return per.unionByName(glob)


def apply_group_stats(df: DataFrame, stats: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """Attach fitted stats: group value, else the global value."""
    per = stats.where(~F.col("is_global")).select(F.col(group).alias("__g"), *[F.col(c).alias(f"__s_{c}") for c in columns])
    glob = stats.where(F.col("is_global"))
    j = df.join(per, df[group] == F.col("__g"), "left")
    for c in columns:
        j = j.withColumn(c, F.coalesce(F.col(f"__s_{c}"), glob.select(c).scalar()))
    return j.drop("__g", *[f"__s_{c}" for c in columns])


def percentile_profile(df: DataFrame, group: Sequence[str], column: Column | str,
                       qs: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95, 0.99), prefix: str = "p") -> DataFrame:
    c = F.col(column) if isinstance(column, str) else column
    src = df.select(*group, c.alias("__x"))
    n = src.groupBy(*group).agg(F.count("__x").alias("n"))
    q = exact_quantiles(src, list(group), "__x", {f"{prefix}{int(round(x * 100))}": x for x in qs})
    cond = [n[g].eqNullSafe(q[g]) for g in group]
    return n.join(q, cond, "left").select(*[n[g] for g in group], "n", *[q[f"{prefix}{int(round(x * 100))}"] for x in qs])


def null_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, null_rate) -- one pass, then unpivot."""
    wide = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    return unpivot(wide, [], list(columns), "feature", "null_rate")


def profile_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per numeric column: count, nulls, mean, sample std, min, quartiles, max
    (long form). One aggregation and one quantile run serve all columns."""
    def stats(c: str) -> Column:
        return F.struct(
            F.lit(c).alias("feature"),
            F.count(c).alias("count"),
            F.count_if(F.col(c).isNull()).alias("nulls"),
            F.avg(c).cast("double").alias("mean"),
            F.stddev_samp(c).cast("double").alias("std"),
            F.min(c).cast("double").alias("min"),
            F.max(c).cast("double").alias("max"),
        )

    one = df.agg(F.array(*[stats(c) for c in columns]).alias("s"))  # one aggregation for all columns
    one = one.select(F.explode("s").alias("s")).select("s.*")
    long = df.unpivot([], [F.col(c).cast("double").alias(c) for c in columns], "__f", "__x")
    quartiles = exact_quantiles(long, ["__f"], "__x", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return one.join(quartiles, one["feature"] == quartiles["__f"], "left").drop("__f")


def value_counts_top(df: DataFrame, column: str, n: int = 20) -> DataFrame:
    """Top-n categories by count (ties by value) -- a top-k report."""
    return df.groupBy(column).count().orderBy(F.desc("count"), F.asc(column)).limit(n)


def stage_funnel(df: DataFrame, stages: Sequence[tuple[str, Column]]) -> DataFrame:
    """Rows remaining after each cumulative cleaning step, in one pass."""
    aggs = [F.count(F.lit(1)).alias("input")]
    cum = F.lit(True)
    for name, cond in stages:
        cum = cum & F.coalesce(cond, F.lit(False))
        aggs.append(F.count_if(cum).alias(name))
    wide = df.agg(*aggs)
    names = ["input"] + [n for n, _ in stages]
    out = wide.unpivot([], names, "stage", "rows")
    order = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
    return out.withColumn("step", order[F.col("stage")])


def regression_metrics(df: DataFrame, y: str, yhat: str, group: str | Sequence[str] | None = None,
                       with_global: bool = True) -> DataFrame:
    """n, MAE, RMSE, R^2 (1 - SSE/SST), median / p90 APE (denominator
    max(y, 1)), hit@10% and hit@25%; globally and per ``group`` in one
    grouping-sets aggregation (group NULL = global row)."""
    e = F.col(yhat) - F.col(y)
    ape = F.abs(e) / F.greatest(F.col(y), F.lit(1.0))
    gcols = [] if group is None else ([group] if isinstance(group, str) else list(group))
    base = df.select(*gcols, F.col(y).alias("__y"), e.alias("__e"), ape.alias("__ape"))
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs("__e")).alias("mae"),
        F.sqrt(F.avg(F.col("__e") * F.col("__e"))).alias("rmse"),
        # a constant target has no R^2 (NULL)
        (F.lit(1.0) - F.try_divide(F.sum(F.col("__e") * F.col("__e")), F.var_pop("__y") * F.count(F.lit(1)))).alias("r2"),
        F.avg((F.col("__ape") <= 0.10).cast("double")).alias("hit_10"),
        F.avg((F.col("__ape") <= 0.25).cast("double")).alias("hit_25"),
    ]
    qs = {"median_ape": 0.5, "p90_ape": 0.9}
    # APE quantiles: exact, bounded memory per group (a global quantile is a group too)
    if not gcols:
        m = base.withColumn("__all", F.lit(1)).groupBy("__all").agg(*aggs)
        q = exact_quantiles(base.withColumn("__all", F.lit(1)), ["__all"], "__ape", qs)
        return m.join(q, "__all", "left").drop("__all")
    if not with_global:
        per = exact_quantiles(base, gcols, "__ape", qs)
        m = base.groupBy(*gcols).agg(*aggs)
        return m.join(per, [m[c].eqNullSafe(per[c]) for c in gcols], "left").select(m["*"], per["median_ape"], per["p90_ape"])
    g = base.rollup(*gcols).agg(*aggs, F.grouping_id().alias("__gid"))
    g = g.where((F.col("__gid") == 0) | (F.col("__gid") == (1 << len(gcols)) - 1))
    g = g.withColumn("scope", F.when(F.col("__gid") == 0, "segment").otherwise("global"))
    both = exact_quantiles_with_global(base, gcols, "__ape", qs)
    qall = both.withColumn("__gid", F.when(F.col("__scope") == "group", F.lit(0)).otherwise(
        F.lit((1 << len(gcols)) - 1))).drop("__scope")
    cond = [g[c].eqNullSafe(qall[c]) for c in gcols] + [g["__gid"] == qall["__gid"]]
    return g.join(qall, cond, "left").select(g["*"], qall["median_ape"], qall["p90_ape"]).drop("__gid")


def fold_summary(metrics: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Mean, population std and worst (min) of a per-fold metric."""
    return metrics.groupBy(*group).agg(
        F.avg(value).alias(f"{value}_mean"),
        F.stddev_pop(value).alias(f"{value}_std"),
        F.min(value).alias(f"{value}_worst"),
        F.count(F.lit(1)).alias("n_folds"),
    )


def lift_vs_baseline(metrics: DataFrame, set_col: str, group: str, value: str, baseline: str) -> DataFrame:
    """Percentage-point change of the average metric vs the baseline set."""
    avg = metrics.groupBy(set_col, group).agg(F.avg(value).alias("__m"))
    base = avg.where(F.col(set_col) == baseline).select(group, F.col("__m").alias("__b"))
    return avg.join(base, group, "left").select(
        set_col, group, F.col("__m").alias(f"avg_{value}"), ((F.col("__m") - F.col("__b")) * 100.0).alias("lift_pp"))


def overfit_gate(train_r2: Column, test_r2: Column, worst_fold_r2: Column, max_gap: float = 0.15,
                 min_worst: float = 0.40) -> Column:
    gap = train_r2 - test_r2
    return F.when((gap <= max_gap) & (worst_fold_r2 >= min_worst), "pass").otherwise("fail")


def promotion_gate(lifts: DataFrame, group: str, lift_pp: str, weight: str, min_gain_pp: float = 3.0,
                   max_loss_pp: float = 5.0, by: Sequence[str] = ()) -> DataFrame:
    """Candidate passes if it improves the dominant group (largest weight) by
    >= ``min_gain_pp`` (lower error => negative lift) and no group worsens by
    more than ``max_loss_pp``. One row: (dominant, dominant_lift, worst_lift, decision)."""
    dom = lifts.groupBy(*by).agg(F.max_by(F.col(group), F.struct(F.col(weight), F.col(group))).alias("dominant"),
                    F.max_by(F.col(lift_pp), F.struct(F.col(weight), F.col(group))).alias("dominant_lift_pp"),
                    F.max(lift_pp).alias("worst_lift_pp"))
    ok = (F.col("dominant_lift_pp") <= -min_gain_pp) & (F.col("worst_lift_pp") <= max_loss_pp)
    return dom.withColumn("decision", F.when(ok, "promote").otherwise("keep"))
