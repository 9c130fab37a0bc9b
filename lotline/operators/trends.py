"""Rolling market trends: exact medians over half-open day windows
(``[d - 365, d)`` and the year before), year-over-year growth, and the trend
grid (one row per as_of date and active neighbourhood).

Window medians come in two ways with the same results. As long as a count shows that
the sales of a group and year (and what its windows reach back to) fit into a task,
day rows with their sorted prices are replicated into the yearly buckets whose windows they can
reach, and one ``applyInPandas`` task reads the windows of a (group, year) as slices. Beyond
``TASK_ROWS`` they are found by counting, without lists and without Python:

1. sales are reduced to (group, day, value, count) by partial aggregation;
2. the values of a group are cut into ``CELLS`` cells at quantiles of a sketch
   (any cuts give exact results; balanced ones need fewer turns). Running sums of the cells' counts
   over the group's days, read at both ends of a window, give the counts of the window's
   cells, and with them the cell that holds the wanted rank;
3. a cell of one value is the answer; the others are cut again, with the values inside them
   alone, until every rank has its value.

A turn is one shuffle by (group, cell) of rows a day, so a group with a third of all sales
costs a calendar's worth of rows; the next turn spreads it over its cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotline.session import discard, materialize

LOOKBACK_DAYS = 365
MIN_TREND_PRICE = 100_000
MIN_GROUP_SIZE = 5
CELLS = 32
TASK_ROWS = 2_000_000

_DAY = "__day"


def day_arrays(sales: DataFrame, group: Sequence[str], day: str, value: str) -> DataFrame:
    """(group..., __day, __vals sorted, __n) -- map-side partial aggregation."""
    return sales.where(F.col(value).isNotNull() & F.col(day).isNotNull()).groupBy(
        *group, F.unix_date(F.col(day)).alias(_DAY)
    ).agg(F.array_sort(F.collect_list(F.col(value))).alias("__vals"), F.count(F.lit(1)).alias("__n"))


def rolling_quantiles(
    sales: DataFrame,
    targets: DataFrame,
    group: Sequence[str],
    sale_day: str,
    value: str,
    target_day: str,
    windows: dict[str, tuple[int, int]],
    q: float = 0.5,
    bucket_days: int = LOOKBACK_DAYS,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """For every target (group..., target_day) and window name -> (start, end)
    days relative to the target day (inclusive, e.g. (-365, -1)): the exact
    q-quantile ``{name}_median`` and the count ``{name}_count`` (0 if empty).

    Where a count shows that the sales of no group and bucket of days (with
    those that its windows reach back to) exceed ``task_rows``, ``_by_day_arrays``; else ``_by_counting``.
    """
    W, reach = int(bucket_days), max(0, -min(lo for lo, _ in windows.values()))
    per_bucket = sales.where(F.col(value).isNotNull()).groupBy(*group, F.floor(F.unix_date(F.col(sale_day)) / W)).agg(F.count(F.lit(1)).alias("n"))
    most = per_bucket.agg(F.max("n")).first()[0] or 0
    if most * (reach // W + 2) <= task_rows:
        return _by_day_arrays(sales, targets, group, sale_day, value, target_day, windows, q, W)
    return _by_counting(sales, targets, group, sale_day, value, target_day, windows, q)


def _by_day_arrays(sales: DataFrame, targets: DataFrame, group: Sequence[str], sale_day: str, value: str, target_day: str, windows: dict[str, tuple[int, int]], q: float, bucket_days: int) -> DataFrame:
    """One task a (group, bucket of days): its days' sorted values side by side, a
    window is a slice of them."""
    group = list(group)
    W = int(bucket_days)
    lo_min = min(lo for lo, _ in windows.values())
    hi_max = max(hi for _, hi in windows.values())
    da = day_arrays(sales, group, sale_day, value)
    # a sale day s can fall in the window of target days [s - hi_max, s - lo_min]:
    # replicate its (already reduced) day row into those targets' time buckets
    da = da.withColumn("__bk", F.explode(F.sequence(
        F.floor((F.col(_DAY) - hi_max) / W).cast("bigint"), F.floor((F.col(_DAY) - lo_min) / W).cast("bigint"))))
    tg = (targets.select(*group, F.col(target_day)).where(F.col(target_day).isNotNull()).distinct()
          .withColumn(_DAY, F.unix_date(F.col(target_day)))
          .withColumn("__bk", F.floor(F.col(_DAY) / W).cast("bigint")))
    u = da.withColumn("__t", F.lit(False)).unionByName(tg.withColumn("__t", F.lit(True)), allowMissingColumns=True)
    u = u.select(*group, "__bk", _DAY, "__t", "__vals", "__n")
    names = list(windows)
    spans = [windows[n] for n in names]
    schema = ", ".join(
        [f"`{g}` {targets.schema[g].dataType.simpleString()}" for g in group]
        + [f"`{_DAY}` int"]
        + [f"`{n}_median` double, `{n}_count` bigint" for n in names]
    )

    def per_bucket(pdf):
        import numpy as np
        import pandas as pd

        t = pdf[pdf["__t"]]
        if t.empty:
            return pd.DataFrame(columns=[*group, _DAY] + [c for n in names for c in (f"{n}_median", f"{n}_count")])
        d = pdf[~pdf["__t"]].sort_values(_DAY)
        days = d[_DAY].to_numpy(dtype=np.int64)
        lens = d["__n"].to_numpy(dtype=np.int64)
        flat = np.concatenate([np.asarray(v, dtype=np.float64) for v in d["__vals"]]) if len(d) else np.zeros(0)
        off = np.concatenate([[0], np.cumsum(lens)])
        tdays = t[_DAY].to_numpy(dtype=np.int64)
        out = {g: t[g].to_numpy() for g in group}
        out[_DAY] = tdays
        for n, (lo, hi) in zip(names, spans):
            a = np.searchsorted(days, tdays + lo, side="left")
            b = np.searchsorted(days, tdays + hi, side="right")
            # the window of a target is the contiguous slice flat[off[a]:off[b]];
            # targets between two sale days share it, so the two ranks around the
            # linear-interpolated quantile are put in place once for each distinct slice
            s, e = off[a], off[b]
            pairs, inv = np.unique(np.stack([s, e], axis=1), axis=0, return_inverse=True)
            vals = np.full(len(pairs), np.nan)
            for j, (ps, pe) in enumerate(pairs):
                if pe > ps:
                    pos = (pe - ps - 1) * q
                    k = int(np.floor(pos))
                    k2 = min(k + 1, pe - ps - 1)
                    w = np.partition(flat[ps:pe], (k, k2))
                    vals[j] = w[k] + (pos - k) * (w[k2] - w[k])
            out[f"{n}_median"] = vals[inv.reshape(-1)]
            out[f"{n}_count"] = e - s
        return pd.DataFrame(out)

    res = u.groupBy(*group, "__bk").applyInPandas(per_bucket, schema)
    cols = [*group, F.date_from_unix_date(F.col(_DAY)).alias(target_day)]
    for n in names:
        cols += [F.when(~F.isnan(f"{n}_median"), F.col(f"{n}_median")).alias(f"{n}_median"), F.col(f"{n}_count")]
    return res.select(*cols)


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]):
    """NULL-safe equality of key columns; ``b`` has them under names with an underscore behind."""
    cond = F.lit(True)
    for c in keys:
        cond = cond & a[c].eqNullSafe(b[f"{c}_"])
    return cond


def _marked(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed({c: f"{c}_" for c in keys})


def _by_counting(sales: DataFrame, targets: DataFrame, group: Sequence[str], sale_day: str, value: str, target_day: str, windows: dict[str, tuple[int, int]], q: float, cells: int = CELLS) -> DataFrame:
    """Without lists and without Python: ranks by running counts of value cells."""
    group, names = list(group), list(windows)
    g = [f"__g{i}" for i in range(len(group))]
    keys = [*g, "pid"]
    state = [*keys, "t", "w", "which"]
    renamed = [F.col(c).alias(k) for c, k in zip(group, g, strict=True)]
    data = sales.where(F.col(value).isNotNull() & F.col(sale_day).isNotNull()).select(
        *renamed, F.lit("").alias("pid"), F.unix_date(F.col(sale_day)).alias("day"), F.col(value).cast("double").alias("v"))
    data = materialize(data.groupBy(*keys, "day", "v").agg(F.count(F.lit(1)).alias("c")), "window-values")
    asked = materialize(targets.select(*renamed, F.unix_date(F.col(target_day)).alias("t")).where("t is not null").distinct(), "window-targets")
    spans = F.explode(F.array(*[F.struct(F.lit(i).alias("w"), F.lit(lo - 1).alias("before"), F.lit(hi).alias("upto")) for i, (lo, hi) in enumerate(windows.values())]))
    at = (asked.select(*g, "t", spans.alias("s")).select(*g, F.lit("").alias("pid"), "t", "s.w", (F.col("t") + F.col("s.before")).alias("before"), (F.col("t") + F.col("s.upto")).alias("upto"))
          .withColumn("which", F.lit(0)).withColumn("k", F.lit(None).cast("long")))
    found, counts = [], None
    while True:
        cut = _cut(data, keys, cells)
        hit = materialize(_window_counts(cut, at, keys, state, cells), "window-counts")
        if counts is None:  # the whole window: its size says which ranks are wanted
            sizes = hit.select(*state, "before", "upto", "upto_cell", F.element_at("upto_cell", -1).alias("n"))
            counts = sizes.select(*g, "t", "w", "n")
            place = (F.col("n") - 1).cast("double") * F.lit(float(q))
            ranks = F.explode(F.array(F.struct(F.lit(0).alias("which"), F.floor(place).alias("k")), F.struct(F.lit(1).alias("which"), F.ceil(place).alias("k")))).alias("r")
            hit = sizes.where("n > 0").select(*keys, "t", "w", "before", "upto", "upto_cell", ranks).select(*keys, "t", "w", "r.which", "before", "upto", "upto_cell", "r.k")
        # the cells that lie wholly before the rank
        hit = hit.withColumn("cell", F.size(F.filter("upto_cell", lambda p: p <= F.col("k"))))
        cell = F.col("cell")
        below = F.when(cell > 0, F.element_at("upto_cell", F.greatest(cell, F.lit(1)))).otherwise(0)
        hit = hit.select(*state, "before", "upto", cell.alias("cell"), (F.col("k") - below).alias("k"))
        ends = _marked(cut.groupBy(*keys, "cell").agg(F.min("v").alias("lo"), F.max("v").alias("hi")), [*keys, "cell"])
        hit = materialize(hit.join(ends, _same(hit, ends, [*keys, "cell"])).select(*hit.columns, "lo", "hi"), "window-state")
        found.append(hit.where("lo = hi").select(*g, "t", "w", "which", F.col("lo").alias("v")))
        inner = F.concat_ws(".", "pid", F.col("cell").cast("string")).alias("pid")
        wide = hit.where("lo < hi")
        at = wide.select(*g, inner, "t", "w", "which", "before", "upto", "k")
        if wide.isEmpty():
            break
        wanted = _marked(at.select(*keys).distinct(), keys)
        rest = cut.select(*g, inner, "day", "v", "c")
        after = materialize(rest.join(wanted, _same(rest, wanted, keys), "left_semi"), "window-values")
        discard(data)
        data = after
    values = found[0]
    for f in found[1:]:
        values = values.unionByName(f)
    got = values.unionByName(counts.withColumn("which", F.lit(-1)).withColumnRenamed("n", "v").withColumn("v", F.col("v").cast("double")))
    nth = lambda i, which: F.max(F.when((F.col("w") == i) & (F.col("which") == which), F.col("v")))
    wide = got.groupBy(*g, "t").agg(*[nth(i, which).alias(f"{n}_{kind}") for i, n in enumerate(names) for kind, which in (("a", 0), ("b", 1), ("n", -1))])
    out = [*[F.col(k).alias(c) for k, c in zip(g, group, strict=True)], F.date_from_unix_date("t").alias(target_day)]
    for n in names:
        place = (F.col(f"{n}_n") - 1) * F.lit(float(q))
        out += [(F.col(f"{n}_a") + (place - F.floor(place)) * (F.col(f"{n}_b") - F.col(f"{n}_a"))).alias(f"{n}_median"),
                F.coalesce(F.col(f"{n}_n").cast("long"), F.lit(0)).alias(f"{n}_count")]
    return wide.select(*out)


def _cut(data: DataFrame, keys: Sequence[str], cells: int) -> DataFrame:
    """Values with the cell that they fall into: cuts at sketched quantiles, and
    before the largest value, so that a cell never holds all that was cut."""
    probs = [i / (cells - 1) for i in range(1, cells - 1)]
    ends = data.groupBy(*keys).agg(F.percentile_approx("v", probs, 2_000).alias("q"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    cuts = F.array_sort(F.array_distinct(F.filter(F.concat("q", F.array("hi")), lambda x: x > F.col("lo"))))
    ends = _marked(ends.select(*keys, cuts.alias("cuts")), keys)
    joined = data.join(ends, _same(data, ends, keys))
    return joined.select(*keys, "day", "v", "c", F.size(F.filter("cuts", lambda x: x <= F.col("v"))).alias("cell"))


def _window_counts(cut: DataFrame, at: DataFrame, keys: Sequence[str], state: Sequence[str], cells: int) -> DataFrame:
    """For every state (keys, t, w, which, days before .. upto, k): ``upto_cell``, the
    running sums of the counts of its window's cells."""
    per_day = cut.groupBy(*keys, "day").agg(*[F.sum(F.when(F.col("cell") == j, F.col("c")).otherwise(0)).alias(f"c{j}") for j in range(cells)])
    ends = F.explode(F.array(F.struct(F.col("before").alias("day"), F.lit(-1).alias("sign")), F.struct(F.col("upto").alias("day"), F.lit(1).alias("sign"))))
    probes = at.select(*state, "before", "upto", "k", ends.alias("e")).select(*state, "before", "upto", "k", "e.day", "e.sign")
    rows = per_day.unionByName(probes, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("day").rangeBetween(Window.unboundedPreceding, 0)
    seen = rows.select(*state, "before", "upto", "k", "sign", *[F.sum(f"c{j}").over(w).alias(f"c{j}") for j in range(cells)]).where("sign is not null")
    number = lambda j: F.sum(F.col("sign") * F.coalesce(F.col(f"c{j}"), F.lit(0)))
    inside = seen.groupBy(*state).agg(F.max("before").alias("before"), F.max("upto").alias("upto"), F.max("k").alias("k"), *[number(j).alias(f"c{j}") for j in range(cells)])
    each = F.array(*[F.col(f"c{j}") for j in range(cells)])
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("out"))
    step = lambda s, c: F.struct((s["at"] + c).alias("at"), F.concat(s["out"], F.array(s["at"] + c)).alias("out"))
    return inside.select(*state, "before", "upto", "k", F.aggregate(each, start, step, lambda s: s["out"]).alias("upto_cell"))


def activity_grid(
    sales: DataFrame,
    dates: DataFrame,
    part: Sequence[str],
    group: Sequence[str],
    sale_day: str,
    date_col: str,
    lookback: int = LOOKBACK_DAYS,
) -> DataFrame:
    """Rows (part..., group..., date) for every date of ``dates`` (per part)
    on which the group has at least one sale in ``[date - lookback, date)``.

    A group's active dates form islands: consecutive sale days closer than
    ``lookback`` merge into one island ``[first + 1, last + lookback]``
    (gaps-and-islands window over distinct sale days). Dates join islands by
    an equi-join on (part, yearly bucket) plus a range filter, so only active
    (date, group) rows are produced -- no calendar x group product.
    """
    part, group = list(part), list(group)
    sd = sales.select(*part, *group, F.unix_date(F.col(sale_day)).alias("__s")).where(F.col("__s").isNotNull()).distinct()
    w = Window.partitionBy(*part, *group).orderBy("__s")
    prev = F.lag("__s").over(w)
    sd = sd.withColumn("__new", F.when(prev.isNull() | (F.col("__s") - prev > lookback), 1).otherwise(0))
    sd = sd.withColumn("__isl", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    isl = sd.groupBy(*part, *group, "__isl").agg(
        (F.min("__s") + 1).alias("__a"), (F.max("__s") + lookback).alias("__b"))
    isl = isl.withColumn("__bk", F.explode(F.sequence(
        F.floor(F.col("__a") / lookback).cast("bigint"), F.floor(F.col("__b") / lookback).cast("bigint"))))
    dd = dates.select(*part, F.col(date_col)).where(F.col(date_col).isNotNull()).distinct().withColumn(
        "__d", F.unix_date(F.col(date_col))).withColumn("__bk", F.floor(F.col("__d") / lookback).cast("bigint"))
    j = dd.join(isl, [*part, "__bk"], "inner").where((F.col("__d") >= F.col("__a")) & (F.col("__d") <= F.col("__b")))
    return j.select(*part, *group, F.col(date_col))


def yoy(cur_median, prev_median, prev_count, min_group: int = MIN_GROUP_SIZE):
    """current / year-ago median - 1; NULL if the year-ago group is thin or <= 0."""
    ok = (F.coalesce(prev_count, F.lit(0)) >= min_group) & (prev_median > 0)
    return F.when(ok, cur_median / prev_median - 1.0)


def trend_grid(
    spine: DataFrame,
    segment: str = "comp_segment",
    borough: str = "borough",
    neighborhood: str = "neighborhood",
    sale_date: str = "sale_date",
    as_of: str = "as_of_date",
    price: str = "sales_price",
    min_price: float = MIN_TREND_PRICE,
    lookback: int = LOOKBACK_DAYS,
) -> DataFrame:
    """One row per (segment, as_of date, borough, neighbourhood) where the
    neighbourhood has a current sale: 365-day median / count, YoY growth of
    the neighbourhood and of the borough. Dates come from all spine rows of
    the segment; medians only from sales >= ``min_price``."""
    sp = spine.where(F.col(segment).isNotNull())
    sales = sp.where(F.col(price) >= min_price).select(segment, borough, neighborhood, sale_date, price)
    dates = sp.select(segment, as_of).distinct()
    windows = {"cur": (-lookback, -1), "prev": (-2 * lookback, -lookback - 1)}
    grid = activity_grid(sales, dates, [segment], [borough, neighborhood], sale_date, as_of, lookback)
    # neighbourhoods and whole boroughs in one run
    scopes = F.explode(F.array(F.lit("neighborhood"), F.lit("borough"))).alias("__scope")
    kept = F.when(F.col("__scope") == "neighborhood", F.col(neighborhood)).alias(neighborhood)
    both = lambda df, *cols: df.select(segment, borough, neighborhood, *cols, scopes).select("__scope", segment, borough, kept, *cols)
    made = rolling_quantiles(both(sales, sale_date, price), both(grid, as_of), ["__scope", segment, borough, neighborhood], sale_date, price, as_of, windows)
    made = materialize(made, "trend-medians")
    nb = made.where("__scope = 'neighborhood'").drop("__scope")
    bo = made.where("__scope = 'borough'").drop("__scope", neighborhood)
    out = nb.join(bo.withColumnsRenamed({c: f"b_{c}" for c in ("cur_median", "cur_count", "prev_median", "prev_count")}),
                  [segment, borough, as_of], "left")
    return out.select(
        segment, as_of, borough, neighborhood,
        F.col("cur_median").alias("nbhd_median_l365"),
        yoy(F.col("cur_median"), F.col("prev_median"), F.col("prev_count")).alias("nbhd_yoy_growth"),
        F.col("cur_count").alias("nbhd_sale_count_l365"),
        F.col("b_cur_median").alias("borough_median_l365"),
        yoy(F.col("b_cur_median"), F.col("b_prev_median"), F.col("b_prev_count")).alias("borough_yoy_growth"),
    )


def window_sums(
    sales: DataFrame, dates: DataFrame, part: Sequence[str], sale_day: str, date_col: str, value: str,
    windows: dict[str, tuple[int, int]],
) -> DataFrame:
    """Per (part..., date): count and sum of ``value`` over each relative day
    window, from day-level pre-aggregates and RANGE frames (the interval
    self-join of every date with its prior sales, without pairing rows)."""
    part = list(part)
    da = sales.groupBy(*part, F.unix_date(F.col(sale_day)).alias(_DAY)).agg(
        F.count(F.lit(1)).alias("__n"), F.sum(F.col(value)).alias("__s")).withColumn("__t", F.lit(False))
    tg = dates.select(*part, F.col(date_col)).distinct().withColumn(_DAY, F.unix_date(F.col(date_col))).withColumn(
        "__t", F.lit(True))
    u = da.unionByName(tg, allowMissingColumns=True)
    base = Window.partitionBy(*part).orderBy(F.col(_DAY))
    cols = [*part, F.col(date_col), F.col("__t")]
    for name, (lo, hi) in windows.items():
        w = base.rangeBetween(lo, hi)
        cols += [F.coalesce(F.sum("__n").over(w), F.lit(0)).alias(f"{name}_count"),
                 F.sum("__s").over(w).alias(f"{name}_sum")]
    return u.select(*cols).where(F.col("__t")).drop("__t")
