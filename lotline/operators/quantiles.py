"""Exact group quantiles by counting, with bounded memory.

Spark's exact ``percentile`` aggregate merges every distinct value of a group
in one task. This module finds the same linear-interpolated quantile (pandas
``quantile``, SQL ``quantile_cont``) by ranks instead:

1. the input is read once and reduced to (group, value, count): partial
   aggregation folds ties, so a value repeated a billion times is one row;
2. the order statistics wanted of each group (two ranks per quantile) start
   with the band of all its values. A band of more than ``MAX_BAND`` distinct
   values is cut into ``CELLS`` equal cells between its least and largest
   value; cell counts and their running sum say which cell holds the rank, and
   that cell (its own least and largest value) is the next band. Both ends of
   a band fall into different cells, so every turn leaves fewer values;
3. in a band of at most ``MAX_BAND`` distinct values a running count gives the
   value at the rank.

Turns go on until every band is small: there is no limit on them, on values
or on rows. No list of values is built anywhere; windows hold ``CELLS`` or
``MAX_BAND`` rows of one rank at most, and the cell counts are partial sums, so a
group with all rows of the table is no hot task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotline.session import discard, materialize

MAX_BAND = 20_000  # distinct values of a band that one running count may go over
CELLS = 4_096


def exact_quantiles(df: DataFrame, group: Sequence[str], value: str, qs: Mapping[str, float],
                    max_band: int = MAX_BAND, cells: int = CELLS, thin: bool = False) -> DataFrame:
    """One row per group with a column per name in ``qs`` (exact quantiles).

    NULL values are ignored; groups without values are absent. Group keys
    are matched NULL-safely (a NULL key is a group of its own). NaN counts as
    the largest value. ``thin``: the input is read twice and few values are
    stored, for input that is cheaper to read than to store.
    """
    group = list(group)
    keys = [F.col(c).alias(f"__g{i}") for i, c in enumerate(group)]
    g = [f"__g{i}" for i in range(len(group))]
    v = F.col(value).cast("double")
    values = df.select(*keys, v.alias("__v")).where("__v is not null")
    counted = _thinned(values, g, list(qs.values())) if thin else values.groupBy(*g, "__v").agg(F.count(F.lit(1)).alias("__c"))
    counted = materialize(counted, "quantile-counts")

    def band():
        """Rows, distinct values and ends (also of the finite values) of a band."""
        finite = F.when(F.abs("__v") < float("inf"), F.col("__v"))
        return [F.sum("__c").alias("rows"), F.count(F.lit(1)).alias("kinds"), F.min("__v").alias("lo"), F.max("__v").alias("hi"),
                F.min(finite).alias("flo"), F.max(finite).alias("fhi")]

    start = counted.groupBy(*g).agg(*band()).withColumnRenamed("rows", "n")
    place = {name: (F.col("n") - 1).cast("double") * F.lit(float(q)) for name, q in qs.items()}
    ranks = F.array_distinct(F.array(*[f(p).cast("long") for p in place.values() for f in (F.floor, F.ceil)]))
    state = start.select(*g, "n", F.explode(ranks).alias("k"), F.lit(0).cast("long").alias("below"), "kinds", "lo", "hi", "flo", "fhi")
    state = materialize(state, "quantile-state")

    def inside(bands: DataFrame) -> DataFrame:
        b = bands.select(*[F.col(c).alias(f"{c}b") for c in g], "n", "k", "below", "lo", "hi", "flo", "fhi")
        cond = [F.col(c).eqNullSafe(F.col(f"{c}b")) for c in g] + [F.col("__v") >= F.col("lo"), F.col("__v") <= F.col("hi")]
        return counted.join(b, cond)

    def holding(rows: DataFrame, order: str, count: str) -> DataFrame:
        """Of the rows of each rank, in order, the one whose running count reaches it."""
        w = Window.partitionBy(*g, "n", "k").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("__upto", F.col("below") + F.sum(count).over(w))
        return rows.where((F.col("__upto") > F.col("k")) & (F.col("__upto") - F.col(count) <= F.col("k")))

    while not state.where(F.col("kinds") > max_band).isEmpty():
        wide = inside(state.where(F.col("kinds") > max_band))
        # subtracting, dividing and rounding down never change the order of two values; halves cannot overflow
        part = (F.col("__v") / 2 - F.col("flo") / 2) / F.nullif(F.col("fhi") / 2 - F.col("flo") / 2, F.lit(0.0))
        cell = (F.when(F.isnan("__v"), cells + 2).when(F.col("__v") == float("inf"), cells + 1).when(F.col("__v") == float("-inf"), -1)
                .otherwise(F.least(F.floor(F.coalesce(part, F.lit(0.0)) * cells), F.lit(cells - 1))))
        found = holding(wide.groupBy(*g, "n", "k", "below", cell.alias("cell")).agg(*band()), "cell", "rows")
        small = state.where(F.col("kinds") <= max_band)
        after = materialize(small.unionByName(found.select(*g, "n", "k", (F.col("__upto") - F.col("rows")).alias("below"), "kinds", "lo", "hi", "flo", "fhi")), "quantile-state")
        discard(state)
        state = after
    at = holding(inside(state), "__v", "__c").select(*g, "n", "k", "__v")
    nth = lambda p: F.max(F.when(F.col("k") == p.cast("long"), F.col("__v")))
    ends = [x for name, p in place.items() for x in (nth(F.floor(p)).alias(f"__a_{name}"), nth(F.ceil(p)).alias(f"__b_{name}"))]
    wide = at.groupBy(*g, "n").agg(*ends)
    out = []
    for name, p in place.items():
        a, b = F.col(f"__a_{name}"), F.col(f"__b_{name}")
        out.append(F.when(a == b, a).otherwise(a + (p - F.floor(p)) * (b - a)).alias(name))
    return wide.select(*[F.col(k).alias(c) for k, c in zip(g, group, strict=True)], *out)


def _thinned(values: DataFrame, g: Sequence[str], qs: Sequence[float]) -> DataFrame:
    """Counts of values (``g``, __v, __c) in which the values of the cells that hold no wanted rank are one, the
    cell's least: the values at the ranks stay what they are. Cells are steps of a 32nd of an octave of 1 + |value|."""
    size = F.floor(F.log2(F.abs("__v") + 1.0) * 32)
    cell = F.when(F.isnan("__v"), 1 << 20).when(F.abs("__v") == float("inf"), F.signum("__v") * (1 << 19)).otherwise(F.signum("__v") * size).cast("int")
    celled = values.withColumn("__cell", cell)
    counts = materialize(celled.groupBy(*g, "__cell").agg(F.count(F.lit(1)).alias("__c"), F.min("__v").alias("__v")), "quantile-cells")
    w = Window.partitionBy(*g) if g else Window.partitionBy(F.lit(1))
    upto = F.sum("__c").over(w.orderBy("__cell").rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.select("*", upto.alias("__upto"), F.sum("__c").over(w).alias("__n"))
    ranks = [f((F.col("__n") - 1).cast("double") * F.lit(float(q))).cast("long") for q in qs for f in (F.floor, F.ceil)]
    holds = F.lit(False)
    for k in ranks:
        holds = holds | ((F.col("__upto") > k) & (F.col("__upto") - F.col("__c") <= k))
    placed = materialize(placed.withColumn("__holds", holds), "quantile-cells")
    wanted = placed.where("__holds").select(*[F.col(c).alias(f"{c}h") for c in g], F.col("__cell").alias("__cellh"))
    inside = celled.join(wanted, [celled["__cell"] == wanted["__cellh"], *[celled[c].eqNullSafe(wanted[f"{c}h"]) for c in g]], "left_semi")
    return inside.groupBy(*g, "__v").agg(F.count(F.lit(1)).alias("__c")).unionByName(placed.where("not __holds").select(*g, "__v", "__c"))


def exact_quantiles_with_global(df: DataFrame, group: Sequence[str], value: str, qs: Mapping[str, float],
                                **kw) -> DataFrame:
    """Per-group and global quantiles in ONE run: the values are
    stacked once more under a ``__scope = 'all'`` key (group columns NULL).
    Output has ``__scope`` ('group' / 'all') next to the group columns."""
    group = list(group)
    scopes = F.explode(F.array(F.lit("group"), F.lit("all")))
    kept = lambda c: F.when(F.col("__scope") == "group", F.col(c)).alias(c)
    both = df.select(*[F.col(c) for c in group], F.col(value).alias("__x"), scopes.alias("__scope")).select("__scope", *[kept(c) for c in group], "__x")
    return exact_quantiles(both, ["__scope", *group], "__x", qs, **kw)
