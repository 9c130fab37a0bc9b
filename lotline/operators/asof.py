"""As-of (point-in-time safe) feature joins.

Every operator answers, for each distinct (key, as_of) of a spine, a question
about facts known *before* (or on) as_of, without ever pairing every spine row
with every fact of its key.

Plan shape (same for all four operators):

1. facts are pre-aggregated per (key, day) -- a groupBy with map-side partial
   aggregation, so a hot key (a third of all rows) collapses to one row per
   distinct day before the shuffle;
2. distinct spine keys are unioned in as marker rows at their as_of day;
3. one window ``partitionBy(key).orderBy(day)`` with a RANGE frame ending
   strictly before (``-1``) or at (``0``) the current day folds the prefix:
   ``sum`` of counts and ``max`` of a struct whose first fields are the
   recency order, i.e. "the newest fact";
4. marker rows are kept.

Per-key window partitions therefore hold at most (#distinct fact days +
#distinct as_of days) rows, which is bounded by the calendar, not by data
volume. The window needs only one shuffle on ``key``; AQE coalesces the small
partitions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_MARK = "__is_key"
_DAY = "__day"


def distinct_keys(spine: DataFrame, key: str, asof: str) -> DataFrame:
    """Distinct (key, as_of): the spine may repeat a key on one as_of day."""
    return spine.select(key, asof).where(F.col(key).isNotNull() & F.col(asof).isNotNull()).distinct()


def _prefix_scan(
    keys: DataFrame,
    key: str,
    asof: str,
    key_day: Column,
    facts: DataFrame,
    fact_day: Column,
    latest_fields: Sequence[Column],
    sum_cols: Sequence[str] = (),
    min_cols: Sequence[str] = (),
    inclusive: bool = False,
) -> DataFrame:
    """Core of every as-of operator; see module docstring.

    ``latest_fields``: Columns over ``facts`` -- the struct of the newest fact
    (its first fields decide recency and break ties).
    Output: keys columns + ``n`` + ``latest`` struct + ``sum_<c>`` + ``min_<c>``.
    """
    latest = F.struct(*latest_fields)
    per_day = facts.groupBy(F.col(key), F.unix_date(fact_day).alias(_DAY)).agg(
        F.count(F.lit(1)).alias("n"),
        F.max(latest).alias("latest"),
        *[F.sum(c).alias(f"sum_{c}") for c in sum_cols],
        *[F.count(c).alias(f"cnt_{c}") for c in sum_cols],
        *[F.min(c).alias(f"min_{c}") for c in min_cols],
    )
    markers = keys.select(F.col(key), F.col(asof), F.unix_date(key_day).alias(_DAY))
    u = per_day.withColumn(_MARK, F.lit(False)).unionByName(
        markers.withColumn(_MARK, F.lit(True)), allowMissingColumns=True
    )
    end = 0 if inclusive else -1
    w = Window.partitionBy(key).orderBy(F.col(_DAY)).rangeBetween(Window.unboundedPreceding, end)
    scanned = u.select(
        F.col(key),
        F.col(asof),
        F.col(_MARK),
        F.coalesce(F.sum("n").over(w), F.lit(0)).alias("n"),
        F.max("latest").over(w).alias("latest"),
        *[F.sum(f"sum_{c}").over(w).alias(f"sum_{c}") for c in sum_cols],
        *[F.sum(f"cnt_{c}").over(w).alias(f"cnt_{c}") for c in sum_cols],
        *[F.min(f"min_{c}").over(w).alias(f"min_{c}") for c in min_cols],
    )
    return scanned.where(F.col(_MARK)).drop(_MARK)


def asof_event_history(
    spine: DataFrame,
    events: DataFrame,
    key: str = "bbl",
    asof: str = "as_of_date",
    ts: str = "document_date",
    tiebreak: str = "document_id",
    carry: Sequence[str] = ("document_amt",),
    prefix: str = "deed",
) -> DataFrame:
    """Events strictly before as_of: count, newest event's fields, days since.

    Output per distinct (key, as_of): ``{prefix}_cnt`` (0 when none),
    ``{prefix}_last_date`` (timestamp), ``{prefix}_last_<c>`` for ``carry``,
    ``{prefix}_days_since_last`` (whole days, floored for time parts).
    """
    keys = distinct_keys(spine, key, asof)
    ev = events.where(F.col(ts).isNotNull())
    out = _prefix_scan(
        keys, key, asof, F.col(asof),
        ev, F.to_date(F.col(ts)),
        [F.col(ts).alias("ts"), F.col(tiebreak).alias("tb"), *[F.col(c).alias(c) for c in carry]],
    )
    last_ts = F.col("latest.ts")
    return out.select(
        F.col(key),
        F.col(asof),
        F.col("n").alias(f"{prefix}_cnt"),
        last_ts.alias(f"{prefix}_last_date"),
        *[F.col(f"latest.{c}").alias(f"{prefix}_last_{c}") for c in carry],
        F.timestamp_diff("DAY", last_ts, F.col(asof).cast("timestamp_ntz")).alias(f"{prefix}_days_since_last"),
    )


def asof_latest_version(
    spine: DataFrame,
    versions: DataFrame,
    key: str = "bbl",
    asof: str = "as_of_date",
    year: str = "year",
    order: Sequence[Column] | None = None,
    carry: Sequence[str] = (),
    prefix: str = "roll",
    keep_unmatched: bool = True,
) -> DataFrame:
    """Newest yearly version available on as_of (version Y is known from Y-01-01).

    ``order``: extra recency / tie-break Columns after the year (e.g. a period
    rank), so the pick is deterministic. Unmatched keys are kept with NULLs.
    """
    keys = distinct_keys(spine, key, asof)
    order = list(order or [])
    fields = [F.col(year).alias("y"), *[o.alias(f"o{i}") for i, o in enumerate(order)], *[F.col(c).alias(c) for c in carry]]
    out = _prefix_scan(
        keys, key, asof, F.col(asof),
        versions.where(F.col(year).isNotNull()),
        F.make_date(F.col(year).cast("int"), F.lit(1), F.lit(1)),
        fields,
        inclusive=True,
    )
    res = out.select(
        F.col(key),
        F.col(asof),
        F.col("latest.y").alias(f"{prefix}_{year}"),
        *[F.col(f"latest.{c}").alias(f"{prefix}_{c}") for c in carry],
    )
    if not keep_unmatched:
        res = res.where(F.col(f"{prefix}_{year}").isNotNull())
    return res


def asof_cumulative(
    spine: DataFrame,
    versions: DataFrame,
    key: str = "bbl",
    asof: str = "as_of_date",
    year: str = "tax_year",
    tiebreak: str = "row_id",
    carry: Sequence[str] = ("abatement", "init_year", "expiry_year"),
    sum_col: str = "abatement",
    min_col: str = "init_year",
    expiry_col: str = "expiry_year",
    prefix: str = "j51",
) -> DataFrame:
    """Versions with ``year < year(as_of)``: newest row's fields, cumulative sum,
    earliest value, active flag (newest expiry >= as_of year; NULL if unknown).

    The sum is 0 when rows exist but all values are NULL, NULL when no row exists.
    """
    keys = distinct_keys(spine, key, asof)
    yr = F.year(F.col(asof)).cast("bigint")
    out = _prefix_scan(
        keys, key, asof, F.make_date(yr.cast("int"), F.lit(1), F.lit(1)),
        versions.where(F.col(year).isNotNull()),
        F.make_date(F.col(year).cast("int"), F.lit(1), F.lit(1)),
        [F.col(year).alias("y"), F.col(tiebreak).alias("tb"), *[F.col(c).alias(c) for c in carry]],
        sum_cols=[sum_col],
        min_cols=[min_col],
    )
    exp = F.col(f"latest.{expiry_col}")
    return out.select(
        F.col(key),
        F.col(asof),
        F.col("latest.y").alias(f"{prefix}_last_tax_year"),
        *[F.col(f"latest.{c}").alias(f"{prefix}_last_{c}") for c in carry],
        F.when(F.col("n") > 0, F.coalesce(F.col(f"sum_{sum_col}"), F.lit(0.0))).alias(f"{prefix}_total_{sum_col}"),
        F.col(f"min_{min_col}").alias(f"{prefix}_earliest_{min_col}"),
        F.when(exp.isNotNull(), (exp >= yr).cast("int")).alias(f"{prefix}_active_flag"),
    )


def asof_latest_snapshot(
    requests: DataFrame,
    snapshots: DataFrame,
    keys: Sequence[str],
    asof: str = "as_of_date",
    snapshot_date: str = "snapshot_date",
    carry: Sequence[str] = (),
    max_age_days: int | None = None,
    prefix: str = "snap",
) -> DataFrame:
    """Newest snapshot with ``snapshot_date <= as_of`` per composite key.

    ``max_age_days`` optionally rejects snapshots older than that many days.
    """
    keys = list(keys)
    ck = "__ck"
    req = requests.select(*keys, asof).where(F.col(asof).isNotNull()).distinct().withColumn(ck, F.struct(*keys))
    snaps = snapshots.where(F.col(snapshot_date).isNotNull()).withColumn(ck, F.struct(*keys))
    out = _prefix_scan(
        req.select(ck, asof), ck, asof, F.col(asof),
        snaps, F.col(snapshot_date).cast("date"),
        [F.col(snapshot_date).cast("date").alias("d"), *[F.col(c).alias(c) for c in carry]],
        inclusive=True,
    )
    d = F.col("latest.d")
    ok = d.isNotNull()
    if max_age_days is not None:
        ok = ok & (F.datediff(F.col(asof), d) <= max_age_days)
    return out.select(
        *[F.col(f"{ck}.{k}").alias(k) for k in keys],
        F.col(asof),
        F.when(ok, d).alias(f"{prefix}_date"),
        *[F.when(ok, F.col(f"latest.{c}")).alias(f"{prefix}_{c}") for c in carry],
    )


@dataclass(frozen=True)
class Side:
    """One table of typed facts for ``asof_many``.

    ``visible``: the first day (a date over ``facts``) on which a fact is known.
    ``latest``: name -> Column of the newest fact; the first ones decide which
    fact of a day is the newest. ``sums`` / ``mins``: names of numbers in
    ``facts`` that are folded over all facts known so far.
    """

    name: str
    facts: DataFrame
    visible: Column
    latest: dict[str, Column]
    sums: tuple[str, ...] = ()
    mins: tuple[str, ...] = ()


def asof_many(spine: DataFrame, sides: Sequence[Side], key: str = "bbl", asof: str = "as_of_date") -> DataFrame:
    """What every side knew of a key on every as_of day, in one merge.

    The sides become one stream of typed facts, folded once by (key, day) with
    map-side combine, and one window over a key's days carries the counts, sums
    and newest facts of all sides to the as_of markers: two shuffles in all, however many sides there
    are, where an as-of join a side takes two each and one to put them together.

    Per distinct (key, as_of): ``{side}_cnt`` (0 when none), ``{side}`` (the newest
    fact as a struct, ``visible`` day first, or NULL), ``{side}_sum_<c>`` (NULL when no fact, 0 when
    all values are NULL) and ``{side}_min_<c>``.
    """
    stream = distinct_keys(spine, key, asof).select(F.col(key), F.unix_date(F.col(asof).cast("date")).alias(_DAY), F.col(asof))
    folded: list[Column] = [F.max(asof).alias(asof)]
    for s in sides:
        fact = F.struct(F.unix_date(s.visible).alias("day"), *[c.alias(n) for n, c in s.latest.items()])
        part = s.facts.where(s.visible.isNotNull()).select(
            F.col(key), F.unix_date(s.visible).alias(_DAY), fact.alias(s.name),
            *[F.col(c).alias(f"{s.name}_sum_{c}") for c in s.sums], *[F.col(c).alias(f"{s.name}_min_{c}") for c in s.mins])
        stream = stream.unionByName(part, allowMissingColumns=True)
        folded += [F.count(s.name).alias(f"{s.name}_cnt"), F.max(s.name).alias(s.name)]
        folded += [F.sum(f"{s.name}_sum_{c}").alias(f"{s.name}_sum_{c}") for c in s.sums]
        folded += [F.min(f"{s.name}_min_{c}").alias(f"{s.name}_min_{c}") for c in s.mins]
    days = stream.where(F.col(key).isNotNull()).groupBy(key, _DAY).agg(*folded)
    w = Window.partitionBy(key).orderBy(_DAY).rangeBetween(Window.unboundedPreceding, 0)
    out: list[Column] = []
    for s in sides:
        n = F.sum(f"{s.name}_cnt").over(w)
        out += [n.alias(f"{s.name}_cnt"), F.max(s.name).over(w).alias(s.name)]
        out += [F.when(n > 0, F.coalesce(F.sum(f"{s.name}_sum_{c}").over(w), F.lit(0))).alias(f"{s.name}_sum_{c}") for c in s.sums]
        out += [F.min(f"{s.name}_min_{c}").over(w).alias(f"{s.name}_min_{c}") for c in s.mins]
    return days.select(key, asof, *out).where(F.col(asof).isNotNull())
