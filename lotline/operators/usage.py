"""Usage counters, overview, quotas and admission (survey 2.5 usage rows, 2.9
batch forms).

Admission ("the first N calls of a user per day pass") needs one cutoff per
user and day: the N-th smallest (timestamp, id). A hot user-day may hold a
large share of all calls, so cutoffs are found in two salted stages
(``nth_per_group``); calls are then compared with their cutoff.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotline.plans.bindings import QUOTA_LIMITS

# Role -> daily call limit (NULL = unlimited) and the monthly request cap.
ROLE_LIMITS = QUOTA_LIMITS
MONTHLY_CAP = 100_000


def daily_counter(events: DataFrame, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """(user_id, period_date, call_count) -- map-side partial counts."""
    return events.groupBy(F.col(user).alias("user_id"), F.to_date(F.col(ts)).alias("period_date")).agg(
        F.count(F.lit(1)).alias("call_count"))


def usage_overview(counters: DataFrame, today: Column, tables: Mapping[str, DataFrame] | None = None, cap: int = MONTHLY_CAP) -> DataFrame:
    """One row: today's total (0 if none), active users today, 7-day total
    (today and the 6 days before), month-to-date total, month label, the month's cap, the roles'
    daily limits, and ``{name}_count`` rows of each of ``tables``."""
    d = F.col("period_date")
    week_start = F.date_sub(today, 6)
    month_start = F.trunc(today, "month")
    return counters.agg(
        F.coalesce(F.sum(F.when(d == today, F.col("call_count"))), F.lit(0)).alias("today_total"),
        F.count_if((d == today) & (F.col("call_count") > 0)).alias("active_users_today"),
        F.coalesce(F.sum(F.when((d >= week_start) & (d <= today), F.col("call_count"))), F.lit(0)).alias("week_total"),
        F.coalesce(F.sum(F.when((d >= month_start) & (d <= today), F.col("call_count"))), F.lit(0)).alias("month_to_date"),
        F.date_format(today, "yyyy-MM").alias("month_label"),
        F.lit(cap).alias("monthly_cap"),
        *[F.lit(limit).alias(f"quota_{role}_per_day") for role, limit in ROLE_LIMITS.items() if limit is not None],
        *[df.select(F.count(F.lit(1))).scalar().alias(f"{name}_count") for name, df in (tables or {}).items()],
    )


def usage_by_day(counters: DataFrame, today: Column, days: int = 7) -> DataFrame:
    d = F.col("period_date")
    return counters.where((d >= F.date_sub(today, days - 1)) & (d <= today)).groupBy("period_date").agg(
        F.sum("call_count").alias("total_calls"))


def monthly_total_cap(counters: DataFrame, cap: int = MONTHLY_CAP) -> DataFrame:
    """Org-wide total per month and whether the cap is reached."""
    m = counters.groupBy(F.trunc("period_date", "month").alias("month")).agg(F.sum("call_count").alias("month_total"))
    return m.withColumn("cap", F.lit(cap)).withColumn("cap_reached", F.col("month_total") >= cap)


def role_limit(role: Column) -> Column:
    out = None
    for r, lim in ROLE_LIMITS.items():
        v = F.lit(lim).cast("int")
        out = F.when(role == r, v) if out is None else out.when(role == r, v)
    return out.otherwise(F.lit(ROLE_LIMITS["user"]).cast("int"))


def quota_status(users: DataFrame, counters: DataFrame, today: Column) -> DataFrame:
    """Per user: limit (NULL = unlimited), used today, remaining, reset date."""
    used = counters.where(F.col("period_date") == today).select("user_id", F.col("call_count").alias("used"))
    j = users.join(used, "user_id", "left")
    lim = role_limit(F.col("role"))
    used_c = F.when(lim.isNull(), F.lit(0).cast("bigint")).otherwise(F.coalesce(F.col("used"), F.lit(0)).cast("bigint"))
    return j.select(
        "user_id", "role", lim.alias("daily_limit"), used_c.alias("used_today"),
        F.when(lim.isNotNull(), F.greatest(F.lit(0).cast("bigint"), lim - used_c)).alias("remaining"),
        F.date_add(today, 1).alias("resets_at"),
    )


def top_n_per_group(df: DataFrame, group: Sequence[str], order: Sequence[str], n: Column | int,
                    salts: int = 16, salt_col: str | None = None) -> DataFrame:
    """Rows that rank <= n within their group under ``order`` (exact, ties
    broken by the full order), in two salted stages (see module docstring).
    ``n`` may be a per-row Column (NULL = unlimited: every row qualifies)."""
    group, order = list(group), list(order)
    nn = n if isinstance(n, Column) else F.lit(n)
    df = df.withColumn("__n", nn)
    unlimited = df.where(F.col("__n").isNull())
    limited = df.where(F.col("__n").isNotNull())
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in (salt_col and [salt_col] or order)]), F.lit(salts))
    limited = limited.withColumn("__salt", salt)
    w1 = Window.partitionBy(*group, "__salt").orderBy(*order)
    cand = limited.withColumn("__r1", F.row_number().over(w1)).where(F.col("__r1") <= F.col("__n"))
    w2 = Window.partitionBy(*group).orderBy(*order)
    top = cand.withColumn("__rank", F.row_number().over(w2)).where(F.col("__rank") <= F.col("__n"))
    return top.drop("__salt", "__r1").unionByName(
        unlimited.withColumn("__rank", F.lit(None).cast("int")))


def nth_per_group(df: DataFrame, group: Sequence[str], order: Sequence[str], n: int, salts: int = 16) -> DataFrame:
    """The n-th row of each group under ``order`` (groups with fewer rows are
    absent) as one struct column ``cutoff``.

    Two stages with a constant n: every (group, salt) keeps its n smallest --
    Spark prunes those before the shuffle -- then the group ranks what is left,
    so a hot group is never sorted whole."""
    group, order = list(group), list(order)
    salted = df.select(*group, *order).withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    first = Window.partitionBy(*group, "__salt").orderBy(*order)
    few = salted.withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= n).drop("__r", "__salt")
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return few.withColumn("__r", rank).where(F.col("__r") <= n).where(F.col("__r") == n).select(*group, F.struct(*order).alias("cutoff"))


def quota_admission(events: DataFrame, user: str = "user_id", ts: str = "ts", event_id: str = "event_id",
                    role: str = "role") -> DataFrame:
    """Every call with ``admitted`` and a reason: a call passes while the
    caller's count of earlier calls that day is below the role limit.

    Per (user, day) the last admitted call is the cutoff: one small row for
    each user and day that reach their limit. Calls are compared with it in a
    join on (user, day); calls of unlimited roles never join."""
    e = events.withColumn("period_date", F.to_date(F.col(ts)))
    limit = role_limit(F.col(role))
    keys, order = [user, "period_date"], [ts, event_id]
    limits = sorted({v for v in ROLE_LIMITS.values() if v is not None})
    limited = e.where(limit.isNotNull())
    cutoffs = None
    for n in limits:
        one = nth_per_group(limited.where(limit == n), keys, order, n)
        cutoffs = one if cutoffs is None else cutoffs.unionByName(one)
    j = limited.join(cutoffs, keys, "left")
    ok = F.col("cutoff").isNull() | (F.struct(*order) <= F.col("cutoff"))
    both = j.withColumn("admitted", ok).drop("cutoff").unionByName(e.where(limit.isNull()).withColumn("admitted", F.lit(True)))
    return both.select(user, event_id, ts, "period_date", role, "admitted",
                       F.when(F.col("admitted"), F.lit("ok")).otherwise(F.lit("quota_exhausted")).alias("reason"))


def _reaching(counts: DataFrame, group: Sequence[str], order: str, n: str, target: Column) -> DataFrame:
    """Of counts in order, the row of each group whose running sum reaches the
    target, with ``before``: the sum of the rows before it."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    upto = counts.withColumn("__upto", F.sum(n).over(w)).withColumn("before", F.col("__upto") - F.col(n))
    return upto.where((F.col("__upto") >= target) & (F.col("before") < target)).drop("__upto")


def monthly_cap_admission(events: DataFrame, ts: str = "ts", event_id: str = "event_id",
                          cap: int = MONTHLY_CAP) -> DataFrame:
    """Org-wide: once a month's running total reaches ``cap`` every further
    call that month is rejected.

    The ``cap``-th call of a month is its cutoff: counts per day, then per
    second of the day in which the cap is reached, lead to one second, whose
    calls are ranked. Every call is compared with its month's cutoff (one row
    a month, where there is one)."""
    month = F.trunc(F.col(ts).cast("date"), "month")
    e = events.withColumn("__month", month)
    day, second = F.to_date(F.col(ts)), F.date_trunc("second", F.col(ts))
    daily = e.groupBy("__month", day.alias("__day")).agg(F.count(F.lit(1)).alias("__n"))
    days = _reaching(daily, ["__month"], "__day", "__n", F.lit(cap)).select("__month", "__day", (F.lit(cap) - F.col("before")).alias("__left"))
    of_day = e.withColumn("__day", day).join(days, ["__month", "__day"]).withColumn("__second", second)
    seconds = of_day.groupBy("__month", "__left", "__second").agg(F.count(F.lit(1)).alias("__n"))
    spot = _reaching(seconds, ["__month", "__left"], "__second", "__n", F.col("__left")).select("__month", "__second", (F.col("__left") - F.col("before")).alias("__rank"))
    last = of_day.drop("__left").join(spot, ["__month", "__second"])
    rank = F.row_number().over(Window.partitionBy("__month").orderBy(ts, event_id))
    cutoff = last.withColumn("__r", rank).where(F.col("__r") == F.col("__rank")).select("__month", F.struct(ts, event_id).alias("cutoff"))
    j = e.join(cutoff, "__month", "left")
    ok = F.col("cutoff").isNull() | (F.struct(ts, event_id) <= F.col("cutoff"))
    return j.select(event_id, ts, ok.alias("admitted"))
