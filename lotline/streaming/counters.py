"""Structured Streaming twins of the usage operators (survey 2.9).

* ``stream_daily_counter``: per (user, UTC day) call counts with a watermark;
  update-mode micro-batches are written by ``foreachBatch`` into one folder
  per epoch (overwrite => a replayed epoch after a failure rewrites the same
  files, so the sink is idempotent); readers take the newest epoch per key.
* ``stream_quota_admission``: admits a call while the caller's count that day
  is below the role limit. The counters of each (group of users, day) live in the state
  store via ``applyInPandasWithState``, one call for all users of a group;
  an event-time timeout drops a day's state once the watermark has passed the end of that day.

Late data: ``watermark`` says how late a row may come. Rows that arrive later
than that are dropped by Spark; rows within it are counted wherever their file
stands in the order of arrival. Admission is decided in order of arrival of the
micro-batches, and by (ts, event id) inside one.

Event times arrive as wall-clock TIMESTAMP_NTZ (``ts``); days, ordering and
output use that column. Watermarks need an instant, so ``__ets`` is the same
wall clock read as UTC; the runs pin the session zone to UTC and restore the
caller's setting afterwards. Checkpoints go to the session's shared
checkpoint folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from lotline.plans.bindings import QUOTA_LIMITS, ROLE_CYCLE
from lotline.session import ensure_checkpoint_dir, ship_package


def event_stream(spark: SparkSession, sf_dir: str, table: str = "events", files_per_trigger: int = 1) -> DataFrame:
    """Stream the driver's event parquet (a folder of files on a cluster)."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    s = (spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet")
         .option("maxFilesPerTrigger", files_per_trigger).parquet(sf_dir))
    return s.withColumn("__ets", F.col("ts").cast("timestamp"))


def with_role(df: DataFrame) -> DataFrame:
    role = F.element_at(F.array(*[F.lit(r) for r in ROLE_CYCLE]), (F.col("user_id") % 3 + 1).cast("int"))
    return df.withColumn("role", role)


def _workdir(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/lotline-stream-{name}-{uuid.uuid4().hex}"


class _utc:
    """Pin the session time zone to UTC while a stream runs (instants of the
    wall-clock event times, UTC day windows); restore it afterwards."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self):
        self.old = self.spark.conf.get("spark.sql.session.timeZone")
        self.spark.conf.set("spark.sql.session.timeZone", "UTC")

    def __exit__(self, *exc):
        self.spark.conf.set("spark.sql.session.timeZone", self.old)


def stream_daily_counter(stream: DataFrame, sink_dir: str, checkpoint: str, watermark: str = "1 day",
                         user: str = "user_id"):
    """Start the watermarked daily counter; returns the StreamingQuery."""
    agg = (stream.withWatermark("__ets", watermark)
           .groupBy(F.window(F.col("__ets"), "1 day"), F.col(user).alias("user_id"))
           .agg(F.count(F.lit(1)).alias("call_count")))

    def write(batch: DataFrame, epoch: int) -> None:
        day = F.to_date(F.col("window.start").cast("timestamp_ntz"))
        out = batch.select("user_id", day.alias("period_date"), "call_count")
        out.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{sink_dir}/epoch={epoch}")

    return (agg.writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def read_counter_table(spark: SparkSession, sink_dir: str) -> DataFrame:
    """Latest count per (user, day) across epochs."""
    t = spark.read.option("basePath", sink_dir).parquet(f"{sink_dir}/epoch=*")
    return t.groupBy("user_id", "period_date").agg(F.max_by("call_count", "epoch").alias("call_count"))


_OUT_SCHEMA = ("user_id long, event_id long, ts timestamp_ntz, period_date date, role string, "
               "admitted boolean, reason string")
_STATE_SCHEMA = "users binary, used binary"
USER_GROUPS = 256  # of a day: the state of a group holds a number for each of its users


def _decision():
    """Which of a user's calls are admitted, in order, each by the limit of its role."""

    def decide(limit, used):
        import numpy as np

        if (limit == limit[0]).all():
            return np.arange(len(limit)) < limit[0] - used
        ok, n = np.zeros(len(limit), dtype=bool), used
        for i, most in enumerate(limit.tolist()):  # a user whose role changed during the day
            ok[i] = n < most
            n += ok[i]
        return ok

    return decide


def _timeout(key, state) -> int:
    """Keep the day's counter until the watermark passes the end of the (UTC) day; a day that
    ended before the watermark (a late batch) is kept until the watermark moves on."""
    import pandas as pd

    day_end_ms = int(pd.Timestamp(key[1]).value // 1_000_000) + 86_400_000
    return max(day_end_ms, state.getCurrentWatermarkMs() + 1)


def _admission():
    """The stateful function of one user and day."""
    limits, least, decide, timeout = dict(QUOTA_LIMITS), QUOTA_LIMITS["user"], _decision(), _timeout
    columns = ["user_id", "event_id", "ts", "period_date", "role", "admitted", "reason"]

    def admit(key, pdfs, state):
        import numpy as np
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        used = state.get[0] if state.exists else 0
        frames = list(pdfs)
        if not frames:
            return
        pdf = pd.concat(frames).sort_values(["ts", "event_id"])
        ok = decide(pdf["role"].map(lambda r: limits.get(r, least)).to_numpy(dtype=np.int64), used)
        pdf = pdf.assign(admitted=ok, reason=np.where(ok, "ok", "quota_exhausted"))
        state.update((used + int(ok.sum()),))
        state.setTimeoutTimestamp(timeout(key, state))
        yield pdf[columns]

    return admit


def _admissions():
    """The stateful function of a group of users and day: all its users at once, by
    one sort. The state is two arrays, the users and how many calls each has used."""
    limits, least, decide, timeout = dict(QUOTA_LIMITS), QUOTA_LIMITS["user"], _decision(), _timeout
    columns = ["user_id", "event_id", "ts", "period_date", "role", "admitted", "reason"]

    def admit(key, pdfs, state):
        import numpy as np
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        frames = list(pdfs)
        if not frames:
            return
        pdf = pd.concat(frames).sort_values(["user_id", "ts", "event_id"])
        # calls without a user are a group of their own, one user
        user = np.zeros(len(pdf), dtype=np.int64) if pdf["user_id"].isna().any() else pdf["user_id"].to_numpy(dtype=np.int64)
        limit = pdf["role"].map({r: limits.get(r, least) for r in pdf["role"].unique()}).fillna(least).to_numpy(dtype=np.int64)
        first = np.flatnonzero(np.concatenate([[True], user[1:] != user[:-1]]))
        ends = np.append(first[1:], len(user))
        users, known = user[first], [np.frombuffer(x, dtype=np.int64) for x in state.get] if state.exists else [np.zeros(0, dtype=np.int64)] * 2
        before = np.zeros(len(users), dtype=np.int64)
        if len(known[0]):
            at = np.minimum(np.searchsorted(known[0], users), len(known[0]) - 1)
            before = np.where(known[0][at] == users, known[1][at], 0)
        ok = np.arange(len(user)) - np.repeat(first, ends - first) < limit - np.repeat(before, ends - first)
        for i in np.flatnonzero(np.minimum.reduceat(limit, first) != np.maximum.reduceat(limit, first)):
            ok[first[i]:ends[i]] = decide(limit[first[i]:ends[i]], before[i])
        others = ~np.isin(known[0], users)
        all_users = np.concatenate([known[0][others], users])
        used = np.concatenate([known[1][others], before + np.add.reduceat(ok.astype(np.int64), first)])
        order = np.argsort(all_users)
        state.update((all_users[order].tobytes(), used[order].tobytes()))
        state.setTimeoutTimestamp(timeout(key, state))
        yield pdf.assign(admitted=ok, reason=np.where(ok, "ok", "quota_exhausted"))[columns]

    return admit


def stream_quota_admission(stream: DataFrame, sink_dir: str, checkpoint: str, watermark: str = "1 day"):
    """Start the admission stream; calls of unlimited roles bypass the state."""
    ship_package(stream.sparkSession)
    unlimited = [r for r, n in QUOTA_LIMITS.items() if n is None]
    s = with_role(stream).withColumn("period_date", F.to_date("ts")).withWatermark("__ets", watermark)
    s = s.select("user_id", "event_id", "ts", "period_date", "role", "__ets")
    free = F.col("role").isin(unlimited)
    group = F.when(F.col("user_id").isNotNull(), F.pmod(F.xxhash64("user_id"), F.lit(USER_GROUPS)).cast("int"))
    counted = s.where(~free).withColumn("user_group", group).groupBy("user_group", "period_date").applyInPandasWithState(
        _admissions(), _OUT_SCHEMA, _STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout)
    passed = s.where(free).select("user_id", "event_id", "ts", "period_date", "role", F.lit(True).alias("admitted"), F.lit("ok").alias("reason"))
    out = counted.unionByName(passed)
    return (out.writeStream.outputMode("append").format("parquet").option("path", sink_dir)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def run_daily_counter(spark: SparkSession, sf_dir: str, watermark: str = "1 day") -> DataFrame:
    """Run the stream over everything available, then read the result table."""
    work = _workdir(spark, "daily")
    with _utc(spark):
        stream_daily_counter(event_stream(spark, sf_dir), f"{work}/out", f"{work}/ckpt", watermark).awaitTermination()
    return read_counter_table(spark, f"{work}/out")


def run_quota_admission(spark: SparkSession, sf_dir: str, watermark: str = "1 day") -> DataFrame:
    """Run the admission stream over everything available, then read its output."""
    work = _workdir(spark, "quota")
    with _utc(spark):
        stream_quota_admission(event_stream(spark, sf_dir), f"{work}/out", f"{work}/ckpt", watermark).awaitTermination()
    return spark.read.schema(_OUT_SCHEMA).parquet(f"{work}/out")
