"""Semantics fixed in round 2, each with expectations written out by hand."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lotline.operators import joins, model, ranking, score, stats, usage


def test_metrics_of_a_constant_target(spark):
    df = spark.createDataFrame([("one", 5.0, 4.0), ("two", 1.0, 1.0), ("two", 3.0, 2.0)], "segment string, y double, yhat double")
    got = {(r.scope, r.segment): r for r in stats.regression_metrics(df, "y", "yhat", group="segment").collect()}
    assert got["segment", "one"].r2 is None and got["segment", "one"].mae == 1.0 and got["segment", "one"].median_ape == 0.2
    assert got["segment", "two"].r2 == pytest.approx(0.5)
    assert got["global", None].n == 3


def test_only_rare_trained_categories_collapse(spark):
    train = spark.createDataFrame([("often", "Bronx")] * 3 + [("seldom", "Bronx")], "nb string, boro string")
    df = spark.createDataFrame([("often", "Bronx"), ("seldom", "Queens"), ("seldom", None), ("unseen", "Bronx"), (None, "Bronx")], "nb string, boro string")
    got = model.collapse_rare(train, df, "nb", "boro", min_rows=3).select("nb").collect()
    assert sorted(str(r.nb) for r in got) == ["None", "Other_Queens", "Other_Unknown", "often", "unseen"]


def test_warnings_follow_the_routed_model(spark):
    rows = [(1, "rental_walkup", None, "ok"), (2, "rental_walkup", 0.0, "no_data"), (3, "rental_elevator", 4.0, "ok"), (4, "one_family", None, "ok"),
            (5, "global", 1.0, "ok"), (6, "global", 1.0, "partial"), (7, "condo_coop", 0.0, "invalid")]
    df = spark.createDataFrame(rows, "id int, key string, units double, status string")
    got = df.select("id", score.prediction_warnings(F.col("key"), F.col("units"), F.col("status")).alias("w"),
                    score.usable_model(F.col("key"), F.col("units")).alias("m")).collect()
    assert {r.id: (list(r.w), r.m) for r in got} == {
        1: (["missing_units"], "global"), 2: (["missing_units", "no_parcel_data"], "global"), 3: ([], "rental_elevator"), 4: ([], "one_family"),
        5: (["global_model_fallback"], "global"), 6: (["incomplete_parcel_data"], "global"), 7: (["invalid_parcel_id"], "condo_coop")}


def test_price_difference_without_a_market_price(spark):
    df = spark.createDataFrame([(10.0, 0.0), (10.0, -1.0), (12.0, 10.0)], "predicted_price double, market_price double")
    assert [r.price_difference_pct for r in score.score_predictions(df).collect()] == [0.0, 0.0, 20.0]


def test_twenty_folds_without_a_group(spark):
    folds = spark.createDataFrame([(i, dt.date(1950, 1, 1), dt.date(1969 + i, 12, 31), dt.date(1970 + i, 1, 31), dt.date(1970 + i, 12, 31)) for i in range(20)],
                                  "fold int, train_start date, train_end date, test_start date, test_end date")
    df = spark.createDataFrame([(dt.date(1960, 5, 5),), (dt.date(1980, 6, 1),), (dt.date(1980, 1, 15),), (dt.date(2050, 1, 1),)], "d date")
    got = ranking.assign_folds(df, folds, "d").groupBy("fold", "role").count().collect()
    assert len({r.fold for r in got}) == 20
    by = {(r.fold, r.role): r["count"] for r in got}
    assert by[0, "train"] == 1 and by[10, "test"] == 1 and by[19, "train"] == 3


def test_profile_reads_its_input_once(spark):
    df = spark.createDataFrame([(1.0, 2), (None, 4), (3.0, 9)], "a double, b int")
    prof = stats.profile_table(df, ["a", "b"])
    got = {r.feature: r for r in prof.collect()}
    assert (got["a"]["count"], got["a"].nulls, got["a"].mean, got["b"].max) == (2, 1, 2.0, 9.0)
    assert prof._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") + prof._jdf.queryExecution().optimizedPlan().toString().count("LocalRelation") == 1


def test_admission_cutoffs_under_a_hot_user(spark):
    at = dt.datetime(2024, 3, 1)
    rows = [(1, i, at + dt.timedelta(seconds=i // 3), "user") for i in range(300)] + [(2, 1000 + i, at, "admin") for i in range(30)]
    rows += [(3, 2000 + i, at + dt.timedelta(days=i % 2), "paid") for i in range(420)]
    df = spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp_ntz, role string").repartition(3)
    got = usage.quota_admission(df).where("admitted").groupBy("user_id", "period_date").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last")).collect()
    by = {(r.user_id, r.period_date.day): (r.n, r.last) for r in got}
    assert by[1, 1] == (10, 9) and by[2, 1] == (30, 1029) and by[3, 1] == (200, 2398) and by[3, 2] == (200, 2399)
    plan = usage.quota_admission(df)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    capped = usage.monthly_cap_admission(df, cap=100).where("admitted").collect()
    ordered = sorted((r[2], r[1]) for r in rows)[:100]
    assert sorted((r.ts, r.event_id) for r in capped) == ordered
    assert usage.monthly_cap_admission(df, cap=10_000).where("not admitted").count() == 0


def test_enrichment_keeps_the_row_count(spark):
    spine = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id int, k string")
    side = spark.createDataFrame([("a", 5), ("a", 4), ("c", 1)], "k string, v int")
    assert sorted((r.id, r.v) for r in joins.enrich_spine(spine, [(side, ["k"])]).collect() if r.v) == [(1, 4), (1, 4)]
    assert joins.enrich_spine(spine, [(side.dropDuplicates(["k"]), ["k"])], unique=True).count() == 3


@pytest.fixture
def late_files(spark, tmp_path):
    """Three files whose days arrive as 10, 1, 2 (one file a micro-batch)."""
    import os
    import time

    folder = tmp_path / "in"
    folder.mkdir()
    rows = []
    for k, day in enumerate((10, 1, 2)):
        part = pd.DataFrame({"event_id": range(100 * k, 100 * k + 24), "ts": [dt.datetime(2024, 1, day, 1, i) for i in range(24)], "user_id": [3] * 12 + [4] * 12})
        path = str(folder / f"part-{k}.parquet")
        spark.createDataFrame(part, "event_id long, ts timestamp_ntz, user_id long").coalesce(1).write.parquet(path)
        for f in (folder / f"part-{k}.parquet").iterdir():
            os.utime(f, (time.time() - 100 + k, time.time() - 100 + k))
        rows.append(part)
    return str(folder), pd.concat(rows)


def _late_stream(spark, folder):
    return (spark.readStream.schema("event_id long, ts timestamp_ntz, user_id long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
            .option("pathGlobFilter", "*.parquet").parquet(folder).withColumn("__ets", F.col("ts").cast("timestamp")))


def test_late_files_within_the_watermark_equal_the_batch(spark, tmp_path, late_files):
    from lotline.streaming import counters

    folder, rows = late_files
    with counters._utc(spark):
        counters.stream_daily_counter(_late_stream(spark, folder), f"{tmp_path}/out", f"{tmp_path}/ckpt", "30 days").awaitTermination()
        counters.stream_quota_admission(_late_stream(spark, folder), f"{tmp_path}/out2", f"{tmp_path}/ckpt2", "30 days").awaitTermination()
    got = {(r.user_id, r.period_date.day): r.call_count for r in counters.read_counter_table(spark, f"{tmp_path}/out").collect()}
    assert got == {(u, d): 12 for u in (3, 4) for d in (1, 2, 10)}
    admitted = {r.event_id for r in spark.read.parquet(f"{tmp_path}/out2").where("admitted").collect()}
    batch = usage.quota_admission(counters.with_role(spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long")))
    assert admitted == {r.event_id for r in batch.where("admitted").collect()}


def test_late_files_beyond_the_watermark_do_not_end_the_stream(spark, tmp_path, late_files):
    from lotline.streaming import counters

    with counters._utc(spark):
        counters.stream_quota_admission(_late_stream(spark, late_files[0]), f"{tmp_path}/out", f"{tmp_path}/ckpt").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").where("period_date = date'2024-01-10'").count() == 24


def test_truncate_reload_replaces_all_rows(spark, tmp_path):
    import uuid

    from lotline.sources import sinks

    table, path = f"reloaded_{uuid.uuid4().hex}", str(tmp_path / "table")
    for rows in ([("1", "a"), ("2", "b"), ("3", "c")], [("7", "z"), ("x", "y")]):
        fresh = spark.createDataFrame(rows, "key string, v string")
        sinks.truncate_reload(fresh, table, {"key": "id"}, {"id": "int"}, path)
    assert sorted((tuple(r) for r in spark.table(table).collect()), key=str) == [(7, "z"), (None, "y")]
    spark.sql(f"DROP TABLE {table}")


def test_scratch_folders_go(spark):
    from lotline import session

    made = session.materialize(spark.range(5).toDF("x"), "trial")
    folder = made.inputFiles()[0].rsplit("/", 1)[0]
    session.discard(made)
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert not fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder))
